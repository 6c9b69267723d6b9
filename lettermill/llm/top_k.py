"""Exact top-k search by inner product: dual-tree search over cells of vectors and the queries that may find them there.

Vectors are dealt into cells by their nearest pivot (a bounded sample of them), each with a covering radius: the top of
the tree. A query is first searched in the cell whose pivot it likes best; its k-th score there prunes whole cells, by the
same bound that prunes pairs of nodes below. It is then sent only to the cells whose bound passes. Cells of many vectors
are split into blocks of bounded size, and the queries of a cell into groups; each pair of block and group is one task's
work, with a cover tree on either side. Its at most k rows a query are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cover_tree import Search
from .shared import by_batch, small_batches, written

#: Vectors that make a cell on average, most cells; most vectors of a block, those under one tree, and queries of a group.
CELL, PIVOTS, BLOCK, TREE, QUERIES = 4096, 2048, 16_384, 1024, 4096
SCALE = 256
#: The cell of vectors whose length no pivot has.
OTHER = -1


def scaled(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: each component x as floor(256 * x); vectors null, or with null or non-finite components, go."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull())
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


class Cells:
    """The pivots by length, and the radii of their cells."""

    def __init__(self, pivots: list[list[int]], kind: str):
        self.kind, self.pivots, self.radius = kind, [np.array(p, np.int64) for p in pivots], np.zeros(len(pivots))
        self.rest = 0.0
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(p) for p in pivots}:
            cells = np.array([i for i, p in enumerate(pivots) if len(p) == size], np.int64)
            self.by_length[size] = cells, np.array([pivots[i] for i in cells], np.float64).reshape(len(cells), size)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell and its distance from the pivot, rounded up."""
        norms = np.sqrt((vectors**2).sum(axis=1))
        if vectors.shape[1] not in self.by_length:
            return np.full(len(vectors), OTHER, np.int64), norms * (1 + 1e-9)
        cells, centres = self.by_length[vectors.shape[1]]
        size = np.sqrt((centres**2).sum(axis=1))
        best = (size**2 - 2 * vectors @ centres.T).argmin(axis=1)
        away = np.sqrt(((vectors - centres[best]) ** 2).sum(axis=1))
        return cells[best], away + 1e-9 * (norms + size[best])

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells that may hold vectors of the queries' length, and no less than each query's best score there."""
        norms = np.sqrt((queries**2).sum(axis=1))
        if queries.shape[1] not in self.by_length:
            return np.array([OTHER]), (norms * self.rest * (1 + 1e-9) + 1)[:, None]
        cells, centres = self.by_length[queries.shape[1]]
        size = np.sqrt((centres**2).sum(axis=1))
        return cells, queries @ centres.T + norms[:, None] * (self.radius[cells] + 1e-9 * size)[None, :] + 1e-6


def _by_length(column: pa.Array, kind: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length, and their vectors: of lists of numbers, or of bytes of ``kind``."""
    if kind:
        values = [np.frombuffer(x, kind).astype(np.int64) for x in column.to_pylist()]
    else:
        values = [np.array(x, np.int64) for x in column.to_pylist()]
    sizes = np.array([len(v) for v in values], np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.array([values[i] for i in rows], np.int64).reshape(len(rows), size)


def _dealt(shared, of_queries: bool):
    """Packed vectors with their cell; for queries, the cell whose pivot scores best."""

    def make():
        cells: Cells = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            cell, away, packed = np.full(n, OTHER, np.int64), np.zeros(n), [b""] * n
            for rows, vectors in _by_length(batch.column(1)):
                if of_queries:
                    some = cells.by_length.get(vectors.shape[1])
                    if some is not None:
                        cell[rows] = some[0][(vectors.astype(np.float64) @ some[1].T).argmax(axis=1)]
                else:
                    cell[rows], away[rows] = cells.nearest(vectors.astype(np.float64))
                for i, v in zip(rows, vectors, strict=True):
                    packed[i] = v.astype(cells.kind).tobytes()
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(cell), pa.array(away)], ["vec_id", "v", "cell", "away"])

        return step

    return by_batch(make)


def _asked(shared):
    """A row for each query and each cell that may hold a vector of its best ``k``."""

    def make():
        cells: Cells = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            worst = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            worst[np.isnan(worst)] = -np.inf
            asks, where = [], []
            for rows, vectors in _by_length(batch.column(1), cells.kind):
                found, bounds = cells.bounds(vectors.astype(np.float64))
                slack = 1e-9 * np.abs(np.where(np.isfinite(worst[rows]), worst[rows], 0))
                i, j = np.nonzero(bounds >= (worst[rows] - slack)[:, None])
                asks.append(rows[i])
                where.append(found[j])
            picked = batch.take(pa.array(np.concatenate(asks)))
            return pa.RecordBatch.from_arrays([*picked.columns, pa.array(np.concatenate(where).astype(np.int64))], ["vec_id", "v", "home", "worst", "cell"])

        return step

    return by_batch(make)


def _searched(k: int, kind: str):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        query_ids, ids = queries["vec_id"].to_numpy(), vectors["vec_id"].to_numpy()
        worst = queries["worst"].to_numpy().astype(np.float64)
        worst[np.isnan(worst)] = -np.inf
        against = {v.shape[1]: (rows, v) for rows, v in _by_length(vectors["v"], kind)}
        for rows, q in _by_length(queries["v"], kind):
            if q.shape[1] in against:  # an inner product needs equal lengths
                others, v = against[q.shape[1]]
                search = Search(q, query_ids[rows], k, worst[rows])
                for low in range(0, len(others), TREE):
                    search.add(v[low : low + TREE], ids[others[low : low + TREE]])
                out += [(np.full(len(f), i), f, s) for i, f, s in zip(query_ids[rows], search.found, search.scores, strict=True)]
        columns = [np.concatenate([x[i] for x in out]) if out else np.empty(0) for i in range(3)]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def _searched_in(asked: DataFrame, vectors: DataFrame, groups: DataFrame, k: int, kind: str) -> DataFrame:
    """``query_id, vec_id, score`` of ``asked(vec_id, v, worst, cell, block)`` in blocks of ``vectors(vec_id, v, cell, block)``;
    ``groups(cell, groups)`` is small."""
    group = F.pmod(F.xxhash64("vec_id"), "groups").cast("int").alias("group")
    left = asked.join(F.broadcast(groups), "cell").select("vec_id", "v", "worst", "cell", "block", group)
    right = vectors.join(F.broadcast(groups), "cell").select("vec_id", "v", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    keys = ["cell", "block", "group"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_searched(k, kind), "query_id long, vec_id long, score long")


def _groups(asked: DataFrame) -> DataFrame:
    """Groups of queries of each cell: a row a cell."""
    rows = asked.groupBy("cell").agg(F.count("*").alias("n")).collect()
    return asked.sparkSession.createDataFrame([(r["cell"], -(-r["n"] // QUERIES)) for r in rows], "cell long, groups int")


def _cells(vectors: DataFrame, queries: DataFrame) -> Cells:
    """Pivots: the vectors with the smallest hashes of their ids, as many as cells of CELL vectors, PIVOTS at most."""
    n, low, high = vectors.unionByName(queries).agg(F.count("*"), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    kind = next((f"<i{b}" for b in (2, 4) if (low or 0) >= -(1 << 8 * b - 1) and (high or 0) < 1 << 8 * b - 1), "<i8")
    wanted, spread = min(PIVOTS, -(-n // CELL)), 1 << 40
    place = F.pmod(F.xxhash64("vec_id"), F.lit(spread)).alias("place")
    some = vectors.select("v", place).filter(F.col("place") < min(spread, 4 * wanted * spread // max(n, 1) + 1))
    found = [tuple(r["v"]) for r in some.orderBy("place", "v").limit(wanted).collect()]
    return Cells([list(v) for v in dict.fromkeys(found)], kind)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its ``k`` highest integer inner products.

    Both tables have ``vec_id`` and ``embedding``; vectors are floored at 256 times their components. Candidates are all
    ``vectors`` but the query's own id; ties go to the smaller vec_id; fewer candidates give fewer rows. Vectors or
    ids that are null, and vectors with a null or non-finite component, take no part. Equal repeated rows count once.
    Vectors are only held against vectors of their own length. Components and scores beyond a long are the nearest long.
    Empty tables give no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    vectors, queries = scaled(vectors), scaled(queries)
    cells = _cells(vectors, queries)
    shared = spark.sparkContext.broadcast(cells)
    packed = "vec_id long, v binary, cell long, away double"
    # of equal vectors only the k + 1 smallest ids can be among the best
    first = F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))
    dealt = vectors.mapInArrow(_dealt(shared, False), packed).withColumn("first", first).filter(F.col("first") <= k + 1).drop("first")
    dealt = written(dealt.dropDuplicates(["v", "vec_id"]), "vectors")
    stats = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()
    for r in stats:
        if r["cell"] == OTHER:
            cells.rest = r["away"]
        else:
            cells.radius[r["cell"]] = r["away"]
    shared.unpersist()
    blocks = spark.createDataFrame([(r["cell"], -(-r["n"] // BLOCK)) for r in stats], "cell long, blocks int")
    dealt = dealt.join(F.broadcast(blocks), "cell").select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"))
    asking = queries.mapInArrow(_dealt(shared, True), packed).select("vec_id", "v", F.col("cell").alias("home")).distinct()
    asking = written(asking, "queries")
    at_home = asking.select("vec_id", "v", F.col("home").alias("cell"), F.lit(0).alias("block"), F.lit(None).cast("long").alias("worst"))
    seeds = written(_searched_in(at_home, dealt.filter("block = 0"), _groups(at_home), k, cells.kind), "seeds")
    worst = seeds.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("worst"))
    known = asking.join(worst, "vec_id", "left").select("vec_id", "v", "home", "worst")
    asked = known.mapInArrow(_asked(spark.sparkContext.broadcast(cells)), "vec_id long, v binary, home long, worst long, cell long")
    every = asked.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("cell <> home or block > 0")
    rest = _searched_in(every, dealt, _groups(asked), k, cells.kind)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return seeds.union(rest).select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


#: The same for the table ``embeddings`` with its ids divisible by 50 as queries.
SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
)
select query_id, rank, vec_id, score
from (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
where rank <= 5
"""
