"""Near-duplicate documents by HyperMinHash signatures, banding and a check of whole shingle sets.

1. Each document's five-word shingles become registers of leading zeros plus mantissa (``registers.py``).
2. Documents with equal shingle sets form a class, which gets a number of its own (``rep``); a class of any number of
   copies is one row from here on. Its text is read where its smallest doc_id stands.
3. Representatives are banded. Every bucket of a band has a leader, the member with the smallest hash, and each
   representative is held against the smallest of its buckets' leaders, on whole sets: one comparison a representative,
   whatever the size of a group. Buckets whose members are linked by now, or were all held against their leader and are
   no more than that, are done. Rounds with other hashes follow while they link a good part of what is left of a large
   bucket. So a group of copies whose members are mostly linked with each other costs in proportion to its size.
4. What is left is compared exhaustively. Representatives of one leader form a group, those of a group that have one
   component already and are many a family of their own; families are dealt into chunks of bounded size. Chunks of one
   group or of groups that meet in some bucket are held against each other (small ones packed together), never those of
   one component: pairs whose estimated similarity can't be ruled out are compared on whole sets. Only a spanning forest
   of the confirmed links leaves the task, never all pairs.
5. Components of the confirmed links give each document's component.

Shingles are 64-bit hashes. Two sets of n shingles differ in their measured intersection from the true one with probability
of about n * n / 2**64 (5e-14 for a thousand words each, and a wrong link also needs the sets at the threshold).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import registers as R
from .components import components
from .shared import as_bytes, broadcast_if_small, by_batch, discard, measured, small_batches, written

#: Documents in a chunk and bytes of their sets; a task holds two chunks.
CHUNK, CHUNK_BYTES = 512, 16_000_000
#: Most rounds of comparisons with leaders; groups in a bucket that are paired, beyond which the bucket is a group of its own.
ROUNDS, PAIRED = 12, 12
#: Six standard deviations of an estimate from REGISTERS registers at the threshold; closer pairs are verified.
SLACK = 0.22

_SIGNATURES = "doc_id long, mark long, n_shingles long, fp binary, regs binary"


def _signatures():
    hashes = R.WordHashes()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, prints, regs = [], [], []
        for text in as_bytes(batch.column(2)):
            shingles = R.shingle_set(text, hashes)
            sizes.append(len(shingles))
            prints.append(R.fingerprint(shingles))
            regs.append(R.raw_registers(shingles).tobytes())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary())],
            ["doc_id", "mark", "n_shingles", "fp", "regs"],
        )

    return step


def _banded(batch: pa.RecordBatch) -> pa.RecordBatch:
    filled = R.densified(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, R.REGISTERS))
    keys = R.band_keys(filled)
    flat = pa.array(keys.reshape(-1))
    offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * R.BANDS)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.ListArray.from_arrays(offsets, flat)], ["rep", "fp", "n", "at", "keys"])


def _payloads():
    hashes = R.WordHashes()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, keep = [], []
        for text, fp in zip(as_bytes(batch.column(2)), batch.column(1).to_pylist(), strict=True):
            shingles = R.shingle_set(text, hashes)
            keep.append(R.fingerprint(shingles) == fp)  # another text under the same doc_id and hash
            sets.append(shingles.tobytes())
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["rep", "fp", "shingles"])
        return out.filter(pa.array(keep))

    return step


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph with this symmetric adjacency matrix."""
    left, edges = np.ones(len(links), bool), []
    for root in range(len(links)):
        if left[root]:
            left[root] = False
            front = [root]
            while front:
                x = front.pop()
                new = np.flatnonzero(links[x] & left)
                left[new] = False
                edges.extend((x, y) for y in new.tolist())
                front.extend(new.tolist())
    return edges


def _intersections(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of ``rows``, exactly: products of 0/1 rows, some shingles at a time."""
    lengths = [len(sets[r]) for r in rows]
    _, inverse, counts = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), lengths)
    shared = counts[inverse] > 1
    owner, inverse = owner[shared], inverse[shared]
    rank = np.cumsum(counts > 1) - 1
    inverse = rank[inverse]
    out, width = np.zeros((len(rows), len(rows)), np.float32), 4096
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    for low in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        a, b = np.searchsorted(inverse, (low, low + width))
        block = np.zeros((len(rows), width), np.float32)
        block[owner[a:b], inverse[a:b] - low] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _led(percent: int):
    """For the rows of a unit: links between leaders (rows that are their own leader) and what they lead, by label."""

    def confirmed(table: pa.Table) -> pa.Table:
        leader, rep, label, leads = (table[c].to_pylist() for c in ("leader", "rep", "label", "leader_label"))
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        heads = {r: sets[i] for i, r in enumerate(rep) if leader[i] == r}
        links = {(label[i], leads[i]) for i, r in enumerate(rep) if leader[i] != r and R.linked(heads[leader[i]], sets[i], percent)}
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return confirmed


def _links(percent: int):
    least = percent / 100 - SLACK

    def confirmed(table: pa.Table) -> pa.Table:
        side, label = table["side"].to_numpy(), table["label"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        n = np.array([len(x) for x in sets], np.int64)
        filled = R.densified(np.stack([R.raw_registers(x) for x in sets]))
        maybe = np.zeros((len(sets), len(sets)), bool)
        for i in range(len(sets)):
            same = (filled[i] == filled).mean(axis=1)
            maybe[i] = ((same - R.CHANCE) / (1 - R.CHANCE) >= least) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        maybe &= (side[:, None] != side[None, :]) | (side == 2)[:, None]
        maybe &= label[:, None] != label[None, :]
        rows = np.flatnonzero(maybe.any(axis=1))
        edges: list[tuple[int, int]] = []
        if 0 < len(rows) <= 8:
            edges = [(i, j) for i in rows.tolist() for j in rows.tolist() if i < j and maybe[i, j] and R.linked(sets[i], sets[j], percent)]
        elif len(rows):
            both = _intersections(sets, rows)
            links = maybe[np.ix_(rows, rows)] & (100 * both >= percent * (n[rows][:, None] + n[rows][None, :] - both))
            edges = [(int(rows[i]), int(rows[j])) for i, j in _forest(links)]
        return pa.table({"a": pa.array([label[i] for i, _ in edges], pa.int64()), "b": pa.array([label[j] for _, j in edges], pa.int64())})

    return confirmed


def _with_leader(live: DataFrame, salt: int) -> DataFrame:
    """``live(key, rep, n, label)`` with its bucket's ``head``."""
    mark = F.struct(F.xxhash64("rep", F.lit(salt)).alias("order"), "rep", "n", "label")
    return live.join(live.groupBy("key").agg(F.min(mark).alias("head")), "key")


def _led_links(first: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: labels joined by links between representatives and the leaders of ``first``."""
    near = F.col("rep") != F.col("leader.rep")
    near &= (F.col("label") != F.col("leader.label")) & (100 * F.least("n", "leader.n") >= percent * F.greatest("n", "leader.n"))
    pairs = first.filter(near).select("rep", "n", "label", F.col("leader.rep").alias("leader"), F.col("leader.n").alias("leader_n"), F.col("leader.label").alias("leader_label"))
    led = pairs.groupBy("leader").agg(F.sum("n").alias("total"), F.first("leader_n").alias("leader_n"), F.first("leader_label").alias("leader_label"))
    led, sums = measured(led.withColumn("chunks", F.expr(f"int((8 * total + {CHUNK_BYTES - 1}) div {CHUNK_BYTES})")), "led", size=F.coalesce(F.sum(F.col("total") * 8), F.lit(0)))
    units = (sums["size"] // CHUNK_BYTES + 1) * 4
    # leaders of few are packed into common units, those of many get several units of their own
    unit = lambda chunk: F.when(F.col("chunks") == 1, F.xxhash64(F.lit("packed"), F.pmod(F.xxhash64("leader"), F.lit(units)))).otherwise(F.xxhash64("leader", chunk)).alias("unit")
    followers = pairs.join(led.select("leader", "chunks"), "leader").select(unit(F.pmod(F.xxhash64("rep"), "chunks").cast("int")), "leader", "rep", "label", "leader_label")
    heads = led.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(unit(F.col("i")), "leader", F.col("leader").alias("rep"), F.col("leader_label").alias("label"), "leader_label")
    return followers.union(heads).join(sets, "rep").groupBy("unit").applyInArrow(_led(percent), "a long, b long")


def _unresolved(led: DataFrame, first: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, rep, n, label``: buckets that may hold a link between different labels, without leaders that are done."""
    rows = led.select("key", "rep", "n", F.col("head.rep").alias("head")).join(labels, "rep").join(first.select("rep", F.col("leader.rep").alias("leader")), "rep")
    other = F.col("rep") != F.col("head")
    of = lambda f, c: f(F.when(c, F.col("label")))
    per = rows.groupBy("key").agg(
        F.count_if(other & (F.col("leader") != F.col("head"))).alias("unchecked"), F.min("label").alias("lo"), F.max("label").alias("hi"), of(F.min, other).alias("lo_other"), of(F.max, other).alias("hi_other")
    )
    done = F.col("unchecked") == 0  # every other member was held against the leader
    per = per.filter(F.when(done, F.col("lo_other") < F.col("hi_other")).otherwise(F.col("lo") < F.col("hi"))).select("key", done.alias("done"))
    return rows.join(per, "key").filter(~F.col("done") | other).select("key", "rep", "n", "label")


def _exhaustive(live: DataFrame, first: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links between labels that join the same as all links between members of a bucket do."""
    hop = first.select(F.col("rep").alias("grp"), F.col("leader.rep").alias("next"))
    grouped = first.select("rep", F.col("leader.rep").alias("grp")).join(hop, "grp", "left").select("rep", F.coalesce("next", "grp").alias("grp"))
    rows = written(live.join(grouped, "rep").select("key", "rep", "n", "label", F.struct(F.lit(0).alias("kind"), F.col("grp").alias("id")).alias("grp")), "grouped")
    meets = rows.select("key", "grp").distinct()
    per = written(meets.groupBy("key").agg(F.count("*").alias("groups")).filter("groups > 1"), "meets")
    paired = meets.join(per.filter(f"groups <= {PAIRED}").select("key"), "key")
    across = paired.join(paired.toDF("key", "other"), "key").filter("grp < other").select("grp", "other").distinct()
    wide = rows.join(per.filter(f"groups > {PAIRED}").select("key"), "key").withColumn("grp", F.struct(F.lit(1).alias("kind"), F.col("key").alias("id")))

    members = rows.unionByName(wide).select("grp", "rep", "n", "label").distinct()
    alike = members.groupBy("grp", "label").agg(F.count("*").alias("alike")).filter(F.col("alike") >= CHUNK).select("grp", "label", F.lit(True).alias("big"))
    big = F.coalesce("big", F.lit(False))
    fam = F.struct("grp", big.alias("big"), F.when(big, F.col("label")).otherwise(0).alias("label")).alias("fam")
    members = written(members.join(alike, ["grp", "label"], "left").select(fam, "rep", "n", "label"), "families")
    weight = F.greatest(F.count("*"), F.expr(f"sum(8 * n) * {CHUNK} div {CHUNK_BYTES}"))  # in documents, or as many by bytes
    sizes = members.groupBy("fam").agg(F.count("*").alias("members"), weight.alias("n"))
    sizes = written(sizes.withColumn("chunks", F.expr(f"int((n + {CHUNK - 1}) div {CHUNK})")), "sizes")
    placed = members.join(sizes.select("fam", "chunks"), "fam").select("fam", F.pmod(F.xxhash64("rep"), "chunks").cast("int").alias("chunk"), "rep", "label")

    left, right = (sizes.select(*[F.col(c).alias(f"{c}_{x}") for c in ("fam", "n", "chunks")]) for x in "ab")
    same = left.join(right, (F.col("fam_a.grp") == F.col("fam_b.grp")) & (F.col("fam_a") < F.col("fam_b")))
    met = across.join(left, F.col("grp") == F.col("fam_a.grp")).join(right, F.col("other") == F.col("fam_b.grp")).drop("grp", "other")
    one = F.col("fam_a.big") & F.col("fam_b.big") & (F.col("fam_a.label") == F.col("fam_b.label"))
    pairs = same.unionByName(met).filter(~one)
    first_larger = F.col("n_a") >= F.col("n_b")
    pairs = pairs.select(*[F.when(first_larger, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{x}") for x, y in ("ab", "ba") for c in ("fam", "n", "chunks")])
    # the chunks of the smaller families that meet a larger one are packed into bins, so that its chunks repeat once a bin
    chunk = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spot = lambda f, c, s: [F.col(f).alias("fam"), F.col(c).alias("chunk"), F.lit(s).alias("side")]
    bins = pairs.groupBy("fam_a").agg(F.expr(f"int((sum(n_b) + {CHUNK - 1}) div {CHUNK})").alias("bins"))
    pieces = pairs.withColumn("j", chunk("chunks_b")).join(bins, "fam_a").withColumn("bin", F.pmod(F.xxhash64("fam_b", "j"), "bins"))
    pieces = pieces.withColumn("i", chunk("chunks_a")).withColumn("unit", F.xxhash64("fam_a", "i", "bin"))
    between = pieces.select("unit", *spot("fam_b", "j", 1)).union(pieces.select("unit", "fam_a", "i").distinct().select("unit", *spot("fam_a", "i", 0)))
    within = sizes.filter("members > 1 and not fam.big").withColumn("i", chunk("chunks")).withColumn("j", F.explode(F.sequence("i", F.col("chunks") - 1)))
    inside = within.select(F.xxhash64("fam", "i", "j", F.lit("within")).alias("unit"), "fam", F.inline(F.when(F.expr("i = j"), F.array(F.struct(F.col("i").alias("chunk"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(F.col("i").alias("chunk"), F.lit(0).alias("side")), F.struct(F.col("j").alias("chunk"), F.lit(1).alias("side"))))))
    units = between.unionByName(inside).join(placed, ["fam", "chunk"]).select("unit", "side", "rep", "label")
    return units.join(sets, "rep").groupBy("unit").applyInArrow(_links(percent), "a long, b long")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``rep, label`` after these links between labels."""
    found = components(links)
    new = found.toDF("label", "component")
    out = written(labels.join(new, "label", "left").select("rep", F.coalesce("component", "label").alias("label")), "labels")
    discard(found)
    return out


def joined(docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """``rep, label``: the component of each representative that shares a bucket with another one.

    ``docs(doc_id, mark, text)``; ``reps(rep, fp, n, at, keys)`` are the representatives, the doc_id and mark of a text of each, and
    their band keys.
    """
    rows = reps.select("rep", "n", F.explode("keys").alias("key"))
    several = rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    live = written(rows.join(several, "key").select("key", "rep", "n", F.col("rep").alias("label")), "members")
    wanted, asked = measured(live.select("rep").distinct().join(reps.select("rep", "fp", "at.*"), "rep"), "wanted", n=F.count("*"))
    texts = docs.join(broadcast_if_small(wanted), ["doc_id", "mark"]).select("rep", "fp", "text")
    sets, held = measured(texts.mapInArrow(by_batch(_payloads), "rep long, fp binary, shingles binary"), "sets", n=F.count("*"))
    if held["n"] > asked["n"]:  # repeated rows
        sets = written(sets.groupBy("rep", "fp").agg(F.first("shingles").alias("shingles")), "sets")
    sets = sets.select("rep", "shingles")
    labels, left = wanted.select("rep", F.col("rep").alias("label")).distinct(), None
    for salt in range(ROUNDS):
        led = _with_leader(live, salt)
        first = written(led.groupBy("rep").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.min("head").alias("leader")), "first")
        labels = _relabelled(labels, _led_links(first, sets, percent))
        last, live = live, written(_unresolved(led, first, labels), "live")
        discard(last)
        alone = live.groupBy("key").agg(F.count_if(F.col("label") == F.col("rep")).alias("alone"))
        before, (left, some) = left, alone.agg(F.coalesce(F.max("alone"), F.lit(0)), F.count("*") > 0).first()
        if left <= CHUNK or before and left > 0.75 * before:
            break
    return _relabelled(labels, _exhaustive(live, first, sets, percent)) if some else labels


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    ``n_shingles`` is the size of the row's set of five-word shingles; documents are linked if 100 * intersection is at
    least ``percent`` * union; ``component_id`` is the smallest doc_id reachable by links, ``kept`` whether it is the
    row's own. A null or empty text, or one without words, has no shingles and is linked with nothing. Rows of equal
    doc_id are one document: if their texts differ, each keeps its size, and the links of all of them hold for it; but a row
    without words stays alone. A null doc_id is linked with nothing and kept. Long texts
    are shingled whole; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    signed = written(docs.mapInArrow(by_batch(_signatures), _SIGNATURES), "signatures")
    with_text = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = with_text.groupBy("fp").agg(F.min(F.struct("doc_id", "mark")).alias("at"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # fixed by being written
    fewest = -(-percent // (100 - percent)) if percent < 100 else 1 << 40  # below it, no other size of set is near enough
    reps = classes.filter(F.col("n") >= fewest).select("rep", "fp", "regs", "n", "at").mapInArrow(by_batch(lambda: _banded), "rep long, fp binary, n long, at struct<doc_id: long, mark: long>, keys array<long>")
    reps = written(reps, "bands")
    several, found = measured(with_text.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("doc_id"), "several", n=F.count("*"))
    labelled = joined(docs, reps, percent).join(classes.select("rep", "fp", F.col("at.doc_id").alias("first")), "rep")
    linked = labelled.join(labelled.groupBy("label").agg(F.min("first").alias("component")), "label").select("fp", "component")
    of_class = classes.select("fp", F.col("at.doc_id").alias("first")).join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component"))
    if found["n"]:  # the texts of one doc_id are one document
        of_class = written(of_class, "components")
        shared = with_text.join(several, "doc_id").join(of_class, "fp").select("doc_id", "component").distinct()
        least = shared.groupBy("doc_id").agg(F.min("component").alias("least"))
        merged = components(shared.join(least, "doc_id").select(F.col("component").alias("a"), F.col("least").alias("b"))).toDF("component", "merged")
        of_class = of_class.join(merged, "component", "left").select("fp", F.coalesce("merged", "component").alias("component"))
    out = signed.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("fp")).alias("fp")).join(of_class, "fp", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
