"""Registered queries against brute force over whole tables: ``python -m tests.llm.whole_tables FOLDER [QUERY ...]``.

Not part of the test suite, as it takes minutes. Prints a line for each query: rows, and rows that differ.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lettermill.llm import pii, queries
from lettermill.llm.pretokens import ranked
from lettermill.session import local_session

from .test_operators import JSON, PATTERN, RANKS, brute_contamination, brute_pii, lower


def exact_groups(texts: dict[int, str | None], percent: int) -> dict[int, tuple[int, int]]:
    """Sizes of shingle sets and components by a prefix-filtered join of whole sets."""
    of, numbers = defaultdict(list), {}
    for doc_id, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        shingles = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        of[frozenset(numbers.setdefault(s, len(numbers)) for s in shingles)].append(doc_id)
    parent = {i: i for i in texts}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a: int, b: int) -> None:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    counts = Counter(s for held in of for s in held)
    index: dict[int, list[frozenset]] = defaultdict(list)
    for held, ids in sorted(of.items(), key=lambda x: len(x[0])):
        if not held:
            continue
        for other in ids[1:]:
            join(ids[0], other)
        ordered = sorted(held, key=lambda s: (counts[s], s))
        prefix = ordered[: len(ordered) - -(-percent * len(ordered) // 100) + 1]
        for other in {o for s in prefix for o in index[s]}:
            if 100 * len(other) >= percent * len(held) and find(of[other][0]) != find(ids[0]):
                both = len(held & other)
                if 100 * both >= percent * (len(held) + len(other) - both):
                    join(ids[0], of[other][0])
        for s in prefix:
            index[s].append(held)
    return {i: (len(held), find(i)) for held, ids in of.items() for i in ids}


def wanted(name: str, table) -> dict | None:
    """The rows that a query should give, by key; None where DuckDB is asked instead."""
    docs = lambda: table("select doc_id, text from documents order by doc_id")
    if name == "op1_decontaminate":
        rows = docs()
        found = brute_contamination([t for _, t in rows], [r for r in table("select item_id, text from benchmark") if r[0] is not None])
        return {i: f for (i, _), f in zip(rows, found, strict=True)}
    if name == "op3_pii":
        out = {}
        for i, text in docs():
            spans = sorted(brute_pii(text or ""), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
            kinds = Counter(s[0] for s in spans)
            out[i] = (*(kinds[k] for k in pii.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())
        return out
    if name == "op4_token_counts":
        encode = ranked(RANKS, PATTERN).encode_ordinary
        sizes = Counter(len(encode(t or "")) for _, t in docs())
        at_least = lambda n, f: sum(f(s) * c for s, c in sizes.items() if s >= n)
        return {n: (c, at_least(n, lambda s: 1), at_least(n, lambda s: s), sum(min(s, n) * k for s, k in sizes.items())) for n, c in sizes.items()}
    if name == "op8_token_files":
        library, start, out = Tokenizer.from_file(JSON), 0, {}
        for i, text in docs():
            ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
            out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
        return out
    if name == "op9_near_duplicates":
        return {i: (n, c, c == i) for i, (n, c) in exact_groups(dict(docs()), 85).items()}
    if name == "op10_bpe":
        encode, out = ranked(RANKS, PATTERN).encode_ordinary, {}
        for i, text in docs():
            ids = encode(text or "")
            out[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        return out
    if name == "op6_top_k":
        rows = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in table("select vec_id, embedding from embeddings where embedding is not null order by vec_id") if all(x is not None and np.isfinite(x) for x in v)]
        ids, vectors = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
        out = {}
        for i, v in rows:
            if i % 50 == 0:
                scores = vectors @ v
                best = [j for j in np.lexsort((ids, -scores)).tolist() if ids[j] != i][:5]
                out |= {(i, rank): (int(ids[j]), int(scores[j])) for rank, j in enumerate(best, 1)}
        return out
    return None


COLUMNS = {
    "op1_decontaminate": ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), "op3_pii": ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"),
    "op4_token_counts": ("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "truncated_tokens"), "op6_top_k": ("query_id", "rank", "vec_id", "score"), "op8_token_files": ("doc_id", "start", "n_tokens", "ids_crc32"),
    "op9_near_duplicates": ("doc_id", "n_shingles", "component_id", "kept"), "op10_bpe": ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"),
}


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:] or [*queries.queries()]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings", "pages"):
        path = f"{folder}/{name}.parquet"
        duck.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    for name in names:
        found = queries.queries()[name](spark, folder)
        if name == "op2_language":
            known = dict(duck.execute("select doc_id, lang from documents where lang is not null").fetchall())
            held = [r for r in found.collect() if r["held_out"] and r["doc_id"] in known and r["lang_pred"] != "und"]
            print(name, len(held), "held-out rows,", sum(known[r["doc_id"]] != r["lang_pred"] for r in held), "differ", flush=True)
            continue
        columns = COLUMNS.get(name)
        if columns is None:
            result = duck.execute(queries.oracle_sql()[name])
            columns = [d[0] for d in result.description]
            want = Counter(result.fetchall())
            have = Counter(tuple(r) for r in found.select(*columns).collect())
            print(name, sum(have.values()), "rows,", sum((want - have).values()) + sum((have - want).values()), "differ from DuckDB", flush=True)
            continue
        key = 2 if name == "op6_top_k" else 1
        have = {tuple(r)[:key] if key > 1 else r[0]: tuple(r)[key:] for r in found.select(*columns).collect()}
        want = wanted(name, lambda sql: duck.execute(sql).fetchall())
        print(name, len(have), "rows,", len(have.keys() ^ want.keys()) + sum(have[k] != want[k] for k in have.keys() & want.keys()), "differ", flush=True)
    spark.stop()


if __name__ == "__main__":
    assert public_tokenizers.PATTERN == PATTERN
    main()
