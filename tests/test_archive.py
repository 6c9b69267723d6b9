"""Segments, inventories, recovery, index maintenance, content-addressed storage and sync."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from lettermill.operators import cas, catalogue, index, integrity, recovery
from lettermill.schemas import INDEXED_DOCS, SEARCH_DOCS
from lettermill.sources import export, providers, segments, synthetic
from lettermill.streaming import sync


def digest(raw):
    return hashlib.sha256(raw).digest()


@pytest.fixture
def archive(spark, tmp_path):
    """Twelve messages in segments of 200 bytes, and their catalogue."""
    raws = {i: f"Subject: n{i}\r\nFrom: <a{i}@x.y>\r\n\r\nbody {i} {'x' * i}".encode() for i in range(12)}
    records = spark.createDataFrame(sorted(raws.items()), "doc_id long, raw binary")
    placed = sorted(tuple(r) for r in segments.write_segments(records, str(tmp_path / "raw"), limit=200, writers=1).collect())
    rows = [(i, f"<{i}>", s, o, n, digest(raws[i]), "") for i, s, o, n in placed]
    messages = spark.createDataFrame(rows, "doc_id long, message_id string, segment string, archive_offset long, frame_bytes long, raw_digest binary, folder string")
    return str(tmp_path / "raw"), messages, raws, placed


def test_round_trip_and_rotation(spark, archive):
    folder, messages, raws, placed = archive
    frames = segments.read_frames(spark, folder).cache()
    assert {int(r["doc_id"]): bytes(r["raw"]) for r in frames.collect()} == raws and frames.filter("status <> 'valid'").count() == 0
    assert len({s for _, s, _, _ in placed}) > 3 and all(o == 0 or o + n <= 200 for _, _, o, n in placed)
    assert {r["doc_id"]: bytes(r["raw"]) for r in integrity.validated_raw(frames, messages).collect()} == raws
    assert [r["claimed_id"] for r in segments.read_range(spark, folder, messages, 3, 6).collect()] == [3, 4, 5]
    assert segments.read_at(spark, folder, placed[4][1], placed[4][2]).first()["doc_id"] == 4
    assert segments.directory_bytes(spark, folder).first()[0] == sum(n for *_, n in placed) == segments.segment_sizes(spark, folder).agg(F.sum("bytes")).first()[0]
    sizes = spark.createDataFrame([(i, n, "w") for i, _, _, n in placed], "doc_id long, size long, writer string")
    assigned = {r["doc_id"]: (f"segment-{r['segment_number']:06d}.arc", r["offset"]) for r in segments.assign_segments(sizes, "doc_id", "size", "writer", 200).collect()}
    assert assigned == {i: (s, o) for i, s, o, _ in placed}
    assert segments.next_segment(["segment-000003.arc", "x"], ["segment-000007.arc", "../segment-9.arc"]) == 8
    assert segments.read_segments(spark, folder).count() == 12
    summary = catalogue.archive_summary(messages, integrity.record_inventory(messages, frames, segments.segment_sizes(spark, folder)), frames).first()
    assert (summary["messages"], summary["available"], summary["missing"]) == (12, 12, 0)


def test_seeks(spark, archive, tmp_path):
    folder, messages, raws, placed = archive
    wanted = messages.filter("doc_id in (2, 9)").select("segment", F.col("archive_offset").alias("offset"))
    wanted = wanted.union(wanted).union(spark.createDataFrame([("segment-000000.arc", 1), ("segment-000000.arc", 10**6), ("segment-000000.arc", None), ("segment-99.arc", 0), ("../x.arc", 0), (None, 0)], "segment string, offset long"))
    found = segments.seek_frames(spark, folder, wanted).collect()
    assert {int(r["doc_id"]): bytes(r["raw"]) for r in found if r["status"] == "valid"} == {i: raws[i] for i in (2, 9)}
    assert sorted(r["status"] for r in found) == ["corrupt"] + ["missing"] * 5 + ["valid"] * 2
    every = segments.seek_frames(spark, folder, messages.select("segment", F.col("archive_offset").alias("offset")))
    columns = segments.FRAMES.replace(" string", "").replace(" long", "").replace(" decimal(20,0)", "").replace(" binary", "").split(", ")
    assert sorted(map(tuple, every.select(columns).collect()), key=str) == sorted(map(tuple, segments.read_frames(spark, folder).select(columns).collect()), key=str)
    assert segments.read_range(spark, f"file://{folder}", messages, 3, 6).count() == 3


class Counting:
    """A file system that counts the bytes read."""

    def __init__(self, system):
        self.system, self.bytes, self.opened = system, 0, 0

    def get_file_info(self, what):
        return self.system.get_file_info(what)

    def open_input_file(self, path):
        self.opened += 1
        file, outer = self.system.open_input_file(path), self

        class Reads:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                file.close()

            def read(self, n=None):
                data = file.read(n)
                outer.bytes += len(data)
                return data

            size, seek = file.size, file.seek

        return Reads()


def test_filters_reach_the_segment_source(spark, archive, monkeypatch):
    from pyspark.sql import datasource as D

    folder, messages, raws, placed = archive
    _, segment, offset, size = placed[7]
    load = lambda: segments.read_segments(spark, folder)
    one = load().filter((F.col("segment") == segment) & (F.col("offset") == offset))
    assert "Filter (" not in one._jdf.queryExecution().executedPlan().toString() and [(int(r["doc_id"]), bytes(r["raw"])) for r in one.collect()] == [(7, raws[7])]
    every = {(s, o): i for i, s, o, _ in placed}
    first = placed[0][1]
    for condition, wanted in (
        (F.col("segment") == first, {i for i, s, *_ in placed if s == first}), (F.col("segment").isin(first, segment, "none.arc"), {i for i, s, *_ in placed if s in (first, segment)}), (F.col("offset") > 0, {i for i, _, o, _ in placed if o > 0}),
        ((F.col("offset") >= 10) & (F.col("offset") < 90), {i for i, _, o, _ in placed if 10 <= o < 90}), (F.col("offset").isin(0, 1), {i for i, _, o, _ in placed if o == 0}), ((F.col("offset") == 0) & (F.col("offset") > 0), set()), (F.col("doc_id") == 5, {5}),
    ):
        assert {int(r["doc_id"]) for r in load().filter(condition).collect()} == wanted
    assert len(every) == 12
    counting = Counting(segments._opened(folder)[0])
    monkeypatch.setattr(segments, "_opened", lambda path: (counting, path))
    reader = segments._Reader(folder)
    rest = [*reader.pushFilters([D.EqualTo(("segment",), segment), D.EqualTo(("offset",), offset), D.IsNotNull(("offset",)), D.EqualTo(("status",), "valid")])]
    assert rest == [D.EqualTo(("status",), "valid")]
    (part,) = reader.partitions()
    assert [r[3] for r in reader.read(part)] == [7] and (counting.opened, counting.bytes) == (1, size)  # the frame and nothing else


def test_few_sources_however_many_segments(spark, tmp_path, monkeypatch):
    """A source is planned for a few segments, and the others' frames are found too; small segments share a partition."""
    from lettermill.plans import archive_queries

    texts = {i: f"text {i} " + "x" * (i % 40) for i in range(1500)}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(archive_queries, "LIMIT", 1000)
    loaded, load = [], segments.read_segments
    monkeypatch.setattr(segments, "read_segments", lambda spark, folder: loaded.append(folder) or load(spark, folder))
    found = archive_queries.segment_pushdown(spark, str(tmp_path))
    md5 = lambda i: hashlib.md5(texts[i].encode()).hexdigest()
    assert sorted(map(tuple, found.collect())) == sorted([(i, md5(i)) for i in texts] + [(-1, md5(i)) for i in texts if i % 50 == 3])
    assert len(loaded) == 1 + archive_queries.FILTERED  # one for each of the thirty segments before
    reader, sizes = segments._Reader(loaded[0]), segments.segment_sizes(spark, loaded[0]).count()
    assert sizes > 60 and len(reader.partitions()) == 1 and len(reader.partitions()[0].segments) == sizes
    monkeypatch.setattr(segments, "PART_BYTES", 2500)
    parts = reader.partitions()
    assert 3 * len(parts) >= sizes > len(parts) and len({n for p in parts for n in p.segments}) == sum(len(p.segments) for p in parts) == sizes


def test_a_frame_behind_a_corrupt_one(spark, archive):
    folder, _, raws, placed = archive
    inside = [p for p in placed if p[1] == placed[-1][1]] if placed[-1][2] else [p for p in placed if p[1] == placed[0][1]]
    first, last = inside[0], inside[-1]
    path = f"{folder}/{first[1]}"
    with open(path, "r+b") as file:
        file.seek(first[3] - 1)
        file.write(b"!")
    load = lambda: segments.read_segments(spark, folder).filter(F.col("segment") == first[1])
    assert [r["status"] for r in load().collect()] == ["corrupt"]
    assert [(int(r["doc_id"]), r["status"]) for r in load().filter(F.col("offset") == last[2]).collect()] == [(last[0], "valid")]
    assert [r["status"] for r in load().filter(F.col("offset") == first[2]).collect()] == ["corrupt"] and load().filter(F.col("offset") == 7).collect() == []


def test_publishing_by_compare_and_swap(spark):
    old = [(i, f"<{i}>", "segment-000000.arc", 100 * i, 50, bytes([i]) * 32) for i in range(1, 7)]
    schema = "doc_id long, message_id string, segment string, archive_offset long, frame_bytes long, raw_digest binary"
    before = spark.createDataFrame(old, schema)
    expected = recovery.expected_rows(before, before.select("doc_id")).cache()
    expected.count()
    now = spark.createDataFrame([old[0], old[1], (3, "<3>", "segment-000001.arc", 0, 50, bytes([3]) * 32), old[3], old[3], old[5], (9, "<9>", "s", 0, 1, b"")], schema)
    gmail = spark.createDataFrame([(i, "gmail:a", f"m{i}", "deleted" if i == 2 else "present") for i in range(1, 7)], "doc_id long, source_account string, gmail_message_id string, source_state string")
    imap = spark.createDataFrame([], "doc_id long, source_account string, mailbox string, uid_validity long, uid long, source_state string")
    chosen = spark.createDataFrame([(i, "gmail", "gmail:a", "other" if i == 6 else f"m{i}") for i in range(1, 7)], "doc_id long, kind string, source_account string, identity string")
    placed = spark.createDataFrame([(i, "segment-000009.arc", 60 * i, 60) for i in range(1, 7)], "doc_id long, segment string, offset long, frame_bytes long")
    after, outcomes = recovery.publish(now, expected, recovery.source_evidence(gmail, imap), chosen, placed)
    told = {r["doc_id"]: (r["outcome"], r["reason"]) for r in outcomes.collect()}
    assert told == {1: ("published", None), 2: ("conflict", "not one present identity"), 3: ("conflict", "the catalogue row changed"), 4: ("conflict", "2 catalogue rows"), 5: ("conflict", "0 catalogue rows"), 6: ("conflict", "another identity")}
    rows = sorted(map(tuple, after.collect()))
    assert rows[0] == (1, "<1>", "segment-000009.arc", 60, 60, bytes([1]) * 32) and sorted(map(tuple, now.collect()))[1:] == rows[1:] and after.columns == now.columns


def test_reconciliation(spark):
    from lettermill.operators.reconcile import reconcile

    schema = "id long, digest string, message_id string, date_ms long, size long"
    a = [(1, "d1", "m1", 1, 1), (2, "d2", "m2", 2, 2), (3, "d3", "m3", 3, 3), (4, "x", "m4", 4, 4), (5, "x", "m5", 5, 5), (6, "d6", None, 6, 6), (7, "y", "y", 7, 7), (8, "y", "y", 7, 7), (9, None, None, None, 9), (10, "z", "z", 8, 8), (11, "z", "z", 8, 8)]
    b = [(101, "d1", "m1", 1, 1), (102, "d2", "m2", 2, 2), (103, "d2", "m2", 2, 2), (104, "e3", "m3", 0, 0), (105, "x", "m5", 5, 5), (106, "x", "m4", 4, 4), (107, "e6", None, 6, 6), (108, "y", "y", 7, 7), (109, "y", "y", 7, 7), (110, None, None, None, 9), (111, "z", "q", 0, 1)]
    found = reconcile(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([
        ("digest", "one-to-one", 1, 101), ("digest", "one-to-many", 2, 102), ("digest", "one-to-many", 2, 103), ("message-id", "one-to-one", 3, 104), ("message-id", "one-to-one", 4, 106), ("message-id", "one-to-one", 5, 105),
        ("date-size", "one-to-one", 6, 107), ("digest", "ambiguous", 7, None), ("digest", "ambiguous", 8, None), ("digest", "ambiguous", None, 108), ("digest", "ambiguous", None, 109), (None, "only-a", 9, None), (None, "only-b", None, 110),
        ("digest", "many-to-one", 10, 111), ("digest", "many-to-one", 11, 111),
    ], key=str)
    assert reconcile(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).collect() == []


def test_writers_fill_their_own_segments(spark, tmp_path):
    folder = str(tmp_path / "many")
    records = spark.createDataFrame([(i, bytes([i % 256]) * (i % 90)) for i in range(300)], "doc_id long, raw binary").repartition(5)
    placed = segments.write_segments(records, folder, limit=1000, first=7, writers=3)
    assert placed.count() == 300 and placed.agg(F.min("segment")).first()[0] == "segment-000007.arc"
    frames = segments.read_frames(spark, folder)
    assert {int(r["doc_id"]): bytes(r["raw"]) for r in frames.collect()} == {i: bytes([i % 256]) * (i % 90) for i in range(300)}
    assert frames.join(placed.withColumnRenamed("doc_id", "id"), ["segment", "offset", "frame_bytes"]).filter("id = doc_id").count() == 300
    assert segments.segment_sizes(spark, folder).filter("bytes > 1000").count() == 0
    assert segments.write_segments(records.limit(0), folder).count() == 0


def test_fnv_equals_the_byte_loop():
    from lettermill.functions import hashes

    def slow(data, prime):
        value = hashes.FNV_OFFSET
        for byte in data:
            value = (value ^ byte) * prime & (1 << 64) - 1
        return value

    rng = random.Random(5)
    for n in (0, 1, 255, 256, 257, 1000, 65_536, 65_537, 200_000):
        data = rng.randbytes(n)
        for prime in (hashes.FNV_PRIME, hashes.SEGMENT_PRIME):
            assert hashes.fnv64(data, prime) == slow(data, prime), n
    assert hashes.fnv64(b"a", hashes.FNV_PRIME) == 0xAF63DC4C8601EC8C


def test_large_payloads_are_made_in_linear_time():
    import time

    began = time.perf_counter()
    data = synthetic.Xorshift(5).randbytes(16 << 20)
    assert len(data) == 16 << 20 and data[:100] == synthetic.Xorshift(5).randbytes(100) and time.perf_counter() - began < 10
    rng = synthetic.Xorshift(9)
    assert all(0 <= rng.getrandbits(k) < 1 << k for k in (1, 7, 31, 32, 33, 64, 100))


@pytest.mark.parametrize(
    ("damage", "status"),
    [
        (lambda d: b"XX" + d[2:], "corrupt"),
        (lambda d: d[:16] + struct.pack("<Q", 1 << 63) + d[24:], "corrupt"),
        (lambda d: d[:16] + struct.pack("<Q", 10**6) + d[24:], "corrupt"),
        (lambda d: d[:-1] + bytes([d[-1] ^ 1]), "corrupt"),
        (lambda d: d + b"MAARC001", "tail"),
    ],
)
def test_faults_end_a_segment(damage, status):
    good, bad = segments.frame(1, b"one"), damage(segments.frame(2, b"two"))
    rows = list(segments.scan("segment-000000.arc", good + bad))
    assert rows[0][5] == "valid" and rows[-1][5] == status and sum(r[5] != "valid" for r in rows) == 1


def test_record_inventory_order(spark, archive):
    folder, messages, raws, placed = archive
    first = dict(zip(("doc_id", "segment", "archive_offset", "frame_bytes"), placed[0], strict=True))
    base = first | {"message_id": "<>", "folder": "", "raw_digest": digest(raws[0])}
    cases = [
        ({}, "available", ""), ({"raw_digest": b"x", "archive_offset": -1}, "inconsistent", "catalogue digest is invalid"), ({"archive_offset": -1, "doc_id": -1}, "inconsistent", "negative catalogue archive coordinate"),
        ({"doc_id": -1, "segment": "../x"}, "inconsistent", "negative catalogue record id"), ({"segment": "../x.arc"}, "inconsistent", "invalid archive segment coordinate"), ({"segment": "segment-99.arc"}, "missing", ""),
        ({"archive_offset": (1 << 63) - 1}, "inconsistent", "archive coordinate overflow"), ({"archive_offset": 10_000}, "missing", ""), ({"frame_bytes": 31}, "inconsistent", "catalogue frame length is smaller than the frame header"),
        ({"archive_offset": 1}, "inconsistent", "no frame at the catalogue coordinate"), ({"frame_bytes": first["frame_bytes"] - 1}, "inconsistent", "frame length differs from the catalogue coordinate"),
        ({"doc_id": 77}, "inconsistent", "catalog/frame id mismatch: frame contains 0"), ({"raw_digest": digest(b"other")}, "inconsistent", "catalogue/RAW digest linkage mismatch"),
    ]
    rows = [base | change | {"folder": str(i)} for i, (change, *_) in enumerate(cases)]
    frames, sizes = segments.read_frames(spark, folder), segments.segment_sizes(spark, folder)
    for i, (_, status, reason) in enumerate(cases):
        found = integrity.record_inventory(spark.createDataFrame([rows[i]], messages.schema), frames, sizes).first()
        assert (found["status"], found["reason"]) == (status, reason), i


def test_recovery_plan(spark):
    from decimal import Decimal

    frames = spark.createDataFrame([("segment-0.arc", 0, 50, Decimal(1), b"a" * 32, "valid", None), ("segment-0.arc", 50, 50, Decimal(9), b"b" * 32, "valid", None), ("segment-0.arc", 100, 50, Decimal(8), b"z" * 32, "valid", None), ("segment-0.arc", 150, 20, None, None, "tail", "incomplete frame header"), ("segment-1.arc", 0, 99, None, None, "corrupt", "frame magic mismatch"), ("segment-2.arc", 0, 99, None, None, "corrupt", "bad"), ("segment-3.arc", 7, 9, None, None, "tail", "t")], "segment string, offset long, frame_bytes long, doc_id decimal(20,0), raw_digest binary, status string, reason string")
    messages = spark.createDataFrame([(1, "segment-0.arc", 0, 50, b"a" * 32), (2, "segment-0.arc", 50, 60, b"c" * 32), (3, "segment-1.arc", 0, 40, b"d" * 32), (4, "segment-0.arc", 160, 50, b"e" * 32), (5, "segment-9.arc", 0, 40, b"f" * 32)], "doc_id long, segment string, archive_offset long, frame_bytes long, raw_digest binary")
    sizes = spark.createDataFrame([("segment-0.arc", 105), ("segment-1.arc", 99)], "segment string, bytes long")
    gmail = spark.createDataFrame([(5, "gmail:a", "m5", "present"), (4, "gmail:a", "m4", "deleted")], "doc_id long, source_account string, gmail_message_id string, source_state string")
    imap = spark.createDataFrame([(4, "imap:u@h:993", "INBOX", 1, 2, "present")], "doc_id long, source_account string, mailbox string, uid_validity long, uid long, source_state string")
    evidence = recovery.source_evidence(gmail, imap)
    classified = integrity.classify_frames(frames, messages)
    plan = recovery.plan(integrity.record_inventory(messages, frames, sizes), messages, classified, evidence).collect()
    assert [(r["subject"], r["status"], r["disposition"]) for r in plan] == [
        ("doc 2", "CataloguedInconsistent", "unsafe-automatic-repair"), ("doc 3", "CataloguedInconsistent", "unsafe-automatic-repair"), ("doc 4", "PhysicallyMissing", "unsafe-automatic-repair"),
        ("doc 5", "PhysicallyMissing", "source"), ("segment-0.arc @ 100", "OrphanValidated", "salvage"), ("segment-0.arc @ 150", "IncompleteTail", "unsafe-automatic-repair"),
        ("segment-1.arc @ 0", "PhysicalCorruption", "unsafe-automatic-repair"), ("segment-2.arc @ 0", "PhysicalCorruption", "unrecoverable-locally"), ("segment-3.arc @ 7", "IncompleteTail", "cleanup-candidate"),
    ]
    # the labels are an interface: seven of them, in these words
    assert recovery.DISPOSITIONS == ("no-action", "source", "user-choice", "salvage", "unrecoverable-locally", "unsafe-automatic-repair", "cleanup-candidate")
    alone = recovery.plan(integrity.record_inventory(messages, frames.limit(0), sizes.limit(0)), messages, classified.limit(0), evidence, archive=False).collect()
    assert [(r["subject"], r["disposition"]) for r in alone] == [(f"doc {i}", d) for i, d in enumerate(["unrecoverable-locally"] * 3 + ["unsafe-automatic-repair", "source"], 1)]
    assert not any(r["automatic"] for r in plan)
    raw = b"the bytes"
    held = spark.createDataFrame([(5, digest(raw)), (4, digest(raw))], "doc_id long, raw_digest binary")
    fetched = lambda identity, data: spark.createDataFrame([(5, "gmail:a", identity, data)], "doc_id long, source_account string, identity string, raw binary")
    outcome = lambda f: {r["doc_id"]: r["outcome"] for r in recovery.repair(held.select("doc_id"), evidence, held, f).collect()}
    assert outcome(fetched("m5", raw)) == {5: "repaired", 4: "refused: not one present identity"}
    assert [outcome(fetched(*x))[5] for x in (("m6", raw), ("m5", b"other"), ("m5", None))] == ["refused: another identity", "refused: digest differs", "unavailable"]
    assert {r["status"] for r in recovery.archive_plan(spark, "invalid", archive=False).collect()} == {"CatalogueInvalidOrUnreadable", "ArchiveRawAbsent"}


@pytest.mark.parametrize(("offset", "size", "disposition"), [(0, 2**62, "unsafe-automatic-repair"), (2**62 + 5, 2**62, "cleanup-candidate"), (2**63 - 1, 2**63 - 1, "cleanup-candidate"), (-5, 2**62, "cleanup-candidate"), (150, 0, "cleanup-candidate"), (170, 9, "cleanup-candidate"), (169, 9, "unsafe-automatic-repair")])
def test_plans_survive_corrupt_coordinates(spark, offset, size, disposition):
    frames = spark.createDataFrame([("segment-0.arc", 150, 20, None, None, "tail", "incomplete frame header")], "segment string, offset long, frame_bytes long, doc_id decimal(20,0), raw_digest binary, status string, reason string")
    messages = spark.createDataFrame([(1, "segment-0.arc", offset, size, b"a" * 32)], "doc_id long, segment string, archive_offset long, frame_bytes long, raw_digest binary")
    sizes = spark.createDataFrame([("segment-0.arc", 170)], "segment string, bytes long")
    none = recovery.source_evidence(spark.createDataFrame([], "doc_id long, source_account string, gmail_message_id string, source_state string"), spark.createDataFrame([], "doc_id long, source_account string, mailbox string, uid_validity long, uid long, source_state string"))
    records, classified = integrity.record_inventory(messages, frames, sizes), integrity.classify_frames(frames, messages)
    items = {r["subject"]: r["disposition"] for r in recovery.plan(records, messages, classified, none).collect()}
    assert items.pop("segment-0.arc @ 150") == disposition
    assert [*items] == ["doc 1"]


@pytest.mark.parametrize("hot", [False, True])
def test_overlaps_equal_all_pairs(spark, hot):
    rng = random.Random(31)
    key = lambda: rng.choice([None, "a", "b"] if hot else [f"k{i}" for i in range(30)])
    place = lambda: (lambda lo: (lo, lo + rng.choice([0, 1, 3, 10, 500])))(rng.randrange(2000))
    a = [(key(), *place(), i) for i in range(700)] + [("a", 5, 9, 1000)] * 300 + [("a", None, 4, 2000), ("b", 2, None, 2001)]
    b = [(key(), *place()) for _ in range(60)] + [("a", 8, 9)] * 200 + [("b", None, 10**9)] + [("k3", 1999, 2**62)]
    found = integrity.overlapping(spark.createDataFrame(a, "key string, lo long, hi long, n int").repartition(3), spark.createDataFrame(b, "key string, start long, stop long").repartition(2), "key", ("lo", "hi"), ("start", "stop"))
    assert found.columns == ["key", "lo", "hi", "n"]
    meets = [r for r in a if None not in r[:3] and any(k == r[0] and s is not None and r[1] < e and s < r[2] for k, s, e in b)]
    assert sorted(map(tuple, found.collect())) == sorted(meets) and len(meets) > 100


def test_index_maintenance(spark, archive):
    folder, messages, raws, _ = archive
    frames, sizes = segments.read_frames(spark, folder), segments.segment_sizes(spark, folder)
    records, raw = integrity.record_inventory(messages, frames, sizes), integrity.validated_raw(frames, messages)
    state = F.when(F.col("doc_id") == 3, "deleted").otherwise("present")
    rows = messages.select("doc_id", "message_id", "folder", "raw_digest", F.lit("gmail:a").alias("source_account"), state.alias("source_state"), F.lit('["L"]').alias("label_ids"), F.lit(5).cast("long").alias("timestamp_ms"), F.lit("h").alias("message_history_id"))
    empty, none = spark.createDataFrame([], SEARCH_DOCS), spark.createDataFrame([], INDEXED_DOCS)
    built, marks, stats = index.maintain(empty, none, rows, records, raw)
    assert stats.first().asDict() == {"indexed": 11, "skipped": 1, "removed": 0, "raw_unavailable": 0, "raw_inconsistent": 0, "parse_failures": 0, "partial": False}
    assert index.has_schema(built) and built.filter("doc_id = 2").first()["sender_filter"] == ["a2", "a2@x.y", "x", "y"] and marks.count() == 11
    built, marks = spark.createDataFrame(built.collect(), SEARCH_DOCS), spark.createDataFrame(marks.collect(), INDEXED_DOCS)
    again = index.maintain(built, marks, rows, records, raw)
    assert again[2].first()["skipped"] == 12 and again[0].count() == 11
    changed = rows.withColumn("label_ids", F.when(F.col("doc_id") == 1, '["M"]').otherwise(F.col("label_ids"))).withColumn("source_state", F.when(F.col("doc_id") == 2, "deleted").otherwise(F.col("source_state"))).filter("doc_id <> 4")
    bad = records.withColumn("status", F.when(F.col("doc_id") == 5, "missing").when(F.col("doc_id") == 6, "inconsistent").otherwise(F.col("status")))
    after, marks2, stats = index.maintain(built, marks, changed, bad, raw)
    assert {r["doc_id"] for r in after.collect()} == {0, 1, 7, 8, 9, 10, 11} and after.filter("doc_id = 1").first()["labels"] == ["M"] and marks2.count() == 7
    assert stats.first().asDict() == {"indexed": 1, "skipped": 7, "removed": 4, "raw_unavailable": 1, "raw_inconsistent": 1, "parse_failures": 0, "partial": True}
    rebuilt = index.maintain(built, marks, rows, records, raw, rebuild=True)
    assert rebuilt[2].first()["indexed"] == 11
    union = catalogue.union_rows(spark.createDataFrame([(1, "a", "present", "[]", 7, "h")], "doc_id long, source_account string, source_state string, label_ids string, internal_date_ms long, message_history_id string"), spark.createDataFrame([(2, "i", "present", None)], "doc_id long, source_account string, source_state string, internal_date_ms long"), messages)
    assert {(r["doc_id"], r["label_ids"], r["timestamp_ms"]) for r in union.collect()} == {(1, "[]", 7), (2, "[]", 0)}


def test_stored_index_maintenance(spark, archive, tmp_path):
    from lettermill.operators.search import SearchRequest
    from lettermill.operators.stored_index import StoredIndex

    folder, messages, raws, _ = archive
    frames, sizes = segments.read_frames(spark, folder), segments.segment_sizes(spark, folder)
    records, raw = integrity.record_inventory(messages, frames, sizes), integrity.validated_raw(frames, messages)
    rows = messages.select("doc_id", "message_id", "folder", "raw_digest", F.lit("gmail:a").alias("source_account"), F.lit("present").alias("source_state"), F.lit('["L"]').alias("label_ids"), F.lit(5).cast("long").alias("timestamp_ms"), F.lit("h").alias("message_history_id"))
    empty, none = StoredIndex.write(spark.createDataFrame([], SEARCH_DOCS), str(tmp_path / "index")), spark.createDataFrame([], INDEXED_DOCS)
    assert empty.search(SearchRequest(text="body")).count() == 0
    index_, marks, stats = index.maintain_stored(empty, none, rows, records, raw)
    assert stats.first()["indexed"] == 12 and index_.search(SearchRequest(text="body")).count() == 12
    changed = rows.withColumn("source_state", F.when(F.col("doc_id") < 3, "deleted").otherwise(F.col("source_state")))
    index_, marks, stats = index.maintain_stored(index_, marks, changed, records, raw)
    assert (stats.first()["removed"], stats.first()["indexed"], marks.count()) == (3, 0, 9)
    assert {r["doc_id"] for r in index_.search(SearchRequest(text="body")).collect()} == set(range(3, 12)) and index_.n == 9
    index_, marks, stats = index.maintain_stored(index_, marks, changed, records, raw, rebuild=True)
    assert index_.last == 0 and index_.live == [0] and index_.search(SearchRequest(text="body")).count() == 9


def test_cas(spark):
    rng = random.Random(3)
    corpus = synthetic.Corpus(80, profile="personal")
    made = synthetic.messages(spark, corpus).cache()
    assert made.count() == 80 and synthetic.message(corpus, 7) == synthetic.message(corpus, 7) and synthetic.message(corpus, 7) != synthetic.message(synthetic.Corpus(80, 43), 7)
    odd = [b"", b"\r\n--attachment;", b"a\r\n--attachment; x\r\n\r\n--attachment; y\r\nzz", bytes(rng.randrange(256) for _ in range(500))]
    extra = spark.createDataFrame([(1000 + i, r) for i, r in enumerate(odd)], "doc_id long, raw binary")
    messages = made.select("doc_id", "raw").union(extra)
    for threshold in (None, 0, 4096):
        cut = cas.externalise(messages, threshold)
        back = cas.reconstruct(cas.references(cut), cas.blobs(cut))
        assert back.join(messages.withColumnRenamed("raw", "was"), "doc_id").filter("raw = was").count() == 84
        sizes = cas.sizes(messages, cut).first()
        assert sizes["raw_bytes"] >= sizes["stored_bytes"] and (threshold is not None) == (sizes["blobs"] > 0)
    with pytest.raises(Exception, match="blob is missing"):
        cas.reconstruct(cas.references(cut), cas.blobs(cut).limit(0)).collect()


def test_export(spark, archive, tmp_path):
    folder, messages, raws, placed = archive
    mail = spark.createDataFrame([(1, "same", 86_400_000, b"one"), (2, "same", 86_400_000, b"two"), (3, "other", 0, b"three")], "doc_id long, subject string, timestamp_ms long, raw binary")
    named = export.named_eml(mail)
    done = export.write_eml(named, str(tmp_path / "out"))
    assert export.batch_summary(done).first().asDict() == {"written": 3, "failed": 0}
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"1970-01-02 same.eml": b"one", "1970-01-02 same-2.eml": b"two", "other.eml": b"three"}
    assert export.batch_summary(export.write_eml(named, str(tmp_path / "out"))).first()["failed"] == 3
    classified = integrity.classify_frames(segments.read_frames(spark, folder), messages.filter("doc_id <> 4"))
    manifest = export.export_orphan(classified, placed[4][1], placed[4][2], str(tmp_path / "orphan.eml"), folder)
    assert (tmp_path / "orphan.eml").read_bytes() == raws[4] and manifest["sha256"] == hashlib.sha256(raws[4]).hexdigest()
    for where in (f"{folder}/in.eml", str(tmp_path / "orphan.eml")):
        with pytest.raises((ValueError, FileExistsError)):
            export.export_orphan(classified, placed[4][1], placed[4][2], where, folder)


OCCURRENCES = "source_account string, gmail_message_id string, doc_id long, thread_id string, label_ids string, internal_date_ms long, message_history_id string, source_state string, first_seen_unix long, last_seen_unix long"


@pytest.mark.parametrize(
    ("history", "known", "found", "action", "deleted_at"),
    [
        ([("1", "added", "a")], False, None, "import", None),
        ([("1", "labels", "a")], True, None, "repair", None),
        ([("1", "deleted", "a")], True, None, "tombstone", "1"),
        ([("1", "deleted", "a")], False, None, "ignore", "1"),
        ([("1", "added", "a"), ("2", "deleted", "a")], False, None, "import-then-tombstone", "2"),
        ([("1", "deleted", "a"), ("2", "labels", "a")], True, None, "repair", None),
        ([("1", "added", "a"), ("1", "deleted", "a")], False, True, "import", None),
        ([("1", "added", "a"), ("1", "deleted", "a")], False, False, "ignore", "1"),
        ([("1", "added", "a"), ("1", "deleted", "a")], True, False, "tombstone", "1"),
        ([("1", "added", "a"), ("2", "added", "b"), ("2", "deleted", "a")], False, None, "import-then-tombstone", "2"),
    ],
)
def test_fold(spark, history, known, found, action, deleted_at):
    events = spark.createDataFrame([(i, *h) for i, h in enumerate(history)], "seq long, record string, kind string, message_id string")
    ids = spark.createDataFrame([("a",)], "message_id string")
    answers = ids.withColumn("found", F.lit(found).cast("boolean")).filter("found is not null")
    row = sync.fold(sync.runs(events, ["seq"]), ids if known else ids.limit(0), answers).filter("message_id = 'a'").first()
    assert (row["action"], row["delete_history"]) == (action, deleted_at)


def test_ambiguous_records_need_an_answer(spark):
    events = spark.createDataFrame([(0, "1", "added", "a"), (1, "1", "deleted", "a")], "seq long, record string, kind string, message_id string")
    runs = sync.runs(events, ["seq"])
    assert [r[0] for r in sync.ambiguous(runs).collect()] == ["a"]
    with pytest.raises(Exception, match="needs the source's answer"):
        sync.fold(runs, runs.select("message_id").limit(0), spark.createDataFrame([], "message_id string, found boolean")).collect()


def test_feed_stream_and_sync(spark, tmp_path):
    ref = lambda i: {"message": {"id": i, "threadId": "t"}}
    pages = [
        {"page": 0, "history": [{"id": "11", "messagesAdded": [ref("n")], "labelsAdded": [ref("k") | {"labelIds": ["X"]}]}, {"id": "12", "messagesDeleted": [ref("d")]}], "historyId": "20"},
        {"page": 1, "history": [{"id": "13", "messagesAdded": [ref("z")]}, {"id": "14", "messagesDeleted": [ref("z")]}], "historyId": "20"},
    ]
    (tmp_path / "history").mkdir()
    for i, page in enumerate(pages):
        (tmp_path / "history" / f"{i}.json").write_text(json.dumps(page))
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "0.json").write_text("\n".join(json.dumps({"id": i, "threadId": "t", "labelIds": ["NEW"], "historyId": "15", "internalDate": "9", "raw": "YQ"}) for i in "nkz"))
    (tmp_path / "profile").mkdir()
    (tmp_path / "profile" / "0.json").write_text(json.dumps({"emailAddress": "a@x", "historyId": "20"}))
    transport = providers.TableTransport(spark, str(tmp_path))
    assert transport.profile() == ("a@x", "20") and transport.history("12").select(F.explode("history")).count() == 2 and transport.listing(query="label:NEW").count() == 3
    held = spark.createDataFrame([("g", i, n, "old", "[]", 1, "1", "present", 1, 1) for n, i in enumerate("kd")], OCCURRENCES)
    fresh = transport.raw().transform(providers.decoded_messages).select(F.lit("g").alias("source_account"), F.col("id").alias("gmail_message_id"), (F.lit(100) + F.ascii("id")).cast("long").alias("doc_id"), "thread_id", "label_ids", "internal_date_ms", "message_history_id", F.lit(50).cast("long").alias("now"), "raw")
    seen = []

    def apply(batch, number):
        runs = sync.runs(sync.flatten_history(batch), ["page", "position", "step"])
        folded = sync.fold(runs, held.select(F.col("gmail_message_id").alias("message_id")), spark.createDataFrame([], "message_id string, found boolean"))
        out = sync.apply_incremental(held, "g", folded, fresh)
        seen.append({r["gmail_message_id"]: (r["source_state"], r["label_ids"], r["message_history_id"]) for r in out.collect()})

    sync.stream_feed(transport.history_stream(), apply, str(tmp_path / "checkpoint")).awaitTermination()
    assert seen == [{"k": ("present", '["NEW"]', "15"), "d": ("deleted", "[]", "12"), "n": ("present", '["NEW"]', "15"), "z": ("deleted", '["NEW"]', "14")}]
    listed = fresh.filter("gmail_message_id <> 'z'").drop("raw")
    repaired, new = sync.apply_full(held, listed, bounded=False)
    assert {r["gmail_message_id"]: r["source_state"] for r in repaired.collect()} == {"k": "present", "d": "deleted"} and [r["gmail_message_id"] for r in new.collect()] == ["n"]
    assert {r["source_state"] for r in sync.apply_full(held, listed, bounded=True)[0].collect()} == {"present"}
    state = spark.createDataFrame([], "source_account string, history_id string, complete int")
    assert sync.frontier(state, "g") is None and sync.frontier(sync.with_frontier(state, "g", "20"), "g") == ("20", True)
    assert [sync.choose_sync(*x) for x in (((("1", True)), False), (("1", False), False), (None, False), (("1", True), True), (("1", True), False, True))] == ["incremental", "full", "full", "full", "full"]


def test_batches_and_mailboxes(spark):
    rows = spark.createDataFrame([(i, 100_000 if i % 50 else 9_000_000, "w") for i in range(200)], "doc_id long, size long, writer string")
    numbered = [(r["doc_id"], r["batch"]) for r in sync.batch_numbers(rows, "doc_id", "size", "writer").orderBy("doc_id").collect()]
    want, batch, n, held = [], 0, 0, 0
    for i in range(200):
        want.append((i, batch))
        n, held = n + 1, held + (100_000 if i % 50 else 9_000_000)
        if n >= sync.BATCH_RECORDS or held >= sync.BATCH_BYTES:
            batch, n, held = batch + 1, 0, 0
    assert numbered == want
    staged = spark.createDataFrame([(1, 10), (2, 20)], "doc_id long, frame_bytes long")
    assert sync.covers(staged, staged, ["doc_id"]).first().asDict() == {"missing": 0, "extra": 0, "bytes_match": True}
    assert sync.covers(staged, staged.filter("doc_id = 1"), ["doc_id"]).first().asDict() == {"missing": 0, "extra": 1, "bytes_match": False}
    fetched = spark.createDataFrame([("i", "INBOX", 1, u) for u in (3, 4, 4, 5, 9, 30)], "source_account string, mailbox string, uid_validity long, uid long")
    assert sorted(r["uid"] for r in sync.new_uids(fetched, fetched.filter("uid = 5"), 3, 10, 20).collect()) == [4, 9]
    boxes = providers.mailboxes(spark.createDataFrame([("Sent", "/", ["\\Sent", "\\HasNoChildren"]), ("x", None, ["\\Noselect"])], "name string, delimiter string, attributes array<string>"))
    assert {(r["mailbox"], r["special_use"], r["selectable"]) for r in boxes.collect()} == {("Sent", '["sent"]', 1), ("x", "[]", 0)}
    answers = spark.createDataFrame([(7, b"r")], "uid long, raw binary")
    outcomes = [providers.resolve_exact(df, uid).first()["outcome"] for df, uid in ((answers.limit(0), 7), (answers, 7), (answers, 8), (answers.union(answers), 7))]
    assert outcomes == ["unavailable", "found", "wrong uid", "ambiguous"]
    assert providers.is_canonical_imap_account(providers.imap_account("u", "h", 993)) and not any(map(providers.is_canonical_imap_account, ("imap:u@h:0", "imap:u@h:70000", "imap:u:1", "u@h:1")))
    moment = spark.createDataFrame([(1, ["b", "a"], b"xyz")], "uid long, flags array<string>, raw binary").withColumn("internal_date", F.timestamp_millis(F.lit(1000)))
    assert providers.fetched_rows(moment).drop("raw").first().asDict() == {"uid": 1, "flags": '["a","b"]', "internal_date": "1970-01-01T00:00:01Z", "internal_date_ms": 1000, "rfc822_size": 3}


def test_catalogue_changes(spark):
    table = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "k long, v string")
    allocated = catalogue.allocate_ids(table.repartition(7), ["v"], 10)
    assert [r["doc_id"] for r in allocated.orderBy("v").collect()] == list(range(10, 60))
    merged = catalogue.merge(table, spark.createDataFrame([(1, "new"), (99, "added")], "k long, v string"), ["k"])
    assert {r["k"]: r["v"] for r in merged.collect()} == {i: f"v{i}" for i in range(50)} | {1: "new", 99: "added"}
    assert catalogue.next_doc_id(spark.createDataFrame([], "doc_id long")).first()[0] == 0


def test_publish_and_frontiers(spark, tmp_path):
    from lettermill.schemas import CATALOGUE
    from lettermill.streaming import publish

    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    for batch in (0, 1, 1):
        publish.publish_batch({"messages": rows, "occurrences": rows}, str(tmp_path / "t"), batch)
    rows.write.parquet(str(tmp_path / "t/messages/batch=9"))  # no marker
    assert publish.published(spark, str(tmp_path / "t"), "messages").count() == 2
    state = spark.createDataFrame([], CATALOGUE["imap_scan_state"])
    messages = spark.createDataFrame([("i", "INBOX", 7)], "source_account string, mailbox string, uid_validity long")
    assert publish.scan_state(state, "i", "INBOX") is None and publish.known_uid_validity(state, messages, "i", "INBOX") == 7 and publish.known_uid_validity(state, messages, "i", "x") is None
    state = publish.advance(publish.advance(state, "i", "INBOX", 7, 10, 11, 1), "i", "INBOX", 7, 20, 21, 2)
    assert publish.scan_state(state, "i", "INBOX") == (7, 20)
    with pytest.raises(ValueError, match="UIDVALIDITY"):
        publish.advance(state, "i", "INBOX", 8, 1, 2, 3)
    done = publish.sync_mailboxes(spark, ["a", "b"], lambda name: 3 if name == "a" else 1 / 0)
    assert {(r["mailbox"], r["imported"], r["error"]) for r in done.collect()} == {("a", 3, None), ("b", 0, "division by zero")}


def test_statistics_and_generators(spark):
    from lettermill.operators import statistics

    sizes = statistics.compression_stats(spark.createDataFrame([(b"a" * 1000 + cas.MARKER + b"b" * 1000,), (None,)], "raw binary")).first()
    assert all(0 < sizes[c] < 200 for c in statistics.COMPRESSED.names)
    rng = synthetic.Xorshift(42)
    assert len({rng.next() for _ in range(1000)}) == 1000 and 0 <= rng.random() < 1 and rng.getrandbits(70) < 1 << 70
    assert [synthetic.Xorshift(1).next(), synthetic.Xorshift(1).next()][0] == synthetic.Xorshift(1).next()
    repeats = [synthetic.body_repeats("light", rng) for _ in range(3000)]
    assert 0.78 < sum(r <= 3 for r in repeats) / 3000 < 0.88 and max(repeats) >= 250
    assert {synthetic.attachment_size("light", rng, 10**6) for _ in range(500)} == {512, 2048, 16_384, 131_072}


def test_config(tmp_path):
    from lettermill.sources.config import Config

    path = str(tmp_path / "c.json")
    config = Config.load(path)
    config.remember("a")
    config.remember("b")
    config.remember("a")
    config.save(path)
    assert Config.load(path) == Config(["a", "b"], {})
