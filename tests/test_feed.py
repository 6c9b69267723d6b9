"""The stateful feed: cut anywhere it gives what one batch gives; restarts, expiry, questions and answers."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lettermill.streaming import feed, sync

KINDS = ("added", "labels", "deleted")


def events(seed, n=160, ids=9):
    """Events in the feed's order: records of several events, of few messages."""
    rng, out, record = random.Random(seed), [], 100
    for position in range(n):
        record += rng.random() < 0.5
        out.append((f"m{rng.randrange(ids)}", str(record), position, rng.choice(KINDS)))
    return out


def folds(spark, rows, answers, known):
    found = sync.runs(spark.createDataFrame(rows, feed.EVENTS), ["position"])
    looked = spark.createDataFrame([(m, m in answers) for m in {r[0] for r in rows}], "message_id string, found boolean")
    return {tuple(r) for r in sync.fold(found, known, looked).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_states_equal_the_fold_of_one_batch(spark, seed):
    rows = events(seed, 200)
    answers = {f"m{i}" for i in range(0, 9, 2)}
    known = spark.createDataFrame([(f"m{i}",) for i in range(0, 9, 3)], "message_id string")
    last = []
    for m in {r[0] for r in rows}:
        held = feed.plain_fold([(r[1], r[3]) for r in rows if r[0] == m] + [(None, feed.FOUND if m in answers else feed.GONE)])
        last.append((m, *held.row(), False))
    assert not any(r[5] for r in last)
    got = feed.actions(spark.createDataFrame(last, feed.FOLDED), known).collect()
    assert {tuple(r) for r in got} == folds(spark, rows, answers, known)


def test_an_answer_comes_when_it_likes():
    rng = random.Random(7)
    for _ in range(400):
        runs = [(str(rng.randrange(3)), rng.choice(KINDS)) for _ in range(rng.randrange(1, 9))]
        answer = rng.choice([feed.FOUND, feed.GONE])
        whole = feed.plain_fold([*runs, (None, answer)])
        at = rng.randrange(len(runs) + 1)
        twice = feed.plain_fold([*runs[:at], (None, answer), *runs[at:], (None, answer)])
        assert whole.row() == twice.row()


def test_a_feed_cut_at_any_page(spark, tmp_path):
    rows = events(11)
    cuts = [0, 37, 38, 111, len(rows)]
    pages, state = str(tmp_path / "pages"), str(tmp_path / "state")
    known = spark.createDataFrame([("m0",), ("m3",)], "message_id string")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = rows[lo:hi]
        feed.write_page(spark.createDataFrame(part, feed.EVENTS), pages, int(part[0][1]), int(part[-1][1]))
        assert feed.Feed(spark, pages, state).run() == "incremental"  # a new run each time: from the checkpoint
        seen = {r["message_id"]: r["ask"] for r in feed.Feed(spark, pages, state).rows().collect()}
        assert set(seen) == {r[0] for r in rows[:hi]}
    before = spark.read.parquet(f"{state}/rows").count()
    assert feed.Feed(spark, pages, state).run() == "incremental" and spark.read.parquet(f"{state}/rows").count() == before  # nothing is repeated
    asked = {m for m, ask in seen.items() if ask}
    assert asked <= {r["message_id"] for r in sync.ambiguous(sync.runs(spark.createDataFrame(rows, feed.EVENTS), ["position"])).collect()} and asked
    answers = [(m, None, 10_000, feed.FOUND if m in ("m1", "m2", "m3") else feed.GONE) for m in sorted(asked)]
    feed.write_page(spark.createDataFrame(answers, feed.EVENTS), pages, 9000, 9001)
    feed.Feed(spark, pages, state).run()
    last = feed.Feed(spark, pages, state).rows()
    assert last.filter("ask").count() == 0
    assert {tuple(r) for r in feed.actions(last, known).collect()} == folds(spark, rows, {"m1", "m2", "m3"}, known)
    assert {p.name for p in (tmp_path / "state/read").iterdir()} >= {f"read-{rows[-1][1]}"}
    # the feed loses what the checkpoint needs: a full sync
    (tmp_path / "pages/expired-9500").touch()
    feed.write_page(spark.createDataFrame([("m5", "9600", 20_000, "added")], feed.EVENTS), pages, 9600, 9600)
    called = []
    assert feed.Feed(spark, pages, state).run(lambda: called.append(1)) == "full" and called == [1]
    fresh = feed.Feed(spark, pages, str(tmp_path / "again"), start=9500)  # from the full sync's history id on
    assert fresh.run() == "incremental" and [r["message_id"] for r in fresh.rows().collect()] == ["m5"]


class Held:
    """What a processor needs of Spark's handle."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):  # noqa: N802
        return self.timers

    def deleteTimer(self, at):  # noqa: N802
        self.timers = [t for t in self.timers if t != at]

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return 1000


def test_questions_come_again():
    held = Held()
    fold = feed._Fold()
    fold.init(held)
    take = lambda rows: [tuple(r) for df in fold.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=["message_id", "record", "position", "kind"])]), held) for r in df.itertuples(index=False)]
    late = lambda: [tuple(r) for df in fold.handleExpiredTimer(("a",), held, held) for r in df.itertuples(index=False)]
    assert take([("a", "1", 1, "deleted"), ("a", "1", 0, "added")]) == [("a", True, True, None, True, True, False)]
    assert held.timers == [1000 + feed.PATIENCE] and late() == [("a", True, True, None, True, True, True)]
    assert take([("a", None, 5, feed.GONE)])[0][1:] == (False, False, "1", False, False, False)
    assert held.timers == [] and late() == []


def test_unfinished_pages_and_odd_lines(spark, tmp_path):
    pages = tmp_path / "pages"
    (pages / f"{1:020d}-{2:020d}").mkdir(parents=True)  # no _SUCCESS
    (pages / "notes").mkdir()
    reader = feed._Pages(str(pages), 0, None)
    assert reader.latestOffset() == reader.initialOffset() == {"page": "", "history_id": 0}
    whole = pages / f"{3:020d}-{4:020d}"
    whole.mkdir()
    (whole / "part-0.json").write_text(json.dumps({"message_id": "x", "record": "3", "position": 1, "kind": "added"}) + "\n" + json.dumps({"message_id": "y"}))
    (whole / "_SUCCESS").touch()
    end = reader.latestOffset()
    assert end["history_id"] == 4
    parts = reader.partitions(reader.initialOffset(), end)
    assert [r for p in parts for r in reader.read(p)] == [("x", "3", 1, "added"), ("y", None, None, None)]
    assert reader.partitions(end, end) == [] and feed._Pages(str(pages), 4, None).partitions(reader.initialOffset(), end) == []
    assert spark.createDataFrame([], feed.FOLDED).transform(lambda d: feed.actions(d, d)).count() == 0 and F is not None
