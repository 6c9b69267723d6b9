"""A change feed as a stream: a source whose offsets are its pages, and the fold of its events as state by message.

The feed is a folder of pages. A page is a folder ``<first>-<last>`` of history ids (padded with zeros, so names are in
order) with JSON lines ``message_id, record, position, kind``; it counts once its ``_SUCCESS`` is there. A file
``expired-<id>`` says that records up to that id are gone. What was read is named by the checkpoint's offset, so a restart
repeats no page that a finished micro-batch had; a checkpoint older than the feed is an error, and the way out a full sync.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyarrow import fs
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.types import ddl
from ..session import local_path
from .sync import IGNORE, IMPORT, IMPORT_TOMBSTONE, REPAIR, TOMBSTONE

EVENTS = "message_id string, record string, position long, kind string"
EXPIRED = "history-expired"
#: Kinds of events: the source's answer to the question whether a message exists, beside the feed's own.
FOUND, GONE, DELETED = "found", "gone", "deleted"
#: Milliseconds that a question may stay without an answer.
PATIENCE = 60_000


# the source


def write_page(events: DataFrame, folder: str, first: int, last: int) -> None:
    """Add a page of the feed: history ids from ``first`` to ``last``."""
    events.select(*ddl(EVENTS).names).write.json(f"{folder}/{first:020d}-{last:020d}")


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    folder = local_path(folder)
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _listed(folder: str) -> tuple[list[str], int]:
    """Whole pages in order, and the id up to which records are gone."""
    system, root = _opened(folder)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    gone = [int(x.base_name.removeprefix("expired-")) for x in found if x.base_name.startswith("expired-")]
    pages = sorted(x.base_name for x in found if x.type == fs.FileType.Directory and x.base_name.replace("-", "").isdigit())
    return [p for p in pages if system.get_file_info(f"{root}/{p}/_SUCCESS").is_file], max(gone, default=0)


@dataclass
class _Page(InputPartition):
    path: str


class _Pages(DataSourceStreamReader):
    def __init__(self, folder: str, start: int, acknowledged: str | None):
        self.folder, self.start, self.acknowledged = folder, start, acknowledged

    def initialOffset(self) -> dict:
        return {"page": "", "history_id": self.start}

    def latestOffset(self) -> dict:
        pages, _ = _listed(self.folder)
        return {"page": pages[-1], "history_id": int(pages[-1].split("-")[1])} if pages else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        pages, gone = _listed(self.folder)
        if start["history_id"] < gone:
            raise RuntimeError(f"{EXPIRED}: the feed begins after {gone}, the offset is {start['history_id']}")
        system, root = _opened(self.folder)
        wanted = [p for p in pages if start["page"] < p <= end["page"] and int(p.split("-")[1]) > self.start]
        files = [f for p in wanted for f in system.get_file_info(fs.FileSelector(f"{root}/{p}")) if f.base_name.startswith("part-")]
        return [_Page(f.path) for f in files]

    def read(self, partition: _Page) -> Iterator[tuple]:
        system, _ = _opened(self.folder)
        with system.open_input_stream(partition.path, compression=None) as file:
            rest = b""
            while block := file.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield from map(_event, lines)
            if rest:
                yield _event(rest)

    def commit(self, end: dict) -> None:
        """Tell the feed how far it was read, if it wants to know: an empty file ``read-<id>``."""
        if self.acknowledged and end["history_id"]:
            system, root = _opened(self.acknowledged)
            system.create_dir(root, recursive=True)
            system.open_output_stream(f"{root}/read-{end['history_id']}").close()


def _event(line: bytes) -> tuple:
    row = json.loads(line)
    return row.get("message_id"), row.get("record"), row.get("position"), row.get("kind")


class HistoryFeed(DataSource):
    """``spark.readStream.format("history_feed").load(folder)``; options: ``start``, the history id to begin after, and ``acknowledged``, a folder."""

    @classmethod
    def name(cls) -> str:
        return "history_feed"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> _Pages:
        return _Pages(self.options["path"], int(self.options.get("start", 0)), self.options.get("acknowledged"))


def read_feed(spark: SparkSession, folder: str, start: int = 0, acknowledged: str | None = None) -> DataFrame:
    """The feed as a streaming DataFrame of EVENTS."""
    spark.dataSource.register(HistoryFeed)
    reader = spark.readStream.format("history_feed").option("start", str(start))
    return (reader.option("acknowledged", acknowledged) if acknowledged else reader).load(folder)


# the fold


@dataclass(frozen=True)
class Folded:
    """What is known of a message after some of its runs."""

    present: bool = False
    needed: bool = False
    delete_history: str | None = None
    asked: bool = False

    def after(self, record: str | None, positive: bool, negative: bool, answer: bool) -> Folded:
        """After a run of equal records; with events of both kinds, the source's answer decides."""
        if positive and negative:
            return Folded(True, True, None, True) if answer else Folded(False, False, record, False)
        if positive:
            return Folded(True, True, None, False)
        return Folded(False, self.needed, record, self.asked) if negative else self


@dataclass(frozen=True)
class Message:
    """A message's state: folded under both answers that are still open, and its last run, which may go on."""

    found: Folded = Folded()
    gone: Folded = Folded()
    record: str | None = None
    positive: bool = False
    negative: bool = False
    answer: bool | None = None

    def now(self) -> tuple[Folded, Folded]:
        """Under either answer, the last run included."""
        run = (self.record, self.positive, self.negative)
        return self.found.after(*run, True if self.answer is None else self.answer), self.gone.after(*run, False if self.answer is None else self.answer)

    def event(self, record: str | None, kind: str) -> Message:
        """After an event of the feed, or the source's answer, which holds for all runs so far."""
        if kind in (FOUND, GONE):
            one = self.found if kind == FOUND else self.gone
            return Message(one, one, self.record, self.positive, self.negative, kind == FOUND if self.positive and self.negative else None)
        negative = kind == DELETED
        if record == self.record and (self.positive or self.negative):
            return Message(self.found, self.gone, record, self.positive or not negative, self.negative or negative, self.answer)
        return Message(*self.now(), record, not negative, negative)

    def row(self) -> tuple:
        """``present, needed, delete_history, from_lookup, ask``: as if it exists, where that is still open."""
        found, gone = self.now()
        return found.present, found.needed, found.delete_history, found.asked, found != gone


_SIDE = "struct<present: boolean, needed: boolean, delete_history: string, asked: boolean>"
_STATE = f"found {_SIDE}, gone {_SIDE}, record string, positive boolean, negative boolean, answer boolean"
FOLDED = "message_id string, present boolean, needed boolean, delete_history string, from_lookup boolean, ask boolean, overdue boolean"


class _Fold(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.message = handle.getValueState("message", ddl(_STATE))

    def _held(self) -> Message:
        if not self.message.exists():
            return Message()
        found, gone, *rest = self.message.get()
        return Message(Folded(*found), Folded(*gone), *rest)

    def _row(self, key: tuple, held: Message, overdue: bool) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(key[0], *held.row(), overdue)], columns=ddl(FOLDED).names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        events = pd.concat([*rows]).sort_values("position", kind="stable")
        for record, kind in zip(events["record"], events["kind"], strict=True):
            held = held.event(record, kind)
        self.message.update((tuple(asdict(held.found).values()), tuple(asdict(held.gone).values()), held.record, held.positive, held.negative, held.answer))
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if held.row()[-1]:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + PATIENCE)
        yield from self._row(key, held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held.row()[-1]:
            yield from self._row(key, held, True)

    def close(self) -> None:
        pass


def folded(events: DataFrame) -> DataFrame:
    """Of each message that a micro-batch of EVENTS touches what the feed says of it by now (FOLDED); the last row holds.

    Runs of equal records are held open across micro-batches, so where the feed is cut changes nothing. ``ask``: whether the
    source's answer, an event ``found`` or ``gone``, would change it; a question without an answer comes again, ``overdue``.
    """
    return events.groupBy("message_id").transformWithStateInPandas(_Fold(), outputStructType=ddl(FOLDED), outputMode="update", timeMode="processingTime")


def plain_fold(events: list[tuple]) -> Message:
    """The same of one message's ``(record, kind)`` in order."""
    held = Message()
    for record, kind in events:
        held = held.event(record, kind)
    return held


def actions(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``message_id, action, delete_history, from_lookup`` of the last FOLDED rows, as ``sync.fold`` gives them."""
    rows = rows.join(known.select("message_id").distinct().withColumn("_known", F.lit(True)), "message_id", "left")
    is_known = F.coalesce("_known", F.lit(False))
    action = F.when(F.col("present") & is_known, REPAIR).when(F.col("present"), IMPORT).when(is_known, TOMBSTONE).when(F.col("needed"), IMPORT_TOMBSTONE).otherwise(IGNORE)
    return rows.select("message_id", action.alias("action"), F.when(~F.col("present"), F.col("delete_history")).alias("delete_history"), "from_lookup")


# the run


class Feed:
    """A feed's standing state below a folder: the checkpoint, and the rows of each micro-batch."""

    def __init__(self, spark: SparkSession, pages: str, folder: str, start: int = 0):
        self.spark, self.pages, self.folder, self.start = spark, pages, folder, start

    def run(self, full: Callable[[], None] | None = None) -> str:
        """Read what is new. ``incremental``; or ``full``, if the feed has lost what lies between: then ``full`` is called."""
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={number}")  # a repeated micro-batch writes the same

        stream = folded(read_feed(self.spark, self.pages, self.start, f"{self.folder}/read"))
        query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except StreamingQueryException as error:
            if EXPIRED not in str(error):
                raise
            if full is not None:
                full()
            return "full"
        return "incremental"

    def rows(self) -> DataFrame:
        """The last row of each message."""
        rows = self.spark.read.schema(ddl(FOLDED + ", batch long")).parquet(f"{self.folder}/rows")
        values = ddl(FOLDED).names[1:]
        return rows.groupBy("message_id").agg(F.max_by(F.struct(*values), "batch").alias("last")).select("message_id", "last.*")
