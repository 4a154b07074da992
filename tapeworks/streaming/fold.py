"""The book fold and event-time windows over Structured Streaming.

A session's book is a map state of its levels, of which a micro-batch writes those that it changed, or one value if it is
shallow; a message that arrives out of order within its session is refused, since a fold cannot be undone. Deltas carry
absolute sizes, so a sink that sees one twice is still right. A row costs by the columns that are made of it, and Spark
does not tell a processor which of them are used, so they are named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from tapeworks.operators.fold import COLUMNS, NAMES, applied, row_maker
from tapeworks.operators.matching import Book
from tapeworks.schema import BUY, FOLDED, SELL
from tapeworks.streaming.windows import Ordered, by_session


class BookProcessor(Ordered):
    """Keeps one session's book between micro-batches."""

    def __init__(self, depth: int, idle_ns: int | None = None, columns: list[str] = NAMES):
        super().__init__(idle_ns)
        self.depth, self.columns = depth, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.row = row_maker(self.columns)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side int, price long", "size long")

    def load(self, known: bool) -> tuple[Book, dict, dict]:
        stored = {(int(side), int(price)): int(size) for (side, price), (size,) in self.levels.iterator()} if known else {}
        sides = {BUY: {}, SELL: {}}
        for (side, price), size in stored.items():
            sides[side][price] = size
        return Book.of(sides[BUY], sides[SELL]), {}, stored

    def step(self, held, session_id, seq, ts_ns, size, price, direction, kind):
        book, changed, _ = held
        out = applied(book, session_id, seq, size, price, direction, kind)
        for side, level, resting in out.deltas:
            changed[side, level] = resting
        return self.row((session_id, seq, ts_ns), book, self.depth, out)

    def save(self, held) -> None:
        _, changed, stored = held
        for level, size in changed.items():
            if size and size != stored.get(level):
                self.levels.updateValue(level, (size,))
            elif not size and level in stored:
                self.levels.removeKey(level)

    def forget(self) -> None:
        self.levels.clear()


class ShallowBookProcessor(BookProcessor):
    """Keeps one session's book as a whole, with the place of its last message: a session costs two calls, however many
    levels a batch changes, but a batch writes all levels."""

    kept = ", bids array<struct<price: long, size: long>>, asks array<struct<price: long, size: long>>"

    def open(self, handle: StatefulProcessorHandle) -> None:
        pass

    def load(self, known: bool, *kept) -> tuple[Book, dict, dict]:
        bids, asks = map(dict, kept) if known else ({}, {})
        return Book.of(bids, asks), {}, {}

    def save(self, held) -> tuple[list, list]:
        return held[0].levels(BUY), held[0].levels(SELL)

    def forget(self) -> None:
        pass


def fold_stream(messages: DataFrame, depth: int, idle_ns: int | None = None, late: str = "0 seconds", columns: list[str] = NAMES, shallow: bool = False) -> DataFrame:
    """The named columns of the fold of a stream of messages; needs the RocksDB state store. A session idle for `idle_ns`
    closes: its book goes, and messages that come after open a new one. Books of some dozens of levels are `shallow`:
    written as a whole, which costs fewer calls than their levels do one by one; the results are the same."""
    fields = ", ".join(f"{c} {FOLDED[c].dataType.simpleString()}" for c in columns)
    return by_session(messages.select(*COLUMNS), (ShallowBookProcessor if shallow else BookProcessor)(depth, idle_ns, columns), fields, late)


def bucket_stream(rows: DataFrame, ts: str, value: str, bucket: str, watermark: str, start: str = "0 seconds", order: str | None = None) -> DataFrame:
    """The last value of each tumbling bucket of each session, stamped with the bucket's right edge; rows at one
    time are in the order of the column `order`."""
    late = rows.withWatermark(ts, watermark)
    groups = late.groupBy("session_id", F.window(ts, bucket, startTime=start).alias("w"))
    return groups.agg(F.max_by(value, F.struct(ts, order) if order else F.col(ts)).alias(value)).select("session_id", F.col("w.end").alias(ts), value)
