"""Folding message streams into book states: batch, table function and stream, over one kernel.

Matching is sequential within a session and independent across sessions, so rows are dealt by session,
sorted within it, and streamed through the kernel in Arrow batches; a session's book is all that stays in
memory. Everything that a state determines is left to column expressions afterwards.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.operators.matching import Book, Outcome
from tapeworks.schema import BUY, FOLDED, SELL, WITHDRAW

COLUMNS = ["session_id", "seq", "ts_ns", "size", "price", "direction", "kind"]
NAMES = FOLDED.fieldNames()


#: How a column of FOLDED is made of a message's key, the book after it, the depth of states and what the message did.
_MADE = {
    "session_id": lambda key, book, depth, out: key[0],
    "seq": lambda key, book, depth, out: key[1],
    "ts_ns": lambda key, book, depth, out: key[2],
    "asks": lambda key, book, depth, out: book.levels(SELL, depth),
    "bids": lambda key, book, depth, out: book.levels(BUY, depth),
    "fills": lambda key, book, depth, out: out.fills,
    "deltas": lambda key, book, depth, out: out.deltas,
    "fill_count": lambda key, book, depth, out: len(out.fills),
    "traded_size": lambda key, book, depth, out: out.traded,
    "traded_value": lambda key, book, depth, out: out.value,
    "unfilled": lambda key, book, depth, out: out.unfilled,
    "withdrawn": lambda key, book, depth, out: out.withdrawn,
}


def row_maker(columns: list[str]) -> Callable[[tuple, Book, int, Outcome], tuple]:
    """Makes the named columns of FOLDED, and no others; nested values are tuples in the order of their fields."""
    makers = [_MADE[c] for c in columns]
    return lambda key, book, depth, out: tuple([make(key, book, depth, out) for make in makers])


_whole = row_maker(NAMES)


def applied(book: Book, session_id, seq, size, price, direction, kind) -> Outcome:
    """Applies a message unless it is malformed."""
    _check(session_id, seq, size, price, direction, kind)
    return book.apply(size, price, direction, kind)


def fold_row(book: Book, depth: int, session_id, seq, ts_ns, size, price, direction, kind) -> tuple:
    """Applies a message and gives the row that FOLDED describes."""
    return _whole((session_id, seq, ts_ns), book, depth, applied(book, session_id, seq, size, price, direction, kind))


class _Columns:
    """Folded rows as columns; nested values go straight to flat arrays with offsets."""

    _LISTS = {"asks": ("price", "size"), "bids": ("price", "size"), "fills": ("price", "size", "aggressor"), "deltas": ("side", "price", "resting")}
    _SMALL = ("aggressor", "side")
    _PLAIN = ("session_id", "seq", "ts_ns")
    _COUNTS = ("fill_count", "traded_size", "traded_value", "unfilled", "withdrawn")

    def __init__(self):
        self.keys, self.counts = [], []
        self.rows = {n: [] for n in self._LISTS}
        self.ends = {n: [0] for n in self._LISTS}

    def add(self, key: tuple, book: Book, depth: int, out) -> None:
        self.keys.append(key)
        self.counts.append((len(out.fills), out.traded, out.value, out.unfilled, out.withdrawn))
        for name, values in (("asks", book.levels(SELL, depth)), ("bids", book.levels(BUY, depth)), ("fills", out.fills), ("deltas", out.deltas)):
            self.rows[name] += values
            self.ends[name].append(len(self.rows[name]))

    def _list(self, name: str) -> pa.Array:
        fields = self._LISTS[name]
        flat = list(zip(*self.rows[name])) or [[] for _ in fields]
        items = pa.StructArray.from_arrays([pa.array(v, pa.int32() if f in self._SMALL else pa.int64()) for f, v in zip(fields, flat)], list(fields))
        return pa.ListArray.from_arrays(pa.array(self.ends[name], pa.int32()), items)

    def batch(self) -> pa.RecordBatch:
        keys, counts = list(zip(*self.keys)), list(zip(*self.counts))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in keys), *map(self._list, self._LISTS), *(pa.array(c, pa.int64()) for c in counts)], [*self._PLAIN, *self._LISTS, *self._COUNTS])


def _check(session_id, seq, size, price, direction, kind) -> None:
    if direction not in (BUY, SELL) or size < 0 or price < 0 or kind not in (1, 2):
        raise ValueError(f"message {session_id}/{seq} is malformed: size {size}, price {price}, direction {direction}, kind {kind}")


def _dealt(messages: DataFrame) -> DataFrame:
    """Sessions dealt to a fixed number of tasks (small inputs are not put into one) and put in order."""
    ways = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return messages.select(*COLUMNS).repartition(ways, "session_id").sortWithinPartitions("session_id", "ts_ns", "seq")


def fold(messages: DataFrame, depth: int, opening: dict[int, dict[int, int]] | None = None, strict: bool = False, storage: str = "sorted", band: tuple[int, int] | None = None) -> DataFrame:
    """(FOLDED) one row a message: the state after it, its fills and deltas, what it traded.

    `opening` maps BUY and SELL to {price: size} and opens every session; it is a parameter, not data. `storage` and
    `band` are those of the books and change no result.
    """
    start = opening or {BUY: {}, SELL: {}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, book = object(), None
        for batch in batches:
            sink = _Columns()
            for session_id, seq, ts_ns, size, price, direction, kind in zip(*(c.to_pylist() for c in batch.columns)):
                _check(session_id, seq, size, price, direction, kind)
                if session_id != session:
                    session, book = session_id, Book.of(start[BUY], start[SELL], strict, storage, band)
                sink.add((session_id, seq, ts_ns), book, depth, book.apply(size, price, direction, kind))
            if sink.keys:
                yield sink.batch()

    return _dealt(messages).mapInArrow(run, FOLDED)


def fold_tally(messages: DataFrame, opening: dict[int, dict[int, int]] | None = None) -> DataFrame:
    """(session_id, messages, fills, traded, withdrawals) by a fold that records no states."""
    start = opening or {BUY: {}, SELL: {}}
    names = ["session_id", "messages", "fills", "traded", "withdrawals"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, book = [], None, None
        for batch in batches:
            for session_id, seq, _, size, price, direction, kind in zip(*(c.to_pylist() for c in batch.columns)):
                _check(session_id, seq, size, price, direction, kind)
                if now is None or session_id != now[0]:
                    now, book = [session_id, 0, 0, 0, 0], Book.of(start[BUY], start[SELL])
                    done.append(now)
                out = book.apply(size, price, direction, kind)
                now[1] += 1
                now[2] += len(out.fills)
                now[3] += out.traded
                now[4] += kind == WITHDRAW
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], names)

    return _dealt(messages).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def fold_table_function(depth: int):
    """The fold as a table function for TABLE(...) PARTITION BY session_id ORDER BY (ts_ns, seq)."""

    class FoldBook:
        def __init__(self):
            self.book = Book()

        def eval(self, row):
            yield fold_row(self.book, depth, *(row[c] for c in COLUMNS))

    return F.udtf(FoldBook, returnType=FOLDED.simpleString())


def fold_by_table_function(messages: DataFrame, depth: int) -> DataFrame:
    """The fold by the table function, under a name of this call's own, so that folds side by side do not meet."""
    spark, name = messages.sparkSession, f"fold_book_{uuid.uuid4().hex}"
    spark.udtf.register(name, fold_table_function(depth))
    return spark.sql(f"SELECT * FROM {name}(TABLE({{rows}}) PARTITION BY session_id ORDER BY (ts_ns, seq))", rows=messages.select(*COLUMNS))


def levels_frame(folded: DataFrame) -> DataFrame:
    """(session_id, seq, side, price, resting) of every level change."""
    return folded.select("session_id", "seq", "ts_ns", F.explode("deltas").alias("d")).select("session_id", "seq", "ts_ns", "d.side", "d.price", "d.resting")


def book_of_deltas(deltas: DataFrame) -> DataFrame:
    """(session_id, side, price, resting): the levels that a log of changes leaves. Changes carry absolute sizes, so
    one that is delivered again changes nothing."""
    last = F.max_by("resting", F.struct("ts_ns", "seq")).alias("resting")
    return deltas.groupBy("session_id", "side", "price").agg(last).where("resting > 0")


def resting_frame(folded: DataFrame) -> DataFrame:
    """(session_id, seq, price, resting) of every order of which something came to rest: its own side's delta, the last one.

    A withdrawal is known by what it withdrew, and an order's side by its fills; one without fills rests as a whole.
    """
    last, side = F.element_at("deltas", -1), F.get("fills", F.lit(0))["aggressor"]
    rests = (F.col("withdrawn") == 0) & (F.size("deltas") > 0) & (side.isNull() | (last["side"] == side))
    return folded.where(rests).select("session_id", "seq", last["price"].alias("price"), last["resting"].alias("resting"))


def fills_frame(folded: DataFrame) -> DataFrame:
    return folded.select("session_id", "seq", "ts_ns", F.posexplode("fills").alias("fill", "f")).select("session_id", "seq", "ts_ns", "fill", "f.price", "f.size", "f.aggressor")


def market_order_size(fills: Column) -> Column:
    return F.aggregate(fills, F.lit(0).cast("long"), lambda s, x: s + x["size"])


def walked_the_book(fills: Column) -> Column:
    """Whether a message traded at more than one price."""
    return F.size(F.array_distinct(F.transform(fills, lambda x: x["price"]))) > 1


def trade_rows(folded: DataFrame) -> DataFrame:
    """(session_id, seq, ts_ns, volume, signed, value) of what each message traded; its fills tell the direction."""
    side = F.coalesce(F.get("fills", F.lit(0))["aggressor"], F.lit(0))
    return folded.select("session_id", "seq", "ts_ns", F.col("traded_size").alias("volume"), (side * F.col("traded_size")).alias("signed"), F.col("traded_value").alias("value"))
