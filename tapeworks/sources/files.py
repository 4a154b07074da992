"""Message and book file pairs: headerless CSV, aligned by position, schema fixed before reading.

Files are read by Spark's CSV reader, split and in parallel. A row's number in its file comes from the
split it lies in: rows of a split keep their order, and the counts of the splits before it are added.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks import schema
from tapeworks.functions import levels as lv
from tapeworks.schema import ASK_PADDING, BID_PADDING, PRICE_SCALE

_NAME = re.compile(r"^(?P<ticker>.+?)_(?P<date>\d{4}-\d{2}-\d{2})_(?P<start>\d+)_(?P<end>\d+)_(?P<kind>message|orderbook)_(?P<depth>\d+)\.csv$")


@dataclass(frozen=True)
class FilePair:
    """What a pair's names say: ticker, date, span in milliseconds after midnight, depth."""

    folder: str
    ticker: str
    date: str
    start_ms: int
    end_ms: int
    depth: int

    @classmethod
    def parse(cls, path: str) -> FilePair:
        folder, _, name = path.rpartition("/")
        m = _NAME.match(name)
        if not m:
            raise ValueError(f"{name!r} is not the name of a message or book file")
        return cls(folder, m["ticker"], m["date"], int(m["start"]), int(m["end"]), int(m["depth"]))

    def _path(self, kind: str) -> str:
        return f"{self.folder}/{self.ticker}_{self.date}_{self.start_ms}_{self.end_ms}_{kind}_{self.depth}.csv"

    @property
    def messages_path(self) -> str:
        return self._path("message")

    @property
    def orderbook_path(self) -> str:
        return self._path("orderbook")

    @property
    def span(self) -> tuple[float, float]:
        return self.start_ms / 1000, self.end_ms / 1000


def name_columns(path: Column) -> dict[str, Column]:
    """The same parts from a column of paths, for reading many pairs at once."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    part = lambda k: F.regexp_extract(name, _NAME.pattern.replace("?P<", "?<"), k)
    return {"ticker": part(1), "date": part(2).cast("date"), "start_ms": part(3).cast("long"), "end_ms": part(4).cast("long"), "depth": part(6).cast("int")}


def clock_ns(text: Column) -> Column:
    """Exact nanoseconds of a clock in seconds written as text; further decimals are cut off."""
    whole, tail = F.split(text, "[.]", 2), F.coalesce(F.get(F.split(text, "[.]", 2), F.lit(1)), F.lit(""))
    return F.get(whole, F.lit(0)).cast("long") * 1_000_000_000 + F.rpad(F.substring(tail, 1, 9), 9, "0").cast("long")


def price_unit(tick_size: float) -> int:
    """File price units in a tick; must be whole."""
    unit = round(tick_size * PRICE_SCALE)
    if unit < 1 or abs(tick_size * PRICE_SCALE - unit) > 1e-9:
        raise ValueError(f"tick size {tick_size} is not a whole number of file price units")
    return unit


def to_ticks(price: Column, tick_size: float) -> Column:
    """A currency price in ticks; one off the grid raises."""
    ratio = price / F.lit(tick_size)
    off = F.raise_error(F.concat(F.lit("price off the tick grid: "), price.cast("string"))).cast("long")
    return F.when(F.abs(ratio - F.rint(ratio)) <= 1e-9, F.rint(ratio).cast("long")).otherwise(off)


def _read(spark: SparkSession, path: str | list[str], kind) -> DataFrame:
    rows = spark.read.schema(kind).option("mode", "FAILFAST").option("header", False).csv(path)
    path = F.col("_metadata.file_path")
    # A file, or a folder of part files in order that Spark wrote under a file's name.
    file = F.regexp_extract(path, r"^(.*?[.]csv)(/|$)", 1)
    return rows.select(F.when(file == "", path).otherwise(file).alias("file"), F.struct(path.alias("path"), F.col("_metadata.file_block_start").alias("start")).alias("_block"), F.monotonically_increasing_id().alias("_id"), "*")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds `row_no`, 0-based within each file or folder. One small row a split is aggregated and sent to the rows, which stay
    where they were read."""
    splits = rows.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("file", "_block", "_first", before.alias("_before"))
    return rows.join(F.broadcast(offsets), ["file", "_block"]).withColumn("row_no", F.col("_before") + F.col("_id") - F.col("_first")).drop("_block", "_id", "_first", "_before")


def read_messages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, row_no, Time, TimeNanoseconds, Type, OrderID, Size, Price, Direction)."""
    return _message_columns(numbered(_read(spark, path, schema.FILE_MESSAGES)), "file", "row_no")


def _message_columns(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.col("Time").cast("double").alias("Time"), clock_ns(F.col("Time")).alias("TimeNanoseconds"), "Type", "OrderID", "Size", "Price", "Direction")


def read_orderbook(spark: SparkSession, path: str | list[str], depth: int) -> DataFrame:
    """(file, row_no, AskPrice1, ...) in file units, padding kept."""
    rows = numbered(_read(spark, path, schema.book_file(depth)))
    return rows.select("file", "row_no", *schema.book_columns(depth))


MESSAGE_RULES = {
    "Type is 1 to 7": lambda: F.col("Type").between(1, 7),
    "Direction is 1 or -1": lambda: F.col("Direction").isin(1, -1),
    "Size is not negative": lambda: F.col("Size") >= 0,
    "Price is at least -1": lambda: F.col("Price") >= -1,
}


def validate(df: DataFrame, rules: dict) -> DataFrame:
    """The frame itself if every row meets every rule; else a ValueError that counts the offenders. One pass."""
    _refuse(df.agg(*_broken(rules)).first(), rules)
    return df


def _broken(rules: dict) -> list[Column]:
    return [F.count_if(~F.coalesce(rule(), F.lit(False))).alias(f"r{k}") for k, rule in enumerate(rules.values())]


def _refuse(got: Row, rules: dict) -> None:
    broken = [f"{name}: {got[f'r{k}']} rows" for k, name in enumerate(rules) if got[f"r{k}"]]
    if broken:
        raise ValueError("; ".join(broken))


def prices_on_grid(book: DataFrame, depth: int, unit: int) -> DataFrame:
    """The frame itself if every quoted price is a multiple of the unit; else a ValueError with the first offender."""
    cols = [f"{s}Price{k}" for k in range(1, depth + 1) for s in ("Ask", "Bid")]
    off = lambda c: ~F.col(c).isin(ASK_PADDING, BID_PADDING) & (F.col(c) % unit != 0)
    which = F.coalesce(*(F.when(off(c), F.lit(c)) for c in cols))
    bad = book.where(reduce(lambda a, b: a | b, (off(c) for c in cols))).select("row_no", which.alias("column"))
    first = bad.agg(F.min_by(F.struct("row_no", "column"), "row_no").alias("x")).first()["x"]
    if first is not None:
        raise ValueError(f"{first['column']} of row {first['row_no']} is not a multiple of {unit}")
    return book


def in_window(opens: float, closes: float, time: str = "Time") -> Column:
    """Rows of a trading window, both ends included."""
    return F.col(time).between(opens, closes)


def load_aligned(spark: SparkSession, pair: FilePair, opens: float | None = None, closes: float | None = None) -> DataFrame:
    """Messages and book states of a pair, row by row: (row_no, Time, ..., asks, bids) in file units.

    A window outside the files' span, files of different length and an empty window raise.
    """
    lo, hi = pair.span
    opens, closes = lo if opens is None else opens, hi if closes is None else closes
    if opens < lo or closes > hi or opens > closes:
        raise ValueError(f"the window {opens}-{closes} is not inside {lo}-{hi}")
    messages, book = read_messages(spark, pair.messages_path).drop("file"), read_orderbook(spark, pair.orderbook_path, pair.depth).drop("file")
    # What is told of the files needs no row numbers: one pass over each.
    seen = _message_columns(_read(spark, pair.messages_path, schema.FILE_MESSAGES)).agg(F.count("*").alias("n"), F.count_if(in_window(opens, closes)).alias("inside"), *_broken(MESSAGE_RULES)).first()
    n, m = seen["n"], _read(spark, pair.orderbook_path, schema.book_file(pair.depth)).count()
    if n != m:
        raise ValueError(f"{n} messages and {m} book states")
    _refuse(seen, MESSAGE_RULES)
    if not seen["inside"]:
        raise ValueError(f"no message lies in {opens}-{closes}")
    sides = book.select("row_no", lv.from_wide("Ask", pair.depth).alias("asks"), lv.from_wide("Bid", pair.depth).alias("bids"))
    return messages.where(in_window(opens, closes)).join(sides, "row_no")


def session_rows(aligned: DataFrame, unit: int, session_id: int = 0) -> DataFrame:
    """The pair as session rows: (session_id, seq, ts_ns, type, size, price, direction, asks, bids), prices of the
    book in ticks, of the messages in file units."""
    ticks = lambda side: F.transform(side, lambda x: F.struct((x["price"] / unit).cast("long").alias("price"), x["size"].alias("size")))
    return aligned.select(
        F.lit(session_id).cast("long").alias("session_id"), F.col("row_no").alias("seq"), F.col("TimeNanoseconds").alias("ts_ns"), F.col("Type").cast("int").alias("type"),
        F.col("Size").alias("size"), F.col("Price").alias("price"), F.col("Direction").cast("int").alias("direction"), ticks(F.col("asks")).alias("asks"), ticks(F.col("bids")).alias("bids"),
    )


def touch_prices(spark: SparkSession, pair: FilePair) -> DataFrame:
    """(row_no, Time, ask, bid): the two best prices in file units; only their columns are parsed."""
    book = read_orderbook(spark, pair.orderbook_path, pair.depth).select("row_no", F.col("AskPrice1").alias("ask"), F.col("BidPrice1").alias("bid"))
    return read_messages(spark, pair.messages_path).select("row_no", "Time").join(book, "row_no")


def padding_census(book: DataFrame, depth: int) -> DataFrame:
    """(side, level, rows, first_row, last_row) of the levels of a book file that are padded somewhere."""
    pads = F.array_compact(F.array(*(F.when(F.col(f"{s}Price{k}") == p, F.struct(F.lit(s).alias("side"), F.lit(k).alias("level"))) for s, p in (("Ask", ASK_PADDING), ("Bid", BID_PADDING)) for k in range(1, depth + 1))))
    rows = book.select("row_no", F.explode(pads).alias("x"))
    return rows.groupBy("x.side", "x.level").agg(F.count("*").alias("rows"), F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"))


def clock(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, Time, TimeNanoseconds) alone; other columns are not parsed."""
    rows = numbered(_read(spark, path, schema.FILE_MESSAGES))
    return rows.select("row_no", F.col("Time").cast("double").alias("Time"), clock_ns(F.col("Time")).alias("TimeNanoseconds"))


def count_rows(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def file_census(spark: SparkSession, pairs: list[FilePair]) -> DataFrame:
    """Names, bytes and line counts of pairs."""
    paths = [p for pair in pairs for p in (pair.messages_path, pair.orderbook_path)]
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    parts = lines.groupBy("path").agg(F.count("*").alias("rows"), F.max("bytes").alias("bytes"))
    got = parts.groupBy(F.regexp_extract("path", r"^(.*?[.]csv)(/|$)", 1).alias("path")).agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    return got.select(*(c.alias(n) for n, c in name_columns(F.col("path")).items()), "rows", "bytes")


def write_pair(rows: DataFrame, messages_path: str, orderbook_path: str, depth: int, unit: int = 1) -> None:
    """Writes two folders of headerless CSV in row order, the clock with nine decimals.

    `rows` has row_no, TimeNanoseconds, Type, OrderID, Size, Price, Direction, asks and bids (in ticks). Range
    partitioning keeps the order across files, so their concatenation is the file.
    """
    ordered = rows.repartitionByRange("row_no").sortWithinPartitions("row_no")
    ns = F.col("TimeNanoseconds")
    clock = F.format_string("%d.%09d", F.floor(ns / 1_000_000_000), ns % 1_000_000_000)
    ordered.select(clock.alias("Time"), "Type", "OrderID", "Size", "Price", "Direction").write.csv(messages_path)
    ordered.select(*lv.to_wide(F.col("asks"), F.col("bids"), depth, unit)).write.csv(orderbook_path)


def write_delta_log(deltas: DataFrame, path: str) -> None:
    """The sparse log as Parquet, ordered so that row groups prune by session and row."""
    deltas.select(*(F.col(f.name).cast(f.dataType) for f in schema.DELTA_LOG.fields)).repartitionByRange("session_id", "seq").sortWithinPartitions("session_id", "seq").write.parquet(path)
