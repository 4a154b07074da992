"""Keeps daily bars of every session up to date while events arrive.

    python -m jobs.session_bars --events /data/events.parquet --out /data/bars

A day of a group of users is a session with a book of its own. For every bar of a session the job writes its messages
and trades, open, high, low, close, volume-weighted price, order-flow imbalance, mean spread and last mid, to Parquet
partitioned by day.

Each run takes only what is new: events with an id above the high-water mark of the runs before. The days they belong
to, however old, are computed again from all their events and overwrite their partitions (dynamic partition overwrite);
other days are neither read nor touched. The mark is written last, as one more row of a table that only grows, so a run
that ends early leaves the old mark and its days are written again, alike, by the next one. Run twice with nothing new,
the job writes nothing.
"""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobs.common import HERE, Done, log, main, read_or_empty  # noqa: E402
from tapeworks.functions import levels as lv  # noqa: E402
from tapeworks.operators import windows as win  # noqa: E402
from tapeworks.sources.tape import USERS, messages_of, micros, with_book  # noqa: E402

MARKS = "mark long, taken long, days int"
#: While bars are made, the sessions of a group of users have different numbers on different days.
DAY_STRIDE = 1 << 40
SCHEMA = (
    "session_id long, bar int, messages long, trades long, hidden long, volume long, signed_volume long, traded_value long, vwap double, "
    "open long, high long, low long, close long, flow long, flow_known boolean, mean_spread double, last_mid double, day int"
)


@dataclass(frozen=True)
class Config:
    """`events`: Parquet of (event_id, ts, user_id, event_type, value); `out`: where bars and marks go; `bar_seconds`: a
    bar's length, a divisor of a day; `files_per_day`: among how many files a day's bars are dealt."""

    events: str = ""
    out: str = ""
    bar_seconds: int = 14_400
    files_per_day: int = 4

    def __post_init__(self):
        if not self.events or not self.out:
            raise ValueError("both paths, events and out, must be given")
        if self.bar_seconds < 1 or 86_400 % self.bar_seconds or self.files_per_day < 1:
            raise ValueError("bar_seconds must divide a day, and files_per_day be at least 1")


def day_number(ts: Column) -> Column:
    """A date as the number yyyymmdd, the form that a partition's name keeps."""
    return (F.year(ts) * 10_000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")


def bars(events: DataFrame, bar_seconds: int) -> DataFrame:
    """The bars of whole days of events."""
    rows = events.withColumns({"day": day_number(F.col("ts")), "us": micros(F.col("ts"))})
    # All windows are partitioned by session, and a session does not leave its day.
    rows = messages_of(rows, F.floor(F.col("us") / 86_400_000_000) * DAY_STRIDE + F.expr(f"user_id div {USERS}"), "day", ((F.floor(F.col("us") / 1_000_000) % 86_400) / bar_seconds).cast("int").alias("bar"))
    rows = with_book(rows)
    a, b = F.col("asks"), F.col("bids")
    rows = rows.select("*", win.order_flow_contribution().alias("flow"), lv.spread(a, b).alias("spread"), lv.mid_price(a, b).alias("mid"))
    lit = (F.col("type") == 4) & (F.col("size") > 0)
    of = lambda cond, x: F.sum(F.when(cond, x).otherwise(0)).cast("long")
    at = F.when(lit, F.col("seq"))
    value = of(lit, F.col("size") * F.col("price"))
    volume = of(lit, F.col("size"))
    found = rows.groupBy("day", "session_id", "bar").agg(
        F.count("*").alias("messages"), F.count_if(lit).alias("trades"), F.count_if(F.col("type") == 5).alias("hidden"), volume.alias("volume"),
        of(lit, -F.col("direction") * F.col("size")).alias("signed_volume"), value.alias("traded_value"), F.try_divide(value.cast("double"), volume.cast("double")).alias("vwap"),
        F.min_by("price", at).alias("open"), F.max(F.when(lit, F.col("price"))).alias("high"), F.min(F.when(lit, F.col("price"))).alias("low"), F.max_by("price", at).alias("close"),
        F.sum("flow").alias("flow"), F.bool_and(F.col("flow").isNotNull()).alias("flow_known"), F.avg("spread").alias("mean_spread"),
        F.max_by("mid", F.when(F.col("mid").isNotNull(), F.col("seq"))).alias("last_mid"),
    )
    return found.withColumn("session_id", F.pmod("session_id", F.lit(DAY_STRIDE)))


def mark_of(spark: SparkSession, out: str) -> int | None:
    """The greatest event id that a finished run has taken; None before the first one."""
    return read_or_empty(spark, MARKS, f"{out}/marks").agg(F.max("mark")).first()[0]


def read_bars(spark: SparkSession, out: str) -> DataFrame:
    return read_or_empty(spark, SCHEMA, f"{out}/bars")


def run(spark: SparkSession, config: Config) -> Done:
    """One run. Events without an id, a time or a user have no place in a session and are counted in the log only."""
    events = spark.read.parquet(config.events).select("event_id", "ts", "user_id", "event_type", "value")
    out, mark = config.out.rstrip("/"), mark_of(spark, config.out.rstrip("/"))
    fresh = events if mark is None else events.where(F.col("event_id") > mark)
    placed = F.col("event_id").isNotNull() & F.col("ts").isNotNull() & F.col("user_id").isNotNull()
    # One pass over the new rows: how many, the mark to come, and the span of their days for the scan to prune by.
    taken, top, odd, first, last = fresh.agg(F.count("*"), F.max("event_id"), F.count_if(~placed), F.min(F.when(placed, F.col("ts"))), F.max(F.when(placed, F.col("ts")))).first()
    if first is None:
        return Done(taken, 0, 0, f"{out}/bars").told("session_bars", f"; nothing new above {mark}, {odd} rows without a place")
    days = fresh.where(placed).select(day_number(F.col("ts")).alias("day")).distinct()
    since, until = (F.expr(f"TIMESTAMP_NTZ'{x:%Y-%m-%d} 00:00:00'") for x in (first, last + timedelta(days=1)))
    # Nothing above the new mark: rows that arrive while this run reads belong to the next one.
    near = events.where(placed & (F.col("ts") >= since) & (F.col("ts") < until) & (F.col("event_id") <= top))
    whole = near.join(days.withColumnRenamed("day", "_day"), day_number(F.col("ts")) == F.col("_day"), "left_semi")
    found = bars(whole, config.bar_seconds).repartition("day", F.pmod(F.xxhash64("session_id"), F.lit(config.files_per_day)))
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{out}/bars")
    written = read_bars(spark, out).join(days, "day", "left_semi").agg(F.count("*"), F.count_distinct("day")).first()
    spark.createDataFrame([(top, taken, written[1])], MARKS).coalesce(1).write.mode("append").parquet(f"{out}/marks")
    log.info("session_bars: mark moved from %s to %s", mark, top)
    return Done(taken, written[0], written[1], f"{out}/bars").told("session_bars", f"; {odd} rows without a place")


if __name__ == "__main__":
    main(Config, run, f"{HERE}/session_bars.json", __doc__)
