"""Event-time windows and alignment over sessions.

The clock `ts_ns` is not unique; `seq` orders rows at one instant. A window (t - w, t] is open on the
left by time and bounded on the right by the row itself: a row never sees a later row of its instant.
That frame is the difference of two running sums over one partitioning and one sort. Look-ups in time
are window functions too, so nothing is joined. Sums of LONGs are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions import levels as lv

BY = "session_id"


def by_row():
    return Window.partitionBy(BY).orderBy("ts_ns", "seq")


def by_time():
    """One order key, as frames by range need it."""
    return Window.partitionBy(BY).orderBy("ts_ns")


def running(value: Column) -> Column:
    return F.sum(value).over(by_row().rowsBetween(Window.unboundedPreceding, 0))


def rolling_sum(value: Column, window_ns: int) -> Column:
    """The sum over (t - w, t] up to the row itself; `value` must not be NULL."""
    before = F.sum(value).over(by_time().rangeBetween(Window.unboundedPreceding, -window_ns))
    return running(value) - F.coalesce(before, F.lit(0))


def window_start(window_ns: int) -> Column:
    """How many rows of the session lie at or before t - w: the 0-based first row of the window."""
    return F.count(F.lit(1)).over(by_time().rangeBetween(Window.unboundedPreceding, -window_ns))


def order_flow_contribution() -> Column:
    """What a row's event did to the touch: size gained at the bid less size gained at the ask.

    NULL on a session's first row and where any of the four touches is missing.
    """
    now = {s: lv.best(F.col(s)) for s in ("bids", "asks")}
    was = {s: F.lag(x).over(by_row()) for s, x in now.items()}
    b, pb, a, pa = now["bids"], was["bids"], now["asks"], was["asks"]
    zero = F.lit(0).cast("long")
    take = lambda cond, x: F.when(cond, x["size"]).otherwise(zero)
    flow = take(b["price"] >= pb["price"], b) - take(b["price"] <= pb["price"], pb) - take(a["price"] <= pa["price"], a) + take(a["price"] >= pa["price"], pa)
    return F.when(b.isNotNull() & pb.isNotNull() & a.isNotNull() & pa.isNotNull(), flow)


def backward_sum(value: Column, window_ns: int) -> Column:
    """The windowed sum, NULL where the window holds a NULL."""
    missing = rolling_sum(value.isNull().cast("long"), window_ns)
    return F.when(missing == 0, rolling_sum(F.coalesce(value, F.lit(0)), window_ns))


def average_depth(depth: Column, window_ns: int) -> Column:
    """Half the mean touch depth over the window's measured rows."""
    n = rolling_sum(depth.isNotNull().cast("long"), window_ns)
    return F.try_divide(rolling_sum(F.coalesce(depth, F.lit(0)), window_ns).cast("double"), (2 * n).cast("double"))


def rolling_vwap(window_ns: int, volume: str = "volume", signed: str = "signed", value: str = "value") -> dict[str, Column]:
    """Ratios of windowed sums: all trades, buys and sells; NULL where nothing traded."""
    out = {}
    for side, taken in (("", F.col(volume) > 0), ("Buy", F.col(signed) > 0), ("Sell", F.col(signed) < 0)):
        part = lambda c: rolling_sum(F.when(taken, F.col(c)).otherwise(F.lit(0)).cast("long"), window_ns)  # noqa: B023, E731
        out[side] = F.try_divide(part(value).cast("double"), part(volume).cast("double"))
    return out


def as_of(value: Column, offset_ns: int) -> Column:
    """The value of the last row with time at most t + offset (the last of several at one instant)."""
    frame = by_time().rangeBetween(Window.unboundedPreceding, offset_ns)
    return F.max_by(F.struct(value.alias("v")), F.col("seq")).over(frame)["v"]


def segments(broken: Column) -> Column:
    """A running count of broken rows; a broken row opens the segment that follows it."""
    return F.sum(F.when(broken, 1).otherwise(0)).over(by_row().rowsBetween(Window.unboundedPreceding, 0)).cast("long")


def aligned(df: DataFrame, value: Column, broken: Column | None = None) -> DataFrame:
    """(session_id, seq, ts_ns, value, segment) on the session's clock."""
    rows = df.select(BY, "seq", "ts_ns", value.alias("value"), (broken if broken is not None else F.lit(False)).alias("broken"))
    return rows.select(BY, "seq", "ts_ns", "value", segments(F.col("broken")).alias("segment"))


def backward_change(window_ns: int) -> Column:
    """value less the value just before the window opened; NULL before the first row or across segments."""
    same = as_of(F.col("segment"), -window_ns) == F.col("segment")
    return F.when(same, F.col("value") - as_of(F.col("value"), -window_ns))


def ahead(horizon_ns: int) -> Column:
    return as_of(F.col("seq"), horizon_ns)


def forward_change(horizon_ns: int) -> Column:
    """The value as of t + h less the row's own; NULL without a later row or across segments."""
    fine = (ahead(horizon_ns) > F.col("seq")) & (as_of(F.col("segment"), horizon_ns) == F.col("segment"))
    return F.when(fine, as_of(F.col("value"), horizon_ns) - F.col("value"))


def forward_change_to_next_event() -> Column:
    same = F.lead("segment").over(by_row()) == F.col("segment")
    return F.when(same, F.lead("value").over(by_row()) - F.col("value"))


def forward_jump_counts(series: DataFrame, horizon_ns: int) -> DataFrame:
    """How many up and down moves fall in (t, t + h]; steps across segments do not count.

    NULL where no later row is in reach. The ends need not share a segment.
    """
    step = F.when(F.lag("segment").over(by_row()) == F.col("segment"), F.col("value") - F.lag("value").over(by_row()))
    rows = series.withColumn("step", step)
    rows = rows.withColumns({n: F.sum(F.when(c, 1).otherwise(0)).over(by_row().rowsBetween(Window.unboundedPreceding, 0)) for n, c in (("ups", F.col("step") > 0), ("downs", F.col("step") < 0))})
    reach = ahead(horizon_ns) > F.col("seq")
    return rows.select(BY, "seq", *(F.when(reach, as_of(F.col(n), horizon_ns) - F.col(n)).alias(n) for n in ("ups", "downs")))


def forward_vwap(rows: DataFrame, horizon_ns: int) -> DataFrame:
    """The VWAP over (t, t + h] less the row's mid; needs volume, value, mid (as `value_mid`) and segment."""
    sums = rows.withColumns({f"c_{c}": F.sum(F.coalesce(c, F.lit(0))).over(by_row().rowsBetween(Window.unboundedPreceding, 0)) for c in ("volume", "value")})
    fine = (ahead(horizon_ns) > F.col("seq")) & (as_of(F.col("segment"), horizon_ns) == F.col("segment"))
    gain = lambda c: (as_of(F.col(f"c_{c}"), horizon_ns) - F.col(f"c_{c}")).cast("double")
    return sums.select(BY, "seq", F.when(fine & (gain("volume") > 0), F.try_divide(gain("value"), gain("volume")) - F.col("value_mid")).alias("forward_vwap"))


def lag_buckets(value: Column, window_ns: int, buckets: int) -> list[Column]:
    """The windowed sum split into `buckets` contiguous ranges of lag, nearest first; NULL as a whole where
    the widest window holds a NULL."""
    edges = [window_ns * k // buckets for k in range(1, buckets + 1)]
    sums = [backward_sum(value, w) for w in edges]
    return [sums[0]] + [b - a for a, b in zip(sums, sums[1:])]


def bucket_series(series: DataFrame, bucket_ns: int) -> DataFrame:
    """The last value of each non-empty bucket [k b, (k + 1) b) from the session's first time, stamped with
    the bucket's right edge."""
    first = F.min("ts_ns").over(Window.partitionBy(BY))
    rows = series.withColumn("t0", first).withColumn("k", F.floor((F.col("ts_ns") - F.col("t0")) / bucket_ns).cast("long"))
    last = rows.groupBy(BY, "k").agg(F.max_by(F.struct("value", "segment", "t0"), F.struct("ts_ns", "seq")).alias("x"))
    return last.select(BY, (F.col("x.t0") + (F.col("k") + 1) * bucket_ns).alias("ts_ns"), "x.value", "x.segment")


def on_clock(rows: DataFrame, clock: DataFrame, value: str, opening: Column | None = None, strict: bool = False) -> DataFrame:
    """As-of of an external clock (session_id, ts_ns): the last value at or before (strictly before, if
    `strict`) each time, `opening` where there is none. Both are united and sorted; nothing is joined."""
    first = F.lit(0 if strict else 1)
    both = rows.select(BY, "ts_ns", F.lit(1 - (0 if strict else 1)).alias("k"), "seq", F.struct(F.col(value).alias("v")).alias("x"))
    both = both.unionByName(clock.select(BY, "ts_ns", first.alias("k"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast(both.schema["x"].dataType).alias("x")).withColumn("tick", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy(BY).orderBy("ts_ns", "k", "seq").rowsBetween(Window.unboundedPreceding, 0)
    # With `strict` the clock's rows come first at their instant, else last.
    found = both.withColumn("last", F.last("x", ignorenulls=True).over(order)).where("tick")
    return found.select(BY, "ts_ns", F.coalesce(F.col("last.v"), opening if opening is not None else F.lit(None)).alias(value))


def islands(df: DataFrame, fresh: Column, label: str = "island") -> DataFrame:
    """Numbers the maximal stretches of rows between `fresh` marks."""
    return df.withColumn(label, F.sum(F.when(fresh, 1).otherwise(0)).over(by_row().rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def market_orders(messages: DataFrame) -> DataFrame:
    """Adds `island` (contiguous executions of one instant and direction), `inside` (the row lies between the
    island's first and last visible fill) and `order_no` (dense, 0-based; -1 outside any order)."""
    execution = F.col("type").isin(4, 5)
    lagged = {c: F.lag(c).over(by_row()) for c in ("type", "ts_ns", "direction")}
    joined = execution & lagged["type"].isin(4, 5) & (lagged["ts_ns"] == F.col("ts_ns")) & (lagged["direction"] == F.col("direction"))
    rows = islands(messages, ~F.coalesce(joined, F.lit(False)))
    block = Window.partitionBy(BY, "island")
    visible = F.when(F.col("type") == 4, F.col("seq"))
    rows = rows.withColumns({"first_fill": F.min(visible).over(block), "last_fill": F.max(visible).over(block)})
    rows = rows.withColumn("inside", F.coalesce(F.col("seq").between(F.col("first_fill"), F.col("last_fill")), F.lit(False)))
    starts = F.sum(F.when(F.col("inside") & (F.col("seq") == F.col("first_fill")), 1).otherwise(0)).over(by_row().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("order_no", F.when(F.col("inside"), starts - 1).otherwise(-1).cast("long"))
