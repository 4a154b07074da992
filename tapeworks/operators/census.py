"""Censuses of message and book files, and the coarsening of fills into market orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions import levels as lv
from tapeworks.operators import windows as win
from tapeworks.operators.distributions import medians
from tapeworks.schema import EVENT_TYPES

BY = "session_id"


def event_census(messages: DataFrame) -> DataFrame:
    """Counts of every event type, those that do not occur included."""
    return messages.groupBy(BY).agg(*(F.count_if(F.col("type") == k).alias(f"type_{k}") for k in EVENT_TYPES))


def touch_census(book: DataFrame) -> DataFrame:
    spread = lv.spread(F.col("asks"), F.col("bids"))
    rows = book.select(BY, spread.alias("s"))
    return rows.groupBy(BY).agg(
        F.count("*").alias("rows"), F.count_if(F.col("s").isNull()).alias("unquoted"), F.count_if(F.col("s") < 0).alias("crossed"),
        F.count_if(F.col("s") == 0).alias("locked"), F.min("s").alias("min_spread"), F.max("s").alias("max_spread"),
    )


def constraint_census(messages: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """For each named constraint: how many messages it rejects and the names of their types, by type code."""
    names = F.create_map(*[F.lit(x) for k, v in EVENT_TYPES.items() for x in (k, v)])
    bad = F.array_compact(F.array(*(F.when(~c, F.lit(n)) for n, c in constraints.items())))
    rows = messages.select(F.explode(bad).alias("constraint"), "type").groupBy("constraint", "type").count()
    got = rows.groupBy("constraint").agg(F.sum("count").alias("rejected"), F.array_sort(F.collect_set("type")).alias("types"))
    every = messages.sparkSession.createDataFrame([(n,) for n in constraints], "constraint string")
    out = every.join(got, "constraint", "left")
    return out.select("constraint", F.coalesce("rejected", F.lit(0)).alias("rejected"), F.concat_ws(", ", F.transform(F.coalesce("types", F.array().cast("array<int>")), lambda t: names[t])).alias("types"))


def padding_census(book: DataFrame, depth: int) -> DataFrame:
    """(session, side, level) of levels that are padded somewhere: rows, first and last time."""
    missing = F.array_compact(F.array(*(F.when(F.size(s) < k, F.struct(F.lit(s).alias("side"), F.lit(k).alias("level"))) for s in ("asks", "bids") for k in range(1, depth + 1))))
    rows = book.select(BY, "ts_ns", F.explode(missing).alias("m"))
    return rows.groupBy(BY, "m.side", "m.level").agg(F.count("*").alias("rows"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def clock_census(text: DataFrame, clock: str = "Time", row: str = "row_no") -> DataFrame:
    """Rows, and the first example, by the number of decimals of a clock written as text."""
    decimals = F.length(F.coalesce(F.get(F.split(clock, "[.]"), F.lit(1)), F.lit("")))
    return text.groupBy(decimals.alias("decimals")).agg(F.count("*").alias("rows"), F.min_by(clock, row).alias("example"))


def clock_origin_census(rows: DataFrame, offsets_s: list[int]) -> DataFrame:
    """How many exact times survive as doubles when the clock counts from an earlier origin."""
    t = rows.select(BY, "seq", "ts_ns", F.explode(F.array(*(F.lit(o).cast("long") for o in offsets_s))).alias("offset_s"))
    t = t.withColumn("as_double", F.col("offset_s").cast("double") + F.col("ts_ns") / F.lit(1e9))
    w = Window.partitionBy(BY, "offset_s").orderBy("ts_ns", "seq")
    merged = (F.lag("ts_ns").over(w) != F.col("ts_ns")) & (F.lag("as_double").over(w) == F.col("as_double"))
    ulp = F.pow(F.lit(2.0), F.floor(F.log2(F.max("as_double"))) - 52)
    return t.withColumn("merged", merged).groupBy("offset_s").agg(F.count_distinct("ts_ns").alias("exact"), F.count_distinct("as_double").alias("as_doubles"), F.count_if("merged").alias("collisions"), ulp.alias("spacing"))


def describe_messages(messages: DataFrame) -> DataFrame:
    """Counts by type, withdrawal rate, length, median gap and share of zero gaps of each session."""
    rows = messages.select(BY, "type", "ts_ns", (F.col("ts_ns") - F.lag("ts_ns").over(win.by_row())).alias("gap"))
    n = {k: F.count_if(F.col("type") == k) for k in (1, 2, 3)}
    got = rows.groupBy(BY).agg(
        F.count("*").alias("messages"), *(n[k].alias(f"type_{k}") for k in n), F.try_divide((n[2] + n[3]).cast("double"), n[1].cast("double")).alias("withdrawal_rate"),
        ((F.max("ts_ns") - F.min("ts_ns")) / F.lit(1e9)).alias("seconds"),
        F.try_divide(F.count_if(F.col("gap") == 0).cast("double"), F.count("gap").cast("double")).alias("zero_gaps"),
    )
    return got.join(medians(rows, "gap", [BY], "median_gap"), BY, "left")


def describe_orderbook(book: DataFrame, tick: int = 1) -> DataFrame:
    """Spreads, first and last mid, mean top imbalance; rows without a quote count in the share's denominator."""
    a, b = F.col("asks"), F.col("bids")
    rows = book.select(BY, "seq", lv.spread(a, b).alias("s"), (2 * lv.mid_price(a, b)).cast("long").alias("m2"), lv.queue_imbalance(F.slice(a, 1, 1), F.slice(b, 1, 1), 1).alias("i"))
    quoted = F.when(F.col("s").isNotNull(), F.col("seq"))
    got = rows.groupBy(BY).agg(
        F.count("*").alias("rows"), F.avg("s").alias("mean_spread"),
        (F.count_if(F.col("s") <= tick) / F.count("*")).alias("one_tick_share"), (F.min_by("m2", quoted) / F.lit(2.0)).alias("first_mid"),
        (F.max_by("m2", quoted) / F.lit(2.0)).alias("last_mid"), F.round(F.avg("i"), 9).alias("mean_imbalance"), F.count_if(F.col("s") <= 0).alias("crossed_or_locked"),
    )
    return got.join(medians(rows, "s", [BY], "median_spread"), BY, "left")


def lit_trades(unit: int = 1) -> dict[str, Column]:
    """Volume, signed volume (the aggressor's side is the resting side's opposite) and traded value in
    tick-shares of visible executions; hidden ones never showed in the book."""
    lit_ = F.col("type") == 4
    size = F.when(lit_, F.col("size")).otherwise(0).cast("long")
    return {"volume": size, "signed": -F.col("direction") * size, "value": F.when(lit_, F.col("size") * F.col("price") / unit).otherwise(0.0)}


CONVENTIONS = ("instant and direction", "contiguous fills", "hidden absorbed")


def visible_orders(messages: DataFrame) -> DataFrame:
    """Every visible execution with its order's label under each of three conventions, in long form."""
    rows = win.market_orders(messages)
    lagged = {c: F.lag(c).over(win.by_row()) for c in ("type", "ts_ns", "direction")}
    joined = (F.col("type") == 4) & (lagged["type"] == 4) & (lagged["ts_ns"] == F.col("ts_ns")) & (lagged["direction"] == F.col("direction"))
    rows = win.islands(rows, ~F.coalesce(joined, F.lit(False)), "run")
    text = lambda *c: F.concat_ws(":", *(F.col(x).cast("string") for x in c))
    labels = F.array(*(F.struct(F.lit(n).alias("convention"), x.alias("label")) for n, x in zip(CONVENTIONS, (text("ts_ns", "direction"), text("run"), text("order_no")))))
    return rows.where("type = 4").select(BY, "seq", "price", F.explode(labels).alias("l")).select(BY, "seq", "price", "l.*")


def market_order_census(messages: DataFrame) -> DataFrame:
    per = visible_orders(messages).groupBy(BY, "convention", "label").agg(F.count("*").alias("fills"), F.count_distinct("price").alias("prices"))
    multi = F.col("fills") > 1
    return per.groupBy(BY, "convention").agg(
        F.sum("fills").alias("executions"), F.count("*").alias("market_orders"), F.count_if(multi).alias("multi_fill"), F.sum(F.when(multi, F.col("fills")).otherwise(0)).alias("fills_inside"),
        F.max("fills").alias("largest"), F.count_if(multi & (F.col("prices") == 1)).alias("queue_splits"),
    )


def execution_gap_census(messages: DataFrame) -> DataFrame:
    """Gaps between visible executions of one price and side, by two meanings of adjacent."""
    cols = ("ts_ns", "price", "direction")
    in_file = messages.select(BY, "type", *cols, *(F.lag(c).over(win.by_row()).alias(f"p_{c}") for c in ("type", *cols))).where("type = 4 and p_type = 4").drop("p_type")
    among = messages.where("type = 4").select(BY, "type", *cols, *(F.lag(c).over(win.by_row()).alias(f"p_{c}") for c in cols)).where("p_ts_ns is not null")
    both = in_file.withColumn("adjacency", F.lit("in the file")).unionByName(among.withColumn("adjacency", F.lit("among the executions")))
    gap = F.col("ts_ns") - F.col("p_ts_ns")
    return both.where("price = p_price and direction = p_direction").groupBy("adjacency").agg(F.count("*").alias("pairs"), F.count_if(gap == 0).alias("same_instant"), F.min(F.when(gap > 0, gap)).alias("least_positive"))


def retained(messages: DataFrame) -> DataFrame:
    """The rows a coarse session keeps: the last of each market order and every message that is no execution;
    a session's first row also if it is an execution outside any order."""
    rows = win.market_orders(messages)
    order = Window.partitionBy(BY, "order_no")
    last = F.when(F.col("order_no") >= 0, F.max("seq").over(order) == F.col("seq"))
    first = F.row_number().over(win.by_row()) == 1
    keep = ~F.col("type").isin(4, 5) | F.coalesce(last, F.lit(False)) | (first & (F.col("order_no") < 0))
    return rows.withColumn("keep", keep).where("keep").drop("keep")


def coarsened(messages: DataFrame, unit: int = 1) -> DataFrame:
    """Fills summed onto the row that survives each market order: (.., order_no, volume, signed, value)."""
    rows = win.market_orders(messages.withColumns(lit_trades(unit)))
    order = Window.partitionBy(BY, "order_no")
    inside = F.col("order_no") >= 0
    first = F.row_number().over(win.by_row()) == 1
    keep = ~F.col("type").isin(4, 5) | (inside & (F.max("seq").over(order) == F.col("seq"))) | (first & ~inside)
    totals = {c: F.when(inside, F.sum(c).over(order)).otherwise(F.lit(0)) for c in ("volume", "signed", "value")}
    return rows.withColumn("keep", keep).withColumns(totals).where("keep").drop("keep", "island", "first_fill", "last_fill", "inside")


def coarsening_totals(messages: DataFrame, unit: int = 1) -> DataFrame:
    """(session, quantity, fine, coarse): rows, shares, traded value, VWAP and mean size before and after."""

    def totals(df: DataFrame, name: str) -> DataFrame:
        v, x = F.sum("volume").cast("double"), F.sum("value").cast("double")
        g = df.groupBy(BY).agg(F.count("*").cast("double").alias("rows"), v.alias("shares"), x.alias("traded value"), F.try_divide(x, v).alias("VWAP"), F.try_divide(v, F.count_if(F.col("volume") > 0).cast("double")).alias("mean size"))
        return g.select(BY, F.explode(F.array(*(F.struct(F.lit(c).alias("quantity"), F.col(c).alias(name)) for c in ("rows", "shares", "traded value", "VWAP", "mean size")))).alias("q")).select(BY, "q.*")

    return totals(messages.withColumns(lit_trades(unit)), "fine").join(totals(coarsened(messages, unit), "coarse"), [BY, "quantity"])


def coarsening_report(fine: DataFrame, coarse: DataFrame, columns: list[str]) -> DataFrame:
    """(statistic, rows_compared, rows_differing, largest_difference, relative_change) at the rows both have.

    NULL equals NULL; the magnitude is over rows where both sides are numbers.
    """
    long = lambda df, name: df.select(BY, "seq", F.explode(F.array(*(F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias(name)) for c in columns))).alias("x")).select(BY, "seq", "x.*")
    both = long(fine, "was").join(long(coarse, "now"), [BY, "seq", "statistic"])
    differs = ~F.col("was").eqNullSafe(F.col("now"))
    size = F.max(F.when(differs, F.abs(F.col("now") - F.col("was"))))
    return both.groupBy("statistic").agg(
        F.count("*").alias("rows_compared"), F.count_if(differs).alias("rows_differing"), F.coalesce(size, F.lit(0.0)).alias("largest_difference"),
        F.round(F.try_divide(F.avg("now") - F.avg("was"), F.avg("was")), 9).alias("relative_change"),
    )


def price_reversing_orders(messages: DataFrame) -> DataFrame:
    """Market orders whose visible fills step back towards the touch: (session, order_no, fills, first, last)."""
    rows = win.market_orders(messages).where("order_no >= 0 and type = 4")
    w = Window.partitionBy(BY, "order_no").orderBy("seq")
    away = (F.col("price") - F.lag("price").over(w)) * -F.lag("direction").over(w)
    per = rows.withColumn("away", away).groupBy(BY, "order_no").agg(F.count("*").alias("fills"), F.min("seq").alias("first_row"), F.max("seq").alias("last_row"), F.min("away").alias("least"))
    return per.where("least < 0").drop("least")


def executions_off_the_touch(messages_with_book: DataFrame, unit: int) -> DataFrame:
    """Visible executions whose price is not the best of their resting side just before."""
    was = {s: F.lag(lv.best(F.col(s))["price"]).over(win.by_row()) for s in ("asks", "bids")}
    best = F.when(F.col("direction") == 1, was["bids"]).otherwise(was["asks"]) * unit
    return messages_with_book.select(BY, "seq", "type", "price", best.alias("touch")).where("type = 4 and price <> touch")
