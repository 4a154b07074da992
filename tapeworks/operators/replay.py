"""Book states from a sparse log of absolute level sizes, without matching.

A delta (side, price, resting) holds until the next one of its level. Which levels live at a row is the
interval join `seq in [delta, next delta)`. Its equality key is a node of a tree over blocks of rows, in which a node has FAN
children: an interval is cut into the fewest whole nodes, at most 2 (FAN - 1) a level of the tree however long it is, and a
row looks at the node of each level above it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows to a block of the interval join, children to a node, and levels of the tree.
BLOCK, FAN, LEVELS = 256, 8, 14


def cover(low: Column, stop: Column, fan: int = FAN, levels: int = LEVELS) -> Column:
    """The nodes that make up the blocks [low, stop), as ARRAY<STRUCT<level, at>>; none if it is empty."""
    at_level = lambda k: (F.ceil(low / F.lit(fan**k)), F.floor(stop / F.lit(fan**k)))
    nodes = lambda k, a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: F.struct(F.lit(k).alias("level"), x.alias("at")))).otherwise(F.array().cast("array<struct<level: int, at: bigint>>"))
    out = []
    for k in range(levels):
        (a, b), (up, down) = at_level(k), at_level(k + 1)
        more = (up < down) if k + 1 < levels else F.lit(False)
        out += [nodes(k, a, F.when(more, up * fan).otherwise(b)), nodes(k, F.when(more, down * fan).otherwise(b), b)]
    # Most intervals are a few blocks long and are those blocks.
    return F.when(stop - low <= fan, nodes(0, low, stop)).otherwise(F.flatten(F.array(*out)))


def nodes_above(block: Column, top: Column, fan: int = FAN, levels: int = LEVELS) -> Column:
    """The nodes that hold a block, from its own up to the highest level that a cover within [0, top] can use."""
    highest = reduce(lambda a, b: a + b, (F.when(top + 1 >= fan**k, 1).otherwise(0) for k in range(1, levels)), F.lit(0))
    every = F.transform(F.sequence(F.lit(0), highest), lambda k: F.struct(k.alias("level"), F.floor(block / F.pow(F.lit(float(fan)), k)).alias("at")))
    return F.when(top + 1 < fan, F.array(F.struct(F.lit(0).alias("level"), block.alias("at")))).otherwise(every)


def intervals(deltas: DataFrame, top: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(session_id, side, price, resting, since, until, node): every level that holds size, a row a node of its cover."""
    level = Window.partitionBy("session_id", "side", "price").orderBy("seq")
    until = F.coalesce(F.lead("seq").over(level), F.lit((1 << 63) - 1))
    held = deltas.select("session_id", F.col("seq").alias("since"), until.alias("until"), "side", "price", "resting").where("resting > 0")
    held = held.join(top, "session_id").withColumn("until", F.least("until", F.col("top") + 1)).where("since < until")
    low, stop = F.floor(F.greatest("since", F.lit(0)) / block), F.floor((F.col("until") - 1) / block) + 1
    return held.select("session_id", "side", "price", "resting", "since", "until", F.explode(cover(low, stop, fan)).alias("node"))


def live_levels(deltas: DataFrame, rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(session_id, seq, side, price, resting) of every level that holds size at each row."""
    top = rows.groupBy("session_id").agg(F.max("seq").alias("top"))
    last = F.max("seq").over(Window.partitionBy("session_id"))
    keyed = rows.select("session_id", "seq", last.alias("last"))
    keyed = keyed.select("session_id", "seq", F.explode(nodes_above(F.floor(F.col("seq") / block), F.floor(F.col("last") / block), fan)).alias("node"))
    joined = keyed.join(intervals(deltas, top, block, fan), ["session_id", "node"]).where("seq >= since and seq < until")
    return joined.select("session_id", "seq", "side", "price", "resting")


def replay(opening: DataFrame, deltas: DataFrame, rows: DataFrame, depth: int, block: int = BLOCK) -> DataFrame:
    """(session_id, seq, asks, bids), the `depth` best levels at each row.

    `opening` (session_id, side, price, size) is the state before the first row. A row whose book is
    empty has empty sides. A log determines no trades.
    """
    start = opening.select("session_id", F.lit(-1).cast("long").alias("seq"), "side", "price", F.col("size").alias("resting"))
    log = start.unionByName(deltas.select("session_id", "seq", "side", "price", "resting"))
    level = F.struct(F.when(F.col("side") > 0, -F.col("price")).otherwise(F.col("price")).alias("rank"), F.struct("price", F.col("resting").alias("size")).alias("level"))
    live = live_levels(log, rows, block)
    side = lambda d: F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("side") == d, level))), 1, depth), lambda x: x["level"])
    # Every row comes once without a level, so that one with an empty book is there without a join.
    every = live.unionByName(rows.select("session_id", "seq", *(F.lit(None).cast(t).alias(c) for c, t in live.dtypes[2:])))
    return every.groupBy("session_id", "seq").agg(side(-1).alias("asks"), side(1).alias("bids"))


def opening_book(deltas: DataFrame, opening: DataFrame, at: int) -> DataFrame:
    """(session_id, side, price, size) of the levels that hold size just before row `at`."""
    start = opening.select("session_id", F.lit(-1).cast("long").alias("seq"), "side", "price", F.col("size").alias("resting"))
    log = start.unionByName(deltas.where(F.col("seq") < at).select("session_id", "seq", "side", "price", "resting"))
    last = log.groupBy("session_id", "side", "price").agg(F.max_by("resting", "seq").alias("size"))
    return last.where("size > 0")


def log_prices(deltas: DataFrame, opening: DataFrame) -> DataFrame:
    """The distinct prices a log touches."""
    return deltas.select("session_id", "price").unionByName(opening.select("session_id", "price")).distinct()


def depth_matrix(deltas: DataFrame, rows: DataFrame, prices: list[int]) -> DataFrame:
    """(session_id, seq, price, signed_size) in long form: the last signed size at each wanted price."""
    wanted = rows.select("session_id", "seq", F.explode(F.array(*(F.lit(p).cast("long") for p in prices))).alias("price"))
    marks = deltas.where(F.col("price").isin(prices)).select("session_id", "seq", "price", (F.col("side") * F.col("resting")).alias("x"), F.lit(0).alias("k"))
    both = marks.unionByName(wanted.select("session_id", "seq", "price", F.lit(None).cast("long").alias("x"), F.lit(1).alias("k")))
    w = Window.partitionBy("session_id", "price").orderBy("seq", "k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("signed_size", F.coalesce(F.last("x", ignorenulls=True).over(w), F.lit(0).cast("long"))).where("k = 1").select("session_id", "seq", "price", "signed_size")
