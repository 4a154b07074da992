"""The data behind the usual drawings, as frames; drawing itself is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions import levels as lv
from tapeworks.operators.hawkes import exponential_ranks


def book_snapshots(book: DataFrame, seqs: list[int]) -> DataFrame:
    """(session_id, seq, side, price, size) of chosen states."""
    rows = book.where(F.col("seq").isin(seqs))
    both = F.concat(F.transform("asks", lambda x: F.struct(F.lit("ask").alias("side"), x["price"].alias("price"), x["size"].alias("size"))), F.transform("bids", lambda x: F.struct(F.lit("bid").alias("side"), x["price"].alias("price"), x["size"].alias("size"))))
    return rows.select("session_id", "seq", F.explode(both).alias("x")).select("session_id", "seq", "x.*")


def depth_profile(book: DataFrame) -> DataFrame:
    """Cumulative size by ticks from the touch, averaged over a session's states."""
    rows = []
    for name in ("asks", "bids"):
        touch = lv.best(F.col(name))["price"]
        off = F.explode(F.transform(name, lambda x: F.struct(F.abs(x["price"] - touch).alias("ticks"), x["size"].alias("size"))))  # noqa: B023
        rows.append(book.select("session_id", "seq", F.lit(name).alias("side"), off.alias("x")).select("session_id", "seq", "side", "x.*"))
    per = rows[0].unionByName(rows[1]).groupBy("session_id", "side", "ticks").agg(F.sum("size").alias("size"))
    total = Window.partitionBy("session_id", "side").orderBy("ticks").rowsBetween(Window.unboundedPreceding, 0)
    states = book.groupBy("session_id").agg(F.count("*").alias("states"))
    return per.withColumn("sum", F.sum("size").over(total)).join(states, "session_id").select("session_id", "side", "ticks", (F.col("sum") / F.col("states")).alias("mean_depth"))


def coverage(stats: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """(session_id, n, uncovered): the share of states that do not determine each imbalance."""
    got = stats.groupBy("session_id").agg(*((1 - F.avg(f"QueueImbalance{n}Covered")).alias(f"c{n}") for n in levels))
    return got.select("session_id", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"c{n}").alias("uncovered")) for n in levels))).alias("x")).select("session_id", "x.*")


def counting(paths: DataFrame) -> DataFrame:
    """(path_id, type, t, count): the steps of the counting processes."""
    w = Window.partitionBy("path_id", "type").orderBy("n")
    return paths.select("path_id", "type", "t", F.row_number().over(w).alias("count"))


def exponential_qq(residuals: DataFrame, by: list[str]) -> DataFrame:
    """(by, theoretical, observed): quantiles of residuals against the unit exponential law."""
    ranked = exponential_ranks(residuals, "residual", by)
    return ranked.select(*by, (-F.ln(1 - (F.col("rank") - F.lit(0.5)) / F.col("n"))).alias("theoretical"), F.col("value").alias("observed"))


def size_bins(df: DataFrame, value: str, edges: list[float], by: list[str]) -> DataFrame:
    """Counts in right-closed bins, and outside them as NULL."""
    bin_ = F.coalesce(*(F.when((F.col(value) > a) & (F.col(value) <= b), F.lit(f"({a}, {b}]")) for a, b in zip(edges, edges[1:])))
    return df.groupBy(*by, bin_.alias("bin")).count()
