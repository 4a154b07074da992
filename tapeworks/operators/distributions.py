"""Empirical laws of many groups at once: distribution functions, quantiles and tests between samples.

Equal values are counted before anything moves. What is left is ranked in ranges of values after the totals of the ranges
before, group by group, so that neither a group that holds most rows nor a value that repeats gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.special import chi_square_tail, kolmogorov_tail, student_two_sided

#: How many ranges of values are ranked side by side, and how many rows of a sequence are taken together.
RANGES, STRETCH = 64, 1 << 16


def cells(df: DataFrame, value: str, by: list[str], counts: dict[str, Column]) -> DataFrame:
    """(by, value, counts): one row for every distinct value of a group with how many of its rows meet each condition.

    NULL and NaN have no place in a law and are left out.
    """
    v = F.col(value).cast("double")
    kept = df.select(*by, v.alias("value"), *(c.alias(n) for n, c in counts.items())).where("value is not null and not isnan(value)")
    return kept.groupBy(*by, "value").agg(*(F.count_if(n).alias(n) for n in counts))


def cumulative(counted: DataFrame, by: list[str], counts: list[str], ranges: int = RANGES) -> DataFrame:
    """Adds, for each count, `upto_` (its sum over the group's values up to this one) and `all_` (over all of them).

    The edges of the ranges are rough quantiles of all values, `ranges` - 1 numbers that reach the driver.
    """
    shares = ", ".join(str(k / ranges) for k in range(1, ranges))
    edges = sorted(set(counted.agg(F.expr(f"approx_percentile(value, array({shares}))")).first()[0] or []))
    at = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e < F.col("value"))) if edges else F.lit(0)
    ranged = counted.withColumn("_range", at)
    totals = ranged.groupBy(*by, "_range").agg(*(F.sum(c).alias(c) for c in counts))
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in counts), *(F.sum(c).over(group).alias(f"all_{c}") for c in counts))
    inner = Window.partitionBy(*by, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.select("*", *(F.sum(c).over(inner).alias(f"_own_{c}") for c in counts))
    # Groups may be NULL, so they are matched null-safe.
    a, b = own.alias("a"), totals.alias("b")
    same = F.col("a._range") == F.col("b._range")
    for c in by:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same).select(*(F.col(f"a.{c}") for c in (*by, "value", *counts)), *((F.col(f"_before_{c}") + F.col(f"_own_{c}")).alias(f"upto_{c}") for c in counts), *(F.col(f"all_{c}") for c in counts))


def two_sample_ks(df: DataFrame, value: str, by: list[str], first: Column, ranges: int = RANGES) -> DataFrame:
    """(by, n, m, ks, p): the greatest distance between the laws of a group's rows with `first` and those without.

    Ties within and between the samples are one step of both laws. Rows for which `first` is NULL belong to neither. A
    group without one of the samples has no distance. p is that of the limit law.
    """
    counted = cells(df, value, by, {"a": first, "b": ~first}).where("a + b > 0")
    law = cumulative(counted, by, ["a", "b"], ranges)
    gap = F.abs(F.try_divide(F.col("upto_a"), F.col("all_a")) - F.try_divide(F.col("upto_b"), F.col("all_b")))
    got = law.groupBy(*by).agg(F.max("all_a").alias("n"), F.max("all_b").alias("m"), F.max(gap).alias("ks"))
    return got.withColumn("p", kolmogorov_tail(F.col("ks") * F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))))


def group_quantiles(df: DataFrame, value: str, by: list[str], shares: list[float], ranges: int = RANGES) -> DataFrame:
    """(by, share, quantile): exact quantiles of every group, linear between neighbouring ranks."""
    law = cumulative(cells(df, value, by, {"n": F.lit(True)}), by, ["n"], ranges)
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share"), (F.lit(float(s)) * (F.col("all_n") - 1)).alias("place")) for i, s in enumerate(shares)))
    covers = lambda r: (r < F.col("upto_n")) & (r >= F.col("upto_n") - F.col("n"))
    mine = F.filter(wanted, lambda w: covers(F.floor(w["place"])) | covers(F.ceil(w["place"])))
    met = law.select(*by, "value", "n", "upto_n", F.explode(mine).alias("w")).select(*by, "value", "n", "upto_n", "w.*")
    pick = lambda f: F.max(F.when(covers(f("place")), F.col("value")))
    ends = met.groupBy(*by, "i", "share").agg(F.max("place").alias("place"), pick(F.floor).alias("low"), pick(F.ceil).alias("high"))
    part = F.col("place") - F.floor("place")
    return ends.select(*by, "share", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - part) * F.col("low") + part * F.col("high")).alias("quantile"))


def medians(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    return group_quantiles(df, value, by, [0.5]).select(*by, F.col("quantile").alias(name))


def quantile_bins(df: DataFrame, value: str, by: list[str], bins: int, ranges: int = RANGES) -> DataFrame:
    """Adds `bin` (from 0): which of its group's quantile bins a row's value lies in, each closed on the right and the
    first on both sides; equal edges are one. NULL where the value is."""
    edges = group_quantiles(df, value, by, [k / bins for k in range(1, bins)], ranges)
    per = edges.groupBy(*by).agg(F.sort_array(F.collect_set("quantile")).alias("_edges"))  # bins - 1 at most
    a, b = df.alias("a"), per.alias("b")
    same = F.lit(True)
    for c in by:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    over = F.size(F.filter("_edges", lambda e: e < F.col(f"a.{value}")))
    return a.join(F.broadcast(b) if not by else b, same, "left").select("a.*", F.when(F.col(f"a.{value}").isNotNull() & ~F.isnan(F.col(f"a.{value}").cast("double")), over).alias("bin"))


def described(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, mean, sd, least, greatest, largest): what a table by group says of a column; sd with n - 1."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.max(F.abs(v)).alias("largest"))


def numbered(df: DataFrame, by: list[str], order: str, stretch: int = STRETCH) -> DataFrame:
    """Adds `_i`, the row's place in its group from 0 by the whole-number column `order`, and `_stretch`.

    Rows are numbered within stretches of the order, after the rows of the stretches before, so a long group is many tasks.
    """
    cut = df.withColumn("_stretch", F.floor(F.col(order) / stretch))
    sizes = cut.groupBy(*by, "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = cut.withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_stretch").orderBy(order)))
    return own.join(sizes, [*by, "_stretch"]).withColumn("_i", F.col("_before") + F.col("_own") - 1).drop("_before", "_own")


def autocorrelations(df: DataFrame, value: str, by: list[str], order: str, lags: int, stretch: int = STRETCH) -> DataFrame:
    """(by, n, r): the size of every group and the array of its autocorrelations at lags 1 to `lags`.

    A group's rows are its series in the order of a whole-number column. Stretches of a series are multiplied side by side;
    the first `lags` rows of each are seen by the one before too, so no product is lost at an edge. A lag with no pair,
    and every lag of a constant series, is NULL.
    """
    rows = numbered(df.select(*by, order, F.col(value).cast("double").alias("_x")).where("_x is not null"), by, order, stretch)
    means = rows.groupBy(*by).agg(F.avg("_x").alias("_mean"), F.count("*").alias("n"))
    at = F.floor(F.col("_i") / stretch)
    # The mean goes with the stretches, of which there are few, and not with the rows of a group.
    parts = rows.select(*by, at.alias("_part")).distinct().join(means, by)
    seen = F.array_compact(F.array(at, F.when((F.col("_i") % stretch < lags) & (at > 0), at - 1)))
    placed = rows.select(*by, "_i", "_x", at.alias("_own"), F.explode(seen).alias("_part")).join(parts, [*by, "_part"])
    placed = placed.withColumn("_c", F.col("_x") - F.col("_mean"))
    w = Window.partitionBy(*by, "_part").orderBy("_i")
    placed = placed.select(*by, "n", "_own", "_part", "_c", *(F.lead("_c", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)))
    base = placed.where("_own = _part")
    sums = base.groupBy(*by, "n").agg(F.sum(F.col("_c") * F.col("_c")).alias("_v"), *(F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lags + 1)))
    return sums.select(*by, "n", F.array(*(F.try_divide(F.col(f"_s{k}"), F.col("_v")) for k in range(1, lags + 1))).alias("r"))


def ljung_box(correlations: DataFrame, lags: int) -> DataFrame:
    """Adds `statistic`, n (n + 2) times the sum of r_k^2 / (n - k), and its p against chi-square; NULL where a lag is."""
    n = F.col("n")
    total = sum((F.get("r", F.lit(k - 1)) ** 2 / F.when(n > k, n - k) for k in range(1, lags + 1)), F.lit(0.0))
    return correlations.withColumn("statistic", n * (n + 2) * total).withColumn("p", chi_square_tail(F.col("statistic"), lags))


def t_tests(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, mean, t, p): whether a group's mean is zero, by Student's two-sided test; NULL for fewer than two rows or
    rows all alike."""
    got = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"))
    t = F.when(F.col("n") > 1, F.try_divide(F.col("mean") * F.sqrt("n"), F.col("_sd")))
    return got.withColumn("t", t).withColumn("p", student_two_sided(F.col("t"), F.col("n") - 1)).drop("_sd")


def holm(df: DataFrame, p: str, by: list[str], order: list[str]) -> DataFrame:
    """Adds `adjusted`: Holm's step-down values of the tests of a family (`by`); rows without p are no part of it."""
    family, ranked = [*by, F.col(p).isNull()], [p, *order]
    m, k = F.count(p).over(Window.partitionBy(*family)), F.row_number().over(Window.partitionBy(*family).orderBy(*ranked))
    step = df.withColumn("_step", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), (m - k + 1) * F.col(p))))
    upto = Window.partitionBy(*family).orderBy(*ranked).rowsBetween(Window.unboundedPreceding, 0)
    return step.withColumn("adjusted", F.max("_step").over(upto)).drop("_step")


def group_information(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, rows, plug_in, miller_madow): how much two discrete columns tell of each other in every group, in nats."""
    joint = df.groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").cast("double").alias("_n"))
    part = lambda *c: F.sum("_n").over(Window.partitionBy(*by, *c))
    rows = joint.withColumns({"_nx": part("_x"), "_ny": part("_y"), "_t": part()})
    term = F.col("_n") / F.col("_t") * F.ln(F.col("_n") * F.col("_t") / (F.col("_nx") * F.col("_ny")))
    got = rows.groupBy(*by).agg(F.sum(term).alias("plug_in"), F.count("*").alias("_cells"), F.count_distinct("_x").alias("_bx"), F.count_distinct("_y").alias("_by"), F.max("_t").cast("long").alias("rows"))
    return got.select(*by, "rows", "plug_in", (F.col("plug_in") - (F.col("_cells") - F.col("_bx") - F.col("_by") + 1) / (2 * F.col("rows"))).alias("miller_madow"))
