"""Queries of goodness of fit and tables by group: laws, sequences and tests of many groups (HWK14, HWK15, REG09, AGG24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.functions import levels as lv
from tapeworks.operators import distributions as ds
from tapeworks.operators import hawkes as hk
from tapeworks.operators import windows as win
from tapeworks.plans.models import _COMP, _MODEL5, BETA, W24
from tapeworks.plans.registry import query
from tapeworks.plans.statistics import FLOW, sides
from tapeworks.sources.shared import shared_path
from tapeworks.sources.tape import HOUR_NS, book, paths, sql, tape

CLOCK = [24.0 * k for k in range(31)]


def residuals(spark, sf_dir):
    """Rescaled waiting times under a model, rounded so that ties are ties in any engine. Written once, for laws and
    sequences pass over them several times and a replay costs more than they do."""
    got = hk.residuals(hk.replay(paths(spark, sf_dir), BETA, 5, _MODEL5)).select("path_id", "type", "n", F.round("residual", 9).alias("residual"))
    path = shared_path(spark, "residuals")
    got.write.parquet(path)
    return spark.read.schema(got.schema).parquet(path)


_ROUNDED = _COMP + ", rr AS (SELECT path_id, type, n, round(r, 9) AS r FROM rs)"


@query(
    "HWK15_two_sample_ks",
    sql(
        "SELECT g AS part, CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m, round(max(abs(fa / n - fb / m)), 9) AS ks FROM (SELECT path_id % 4 AS g, sum(CASE WHEN type = 0 THEN 1.0 ELSE 0 END) OVER w AS fa, sum(CASE WHEN type = 1 THEN 1.0 ELSE 0 END) OVER w AS fb, CAST(count(*) FILTER (WHERE type = 0) OVER (PARTITION BY path_id % 4) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE type = 1) OVER (PARTITION BY path_id % 4) AS DOUBLE) AS m FROM rr WHERE type IN (0, 1) WINDOW w AS (PARTITION BY path_id % 4 ORDER BY r RANGE UNBOUNDED PRECEDING)) GROUP BY g",
        "paths",
        more=_ROUNDED,
    ),
)
def two_sample_ks(spark, sf_dir):
    """Whether the residuals of two types are of one law, for four parts of the paths."""
    rows = residuals(spark, sf_dir).where("type in (0, 1)").withColumn("part", F.col("path_id") % 4)
    return ds.two_sample_ks(rows, "residual", ["part"], F.col("type") == 0).select("part", "n", "m", F.round("ks", 9).alias("ks"))


_LAGS = 4


@query(
    "HWK15_ljung_box",
    sql(
        "SELECT path_id, type, CAST(count(*) AS BIGINT) AS n, "
        + ", ".join(f"round(sum(c * l{k}) / sum(c * c), 6) AS r{k}" for k in range(1, _LAGS + 1))
        + ", round(count(*) * (count(*) + 2) * ("
        + " + ".join(f"power(sum(c * l{k}) / sum(c * c), 2) / (count(*) - {k})" for k in range(1, _LAGS + 1))
        + "), 5) AS statistic FROM (SELECT *, "
        + ", ".join(f"lead(c, {k}) OVER w AS l{k}" for k in range(1, _LAGS + 1))
        + f" FROM (SELECT path_id, type, n, r - avg(r) OVER (PARTITION BY path_id, type) AS c FROM rr) WINDOW w AS (PARTITION BY path_id, type ORDER BY n)) GROUP BY path_id, type HAVING count(*) > {_LAGS}",
        "paths",
        more=_ROUNDED,
    ),
)
def ljung_box(spark, sf_dir):
    """Autocorrelations of every path's residuals of a type, and whether they are jointly zero."""
    got = ds.ljung_box(ds.autocorrelations(residuals(spark, sf_dir), "residual", ["path_id", "type"], "n", _LAGS), _LAGS).where(F.col("n") > _LAGS)
    return got.select("path_id", "type", "n", *(F.round(F.get("r", F.lit(k - 1)), 6).alias(f"r{k}") for k in range(1, _LAGS + 1)), F.round("statistic", 5).alias("statistic"))


_CLOCK = f"""ck AS (SELECT g.path_id, g.tau, g.k, count(p.n) FILTER (WHERE p.type = g.k) AS n, 0.01 * g.tau + 0.008 / {BETA} * (count(p.n) - coalesce(sum(exp(-{BETA} * (g.tau - p.t))), 0)) AS c
    FROM (SELECT DISTINCT path_id, CAST(24 * i AS DOUBLE) AS tau, CAST(k AS INTEGER) AS k FROM paths, range(31) r(i), range(5) s(k)) g LEFT JOIN paths p ON p.path_id = g.path_id AND p.t <= g.tau GROUP BY g.path_id, g.tau, g.k),
    inc AS (SELECT path_id, tau, k, n - lag(n) OVER w AS dn, n - c - lag(n - c) OVER w AS dm FROM ck WINDOW w AS (PARTITION BY path_id, k ORDER BY tau))"""


@query("HWK14_compensators_on_a_clock", sql("SELECT path_id, tau AS t, k AS type, CAST(n AS BIGINT) AS n, round(c, 6) AS compensator FROM ck", "paths", more=_CLOCK))
def on_clock(spark, sf_dir):
    """Counts and compensators of every type at every day's end."""
    return hk.compensators_on_clock(paths(spark, sf_dir), _MODEL5, CLOCK).select("path_id", "t", "type", "n", F.round("compensator", 6).alias("compensator"))


def _correlation_sql() -> str:
    return f"SELECT a.k AS first, b.k AS second, CAST(count(*) AS BIGINT) AS windows, round(sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 6) AS correlation, round(sqrt(sum(a.x * b.x * a.x * b.x)) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 6) AS error FROM cx a JOIN cx b ON a.path_id = b.path_id AND a.tau = b.tau AND a.k < b.k GROUP BY a.k, b.k"


def _centred(value: str) -> str:
    return _CLOCK + f", cx AS (SELECT path_id, tau, k, {value} - avg({value}) OVER (PARTITION BY k) AS x FROM inc WHERE dm IS NOT NULL)"


@query("HWK15_increment_correlations", sql(_correlation_sql(), "paths", more=_centred("dm")))
def increments(spark, sf_dir):
    """Correlations between types of what their counts exceed their compensators by, day by day, with errors."""
    got = hk.increment_correlations(hk.martingale_increments(hk.compensators_on_clock(paths(spark, sf_dir), _MODEL5, CLOCK)), 5)
    return got.select("first", "second", "windows", F.round("correlation", 6).alias("correlation"), F.round("error", 6).alias("error"))


@query("AGG18_count_correlations", sql(_correlation_sql(), "paths", more=_centred("dn")))
def counted(spark, sf_dir):
    """The same of the counts themselves."""
    got = hk.increment_correlations(hk.martingale_increments(hk.compensators_on_clock(paths(spark, sf_dir), _MODEL5, CLOCK)), 5, "counted")
    return got.select("first", "second", "windows", F.round("correlation", 6).alias("correlation"), F.round("error", 6).alias("error"))


_HOURS = (6, 24, 72)


def gains(spark, sf_dir):
    """(predictor, horizon_h, gain): the forward mid change in the direction that a predictor's sign foretells."""
    rows = book(spark, sf_dir).select("session_id", "seq", "ts_ns", win.order_flow_contribution().alias("flow"), lv.queue_imbalance(*sides(), 1).alias("touch"), lv.mid_price(*sides()).alias("value"))
    rows = rows.withColumn("segment", win.segments(F.col("value").isNull()))
    rows = rows.withColumns({"day": win.backward_sum(F.col("flow"), W24)} | {f"y{h}": win.forward_change(h * HOUR_NS) for h in _HOURS})
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("predictor"), F.lit(h).alias("horizon_h"), (F.signum(F.col(c).cast("double")) * F.col(f"y{h}")).alias("gain")) for n, c in (("flow of a day", "day"), ("touch", "touch")) for h in _HOURS)))
    return rows.select(each.alias("x")).select("x.*").where("gain is not null")


_GAINS = FLOW + ", " + ", ".join(
    f"y{h} AS (SELECT session_id, seq, CASE WHEN q > seq AND fseg = segment THEN fmid - mid END AS y FROM (SELECT a.session_id, a.seq, a.mid, a.segment, max(b.seq) AS q, arg_max_null(b.mid, b.seq) AS fmid, arg_max(b.segment, b.seq) AS fseg FROM sg a JOIN sg b ON b.session_id = a.session_id AND b.ts_ns <= a.ts_ns + {h * HOUR_NS} GROUP BY ALL))"
    for h in _HOURS
) + f""", dy AS (SELECT a.session_id, a.seq, CASE WHEN count(*) = count(b.flow) THEN sum(b.flow) END AS x FROM fw a JOIN fw b ON b.session_id = a.session_id AND b.ts_ns > a.ts_ns - {W24} AND b.ts_ns <= a.ts_ns AND b.seq <= a.seq GROUP BY ALL),
    pr AS (SELECT session_id, seq, 'flow of a day' AS predictor, CAST(x AS DOUBLE) AS x FROM dy UNION ALL SELECT session_id, seq, 'touch', CAST(coalesce(bs1, 0) - coalesce(as1, 0) AS DOUBLE) / nullif(coalesce(bs1, 0) + coalesce(as1, 0), 0) FROM bk),
    ga AS ({" UNION ALL ".join(f"SELECT predictor, {h} AS horizon_h, sign(x) * y AS gain FROM pr JOIN y{h} USING (session_id, seq) WHERE x IS NOT NULL AND y IS NOT NULL" for h in _HOURS)}),
    tt AS (SELECT predictor, horizon_h, count(*) AS n, avg(gain) AS mean, avg(gain) * sqrt(count(*)) / stddev_samp(gain) AS t FROM ga GROUP BY ALL),
    qp AS (SELECT predictor, horizon_h, n, mean, t, 1 - 2 * abs(t) / 4000 / 3 * exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) / sqrt((n - 1) * pi()) * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * power(1 + power(abs(t) * i / 4000, 2) / (n - 1), -n / 2.0)) AS p FROM tt, range(4001) r(i) GROUP BY predictor, horizon_h, n, mean, t)"""


@query("REG09_t_tests", sql("SELECT predictor, horizon_h, CAST(n AS BIGINT) AS n, round(mean, 9) AS mean, round(t, 6) AS t, round(p, 6) AS p, round(max(a) OVER (PARTITION BY predictor ORDER BY p, horizon_h ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM (SELECT *, least(1.0, (count(*) OVER (PARTITION BY predictor) + 1 - row_number() OVER (PARTITION BY predictor ORDER BY p, horizon_h)) * p) AS a FROM qp)", "bk", more=_GAINS))
def t_tests(spark, sf_dir):
    """Whether two predictors foretell the mid at three horizons: Student's test each, adjusted over a predictor's horizons."""
    got = ds.holm(ds.t_tests(gains(spark, sf_dir), "gain", ["predictor", "horizon_h"]), "p", ["predictor"], ["horizon_h"])
    return got.select("predictor", "horizon_h", "n", *(F.round(c, k).alias(c) for c, k in (("mean", 9), ("t", 6), ("p", 6), ("adjusted", 6))))


@query(
    "AGG24_quantile_bins",
    sql(
        "SELECT session_id, CAST(len(list_filter(edges, lambda x: x < size)) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS sd, min(price) AS least, max(price) AS greatest FROM tape JOIN (SELECT session_id, list_distinct(quantile_cont(size, [0.25, 0.5, 0.75])) AS edges FROM tape GROUP BY session_id) USING (session_id) GROUP BY 1, 2",
        "tape",
    ),
)
def quantile_bins(spark, sf_dir):
    """Prices by quarters of each session's sizes."""
    got = ds.described(ds.quantile_bins(tape(spark, sf_dir), "size", ["session_id"], 4), "price", ["session_id", "bin"])
    return got.select("session_id", "bin", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "least", "greatest")


@query("AGG24_pivoted", sql("SELECT session_id, " + ", ".join(f"round(avg(size) FILTER (WHERE type = {k}), 6) AS type_{k}" for k in range(1, 6)) + " FROM tape GROUP BY session_id", "tape"))
def pivoted(spark, sf_dir):
    """Mean sizes, a row a session and a column a type."""
    got = tape(spark, sf_dir).groupBy("session_id").pivot("type", [1, 2, 3, 4, 5]).agg(F.avg("size"))
    return got.select("session_id", *(F.round(str(k), 6).alias(f"type_{k}") for k in range(1, 6)))
