"""Queries of estimation, point processes, order flow and streaming (EST, REG, HWK, SIM, CPL, FLD, STR)."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from tapeworks.functions import levels as lv
from tapeworks.operators import distributions as ds
from tapeworks.operators import estimation as est
from tapeworks.operators import flow as fl
from tapeworks.operators import fold
from tapeworks.operators import hawkes as hk
from tapeworks.operators import windows as win
from tapeworks.operators.matching import STORAGES
from tapeworks.operators.session import statistics_frame
from tapeworks.plans.registry import query
from tapeworks.plans.statistics import FLOW, FRAME, FRAME_CTES, FRAME_SQL, TRUNCATED, sides
from tapeworks.plans.windows import _AHEAD, flow_rows, mid_series
from tapeworks.schema import BUY, SELL
from tapeworks.sources import parameters as par
from tapeworks.sources.tape import DEPTH, HOUR_NS, book, paths, sql, tape

KEYS = ["session_id", "seq"]
W24 = 24 * HOUR_NS
ORDER = ["ts_ns", "seq"]


def study(spark, sf_dir):
    """(session_id, seq, ts_ns, x, depth, y, class): order flow imbalance against the forward mid change."""
    rows = book(spark, sf_dir).select(*KEYS, "ts_ns", win.order_flow_contribution().cast("double").alias("flow"), lv.touch_depth(*sides()).cast("double").alias("depth"), lv.mid_price(*sides()).alias("value"))
    rows = rows.withColumn("segment", win.segments(F.col("value").isNull()))
    rows = rows.withColumns({"x": win.backward_sum(F.col("flow"), W24), "y": win.forward_change(W24)})
    return rows.dropna(subset=["x", "y", "depth"]).select(*KEYS, "ts_ns", "x", "depth", "y", est.outcome_class(F.col("y")).alias("class"))


STUDY = (
    FLOW
    + ", "
    + _AHEAD
    + f""", ofi AS (SELECT a.session_id, a.seq, CASE WHEN count(*) = count(b.flow) THEN sum(b.flow) END AS x FROM fw a JOIN fw b ON b.session_id = a.session_id AND b.ts_ns > a.ts_ns - {W24} AND b.ts_ns <= a.ts_ns AND b.seq <= a.seq GROUP BY ALL),
    st AS (SELECT w.session_id, w.seq, w.ts_ns, CAST(o.x AS DOUBLE) AS x, CAST(w.depth AS DOUBLE) AS depth, f.fmid - f.mid AS y, CAST(sign(f.fmid - f.mid) + 1 AS INTEGER) AS class FROM fw w JOIN ofi o USING (session_id, seq) JOIN fa f USING (session_id, seq) WHERE o.x IS NOT NULL AND w.depth IS NOT NULL AND f.q > f.seq AND f.fseg = f.segment AND f.fmid IS NOT NULL AND f.mid IS NOT NULL)"""
)


def one_row(spark, **values):
    return spark.createDataFrame([tuple(float(v) if v is not None else None for v in values.values())], ", ".join(f"{k} double" for k in values))


@query("REG01_aligned_series", sql("SELECT session_id, seq, mid AS value, segment FROM sg", "bk", more=FLOW))
def reg01(spark, sf_dir):
    return mid_series(spark, sf_dir).select(*KEYS, "value", "segment")


@query("REG02_predictors", sql("SELECT session_id, seq, x, depth, y FROM st", "bk", more=STUDY))
def reg02(spark, sf_dir):
    return study(spark, sf_dir).select(*KEYS, "x", "depth", "y")


@query("REG03_outcome_classes", sql("SELECT class, CAST(count(*) AS BIGINT) AS rows FROM st GROUP BY class", "bk", more=STUDY))
def reg03(spark, sf_dir):
    return study(spark, sf_dir).groupBy("class").agg(F.count("*").alias("rows"))


@query("REG04_signed_covariance", sql("SELECT round(covar_pop(sign(x), y), 9) AS signed_covariance FROM st", "bk", more=STUDY))
def reg04(spark, sf_dir):
    return study(spark, sf_dir).agg(F.round(est.signed_covariance(F.col("x"), F.col("y")), 9).alias("signed_covariance"))


@query("REG05_sign_accuracy", sql("SELECT round(avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END) FILTER (WHERE x <> 0 AND y <> 0), 9) AS accuracy, round(avg(CASE WHEN x <> 0 AND y <> 0 THEN 1.0 ELSE 0.0 END), 9) AS coverage, round(greatest(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE x <> 0 AND y <> 0), 1 - avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE x <> 0 AND y <> 0)), 9) AS base_rate FROM st", "bk", more=STUDY))
def reg05(spark, sf_dir):
    return study(spark, sf_dir).agg(*(F.round(c, 9).alias(n) for n, c in est.sign_accuracy(F.col("x"), F.col("y")).items()))


def _fit(spark, sf_dir):
    rows = study(spark, sf_dir).withColumn("one", F.lit(1.0)).persist()
    return rows, est.ols(rows, ["one", "x", "depth"], "y")


def _normal(names: list[str]) -> str:
    """Normal equations of a fit of y on centred columns, their inverse as V, residuals and scores, in CTEs."""
    x, z = names
    return f"""ce AS (SELECT *, {x} - (SELECT avg({x}) FROM st) AS a, {z} - (SELECT avg({z}) FROM st) AS b, y - (SELECT avg(y) FROM st) AS c FROM st),
    sm AS (SELECT count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * c) AS ac, sum(b * c) AS bc, sum(c * c) AS cc FROM ce),
    iv AS (SELECT *, bb / (aa * bb - ab * ab) AS v11, -ab / (aa * bb - ab * ab) AS v12, aa / (aa * bb - ab * ab) AS v22 FROM sm),
    sl AS (SELECT *, v11 * ac + v12 * bc AS b1, v12 * ac + v22 * bc AS b2 FROM iv),
    sc AS (SELECT session_id, ts_ns, seq, c - b1 * a - b2 * b AS e, a * (c - b1 * a - b2 * b) AS s1, b * (c - b1 * a - b2 * b) AS s2, row_number() OVER (PARTITION BY session_id ORDER BY ts_ns, seq) AS r FROM ce, sl),
    hc AS (SELECT sum(w * p.s1 * q.s1) AS h11, sum(w * (p.s1 * q.s2 + p.s2 * q.s1) / 2) AS h12, sum(w * p.s2 * q.s2) AS h22 FROM sc p JOIN sc q ON q.session_id = p.session_id AND q.r BETWEEN p.r - 10 AND p.r + 10, LATERAL (SELECT 1 - abs(p.r - q.r) / 11.0 AS w)),
    hv AS (SELECT *, v11 * v11 * h11 + 2 * v11 * v12 * h12 + v12 * v12 * h22 AS o11, v11 * v12 * h11 + (v11 * v22 + v12 * v12) * h12 + v12 * v22 * h22 AS o12, v12 * v12 * h11 + 2 * v12 * v22 * h12 + v22 * v22 * h22 AS o22, (SELECT sum(e * e) FROM sc) AS ss FROM sl, hc)"""


@query("REG06_nested_fit", sql("SELECT round(b1, 9) AS slope_x, round(b2, 9) AS slope_depth, round((o22 * b1 * b1 - 2 * o12 * b1 * b2 + o11 * b2 * b2) / (o11 * o22 - o12 * o12) / 2, 5) AS joint_f, round(1 - ss / cc, 9) AS r_squared, round(n * ss / (n - 3) * v11 / o11, 5) AS effective_sample FROM hv", "bk", more=STUDY + ", " + _normal(["x", "depth"])))
def reg06(spark, sf_dir):
    """Both slopes, the joint F of the block on HAC variances, and the effective sample."""
    rows, fit = _fit(spark, sf_dir)
    hac = est.hac_variance(rows, fit, "y", 10, ORDER, ["session_id"])
    out = one_row(spark, slope_x=round(fit.coefficients[1], 9), slope_depth=round(fit.coefficients[2], 9), joint_f=round(est.joint_f(fit, hac, [1, 2]), 5), r_squared=round(fit.r_squared, 9), effective_sample=round(est.effective_sample(fit, hac, 1), 5))
    rows.unpersist()
    return out


@query("REG07_tuned_window", sql("SELECT h AS window_h, round(abs(covar_pop(sign(s), p)), 9) AS criterion FROM (SELECT a.session_id, a.seq, v.h, CASE WHEN count(*) = count(b.flow) THEN sum(b.flow) END AS s FROM fw a CROSS JOIN (VALUES (2), (6), (24)) v(h) JOIN fw b ON b.session_id = a.session_id AND b.ts_ns > a.ts_ns - v.h * 3600000000000 AND b.ts_ns <= a.ts_ns AND b.seq <= a.seq GROUP BY ALL) k JOIN (SELECT session_id, seq, y AS p FROM st) USING (session_id, seq) GROUP BY h", "bk", more=STUDY))
def reg07(spark, sf_dir):
    hours = (2, 6, 24)
    rows = book(spark, sf_dir).select(*KEYS, "ts_ns", win.order_flow_contribution().cast("double").alias("flow"), lv.touch_depth(*sides()).alias("depth"), lv.mid_price(*sides()).alias("value"))
    rows = rows.withColumn("segment", win.segments(F.col("value").isNull())).withColumns({f"s{h}": win.backward_sum(F.col("flow"), h * HOUR_NS) for h in hours} | {"y": win.forward_change(W24)})
    curve, _ = est.tune_window(rows.dropna(subset=["y", "depth"]), {h: f"s{h}" for h in hours}, lambda c: F.abs(est.signed_covariance(c, F.col("y"))))
    return spark.createDataFrame([(h, round(v, 9)) for h, v in curve.items()], "window_h int, criterion double")


@query("REG09_holm", sql("SELECT type, round(max(a) OVER (ORDER BY p, type ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM (SELECT *, least(1.0, (5 + 1 - row_number() OVER (ORDER BY p, type)) * p) AS a FROM (SELECT type, 1.0 / (2 + count(*)) AS p FROM tape GROUP BY type))", "tape"))
def reg09(spark, sf_dir):
    """The step-down rule on one family of values; tests with p of their own are in REG09_t_tests."""
    p = tape(spark, sf_dir).groupBy("type").agg((1 / (2 + F.count("*"))).alias("p"))
    return ds.holm(p, "p", [], ["type"]).select("type", F.round("adjusted", 9).alias("adjusted"))


@query("REG10_against_the_horizon", sql("SELECT k AS lag, round(regr_slope(later, price), 9) AS slope, round(regr_r2(later, price), 9) AS share FROM (SELECT 1 AS k, price, lead(price, 1) OVER o AS later FROM tape WINDOW o AS (PARTITION BY session_id ORDER BY ts_ns, seq) UNION ALL SELECT 5, price, lead(price, 5) OVER o FROM tape WINDOW o AS (PARTITION BY session_id ORDER BY ts_ns, seq)) WHERE later IS NOT NULL GROUP BY k", "tape"))
def reg10(spark, sf_dir):
    rows = tape(spark, sf_dir).select("price", *(F.lead("price", k).over(win.by_row()).alias(f"l{k}") for k in (1, 5)))
    rows = rows.select("price", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"l{k}").alias("later")) for k in (1, 5)))).alias("x"))
    return rows.select("price", "x.*").where("later is not null").groupBy("lag").agg(F.round(F.regr_slope("later", "price"), 9).alias("slope"), F.round(F.regr_r2("later", "price"), 9).alias("share"))


@query("EST01_ols", sql("SELECT round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 9) AS intercept, round(regr_r2(y, x), 9) AS r_squared FROM st", "bk", more=STUDY))
def est01(spark, sf_dir):
    fit = est.ols(study(spark, sf_dir).withColumn("one", F.lit(1.0)), ["one", "x"], "y")
    return one_row(spark, slope=round(fit.coefficients[1], 9), intercept=round(fit.coefficients[0], 9), r_squared=round(fit.r_squared, 9))


@query(
    "EST02_hac_variance",
    sql(
        "SELECT round((c0 + 2 * (0.75 * c1 + 0.5 * c2 + 0.25 * c3)) / (sxx * sxx), 12) AS variance FROM (SELECT sum(s * s) AS c0, sum(s * l1) AS c1, sum(s * l2) AS c2, sum(s * l3) AS c3, sum(x * x) AS sxx FROM (SELECT x, s, lag(s, 1) OVER o AS l1, lag(s, 2) OVER o AS l2, lag(s, 3) OVER o AS l3 FROM (SELECT *, x * (y - x * (SELECT sum(x * y) / sum(x * x) FROM st)) AS s FROM st) WINDOW o AS (PARTITION BY session_id ORDER BY ts_ns, seq)))",
        "bk",
        more=STUDY,
    ),
)
def est02(spark, sf_dir):
    rows = study(spark, sf_dir)
    fit = est.ols(rows, ["x"], "y")
    return one_row(spark, variance=round(float(est.hac_variance(rows, fit, "y", 3, ORDER, ["session_id"])[0, 0]), 12))


@query(
    "EST03_effective_sample",
    sql(
        "SELECT round(c0 / (n - 1) * sxx * n / (c0s + 2 * (0.75 * c1 + 0.5 * c2 + 0.25 * c3)), 6) AS effective_sample FROM (SELECT count(*) AS n, sum(e * e) AS c0, sum(s * s) AS c0s, sum(s * l1) AS c1, sum(s * l2) AS c2, sum(s * l3) AS c3, sum(x * x) AS sxx FROM (SELECT x, e, s, lag(s, 1) OVER o AS l1, lag(s, 2) OVER o AS l2, lag(s, 3) OVER o AS l3 FROM (SELECT *, x * e AS s FROM (SELECT *, y - x * (SELECT sum(x * y) / sum(x * x) FROM st) AS e FROM st)) WINDOW o AS (PARTITION BY session_id ORDER BY ts_ns, seq)))",
        "bk",
        more=STUDY,
    ),
)
def est03(spark, sf_dir):
    rows = study(spark, sf_dir)
    fit = est.ols(rows, ["x"], "y")
    return one_row(spark, effective_sample=round(est.effective_sample(fit, est.hac_variance(rows, fit, "y", 3, ORDER, ["session_id"]), 0), 6))


_BLOCK = """xs AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts_ns, seq) AS r, CAST(flow AS DOUBLE) - (SELECT avg(flow) FROM fw) AS c FROM fw WHERE flow IS NOT NULL),
    nn AS (SELECT count(*) AS n, sum(c * c) AS v, CAST(least(count(*) - 1, ceil(2 * sqrt(count(*)))) AS BIGINT) AS most, CAST(greatest(5, ceil(sqrt(log10(count(*))))) AS BIGINT) AS run, 2 * sqrt(log10(count(*)) / count(*)) AS band FROM xs),
    rh AS (SELECT k, coalesce(s, 0) / v AS rho, abs(coalesce(s, 0) / v) < band AS quiet FROM nn, (SELECT unnest(range(1, (SELECT most FROM nn) + 1)) AS k) LEFT JOIN (SELECT b.r - a.r AS k, sum(a.c * b.c) AS s FROM xs a JOIN xs b ON b.session_id = a.session_id AND b.r > a.r AND b.r - a.r <= (SELECT most FROM nn) GROUP BY 1) USING (k)),
    cu AS (SELECT coalesce((SELECT min(a.k) FROM rh a WHERE a.k + run - 1 <= most AND (SELECT bool_and(quiet) FROM rh b WHERE b.k BETWEEN a.k AND a.k + run - 1)), most) AS cut FROM nn),
    gs AS (SELECT 2 * sum(least(1, greatest(0, 2 * (1 - k / CAST(cut AS DOUBLE)))) * k * rho) AS g, 1 + 2 * sum(least(1, greatest(0, 2 * (1 - k / CAST(cut AS DOUBLE)))) * rho) AS s FROM rh, cu WHERE k <= 2 * cut)"""


@query("EST04_block_length", sql("SELECT CAST(n AS DOUBLE) AS rows, round(least(cbrt(n), greatest(1, cbrt(g * g / (s * s)) * cbrt(n))), 9) AS block_length FROM nn, gs", "bk", more=FLOW + ", " + _AHEAD + ", " + _BLOCK))
def est04(spark, sf_dir):
    n, length = est.automatic_block(flow_rows(spark, sf_dir), "flow", ORDER, ["session_id"])
    return one_row(spark, rows=n, block_length=round(length, 9))


_BOOT = f"""dl AS (SELECT ts_ns, CAST(sum(size) AS DOUBLE) AS size, CAST(count(*) AS DOUBLE) AS events, row_number() OVER (ORDER BY ts_ns) - 1 AS pos FROM tape GROUP BY ts_ns),
    nn AS (SELECT count(*) AS n FROM dl),
    bl AS (SELECT a.pos, count(*) AS len FROM dl a JOIN dl b ON b.ts_ns >= a.ts_ns AND b.ts_ns <= a.ts_ns + {W24} GROUP BY 1),
    dr AS (SELECT r, k, CAST('0x' || substr(md5('7:' || r || ':' || k), 1, 15) AS BIGINT) % n AS pos FROM range(20) t(r), (SELECT n, unnest(range(n)) AS k FROM nn)),
    ru AS (SELECT r, pos, least(len, n - (sum(len) OVER (PARTITION BY r ORDER BY k) - len)) AS take FROM dr JOIN bl USING (pos), nn)"""


@query("EST05_bootstrap_means", sql("SELECT r AS replicate, round(sum(size) / any_value(n), 6) AS size, round(sum(events) / any_value(n), 6) AS events FROM ru JOIN dl ON dl.pos >= ru.pos AND dl.pos < ru.pos + take, nn WHERE take > 0 GROUP BY r", "tape", more=_BOOT))
def est05(spark, sf_dir):
    """Twenty replicates of a block bootstrap of daily volumes."""
    daily = tape(spark, sf_dir).groupBy(F.col("ts_ns")).agg(F.sum("size").cast("double").alias("size"), F.count("*").cast("double").alias("events"))
    got = est.bootstrap_means(daily, ["size", "events"], W24, 20, 7)
    return got.select("replicate", *(F.round(c, 6).alias(c) for c in ("size", "events")))


@query("EST05_bootstrap_slopes", sql("SELECT r AS replicate, round(regr_slope(size, events), 6) AS slope FROM ru JOIN dl ON dl.pos >= ru.pos AND dl.pos < ru.pos + take, nn WHERE take > 0 GROUP BY r", "tape", more=_BOOT))
def est05b(spark, sf_dir):
    """The slope of daily volume on the number of events, in the same replicates."""
    daily = tape(spark, sf_dir).groupBy(F.col("ts_ns")).agg(F.sum("size").cast("double").alias("size"), F.count("*").cast("double").alias("events"))
    return est.bootstrap_slopes(daily, "events", "size", W24, 20, 7).select("replicate", F.round("slope", 6).alias("slope"))


@query("EST06_kendall_tau_b", sql("SELECT round(sum(sign(CAST(a.size - b.size AS DOUBLE)) * sign(CAST(a.price - b.price AS DOUBLE))) / sqrt(CAST(count(*) FILTER (WHERE a.size <> b.size) AS DOUBLE) * count(*) FILTER (WHERE a.price <> b.price)), 9) AS tau FROM tape a, tape b", "tape"))
def est06(spark, sf_dir):
    """Pairs are compared between distinct values, not between rows."""
    return one_row(spark, tau=round(est.kendall_tau_b(tape(spark, sf_dir), "size", "price"), 9))


_SPLIT = "seq % 2"


_MODEL = """tr AS (SELECT *, CAST(x AS DOUBLE) AS v FROM st WHERE seq % 2 = 1), te AS (SELECT *, CAST(x AS DOUBLE) AS v FROM st WHERE seq % 2 = 0),
    ed AS (SELECT DISTINCT unnest(quantile_cont(v, [0.2, 0.4, 0.6, 0.8])) AS e FROM tr),
    ov AS (SELECT c, (SELECT count(*) FROM tr WHERE class = c) AS n, (SELECT count(*) FROM tr) AS t FROM range(3) r(c)),
    tg AS (SELECT c, (n + 10.0) / (t + 30.0) AS target, n, t FROM ov),
    bt AS (SELECT (SELECT count(*) FROM ed WHERE e <= v) AS b, class FROM tr),
    bs AS (SELECT (SELECT count(*) FROM ed WHERE e <= v) AS b, class FROM te),
    pr AS (SELECT g.b, tg.c, ((SELECT count(*) FROM bt WHERE bt.b = g.b AND class = tg.c) + 30 * target) / ((SELECT count(*) FROM bt WHERE bt.b = g.b) + 30.0) AS p FROM (SELECT DISTINCT b FROM (SELECT b FROM bt UNION SELECT b FROM bs)) g, tg)"""


@query("EST07_three_class_model", sql("SELECT CAST(b AS INTEGER) AS bin, CAST(c AS INTEGER) AS class, round(p, 9) AS probability FROM pr", "bk", more=STUDY + ", " + _MODEL))
def est07(spark, sf_dir):
    """The bins' class probabilities, learned on odd rows."""
    train = study(spark, sf_dir).where(f"{_SPLIT} = 1")
    model = est.ThreeClassModel.fit(train, "x", "class", 5, 30.0)
    return spark.createDataFrame([(b, c, round(float(p), 9)) for b, row in enumerate(model.probabilities) for c, p in enumerate(row)], "bin int, class int, probability double")


@query("EST08_log_score_skill", sql("SELECT round(1 - avg(-ln(pr.p)) / avg(-ln((tg.n + 30 * tg.target) / (tg.t + 30.0))), 9) AS skill FROM bs JOIN pr ON pr.b = bs.b AND pr.c = bs.class JOIN tg ON tg.c = bs.class", "bk", more=STUDY + ", " + _MODEL))
def est08(spark, sf_dir):
    rows = study(spark, sf_dir)
    return one_row(spark, skill=round(est.log_score_skill(rows.where(f"{_SPLIT} = 1"), rows.where(f"{_SPLIT} = 0"), "x", "class", 5, 30.0), 9))


_JOINT = """tr AS (SELECT *, CAST(x AS DOUBLE) AS v FROM st WHERE seq % 2 = 1), te AS (SELECT *, CAST(x AS DOUBLE) AS v FROM st WHERE seq % 2 = 0),
    eb AS (SELECT DISTINCT unnest(quantile_cont(v, [0.25, 0.5, 0.75])) AS e FROM tr), ex AS (SELECT DISTINCT unnest(quantile_cont(depth, [0.25, 0.5, 0.75])) AS e FROM tr),
    ov AS (SELECT c, (SELECT count(*) FROM tr WHERE class = c) AS n, (SELECT count(*) FROM tr) AS t FROM range(3) r(c)),
    tg AS (SELECT c, (n + 10.0) / (t + 30.0) AS target FROM ov),
    bt AS (SELECT (SELECT count(*) FROM eb WHERE e <= v) AS b, (SELECT count(*) FROM ex WHERE e <= depth) AS k, class FROM tr),
    bs AS (SELECT (SELECT count(*) FROM eb WHERE e <= v) AS b, (SELECT count(*) FROM ex WHERE e <= depth) AS k, class FROM te),
    pb AS (SELECT g.b, tg.c, ((SELECT count(*) FROM bt WHERE bt.b = g.b AND class = tg.c) + 30 * target) / ((SELECT count(*) FROM bt WHERE bt.b = g.b) + 30.0) AS p FROM (SELECT DISTINCT b FROM bs) g, tg),
    pj AS (SELECT g.b, g.k, pb.c, pb.p AS base, ((SELECT count(*) FROM bt WHERE bt.b = g.b AND bt.k = g.k AND class = pb.c) + 30 * pb.p) / ((SELECT count(*) FROM bt WHERE bt.b = g.b AND bt.k = g.k) + 30.0) AS p FROM (SELECT DISTINCT b, k FROM bs) g JOIN pb ON pb.b = g.b)"""


@query("EST09_incremental_skill", sql("SELECT round(1 - avg(-ln(pj.p)) / avg(-ln(pj.base)), 9) AS skill FROM bs JOIN pj ON pj.b = bs.b AND pj.k = bs.k AND pj.c = bs.class", "bk", more=STUDY + ", " + _JOINT))
def est09(spark, sf_dir):
    """What depth adds to order flow imbalance, learned on odd rows."""
    rows = study(spark, sf_dir)
    return one_row(spark, skill=round(est.incremental_log_score_skill(rows.where(f"{_SPLIT} = 1"), rows.where(f"{_SPLIT} = 0"), "x", "depth", "class", 4, 30.0), 9))


@query("EST10_brier_skill", sql("SELECT round(1 - avg(power(0.2 - CASE WHEN class = 0 THEN 1 ELSE 0 END, 2) + power(0.5 - CASE WHEN class = 1 THEN 1 ELSE 0 END, 2) + power(0.3 - CASE WHEN class = 2 THEN 1 ELSE 0 END, 2)) / avg(power(1 / 3.0 - CASE WHEN class = 0 THEN 1 ELSE 0 END, 2) + power(1 / 3.0 - CASE WHEN class = 1 THEN 1 ELSE 0 END, 2) + power(1 / 3.0 - CASE WHEN class = 2 THEN 1 ELSE 0 END, 2)), 9) AS skill FROM st", "bk", more=STUDY))
def est10(spark, sf_dir):
    rows = study(spark, sf_dir).withColumns({"p0": F.lit(0.2), "p1": F.lit(0.5), "p2": F.lit(0.3)})
    return one_row(spark, skill=round(est.brier_skill(rows, ["p0", "p1", "p2"], "class", [1 / 3] * 3), 9))


@query("EST10_reliability", sql("SELECT CAST((SELECT count(*) FROM (SELECT DISTINCT unnest(quantile_cont(depth, [0.25, 0.5, 0.75])) AS e FROM st) WHERE e <= s.depth) AS INTEGER) AS bin, round(avg(depth), 6) AS mean_forecast, round(avg(CASE WHEN class = 2 THEN 1.0 ELSE 0.0 END), 9) AS realised, CAST(count(*) AS BIGINT) AS rows FROM st s GROUP BY 1", "bk", more=STUDY))
def est10b(spark, sf_dir):
    got = est.reliability(study(spark, sf_dir), "depth", "class", 2, 4)
    return got.select("bin", F.round("mean_forecast", 6).alias("mean_forecast"), F.round("realised", 9).alias("realised"), "rows")


@query("EST11_hill_tail_index", sql("SELECT round(50 / sum(ln(m / last)), 9) AS index FROM (SELECT m, min(m) OVER () AS last, row_number() OVER (ORDER BY m DESC) AS k FROM (SELECT abs(CAST(x AS DOUBLE)) AS m FROM st WHERE x <> 0 ORDER BY m DESC LIMIT 51)) WHERE k <= 50", "bk", more=STUDY))
def est11(spark, sf_dir):
    return one_row(spark, index=round(est.hill_tail_index(study(spark, sf_dir), "x", 50), 9))


@query("EST12_clark_west", sql("SELECT session_id, seq, round(y * y - power(y - x / 1000, 2) + power(x / 1000, 2), 9) AS adjusted FROM st", "bk", more=STUDY))
def est12(spark, sf_dir):
    return study(spark, sf_dir).select(*KEYS, F.round(est.clark_west(F.col("y"), F.lit(0.0), F.col("x") / 1000), 9).alias("adjusted"))


@query("EST13_purged_folds", sql(f"SELECT fold, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE ts_ns < (SELECT quantile_cont(CAST(ts_ns AS DOUBLE), 0.25) FROM tape) - {W24} OR ts_ns > (SELECT quantile_cont(CAST(ts_ns AS DOUBLE), 0.5) FROM tape) + {W24}) AS BIGINT) AS trains_for_1 FROM (SELECT *, CAST((SELECT count(*) FROM (SELECT unnest(quantile_cont(CAST(ts_ns AS DOUBLE), [0.25, 0.5, 0.75])) AS b FROM tape) WHERE b <= t.ts_ns) AS INTEGER) AS fold FROM tape t) GROUP BY fold", "tape"))
def est13(spark, sf_dir):
    rows = est.purged_folds(tape(spark, sf_dir), "ts_ns", 4, W24)
    return rows.groupBy("fold").agg(F.count("*").alias("rows"), F.count_if(F.array_contains("trains", 1)).alias("trains_for_1"))


@query(
    "EST14_mutual_information",
    sql(
        "SELECT round(sum(n / t * ln(n * t / (nx * ny))), 9) AS plug_in, round(sum(n / t * ln(n * t / (nx * ny))) - (count(*) - count(DISTINCT type) - count(DISTINCT b) + 1) / (2 * max(t)), 9) AS miller_madow, CAST(count(DISTINCT type) AS BIGINT) AS x_bins, CAST(max(t) AS BIGINT) AS rows FROM (SELECT *, sum(n) OVER (PARTITION BY type) AS nx, sum(n) OVER (PARTITION BY b) AS ny, sum(n) OVER () AS t FROM (SELECT type, size // 100 AS b, CAST(count(*) AS DOUBLE) AS n FROM tape GROUP BY ALL))",
        "tape",
    ),
)
def est14(spark, sf_dir):
    rows = tape(spark, sf_dir).select("type", F.floor(F.col("size") / 100).alias("b"))
    got = est.mutual_information(rows, "type", "b")
    return got.select(F.round("plug_in", 9).alias("plug_in"), F.round("miller_madow", 9).alias("miller_madow"), "x_bins", "rows")


@query(
    "EST15_transfer_entropy",
    sql(
        "SELECT round(sum(n / t * ln(n * nz / (nxz * nyz))), 9) AS plug_in, round(sum(n / t * ln(n * nz / (nxz * nyz))) - greatest(count(*) - count(DISTINCT x) * count(DISTINCT z), 0) * 2 / (2 * max(t) * 3), 9) AS corrected, CAST(max(t) AS BIGINT) AS rows FROM (SELECT *, sum(n) OVER (PARTITION BY x, z) AS nxz, sum(n) OVER (PARTITION BY y, z) AS nyz, sum(n) OVER (PARTITION BY z) AS nz, sum(n) OVER () AS t FROM (SELECT x, y, z, CAST(count(*) AS DOUBLE) AS n FROM (SELECT direction AS x, lead(type) OVER o % 3 AS y, type % 3 AS z FROM tape WINDOW o AS (PARTITION BY session_id ORDER BY ts_ns, seq)) WHERE y IS NOT NULL GROUP BY ALL))",
        "tape",
    ),
)
def est15(spark, sf_dir):
    rows = tape(spark, sf_dir).select(F.col("direction").alias("x"), (F.lead("type").over(win.by_row()) % 3).alias("y"), (F.col("type") % 3).alias("z")).where("y is not null")
    got = est.transfer_entropy(rows, "x", "y", "z")
    return got.select(F.round("plug_in", 9).alias("plug_in"), F.round("corrected", 9).alias("corrected"), "rows")


@query("EST16_circular_shift_null", sql("SELECT o AS offset, round(covar_pop(CAST(b.size AS DOUBLE), CAST(a.price AS DOUBLE)), 6) AS covariance FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM tape) a, (VALUES (10), (20), (30)) v(o), tape b WHERE b.session_id = a.session_id AND b.seq = ((a.seq - 1 - o) % n + n) % n + 1 GROUP BY o", "tape"))
def est16(spark, sf_dir):
    turned = est.circular_shifts(tape(spark, sf_dir), "size", [10, 20, 30], ["session_id"], ORDER)
    return turned.groupBy(F.col("offset").cast("int").alias("offset")).agg(F.round(F.covar_pop(F.col("shifted").cast("double"), F.col("price").cast("double")), 6).alias("covariance"))


# Point processes.

BETA = 0.05


@query("HWK08_simulated_paths")
def hwk08(spark, sf_dir):
    return hk.simulate(spark, par.flow("balanced"), 16, 60.0, 11)


@query("HWK09_thinned_paths")
def hwk09(spark, sf_dir):
    return hk.simulate(spark, par.flow("balanced"), 16, 60.0, 11, thinning=True)


_STATE = ", ".join(f"round(coalesce(sum(exp(-{BETA} * (a.t - b.t))) FILTER (WHERE b.type = {k}), 0), 6) AS z{k}" for k in range(5))


@query("HWK11_state_at_events", sql(f"SELECT a.path_id, a.n, {_STATE} FROM paths a LEFT JOIN paths b ON b.path_id = a.path_id AND b.n < a.n GROUP BY a.path_id, a.n", "paths"))
def hwk11(spark, sf_dir):
    got = hk.state_before(paths(spark, sf_dir), BETA, 5)
    return got.select("path_id", "n", *(F.round(f"z{k}", 6).alias(f"z{k}") for k in range(5)))


_MODEL5 = hk.Hawkes(np.full(5, 0.01), np.full((5, 5), 0.008), BETA)


@query(
    "HWK12_compensators",
    sql(f"SELECT path_id, n, k AS component, round(0.01 * (k + 1) * t + 0.008 / {BETA} * c, 6) AS compensator, round(0.01 * (k + 1) + 0.008 * s, 6) AS intensity FROM (SELECT a.path_id, a.n, a.t, count(b.n) - coalesce(sum(exp(-{BETA} * (a.t - b.t))), 0) AS c, coalesce(sum(exp(-{BETA} * (a.t - b.t))), 0) AS s FROM paths a LEFT JOIN paths b ON b.path_id = a.path_id AND b.n < a.n GROUP BY a.path_id, a.n, a.t), (SELECT CAST(unnest(range(5)) AS INTEGER) AS k)", "paths"),
)
def hwk12(spark, sf_dir):
    """Every component's compensator and intensity just before each event, streamed path by path; baselines differ."""
    rising = hk.Hawkes(0.01 * np.arange(1, 6), _MODEL5.a, BETA)
    got = hk.replay(paths(spark, sf_dir), BETA, 5, rising)
    got = got.select("path_id", "n", F.posexplode(F.arrays_zip("compensators", "intensities")).alias("component", "x"))
    return got.select("path_id", "n", "component", F.round("x.compensators", 6).alias("compensator"), F.round("x.intensities", 6).alias("intensity"))


@query("HWK13_state_on_a_clock", sql("SELECT g.path_id, g.tau AS t, " + ", ".join(f"round(coalesce(sum(exp(-{BETA} * (g.tau - b.t))) FILTER (WHERE b.type = {k}), 0), 6) AS z{k}" for k in range(5)) + " FROM (SELECT DISTINCT path_id, tau FROM paths, (VALUES (CAST(50.0 AS DOUBLE)), (200.0), (700.0)) v(tau)) g LEFT JOIN paths b ON b.path_id = g.path_id AND b.t < g.tau GROUP BY g.path_id, g.tau", "paths"))
def hwk13(spark, sf_dir):
    got = hk.state_on_clock(paths(spark, sf_dir), BETA, 5, [50.0, 200.0, 700.0])
    return got.select("path_id", "t", *(F.round(f"z{k}", 6).alias(f"z{k}") for k in range(5)))


_COMP = f"cp AS (SELECT a.path_id, a.n, a.type, 0.01 * a.t + 0.008 / {BETA} * (count(b.n) - coalesce(sum(exp(-{BETA} * (a.t - b.t))), 0)) AS c FROM paths a LEFT JOIN paths b ON b.path_id = a.path_id AND b.n < a.n GROUP BY a.path_id, a.n, a.type, a.t), rs AS (SELECT path_id, n, type, c - coalesce(lag(c) OVER (PARTITION BY path_id, type ORDER BY n), 0) AS r FROM cp)"


@query("HWK14_residuals", sql("SELECT path_id, type, n, round(r, 6) AS residual FROM rs", "paths", more=_COMP))
def hwk14(spark, sf_dir):
    got = hk.residuals(hk.replay(paths(spark, sf_dir), BETA, 5, _MODEL5))
    return got.select("path_id", "type", "n", F.round("residual", 6).alias("residual"))


@query("HWK15_kolmogorov_smirnov", sql("SELECT type, CAST(count(*) AS BIGINT) AS n, round(max(greatest(i / k - f, f - (i - 1) / k)), 6) AS ks FROM (SELECT type, 1 - exp(-r) AS f, CAST(row_number() OVER (PARTITION BY type ORDER BY r) AS DOUBLE) AS i, CAST(count(*) OVER (PARTITION BY type) AS DOUBLE) AS k FROM rs) GROUP BY type", "paths", more=_COMP))
def hwk15(spark, sf_dir):
    got = hk.ks_exponential(hk.residuals(hk.replay(paths(spark, sf_dir), BETA, 5, _MODEL5)), "residual", ["type"])
    return got.select("type", "n", F.round("ks", 6).alias("ks"))


@query("HWK16_cluster_sizes")
def hwk16(spark, sf_dir):
    return hk.cluster_sizes(spark, par.flow("resilient"), 200, 0, 5)


@query("HWK16_state_integral", sql(f"SELECT path_id, type, round(sum((1 - exp(-{BETA} * (700 - t))) / {BETA}), 6) AS integral FROM paths WHERE t < 700 GROUP BY ALL", "paths"))
def hwk16b(spark, sf_dir):
    """The integral of each type's decayed count up to a horizon."""
    p = paths(spark, sf_dir).where("t < 700")
    return p.groupBy("path_id", "type").agg(F.round(F.sum((1 - F.exp(-BETA * (700 - F.col("t")))) / F.lit(BETA)), 6).alias("integral"))


@query("HWK18_forward_counts", sql("SELECT g.path_id, g.tau AS t, " + ", ".join(f"CAST(count(*) FILTER (WHERE b.type = {k}) AS BIGINT) AS n{k}" for k in range(5)) + " FROM (SELECT DISTINCT path_id, tau FROM paths, (VALUES (CAST(50.0 AS DOUBLE)), (200.0), (700.0)) v(tau)) g LEFT JOIN paths b ON b.path_id = g.path_id AND b.t <= g.tau GROUP BY g.path_id, g.tau", "paths"))
def hwk18(spark, sf_dir):
    return hk.counts_on_clock(paths(spark, sf_dir), 5, [50.0, 200.0, 700.0])


# Folds, order flow and coupling.


def messages(spark, sf_dir):
    """The tape as orders: cancellations and deletions withdraw, executions are market orders against the book."""
    t = tape(spark, sf_dir)
    kind = F.when(F.col("type").isin(2, 3), 2).otherwise(1)
    price = F.when(F.col("type").isin(4, 5), F.when(F.col("direction") > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(0))).otherwise(F.col("price") / 100)
    return t.select("session_id", "seq", "ts_ns", "size", price.cast("long").alias("price"), F.col("direction").cast("int").alias("direction"), kind.alias("kind"))


#: The update rule in SQL: one step of all sessions at a time over books of twenty prices, 1000 to 1019.
#: `f` is what each level of the other side gives, `stays` where the rest of an order stays.
_FOLD = """ms AS (SELECT session_id, seq, ts_ns, size, direction AS d, type IN (2, 3) AS gone, CASE WHEN type IN (4, 5) THEN NULL ELSE price // 100 END AS p FROM tape),
    fo AS (
        SELECT session_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS ts_ns, 0 AS d, CAST(NULL AS BIGINT) AS stays, CAST(0 AS BIGINT) AS unfilled, CAST(0 AS BIGINT) AS took, z AS f, z AS opp, z AS own, z AS bids, z AS asks, FALSE AS gone
        FROM (SELECT DISTINCT session_id, list_transform(range(20), lambda i: CAST(0 AS BIGINT)) AS z FROM ms)
        UNION ALL
        SELECT session_id, seq, ts_ns, d, CASE WHEN gone AND took > 0 THEN p WHEN NOT gone AND rest > 0 THEN stays END, CASE WHEN stays IS NULL AND NOT gone THEN rest ELSE 0 END, took, f, opp, own,
            CASE WHEN d = 1 THEN own ELSE opp END, CASE WHEN d = 1 THEN opp ELSE own END, gone
        FROM (
            SELECT session_id, seq, ts_ns, d, p, gone, stays, rest, took, f, list_transform(opp, lambda x, i: x - f[i]) AS opp,
                list_transform(own, lambda x, i: x + CASE WHEN gone AND 999 + i = p THEN -took WHEN NOT gone AND 999 + i = stays THEN rest ELSE 0 END) AS own
            FROM (
                SELECT *, CASE WHEN gone THEN 0 ELSE size - CAST(list_sum(f) AS BIGINT) END AS rest, CASE WHEN gone THEN least(size, own[p - 999]) ELSE 0 END AS took,
                    CASE WHEN p IS NOT NULL THEN p WHEN d = 1 THEN list_max(list_transform(f, lambda x, i: CASE WHEN x > 0 THEN 999 + i END)) ELSE list_min(list_transform(f, lambda x, i: CASE WHEN x > 0 THEN 999 + i END)) END AS stays
                FROM (
                    SELECT *, list_transform(al, lambda x, i: greatest(0, least(x, size - CAST(coalesce(list_sum(CASE WHEN d = 1 THEN al[1:i - 1] ELSE al[i + 1:20] END), 0) AS BIGINT)))) AS f
                    FROM (
                        SELECT *, list_transform(opp, lambda x, i: CASE WHEN gone OR (p IS NOT NULL AND (999 + i - p) * d > 0) THEN 0 ELSE x END) AS al
                        FROM (SELECT ms.*, CASE WHEN ms.d = 1 THEN asks ELSE bids END AS opp, CASE WHEN ms.d = 1 THEN bids ELSE asks END AS own FROM fo JOIN ms ON ms.session_id = fo.session_id AND ms.seq = fo.seq + 1)
                    )
                )
            )
        )
    ),
    fb AS (
        SELECT *, list_max(list_transform(bids, lambda x, i: CASE WHEN x > 0 THEN 999 + i END)) AS bid, list_min(list_transform(asks, lambda x, i: CASE WHEN x > 0 THEN 999 + i END)) AS ask,
            CAST(len(list_filter(f, lambda x: x > 0)) AS BIGINT) AS fill_count, CAST(list_sum(f) AS BIGINT) AS traded_size, CAST(list_sum(list_transform(f, lambda x, i: x * (999 + i))) AS BIGINT) AS traded_value
        FROM fo WHERE seq > 0
    ),
    fl AS (SELECT session_id, seq, ts_ns, d, opp, unnest(range(1, 21)) AS i, unnest(f) AS x FROM fb)"""


def folded_sql(body: str) -> str:
    return sql(body, "tape", more=_FOLD).replace("WITH ", "WITH RECURSIVE ", 1)


@query("FLD01_folded_book", folded_sql("SELECT session_id, seq, bid, ask, fill_count, traded_size, traded_value, unfilled, took AS withdrawn, fill_count > 1 AS walked FROM fb"))
def fld01(spark, sf_dir):
    """Touches and trades after every message, by the batch fold."""
    f = fold.fold(messages(spark, sf_dir), DEPTH)
    a, b = sides()
    return f.select(*KEYS, lv.best(b)["price"].alias("bid"), lv.best(a)["price"].alias("ask"), "fill_count", "traded_size", "traded_value", "unfilled", "withdrawn", fold.walked_the_book(F.col("fills")).alias("walked"))


@query("FLD05_fills", folded_sql("SELECT session_id, seq, ts_ns, CAST(row_number() OVER (PARTITION BY session_id, seq ORDER BY i * d) - 1 AS INTEGER) AS fill, CAST(999 + i AS BIGINT) AS price, x AS size, CAST(d AS INTEGER) AS aggressor FROM fl WHERE x > 0"))
def fld05(spark, sf_dir):
    return fold.fills_frame(fold.fold(messages(spark, sf_dir), DEPTH))


@query("FLD06_tally", folded_sql("SELECT session_id, CAST(count(*) AS BIGINT) AS messages, CAST(sum(fill_count) AS BIGINT) AS fills, CAST(sum(traded_size) AS BIGINT) AS traded, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS withdrawals FROM fb GROUP BY session_id"))
def fld06(spark, sf_dir):
    return fold.fold_tally(messages(spark, sf_dir))


_BEST3 = ", ".join(f"{s}l[{k}] + 999 AS {s}p{k}, {n}[{s}l[{k}]] AS {s}s{k}" for s, n in (("a", "asks"), ("b", "bids")) for k in range(1, DEPTH + 1))
_FOLDED_BOOK = f"bi AS (SELECT session_id, seq, ts_ns, bids, asks, list_reverse(list_filter(range(1, 21), lambda i: bids[i] > 0)) AS bl, list_filter(range(1, 21), lambda i: asks[i] > 0) AS al FROM fb), bk AS (SELECT session_id, seq, ts_ns, {_BEST3} FROM bi), "


@query("FLD07_session_statistics", sql(FRAME_SQL, "tape", more=_FOLD + ", " + _FOLDED_BOOK + FRAME_CTES).replace("WITH ", "WITH RECURSIVE ", 1))
def fld07(spark, sf_dir):
    """Every declared statistic over folded states: the fold is Python, all else column expressions."""
    return statistics_frame(fold.fold(messages(spark, sf_dir), DEPTH), FRAME, DEPTH, TRUNCATED)


@query("FLD08_top_of_book", folded_sql("SELECT session_id, seq, bid AS price, bids[bid - 999] AS bid_size, ask AS ask_price, asks[ask - 999] AS ask_size FROM fb"))
def fld08(spark, sf_dir):
    a, b = sides()
    return fold.fold(messages(spark, sf_dir), 1).select(*KEYS, lv.best(b).alias("bid"), lv.best(a).alias("ask")).select(*KEYS, "bid.price", F.col("bid.size").alias("bid_size"), F.col("ask.price").alias("ask_price"), F.col("ask.size").alias("ask_size"))


@query("FLD02_resting_prices", folded_sql("SELECT session_id, seq, CAST(stays AS BIGINT) AS price, own[stays - 999] AS resting FROM fb WHERE stays IS NOT NULL AND NOT gone"))
def fld02(spark, sf_dir):
    """Where what is left of an order comes to rest: at its limit, or the last price a market order traded at."""
    return fold.resting_frame(fold.fold(messages(spark, sf_dir), 1))


@query("FLD04_dispatched_kinds", folded_sql("SELECT CAST(CASE WHEN gone THEN 2 ELSE 1 END AS INTEGER) AS kind, CAST(count(*) AS BIGINT) AS messages, CAST(count(*) FILTER (WHERE fill_count > 0) AS BIGINT) AS trading, CAST(sum(traded_size) AS BIGINT) AS traded, CAST(sum(took) AS BIGINT) AS withdrawn FROM fb GROUP BY 1"))
def fld04(spark, sf_dir):
    """What messages of each kind do once they are dispatched."""
    m = messages(spark, sf_dir)
    f = fold.fold(m, 1).join(m.select(*KEYS, F.col("kind").cast("int").alias("kind")), KEYS)
    return f.groupBy("kind").agg(F.count("*").alias("messages"), F.count_if(F.col("fill_count") > 0).alias("trading"), F.sum("traded_size").alias("traded"), F.sum("withdrawn").alias("withdrawn"))


@query("FLD09_level_deltas", folded_sql("SELECT session_id, seq, ts_ns, CAST(-d AS INTEGER) AS side, CAST(999 + i AS BIGINT) AS price, opp[i] AS resting FROM fl WHERE x > 0 UNION ALL SELECT session_id, seq, ts_ns, CAST(d AS INTEGER), CAST(stays AS BIGINT), own[stays - 999] FROM fb WHERE stays IS NOT NULL"))
def fld09(spark, sf_dir):
    return fold.levels_frame(fold.fold(messages(spark, sf_dir), DEPTH))


@query("FLD01_table_function", folded_sql("SELECT session_id, seq, fill_count, traded_size, traded_value FROM fb"))
def fld01b(spark, sf_dir):
    f = fold.fold_by_table_function(messages(spark, sf_dir), DEPTH)
    return f.select(*KEYS, "fill_count", "traded_size", "traded_value")


#: Prices of the tape's orders.
BAND = (1000, 1019)


@query("FLD15_storage_variants", folded_sql("SELECT storage, session_id, seq, bid, bids[bid - 999] AS bid_size, ask, asks[ask - 999] AS ask_size, traded_value, took AS withdrawn FROM fb, (VALUES " + ", ".join(f"('{n}')" for n in STORAGES) + ") v(storage)"))
def fld15b(spark, sf_dir):
    """The same fold with every way to store a book."""
    a, b = sides()
    out = None
    for name in STORAGES:
        f = fold.fold(messages(spark, sf_dir), 1, storage=name, band=BAND)
        f = f.select(F.lit(name).alias("storage"), *KEYS, lv.best(b).alias("b"), lv.best(a).alias("a"), "traded_value", "withdrawn")
        f = f.select("storage", *KEYS, F.col("b.price").alias("bid"), F.col("b.size").alias("bid_size"), F.col("a.price").alias("ask"), F.col("a.size").alias("ask_size"), "traded_value", "withdrawn")
        out = f if out is None else out.unionByName(f)
    return out


@query("SIM01_event_types", sql("SELECT session_id, seq, CAST((type + 1) % 6 AS INTEGER) AS event, CASE WHEN (type + 1) % 6 % 2 = 0 THEN 1 ELSE -1 END AS direction, CASE WHEN (type + 1) % 6 % 2 = 0 THEN 1 ELSE -1 END * CASE WHEN (type + 1) % 6 < 4 THEN 1 ELSE -1 END AS pressure FROM tape", "tape"))
def sim01(spark, sf_dir):
    kind = (F.col("type") + 1) % 6
    return tape(spark, sf_dir).select(*KEYS, kind.alias("event"), fl.direction_column(kind).alias("direction"), fl.pressure_column(kind).alias("pressure"))


@query("SIM02_lot_sizes", sql("SELECT session_id, seq, greatest(10, CAST(round_even(size * 1.25 / 10, 0) AS BIGINT) * 10) AS lots FROM tape", "tape"))
def sim02(spark, sf_dir):
    return tape(spark, sf_dir).select(*KEYS, fl.lot_size(F.col("size") * F.lit(1.25), 10).alias("lots"))


@query("SIM05_simulated_flow")
def sim05(spark, sf_dir):
    return fl.simulate_flow(spark, par.flow("resilient"), par.marks("resilient"), 8, 30.0, 3, warm_up=5.0)


@query("SIM06_dropped_events")
def sim06(spark, sf_dir):
    rows = fl.simulate_flow(spark, par.flow("resilient"), par.marks("resilient"), 8, 30.0, 3)
    return rows.groupBy("session_id").agg(F.count("*").alias("events"), F.count_if(~F.col("emitted")).alias("dropped"))


TOUCHES = {BUY: (1000, 5), SELL: (1001, 5)}


def coupled(spark, mark_seeds=2):
    return fl.coupled(hk.simulate(spark, par.flow("balanced"), 8, 20.0, 17), par.marks("unit"), 1, 5, TOUCHES, 60, 23, mark_seeds)


#: What unit orders do to the idealised book: `ev` is the side a unit goes from (-1, 1), or comes to (-2, 2: 2 the bid).
_IDEAL = """iw AS (
        SELECT DISTINCT path_id, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS t, CAST(-1 AS INTEGER) AS type, CAST(1000 AS BIGINT) AS b, CAST(2 AS BIGINT) AS nb, CAST(1001 AS BIGINT) AS a, CAST(2 AS BIGINT) AS na, 0 AS dead FROM paths
        UNION ALL
        SELECT path_id, n, t, type, CASE WHEN ev = 1 AND nb = 1 THEN b - 1 WHEN ev = 2 AND nb = 3 THEN b + 1 ELSE b END, CASE WHEN ev = 1 THEN CASE WHEN nb = 1 THEN 3 ELSE nb - 1 END WHEN ev = 2 THEN CASE WHEN nb = 3 THEN 1 ELSE nb + 1 END ELSE nb END,
            CASE WHEN ev = -1 AND na = 1 THEN a + 1 WHEN ev = -2 AND na = 3 THEN a - 1 ELSE a END, CASE WHEN ev = -1 THEN CASE WHEN na = 1 THEN 3 ELSE na - 1 END WHEN ev = -2 THEN CASE WHEN na = 3 THEN 1 ELSE na + 1 END ELSE na END,
            CASE WHEN ev = 1 AND nb = 1 AND b = 995 THEN 1 WHEN ev = -1 AND na = 1 AND a = 1006 THEN -1 ELSE 0 END
        FROM (
            SELECT w.path_id, p.n, p.t, p.type, b, nb, a, na, CASE p.type WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN -1 WHEN 2 THEN CASE WHEN nb = 3 AND b + 1 = a THEN -1 ELSE 2 END ELSE CASE WHEN na = 3 AND b + 1 = a THEN 1 ELSE -2 END END AS ev
            FROM iw w JOIN paths p ON p.path_id = w.path_id AND p.n = w.n + 1 WHERE dead = 0
        )
    ),
    il AS (SELECT *, lead(dead) OVER (PARTITION BY path_id ORDER BY n) AS ends FROM iw)"""

#: Touches, depth and levels of the idealised book that the events of the tables are placed in.
SMALL = {"depth": 3, "touches": {BUY: (1000, 2), SELL: (1001, 2)}, "levels": 6}


def ideal_sql(body: str) -> str:
    return sql(body, "paths", more=_IDEAL).replace("WITH ", "WITH RECURSIVE ", 1)


@query("SIM07_idealised_flow", ideal_sql("SELECT path_id, n, round(t, 6) AS t, type, b AS bid, nb AS bid_size, a AS ask, na AS ask_size, CASE ends WHEN 1 THEN 'the bid side would empty' WHEN -1 THEN 'the ask side would empty' END AS breach FROM il WHERE dead = 0"))
def sim07(spark, sf_dir):
    """Each user's events as unit orders that keep the idealised book."""
    return fl.idealised_flow(paths(spark, sf_dir), **SMALL).withColumn("t", F.round("t", 6))


@query("SIM08_flow_identity", ideal_sql("SELECT path_id, CAST(count(*) AS BIGINT) AS rows, CAST(sum(e) AS BIGINT) AS flow, arg_max(b + a, n) / 2 - 1000.5 AS moved, CAST(count(*) FILTER (WHERE 3 * (b + a - 2001) <> flow - nb + na) AS BIGINT) AS violations FROM (SELECT *, sum(e) OVER (PARTITION BY path_id ORDER BY n) AS flow FROM (SELECT *, coalesce(CASE WHEN b >= lag(b) OVER o THEN nb ELSE 0 END - CASE WHEN b <= lag(b) OVER o THEN lag(nb) OVER o ELSE 0 END - CASE WHEN a <= lag(a) OVER o THEN na ELSE 0 END + CASE WHEN a >= lag(a) OVER o THEN lag(na) OVER o ELSE 0 END, 0) AS e FROM iw WHERE dead = 0 WINDOW o AS (PARTITION BY path_id ORDER BY n))) GROUP BY path_id"))
def sim08(spark, sf_dir):
    """In the idealised book the mid's move follows from the flow: rows where it does not (none)."""
    return fl.flow_identity(fl.idealised_flow(paths(spark, sf_dir), **SMALL), SMALL["depth"])


_CUMULATED = [" + ".join(f"coalesce(bs{j}, 0)" for j in range(1, k + 1)) for k in range(1, DEPTH + 1)]


@query("SIM04_withdrawal_levels", sql("SELECT session_id, seq, CASE " + " ".join(f"WHEN 101 * ({c}) > (seq * 37) % 101 * ({_CUMULATED[-1]}) THEN bp{k}" for k, c in enumerate(_CUMULATED, 1)) + " END AS price FROM bk", "bk"))
def sim04(spark, sf_dir):
    """The bid that a withdrawal picks in proportion to size; none where there is no bid."""
    return book(spark, sf_dir).select(*KEYS, fl.weighted_level(F.col("bids"), (F.col("seq") * 37 % 101) / F.lit(101.0)).alias("price"))


@query("CPL02_coupled_books")
def cpl02(spark, sf_dir):
    return coupled(spark)


@query("CPL03_parting")
def cpl03(spark, sf_dir):
    return fl.parting(coupled(spark))


@query("CPL04_first_moves")
def cpl04(spark, sf_dir):
    return fl.first_moves(coupled(spark))


@query("CPL04_touch_walks")
def cpl04b(spark, sf_dir):
    return fl.touch_walks(coupled(spark))


@query("CPL05_mids_on_a_clock")
def cpl05(spark, sf_dir):
    return fl.mids_on_clock(coupled(spark), [1.0, 5.0, 10.0, 20.0])


_WALK = "wk AS (SELECT path_id, n, type, 3 + sum(CASE type WHEN 2 THEN 1 WHEN 1 THEN -1 WHEN 4 THEN -1 ELSE 0 END) OVER o AS b, 4 + sum(CASE type WHEN 3 THEN 1 WHEN 0 THEN -1 ELSE 0 END) OVER o AS a FROM paths WINDOW o AS (PARTITION BY path_id ORDER BY n ROWS UNBOUNDED PRECEDING)), wm AS (SELECT *, greatest(5, max(greatest(a, b)) OVER (PARTITION BY path_id ORDER BY n ROWS UNBOUNDED PRECEDING)) AS m FROM wk)"


@query("CPL06_first_move_from_counts", sql("SELECT path_id, min(n) AS n FROM wm WHERE m - least(a, b) >= 5 GROUP BY path_id", "paths", more=_WALK))
def cpl06(spark, sf_dir):
    return fl.first_move_from_counts(paths(spark, sf_dir), 5, 3, 4).select("path_id", "n")


@query("CPL07_distance_terms")
def cpl07(spark, sf_dir):
    return fl.distance_terms(coupled(spark), 5)


@query("CPL01_state_after", sql(f"SELECT path_id, type, round(sum(exp(-{BETA} * (300 - t))), 6) AS state FROM paths WHERE t <= 300 GROUP BY ALL", "paths"))
def cpl01(spark, sf_dir):
    p = paths(spark, sf_dir).where("t <= 300")
    return p.groupBy("path_id", "type").agg(F.round(F.sum(F.exp(-BETA * (300 - F.col("t")))), 6).alias("state"))

