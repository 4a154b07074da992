"""Queries of many fits at once (REG06, REG08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.functions import levels as lv
from tapeworks.operators import windows as win
from tapeworks.operators.fits import nested_fits
from tapeworks.plans.registry import query
from tapeworks.plans.statistics import FLOW, sides
from tapeworks.sources.tape import HOUR_NS, book, sql

WINDOWS, HORIZONS, PARTS = (6, 24), (6, 24), 5

_FITS = (
    FLOW
    + "".join(
        f", x{w} AS (SELECT a.session_id, a.seq, CASE WHEN count(*) = count(b.flow) THEN sum(b.flow) END AS x FROM fw a JOIN fw b ON b.session_id = a.session_id AND b.ts_ns > a.ts_ns - {w * HOUR_NS} AND b.ts_ns <= a.ts_ns AND b.seq <= a.seq GROUP BY ALL)"
        for w in WINDOWS
    )
    + "".join(
        f", y{h} AS (SELECT session_id, seq, CASE WHEN q > seq AND fseg = segment THEN fmid - mid END AS y FROM (SELECT a.session_id, a.seq, a.mid, a.segment, max(b.seq) AS q, arg_max_null(b.mid, b.seq) AS fmid, arg_max(b.segment, b.seq) AS fseg FROM sg a JOIN sg b ON b.session_id = a.session_id AND b.ts_ns <= a.ts_ns + {h * HOUR_NS} GROUP BY ALL))"
        for h in HORIZONS
    )
    + ", fr AS ("
    + " UNION ALL ".join(f"SELECT session_id % {PARTS} AS part, {w} AS window_h, {h} AS horizon_h, CAST(x AS DOUBLE) AS x, CAST(depth AS DOUBLE) AS z, y FROM x{w} JOIN y{h} USING (session_id, seq) JOIN fw USING (session_id, seq) WHERE x IS NOT NULL AND depth IS NOT NULL AND y IS NOT NULL" for w in WINDOWS for h in HORIZONS)
    + "), ag AS (SELECT part, window_h, horizon_h, count(*) AS n, var_pop(x) AS xx, covar_pop(x, z) AS xz, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, var_pop(y) AS yy, avg(x) AS ax, avg(z) AS az, avg(y) AS ay FROM fr GROUP BY ALL)"
    ", bs AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM ag)"
    ", rs2 AS (SELECT *, (b1 * xy + b2 * zy) / yy AS r2, xy * xy / (xx * yy) AS r1 FROM bs)"
)


@query(
    "REG08_nested_fits",
    sql("SELECT part, window_h, horizon_h, CAST(n AS BIGINT) AS n, round(ay - b1 * ax - b2 * az, 6) AS intercept, round(b1, 8) AS slope_flow, round(b2, 8) AS slope_depth, round(r1, 8) AS base_r_squared, round(r2, 8) AS r_squared, round((r2 - r1) / (1 - r2) * (n - 3), 4) AS f FROM rs2", "bk", more=_FITS),
)
def fits(spark, sf_dir):
    """A table of fits of the forward mid change on flow, and on flow and depth: by part of the sessions, window and horizon."""
    rows = book(spark, sf_dir).select("session_id", "seq", "ts_ns", win.order_flow_contribution().alias("flow"), lv.touch_depth(*sides()).alias("depth"), lv.mid_price(*sides()).alias("value"))
    rows = rows.withColumn("segment", win.segments(F.col("value").isNull()))
    rows = rows.withColumns({f"x{w}": win.backward_sum(F.col("flow"), w * HOUR_NS) for w in WINDOWS} | {f"y{h}": win.forward_change(h * HOUR_NS) for h in HORIZONS})
    each = F.explode(F.array(*(F.struct(F.lit(w).alias("window_h"), F.lit(h).alias("horizon_h"), F.col(f"x{w}").alias("x"), F.col(f"y{h}").alias("y")) for w in WINDOWS for h in HORIZONS)))
    cases = rows.select((F.col("session_id") % PARTS).alias("part"), "depth", each.alias("c")).select("part", "depth", "c.*")
    got = nested_fits(cases, ["part", "window_h", "horizon_h"], ["x"], ["depth"], "y")
    return got.select("part", "window_h", "horizon_h", "n", F.round("intercept", 6).alias("intercept"), F.round(F.get("slopes", F.lit(0)), 8).alias("slope_flow"), F.round(F.get("slopes", F.lit(1)), 8).alias("slope_depth"), F.round("base_r_squared", 8).alias("base_r_squared"), F.round("r_squared", 8).alias("r_squared"), F.round("f", 4).alias("f"))
