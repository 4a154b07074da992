"""Queries of the frames behind drawings (FIG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import figures
from tapeworks.operators import hawkes as hk
from tapeworks.plans.models import _COMP, _MODEL5, BETA
from tapeworks.plans.registry import query
from tapeworks.sources.tape import DEPTH, book, paths, sql

_OFF = " UNION ALL ".join(f"SELECT session_id, '{n}' AS side, abs({s}p{k} - {s}p1) AS ticks, {s}s{k} AS size FROM bk WHERE {s}p{k} IS NOT NULL" for n, s in (("asks", "a"), ("bids", "b")) for k in range(1, DEPTH + 1))


@query("FIG01_depth_profile", sql(f"SELECT session_id, side, ticks, round(sum(size) OVER (PARTITION BY session_id, side ORDER BY ticks) / states, 9) AS mean_depth FROM (SELECT session_id, side, ticks, CAST(sum(size) AS DOUBLE) AS size FROM ({_OFF}) GROUP BY ALL) JOIN (SELECT session_id, count(*) AS states FROM bk GROUP BY session_id) USING (session_id)", "bk"))
def depth_profile(spark, sf_dir):
    """Size up to so many ticks from the touch, averaged over a session."""
    return figures.depth_profile(book(spark, sf_dir)).withColumn("mean_depth", F.round("mean_depth", 9))


@query("FIG02_counting", sql("SELECT path_id, type, round(t, 6) AS t, CAST(row_number() OVER (PARTITION BY path_id, type ORDER BY n) AS INTEGER) AS count FROM paths", "paths"))
def counting(spark, sf_dir):
    """The steps of the counting processes."""
    return figures.counting(paths(spark, sf_dir)).withColumn("t", F.round("t", 6))


@query("FIG03_exponential_quantiles", sql("SELECT type, round(-ln(1 - (row_number() OVER (PARTITION BY type ORDER BY r) - 0.5 :: DOUBLE) / count(*) OVER (PARTITION BY type)), 6) AS theoretical, round(r, 6) AS observed FROM rs", "paths", more=_COMP))
def quantiles(spark, sf_dir):
    """Quantiles of the residuals of each type beside those of their law."""
    got = figures.exponential_qq(hk.residuals(hk.replay(paths(spark, sf_dir), BETA, 5, _MODEL5)), ["type"])
    return got.select("type", F.round("theoretical", 6).alias("theoretical"), F.round("observed", 6).alias("observed"))
