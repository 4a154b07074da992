"""Registered queries of the order-book engine."""

from tapeworks.plans import census, closed_forms, figures, files, fits, models, residuals, statistics, windows
from tapeworks.plans.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


def flagship(spark, sf_dir):
    """Rolling VWAP over event time."""
    return QUERIES["WIN06_rolling_vwap"](spark, sf_dir)


__all__ = ["census", "closed_forms", "figures", "files", "fits", "flagship", "models", "oracle_sql", "queries", "residuals", "statistics", "windows"]
