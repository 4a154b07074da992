"""Many linear fits at once: moments of every group by one aggregation, then batches of small systems solved in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _solved(c: np.ndarray, cy: np.ndarray, vy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of least norm and the explained share of variance, for a stack of centred moment matrices."""
    slopes = np.einsum("nij,nj->ni", np.linalg.pinv(c, hermitian=True), cy)
    return slopes, np.divide(np.einsum("ni,ni->n", slopes, cy), vy, out=np.full(len(vy), np.nan), where=vy > 0)


def nested_fits(df: DataFrame, by: list[str], base: list[str], extra: list[str], outcome: str) -> DataFrame:
    """(by, n, intercept, slopes, base_r_squared, r_squared, f): for every group the fit of the outcome on base and extra
    predictors, how much the base alone explains, and the F of the extra ones together.

    Rows with a NULL in any column are left out. Predictors that depend on each other share their slope (least norm).
    f is NULL where no degree of freedom or no variance is left; shares are NULL for a constant outcome.
    """
    xs = [*base, *extra]
    k, kb = len(xs), len(base)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    columns = [*by, *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(xs)), F.col(outcome).cast("double").alias("_y")]
    rows = df.select(*columns).dropna(subset=[*(f"_x{i}" for i in range(k)), "_y"])
    moments = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.array(F.avg("_y"), *(F.avg(f"_x{i}") for i in range(k))).alias("means"),
        F.array(F.var_pop("_y"), *(F.covar_pop(f"_x{i}", "_y") for i in range(k)), *(F.covar_pop(f"_x{i}", f"_x{j}") for i, j in pairs)).alias("moments"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = len(batch)
            if not size:
                continue
            keys, n = batch.columns[: len(by)], batch.column(len(by)).to_numpy()
            means, m = (np.array(batch.column(len(by) + j).to_pylist(), float).reshape(size, -1) for j in (1, 2))
            c = np.zeros((size, k, k))
            for at, (i, j) in enumerate(pairs):
                c[:, i, j] = c[:, j, i] = m[:, 1 + k + at]
            slopes, share = _solved(c, m[:, 1 : 1 + k], m[:, 0])
            below = _solved(c[:, :kb, :kb], m[:, 1 : 1 + kb], m[:, 0])[1] if kb else np.where(m[:, 0] > 0, 0.0, np.nan)
            free, left = n - k - 1, 1 - share
            fine = (free > 0) & (left > 0) & (k > kb)
            f = np.divide((share - below) / max(1, k - kb) * free, left, out=np.full(size, np.nan), where=fine)
            none = lambda x: pa.array(x, mask=np.isnan(x))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, size * k + 1, k, dtype=np.int32)), pa.array(slopes.ravel()))
            yield pa.RecordBatch.from_arrays([*keys, pa.array(n), pa.array(means[:, 0] - np.einsum("ni,ni->n", slopes, means[:, 1:])), lists, none(below), none(share), none(f)], [*by, "n", "intercept", "slopes", "base_r_squared", "r_squared", "f"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in moments.select(*by).dtypes)
    return moments.mapInArrow(run, f"{kinds}, n long, intercept double, slopes array<double>, base_r_squared double, r_squared double, f double")
