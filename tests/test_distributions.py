"""Laws of groups and tails of tests against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.functions import special
from tapeworks.operators import distributions as ds


def value_of(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def simpson(f, a, b, n=200_000):
    x = np.linspace(a, b, n + 1)
    y = f(x)
    return (b - a) / n / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())


@pytest.mark.parametrize("freedom", [1, 2, 5, 20, 40])
def test_chi_square_tail(spark, freedom):
    """Even orders by their finite sum, others by quadrature from far out."""
    for x in (0.01, 0.5, 1.0, freedom - 0.5, freedom + 2.0, 3.0 * freedom + 10, 200.0):
        if freedom % 2 == 0:
            want = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))
        elif freedom == 1:
            want = math.erfc(math.sqrt(x / 2))
        else:
            norm = 2 ** (freedom / 2) * math.gamma(freedom / 2)
            want = simpson(lambda y: y ** (freedom / 2 - 1) * np.exp(-y / 2) / norm, x, x + 400)
        assert value_of(spark, special.chi_square_tail(F.lit(x), freedom)) == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert value_of(spark, special.chi_square_tail(F.lit(0.0), freedom)) == 1.0
    assert value_of(spark, special.chi_square_tail(F.lit(None).cast("double"), freedom)) is None


def test_student_tail(spark):
    for n in (1, 2, 3, 10, 101, 5000):
        for t in (0.0, 0.3, -1.0, 2.5, 9.0):
            if n == 1:
                want = 1 - 2 / math.pi * math.atan(abs(t))
            elif n == 2:
                want = 1 - abs(t) / math.sqrt(2 + t * t)
            else:
                c = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi)
                want = 1 - 2 * simpson(lambda y: c * (1 + y * y / n) ** (-(n + 1) / 2), 0, abs(t))
            assert value_of(spark, special.student_two_sided(F.lit(t), F.lit(n))) == pytest.approx(want, rel=1e-8, abs=1e-10)
    assert value_of(spark, special.student_two_sided(F.lit(1.0), F.lit(0))) is None


def test_kolmogorov_tail(spark):
    for x in (0.2, 0.5, 0.99, 1.0, 1.36, 2.0):
        want = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 2000))
        assert value_of(spark, special.kolmogorov_tail(F.lit(x))) == pytest.approx(want, abs=1e-12)
    assert value_of(spark, special.kolmogorov_tail(F.lit(1.3580986393225507))) == pytest.approx(0.05, abs=1e-9)


@pytest.fixture(scope="module")
def groups():
    """A hot group, tied values, a group of one sample, NULL groups, NaN and NULL values."""
    rng = random.Random(4)
    rows = [("hot", rng.random() < 0.3, rng.gauss(0, 1)) for _ in range(3000)]
    rows += [("tied", rng.random() < 0.5, float(rng.randint(0, 3))) for _ in range(400)]
    rows += [("one", True, 1.0), ("one", True, 2.0), ("single", False, 5.0), (None, True, 1.0), (None, False, 2.0), (None, False, 2.0)]
    rows += [("tied", None, 100.0), ("tied", True, None), ("tied", True, float("nan"))]
    rows += [(f"g{i}", bool(i % 2), float(i * j % 7)) for i in range(20) for j in range(i)]
    return rows


SCHEMA = "g string, first boolean, value double"


def by_group(rows):
    out = {}
    for g, first, v in rows:
        out.setdefault(g, []).append((first, v))
    return out


@pytest.mark.parametrize("ranges", [2, 64])
def test_two_sample_ks(spark, groups, ranges):
    got = {r.g: r for r in ds.two_sample_ks(spark.createDataFrame(groups, SCHEMA), "value", ["g"], F.col("first"), ranges).collect()}
    for g, rows in by_group(groups).items():
        fine = [(f, v) for f, v in rows if f is not None and v is not None and not math.isnan(v)]
        if not fine:
            assert g not in got
            continue
        a, b = ([v for f, v in fine if f is w] for w in (True, False))
        assert (got[g].n, got[g].m) == (len(a), len(b))
        if not a or not b:
            assert got[g].ks is None and got[g].p is None
            continue
        want = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for _, v in fine)
        assert got[g].ks == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("ranges", [2, 64])
def test_group_quantiles(spark, groups, ranges):
    shares = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {(r.g, r.share): r.quantile for r in ds.group_quantiles(spark.createDataFrame(groups, SCHEMA), "value", ["g"], shares, ranges).collect()}
    for g, rows in by_group(groups).items():
        values = [v for _, v in rows if v is not None and not math.isnan(v)]
        for s in shares:
            assert got[g, s] == pytest.approx(float(np.quantile(values, s)), abs=1e-12)


def test_quantile_bins_keep_every_row(spark, groups):
    rows = ds.quantile_bins(spark.createDataFrame(groups, SCHEMA), "value", ["g"], 4).collect()
    assert len(rows) == len(groups)
    values = {g: [v for _, v in x if v is not None and not math.isnan(v)] for g, x in by_group(groups).items()}
    for r in rows:
        if r.value is None or math.isnan(r.value):
            assert r.bin is None
        else:
            assert r.bin == sum(e < r.value for e in sorted({float(np.quantile(values[r.g], k / 4)) for k in (1, 2, 3)}))


@pytest.mark.parametrize("stretch", [7, 1 << 16])
def test_autocorrelations(spark, stretch):
    rng = random.Random(5)
    rows, n = [], {"long": 500, "short": 12, "tiny": 2, "flat": 30}
    for g, m in n.items():
        at = sorted(rng.sample(range(5 * m), m))
        rows += [(g, i, 1.0 if g == "flat" else rng.expovariate(1)) for i in at] + [(g, 10**6, None)]
    rng.shuffle(rows)
    got = {r.g: r for r in ds.ljung_box(ds.autocorrelations(spark.createDataFrame(rows, "g string, i long, x double"), "x", ["g"], "i", 4, stretch), 4).collect()}
    for g, m in n.items():
        x = np.array([v for _, _, v in sorted(r for r in rows if r[0] == g and r[2] is not None)])
        c = x - x.mean()
        assert got[g].n == m
        if g in ("tiny", "flat"):
            assert got[g].statistic is None and got[g].p is None
            continue
        r = [float(c[:-k] @ c[k:] / (c @ c)) for k in range(1, 5)]
        assert got[g].r == pytest.approx(r, abs=1e-12)
        q = m * (m + 2) * sum(v * v / (m - k) for k, v in enumerate(r, 1))
        assert got[g].statistic == pytest.approx(q, rel=1e-12)
        assert got[g].p == pytest.approx(math.exp(-q / 2) * (1 + q / 2), rel=1e-9)


def test_a_long_series_is_many_tasks(spark):
    """No stretch of a series sees more than its own rows and the lags after them."""
    df = spark.range(1000).select(F.lit("one").alias("g"), "id", F.rand(3).alias("x"))
    sizes = ds.numbered(df, ["g"], "id", 64).groupBy("_stretch").count().collect()
    assert max(r["count"] for r in sizes) == 64 and len(sizes) == 16


def test_t_tests_and_holm(spark):
    rng = random.Random(6)
    rows = [(f, k, rng.gauss(k / 4, 1)) for f in "ab" for k in range(5) for _ in range(30)] + [("a", 9, 1.0), ("b", 8, None)]
    tests = ds.t_tests(spark.createDataFrame(rows, "f string, k int, x double"), "x", ["f", "k"])
    got = {(r.f, r.k): r for r in ds.holm(tests, "p", ["f"], ["k"]).collect()}
    for f in "ab":
        ps = []
        for k in range(5):
            x = np.array([v for a, b, v in rows if (a, b) == (f, k)])
            assert got[f, k].t == pytest.approx(x.mean() * math.sqrt(len(x)) / x.std(ddof=1), rel=1e-12)
            ps.append((got[f, k].p, k))
        worst = 0.0
        for place, (p, k) in enumerate(sorted(ps)):
            worst = max(worst, min(1.0, (5 - place) * p))
            assert got[f, k].adjusted == pytest.approx(worst, rel=1e-12)
    assert got["a", 9].p is None and got["a", 9].adjusted is None and got["b", 8].t is None


def test_nested_fits(spark):
    """Groups by plain least squares; dependent predictors, a constant outcome, too few rows, and NULLs."""
    from tapeworks.operators.fits import nested_fits

    rng = np.random.default_rng(8)
    rows = [(g, *map(float, x), float(x @ [1.0, -2.0, 0.5] + 3 + e)) for g in range(4) for x, e in zip(rng.normal(size=(60, 3)), rng.normal(size=60))]
    rows += [(9, float(x), 2 * float(x), 0.0, 4 * float(x) + 1) for x in range(10)] + [(10, float(x), 1.0, 0.0, 5.0) for x in range(5)] + [(11, 1.0, 2.0, 3.0, 4.0), (None, 1.0, None, 2.0, 3.0), (0, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g long, a double, b double, c double, y double")
    got = {r.g: r for r in nested_fits(df, ["g"], ["a"], ["b", "c"], "y").collect()}
    for g in range(4):
        data = np.array([r[1:] for r in rows if r[0] == g and None not in r])
        design = np.column_stack([np.ones(len(data)), data[:, :3]])
        beta, rss, *_ = np.linalg.lstsq(design, data[:, 3], rcond=None)
        base = np.linalg.lstsq(design[:, :2], data[:, 3], rcond=None)[1]
        tss = ((data[:, 3] - data[:, 3].mean()) ** 2).sum()
        assert [got[g].intercept, *got[g].slopes] == pytest.approx(list(beta), abs=1e-9)
        assert (got[g].n, got[g].r_squared, got[g].base_r_squared) == (60, pytest.approx(1 - rss[0] / tss), pytest.approx(1 - base[0] / tss))
        assert got[g].f == pytest.approx((base[0] - rss[0]) / 2 / (rss[0] / 56))
    assert got[9].slopes == pytest.approx([0.8, 1.6, 0.0]) and got[9].r_squared == pytest.approx(1)
    assert got[10].r_squared is None and got[10].f is None and got[11].f is None and None not in got
