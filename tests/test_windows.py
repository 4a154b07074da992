"""Event-time windows: stated cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import windows as win
from tapeworks.operators.session import MarketSession

S = 1_000_000_000


def frame(spark, rows, columns):
    return spark.createDataFrame([(0, k, t * S, *more) for k, (t, *more) in enumerate(rows)], f"session_id long, seq long, ts_ns long, {columns}")


def test_vwap_with_ties(spark):
    rows = [(1, 100, 100, 100200), (2, 100, 100, 100300), (2, 300, 300, 300000), (3, 100, 100, 100100)]
    df = frame(spark, rows, "volume long, signed long, value long")
    assert [r.vwap for r in MarketSession(df, 1, traded=df).vwap(S).orderBy("seq").collect()] == [1002, 1003, 1000.75, 1001]


@pytest.mark.parametrize("times,values,w,want", [([1, 1, 1], [10, 20, 30], 5, [10, 30, 60]), ([0, 1, 2], [100, 10, 1], 2, [100, 110, 11])])
def test_rolling_sum(spark, times, values, w, want):
    df = frame(spark, list(zip(times, values)), "v long")
    assert [r.s for r in df.select("seq", win.rolling_sum(F.col("v"), w * S).alias("s")).orderBy("seq").collect()] == want


@pytest.fixture(scope="module")
def series():
    rng = random.Random(4)
    t, rows = 0, []
    for _ in range(250):
        t += rng.choice([0, 0, 1, 1, 2, 5])
        rows.append((t, None if rng.random() < 0.05 else float(rng.randint(0, 9))))
    return rows


def brute(rows, f):
    seg, out = 0, []
    segs = []
    for _, v in rows:
        seg += v is None
        segs.append(seg)
    for k in range(len(rows)):
        out.append(f(k, segs))
    return out


def check(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b or a is not None and b is not None and abs(a - b) < 1e-9, (a, b)


def test_backward_and_forward(spark, series):
    df = win.aligned(frame(spark, series, "v double"), F.col("v"), F.col("v").isNull())
    rows = df.select(
        "seq", win.backward_sum(F.col("value"), 5 * S).alias("bs"), win.backward_change(5 * S).alias("bc"), win.forward_change(5 * S).alias("fc"), win.forward_change_to_next_event().alias("nx"),
    ).orderBy("seq").collect()
    t, v = [x for x, _ in series], [x for _, x in series]

    def back_sum(k, _):
        xs = [v[j] for j in range(k + 1) if t[j] > t[k] - 5]
        return None if None in xs else sum(xs)

    def back_change(k, g):
        j = max((j for j in range(len(t)) if t[j] <= t[k] - 5), default=None)
        return None if j is None or g[j] != g[k] or v[j] is None or v[k] is None else v[k] - v[j]

    def forward(k, g):
        j = max(j for j in range(len(t)) if t[j] <= t[k] + 5)
        return None if j <= k or g[j] != g[k] or v[j] is None or v[k] is None else v[j] - v[k]

    def following(k, g):
        return None if k + 1 == len(t) or g[k + 1] != g[k] or v[k] is None or v[k + 1] is None else v[k + 1] - v[k]

    for name, f in (("bs", back_sum), ("bc", back_change), ("fc", forward), ("nx", following)):
        check([r[name] for r in rows], brute(series, f))
    jumps = win.forward_jump_counts(df, 5 * S).orderBy("seq").collect()

    def ups(k, g):
        j = max(j for j in range(len(t)) if t[j] <= t[k] + 5)
        return None if j <= k else sum(g[i] == g[i - 1] and v[i] is not None and v[i - 1] is not None and v[i] > v[i - 1] for i in range(k + 1, j + 1))

    check([r.ups for r in jumps], brute(series, ups))


def test_buckets(spark, series):
    df = win.aligned(frame(spark, series, "v double"), F.col("v"), F.col("v").isNull())
    got = {r.ts_ns // S: (r.value, r.segment) for r in win.bucket_series(df, 10 * S).collect()}
    t0, want, seg = series[0][0], {}, 0
    for t, v in series:
        seg += v is None
        want[t0 + ((t - t0) // 10 + 1) * 10] = (v, seg)
    assert got == want


def test_market_orders(spark):
    # (instant, type, direction): edge hidden prints stay out, interior ones come in, a flip or another row ends a block.
    rows = [(1, 5, 1), (1, 4, 1), (1, 5, 1), (1, 4, 1), (1, 5, 1), (1, 4, -1), (1, 1, 1), (1, 4, -1), (2, 5, 1), (3, 4, 1), (4, 4, 1)]
    df = frame(spark, rows, "type int, direction int")
    assert [r.order_no for r in win.market_orders(df).orderBy("seq").collect()] == [-1, 0, 0, 0, -1, 1, -1, 2, -1, 3, 4]


def test_clock(spark):
    df = frame(spark, [(1, 5), (1, 6), (3, 7)], "v long")
    clock = spark.createDataFrame([(0, t * S) for t in (0, 1, 2, 3)], "session_id long, ts_ns long")
    at = lambda strict: [r.v for r in win.on_clock(df, clock, "v", F.lit(-1).cast("long"), strict).orderBy("ts_ns").collect()]
    assert at(False) == [-1, 6, 6, 7] and at(True) == [-1, -1, 6, 6]
