"""State of streams: it follows what a window or a book holds, and idle sessions leave none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import fold
from tapeworks.streaming import fold as stf
from tapeworks.streaming import windows as stw
from tests.test_fold import COLUMNS, random_messages

S = 1_000_000_000
ROWS = "session_id long, seq long, ts_ns long, value long"


@pytest.fixture
def arrivals(spark, tmp_path):
    """Runs an operator over parts that arrive one by one; gives the results so far and the rows of state after each."""

    def run(parts, schema, operator, variable="last"):
        kept = []
        for part in parts:
            spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
            stream = operator(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
            q.awaitTermination()
            state = spark.read.format("statestore").option("stateVarName", variable).option("flattenCollectionTypes", True).load(str(tmp_path / "check"))
            kept.append(state.count())
        return spark.read.parquet(str(tmp_path / "out")), kept

    return run


def plain_rolling(rows, window):
    return {(s, n): (sum(v for x, m, t, v in rows if x == s and m <= n and t > at - window), sum(1 for x, m, t, v in rows if x == s and m <= n and t > at - window)) for s, n, at, _ in rows}


def test_rolling_sums_over_many_arrivals(arrivals):
    """Windows that outlive several arrivals, rows that come and leave within one, and lists that are written anew."""
    rng, rows = np.random.default_rng(2), []
    for s in range(3):
        t = np.cumsum(rng.integers(0, 3, 120)) * S
        rows += [(s, k, int(x), int(v)) for k, (x, v) in enumerate(zip(t, rng.integers(-9, 9, 120)))]
    rows.sort(key=lambda r: r[2])
    cut = [0, 40, 41, 45, 200, 230, len(rows)]
    parts = [[r for r in rows if a * S <= r[2] < b * S] for a, b in zip([0, 10, 11, 14, 60, 90], [10, 11, 14, 60, 90, 10**6])]
    assert sum(map(len, parts)) == len(rows) and cut[-1] == len(rows)
    got, _ = arrivals([p for p in parts if p], ROWS, lambda s: stw.rolling_stream(s, 7 * S))
    assert {(r.session_id, r.seq): (r.total, r.events) for r in got.collect()} == plain_rolling(rows, 7 * S)


def test_state_of_a_window_shrinks(arrivals):
    """A burst leaves the window with the first row after it; what is stored follows."""
    burst, after = [(1, k, k, 1) for k in range(500)], [(1, 500 + k, 100 * S + k, 1) for k in range(3)]
    got, kept = arrivals([burst, after, [(1, 600, 200 * S, 1)]], ROWS, lambda s: stw.rolling_stream(s, S), "rows")
    assert kept[0] == 500 and kept[1] == 3
    assert got.where("seq = 600").first().events == 1


def test_idle_sessions_are_forgotten(arrivals):
    """A timer clears a session once others have gone on for long enough; it begins anew if it comes back."""
    parts = [
        [(s, k, (1 + k) * S, 1) for s in range(20) for k in range(5)],
        [(0, 10, 100 * S, 1)],  # moves the watermark past the idle time of the others
        [(0, 11, 101 * S, 1)],
        [(0, 12, 102 * S, 1), (7, 0, 103 * S, 1)],  # an order before the last one it had, yet a new session
    ]
    got, kept = arrivals(parts, ROWS, lambda s: stw.island_stream(s, idle_ns=30 * S))
    assert kept[0] == 20 and kept[2:] == [1, 2]
    rows = {(r.session_id, r.seq, r.ts_ns): r.island for r in got.collect()}
    assert len(rows) == 100 + 4 and rows[7, 0, 103 * S] == 1


def test_a_folded_session_closes_and_opens(spark, arrivals):
    """A book is stored level by level; a session that was idle opens with an empty one."""
    first = [(1, 0, S, 10, 1000, 1, 1), (1, 1, S, 20, 1003, -1, 1), (2, 0, S, 5, 999, 1, 1)]
    parts = [first, [(2, 1, 500 * S, 5, 998, 1, 1)], [(2, 2, 501 * S, 1, 997, 1, 1)], [(1, 2, 502 * S, 7, 1000, -1, 1)]]
    got, kept = arrivals(parts, COLUMNS, lambda m: stf.fold_stream(m, 5, idle_ns=60 * S), "levels")
    last = got.where("session_id = 1 and seq = 2").first()
    assert last.traded_size == 0 and [tuple(x) for x in last.asks] == [(1000, 7)] and last.bids == []
    assert kept == [3, 2, 3, 4]  # the two levels of the idle session are gone


def test_fold_over_many_arrivals(spark, arrivals):
    rows = random_messages(3, 200, seed=9)
    edges = sorted({r[2] for r in rows})
    parts = [[r for r in rows if a <= r[2] < b] for a, b in zip(edges[::25], [*edges[25::25], edges[-1] + 1])]
    got, _ = arrivals([p for p in parts if p], COLUMNS, lambda m: stf.fold_stream(m, 4))
    want = fold.fold(spark.createDataFrame(rows, COLUMNS), 4)
    key = lambda df: sorted((r.session_id, r.seq, str(r.asks), str(r.bids), str(r.fills), str(r.deltas), r.unfilled) for r in df.collect())
    assert key(got.select(want.columns)) == key(want)
    assert got.where(F.col("traded_size") > 0).count() > 0
