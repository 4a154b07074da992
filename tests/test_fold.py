"""The matching kernel and its three drivers; replay and statistics agree with the fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.functions import levels as lv
from tapeworks.operators import fold, replay
from tapeworks.operators.matching import STORAGES, Book
from tapeworks.operators.session import MarketSession, statistics_frame
from tapeworks.schema import BUY, MARKET_BUY_PRICE, MARKET_SELL_PRICE, SELL, SUBMIT, WITHDRAW, SessionStatistics

COLUMNS = "session_id long, seq long, ts_ns long, size long, price long, direction int, kind int"


def random_messages(sessions=4, n=300, seed=0):
    rng, rows = np.random.default_rng(seed), []
    for s in range(sessions):
        t = 0
        for k in range(n):
            t += int(rng.integers(0, 3)) * 1_000_000_000
            d, u = (1 if rng.random() < 0.5 else -1), rng.random()
            size = int(rng.integers(1, 30)) * 10
            if u < 0.1:
                rows.append((s, k, t, size, MARKET_BUY_PRICE if d > 0 else MARKET_SELL_PRICE, d, SUBMIT))
            elif u < 0.7:
                rows.append((s, k, t, size, 1000 + int(rng.integers(-8, 9)), d, SUBMIT))
            else:
                rows.append((s, k, t, size, 1000 + int(rng.integers(-8, 9)), d, WITHDRAW))
    return rows


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(random_messages(), COLUMNS)


#: A book with a gap on each side, and what single messages (size, price, direction, kind) leave of it: levels that
#: differ, a size of 0 for one that is gone, and what stays unfilled.
BIDS, ASKS = {50: 30, 49: 20, 46: 10}, {53: 15, 54: 25, 58: 5}
CASES = {
    "rests between the touches": ((5, 51, BUY, SUBMIT), {51: 5}, {}, 0),
    "joins a level": ((7, 58, SELL, SUBMIT), {}, {58: 12}, 0),
    "opens a level in a gap": ((9, 48, BUY, SUBMIT), {48: 9}, {}, 0),
    "takes part of the touch": ((10, 60, BUY, SUBMIT), {}, {53: 5}, 0),
    "takes the touch and stops at its limit": ((40, 50, SELL, SUBMIT), {50: 0}, {50: 10}, 0),
    "takes two levels and rests": ((50, 55, BUY, SUBMIT), {55: 10}, {53: 0, 54: 0}, 0),
    "takes no more than asked across a gap": ((51, 46, SELL, SUBMIT), {50: 0, 49: 0, 46: 9}, {}, 0),
    "market order empties a side and rests where it last traded": ((70, MARKET_SELL_PRICE, SELL, SUBMIT), {50: 0, 49: 0, 46: 0}, {46: 10}, 0),
    "market order within a level": ((12, MARKET_BUY_PRICE, BUY, SUBMIT), {}, {53: 3}, 0),
    "withdraws a part": ((5, 49, BUY, WITHDRAW), {49: 15}, {}, 0),
    "withdraws a level": ((25, 54, SELL, WITHDRAW), {}, {54: 0}, 0),
    "withdraws more than rests": ((99, 46, BUY, WITHDRAW), {46: 0}, {}, 0),
    "withdraws where nothing rests": ((5, 47, BUY, WITHDRAW), {}, {}, 0),
}


@pytest.mark.parametrize("name", CASES)
def test_single_messages(name):
    message, bids, asks, unfilled = CASES[name]
    book = Book.of(BIDS, ASKS)
    out = book.apply(*message)
    kept = lambda now: {p: q for p, q in now.items() if q}
    assert (dict(book.levels(BUY)), dict(book.levels(SELL)), out.unfilled) == (kept(BIDS | bids), kept(ASKS | asks), unfilled)
    assert out.deltas == [(s, p, q) for s, p, q in out.deltas if (bids if s == BUY else asks)[p] == q] and len(out.deltas) == len(bids) + len(asks)
    other, gone = (ASKS, asks) if message[2] == BUY else (BIDS, bids)
    assert out.traded == sum(q - gone.get(p, q) for p, q in other.items()) * (message[3] == SUBMIT)


def test_market_order_without_an_other_side():
    book = Book.of({50: 30}, {})
    assert book.apply(60, MARKET_BUY_PRICE, BUY, SUBMIT).unfilled == 60 and dict(book.levels(BUY)) == {50: 30}


def test_rested_and_traded_rows_need_no_messages(spark, messages):
    """Direction and kind are read off the fold's own columns."""
    folded = fold.fold(messages, 3)
    kinds = {(r.session_id, r.seq): (r.direction, r.kind) for r in messages.collect()}
    rows = folded.collect()
    rested = {(r.session_id, r.seq): (r.price, r.resting) for r in fold.resting_frame(folded).collect()}
    traded = {(r.session_id, r.seq): (r.volume, r.signed, r.value) for r in fold.trade_rows(folded).collect()}
    assert len(traded) == len(rows)
    for r in rows:
        direction, kind = kinds[r.session_id, r.seq]
        own = [d for d in r.deltas if d.side == direction]
        want = (own[-1].price, own[-1].resting) if kind == SUBMIT and own else None
        assert rested.get((r.session_id, r.seq)) == want
        assert traded[r.session_id, r.seq] == (r.traded_size, direction * r.traded_size, r.traded_value)


def test_strict_withdrawal_and_crossed_books():
    with pytest.raises(ValueError):
        Book.of({1000: 5}, {}, strict=True).withdraw(6, 1000, BUY)
    assert Book.of({1000: 5}, {}).withdraw(6, 1000, BUY).withdrawn == 5
    with pytest.raises(ValueError):
        Book.of({1002: 5}, {1001: 5})


@pytest.mark.parametrize("storage", STORAGES)
def test_storages_agree(storage):
    """Every way to store a book does the same, level by level, over messages that empty and refill sides."""
    for seed in range(5):
        books = Book(), Book(storage=storage, band=(990, 1010))
        for _, _, _, size, price, d, kind in random_messages(1, 400, seed):
            a, b = (book.apply(size, price, d, kind) for book in books)
            assert a == b
            assert all(x.levels(side) == y.levels(side) and x.best(side) == y.best(side) for x, y in [books] for side in (BUY, SELL))
        assert books[1].copy().levels(BUY, 2) == books[0].levels(BUY, 2)


def test_storages_refuse_what_they_cannot_hold():
    with pytest.raises(ValueError, match="band"):
        Book(storage="ticks")
    with pytest.raises(ValueError, match="outside the band"):
        Book(storage="ticks", band=(990, 1010)).submit(5, 1011, BUY)
    assert Book(storage="ticks", band=(990, 1010)).withdraw(5, 1011, BUY).withdrawn == 0
    book = Book(storage="bitmap")
    book.submit(5, 1000, BUY)
    with pytest.raises(ValueError, match="bitmap"):
        book.submit(5, 1000 + (1 << 30), BUY)


def test_a_heap_sheds_stale_ranks():
    book = Book(storage="heap")
    for k in range(2000):
        book.submit(1, 1000 - k % 200, BUY)
        book.withdraw(1, 1000 - k % 200, BUY)
    assert book.sides[BUY].stale() <= 66 and book.best(BUY) is None


def brute(rows, depth):
    out, books = [], {}
    for s, k, t, size, price, d, kind in rows:
        book = books.setdefault(s, {1: {}, -1: {}})
        if kind == WITHDRAW:
            took = min(size, book[d].get(price, 0))
            traded = 0
            if took:
                book[d][price] -= took
        else:
            left, last, traded = size, None, 0
            while left and any(book[-d].values()):
                best = min((p for p, q in book[-d].items() if q), key=lambda p: p * d)
                if best * d > price * d:
                    break
                took = min(left, book[-d][best])
                book[-d][best] -= took
                left, last, traded = left - took, best, traded + took
            at = price if price not in (MARKET_BUY_PRICE, MARKET_SELL_PRICE) else last
            if left and at is not None:
                book[d][at] = book[d].get(at, 0) + left
        top = lambda side: sorted(((p, q) for p, q in book[side].items() if q), key=lambda x: -side * x[0])[:depth]  # noqa: B023, E731
        out.append((s, k, top(-1), top(1), traded))
    return out


def as_rows(df):
    return sorted((r.session_id, r.seq, [tuple(x) for x in r.asks], [tuple(x) for x in r.bids], r.traded_size) for r in df.collect())


def test_batch_fold(messages):
    assert as_rows(fold.fold(messages, 3)) == sorted(brute(random_messages(), 3))


def test_table_function_fold(messages):
    assert as_rows(fold.fold_by_table_function(messages, 3)) == as_rows(fold.fold(messages, 3))


def test_malformed_messages_are_refused(spark):
    for bad in ((0, 0, 0, -5, 1000, 1, 1), (0, 0, 0, 5, 1000, 0, 1), (0, 0, 0, 5, 1000, 1, 3)):
        with pytest.raises(Exception, match="malformed"):
            fold.fold(spark.createDataFrame([bad], COLUMNS), 3).collect()


def test_stream_fold(spark, messages, tmp_path):
    from tapeworks.streaming.fold import fold_stream

    early, late = messages.where("seq < 150"), messages.where("seq >= 150")
    for k, part in enumerate((early, late)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in"))
        q = fold_stream(stream, 3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert as_rows(got) == as_rows(fold.fold(messages, 3))


def test_bucket_stream(spark, tmp_path):
    from tapeworks.streaming.fold import bucket_stream

    rows = [(1, f"2024-01-01 00:00:{s:02d}", float(s)) for s in range(0, 60, 7)] + [(1, "2024-01-02 00:00:00", 0.0)]
    df = spark.createDataFrame(rows, "session_id long, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = bucket_stream(stream, "ts", "v", "10 seconds", "1 minute").writeStream.format("memory").queryName("buckets").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.v for r in spark.sql("select v from buckets").collect()}
    assert {7.0, 14.0, 28.0, 35.0, 49.0, 56.0} <= got | {0.0}


def test_replay_is_the_fold(spark, messages):
    folded = fold.fold(messages, 3)
    opening = spark.createDataFrame([], "session_id long, side int, price long, size long")
    again = replay.replay(opening, fold.levels_frame(folded), messages.select("session_id", "seq"), 3, block=32)
    key = lambda df: sorted((r.session_id, r.seq, [tuple(x) for x in r.asks], [tuple(x) for x in r.bids]) for r in df.collect())
    assert key(again) == key(folded)
    before = {(r.session_id, r.side, r.price): r["size"] for r in replay.opening_book(fold.levels_frame(folded), opening, 100).collect()}
    state = folded.where("seq = 99").collect()
    for r in state:
        assert all(before[r.session_id, -1, x.price] == x["size"] for x in r.asks)


def test_statistics_against_plain_python(messages):
    spec = SessionStatistics((1, 2, 5), (100, 400), (1, 10))
    folded = fold.fold(messages, 3).persist()
    stats = {(r.session_id, r.seq): r.asDict() for r in statistics_frame(folded, spec, 3, False).collect()}
    for r in folded.collect():
        s = stats[r.session_id, r.seq]
        asks, bids = {x.price: x["size"] for x in r.asks}, {x.price: x["size"] for x in r.bids}
        if asks and bids:
            a, b = min(asks), max(bids)
            assert (s["Spread"], s["MidPrice"], s["TouchDepth"]) == (a - b, (a + b) / 2, asks[a] + bids[b])
            assert abs(s["MicroPrice"] - (s["MidPrice"] + s["Spread"] / 2 * (bids[b] - asks[a]) / (bids[b] + asks[a]))) < 1e-9
            assert b < s["MicroPrice"] < a
        else:
            assert s["Spread"] is s["MidPrice"] is None
        for n in (1, 2, 5):
            na = sum(q for p, q in asks.items() if p < min(asks) + n) if asks else 0
            nb = sum(q for p, q in bids.items() if p > max(bids) - n) if bids else 0
            if s[f"QueueImbalance{n}Covered"] and na + nb:
                assert abs(s[f"QueueImbalance{n}"] - (nb - na) / (nb + na)) < 1e-12
        for q in (100, 400):
            cost = s[f"SweepCostBuy{q}"]
            if sum(asks.values()) >= q and bids:
                left, paid = q, 0
                for p in sorted(asks):
                    took = min(left, asks[p])
                    left, paid = left - took, paid + took * p
                assert abs(cost - (paid / q - s["MidPrice"])) < 1e-9 and cost >= s["Spread"] / 2 - 1e-9
            else:
                assert cost is None
        prices = sorted(asks)
        runs = [y - x - 1 for x, y in zip(prices, prices[1:]) if y - x > 1]
        assert (s["AskGapCount"], s["AskLargestGap"]) == (len(runs), max(runs, default=0))


def test_gap_ladder(spark):
    df = spark.createDataFrame([([(p, 10) for p in (100, 99, 97, 96, 93)],)], "bids array<struct<price: long, size: long>>")
    b = F.col("bids")
    r = df.select(lv.empty_grid_positions(b).alias("e"), lv.gap_count(b).alias("n"), lv.largest_gap(b).alias("l"), lv.grid_span(b).alias("s"), lv.first_gap_distance(b).alias("d"), lv.largest_gap_distance(b).alias("ld")).first()
    assert (r.e, r.n, r.l, r.s, r.d, r.ld) == ([3, 6, 7], 2, 2, 8, 2, 5)


def test_grid_and_column_imbalance(spark):
    rows = [([(p, (p - 100) * 10) for p in range(101, 106)], [(99, 40), (90, 60)])]
    kind = "array<struct<price: long, size: long>>"
    df = spark.createDataFrame(rows, f"asks {kind}, bids {kind}").select(F.slice("asks", 1, 2).alias("asks"), "bids")
    a, b = F.col("asks"), F.col("bids")
    r = df.select(lv.queue_imbalance(a, b, 2).alias("grid"), lv.column_sliced_imbalance(a, b, 2).alias("cols"), lv.imbalance_covered(a, b, 3, 2, True).alias("c3")).first()
    assert round(r.grid, 6) == 0.142857 and round(r.cols, 6) == 0.538462 and not r.c3


def test_a_session_without_trades_refuses_volume(messages):
    with pytest.raises(ValueError):
        MarketSession(messages, 3).trades
    with pytest.raises(ValueError):
        MarketSession(messages, 3).vwap(1)


def test_declaration_is_sorted_and_whole():
    spec = SessionStatistics((5, 1, 1), (100,), (10, 1))
    assert spec.imbalance_levels == (1, 5) and spec.windows == (1, 10)
    assert [f.name for f in spec.schema()] == [n for n, *_ in spec.declaration()]
    for bad in (0, 1.5, True, "1"):
        with pytest.raises(ValueError):
            SessionStatistics((bad,))
    assert SELL == -1


@pytest.mark.parametrize(("depth", "truncated"), [(1, True), (3, False), (6, True)])
def test_written_out_statistics_are_the_walked_ones(spark, depth, truncated):
    """Level by level or by walks over arrays, every statistic is the same; empty, short, full and gapped sides."""
    from tapeworks.operators.session import row_statistics, walked_statistics

    rng = np.random.default_rng(depth)

    def side(base, sign):
        n = int(rng.integers(0, depth + 1))
        steps = np.concatenate([[0], np.cumsum(rng.integers(1, 5, max(0, n - 1)))])[:n]
        return [(int(base + sign * s), int(rng.integers(1, 60)) * 10) for s in steps]

    kind = "array<struct<price: long, size: long>>"
    books = spark.createDataFrame([(k, side(1002, 1), side(1000, -1)) for k in range(300)], f"k long, asks {kind}, bids {kind}")
    spec = SessionStatistics((1, 2, 5), (50, 100, 400), (1,))
    new, old = (books.select("k", *(c.alias(n) for n, c in f(spec, depth, truncated).items())).orderBy("k").collect() for f in (row_statistics, walked_statistics))
    assert new == old and new[0].__fields__ == old[0].__fields__
    plan = books.select(*(c.alias(n) for n, c in row_statistics(spec, depth, truncated).items()))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan


@pytest.mark.parametrize("fan", [2, 8])
def test_covers_are_whole_and_small(spark, fan):
    """The nodes of a cover hold each block once and no other; every block finds its node; their number is logarithmic."""
    rng = np.random.default_rng(fan)
    spans = [(0, 1), (0, 0), (5, 5), (0, 1000), (1, 1000), (7, 8), (63, 65), (511, 513), (0, 512)] + [tuple(sorted(map(int, rng.integers(0, 5000, 2)))) for _ in range(60)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i long, a long, b long").select("i", replay.cover(F.col("a"), F.col("b"), fan).alias("nodes")).collect()
    above = {r.block: {(x.level, x.at) for x in r.nodes} for r in spark.range(5000).select(F.col("id").alias("block"), replay.nodes_above(F.col("id"), F.lit(4999), fan).alias("nodes")).collect()}
    for r in got:
        a, b = spans[r.i]
        nodes = {(x.level, x.at) for x in r.nodes}
        assert len(nodes) == len(r.nodes) <= 2 * (fan - 1) * max(1, int(np.ceil(np.log(max(b - a, 2)) / np.log(fan))) + 1)
        for block in (*range(max(0, a - 3), min(a + 40, 5000)), *range(max(0, b - 40), min(b + 3, 5000)), (a + b) // 2):
            assert len(nodes & above[block]) == (a <= block < b)


def test_a_quiet_level_costs_few_rows(spark):
    """One level that never changes over a session of two million rows, beside one that changes at every hundredth."""
    top = spark.createDataFrame([(1, 2_000_000)], "session_id long, top long")
    quiet = spark.createDataFrame([(1, 3, 1, 1000, 5)], "session_id long, seq long, side int, price long, resting long")
    busy = spark.range(0, 2_000_000, 100).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("seq"), F.lit(-1).alias("side"), F.lit(1001).cast("long").alias("price"), (F.col("id") % 7 + 1).alias("resting"))
    assert replay.intervals(quiet, top).count() <= 2 * 7 * 5
    assert replay.intervals(quiet.unionByName(busy), top).count() <= 2 * 7 * 5 + 2 * 20_000


@pytest.mark.parametrize(("block", "fan"), [(1, 2), (4, 2), (4, 8), (256, 8)])
def test_blocks_and_fans_change_nothing(spark, messages, block, fan):
    folded = fold.fold(messages, 50)
    deltas = fold.levels_frame(folded)
    live = replay.live_levels(deltas, messages.select("session_id", "seq"), block, fan)
    got = {(r.session_id, r.seq, r.side, r.price): r.resting for r in live.collect()}
    want = {(r.session_id, r.seq, d, x.price): x["size"] for r in folded.collect() for d, side in ((-1, r.asks), (1, r.bids)) for x in side}
    assert got == want
