"""Point processes, order flow, coupling, estimators and files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks import schema
from tapeworks.functions import levels as lv
from tapeworks.operators import estimation as est
from tapeworks.operators import flow as fl
from tapeworks.operators import hawkes as hk
from tapeworks.schema import BUY, SELL
from tapeworks.sources import files
from tapeworks.sources import parameters as par

TOUCHES = {BUY: (1000, 3), SELL: (1001, 4)}
FOUR = hk.Hawkes(np.array([0.5, 0.3, 1.0, 1.0]), np.array([[0.8, 0.1, 0.2, 0.0], [0.1, 0.7, 0.0, 0.2], [0.2, 0.1, 0.5, 0.1], [0.1, 0.3, 0.1, 0.6]]), 2.5)


def test_expm_and_lyapunov():
    a = np.array([[0.0, 1.0], [-1.0, 0.0]])
    assert np.allclose(hk.expm(a * 2), [[math.cos(2), math.sin(2)], [-math.sin(2), math.cos(2)]])
    k, q = np.array([[-2.0, 0.5], [0.1, -1.0]]), np.array([[-1.0, 0.0], [0.0, -3.0]])
    v = hk.lyapunov(k, q)
    assert np.allclose(k @ v + v @ k.T, q)


def test_closed_forms():
    p = par.flow("resilient")
    assert round(p.branching_ratio, 6) == 0.6 and round(p.rates.sum(), 2) == 30.19
    assert round(p.endogenous_fraction(), 3) == 0.682 and abs(p.mean_cluster_size() - 3.149) < 1e-3
    assert round(p.signed_endogenous_fraction(fl.PRESSURE), 3) == -0.351
    assert round(par.flow("trending").signed_endogenous_fraction(fl.PRESSURE), 3) == 0.554
    assert math.isclose(p.mu.sum() * p.mean_cluster_size(), p.rates.sum())
    z = np.arange(6.0)
    f, c = p.forward_state(z, 1.3), p.forward_counts(z, 1.3)
    assert np.allclose(f["total"], f["stationary"] + f["deviation"]) and np.allclose(c["total"], c["stationary"] + c["deviation"])
    assert np.allclose(p.signed_excitation_at(fl.PRESSURE, 1e-6) / 1e-6, p.signed_excitation(fl.PRESSURE), rtol=1e-3)
    back = hk.Hawkes.from_rates(p.rates, p.a, p.beta, p.branching_ratio)
    assert np.allclose(back.mu, p.mu)


@pytest.mark.parametrize("bad", [dict(mu=[0.0, 0.0]), dict(mu=[-1.0, 1.0]), dict(a=[[5.0, 0.0], [0.0, 0.0]]), dict(beta=0.0), dict(a=[[1.0]])])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        hk.Hawkes(**{"mu": [1.0, 1.0], "a": [[0.1, 0.0], [0.0, 0.1]], "beta": 2.0} | bad)


def test_parameter_frames(spark):
    p = par.flow("asymmetric")
    again = hk.Hawkes.from_frame(p.to_frame(spark).orderBy(F.rand(1)))
    assert np.array_equal(again.a, p.a) and np.array_equal(again.mu, p.mu)
    text = par.to_json(p.to_frame(spark))
    assert np.array_equal(hk.Hawkes.from_frame(par.from_json(spark, text, schema.HAWKES)).a, p.a)
    with pytest.raises(ValueError):
        hk.Hawkes.from_frame(p.to_frame(spark).where("Component <> 1 or Cause <> 0"))
    m = par.marks("deep")
    assert par.Marks.from_frame(m.to_frame(spark)) == m
    for bad in ((0.0, 1.0, 1.0, 1), (0.5, 1.0, 0.0, 1), (0.5, 1.0, 1.0, 0)):
        with pytest.raises(ValueError):
            par.Marks(*bad)


@pytest.mark.parametrize("thinning", [False, True])
def test_simulated_paths(spark, thinning):
    paths = hk.simulate(spark, FOUR, 24, 150.0, 7, thinning=thinning).persist()
    rates = {r.type: r["count"] / (24 * 150) for r in paths.groupBy("type").count().collect()}
    assert all(abs(rates[k] / FOUR.rates[k] - 1) < 0.1 for k in range(4))
    again = hk.simulate(spark, FOUR, 24, 150.0, 7, thinning=thinning)
    assert paths.exceptAll(again).isEmpty()
    ks = hk.ks_exponential(hk.residuals(hk.replay(paths, FOUR.beta, 4, FOUR)), "residual", ["type"]).collect()
    assert all(est.kolmogorov_p(r.ks, r.n) > 0.001 for r in ks)


def test_a_continued_path_loses_nothing():
    whole = list(hk.Simulator(FOUR, hk.seeded(1, 1)).events(40.0))
    parts = hk.Simulator(FOUR, hk.seeded(1, 1))
    assert list(parts.events(15.0)) + list(parts.events(40.0)) == whole


def test_two_replays_agree(spark):
    paths = hk.simulate(spark, FOUR, 5, 20.0, 3)
    a = {(r.path_id, r.n): r.z for r in hk.replay(paths, 2.5, 4).collect()}
    b = {(r.path_id, r.n): [r[f"z{k}"] for k in range(4)] for r in hk.state_before(paths, 2.5, 4).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_scripted_counts(spark):
    path = spark.createDataFrame([(0, 0, 0.25, 1), (0, 1, 0.5, 0)], schema.PATHS)
    got = [(r.n0, r.n1) for r in hk.counts_on_clock(path, 2, [0.0, 0.25, 0.5, 1.0]).orderBy("t").collect()]
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1)]
    z = hk.state_on_clock(path, 1.0, 2, [0.25, 1.0], [1.0, 0.0]).orderBy("t").collect()
    assert math.isclose(z[0].z0, math.exp(-0.25)) and z[0].z1 == 0 and math.isclose(z[1].z0, math.exp(-1) + math.exp(-0.5))


def test_clustered_counts_are_overdispersed(spark):
    fano = lambda df: hk.fano(hk.counts_in_windows(df, 5.0, 400.0, ["path_id"]), ["path_id"]).agg(F.avg("fano")).first()[0]
    assert fano(hk.simulate(spark, par.flow("self_exciting"), 8, 400.0, 5)) > 2
    assert 0.7 < fano(hk.poisson_paths(spark, [1.0, 1.0], 8, 400.0, 5)) < 1.3
    sizes = hk.cluster_sizes(spark, par.flow("resilient"), 3000, 0, 1).agg(F.avg("size")).first()[0]
    want = float(np.ones(6) @ par.flow("resilient").resolvent[:, 0])
    assert abs(sizes / want - 1) < 0.1


@pytest.fixture(scope="module")
def pair(spark):
    paths = hk.simulate(spark, par.flow("balanced"), 6, 15.0, 2).persist()
    return paths, fl.coupled(paths, par.marks("unit"), 1, 5, TOUCHES, 60, 3, 2).persist()


def test_distance_identity(pair):
    rows = fl.distance_terms(pair[1], 5).collect()
    assert len(rows) > 200
    for r in rows:
        assert abs(r.distance - (r.imbalance_mismatch - r.touch_size_mismatch - r.depth_mismatch)) < 1e-9
        assert abs(r.cks_depth_mismatch) < 1e-9


def test_first_moves_and_counts(pair):
    paths, both = pair
    moves = {r.path_id: r.cks_n for r in fl.first_moves(both).where("mark_seed = 0").collect()}
    # Paths number events from 0, the pair from 1: its row 0 is the opening.
    counted = {r.path_id: r.n + 1 for r in fl.first_move_from_counts(paths, 5, 3, 4).collect()}
    assert {k: v for k, v in moves.items() if v is not None} == counted
    walks = {(r.path_id, r.n + 1): (r.bid_size, r.ask_size) for r in fl.touch_walks_from_counts(paths, 5, 3, 4).where("not moved").collect()}
    seen = {(r.path_id, r.n): (r.cks_bid_size, r.cks_ask_size) for r in fl.touch_walks(both).where("mark_seed = 0 and n > 0 and cks_bid_size is not null").collect()}
    assert seen == walks


def test_parting_is_where_mids_first_differ(pair):
    rows = {}
    for r in fl.mids(pair[1]).orderBy("n").collect():
        if r.discrepancy != 0:
            rows.setdefault((r.path_id, r.mark_seed), r.n)
    assert {(r.path_id, r.mark_seed): r.n for r in fl.parting(pair[1]).collect()} == rows
    clock = fl.mids_on_clock(pair[1], [0.0, 5.0])
    assert clock.where("at = 0 and cks_mid <> 1000.5").isEmpty()


def test_simulated_flow(spark):
    rows = fl.simulate_flow(spark, par.flow("resilient"), par.marks("resilient"), 3, 20.0, 4).persist()
    assert rows.where("emitted and bid >= ask").isEmpty()
    assert rows.where("not emitted and type < 4").isEmpty()
    late = fl.simulate_flow(spark, par.flow("resilient"), par.marks("resilient"), 3, 20.0, 4, warm_up=10.0)
    assert late.count() == rows.where("t > 10").count()


def test_variance_split():
    rng = np.random.default_rng(0)
    sample = rng.normal(size=(12, 4)) + rng.normal(size=(12, 1)) * 2
    rows = [(p, s, float(sample[p, s])) for p in range(12) for s in range(4)]
    from pyspark.sql import SparkSession

    df = SparkSession.getActiveSession().createDataFrame(rows, "path_id long, mark_seed long, d double").withColumn("t", F.lit(1))
    r = fl.variance_split(df, "d", ["t"]).first()
    placement = sample.var(axis=1, ddof=1).mean()
    flow = sample.mean(axis=1).var(ddof=1) - placement / 4
    assert np.allclose([r.placement_part, r.flow_part, r.total], [placement, flow, flow + placement])


def test_estimators_against_numpy(spark):
    rng = np.random.default_rng(1)
    n = 400
    x, z = rng.normal(size=n), rng.normal(size=n)
    y = 0.5 * x - 0.2 * z + rng.standard_normal(n).cumsum() * 0.05
    df = spark.createDataFrame([(0, k, k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(x, z, y))], "session_id long, seq long, ts_ns long, x double, z double, y double").withColumn("one", F.lit(1.0))
    fit = est.ols(df, ["one", "x", "z"], "y")
    design = np.column_stack([np.ones(n), x, z])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    e = y - design @ beta
    assert np.allclose(fit.coefficients, beta) and np.isclose(fit.r_squared, 1 - e @ e / ((y - y.mean()) @ (y - y.mean())))
    s = design * e[:, None]
    middle = s.T @ s
    for k in range(1, 8):
        c = s[k:].T @ s[:-k]
        middle = middle + (1 - k / 8) * (c + c.T)
    inverse = np.linalg.pinv(design.T @ design)
    assert np.allclose(est.hac_variance(df, fit, "y", 7, ["ts_ns", "seq"], ["session_id"]), inverse @ middle @ inverse)
    c = y - y.mean()
    products = est.lagged_products(df.withColumn("c", F.col("y") - F.lit(float(y.mean()))), "c", 2, 6, ["ts_ns", "seq"], ["session_id"])
    assert np.allclose(products, [c[k:] @ c[:-k] for k in range(2, 7)])
    doubled = est.ols(df.withColumn("x2", 2 * F.col("x")), ["x", "x2"], "y")
    assert np.allclose(doubled.coefficients, np.linalg.lstsq(np.column_stack([x, 2 * x]), y, rcond=None)[0])
    assert est.log_score_skill(df.withColumn("c", F.lit(1.0)).withColumn("k", (F.col("seq") % 3).cast("int")), df.withColumn("c", F.lit(1.0)).withColumn("k", (F.col("seq") % 3).cast("int")), "c", "k", 5, 10.0) == pytest.approx(0)
    small = df.where("seq < 60").select(F.floor(F.col("x") * 3).alias("a"), F.floor(F.col("y") * 3).alias("b"))
    a, b = (np.array([r[c] for r in small.collect()]) for c in ("a", "b"))
    da, db = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
    assert est.kendall_tau_b(small, "a", "b") == pytest.approx((da * db).sum() / math.sqrt((da**2).sum() * (db**2).sum()))
    # Continuous values, of which all pairs are distinct, and NULLs.
    pairs = df.where("seq < 300").select(F.when(F.col("seq") != 7, F.col("x")).alias("x"), "y")
    a, b = (np.array([r[c] for r in pairs.dropna().collect()]) for c in ("x", "y"))
    assert est.kendall_tau_b(pairs, "x", "y") == pytest.approx((np.sign(a[:, None] - a) * np.sign(b[:, None] - b)).sum() / (len(a) * (len(a) - 1)))
    assert math.isnan(est.kendall_tau_b(pairs.withColumn("y", F.lit(1)), "x", "y")) and math.isnan(est.kendall_tau_b(pairs.limit(0), "x", "y"))
    ranks, count = est.dense_ranks(pairs.dropna(), "x", 8)
    assert count == len(a) and [r["rank"] for r in ranks.orderBy("x").collect()] == list(range(len(a)))
    means = est.bootstrap_means(df, ["x"], 20, 50, 3).agg(F.avg("x")).first()[0]
    assert abs(means - x.mean()) < 0.2


def test_small_laws():
    assert est.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    assert est.student_t_cdf(2.228, 10) == pytest.approx(0.975, abs=1e-4)
    assert est.normal_cdf(1.96) == pytest.approx(0.975, abs=1e-4)


def plain_block(y):
    """The automatic block length from all correlations at once."""
    n, c = len(y), y - y.mean()
    most, run = min(n - 1, math.ceil(2 * math.sqrt(n))), max(5, math.ceil(math.sqrt(math.log10(n))))
    rho = np.array([c[k:] @ c[: n - k] / (c @ c) for k in range(1, most + 1)])
    quiet = np.abs(rho) < 2 * math.sqrt(math.log10(n) / n)
    cut = next((k for k in range(1, most - run + 2) if all(quiet[k - 1 : k - 1 + run])), most)
    g = s = 0.0
    for k in range(1, min(2 * cut, most) + 1):
        weight = 1.0 if k <= cut / 2 else 2 * (1 - k / cut) if k < cut else 0.0
        g, s = g + weight * k * rho[k - 1], s + weight * rho[k - 1]
    return min(n ** (1 / 3), max(1.0, ((2 * g / (1 + 2 * s)) ** 2 * n) ** (1 / 3)))


@pytest.mark.parametrize("memory,batch", [(0.0, 32), (0.6, 32), (0.6, 3), (0.97, 7), (0.999, 32)])
def test_automatic_block_length(spark, memory, batch):
    """From no memory to correlations that never die out, whatever the number of lags a pass."""
    rng = np.random.default_rng(5)
    y = np.zeros(700)
    for k in range(1, 700):
        y[k] = memory * y[k - 1] + rng.normal()
    df = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(y)], "session_id long, seq long, y double")
    n, length = est.automatic_block(df, "y", ["seq"], ["session_id"], batch)
    assert n == 700 and length == pytest.approx(plain_block(y))
    assert est.automatic_block(df.where("seq < 5"), "y", ["seq"], ["session_id"]) == (5, 1.0)
    assert est.automatic_block(df.withColumn("y", F.lit(1.0)), "y", ["seq"], ["session_id"]) == (700, 1.0)


def write_csv(path, rows):
    path.write_text("".join(",".join(map(str, r)) + "\n" for r in rows))


@pytest.fixture
def pair_of_files(tmp_path):
    def make(messages, books, depth=1):
        stem = f"{tmp_path}/TEST_2012-06-21_34200000_57600000_{{}}_{depth}.csv"
        write_csv(tmp_path / stem.format("message").rsplit("/", 1)[1], messages)
        write_csv(tmp_path / stem.format("orderbook").rsplit("/", 1)[1], books)
        return files.FilePair.parse(stem.format("message"))

    return make


def test_file_pair(spark, pair_of_files, tmp_path):
    rows = [("36754.716797047004", 1, 5, 10, 1000000 + 100 * k, 1 if k % 2 else -1) for k in range(3000)]
    books = [(1000200 + 100 * k, 10, 1000000 + 100 * k, 20) for k in range(2999)] + [(9999999999, 0, -9999999999, 0)]
    pair = pair_of_files(rows, books)
    assert (pair.ticker, pair.depth, pair.span) == ("TEST", 1, (34200.0, 57600.0))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = files.load_aligned(spark, pair).orderBy("row_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.row_no for r in got] == list(range(3000)) and all(r.Price == 1000000 + 100 * r.row_no for r in got)
    assert got[5].TimeNanoseconds == 36754716797047 and got[5].asks[0].price == 1000700 and got[-1].asks == []
    assert files.touch_prices(spark, pair).where("row_no = 7").first()[2:] == (1000900, 1000700)
    census = {r.depth: r.rows for r in files.file_census(spark, [pair]).collect()}
    assert census == {1: 3000} and files.count_rows(spark, pair.messages_path) == 3000
    with pytest.raises(ValueError):
        files.load_aligned(spark, pair, 1.0, 2.0)
    with pytest.raises(ValueError):
        files.load_aligned(spark, pair, 34200.0, 34201.0)
    with pytest.raises(ValueError, match="AskPrice1 of row 0"):
        files.prices_on_grid(files.read_orderbook(spark, pair.orderbook_path, 1), 1, 700)
    aligned = files.load_aligned(spark, pair)
    out = aligned.select("row_no", "TimeNanoseconds", "Type", "OrderID", "Size", "Price", "Direction", "asks", "bids")
    files.write_pair(out, str(tmp_path / "m"), str(tmp_path / "b"), 1)
    again = [line for p in sorted((tmp_path / "b").glob("part-*")) for line in p.read_text().splitlines()]
    assert again == [",".join(map(str, b)) for b in books]
    first = next(line for p in sorted((tmp_path / "m").glob("part-*")) for line in p.read_text().splitlines())
    assert first.startswith("36754.716797047,1,5,10,1000000")


@pytest.mark.parametrize("row", [("1.0", 8, 1, 5, 100, 1), ("1.0", 1, 1, 5, 100, 0), ("1.0", 1, 1, -5, 100, 1), ("1.0", 1, 1, 5, -2, 1)])
def test_rows_to_refuse(spark, pair_of_files, row):
    pair = pair_of_files([row], [(200, 1, 100, 1)])
    with pytest.raises(ValueError):
        files.load_aligned(spark, pair, 34200.0, 57600.0)


def test_text_in_a_number_column_and_uneven_files(spark, pair_of_files):
    with pytest.raises(Exception):  # noqa: B017
        files.read_messages(spark, pair_of_files([("1.0", 1, 1, "2.5", 100, 1)], [(200, 1, 100, 1)]).messages_path).collect()
    with pytest.raises(ValueError, match="2 messages and 1"):
        files.load_aligned(spark, pair_of_files([("34200.0", 1, 1, 5, 100, 1)] * 2, [(200, 1, 100, 1)]))


def test_prices_and_units(spark):
    assert files.price_unit(0.01) == 100
    with pytest.raises(ValueError):
        files.price_unit(0.00001)
    df = spark.createDataFrame([(100.01,), (3.5,)], "p double")
    assert [r.t for r in df.select(files.to_ticks(F.col("p"), 0.01).alias("t")).collect()] == [10001, 350]
    with pytest.raises(Exception, match="off the tick grid"):
        spark.createDataFrame([(100.013,)], "p double").select(files.to_ticks(F.col("p"), 0.01)).collect()
    assert lv.BUY == 1


@pytest.mark.parametrize("blocks", [1, 7, 64])
def test_exact_quantiles(spark, blocks):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=2000), np.full(900, 0.25), rng.integers(0, 5, 300)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    at = [0.0, 0.1, 1 / 3, 0.5, 0.75, 0.999, 1.0]
    assert est.exact_quantiles(df, "v", at, blocks) == pytest.approx(np.quantile(values, at).tolist(), abs=1e-12)
    assert est.exact_quantiles(df.where("v is null"), "v", at) == []
    assert est.exact_quantiles(df.where("v = 0.25"), "v", at) == [0.25] * len(at)


def test_idealised_flow_is_the_coupled_books(spark, pair):
    """The unit orders by themselves are those beside the marked ones, as far as the pair goes."""
    paths, both = pair
    alone = fl.idealised_flow(paths, 5, TOUCHES, 60).alias("a")
    b = both.where("mark_seed = 0").alias("b")
    same = alone.join(b, ["path_id", "n"]).select((F.struct("bid", F.col("bid_size").cast("double"), "ask", F.col("ask_size").cast("double")) == F.struct("cks_bid", "cks_bid_size", "cks_ask", "cks_ask_size")).alias("same"))
    got = same.groupBy("same").count().collect()
    assert [r["same"] for r in got] == [True] and got[0]["count"] == b.count()


@pytest.mark.parametrize("lag", [0, 1, 6, 40])
def test_hac_variance_of_short_groups(spark, lag):
    """Groups of 1 to 12 rows, shorter and longer than the lag."""
    rng = np.random.default_rng(lag)
    rows = [(g, k, k, float(a), float(b)) for g in range(1, 13) for k, (a, b) in enumerate(rng.normal(size=(g, 2)))]
    df = spark.createDataFrame(rows, "session_id long, seq long, ts_ns long, x double, y double").withColumn("one", F.lit(1.0))
    fit = est.ols(df, ["one", "x"], "y")
    middle = np.zeros((2, 2))
    for g in range(1, 13):
        own = np.array([(x, y) for s, _, _, x, y in rows if s == g])
        design = np.column_stack([np.ones(g), own[:, 0]])
        s = design * (own[:, 1] - design @ fit.coefficients)[:, None]
        middle += s.T @ s
        for k in range(1, min(lag, g - 1) + 1):
            c = s[k:].T @ s[:-k]
            middle += (1 - k / (lag + 1)) * (c + c.T)
    want = fit.gram_inverse @ middle @ fit.gram_inverse
    assert np.allclose(est.hac_variance(df, fit, "y", lag, ["ts_ns", "seq"], ["session_id"]), want)


def plain_replay(rows, beta, d):
    """The recursion event by event."""
    out, path = [], None
    for p, n, t, k in sorted(rows):
        if p != path:
            path, last, z, counts = p, 0.0, np.zeros(d), np.zeros(d)
        z = z * np.exp(-beta * (t - last))
        last = t
        out.append((p, n, z.copy(), counts.copy()))
        z[k] += 1
        counts[k] += 1
    return out


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_blocks_of_a_path_change_nothing(spark, block):
    """Paths of many lengths, one long; ties in time; blocks cut anywhere; batches that end within a block."""
    rng = np.random.default_rng(3)
    rows = []
    for p, n in enumerate([1, 6, 7, 8, 14, 500, 63, 64, 65]):
        t = np.sort(np.round(rng.exponential(1, n).cumsum(), 1))
        rows += [(p, i + 1, float(x), int(k)) for i, (x, k) in enumerate(zip(t, rng.integers(0, 3, n)))]
    beta, model = 0.7, hk.Hawkes(np.full(3, 0.2), np.full((3, 3), 0.1), 0.7)
    df = spark.createDataFrame(rows, "path_id long, n long, t double, type int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = sorted(map(tuple, hk.replay(df, beta, 3, model, block=block).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = plain_replay(rows, beta, 3)
    assert len(got) == len(want)
    for g, (p, n, z, counts) in zip(got, want):
        assert g[:2] == (p, n) and g[4] == pytest.approx(z, abs=1e-9) and g[5] == list(counts)
        assert g[6] == pytest.approx(model.mu + model.a @ z, abs=1e-9)
        assert g[7] == pytest.approx(model.mu * g[2] + model.a @ (counts - z) / beta, abs=1e-8)
    assert hk.replay(df.limit(0), beta, 3, model, block=block).count() == 0


def test_a_long_path_is_many_tasks(spark):
    """Blocks of one path are dealt to tasks; none of them reads the path."""
    df = spark.range(40_000).select(F.lit(0).alias("path_id"), F.col("id").alias("n"), (F.col("id") / 10).alias("t"), (F.col("id") % 3).cast("int").alias("type"))
    got = hk.replay(df, 0.5, 3, block=1000)
    sizes = got.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in sizes) == 40_000 and len(sizes) >= 6 and max(r["count"] for r in sizes) <= 12_000
    z = got.where("n = 39999").first().z
    assert sum(z) == pytest.approx(sum(np.exp(-0.5 * k / 10) for k in range(1, 2000)), abs=1e-9)


def test_affine_scan():
    rng = np.random.default_rng(1)
    a, b = rng.uniform(0, 1, 50), rng.normal(size=(50, 3))
    x, want = np.zeros(3), []
    for i in range(50):
        x = a[i] * x + b[i]
        want.append(x)
    assert np.allclose(hk.affine_scan(a, b), want)
    assert hk.affine_scan(a[:0], b[:0]).shape == (0, 3)


def test_compensators_on_a_clock_against_the_replay(spark):
    """At a tick, the compensator is what the sum over all events says; increments are per tick; errors are those of products."""
    rng = np.random.default_rng(5)
    rows = [(p, i, float(t), int(k)) for p in range(6) for i, (t, k) in enumerate(zip(np.sort(rng.uniform(0, 20, 40)), rng.integers(0, 2, 40)))]
    rows += [(9, 0, 25.0, 1)]  # nothing within the clock
    model = hk.Hawkes(np.array([0.3, 0.5]), np.array([[0.2, 0.1], [0.05, 0.3]]), 1.1)
    clock = [0.0, 2.5, 5.0, 12.0, 20.0]
    df = spark.createDataFrame(rows, "path_id long, n long, t double, type int")
    at = hk.compensators_on_clock(df, model, clock)
    got = {(r.path_id, r.t, r.type): (r.n, r.compensator) for r in at.collect()}
    for p in (*range(6), 9):
        mine = [(t, k) for q, _, t, k in rows if q == p]
        for tau in clock:
            gone = np.array([sum(1 - np.exp(-1.1 * (tau - t)) for t, k in mine if k == j and t <= tau) for j in (0, 1)])
            for j in (0, 1):
                n, c = got[p, tau, j]
                assert n == sum(k == j and t <= tau for t, k in mine)
                assert c == pytest.approx(model.mu[j] * tau + (model.a @ gone / 1.1)[j], abs=1e-9)
    inc = hk.martingale_increments(at)
    rows = {(r.path_id, r.t, r.type): r.increment for r in inc.collect()}
    assert len(rows) == 7 * 4 * 2
    a, b = (np.array([rows[p, tau, j] for p in (*range(6), 9) for tau in clock[1:]]) for j in (0, 1))
    a, b = a - a.mean(), b - b.mean()
    r = hk.increment_correlations(inc, 2).first()
    norm = np.sqrt((a @ a) * (b @ b))
    assert (r.windows, r.correlation, r.error) == (28, pytest.approx(a @ b / norm), pytest.approx(np.sqrt(((a * b) ** 2).sum()) / norm))
