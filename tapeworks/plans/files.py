"""Queries that write a message and book file pair and read it back (SRC, AGG02), the remaining parameter and
process tables, and the fold of a stream."""

from __future__ import annotations

import numpy as np
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tapeworks import schema
from tapeworks.operators import flow as fl
from tapeworks.operators import fold
from tapeworks.operators import hawkes as hk
from tapeworks.operators.matching import Book
from tapeworks.plans.models import ORDER, STUDY, folded_sql, messages, study
from tapeworks.plans.registry import query
from tapeworks.schema import BUY, SELL, SessionStatistics
from tapeworks.sources import files
from tapeworks.sources import parameters as par
from tapeworks.sources.shared import shared_path
from tapeworks.sources.tape import DEPTH, sql, tape, tape_with_book
from tapeworks.streaming import fold as stf
from tapeworks.streaming import windows as stw

DAY_NS = 86_400_000_000_000
#: A file's clock counts from midnight; the tape's days become thousands of seconds.
_NS = "ts_ns // 86400000000000 % 1000 * 50000000000 + 34200000000000 + seq"


def written_pair(spark, sf_dir) -> files.FilePair:
    """Every session's rows, one after the other, as one pair in the shared folder."""
    rows = tape_with_book(spark, sf_dir)
    pair = files.FilePair(shared_path(spark, "pair"), "TAPE", "2024-01-01", 0, 10**9, DEPTH)
    clock = F.floor(F.col("ts_ns") / DAY_NS) % 1000 * 50_000_000_000 + 34_200_000_000_000 + F.col("seq")
    out = rows.select(
        F.col("event_id").alias("row_no"), clock.alias("TimeNanoseconds"), F.col("type").cast("long").alias("Type"), F.col("event_id").alias("OrderID"), F.col("size").alias("Size"),
        F.col("price").alias("Price"), F.col("direction").cast("long").alias("Direction"), "asks", "bids",
    )
    # Two files, and the edges of their ranges, are made of the rows; the tape is computed once for all.
    path = shared_path(spark, "rows")
    out.write.parquet(path)
    files.write_pair(spark.read.schema(out.schema).parquet(path), pair.messages_path, pair.orderbook_path, DEPTH, 100)
    return pair


_ROW = "row_number() OVER (ORDER BY e) - 1 AS row_no"


@query("SRC09_written_messages", sql(f"SELECT {_ROW}, {_NS} AS ns, CAST(type AS BIGINT) AS type, size, price, CAST(direction AS BIGINT) AS direction FROM tape", "tape"))
def written_messages(spark, sf_dir):
    got = files.validate(files.read_messages(spark, written_pair(spark, sf_dir).messages_path), files.MESSAGE_RULES)
    return got.select("row_no", F.col("TimeNanoseconds").alias("ns"), F.col("Type").alias("type"), F.col("Size").alias("size"), F.col("Price").alias("price"), F.col("Direction").alias("direction"))


@query("SRC04_aligned_pair", sql(f"SELECT {_ROW}, type, ap1 AS ask, bp1 AS bid FROM bk", "bk"))
def aligned_pair(spark, sf_dir):
    rows = files.session_rows(files.load_aligned(spark, written_pair(spark, sf_dir)), 100)
    return rows.select(F.col("seq").alias("row_no"), "type", F.get("asks", F.lit(0))["price"].alias("ask"), F.get("bids", F.lit(0))["price"].alias("bid"))


@query("SRC05_line_count", "SELECT CAST(count(*) AS BIGINT) AS lines FROM events")
def line_count(spark, sf_dir):
    n = files.count_rows(spark, written_pair(spark, sf_dir).orderbook_path)
    return spark.createDataFrame([(n,)], "lines long")


@query("SRC06_clock_column", sql(f"SELECT {_ROW}, {_NS} AS ns FROM tape", "tape"))
def clock_column(spark, sf_dir):
    return files.clock(spark, written_pair(spark, sf_dir).messages_path).select("row_no", F.col("TimeNanoseconds").alias("ns"))


@query(
    "SRC08_padding_census",
    sql("SELECT side, level, CAST(count(*) AS BIGINT) AS rows, min(r) AS first_row, max(r) AS last_row FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS side, {k} AS level, r FROM (SELECT *, row_number() OVER (ORDER BY e) - 1 AS r FROM bk) WHERE {s}p{k} IS NULL" for s, n in (("a", "Ask"), ("b", "Bid")) for k in (1, 2, 3)) + ") GROUP BY ALL", "bk"),
)
def padding(spark, sf_dir):
    return files.padding_census(files.read_orderbook(spark, written_pair(spark, sf_dir).orderbook_path, DEPTH), DEPTH)


@query("AGG02_file_census", "SELECT 'TAPE' AS ticker, '2024-01-01' AS date, CAST(3 AS INTEGER) AS depth, CAST(count(*) * 2 AS BIGINT) AS rows FROM events")
def file_census(spark, sf_dir):
    got = files.file_census(spark, [written_pair(spark, sf_dir)])
    return got.groupBy("ticker", F.col("date").cast("string").alias("date"), "depth").agg(F.sum("rows").alias("rows"))


@query("SRC11_json_round_trip", "SELECT CAST(type AS BIGINT) AS Component, CAST(cause AS BIGINT) AS Cause, CASE WHEN type = cause THEN CAST(baseline AS DOUBLE) END AS BaseIntensity, CAST(kernel AS DOUBLE) AS Kernel, CAST(" + str(par.DECAY) + " AS DOUBLE) AS Decay, name FROM (VALUES " + ", ".join(f"('{n}', {i}, {j}, {mu[i]}, {x})" for n, (mu, a) in (par.FLOWS | par.PAIRS).items() for i, row in enumerate(a) for j, x in enumerate(row)) + ") v(name, type, cause, baseline, kernel)")
def json_round_trip(spark, sf_dir):
    """The example processes written as JSON records and read back."""
    out = None
    for name in (*par.FLOWS, *par.PAIRS):
        again = par.from_json(spark, par.to_json(par.flow(name).to_frame(spark)), schema.HAWKES).withColumn("name", F.lit(name))
        out = again if out is None else out.unionByName(again)
    return out


@query("SRC13_mark_parameters", "SELECT CAST(a AS DOUBLE) AS " + schema.MARKS[0].name + ", CAST(b AS DOUBLE) AS " + schema.MARKS[1].name + ", CAST(c AS DOUBLE) AS " + schema.MARKS[2].name + ", CAST(d AS BIGINT) AS " + schema.MARKS[3].name + ", name FROM (VALUES " + ", ".join(f"{(n, *v)}" for n, v in par.MARKS.items()) + ") v(name, a, b, c, d)")
def mark_parameters(spark, sf_dir):
    out = None
    for name in par.MARKS:
        again = par.Marks.from_frame(par.marks(name).to_frame(spark)).to_frame(spark).withColumn("name", F.lit(name))
        out = again if out is None else out.unionByName(again)
    return out


@query("SRC17_price_units", "SELECT CAST(t AS DOUBLE) AS tick_size, CAST(round(t * 10000) AS BIGINT) AS unit FROM (VALUES (0.0001), (0.01), (0.05), (1.0)) v(t)")
def price_units(spark, sf_dir):
    return spark.createDataFrame([(t, files.price_unit(t)) for t in (0.0001, 0.01, 0.05, 1.0)], "tick_size double, unit long")


@query("PRJ10_checked_declarations", "SELECT * FROM (VALUES ('(1, 2)', FALSE), ('(0,)', TRUE), ('(1.5,)', TRUE), ('(True,)', TRUE)) v(levels, refused)")
def checked(spark, sf_dir):
    """Which declarations are refused."""
    rows = []
    for levels in ((1, 2), (0,), (1.5,), (True,)):
        try:
            SessionStatistics(levels)
            rows.append((str(levels), False))
        except ValueError:
            rows.append((str(levels), True))
    return spark.createDataFrame(rows, "levels string, refused boolean")


@query("FLD16_constructors", "SELECT book, CAST(price AS BIGINT) AS price, CAST(size AS BIGINT) AS size FROM (VALUES ('book', 1000, 5), ('book', 999, 7), ('book', 1002, 4), ('copy', 999, 7), ('copy', 1002, 4)) v(book, price, size)")
def constructors(spark, sf_dir):
    """A book built from levels, copied, and a level set to nothing in the copy."""
    book = Book.of({1000: 5, 999: 7}, {1002: 4})
    other = book.copy()
    other.sides[BUY].set(1000, 0)
    rows = [(n, p, s) for n, b in (("book", book), ("copy", other)) for d in (BUY, SELL) for p, s in b.levels(d)]
    return spark.createDataFrame(rows, "book string, price long, size long")


@query("HWK10_continued_paths")
def continued(spark, sf_dir):
    """Paths that start from a given state."""
    return hk.simulate(spark, par.flow("self_exciting"), 8, 20.0, 5, state=np.array([3.0, 0.0]))


@query("HWK17_fan")
def fan(spark, sf_dir):
    """Mean counts of a fan of paths on a clock beside their expectation."""
    p, z = par.flow("self_exciting"), np.array([1.0, 0.0])
    clock = [1.0, 5.0, 10.0]
    counts = hk.counts_on_clock(hk.simulate(spark, p, 64, 10.0, 9, state=z), 2, clock)
    means = hk.sample_mean(counts, ["t"], ["n0", "n1"])
    want = spark.createDataFrame([(t, *(float(x) for x in p.forward_counts(z, t)["total"])) for t in clock], "t double, want0 double, want1 double")
    return means.join(want, "t")


@query("SIM03_price_offsets")
def offsets(spark, sf_dir):
    """How limit orders and withdrawals of a simulated flow spread over prices."""
    rows = fl.simulate_flow(spark, par.flow("resilient"), par.marks("resilient"), 8, 30.0, 3, warm_up=10.0)
    return rows.where("emitted and type >= 2").groupBy("type").agg(F.count("*").alias("orders"), F.avg("size").alias("mean_size"), F.stddev_samp("price").alias("price_spread"))


@query(
    "REG08_result_table",
    sql(
        "SELECT 'tape' AS Configuration, 'order flow imbalance' AS Predictor, CAST(86400 AS DOUBLE) AS Window, CAST(86400 AS DOUBLE) AS Horizon, CAST(0 AS BIGINT) AS Seed, CAST(n AS BIGINT) AS Rows, round(i0, 9) AS Intercept, round(s1, 9) AS Slope, round(see / (n - 2) / sxx, 9) AS SlopeVariance, round(hac, 9) AS HacVariance, round(r2, 9) AS RSquared, round(see / (n - 2) / sxx * n / hac, 6) AS EffectiveSample "
        "FROM (SELECT any_value(n) AS n, any_value(i0) AS i0, any_value(s1) AS s1, any_value(r2) AS r2, any_value(sxx) AS sxx, sum(e * e) AS see, (sum(u * u) + 2 * ("
        + " + ".join(f"{6 - k} / 6 :: DOUBLE * sum(u * u{k})" for k in range(1, 6))
        + ")) / power(any_value(sxx), 2) AS hac FROM (SELECT *, "
        + ", ".join(f"lag(u, {k}) OVER o AS u{k}" for k in range(1, 6))
        + " FROM (SELECT session_id, ts_ns, seq, f.*, y - i0 - s1 * x AS e, (x - mx) * (y - i0 - s1 * x) AS u FROM st, (SELECT count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS s1, regr_intercept(y, x) AS i0, regr_r2(y, x) AS r2 FROM st) f) WINDOW o AS (PARTITION BY session_id ORDER BY ts_ns, seq)))",
        "bk",
        more=STUDY,
    ),
)
def results(spark, sf_dir):
    """One row of a fit in the declared result schema."""
    from tapeworks.operators import estimation as est

    rows = study(spark, sf_dir).withColumn("one", F.lit(1.0))
    fit = est.ols(rows, ["one", "x"], "y")
    hac = est.hac_variance(rows, fit, "y", 5, ORDER, ["session_id"])
    values = ("tape", "order flow imbalance", 86400.0, 86400.0, 0, fit.rows, float(fit.coefficients[0]), float(fit.coefficients[1]), float(fit.variance()[1, 1]), float(hac[1, 1]), fit.r_squared, est.effective_sample(fit, hac, 1))
    values = (*values[:6], *(round(float(v), 9) for v in values[6:11]), round(float(values[11]), 6))
    return spark.createDataFrame([values], schema.REGRESSION)


def _halves(spark, rows):
    """Rows before and from the middle of their time; they are computed once, however many streams take them."""
    path = shared_path(spark, "rows")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    low, high = rows.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    middle = ((low or 0) + (high or 0)) // 2
    return [rows.where(F.col("ts_ns") < middle), rows.where(F.col("ts_ns") >= middle)]


@query("STR01_stream_fold", folded_sql("SELECT session_id, seq, fill_count, traded_size, traded_value FROM fb"))
def stream_fold(spark, sf_dir):
    """The fold as a stream: two arrivals of messages, state kept between them. Its books have twenty prices."""
    columns = ["session_id", "seq", "fill_count", "traded_size", "traded_value"]
    return stw.run_in_parts(spark, _halves(spark, messages(spark, sf_dir)), lambda rows: stf.fold_stream(rows, DEPTH, columns=columns, shallow=True))


@query("STR02_tumbling_buckets", sql("SELECT session_id, epoch_us(w) AS bucket_us, arg_max(price, seq) AS price FROM (SELECT *, date_trunc('day', make_timestamp(ts_ns // 1000)) + INTERVAL 1 DAY AS w FROM tape) GROUP BY session_id, w", "tape"))
def stream_buckets(spark, sf_dir):
    """Daily buckets of a stream; a bucket that both arrivals touch is updated."""
    rows = tape(spark, sf_dir).select("session_id", "seq", "ts_ns", F.timestamp_micros((F.col("ts_ns") / 1000).cast("long")).alias("ts"), "price")
    got = stw.run_in_parts(spark, _halves(spark, rows), lambda s: stf.bucket_stream(s, "ts", "price", "1 day", "2 days", order="seq"), ["session_id", "ts"])
    return got.select("session_id", F.unix_micros("ts").alias("bucket_us"), "price")


def _valued(spark, sf_dir, value: str):
    return tape(spark, sf_dir).select("session_id", "seq", "ts_ns", F.col(value).cast("long").alias("value"))


@query("STR03_rolling_sums", sql(f"SELECT a.session_id, a.seq, CAST(sum(b.size) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS events FROM tape a JOIN tape b ON b.session_id = a.session_id AND b.ts_ns > a.ts_ns - {DAY_NS} AND b.ts_ns <= a.ts_ns AND b.seq <= a.seq GROUP BY ALL", "tape"))
def stream_rolling(spark, sf_dir):
    """Sums over (t - 24 h, t] of every row of a stream."""
    got = stw.run_in_parts(spark, _halves(spark, _valued(spark, sf_dir, "size")), lambda s: stw.rolling_stream(s, DAY_NS))
    return got.select("session_id", "seq", "total", "events")


@query("STR04_islands", sql("SELECT session_id, seq, CAST(sum(fresh) OVER (PARTITION BY session_id ORDER BY ts_ns, seq) AS BIGINT) AS island FROM (SELECT *, CASE WHEN direction IS NOT DISTINCT FROM lag(direction) OVER (PARTITION BY session_id ORDER BY ts_ns, seq) THEN 0 ELSE 1 END AS fresh FROM tape)", "tape"))
def stream_islands(spark, sf_dir):
    """Stretches of one direction in a stream."""
    return stw.run_in_parts(spark, _halves(spark, _valued(spark, sf_dir, "direction")), stw.island_stream).select("session_id", "seq", "island")


@query("STR05_late_rows", "SELECT * FROM (VALUES ('in order', FALSE), ('late', TRUE), ('again', TRUE)) v(arrival, refused)")
def stream_late(spark, sf_dir):
    """Whether a second arrival is refused: rows in order, rows before those already answered, the same rows again."""
    first, second = _halves(spark, _valued(spark, sf_dir, "size"))
    rows = []
    for name, parts in (("in order", [first, second]), ("late", [second, first]), ("again", [first, first])):
        try:
            stw.run_in_parts(spark, parts, lambda s: stw.rolling_stream(s, DAY_NS))
            rows.append((name, False))
        except StreamingQueryException:
            rows.append((name, True))
    return spark.createDataFrame(rows, "arrival string, refused boolean")


@query("STR06_repeated_deltas", folded_sql("SELECT session_id, CAST(side AS INTEGER) AS side, CAST(999 + i AS BIGINT) AS price, resting FROM (SELECT session_id, unnest(range(1, 21)) AS i, 1 AS side, unnest(bids) AS resting FROM (SELECT * FROM fb QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) = 1) UNION ALL SELECT session_id, unnest(range(1, 21)), -1, unnest(asks) FROM (SELECT * FROM fb QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) = 1)) WHERE resting > 0"))
def stream_deltas(spark, sf_dir):
    """The books that a log of changes leaves, every change delivered twice."""
    deltas = fold.levels_frame(fold.fold(messages(spark, sf_dir), 1))
    return fold.book_of_deltas(deltas.unionByName(deltas))


@query("FLD03_withdrawals", folded_sql("SELECT session_id, CAST(sum(took) AS BIGINT) AS withdrawn, CAST(sum(unfilled) AS BIGINT) AS unfilled FROM fb GROUP BY session_id"))
def withdrawals(spark, sf_dir):
    f = fold.fold(messages(spark, sf_dir), DEPTH)
    return f.groupBy("session_id").agg(F.sum("withdrawn").alias("withdrawn"), F.sum("unfilled").alias("unfilled"))


@query("SRC14_example_flows", "SELECT name, CAST(type AS INTEGER) AS type, CAST(cause AS INTEGER) AS cause, CAST(baseline AS DOUBLE) AS baseline, CAST(kernel AS DOUBLE) AS kernel FROM (VALUES " + ", ".join(f"('{n}', {i}, {j}, {mu[i]}, {x})" for n, (mu, a) in (par.FLOWS | par.PAIRS).items() for i, row in enumerate(a) for j, x in enumerate(row)) + ") v(name, type, cause, baseline, kernel)")
def example_flows(spark, sf_dir):
    """The example processes, one row a kernel entry."""
    rows = [(n, i, j, float(p.mu[i]), float(p.a[i, j])) for n in (*par.FLOWS, *par.PAIRS) for p in [par.flow(n)] for i in range(p.d) for j in range(p.d)]
    return spark.createDataFrame(rows, "name string, type int, cause int, baseline double, kernel double")


@query("HWK01_refused_parameters", "SELECT * FROM (VALUES ('plain', FALSE), ('shapes', TRUE), ('no decay', TRUE), ('negative baseline', TRUE), ('negative kernel', TRUE), ('no baseline', TRUE), ('not stationary', TRUE), ('not finite', TRUE)) v(parameters, refused)")
def refused_parameters(spark, sf_dir):
    """Which parameters make no process."""
    cases = {
        "plain": ([0.1, 0.2], [[0.5, 0.1], [0.0, 0.5]], 1.0),
        "shapes": ([0.1, 0.2], [[0.5]], 1.0),
        "no decay": ([0.1], [[0.0]], 0.0),
        "negative baseline": ([0.3, -0.1], [[0.0, 0.0], [0.0, 0.0]], 1.0),
        "negative kernel": ([0.1], [[-0.1]], 1.0),
        "no baseline": ([0.0], [[0.1]], 1.0),
        "not stationary": ([0.1], [[1.0]], 1.0),
        "not finite": ([float("inf")], [[0.1]], 1.0),
    }
    rows = []
    for name, values in cases.items():
        try:
            hk.Hawkes(*values)
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "parameters string, refused boolean")


@query(
    "HWK04_fractions_of_pairs",
    f"SELECT name, round(1 - (m1 + m2) / (r1 + r2), 9) AS endogenous_fraction, round((r1 + r2) / (m1 + m2), 9) AS cluster_size, round(((g11 - g21) * r1 + (g22 - g12) * r2) / (r1 + r2), 9) AS signed_fraction FROM (SELECT *, ((1 - g22) * m1 + g12 * m2) / ((1 - g11) * (1 - g22) - g12 * g21) AS r1, (g21 * m1 + (1 - g11) * m2) / ((1 - g11) * (1 - g22) - g12 * g21) AS r2 FROM (SELECT name, CAST(m1 AS DOUBLE) AS m1, CAST(m2 AS DOUBLE) AS m2, a11 / {par.DECAY} :: DOUBLE AS g11, a12 / {par.DECAY} :: DOUBLE AS g12, a21 / {par.DECAY} :: DOUBLE AS g21, a22 / {par.DECAY} :: DOUBLE AS g22 FROM (VALUES "
    + ", ".join(f"{(n, *mu, *a[0], *a[1])}" for n, (mu, a) in par.PAIRS.items())
    + ") v(name, m1, m2, a11, a12, a21, a22)))",
)
def fractions(spark, sf_dir):
    """How much of the two-type processes is their own doing, and how much of it pushes one way."""
    signs = np.array([1.0, -1.0])
    rows = [(n, *(round(float(x), 9) for x in (p.endogenous_fraction(), p.mean_cluster_size(), p.signed_endogenous_fraction(signs)))) for n in par.PAIRS for p in [par.flow(n)]]
    return spark.createDataFrame(rows, "name string, endogenous_fraction double, cluster_size double, signed_fraction double")
