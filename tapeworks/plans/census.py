"""Queries of sources, projections, censuses, coarsening, sorts and set operations (SRC, PRJ, AGG, SRT, SET)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeworks.functions import bits
from tapeworks.functions import levels as lv
from tapeworks.operators import census, figures, replay
from tapeworks.operators import estimation as est
from tapeworks.operators import hawkes as hk
from tapeworks.operators import windows as win
from tapeworks.operators.session import statistics_frame
from tapeworks.plans.registry import query
from tapeworks.plans.statistics import FLOW, sides
from tapeworks.plans.windows import DELTAS, ORDERS, delta_log
from tapeworks.schema import ASK_PADDING, BID_PADDING, SessionStatistics
from tapeworks.sources import files
from tapeworks.sources.tape import DEPTH, HOUR_NS, book, paths, sql, table, tape, tape_with_book, trades

KEYS = ["session_id", "seq"]
DAY = 24 * HOUR_NS


def _median(x: str) -> str:
    return f"quantile_cont(CAST({x} AS DOUBLE), 0.5)"


# Sources: the parsing rules applied to text made from the tables.


@query("SRC01_clock_text", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(l_extendedprice AS BIGINT) * 0 + l_orderkey % 86400 * 1000000000 + (l_partkey * 7919 + l_linenumber) % 1000000000 AS ns FROM lineitem")
def clock_text(spark, sf_dir):
    """Clocks written with twelve decimals and read back exactly to the nanosecond."""
    li = table(spark, sf_dir, "lineitem")
    text = F.format_string("%d.%09d%03d", F.col("l_orderkey") % 86400, (F.col("l_partkey") * 7919 + F.col("l_linenumber")) % 1_000_000_000, F.col("l_suppkey") % 1000)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", files.clock_ns(text).alias("ns"))


_NAMES = "SELECT c_custkey, 'T' || c_custkey AS ticker, DATE '2012-06-21' + CAST(c_custkey % 30 AS INTEGER) AS date, 34200000 AS start_ms, 57600000 AS end_ms, CAST(1 + c_custkey % 10 AS INTEGER) AS depth FROM customer"


@query("SRC03_file_names", f"SELECT c_custkey, ticker, CAST(date AS VARCHAR) AS date, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, depth FROM ({_NAMES})")
def file_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey"))
    day = F.date_add(F.lit("2012-06-21").cast("date"), (F.col("c_custkey") % 30).cast("int"))
    path = F.concat(F.lit("/data/T"), F.col("c_custkey").cast("string"), F.lit("_"), day.cast("string"), F.lit("_34200000_57600000_message_"), (1 + F.col("c_custkey") % 10).cast("string"), F.lit(".csv"))
    return c.select("c_custkey", *(x.alias(n) for n, x in files.name_columns(path).items())).withColumn("date", F.col("date").cast("string"))


def _wide() -> str:
    return ", ".join(f"coalesce({s}p{k} * 100, {pad}) AS {n}Price{k}, coalesce({s}s{k}, 0) AS {n}Size{k}" for k in range(1, DEPTH + 1) for s, n, pad in (("a", "Ask", ASK_PADDING), ("b", "Bid", BID_PADDING)))


@query("SRC02_wide_book", sql(f"SELECT session_id, seq, {_wide()} FROM bk", "bk"))
def wide_book(spark, sf_dir):
    return book(spark, sf_dir).select(*KEYS, *lv.to_wide(*sides(), DEPTH, 100))


@query("SRC15_round_trip", sql("SELECT session_id, seq, " + ", ".join(f"{s}p{k} AS {n}{k}" for s, n in (("a", "ask"), ("b", "bid")) for k in (1, 2, 3)) + " FROM bk", "bk"))
def round_trip(spark, sf_dir):
    """Arrays to the wide layout in file units and back to ticks."""
    wide = book(spark, sf_dir).select(*KEYS, *lv.to_wide(*sides(), DEPTH, 100))
    back = wide.select(*KEYS, lv.from_wide("Ask", DEPTH, 100).alias("asks"), lv.from_wide("Bid", DEPTH, 100).alias("bids"))
    return back.select(*KEYS, *(F.get(s, F.lit(k - 1))["price"].alias(f"{n}{k}") for s, n in (("asks", "ask"), ("bids", "bid")) for k in (1, 2, 3)))


@query("SRC04_window_slice", sql(f"SELECT t.session_id, t.seq, t.ts_ns, t.type, b.ap1 AS ask FROM tape t JOIN bk b USING (session_id, seq) WHERE t.ts_ns BETWEEN {1704067200000000000 + 5 * DAY} AND {1704067200000000000 + 9 * DAY}", "bk"))
def window_slice(spark, sf_dir):
    lo = 1704067200000000000 + 5 * DAY
    t = tape(spark, sf_dir).where(F.col("ts_ns").between(lo, lo + 4 * DAY))
    b = book(spark, sf_dir).select(*KEYS, lv.best(F.col("asks"))["price"].alias("ask"))
    return t.select(*KEYS, "ts_ns", "type").join(b, KEYS)


@query("SRC07_touch_prices", sql("SELECT session_id, seq, ts_ns, ap1 AS ask, bp1 AS bid FROM bk", "bk"))
def touches(spark, sf_dir):
    a, b = sides()
    return book(spark, sf_dir).select(*KEYS, "ts_ns", lv.best(a)["price"].alias("ask"), lv.best(b)["price"].alias("bid"))


@query("SRC10_delta_log", sql("SELECT session_id, seq, ts_ns, CAST(side AS INTEGER) AS side, price, resting FROM dl", "tape", more=DELTAS))
def delta_table(spark, sf_dir):
    return delta_log(spark, sf_dir)


@query("SRC12_parameter_pivot", "SELECT r AS component, CAST(CASE WHEN r = 0 THEN 0.2 ELSE 0.6 END AS DOUBLE) AS base, CAST(CASE WHEN r = 0 THEN 1.2 ELSE 0.4 END AS DOUBLE) AS cause_0, CAST(CASE WHEN r = 0 THEN 4.8 ELSE 0.8 END AS DOUBLE) AS cause_1 FROM range(2) t(r)")
def parameter_pivot(spark, sf_dir):
    from tapeworks.sources.parameters import flow

    long = flow("asymmetric").to_frame(spark)
    wide = long.groupBy(F.col("Component").alias("component")).pivot("Cause", [0, 1]).agg(F.first("Kernel"))
    base = long.where("Component = Cause").select(F.col("Component").alias("component"), F.col("BaseIntensity").alias("base"))
    return base.join(wide, "component").select("component", "base", F.col("0").alias("cause_0"), F.col("1").alias("cause_1"))


@query("SRC16_validation", sql("SELECT session_id, CAST(count(*) FILTER (WHERE type NOT BETWEEN 1 AND 4) AS BIGINT) AS bad_type, CAST(count(*) FILTER (WHERE size > 280) AS BIGINT) AS bad_size, CAST(count(*) FILTER (WHERE price % 200 <> 0) AS BIGINT) AS off_grid FROM tape GROUP BY session_id", "tape"))
def validation(spark, sf_dir):
    """Constraint violations counted in one pass."""
    return tape(spark, sf_dir).groupBy("session_id").agg(F.count_if(~F.col("type").between(1, 4)).alias("bad_type"), F.count_if(F.col("size") > 280).alias("bad_size"), F.count_if(F.col("price") % 200 != 0).alias("off_grid"))


# Projections and predicates.


@query("PRJ01_trading_window", sql(f"SELECT session_id, seq, ts_ns FROM tape WHERE ts_ns >= {1704067200000000000 + DAY} AND ts_ns <= {1704067200000000000 + 2 * DAY}", "tape"))
def trading_window(spark, sf_dir):
    lo = 1704067200000000000 + DAY
    return tape(spark, sf_dir).where(files.in_window(lo, lo + DAY, "ts_ns")).select(*KEYS, "ts_ns")


@query("PRJ02_first_off_grid", sql("SELECT session_id, min(seq) AS seq, arg_min(ap1, seq) AS price FROM bk WHERE ap1 % 7 <> 0 GROUP BY session_id", "bk"))
def off_grid(spark, sf_dir):
    p = lv.best(F.col("asks"))["price"]
    return book(spark, sf_dir).select(*KEYS, p.alias("p")).where("p % 7 <> 0").groupBy("session_id").agg(F.min("seq").alias("seq"), F.min_by("p", "seq").alias("price"))


@query("PRJ04_ticks", sql("SELECT session_id, seq, CASE WHEN e % 13 = 0 THEN NULL ELSE price // 100 END AS ticks FROM tape", "tape"))
def ticks(spark, sf_dir):
    padded = F.when(F.col("event_id") % 13 == 0, F.lit(ASK_PADDING)).otherwise(F.col("price"))
    return tape(spark, sf_dir).select(*KEYS, F.when(padded != ASK_PADDING, (padded / 100).cast("long")).alias("ticks"))


@query("PRJ05_executions_off_the_touch", sql("SELECT session_id, seq, type, price, touch FROM (SELECT *, 100 * CASE WHEN direction = 1 THEN lag(bp1) OVER o ELSE lag(ap1) OVER o END AS touch FROM bk WINDOW o AS (PARTITION BY session_id ORDER BY ts_ns, seq)) WHERE type = 4 AND price <> touch", "bk"))
def off_touch(spark, sf_dir):
    return census.executions_off_the_touch(tape_with_book(spark, sf_dir), 100)


@query(
    "PRJ06_price_reversing_orders",
    sql("SELECT session_id, order_no, CAST(count(*) AS BIGINT) AS fills, min(seq) AS first_row, max(seq) AS last_row FROM (SELECT *, (price - lag(price) OVER w) * -(lag(direction) OVER w) AS away FROM mo WHERE order_no >= 0 AND type = 4 WINDOW w AS (PARTITION BY session_id, order_no ORDER BY seq)) GROUP BY session_id, order_no HAVING min(away) < 0", "tape", more=ORDERS),
)
def reversing(spark, sf_dir):
    return census.price_reversing_orders(tape(spark, sf_dir))


_KEPT = "kp AS (SELECT *, type NOT IN (4, 5) OR (order_no >= 0 AND seq = max(seq) OVER (PARTITION BY session_id, order_no)) OR (order_no < 0 AND seq = 1) AS keep FROM mo)"


@query("PRJ07_retained_rows", sql("SELECT session_id, seq, type, order_no FROM kp WHERE keep", "tape", more=ORDERS + ", " + _KEPT))
def kept(spark, sf_dir):
    return census.retained(tape(spark, sf_dir)).select(*KEYS, "type", "order_no")


@query("PRJ08_common_rows", sql("SELECT session_id, seq FROM fw WHERE flow IS NOT NULL AND mid IS NOT NULL AND depth IS NOT NULL AND bp2 IS NOT NULL", "bk", more=FLOW))
def common(spark, sf_dir):
    b = F.col("bids")
    rows = book(spark, sf_dir).select(*KEYS, win.order_flow_contribution().alias("flow"), lv.mid_price(*sides()).alias("mid"), lv.touch_depth(*sides()).alias("depth"), F.get(b, F.lit(1))["price"].alias("second"))
    return rows.dropna().select(*KEYS)


@query("PRJ09_message_rules", sql("SELECT session_id, CAST(count(*) FILTER (WHERE direction NOT IN (1, -1) OR size < 0 OR price < 0) AS BIGINT) AS malformed FROM tape GROUP BY session_id", "tape"))
def message_rules(spark, sf_dir):
    bad = ~F.col("direction").isin(1, -1) | (F.col("size") < 0) | (F.col("price") < 0)
    return tape(spark, sf_dir).groupBy("session_id").agg(F.count_if(bad).alias("malformed"))


@query(
    "PRJ11_described_messages",
    sql(
        "SELECT session_id, seq, CASE WHEN type IN (2, 3) THEN 'withdraw ' || CASE WHEN direction > 0 THEN 'bid ' ELSE 'ask ' END ELSE CASE WHEN direction > 0 THEN 'buy ' ELSE 'sell ' END END || size || CASE WHEN type = 4 THEN ' at market' ELSE ' @ ' || price END AS said FROM tape",
        "tape",
    ),
)
def described(spark, sf_dir):
    d, s, p = F.col("direction"), F.col("size"), F.col("price")
    message = F.when(F.col("type") == 4, bits.market_order(s, d)).when(F.col("type").isin(2, 3), bits.withdrawal(s, p, d)).otherwise(bits.limit_order(s, p, d))
    rows = tape(spark, sf_dir).select(*KEYS, message.alias("m"))
    return rows.select(*KEYS, bits.describe_message(F.col("m.size"), F.col("m.price"), F.col("m.direction"), F.col("m.kind")).alias("said"))


@query("PRJ12_reflected", sql("SELECT session_id, seq, CASE WHEN e % 9 = 0 THEN 9223372036854775807 WHEN e % 9 = 1 THEN 0 ELSE 2002 - price // 100 END AS price, -direction AS direction FROM tape", "tape"))
def reflected(spark, sf_dir):
    e = F.col("event_id") % 9
    p = F.when(e == 0, F.lit(0).cast("long")).when(e == 1, F.lit((1 << 63) - 1)).otherwise((F.col("price") / 100).cast("long"))
    return tape(spark, sf_dir).select(*KEYS, bits.reflect_price(p, F.lit(1001).cast("long")).alias("price"), (-F.col("direction")).alias("direction"))


# Replay.

_LIVE = "lv AS (SELECT m.session_id, m.seq, i.side, i.price, i.resting, row_number() OVER (PARTITION BY m.session_id, m.seq, i.side ORDER BY i.side * i.price DESC) AS k FROM tape m JOIN iv i ON i.session_id = m.session_id AND m.seq >= i.seq AND m.seq < i.until WHERE i.resting > 0)"


@query(
    "FLD10_replayed_book",
    sql(
        "SELECT t.session_id, t.seq, "
        + ", ".join(f"max(l.price) FILTER (WHERE l.side = {d} AND l.k = {k}) AS {n}{k}, max(l.resting) FILTER (WHERE l.side = {d} AND l.k = {k}) AS {n}_size{k}" for n, d in (("ask", -1), ("bid", 1)) for k in (1, 2))
        + " FROM tape t LEFT JOIN lv l USING (session_id, seq) GROUP BY t.session_id, t.seq",
        "tape",
        more=DELTAS + ", " + _LIVE,
    ),
)
def replayed(spark, sf_dir):
    """The two best levels of each side at every message, from the sparse log alone."""
    opening = spark.createDataFrame([], "session_id long, side int, price long, size long")
    got = replay.replay(opening, delta_log(spark, sf_dir), tape(spark, sf_dir).select(*KEYS), 2)
    return got.select(*KEYS, *(F.get(s, F.lit(k - 1))[c].alias(f"{n}{x}{k}") for n, s in (("ask", "asks"), ("bid", "bids")) for k in (1, 2) for c, x in (("price", ""), ("size", "_size"))))


@query("FLD11_opening_book", sql("SELECT session_id, CAST(side AS INTEGER) AS side, price, size FROM (SELECT session_id, side, price, arg_max(resting, seq) AS size FROM dl WHERE seq < 60 GROUP BY ALL) WHERE size > 0", "tape", more=DELTAS))
def opening(spark, sf_dir):
    empty = spark.createDataFrame([], "session_id long, side int, price long, size long")
    return replay.opening_book(delta_log(spark, sf_dir), empty, 60)


# Censuses.


@query("AGG01_event_census", sql("SELECT session_id, " + ", ".join(f"CAST(count(*) FILTER (WHERE type = {k}) AS BIGINT) AS type_{k}" for k in range(1, 8)) + " FROM tape GROUP BY session_id", "tape"))
def agg01(spark, sf_dir):
    return census.event_census(tape(spark, sf_dir))


@query(
    "AGG03_touch_census",
    sql("SELECT session_id, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE s IS NULL) AS BIGINT) AS unquoted, CAST(count(*) FILTER (WHERE s < 0) AS BIGINT) AS crossed, CAST(count(*) FILTER (WHERE s = 0) AS BIGINT) AS locked, min(s) AS min_spread, max(s) AS max_spread FROM (SELECT session_id, ap1 - bp1 AS s FROM bk) GROUP BY session_id", "bk"),
)
def agg03(spark, sf_dir):
    return census.touch_census(book(spark, sf_dir))


@query(
    "AGG04_constraint_census",
    sql(
        "SELECT c AS constraint, CAST(count(r.type) AS BIGINT) AS rejected, coalesce(array_to_string(list_sort(list(DISTINCT r.type)), ','), '') AS codes FROM (VALUES ('even price'), ('small size'), ('any')) v(c) LEFT JOIN (SELECT 'even price' AS k, type FROM tape WHERE price % 200 <> 0 UNION ALL SELECT 'small size', type FROM tape WHERE size > 250) r ON r.k = v.c GROUP BY c",
        "tape",
    ).replace("codes FROM", "types FROM").replace("array_to_string(list_sort(list(DISTINCT r.type)), ',')", "array_to_string(list_transform(list_sort(list(DISTINCT r.type) FILTER (WHERE r.type IS NOT NULL)), lambda t: ['submission', 'cancellation', 'deletion', 'execution visible', 'execution hidden', 'cross trade', 'halt'][t]), ', ')"),
)
def agg04(spark, sf_dir):
    return census.constraint_census(tape(spark, sf_dir), {"even price": F.col("price") % 200 == 0, "small size": F.col("size") <= 250, "any": F.lit(True)})


@query(
    "AGG05_padding_census",
    sql("SELECT session_id, side, level, CAST(count(*) AS BIGINT) AS rows, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM (" + " UNION ALL ".join(f"SELECT session_id, ts_ns, '{n}' AS side, {k} AS level FROM bk WHERE {s}p{k} IS NULL" for s, n in (("a", "asks"), ("b", "bids")) for k in (1, 2, 3)) + ") GROUP BY ALL", "bk"),
)
def agg05(spark, sf_dir):
    return census.padding_census(book(spark, sf_dir), DEPTH)


@query("AGG06_clock_census", "SELECT CAST(length(split_part(t, '.', 2)) AS INTEGER) AS decimals, CAST(count(*) AS BIGINT) AS rows, arg_min(t, e) AS example FROM (SELECT event_id AS e, event_id % 86400 || CASE WHEN event_id % 5 = 0 THEN '' ELSE '.' || substr('123456789', 1, CAST(event_id % 5 AS INTEGER)) END AS t FROM events) GROUP BY 1")
def agg06(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    n = (F.col("event_id") % 5).cast("int")
    text = F.concat((F.col("event_id") % 86400).cast("string"), F.when(n == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lit("123456789").substr(F.lit(1), n))))
    return census.clock_census(e.withColumn("Time", text), row="event_id")


@query("AGG07_clock_origins", sql("SELECT o AS offset_s, CAST(count(DISTINCT ns) AS BIGINT) AS exact, CAST(count(DISTINCT t) AS BIGINT) AS as_doubles, CAST(count(*) FILTER (WHERE was_ns <> ns AND was_t = t) AS BIGINT) AS collisions, power(2.0, floor(log2(max(t))) - 52) AS spacing FROM (SELECT *, lag(ns) OVER w AS was_ns, lag(t) OVER w AS was_t FROM (SELECT session_id AS s, e, e * 37 AS ns, o, CAST(o AS DOUBLE) + e * 37 / 1e9 AS t FROM tape, (VALUES (CAST(0 AS BIGINT)), (1700000000)) v(o)) WINDOW w AS (PARTITION BY s, o ORDER BY ns, e)) GROUP BY o", "tape"))
def agg07(spark, sf_dir):
    rows = tape(spark, sf_dir).select("session_id", F.col("event_id").alias("seq"), (F.col("event_id") * 37).alias("ts_ns"))
    return census.clock_origin_census(rows, [0, 1_700_000_000])


@query(
    "AGG08_described_messages",
    sql(
        "SELECT session_id, CAST(count(*) AS BIGINT) AS messages, "
        + ", ".join(f"CAST(count(*) FILTER (WHERE type = {k}) AS BIGINT) AS type_{k}" for k in (1, 2, 3))
        + ", CAST(count(*) FILTER (WHERE type IN (2, 3)) AS DOUBLE) / nullif(count(*) FILTER (WHERE type = 1), 0) AS withdrawal_rate, (max(ts_ns) - min(ts_ns)) / 1e9 AS seconds, "
        + _median("gap")
        + " AS median_gap, CAST(count(*) FILTER (WHERE gap = 0) AS DOUBLE) / nullif(count(gap), 0) AS zero_gaps FROM (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY session_id ORDER BY ts_ns, seq) AS gap FROM tape) GROUP BY session_id",
        "tape",
    ),
)
def agg08(spark, sf_dir):
    return census.describe_messages(tape(spark, sf_dir))


@query(
    "AGG09_described_book",
    sql(
        "SELECT session_id, CAST(count(*) AS BIGINT) AS rows, avg(s) AS mean_spread, " + _median("s") + " AS median_spread, CAST(count(*) FILTER (WHERE s <= 1) AS DOUBLE) / count(*) AS one_tick_share, arg_min(m, seq) FILTER (WHERE m IS NOT NULL) AS first_mid, arg_max(m, seq) FILTER (WHERE m IS NOT NULL) AS last_mid, round(avg(i), 9) AS mean_imbalance, CAST(count(*) FILTER (WHERE s <= 0) AS BIGINT) AS crossed_or_locked FROM (SELECT session_id, seq, ap1 - bp1 AS s, (ap1 + bp1) / 2.0 AS m, CAST(coalesce(bs1, 0) - coalesce(as1, 0) AS DOUBLE) / nullif(coalesce(bs1, 0) + coalesce(as1, 0), 0) AS i FROM bk) GROUP BY session_id",
        "bk",
    ),
)
def agg09(spark, sf_dir):
    return census.describe_orderbook(book(spark, sf_dir))


_CONV = (
    ORDERS
    + """, rn AS (SELECT *, sum(CASE WHEN type = 4 AND pt = 4 AND pts = ts_ns AND pd = direction THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS run FROM lg),
    ll AS (SELECT session_id, 'instant and direction' AS convention, ts_ns || ':' || direction AS label, price FROM tape WHERE type = 4
        UNION ALL SELECT session_id, 'contiguous fills', CAST(run AS VARCHAR), price FROM rn WHERE type = 4 UNION ALL SELECT session_id, 'hidden absorbed', CAST(order_no AS VARCHAR), price FROM mo WHERE type = 4),
    oo AS (SELECT session_id, convention, label, count(*) AS fills, count(DISTINCT price) AS prices FROM ll GROUP BY ALL)"""
)


@query(
    "AGG10_market_order_census",
    sql("SELECT session_id, convention, CAST(sum(fills) AS BIGINT) AS executions, CAST(count(*) AS BIGINT) AS market_orders, CAST(count(*) FILTER (WHERE fills > 1) AS BIGINT) AS multi_fill, CAST(coalesce(sum(fills) FILTER (WHERE fills > 1), 0) AS BIGINT) AS fills_inside, CAST(max(fills) AS BIGINT) AS largest, CAST(count(*) FILTER (WHERE fills > 1 AND prices = 1) AS BIGINT) AS queue_splits FROM oo GROUP BY ALL", "tape", more=_CONV),
)
def agg10(spark, sf_dir):
    return census.market_order_census(tape(spark, sf_dir))


@query(
    "AGG11_execution_gaps",
    sql(
        "SELECT adjacency, CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (WHERE g = 0) AS BIGINT) AS same_instant, min(g) FILTER (WHERE g > 0) AS least_positive FROM (SELECT 'in the file' AS adjacency, ts_ns - pts AS g FROM (SELECT *, lag(type) OVER o AS pt, lag(ts_ns) OVER o AS pts, lag(price) OVER o AS pp, lag(direction) OVER o AS pd FROM tape WINDOW o AS (PARTITION BY session_id ORDER BY ts_ns, seq)) WHERE type = 4 AND pt = 4 AND price = pp AND direction = pd UNION ALL SELECT 'among the executions', ts_ns - pts FROM (SELECT *, lag(ts_ns) OVER o AS pts, lag(price) OVER o AS pp, lag(direction) OVER o AS pd FROM tape WHERE type = 4 WINDOW o AS (PARTITION BY session_id ORDER BY ts_ns, seq)) WHERE price = pp AND direction = pd) GROUP BY adjacency",
        "tape",
    ),
)
def agg11(spark, sf_dir):
    return census.execution_gap_census(tape(spark, sf_dir))


@query("AGG12_lit_trades", sql("SELECT session_id, seq, CASE WHEN type = 4 THEN size ELSE 0 END AS volume, CASE WHEN type = 4 THEN -direction * size ELSE 0 END AS signed, CASE WHEN type = 4 THEN size * price / 100.0 ELSE 0.0 END AS value FROM tape", "tape"))
def agg12(spark, sf_dir):
    return tape(spark, sf_dir).select(*KEYS, *(c.alias(n) for n, c in census.lit_trades(100).items()))


_COARSE = _KEPT + ", co AS (SELECT k.session_id, k.seq, k.order_no, coalesce(s.volume, 0) AS volume, coalesce(s.signed, 0) AS signed, coalesce(s.value, 0) AS value FROM kp k LEFT JOIN (SELECT session_id, order_no, CAST(sum(size) FILTER (WHERE type = 4) AS BIGINT) AS volume, CAST(sum(-direction * size) FILTER (WHERE type = 4) AS BIGINT) AS signed, sum(size * price / 100.0) FILTER (WHERE type = 4) AS value FROM mo WHERE order_no >= 0 GROUP BY ALL) s USING (session_id, order_no) WHERE k.keep)"


@query("AGG13_coarsened", sql("SELECT * FROM co", "tape", more=ORDERS + ", " + _COARSE))
def agg13(spark, sf_dir):
    return census.coarsened(tape(spark, sf_dir), 100).select(*KEYS, "order_no", "volume", "signed", "value")


@query(
    "AGG14_coarsening_report",
    sql(
        "SELECT 'volume' AS statistic, CAST(count(*) AS BIGINT) AS rows_compared, CAST(count(*) FILTER (WHERE f.v <> c.volume) AS BIGINT) AS rows_differing, CAST(coalesce(max(abs(f.v - c.volume)) FILTER (WHERE f.v <> c.volume), 0) AS DOUBLE) AS largest_difference, round((avg(c.volume) - avg(f.v)) / nullif(avg(f.v), 0), 9) AS relative_change FROM co c JOIN (SELECT session_id, seq, CASE WHEN type = 4 THEN size ELSE 0 END AS v FROM tape) f USING (session_id, seq)",
        "tape",
        more=ORDERS + ", " + _COARSE,
    ),
)
def agg14(spark, sf_dir):
    t = tape(spark, sf_dir)
    fine = t.select(*KEYS, census.lit_trades(100)["volume"].alias("volume"))
    return census.coarsening_report(fine, census.coarsened(t, 100), ["volume"])


@query(
    "AGG15_coarsening_totals",
    sql(
        "SELECT f.session_id, q AS quantity, CASE q WHEN 'rows' THEN f.n WHEN 'shares' THEN f.v WHEN 'traded value' THEN f.x WHEN 'VWAP' THEN f.x / nullif(f.v, 0) ELSE f.v / nullif(f.k, 0) END AS fine, CASE q WHEN 'rows' THEN c.n WHEN 'shares' THEN c.v WHEN 'traded value' THEN c.x WHEN 'VWAP' THEN c.x / nullif(c.v, 0) ELSE c.v / nullif(c.k, 0) END AS coarse FROM (SELECT session_id, CAST(count(*) AS DOUBLE) AS n, CAST(coalesce(sum(size) FILTER (WHERE type = 4), 0) AS DOUBLE) AS v, coalesce(sum(size * price / 100.0) FILTER (WHERE type = 4), 0.0) AS x, CAST(count(*) FILTER (WHERE type = 4 AND size > 0) AS DOUBLE) AS k FROM tape GROUP BY session_id) f JOIN (SELECT session_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(volume) AS DOUBLE) AS v, sum(value) AS x, CAST(count(*) FILTER (WHERE volume > 0) AS DOUBLE) AS k FROM co GROUP BY session_id) c USING (session_id), (VALUES ('rows'), ('shares'), ('traded value'), ('VWAP'), ('mean size')) v(q)",
        "tape",
        more=ORDERS + ", " + _COARSE,
    ),
)
def agg15(spark, sf_dir):
    return census.coarsening_totals(tape(spark, sf_dir), 100)


@query("AGG16_bucket_series", sql(f"SELECT session_id, t0 + (k + 1) * {DAY} AS ts_ns, arg_max(mid, seq) FILTER (WHERE true) AS value, arg_max(segment, seq) AS segment FROM (SELECT *, (ts_ns - t0) // {DAY} AS k FROM (SELECT *, min(ts_ns) OVER (PARTITION BY session_id) AS t0 FROM sg)) GROUP BY session_id, t0, k".replace("arg_max(mid, seq) FILTER (WHERE true)", "arg_max_null(mid, seq)"), "bk", more=FLOW))
def agg16(spark, sf_dir):
    mid = lv.mid_price(*sides())
    return win.bucket_series(win.aligned(book(spark, sf_dir), mid, mid.isNull()), DAY)


@query("AGG17_batch_vwap", sql("SELECT session_id, CAST(sum(value) AS DOUBLE) / sum(volume) AS vwap, round(avg(CAST(value AS DOUBLE) / volume), 6) AS mean_of_ratios FROM trades GROUP BY session_id", "trades"))
def agg17(spark, sf_dir):
    ratio = F.col("value").cast("double") / F.col("volume")
    return trades(spark, sf_dir).groupBy("session_id").agg((F.sum("value").cast("double") / F.sum("volume")).alias("vwap"), F.round(F.avg(ratio), 6).alias("mean_of_ratios"))


@query("AGG18_fano", sql("SELECT path_id, round(var_samp(n) / nullif(avg(n), 0), 9) AS fano FROM (SELECT g.path_id, g.w, count(p.n) AS n FROM (SELECT DISTINCT path_id, w FROM paths, range(25) r(w)) g LEFT JOIN paths p ON p.path_id = g.path_id AND p.t < 600 AND floor(p.t / 24) = g.w GROUP BY ALL) GROUP BY path_id", "paths"))
def agg18(spark, sf_dir):
    counts = hk.counts_in_windows(paths(spark, sf_dir), 24.0, 600.0, ["path_id"])
    return hk.fano(counts, ["path_id"]).select("path_id", F.round("fano", 9).alias("fano"))


@query("AGG19_batch_means", sql("SELECT session_id, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS error FROM (SELECT session_id, (seq - 1) // 20 AS b, avg(size) AS m FROM tape GROUP BY ALL) GROUP BY session_id", "tape"))
def agg19(spark, sf_dir):
    per = tape(spark, sf_dir).groupBy("session_id", F.floor((F.col("seq") - 1) / 20).alias("b")).agg(F.avg("size").alias("m"))
    got = hk.sample_mean(per, ["session_id"], ["m"])
    return got.select("session_id", F.round("m_mean", 6).alias("mean"), F.round("m_error", 6).alias("error"))


@query("AGG20_sample_means", sql("SELECT w, round(avg(n), 6) AS mean, round(stddev_samp(n) / sqrt(count(*)), 6) AS error, CAST(count(*) AS BIGINT) AS paths FROM (SELECT g.path_id, g.w, count(p.n) AS n FROM (SELECT DISTINCT path_id, w FROM paths, (VALUES (CAST(100.0 AS DOUBLE)), (300.0), (500.0)) v(w)) g LEFT JOIN paths p ON p.path_id = g.path_id AND p.t <= g.w GROUP BY ALL) GROUP BY w", "paths"))
def agg20(spark, sf_dir):
    counts = hk.counts_on_clock(paths(spark, sf_dir), 5, [100.0, 300.0, 500.0]).select("path_id", F.col("t").alias("w"), sum((F.col(f"n{k}") for k in range(5)), F.lit(0)).alias("n"))
    return counts.groupBy("w").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n") / F.sqrt(F.count("n")), 6).alias("error"), F.count("*").alias("paths"))


@query("AGG21_variance_split", sql("SELECT type, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(m)), 6) AS standard_error, round(var_samp(m) - avg(v / k) + avg(v), 6) AS total, round(var_samp(m) - avg(v / k), 6) AS flow_part, round(avg(v), 6) AS placement_part FROM (SELECT type, session_id, avg(size) AS m, var_samp(size) AS v, count(size) AS k FROM tape GROUP BY ALL) GROUP BY type", "tape"))
def agg21(spark, sf_dir):
    from tapeworks.operators.flow import variance_split

    got = variance_split(tape(spark, sf_dir), "size", ["type"], "session_id")
    return got.select("type", *(F.round(c, 6).alias(c) for c in ("mean", "standard_error", "total", "flow_part", "placement_part")))


@query("AGG22_placement_statistics", sql("SELECT type, round(avg(CASE WHEN flow = 0 THEN 1.0 ELSE 0.0 END), 9) AS behind, round(regr_slope(flow, depth), 9) AS slope FROM fw WHERE flow IS NOT NULL GROUP BY type", "bk", more=FLOW))
def agg22(spark, sf_dir):
    rows = tape_with_book(spark, sf_dir).select("type", win.order_flow_contribution().alias("flow"), lv.touch_depth(*sides()).alias("depth")).where("flow is not null")
    return rows.groupBy("type").agg(F.round(F.avg(F.when(F.col("flow") == 0, 1.0).otherwise(0.0)), 9).alias("behind"), F.round(F.regr_slope("flow", "depth"), 9).alias("slope"))


@query("AGG23_coverage", sql("SELECT session_id, n, round(1 - avg(CASE WHEN " + " AND ".join(f"({s}p1 IS NULL OR abs(coalesce({s}p3, {s}p2, {s}p1) - {s}p1) + 1 >= n)" for s in "ab") + " THEN 1.0 ELSE 0.0 END), 9) AS uncovered FROM bk, (VALUES (1), (2), (5)) v(n) GROUP BY ALL", "bk"))
def agg23(spark, sf_dir):
    stats = statistics_frame(book(spark, sf_dir), SessionStatistics((1, 2, 5), (100,), (7200,)), DEPTH, True)
    return figures.coverage(stats, (1, 2, 5)).select("session_id", "n", F.round("uncovered", 9).alias("uncovered"))


@query("AGG24_size_bins", sql("SELECT session_id, CASE WHEN size > 0 AND size <= 100 THEN '(0, 100]' WHEN size > 100 AND size <= 200 THEN '(100, 200]' END AS bin, CAST(count(*) AS BIGINT) AS count FROM tape GROUP BY ALL", "tape"))
def agg24(spark, sf_dir):
    return figures.size_bins(tape(spark, sf_dir), "size", [0, 100, 200], ["session_id"])


# Sorts, limits, set operations.


@query("SRT01_best_levels", sql("SELECT session_id, direction, price, size FROM (SELECT *, row_number() OVER (PARTITION BY session_id, direction ORDER BY direction * price DESC) AS k FROM (SELECT session_id, direction, price, CAST(sum(size) AS BIGINT) AS size FROM tape GROUP BY ALL)) WHERE k <= 3", "tape"))
def srt01(spark, sf_dir):
    per = tape(spark, sf_dir).groupBy("session_id", "direction", "price").agg(F.sum("size").alias("size"))
    k = F.row_number().over(Window.partitionBy("session_id", "direction").orderBy(F.desc(F.col("direction") * F.col("price"))))
    return per.withColumn("k", k).where("k <= 3").drop("k")


@query("SRT03_largest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def srt03(spark, sf_dir):
    """The hundred largest magnitudes: a top-k report."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SRT04_after", sql("SELECT path_id, n - 20 AS n, round(t - cut, 6) AS t, type FROM (SELECT *, max(t) FILTER (WHERE n = 20) OVER (PARTITION BY path_id) AS cut FROM paths) WHERE n > 20", "paths"))
def srt04(spark, sf_dir):
    cut = F.max(F.when(F.col("n") == 20, F.col("t"))).over(Window.partitionBy("path_id"))
    return paths(spark, sf_dir).withColumn("cut", cut).where("n > 20").select("path_id", (F.col("n") - 20).alias("n"), F.round(F.col("t") - F.col("cut"), 6).alias("t"), "type")


@query("SRT05_first_with", sql("SELECT session_id, min(seq) AS seq, arg_min(size, seq) AS size FROM tape WHERE type = 4 AND price > 101500 GROUP BY session_id", "tape"))
def srt05(spark, sf_dir):
    hit = F.when((F.col("type") == 4) & (F.col("price") > 101500), F.col("seq"))
    return tape(spark, sf_dir).groupBy("session_id").agg(F.min(hit).alias("seq"), F.min_by("size", hit).alias("size")).where("seq is not null")


@query("SET01_union", sql("SELECT session_id, 'ask' AS side, ap1 AS price FROM bk WHERE ap1 IS NOT NULL UNION ALL SELECT session_id, 'bid', bp1 FROM bk WHERE bp1 IS NOT NULL", "bk"))
def set01(spark, sf_dir):
    b = book(spark, sf_dir)
    one = lambda n, s: b.select("session_id", F.lit(n).alias("side"), lv.best(F.col(s))["price"].alias("price"))
    return one("ask", "asks").unionByName(one("bid", "bids")).where("price is not null")


@query("SET02_empty_positions", sql("SELECT session_id, seq, unnest(range(bp3, bp1 + 1)) AS price FROM bk WHERE bp3 IS NOT NULL EXCEPT ALL SELECT session_id, seq, unnest([bp1, bp2, bp3]) FROM bk WHERE bp3 IS NOT NULL", "bk"))
def set02(spark, sf_dir):
    _, b = sides()
    held = book(spark, sf_dir).where(F.size(b) == 3)
    prices = F.transform(b, lambda x: x["price"])
    return held.select(*KEYS, F.explode(F.array_except(F.sequence(F.array_min(prices), F.array_max(prices)), prices)).alias("price"))


@query("EST11_participation_ratio", sql("SELECT session_id, round(power(sum(CAST(size AS DOUBLE) * size), 2) / sum(CAST(size AS DOUBLE) * size * size * size), 6) AS ratio FROM tape GROUP BY session_id", "tape"))
def est11(spark, sf_dir):
    return tape(spark, sf_dir).groupBy("session_id").agg(F.round(est.participation_ratio(F.col("size").cast("double")), 6).alias("ratio"))


_DECLARED = "Spread MidPrice MicroPrice QueueImbalance1 QueueImbalance1Covered QueueImbalance2 QueueImbalance2Covered QueueImbalance5 QueueImbalance5Covered SweepCostBuy100 SweepCostBuy100Covered SweepCostSell100 SweepCostSell100Covered SweepCostBuy400 SweepCostBuy400Covered SweepCostSell400 SweepCostSell400Covered OrderFlowContribution TouchDepth BidOccupiedLevels BidGapCount BidLargestGap BidFirstGapDistance BidFirstGapSize BidLargestGapDistance AskOccupiedLevels AskGapCount AskLargestGap AskFirstGapDistance AskFirstGapSize AskLargestGapDistance OrderFlowImbalance1 OrderFlowImbalance1Covered AverageDepth1 OrderFlowImbalance10 OrderFlowImbalance10Covered AverageDepth10"


@query("SCH01_statistics_schema", f"SELECT CAST(i - 1 AS INTEGER) AS position, n AS name, CASE WHEN n LIKE 'OrderFlowImbalance%' OR n LIKE 'AverageDepth%' THEN 'window' WHEN n = 'OrderFlowContribution' THEN 'increment' ELSE 'configuration' END AS dependence, n LIKE '%Covered' AS covered FROM (SELECT unnest(string_split('{_DECLARED}', ' ')) AS n, unnest(range(1, 38)) AS i)")
def declared(spark, sf_dir):
    """The declared columns of a session's statistics, in order."""
    rows = [(k, n, d.value, flag) for k, (n, d, flag) in enumerate(SessionStatistics().declaration())]
    return spark.createDataFrame(rows, "position int, name string, dependence string, covered boolean")


