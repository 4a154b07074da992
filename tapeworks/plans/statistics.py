"""Queries of the book statistics (STA) and of the read-only book accessors (FLD12-14, FLD17-18)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeworks.functions import bits
from tapeworks.functions import levels as lv
from tapeworks.operators.session import statistics_frame
from tapeworks.plans.registry import query
from tapeworks.schema import BUY, SELL, SessionStatistics
from tapeworks.sources.tape import DEPTH, book, sql, table, tape

KEYS = ["session_id", "seq"]
LEVELS, SWEEPS, TRUNCATED = (1, 2, 5), (100, 400), True

#: The touches before each row, the order flow contribution, the mid and its segments, in SQL.
FLOW = """lb AS (SELECT *, lag(bp1) OVER o AS pbp, lag(bs1) OVER o AS pbs, lag(ap1) OVER o AS pap, lag(as1) OVER o AS pas FROM bk WINDOW o AS (PARTITION BY session_id ORDER BY ts_ns, seq)),
    fw AS (SELECT *, CASE WHEN bp1 IS NOT NULL AND pbp IS NOT NULL AND ap1 IS NOT NULL AND pap IS NOT NULL THEN
        (CASE WHEN bp1 >= pbp THEN bs1 ELSE 0 END) - (CASE WHEN bp1 <= pbp THEN pbs ELSE 0 END) - (CASE WHEN ap1 <= pap THEN as1 ELSE 0 END) + (CASE WHEN ap1 >= pap THEN pas ELSE 0 END) END AS flow,
        (ap1 + bp1) / 2.0 AS mid, as1 + bs1 AS depth FROM lb),
    sg AS (SELECT *, CAST(sum(CASE WHEN mid IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM fw)"""


def sides() -> tuple[Column, Column]:
    return F.col("asks"), F.col("bids")


def _book_query(name: str, columns: Callable[[Column, Column], dict], expressions: dict[str, str], where: str = "") -> None:
    """Registers columns over the book, with their SQL over its wide form."""
    text = ", ".join(f"{x} AS {c}" for c, x in expressions.items())

    @query(name, sql(f"SELECT session_id, seq, {text} FROM bk {where}", "bk"))
    def run(spark, sf_dir):
        return book(spark, sf_dir).select(*KEYS, *(x.alias(c) for c, x in columns(*sides()).items()))


def _occupied(s: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {s}p{k} IS NULL THEN 0 ELSE 1 END" for k in range(1, DEPTH + 1)) + ")"


def _span(s: str) -> str:
    return f"CASE WHEN {s}p1 IS NULL THEN 0 ELSE abs(coalesce({s}p3, {s}p2, {s}p1) - {s}p1) + 1 END"


def _window(s: str, n: int) -> str:
    return "(" + " + ".join(f"CASE WHEN abs({s}p{k} - {s}p1) <= {n - 1} THEN {s}s{k} ELSE 0 END" for k in range(1, DEPTH + 1)) + ")"


def _imbalance(n: int) -> str:
    a, b = _window("a", n), _window("b", n)
    return f"CAST({b} - {a} AS DOUBLE) / nullif({b} + {a}, 0)"


def _covered(n: int) -> str:
    return " AND ".join(f"({_occupied(s)} = 0 OR {_span(s)} >= {n})" for s in "ab")


MID = "(ap1 + bp1) / 2.0"


def _filled(s: str, q: int) -> str:
    return f"(coalesce({s}s1, 0) + coalesce({s}s2, 0) + coalesce({s}s3, 0)) >= {q}"


def _sweep(s: str, q: int, d: int) -> str:
    before, value = "0", []
    for k in range(1, DEPTH + 1):
        value.append(f"coalesce(greatest(least({q} - ({before}), {s}s{k}), 0) * {s}p{k}, 0)")
        before += f" + coalesce({s}s{k}, 0)"
    return f"CASE WHEN {_filled(s, q)} THEN {d} * (({' + '.join(value)}) / {q}.0 - {MID}) END"


def _hole(s: str, k: int) -> str:
    return f"coalesce(abs({s}p{k + 1} - {s}p{k}) - 1, 0)"


def _largest(s: str) -> str:
    return f"greatest({_hole(s, 1)}, {_hole(s, 2)})"


def _first_distance(s: str) -> str:
    return f"CASE WHEN {_hole(s, 1)} > 0 THEN 1 WHEN {_hole(s, 2)} > 0 THEN abs({s}p2 - {s}p1) + 1 END"


def _first_size(s: str) -> str:
    return f"CASE WHEN {_hole(s, 1)} > 0 THEN {_hole(s, 1)} ELSE {_hole(s, 2)} END"


def _largest_distance(s: str) -> str:
    return f"CASE WHEN {_largest(s)} = 0 THEN NULL WHEN {_hole(s, 1)} = {_largest(s)} THEN 1 ELSE abs({s}p2 - {s}p1) + 1 END"


def _both(A: Column, B: Column, f) -> dict:
    return {"ask": f(A), "bid": f(B)}


def _both_sql(f) -> dict[str, str]:
    return {"ask": f("a"), "bid": f("b")}


def _long(x):
    return x.cast("long")


_book_query("STA01_spread", lambda A, B: {"spread": lv.spread(A, B)}, {"spread": "ap1 - bp1"})
_book_query("STA02_mid_price", lambda A, B: {"mid": lv.mid_price(A, B)}, {"mid": MID})
_book_query("STA03_micro_price", lambda A, B: {"micro": lv.micro_price(A, B)}, {"micro": "CAST(ap1 * bs1 + bp1 * as1 AS DOUBLE) / (as1 + bs1)"})
_book_query("STA04_queue_imbalance", lambda A, B: {f"i{n}": F.when(lv.imbalance_covered(A, B, n, DEPTH, TRUNCATED), lv.queue_imbalance(A, B, n)) for n in LEVELS}, {f"i{n}": f"CASE WHEN {_covered(n)} THEN {_imbalance(n)} END" for n in LEVELS})
_book_query("STA05_imbalance_profile", lambda A, B: {f"i{n}": F.get(lv.imbalance_profile(A, B, LEVELS), F.lit(k)) for k, n in enumerate(LEVELS)}, {f"i{n}": _imbalance(n) for n in LEVELS})
_book_query("STA06_imbalance_coverage", lambda A, B: {f"c{n}": lv.imbalance_covered(A, B, n, DEPTH, TRUNCATED) for n in LEVELS}, {f"c{n}": _covered(n) for n in LEVELS})
_book_query(
    "STA07_sweep_cost",
    lambda A, B: {f"{s}{q}": lv.sweep_cost(A, B, q, d) for q in SWEEPS for s, d in (("buy", BUY), ("sell", SELL))},
    {f"{s}{q}": _sweep(x, q, d) for q in SWEEPS for s, x, d in (("buy", "a", 1), ("sell", "b", -1))},
)
_book_query(
    "STA08_sweep_coverage",
    lambda A, B: {f"{s}{q}": lv.sweep_covered(A, B, q, d, DEPTH, False) for q in SWEEPS for s, d in (("buy", BUY), ("sell", SELL))},
    {f"{s}{q}": f"ap1 IS NOT NULL AND bp1 IS NOT NULL AND ({_filled(x, q)} OR {_occupied(x)} < {DEPTH})" for q in SWEEPS for s, x in (("buy", "a"), ("sell", "b"))},
)
_book_query("STA09_touch_depth", lambda A, B: {"depth": lv.touch_depth(A, B)}, {"depth": "as1 + bs1"})
_book_query("STA10_occupied_levels", lambda A, B: _both(A, B, lambda s: _long(F.size(s))), _both_sql(lambda s: f"CAST({_occupied(s)} AS BIGINT)"))
_book_query("STA11_grid_span", lambda A, B: _both(A, B, lv.grid_span), _both_sql(_span))
_book_query(
    "STA12_empty_grid_positions",
    lambda A, B: _both(A, B, lambda s: F.concat_ws(",", lv.empty_grid_positions(s).cast("array<string>"))),
    _both_sql(lambda s: f"coalesce(array_to_string(list_filter(range(1, {_span(s)} + 1), lambda i: i - 1 <> 0 AND i - 1 <> coalesce(abs({s}p2 - {s}p1), 0) AND i - 1 <> coalesce(abs({s}p3 - {s}p1), 0)), ','), '')"),
)
_book_query("STA13_gap_count", lambda A, B: _both(A, B, lambda s: _long(lv.gap_count(s))), _both_sql(lambda s: f"CAST(CASE WHEN {_hole(s, 1)} > 0 THEN 1 ELSE 0 END + CASE WHEN {_hole(s, 2)} > 0 THEN 1 ELSE 0 END AS BIGINT)"))
_book_query("STA14_largest_gap", lambda A, B: _both(A, B, lv.largest_gap), _both_sql(_largest))
_book_query(
    "STA15_first_gap",
    lambda A, B: {f"{n}_{w}": f(s) for n, s in (("ask", A), ("bid", B)) for w, f in (("distance", lv.first_gap_distance), ("size", lv.first_gap_size))},
    {f"{n}_{w}": f(s) for n, s in (("ask", "a"), ("bid", "b")) for w, f in (("distance", _first_distance), ("size", _first_size))},
)
_book_query("STA16_largest_gap_distance", lambda A, B: _both(A, B, lv.largest_gap_distance), _both_sql(_largest_distance))
_SIDE = [("occupied", lambda s: f"CAST({_occupied(s)} AS BIGINT)"), ("span", _span), ("largest_gap", _largest), ("first_gap_distance", _first_distance), ("first_gap_size", _first_size), ("largest_gap_distance", _largest_distance)]
_book_query(
    "STA17_side_statistics",
    lambda A, B: {f"{n}_{k}": lv.side_statistics(s)[k].cast("long") for n, s in (("ask", A), ("bid", B)) for k, _ in _SIDE},
    {f"{n}_{k}": f(s) for n, s in (("ask", "a"), ("bid", "b")) for k, f in _SIDE},
)
_book_query(
    "STA18_column_sliced_imbalance",
    lambda A, B: {f"i{n}": lv.column_sliced_imbalance(A, B, n) for n in (1, 2, 3)},
    {f"i{n}": "CAST({b} - {a} AS DOUBLE) / nullif({b} + {a}, 0)".format(**{s: "(" + " + ".join(f"coalesce({s}s{k}, 0)" for k in range(1, n + 1)) + ")" for s in "ab"}) for n in (1, 2, 3)},
)


def _double(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _bit(x: str) -> str:
    return f"CASE WHEN {x} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _frame_columns(spec: SessionStatistics) -> dict[str, str]:
    """Every declared statistic over the wide view `fw` and the window sums w<seconds>."""
    out = {"Spread": "ap1 - bp1", "MidPrice": MID, "MicroPrice": "CAST(ap1 * bs1 + bp1 * as1 AS DOUBLE) / (as1 + bs1)"}
    for n in spec.imbalance_levels:
        out |= {f"QueueImbalance{n}": f"CASE WHEN {_covered(n)} THEN {_imbalance(n)} END", f"QueueImbalance{n}Covered": _bit(_covered(n))}
    for q in spec.sweep_sizes:
        for side, s, d in (("Buy", "a", 1), ("Sell", "b", -1)):
            out |= {f"SweepCost{side}{q}": _sweep(s, q, d), f"SweepCost{side}{q}Covered": _bit(f"ap1 IS NOT NULL AND bp1 IS NOT NULL AND {_filled(s, q)}")}
    out |= {"OrderFlowContribution": "flow", "TouchDepth": "as1 + bs1"}
    for name, s in (("Bid", "b"), ("Ask", "a")):
        out |= {
            f"{name}OccupiedLevels": _occupied(s), f"{name}GapCount": f"(CASE WHEN {_hole(s, 1)} > 0 THEN 1 ELSE 0 END + CASE WHEN {_hole(s, 2)} > 0 THEN 1 ELSE 0 END)", f"{name}LargestGap": _largest(s),
            f"{name}FirstGapDistance": _first_distance(s), f"{name}FirstGapSize": _first_size(s), f"{name}LargestGapDistance": _largest_distance(s),
        }
    for w in spec.windows:
        out |= {f"OrderFlowImbalance{w}": f"w{w}.ofi", f"OrderFlowImbalance{w}Covered": _bit(f"w{w}.ofi IS NOT NULL"), f"AverageDepth{w}": f"w{w}.depth"}
    return {n: _double(x) if "Covered" not in n else x for n, x in out.items()}


FRAME = SessionStatistics(windows=(7200, 86400))
_SUMS = ", ".join(
    f"w{w} AS (SELECT a.session_id, a.seq, CASE WHEN count(*) = count(b.flow) THEN sum(b.flow) END AS ofi, CAST(sum(b.depth) AS DOUBLE) / nullif(2 * count(b.depth), 0) AS depth "
    f"FROM fw a JOIN fw b ON b.session_id = a.session_id AND b.ts_ns > a.ts_ns - {w}000000000 AND b.ts_ns <= a.ts_ns AND b.seq <= a.seq GROUP BY ALL)"
    for w in FRAME.windows
)


FRAME_SQL = "SELECT fw.session_id, fw.seq, fw.ts_ns, " + ", ".join(f'{x} AS "{n}"' for n, x in _frame_columns(FRAME).items()) + " FROM fw " + " ".join(f"JOIN w{w} ON w{w}.session_id = fw.session_id AND w{w}.seq = fw.seq" for w in FRAME.windows)
FRAME_CTES = FLOW + ", " + _SUMS


@query("STA19_statistics_frame", sql(FRAME_SQL, "bk", more=FRAME_CTES))
def statistics(spark, sf_dir):
    """Every declared statistic of a session, by the same functions as the single queries."""
    return statistics_frame(book(spark, sf_dir), FRAME, DEPTH, TRUNCATED)


@query(
    "STA20_bit_vocabulary",
    """WITH p AS (SELECT p_partkey, p_partkey * 37 % 4096 AS n FROM part),
    s AS (SELECT *, rtrim(CASE WHEN n = 0 THEN '0' ELSE ltrim(to_base(n, 2), '0') END, '0') AS core, ltrim(to_base(n, 2), '0') AS digits FROM p),
    g AS (SELECT *, list_filter(list_transform(string_split(core, '1'), lambda x: length(x)), lambda x: x > 0) AS runs FROM s)
    SELECT p_partkey, n, CASE WHEN n = 0 THEN NULL ELSE CAST(length(digits) - length(core) AS INTEGER) END AS zeros,
        CASE WHEN n = 0 THEN 0 ELSE n // CAST(2 ** (length(digits) - length(core)) AS BIGINT) END AS odd_part,
        CAST(CASE WHEN n = 0 THEN 0 ELSE len(runs) END AS INTEGER) AS gaps, CAST(CASE WHEN n = 0 THEN 0 ELSE coalesce(list_max(runs), 0) END AS INTEGER) AS largest,
        coalesce((SELECT sum(b) FROM (SELECT 2 ** i AS b FROM range(12) r(i) WHERE (n >> i) & 1 = 1 ORDER BY i DESC LIMIT 2)), 0)::BIGINT AS high2,
        coalesce((SELECT sum(b) FROM (SELECT 2 ** i AS b FROM range(12) r(i) WHERE (n >> i) & 1 = 1 ORDER BY i LIMIT 2)), 0)::BIGINT AS low2
    FROM g""",
)
def bit_vocabulary(spark, sf_dir):
    n = F.col("p_partkey") * 37 % 4096
    p = table(spark, sf_dir, "part").select("p_partkey", n.alias("n"))
    n = F.col("n")
    return p.select(
        "p_partkey", "n", bits.trailing_zeros(n).alias("zeros"), bits.discard_trailing_zeros(n).alias("odd_part"), bits.count_gaps(n).alias("gaps"),
        bits.largest_gap(n).alias("largest"), bits.keep_highest(n, 2).alias("high2"), bits.keep_lowest(n, 2).alias("low2"),
    )


@query(
    "STA21_bitmap_gaps",
    sql(f"SELECT session_id, seq, CAST(CASE WHEN {_hole('b', 1)} > 0 THEN 1 ELSE 0 END + CASE WHEN {_hole('b', 2)} > 0 THEN 1 ELSE 0 END AS INTEGER) AS gaps, CAST({_largest('b')} AS INTEGER) AS largest FROM bk", "bk"),
)
def bitmap_gaps(spark, sf_dir):
    """The gaps of the bid side read off a bit mask of its prices; equal to STA13 and STA14."""
    A, B = sides()
    low = F.array_min(F.transform(B, lambda x: x["price"]))
    mask = F.aggregate(B, F.lit(0).cast("long"), lambda s, x: s + F.pow(F.lit(2.0), x["price"] - low).cast("long"))
    return book(spark, sf_dir).select(*KEYS, bits.count_gaps(mask).alias("gaps"), bits.largest_gap(mask).cast("int").alias("largest"))


_book_query(
    "FLD12_best_prices",
    lambda A, B: {"bid": lv.best(B)["price"], "ask": lv.best(A)["price"], "bid_size": lv.best(B)["size"], "ask_size": lv.best(A)["size"]},
    {"bid": "bp1", "ask": "ap1", "bid_size": "bs1", "ask_size": "as1"},
)


def _grid(s: str, i: int) -> str:
    d = -1 if s == "b" else 1
    return "coalesce(" + ", ".join(f"CASE WHEN {s}p{k} = {s}p1 + {d * (i - 1)} THEN {s}s{k} END" for k in range(1, DEPTH + 1)) + ", 0)"


_book_query(
    "FLD13_grid_levels",
    lambda A, B: {f"{n}{w}{i}": f(s, i, d) for n, s, d in (("bid", B, BUY), ("ask", A, SELL)) for i in (1, 2, 3) for w, f in (("_price", lv.grid_price), ("_size", lv.grid_size))},
    {f"{n}{w}{i}": f for n, s, d in (("bid", "b", -1), ("ask", "a", 1)) for i in (1, 2, 3) for w, f in (("_price", f"{s}p1 + {d * (i - 1)}"), ("_size", _grid(s, i)))},
)


@query(
    "FLD14_occupied_levels",
    sql(
        "SELECT session_id, seq, side, level, price, size FROM ("
        + " UNION ALL ".join(f"SELECT session_id, seq, '{n}' AS side, {k} AS level, {s}p{k} AS price, {s}s{k} AS size FROM bk" for n, s in (("ask", "a"), ("bid", "b")) for k in (1, 2))
        + ") WHERE price IS NOT NULL",
        "bk",
    ),
)
def top_levels(spark, sf_dir):
    A, B = sides()
    both = F.explode(F.array(F.struct(F.lit("ask").alias("side"), lv.occupied_levels(A, 2).alias("l")), F.struct(F.lit("bid").alias("side"), lv.occupied_levels(B, 2).alias("l"))))
    rows = book(spark, sf_dir).select(*KEYS, both.alias("s")).select(*KEYS, "s.side", F.posexplode("s.l").alias("k", "x"))
    return rows.select(*KEYS, "side", (F.col("k") + 1).alias("level"), "x.price", "x.size")


@query("FLD17_invariants", sql("SELECT session_id, CAST(count(*) AS BIGINT) AS states, CAST(count(*) FILTER (WHERE ap1 <= bp1) AS BIGINT) AS crossed, CAST(count(*) FILTER (WHERE least(as1, as2, as3, bs1, bs2, bs3) <= 0) AS BIGINT) AS empty_levels FROM bk GROUP BY session_id", "bk"))
def invariants(spark, sf_dir):
    A, B = sides()
    empty = F.exists(F.concat(A, B), lambda x: x["size"] <= 0)
    return book(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("states"), F.count_if(lv.best(A)["price"] <= lv.best(B)["price"]).alias("crossed"), F.count_if(empty).alias("empty_levels"))


@query("FLD18_idealised_book", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, k AS level, 1000 - k + 1 AS bid, 1000 + n_nationkey % 3 + k AS ask, CAST(5 AS BIGINT) AS size FROM nation, range(1, 6) r(k)")
def idealised(spark, sf_dir):
    from tapeworks.operators.session import idealised_sides

    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    asks, bids = idealised_sides(F.lit(1000).cast("long"), 1001 + F.col("n_nationkey") % 3, 5, 5)
    rows = n.select("n_nationkey", F.posexplode(F.arrays_zip(bids.alias("b"), asks.alias("a"))).alias("k", "x"))
    return rows.select("n_nationkey", (F.col("k") + 1).cast("long").alias("level"), F.col("x.b.price").alias("bid"), F.col("x.a.price").alias("ask"), F.col("x.b.size").alias("size"))


@query("PRJ03_grid_prices", sql("SELECT session_id, seq, price FROM (SELECT session_id, seq, CASE WHEN e % 9 = 0 THEN 0 WHEN e % 9 = 1 THEN 9223372036854775807 ELSE price END AS price FROM tape) WHERE price NOT IN (0, 9223372036854775807)", "tape"))
def grid_prices(spark, sf_dir):
    e = F.col("event_id") % 9
    p = F.when(e == 0, F.lit(0).cast("long")).when(e == 1, F.lit((1 << 63) - 1)).otherwise(F.col("price"))
    return tape(spark, sf_dir).select(*KEYS, p.alias("price")).where(~bits.is_market_price(F.col("price")))
