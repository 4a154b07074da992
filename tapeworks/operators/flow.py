"""Order flow from point-process events, and two placements of one path side by side.

A price depends on the book that the order meets, so drawing marks and folding happen in one task per
path; paths are independent rows and spread over the cluster. Everything a folded frame determines (first
moves, distances, splits) is a window or an aggregate afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.operators.hawkes import Hawkes, Simulator, seeded
from tapeworks.operators.matching import Book
from tapeworks.schema import BUY, MARKET_BUY_PRICE, MARKET_SELL_PRICE, SELL, SUBMIT, WITHDRAW
from tapeworks.sources.parameters import Marks

TYPES = ("market buy", "market sell", "limit buy", "limit sell", "withdraw buy", "withdraw sell")


def direction(kind: int) -> int:
    return BUY if kind % 2 == 0 else SELL


def pressure(kind: int) -> int:
    """The sign an event means for the mid: its direction, reversed for withdrawals."""
    return direction(kind) if kind < 4 else -direction(kind)


def direction_column(kind: Column) -> Column:
    return F.when(kind % 2 == 0, BUY).otherwise(SELL)


def pressure_column(kind: Column) -> Column:
    return direction_column(kind) * F.when(kind < 4, 1).otherwise(-1)


def lot_size(raw: Column, lot: int) -> Column:
    """A size rounded to lots, half to even, one lot at least."""
    return F.greatest(F.lit(lot).cast("long"), (F.rint(raw / lot) * lot).cast("long"))


def draw_size(m: Marks, rng: np.random.Generator) -> int:
    return max(m.lot, round(float(rng.lognormal(m.mean_log_size, m.sigma_log_size)) / m.lot) * m.lot)


def place_by_marks(book: Book, kind: int, m: Marks, reference: int, rng: np.random.Generator) -> tuple[int, int, int, int] | None:
    """The message (size, price, direction, kind) of an event; None for a withdrawal from an empty side.

    Limit orders quote a geometric number of ticks from the other side's best price, one tick inside it at
    the nearest; withdrawals pick a level in proportion to its size.
    """
    d = direction(kind)
    if kind < 2:
        return draw_size(m, rng), MARKET_BUY_PRICE if d == BUY else MARKET_SELL_PRICE, d, SUBMIT
    if kind < 4:
        size, other = draw_size(m, rng), book.best(-d)
        other = reference + d if other is None else other
        return size, max(1, other - d * int(rng.geometric(m.depth_decay))), d, SUBMIT
    levels = book.levels(d)
    if not levels:
        return None
    weights = np.array([s for _, s in levels], float)
    price, rests = levels[int(rng.choice(len(levels), p=weights / weights.sum()))]
    return min(draw_size(m, rng), rests), price, d, WITHDRAW


def simulate_flow(spark: SparkSession, p: Hawkes, m: Marks, paths: int, horizon: float, seed: int, reference: int = 1000, warm_up: float = 0.0) -> DataFrame:
    """(session_id, seq, t, type, emitted, size, price, direction, kind, bid, ask, traded): simulated sessions.

    Every event is a row, dropped ones too (emitted false). The rows of (warm_up, horizon] are returned.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rng, book, rows, seq = seeded(seed, int(path)), Book(), [], 0
                for t, kind in Simulator(p, rng).events(horizon):
                    message = place_by_marks(book, kind, m, reference, rng)
                    out = book.apply(*message) if message else None
                    if t > warm_up:
                        rows.append((int(path), seq, t, kind, message is not None, *(message or (None,) * 4), book.best(BUY), book.best(SELL), out.traded if out else 0))
                        seq += 1
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist([dict(zip(_FLOW.names, r)) for r in rows], _FLOW)
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(_FLOW.names, r)) for r in rows], _FLOW)

    return spark.range(paths).repartition(min(paths, spark.sparkContext.defaultParallelism * 4)).mapInArrow(run, "session_id long, seq long, t double, type int, emitted boolean, size long, price long, direction int, kind int, bid long, ask long, traded long")


_LONGS = ("session_id", "seq", "size", "price", "bid", "ask", "traded")
_FLOW = pa.schema(
    [(c, pa.int64() if c in _LONGS else pa.float64() if c == "t" else pa.bool_() if c == "emitted" else pa.int32()) for c in ("session_id", "seq", "t", "type", "emitted", "size", "price", "direction", "kind", "bid", "ask", "traded")]
)


class Breach(Exception):
    """The next unit event cannot be placed and keep the idealised book."""


def idealised(depth: int, touches: dict[int, tuple[int, int]], levels: int, unit: int = 1) -> Book:
    """`levels` contiguous prices a side, `depth` on each behind a touch of 1..depth, all sizes times `unit`."""
    (bid, nb), (ask, na) = touches[BUY], touches[SELL]
    if bid >= ask or levels < 1 or not 1 <= nb <= depth or not 1 <= na <= depth:
        raise ValueError(f"no idealised book has touches {touches} at depth {depth} and {levels} levels")
    side = lambda at, n, d: {at: n * unit} | {at - d * k: depth * unit for k in range(1, levels)}
    return Book.of(side(bid, nb, BUY), side(ask, na, SELL))


def place_idealised(book: Book, kind: int, depth: int) -> tuple[int, int, int, int]:
    """A unit order at the touches that keeps every level behind a touch at `depth`."""
    d = direction(kind)

    def taken_from(side: int) -> int:
        touch = book.best(side)
        if touch is None or book.size_at(side, touch) == 1 and not book.size_at(side, touch - side):
            raise Breach(f"the {'bid' if side == BUY else 'ask'} side would empty")
        return touch

    if kind < 2:
        return 1, taken_from(-d), d, SUBMIT
    if kind >= 4:
        return 1, taken_from(d), d, WITHDRAW
    touch = book.best(d)
    if book.size_at(d, touch) < depth:
        return 1, touch, d, SUBMIT
    inside = touch + d
    return 1, taken_from(-d) if inside == book.best(-d) else inside, d, SUBMIT


_PAIR = "path_id long, mark_seed long, n long, t double, type int, " + ", ".join(f"{b}_{c} {k}" for b in ("cks", "haw") for c, k in (("bid", "long"), ("bid_size", "double"), ("ask", "long"), ("ask_size", "double"))) + ", breach string"


def coupled(paths: DataFrame, m: Marks, unit: int, depth: int, touches: dict[int, tuple[int, int]], levels: int, seed: int, mark_seeds: int = 1) -> DataFrame:
    """One path in two books: unit orders that keep the idealised book (cks) and marked orders (haw).

    A row an event and mark seed: the touches of both after it, sizes in units. n = 0 is the opening; a path
    stops before the first event that would empty a side, and its last row then names the breach.
    """

    class Pair:
        """One path under one mark seed, an event at a time; a row is given when the next event is known to follow."""

        def __init__(self, path, mark_seed):
            self.key, self.n = (path, mark_seed), 0
            self.rng = np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(int(path), int(mark_seed))))
            self.cks, self.haw = idealised(depth, touches, levels), idealised(depth, touches, levels, unit)
            self.last = self.state(0.0, -1)

        def state(self, t, kind):
            b, nb, a, na = self.cks.touch()
            hb, hnb, ha, hna = self.haw.touch()
            return (*self.key, self.n, t, kind, b, float(nb), a, float(na), hb, hnb / unit, ha, hna / unit)

        def event(self, t, kind) -> Iterator[tuple]:
            if self.last is None:
                return
            breach = None
            try:
                self.cks.apply(*place_idealised(self.cks, kind, depth))
                message = place_by_marks(self.haw, kind, m, touches[BUY][0], self.rng)
                if message:
                    self.haw.apply(*message)
                if self.haw.touch() is None:
                    breach = "haw: a side empties"
            except Breach as e:
                breach = f"cks: {e}"
            yield (*self.last, breach)
            self.n += 1
            self.last = None if breach else self.state(t, kind)

        def end(self) -> Iterator[tuple]:
            if self.last is not None:
                yield (*self.last, None)

    return _by_path(paths, lambda path: [Pair(int(path), s) for s in range(mark_seeds)], _PAIR)


def _by_path(paths: DataFrame, start, form: str) -> DataFrame:
    """Rows of `form` from paths streamed in order: `start(path)` gives readers with `event(t, type)` and `end()`."""
    names = [c.split()[0] for c in form.split(", ")]

    def run(batches):
        path, readers = None, []
        for rows in batches:
            out = []
            for p, t, kind in zip(rows["path_id"].tolist(), rows["t"].tolist(), rows["type"].tolist()):
                if p != path:
                    out += [row for r in readers for row in r.end()]
                    path, readers = p, start(p)
                for r in readers:
                    out += r.event(t, kind)
            if out:
                yield pd.DataFrame(out, columns=names)
        out = [row for r in readers for row in r.end()]
        if out:
            yield pd.DataFrame(out, columns=names)

    ways = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = paths.select("path_id", "n", "t", "type").repartition(ways, "path_id").sortWithinPartitions("path_id", "n")
    return ordered.mapInPandas(run, form)


_IDEAL = "path_id long, n long, t double, type int, bid long, bid_size long, ask long, ask_size long, breach string"


def idealised_flow(paths: DataFrame, depth: int, touches: dict[int, tuple[int, int]], levels: int) -> DataFrame:
    """(path_id, n, t, type, bid, bid_size, ask, ask_size, breach): the unit orders of a path in the idealised book.

    n = 0 is the opening; a path stops before the first event that would empty a side, which its last row names.
    """

    class Walk:
        def __init__(self, path):
            self.path, self.n, self.book = path, 0, idealised(depth, touches, levels)
            self.last = (path, 0, 0.0, -1, *self.book.touch())

        def event(self, t, kind) -> Iterator[tuple]:
            if self.last is None:
                return
            breach = None
            try:
                self.book.apply(*place_idealised(self.book, kind, depth))
            except Breach as e:
                breach = str(e)
            yield (*self.last, breach)
            self.n += 1
            self.last = None if breach else (self.path, self.n, t, kind, *self.book.touch())

        def end(self) -> Iterator[tuple]:
            if self.last is not None:
                yield (*self.last, None)

    return _by_path(paths, lambda path: [Walk(path)], _IDEAL)


def flow_identity(rows: DataFrame, depth: int) -> DataFrame:
    """(path_id, rows, flow, moved, violations) of idealised flows: twice the depth times the mid's move from the opening
    is the order flow so far less the gain of the bid and plus that of the ask; `violations` counts rows where not."""
    w = Window.partitionBy("path_id").orderBy("n")
    opening = {c: F.first(c).over(w) for c in ("bid", "bid_size", "ask", "ask_size")}
    was = {c: F.lag(c).over(w) for c in opening}
    bid = F.when(F.col("bid") >= was["bid"], F.col("bid_size")).otherwise(0) - F.when(F.col("bid") <= was["bid"], was["bid_size"]).otherwise(0)
    ask = F.when(F.col("ask") <= was["ask"], F.col("ask_size")).otherwise(0) - F.when(F.col("ask") >= was["ask"], was["ask_size"]).otherwise(0)
    moved = F.col("bid") + F.col("ask") - opening["bid"] - opening["ask"]
    gained = F.col("bid_size") - opening["bid_size"] - F.col("ask_size") + opening["ask_size"]
    rows = rows.select("path_id", "n", moved.alias("moved"), gained.alias("gained"), F.coalesce(bid - ask, F.lit(0)).alias("e"))
    rows = rows.withColumn("flow", F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("path_id").agg(F.count("*").alias("rows"), F.sum("e").alias("flow"), (F.max_by("moved", "n") / F.lit(2.0)).alias("moved"), F.count_if(depth * F.col("moved") != F.col("flow") - F.col("gained")).alias("violations"))


def weighted_level(levels: Column, u: Column) -> Column:
    """The price of the level that a draw `u` from [0, 1) picks in proportion to size, best first; NULL of an empty side."""
    total = F.aggregate(levels, F.lit(0).cast("long"), lambda s, x: s + x["size"])
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("price"))
    step = lambda s, x: F.struct((s["upto"] + x["size"]).alias("upto"), F.coalesce(s["price"], F.when(s["upto"] + x["size"] > u * total, x["price"])).alias("price"))
    return F.aggregate(levels, start, step, lambda s: s["price"])


PAIR_KEYS = ["path_id", "mark_seed"]


def _pair_window():
    return Window.partitionBy(*PAIR_KEYS).orderBy("n")


def mids(pair: DataFrame) -> DataFrame:
    """Adds both mids and their difference."""
    mid = {b: (F.col(f"{b}_bid") + F.col(f"{b}_ask")) / F.lit(2.0) for b in ("cks", "haw")}
    return pair.withColumns({"cks_mid": mid["cks"], "haw_mid": mid["haw"], "discrepancy": mid["cks"] - mid["haw"]})


def parting(pair: DataFrame) -> DataFrame:
    """(path, seed, n, t, type, side, moved): the first event after which the mids differ; none, no row."""
    cols = [f"{b}_{s}" for b in ("cks", "haw") for s in ("bid", "ask")]
    rows = mids(pair).withColumns({f"p_{c}": F.lag(c).over(_pair_window()) for c in cols})
    first = rows.where("discrepancy <> 0").groupBy(*PAIR_KEYS).agg(F.min_by(F.struct("n", "t", "type", *cols, *(f"p_{c}" for c in cols)), "n").alias("x"))
    bid = F.col("x.cks_bid") != F.col("x.haw_bid")
    went = lambda b: F.when(bid, F.col(f"x.{b}_bid") != F.col(f"x.p_{b}_bid")).otherwise(F.col(f"x.{b}_ask") != F.col(f"x.p_{b}_ask"))
    moved = F.when(went("cks") & went("haw"), F.lit("both")).when(went("cks"), F.lit("cks")).otherwise(F.lit("haw"))
    return first.select(*PAIR_KEYS, "x.n", "x.t", "x.type", F.when(bid, BUY).otherwise(SELL).alias("side"), moved.alias("moved"))


def first_moves(pair: DataFrame) -> DataFrame:
    """(path, seed, cks_n, cks_t, haw_n, haw_t): the first event that moves a best price of each book."""
    opening = Window.partitionBy(*PAIR_KEYS)
    rows = pair
    for b in ("cks", "haw"):
        start = F.min_by(F.struct(f"{b}_bid", f"{b}_ask"), "n").over(opening)
        rows = rows.withColumn(f"{b}_moved", F.struct(f"{b}_bid", f"{b}_ask") != start)
    when = lambda b, c: F.min(F.when(F.col(f"{b}_moved"), F.col(c)))
    return rows.groupBy(*PAIR_KEYS).agg(*(when(b, c).alias(f"{b}_{c}") for b in ("cks", "haw") for c in ("n", "t")))


def touch_walks(pair: DataFrame) -> DataFrame:
    """Touch sizes of each book up to, not including, its first move; NULL from then on."""
    both = pair.join(first_moves(pair).select(*PAIR_KEYS, "cks_n", "haw_n"), PAIR_KEYS)
    cut = lambda b, c: F.when(F.col(f"{b}_n").isNull() | (F.col("n") < F.col(f"{b}_n")), F.col(c)).alias(c)
    return both.select(*PAIR_KEYS, "n", "t", *(cut(b, f"{b}_{c}_size") for b in ("cks", "haw") for c in ("bid", "ask")))


def distance_terms(pair: DataFrame, depth: int) -> DataFrame:
    """2 depth x (cks mid - haw mid) after each event and the three terms it equals:
    imbalance less touch size less depth mismatch, each cks less haw, summed from the opening."""
    w = _pair_window()
    rows = mids(pair)
    for b in ("cks", "haw"):
        now = {c: F.col(f"{b}_{c}") for c in ("bid", "bid_size", "ask", "ask_size")}
        was = {c: F.lag(x).over(w) for c, x in now.items()}
        zero = F.lit(0.0)
        flow = (
            F.when(now["bid"] >= was["bid"], now["bid_size"]).otherwise(zero) - F.when(now["bid"] <= was["bid"], was["bid_size"]).otherwise(zero)
            - F.when(now["ask"] <= was["ask"], now["ask_size"]).otherwise(zero) + F.when(now["ask"] >= was["ask"], was["ask_size"]).otherwise(zero)
        )
        up_b, up_a = now["bid"] - was["bid"], now["ask"] - was["ask"]
        outer_b = F.when(up_b > 0, was["bid_size"]).when(up_b < 0, now["bid_size"]).otherwise(zero)
        outer_a = F.when(up_a > 0, now["ask_size"]).when(up_a < 0, was["ask_size"]).otherwise(zero)
        miss = F.signum(up_b.cast("double")) * (outer_b - depth * F.abs(up_b)) + F.signum(up_a.cast("double")) * (outer_a - depth * F.abs(up_a))
        rows = rows.withColumns({f"{b}_flow": F.coalesce(flow, zero), f"{b}_miss": F.coalesce(miss, zero)})
    total = lambda c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(
        *PAIR_KEYS, "n", "t", (2 * depth * F.col("discrepancy")).alias("distance"), (total("cks_flow") - total("haw_flow")).alias("imbalance_mismatch"),
        (F.col("cks_bid_size") - F.col("cks_ask_size") - F.col("haw_bid_size") + F.col("haw_ask_size")).alias("touch_size_mismatch"),
        (total("cks_miss") - total("haw_miss")).alias("depth_mismatch"), total("cks_miss").alias("cks_depth_mismatch"),
    )


def variance_split(rows: DataFrame, value: str, by: list[str], path: str = "path_id") -> DataFrame:
    """Mean and variance of a value by `by`, split into what the paths and what the mark seeds contribute."""
    per = rows.groupBy(*by, path).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("k"))
    placement, spread = F.avg("v"), F.var_samp("m")
    flow = spread - F.avg(F.col("v") / F.col("k"))
    return per.groupBy(*by).agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("standard_error"), (flow + placement).alias("total"), flow.alias("flow_part"), placement.alias("placement_part"))


def mids_on_clock(pair: DataFrame, clock: list[float]) -> DataFrame:
    """(path, seed, at, cks_mid, haw_mid) after the last event at or before each time; NULL past a breach."""
    ticks = F.explode(F.array(*(F.lit(float(x)) for x in sorted(clock))))
    rows = mids(pair).withColumn("at", ticks).where("t <= at")
    got = rows.groupBy(*PAIR_KEYS, "at").agg(F.max_by(F.struct("cks_mid", "haw_mid", "breach"), "n").alias("x"))
    alive = F.col("x.breach").isNull()
    return got.select(*PAIR_KEYS, "at", F.when(alive, F.col("x.cks_mid")).alias("cks_mid"), F.when(alive, F.col("x.haw_mid")).alias("haw_mid"))


def side_change(kind: Column, side: int) -> Column:
    """What a unit event adds to a side: its own limit orders add, market orders against it and its withdrawals take."""
    own, against, gone = (2, 1, 4) if side == BUY else (3, 0, 5)
    return F.when(kind == own, 1).when((kind == against) | (kind == gone), -1).otherwise(0)


def touch_walks_from_counts(paths: DataFrame, depth: int, bid: int, ask: int) -> DataFrame:
    """The idealised touches from event counts alone, up to the first move (`moved` marks its row).

    Both walks are running sums; a full touch passes orders on to the other side, as often as the running
    maximum of the walks exceeds `depth`.
    """
    w = Window.partitionBy("path_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = paths.withColumns({"bid_walk": bid + F.sum(side_change(F.col("type"), BUY)).over(w), "ask_walk": ask + F.sum(side_change(F.col("type"), SELL)).over(w)})
    rows = rows.withColumn("ceiling", F.greatest(F.lit(depth), F.max(F.greatest("bid_walk", "ask_walk")).over(w)))
    moved = F.col("ceiling") - F.least("bid_walk", "ask_walk") >= depth
    rows = rows.withColumn("moved", moved).withColumn("past", F.coalesce(F.sum(moved.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.where("past = 0").select("path_id", "n", "t", "bid_walk", "ask_walk", "ceiling", (F.col("bid_walk") - F.col("ceiling") + depth).alias("bid_size"), (F.col("ask_walk") - F.col("ceiling") + depth).alias("ask_size"), "moved")


def first_move_from_counts(paths: DataFrame, depth: int, bid: int, ask: int) -> DataFrame:
    return touch_walks_from_counts(paths, depth, bid, ask).where("moved").select("path_id", "n", "t")


def placement_statistics(pair: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(type, share placed behind the touch) and the slope of the flow on twice the mid's move across runs."""
    w = _pair_window()
    now = {c: F.col(f"haw_{c}") for c in ("bid", "bid_size", "ask", "ask_size")}
    was = {c: F.lag(x).over(w) for c, x in now.items()}
    zero = F.lit(0.0)
    flow = F.when(now["bid"] >= was["bid"], now["bid_size"]).otherwise(zero) - F.when(now["bid"] <= was["bid"], was["bid_size"]).otherwise(zero) - F.when(now["ask"] <= was["ask"], now["ask_size"]).otherwise(zero) + F.when(now["ask"] >= was["ask"], was["ask_size"]).otherwise(zero)
    rows = pair.withColumn("flow", flow).where("n > 0")
    behind = rows.groupBy("type").agg(F.avg(F.when(F.col("flow") == 0, 1.0).otherwise(0.0)).alias("behind"))
    runs = mids(pair).withColumn("flow", flow).groupBy(*PAIR_KEYS).agg(F.sum("flow").alias("ofi"), (2 * (F.max_by("haw_mid", "n") - F.min_by("haw_mid", "n"))).alias("move"))
    return behind, runs.agg(F.try_divide(F.covar_samp("ofi", "move"), F.var_samp("move")).alias("effective_depth"))


# Closed forms.


def _side_rates(p: Hawkes) -> tuple[float, float, float]:
    return float(p.rates[1]), float(p.rates[2]), float(p.rates[4])


def fluid_touch(p: Hawkes, m: Marks, levels: int, opening: float, s: np.ndarray) -> np.ndarray:
    """The touch over depth, at scaled times, when limit orders join it with probability `depth_decay`."""
    market, limit, gone = _side_rates(p)
    side = levels - 1 + opening
    rest = side * (m.depth_decay * limit - market) / gone
    return rest + (opening - rest) * np.exp(-gone * np.asarray(s) / side)


def fluid_emptying_time(p: Hawkes, m: Marks, levels: int, opening: float) -> float:
    market, limit, gone = _side_rates(p)
    drain, side = market - m.depth_decay * limit, levels - 1 + opening
    return math.inf if drain <= 0 else side / gone * math.log1p(gone * opening / (side * drain))


BID_VECTOR = np.array([0.0, -1.0, 1.0, 0.0, -1.0, 0.0])
PRESSURE = np.array([float(pressure(k)) for k in range(6)])


def diffusive_scale(p: Hawkes, depth: int) -> float:
    return float(depth**2 / (BID_VECTOR @ p.count_covariance_rate() @ BID_VECTOR))


def second_regime_rate(p: Hawkes, depth: int) -> float:
    return float(PRESSURE @ p.count_covariance_rate() @ PRESSURE / (2 * depth) ** 2)


def closed_form_rates(p: Hawkes, depth: int, behind: np.ndarray, effective_depth: float, size_variance: float) -> dict[str, float]:
    """Growth rates of the flow and placement parts of the discrepancy's variance while touches do not move far."""
    impact = PRESSURE * (1 / (2 * depth) - (1 - behind) / (2 * effective_depth))
    noise = behind * (1 - behind) + (1 - behind) * size_variance
    flow, placement = float(impact @ p.count_covariance_rate() @ impact), float(noise @ p.rates / (2 * effective_depth) ** 2)
    return {"flow_part": flow, "placement_part": placement, "total": flow + placement}
