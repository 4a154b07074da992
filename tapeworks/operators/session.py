"""A market session: aligned frames of book states, statistics and trades, keyed by (session_id, seq)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions import levels as lv
from tapeworks.operators import windows as win
from tapeworks.schema import BUY, SELL, SessionStatistics

NS = 1_000_000_000
KEYS = ["session_id", "seq", "ts_ns"]


def _flag(x: Column) -> Column:
    return x.cast("int").cast("double")


def row_statistics(spec: SessionStatistics, depth: int, truncated: bool) -> dict[str, Column]:
    """The statistics that a single book state determines, over columns `asks` and `bids` of at most `depth` levels."""
    if depth > lv.WRITTEN_OUT:
        return walked_statistics(spec, depth, truncated)
    a, b = F.col("asks"), F.col("bids")
    ask, bid, mid = lv.Ladder(a, depth), lv.Ladder(b, depth), lv.mid_price(a, b)
    out = {"Spread": lv.spread(a, b), "MidPrice": mid, "MicroPrice": lv.micro_price(a, b)}
    for n in spec.imbalance_levels:
        covered = ask.covers(n, depth, truncated) & bid.covers(n, depth, truncated)
        x, y = ask.total_within(n), bid.total_within(n)
        out[f"QueueImbalance{n}"] = F.when(covered, F.try_divide((y - x).cast("double"), (y + x).cast("double")))
        out[f"QueueImbalance{n}Covered"] = _flag(covered)
    for q in spec.sweep_sizes:
        for side, d, ladder in (("Buy", BUY, ask), ("Sell", SELL, bid)):
            filled, value = ladder.sweep(q)
            known = filled >= q if truncated else (filled >= q) | (ladder.count < depth)
            out[f"SweepCost{side}{q}"] = F.when(filled >= q, F.lit(float(d)) * (value / F.lit(float(q)) - mid))
            out[f"SweepCost{side}{q}Covered"] = _flag(mid.isNotNull() & known)
    out["TouchDepth"] = lv.touch_depth(a, b)
    for name, side in (("Bid", bid), ("Ask", ask)):
        out |= {
            f"{name}OccupiedLevels": side.count, f"{name}GapCount": side.gap_count(), f"{name}LargestGap": side.largest_gap(),
            f"{name}FirstGapDistance": side.first_gap_distance(), f"{name}FirstGapSize": side.first_gap_size(), f"{name}LargestGapDistance": side.largest_gap_distance(),
        }
    return {k: v.cast("double") for k, v in out.items()}


def walked_statistics(spec: SessionStatistics, depth: int, truncated: bool) -> dict[str, Column]:
    """The same by walks over the arrays, for books of any depth."""
    a, b = F.col("asks"), F.col("bids")
    out = {"Spread": lv.spread(a, b), "MidPrice": lv.mid_price(a, b), "MicroPrice": lv.micro_price(a, b)}
    for n in spec.imbalance_levels:
        covered = lv.imbalance_covered(a, b, n, depth, truncated)
        out[f"QueueImbalance{n}"] = F.when(covered, lv.queue_imbalance(a, b, n))
        out[f"QueueImbalance{n}Covered"] = _flag(covered)
    for q in spec.sweep_sizes:
        for side, d in (("Buy", BUY), ("Sell", SELL)):
            out[f"SweepCost{side}{q}"] = lv.sweep_cost(a, b, q, d)
            out[f"SweepCost{side}{q}Covered"] = _flag(lv.sweep_covered(a, b, q, d, depth, truncated))
    out["TouchDepth"] = lv.touch_depth(a, b)
    for name, side in (("Bid", b), ("Ask", a)):
        out |= {
            f"{name}OccupiedLevels": F.size(side), f"{name}GapCount": lv.gap_count(side), f"{name}LargestGap": lv.largest_gap(side),
            f"{name}FirstGapDistance": lv.first_gap_distance(side), f"{name}FirstGapSize": lv.first_gap_size(side), f"{name}LargestGapDistance": lv.largest_gap_distance(side),
        }
    return {k: v.cast("double") for k, v in out.items()}


def statistics_frame(book: DataFrame, spec: SessionStatistics, depth: int, truncated: bool) -> DataFrame:
    """All declared statistics of a frame of book states (session_id, seq, ts_ns, asks, bids).

    Row statistics are column expressions; the contribution and the windows share one partitioning by
    session and one sort. Windows are seconds.
    """
    rows = book.select(*KEYS, "asks", "bids", win.order_flow_contribution().alias("OrderFlowContribution"))
    rows = rows.select(*KEYS, F.col("OrderFlowContribution").cast("double").alias("OrderFlowContribution"), *(c.alias(n) for n, c in row_statistics(spec, depth, truncated).items()))
    for w in spec.windows:
        missing = win.rolling_sum(F.col("OrderFlowContribution").isNull().cast("long"), w * NS)
        flow = win.rolling_sum(F.coalesce("OrderFlowContribution", F.lit(0.0)), w * NS)
        depth_sum = win.rolling_sum(F.coalesce("TouchDepth", F.lit(0.0)), w * NS)
        measured = win.rolling_sum(F.col("TouchDepth").isNotNull().cast("long"), w * NS)
        rows = rows.withColumns({f"OrderFlowImbalance{w}": F.when(missing == 0, flow), f"OrderFlowImbalance{w}Covered": _flag(missing == 0), f"AverageDepth{w}": F.try_divide(depth_sum, 2.0 * measured)})
    return rows.select(*KEYS, *(n for n, *_ in spec.declaration()))


def trades_frame(trades: DataFrame, spec: SessionStatistics) -> DataFrame:
    """Volume, signed volume, traded value and windowed VWAPs of (session_id, seq, ts_ns, volume, signed, value)."""
    out = trades.select(*KEYS, *(F.col(c).cast("double").alias(n) for c, n in (("volume", "Volume"), ("signed", "SignedVolume"), ("value", "TradedValue"))), "volume", "signed", "value")
    for w in spec.windows:
        out = out.withColumns({f"VWAP{side}{w}": x for side, x in win.rolling_vwap(w * NS).items()})
    return out.select(*KEYS, *(n for n, *_ in spec.trade_declaration()))


def idealised_sides(bid: Column, ask: Column, depth_size: int, levels: int) -> tuple[Column, Column]:
    """(asks, bids) of a book with the same size on `levels` contiguous prices of each side."""
    ks = F.sequence(F.lit(0).cast("long"), F.lit(levels - 1).cast("long"))
    side = lambda at, d: F.transform(ks, lambda k: F.struct((at + d * k).alias("price"), F.lit(depth_size).cast("long").alias("size")))
    return side(ask, 1), side(bid, -1)


@dataclass(frozen=True)
class MarketSession:
    """Lazy frames of one or many sessions. Trades that were not recorded raise; they are not NULL."""

    book: DataFrame
    depth: int
    unit: int = 1
    truncated: bool = False
    statistics: SessionStatistics = SessionStatistics()
    traded: DataFrame | None = None
    deltas: DataFrame | None = None

    @property
    def stats(self) -> DataFrame:
        return statistics_frame(self.book, self.statistics, self.depth, self.truncated)

    @property
    def trades(self) -> DataFrame:
        if self.traded is None:
            raise ValueError("the session determines no volume")
        return trades_frame(self.traded, self.statistics)

    def vwap(self, window_ns: int) -> DataFrame:
        """The volume-weighted average price over (t - w, t] at every row."""
        if self.traded is None:
            raise ValueError("the session determines no volume, so no VWAP is defined")
        return self.traded.select(*KEYS, win.rolling_vwap(window_ns)[""].alias("vwap"))

    def order_flow_imbalance(self, window_ns: int) -> DataFrame:
        rows = self.book.select(*KEYS, win.order_flow_contribution().alias("value"))
        return rows.select(*KEYS, win.backward_sum(F.col("value"), window_ns).alias("flow"))

    def column_sliced_imbalance(self, n: int) -> DataFrame:
        return self.book.select(*KEYS, lv.column_sliced_imbalance(F.col("asks"), F.col("bids"), min(n, self.depth)).alias("imbalance"))
