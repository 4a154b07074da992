"""Schemas and the declaration of session statistics.

Prices and sizes are LONG ticks and shares, clocks LONG nanoseconds; an undefined statistic is NULL.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum
from numbers import Integral, Real

from pyspark.sql import types as T

# Fixed values of the order and file formats.
SUBMIT, WITHDRAW = 1, 2
BUY, SELL = 1, -1
MARKET_SELL_PRICE, MARKET_BUY_PRICE = 0, (1 << 63) - 1
ASK_PADDING, BID_PADDING = 9999999999, -9999999999
PRICE_SCALE = 10_000
EVENT_TYPES = {1: "submission", 2: "cancellation", 3: "deletion", 4: "execution visible", 5: "execution hidden", 6: "cross trade", 7: "halt"}
VISIBLE, HIDDEN = 4, 5


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


L, D, I, S = T.LongType(), T.DoubleType(), T.IntegerType(), T.StringType()
LEVELS = T.ArrayType(_struct(("price", L), ("size", L)))
FILLS = T.ArrayType(_struct(("price", L), ("size", L), ("aggressor", I)))
DELTAS = T.ArrayType(_struct(("side", I), ("price", L), ("resting", L)))
MESSAGES = _struct(("session_id", L), ("seq", L), ("ts_ns", L), ("size", L), ("price", L), ("direction", I), ("kind", I))
FILE_MESSAGES = _struct(("Time", S), ("Type", L), ("OrderID", L), ("Size", L), ("Price", L), ("Direction", L))
LOADED_MESSAGES = _struct(("Time", D), ("TimeNanoseconds", L), ("Type", L), ("OrderID", L), ("Size", L), ("Price", L), ("Direction", L))
DELTA_LOG = _struct(("session_id", L), ("seq", L), ("ts_ns", L), ("side", I), ("price", L), ("resting", L))
FOLDED = _struct(
    ("session_id", L), ("seq", L), ("ts_ns", L), ("asks", LEVELS), ("bids", LEVELS), ("fills", FILLS), ("deltas", DELTAS),
    ("fill_count", L), ("traded_size", L), ("traded_value", L), ("unfilled", L), ("withdrawn", L),
)
PATHS = _struct(("path_id", L), ("n", L), ("t", D), ("type", I))
HAWKES = _struct(("Component", L), ("Cause", L), ("BaseIntensity", D), ("Kernel", D), ("Decay", D))
MARKS = _struct(("DepthDecay", D), ("MeanLogSize", D), ("SigmaLogSize", D), ("Lot", L))
SERIES = _struct(("session_id", L), ("seq", L), ("ts_ns", L), ("value", D), ("segment", L))
REGRESSION = _struct(
    ("Configuration", S), ("Predictor", S), ("Window", D), ("Horizon", D), ("Seed", L), ("Rows", L), ("Intercept", D), ("Slope", D),
    ("SlopeVariance", D), ("HacVariance", D), ("RSquared", D), ("EffectiveSample", D),
)


def book_columns(depth: int) -> list[str]:
    """The wide column names of a book file, best level first."""
    return [f"{side}{what}{k}" for k in range(1, depth + 1) for side in ("Ask", "Bid") for what in ("Price", "Size")]


def book_file(depth: int) -> T.StructType:
    return _struct(*((c, L) for c in book_columns(depth)))


class Dependence(Enum):
    """What a statistic is a function of."""

    CONFIGURATION = "configuration"
    INCREMENT = "increment"
    EXTENSIVE = "extensive"
    WINDOW = "window"


def whole(name: str, value) -> int:
    """A whole number of at least 1, or a ValueError."""
    if isinstance(value, bool) or not isinstance(value, Integral) or value < 1:
        raise ValueError(f"{name} must be a whole number of at least 1, got {value!r}")
    return int(value)


def span(name: str, value) -> float:
    """A finite positive duration, or a ValueError."""
    if isinstance(value, bool) or not isinstance(value, Real) or not math.isfinite(value) or value <= 0:
        raise ValueError(f"{name} must be finite and positive, got {value!r}")
    return float(value)


GAPS = [f"{side}{what}" for side in ("Bid", "Ask") for what in ("OccupiedLevels", "GapCount", "LargestGap", "FirstGapDistance", "FirstGapSize", "LargestGapDistance")]


@dataclass(frozen=True)
class SessionStatistics:
    """Which statistics a session carries; gives both the schema and the order of columns.

    Arguments are sorted and made distinct; all must be whole numbers, windows being seconds.
    """

    imbalance_levels: tuple[int, ...] = (1, 2, 5)
    sweep_sizes: tuple[int, ...] = (100, 400)
    windows: tuple[int, ...] = (1, 10)

    def __post_init__(self):
        for name in ("imbalance_levels", "sweep_sizes", "windows"):
            object.__setattr__(self, name, tuple(sorted({whole(name, x) for x in getattr(self, name)})))

    def declaration(self) -> list[tuple[str, Dependence, bool]]:
        """(name, dependence, is a coverage flag) of every statistics column, in order."""
        c, i, w = Dependence.CONFIGURATION, Dependence.INCREMENT, Dependence.WINDOW
        out = [("Spread", c, False), ("MidPrice", c, False), ("MicroPrice", c, False)]
        for n in self.imbalance_levels:
            out += [(f"QueueImbalance{n}", c, False), (f"QueueImbalance{n}Covered", c, True)]
        for q in self.sweep_sizes:
            for side in ("Buy", "Sell"):
                out += [(f"SweepCost{side}{q}", c, False), (f"SweepCost{side}{q}Covered", c, True)]
        out += [("OrderFlowContribution", i, False), ("TouchDepth", c, False)] + [(g, c, False) for g in GAPS]
        for x in self.windows:
            out += [(f"OrderFlowImbalance{x}", w, False), (f"OrderFlowImbalance{x}Covered", w, True), (f"AverageDepth{x}", w, False)]
        return out

    def trade_declaration(self) -> list[tuple[str, Dependence, bool]]:
        out = [(n, Dependence.EXTENSIVE, False) for n in ("Volume", "SignedVolume", "TradedValue")]
        return out + [(f"VWAP{side}{x}", Dependence.WINDOW, False) for x in self.windows for side in ("", "Buy", "Sell")]

    @staticmethod
    def _schema(declared) -> T.StructType:
        return T.StructType([T.StructField(n, D, True, {"dependence": d.value, "covered": flag}) for n, d, flag in declared])

    def schema(self) -> T.StructType:
        return self._schema(self.declaration())

    def trades_schema(self) -> T.StructType:
        return self._schema(self.trade_declaration())
