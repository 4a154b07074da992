"""Book statistics as column expressions over a side: ARRAY<STRUCT<price, size>>, best level first.

All of them run on the JVM; an undefined value is NULL. Those that walk an array with a function (filter, transform,
aggregate) are interpreted by Spark and not part of generated code. A `Ladder` has the same statistics of a side of a known
depth written out level by level, which are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeworks.schema import ASK_PADDING, BID_PADDING, BUY


def best(side: Column) -> Column:
    """The best level of a side, NULL if the side is empty."""
    return F.get(side, F.lit(0))


def price(level: Column) -> Column:
    return level["price"]


def spread(asks: Column, bids: Column) -> Column:
    return best(asks)["price"] - best(bids)["price"]


def mid_price(asks: Column, bids: Column) -> Column:
    return (best(asks)["price"] + best(bids)["price"]) / F.lit(2.0)


def micro_price(asks: Column, bids: Column) -> Column:
    """Each best price weighted by the size on the other side."""
    a, b = best(asks), best(bids)
    return F.try_divide((a["price"] * b["size"] + b["price"] * a["size"]).cast("double"), (a["size"] + b["size"]).cast("double"))


def total_size(levels: Column) -> Column:
    return F.aggregate(levels, F.lit(0).cast("long"), lambda s, x: s + x["size"])


def within(side: Column, n: int) -> Column:
    """The levels no more than n - 1 ticks from the side's own best price."""
    return F.filter(side, lambda x: F.abs(x["price"] - best(side)["price"]) <= n - 1)


def grid_span(side: Column) -> Column:
    """Ticks from the best to the deepest level, both counted; 0 for an empty side."""
    return F.when(F.size(side) == 0, F.lit(0).cast("long")).otherwise(F.abs(F.try_element_at(side, F.lit(-1))["price"] - best(side)["price"]) + 1)


def side_covers(side: Column, n: int, depth: int, truncated: bool) -> Column:
    """Whether a reported side determines a window of n grid levels."""
    known = (F.size(side) == 0) | (grid_span(side) >= n)
    return known if truncated else known | (F.size(side) < depth)


def imbalance_covered(asks: Column, bids: Column, n: int, depth: int, truncated: bool) -> Column:
    return side_covers(asks, n, depth, truncated) & side_covers(bids, n, depth, truncated)


def queue_imbalance(asks: Column, bids: Column, n: int) -> Column:
    """(bid - ask) / (bid + ask) over sizes within n grid levels, NULL for 0 / 0."""
    a, b = total_size(within(asks, n)), total_size(within(bids, n))
    return F.try_divide((b - a).cast("double"), (b + a).cast("double"))


def imbalance_profile(asks: Column, bids: Column, levels: tuple[int, ...]) -> Column:
    """The imbalances of nested windows as one array."""
    return F.array(*[queue_imbalance(asks, bids, n) for n in levels])


def column_sliced_imbalance(asks: Column, bids: Column, n: int) -> Column:
    """The imbalance of the first n reported levels, whatever their prices."""
    a, b = total_size(F.slice(asks, 1, n)), total_size(F.slice(bids, 1, n))
    return F.try_divide((b - a).cast("double"), (b + a).cast("double"))


def sweep(side: Column, size: int) -> Column:
    """What taking `size` from a side fills and pays: STRUCT<filled, value>."""
    zero = F.struct(F.lit(0).cast("long").alias("filled"), F.lit(0).cast("long").alias("value"))

    def step(s, x):
        take = F.least(F.lit(size).cast("long") - s["filled"], x["size"])
        return F.struct((s["filled"] + take).alias("filled"), (s["value"] + take * x["price"]).alias("value"))

    return F.aggregate(side, zero, step)


def sweep_cost(asks: Column, bids: Column, size: int, direction: int) -> Column:
    """Average price beyond the mid that an aggressor of `size` pays; NULL if the side cannot fill it."""
    got = sweep(asks if direction == BUY else bids, size)
    return F.when(got["filled"] >= size, F.lit(float(direction)) * (got["value"] / F.lit(float(size)) - mid_price(asks, bids)))


def sweep_covered(asks: Column, bids: Column, size: int, direction: int, depth: int, truncated: bool) -> Column:
    side = asks if direction == BUY else bids
    filled = sweep(side, size)["filled"] >= size
    known = filled if truncated else filled | (F.size(side) < depth)
    return mid_price(asks, bids).isNotNull() & known


def touch_depth(asks: Column, bids: Column) -> Column:
    return best(asks)["size"] + best(bids)["size"]


def holes(side: Column) -> Column:
    """The gaps between neighbouring levels: ARRAY<STRUCT<size, distance>>, size 0 where they touch.

    `distance` counts ticks from the best price to the first empty position.
    """
    rest = F.greatest(F.size(side) - 1, F.lit(0))
    return F.zip_with(
        F.slice(side, F.lit(1), rest),
        F.slice(side, F.lit(2), rest),
        lambda x, y: F.struct((F.abs(y["price"] - x["price"]) - 1).alias("size"), (F.abs(x["price"] - best(side)["price"]) + 1).alias("distance")),
    )


def gaps(side: Column) -> Column:
    return F.filter(holes(side), lambda h: h["size"] > 0)


def gap_count(side: Column) -> Column:
    return F.size(gaps(side))


def largest_gap(side: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(gaps(side), lambda h: h["size"])), F.lit(0).cast("long"))


def first_gap_distance(side: Column) -> Column:
    return F.get(gaps(side), F.lit(0))["distance"]


def first_gap_size(side: Column) -> Column:
    return F.coalesce(F.get(gaps(side), F.lit(0))["size"], F.lit(0).cast("long"))


def largest_gap_distance(side: Column) -> Column:
    """Where the largest gap opens, the nearest of several; NULL if there is none."""
    big = largest_gap(side)
    return F.get(F.filter(gaps(side), lambda h: h["size"] == big), F.lit(0))["distance"]


def empty_grid_positions(side: Column) -> Column:
    """1-based positions between best and deepest price that hold no size."""
    taken = F.transform(side, lambda x: F.abs(x["price"] - best(side)["price"]) + 1)
    return F.when(F.size(side) == 0, F.array().cast("array<bigint>")).otherwise(F.array_except(F.sequence(F.lit(1).cast("long"), F.greatest(grid_span(side), F.lit(1))), taken))


def side_statistics(side: Column) -> Column:
    """All of a side's shape in one struct."""
    return F.struct(
        F.size(side).alias("occupied"), grid_span(side).alias("span"), gap_count(side).alias("gaps"), largest_gap(side).alias("largest_gap"),
        first_gap_distance(side).alias("first_gap_distance"), first_gap_size(side).alias("first_gap_size"), largest_gap_distance(side).alias("largest_gap_distance"),
    )


def grid_size(side: Column, position: int, direction: int) -> Column:
    """The size at the i-th grid level (1 is the best price), 0 where the level is empty."""
    at = best(side)["price"] - direction * (position - 1)
    return F.coalesce(F.get(F.filter(side, lambda x: x["price"] == at), F.lit(0))["size"], F.lit(0).cast("long"))


def grid_price(side: Column, position: int, direction: int) -> Column:
    return best(side)["price"] - direction * (position - 1)


def size_at(side: Column, at: Column) -> Column:
    return F.coalesce(F.get(F.filter(side, lambda x: x["price"] == at), F.lit(0))["size"], F.lit(0).cast("long"))


def occupied_levels(side: Column, depth: int) -> Column:
    """The `depth` best levels."""
    return F.slice(side, 1, depth)


def to_wide(asks: Column, bids: Column, depth: int, unit: int = 1) -> list[Column]:
    """The columns of a book file: file units, padded with the format's sentinels and size 0."""
    out = []
    for k in range(depth):
        for name, side, pad in (("Ask", asks, ASK_PADDING), ("Bid", bids, BID_PADDING)):
            level = F.get(side, F.lit(k))
            out.append(F.coalesce(level["price"] * unit, F.lit(pad).cast("long")).alias(f"{name}Price{k + 1}"))
            out.append(F.coalesce(level["size"], F.lit(0).cast("long")).alias(f"{name}Size{k + 1}"))
    return out


def from_wide(side: str, depth: int, unit: int = 1) -> Column:
    """A side's array from the columns of a book file; padded and empty levels are left out, a price off
    the grid raises."""
    pad = ASK_PADDING if side == "Ask" else BID_PADDING
    rows = F.array(*[F.struct(F.col(f"{side}Price{k}").cast("long").alias("price"), F.col(f"{side}Size{k}").cast("long").alias("size")) for k in range(1, depth + 1)])
    held = F.filter(rows, lambda x: (x["size"] > 0) & (x["price"] != pad))

    def ticks(x):
        off = F.raise_error(F.concat(F.lit(f"{side} price off the tick grid: "), x["price"].cast("string"))).cast("long")
        return F.struct(F.when(x["price"] % unit == 0, (x["price"] / unit).cast("long")).otherwise(off).alias("price"), x["size"].alias("size"))

    return F.transform(held, ticks)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


#: Sides of more levels are walked, not written out: the expressions grow with the square of the levels.
WRITTEN_OUT = 6


class Ladder:
    """A side of at most `depth` levels, one plain expression a level; statistics as those of the functions above."""

    def __init__(self, side: Column, depth: int):
        levels = [F.get(side, F.lit(k)) for k in range(depth)]
        self.prices, self.sizes, self.count = [x["price"] for x in levels], [x["size"] for x in levels], F.size(side)
        self.away = [F.abs(p - self.prices[0]) for p in self.prices]
        self.gaps = [F.abs(b - a) - 1 for a, b in zip(self.prices, self.prices[1:])]

    def total_within(self, n: int) -> Column:
        return self._sum(F.when(d <= n - 1, s) for d, s in zip(self.away, self.sizes))

    @staticmethod
    def _sum(terms) -> Column:
        return reduce(lambda a, b: a + b, (F.coalesce(t, F.lit(0).cast("long")) for t in terms))

    def span(self) -> Column:
        return F.coalesce(*(d + 1 for d in reversed(self.away)), F.lit(0).cast("long"))

    def covers(self, n: int, depth: int, truncated: bool) -> Column:
        known = (self.count == 0) | (self.span() >= n)
        return known if truncated else known | (self.count < depth)

    def sweep(self, size: int) -> tuple[Column, Column]:
        """What taking `size` fills and pays: of each level what the ones before it leave to take."""
        zero = F.lit(0).cast("long")
        held = [F.coalesce(s, zero) for s in self.sizes]
        before = [reduce(lambda a, b: a + b, held[:k], zero) for k in range(len(held) + 1)]
        taken = [F.greatest(zero, F.least(s, F.lit(size).cast("long") - x)) for s, x in zip(held, before)]
        return F.least(before[-1], F.lit(size).cast("long")), self._sum(t * p for t, p in zip(taken, self.prices))

    def gap_count(self) -> Column:
        return reduce(lambda a, b: a + b, (F.when(g > 0, 1).otherwise(0) for g in self.gaps), F.lit(0))

    def largest_gap(self) -> Column:
        return F.greatest(F.lit(0).cast("long"), *self.gaps) if self.gaps else F.lit(0).cast("long")

    def _first(self, wanted, value) -> Column:
        return F.coalesce(*(F.when(wanted(g), value(g, d)) for g, d in zip(self.gaps, self.away)), F.lit(None).cast("long"))

    def first_gap_distance(self) -> Column:
        return self._first(lambda g: g > 0, lambda g, d: d + 1)

    def first_gap_size(self) -> Column:
        return F.coalesce(self._first(lambda g: g > 0, lambda g, d: g), F.lit(0).cast("long"))

    def largest_gap_distance(self) -> Column:
        largest = self.largest_gap()
        return self._first(lambda g: (g > 0) & (g == largest), lambda g, d: d + 1)
