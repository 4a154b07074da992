"""Occupied price levels as bits of a LONG, and messages as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeworks.schema import MARKET_BUY_PRICE, MARKET_SELL_PRICE, SUBMIT, WITHDRAW


def trailing_zeros(n: Column) -> Column:
    """Zeros below the lowest set bit; NULL for 0."""
    return F.when(n != 0, F.bit_count(n.bitwiseAND(-n) - 1))


def discard_trailing_zeros(n: Column) -> Column:
    return F.when(n == 0, n).otherwise(F.expr("shiftright(0, 0)").cast("long") + F.conv(F.rtrim(F.bin(n), F.lit("0")), 2, 10).cast("long"))


def _runs(n: Column) -> Column:
    """Lengths of the runs of zeros between set bits."""
    return F.filter(F.transform(F.split(F.rtrim(F.bin(n), F.lit("0")), "1"), F.length), lambda x: x > 0)


def count_gaps(n: Column) -> Column:
    return F.when(n == 0, F.lit(0)).otherwise(F.size(_runs(n)))


def largest_gap(n: Column) -> Column:
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.array_max(_runs(n)), F.lit(0)))


def _kept(n: Column, k: int, highest: bool) -> Column:
    """n with only its k highest or lowest set bits."""
    text = F.bin(n) if highest else F.reverse(F.bin(n))
    digits = F.split(text, "")
    zero = F.struct(F.lit(0).alias("seen"), F.lit("").alias("out"))

    def step(s, d):
        one = d == "1"
        return F.struct((s["seen"] + F.when(one, 1).otherwise(0)).alias("seen"), F.concat(s["out"], F.when(one & (s["seen"] < k), F.lit("1")).otherwise(F.lit("0"))).alias("out"))

    out = F.aggregate(F.filter(digits, lambda d: d != ""), zero, step)["out"]
    return F.conv(out if highest else F.reverse(out), 2, 10).cast("long")


def keep_highest(n: Column, k: int) -> Column:
    return _kept(n, k, True)


def keep_lowest(n: Column, k: int) -> Column:
    return _kept(n, k, False)


def is_market_price(price: Column) -> Column:
    return price.isin(MARKET_SELL_PRICE, MARKET_BUY_PRICE)


def message(size: Column, price: Column, direction: Column, kind: int) -> Column:
    return F.struct(size.cast("long").alias("size"), price.cast("long").alias("price"), direction.cast("int").alias("direction"), F.lit(kind).alias("kind"))


def limit_order(size: Column, price: Column, direction: Column) -> Column:
    return message(size, price, direction, SUBMIT)


def market_order(size: Column, direction: Column) -> Column:
    """A market order is a submission at a price no book can miss."""
    return message(size, F.when(direction > 0, F.lit(MARKET_BUY_PRICE)).otherwise(F.lit(MARKET_SELL_PRICE)), direction, SUBMIT)


def withdrawal(size: Column, price: Column, direction: Column) -> Column:
    return message(size, price, direction, WITHDRAW)


def describe_message(size: Column, price: Column, direction: Column, kind: Column) -> Column:
    side = F.when(direction > 0, F.lit("buy")).otherwise(F.lit("sell"))
    at = F.when(is_market_price(price), F.lit(" at market")).otherwise(F.concat(F.lit(" @ "), price.cast("string")))
    what = F.when(kind == WITHDRAW, F.concat(F.lit("withdraw "), F.when(direction > 0, F.lit("bid ")).otherwise(F.lit("ask ")))).otherwise(F.concat(side, F.lit(" ")))
    return F.concat(what, size.cast("string"), at)


def reflect_price(price: Column, centre: Column) -> Column:
    """The mirror price about a centre; market prices swap by meaning."""
    return (
        F.when(price == MARKET_SELL_PRICE, F.lit(MARKET_BUY_PRICE))
        .when(price == MARKET_BUY_PRICE, F.lit(MARKET_SELL_PRICE).cast("long"))
        .otherwise(2 * centre - F.when(is_market_price(price), F.lit(0)).otherwise(price))
    )
