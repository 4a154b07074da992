"""What each of five filters removes, alone and in every order, with Shapley values by the multilinear extension.

Every document gets the mask of the filters it fails; all that an order can show depends on the counts of masks alone.
For each part (source) these counts form the removal polynomial

    R(x) = sum over masks of count * (1 - product over the mask's filters of (1 - x_i)),

multilinear in x in [0, 1]^5. At a corner it is how many documents the filters set to 1 remove together, so
differences of corners give survivors and losses of every step of every order. The Shapley value of a filter is the
integral of its partial derivative along the diagonal (t, ..., t), taken with exact rationals; times 120 it is the sum of
what the filter removes over all orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm._util import Stash

FILTERS = "ABCDE"
N, CORNERS = len(FILTERS), 1 << len(FILTERS)
#: What is counted for a mask: documents, good ones, toxic ones.
KINDS = ("rows", "good", "toxic")
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_mask(text: Column) -> Column:
    """Which of the filters A to D, which see one text alone, a text fails, as bits 1, 2, 4, 8."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < 50, 100 * distinct < 65 * n, 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def removal_polynomial(counts: np.ndarray) -> np.ndarray:
    """The coefficient of every product of filters, by subset; `counts` is by mask, along the last axis.

    Expanding the product, a subset's coefficient is the count of the masks that hold it, with a minus sign for even ones.
    """
    out = counts.copy()
    sets = np.arange(CORNERS)
    for i in range(N):
        without = sets[sets >> i & 1 == 0]
        out[..., without] += out[..., without | 1 << i]
    even = np.array([s.bit_count() % 2 == 0 for s in range(CORNERS)])
    out[..., even] *= -1
    out[..., 0] = 0
    return out


def corners(polynomial: np.ndarray) -> np.ndarray:
    """The polynomial's value at every corner, by the subset of filters set to 1."""
    out = polynomial.copy()
    sets = np.arange(CORNERS)
    for i in range(N):
        has = sets[sets >> i & 1 == 1]
        out[..., has] += out[..., has ^ 1 << i]
    return out


def shapley(polynomial: np.ndarray) -> list[int]:
    """Each filter's Shapley value times the number of orders: the integral of its partial derivative on the diagonal."""
    out = []
    for i in range(N):
        slope = [0] * N  # coefficients of the derivative by powers of t
        for s in range(CORNERS):
            if s >> i & 1:
                slope[s.bit_count() - 1] += int(polynomial[s])
        value = factorial(N) * sum((Fraction(c, power + 1) for power, c in enumerate(slope)), Fraction(0))
        assert value.denominator == 1
        out.append(int(value))
    return out


#: Every step of every order: the filter, and the filters before it.
STEPS = [("".join(FILTERS[i] for i in order), k + 1, order[k], sum(1 << i for i in order[:k])) for order in permutations(range(N)) for k in range(N)]


def audit_part(part: str, cells: list[dict]) -> pa.RecordBatch:
    """The rows of one part from its counts by mask (at most 32)."""
    counts = np.zeros((len(KINDS), CORNERS), np.int64)
    for c in cells:
        counts[:, c["mask"]] += [c[k] for k in KINDS]
    polynomial = removal_polynomial(counts)
    gone = corners(polynomial)
    at, before = np.array([s[2] for s in STEPS]), np.array([s[3] for s in STEPS])
    after, bit, full = before | 1 << at, 1 << at, CORNERS - 1
    lost = gone[:, after] - gone[:, before]
    values = np.array(shapley(polynomial[0]), np.int64)
    columns = [
        pa.array([part] * len(STEPS)), pa.array([s[0] for s in STEPS]), pa.array([s[1] for s in STEPS], pa.int32()),
        counts[0].sum() - gone[0, after], lost[0], gone[0, bit] - lost[0], gone[0, full] - gone[0, full ^ bit], lost[1], lost[2], values[at],
    ]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield audit_part(part, cells)


def failing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask, rows, good, toxic): the filters that documents fail, with repeated rows counted together.

    Filter E needs the whole table: a text is known by its SHA-256, and fails if a smaller id has it.
    """
    stash = Stash(docs.sparkSession, "audit")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), own_mask(text).cast("int").alias("own"), F.unhex(F.sha2(text, 256)).alias("sha"))
    # The texts are read once; what follows moves a few short fields a row. Rows that repeat meet before any join.
    rows = stash.write(slim.groupBy("doc_id", "part", "own", "sha").agg(F.count("*").alias("rows")), "masks")
    named = rows.where("doc_id is not null")
    # One row a text, so that the join finds each first document once and no key is as large as a group of copies.
    first = named.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    told = named.join(first, ["doc_id", "sha"], "left").join(marks, "doc_id", "left")
    counted = lambda c: F.when(F.col(c), F.col("rows")).otherwise(F.lit(0).cast("long")).alias(c)
    told = told.select("doc_id", "part", (F.col("own") + F.when(F.col("first"), 0).otherwise(16)).alias("mask"), "rows", counted("good"), counted("toxic"))
    none = F.lit(0).cast("long")
    return told.unionByName(rows.where("doc_id is null").select("doc_id", "part", F.col("own").alias("mask"), "rows", none.alias("good"), none.alias("toxic")))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """600 rows a part: every step of every order of the five filters, with what it keeps, removes and shares.

    A null text is empty, a null part the empty string. A null id is no smaller than any and has none smaller, so its row
    fails no E and has no label. Rows that repeat an id with the same text are none of them earlier than another.
    Repeated labels count if any of them does. An empty table has no part and gives no row; other columns are ignored.
    """
    cells = failing(docs, labels, id_col, text_col, part_col).groupBy("part", "mask").agg(*(F.sum(k).alias(k) for k in KINDS))
    whole = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *KINDS)).alias("cells"))  # 32 at most
    return whole.mapInArrow(_audit, SCHEMA)
