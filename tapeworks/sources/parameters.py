"""Example parametrisations: six-type order flows, two-type pairs, marks.

Types in order: market buy, market sell, limit buy, limit sell, withdraw buy, withdraw sell.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tapeworks import schema
from tapeworks.operators.hawkes import Hawkes

# Baselines and kernels of the example flows, decay 4 throughout.
DECAY = 4.0
FLOWS = {
    "resilient": (
        [0.5126447854, 0.5126447854, 0.1402833873, 0.1402833873, 4.1410981517, 4.1410981517],
        [
            [1.5541514008, 0.3453669780, 0.0518050467, 0.0518050467, 0.1726834890, 0.1726834890],
            [0.3453669780, 1.5541514008, 0.0518050467, 0.0518050467, 0.1726834890, 0.1726834890],
            [0.1726834890, 3.2809862906, 0.1726834890, 0.1726834890, 3.2809862906, 0.1726834890],
            [3.2809862906, 0.1726834890, 0.1726834890, 0.1726834890, 0.1726834890, 3.2809862906],
            [0.1726834890, 0.1726834890, 0.1726834890, 0.1726834890, 0.1726834890, 0.1726834890],
            [0.1726834890, 0.1726834890, 0.1726834890, 0.1726834890, 0.1726834890, 0.1726834890],
        ],
    ),
    "trending": (
        [0.4591361692, 0.4591361692, 4.0173011153, 4.0173011153, 1.9496606913, 1.9496606913],
        [
            [0.9001807356, 0.0150030123, 0.0045009037, 0.0045009037, 0.0150030123, 0.9001807356],
            [0.0150030123, 0.9001807356, 0.0045009037, 0.0045009037, 0.9001807356, 0.0150030123],
            [0.9001807356, 0.0150030123, 0.9001807356, 0.0150030123, 0.0150030123, 0.9001807356],
            [0.0150030123, 0.9001807356, 0.0150030123, 0.9001807356, 0.9001807356, 0.0150030123],
            [0.0150030123, 0.9001807356, 0.0150030123, 0.9001807356, 0.9001807356, 0.0150030123],
            [0.9001807356, 0.0150030123, 0.9001807356, 0.0150030123, 0.0150030123, 0.9001807356],
        ],
    ),
    "balanced": (
        [0.4423762335, 0.4423762335, 0.5213350222, 0.5213350222, 1.1402427313, 1.1402427313],
        [
            [1.2951261673, 0.2878058150, 0.0431708722, 0.0431708722, 0.1439029075, 0.1439029075],
            [0.2878058150, 1.2951261673, 0.0431708722, 0.0431708722, 0.1439029075, 0.1439029075],
            [0.1439029075, 2.7341552420, 0.1439029075, 0.1439029075, 2.7341552420, 0.1439029075],
            [2.7341552420, 0.1439029075, 0.1439029075, 0.1439029075, 0.1439029075, 2.7341552420],
            [0.1439029075, 0.1439029075, 0.1439029075, 0.1439029075, 0.1439029075, 0.1439029075],
            [0.1439029075, 0.1439029075, 0.1439029075, 0.1439029075, 0.1439029075, 0.1439029075],
        ],
    ),
}
# Two-type pairs.
PAIRS = {
    "self_exciting": ([0.25, 0.25], [[2.8, 0.2], [0.2, 2.8]]),
    "cross_exciting": ([0.25, 0.25], [[0.2, 2.8], [2.8, 0.2]]),
    "asymmetric": ([0.2, 0.6], [[1.2, 4.8], [0.4, 0.8]]),
    "weakly_exciting": ([0.9, 0.9], [[0.3, 0.1], [0.1, 0.3]]),
    "one_way": ([0.4, 0.1], [[0.8, 0.0], [4.0, 2.4]]),
}
# Depth decay, mean and deviation of log size, lot.
MARKS = {
    "resilient": (0.08, 4.0, 0.8, 10),
    "trending": (0.15, 4.0, 0.8, 10),
    "shallow": (0.45, 4.0, 0.8, 10),
    "deep": (0.02, 4.0, 0.8, 10),
    "unit": (0.2, 0.0, 0.01, 1),
    "uncertain_size": (0.2, 4.2851701860, 0.8, 1),
}
UNCERTAIN_SIZE_UNIT = 100


@dataclass(frozen=True)
class Marks:
    """How an event becomes an order: price offsets and sizes."""

    depth_decay: float
    mean_log_size: float
    sigma_log_size: float
    lot: int

    def __post_init__(self):
        if not 0 < self.depth_decay <= 1 or self.sigma_log_size <= 0 or self.lot < 1:
            raise ValueError(f"marks out of range: {self}")

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.depth_decay, self.mean_log_size, self.sigma_log_size, self.lot)], schema.MARKS)

    @classmethod
    def from_frame(cls, df: DataFrame) -> Marks:
        rows = df.limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"marks are one row, got {len(rows)}")
        return cls(*rows[0])


def flow(name: str) -> Hawkes:
    mu, a = (FLOWS | PAIRS)[name]
    return Hawkes(np.array(mu), np.array(a), DECAY)


def marks(name: str) -> Marks:
    return Marks(*MARKS[name])


def to_json(df: DataFrame) -> str:
    """A small parameter frame as JSON records; NULL for everything undefined."""
    rows = df.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("only parameter frames of at most 10000 rows are written as one JSON text")
    return json.dumps([r.asDict(recursive=True) for r in rows], default=str)


def from_json(spark: SparkSession, text: str, schema_) -> DataFrame:
    names = [f.name for f in schema_.fields]
    records = json.loads(text)
    for r in records:
        if set(r) != set(names):
            raise ValueError(f"a record has {sorted(r)}, not {sorted(names)}")
    cast = {"double": float, "bigint": int, "int": int}
    kinds = {f.name: cast.get(f.dataType.simpleString(), lambda x: x) for f in schema_.fields}
    return spark.createDataFrame([tuple(None if r[n] is None else kinds[n](r[n]) for n in names) for r in records], schema_)
