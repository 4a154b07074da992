"""Compares a Spark result with an oracle's, whatever the order of rows and columns."""

import math

import pandas as pd


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return float(f"{v:.9g}") if isinstance(v, float) else v

    def key(row):
        return tuple((v is None, "" if v is None else "n" if isinstance(v, (int, float)) else "s", 0 if v is None else float(v) if isinstance(v, (int, float)) else str(v)) for v in row)

    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=key)


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9)
    return a == b


def assert_same(got: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(expected.columns)
    a, b = rows_of(got), rows_of(expected)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(map(same, x, y)), (x, y)
