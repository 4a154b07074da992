"""Exact top-k search and the audit of filters: brute force, edge cases, and what their methods promise."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import filter_audit, topk_search
from tapeworks.llm.queries import oracle_sql, queries
from tests.compare import assert_same

VECTORS = "vec_id long, embedding array<float>, label int, score long, cell int"


@pytest.mark.parametrize("name", ["op11_topk_search", "op12_filter_audit"])
def test_against_sql(spark, duck, sf_dir, name):
    assert_same(queries()[name](spark, sf_dir).toPandas(), duck.execute(oracle_sql()[name]).df())


def brute(rows, k=5, every=50, scale=256.0):
    """The contract, in plain Python integers."""
    whole = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v):
            whole.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    out = []
    for q, a in sorted({q: a for q, a in whole if q is not None and q % every == 0}.items()):
        scored = [(-max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i is None, i if i is not None else 0) for i, b in whole if i != q]
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


def found(spark, rows, k=5, every=50):
    df = spark.createDataFrame([(i, v, 1, 7, 7) for i, v in rows], VECTORS)
    return sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % every == 0, k=k).collect()))


@pytest.fixture
def small(monkeypatch):
    """Bounds so low that some hundred rows make many cells, groups and parts."""
    for name, value in {"LEAST_ROWS": 16, "GROUP_ROWS": 16, "SLAB_ROWS": 16, "LEAF_ROWS": 8, "MOST_CELLS": 12}.items():
        monkeypatch.setattr(topk_search, name, value)


def clustered(rng, n, d=6, centres=5):
    at = rng.normal(size=(centres, d)) * 20
    return (at[rng.integers(0, centres, n)] + rng.normal(size=(n, d))).astype(np.float32)


@pytest.mark.parametrize("kind", ["sphere", "clusters", "lattice"])
def test_top_k_equals_brute_force(spark, small, kind):
    rng = np.random.default_rng(3)
    m = {"sphere": lambda: rng.normal(size=(400, 8)), "clusters": lambda: clustered(rng, 400), "lattice": lambda: rng.integers(-2, 3, (400, 3)) / 256}[kind]()
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m.astype(np.float32))]
    assert found(spark, rows, every=10) == brute(rows, every=10)


def test_a_third_of_all_rows_alike(spark, small):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(300, 5)).astype(np.float32)
    m[100:200] = m[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    random.Random(1).shuffle(rows)
    assert found(spark, rows, every=25) == brute(rows, every=25)


def test_vectors_of_every_kind(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.5]), (100, []), (150, None), (200, [1.0, None]), (250, [nan, 1.0]), (300, [inf, 0.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]),
            (None, [1.0, 2.0]), (None, None), (3, [-0.001, 0.001]), (-50, [3e30, -3e30]), (4, [3e30, 3e30, 1.0]), (5, [70000.0, 1.5]), (6, [70000.0, -1.5]), (0, [1.0, 2.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, k=100) == brute(rows, k=100)


def test_fewer_rows_than_k_and_none(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, [1.0]), (7, [-1.0])]) == [(0, 1, 7, -65536)]
    assert found(spark, [(1, [1.0]), (7, [-1.0])]) == []


def test_repeated_query_rows_with_other_components(spark):
    got = found(spark, [(0, [1.0]), (0, [2.0]), (1, [1.0]), (2, [3.0])])
    assert [g[:3] for g in got] == [(0, 1, 2), (0, 2, 1)] and got[0][3] in (3 * 65536, 6 * 65536)


def test_wide_vectors_stay_exact():
    """Sums beyond single and double precision."""
    rng = np.random.default_rng(2)
    for most in (100, 1 << 20, 1 << 30):
        q, d = (rng.integers(-most, most, (3, 40)).astype(np.float64) for _ in range(2))
        want = [[max(-(2**63) + 1, min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(x, y)))) for y in d] for x in q]
        assert [[int(v) for v in row] for row in topk_search.products(q, d)] == want


def test_tree_is_nested_and_separated():
    points = np.random.default_rng(5).normal(size=(500, 3))
    tree = topk_search.CoverTree.grow(points, 60)
    top = np.linalg.norm(points - points[0], axis=1).max()
    for j in range(1, 60):
        radius = top / topk_search.BASE ** (tree.level[j] - 1)
        assert tree.level[tree.parent[j]] < tree.level[j]
        assert np.linalg.norm(tree.centres[j] - tree.centres[tree.parent[j]]) <= radius * (1 + 1e-9)
        same = [i for i in range(j) if tree.level[i] <= tree.level[j]]
        assert min(np.linalg.norm(tree.centres[j] - tree.centres[i]) for i in same) > radius / topk_search.BASE * (1 - 1e-9)
    assert sorted(tree.order()) == list(range(60))


def test_walk_prunes_far_cells_and_never_a_needed_one():
    rng = np.random.default_rng(6)
    m = np.floor(256 * clustered(rng, 3000, d=4, centres=30)).astype(np.float64)
    tree = topk_search.CoverTree.grow(m, 64)
    cell, away = tree.nearest(m)
    size, n = np.linalg.norm(m, axis=1), len(tree.level)
    worth = lambda x: np.array([x[cell == c].max(initial=0) for c in range(n)])
    side = topk_search.Side(worth(away), worth(size), np.bincount(cell, minlength=n))
    scores = m @ m.T
    fifth = -np.partition(-scores, 5, axis=1)[:, 5]
    worst = np.array([fifth[cell == c].min(initial=np.inf) for c in range(n)])
    left = set(topk_search.surviving(tree, side, side, worst))
    needed = {(cell[i], cell[j]) for i, j in zip(*np.nonzero(scores >= fifth[:, None]))}
    assert needed <= left
    assert len(left) < 0.6 * n * n


def test_bound_holds_in_every_pair():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a, b = rng.normal(size=(2, 5, 3)) * rng.integers(1, 1000)
        (ca, ra, la), (cb, rb, lb) = topk_search._ball(a), topk_search._ball(b)
        most = topk_search.bound(ca[None], cb[None], np.array([ra]), np.array([rb]), np.array([la]), np.array([lb]))[0]
        assert (a @ b.T).max() <= most


# The audit of filters.

DOCS = "doc_id long, text string, source string, quality long, mask int, rows long, good boolean"
LABELS = "doc_id long, quality int, toxic int, text string"
SPACE = " \t\n\x0b\x0c\r"


def fails(t):
    words, w = [], ""
    for ch in t + " ":
        if ch in SPACE:
            words, w = words + [w] * bool(w), ""
        else:
            w += ch
    return [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t)]


def audit(docs, labels):
    """Every order applied document by document."""
    docs = [(i, t or "", p or "") for i, t, p in docs]
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    label = lambda i, k: i is not None and any(x[0] == i and x[k] == 1 for x in labels)
    out = []
    for part in sorted({p for *_, p in docs}):
        rows = [(fails(t) + [i is not None and first[t] < i], label(i, 1), label(i, 2)) for i, t, p in docs if p == part]
        steps, total = [], [0] * 5
        for order in itertools.permutations(range(5)):
            left = rows
            for k, f in enumerate(order):
                gone, stay = [r for r in left if r[0][f]], [r for r in left if not r[0][f]]
                name = "".join("ABCDE"[x] for x in order)
                alone = sum(r[0][f] and sum(r[0]) == 1 for r in rows)
                steps.append((f, [part, name, k + 1, len(stay), len(gone), sum(r[0][f] for r in rows) - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone)]))
                total[f] += len(gone)
                left = stay
        out += [tuple(s + [total[f]]) for f, s in steps]
    return sorted(out)


def audited(spark, docs, labels):
    d = spark.createDataFrame([(i, t, p, 1, 3, 9, True) for i, t, p in docs], DOCS)
    return sorted(map(tuple, filter_audit.audit_filters(d, spark.createDataFrame([(*x, "t") for x in labels], LABELS)).collect()))


def test_audit_equals_every_order_applied(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(rng.choice([5, 400]))] + ["A B", "X#", "é ñ"], k=rng.choice([0, 49, 50, 51, 120]))) for _ in range(60)]
    docs = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(250)]
    docs += [(300 + i, texts[0], "hot") for i in range(120)]
    docs += [(None, texts[1], "a"), (None, None, None), (500, None, "b"), (501, "", "b"), (7, texts[2], "a"), (7, texts[2], "a"), (502, "\t\n\x0b\x0c\r ", "c"), (503, "x " * 200_000, "c"), (504, "É" * 95 + "ABCDE", "c"), (505, "😀" * 94 + "ABCDEF", "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 400, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (9999, 1, 1)]
    assert audited(spark, docs, labels) == audit(docs, labels)


def test_audit_of_empty_tables(spark):
    assert audited(spark, [], []) == []
    assert audited(spark, [], [(1, 1, 1)]) == []
    assert audited(spark, [(1, "x", "p")], []) == audit([(1, "x", "p")], [])


def test_polynomial_and_shapley_of_any_counts():
    """Corners equal direct sums; values equal marginals over all orders, and add up."""
    rng = np.random.default_rng(9)
    for _ in range(20):
        counts = rng.integers(0, 1 << 40, 32)
        polynomial = filter_audit.removal_polynomial(counts)
        gone = filter_audit.corners(polynomial)
        direct = [sum(int(c) for m, c in enumerate(counts) if m & s) for s in range(32)]
        assert gone.tolist() == direct
        values = filter_audit.shapley(polynomial)
        for f in range(5):
            marginal = 0
            for order in itertools.permutations(range(5)):
                before = sum(1 << x for x in order[: order.index(f)])
                marginal += direct[before | 1 << f] - direct[before]
            assert values[f] == marginal
        assert sum(values) == 120 * direct[31]
