"""Exact top-k search by inner product: a dual-tree walk over a cover tree of all rows.

Queries and data share one tree. Its centres come from a bounded sample by farthest-first traversal, whose order is
that of a cover tree: a centre that enters at distance r from all earlier ones belongs to the level of r, and hangs under
the nearest centre of the levels above. Every row, query or not, is then routed to its nearest centre, and the covering
radii are measured over all rows, so that the sample decides how fast the search is and never what it finds.

With centres a, b and radii r, s, no query of one node scores more with any row of another than
``<a, b> + r |b| + s |a| + r s``, nor more than the product of their largest lengths. The search has two phases:

1. queries meet the rows around their own cell, which gives each query a worst kth score to beat;
2. pairs of nodes are walked from the root down, both sides at once; a pair goes when its bound is below the worst kth
   score of the node's queries. Rows are sent only to the groups of queries which they survive for.

Within a task the same walk is done once more over the rows that met there, with finer cells and rising scores, and leaf
pairs are multiplied as matrices. Cells of any size are dealt in salted parts, so a hot vector is no hot task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm._util import Stash, bound_batches, partitions

#: The tree is fitted on about so many rows, and on so many bytes of them at most.
SAMPLE_ROWS, SAMPLE_BYTES = 8192, 64 << 20
#: Cells of the tree at most; the driver holds a few numbers a cell and walks pairs of cells.
MOST_CELLS = 1024
#: Rows of data and of queries that meet in a task: at most so many, and of so many bytes.
GROUP_ROWS, SLAB_ROWS, GROUP_BYTES = 65_536, 65_536, 64 << 20
#: Fewer rows than this are not split further.
LEAST_ROWS = 512
#: Rows of a leaf within a task: a block of scores has at most the square of it.
LEAF_ROWS = 1024
#: A level's radius is that of the level above over this.
BASE = 2.0
NONE = -(1 << 63)
LAST_ID = (1 << 63) - 1


def scaled(vector: list | None, scale: float) -> np.ndarray | None:
    """floor(scale * x) for every component, or None where the vector takes no part."""
    if vector is None or any(x is None for x in vector):
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.floor(np.asarray(vector, np.float64) * scale)
    return out if np.isfinite(out).all() else None


def scaled_rows(column: pa.Array, scale: float) -> list[np.ndarray | None]:
    """`scaled` of a batch; at once where all vectors are whole and of one length."""
    width = {len(x) if x.is_valid else -1 for x in column[:1]}
    if isinstance(column, pa.ListArray | pa.LargeListArray) and column.null_count == 0 and len(column):
        flat, (d,) = column.flatten(), width
        if flat.null_count == 0 and d > 0 and len(flat) == d * len(column) and (np.diff(column.offsets.to_numpy()) == d).all():
            with np.errstate(over="ignore", invalid="ignore"):
                m = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d) * scale)
            good = np.isfinite(m).all(axis=1)
            return [row if ok else None for row, ok in zip(m, good)]
    return [scaled(v.as_py(), scale) for v in column]


def pack(v: np.ndarray) -> tuple[bool, bytes]:
    """Whole numbers as 4-byte floats where these are exact, else as 8-byte ones."""
    wide = bool(len(v)) and float(np.abs(v).max()) >= 1 << 24
    return wide, v.astype(np.float64 if wide else np.float32).tobytes()


def unpack(wide: list[bool], vecs: list[bytes], d: int = 0) -> np.ndarray:
    """The rows as a matrix; shorter vectors end in zeros, which change no product with the longer ones."""
    rows = [np.frombuffer(b, np.float64 if w else np.float32) for w, b in zip(wide, vecs)]
    d = max([d, *map(len, rows)])
    out = np.zeros((len(rows), d), np.float64 if any(wide) else np.float32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def widened(m: np.ndarray, d: int) -> np.ndarray:
    return m if m.shape[1] == d else np.pad(m, ((0, 0), (0, d - m.shape[1])))


@dataclass
class CoverTree:
    """Centres in the order they entered, each with its level and its parent among the levels above."""

    centres: np.ndarray
    level: np.ndarray
    parent: np.ndarray

    @classmethod
    def grow(cls, points: np.ndarray, most: int) -> CoverTree:
        """A tree over some of the points: farthest first, until `most` centres or no point is apart."""
        points = np.asarray(points, np.float64)
        if not len(points):
            points = np.zeros((1, points.shape[1] if points.ndim == 2 else 0))
        near = _away(points, points[0])
        chosen, level, parent, top = [0], [0], [0], None
        while len(chosen) < min(most, len(points)):
            i = int(np.argmax(near))
            if not 0 < near[i] < np.inf:
                break
            top = top or near[i]
            lv = 1 + int(np.floor(np.log(top / near[i]) / np.log(BASE)))
            above = [j for j, x in enumerate(level) if x < lv]
            parent.append(above[int(np.argmin(_away(points[[chosen[j] for j in above]], points[i])))])
            chosen.append(i)
            level.append(lv)
            near = np.minimum(near, _away(points, points[i]))
        return cls(points[chosen], np.array(level), np.array(parent))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest centre and its distance to it."""
        if rows.shape[1] != self.centres.shape[1]:
            d = max(rows.shape[1], self.centres.shape[1])
            rows, centres = widened(rows, d), widened(self.centres, d)
        else:
            centres = self.centres
        half = (centres**2).sum(axis=1) / 2
        cell = np.concatenate([np.argmin(half - rows[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(rows), 4096)] or [np.zeros(0, int)])
        return cell, np.linalg.norm(rows - centres[cell], axis=1)

    def order(self) -> list[int]:
        """The centres depth first, so that neighbours in the list are neighbours in the tree."""
        below: dict[int, list[int]] = {}
        for j in range(1, len(self.level)):
            below.setdefault(int(self.parent[j]), []).append(j)
        out, todo = [], [0]
        while todo:
            j = todo.pop()
            out.append(j)
            todo += reversed(below.get(j, []))
        return out


def _away(points: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.linalg.norm(points - x, axis=1)


@dataclass
class Side:
    """What is measured of the queries, or of all rows, of every cell: a radius, the largest length, how many."""

    radius: np.ndarray
    length: np.ndarray
    rows: np.ndarray


def bound(a: np.ndarray, b: np.ndarray, r: np.ndarray, s: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """The most that a row of node i can score with one of node j, for arrays of pairs; rounding is allowed for."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    most = np.minimum((a * b).sum(axis=1) + r * nb + s * na + r * s, la * lb)
    most = most + 1 + 1e-9 * ((na + r) * (nb + s) + la * lb)
    return np.where(np.isnan(most), np.inf, most)


def surviving(tree: CoverTree, q: Side, d: Side, worst: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (cell of queries, cell of rows) that the walk from the root leaves; `worst` is each cell's score to beat."""
    last, n = int(tree.level.max()), len(tree.level)
    apart = _away(tree.centres, tree.centres[tree.parent]) if n > 1 else np.zeros(n)
    # A node of level l is a centre of level l or above; below it are itself and the centres of level l + 1 that hang under it.
    levels = [None] * (last + 1)
    state = [np.where(s.rows > 0, s.radius, -np.inf).astype(float) for s in (q, d)] + [np.where(s.rows > 0, s.length, 0.0) for s in (q, d)] + [np.where(q.rows > 0, worst, np.inf)]
    for lv in range(last, -1, -1):
        levels[lv] = [x.copy() for x in state]
        for j in np.flatnonzero(tree.level == lv) if lv else []:
            p = tree.parent[j]
            for k in (0, 1):
                state[k][p] = max(state[k][p], state[k][j] + apart[j])
            for k in (2, 3):
                state[k][p] = max(state[k][p], state[k][j])
            state[4][p] = min(state[4][p], state[4][j])
    at, other = np.array([0]), np.array([0])
    for lv in range(last + 1):
        if lv:
            kids = [[j] for j in range(n)]
            for j in np.flatnonzero(tree.level == lv):
                kids[tree.parent[j]].append(int(j))
            pairs = [(x, y) for i, j in zip(at, other) for x in kids[i] for y in kids[j]]
            at, other = np.array(pairs, int).reshape(-1, 2).T
        rq, rd, lq, ld, w = levels[lv]
        keep = (rq[at] >= 0) & (rd[other] >= 0)
        at, other = at[keep], other[keep]
        step = 1 << 14
        ok = [bound(tree.centres[at[i : i + step]], tree.centres[other[i : i + step]], rq[at[i : i + step]], rd[other[i : i + step]], lq[at[i : i + step]], ld[other[i : i + step]]) >= w[at[i : i + step]] for i in range(0, len(at), step)]
        ok = np.concatenate(ok) if ok else np.zeros(0, bool)
        at, other = at[ok], other[ok]
    return list(zip(at.tolist(), other.tolist()))


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: floats while every sum is exact in them, else Python's integers, held to
    the range of a LONG."""
    d_ = max(q.shape[1], d.shape[1])
    q, d = widened(q, d_), widened(d, d_)
    most = d_ * float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0))
    if most < 1 << 24:
        return q.astype(np.float32, copy=False) @ d.astype(np.float32, copy=False).T
    if most < 1 << 53:
        return q.astype(np.float64) @ d.astype(np.float64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(q).dot(whole(d).T), NONE + 1, LAST_ID).astype(np.int64)


class Best:
    """The k best (score, id) so far of some queries; `floor` is a score that a query is known to reach elsewhere."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.query, self.k = ids, k
        self.score, self.id = np.full((len(ids), k), NONE, np.int64), np.full((len(ids), k), LAST_ID, np.int64)
        self.floor = floor

    def worst(self) -> np.ndarray:
        return np.maximum(self.floor, self.score[:, -1])

    def take(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Offers rows `ids`, in ascending order, with their scores for the queries `at`."""
        whole = scores.dtype == np.int64
        low = np.int64(NONE) if whole else scores.dtype.type(-np.inf)
        own = np.searchsorted(ids, self.query[at]), np.searchsorted(ids, self.query[at], side="right")
        for i in np.flatnonzero(own[1] > own[0]):
            scores[i, own[0][i] : own[1][i]] = low
        worst = self.worst()[at]
        # A tie may still win by its smaller id. No score is as low as NONE, so a query without a score takes any.
        some = np.flatnonzero(scores.max(axis=1) >= (worst if whole else worst.astype(np.float64)))
        if not len(some):
            return
        s, k = scores[some], min(self.k, scores.shape[1])
        cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        over, tie = s > cut[:, None], s == cut[:, None]
        tie &= np.cumsum(tie, axis=1) <= k - over.sum(axis=1)[:, None]
        i, j = np.nonzero((over | tie) & (s != low))
        rows, got = some[i], s[i, j].astype(np.int64)
        for r in np.unique(rows):
            mine, q = rows == r, at[r]
            score = np.concatenate([self.score[q], got[mine]])
            ident = np.concatenate([self.id[q], ids[j[mine]]])
            # Descending by score without negating the least LONG.
            best = np.lexsort((ident, ~score))[: self.k]
            self.score[q], self.id[q] = score[best], ident[best]


def leaves(m: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    """The rows of a matrix in cells of a small cover tree, LEAF_ROWS at most each and in `order` within each."""
    if len(m) <= LEAF_ROWS:
        return [order]
    step = max(1, len(m) // SAMPLE_ROWS)
    cell = CoverTree.grow(m[::step].astype(np.float64), max(2, 2 * len(m) // LEAF_ROWS)).nearest(m.astype(np.float64))[0][order]
    out = []
    for c in np.unique(cell):
        rows = order[cell == c]
        out += [rows[i : i + LEAF_ROWS] for i in range(0, len(rows), LEAF_ROWS)]
    return out


def _ball(m: np.ndarray) -> tuple[np.ndarray, float, float]:
    m = m.astype(np.float64)
    centre = m.mean(axis=0)
    return centre, float(np.linalg.norm(m - centre, axis=1).max()), float(np.linalg.norm(m, axis=1).max())


def search(q: np.ndarray, best: Best, d: np.ndarray, ids: np.ndarray) -> None:
    """The walk over the rows of a task: for each leaf of queries, leaves of rows by falling bound, until none can help."""
    width = max(q.shape[1], d.shape[1])
    q, d = widened(q, width), widened(d, width)
    cells = [(rows, *_ball(d[rows])) for rows in leaves(d, np.argsort(ids, kind="stable"))]
    centre, radius, length = np.array([c[1] for c in cells]), np.array([c[2] for c in cells]), np.array([c[3] for c in cells])
    for at in leaves(q, np.arange(len(q))):
        c, r, size = _ball(q[at])
        n = len(cells)
        most = bound(np.repeat(c[None], n, axis=0), centre, np.full(n, r), radius, np.full(n, size), length)
        for j in np.argsort(-most, kind="stable"):
            if most[j] < best.worst()[at].min():
                break
            rows = cells[j][0]
            best.take(at, ids[rows], products(q[at], d[rows]))


def _routed(vectors: DataFrame, tree: CoverTree, scale: float) -> DataFrame:
    """Every row that takes part: its cell, its id, its whole numbers and its distance from the cell's centre."""

    def run(batches):
        for batch in batches:
            keep = [(i, v) for i, v in enumerate(scaled_rows(batch.column(2), scale)) if v is not None]
            if not keep:
                continue
            packed = [pack(v) for _, v in keep]
            rows = unpack([True] * len(keep), [v.astype(np.float64).tobytes() for _, v in keep])
            cell, away = tree.nearest(rows)
            pick = pa.array([i for i, _ in keep], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), batch.column(0).take(pick), batch.column(1).take(pick), pa.array([w for w, _ in packed]), pa.array([b for _, b in packed], pa.binary()), pa.array(away), pa.array(np.linalg.norm(rows, axis=1))],
                ["cell", "vec_id", "is_query", "wide", "vec", "away", "length"],
            )

    return vectors.mapInArrow(run, "cell int, vec_id long, is_query boolean, wide boolean, vec binary, away double, length double")


def _met(k: int):
    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(q) and len(d):
            ids = d["vec_id"].fill_null(LAST_ID).to_numpy()
            floor = q["floor"].fill_null(NONE).to_numpy()
            best = Best(q["query_id"].to_numpy(), floor, k)
            search(unpack(q["wide"].to_pylist(), q["vec"].to_pylist()), best, unpack(d["wide"].to_pylist(), d["vec"].to_pylist()), ids)
            i, j = np.nonzero((best.score != NONE) & (best.score >= floor[:, None]))
            out = best.query[i], best.id[i, j], best.score[i, j]
        ids = pa.array(out[1], pa.int64())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.compute.if_else(pa.compute.equal(ids, LAST_ID), None, ids), "score": pa.array(out[2], pa.int64())})

    return run


def _groups(order: list[int], rows: np.ndarray, most: int) -> tuple[dict[int, int], list[int]]:
    """Neighbouring cells in groups of at most `most` rows; a larger cell is a group of its own, dealt in parts.

    Gives each cell's group and each group's number of parts.
    """
    group, parts, filled = {}, [], most
    for c in order:
        n = int(rows[c])
        if n == 0:
            continue
        if filled + n > most:
            parts.append(-(-n // most))
            filled = 0
        group[c] = len(parts) - 1
        filled += n
    return group, parts


def _meet(spark: SparkSession, queries: DataFrame, rows: DataFrame, q_plan: list[tuple], d_plan: list[tuple], k: int) -> DataFrame:
    """Sends queries and rows to where they meet, by two plans of at most MOST_CELLS rows, and searches there."""
    q_to = spark.createDataFrame(q_plan, "cell int, qg int, q_parts int, to array<struct<dg:int,first:int,end:int>>")
    d_to = spark.createDataFrame(d_plan, "cell int, dg int, d_parts int, to array<struct<qg:int,q_parts:int>>")
    part = lambda n: F.expr(f"cast(pmod(xxhash64(vec_id, vec), {n}) as int)")
    until = lambda n, start=0: F.explode(F.sequence(F.lit(start) if isinstance(start, int) else start, n - 1))
    q = queries.join(F.broadcast(q_to), "cell").select("query_id", "floor", "wide", "vec", "qg", F.expr("cast(pmod(xxhash64(query_id), q_parts) as int)").alias("qs"), F.explode("to").alias("t"))
    q = q.select("query_id", "floor", "wide", "vec", "qg", "qs", F.col("t.dg").alias("dg"), until(F.col("t.end"), F.col("t.first")).alias("ds"))
    d = rows.join(F.broadcast(d_to), "cell").select("vec_id", "wide", "vec", "dg", part("d_parts").alias("ds"), F.explode("to").alias("t"))
    d = d.select("vec_id", "wide", "vec", F.col("t.qg").alias("qg"), until(F.col("t.q_parts")).alias("qs"), "dg", "ds")
    key = ["qg", "qs", "dg", "ds"]
    return q.groupBy(*key).cogroup(d.groupBy(*key)).applyInArrow(lambda a, b: _met(k)(a, b), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows that score highest with each query, by the inner product of
    floor(scale * x); all if there are fewer. Ties go to the smaller id.

    `is_query` tells which rows are queries; a row whose id is the query's is the query's own and no candidate of it.
    Vectors that are null or hold a null, or a component that is not finite once scaled, take no part. Shorter vectors
    end in zeros; an empty one scores 0. Repeated rows are candidates one by one. Where rows repeat a query's id, one of
    them is the query (the least as bytes). A row with a null id is a candidate, after all others of its score, and no
    query; the id 2**63 - 1 is kept for it. Scores past the range of a LONG are held to it. An empty table gives
    an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    stash = Stash(spark, "topk")
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query.cast("boolean"), F.lit(False)).alias("is_query"), F.col(vector_col).cast("array<double>").alias("v"))
    n, width = (max(1, x or 0) for x in slim.agg(F.count("*"), F.max(F.size("v"))).first())
    share = min(1.0, 1.25 * SAMPLE_ROWS / n)
    chance = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(share * (1 << 30))
    few = max(16, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    picked = [v for row in slim.where(chance & F.col("v").isNotNull()).select("v").limit(few).collect() if (v := scaled(row.v, scale)) is not None]

    room = GROUP_BYTES // (8 * width)
    fit = max(LEAST_ROWS, min(GROUP_ROWS, room, n // (4 * partitions(spark))))
    tree = CoverTree.grow(unpack([True] * len(picked), [v.tobytes() for v in picked], 1), max(1, min(MOST_CELLS, 2 * n // fit)))
    rows = stash.write(_routed(slim, tree, scale), "rows")

    cells = len(tree.level)
    q_only = lambda c: F.max(F.when(F.col("is_query"), F.col(c)))
    stats = rows.groupBy("cell").agg(F.max("away"), F.max("length"), F.count("*"), q_only("away"), q_only("length"), F.count(F.when(F.col("is_query"), 1))).collect()
    table = np.zeros((6, cells))
    for s in stats:
        table[:, s[0]] = [x or 0 for x in s[1:]]
    d_side, q_side = Side(*table[:3]), Side(*table[3:])
    order = tree.order()
    dg, d_parts = _groups(order, d_side.rows, fit)
    qg, q_parts = _groups(order, q_side.rows, max(LEAST_ROWS, min(SLAB_ROWS, room)))

    own = rows.where("is_query and vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("vec", "wide", "cell")).alias("x"))
    queries = own.select(F.col("vec_id").alias("query_id"), "x.vec", "x.wide", "x.cell")
    # First around home: each query with the first part of its own cell's group.
    home = {g: sorted({qg[c] for c in qg if dg[c] == g}) for g in set(dg.values())}
    q_plan = [(c, g, q_parts[g], [(dg[c], 0, 1)]) for c, g in qg.items()]
    d_plan = [(c, g, d_parts[g], [(x, q_parts[x]) for x in home[g]]) for c, g in dg.items()]
    first_part = rows.join(F.broadcast(spark.createDataFrame([(c, d_parts[g]) for c, g in dg.items()], "cell int, n int")), "cell").where("pmod(xxhash64(vec_id, vec), n) = 0").drop("n")
    near = stash.write(_meet(spark, queries.withColumn("floor", F.lit(None).cast("long")), first_part, q_plan, d_plan, k), "near")

    floors = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    known = stash.write(queries.join(floors, "query_id", "left"), "queries")
    worst = np.full(cells, -np.inf)
    for c, none, least in known.groupBy("cell").agg(F.count_if(F.col("floor").isNull()), F.min("floor")).collect():
        worst[c] = -np.inf if none else least
    # Then all else that the walk leaves. A query's first meeting is not repeated.
    to_d: dict[int, set[int]] = {}
    to_q: dict[int, set[int]] = {}
    for c, e in surviving(tree, q_side, d_side, worst):
        if dg[e] == dg[c] and d_parts[dg[e]] == 1:
            continue
        to_d.setdefault(c, set()).add(dg[e])
        to_q.setdefault(e, set()).add(qg[c])
    q_plan = [(c, qg[c], q_parts[qg[c]], [(g, int(g == dg[c]), d_parts[g]) for g in sorted(gs)]) for c, gs in to_d.items()]
    d_plan = [(c, dg[c], d_parts[dg[c]], [(g, q_parts[g]) for g in sorted(gs)]) for c, gs in to_q.items()]
    every = near.unionByName(_meet(spark, known, rows, q_plan, d_plan, k)) if q_plan else near
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
