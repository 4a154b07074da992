"""SimHash near-duplicate classes by a generalised pigeonhole search.

Fingerprints of 64 bits are cut into m groups of bits. Correlated bits share a group. Any two
fingerprints within `radius` bits agree, in some group i, up to t_i bits whenever the thresholds
t_i >= -1 add up to radius - m + 1 (-1 leaves a group out). The thresholds are chosen by dynamic
programming on estimated candidate counts; the estimates come from the first two moments of the
distance of two random fingerprints on each group, which follow exactly from the 64 x 64 table of
joint bit counts over all fingerprints. Groups are probed by key, candidates verified on all bits.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm._util import Stash, lean, partitions
from tapeworks.llm.components import connected_components
from tapeworks.llm.exact_dedup import drop_ids

BITS = 64
SEED = 42
#: Shingles whose bits are counted in one go.
SHINGLE_BLOCK = 1 << 16
#: A key with more members than this is split into blocks of about this many.
BLOCK_ROWS = 2048
#: Members compared in one go.
BUFFER_ROWS = 1 << 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text: a bit is set where over half of the shingles' XXH64 have it set."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    n, counts = len(starts), np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, SHINGLE_BLOCK):
        block = [digest(joined[a:b], SEED) for a, b in zip(starts[i : i + SHINGLE_BLOCK].tolist(), ends[i : i + SHINGLE_BLOCK].tolist())]
        hashes = np.array(block, np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            out = np.fromiter((fingerprint(texts[i].as_py(), shingle) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(lean(run), "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each pair of bits, in how many both are set.

    A fixed number of sums, whatever the number of rows or tasks, reaches the driver.
    """

    def run(batches):
        joint, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for i in range(0, len(values), BUFFER_ROWS):
                part = np.ascontiguousarray(values[i : i + BUFFER_ROWS])
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                joint += np.rint(bits.T @ bits).astype(np.int64)
                n += len(part)
        if n:
            flat = np.concatenate([[n], joint.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["k", "s"])

    sums = fps.select("fp").mapInArrow(run, "k int, s long").groupBy("k").agg(F.sum("s").alias("s")).collect()
    flat = np.zeros(1 + BITS * BITS, np.int64)
    for row in sums:
        flat[row.k] = row.s
    return int(flat[0]), flat[1:].reshape(BITS, BITS)


def group_bits(n: int, joint: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about 64 / m bits, correlated bits together (greedy)."""
    p = np.diag(joint) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((joint / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    free, groups = set(range(BITS)), []
    for g in range(m):
        room = BITS * (g + 1) // m - BITS * g // m
        left = sorted(free)
        sub = r[np.ix_(left, left)]
        group = [left[int(np.argmax(sub.max(axis=1)))]]
        free.discard(group[0])
        while len(group) < room:
            left = sorted(free)
            best = left[int(np.argmax(r[np.ix_(left, group)].sum(axis=1)))]
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def close_share(n: int, joint: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Estimated shares of pairs of fingerprints within 0..most bits of each other on `bits`.

    Mean and variance of the distance are exact for random pairs; a beta-binomial law is fitted.
    """
    w = len(bits)
    j = joint[np.ix_(bits, bits)] / max(n, 1)
    p = np.diag(j)
    both = 2 * (j * (1 - p[:, None] - p[None, :] + j) + (p[:, None] - j) * (p[None, :] - j))
    single = 2 * p * (1 - p)
    mean = float(single.sum())
    np.fill_diagonal(both, single)
    var = max(float(both.sum()) - mean**2, 1e-9)
    q = min(max(mean / w, 1e-6), 1 - 1e-6)
    rho = min(max((var / (w * q * (1 - q)) - 1) / max(w - 1, 1), 1e-6), 0.999)
    a, b = q * (1 / rho - 1), (1 - q) * (1 / rho - 1)
    lb = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    pmf = [math.exp(math.lgamma(w + 1) - math.lgamma(k + 1) - math.lgamma(w - k + 1) + lb(k + a, w - k + b) - lb(a, b)) for k in range(most + 1)]
    return list(np.minimum(np.cumsum(pmf), 1.0))


def plan(n: int, joint: np.ndarray, radius: int, probe_cost: float = 60.0, pair_cost: float = 1.0) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds (groups left out are not returned).

    probe_cost and pair_cost weigh a shuffled probe row against a verified pair.
    """
    best = (math.inf, [])
    for m in range(2, radius + 2):
        groups = group_bits(n, joint, m)
        goal = radius - m + 1
        cost = []
        for bits in groups:
            share = close_share(n, joint, bits, goal + m)
            rows = [1.0 + sum(math.comb(len(bits), k) / 2 for k in range(1, t + 1)) for t in range(goal + m)]
            cost.append({-1: 0.0} | {t: probe_cost * n * rows[t] + pair_cost * share[t] * n * n / 2 for t in range(goal + m)})
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # sum of (t + 1) so far -> cost, thresholds
        for c in cost:
            after: dict[int, tuple[float, list[int]]] = {}
            for used, (total, ts) in table.items():
                for t, x in c.items():
                    k = used + t + 1
                    if k <= goal + m and (k not in after or total + x < after[k][0]):
                        after[k] = (total + x, [*ts, t])
            table = after
        total, ts = table[goal + m]
        if total < best[0]:
            best = (total, [(g, t) for g, t in zip(groups, ts) if t >= 0])
    return best[1]


def _keys(values: np.ndarray, bits: list[int]) -> np.ndarray:
    key = np.zeros(len(values), np.uint64)
    for k, b in enumerate(bits):
        key |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return key


def probes(fps: DataFrame, groups: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp, own): each fingerprint under its own key and, up to each group's threshold, under
    neighbouring keys. Of two differing keys only one side needs to move to the other: flips are
    emitted where the lowest flipped bit is 0."""

    def run(batches):
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for i, (bits, t) in enumerate(groups):
                key = _keys(values, bits)
                out = [(key, values, 1)]
                for k in range(1, t + 1):
                    for flips in itertools.combinations(range(len(bits)), k):
                        low = (key >> np.uint64(flips[0])) & np.uint64(1) == 0
                        out.append((key[low] ^ np.uint64(sum(1 << f for f in flips)), values[low], 0))
                for keys, who, own in out:
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, i, np.int8)), pa.array(keys.view(np.int64)), pa.array(who.view(np.int64)), pa.array(np.full(n, own, np.int8))],
                        ["part", "key", "fp", "own"],
                    )

    return fps.select("fp").mapInArrow(run, "part byte, key long, fp long, own byte")


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    root = parent[x]
    while True:
        up = parent[root]
        if np.array_equal(up, root):
            parent[x] = root
            return root
        root = up


def _forest(group: np.ndarray, fp: np.ndarray, own: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by group: the smallest row that each row is linked to inside its group.

    All pairs of a group are compared, offset by offset; links only move pointers, so that memory
    stays in proportion to the rows."""
    n = len(fp)
    parent = np.arange(n)
    at, k = np.arange(n), 1
    while True:
        at = at[at + k < n]
        at = at[group[at] == group[at + k]]
        if not len(at):
            return _find(parent, np.arange(n))
        a, b = at, at + k
        close = (np.bitwise_count(fp[a] ^ fp[b]) <= radius) & (own[a] | own[b]).astype(bool)
        a, b = a[close], b[close]
        while len(a):
            ra, rb = _find(parent, a), _find(parent, b)
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            parent[np.maximum(ra, rb)] = np.minimum(ra, rb)
        k += 1


def _verify(columns: list[str], radius: int):
    """A mapInArrow function over rows sorted by `columns`: links (u, v), at most one a row."""

    def links(table: pd.DataFrame):
        ids = table[columns]
        group = (ids != ids.shift()).any(axis=1).to_numpy().cumsum()
        fp = table["fp"].to_numpy().view(np.uint64)
        root = _forest(group, fp, table["own"].to_numpy(), radius)
        u, v = fp.view(np.int64), fp.view(np.int64)[root]
        keep = u != v
        return pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

    def run(batches):
        held = None
        for batch in batches:
            rows = batch.to_pandas()
            held = rows if held is None else pd.concat([held, rows], ignore_index=True)
            if len(held) < BUFFER_ROWS:
                continue
            tail = held[columns].iloc[-1]
            same = (held[columns] == tail).all(axis=1).to_numpy()
            cut = len(held) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield links(held.iloc[:cut].reset_index(drop=True))
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield links(held)

    return run


def link_fingerprints(fps: DataFrame, radius: int = 3, block_rows: int = BLOCK_ROWS, stash: Stash | None = None) -> DataFrame:
    """(u, v): links between distinct fingerprints within `radius` bits; enough of them to connect
    every class, at most one a probe row. `fps` has one row a distinct fingerprint (column fp).

    A key with more than `block_rows` members is dealt to pairs of blocks, so that no task gathers
    an unbounded group and the whole group is still compared.
    """
    spark = fps.sparkSession
    stash = stash or Stash(spark, "gph")
    n, joint = bit_statistics(fps)
    if n < 2:
        return spark.createDataFrame([], "u long, v long")
    rows = stash.write(probes(fps, plan(n, joint, radius)), "probes")
    hot = stash.write(rows.groupBy("part", "key").agg(F.count("*").alias("c")).where(F.col("c") > block_rows).withColumn("blocks", F.ceil(F.col("c") / block_rows).cast("int")).drop("c"), "hot", n)
    ways = partitions(spark)
    some_hot = not hot.isEmpty()
    cold = rows.join(hot, ["part", "key"], "left_anti") if some_hot else rows
    cold = cold.repartition(ways, "part", "key").sortWithinPartitions("part", "key")
    out = cold.mapInArrow(_verify(["part", "key"], radius), "u long, v long")
    if some_hot:
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        dealt = rows.join(hot, ["part", "key"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("part", "key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "fp", "own")
        dealt = dealt.repartition(ways, "part", "key", "x", "y").sortWithinPartitions("part", "key", "x", "y")
        out = out.unionByName(dealt.mapInArrow(_verify(["part", "key", "x", "y"], radius), "u long, v long"))
    links = stash.write(out.distinct(), "links", n)
    stash.drop(rows, hot)
    return links


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Null and empty texts have fingerprint zero and link like any other. A null id is kept; its class
    is named by the smallest id that is not null, or null if there is none. Rows that repeat an id
    are rows of their own. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "simhash")
    marked = stash.write(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    n = marked.count()
    reps = stash.write(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct", n)
    labels = connected_components(link_fingerprints(reps, radius, stash=stash))
    # Written, so that a large class or a hot fingerprint meets its name in rows that can be split between tasks.
    rooted = stash.write(reps.join(labels.toDF("fp", "root"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted", n)
    named = stash.write(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "named", n)
    classes = stash.write(rooted.join(named, "root").select("fp", "component_id"), "classes", n)
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One document of every near-duplicate class, that with the smallest id, with all its columns.

    Rows with a null id stay; rows that repeat the smallest id are one document and stay together.
    """
    classes = near_duplicate_classes(docs, id_col, text_col, shingle, radius)
    return drop_ids(docs, classes.where("doc_id <> component_id").select("doc_id"), id_col)
