"""Benchmark decontamination by SimHash windows of item size.

For every benchmark item, windows of as many words slide over a document. A window's SimHash is looked
up in a multi-index: the 64 bits are cut into blocks, and any fingerprint within the radius differs in
some block by few bits only, so the blocks' tables give all items within the radius. Candidates are
verified by the exact similarity of their word shingles: the multiset Jaccard index, or the one in which a
shingle weighs the less the more distinct items of the whole benchmark have it, whichever is higher.

Weights of shingles that benchmark texts share are broadcast up to a checked number of them; beyond it, windows within
the radius hand on their shingles and meet the weights in a join. Items come in slices of a checked size. Where there
are several, each slice's result is written and its index released before the next.

A window that shares no shingle with an item has similarity zero, so windows are only fingerprinted
where they hold a shingle of an item of their size; this drops none that could be verified.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm import _tokens
from tapeworks.llm._util import Stash, bound_batches, give_back, lean

SHINGLE = 5
SIMILARITY = 0.8
#: Two windows of similarity 0.8 differ by about 10 of 64 bits; twice that leaves hardly any out.
RADIUS, BLOCKS, BLOCK_RADIUS = 20, 7, 2
#: Items are broadcast in slices of at most so many words; a larger benchmark takes more passes.
SLICE_WORDS = 2_000_000
#: Shared shingles (16 bytes each) that are broadcast at most.
SHARED_SHINGLES = 4_000_000
#: Windows fingerprinted in one go.
WINDOW_BLOCK = 4096
TEXT_BLOCK = 4 << 20
_GATE_BITS = 20

# Upper case becomes lower case and ASCII punctuation nothing; white space and all else stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_DROP = np.zeros(256, bool)
_DROP[[b for b in range(128) if not chr(b).isalnum() and not _tokens.SPACE[b]]] = True


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the folded words of an array of texts, and the n + 1 offsets of each text's words."""
    raw, at = _tokens.buffers(column)
    drop = _DROP[raw]
    if drop.any():
        kept = np.concatenate([[0], np.cumsum(~drop)])
        raw, at = raw[~drop], kept[at]
    raw = _FOLD[raw]
    starts, ends, of = _tokens.word_spans(raw, at)
    return _tokens.word_hashes(raw, starts, ends, 7), of


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _majority(counts: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view(np.uint64).ravel()


class _Group:
    """Up to 64 items of one size with their multi-index."""

    def __init__(self, size: int, items: list[tuple]):
        self.size, self.shingle = size, min(SHINGLE, size)
        self.items = items  # (item_id, shingles with counts, fingerprint)
        self.fps = np.array([fp for _, _, fp in items], np.uint64)
        edges = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
        self.blocks = []
        for lo, hi in itertools.pairwise(edges):
            width = hi - lo
            values = np.arange(1 << width, dtype=np.uint64)
            table = np.zeros(1 << width, np.uint64)
            for k, fp in enumerate(self.fps.tolist()):
                own = np.uint64((fp >> lo) & ((1 << width) - 1))
                table[np.bitwise_count(values ^ own) <= BLOCK_RADIUS] |= np.uint64(1 << k)
            self.blocks.append((np.uint64(lo), np.uint64((1 << width) - 1), table))

    def near(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows and items within the radius, with the distance."""
        mask = np.zeros(len(fps), np.uint64)
        for shift, ones, table in self.blocks:
            mask |= table[(fps >> shift) & ones]
        out = []
        for k in range(len(self.items)):
            at = np.flatnonzero((mask >> np.uint64(k)) & np.uint64(1))
            d = np.bitwise_count(fps[at] ^ self.fps[k])
            fine = d <= RADIUS
            out.append((at[fine], np.full(int(fine.sum()), k), d[fine]))
        return tuple(np.concatenate(c) for c in zip(*out))


class BenchmarkIndex:
    """The items of one slice of the benchmark, ready to be searched for."""

    def __init__(self, rows: list[tuple[int, str | None]], shared: tuple[np.ndarray, np.ndarray], similarity: float = SIMILARITY):
        self.similarity, self.shared = similarity, shared
        words, of = _words(pa.array([t for _, t in rows], pa.large_string()))
        by_size = defaultdict(list)
        for (item_id, _), lo, hi in zip(rows, of[:-1], of[1:]):
            if hi > lo:
                hashes = _tokens.window_hashes(words[lo:hi], min(SHINGLE, int(hi - lo)))
                fp = int(_majority(_bits(hashes).sum(axis=0, dtype=np.int64)[None], len(hashes))[0])
                by_size[int(hi - lo)].append((item_id, np.unique(hashes, return_counts=True), fp))
        self.groups = [_Group(size, items[i : i + 64]) for size, items in sorted(by_size.items()) for i in range(0, len(items), 64)]
        self.gates = {}
        for k in {g.shingle for g in self.groups}:
            mine = [(h, n) for n, g in enumerate(self.groups) if g.shingle == k for _, (own, _), _ in g.items for h in own.tolist()]
            pairs = np.array(mine, dtype=[("h", np.uint64), ("g", np.int64)]) if mine else np.zeros(0, [("h", np.uint64), ("g", np.int64)])
            pairs = np.unique(pairs)
            quick = np.zeros(1 << _GATE_BITS, bool)
            quick[(pairs["h"] >> np.uint64(64 - _GATE_BITS)).astype(np.int64)] = True
            self.gates[k] = (quick, pairs["h"], pairs["g"])

    @staticmethod
    def _common(item: tuple[np.ndarray, np.ndarray], window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shingles of an item and a window with the least and the greatest of their counts."""
        mine = np.unique(window, return_counts=True)
        every = np.union1d(item[0], mine[0])
        n, m = np.zeros((2, len(every)), np.int64)
        n[np.searchsorted(every, item[0])], m[np.searchsorted(every, mine[0])] = item[1], mine[1]
        return every, np.minimum(n, m), np.maximum(n, m)

    def _similarity(self, item: tuple[np.ndarray, np.ndarray], window: np.ndarray) -> float:
        """Jaccard index of two multisets of shingles, plain or weighted, whichever is higher."""
        every, both, total = self._common(item, window)
        plain = float(both.sum() / total.sum())
        keys, texts = self.shared
        if plain == 1 or not len(keys):
            return plain
        at = np.minimum(np.searchsorted(keys, every), len(keys) - 1)
        weight = np.where(keys[at] == every, 1 / texts[at], 1.0)
        return max(plain, float((weight * both).sum() / (weight * total).sum()))

    def _search(self, words: np.ndarray, k: int, hashes: np.ndarray, anchors: np.ndarray) -> Iterator[tuple]:
        """Windows of one document within the radius of an item: (item_id, its shingles, start, size, distance, the window's)."""
        _, keys, owners = self.gates[k]
        lo, hi = np.searchsorted(keys, hashes[anchors], "left"), np.searchsorted(keys, hashes[anchors], "right")
        where = defaultdict(list)
        for a, x, y in zip(anchors.tolist(), lo.tolist(), hi.tolist()):
            for g in owners[x:y].tolist():
                where[g].append(a)
        for g, at in where.items():
            group = self.groups[g]
            size = min(group.size, len(words))
            n = size - k + 1  # shingles in a window
            last = len(words) - size
            at = np.unique(np.array(at))
            first, stop = np.maximum(at - n + 1, 0), np.minimum(at, last) + 1
            mark = np.zeros(last + 2, np.int64)
            np.add.at(mark, np.minimum(first, last + 1), 1)
            np.add.at(mark, stop, -1)
            starts = np.flatnonzero(np.cumsum(mark)[: last + 1] > 0)
            for i in range(0, len(starts), WINDOW_BLOCK):
                part = starts[i : i + WINDOW_BLOCK]
                for run in np.split(part, np.flatnonzero(np.diff(part) > n) + 1):
                    a, b = int(run[0]), int(run[-1]) + n
                    sums = np.zeros((b - a + 1, 64), np.int32)
                    np.cumsum(_bits(hashes[a:b]), axis=0, out=sums[1:])
                    fps = _majority(sums[run - a + n] - sums[run - a], n)
                    for w, item, d in zip(*group.near(fps)):
                        start = int(run[w])
                        item_id, own, _ = group.items[item]
                        yield item_id, own, start, size, int(d), hashes[start : start + n]

    def matches(self, column: pa.Array) -> Iterator[tuple]:
        """(row, item_id, start, size, distance, similarity): the best window of each item in each text."""
        for near in self._blocks(column):
            best: dict[tuple, tuple] = {}
            for row, item_id, own, start, size, d, window in near:
                score = self._similarity(own, window)
                key = (row, item_id)
                if score >= self.similarity and (key not in best or (-score, start) < (-best[key][3], best[key][0])):
                    best[key] = (start, size, d, score)
            for (row, item_id), found in best.items():
                yield row, item_id, *found

    def candidates(self, column: pa.Array) -> Iterator[tuple]:
        """(row, item_id, start, size, distance, shingles, least counts, greatest counts) of every window within the radius."""
        for near in self._blocks(column):
            for row, item_id, own, start, size, d, window in near:
                yield row, item_id, start, size, d, *self._common(own, window)

    def _blocks(self, column: pa.Array) -> Iterator[Iterator[tuple]]:
        """For each block of texts, its windows within the radius, with the text's row before them."""
        for lo, hi in _tokens.slices(column, TEXT_BLOCK):
            yield self._near(lo, *_words(column.slice(lo, hi - lo)))

    def _near(self, first: int, words: np.ndarray, of: np.ndarray) -> Iterator[tuple]:
        for k, (quick, keys, _) in self.gates.items():
            hashes = _tokens.window_hashes(words, k)
            hit = np.flatnonzero(quick[(hashes >> np.uint64(64 - _GATE_BITS)).astype(np.int64)])
            hit = hit[keys[np.minimum(np.searchsorted(keys, hashes[hit]), len(keys) - 1)] == hashes[hit]] if len(keys) else hit[:0]
            row = np.searchsorted(of, hit, "right") - 1
            inside = hit + k <= of[row + 1]
            hit, row = hit[inside], row[inside]
            for r in np.unique(row).tolist():
                a, b = int(of[r]), int(of[r + 1])
                for found in self._search(words[a:b], k, hashes[a : b - k + 1], hit[row == r] - a):
                    yield first + r, *found


def shared_shingles(benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """(shingle, texts): the shingles that more than one distinct text of the whole benchmark has, as a written table.

    Texts of the same folded words are one.
    """

    def run(batches):
        for batch in batches:
            words, of = _words(batch.column(0))
            for lo, hi in zip(of[:-1].tolist(), of[1:].tolist()):
                if hi > lo:
                    hashes = np.unique(_tokens.window_hashes(words[lo:hi], min(SHINGLE, hi - lo)))
                    text = np.full(len(hashes), xxhash.xxh64_intdigest(words[lo:hi].tobytes()), np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(text.view(np.int64))], ["shingle", "item"])

    pairs = benchmark.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "shingle long, item long").distinct()
    counted = pairs.groupBy("shingle").agg(F.count("*").alias("texts")).where("texts > 1")
    return Stash(benchmark.sparkSession, "benchmark").write(counted, "shared")


def small_enough(shared: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The shared shingles, sorted, with the number of texts; None if there are more than may be broadcast."""
    if shared.count() > most:
        return None
    table = shared.toArrow()
    keys = table.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table.column(1).to_numpy()[order]


def benchmark_slices(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", slice_words: int = SLICE_WORDS) -> Iterator[list[tuple]]:
    """The benchmark in slices whose size is checked, so that each can be broadcast."""
    rows, weight = [], 0
    for r in benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).toLocalIterator():
        n = r[1].count(" ") + 1
        if rows and weight + n > slice_words:
            yield rows
            rows, weight = [], 0
        rows.append((r[0], r[1]))
        weight += n
    if rows:
        yield rows


SCHEMA = "doc_id long, item_id long, start_word long, n_words long, distance int, similarity double"
CANDIDATES = "uid string, doc_id long, item_id long, start_word long, n_words long, distance int, shingles array<struct<shingle: long, both: long, total: long>>"


def _matched(slim: DataFrame, index) -> DataFrame:
    """Documents against a slice whose weights are at hand."""

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
        names = ["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"]
        for batch in batches:
            found = list(index.value.matches(batch.column(1)))
            if found:
                row, *rest = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(c, t) for c, t in zip(rest, kinds[1:]))], names)

    return slim.mapInArrow(lean(run), SCHEMA)


def _joined(slim: DataFrame, index, shared: DataFrame, similarity: float, stash: Stash) -> DataFrame:
    """The same where the weights are a table: windows within the radius meet it shingle by shingle."""

    def run(batches):
        kind = pa.list_(pa.struct([("shingle", pa.int64()), ("both", pa.int64()), ("total", pa.int64())]))
        for batch in batches:
            ids, uid = batch.column(0).to_pylist(), uuid.uuid4().hex
            for row, item_id, start, size, d, keys, both, total in index.value.candidates(batch.column(1)):
                shingles = [{"shingle": int(k), "both": int(x), "total": int(y)} for k, x, y in zip(keys.view(np.int64), both, total)]
                columns = [pa.array([f"{uid}-{row}"]), *(pa.array([x], t) for x, t in zip((ids[row], item_id, start, size, d), [pa.int64()] * 4 + [pa.int32()])), pa.array([shingles], kind)]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "item_id", "start_word", "n_words", "distance", "shingles"])

    # Written, so that a row's name, made anew by each run of a task, is one in all that follows.
    found = stash.write(slim.mapInArrow(run, CANDIDATES), "windows")
    window = ["uid", "doc_id", "item_id", "start_word", "n_words", "distance"]
    each = found.select(*window, F.explode("shingles").alias("s")).select(*window, "s.*").join(shared, "shingle", "left")
    weight = 1 / F.coalesce("texts", F.lit(1))
    plain, weighted = F.sum("both") / F.sum("total"), F.sum(weight * F.col("both")) / F.sum(weight * F.col("total"))
    scored = each.groupBy(*window).agg(F.greatest(plain, weighted).alias("similarity")).where(F.col("similarity") >= similarity)
    best = scored.groupBy("uid", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("worse"), "start_word", "doc_id", "n_words", "distance", "similarity")).alias("b"))
    return best.select("b.doc_id", "item_id", "b.start_word", "b.n_words", "b.distance", "b.similarity")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    similarity: float = SIMILARITY, slice_words: int = SLICE_WORDS, most_shared: int = SHARED_SHINGLES,
) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance, similarity): one row for each document and item
    with a window of the item's size (the whole document if it is shorter) of `similarity` or more; the
    first of the best windows is told.

    Words are compared without ASCII punctuation and case, five to a shingle (all words of a shorter
    item). Null and empty texts and items match nothing. A null document id stays null; rows that repeat
    an id or an item each give their rows. Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "leaks")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out, before, shared = None, None, shared_shingles(benchmark, item_text_col)
    weights = small_enough(shared, most_shared)
    for rows in benchmark_slices(benchmark, item_col, item_text_col, slice_words):
        if before is not None:  # more than one slice: the last one's result is written and its index given up
            out, before = _written(out, before, stash), None
        index = spark.sparkContext.broadcast(BenchmarkIndex(rows, weights, similarity))
        before = (_matched(slim, index) if weights is not None else _joined(slim, index, shared, similarity, stash), index)
    if before is None:
        return spark.createDataFrame([], SCHEMA)
    return before[0] if out is None else out.unionByName(before[0])


def _written(out: DataFrame | None, part: tuple, stash: Stash) -> DataFrame:
    found, index = part
    found = stash.write(found, "slice")
    index.destroy()
    return found if out is None else out.unionByName(found)


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    similarity: float = SIMILARITY, slice_words: int = SLICE_WORDS, most_shared: int = SHARED_SHINGLES,
) -> DataFrame:
    """The rows that match no item, with all their columns; texts are judged where they lie.

    A benchmark of several slices takes a pass for each, over what the ones before kept. Where weights are joined, rows
    are numbered in a written table first.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "clean")
    shared = shared_shingles(benchmark, item_text_col)
    weights = small_enough(shared, most_shared)
    if weights is None:
        row = f"_row_{uuid.uuid4().hex}"
        numbered = stash.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        leaks = contaminated(numbered, benchmark, row, text_col, item_col, item_text_col, similarity, slice_words, most_shared)
        return numbered.join(leaks.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(*docs.columns)
    out, before, kept = docs, None, []
    for rows in benchmark_slices(benchmark, item_col, item_text_col, slice_words):
        if before is not None:
            out = stash.write(out, "pass")
            before.destroy()
            stash.drop(*kept)
            kept = [out]
        before = spark.sparkContext.broadcast(BenchmarkIndex(rows, weights, similarity))
        out = out.where(_clean(before)(F.col(text_col).cast("string")))
    return out


def _clean(index):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        fine = np.ones(len(texts), bool)
        fine[[m[0] for m in index.value.matches(pa.array(texts, pa.large_string()))]] = False
        give_back()
        return pd.Series(fine)

    return clean
