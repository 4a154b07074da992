"""Near copies by the exact similarity of word shingles.

Two documents are near copies if the Jaccard index of their sets of shingles is `similarity` or more.
Candidates share a SimHash class or one of BANDS keys, each made of ROWS min-hashes: at an index of 0.8
all keys differ with a chance of (1 - 0.8**5)**24, about 7 in 100 000. (A SimHash radius that covers 0.8
is about 20 of 64 bits, within which one of 1000 random pairs lies.) Every candidate is verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm import _tokens
from tapeworks.llm._util import Stash, lean, partitions
from tapeworks.llm.components import connected_components
from tapeworks.llm.exact_dedup import drop_ids
from tapeworks.llm.simhash import near_duplicate_classes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Keys of so few members become pairs; larger ones are compared in blocks of about so many shingles and members.
PAIRED, BLOCK_SHINGLES, BLOCK_ROWS = 3, 1 << 18, 1024
#: Shared shingles that are counted in one go.
SLICE = 4096
#: Bytes of text, and shingles of a text, that are hashed in one go.
TEXT_BLOCK, SHINGLE_BLOCK = 1 << 20, 1024

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SALT = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_XOR, _TIMES = _SALT[0], _SALT[1] | np.uint64(1)


def shingle_sets(column: pa.Array, shingle: int = SHINGLE):
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, one without words is 0."""
    for lo, hi in _tokens.slices(column, TEXT_BLOCK):
        raw, at = _tokens.buffers(column.slice(lo, hi - lo))
        raw = _FOLD[raw]
        starts, ends, of = _tokens.word_spans(raw, at)
        words = _tokens.word_hashes(raw, starts, ends)
        for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
            yield np.unique(_tokens.window_hashes(words[a:b], min(shingle, b - a))) if b > a else np.zeros(1, np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band; the band is part of the key."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), SHINGLE_BLOCK):
        block = hashes[None, i : i + SHINGLE_BLOCK] ^ _XOR
        block *= _TIMES
        np.minimum(least, block.min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _tokens.mix(key * np.uint64(0x9E3779B97F4A7C15) + least[k::ROWS])
    return key


def _bands(shingle: int):
    def run(batches):
        for batch in batches:
            if len(batch):
                keys = np.concatenate([band_keys(h) for h in shingle_sets(batch.column(1), shingle)])
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(ids, BANDS))], ["key", "doc_id"])

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            at = 0
            for lo, hi in _tokens.slices(batch.column(1), TEXT_BLOCK):
                sets = list(shingle_sets(batch.column(1).slice(lo, hi - lo), shingle))
                offsets = np.concatenate([[0], np.cumsum([len(h) for h in sets])]).astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "shingles"])
                at = hi

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left shares with each on the right."""
    out = np.zeros((len(left), len(right)), np.float64)
    terms, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    both = np.bincount(at[owner < len(left)], minlength=len(terms)) * np.bincount(at[owner >= len(left)], minlength=len(terms)) > 0
    place = np.cumsum(both) - 1
    owner, at = owner[both[at]], place[at[both[at]]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for lo in range(0, int(both.sum()), SLICE):
        a, b = np.searchsorted(at, [lo, lo + SLICE])
        table = np.zeros((len(left) + len(right), SLICE), np.float32)
        table[owner[a:b], at[a:b] - lo] = 1
        out += table[: len(left)] @ table[len(left) :].T
    return out


def _forest(near: np.ndarray, us: np.ndarray, vs: np.ndarray):
    """Links (u, v), one fewer than the members of each component of a bipartite table of near pairs."""
    new_u, new_v = np.ones(len(us), bool), np.ones(len(vs), bool)
    for first in np.flatnonzero(near.any(axis=1)).tolist():
        if not new_u[first]:
            continue
        new_u[first], todo = False, [(first, True)]
        while todo:
            k, is_u = todo.pop()
            met = np.flatnonzero(near[k] & new_v if is_u else near[:, k] & new_u)
            (new_v if is_u else new_u)[met] = False
            for m in met.tolist():
                yield (us[k], vs[m]) if is_u else (us[m], vs[k])
                todo.append((m, not is_u))


def _linked(similarity: float):
    """Over rows (key, x, y, doc_id, root, mine, shingles) sorted by the first three: links between near documents of
    different roots, at most two a row. Blocks x and y of a key are compared."""

    def settle(rows: list[tuple]):
        sides = [[r for r in rows if r[5] == side] for side in (rows[0][1], rows[0][2])]
        if not all(sides):
            return
        ids, roots = ([np.array([r[k] for r in side], np.int64) for side in sides] for k in (3, 4))
        sets = [[r[6] for r in side] for side in sides]
        sizes = [np.array([len(x) for x in side], float) for side in sets]
        both = _common(*sets)
        near = (both >= similarity * (sizes[0][:, None] + sizes[1] - both)) & (roots[0][:, None] != roots[1])
        links = list(_forest(near, *ids))
        if links:
            u, v = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            flat, offsets = batch.column(6).flatten().to_numpy(zero_copy_only=False), np.asarray(batch.column(6).offsets)
            offsets = offsets - offsets[0]
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)))):
                if held and held[0][:3] != row[:3]:
                    yield from settle(held)
                    held = []
                held.append((*row, flat[offsets[k] : offsets[k + 1]].copy()))
        if held:
            yield from settle(held)

    return run


def near_copy_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, block_shingles: int = BLOCK_SHINGLES, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(node, root) for every id that has a near copy; root is the smallest id of its class, the classes
    being the connected components of near copies. Null ids are left out; rows that repeat an id are one
    document, near to all that one of them is near to. Other columns are ignored.

    A key's members are first compared with its smallest one. Keys that this leaves with members of
    different classes are compared in full: small ones as pairs, larger ones block by block, where a
    block hands on no more links than it has members.
    """
    stash = Stash(docs.sparkSession, "near")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    classes = near_duplicate_classes(slim, shingle=shingle).select(F.col("component_id").alias("key"), "doc_id")
    rows = stash.write(slim.mapInArrow(lean(_bands(shingle)), "key long, doc_id long").unionByName(classes), "keys")
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    members = stash.write(rows.join(shared, "key"), "members")
    stash.drop(rows)
    some = members.select("doc_id").distinct()
    sets = stash.write(slim.join(some, "doc_id", "left_semi").mapInArrow(lean(_sets(shingle)), "doc_id long, shingles array<long>"), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        met = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v").withColumn("both", F.size(F.array_intersect("a", "b")))
        return stash.write(met.where(F.col("both") >= F.lit(similarity) * (F.size("a") + F.size("b") - F.col("both"))).select("u", "v"), name)

    tried = stash.write(members.where("least < doc_id").select(F.col("least").alias("u"), F.col("doc_id").alias("v")).distinct(), "tried")
    links = verified(tried, "links")
    roots = connected_components(links).toDF("doc_id", "root")
    placed = stash.write(members.distinct().join(roots, "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root")), "placed")
    sizes = sets.select("doc_id", F.size("shingles").alias("n"))
    split = placed.join(sizes, "doc_id").groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("c"), F.sum("n").alias("n")).where("x < y")
    blocks = F.greatest(F.ceil(F.col("n") / block_shingles), F.ceil(F.col("c") / block_rows)).cast("int")
    open_ = stash.write(placed.join(split.select("key", "c", blocks.alias("blocks")), "key"), "open")

    few = open_.where(F.col("c") <= PAIRED)  # at most as many pairs as members
    left, right = few.select("key", F.col("doc_id").alias("u"), F.col("root").alias("ru")), few.select("key", F.col("doc_id").alias("v"), F.col("root").alias("rv"))
    more = verified(left.join(right, "key").where("u < v and ru <> rv").select("u", "v").distinct().join(tried, ["u", "v"], "left_anti"), "more")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    dealt = open_.where(F.col("c") > PAIRED).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "doc_id", "root", "mine").join(sets, "doc_id")
    dealt = dealt.select("key", "x", "y", "doc_id", "root", "mine", "shingles").repartition(partitions(docs.sparkSession), "key", "x", "y").sortWithinPartitions("key", "x", "y")
    most = stash.write(dealt.mapInArrow(lean(_linked(similarity)), "u long, v long").distinct(), "most")
    stash.drop(members, placed, open_, sets, tried)
    return connected_components(links.unionByName(more).unionByName(most))


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of every class of near copies, that with the smallest id, with all its columns.

    Rows with a null id stay; rows that repeat the smallest id are one document and stay together.
    """
    classes = near_copy_classes(docs, id_col, text_col, shingle, similarity)
    return drop_ids(docs, classes.where("node <> root").select(F.col("node").alias("doc_id")), id_col)
