"""Repeated passages: Rabin-Karp windows, counted by hash bucket, merged into maximal removal intervals.

Stage 1 hashes every window of `size` words with vectorised arithmetic and sends it to a bucket of the
hash, many windows a row. Before that, a block of texts settles what it can by itself: of equal windows
only those of its smallest document travel, the others are removals already. Stage 2 compares a
bucket's windows, a bounded number at a time, and returns removals to their documents. Stage 3 meets the
texts, merges removed windows into intervals and drops the words they cover.

Windows are compared by so many bits of two independent hashes (80 to 128) that at the input's own size
the chance of any two different windows meeting is below one in a million (`key_bytes`).
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm import _tokens
from tapeworks.llm._util import bound_batches, partitions, text_bytes

#: Bytes of text that settle their own repeats before anything is sent.
BLOCK_BYTES = 4 << 20
#: About how many windows a bucket should hold.
BUCKET_WINDOWS = 1 << 19
#: A bucket's windows are compared when so many have come; only one document's of each hash are held on.
SETTLE_WINDOWS = 1 << 20
#: A first shuffle goes to 2**COARSE_BITS buckets at most; more buckets are reached by a second one, since rows of a
#: block dealt to very many buckets would hold a window or two each.
COARSE_BITS, REGROUP_WINDOWS, MOST_TASKS = 12, 1 << 21, 1 << 17
#: Documents are dealt to so many bytes of text a part.
PART_BYTES = 8 << 20
NO_ID = -(1 << 63)


def _pack(a: np.ndarray) -> bytes:
    """An integer array as compressed byte planes."""
    if not len(a):
        return b""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _delta(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def _part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (_tokens.mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def key_bytes(windows: float) -> int:
    """Bytes of a window's hash (10 to 16): twice the bits that number the windows, and 20 more."""
    return min(16, max(10, math.ceil((2 * math.log2(max(2.0, windows)) + 20) / 8)))


def _windows(column: pa.Array, size: int, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Two hashes (the second cut to what `width` bytes hold) of all windows of an array of texts, with each
    one's text and word position."""
    raw, at = _tokens.buffers(column)
    starts, ends, of = _tokens.word_spans(raw, at)
    counts = np.diff(of)
    full = np.maximum(counts - size + 1, 0)
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), full)
    pos = np.arange(len(doc), dtype=np.int32) - np.repeat((np.cumsum(full) - full).astype(np.int32), full)
    pick = of[:-1].astype(np.int32)[doc] + pos
    out = [_tokens.window_hashes(_tokens.word_hashes(raw, starts, ends, salt), size, salt)[pick] for salt in (0, 1)]
    out[1] &= np.uint64((1 << 8 * (width - 8)) - 1)
    return out, doc, pos.view(np.uint32)


def _repeated(hashes: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Marks windows that also start in a document with a smaller id."""
    if not len(ids):
        return np.zeros(0, bool)
    first, second = hashes
    order = np.argsort(first, kind="stable")
    new = np.ones(len(order), bool)
    sorted_first, sorted_second = first[order], second[order]
    new[1:] = sorted_first[1:] != sorted_first[:-1]
    if (~new[1:] & (sorted_second[1:] != sorted_second[:-1])).any():  # a clash of the first hash
        order = np.lexsort((second, first))
        sorted_first, sorted_second = first[order], second[order]
        new[1:] = (sorted_first[1:] != sorted_first[:-1]) | (sorted_second[1:] != sorted_second[:-1])
    del sorted_first, sorted_second
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    out = np.empty(len(ids), bool)
    out[order] = ids[order] > least[np.cumsum(new) - 1]
    return out


_NAMES = ["bucket", "h", "ids", "pos", "sids", "spos"]
#: A batch of rows is handed on at this many bytes.
_OUT_BYTES = 4 << 20


def _encode(hashes: list[np.ndarray], ids: np.ndarray, pos: np.ndarray, gone: np.ndarray, bits: int, width: int):
    """Windows as rows (bucket, hashes, id deltas, positions, settled ids, settled positions), many a row."""
    bucket = (hashes[0] >> np.uint64(64 - bits)).astype(np.int64)
    low = np.ascontiguousarray(hashes[0]).view(np.uint8).reshape(-1, 8)[:, :7]  # the bucket holds the top byte
    more = np.ascontiguousarray(hashes[1]).view(np.uint8).reshape(-1, 8)[:, : width - 8]
    order = np.argsort(bucket, kind="stable")
    new = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    rows, weight = [], 0
    for a, b in zip(new, np.append(new[1:], len(order))):
        at = order[a:b]
        sent, left = at[~gone[at]], at[gone[at]]
        h = low[sent].tobytes() + more[sent].tobytes()
        rows.append((int(bucket[at[0]]), h, _pack(_delta(ids[sent])), _pack(pos[sent]), _pack(_delta(ids[left])), _pack(pos[left])))
        weight += len(h)
        if weight >= _OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], _NAMES)
            rows, weight = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], _NAMES)


def _decode(rows: list[tuple], bits: int, width: int):
    """The windows of rows of one bucket: hashes, ids, positions, and the settled ids and positions."""
    top = int(rows[0][0]) >> (bits - 8)
    parts = []
    for _, h, i, p, si, sp in rows:
        ids = np.cumsum(_unpack(i, np.int64))
        n, raw = len(ids), np.frombuffer(h, np.uint8)
        full, second = np.empty((n, 8), np.uint8), np.zeros((n, 8), np.uint8)
        full[:, :7] = raw[: 7 * n].reshape(n, 7)
        full[:, 7] = top
        second[:, : width - 8] = raw[7 * n :].reshape(n, width - 8)
        parts.append((full.view(np.uint64).ravel(), second.view(np.uint64).ravel(), ids, _unpack(p, np.uint32), np.cumsum(_unpack(si, np.int64)), _unpack(sp, np.uint32)))
    first, second, *rest = (np.concatenate(c) for c in zip(*parts))
    return [first, second], *rest


def _send(size: int, width: int, bits: int, block_bytes: int):
    """Stage 1: texts to rows of windows; each block of texts settles its own repeats."""

    def settle(held: list[tuple[pa.Array, pa.Array]]):
        ids = pa.concat_arrays([i for i, _ in held]).fill_null(NO_ID).to_numpy()
        hashes, doc, pos = _windows(pa.concat_arrays([t for _, t in held]), size, width)
        own = ids[doc]
        yield from _encode(hashes, own, pos, _repeated(hashes, own), bits, width)

    def run(batches):
        held, weight = [], 0
        for batch in batches:
            for lo, hi in _tokens.slices(batch.column(1), block_bytes):
                ids, texts = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
                own = texts.nbytes
                if held and weight + own > block_bytes:
                    yield from settle(held)
                    held, weight = [], 0
                held.append((ids, texts))
                weight += own
            if held:  # a copy of the rest, so that the batch itself can go
                ids, texts = (pa.concat_arrays(list(c)) for c in zip(*held))
                held = [(ids.take(rows), texts.take(rows)) for rows in [pa.array(range(len(ids)))]]
        if held:
            yield from settle(held)

    return run


def _by_bucket(batches, most: int):
    """Lists of rows of one bucket each, from rows sorted by bucket, and whether the bucket ends with the list.

    A list is closed at about `most` windows."""
    held, weight = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (held[0][0] != row[0] or weight >= most):
                yield held, held[0][0] != row[0]
                held, weight = [], 0
            held.append(row)
            weight += len(row[1]) // 9 + len(row[4])
    if held:
        yield held, True


def _regroup(width: int, coarse: int, fine: int, most: int):
    """Between two shuffles of a very large input: rows of a coarse bucket, a few windows each, become fuller rows
    of fine buckets, and what `most` windows can settle among themselves is settled."""

    def run(batches):
        for rows, _ in _by_bucket(batches, most):
            hashes, ids, pos, sids, spos = _decode(rows, coarse, width)
            yield from _encode(hashes, ids, pos, _repeated(hashes, ids), fine, width)
            if len(sids):  # already settled: any bucket hands them on
                yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (rows[0][0] << (fine - coarse), b"", b"", b"", _pack(_delta(sids)), _pack(spos))], _NAMES)

    return run


def _compare(width: int, bits: int, parts: int, most: int):
    """Stage 2 over rows sorted by bucket: rows (part, ids, positions) of removals.

    However many rows a bucket has, about `most` windows and those of the smallest document so far of each
    hash are held."""

    def removals(ids: np.ndarray, pos: np.ndarray):
        part = _part_of(ids, parts)
        order = np.lexsort((pos, ids, part))
        ids, pos, part = ids[order], pos[order], part[order]
        heads = np.flatnonzero(np.diff(part, prepend=-1))
        tails = np.append(heads[1:], len(part))
        for k in range(0, len(heads), 4096):
            spans = list(zip(heads[k : k + 4096], tails[k : k + 4096]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[heads[k : k + 4096]]), pa.array([_pack(_delta(ids[a:b])) for a, b in spans]), pa.array([_pack(pos[a:b]) for a, b in spans])],
                ["part", "ids", "pos"],
            )

    def run(batches):
        live = None
        for rows, ends in _by_bucket(batches, most):
            (first, second), ids, pos, sids, spos = _decode(rows, bits, width)
            if live is not None:
                first, second, ids, pos = (np.concatenate(c) for c in zip(live, (first, second, ids, pos)))
            gone = _repeated([first, second], ids)
            yield from removals(np.concatenate([ids[gone], sids]), np.concatenate([pos[gone], spos]))
            live = None if ends else tuple(c[~gone] for c in (first, second, ids, pos))

    return run


def _intervals(pos: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal word intervals covered by windows at sorted positions."""
    pos = np.unique(pos).astype(np.int64)
    new = np.ones(len(pos), bool)
    new[1:] = np.diff(pos) > size
    heads = np.flatnonzero(new)
    return pos[heads], pos[np.append(heads[1:], len(pos)) - 1] + size


def _remove(size: int, with_text: bool):
    """Stage 3 over rows sorted by (part, kind): removals of a part first, then its texts."""

    def run(batches):
        part, gone = None, None
        ids, pos = [], []
        for batch in batches:
            cols = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data = batch.column(3), batch.column(4)
            out: list[tuple] = []
            for k, (p, kind) in enumerate(zip(*cols)):
                if p != part:
                    part, gone, ids, pos = p, None, [], []
                if kind == 0:
                    ids.append(np.cumsum(_unpack(data[0][k].as_py(), np.int64)))
                    pos.append(_unpack(data[1][k].as_py(), np.uint32))
                    continue
                if gone is None:
                    i, q = (np.concatenate(ids), np.concatenate(pos)) if ids else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
                    order = np.argsort(i, kind="stable")
                    gone, ids, pos = (i[order], q[order]), [], []
                doc_id = batch.column(2)[k].as_py()
                packed = data[1][k].as_py()
                words = (zstandard.ZstdDecompressor().decompress(packed) if packed else b"").split()
                n, removed, spans = len(words), 0, []
                lo, hi = np.searchsorted(gone[0], NO_ID if doc_id is None else doc_id, "left"), np.searchsorted(gone[0], NO_ID if doc_id is None else doc_id, "right")
                if hi > lo and n >= size:
                    keep = np.ones(n, bool)
                    a, b = _intervals(gone[1][lo:hi], size)
                    for x, y in zip(a.tolist(), b.tolist()):
                        keep[x:y] = False
                    spans = [{"first": x, "last": y} for x, y in zip(a.tolist(), b.tolist())]
                    words = list(itertools.compress(words, keep))
                    removed = n - len(words)
                kept = b" ".join(words)
                out.append((doc_id, n, removed, hashlib.sha256(kept).hexdigest(), spans, kept.decode() if with_text else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _OUT)], ["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"])

    return run


_OUT = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.string()]
_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<first: long, last: long>>, kept_text string"


def _texts(parts: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 512):
                piece = batch.slice(lo, 512)
                ids = piece.column(0)
                n = len(piece)
                packed = [zstandard.ZstdCompressor(level=3).compress(t.encode()) if t else b"" for t in piece.column(1).to_pylist()]
                known = np.array(ids.fill_null(NO_ID).to_numpy(zero_copy_only=False))
                if ids.null_count:  # such texts lose nothing, so any part will do
                    none = np.asarray(ids.is_null())
                    known[none] = [zlib.crc32(d) for d, x in zip(packed, none) if x]
                key = _part_of(known, parts)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.ones(n, np.int8)), ids, pa.array([b""] * n), pa.array(packed)], ["part", "kind", "doc_id", "ids", "data"])

    return run


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13, block_bytes: int = BLOCK_BYTES, with_text: bool = True, bucket_windows: int = BUCKET_WINDOWS, coarse_bits: int = COARSE_BITS, settle_windows: int = SETTLE_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed, kept_text) for every row.

    A word goes if a window of `size` consecutive words that covers it also starts in a document with
    a smaller id; `removed` has the merged word intervals (first, end exclusive), `kept_text` the other
    words joined by a space. Windows are judged on the input. Null and empty texts have no words. A
    null id counts as smaller than any other; rows that repeat an id count as one document, so none of
    them loses a word to the other, but removals of either apply to each where the positions exist.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    total = text_bytes(docs, text_col)
    width = key_bytes(total)
    bits = 8
    while (1 << bits) < total / 3 / bucket_windows and bits < 40:
        bits += 1
    coarse = min(bits, coarse_bits)
    ways = partitions(spark)
    parts = max(ways, int(total * 2 / PART_BYTES))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = "bucket long, h binary, ids binary, pos binary, sids binary, spos binary"
    sent = slim.mapInArrow(_send(size, width, coarse, block_bytes), rows)
    if coarse < bits:
        dealt = sent.repartition(max(ways, 1 << coarse), "bucket").sortWithinPartitions("bucket")
        sent = dealt.mapInArrow(_regroup(width, coarse, bits, REGROUP_WINDOWS), rows)
    gone = sent.repartition(max(ways, min((1 << bits) // 2, MOST_TASKS)), "bucket").sortWithinPartitions("bucket").mapInArrow(_compare(width, bits, parts, settle_windows), "part int, ids binary, pos binary")
    gone = gone.select("part", F.lit(0).cast("byte").alias("kind"), F.lit(None).cast("long").alias("doc_id"), "ids", F.col("pos").alias("data"))
    texts = slim.mapInArrow(_texts(parts), "part int, kind byte, doc_id long, ids binary, data binary")
    both = gone.unionByName(texts).repartition(max(ways, min(parts // 4, MOST_TASKS)), "part").sortWithinPartitions("part", "kind")
    return both.mapInArrow(_remove(size, with_text), _SCHEMA)
