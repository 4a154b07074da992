"""Best-fit packing with certified bounds and exchange between partitions.

Documents become token pieces; a piece of full length is a sequence by itself. The others are dealt
to partitions, each packed best-fit decreasing. Dual-feasible functions bound from below how many
sequences a partition needs: one that meets its bound is certified and final. The others give up the
documents of their loosest sequences, which are pooled, dealt anew to fewer partitions and packed
again, for as long as that saves sequences.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm._tokens import slices
from tapeworks.llm._util import Stash, lean, partitions

CAPACITY = 2048
#: About so many pieces are packed together.
PART_ITEMS = 1 << 16
#: Token ids remembered by a worker, as runs of letters or signs; forgotten as a whole when full.
REMEMBERED = 300_000
_GROUP_BYTES = 12 << 20


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most that dual-feasible functions certify for a set of lengths.

    Used are the thresholding family (long counts as full, short as nothing) and the rounding family
    u_k of Fekete and Schepers.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    cum_n, cum_x = np.cumsum(count), np.cumsum(count * x)
    for low in range(1, capacity // 2 + 1):
        high = capacity - low
        full = cum_n[-1] - cum_n[high]
        total = full * capacity + cum_x[high] - cum_x[low - 1]
        best = max(best, -(-int(total) // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * x
        # In units of capacity / k; exact multiples keep their own size.
        exact = scaled % capacity == 0
        units = np.where(exact, x * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * units).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Each item's bin and offset, and the number of bins. Bins by room are stacks, fitting rooms are
    found in a bit mask, so the time is in proportion to the items."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, b = capacity, opened
            opened += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            stacks[left].append(b)
            rooms |= 1 << left
    return bins, offsets, opened


# The parts of a tokenizer file on which the short cut through distinct words rests.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def drops_white_space(path: str) -> bool:
    """Whether a tokenizer file is one whose words between spaces have ids of their own, as `_WordIds` takes them."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    fine = told.get("normalizer") == _NORMALIZER and told.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
    model = told.get("model", {})
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    # An added token is found before words are; one with a letter, digit or space could be lost in a part.
    added = all(t["special"] and not t["normalized"] and "<" in t["content"] and " " not in t["content"] for t in told.get("added_tokens", []))
    return fine and plain and added and not told.get("truncation") and not told.get("padding")


class _TextIds:
    """Token ids of whole texts by any tokenizer, as little-endian bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def documents(self, texts: pa.Array) -> list[bytes]:
        return [array("I", self.tokenizer.encode(t or "", add_special_tokens=False).ids).tobytes() for t in texts.to_pylist()]


class _WordIds:
    """Token ids of words between spaces, as little-endian bytes, each distinct word encoded once.

    For tokenizers of which `drops_white_space` holds. Such a one cuts words into runs of letters, single digits and runs of other signs, and merges only
    inside such a run. A word of letters with signs around it is therefore the ids of its parts, and the
    model is asked for the folded letters alone, already mapped to the byte alphabet; every other word
    (digits, apostrophes, `<`, letters beyond Latin-1) goes through the whole tokenizer.
    """

    _SIGNS = frozenset("!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~")
    _PLAIN = re.compile(r"([!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
        self.alphabet = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.parts = _Remembered(self._part)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, text: str) -> bytes:
        """The ids of a run of signs or of folded letters."""
        if not text:
            return b""
        if text[0] in self._SIGNS:
            return self._whole(text)
        seen = text if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()

    def _encode(self, word: str) -> bytes:
        if not word:
            return b""
        part = self.parts
        if word.isascii() and word.isalpha() and len(word) <= 200:
            return part[word.lower()]
        m = self._PLAIN.fullmatch(word)
        if m is None or len(word) > 200:
            return self._whole(word)
        return part[m[1]] + part[m[2].lower()] + part[m[3]]

    def documents(self, texts: pa.Array) -> list[memoryview]:
        """The ids of each text; a batch's distinct words are encoded once, the rest is array work."""
        words = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        ids = pa.array([self._encode(w) for w in coded.dictionary.to_pylist()], pa.large_binary()).take(coded.indices)
        _, at, data = ids.buffers()
        ends = np.frombuffer(at, np.int64, len(ids) + 1)[np.asarray(words.offsets) - words.offsets[0].as_py()]
        whole = memoryview(data) if data is not None else memoryview(b"")
        return [whole[a:b] for a, b in itertools.pairwise(ends.tolist())]


class _Remembered(dict):
    """A bounded memory of a function's results; forgotten as a whole when full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        got = self[key] = self.make(key)
        return got


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's token pieces.

    Where the tokenizer drops white space before anything else crosses it, texts are cut at spaces and line
    ends and each distinct word is encoded once and remembered; any other tokenizer gets whole texts.
    """
    if array("I").itemsize != 4 or sys.byteorder != "little":
        raise RuntimeError("token ids are written as little-endian 32-bit numbers")
    kind = _WordIds if drops_white_space(tokenizer_path) else _TextIds

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of, end = kind(tokenizer_path).documents, np.array([end_id], "<u4").tobytes()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for lo, hi in slices(batch.column(1), _GROUP_BYTES):
                rows = []
                for doc_id, data in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), ids_of(batch.column(1).slice(lo, hi - lo))):
                    size, step = len(data) + len(end), 4 * capacity
                    for piece, at in enumerate(range(0, size, step)):
                        crc = zlib.crc32(data[at : at + step])
                        stop = min(at + step, size)
                        if stop == size:  # the end token, or what of it is in this piece
                            crc = zlib.crc32(end, crc)
                        rows.append((doc_id, piece, at // 4, (stop - at) // 4, crc))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


#: A sequence's number has fields for its round, part and place in the part; pieces that fill one begin at FULL.
ROUND_BITS, PART_BITS, BIN_BITS, FULL = 12, 29, 20, 1 << 62
#: Rounds of exchange at most. Each round uses fewer sequences than the one before or is the last; what a last round
#: would have given up stays packed as it is.
MOST_ROUNDS = 64


def sequence_base(round_: int, part: int, bins: int) -> int:
    """The number of a part's first sequence; distinct for all rounds and parts, or an error."""
    if round_ >= 1 << ROUND_BITS or part >= 1 << PART_BITS or bins > 1 << BIN_BITS:
        raise OverflowError(f"round {round_}, part {part} of {bins} sequences is out of the range of sequence ids")
    return ((round_ << PART_BITS) + part) << BIN_BITS


def _pack_parts(capacity: int, round_: int):
    """Packs each part of rows (part, uid, length), sorted by part; tells bounds and what is released."""

    def pack(part: int, uid: np.ndarray, length: np.ndarray):
        bins, offsets, n = best_fit_decreasing(length, capacity)
        bound = lower_bound(length, capacity)
        fill = np.bincount(bins, length, n).astype(np.int64)
        free = np.zeros(n, bool)
        if n > bound:
            # The loosest sequences, with room for a multiple of the gap, give up their documents.
            loose = np.argsort(fill, kind="stable")[: max(4 * (n - bound), n // 8)]
            free[loose[fill[loose] < capacity]] = True
        sequence = sequence_base(round_, part, n) + bins
        return pa.RecordBatch.from_arrays(
            [pa.array(uid), pa.array(length), pa.array(sequence), pa.array(offsets), pa.array(free[bins])],
            ["uid", "length", "sequence_id", "offset", "released"],
        )

    def run(batches):
        part, uid, length = None, [], []
        for batch in batches:
            p, u, x = (np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns)
            for k in np.flatnonzero(np.diff(p, prepend=p[:1] - 1)) if len(p) else []:
                end = k + int(np.searchsorted(p[k:], p[k], "right"))
                if part is not None and part != int(p[k]):
                    yield pack(part, np.concatenate(uid), np.concatenate(length))
                    uid, length = [], []
                part = int(p[k])
                uid.append(u[k:end])
                length.append(x[k:end])
        if part is not None:
            yield pack(part, np.concatenate(uid), np.concatenate(length))

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, part_items: int = PART_ITEMS
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    Null and empty texts are the end token alone. Only documents longer than `capacity` are cut. Null
    and repeated ids are packed like any other rows. An empty table gives an empty result; other
    columns are ignored. Sequence ids are distinct numbers, nothing more.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "packing")
    ways = partitions(spark)
    tokens = stash.write(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id), "tokens")
    # The written rows are numbered once more into a table, so that numbers stay if a task runs again.
    pieces = stash.write(tokens.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    stash.drop(tokens)
    pool = pieces.where(F.col("length") < capacity).select("uid", "length")
    full = pieces.where(F.col("length") >= capacity).select("uid", (F.col("uid") + F.lit(FULL)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = [full]
    before = None  # sequences given up for the pool, and where their documents lie
    for round_ in range(MOST_ROUNDS):
        n = pool.count()
        if not n:
            break
        parts = max(1, -(-n // part_items))
        sequence_base(round_, parts - 1, 0)
        dealt = pool.select(F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(parts)).alias("part"), "uid", "length")
        dealt = dealt.repartition(min(parts, ways), "part").sortWithinPartitions("part")
        packed = stash.write(dealt.mapInArrow(_pack_parts(capacity, round_), "uid long, length long, sequence_id long, offset long, released boolean"), f"round{round_}")
        used, spare = packed.agg(F.count_if(F.col("offset") == 0), F.count_if("released")).first()
        if before is not None and used >= before[0]:
            placed.append(before[1])
            before = None
            break
        placed.append(packed.where("not released").select("uid", "sequence_id", "offset"))
        before = None
        if not spare:  # every part meets its bound
            break
        out = packed.where("released")
        before = (out.agg(F.count_if(F.col("offset") == 0)).first()[0], out.select("uid", "sequence_id", "offset"))
        pool = out.select("uid", "length")
    if before is not None:
        placed.append(before[1])
    where = placed[0]
    for more in placed[1:]:
        where = where.unionByName(more)
    return pieces.join(where, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
