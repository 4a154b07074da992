"""Vectorised words of Arrow string columns: no Python object per word.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. A word's hash chains its 8-byte lanes
through a 64-bit finaliser, so no two words of one length up to 8 bytes share a hash; a long word is
hashed by XXH64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Odd multipliers of Rabin-Karp window hashes; two different ones for hashes that should be independent.
_ROLLS = (0xD6E8FEB86659FD93, 0x9FB21C651E98DF23)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Longer words are hashed one by one.
LANE_BYTES = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words as byte positions, and the n + 1 offsets of each text's words."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~space[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = at[:-1][at[:-1] < len(raw)]
    first[edges] = solid[edges]  # a text's first byte starts a word whatever precedes it
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends_of = at[1:][at[1:] > 0] - 1
    last[ends_of] = solid[ends_of]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; another salt gives another function."""
    lengths = ends - starts
    out = mix(lengths.astype(U64) * U64(0xFF51AFD7ED558CCD) + U64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    if not len(starts):
        return out
    padded = np.empty(len(raw) + 8, np.uint8)
    padded[: len(raw)], padded[len(raw) :] = raw, 0
    lanes = np.ndarray(len(raw) + 1, "<u8", padded.data, strides=(1,))  # the 8 bytes from each position on
    long = np.flatnonzero(lengths > LANE_BYTES)
    live, at, left = slice(None), starts, lengths
    if len(long):
        live = np.flatnonzero(lengths <= LANE_BYTES)
        at, left = starts[live], lengths[live]
    while len(at):
        out[live] = mix(out[live] * U64(0xC2B2AE3D27D4EB4F) ^ (lanes[at] & _KEEP[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    for k in long.tolist():
        out[k] = xxhash.xxh64_intdigest(raw[starts[k] : ends[k]].data, seed=salt)
    return out


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of every `size` consecutive words; entry i starts at word i."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, roll = words[:n].copy(), U64(_ROLLS[salt])
    for k in range(1, size):
        out *= roll
        out += words[k : k + n]
    return mix(out)


def slices(column: pa.Array, most_bytes: int):
    """Row ranges (lo, hi) of an array with about `most_bytes` of text each, one row at least."""
    _, at = buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most_bytes, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
