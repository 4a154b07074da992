"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile ranks a language's most frequent character n-grams (within words padded by a space). A
document's own most frequent n-grams are ranked likewise; the distance to a profile adds up how far
each n-gram is out of place, with a fixed penalty for one the profile lacks. The nearest profile wins.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm._util import bound_batches, give_back, lean

LONGEST = 5
PROFILE = 1500
RANKED = 400
#: About so many distinct texts of each language are learned from (chosen by a hash of the text). What reaches the
#: driver are PROFILE n-grams a language.
FIT_TEXTS = 3000
UNKNOWN = "und"
#: Characters of a text whose n-grams are counted in one go; the counts do not depend on it.
BLOCK_CHARS = 1 << 20
_KINDS = None


def _kinds() -> np.ndarray:
    """By code point: 2 for a letter, 1 for a mark that combines with one, 0 for all else."""
    global _KINDS
    if _KINDS is None:
        _KINDS = np.fromiter((2 if chr(c).isalpha() else unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)), np.uint8, 0x110000)
    return _KINDS


def _codes(text: str, block: int) -> Iterator[np.ndarray]:
    """Words as code points, everything between two words as one 0, a 0 at both ends; in blocks that follow on
    from each other. A text without a letter has none. Marks belong to words but make none."""
    text, kinds, met, gap = text.lower(), _kinds(), False, True
    held = [np.zeros(1, np.uint64)]
    for i in range(0, len(text), block):
        raw = np.frombuffer(text[i : i + block].encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds[raw]
        met = met or bool((kind == 2).any())
        solid = kind > 0
        after = np.concatenate([[not gap], solid[:-1]])  # whether the character before is part of a word
        keep = solid | after
        held.append(np.where(solid, raw, 0)[keep].astype(np.uint64))
        gap = not solid[-1]
        if not gap and i + block >= len(text):
            held.append(np.zeros(1, np.uint64))
        if met:
            yield np.concatenate(held)
            held = []


def _grams(codes: np.ndarray, longest: int, old: int = 0) -> np.ndarray:
    """Hashed n-grams of one to `longest` characters without a space inside that end behind the first `old` codes."""
    letter = codes != 0
    out = [codes[old:][letter[old:]] + np.uint64(1 << 40)]
    digits = codes + np.uint64(1)  # a space counts too
    value, fine = digits, np.ones(len(codes), bool)
    for n in range(2, longest + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        value = value[:m] * np.uint64(0x9E3779B97F4A7C15) + digits[n - 1 : n - 1 + m]
        fine = fine[:m] & (letter[n - 2 : n - 2 + m] if n > 2 else True)
        use = fine & (letter[:m] | letter[1 : 1 + m])
        use[: max(0, old - n + 1)] = False
        out.append((value[use] ^ (value[use] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
    return np.concatenate(out)


def count_grams(text: str, longest: int = LONGEST, block: int = BLOCK_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text with their counts."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tail = np.zeros(0, np.uint64)
    for codes in _codes(text, block):
        old = len(tail)
        codes = np.concatenate([tail, codes]) if old else codes
        tail = codes[max(0, len(codes) - longest + 1) :]
        k, c = np.unique(_grams(codes, longest, old), return_counts=True)
        if len(keys):
            keys, inverse = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, c])).astype(np.int64)
        else:
            keys, counts = k, c
    return keys, counts


def _top(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams by rank; ties go to the smaller key."""
    if len(keys) > most:
        floor = np.partition(counts, len(counts) - most)[len(counts) - most]
        at = np.flatnonzero(counts >= floor)
        keys, counts = keys[at], counts[at]
    return keys[np.argsort(-counts, kind="stable")][:most]


class Profiles:
    """Learned profiles: one sorted array of n-grams with every language's rank."""

    def __init__(self, ranked: dict[str, list[int]], longest: int = LONGEST, ranks: int = RANKED):
        self.langs = sorted(ranked)
        self.size = max((len(v) for v in ranked.values()), default=1)
        self.longest, self.ranks = longest, ranks
        self.grams = np.unique(np.array([g for v in ranked.values() for g in v], np.int64).view(np.uint64))
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), self.size, np.int32)
        for k, lang in enumerate(self.langs):
            own = np.array(ranked[lang], np.int64).view(np.uint64)
            self.rank[np.searchsorted(self.grams, own), k] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and a score: 1 for a profile met exactly, 0 for no n-gram in common."""
        if not text or not self.langs:
            return UNKNOWN, 0.0
        top = _top(*count_grams(text, self.longest), self.ranks)
        if not len(top):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == top, at, len(self.grams))
        found = self.rank[at]
        away = np.where(found < self.size, np.abs(found - np.arange(len(top))[:, None]), self.size).sum(axis=0)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (len(top) * self.size))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, profile: int = PROFILE, fit_texts: int = FIT_TEXTS) -> Profiles:
    """Profiles from a bounded sample of the labelled rows.

    About `fit_texts` distinct texts of each language are taken by a hash of the text, so that copies
    count once and the choice does not depend on the order of rows. What reaches the driver are
    languages x profile n-grams. Null languages and texts are left out.
    """
    bound_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).collect()
    if not counts:
        return Profiles({}, longest)
    scale = 1 << 20
    # As many rows as there are languages, already on the driver.
    limits = F.broadcast(labelled.sparkSession.createDataFrame([(r["lang"], min(scale, -(-fit_texts * scale // max(1, r["n"])))) for r in counts], "lang string, most long"))
    sample = rows.join(limits, "lang").where(F.pmod(F.xxhash64("text"), F.lit(scale)) < F.col("most")).select("lang", "text").distinct()

    def run(batches):
        for batch in batches:
            held: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(count_grams(text, longest))
            for lang, parts in held.items():
                keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                sums = np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(sums)], ["lang", "gram", "n"])

    grams = sample.mapInArrow(lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked: dict[str, list] = {}
    for r in grams.withColumn("place", place).where(F.col("place") <= profile).select("lang", "gram", "place").collect():
        ranked.setdefault(r["lang"], []).append((r["place"], r["gram"]))
    return Profiles({k: [g for _, g in sorted(v)] for k, v in ranked.items()}, longest)


def predictor(profiles: Profiles) -> Callable[[Column], Column]:
    """A column function: text to struct (lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])
        give_back()
        return out

    return predict


def held_out(id_col: str = "doc_id") -> Column:
    """The rows set aside from learning: crc32 of the id as text, modulo 4, is 2. A null id is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    Learns from text and lang of the rows that are not held out; predicts from text alone. A text that
    is null or has no letter is `und` with score 0, and so is every text if no row is labelled. Of languages
    at the same distance the first in the order of names wins. Repeated rows repeat their result; an empty
    table gives an empty result; other columns are ignored.
    """
    profiles = learn(docs.where(~held_out(id_col)), text_col, lang_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return slim.withColumn("p", predictor(profiles)("text")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.0) -> DataFrame:
    """The rows whose text has a language: not `und` and a score of `least` or more. All columns stay."""
    profiles = learn(docs.where(~held_out(id_col)), text_col, lang_col)
    name = "_language_" + "_".join(docs.columns)
    marked = docs.withColumn(name, predictor(profiles)(F.col(text_col).cast("string")))
    return marked.where((F.col(name)["lang_pred"] != UNKNOWN) & (F.col(name)["score"] >= least)).drop(name)
