"""Profiles the texts of every source: counts, lengths, broken constraints, and which signals tell good texts.

    python -m jobs.text_profile --documents /data/documents.parquet --labels /data/labels.parquet --out /data/profile

Two outputs, both Parquet partitioned by source. `features` has a row a document with what is measured of its text;
`profile` is computed from it and has a row a measure:

    lang:<language>      documents, empty, labelled, good, words, mean_words, fano_words, and quantiles of words
    constraint:<name>    rejected documents and the first of them (smallest id)
    signal:<feature>     for documents labelled good and those labelled otherwise: how many of each, the greatest distance of
                         the two laws with its p, and the information that the feature's quantile bin has on the label

Each output is overwritten as a whole, so a run repeated over the same input, also after one that ended early, leaves
the same. A null or empty source or language is `(none)`; a null text is empty. Repeated labels of a document count as
good if any of them does. Documents without a label are counted but not tested.
"""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobs.common import HERE, Done, main, read_or_empty  # noqa: E402
from tapeworks.operators import distributions as ds  # noqa: E402

NONE = "(none)"
SIGNALS = ("words", "distinct_share", "capital_share", "digit_share", "mean_word")
FEATURES = "doc_id long, lang string, chars long, words long, distinct_share double, capital_share double, digit_share double, mean_word double, n_chars_fits boolean, good boolean, source string"
PROFILE = "scope string, measure string, value double, source string"


@dataclass(frozen=True)
class Config:
    """`documents`: Parquet of (doc_id, text, lang, source, n_chars); `labels`: of (doc_id, quality); `out`: where both
    outputs go; `quantiles`: of the words; `bins`: quantile bins of a signal."""

    documents: str = ""
    labels: str = ""
    out: str = ""
    quantiles: tuple = (0.1, 0.5, 0.9, 0.99)
    bins: int = 8

    def __post_init__(self):
        if not self.documents or not self.labels or not self.out:
            raise ValueError("the paths documents, labels and out must be given")
        object.__setattr__(self, "quantiles", tuple(float(q) for q in self.quantiles))
        if not self.quantiles or not all(0 <= q <= 1 for q in self.quantiles) or self.bins < 2:
            raise ValueError("quantiles must lie between 0 and 1, and bins be at least 2")


def features(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document. Texts are read once; only numbers go on."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    among = lambda chars: F.regexp_count(text, F.lit(chars))
    named = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", NONE).otherwise(F.col(c))
    share = lambda x, n: F.try_divide(x.cast("double"), n.cast("double"))
    n, chars = F.size(words).cast("long"), F.length(text).cast("long")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), named("lang").alias("lang"), chars.alias("chars"), n.alias("words"),
        share(F.size(F.array_distinct(words)), n).alias("distinct_share"), share(among("[A-Z]"), chars).alias("capital_share"),
        share(among("[0-9]"), chars).alias("digit_share"), share(F.length(F.array_join(words, "")), n).alias("mean_word"),
        F.col("n_chars").eqNullSafe(F.length(F.col("text"))).alias("n_chars_fits"), named("source").alias("source"),
    )
    judged = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"))
    return rows.join(judged, "doc_id", "left").select("doc_id", "lang", "chars", "words", *SIGNALS[1:], "n_chars_fits", "good", "source")


def _tidy(df: DataFrame, scope: Column, measures: dict[str, Column]) -> DataFrame:
    """A row a measure; measures without a value are left out."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), c.cast("double").alias("value")) for n, c in measures.items())))
    return df.select(scope.alias("scope"), each.alias("m"), "source").select("scope", "m.measure", "m.value", "source").where("value is not null")


def profile(rows: DataFrame, quantiles: tuple, bins: int) -> DataFrame:
    by = ["source", "lang"]
    lang = F.concat(F.lit("lang:"), F.col("lang"))
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("documents"), F.count_if(F.col("chars") == 0).alias("empty"), F.count("good").alias("labelled"), F.count_if("good").alias("good"),
        F.sum("words").alias("words"), F.avg("words").alias("mean_words"), F.try_divide(F.var_samp("words"), F.avg("words")).alias("fano_words"),
    )
    out = _tidy(counts, lang, {c: F.col(c) for c in ("documents", "empty", "labelled", "good", "words", "mean_words", "fano_words")})
    at = ds.group_quantiles(rows, "words", by, list(quantiles))
    out = out.unionByName(at.select(lang.alias("scope"), F.concat(F.lit("words_q"), F.round(F.col("share") * 100).cast("int")).alias("measure"), F.col("quantile").alias("value"), "source"))

    broken = {"n_chars fits": ~F.col("n_chars_fits"), "has words": F.col("words") == 0, "has a language": F.col("lang") == NONE}
    for name, fails in broken.items():
        census = rows.groupBy("source").agg(F.count_if(fails).alias("rejected"), F.min(F.when(fails, F.col("doc_id"))).alias("first"))
        out = out.unionByName(_tidy(census, F.lit(f"constraint:{name}"), {"rejected": F.col("rejected"), "first": F.col("first")}))

    # All signals at once: a row a document and signal, for documents with a label.
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("x")) for s in SIGNALS)))
    signals = rows.where("good is not null").select("source", "good", each.alias("s")).select("source", "good", "s.*").where("x is not null")
    key, scope = ["source", "signal"], F.concat(F.lit("signal:"), F.col("signal"))
    laws = ds.two_sample_ks(signals, "x", key, F.col("good"))
    out = out.unionByName(_tidy(laws, scope, {"good": F.col("n"), "other": F.col("m"), "distance": F.col("ks"), "p": F.col("p")}))
    told = ds.group_information(ds.quantile_bins(signals, "x", key, bins), "bin", "good", key)
    return out.unionByName(_tidy(told, scope, {"information": F.col("plug_in"), "information_corrected": F.col("miller_madow")}))


def read_profile(spark: SparkSession, out: str) -> DataFrame:
    return read_or_empty(spark, PROFILE, f"{out}/profile")


def run(spark: SparkSession, config: Config) -> Done:
    out = config.out.rstrip("/")
    documents = spark.read.parquet(config.documents).select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.read.parquet(config.labels).select("doc_id", "quality")
    # By ranges of source and id: a large source is many tasks and files, and few tasks write to a small one.
    # The edges of the ranges are drawn from the rows themselves, so these are kept on disk: texts are measured once.
    measured = features(documents, labels).persist(StorageLevel.DISK_ONLY)
    try:
        dealt = measured.repartitionByRange("source", "doc_id")
        dealt.write.mode("overwrite").partitionBy("source").parquet(f"{out}/features")
    finally:
        measured.unpersist()
    rows = read_or_empty(spark, FEATURES, f"{out}/features")
    n = rows.count()
    Done(n, n, rows.select("source").distinct().count(), f"{out}/features").told("text_profile")
    profile(rows, config.quantiles, config.bins).repartition("source").write.mode("overwrite").partitionBy("source").parquet(f"{out}/profile")
    wrote = read_profile(spark, out).agg(F.count("*"), F.count_distinct("source")).first()
    return Done(n, wrote[0], wrote[1], f"{out}/profile").told("text_profile")


if __name__ == "__main__":
    main(Config, run, f"{HERE}/text_profile.json", __doc__)
