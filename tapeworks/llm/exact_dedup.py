"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its content says so, between a least and a greatest length in bytes: after
a sentence or line end, or, outside ASCII, after a character whose last byte is one of a few; where a
stretch has neither, after a rare letter or digit. So equal texts have equal chunk lists and most chunks of near
copies are shared, in any script.
Each distinct chunk gets an identifier that is verified by content: every distinct chunk is moved once,
combined before the shuffle, and two chunks that share a hash get different ordinals. Documents are
then compared by their ordered identifier lists; the texts themselves never move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm._util import Stash, ascii_lower

LEAST, GREATEST = 512, 4096


def chunk_hash(chunk: Column) -> Column:
    """128 bits of a chunk; collisions are found and told apart, not assumed away."""
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(1), chunk).alias("b"))


def chunks(text: Column, least: int = LEAST, greatest: int = GREATEST) -> Column:
    """The chunks of a text, in order; joined they give the text. An empty text has none."""
    # Over bytes (as Latin-1), so that all scripts have boundaries; no cut falls inside a character.
    whole = r"(?![\x80-\xbf])"
    ends = [r"(?:[.!?;|\n]|[\x87\xa7]" + whole + ")", "[jqxz07]"]
    pattern = "(?s)" + "|".join([f".{{{least},{greatest - 1}}}?{end}" for end in ends] + [f".{{1,{greatest}}}{whole}", f".{{1,{greatest}}}"])
    cut = F.regexp_extract_all(F.decode(text.cast("binary"), "ISO-8859-1"), F.lit(pattern), F.lit(0))
    return F.transform(cut, lambda c: F.encode(c, "ISO-8859-1").cast("string"))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    greatest: int = GREATEST,
    hashed: Callable[[Column], Column] = chunk_hash,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id of a
    group stays. A null id never stays unless its group has no other (keep_id is null then). Rows that
    repeat a kept id with the same text are one document and all marked kept. group_size counts rows.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "recipes")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    cut = slim.select(F.explode(chunks(F.col("text"), least, greatest)).alias("chunk"))
    verified = cut.select(hashed(F.col("chunk")).alias("h"), "chunk").distinct()
    clashes = stash.write(verified.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "clashes")

    recipe = F.transform(chunks(F.col("text"), least, greatest), lambda c: F.struct(hashed(c).alias("h"), F.lit(0).alias("ordinal")))
    recipes = slim.select("doc_id", F.sha2("text", 256).alias("text_sha256"), recipe.alias("recipe"))
    if clashes.isEmpty():
        recipes = stash.write(recipes, "lists")
    else:
        clashing = verified.join(clashes, "h", "left_semi")
        ordered = clashing.withColumn("ordinal", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
        numbered = stash.write(slim.withColumn("row", F.monotonically_increasing_id()), "texts")
        pieces = numbered.select("row", "doc_id", F.sha2("text", 256).alias("text_sha256"), F.posexplode_outer(chunks(F.col("text"), least, greatest)).alias("pos", "chunk"))
        pieces = pieces.withColumn("h", F.when(F.col("chunk").isNotNull(), hashed(F.col("chunk")))).join(ordered, ["h", "chunk"], "left")
        piece = F.when(F.col("pos").isNotNull(), F.struct("pos", F.struct("h", F.coalesce("ordinal", F.lit(0)).alias("ordinal")).alias("id")))
        lists = pieces.groupBy("row", "doc_id", "text_sha256").agg(F.sort_array(F.collect_list(piece)).alias("l"))
        recipes = stash.write(lists.select("doc_id", "text_sha256", F.transform("l", lambda x: x["id"]).alias("recipe")), "lists")
    # Written, so that both sides of the join are exchanges and a hot recipe's rows can be split between tasks.
    groups = stash.write(recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    joined = recipes.join(groups, "recipe")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_largest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group of equal texts, that with the largest id, with all its columns.

    A repeated id is one document, of which one row stays. Rows with a null id cannot be told from one
    another and stay.
    """
    stash = Stash(docs.sparkSession, "kept")
    marks = exact_duplicates(docs, id_col, text_col)
    ids = stash.write(marks.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("rows")), "ids")
    out = drop_ids(docs, ids.where("not kept").select("doc_id"), id_col)
    repeated = ids.where("kept and rows > 1").select("doc_id")
    if repeated.isEmpty():
        return out
    same = out[id_col] == repeated["doc_id"]
    return out.join(repeated, same, "left_anti").unionByName(out.join(repeated, same, "left_semi").dropDuplicates([id_col]))


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not among `ids` (one column). The texts are hashed to the ids, not sorted."""
    gone = ids.toDF("_gone").hint("shuffle_hash")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
