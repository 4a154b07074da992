"""Connected components of an edge table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm._util import Stash


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of an edge; root names the component.

    Each round every node points at its smallest neighbour (or itself), pointers are jumped twice,
    and the edges are contracted to the roots, so that stars vanish in one round and chains shrink
    to a fraction. Minima are combined before the shuffle, so a hub with very many edges costs one
    row per task; joins on a hub are rows of two longs that adaptive execution splits. All state is
    in written tables, nothing is collected. Null ends and self loops are ignored; an empty edge
    table gives an empty result.
    """
    spark = edges.sparkSession
    stash = Stash(spark, "components")
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    left = stash.write(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct(), "edges")
    labels, nodes = None, 0
    while edges_left := left.count():
        # An edge has two ends, so these bound the rows of everything below.
        ends, nodes = 2 * edges_left, nodes or 2 * edges_left
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = stash.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "parents", ends)
        one = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
        two = up.join(one, "p").select("u", F.col("q").alias("p"))
        roots = stash.write(two.join(one, "p").select("u", F.col("q").alias("p")), "roots", ends)
        ru, rv = roots.toDF("u", "ru"), roots.toDF("v", "rv")
        merged = left.join(ru, "u").join(rv, "v").where("ru <> rv")
        after = stash.write(merged.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges", edges_left)
        if labels is None:
            now = roots.toDF("node", "root")
        else:
            step = roots.toDF("root", "next")
            now = stash.write(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels", nodes)
            stash.drop(labels, roots)
        stash.drop(left, up)
        labels, left = now, after
    stash.drop(left)
    return labels if labels is not None else spark.createDataFrame([], "node long, root long")
