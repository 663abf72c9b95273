"""Comparison of trees by the leaves they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ploidy_distance(copies: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b) of trees the distance of their extra copies; copies has (tree, taxon, n).

    Copies beyond the first are matched by taxon; a taxon that a tree lacks has none. distance is 1 - common / union, fp are b's
    extras that a lacks, fn a's that b lacks, tp the common ones.
    """
    extra = copies.select("tree", "taxon", (F.col("n") - 1).alias("extra"))
    left = pairs.join(extra.withColumnRenamed("tree", "a"), "a").select("a", "b", "taxon", F.col("extra").alias("x"), F.lit(0).cast("long").alias("y"))
    right = pairs.join(extra.withColumnRenamed("tree", "b"), "b").select("a", "b", "taxon", F.lit(0).cast("long").alias("x"), F.col("extra").alias("y"))
    each = left.unionByName(right).groupBy("a", "b", "taxon").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    common, union = F.sum(F.least("x", "y")), F.sum(F.greatest("x", "y"))
    found = each.groupBy("a", "b").agg(common.alias("tp"), (F.sum("y") - common).alias("fp"), (F.sum("x") - common).alias("fn"), union.alias("union"))
    return found.select("a", "b", "tp", "fp", "fn", F.when(F.col("union") > 0, 1 - F.col("tp") / F.col("union")).otherwise(0.0).alias("distance"))


def jaccard(copies: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, common, jaccard) of the leaf sets of pairs of trees."""
    size = copies.groupBy("tree").agg(F.count("*").alias("size"))
    shared = pairs.join(copies.select(F.col("tree").alias("a"), "taxon"), "a").join(copies.select(F.col("tree").alias("b"), "taxon"), ["b", "taxon"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    sizes = pairs.join(size.select(F.col("tree").alias("a"), F.col("size").alias("na")), "a").join(size.select(F.col("tree").alias("b"), F.col("size").alias("nb")), "b")
    common = F.coalesce("common", F.lit(0)).cast("long")
    return sizes.join(shared, ["a", "b"], "left").select("a", "b", common.alias("common"), (common / (F.col("na") + F.col("nb") - common)).alias("jaccard"))
