"""How often a clade may be copied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allowance(species: DataFrame, limits: DataFrame, copies: DataFrame) -> DataFrame:
    """(h, allowed): how often each clade may be copied, the least over its species of (limit - copies) / copies in the clade.

    limits has (species, max_copies); a species without one has 999. A clade with a child that may not be copied may not either.
    """
    below = species.alias("a").join(species.alias("d"), F.col("d.tin").between(F.col("a.tin"), F.col("a.tout")) & F.col("d.is_leaf")).select(F.col("a.node_id").alias("h"), F.col("d.species").alias("species"))
    each = below.groupBy("h", "species").agg(F.count("*").alias("here")).join(limits, "species", "left").join(copies, "species", "left")
    room = F.floor((F.coalesce("max_copies", F.lit(999)) - F.coalesce("copies", F.lit(1))) / F.col("here"))
    found = each.groupBy("h").agg(F.min(room).alias("allowed"))
    barred = found.filter("allowed < 1").join(species.select(F.col("node_id").alias("h"), "tin"), "h").select(F.col("tin").alias("x"))
    above = species.join(barred, F.col("x").between(F.col("tin"), F.col("tout"))).select(F.col("node_id").alias("h")).distinct()
    return found.join(above.withColumn("barred", F.lit(True)), "h", "left").select("h", F.when(F.col("barred"), 0).otherwise(F.col("allowed")).alias("allowed"))


def donors(allowed: DataFrame, family: int = 0) -> DataFrame:
    """(family, node) of the clades of allowance() that may be copied at least once: what sweep.candidates takes as donors."""
    return allowed.filter("allowed >= 1").select(F.lit(family).cast("long").alias("family"), F.col("h").alias("node"))
