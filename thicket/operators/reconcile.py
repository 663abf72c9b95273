"""Reconciliation of gene trees with a species tree: images, duplications and losses of every gene node.

A gene node's image is the lowest species node above all its leaves' species. It is a duplication if a child has the same
image; an edge to a child loses the species nodes it passes, and the root loses those above its image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Images as numbers: leaves, nodes within a region, nodes above regions.
LEAF, INNER, TOP = 0, 1_000_000, 2_000_000


def images(leaves: DataFrame) -> DataFrame:
    """leaves with the image and depth of each place's leaf and of the node that covers the places up to it."""
    upto = Window.partitionBy("gt_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low, high = (lambda c: F.min(c).over(upto)), (lambda c: F.max(c).over(upto))
    seen = leaves.withColumns({"_n0": low("nation"), "_n1": high("nation"), "_r0": low("region"), "_r1": high("region"), "_k": high("rank")})
    one, same = F.col("_n0") == F.col("_n1"), F.col("_r0") == F.col("_r1")
    image = F.when(one, LEAF + F.col("nation")).when(same, INNER + 1000 * F.col("_r0") + F.col("_k")).otherwise(TOP + F.col("_r1"))
    region_top = F.col("regions") - F.greatest(F.lit(1), "region")
    depth = F.when(one, F.col("leaf_depth")).when(same, region_top + F.col("size") - 1 - F.col("_k")).otherwise(F.col("regions") - 1 - F.col("_r1"))
    return seen.withColumns({"image": image.cast("int"), "depth": depth.cast("int")}).drop("_n0", "_n1", "_r0", "_r1", "_k")


def node_costs(leaves: DataFrame) -> DataFrame:
    """A row for each place: its node's image, dup and losses; the leaf at place 1 stands for itself. root marks the last."""
    order = Window.partitionBy("gt_id").orderBy("place")
    below = images(leaves).withColumns({"below": F.lag("image").over(order), "below_depth": F.lag("depth").over(order), "root": F.lead("place").over(order).isNull()})
    inner = F.col("place") > 1
    dup = F.when(inner & ((F.col("image") == F.col("below")) | (F.col("image") == LEAF + F.col("nation"))), 1).otherwise(0)
    found = below.withColumn("dup", dup)
    passed = lambda child: F.greatest(F.lit(0), child - F.col("depth") - 1 + F.col("dup"))
    loss = F.when(inner, passed(F.col("below_depth")) + passed(F.col("leaf_depth"))).otherwise(0) + F.when(F.col("root"), F.col("depth")).otherwise(0)
    return found.withColumn("loss", loss.cast("int"))


def scores(nodes: DataFrame, w_dup: int = 1, w_loss: int = 1) -> DataFrame:
    """(gt_id, n_leaves, n_dups, n_losses, score) of each gene tree."""
    found = nodes.groupBy("gt_id").agg(F.count("*").alias("n_leaves"), F.sum("dup").alias("n_dups"), F.sum("loss").alias("n_losses"))
    return found.withColumn("score", w_dup * F.col("n_dups") + w_loss * F.col("n_losses"))


#: node_costs in SQL, after LEAVES_SQL.
NODES_SQL = """
im AS (SELECT *,
         min(nation) OVER w = max(nation) OVER w AS one, min(region) OVER w = max(region) OVER w AS same,
         max(rank) OVER w AS k, max(region) OVER w AS rmax
       FROM gl WINDOW w AS (PARTITION BY gt_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ig AS (SELECT *,
         CAST(CASE WHEN one THEN nation WHEN same THEN 1000000 + 1000 * region + k ELSE 2000000 + rmax END AS INTEGER) AS image,
         CAST(CASE WHEN one THEN leaf_depth WHEN same THEN regions - greatest(1, region) + size - 1 - k ELSE regions - 1 - rmax END AS INTEGER) AS depth
       FROM im),
lg AS (SELECT *, lag(image) OVER w AS below, lag(depth) OVER w AS below_depth, lead(place) OVER w IS NULL AS root FROM ig WINDOW w AS (PARTITION BY gt_id ORDER BY place)),
dp AS (SELECT *, CASE WHEN place > 1 AND (image = below OR image = nation) THEN 1 ELSE 0 END AS dup FROM lg),
nc AS (SELECT *, CAST(CASE WHEN place > 1 THEN greatest(0, below_depth - depth - 1 + dup) + greatest(0, leaf_depth - depth - 1 + dup) ELSE 0 END
                 + CASE WHEN root THEN depth ELSE 0 END AS INTEGER) AS loss FROM dp)"""
