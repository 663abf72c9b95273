"""Grouping of gene trees and of their clades: isomorphism classes, units of a donor clade, caps and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def signatures(leaves: DataFrame) -> DataFrame:
    """(gt_id, signature) equal for trees that differ by names and child order alone: species by place, the first two sorted."""
    listed = leaves.groupBy("gt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "nation"))), lambda x: x["nation"]).alias("s"))
    first = F.array_sort(F.slice("s", 1, 2))
    return listed.select("gt_id", F.array_join(F.concat(first, F.slice("s", 3, F.greatest(F.lit(1), F.size("s")))), ",").alias("signature"))


def classes(leaves: DataFrame) -> DataFrame:
    """(signature, rep_gt_id, weight): one row for each isomorphism class; weights add up to the number of trees."""
    return signatures(leaves).groupBy("signature").agg(F.min("gt_id").alias("rep_gt_id"), F.count("*").alias("weight"))


def units(leaves: DataFrame) -> DataFrame:
    """(gt_id, region, n_leaves, n_units, merged) for each region as donor clade.

    A clade of donor leaves moves as one if its children's species don't meet at its root. In a caterpillar such clades are
    prefixes; the largest one that qualifies takes in all below it, and later donor leaves move alone.
    """
    upto = Window.partitionBy("gt_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = leaves.withColumn("pure", F.min("region").over(upto) == F.max("region").over(upto))
    seen = seen.withColumn("fresh", F.row_number().over(Window.partitionBy("gt_id", "nation").orderBy("place")) == 1)
    fits = F.col("pure") & F.col("fresh") & (F.col("place") > 1)
    each = seen.groupBy("gt_id", "region").agg(F.count("*").alias("n_leaves"), F.coalesce(F.max(F.when(fits, F.col("place"))), F.lit(0)).cast("long").alias("merged"))
    # A merged prefix holds `merged` donor leaves, for all its leaves are the donor's.
    return each.withColumn("n_units", F.when(F.col("merged") > 0, 1 + F.col("n_leaves") - F.col("merged")).otherwise(F.col("n_leaves")))


def within_cap(per_donor: DataFrame, cap: int) -> DataFrame:
    """(gt_id, n_donors, most_units, combinations, kept): a tree over the cap for any donor is left out for all."""
    found = per_donor.groupBy("gt_id").agg(F.count("*").alias("n_donors"), F.max("n_units").alias("most_units"), F.sum(F.pow(F.lit(2.0), "n_units")).cast("long").alias("combinations"))
    return found.withColumn("kept", F.col("most_units") <= cap)


def quotas(leaves: DataFrame) -> DataFrame:
    """(gt_id, o, q): harmonic mean of the share of species present and of support, which reads as 1 where it is missing."""
    found = leaves.groupBy("gt_id").agg(F.count_distinct("nation").alias("present"), F.count("*").alias("n"), F.first("regions").alias("regions"))
    total = leaves.agg(F.count_distinct("nation").alias("all"))
    o = F.col("present") / F.col("all")
    return found.crossJoin(F.broadcast(total)).select("gt_id", o.alias("o"), (2 * o / (o + 1)).alias("q"))


def support_quotas(parsed: DataFrame, n_species: int | None = None) -> DataFrame:
    """(tree_id, o, r, q) of parsed trees: the share of all species that a tree has, the mean support of its inner nodes but the root, and their harmonic mean.

    Supports are of 100 in trees where one is over 1, and 1 where one is missing. A tree of up to two leaves has r 1. Without
    n_species the species of all trees count.
    """
    inner = ~F.col("is_leaf") & F.col("parent_id").isNotNull()
    support = F.when(inner, F.coalesce("support", F.lit(1.0)))
    each = parsed.groupBy("tree_id").agg(F.count_distinct(F.when(F.col("is_leaf"), F.col("species"))).alias("present"), F.count_if("is_leaf").alias("n"), F.coalesce(F.sum(support), F.lit(0.0)).alias("sum"), F.max(support).alias("most"))
    if n_species is None:
        total = parsed.filter("is_leaf").agg(F.count_distinct("species").alias("all"))
        each = each.crossJoin(F.broadcast(total))  # one row
    else:
        each = each.withColumn("all", F.lit(n_species))
    o = F.when(F.col("all") > 0, F.col("present") / F.col("all")).otherwise(0.0)
    r = F.when(F.col("n") <= 2, 1.0).otherwise(F.col("sum") / F.when(F.col("most") > 1, 100.0).otherwise(1.0) / (F.col("n") - 2))
    found = each.select("tree_id", o.alias("o"), r.alias("r"))
    return found.withColumn("q", F.when(F.col("o") + F.col("r") > 0, 2 * F.col("o") * F.col("r") / (F.col("o") + F.col("r"))).otherwise(0.0))


def lineages(trees: DataFrame, key: list[str]) -> DataFrame:
    """(*key, label, n_groups, largest) of trees (*key, labels, nodes): the largest clades of one label, and how many leaves the largest of them has."""
    from .surgery import maximal_clades

    size = F.col("hi") - F.col("lo") + 1
    return maximal_clades(trees, key).groupBy(*key, "label").agg(F.count("*").alias("n_groups"), F.max(size).cast("long").alias("largest"))


UNITS_SQL = """
fr AS (SELECT *, min(region) OVER w = max(region) OVER w AS pure, row_number() OVER (PARTITION BY gt_id, nation ORDER BY place) = 1 AS fresh
       FROM gl WINDOW w AS (PARTITION BY gt_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pd AS (SELECT gt_id, region, count(*) AS n_leaves, coalesce(max(CASE WHEN pure AND fresh AND place > 1 THEN place END), 0) AS merged FROM fr GROUP BY gt_id, region),
un AS (SELECT *, CASE WHEN merged > 0 THEN 1 + n_leaves - merged ELSE n_leaves END AS n_units FROM pd)"""
