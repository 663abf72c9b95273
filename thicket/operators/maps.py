"""What a reconciliation says about species nodes and about pairs of genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def species_nodes(leaves: DataFrame) -> DataFrame:
    """(image, name) of every node of the species tree of species leaves: leaves, then nodes within and above regions."""
    tips = leaves.select(F.col("nation").alias("image"), F.col("species").alias("name"))
    inner = leaves.filter("rank > 0").select((1_000_000 + 1000 * F.col("region") + F.col("rank")).alias("image"), F.concat(F.lit("<"), "region", F.lit("."), "rank", F.lit(">")).alias("name"))
    top = leaves.filter("region > 0").select((2_000_000 + F.col("region")).alias("image"), F.concat(F.lit("<"), "region", F.lit(">")).alias("name")).distinct()
    return tips.unionByName(inner).unionByName(top).withColumn("image", F.col("image").cast("int"))


def counts_by_node(nodes: DataFrame, species: DataFrame) -> DataFrame:
    """(image, name, dups, losses, genes): totals over all gene trees of each species node, zeros included."""
    inner = nodes.filter("place > 1").groupBy("image").agg(F.sum("dup").alias("dups"), F.sum("loss").alias("losses"), F.count("*").alias("genes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return species.join(inner, "image", "left").select("image", "name", zero("dups"), zero("losses"), zero("genes"))


def orthology(nodes: DataFrame) -> DataFrame:
    """(gt_id, nation, kind, n): pairs of genes of one species in a tree by kind; PARALOG if they meet at a duplication.

    Two leaves of a caterpillar meet at the later one's node, so that node's dup tells, and it has as many pairs as there are
    genes of the species before it: no pairs are formed. A species with one gene in a tree is SINGLE.
    """
    from pyspark.sql import Window

    before = F.row_number().over(Window.partitionBy("gt_id", "nation").orderBy("place")) - 1
    found = nodes.withColumn("pairs", before).groupBy("gt_id", "nation").agg(F.count("*").alias("genes"), F.sum(F.col("pairs") * F.col("dup")).alias("paralog"), F.sum(F.col("pairs") * (1 - F.col("dup"))).alias("homoeolog"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("long").alias("n")) for k, v in (("PARALOG", F.col("paralog")), ("HOMOEOLOG", F.col("homoeolog")), ("SINGLE", F.when(F.col("genes") == 1, 1).otherwise(0)))])
    return found.select("gt_id", "nation", F.inline(kinds)).filter("n > 0")


def counts(nodes: DataFrame, species: DataFrame) -> DataFrame:
    """(image, name, dups, losses, genes): totals of mapped trees of any shape over each species node (node_id, name), zeros included."""
    inner = nodes.filter("NOT is_leaf").groupBy("image").agg(F.sum("dup").alias("dups"), F.sum("loss").alias("losses"), F.count("*").alias("genes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return species.select(F.col("node_id").alias("image"), "name").join(inner, "image", "left").select("image", "name", zero("dups"), zero("losses"), zero("genes"))


def gene_pairs(nodes: DataFrame, leaves: DataFrame, species: str) -> DataFrame:
    """(tree_id, species, kind, n) of pairs of genes of one species in mapped trees of any shape: PARALOG if they meet at a duplication, else HOMOEOLOG; SINGLE for one gene.

    leaves has (tree_id, leaf, species). Of n genes below a node those pairs meet there that don't meet below a child: no pairs are formed.
    """
    key = ["tree_id", species]
    names = leaves.groupBy("tree_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("leaf", species))), lambda x: x[species]).alias("names"))
    below = nodes.join(names, "tree_id").select("tree_id", "node_id", "parent_id", "dup", F.explode(F.expr("slice(names, lo + 1, hi - lo + 1)")).alias(species))
    held = below.groupBy("tree_id", "node_id", "parent_id", "dup", species).agg(F.count("*").alias("n")).withColumn("pairs", F.expr("n * (n - 1) div 2"))
    # A node's pairs, and the same taken off its parent's.
    own = F.struct("node_id", F.col("pairs").alias("p"), F.col("dup").alias("d"))
    up = F.struct(F.col("parent_id").alias("node_id"), (-F.col("pairs")).alias("p"), F.lit(None).cast("int").alias("d"))
    met = held.filter("n > 1").select(*key, F.inline(F.array(own, up))).filter("node_id IS NOT NULL").groupBy(*key, "node_id").agg(F.sum("p").alias("p"), F.max("d").alias("d")).filter("p > 0")
    pairs = met.groupBy(*key, F.when(F.col("d") == 1, "PARALOG").otherwise("HOMOEOLOG").alias("kind")).agg(F.sum("p").alias("n"))
    single = leaves.groupBy(*key).agg(F.count("*").alias("n")).filter("n = 1").select(*key, F.lit("SINGLE").alias("kind"), F.col("n"))
    return pairs.unionByName(single)
