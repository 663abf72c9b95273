"""Trees derived from the star-schema tables: nations under regions as the species tree, orders as gene trees.

The species tree is a caterpillar of region tops, each region's a caterpillar of its nations, both in key order. A gene tree is
the caterpillar of an order's lineitems, each a gene of its supplier's nation. In a caterpillar the node at place k covers the
leaves 1 to k, so what lies below a node is a running aggregate and no tree is ever walked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def species_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, species, region, rank, size, regions, leaf_depth) of each nation: its place within its region, from 0."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    within = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    regions = region.select("r_regionkey", (F.row_number().over(Window.orderBy("r_regionkey")) - 1).alias("region"))
    leaves = nation.withColumn("rank", F.row_number().over(within) - 1).withColumn("size", F.count("*").over(Window.partitionBy("n_regionkey")))
    leaves = leaves.join(regions, leaves.n_regionkey == regions.r_regionkey).crossJoin(region.agg(F.count("*").alias("regions")))
    top = F.col("regions") - F.greatest(F.lit(1), "region")
    return leaves.select(
        F.col("n_nationkey").alias("nation"),
        F.col("n_name").alias("species"),
        "region",
        "rank",
        "size",
        "regions",
        (top + F.col("size") - 1 - F.greatest(F.lit(1), "rank") + 1).cast("int").alias("leaf_depth"),
    )


def gene_leaves(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(gt_id, place, and the species leaf's columns) of each lineitem, places from 1 in each order's tree; more names further columns of lineitem."""
    species = F.broadcast(species_leaves(spark, sf_dir))  # one row a nation
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *more)
    order = Window.partitionBy("gt_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    genes = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).join(species, "nation").withColumnRenamed("l_orderkey", "gt_id")
    return genes.withColumn("place", F.row_number().over(order)).select("gt_id", "place", "nation", "species", "region", "rank", "size", "regions", "leaf_depth", *more)


#: Suppliers up to this many are broadcast, some 20 bytes each; more are joined by a shuffle.
BROADCAST_SUPPLIERS = 1_000_000


def order_leaves(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """(tree_id, leaves): a row an order, a column of placed_leaves of its leaves in order. Lineitems are shuffled once, and that is all."""
    order = Window.orderBy("region", "rank")  # one row a nation
    places = species_leaves(spark, sf_dir).withColumn("pos", F.row_number().over(order) - 1).select("nation", F.col(column).alias("x"))
    supplier = table(spark, sf_dir, "supplier")
    homes = supplier.join(F.broadcast(places), supplier.s_nationkey == places.nation).select(F.col("s_suppkey").alias("l_suppkey"), "x")
    homes = F.broadcast(homes) if supplier.count() <= BROADCAST_SUPPLIERS else homes
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").join(homes, "l_suppkey")
    rows = lines.groupBy(F.col("l_orderkey").alias("tree_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "x"))).alias("x"))
    return rows.select("tree_id", F.col("x.x").alias("leaves"))


def placed_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene_leaves with leaf, a leaf's number in its tree from 0, and pos, its species leaf's in the species tree, both from left to right."""
    order = Window.orderBy("region", "rank")  # one row a nation
    places = species_leaves(spark, sf_dir).select("nation", (F.row_number().over(order) - 1).alias("pos"))
    return gene_leaves(spark, sf_dir).join(F.broadcast(places), "nation").withColumn("leaf", F.col("place") - 1)


def balanced_nodes(leaves: DataFrame) -> DataFrame:
    """(tree_id, u, parent, lo, hi): each order's leaves as a balanced tree instead of a caterpillar.

    A node of level l covers 2 ** l leaves from a multiple of that on, as far as there are any; one that covers what its only
    child does is left out. u is 100,000 lo + hi.
    """
    sizes = leaves.groupBy(F.col("gt_id").alias("tree_id")).agg(F.count("*").alias("n"))
    top = F.ceil(F.log2("n")).cast("int")
    spread = sizes.withColumn("top", top).withColumn("l", F.explode(F.sequence(F.lit(0), "top")))
    spread = spread.withColumn("j", F.explode(F.expr("sequence(0L, (n - 1) >> l)"))).filter("l = 0 OR (j << l) + (1L << (l - 1)) < n")
    up = F.expr("get(filter(sequence(1, top - l), m -> ((j >> m) << (l + m)) + (1L << (l + m - 1)) < n), 0)")
    spread = spread.withColumn("m", F.when(F.col("l") < F.col("top"), up)).selectExpr("tree_id", "j << l AS lo", "least((j + 1) << l, n) - 1 AS hi", "(j >> m) << (l + m) AS plo", "least(((j >> m) + 1) << (l + m), n) - 1 AS phi")
    return spread.selectExpr("tree_id", "100000 * lo + hi AS u", "100000 * plo + phi AS parent", "int(lo) AS lo", "int(hi) AS hi")


#: The same leaves in SQL, as common table expressions that other queries begin with.
LEAVES_SQL = """
rg AS (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) - 1 AS region, count(*) OVER () AS regions FROM region),
sp AS (SELECT n_nationkey AS nation, n_name AS species, region, regions,
              row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS rank,
              count(*) OVER (PARTITION BY n_regionkey) AS size
       FROM nation JOIN rg ON n_regionkey = r_regionkey),
sl AS (SELECT *, regions - greatest(1, region) + size - 1 - greatest(1, rank) + 1 AS leaf_depth FROM sp),
gl AS (SELECT l_orderkey AS gt_id,
              row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, sl.*
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN sl ON s_nationkey = sl.nation)"""

#: The whole species tree's nodes, leaves with their places, and the balanced trees' nodes in SQL, after LEAVES_SQL.
BALANCED_SQL = """
sq AS (SELECT *, row_number() OVER (ORDER BY region, rank) - 1 AS pos FROM sl),
sr AS (SELECT region, min(pos) AS a, max(pos) AS z FROM sq GROUP BY region),
si AS (SELECT pos AS lo, pos AS hi, species AS name FROM sq UNION ALL SELECT a, pos, NULL FROM sq JOIN sr USING (region) WHERE rank > 0 UNION ALL SELECT 0, z, NULL FROM sr WHERE region > 0),
sd AS (SELECT CAST(row_number() OVER (ORDER BY lo, hi DESC) - 1 AS INTEGER) AS node, lo, hi, name, (SELECT count(*) - 1 FROM si a WHERE a.lo <= s.lo AND s.hi <= a.hi) AS depth FROM si s),
bl AS (SELECT gt_id, place - 1 AS leaf, pos, gl.nation, gl.species FROM gl JOIN sq USING (nation)),
bz AS (SELECT gt_id, count(*) AS n FROM gl GROUP BY gt_id),
bn AS (SELECT gt_id, n, (j << l) AS lo, least((j + 1) << l, n) - 1 AS hi FROM (SELECT *, unnest(range(((n - 1) >> l) + 1)) AS j FROM (SELECT *, unnest(range(CAST(ceil(log2(n)) AS BIGINT) + 1)) AS l FROM bz)) WHERE l = 0 OR (j << l) + (1 << (l - 1)) < n),
bp AS (SELECT b.gt_id, b.lo, b.hi, arg_min(p.lo, p.hi - p.lo) AS plo, arg_min(p.hi, p.hi - p.lo) AS phi FROM bn b LEFT JOIN bn p ON p.gt_id = b.gt_id AND p.lo <= b.lo AND b.hi <= p.hi AND (p.lo <> b.lo OR p.hi <> b.hi) GROUP BY ALL),
bs AS (SELECT b.gt_id, b.lo, b.hi, plo, phi, min(pos) AS f, max(pos) AS z, count(DISTINCT pos) AS kinds FROM bp b JOIN bl ON bl.gt_id = b.gt_id AND leaf BETWEEN b.lo AND b.hi GROUP BY ALL),
bt AS (SELECT f, z, arg_max(node, depth) AS image, max(depth) AS d FROM (SELECT DISTINCT f, z FROM bs) JOIN sd ON sd.lo <= f AND z <= sd.hi GROUP BY f, z),
bi AS (SELECT bs.*, image, d FROM bs JOIN bt USING (f, z)),
bm AS (SELECT p.gt_id, p.lo, p.hi, p.plo, p.image, p.d, CAST(coalesce(max(CASE WHEN k.image = p.image THEN 1 ELSE 0 END), 0) AS INTEGER) AS dup, list(k.d) FILTER (k.d IS NOT NULL) AS ds
       FROM bi p LEFT JOIN bi k ON k.gt_id = p.gt_id AND k.plo = p.lo AND k.phi = p.hi GROUP BY ALL),
bc AS (SELECT gt_id, lo, hi, image, dup, CAST(coalesce(list_sum(list_transform(ds, lambda x: greatest(0, x - d - 1 + dup))), 0) + CASE WHEN plo IS NULL THEN d ELSE 0 END AS INTEGER) AS loss FROM bm)"""
