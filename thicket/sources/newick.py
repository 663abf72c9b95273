"""Newick as a source and a sink, and reconciliation of any parsed trees.

Parsed trees are node tables: one row a node with its parent, depth and preorder interval [tin, tout], so what lies below a
node is an interval and the lowest node above a set of leaves is that above its first and last in preorder.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, trees
from ..functions.storage import stored

#: Pairs of species leaves up to this many are broadcast, some 20 bytes each; more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000
NODES = "tree_id long, node_id int, parent_id int, child_ord int, name string, species string, is_leaf boolean, dist double, depth int, tin int, tout int, post int, lo int, hi int, support double"
TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]


def kind_of(spark, text: str) -> str:
    """What an input is: raw (it has a bracket or semicolon), file, dir, glob, or missing. Paths are asked of the file system that Spark reads from."""
    if any(c in text for c in "();"):
        return "raw"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(path):
        return "dir" if files.getFileStatus(path).isDirectory() else "file"
    found = files.globStatus(path) if any(c in text for c in "*?[{") else None
    return "glob" if found else "missing"


def read(spark, text: str) -> DataFrame:
    """(tree_id, origin, newick) of an input by its kind: raw text is one tree, a file one on each line, a folder or pattern one in each file.

    origin is input, a line's file and number, or a file. Blank lines and files are left out, so that numbers are of lines in
    the file. tree_id only tells trees apart.
    """
    kind = kind_of(spark, text)
    if kind == "missing":
        raise FileNotFoundError(f"no such input: {text}")
    if kind == "raw":
        rows = spark.createDataFrame([("input", text)], "origin string, newick string")
    elif kind == "file":
        # A file is read whole, for the number of a line is known to no one else.
        whole = spark.read.text(text, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("k", "newick"))
        rows = whole.select(F.concat("file", F.lit(":"), (F.col("k") + 1).cast("string")).alias("origin"), "newick")
    else:
        rows = spark.read.text(text, wholetext=True).select(F.col("_metadata.file_path").alias("origin"), F.col("value").alias("newick"))
    rows = rows.withColumn("newick", F.btrim("newick", F.lit(" \t\r\n"))).filter("newick <> ''")
    return rows.select(F.monotonically_increasing_id().alias("tree_id"), "origin", "newick")


def read_lines(spark, path: str) -> DataFrame:
    """(tree_id, origin, newick) of files of any size with a tree on each line; blank lines are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("origin"), F.trim("value").alias("newick")).filter("newick <> ''")
    return lines.select(F.monotonically_increasing_id().alias("tree_id"), "origin", "newick")


def _nodes(tree_id, tree: trees.Tree):
    leaves_before = [0]
    for u in sorted(range(len(tree.parent)), key=tree.tin.__getitem__):
        leaves_before.append(leaves_before[-1] + (not tree.children[u]))
    for u in range(len(tree.parent)):
        leaf = not tree.children[u]
        number = not leaf and tree.name[u].replace(".", "", 1).isdigit()
        name = None if number else tree.name[u]
        parent = tree.parent[u]
        yield tree_id, u, parent if u else None, tree.children[parent].index(u) if u else 0, name, trees.species_of(name) if leaf else None, leaf, tree.dist[u], tree.depth[u], tree.tin[u], tree.tout[u], tree.post[u], leaves_before[tree.tin[u]], leaves_before[tree.tout[u] + 1] - 1, float(tree.name[u]) if number else None


def parse(newicks: DataFrame) -> DataFrame:
    """Node table of (tree_id, newick); strings that are no trees yield nothing, see rejects()."""

    def nodes(batches):
        for batch in batches:
            rows = []
            for tree_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += _nodes(tree_id, trees.parse_newick(text or ""))
                except ValueError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES)], names=[x.split()[0] for x in NODES.split(", ")])

    return newicks.select(F.col("tree_id").cast("long"), "newick").mapInArrow(nodes, NODES)


def rejects(newicks: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """The rows of newicks that parse() has nothing for; parsed is what it has, if that is at hand."""
    parsed = parse(newicks) if parsed is None else parsed
    return newicks.join(parsed.filter("parent_id IS NULL").select("tree_id"), "tree_id", "left_anti")


def write(leaves: DataFrame, support: str | None = None) -> DataFrame:
    """(tree_id, newick) of caterpillars given by (gt_id, place, species); leaves are gene_species. A column support labels the node that ends with its leaf."""
    name = F.concat(F.lit("g"), "gt_id", F.lit("."), "place", F.lit("_"), F.replace("species", F.lit("_"), F.lit("-")))
    return _comb(leaves, "gt_id", "place", name, support).select(F.col("gt_id").alias("tree_id"), F.concat("newick", F.lit(";")).alias("newick"))


def _comb(parts: DataFrame, key: str, order: str, name, support: str | None = None) -> DataFrame:
    """(key, newick) of the caterpillar of each key's parts."""
    label = F.lit("") if support is None else F.coalesce(F.col(support).cast("string"), F.lit(""))
    listed = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), name.alias("x"), label.alias("l")))).alias("x"))
    rest = F.transform(F.slice("x", 2, F.greatest(F.lit(1), F.size("x"))), lambda s: F.concat(F.lit(","), s["x"], F.lit(")"), s["l"]))
    return listed.select(key, F.concat(F.expr("repeat('(', size(x) - 1)"), F.get("x", F.lit(0))["x"], F.array_join(rest, "")).alias("newick"))


def species_newick(species: DataFrame) -> DataFrame:
    """(tree_id, newick): the species tree of species leaves."""
    regions = _comb(species, "region", "rank", F.replace("species", F.lit("_"), F.lit("-")))
    whole = _comb(regions.withColumn("all", F.lit(0)), "all", "region", F.col("newick"))
    return whole.select(F.lit(0).cast("long").alias("tree_id"), F.concat("newick", F.lit(";")).alias("newick"))


def pairs_below(nodes: DataFrame, key: str) -> DataFrame:
    """(key, lo, hi, node, depth): every two leaves of a tree, by number, and the lowest node above both; a leaf is above itself.

    Two leaves meet where they lie below different children, so each pair is made once and nothing is searched.
    """
    kid = nodes.filter("parent_id IS NOT NULL").select(key, F.col("parent_id").alias("node_id"), "lo", "hi")
    left, right = kid.select(key, "node_id", F.col("lo").alias("a"), F.col("hi").alias("b")), kid.select(key, "node_id", F.col("lo").alias("c"), F.col("hi").alias("d"))
    two = left.join(right, [key, "node_id"]).filter("b < c").join(nodes.select(key, "node_id", "depth"), [key, "node_id"])
    met = two.withColumn("lo", F.explode(F.sequence("a", "b"))).withColumn("hi", F.explode(F.sequence("c", "d"))).select(key, "lo", "hi", F.col("node_id").alias("node"), "depth")
    return met.unionByName(nodes.filter("lo = hi").select(key, "lo", "hi", F.col("node_id").alias("node"), "depth"))


def listed(nodes: DataFrame, leaves: DataFrame, key: list[str]) -> DataFrame:
    """(*key, pos, nodes): a row a tree; pos is each leaf's species leaf in order, nodes (lo, hi, u, parent) are in preorder.

    nodes has (*key, u, parent, lo, hi) and leaves (*key, leaf, pos). All later steps of a tree go on from this row.
    """
    none = F.lit(None)
    inner = nodes.select(*key, F.struct("lo", (-F.col("hi")).alias("z"), F.col("u").cast("long").alias("u"), F.col("parent").cast("long").alias("parent")).alias("node"), none.cast("struct<leaf:int,pos:int>").alias("tip"))
    tips = leaves.select(*key, none.cast("struct<lo:int,z:int,u:bigint,parent:bigint>").alias("node"), F.struct(F.col("leaf").cast("int").alias("leaf"), F.col("pos").cast("int").alias("pos")).alias("tip"))
    rows = inner.unionByName(tips).groupBy(*key).agg(F.sort_array(F.collect_list("tip")).alias("tips"), F.sort_array(F.collect_list("node")).alias("nodes"))
    return rows.select(*key, F.transform("tips", lambda x: x["pos"]).alias("pos"), F.transform("nodes", lambda x: F.struct(x["lo"].alias("lo"), (-x["z"]).alias("hi"), x["u"].alias("u"), x["parent"].alias("parent"))).alias("nodes"))


def spans(rows: DataFrame, key: list[str]) -> DataFrame:
    """(*key, u, parent, lo, hi, first, last, kinds) of every node of listed(): least and greatest species leaf below it, and how many different ones."""
    each = rows.select(*key, "pos", F.inline("nodes")).withColumn("held", F.slice("pos", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1))
    return each.select(*key, "u", "parent", "lo", "hi", F.array_min("held").alias("first"), F.array_max("held").alias("last"), F.size(F.array_distinct("held")).alias("kinds"))


def unresolved(parsed: DataFrame) -> DataFrame:
    """(tree_id, reason) of parsed trees that are not binary: unrooted if the root has over two children, polytomy for another such node, unary for one child."""
    kids = parsed.filter("parent_id IS NOT NULL").groupBy("tree_id", "parent_id").agg(F.count("*").alias("n")).filter("n <> 2")
    reason = F.when(F.col("n") == 1, "unary").when(F.col("parent_id") == 0, "unrooted").otherwise("polytomy")
    return kids.select("tree_id", reason.alias("reason")).groupBy("tree_id").agg(F.max("reason").alias("reason"))  # unrooted before unary before polytomy


def name_problems(parsed: DataFrame) -> DataFrame:
    """(tree_id, name, reason) of a species tree's names that it can't have, names that come twice among them."""
    own = parsed.select("tree_id", "name", names.species_problem(F.col("name"), F.col("is_leaf")).alias("reason")).filter("reason IS NOT NULL")
    twice = parsed.filter("coalesce(name, '') <> ''").groupBy("tree_id", "name").agg(F.count("*").alias("n")).filter("n > 1")
    return own.distinct().unionByName(twice.select("tree_id", "name", F.lit("name twice").alias("reason")))


def gene_name_problems(parsed: DataFrame, species: DataFrame) -> DataFrame:
    """(tree_id, name, reason) of gene trees' leaves that can't be read as genes of species (species): without a name, with structure signs, of no known species, or twice."""
    leaves = parsed.filter("is_leaf").select("tree_id", "name", "species").join(species.select("species", F.lit(True).alias("known")).distinct(), "species", "left")
    whole = leaves.join(species.select(F.col("species").alias("name"), F.lit(True).alias("whole")).distinct(), "name", "left")
    times = F.count("*").over(Window.partitionBy("tree_id", "name"))
    empty, held = F.coalesce("name", F.lit("")) == "", F.translate("name", names.ILLEGAL, "") != F.col("name")
    reason = F.when(empty, "empty leaf name").when(held, "illegal sign in a leaf name").when(F.col("known").isNull() & F.col("whole").isNull(), "no such species").when(F.col("times") > 1, "name twice")
    return whole.withColumn("times", times).select("tree_id", "name", reason.alias("reason")).filter("reason IS NOT NULL").distinct()


def repaired_names(parsed: DataFrame) -> DataFrame:
    """parsed species trees with their names put right; of equal inner names the first in preorder stays. Leaves that are equal then are left to name_problems()."""
    named = parsed.withColumn("name", names.repaired_species(F.col("name"), F.col("is_leaf")))
    first = F.row_number().over(Window.partitionBy("tree_id", "name").orderBy("tin"))
    again = named.withColumn("name", F.when(F.col("is_leaf") | (first == 1), F.col("name")))
    return again.withColumn("species", F.when(F.col("is_leaf"), F.element_at(F.split("name", "_"), -1)))


def without_knuckles(parsed: DataFrame) -> DataFrame:
    """(tree_id, node_id, parent_id, lo, hi, name, dist, support) of parsed trees without inner nodes of one child.

    Such nodes stand over the same leaves one above the other; the topmost stays, or the leaf if there is one below. It has the
    first name from above, the lowest support, and the lengths of all added up.
    """
    same = Window.partitionBy("tree_id", "lo", "hi").orderBy("tin")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = F.first(F.when(F.coalesce("name", F.lit("")) != "", F.col("name")), True).over(whole)
    leaf = F.max(F.when(F.col("is_leaf"), F.col("node_id"))).over(whole)
    each = parsed.select("tree_id", "node_id", "parent_id", "lo", "hi", "is_leaf", F.when(leaf.isNotNull(), F.max(F.when(F.col("is_leaf"), F.col("name"))).over(whole)).otherwise(named).alias("name"), F.sum("dist").over(whole).alias("dist"), F.min("support").over(whole).alias("support"), F.coalesce(leaf, F.first("node_id").over(whole)).alias("kept"), F.first("parent_id").over(whole).alias("up"))
    ids = each.select("tree_id", F.col("node_id").alias("up"), F.col("kept").alias("above"))
    stays = each.filter("node_id = kept").join(ids, ["tree_id", "up"], "left")
    return stays.select("tree_id", "node_id", F.col("above").alias("parent_id"), "lo", "hi", "name", "dist", "support")


def placed(genes: DataFrame, species: DataFrame) -> DataFrame:
    """(tree_id, leaf, pos) of parsed gene trees: each leaf's number and that of its species' leaf; a gene of a species that the tree lacks is an error."""
    tips = species.filter("is_leaf").select("species", F.col("lo").alias("pos"))
    lost = F.raise_error(F.concat(F.lit("no such species: "), F.coalesce("species", F.lit("null")))).cast("int")
    return genes.filter("is_leaf").join(tips, "species", "left").select("tree_id", F.col("lo").alias("leaf"), F.coalesce("pos", lost).alias("pos"))


def lowest_common(species: DataFrame) -> DataFrame:
    """(first, last, image, image_depth) of every two leaves of one tree (node_id, parent_id, lo, hi, depth), broadcast if few."""
    lowest = stored(pairs_below(species.withColumn("one", F.lit(0)), "one"))
    lowest = lowest.select(F.col("lo").alias("first"), F.col("hi").alias("last"), F.col("node").alias("image"), F.col("depth").alias("image_depth"))
    return F.broadcast(lowest) if lowest.count() <= BROADCAST_PAIRS else lowest


def mapped(nodes: DataFrame, leaves: DataFrame, species: DataFrame) -> DataFrame:
    """(tree_id, node_id, parent_id, is_leaf, lo, hi, image, image_depth, dup, loss) of every node of gene trees against one species tree.

    nodes has (tree_id, u, parent, lo, hi), leaves (tree_id, leaf, pos), species (node_id, parent_id, lo, hi, depth).
    """
    each = spans(listed(nodes, leaves, ["tree_id"]), ["tree_id"])
    images = each.join(lowest_common(species), ["first", "last"])
    # A node's row, and the same as a child of its parent: one grouping brings both together, without a join.
    own = F.struct(F.col("u").alias("node_id"), F.struct("parent", "lo", "hi", "image", "image_depth").alias("own"), F.lit(None).cast("struct<image:int,image_depth:int>").alias("kid"))
    kid = F.struct(F.col("parent").alias("node_id"), F.lit(None).cast("struct<parent:bigint,lo:int,hi:int,image:int,image_depth:int>").alias("own"), F.struct("image", "image_depth").alias("kid"))
    met = images.select("tree_id", F.inline(F.array(own, kid))).filter("node_id IS NOT NULL").groupBy("tree_id", "node_id").agg(F.max("own").alias("own"), F.collect_list("kid").alias("kids"))
    flat = met.select("tree_id", "node_id", F.col("own.parent").alias("parent_id"), (F.size("kids") == 0).alias("is_leaf"), "own.lo", "own.hi", "own.image", "own.image_depth", "kids")
    flat = flat.withColumn("dup", F.exists("kids", lambda x: x["image"] == F.col("image")).cast("int"))
    edge = F.aggregate("kids", F.lit(0), lambda t, x: t + F.greatest(F.lit(0), x["image_depth"] - F.col("image_depth") - 1 + F.col("dup")))
    return flat.withColumn("loss", edge + F.when(F.col("parent_id").isNull(), F.col("image_depth")).otherwise(0)).drop("kids")


def totals(nodes: DataFrame) -> DataFrame:
    """(tree_id, n_leaves, n_dups, n_losses, score) of mapped nodes."""
    found = nodes.groupBy("tree_id").agg(F.sum(F.col("is_leaf").cast("long")).alias("n_leaves"), F.sum("dup").cast("long").alias("n_dups"), F.sum("loss").cast("long").alias("n_losses"))
    return found.withColumn("score", F.col("n_dups") + F.col("n_losses"))


def scored(genes: DataFrame, species: DataFrame) -> DataFrame:
    """(tree_id, n_leaves, n_dups, n_losses, score) of parsed gene trees against one parsed species tree; a gene of a species that it lacks is an error."""
    nodes = genes.select("tree_id", F.col("node_id").alias("u"), F.col("parent_id").alias("parent"), "lo", "hi")
    return totals(mapped(nodes, placed(genes, species), species))
