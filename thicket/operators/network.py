"""Multi-labelled trees as networks: folding, unfolding, extended Newick, measures and comparison, over many trees at once.

Two subtrees of a tree with equal digests (operators/canon.py) are copies of one lineage. Folding merges all of them, so a
network has one node for each digest; one that is reached from more than one place is a reticulation. The root is never merged,
for nothing else is as large. Of many small trees, a row each, the functions of trees fold each where it lies, without a shuffle.
Networks of any size are tables: nodes (net_id, node, name), names for leaves alone, and edges (net_id, src,
dst, n), n being how often src has dst as a child.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.storage import stored
from ..sources import newick
from . import canon


def named_trees(nodes: DataFrame) -> DataFrame:
    """(tree_id, names, nodes) of parsed trees: a row a tree, names of the leaves in order."""
    spans = nodes.select("tree_id", F.col("node_id").alias("u"), F.col("parent_id").alias("parent"), "lo", "hi")
    places = newick.listed(spans, nodes.filter("is_leaf").select("tree_id", F.col("lo").alias("leaf"), F.col("lo").alias("pos")), ["tree_id"])
    names = nodes.filter("is_leaf").groupBy("tree_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("lo", "name"))), lambda x: x["name"]).alias("names"))
    return places.select("tree_id", "nodes").join(names, "tree_id")


def canonical(nodes: DataFrame) -> DataFrame:
    """nodes with canon, a digest of each subtree up to the order of children: of a leaf's name, or of its children's sorted digests."""
    digests = canon.folded(named_trees(nodes), ["tree_id"]).select("tree_id", F.inline("digests")).select("tree_id", F.col("u").cast("int").alias("node_id"), F.col("digest").alias("canon"))
    return nodes.join(digests, ["tree_id", "node_id"])


def fold(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the networks of trees (tree_id, names, nodes), as named_trees() gives them."""
    signed = trees.join(canon.folded(trees, ["tree_id"]), "tree_id")
    each = stored(signed.select(F.col("tree_id").alias("net_id"), F.explode(F.arrays_zip("nodes", F.reverse("digests").alias("digests"))).alias("x"), "names").select("net_id", "x.nodes.*", F.col("x.digests.digest").alias("digest"), "names"))
    leaf_name = F.when(F.col("lo") == F.col("hi"), F.get("names", F.col("lo")))
    nodes = each.groupBy("net_id", "digest").agg(F.min("u").alias("kept"), F.first(leaf_name).alias("name"))
    kept = nodes.select("net_id", F.col("kept").alias("parent"), F.col("digest").alias("src"))
    edges = each.filter("parent IS NOT NULL").join(kept, ["net_id", "parent"]).groupBy("net_id", "src", F.col("digest").alias("dst")).agg(F.count("*").alias("n"))
    return nodes.select("net_id", F.col("digest").alias("node"), "name"), edges


def _each_tree(trees: DataFrame, shape, judge, made: str) -> DataFrame:
    """A row (tree_id, made) of each of trees (tree_id, names, nodes), or (tree_id, names) of the shape that shape(n leaves) has the spans of."""
    types = [x.split(" ", 1)[0] for x in made.split(", ")]

    def run(batches):
        forms = folds.Forms()
        for batch in batches:
            names = batch.column("names").to_pylist()
            spans = ([(x["lo"], x["hi"]) for x in t] for t in batch.column("nodes").to_pylist()) if shape is None else (shape(len(x)) for x in names)
            got = [judge(forms, x, s) for x, s in zip(names, spans)]
            columns = zip(*got) if got else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column("tree_id"), *[pa.array(c, kinds[x.split(" ", 1)[1]]) for x, c in zip(made.split(", "), columns)]], names=["tree_id", *types])

    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
    return trees.select(F.col("tree_id").cast("long"), "names", *(["nodes"] if shape is None else [])).mapInArrow(run, f"tree_id long, {made}")


def tree_measures(trees: DataFrame, shape=None) -> DataFrame:
    """measures() of trees' networks, as (tree_id, n_nodes, n_edges, n_reticulations, n_in)."""
    return _each_tree(trees, shape, folds.measures, "n_nodes long, n_edges long, n_reticulations long, n_in long")


def tree_sets(trees: DataFrame, shape=None) -> DataFrame:
    """(tree_id, sets): below_reticulations() of each tree's network, all sets in a row."""
    return _each_tree(trees, shape, lambda *x: (folds.below_reticulations(*x),), "sets array<array<string>>")


def tree_copies(trees: DataFrame, shape=None) -> DataFrame:
    """(tree_id, n_reticulations, n_copies, n_leaves): reticulations() of each tree, added up."""

    def judge(*x):
        found = folds.copies(*x)
        return len(found), sum(n for _, n, _ in found), sum(m for _, _, m in found)

    return _each_tree(trees, shape, judge, "n_reticulations long, n_copies long, n_leaves long")


def round_trips(trees: DataFrame, shape=None) -> DataFrame:
    """(tree_id, n_leaves, same): whether trees folded, written in extended Newick, read and unfolded are what they were."""
    return _each_tree(trees, shape, lambda forms, names, spans: (len(names), folds.comes_back(forms, names, spans)), "n_leaves long, same boolean")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(net_id, node) that no edge leads to."""
    return nodes.select("net_id", "node").join(edges.select("net_id", F.col("dst").alias("node")).distinct(), ["net_id", "node"], "left_anti")


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(net_id, node, depth): the longest way from the root, level by level for all networks at once; a cycle is an error."""
    level, k, found = stored(roots(nodes, edges).withColumn("depth", F.lit(0))), 0, None
    most = nodes.groupBy("net_id").count().agg(F.max("count")).first()[0] or 0
    while not level.isEmpty():
        if k > most:
            raise ValueError("a network with a cycle")
        found = level if found is None else found.unionByName(level)
        k += 1
        level = stored(level.join(edges.withColumnRenamed("src", "node"), ["net_id", "node"]).select("net_id", F.col("dst").alias("node"), F.lit(k).alias("depth")).distinct())
    return (level if found is None else found).groupBy("net_id", "node").agg(F.max("depth").alias("depth"))


def unfold(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tree_id, names, nodes) of the multi-labelled trees that networks stand for: every way from the root is a node.

    Ways grow by a level at a time for all networks at once; a child that is there n times is n ways.
    """
    level = stored(roots(nodes, edges).withColumn("way", F.lit("")))
    ways, most = level, nodes.groupBy("net_id").count().agg(F.max("count")).first()[0] or 0
    order = Window.partitionBy("net_id", "way").orderBy("dst", "i")
    for _ in range(most):
        down = level.join(edges.withColumnRenamed("src", "node"), ["net_id", "node"]).withColumn("i", F.explode(F.expr("sequence(1L, n)")))
        level = stored(down.withColumn("k", F.row_number().over(order)).select("net_id", F.col("dst").alias("node"), F.concat("way", F.lpad(F.col("k").cast("string"), 6, "0")).alias("way")))
        if level.isEmpty():
            break
        ways = ways.unionByName(level)
    ends = stored(ways).join(nodes, ["net_id", "node"])
    tips = ends.filter("name IS NOT NULL").withColumn("leaf", F.row_number().over(Window.partitionBy("net_id").orderBy("way")) - 1)
    above = tips.select("net_id", "leaf", F.explode(F.expr("transform(sequence(0, length(way) div 6), k -> substring(way, 1, 6 * k))")).alias("way"))
    spans = above.groupBy("net_id", "way").agg(F.min("leaf").alias("lo"), F.max("leaf").alias("hi"))
    names = tips.groupBy("net_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("leaf", "name"))), lambda x: x["name"]).alias("names"))
    listed = spans.groupBy("net_id").agg(F.sort_array(F.collect_list(F.struct("lo", (-F.col("hi")).alias("z"), F.length("way").alias("d")))).alias("s"))
    made = F.transform("s", lambda x, i: F.struct(x["lo"].cast("int").alias("lo"), (-x["z"]).cast("int").alias("hi"), i.cast("long").alias("u"), F.lit(None).cast("long").alias("parent")))
    return listed.join(names, "net_id").select(F.col("net_id").alias("tree_id"), "names", made.alias("nodes"))


def write(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(net_id, newick) in extended Newick: a reticulation's children are written where it is first met, as (...)#Hk, and #Hk stands for it elsewhere."""
    listed = edges.groupBy("net_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "n"))).alias("edges"))
    named = nodes.groupBy("net_id").agg(F.collect_list(F.struct("node", "name")).alias("nodes"))

    def text(row) -> str:
        kids: dict[str, list] = {}
        for e in row["edges"] or []:
            kids.setdefault(e["src"], []).extend([e["dst"]] * e["n"])
        reached = {x for below in kids.values() for x in below}
        name = {x["node"]: x["name"] for x in row["nodes"]}
        return folds.text(next(x for x in name if x not in reached), kids, name)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("net_id"), pa.array([text(r) for r in batch.to_pylist()], pa.string())], names=["net_id", "newick"])

    return named.join(listed, "net_id", "left").select("net_id", "nodes", "edges").mapInArrow(run, "net_id long, newick string")


def read(newicks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of networks (net_id, newick) in extended Newick; a tag is what follows # in a name, and its places are one node.

    A reticulation that stands alone above one node is joined with it, as folding has it.
    """
    parsed = stored(newick.parse(newicks.select(F.col("net_id").alias("tree_id"), "newick")))
    tag = F.when(F.contains(F.coalesce("name", F.lit("")), F.lit("#")), F.regexp_extract("name", "#.*$", 0))
    key = F.coalesce(tag, F.col("node_id").cast("string"))
    each = parsed.select(F.col("tree_id").alias("net_id"), "node_id", "parent_id", key.alias("node"), F.when(F.col("is_leaf") & tag.isNull(), F.col("name")).alias("name"))
    up = each.select("net_id", F.col("node_id").alias("parent_id"), F.col("node").alias("src"))
    edges = each.join(up, ["net_id", "parent_id"]).groupBy("net_id", "src", F.col("node").alias("dst")).agg(F.count("*").alias("n"))
    nodes = each.groupBy("net_id", "node").agg(F.max("name").alias("name"))
    one = edges.groupBy("net_id", "src").agg(F.sum("n").alias("k"), F.first("dst").alias("to")).filter("k = 1")
    alone = stored(one.filter(F.startswith("src", F.lit("#"))).select("net_id", F.col("src").alias("tag"), "to"))
    moved = edges.join(alone.select("net_id", F.col("tag").alias("src"), F.lit(True).alias("gone")), ["net_id", "src"], "left").filter("gone IS NULL").drop("gone")
    moved = moved.join(alone.select("net_id", F.col("tag").alias("dst"), "to"), ["net_id", "dst"], "left").groupBy("net_id", "src", F.coalesce("to", "dst").alias("dst")).agg(F.sum("n").alias("n"))
    return nodes.join(alone.select("net_id", F.col("tag").alias("node")), ["net_id", "node"], "left_anti"), moved


def measures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(net_id, n_nodes, n_edges, n_reticulations, n_in): sizes of networks; n_in adds up how often reticulations are reached."""
    into = edges.groupBy("net_id", F.col("dst").alias("node")).agg(F.sum("n").alias("n"))
    each = nodes.join(into, ["net_id", "node"], "left")
    many = F.col("n") > 1
    return each.groupBy("net_id").agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"), F.count_if(many).alias("n_reticulations"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("n_in"))


def below_reticulations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(net_id, node, leaves): the names of the different leaves below each reticulation, sorted. Ways down grow by a level at a time."""
    into = edges.groupBy("net_id", F.col("dst").alias("node")).agg(F.sum("n").alias("n")).filter("n > 1")
    level = stored(into.select("net_id", "node", F.col("node").alias("at")))
    reached = level
    while True:
        level = stored(level.join(edges.select("net_id", F.col("src").alias("at"), "dst"), ["net_id", "at"]).select("net_id", "node", F.col("dst").alias("at")).distinct())
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    tips = nodes.filter("name IS NOT NULL").select("net_id", F.col("node").alias("at"), "name")
    return reached.distinct().join(tips, ["net_id", "at"]).groupBy("net_id", "node").agg(F.array_sort(F.collect_set("name")).alias("leaves"))


def best_assignment(weight: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of the greatest total weight, each row and column once at most: shortest augmenting ways over potentials."""
    turned = len(weight) > len(weight[0])
    cost = [[-x for x in r] for r in (zip(*weight) if turned else weight)]
    n, m = len(cost), len(cost[0])
    row_pot, col_pot, owner = [0.0] * n, [0.0] * m, [-1] * m
    for start in range(n):
        far, via, done = [float("inf")] * m, [-1] * m, [False] * m
        row, at, base = start, -1, 0.0
        while row >= 0:
            for j in range(m):
                if not done[j] and (d := base + cost[row][j] - row_pot[row] - col_pot[j]) < far[j]:
                    far[j], via[j] = d, at
            at = min((j for j in range(m) if not done[j]), key=far.__getitem__)
            done[at], base, row = True, far[at], owner[at]
        row_pot[start] += base
        for j in range(m):
            if done[j] and owner[j] >= 0:
                row_pot[owner[j]] += base - far[j]
            if done[j]:
                col_pot[j] -= base - far[j]
        while at >= 0:
            owner[at] = owner[via[at]] if via[at] >= 0 else start
            at = via[at]
    return sorted((j, i) if turned else (i, j) for j, i in enumerate(owner) if i >= 0)


def matched(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, distance, fp, fn, tp) of pairs of networks by the leaf sets (net_id, leaves) of their reticulations.

    Reticulations are matched for the greatest sum of Jaccard indices. A pair's distance is 1 less its index, what it has in b
    alone is its share of false ones, in a alone of missing ones; each unmatched one counts 1, in b to fp, in a to fn; all are
    divided by the larger number. Networks without reticulations are at 0 of one another and at 1 of all others.
    """
    return matched_rows(sets.groupBy("net_id").agg(F.sort_array(F.collect_list("leaves")).alias("sets")), pairs)


def matched_rows(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """matched() of sets that are there as a row for each network (net_id, sets), sorted; networks without sets may be left out."""
    none = F.array().cast("array<array<string>>")
    side = lambda x: held.select(F.col("net_id").alias(x), F.col("sets").alias(f"{x}_sets"))
    both = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", F.coalesce("a_sets", none).alias("x"), F.coalesce("b_sets", none).alias("y"))

    def judged(x, y):
        if not x or not y:
            return float(bool(x) != bool(y)), float(bool(y) and not x), float(bool(x) and not y)
        common = [[len(p & q) for q in y] for p in x]
        index = [[c / len(p | q) for c, q in zip(row, y)] for row, p in zip(common, x)]
        found = best_assignment(index)
        extra, n = abs(len(x) - len(y)), max(len(x), len(y))
        d = sum(1 - index[i][j] for i, j in found) + extra
        fp = sum((len(y[j]) - common[i][j]) / len(y[j]) for i, j in found) + max(0, len(y) - len(x))
        fn = sum((len(x[i]) - common[i][j]) / len(x[i]) for i, j in found) + max(0, len(x) - len(y))
        return d / n, fp / n, fn / n

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            got = [judged([set(s) for s in r["x"]], [set(s) for s in r["y"]]) for r in rows]
            sizes = [(len(r["x"]), len(r["y"])) for r in rows]
            columns = [batch.column("a"), batch.column("b"), *[pa.array([s[i] for s in sizes], pa.int64()) for i in (0, 1)], *[pa.array([g[i] for g in got], pa.float64()) for i in range(3)], pa.array([1 - g[0] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n_a", "n_b", "distance", "fp", "fn", "tp"])

    return both.mapInArrow(run, "a long, b long, n_a long, n_b long, distance double, fp double, fn double, tp double")


def matrix(nets: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, distance) of every two of a set of networks (net_id), both ways, and 0 of each from itself."""
    one = nets.select(F.col("net_id").alias("a"))
    lower = matched(sets, one.join(nets.select(F.col("net_id").alias("b")), F.col("b") < F.col("a"))).select("a", "b", "distance")
    return lower.unionByName(lower.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).unionByName(one.select("a", F.col("a").alias("b"), F.lit(0.0).alias("distance")))


def reticulations(nodes: DataFrame) -> DataFrame:
    """(tree_id, canon, kept, n_copies, n_leaves): the lineages that folding merges, each with the copy that stays.

    Only the topmost equal subtrees count: those whose parents are not copies of one another themselves. The root never folds.
    """
    named = canonical(nodes)
    copies = F.count("*").over(Window.partitionBy("tree_id", "canon"))
    counted = named.withColumn("copies", F.when(F.col("parent_id").isNull(), 1).otherwise(copies))
    up = counted.select("tree_id", F.col("node_id").alias("parent_id"), F.col("copies").alias("above"))
    joined = counted.join(up, ["tree_id", "parent_id"], "left").filter("copies > 1")
    # A copy whose parent is folded too goes with it.
    width = joined.withColumn("n_leaves", F.expr("hi - lo + 1"))
    folded = width.filter(F.coalesce("above", F.lit(1)) <= 1)
    return folded.groupBy("tree_id", "canon").agg(F.min("node_id").alias("kept"), F.count("*").alias("n_copies"), F.max("n_leaves").alias("n_leaves")).filter("n_copies > 1")


def unfolded_size(edges: DataFrame) -> DataFrame:
    """(net_id, node, n_paths) of a network's edges (net_id, src, dst): how often unfolding repeats each node.

    Paths from the root are counted level by level; a network has no cycles, so this ends.
    """
    roots = edges.select("net_id", F.col("src").alias("node")).distinct().join(edges.select("net_id", F.col("dst").alias("node")).distinct(), ["net_id", "node"], "left_anti")
    level = roots.withColumn("n", F.lit(1).cast("long"))
    total = level
    while True:
        level = level.join(edges.withColumnRenamed("src", "node"), ["net_id", "node"]).groupBy("net_id", F.col("dst").alias("node")).agg(F.sum("n").alias("n"))
        level = stored(level)
        if level.isEmpty():
            break
        total = total.unionByName(level)
    return total.groupBy("net_id", "node").agg(F.sum("n").alias("n_paths"))
