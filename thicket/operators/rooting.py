"""Every rooting of gene trees scored against the species tree at once.

Seen from a root on the edge above node u, what lies below a node is either what lay below it before, or all but what lay below
a child of it on the way to u. So a tree has two images a node, of the leaves below it and of all others, and with them two
costs; a rooting's cost is the first ones of the nodes off the way from the root to u, the second ones of those on it, and what
the new root costs. Sums along the way are running sums in preorder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..sources import newick


def images(nodes: DataFrame, leaves: DataFrame, species: DataFrame) -> DataFrame:
    """(tree_id, u, parent, lo, hi, n, down, down_depth, up, up_depth) of binary gene trees: images of the leaves below each node, and of all others."""
    rows = newick.listed(nodes, leaves, ["tree_id"])
    each = rows.select("tree_id", "pos", F.inline("nodes")).withColumn("n", F.size("pos"))
    part = lambda start, size: F.slice("pos", start, size)
    inside, before, after = part(F.col("lo") + 1, F.col("hi") - F.col("lo") + 1), part(F.lit(1), F.col("lo")), part(F.col("hi") + 2, F.greatest(F.lit(0), F.col("n") - F.col("hi") - 1))
    ends = {"first": F.array_min(inside), "last": F.array_max(inside), "out_first": F.least(F.array_min(before), F.array_min(after)), "out_last": F.greatest(F.array_max(before), F.array_max(after))}
    each = each.select("tree_id", "u", "parent", "lo", "hi", "n", *[v.alias(k) for k, v in ends.items()])
    lowest = newick.lowest_common(species)
    down = lowest.select("first", "last", F.col("image").alias("down"), F.col("image_depth").alias("down_depth"))
    up = lowest.select(F.col("first").alias("out_first"), F.col("last").alias("out_last"), F.col("image").alias("up"), F.col("image_depth").alias("up_depth"))
    return each.join(down, ["first", "last"]).join(up, ["out_first", "out_last"], "left").drop("first", "last", "out_first", "out_last")


def local(image, depth, children: list[tuple]) -> tuple:
    """(dup, loss) of a node with an image, its depth, and its children's."""
    dup = F.greatest(*[(c == image).cast("int") for c, _ in children])
    return dup, sum((F.greatest(F.lit(0), d - depth - 1 + dup) for _, d in children), F.lit(0))


def rootings(nodes: DataFrame, leaves: DataFrame, species: DataFrame) -> DataFrame:
    """(tree_id, u, n_dups, n_losses, score) for a root on the edge above each node u; the edges above the old root's children are one rooting.

    nodes has (tree_id, u, parent, lo, hi) and leaves (tree_id, leaf, pos) of binary gene trees, species (node_id, parent_id, lo,
    hi, depth). A tree of one leaf has none.
    """
    each = stored(images(nodes, leaves, species))
    # A node's parent, sister and the parent's other side, all from the rows of one parent: a window, not joins.
    beside = Window.partitionBy("tree_id", "parent").orderBy("lo")
    sister = lambda c: F.coalesce(F.lag(c).over(beside), F.lead(c).over(beside))
    kin = each.filter("parent IS NOT NULL").select("*", sister("down").alias("s"), sister("down_depth").alias("s_depth"))
    # Children's images at their parent, and the parent's other side at its children.
    kids = kin.groupBy("tree_id", F.col("parent").alias("u")).agg(F.min(F.struct("lo", "down", "down_depth")).alias("a"), F.max(F.struct("lo", "down", "down_depth")).alias("b"))
    above = each.select("tree_id", F.col("u").alias("parent"), F.col("parent").isNull().alias("top"), F.col("up").alias("p"), F.col("up_depth").alias("p_depth"), F.col("down").alias("whole"), F.col("down_depth").alias("whole_depth"))
    full = kin.join(above, ["tree_id", "parent"]).join(kids, ["tree_id", "u"], "left")
    col = F.col
    d_dup, d_loss = local(col("down"), col("down_depth"), [(col("a.down"), col("a.down_depth")), (col("b.down"), col("b.down_depth"))])
    u_dup, u_loss = local(col("up"), col("up_depth"), [(col("p"), col("p_depth")), (col("s"), col("s_depth"))])
    # The old root's image is that of all leaves, whatever the rooting.
    tree = each.filter("parent IS NULL").select("tree_id", F.col("down").alias("all"), F.col("down_depth").alias("all_depth"))
    full = full.join(tree, "tree_id")
    r_dup, r_loss = local(col("all"), col("all_depth"), [(col("down"), col("down_depth")), (col("up"), col("up_depth"))])
    inner, lower = F.col("lo") < F.col("hi"), ~F.col("top")
    costs = full.select(
        "tree_id", "u", "lo", "hi", "all_depth",
        *[F.when(inner, x).otherwise(0).alias(c) for c, x in (("d_dup", d_dup), ("d_loss", d_loss))],
        *[F.when(lower, x).otherwise(0).alias(c) for c, x in (("u_dup", u_dup), ("u_loss", u_loss))],
        r_dup.alias("r_dup"), r_loss.alias("r_loss"),
    )
    # What a node on the way changes holds for all below it: it begins after the node, or with it, and ends with its last leaf.
    changes = lambda kind: (F.col(f"u_{kind}") - F.col(f"d_{kind}")).alias(kind)
    begin = costs.select("tree_id", F.col("lo").alias("at"), (-F.col("hi")).alias("z"), F.lit(0).alias("step"), "u", "d_dup", "d_loss", "all_depth", "r_dup", "r_loss", changes("dup"), changes("loss"))
    none = [F.lit(None).cast("long").alias("u"), *[F.lit(None).cast("int").alias(c) for c in ("d_dup", "d_loss", "all_depth", "r_dup", "r_loss")]]
    end = costs.select("tree_id", (F.col("hi") + 1).alias("at"), F.lit(-(1 << 30)).alias("z"), F.lit(-1).alias("step"), *none, *[(-F.col(f"u_{k}") + F.col(f"d_{k}")).alias(k) for k in ("dup", "loss")])
    along = Window.partitionBy("tree_id").orderBy("at", "z", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ways = begin.unionByName(end).select("*", *[F.sum(k).over(along).alias(f"way_{k}") for k in ("dup", "loss")], *[F.sum(f"d_{k}").over(Window.partitionBy("tree_id")).alias(f"all_{k}") for k in ("dup", "loss")])
    # The way holds u itself as one whose child it is not: its own leaves stay below it.
    sums = {k: F.col(f"all_{k}") + F.col(f"way_{k}") + F.col(f"d_{k}") + F.col(f"r_{k}") for k in ("dup", "loss")}
    found = ways.filter("step = 0").select("tree_id", "u", sums["dup"].cast("long").alias("n_dups"), (sums["loss"] + F.col("all_depth")).cast("long").alias("n_losses"))
    return found.withColumn("score", F.col("n_dups") + F.col("n_losses"))


def best(found: DataFrame) -> DataFrame:
    """(tree_id, u, score, n_rootings, worst) of rootings(): each tree's cheapest, the first node of equal ones."""
    return found.groupBy("tree_id").agg(F.min(F.struct("score", "u")).alias("b"), F.count("*").alias("n_rootings"), F.max("score").alias("worst")).select("tree_id", "b.u", "b.score", "n_rootings", "worst")


def rerooted(trees: DataFrame, key: list[str]) -> DataFrame:
    """(*key, pos, nodes) of binary trees (*key, pos, nodes, at) with their root on the edge above the node whose u is `at`; nodes have (lo, hi).

    Leaves of that node come first, then those beside it, then those beside its parent and so on, so that all that lies below a
    node is a run again. A tree whose `at` is its root, or null, or that has no such node, only keeps its nodes' spans.
    """
    here = F.get(F.filter("nodes", lambda x: x["u"] == F.col("at")), F.lit(0))
    rows = trees.withColumn("x", here).withColumn("way", F.filter("nodes", lambda x: (x["lo"] <= F.col("x.lo")) & (F.col("x.hi") <= x["hi"])))
    rows = rows.withColumn("way", F.coalesce("way", F.array().cast(trees.schema["nodes"].dataType)))
    # Nodes of the way, the outermost first: the more of them hold a leaf, the nearer it comes to the front.
    near = F.transform("pos", lambda p, i: F.struct((-F.size(F.filter("way", lambda w: (w["lo"] <= i) & (i <= w["hi"])))).alias("k"), i.alias("i"), p.alias("p")))
    rows = rows.withColumn("order", F.array_sort(near)).withColumn("place", F.transform("order", lambda o: o["i"]))
    span = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    moved = F.transform(F.filter("nodes", lambda n: ~((n["lo"] <= F.col("x.lo")) & (F.col("x.hi") <= n["hi"]) & (n["u"] != F.col("at")))), lambda n: span(F.array_position("place", n["lo"]) - 1, F.array_position("place", n["lo"]) - 1 + n["hi"] - n["lo"]))
    n = F.size("pos")
    # What is all but a node of the way; that of a child of the old root is the other child.
    rest = F.transform(F.slice("way", F.lit(3), F.greatest(F.lit(0), F.size("way") - 2)), lambda w: span(w["hi"] - w["lo"] + 1, n - 1))
    whole = F.transform("nodes", lambda x: span(x["lo"], x["hi"]))
    made = F.when(F.size("way") < 2, whole).otherwise(F.concat(F.array(span(F.lit(0), n - 1)), moved, rest))
    return rows.select(*key, F.transform("order", lambda o: o["p"]).alias("pos"), F.array_sort(made).alias("nodes"))
