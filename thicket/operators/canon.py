"""Canonical forms of trees of any shape, each made in one fold over a tree's nodes: two trees are equal up to the order of children if their digests are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folded(trees: DataFrame, key: list[str]) -> DataFrame:
    """(*key, signature, leaf_order, digests) of trees (*key, names, nodes).

    names has the leaves' names in order; nodes (lo, hi, u, parent) are in preorder. A leaf's digest is of its name, a node's of
    its children's in order. leaf_order lists the leaves' numbers with the children of each node in order of their digests, so
    that equal trees' leaves correspond place by place. digests has (u, digest, n_leaves) of every node. Read from behind, nodes
    come after all below them; what is done but has no parent yet lies on a stack.
    """
    done = "array<struct<digest:string,leaves:array<int>,lo:int>>"
    out = "array<struct<u:bigint,digest:string,n_leaves:int>>"
    leaf = "struct(sha2(concat('leaf ', coalesce(get(names, x.lo), '')), 256) AS digest, array(x.lo) AS leaves, x.lo AS lo)"
    below = "filter(acc.stack, s -> s.lo <= x.hi)"  # nodes read before lie to the right of x or below it
    sorted_below = f"array_sort({below}, (a, b) -> CASE WHEN a.digest < b.digest THEN -1 WHEN a.digest > b.digest THEN 1 WHEN a.lo < b.lo THEN -1 ELSE 1 END)"
    inner = f"struct(sha2(array_join(transform({sorted_below}, s -> s.digest), ','), 256) AS digest, flatten(transform({sorted_below}, s -> s.leaves)) AS leaves, x.lo AS lo)"
    made = f"CASE WHEN x.lo = x.hi THEN {leaf} ELSE {inner} END"
    # Named once by a fold over one element, so that a node's digest is made once.
    step = f"aggregate(array({made}), acc, (a, y) -> named_struct('stack', concat(array(y), filter(a.stack, s -> s.lo > x.hi)), 'out', concat(a.out, array(named_struct('u', x.u, 'digest', y.digest, 'n_leaves', x.hi - x.lo + 1)))))"
    start = f"named_struct('stack', cast(array() AS {done}), 'out', cast(array() AS {out}))"
    rows = trees.withColumn("_f", F.expr(f"aggregate(reverse(nodes), {start}, (acc, x) -> {step})"))
    top = F.element_at("_f.stack", 1)
    return rows.select(*key, top["digest"].alias("signature"), top["leaves"].alias("leaf_order"), F.col("_f.out").alias("digests"))


def classes(signed: DataFrame, tree: str, weight: str | None = None) -> DataFrame:
    """(signature, rep, n_trees, weight): a row for each class of equal trees; weight adds up the members' weights, 1 each if none are given."""
    w = F.lit(1) if weight is None else F.col(weight)
    return signed.groupBy("signature").agg(F.min(tree).alias("rep"), F.count("*").alias("n_trees"), F.sum(w).alias("weight"))


def corresponding(signed: DataFrame, tree: str, pairs: DataFrame) -> DataFrame:
    """(tree, leaf, rep, rep_leaf): each leaf's counterpart in the tree that stands for its class; pairs has (tree, rep) of equal trees."""
    each = signed.select(F.col(tree).alias("tree"), F.posexplode("leaf_order").alias("k", "leaf"))
    other = each.select(F.col("tree").alias("rep"), "k", F.col("leaf").alias("rep_leaf"))
    return pairs.join(each, "tree").join(other, ["rep", "k"]).select("tree", "leaf", "rep", "rep_leaf")
