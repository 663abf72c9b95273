"""Trees cut, joined and taken apart as tables: a binary tree is the set of its nodes' first and last leaves.

In preorder a node's left child follows it, and its right child covers the leaves after that; so parents come from one window,
and what is left of a tree when leaves go is a filter on how many leaves each node keeps.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import folds


def _preorder(key: list[str]):
    return Window.partitionBy(*key).orderBy("lo", F.desc("hi"))


def encode(spans: DataFrame, key: list[str]) -> DataFrame:
    """(*key, u, parent, lo, hi) of binary trees given by their nodes' spans (*key, lo, hi); u is 100,000 lo + hi."""
    code = lambda lo, hi: (F.lit(100_000).cast("long") * lo + hi).cast("long")
    along = _preorder(key)
    seen = spans.select(*key, F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))
    seen = seen.withColumn("left", F.when(F.col("lo") < F.col("hi"), F.lead("hi").over(along))).withColumn("n", F.row_number().over(along))
    me = code(F.col("lo"), F.col("hi"))
    child = lambda lo, hi: F.struct(code(lo, hi).alias("u"), me.alias("parent"), lo.alias("lo"), hi.alias("hi"))
    kids = F.array(child(F.col("lo"), F.col("left")), child((F.col("left") + 1).cast("int"), F.col("hi")))
    below = seen.filter("lo < hi").select(*key, F.inline(kids))
    return below.unionByName(seen.filter("n = 1").select(*key, me.alias("u"), F.lit(None).cast("long").alias("parent"), "lo", "hi"))


def pruned(trees: DataFrame, key: list[str]) -> DataFrame:
    """(*key, lo, hi) of what is left of trees (*key, keep, nodes) once leaves whose keep is false go: nodes with one child left go too, and leaves are numbered anew.

    keep has a flag for each leaf in order, nodes (lo, hi, ...) in preorder. A tree without a kept leaf has no rows.
    """
    each = trees.select(*key, "keep", F.inline("nodes")).select(*key, "lo", "hi", "keep")
    count = lambda start, size: F.size(F.filter(F.slice("keep", start, size), lambda x: x))
    each = each.select(*key, "lo", "hi", count(F.lit(1), F.col("lo")).alias("before"), count(F.col("lo") + 1, F.col("hi") - F.col("lo") + 1).alias("held"))
    each = each.withColumn("left", F.lead("held").over(_preorder(key)))
    stays = F.when(F.col("lo") == F.col("hi"), F.col("held") == 1).otherwise((F.col("left") > 0) & (F.col("left") < F.col("held")))
    return each.filter(stays).select(*key, F.col("before").alias("lo"), (F.col("before") + F.col("held") - 1).alias("hi"))


def maximal_clades(trees: DataFrame, key: list[str]) -> DataFrame:
    """(*key, lo, hi, label): the largest clades all of whose leaves have one label; labels (*key, labels, nodes) has null for none."""
    each = trees.select(*key, "labels", F.inline("nodes")).withColumn("held", F.slice("labels", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1))
    pure = each.filter(~F.exists("held", lambda x: x.isNull()) & (F.array_min("held") == F.array_max("held"))).select(*key, "lo", "hi", F.array_min("held").alias("label"))
    reached = F.max("hi").over(_preorder(key).rowsBetween(Window.unboundedPreceding, -1))
    return pure.withColumn("reached", reached).filter("reached IS NULL OR hi > reached").drop("reached")


def partition(trees: DataFrame, key: list[str], least_leaves: int = 1) -> tuple[DataFrame, DataFrame]:
    """(inner, outer) of gene trees (*key, pos, labels, nodes) whose leaves are labelled with the copy that they lie on.

    inner has (*key, part, label, first, pos, nodes) of each largest clade of one label, part numbering a tree's clades from
    0 by first leaf; outer (*key, pos, nodes) of what is left, with those joined that their parents leave alone. Trees of under
    least_leaves leaves are left out on either side unless all on that side are: small ones are better than none.
    """
    found = maximal_clades(trees.select(*key, "labels", "nodes"), key)
    numbered = found.withColumn("part", F.row_number().over(_preorder(key)) - 1)
    runs = numbered.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "label", "part"))).alias("runs"))
    rows = trees.select(*key, "pos", "nodes").join(runs, key, "left").withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<lo:int,hi:int,label:int,part:int>>")))
    moved = lambda by: F.transform(F.filter("nodes", lambda x: (x["lo"] >= F.col("lo")) & (x["hi"] <= F.col("hi"))), lambda x: F.struct((x["lo"] - by).alias("lo"), (x["hi"] - by).alias("hi")))
    inner = rows.select(*key, "pos", "nodes", F.inline("runs")).select(*key, "part", "label", F.col("lo").alias("first"), F.slice("pos", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1).alias("pos"), moved(F.col("lo")).alias("nodes"))
    keep = F.transform("pos", lambda x, i: ~F.exists("runs", lambda r: (r["lo"] <= i) & (i <= r["hi"])))
    left = rows.withColumn("keep", keep)
    kept = left.select(*key, F.transform(F.filter(F.arrays_zip("pos", "keep"), lambda x: x["keep"]), lambda x: x["pos"]).alias("pos")).filter(F.size("pos") > 0)
    spans = pruned(left.select(*key, "keep", "nodes"), key).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("lo", (-F.col("hi")).alias("z")))).alias("s"))
    outer = kept.join(spans, key).select(*key, "pos", F.transform("s", lambda x: F.struct(x["lo"].alias("lo"), (-x["z"]).alias("hi"))).alias("nodes"))

    def large(side: DataFrame) -> DataFrame:
        sizes = side.withColumn("enough", F.size("pos") >= least_leaves)
        any_enough = sizes.agg(F.coalesce(F.max("enough"), F.lit(False)).alias("some"))  # one row
        return sizes.crossJoin(F.broadcast(any_enough)).filter("enough OR NOT some").drop("enough", "some")

    return (inner, outer) if least_leaves <= 1 else (large(inner), large(outer))


def graft(species: DataFrame, events: DataFrame, mark: str) -> DataFrame:
    """species (family, node, parent, lo, hi, depth, species) with a copy of clade h joined above t, for events (family, h, t); other families stay as they are.

    The copy's leaves come after the target's. A new node holds both; copied nodes' numbers go on from the largest, and copied
    species' names end with mark.
    """
    at = lambda c: species.select("family", F.col("node").alias(c), F.col("lo").alias(f"{c}_lo"), F.col("hi").alias(f"{c}_hi"), F.col("depth").alias(f"{c}_depth"), F.col("parent").alias(f"{c}_parent"))
    ends = species.groupBy("family").agg(F.max("node").alias("top"), F.max("hi").alias("last"))
    sites = events.select("family", "h", "t").join(at("h"), ["family", "h"]).join(at("t"), ["family", "t"]).join(ends, "family").withColumn("m", F.col("h_hi") - F.col("h_lo") + 1)
    rows = species.join(sites, "family", "left")
    some = F.col("h").isNotNull()
    after = some & (F.col("lo") > F.col("t_hi"))
    within = some & (F.col("t_lo") <= F.col("lo")) & (F.col("hi") <= F.col("t_hi"))
    over = some & (F.col("lo") <= F.col("t_lo")) & (F.col("t_hi") <= F.col("hi")) & (F.col("node") != F.col("t"))
    shift = lambda cond: F.when(cond, F.col("m")).otherwise(0)
    joint = (F.col("top") + 1).cast("int")
    old = rows.select(
        "family",
        "node",
        F.when(some & (F.col("node") == F.col("t")), joint).otherwise(F.col("parent")).alias("parent"),
        (F.col("lo") + shift(after)).cast("int").alias("lo"),
        (F.col("hi") + shift(after | over)).cast("int").alias("hi"),
        (F.col("depth") + F.when(within, 1).otherwise(0)).cast("int").alias("depth"),
        "species",
    )
    new = sites.select("family", joint.alias("node"), F.col("t_parent").alias("parent"), F.col("t_lo").alias("lo"), (F.col("t_hi") + F.col("m")).cast("int").alias("hi"), F.col("t_depth").alias("depth"), F.lit(None).cast("string").alias("species"))
    moved = (F.col("t_hi") + 1 - F.col("h_lo")).cast("int")
    number = lambda c: (F.col(c) + joint + 1).cast("int")
    copies = rows.filter(some & (F.col("h_lo") <= F.col("lo")) & (F.col("hi") <= F.col("h_hi"))).select(
        "family",
        number("node").alias("node"),
        F.when(F.col("node") == F.col("h"), joint).otherwise(number("parent")).alias("parent"),
        (F.col("lo") + moved).cast("int").alias("lo"),
        (F.col("hi") + moved).cast("int").alias("hi"),
        (F.col("depth") - F.col("h_depth") + F.col("t_depth") + 1).cast("int").alias("depth"),
        F.concat("species", F.lit(mark)).alias("species"),
    )
    return old.unionByName(new).unionByName(copies)


def clades(trees: DataFrame, key: list[str]) -> DataFrame:
    """(*key, clade) of trees (*key, names, nodes): the names below each inner node, sorted."""
    each = trees.select(*key, "names", F.inline("nodes")).filter("lo < hi")
    return each.select(*key, F.array_sort(F.slice("names", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1)).alias("clade")).distinct()


def contained(trees: DataFrame, target: DataFrame, key: list[str], shape=None) -> DataFrame:
    """(*key, n_taxa, distance, contained): whether trees (*key, names, nodes) are the target tree (names, nodes), cut down to their names.

    distance is the number of clades that only one of them has. A tree with a name twice, or one that the target lacks, is not contained
    and has no distance. Trees without nodes are of the shape that shape(n leaves) has the spans of. Each is told in its row.
    """
    ends = [F.expr(f"transform(nodes, x -> int(x.{c})) AS _{c}") for c in ("lo", "hi")]
    whole = target.select(F.col("names").alias("_all"), *ends)
    both = trees.select(*key, "names", *([F.transform("nodes", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))).alias("nodes")] if shape is None else [])).crossJoin(F.broadcast(whole))  # one row
    schema = StructType([trees.schema[c] for c in key]).add("n_taxa", "long").add("distance", "long").add("contained", "boolean")

    def run(batches):
        bit = inner = None
        for batch in batches:
            if bit is None and batch.num_rows:
                bit, inner = folds.clade_bits(batch.column("_all")[0].as_py(), zip(*(batch.column(c)[0].as_py() for c in ("_lo", "_hi"))))  # the same in all rows
            names = batch.column("names").to_pylist()
            spans = ([(x["lo"], x["hi"]) for x in t] for t in batch.column("nodes").to_pylist()) if shape is None else (shape(len(x)) for x in names)
            found = [folds.clade_distance(x, s, bit, inner) for x, s in zip(names, spans)]
            made = [pa.array([len(x) for x in names], pa.int64()), pa.array(found, pa.int64()), pa.array([d == 0 for d in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in key], *made], names=[*key, "n_taxa", "distance", "contained"])

    return both.mapInArrow(run, schema)
