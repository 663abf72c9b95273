"""All copied-clade candidates of a species tree scored over gene trees at once.

A candidate (h, t) is the species tree with a copy of clade h joined above t. The gene leaves of a donor clade h fall into
units that take the original or the copy together; a tree costs what its best choice for all units costs. No candidate tree is
ever built: for a choice the cost under every target comes from running sums over the species tree (functions/costs.py). Units,
pins and caps are joins and windows; each gene tree is one row from then on, tasks add up what their trees cost, and one small
sum over donors and targets remains.

Trees come as tables. species: (family, node, parent, lo, hi, depth), nodes by the first and last leaf below, leaves numbered
from left to right from 0. genes: (family, gt, u, parent, lo, hi) likewise, and leaves: (family, gt, leaf, pos), pos being the
species leaf. All inner nodes have two children. A species tree must fit into a row; gene trees and families are any number, and
each family's gene trees meet its own species tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import costs
from ..functions.storage import stored
from ..sources import newick

KEY = ["family", "gt"]
#: Nodes of all species trees up to this many are broadcast, some 50 bytes each; more are joined by a shuffle.
BROADCAST_NODES = 1_000_000
#: Power of two above which the choices of one tree and donor are an error.
MOST_WORK = 24
#: Gene trees that a task holds as Python objects at once.
TREES = 1000
#: Which clades of donor leaves move as one: any whose leaves are all of different species; any whose children's species differ
#: at its root; any at all; none but single leaves, which gives the least cost over every leaf's own choice.
RULES = ("strict", "engine", "maximal", "exact")


def small(table: DataFrame, rows: DataFrame, most: int = BROADCAST_NODES) -> DataFrame:
    """table, broadcast if rows, which it grows with, has at most so many."""
    return F.broadcast(table) if rows.count() <= most else table


def ordered(species: DataFrame) -> DataFrame:
    """species with place, each node's number in preorder from 0, and ord, its number among leaves and then inner nodes from below, from 1."""
    along = Window.partitionBy("family")
    order = along.orderBy(F.col("lo") != F.col("hi"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("hi")), F.desc("lo"))
    return species.withColumn("place", F.row_number().over(along.orderBy("lo", F.desc("hi"))) - 1).withColumn("ord", F.row_number().over(order))


def resolve(species: DataFrame, wanted: DataFrame) -> DataFrame:
    """(family, node, text) of clades (family, text) named by a node's number in angle brackets, a species, or several with commas between: the lowest node above them.

    species needs a column species. A name that the tree lacks is an error. What several texts name comes once for each.
    """
    parts = wanted.select("family", "text", F.explode(F.split("text", r"\s*,\s*")).alias("part")).withColumn("part", F.trim("part"))
    number = F.expr("try_cast(regexp_extract(part, '^<([0-9]+)>$', 1) AS int)")
    named = species.select("family", F.col("species").alias("name"), "node", "lo", "hi", "depth")
    same = (F.col("p.family") == F.col("n.family")) & ((F.col("n.name") == F.col("p.part")) | (F.col("n.node") == F.col("p.number")))
    met = parts.withColumn("number", number).alias("p").join(small(named, species).alias("n"), same, "left")
    lost = F.raise_error(F.concat(F.lit("no such clade: "), F.col("part"))).cast("int")
    ends = met.select("p.family", "text", F.coalesce("lo", lost).alias("first"), F.coalesce("hi", lost).alias("last")).groupBy("family", "text").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    above = ends.join(small(named, species), "family").filter("lo <= first AND last <= hi")
    return above.groupBy("family", "text").agg(F.max(F.struct("depth", "node"))["node"].alias("node")).select("family", "node", "text")


def candidates(species: DataFrame, redundant: bool = False, donors: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(family, mt_id, h, t): no target strictly below its donor and, unless asked for, none beside it; leaves come first, then inner nodes from below.

    donors and targets (family, node) restrict either side; numbers are of what is left.
    """
    nodes = ordered(species)
    h = nodes.select("family", F.col("node").alias("h"), F.col("ord").alias("h_ord"), F.col("lo").alias("hlo"), F.col("hi").alias("hhi"), F.col("parent").alias("h_up"))
    t = nodes.select("family", F.col("node").alias("t"), F.col("ord").alias("t_ord"), F.col("lo").alias("tlo"), F.col("hi").alias("thi"), F.col("parent").alias("t_up"))
    same = F.col("h") == F.col("t")
    legal = same | ~((F.col("hlo") <= F.col("tlo")) & (F.col("thi") <= F.col("hhi")))
    if not redundant:
        legal = legal & (same | ~F.coalesce(F.col("h_up") == F.col("t_up"), F.lit(False)))
    if donors is not None:
        h = h.join(donors.select("family", F.col("node").alias("h")), ["family", "h"], "left_semi")
    if targets is not None:
        t = t.join(targets.select("family", F.col("node").alias("t")), ["family", "t"], "left_semi")
    return h.join(t, "family").filter(legal).select("family", F.row_number().over(Window.partitionBy("family").orderBy("h_ord", "t_ord")).cast("long").alias("mt_id"), "h", "t")


def units(trees: DataFrame, species: DataFrame, rule: str = "engine") -> DataFrame:
    """(family, gt, h, unit, lo, hi, u, parent) for each donor clade: its gene trees' units, numbered from 0, as runs of leaves under a node.

    trees is as newick.listed() gives it. Of the clades that a rule lets move as one the largest count.
    """
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    each = newick.spans(trees, KEY)
    size = F.col("hi") - F.col("lo") + 1
    if rule == "engine":
        # A node's row, and its number of species as a child of its parent, brought together by one grouping.
        own = F.struct("u", F.struct("parent", "lo", "hi", "first", "last", "kinds").alias("own"), F.lit(0).alias("apart"))
        kid = F.struct(F.col("parent").alias("u"), F.lit(None).cast("struct<parent:bigint,lo:int,hi:int,first:int,last:int,kinds:int>").alias("own"), F.col("kinds").alias("apart"))
        met = each.select(*KEY, F.inline(F.array(own, kid))).filter("u IS NOT NULL").groupBy(*KEY, "u").agg(F.max("own").alias("own"), F.sum("apart").alias("apart"))
        each = met.select(*KEY, "u", "own.*", "apart").filter((F.col("lo") == F.col("hi")) | (F.col("kinds") == F.col("apart")))
    elif rule == "strict":
        each = each.filter(F.col("kinds") == size)
    elif rule == "exact":
        each = each.filter("lo = hi")
    donors = species.select("family", F.col("node").alias("h"), F.col("lo").alias("hlo"), F.col("hi").alias("hhi"))
    inside = each.join(small(donors, species), "family").filter("first >= hlo AND last <= hhi")
    by = Window.partitionBy(*KEY, "h").orderBy("lo", F.desc("hi"))
    # Clades nest or lie apart: one that ends within what came before is inside it.
    largest = inside.withColumn("reached", F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))).filter("reached IS NULL OR hi > reached")
    return largest.withColumn("unit", F.row_number().over(by) - 1).select(*KEY, "h", "unit", "lo", "hi", "u", "parent")


def pins(trees: DataFrame, species: DataFrame, found: DataFrame) -> DataFrame:
    """(family, gt, h, unit, t, state) of units under each target of their donor: 0 if tied to the original, 1 to the copy, null if free.

    A unit's sister clade ties it: to the original if all its species lie in the donor's sister clade, unless the target is the
    donor or lies in that clade; else to the copy if the target holds them all and not the donor. The root has no sister.
    """
    each = newick.spans(trees, KEY).select(*KEY, "u", "parent", "first", "last")
    beside = found.join(each.withColumnRenamed("u", "v"), [*KEY, "parent"], "left").groupBy(*KEY, "h", "unit", "u").agg(F.min(F.when(F.col("v") != F.col("u"), F.col("first"))).alias("first"), F.max(F.when(F.col("v") != F.col("u"), F.col("last"))).alias("last"))
    node = species.select("family", F.col("node").alias("h"), "parent", F.col("lo").alias("hlo"), F.col("hi").alias("hhi"))
    sister = species.select("family", F.col("node").alias("s"), "parent", F.col("lo").alias("slo"), F.col("hi").alias("shi"))
    donors = node.join(sister, (node.family == sister.family) & (node.parent == sister.parent) & (node.h != sister.s), "left").select(node.family, "h", "hlo", "hhi", "slo", "shi")
    targets = candidates(species, True).join(species.select("family", F.col("node").alias("t"), F.col("lo").alias("tlo"), F.col("hi").alias("thi")), ["family", "t"])
    sites = stored(donors.join(targets, ["family", "h"]).drop("mt_id"))
    rows = beside.join(small(sites, sites), ["family", "h"])
    within = lambda a, b, c, d: (F.col(c) <= F.col(a)) & (F.col(b) <= F.col(d))
    original = within("first", "last", "slo", "shi") & (F.col("t") != F.col("h")) & ~within("tlo", "thi", "slo", "shi")
    copy = within("first", "last", "tlo", "thi") & ~within("hlo", "hhi", "tlo", "thi")
    return rows.select(*KEY, "h", "unit", "t", F.when(original, 0).when(copy, 1).alias("state"))


def work(pinned: DataFrame) -> DataFrame:
    """(family, gt, h, t, n_units, n_free): units of each tree under each candidate, and those that no sister ties; choices are 2 ** n_free."""
    return pinned.groupBy(*KEY, "h", "t").agg(F.count("*").alias("n_units"), F.count_if(F.col("state").isNull()).alias("n_free"))


_FOUND = "family long, h int, t int, cost double"


def _swept(w_dup: float, w_loss: float):
    """What a task's trees cost: by no place (h, t null), by target, and what a donor changes by target; h and t are places in preorder."""

    def run(batches):
        total: dict[tuple, np.ndarray] = {}

        def rows():
            family, h, t, cost = [], [], [], []
            for (f, kind), x in total.items():
                place = np.argwhere(x != 0) if kind == 2 else np.argwhere(np.ones_like(x))
                family += [f] * len(place)
                h += place[:, 0].tolist() if kind == 2 else [None] * len(place)
                t += place[:, -1].tolist() if kind else [None] * len(place)
                cost += x[tuple(place.T)].tolist()
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(family, pa.int64()), pa.array(h, pa.int32()), pa.array(t, pa.int32()), pa.array(cost, pa.float64())], names=["family", "h", "t", "cost"])

        known = (None, None)  # the last family's species tree
        for part in (batch.slice(at, TREES) for batch in batches for at in range(0, batch.num_rows, TREES)):
            held: dict[int, list] = {}
            for i, row in enumerate(part.drop_columns("species").to_pylist()):
                held.setdefault(row["family"], []).append(row | {"i": i})
            for family, trees in held.items():
                if known[0] != family:
                    nodes = part.column("species")[trees[0]["i"]].as_py()  # of one row, for it is the same in all
                    known = family, costs.Species([x["lo"] for x in nodes], [x["hi"] for x in nodes], [x["depth"] for x in nodes])
                s = known[1]
                listed = costs.Trees(s, [x["pos"] for x in trees], [[(n["lo"], n["hi"]) for n in x["nodes"]] for x in trees])
                unit = np.array([(i, u["h"], u["lo"], u["hi"]) for i, x in enumerate(trees) for u in x["units"] or []], np.int64).reshape(-1, 4)
                got = costs.sweep(s, listed, np.array([x["weight"] for x in trees], float), *unit.T, w_dup, w_loss)
                for kind, x in enumerate(got):
                    x = np.atleast_1d(x)
                    total[family, kind] = x if (family, kind) not in total else total[family, kind] + x
            if sum(x.size for x in total.values()) > 1_000_000:
                yield rows()
        yield rows()

    return run


def score_trees(trees: DataFrame, found: DataFrame, weights: DataFrame, species: DataFrame, w_dup: float = 1, w_loss: float = 1) -> DataFrame:
    """(family, h, t, cost) summed over trees: for null h and t against the species tree as it is, for null h by target, else what the donor changes."""
    nodes = ordered(species)
    places = nodes.select("family", F.col("node").alias("h"), F.col("place").alias("at"))
    whole = nodes.groupBy("family").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "lo", "hi", "depth"))), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["depth"].alias("depth"))).alias("species"))
    unit = F.transform(F.sort_array(F.collect_list(F.struct(F.col("at").alias("h"), "lo", "hi"))), lambda x: x).alias("units")
    by_tree = found.join(small(places, species), ["family", "h"]).groupBy(*KEY).agg(unit)
    rows = trees.join(weights, KEY).join(by_tree, KEY, "left").join(small(whole, species), "family")
    swept = rows.select("family", "weight", "pos", F.transform("nodes", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))).alias("nodes"), "units", "species").mapInArrow(_swept(w_dup, w_loss), _FOUND)
    summed = swept.groupBy("family", "h", "t").agg(F.sum("cost").alias("cost"))
    node = lambda c: places.select("family", F.col("at").alias(c), F.col("h").alias(f"{c}_node"))
    return summed.join(node("h"), ["family", "h"], "left").join(node("t"), ["family", "t"], "left").select("family", F.col("h_node").alias("h"), F.col("t_node").alias("t"), "cost")


def score_candidates(genes: DataFrame, leaves: DataFrame, weights: DataFrame, species: DataFrame, most_units: int = 15, w_dup: float = 1, w_loss: float = 1, rule: str = "engine", redundant: bool = False, donors: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(family, mt_id, h, t, score, n_trees, n_skipped) over gene trees weighted by (family, gt, weight); mt_id 0 is the species tree as it is.

    A tree with over most_units units for any donor clade is left out for all candidates and counted in n_skipped: all its units
    are free where donor and target are one, so that is the most that any candidate leaves free. If all trees of a family are
    left out, its rows stay, without a score. donors and targets (family, node) restrict the candidates, and the units that count
    against the limit. Work beyond 2 ** MOST_WORK for one tree and donor is an error.
    """
    if most_units > MOST_WORK:
        raise ValueError(f"choices of over {MOST_WORK} units are too many")
    species = stored(species)
    trees = stored(newick.listed(genes, leaves, KEY).join(weights.select(KEY), KEY, "left_semi"))
    found = units(trees, species, rule)
    if donors is not None:
        found = found.join(donors.select("family", F.col("node").alias("h")), ["family", "h"], "left_semi")
    found = stored(found)
    over = found.groupBy(*KEY, "h").agg(F.count("*").alias("k")).filter(F.col("k") > most_units).select(*KEY).distinct()
    kept = stored(trees.join(over, KEY, "left_anti"))
    sums = stored(score_trees(kept, found.join(kept.select(KEY), KEY, "left_semi"), weights, species, w_dup, w_loss))
    plain = sums.filter("t IS NULL").select("family", F.col("cost").alias("plain"))
    by_target = sums.filter("h IS NULL AND t IS NOT NULL").select("family", "t", F.col("cost").alias("by_target"))
    differs = sums.filter("h IS NOT NULL").select("family", "h", "t", F.col("cost").alias("differs"))
    wanted = candidates(species, redundant, donors, targets)
    swept = wanted.join(by_target, ["family", "t"], "left").join(differs, ["family", "h", "t"], "left")
    swept = swept.select("family", "mt_id", "h", "t", (F.col("by_target") + F.coalesce("differs", F.lit(0.0))).alias("score"))
    base = species.select("family").distinct().join(plain, "family", "left").select("family", F.lit(0).cast("long").alias("mt_id"), F.lit(None).cast("int").alias("h"), F.lit(None).cast("int").alias("t"), F.col("plain").alias("score"))
    left = kept.select(*KEY, F.lit(True).alias("kept"))
    counts = weights.join(left, KEY, "left").groupBy("family").agg(F.sum(F.when(F.col("kept"), F.col("weight")).otherwise(0)).alias("n_trees"), F.sum(F.when(F.col("kept"), 0).otherwise(F.col("weight"))).alias("n_skipped"))
    return swept.unionByName(base).join(counts, "family")


def species_nodes(species: DataFrame) -> DataFrame:
    """Node table (family, node, parent, lo, hi, depth, species) of species trees (family, newick); one that is no binary tree, or names a species twice, is an error."""
    parsed = stored(newick.parse(species.select(F.col("family").alias("tree_id"), "newick")))
    bad = newick.rejects(species.select(F.col("family").alias("tree_id"), "newick"), parsed).select("tree_id", F.lit("no tree").alias("reason"))
    bad = bad.unionByName(newick.unresolved(parsed)).unionByName(parsed.filter("is_leaf").groupBy("tree_id", "species").count().filter("count > 1").select("tree_id", F.lit("a species twice").alias("reason")))
    worst = bad.orderBy("tree_id", "reason").first()
    if worst:
        raise ValueError(f"species tree {worst['tree_id']}: {worst['reason']}")
    return parsed.select(F.col("tree_id").alias("family"), F.col("node_id").alias("node"), F.col("parent_id").alias("parent"), "lo", "hi", "depth", "species")


def gene_tables(weighted: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(genes, leaves, weights, rejected) of gene trees (family, newick, weight): equal strings of a family count once.

    rejected has (family, newick, weight, reason): no tree, unrooted, polytomy or unary. A gene of a species that its family's
    tree lacks is an error.
    """
    counted = stored(weighted.groupBy("family", "newick").agg(F.sum("weight").alias("weight")).withColumn("gt", F.monotonically_increasing_id()))
    parsed = stored(newick.parse(counted.select(F.col("gt").alias("tree_id"), "newick")))
    bad = newick.rejects(counted.select(F.col("gt").alias("tree_id")), parsed).select("tree_id", F.lit("no tree").alias("reason")).unionByName(newick.unresolved(parsed))
    bad = stored(bad.withColumnRenamed("tree_id", "gt"))
    rejected = counted.join(bad, "gt").select("family", "newick", "weight", "reason")
    whole = stored(counted.join(bad, "gt", "left_anti").select(*KEY, "weight"))
    parsed = stored(parsed.withColumnRenamed("tree_id", "gt").join(whole.select(KEY), "gt"))
    tips = nodes.filter("lo = hi").select("family", "species", F.col("lo").alias("pos"))
    lost = F.raise_error(F.concat(F.lit("no such species: "), F.coalesce("species", F.lit("null")))).cast("int")
    leaves = parsed.filter("is_leaf").select(*KEY, F.col("lo").alias("leaf"), "species").join(small(tips, nodes), ["family", "species"], "left")
    leaves = stored(leaves.select(*KEY, "leaf", F.coalesce("pos", lost).alias("pos")))
    return parsed.select(*KEY, F.col("node_id").alias("u"), F.col("parent_id").alias("parent"), "lo", "hi"), leaves, whole, rejected


def score_newicks(weighted: DataFrame, species: DataFrame, most_units: int = 15, w_dup: float = 1, w_loss: float = 1, rule: str = "engine") -> DataFrame:
    """score_candidates for gene trees (family, newick, weight) and species trees (family, newick); h and t are preorder numbers.

    Gene trees that are not binary are an error here; gene_tables() tells them apart.
    """
    nodes = stored(species_nodes(species))
    genes, leaves, weights, rejected = gene_tables(weighted, nodes)
    bad = rejected.filter("reason <> 'no tree'").orderBy("newick").first()
    if bad:
        raise ValueError(f"{bad['reason']}: {bad['newick']}")
    return score_candidates(genes, leaves, weights, nodes.drop("species"), most_units, w_dup, w_loss, rule)
