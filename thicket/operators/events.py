"""Searches for several events: the maps of a winner, and rounds that go on from the tree that won."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import costs
from ..functions.storage import stored
from ..sources import newick
from . import surgery, sweep

KEY = sweep.KEY


def winners(scores: DataFrame) -> DataFrame:
    """(family, mt_id, h, t, score, before, passed): each family's best candidate by (score, mt_id), and whether it beats the tree without a copy."""
    before = scores.filter("mt_id = 0").select("family", F.col("score").alias("before"))
    first = F.row_number().over(Window.partitionBy("family").orderBy("score", "mt_id"))
    best = scores.filter("mt_id > 0 AND score IS NOT NULL").withColumn("n", first).filter("n = 1")
    return best.join(before, "family").select("family", "mt_id", "h", "t", "score", "before", (F.col("score") < F.col("before")).alias("passed"))


def winning_copies(trees: DataFrame, found: DataFrame, won: DataFrame, species: DataFrame, w_dup: float = 1, w_loss: float = 1) -> DataFrame:
    """(family, gt, cost, copies) of each gene tree under its family's winner (family, h, t): copies has for each leaf 0 for the original, 1 for the copy, null outside the donor.

    Of the cheapest choices the first counts, the original coming before the copy, units from left to right.
    """
    nodes = sweep.ordered(species)
    whole = nodes.groupBy("family").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "lo", "hi", "depth"))), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["depth"].alias("depth"))).alias("species"))
    place = lambda c: nodes.select("family", F.col("node").alias(c), F.col("place").alias(f"{c}_at"))
    sites = won.select("family", "h", "t").join(place("h"), ["family", "h"]).join(place("t"), ["family", "t"]).join(whole, "family")
    of_winner = found.join(sweep.small(won.select("family", "h"), species), ["family", "h"])
    runs = of_winner.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("units"))
    rows = trees.join(sweep.small(sites, species), "family").join(runs, KEY, "left")

    def run(batches):
        for batch in batches:
            out = {"family": [], "gt": [], "cost": [], "copies": []}
            for row in batch.to_pylist():
                s = costs.Species(*[[x[c] for x in row["species"]] for c in ("lo", "hi", "depth")])
                tree = costs.Trees(s, [row["pos"]], [[(n["lo"], n["hi"]) for n in row["nodes"]]])
                units = row["units"] or []
                cost, taken = costs.best_choice(s, tree, 0, row["h_at"], row["t_at"], [u["lo"] for u in units], [u["hi"] for u in units], w_dup, w_loss)
                copies: list[int | None] = [None] * len(row["pos"])
                for u, copy in zip(units, taken):
                    copies[u["lo"] : u["hi"] + 1] = [copy] * (u["hi"] - u["lo"] + 1)
                for name, value in zip(out, (row["family"], row["gt"], cost, copies)):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["family"], pa.int64()), pa.array(out["gt"], pa.int64()), pa.array(out["cost"], pa.float64()), pa.array(out["copies"], pa.list_(pa.int32()))], names=list(out))

    return rows.select("family", "gt", "pos", "nodes", "species", "units", "h_at", "t_at").mapInArrow(run, "family long, gt long, cost double, copies array<int>")


def labelled(trees: DataFrame, copies: DataFrame) -> DataFrame:
    """trees (family, gt, pos, nodes) with labels, the copy that each leaf lies on: what surgery.partition takes apart."""
    return trees.join(copies.select(*KEY, F.col("copies").alias("labels")), KEY)


def full_search(genes: DataFrame, leaves: DataFrame, weights: DataFrame, species: DataFrame, rounds: int = 3, most_units: int = 15, w_dup: float = 1, w_loss: float = 1) -> tuple[DataFrame, DataFrame]:
    """(events, species): one event after the other, each on the tree that the one before left.

    A round scores every candidate, takes the best, joins its copy into the species tree and moves the gene leaves that its map
    puts on the copy; copied species' names end with |round.1. A family stops when its best candidate no longer beats its tree.
    events has (family, round, mt_id, h, t, score, before, passed), the last of a family not passed unless rounds ran out.
    species needs a column species. Each round's tables are stored, so a round never repeats those before.
    """
    species, trees, events = stored(species), stored(newick.listed(genes, leaves, KEY)), None
    weights = stored(weights)
    for k in range(1, rounds + 1):
        scores = stored(sweep.score_candidates(*tables(trees), weights, species.drop("species"), most_units, w_dup, w_loss))
        won = stored(winners(scores).withColumn("round", F.lit(k)))
        events = won if events is None else events.unionByName(won)
        ahead = stored(won.filter("passed"))
        if k == rounds or ahead.isEmpty():
            break
        found = stored(sweep.units(trees, species.drop("species")))
        going = trees.join(sweep.small(ahead.select("family"), species), "family", "left_semi")
        copies = winning_copies(going, found, ahead, species.drop("species"), w_dup, w_loss)
        sites = ahead.join(species.select("family", F.col("node").alias("h"), F.col("lo").alias("hlo"), F.col("hi").alias("hhi")), ["family", "h"]).join(species.select("family", F.col("node").alias("t"), F.col("hi").alias("thi")), ["family", "t"]).select("family", "hlo", "hhi", "thi")
        joined = going.join(copies, KEY).join(sweep.small(sites, species), "family")
        pos = F.transform(F.arrays_zip("pos", "copies"), lambda x: F.when(x["copies"] == 1, x["pos"] - F.col("hlo") + F.col("thi") + 1).when(x["pos"] > F.col("thi"), x["pos"] + F.col("hhi") - F.col("hlo") + 1).otherwise(x["pos"]))
        trees = stored(joined.select(*KEY, pos.cast("array<int>").alias("pos"), "nodes"))
        species = stored(surgery.graft(species.join(ahead.select("family"), "family", "left_semi"), ahead, f"|{k}.1"))
    return events.select("family", "round", "mt_id", "h", "t", "score", "before", "passed"), species


def tables(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(genes, leaves) of listed trees."""
    return trees.select(*KEY, F.inline("nodes")).select(*KEY, "u", "parent", "lo", "hi"), trees.select(*KEY, F.posexplode("pos").alias("leaf", "pos"))
