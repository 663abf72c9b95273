"""The best ways through a tree of searches: each search has alternatives, of which one is taken, and each alternative leads to further searches, which all are done.

states: (run, state, task, up, side, depth, delta): an alternative of search `task`, what it changes the score by (0 if it did
not pass), and where its search stands: below state `up`, null for the first search of a run, as its subsearch 0 or 1. A way is
a set of states, one for each search that is reached; its value is the sum of their deltas, the less the better. Values come
from below by levels, for all runs at once, and of each state and each search the best `keep` are kept: none of the best ones
of a whole is made from any but the best of its parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored


def _first(rows: DataFrame, by: list[str], keep: int) -> DataFrame:
    """The `keep` best of each group with their place."""
    along = Window.partitionBy(*by).orderBy("value", "way")
    return rows.withColumn("place", F.row_number().over(along)).filter(F.col("place") <= keep)


def universes(states: DataFrame, keep: int = 500) -> DataFrame:
    """(run, place, value, way): each run's best ways, way being the sorted states on it."""
    states = stored(states)
    deepest = states.agg(F.max("depth")).first()[0]
    below = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        level = states.filter(F.col("depth") == depth)
        rows = level.select("run", "state", "up", "side", F.col("delta").alias("value"), F.array("state").alias("way"))
        if below is not None:
            # Of two sides only pairs whose places multiply to `keep` at most can be among the best; a side without a search adds nothing.
            side = lambda k: below.filter(F.col("side") == k).select("run", F.col("up").alias("state"), F.col("value").alias(f"v{k}"), F.col("way").alias(f"w{k}"), F.col("place").alias(f"p{k}"))  # noqa: E731,B023
            with_left = rows.join(side(0), ["run", "state"], "left")
            ranks = F.coalesce("p0", F.lit(1)) * F.coalesce("p1", F.lit(1)) <= keep
            both = with_left.join(side(1), ["run", "state"], "left").filter(ranks)
            none = F.array().cast("array<bigint>")
            rows = both.select("run", "state", "up", "side", (F.col("value") + F.coalesce("v0", F.lit(0.0)) + F.coalesce("v1", F.lit(0.0))).alias("value"), F.concat("way", F.coalesce("w0", none), F.coalesce("w1", none)).alias("way"))
        best = _first(rows.withColumn("way", F.array_sort("way")), ["run", "state"], keep).drop("place", "state")
        below = stored(_first(best, ["run", "up", "side"], keep))
    empty = states.select("run", F.lit(1).alias("place"), F.col("delta").alias("value"), F.array("state").alias("way")).limit(0)
    return empty if below is None else below.filter("up IS NULL").select("run", "place", "value", "way")


def followed(states: DataFrame, ways: DataFrame, breadth: int) -> DataFrame:
    """states with open: whether a state is on one of its run's best `breadth` ways; others need not be searched further."""
    on = ways.filter(F.col("place") <= breadth).select("run", F.explode("way").alias("state")).distinct().withColumn("open", F.lit(True))
    return states.join(on, ["run", "state"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
