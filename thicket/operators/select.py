"""Ranking, selection and the shape of a score distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best(scores: DataFrame, n: int, key: str = "gt_id") -> DataFrame:
    """The n rows of least (score, key), ranked from 1."""
    top = scores.orderBy("score", key).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("score", key)))


def passed(ranked: DataFrame, reference: float, offset: float, relative: bool = False) -> DataFrame:
    """ranked with passed: whether a score is below the reference by more than the offset, taken of the reference if relative."""
    least = offset * reference if relative else offset
    return ranked.withColumn("passed", F.lit(least) < F.lit(reference) - F.col("score"))


def histogram(scores: DataFrame, bins: int = 30) -> DataFrame:
    """(bin, n) of equal bins from the least to the greatest score; the greatest is in the last bin."""
    ends = scores.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    number = F.when(F.col("high") == F.col("low"), 1).otherwise(F.least(F.lit(bins), F.floor((F.col("score") - F.col("low")) / width) + 1))
    return scores.select("score").crossJoin(F.broadcast(ends)).groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def density(scores: DataFrame, points: int = 100, by: list[str] | None = None) -> DataFrame:
    """(*by, point, x, density, valley): Gaussian kernel density on an even grid, bandwidth std * n ** -0.2, and its inner minima.

    Equal scores are counted first, so the kernel sum runs over different scores only. Of a flat minimum its middle point is the
    valley. A group of under three scores, or of equal ones, has no density.
    """
    by = by or []
    counts = scores.groupBy(*by, "score").agg(F.count("*").cast("double").alias("m"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # as many rows as a group has different scores
    middle = counts.withColumn("n", F.sum("m").over(group)).withColumn("mean", F.sum(F.col("m") * F.col("score")).over(group) / F.col("n"))
    off = F.col("score") - F.col("mean")
    total = middle.groupBy(*by).agg(F.max("n").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.sum(F.col("m") * off * off).alias("square"))
    total = total.filter("n >= 3 AND high > low").withColumn("h", F.sqrt(F.col("square") / (F.col("n") - 1)) * F.pow("n", F.lit(-0.2)))
    grid = total.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / (points - 1))
    z = (F.col("x") - F.col("score")) / F.col("h")
    met = counts.join(grid, by) if by else counts.crossJoin(F.broadcast(grid))  # `points` rows
    summed = met.groupBy(*by, "point", "x").agg((F.sum(F.col("m") * F.exp(-z * z / 2)) / F.first(F.col("n") * F.col("h") * F.sqrt(F.lit(2) * F.pi()))).alias("density"))
    along = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("point")
    stepped = summed.withColumn("step", F.coalesce((F.col("density") != F.lag("density").over(along)).cast("int"), F.lit(0))).withColumn("run", F.sum("step").over(along))
    runs = stepped.groupBy(*by, "run").agg(F.floor((F.min("point") + F.max("point")) / 2).cast("int").alias("middle"), F.first("density").alias("d"))
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("run")
    low = runs.withColumn("low", F.coalesce((F.col("d") < F.lag("d").over(order)) & (F.col("d") < F.lead("d").over(order)), F.lit(False)))
    joined = stepped.join(low.select(*by, "run", "middle", "low"), [*by, "run"])
    return joined.select(*by, "point", "x", "density", (F.col("low") & (F.col("point") == F.col("middle"))).alias("valley"))


def valleys(scores: DataFrame, points: int = 100) -> DataFrame:
    """(family, input, first, left, right) of scores (family, mt_id, score): the first valley of the density of all scores, mt_id 0 too, and the nearest on either side of the input's, mt_id 0.

    Without a valley the first is the largest score; without one on a side that is infinitely far. Without an input it is infinite.
    """
    known = scores.filter("score IS NOT NULL")
    found = density(known.select("family", "score"), points, ["family"]).filter("valley").select("family", "x")
    ends = known.groupBy("family").agg(F.max("score").alias("high"), F.max(F.when(F.col("mt_id") == 0, F.col("score"))).alias("input"))
    far = F.lit(float("inf"))
    both = ends.withColumn("input", F.coalesce("input", far)).join(found, "family", "left")
    x, at = F.col("x"), F.col("input")
    return both.groupBy("family", "input").agg(F.coalesce(F.min("x"), F.max("high")).alias("first"), F.coalesce(F.max(F.when(x < at, x)), -far).alias("left"), F.coalesce(F.min(F.when(x > at, x)), far).alias("right"))


#: What n_best stands for below 1: up to the input's score, the first valley, those left and right of the input.
BREAKS = {0: "input", -1: "first", -2: "left", -3: "right"}


def selected(scores: DataFrame, bounds: DataFrame, n_best: int = 1, mode: str = "single", cutoff: tuple[str, bool, float] = ("input", False, 0.0), previous: DataFrame | None = None) -> DataFrame:
    """(family, mt_id, score, rank, passed): the candidates that a search goes on with; mt_id 0 is the input, always in, without a rank and passed.

    n_best counts the candidates, best first; 0 to -3 take all up to a score (BREAKS), itself included; below that all. The best
    one is always in. cutoff is (reference, relative, offset): a candidate passes if it lies below the reference (input, first,
    left, right, or none for all) by more than the offset, taken of the reference if relative; previous (family, score) stands
    in for the input's score there. Mode no-st leaves the input out, and then breaks around it mean the first valley; st-only
    takes nothing else.
    """
    if mode not in ("single", "no-st", "st-only"):
        raise ValueError(f"no such mode: {mode}")
    if cutoff[0] not in ("none", *BREAKS.values()):
        raise ValueError(f"no such reference: {cutoff[0]}")
    known = scores.filter("score IS NOT NULL")
    own = known.filter("mt_id = 0").select("family", "mt_id", "score", F.lit(None).cast("long").alias("rank"), F.lit(True).alias("passed"))
    if mode == "st-only":
        return own
    if mode == "no-st" and n_best in (0, -2, -3):
        n_best = -1
    ranked = known.filter("mt_id > 0").withColumn("rank", F.row_number().over(Window.partitionBy("family").orderBy("score", "mt_id")).cast("long"))
    rows = ranked.join(bounds, "family")
    if n_best in BREAKS:
        rows = rows.filter((F.col("score") <= F.col(BREAKS[n_best])) | (F.col("rank") == 1))
    elif n_best > 0:
        rows = rows.filter(F.col("rank") <= n_best)
    if cutoff[0] == "none":
        passes = F.lit(True)
    else:
        reference = F.col(cutoff[0])
        if cutoff[0] == "input" and previous is not None:
            rows = rows.join(previous.select("family", F.col("score").alias("previous")), "family", "left")
            reference = F.coalesce("previous", "input")
        passes = F.lit(float(cutoff[2])) * (reference if cutoff[1] else F.lit(1.0)) < reference - F.col("score")
    found = rows.select("family", "mt_id", "score", "rank", passes.alias("passed"))
    return found if mode == "no-st" else own.unionByName(found)
