"""Readers of the small side files that steer a search, as DataFrames with their rejected rows told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ploidy(spark: SparkSession, path: str, species: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(species, max_copies) of lines `species count`, and (line, reason) of those left out.

    Comments from # on and blank lines are skipped. A line is left out if it hasn't two fields, its count is no positive whole
    number, its species is unknown, or its species came before with a smaller count.
    """
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("line")).filter("line <> ''")
    fields = lines.withColumn("f", F.split("line", r"\s+"))
    parsed = fields.select("line", F.col("f")[0].alias("species"), F.expr("try_cast(get(f, 1) AS int)").alias("max_copies"), F.size("f").alias("n"))
    known = parsed.join(species.select("species", F.lit(True).alias("known")).distinct(), "species", "left")
    reason = F.when(F.col("n") != 2, "fields").when(F.col("max_copies").isNull() | (F.col("max_copies") < 1), "count").when(F.col("known").isNull(), "unknown species")
    judged = known.withColumn("reason", reason)
    good = judged.filter("reason IS NULL").groupBy("species").agg(F.min("max_copies").alias("max_copies"))
    return good, judged.filter("reason IS NOT NULL").select("line", "reason")


def history(spark: SparkSession, path: str) -> DataFrame:
    """Events of an earlier search: one JSON object a line."""
    return spark.read.json(path)


def save_scores(scores: DataFrame, path: str) -> None:
    """Scores as tab-separated text, best first, three decimals, in as many files as Spark sorts them into; candidates without a score say so."""
    text = F.when(F.col("score").isNull(), "NOT_SCORED").otherwise(F.format_string("%.3f", "score"))
    scores.orderBy(F.asc_nulls_last("score"), "mt_id").select("mt_id", "h", "t", text.alias("score")).write.mode("overwrite").csv(path, sep="\t", header=True)


def tree_lines(trees: DataFrame, rejected: DataFrame, over: DataFrame) -> DataFrame:
    """(tree_id, line): each of trees (tree_id, newick) as it is, or why it was left out: rejected (tree_id, reason), or over (tree_id, n_units) the limit of units."""
    both = trees.join(rejected.select("tree_id", "reason"), "tree_id", "left").join(over.select("tree_id", "n_units"), "tree_id", "left")
    why = F.when(F.col("reason").isNotNull(), F.concat(F.lit("# left out: "), "reason")).when(F.col("n_units").isNotNull(), F.concat(F.lit("# over the limit: "), F.col("n_units").cast("string"), F.lit(" units")))
    return both.select("tree_id", F.coalesce(why, F.col("newick")).alias("line"))


def filtered(inputs: DataFrame, trees: DataFrame, per_donor: DataFrame, limit: int) -> DataFrame:
    """(tree_id, outcome, n_over, line) for each of inputs (tree_id), in place: kept with its tree, over the limit of units, or gone before.

    trees has (tree_id, newick) of those that are left, per_donor (tree_id, n_units) a row for each donor of a tree; n_over counts
    the donors under which it is over the limit.
    """
    over = per_donor.groupBy("tree_id").agg(F.count_if(F.col("n_units") > limit).alias("n_over"))
    both = inputs.select("tree_id").join(trees.select("tree_id", "newick"), "tree_id", "left").join(over, "tree_id", "left").withColumn("n_over", F.coalesce("n_over", F.lit(0).cast("long")))
    outcome = F.when(F.col("newick").isNull(), "gone").when(F.col("n_over") > 0, "over").otherwise("kept")
    line = F.when(F.col("newick").isNull(), F.lit("# gone before")).when(F.col("n_over") > 0, F.concat(F.lit("# over the limit for "), F.col("n_over").cast("string"), F.lit(" donors"))).otherwise(F.col("newick"))
    return both.select("tree_id", outcome.alias("outcome"), "n_over", line.alias("line"))


def check_numbers(units: DataFrame, pinned: DataFrame) -> DataFrame:
    """(family, gt, h, t, groups, fixed, combinations) of sweep.units and sweep.pins: a tree's units under each candidate, how many of them are tied, and the choices left."""
    key = ["family", "gt", "h"]
    load = pinned.groupBy(*key, "t").agg(F.count("*").alias("groups"), F.count("state").alias("fixed"))
    return load.withColumn("combinations", F.pow(F.lit(2.0), F.col("groups") - F.col("fixed"))).join(units.select(*key).distinct(), key, "left_semi")
