"""Scores kept up to date as gene trees arrive.

A total over gene trees is a sum, so each micro-batch's sums by candidate are appended under their batch number and the
current total is the sum over batches. A batch that runs again after a failure replaces its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sweep import score_newicks


def follow(spark: SparkSession, trees_folder: str, species: DataFrame, sums_folder: str, checkpoint: str):
    """A started query that scores new trees (family, newick, weight) of a Parquet folder into sums_folder."""

    def add(batch: DataFrame, number: int) -> None:
        found = score_newicks(batch, species).select("family", "mt_id", "score", "n_trees")
        found.write.mode("overwrite").parquet(f"{sums_folder}/batch={number}")

    stream = spark.readStream.schema("family long, newick string, weight long").parquet(trees_folder)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, sums_folder: str) -> DataFrame:
    """(family, mt_id, score, n_trees) over all batches so far."""
    return spark.read.parquet(sums_folder).groupBy("family", "mt_id").agg(F.sum("score").alias("score"), F.sum("n_trees").alias("n_trees"))
