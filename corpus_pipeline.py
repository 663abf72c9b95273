"""A training corpus from raw documents: stages that each read the Parquet output of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import jaccard, langid, linedup, packing, quality
from thicket.llm.common import stored
from thicket.llm.queries import byte_bpe_files

#: Calibrated probability under which a document's language is taken as not known.
LEAST_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's histograms."""
    return quality.passing(docs).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is of a known language."""
    return langid.identify(docs).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came up before; those that have no word left go."""
    left = linedup.drop_repeated_lines(docs).filter(F.length(F.btrim("text", F.lit(linedup.TRIMMED))) > 0)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8."""
    return jaccard.one_of_each(docs, n=5, percent=80).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, as pieces placed in sequences of 1,024 tokens."""
    return packing.pack_documents(docs, *byte_bpe_files())


#: (name, function of session, documents and folder of tables).
STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: The stages' learning and packing have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the table documents, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
