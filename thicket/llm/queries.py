"""The corpus operators as queries over the input tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, htmltext, jaccard, langid, linedup, oracles, packing, phrases, pieces, quality, secrets, suffix_model, topk, treap
from .common import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op2_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), *byte_bpe_files())


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation that is no prefix of a longer one, rendered."""
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best others of every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that an earlier line repeats or nearly repeats."""
    docs = linedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", "text")


def op7_suffix_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability, learned from six sevenths of them."""
    return suffix_model.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality counts and verdict of every document."""
    docs = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), carry=["doc_id"])
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[F.round(c, 6).alias(c) for c in ("class_distance", "word_distance")])


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of nine tenths similarity of three-word sets."""
    return jaccard.link(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, percent=90)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = pieces.decode_documents(pieces.encode_documents(docs, model), model)
    return decoded.select("doc_id", "n_tokens", "ids_crc32", F.length("decoded").cast("long").alias("n_chars"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op11_treap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for every benchmark item."""
    return treap.search(treap.build(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of two to four words found thirty times or more."""
    return phrases.mine(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of secrets in every document, by pattern and by randomness tests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.find(docs, ["doc_id"]))


def byte_bpe_files() -> tuple[str, str, str]:
    """Vocabulary, ranks and word pattern of the public byte-level tokenizer."""
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


QUERIES = {
    "op1_langid": op1_langid,
    "op2_htmltext": op2_htmltext,
    "op3_packing": op3_packing,
    "op4_chat": op4_chat,
    "op5_topk": op5_topk,
    "op6_linedup": op6_linedup,
    "op7_suffix_model": op7_suffix_model,
    "op8_quality": op8_quality,
    "op9_jaccard": op9_jaccard,
    "op10_pieces": op10_pieces,
    "op11_treap": op11_treap,
    "op12_phrases": op12_phrases,
    "op13_secrets": op13_secrets,
}

ORACLE_SQL = oracles.ORACLE_SQL
