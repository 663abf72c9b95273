"""Chat formatting after collapse of cumulative snapshots, in DataFrame functions only.

Logs often hold a conversation several times, each time with more turns. A turn's hash covers its place, role and text; the
running xor of two such hashes names every prefix of a conversation by 128 bits. A conversation whose own name is that of a
longer one's prefix goes by an anti-join, equal ones keep the smallest conv_id, and what is left is rendered.

Defined results: turns are ordered by turn, then role, then text, nulls first; identical rows of a conversation count once. A
null role is rendered as `unknown`, a null text as empty; in hashes both differ from any value. Rows without a conv_id belong
to no conversation. `<|` within a role or text is rendered as `< |`, so that no content closes a turn. Other columns are
dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed


def _hashes() -> list:
    parts = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    # A hash takes what went before as its seed: two hashes only differ throughout if their first values do.
    return [F.xxhash64(F.lit(seed), "place", *parts) for seed in ("first", "second")]


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text) of the maximal conversations of turns (conv_id, turn, role, text)."""
    turns = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    first, second = _hashes()
    hashed = turns.withColumn("place", F.row_number().over(order)).select("conv_id", "place", first.alias("a"), second.alias("b"))
    by_place = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = checkpointed(hashed.select("conv_id", "place", F.bit_xor("a").over(by_place).alias("a"), F.bit_xor("b").over(by_place).alias("b"), F.lead("place").over(Window.partitionBy("conv_id").orderBy("place")).isNull().alias("whole")))
    # One row for each different conversation, and for each different proper prefix, however often it was logged.
    whole = names.filter("whole").groupBy("place", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = names.filter("NOT whole").select("place", "a", "b").distinct()
    kept = whole.join(prefixes, ["place", "a", "b"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")
    safe = lambda c, default: F.replace(F.coalesce(c, F.lit(default)), F.lit("<|"), F.lit("< |"))
    lines = turns.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda x: F.concat(F.lit("<|"), safe(x["role"], "unknown"), F.lit("|>\n"), safe(x["text"], ""), F.lit("<|end|>\n"))), "")
    return lines.select("conv_id", text.alias("text")).join(kept, "conv_id").select("conv_id", "n_turns", "n_copies", "text")


ORACLE = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l, count(*) AS n FROM t GROUP BY conv_id),
k AS (SELECT min(conv_id) AS conv_id, l, n, count(*) AS n_copies FROM c GROUP BY l, n),
m AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.n > k.n AND o.l[1:k.n] = k.l))
SELECT conv_id, n AS n_turns, n_copies,
       array_to_string(list_transform(l, lambda x: concat('<|', replace(coalesce(x.r, 'unknown'), '<|', '< |'), '|>', chr(10), replace(coalesce(x.t, ''), '<|', '< |'), '<|end|>', chr(10))), '') AS text
FROM m
"""
