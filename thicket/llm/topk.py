"""Exact top-k inner products over a bit-sliced index.

Vectors become integers, floor(256 x) of each component. The index, a stored table, holds blocks of rows: each component as bit
slices, bitmaps over the block's rows, least significant first. A query's scores are made by bitmap arithmetic alone: for every
set bit of a component's weight the component's slices are added, shifted, into the slices of the sum; a negative weight adds
the complement. The k largest sums are then read off from the most significant slice downward, and rows that tie at the boundary
go by their number. Blocks of queries meet blocks of the index; each pair of blocks yields k rows a query, of which the best stay.
What is copied for each block of queries is the index's slices, some ten bits a component.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part, nor does one with a component
whose 256-fold passes the doubles. Each row counts on its own: rows that share a vec_id are all candidates, also of one another,
and each is a query if its vec_id is one; their answers then stand under the same query_id. Only vectors of one length meet. Rows
with a null vec_id take no part. Large components lie in blocks of their own, whose slices are as many as they need. Scores are
exact of any size and order rows so; one that passes 64 bits is written as the nearest long. Other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UID, checkpointed, small_batches, stored, with_uid, workers_find_package

ROW_BLOCK, QUERY_BLOCK = 8192, 4096
#: Integer components up to this size are 64-bit in numpy, and so are sums of 2 ** 16 products; larger ones are Python's.
NARROW = 1 << 23
#: Added to a score that passes 64 bits, so that its bytes order as it does; products of doubles' integers are smaller.
WIDE = 1 << 2200


def integers(vectors: pa.ChunkedArray | pa.Array, wide: bool) -> np.ndarray:
    """Whole-numbered doubles (row, component) as 64-bit integers, or as Python's where they are wide."""
    flat = vectors.combine_chunks().flatten().to_numpy().reshape(len(vectors), -1)
    return np.array([list(map(int, row)) for row in flat.tolist()], dtype=object) if wide else flat.astype(np.int64)


def bit_slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices (component, bit, word) of integers (row, component) less each component's minimum, and the minima."""
    low = values.min(axis=0)
    shifted = values - low
    bits = max(1, int(shifted.max()).bit_length())
    words = -(-len(values) // 64)
    out = np.zeros((values.shape[1], bits, words), dtype=np.uint64)
    for b in range(bits):
        flags = np.zeros((words * 64, values.shape[1]), dtype=np.uint8)
        flags[: len(values)] = shifted >> b & 1
        out[:, b] = np.packbits(flags, axis=0, bitorder="little").T.copy().view(np.uint64)
    return out, low


def sums(slices: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Slices (bit, query, word) of each row's sum of |weight| times its component, or the component's complement where the weight is negative."""
    dims, bits, words = slices.shape
    size = np.abs(weights)
    width = (int(size.sum(axis=1).max()) * ((1 << bits) - 1)).bit_length() + 1
    total = np.zeros((width, len(weights), words), dtype=np.uint64)
    for d in range(dims):
        for shift in range(int(size[:, d].max()).bit_length()):
            who = np.flatnonzero((size[:, d] >> shift & 1).astype(bool))
            if not len(who):
                continue
            flip = np.where(weights[who, d] < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]
            carry = np.zeros((len(who), words), dtype=np.uint64)
            for b in range(shift, width):
                at = total[b][who]
                if b - shift < bits:
                    add = slices[d, b - shift] ^ flip
                    half = at ^ add
                    total[b][who] = half ^ carry
                    carry = at & add | half & carry
                else:
                    total[b][who] = at ^ carry
                    carry &= at
                    if not carry.any():
                        break
    return total


def largest(total: np.ndarray, able: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (query, word) of rows above the k-th largest sum and of rows equal to it, among able rows."""
    sure, tied = np.zeros_like(able), able.copy()
    for s in total[::-1]:
        higher = tied & s
        n = np.bitwise_count(sure | higher).sum(axis=1)
        more = (n >= k)[:, None]
        sure = np.where(more, sure, sure | higher)
        tied = np.where(more, higher, tied & ~s)
    return sure, tied


def block_top(slices: np.ndarray, low: np.ndarray, own: np.ndarray, n: int, queries: np.ndarray, k: int):
    """(query, row, score) of each query's k best of a block's n rows, ties to the smaller row; own is a query's own row there, or -1."""
    bits, words = slices.shape[1:]
    every = np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)
    out = []
    for at in range(0, len(queries), 64):
        q = queries[at : at + 64]
        able = np.repeat(every[None], len(q), axis=0)
        for i in np.flatnonzero(own[at : at + 64] >= 0):
            row = int(own[at + i])
            able[i, row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
        total = sums(slices, q)
        sure, tied = largest(total, able, k)
        for i in range(len(q)):
            weights = [int(w) for w in q[i]]
            # A complement stands for its mark less the value, and every value for what it has above the component's minimum.
            base = sum(w * int(m) for w, m in zip(weights, low)) + ((1 << bits) - 1) * sum(w for w in weights if w < 0)
            above = np.flatnonzero(np.unpackbits(sure[i].view(np.uint8), bitorder="little"))
            equal = np.flatnonzero(np.unpackbits(tied[i].view(np.uint8), bitorder="little"))[: max(0, k - len(above))]
            for row in [*above.tolist(), *equal.tolist()]:
                marks = (total[:, i, row // 64] >> np.uint64(row % 64) & np.uint64(1)).tolist()
                out.append((at + i, row, base + sum(m << b for b, m in enumerate(marks))))
    return out


def numbered(vectors: DataFrame) -> DataFrame:
    """(row number, vec_id, v, dim, wide) of the rows that take part, stored; v has floor(256 x) as whole-numbered doubles."""
    spare = float(np.finfo(np.float64).max) / 256
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= spare))
    good = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & whole)
    # Doubles of 2 ** 53 and more are whole already, and the SQL function would take them to a long.
    down = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)
    rows = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: down(x.cast("double") * 256)).alias("v"))
    return checkpointed(with_uid(rows.withColumns({"dim": F.size("v"), "wide": F.array_max(F.transform("v", F.abs)) > NARROW})))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows with the number of the block that each is dealt to; block has a kind's (dim, wide) count of blocks of about size rows."""
    kinds = rows.groupBy("dim", "wide").agg(F.count("*").alias("n"))
    counts = kinds.select("dim", "wide", F.ceil(F.col("n") / size).cast("long").alias("blocks"))
    return rows.join(counts, ["dim", "wide"]).withColumn("block", F.pmod(F.xxhash64(UID), "blocks").cast("int")).drop("blocks")


INDEX = f"dim int, wide boolean, block int, {UID}s binary, ids binary, slices binary, low array<double>"


def build_index(rows: DataFrame, row_block: int = ROW_BLOCK) -> DataFrame:
    """The bit-sliced index of numbered() rows: one row a block."""

    def sliced(key, block):
        block = block.sort_by([("vec_id", "ascending"), (UID, "ascending")])
        slices, low = bit_slices(integers(block["v"], key[1].as_py()))
        parts = [block[UID].to_numpy().tobytes(), block["vec_id"].to_numpy().tobytes(), slices.tobytes(), [float(x) for x in low]]
        names = [x.split()[0] for x in INDEX.split(", ")]
        return pa.table({n: pa.array([v], t) for n, v, t in zip(names, [*[k.as_py() for k in key], *parts], [pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64())])})

    return _blocks(rows, row_block).groupBy("dim", "wide", "block").applyInArrow(sliced, INDEX)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every` the k best others by integer inner product."""
    spark = vectors.sparkSession
    workers_find_package(spark)
    small_batches(spark)
    rows = numbered(vectors)
    index = stored(build_index(rows, row_block))
    queries = _blocks(rows.filter(F.col("vec_id") % every == 0), query_block).select("dim", F.col("wide").alias("wide_query"), F.col("block").alias("query_block"), UID, "vec_id", "v")
    # Each block of the index meets each block of queries of its length: pairs of block numbers, not of rows.
    pairs = index.select("dim", "wide", "block").join(queries.select("dim", "wide_query", "query_block").distinct(), "dim")
    # Both sides come from the same rows, so their columns get names of their own.
    apart = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    left = apart(index.join(pairs, ["dim", "wide", "block"]))
    right = apart(queries.join(pairs, ["dim", "wide_query", "query_block"]))
    schema = "query long, query_id long, vec_id long, score long, wide_score binary"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def best(key, block, asked):
        found = []
        if len(block) and len(asked):
            one = {c: block[c][0].as_py() for c in (f"{UID}s", "ids", "slices", "low")}
            uids, ids, dim = np.frombuffer(one[f"{UID}s"], np.int64), np.frombuffer(one["ids"], np.int64), len(one["low"])
            slices = np.frombuffer(one["slices"], np.uint64).reshape(dim, -1, -(-len(ids) // 64))
            names, shown = asked[UID].to_numpy(), asked["vec_id"].to_numpy()
            order = np.argsort(uids)
            at = np.minimum(np.searchsorted(uids, names, sorter=order), len(uids) - 1)
            own = np.where(uids[order[at]] == names, order[at], -1)
            for q, row, score in block_top(slices, np.array(one["low"]), own, len(ids), integers(asked["v"], key[3].as_py()), k):
                near = max(-(1 << 63), min((1 << 63) - 1, score))
                past = abs(score) >= (1 << 63) - 1
                found.append((int(names[q]), int(shown[q]), int(ids[row]), near, (score + WIDE).to_bytes(280, "big") if past else None))
        return pa.table({n.split()[0]: pa.array([f[i] for f in found], t) for i, (n, t) in enumerate(zip(schema.split(", "), types))})

    keys = ["dim", "wide", "block", "wide_query", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("wide_score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.rid <> c.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
