"""Best-fit packing of tokenised documents into fixed-length sequences, in bulk-synchronous rounds.

Each round range-sorts the waiting pieces and the open gaps together by size, largest first, gaps before pieces. Every piece
takes the nearest gap before it (its successor in size) that no larger piece has taken; since sizes fall along the order,
that is a matching of brackets, so a running sum of +1 for gaps and -1 for pieces gives each its nesting level, and within a
level a piece's gap is the event just before it. Each sorted range sums on its own, and one number per range carries over.
A gap takes one piece a round; conflicts thus go by rank. Gaps shrink, pieces that no gap can hold any more open as many
sequences as their tokens need at least, and the next round begins.

Defined results: a null text is empty; an empty document is its end token alone. A document of more than `capacity` tokens
is cut into pieces of that many, of which the first may be shorter. Rows that repeat are packed each. No row is left out.
Other columns are dropped; names of the input don't matter beyond doc_id and text.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UID, forgotten, stored, with_uid, workers_find_package

#: Words whose ids a Python worker remembers.
REMEMBERED = 300_000
#: Outside these characters, white space of one word never changes how another is cut.
SPACED_WORD = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
ODD_SPACE = re.compile("[%s]" % "".join(map(chr, [0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])))


class ByteBpe:
    """Byte-level BPE ids of whole texts, as little-endian 32-bit integers.

    A word with the white space before it is cut the same way wherever it stands, so its ids are remembered. Texts with
    unusual white space go through the tokenizer whole. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.whole.encode_special_tokens = True
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        self.words = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        got = self.known.get(word)
        if got is None:
            got = np.array(self.words.encode_ordinary(word), dtype="<u4").tobytes()
            if len(self.known) < REMEMBERED and len(word) <= 64:
                self.known[word] = got
        return got

    def encode(self, text: str) -> bytes:
        if ODD_SPACE.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.word, SPACED_WORD.findall(text)))


@lru_cache(maxsize=2)
def byte_bpe(vocabulary: str, ranks: str, pattern: str) -> ByteBpe:
    return ByteBpe(vocabulary, ranks, pattern)


def cut_documents(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the pieces of docs' texts, and their ids if asked for."""
    workers_find_package(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    end = np.array([end_id], dtype="<u4").tobytes()
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]

    def cut(batches):
        bpe = byte_bpe(vocabulary, ranks, pattern)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part, rows = batch.slice(at, 512), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = bpe.encode(text or "") + end
                    total = len(ids) // 4
                    bounds = [0, *range(total % capacity or capacity, total + 1, capacity)]
                    for k, (start, stop) in enumerate(zip(bounds, bounds[1:])):
                        own = ids[4 * start : 4 * stop]
                        rows.append((doc_id, k, start, stop - start, zlib.crc32(own), np.frombuffer(own, dtype="<i4") if with_ids else None))
                columns = [pa.array([r[i] for r in rows], types[i]) for i in range(5 + with_ids)]
                yield pa.RecordBatch.from_arrays(columns, names=names[: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def _sorted_sums(events: DataFrame) -> DataFrame:
    """events (id, size, sign) sorted into ranges by size, with each range's number and running sums.

    sum has the signs up to the row and low the smallest sum before it, both within the range.
    """

    def sums(batches):
        total, low, row = 0, 1 << 60, 0
        for batch in batches:
            sign = batch.column(2).to_numpy()
            if not len(sign):
                continue
            running = total + np.cumsum(sign)
            before = np.minimum.accumulate(np.concatenate([[low], running]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(row, row + len(sign))), pa.array(running), pa.array(before[:-1])], names=["id", "size", "sign", "range", "row", "sum", "low"])
            total, low, row = int(running[-1]), int(before[-1]), row + len(sign)

    ordered = events.repartitionByRange(F.desc("size"), F.desc("sign"), "id").sortWithinPartitions(F.desc("size"), F.desc("sign"), "id").withColumn("range", F.spark_partition_id())
    return ordered.mapInArrow(sums, "id long, size long, sign long, range int, row long, sum long, low long")


def _matched(events: DataFrame) -> DataFrame:
    """events with the other side of each match, and the rank of each piece that has none.

    other and other_size are of the gap for a piece and of the piece for a gap; rank counts unmatched pieces from the largest.
    """
    spark = events.sparkSession
    local = stored(_sorted_sums(events))
    # One row for each range, however many events there are.
    ends = local.groupBy("range").agg(F.max_by("sum", "row").alias("total"), F.min(F.least("low", "sum")).alias("low")).collect()
    carried, base, low = [], 0, 0
    for r in sorted(ends, key=lambda r: r["range"]):
        carried.append((r["range"], base, low))
        base, low = base + r["total"], min(low, base + r["low"])
    carry = F.broadcast(spark.createDataFrame(carried, "range int, base long, floor long"))
    level = local.join(carry, "range").select("id", "size", "sign", "range", "row", (F.col("sum") + F.col("base")).alias("sum"), F.least("floor", F.col("low") + F.col("base")).alias("floor"))
    is_piece = F.col("sign") == -1
    lost = is_piece & (F.col("sum") < F.col("floor"))
    along = Window.partitionBy("level").orderBy("range", "row")
    near = lambda f, sign: [F.when(f("sign").over(along) == sign, f(c).over(along)) for c in ("id", "size")]
    # A piece without a gap is alone on a level below zero, so that one pass does for all events.
    levels = level.withColumns({"level": F.when(lost, F.col("sum")).otherwise(F.col("sum") - F.col("floor") + F.when(is_piece, 1).otherwise(0)), "rank": F.when(lost, -F.col("sum"))})
    gap_before, piece_after = near(F.lag, 1), near(F.lead, -1)
    found = stored(levels.select("id", "size", "sign", F.when(is_piece, gap_before[0]).otherwise(piece_after[0]).alias("other"), F.when(is_piece, gap_before[1]).otherwise(piece_after[1]).alias("other_size"), "rank"))
    forgotten(local)
    return found


def best_fit(items: DataFrame, capacity: int = 1024) -> DataFrame:
    """(id, sequence_id, offset) for items (id unique, size from 1 to capacity); sequences are named after their first item."""
    if items.filter(~F.col("size").between(1, capacity)).limit(1).count():
        raise ValueError(f"an item is empty or longer than {capacity}")
    placed = [items.filter(F.col("size") == capacity).select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    events = items.filter(F.col("size") < capacity).select("id", "size", F.lit(-1).cast("long").alias("sign"))
    while True:
        found = _matched(events)
        space = F.col("size") - F.coalesce("other_size", F.lit(0))
        is_gap, lost = F.col("sign") == 1, F.col("rank").isNotNull()
        seen = found.agg(F.max(F.when(is_gap, space)).alias("widest"), F.count_if(lost).alias("lost"), F.min(F.when(lost, F.col("size"))).alias("least")).first()
        opened = 0
        if seen["lost"]:
            stuck = lost & (F.col("size") > (seen["widest"] or 0))
            need = found.filter(stuck).agg(F.sum("size").alias("tokens"), F.count_if(F.col("size") > capacity // 2).alias("large")).first()
            opened = max(-(-(need["tokens"] or 0) // capacity), need["large"])
        is_new = lost & (F.col("rank") <= opened)
        sequence, offset = F.when(lost, F.col("id")).otherwise(F.col("other")), F.when(lost, 0).otherwise(capacity - F.col("other_size"))
        placed.append(found.filter((F.col("sign") == -1) & (~lost | is_new)).select("id", sequence.alias("sequence_id"), offset.cast("long").alias("offset")))
        if seen["lost"] <= opened:
            break
        # Ranks go from the largest down, so the smallest piece still waits. A row is a gap or a piece in the next round, or neither.
        left = F.when(is_gap, space).when(is_new, capacity - F.col("size")).when(lost, F.col("size"))
        waits = lost & ~is_new
        events = found.select("id", left.alias("size"), F.when(waits, -1).otherwise(1).cast("long").alias("sign")).filter(F.col("size") >= seen["least"])
    whole = placed[0]
    for part in placed[1:]:
        whole = whole.unionByName(part)
    return whole


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of all docs with the sequence and the place where each lies."""
    pieces = stored(with_uid(cut_documents(docs, vocabulary, ranks, pattern, capacity, end_id)))
    places = best_fit(pieces.select(F.col(UID).alias("id"), F.col("length").alias("size")), capacity).withColumnRenamed("id", UID)
    return pieces.join(places, UID).drop(UID)


def packed_ids(docs: DataFrame, packed: DataFrame, vocabulary: str, ranks: str, pattern: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(sequence_id, ids) of packed docs whose ids are unique: the token sequences themselves."""
    pieces = cut_documents(docs, vocabulary, ranks, pattern, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids")
    joined = packed.select("doc_id", "piece", "sequence_id", "offset").join(pieces, ["doc_id", "piece"])
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
