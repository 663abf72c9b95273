"""Ranked lexical search by K2-treaps: compressed quadtrees over grids of terms and documents whose cells hold the largest impact.

Documents are dealt to blocks of up to BLOCK_DOCS, or BLOCK_BYTES of text. A block is a grid of its terms, the commonest first,
by its documents; a point holds the term's impact on the document. The grid is halved both ways again and again: a cell without
points is not kept, another one has a bit for each quarter that has points and the largest impact in it, written as what it falls
short of its parent's. A block is a row of the index, so the index is as many rows as there are blocks.

A search goes down the rows of an item's terms together. A state is a range of documents with one cell for each term that has
points there; the sum of weight times largest impact bounds what any of the documents may score. In each block every item opens
its best states first, a few at a time, and stops once none may reach its least score so far, which it takes along from block to
block of a task. A range of one document has its exact score. Items come in batches of bounded size against the whole index, and
go down a block in parts of bounded size; what tasks find is merged by ranks, first within groups of tasks.

Defined results: a null or blank text has no terms and is no hit of any item. Rows count each, whatever their ids; equal scores
go by doc_id, null last. An item without terms, or whose terms no document holds, has no rows. Repeated items are ranked each.
Of extra columns none is read. A text is never split, so a very long one is a block alone.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LARGE_ROWS, small_batches, stored, workers_find_package

BLOCK_DOCS, BLOCK_BYTES = 256, 2 << 20
#: Bytes of item texts that are searched at once.
BATCH_BYTES = 1 << 20
#: Terms of the items that go down a block together; their states take memory in proportion, whatever the number of items.
TOGETHER = 4096
#: States that an item opens at once, and groups of tasks whose hits are merged first.
OPENED, SALTS = 8, 64
#: Entries of a search's states before the dead ones are dropped.
HELD = 500_000
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_POSTINGS = "doc_ids array<long>, n_docs long, n_terms long, lengths binary, terms binary, df binary, cols binary, tf binary"
_GRID = "doc_ids array<long>, terms binary, df binary, levels int, sizes binary, quarters binary, drops binary"


def terms_of(text: str) -> list[bytes]:
    """Terms of a text, in order and with repeats."""
    return text.encode().translate(_TERMS).split()


def postings(docs: DataFrame) -> DataFrame:
    """A row for each block of docs (doc_id, text): its terms by falling number of documents, and for each the documents and how often it occurs."""

    def block(ids, number, words):
        lengths = np.array([len(w) for w in words], np.int64)
        both, tf = np.unique(np.concatenate(words) * len(words) + np.repeat(np.arange(len(words)), lengths), return_counts=True)
        df = np.bincount(both // len(words), minlength=len(number))
        order = np.argsort(-df, kind="stable")
        row = np.empty(len(order), np.int64)
        row[order] = np.arange(len(order))
        by = np.argsort(row[both // len(words)], kind="stable")
        terms = list(number)
        held = [ids, int((lengths > 0).sum()), int(lengths.sum()), lengths.tobytes(), b" ".join(terms[i] for i in order), df[order].astype(np.int32).tobytes(), (both % len(words))[by].astype(np.int32).tobytes(), tf[by].astype(np.int32).tobytes()]
        kinds = [pa.list_(pa.int64()), pa.int64(), pa.int64()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held, kinds)], names=[x.split()[0] for x in _POSTINGS.split(", ")])

    def empty():
        number = defaultdict()
        number.default_factory = number.__len__  # a new term gets the next number
        return [], number, [], 0

    def run(batches):
        ids, number, words, size = empty()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                ids.append(doc_id.as_py())
                words.append(np.array([number[x] for x in terms_of(text)], np.int64))
                size += len(text)
                if len(ids) == BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield block(ids, number, words)
                    ids, number, words, size = empty()
        if ids:
            yield block(ids, number, words)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _POSTINGS)


def spread_bits(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers moved to the even places of 64-bit ones."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def grid(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> tuple:
    """(levels, sizes, quarters, drops) of the treap over points; sizes has the cells of each level, the whole grid's first."""
    levels = max(int(rows.max(initial=0)).bit_length(), int(cols.max(initial=0)).bit_length(), 1)
    cell = spread_bits(rows) << np.uint64(1) | spread_bits(cols)
    order = np.argsort(cell)
    cell, best = cell[order], values[order].astype(np.int64)
    sizes, quarters, drops = [len(cell)], [], []
    for _ in range(levels):
        parent = cell >> np.uint64(2)
        new = np.concatenate([[True], parent[1:] != parent[:-1]])
        first, of = np.flatnonzero(new), np.cumsum(new) - 1
        above = np.maximum.reduceat(best, first)
        marks = np.zeros(4 * len(first), np.uint8)
        marks[4 * of + (cell & np.uint64(3)).astype(np.int64)] = 1
        quarters.append(np.packbits(marks))
        drops.append((above[of] - best).astype(np.uint32))
        cell, best = parent[first], above
        sizes.append(len(cell))
    drops.append(best.astype(np.uint32))
    turned = lambda parts: np.concatenate(parts[::-1])
    return levels, np.array(sizes[::-1], np.int64), turned(quarters), turned(drops)


def opened(levels: int, sizes: np.ndarray, quarters: np.ndarray, drops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child, best) of a treap: the four quarters' cells of each cell, -1 for none, and each cell's largest impact; cells are numbered level by level."""
    child, best, at = [], [drops[:1].astype(np.int64)], 0
    ends = np.cumsum(sizes)
    for level in range(levels):
        n = int(sizes[level])
        marks = np.unpackbits(quarters[at : at + (4 * n + 7) // 8])[: 4 * n].astype(bool)
        at += (4 * n + 7) // 8
        number = np.full(4 * n, -1, np.int32)
        number[marks] = np.arange(ends[level], ends[level + 1])
        child.append(number)
        best.append(best[-1][np.flatnonzero(marks) // 4] - drops[ends[level] : ends[level + 1]])
    return np.concatenate(child), np.concatenate(best)


def build(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(index, documents with a term, all terms) of docs (doc_id, text)."""
    workers_find_package(docs.sparkSession)
    small_batches(docs.sparkSession, "2m")  # a block or two
    listed = stored(postings(docs), LARGE_ROWS)
    n_docs, n_terms = (x or 0 for x in listed.agg(F.sum("n_docs"), F.sum("n_terms")).first())

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths, df, cols, tf = (np.frombuffer(row[c], t).astype(np.int64) for c, t in (("lengths", np.int64), ("df", np.int32), ("cols", np.int32), ("tf", np.int32)))
                if not len(tf):
                    continue
                m = 100 - 50 + (50 * lengths * n_docs) // n_terms
                values = (1_000_000_000 * tf) // (1000 * tf + 20 * m[cols])
                levels, sizes, quarters, drops = grid(np.repeat(np.arange(len(df)), df), cols, values)
                held = [row["doc_ids"], row["terms"], row["df"], levels, sizes.tobytes(), quarters.tobytes(), drops.tobytes()]
                kinds = [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held, kinds)], names=[x.split()[0] for x in _GRID.split(", ")])

    return stored(listed.mapInArrow(run, _GRID), LARGE_ROWS), n_docs, n_terms


class Hits:
    """The best k of each item so far: by score, then doc_id, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.zeros(items, np.int64)
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, item, score, doc, null):
        item, score, doc, null = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        kept = place_in_group(item) < self.k
        self.item, self.score, self.doc, self.null = item[kept], score[kept], doc[kept], null[kept]
        last = place_in_group(self.item) == self.k - 1
        self.least[self.item[last]] = self.score[last]


def place_in_group(sorted_groups: np.ndarray) -> np.ndarray:
    """Places from 0 within runs of equal numbers."""
    first = np.flatnonzero(np.concatenate([[True], sorted_groups[1:] != sorted_groups[:-1]])) if len(sorted_groups) else np.zeros(0, np.int64)
    return np.arange(len(sorted_groups)) - np.repeat(first, np.diff(np.append(first, len(sorted_groups))))


def descend(block: dict, items: list[np.ndarray], weights: list[np.ndarray], hits: Hits, ids: np.ndarray, null: np.ndarray) -> None:
    """Adds a block's hits for items, each given by rows of its terms in the block and their weights."""
    levels, child, best = block["levels"], block["child"], block["best"]
    sizes = np.array([len(x) for x in items])
    some = np.flatnonzero(sizes)
    # What states hold of terms: row, weight and cell, appended to, and packed when the dead outgrow HELD.
    row, weight = np.concatenate([items[i] for i in some]).astype(np.int32), np.concatenate([weights[i] for i in some]).astype(np.int32)
    cell = np.zeros(len(row), np.int32)
    used = len(row)
    state = {"item": some, "level": np.zeros(len(some), np.int64), "col": np.zeros(len(some), np.int64), "count": sizes[some]}
    state["start"] = np.cumsum(state["count"]) - state["count"]
    state["bound"] = np.add.reduceat(weight.astype(np.int64) * best[0], state["start"])
    while len(state["item"]):
        # The best few of each item; what may not reach an item's least score goes.
        order = np.lexsort((-state["bound"], state["item"]))
        order = order[state["bound"][order] >= np.maximum(1, hits.least[state["item"][order]])]
        place = place_in_group(state["item"][order])
        now = {k: v[order[place < OPENED]] for k, v in state.items()}
        state = {k: v[order[place >= OPENED]] for k, v in state.items()}
        leaf = now["level"] == levels
        if leaf.any():
            at = now["col"][leaf]
            hits.add(now["item"][leaf], now["bound"][leaf], ids[at], null[at])
            now = {k: v[~leaf] for k, v in now.items()}
        if not len(now["item"]):
            continue
        owner = np.repeat(np.arange(len(now["item"])), now["count"])
        at = np.repeat(now["start"] - (np.cumsum(now["count"]) - now["count"]), now["count"]) + np.arange(len(owner))
        half = (row[at] >> (levels - 1 - now["level"][owner])) & 1
        new = []
        for side in (0, 1):
            to = child[4 * cell[at] + 2 * half + side]
            there = to >= 0
            own, r, w, c = owner[there], row[at][there], weight[at][there], to[there]
            if not len(own):
                continue
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            kept = own[first]
            made = {"item": now["item"][kept], "level": now["level"][kept] + 1, "col": 2 * now["col"][kept] + side, "count": np.diff(np.append(first, len(own))), "start": used + first, "bound": np.add.reduceat(w.astype(np.int64) * best[c], first)}
            if used + len(r) > len(row):
                row, weight, cell = (np.concatenate([x, np.zeros(max(len(x), len(r)), x.dtype)]) for x in (row, weight, cell))
            row[used : used + len(r)], weight[used : used + len(r)], cell[used : used + len(r)] = r, w, c
            used += len(r)
            new.append(made)
        state = {k: np.concatenate([state[k], *[x[k] for x in new]]) for k in state}
        if used > HELD and used > 2 * state["count"].sum():
            begin = np.cumsum(state["count"]) - state["count"]
            at = np.repeat(state["start"] - begin, state["count"]) + np.arange(int(state["count"].sum()))
            row, weight, cell, state["start"], used = row[at], weight[at], cell[at], begin, len(at)


def _frequencies(terms: set[bytes]):
    def run(batches):
        found: dict[bytes, int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                for term, df in zip(row["terms"].split(), np.frombuffer(row["df"], np.int32).tolist()):
                    if term in terms:
                        found[term] = found.get(term, 0) + df
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "df"])

    return run


def _search(items: list[list[tuple[bytes, int]]], k: int):
    """Hits (item, doc_id, score) of a task's blocks for items, given as lists of (term, weight)."""
    wanted = {t for item in items for t, _ in item}
    parts, ends = [], np.cumsum([len(item) for item in items])
    while (at := parts[-1].stop if parts else 0) < len(items):
        parts.append(slice(at, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, side="right")))))

    def run(batches):
        hits = [Hits(len(items[part]), k) for part in parts]
        for batch in batches:
            for row in batch.to_pylist():
                place = {t: i for i, t in enumerate(row["terms"].split()) if t in wanted}
                block = {"levels": row["levels"]}
                block["child"], block["best"] = opened(row["levels"], np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["quarters"], np.uint8), np.frombuffer(row["drops"], np.uint32))
                null = np.array([x is None for x in row["doc_ids"]])
                ids = np.array([x or 0 for x in row["doc_ids"]], np.int64)
                for part, best in zip(parts, hits):
                    held = [[(place[t], w) for t, w in item if t in place] for item in items[part]]
                    if any(held):
                        descend(block, [np.array([r for r, _ in x], np.int64) for x in held], [np.array([w for _, w in x], np.int64) for x in held], best, ids, null)
        for part, best in zip(parts, hits):
            docs = pa.array(best.doc, mask=best.null) if len(best.doc) else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(best.item + part.start), docs, pa.array(best.score)], names=["item", "doc_id", "score"])

    return run


def _batches(items: DataFrame):
    """(item_id, terms of its text, each once) of some items at a time."""
    held, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        terms = list(dict.fromkeys(terms_of(r["text"] or "")))
        if terms:
            held.append((r["item_id"], terms))
            size += sum(map(len, terms))
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(index: tuple[DataFrame, int, int], items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of each item (item_id, text)."""
    table, n_docs, _ = index
    spark = table.sparkSession
    found = None
    for batch in _batches(items):
        wanted = {t for _, terms in batch for t in terms}
        counted = table.select("terms", "df").mapInArrow(_frequencies(wanted), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
        weighed = counted.select("term", F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w"))
        weight = {bytes(r["term"]): r["w"] for r in weighed.collect()}  # at most the batch's terms
        listed = [[(t, weight[t]) for t in terms if t in weight] for _, terms in batch]
        hits = table.mapInArrow(_search(listed, k), "item long, doc_id long, score long").withColumn("salt", F.spark_partition_id() % SALTS)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        first = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= k)
        best = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(batch)], "item long, item_id long")
        part = best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found = part if found is None else stored(found).unionByName(stored(part))
    return found if found is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


_SIGNS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_SIGNS}') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY ALL),
m AS (SELECT rid, doc_id, 100 - 50 + (50 * len(w) * nd) // l AS m FROM d, s WHERE len(w) > 0),
q AS (SELECT row_number() OVER () AS iid, item_id, list_distinct(regexp_extract_all({_LOWER}, '{_SIGNS}')) AS w FROM benchmark),
t AS (SELECT iid, item_id, unnest(w) AS term FROM q),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, nd),
c AS (SELECT iid, item_id, doc_id, rid, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM t JOIN f USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
"""
