"""Treap search against SQL and against scoring every document, and the treap itself against its points."""

import collections
import math
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thicket.llm import treap

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AWKWARD = [(None, None), (1000, ""), (1000, " .,;- "), (None, "w1 w2 É w3"), (None, "w1 w2 É w3"), (7, "W1 w1 w1_w2"), (1001, "é É x"), (1002, "w0 " * 200_000)]
ITEMS = [(0, "w1 w2 w3 w3 É"), (0, "w1 w2 w3 w3 É"), (1, "nothing-there zzz"), (2, None), (None, "w0 W11 x"), (3, " ".join(f"w{i}" for i in range(40))), (4, "...")]


def corpus(n=900):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["Éa", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for i in range(n)]
    return rows + [(n + i, rows[i][1]) for i in range(20)] + AWKWARD


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(doc_id, collections.Counter(terms(t))) for doc_id, t in docs]
    n_docs, total = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in held:
            m = 50 + 50 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0))
        out += [(item_id, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_search_equals_scoring_all_and_sql(spark, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(treap, "BLOCK_DOCS", 128)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"terms": F.lit(1), "item": F.lit(2)}).repartition(4)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("x"))
    index = treap.build(table)
    got = sorted((tuple(r) for r in treap.search(index, items).collect()), key=repr)
    assert got == brute(docs, ITEMS, 50) and len(got) > 150
    monkeypatch.setattr(treap, "BATCH_BYTES", 8)
    assert sorted((tuple(r) for r in treap.search(index, items, 3).collect()), key=repr) == brute(docs, ITEMS, 3)
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    c.executemany("INSERT INTO benchmark VALUES (?, ?)", ITEMS)
    assert sorted(c.execute(f"SELECT item_id, rank, doc_id, score FROM ({treap.ORACLE})").fetchall(), key=repr) == got


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert treap.search(treap.build(docs), items).count() == 0
    some = spark.createDataFrame([(1, "w1")], "doc_id long, text string")
    assert treap.search(treap.build(some), items.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 300), st.integers(0, 40)), st.integers(1, 1000), min_size=1, max_size=120))
def test_treap_holds_its_points(points):
    rows, cols = (np.array([p[i] for p in points]) for i in (0, 1))
    levels, sizes, quarters, drops = treap.grid(rows, cols, np.array(list(points.values())))
    child, best = treap.opened(levels, sizes, quarters, drops)
    assert best[0] == max(points.values()) and sizes[-1] == len(points)

    def walk(cell, level, row, col):
        if level == levels:
            yield (row, col), int(best[cell])
            return
        for q in range(4):
            to = child[4 * cell + q]
            if to >= 0:
                assert best[to] <= best[cell]
                yield from walk(to, level + 1, 2 * row + q // 2, 2 * col + q % 2)

    assert dict(walk(0, 0, 0, 0)) == points


def test_many_items_go_down_in_parts(spark, monkeypatch):
    """Twelve times the items take hardly more memory, and parts of any size give the same hits."""
    table, *_ = treap.build(spark.createDataFrame(corpus(), "doc_id long, text string").coalesce(1))
    batches = table.toArrow().to_batches()
    rng = random.Random(3)
    items = [[(f"w{j}".encode(), rng.randrange(1, 3000)) for j in rng.sample(range(40), 20)] for _ in range(60)]

    def found(items):
        tracemalloc.start()
        rows = sorted(r for b in treap._search(items, 50)(iter(batches)) for r in zip(*(b.column(c).to_pylist() for c in ("item", "score"))))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows, peak

    monkeypatch.setattr(treap, "TOGETHER", 1200)
    few, small = found(items)
    many, large = found(items * 12)
    assert [(i + 60 * k, s) for k in range(12) for i, s in few] == many and len(few) > 2000
    assert large < 2.5 * small
    for together in (1, 70):
        monkeypatch.setattr(treap, "TOGETHER", together)
        assert found(items)[0] == few


def test_blocks_are_stored_in_small_row_groups(spark, monkeypatch):
    monkeypatch.setattr(treap, "BLOCK_DOCS", 4)
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(f"{rng.randrange(1 << 40):x}" for _ in range(20_000))) for i in range(48)], "doc_id long, text string").coalesce(1)
    table, *_ = treap.build(docs)
    groups = [f.row_group(i) for x in table.inputFiles() for f in [pq.ParquetFile(x.removeprefix("file:")).metadata] for i in range(f.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 12 and max(g.num_rows for g in groups) < 6
