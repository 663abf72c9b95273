"""The Jaccard join against all pairs."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm import jaccard
from thicket.llm.common import shared_folder

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text, n):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def brute(rows, n, percent):
    sets = [(i, shingle_set(x, n)) for i, x in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            p, q = sets[a][1], sets[b][1]
            if p and q and 100 * len(p & q) >= percent * len(p | q):
                parent[find(a)] = find(b)
    out = []
    for a, (i, s) in enumerate(sets):
        mates = [sets[b][0] for b in range(len(rows)) if find(b) == find(a) and sets[b][0] is not None]
        out.append((i, len(s), min(mates) if s and mates else i))
    return sorted(out, key=lambda r: (r[0] is None, r))


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    out = ["", None, " \n", "one", "One two", "one TWO", "a b c", "a b c", "a b c d"]
    shared = [word() for _ in range(30)]
    for _ in range(12):
        out.append(" ".join([word() for _ in range(rng.randrange(3, 90))] + shared))
    for _ in range(4):
        line = [word() for _ in range(rng.choice([25, 60, 140]))]
        for _ in range(25):  # chains too: each copy is made from the one before
            copy = list(line)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
            line = copy if rng.random() < 0.4 else line
    return out + out[-2:]


@pytest.mark.parametrize("seed, n, percent", [(1, 3, 90), (2, 5, 80), (3, 3, 60)])
def test_against_all_pairs(spark, seed, n, percent):
    rows = [(i, x) for i, x in enumerate(texts(seed))] + [(None, "a b c"), (5, "one TWO"), (3, "other words entirely here")]
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, n_shingles int, token string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(docs, n, percent).collect()), key=lambda r: (r[0] is None, r))
    assert got == brute(rows, n, percent)


def test_frequent_tokens_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "OFTEN", 2)
    monkeypatch.setattr(jaccard, "MULTIPLE", 0)
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    monkeypatch.setattr(jaccard, "UNBANDED", 0)
    rows = [(i, x) for i, x in enumerate(texts(4))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert got == brute(rows, 3, 90)


def test_small_groups_are_paired_at_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 3)
    entries = [(1, 10, 7), (2, 10, 7), (3, 10, 7), (4, 20, 8), (5, 10, 8), (6, 5, 9)] + [(i, 10, 5) for i in range(20, 25)]
    rows = jaccard._paired(spark.createDataFrame(entries, "id long, n long, token long"), 90).collect()
    assert {(r.id, i) for r in rows if r.token is None for i, _ in r.others} == {(1, 2), (1, 3), (2, 3)}
    assert sorted((r.token, r.id, r.n, [i for i, _ in r.others]) for r in rows if r.token is not None) == [(5, i, 10, [20] if i > 20 else []) for i in range(20, 25)]


def test_least_shared_tokens_of_prefixes(spark):
    rng, rank = random.Random(9), np.zeros(1 << jaccard.BUCKET_BITS, np.uint16)
    for percent in (60, 80, 90):
        for _ in range(60):
            x = [rng.randrange(1 << 64) for _ in range(rng.randrange(1, 200))]
            y = [t for t in x if rng.random() < 0.97] + [rng.randrange(1 << 64) for _ in range(rng.randrange(6))]
            common = len(set(x) & set(y))
            if not y or 100 * common < percent * (len(x) + len(y) - common):
                continue
            p, q = (jaccard.prefixes(np.unique(np.array(s, np.uint64)), rank, percent, (0,))[0] for s in (x, y))
            sizes = spark.range(1).select(F.lit(min(len(x), len(y))).alias("nx"), F.lit(max(len(x), len(y))).alias("ny"))
            assert len(np.intersect1d(p, q)) >= sizes.select(jaccard.least_shared(percent)).first()[0]


def test_ranks_are_gathered_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GATHERED", 64)
    rows = [(bytes(jaccard.shingles(b"a b c d e f g h i j", 3).tobytes()),)] * 40
    rank = jaccard._ranks(spark.createDataFrame(rows, "tokens binary").coalesce(1))
    assert sorted(rank[rank > 0].tolist()) == [40] * 8


def test_no_rows_and_one_of_each(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.link(none).collect() == []
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, ""), (4, ""), (None, "a b c")], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in jaccard.one_of_each(docs).collect()) == [1, 3, 4]
    again = spark.createDataFrame([(7, "x y z", "clash"), (7, "other words", "clash"), (8, "x y z", None), (None, "p q", None), (None, "p q", None)], "doc_id long, text string, n_shingles string")
    left = jaccard.one_of_each(again)
    assert left.columns == again.columns and sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "p q"), (7, "other words"), (7, "x y z")]


def test_large_sets_are_told_apart_by_the_wider_bitmap(spark, monkeypatch):
    """Two sets of 3,000 tokens that share two fifths: prefixes meet and the small bitmap is full."""
    compared, plain = [], jaccard._linked
    monkeypatch.setattr(jaccard, "_linked", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    rows = [(k, " ".join(words("same", 1200) + words(name, 1800))) for k, name in enumerate("ab")]
    got = sorted(tuple(r) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), 1, 60).collect())
    assert got == brute(rows, 1, 60) == [(0, 3000, 0), (1, 3000, 1)] and not compared
    rows.append((2, " ".join(words("same", 1200) + words("b", 1700))))
    got = sorted(tuple(r) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), 1, 60).collect())
    assert got == brute(rows, 1, 60) and compared == [1]


def test_scratch_tables_go(spark):
    rows = [(i, x) for i, x in enumerate(texts(4))]
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    left = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert len({x for x in os.listdir(folder) if x.startswith("table-")} - before) == 1  # what the result reads
    assert left.count() == len({c for _, n, c in brute(rows, 3, 90) if n}) + sum(not n for _, n, _ in brute(rows, 3, 90))
