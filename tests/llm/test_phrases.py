"""Phrases against SQL and against counting all of them, and the summaries' guarantee."""

import collections
import random
import re

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thicket.llm import phrases

AWKWARD = [(None, "en"), ("", None), ("Ünïcode WORD word\ttab, end.\x0bnext", None), (" ... !!! ", "de"), ("a", "en")]


def texts(n=300, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Éa", "B", "b"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(n):
        parts = rng.choices(words, weights, k=rng.randrange(1, 40))
        rows.append(("".join(w + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for w in parts), rng.choice(["en", "en", "en", "fr", None])))
    return rows + [("very common phrase here now. " * 3000, "en")] + AWKWARD


def brute(rows, least, best):
    f, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                f.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    f = {k: v for k, v in f.items() if v >= least}
    longer = collections.Counter()
    for (lang, w), a in f.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                longer[lang, w[i : i + n]] = max(a, longer[lang, w[i : i + n]])
    out = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) > 1 and 100 * longer[lang, w] < 80 * a:
            score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:best]))


def test_mined_phrases_equal_counting_and_sql(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({"phrase": F.lit(1), "n": F.lit(2)}).repartition(5)
    got = sorted(tuple(r) for r in phrases.mine(docs).collect())
    assert got == brute(rows, 30, 2000) and len(got) > 20
    few = sorted(tuple(r) for r in phrases.mine(docs, least=4, best=7, bits=15, counters=20).collect())
    assert few == brute(rows, 4, 7)
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(c.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({phrases.ORACLE})").fetchall()) == got


def test_empty_table(spark):
    assert phrases.mine(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_counts_past_64_bits(spark):
    big = 9 * 10**17
    counts = spark.createDataFrame([("x", "a b", big, 2), ("x", "a", big, 1), ("x", "b", big + 2, 1)], "lang string, phrase string, f long, m int")
    row = phrases.scored(counts, spark.createDataFrame([("x", 5 * big)], "lang string, n long")).first()
    assert (row.score, row.l, row.r) == (2000000 * big // (2 * big + 2), big, big + 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=600), st.integers(2, 9), st.integers(1, 5))
def test_every_frequent_name_survives(stream, least, tasks):
    """Summaries of parts of a stream, merged in turn: what comes up `least` times is still there."""
    capacity = len(stream) // least + 1
    names, counts, taken = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for k in range(tasks):
        part, n = np.unique(np.array(stream[k::tasks], np.uint64), return_counts=True)
        names, counts = phrases._summed(np.concatenate([names, part]), np.concatenate([counts, n.astype(np.int64)]))
        names, counts, by = phrases.lowered(names, counts, capacity)
        taken += by
        assert len(names) <= capacity
    assert taken < least and all(collections.Counter(stream)[x] <= n + taken for x, n in zip(names.tolist(), counts.tolist()))
    assert {x for x, n in collections.Counter(stream).items() if n >= least} <= set(names.tolist())
