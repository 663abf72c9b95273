"""Suffix-tree scoring: counts, base and scores by plain Python, a proper distribution, and better held-out scores on ordered text."""

import random
import re
import zlib
from collections import Counter
from dataclasses import replace
from functools import lru_cache
from math import log, log10

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from thicket.llm import suffix_model

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lower), " "]


def made(n, seed=3):
    rng = random.Random(seed)
    follows = {w: rng.sample(range(30), 3) for w in range(30)}
    out = []
    for _ in range(n):
        w, line = rng.randrange(30), []
        for _ in range(rng.randrange(5, 60)):
            line.append(f"W{w}" if rng.random() < 0.5 else f"w{w}")
            w = rng.choice(follows[w]) if rng.random() < 0.9 else rng.randrange(30)
        out.append(rng.choice([" ", "\n", "\t\x0b"]).join(line) + rng.choice(["", f" rare{rng.randrange(500)}"]))
    return out


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Plain:
    """The model by its definition, a context at a time."""

    def __init__(self, texts, s):
        self.s, grams = s, Counter()
        for line in map(tokens, texts):
            for n in range(1, s.depth + 2):
                grams.update(tuple(line[i : i + n]) for i in range(len(line) - n + 1))
        self.count, self.states = grams, {}
        self.total = sum(c for g, c in grams.items() if len(g) == 1)
        self.distinct = sum(len(g) == 1 for g in grams)
        for length in range(1, s.depth + 1):
            for c in [g for g, n in grams.items() if len(g) == length and n >= s.least_context and g[-1] != " "]:
                self.test(c)

    def test(self, c):
        s, n = self.s, self.count[c]
        named = {g[-1]: m for g, m in self.count.items() if len(g) == len(c) + 1 and g[:-1] == c and m >= s.least_successor}
        above = {w: self.probability(w, c[1:]) for w in named}
        rest, rest_above = 1 - sum(named.values()) / n, 1 - sum(above.values())
        entropy = sum(m / n * log(m / n / above[w]) for w, m in named.items()) + (rest * log(rest / rest_above) if rest > 1e-15 else 0)
        if named and 2 * n * entropy > s.divergence * len(named):
            p = {w: (m + s.strength * above[w]) / (n + s.strength) for w, m in named.items()}
            self.states[c] = p, (1 - sum(p.values())) / rest_above

    def probability(self, w, c):
        for k in range(len(c)):
            if c[k:] in self.states:
                p, left = self.states[c[k:]]
                return p[w] if w in p else left * self.probability(w, c[k + 1 :])
        return (self.count[w,] + 1) / (self.total + self.distinct + 1)

    def score(self, text):
        line = tokens(text)
        return sum(log10(self.probability(w, tuple(line[max(0, i - self.s.depth) : i]))) for i, w in enumerate(line))


TEXTS = [*made(300), "", None, "   ", "É é x", "only once", "w1 w2 " * 5000]
ROWS = [(i, x, 1) for i, x in enumerate(TEXTS)] + [(7, TEXTS[7], 1), (None, "w1 w2", 1)]
#: A tiny share puts all words and n-grams in the head, a large one nearly all in the joins.
SETTINGS = [
    suffix_model.Settings(depth=2, least_context=20, least_successor=2, strength=5.0, head_share=0.02),
    suffix_model.Settings(depth=3, least_context=8, least_successor=1, strength=5.0, head_share=1e-9),
]


@lru_cache
def plain(s):
    return Plain([x for i, x, _ in ROWS if i is not None and not held(i)], s)


@pytest.fixture(scope="module", params=SETTINGS, ids=["depth2", "depth3"])
def scored(spark, request):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, score int").repartition(3)
    with pytest.MonkeyPatch.context() as changed:
        if request.param.depth == 3:  # contexts in several parts, parts from several chunks
            changed.setattr(suffix_model, "GRAM_BUFFER", 100)
            changed.setattr(suffix_model, "SLICE", 7)
        return request.param, suffix_model.score_documents(docs, request.param).collect()


def test_counts_base_and_score(scored):
    s, got = scored
    model = plain(s)
    assert {len(c) for c in model.states} == set(range(1, s.depth + 1))
    key = lambda r: (r[0], r[2])
    want = []
    for i, x, _ in ROWS:
        t = tokens(x)
        base = sum(log10((model.count[w,] + 1) / (model.total + model.distinct + 1)) for w in t)
        want.append((-1 if i is None else i, held(i), len(t), sum(model.count[w,] > 0 for w in t), model.total, base, model.score(x)))
    have = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    for a, b in zip(sorted(have, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-6)


def test_order_helps(scored):
    _, got = scored
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.1 * sum(r.n_tokens for r in out)


@pytest.mark.parametrize("s", SETTINGS)
def test_proper_distribution(s):
    model = plain(s)
    words = [g[0] for g in model.count if len(g) == 1]
    for c in [(), *list(model.states)[::17]]:
        assert abs(sum(model.probability(w, c) for w in [*words, "never seen"]) - 1) < 1e-9


def test_states_grow_with_the_corpus(spark):
    """Least counts don't move with the size: what is learned from a part stays in the whole."""
    s, found = suffix_model.Settings(least_context=30, least_successor=2), []
    for n in (100, 400):
        docs = spark.createDataFrame([(i, x) for i, x in enumerate(made(n))], "doc_id long, text string")
        counts = suffix_model.stored(suffix_model.count_words(docs))
        found.append(suffix_model.grow(docs, counts, s).weights.count())
    assert found[1] > 1.5 * found[0]


def test_no_rows_and_no_training(spark):
    assert suffix_model.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = suffix_model.score_documents(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.base_score, one.score) == (3, 0, 0, 0.0, 0.0)


def test_frequent_grams_are_looked_up_inside_tasks(spark):
    """The most frequent words and n-grams go by number, not only by share, and where they are looked up changes no score."""
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(made(300))], "doc_id long, text string")
    few = suffix_model.Settings(least_context=20, least_successor=2, head_share=0.05, head_words=0, head_grams=0)
    some, all_of_them = replace(few, head_words=20, head_grams=60), replace(few, head_words=10**6, head_grams=10**6)
    counts = suffix_model.stored(suffix_model.count_words(docs))
    tree, found, left = suffix_model.grow(docs, counts, few), [], []
    for s in (few, some, all_of_them):
        docs_held = docs.withColumn("held_out", suffix_model.F.lit(False))
        found.append({r.doc_id: (r.n_known, r.base_score, r.score) for r in suffix_model.scored(docs_held, counts, tree, s).collect()})
        least = [suffix_model.head_least(counts, s.head_words, 0.05 * tree.total), suffix_model.head_least(tree.weights, s.head_grams, 0.05 * tree.total)]
        partly = suffix_model._partly_scored(docs_held, counts, tree, s, *least)
        left.append(partly.selectExpr("sum(size(rare))", "sum(size(grams))").first())
    assert left[0][0] > left[1][0] > left[2][0] == 0 and left[0][1] > left[1][1] > left[2][1] == 0
    for other in found[1:]:
        for i, want in found[0].items():
            assert other[i] == pytest.approx(want, abs=1e-6)


def test_counting_rows_follow_tasks_not_contexts(spark, monkeypatch):
    """A task sends one row for each range of contexts, however many contexts there are."""
    monkeypatch.setattr(suffix_model, "BUCKET_BITS", 2)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(made(300))], "doc_id long, text string").coalesce(1)
    words = suffix_model.hashed([w for w, _ in Counter(t for x in made(300) for t in tokens(x)[:-1]).most_common(40) for w in [w.encode()]]).view("int64").tolist()
    contexts = spark.createDataFrame([(w, 1000) for w in words], "ctx long, n_ctx long")
    below = spark.createDataFrame([(w,) for w in words], "key long")
    rows = []
    plain = DataFrame.repartition

    def spied(df, *args):
        if args == ("bucket",):
            rows.append(df.count())
        return plain(df, *args)

    monkeypatch.setattr(DataFrame, "repartition", spied)
    got = {(r.ctx, r.word): r.n for r in suffix_model._successors(docs, 1, contexts, below, 3, 1000).collect()}
    want = Counter()
    for x in made(300):
        line = suffix_model.hashed(suffix_model.tokens_of(x.encode())).view("int64").tolist()
        want.update((a, b) for a, b in zip(line, line[1:]) if a in words and b in words)
    assert rows == [4]
    kept = {k: n for k, n in got.items() if k in want}
    assert kept == {k: n for k, n in want.items() if n >= 3}


def test_looked_up_keys():
    """The index leads to every key, the smallest and largest too, and to none that isn't there."""
    rng = np.random.default_rng(5)
    top = np.uint64(2**64 - 1)
    for keys in (np.array([0], np.uint64), np.array([top], np.uint64), np.append(np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64)), top), np.arange(40, dtype=np.uint64) + np.uint64(2**63)):
        wanted = np.concatenate([keys, keys + np.uint64(1), keys - np.uint64(1), np.array([0, top], np.uint64)])
        at, hit = suffix_model.looked_up(keys, suffix_model.key_index(keys), wanted)
        assert hit.tolist() == np.isin(wanted, keys).tolist() and (keys[at[hit]] == wanted[hit]).all()
