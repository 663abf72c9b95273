"""Chat collapse and exact search against plain Python."""

import math
import random

import numpy as np

from thicket.llm import chat, topk


def rendered(turns):
    return "".join(f"<|{(r or 'unknown').replace('<|', '< |')}|>\n{(t or '').replace('<|', '< |')}<|end|>\n" for _, r, t in turns)


def test_collapse(spark):
    rng = random.Random(2)
    rows = []
    for c in range(60):
        line = [(k, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "", None, "x<|end|>"])) for k in range(rng.randrange(1, 5))]
        rows += [(c, *t, 9) for t in line]
        rows += [(c + 100, *t, 9) for t in line[: rng.randrange(1, len(line) + 1)]]
    rows += [rows[0], (None, 0, "user", "lost", 9), (7000, None, "a", "b", 9), (7000, 1, "a", "b", 9), (7000, 1, "a", "a", 9)]
    got = sorted((r.conv_id, r.n_turns, r.n_copies, r.text) for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int").repartition(4)).collect())
    key = lambda t: tuple((x is not None, x) for x in t)
    convs = {}
    for c, *t, _ in rows:
        if c is not None:
            convs.setdefault(c, set()).add(tuple(t))
    convs = {c: sorted(t, key=lambda x: [(v is not None, v if v is not None else 0) for v in x]) for c, t in convs.items()}
    seq = {c: [t[1:] for t in ts] for c, ts in convs.items()}
    want = []
    for c, s in seq.items():
        same = [d for d in seq if seq[d] == s]
        if c == min(same) and not any(len(o) > len(s) and o[: len(s)] == s for o in seq.values()):
            want.append((c, len(s), len(same), rendered(convs[c])))
    assert got == sorted(want)
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.1, 0.3, 0.999]) for _ in range(6)], 0) for i in range(-120, 300)]
    rows += [(400 + i, rows[7][1], 0) for i in range(60)] + [(500, None, 0), (550, [float("nan")] * 6, 0), (600, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (650, [math.inf] * 6, 0), (700, [], 0), (750, [0.5, 0.5], 0), (800, [0.1, 0.2], 0), (None, [0.1] * 6, 0)]
    rows += [rows[20], rows[25], (-100, [0.3] * 6, 0), (130, [0.999] * 6, 0), (130, [0.1] * 6, 0)]  # rows that share an id, queries among them
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    assert answers(topk.top_k(docs, row_block=70, query_block=3)) == brute_top(rows, np.float32)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def answers(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def brute_top(rows, number):
    """What top_k gives, one query after the other; a score is the nearest long."""
    ints = [(i, [math.floor(256 * float(number(x))) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    near = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = []
    for at, (q, a) in enumerate(ints):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), c) for other, (c, b) in enumerate(ints) if other != at and len(a) == len(b))[:5]
            want += [(q, k + 1, c, near(-s)) for k, (s, c) in enumerate(best)]
    return sorted(want)


def test_top_k_rows_of_one_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.1, 0.0]), (1, [0.9, 0.0]), (2, [0.5, 0.0])]
    got = answers(topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == [(0, 1, 1, 58880), (0, 2, 2, 32768), (0, 3, 1, 6400)]


def test_top_k_large_components(spark):
    rng = random.Random(5)
    sizes = [0.5, 3.0, 4e4, 1e9, 1e12, 1e30, 1e300]
    rows = [(i, [rng.uniform(-1, 1) * rng.choice(sizes[: 1 + i % len(sizes)]) for _ in range(3)]) for i in range(160)]
    rows += [(200, [40000.0, 0.0, 0.0]), (250, [1.7e308, 0.0, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert answers(topk.top_k(docs, row_block=40, query_block=3)) == brute_top(rows[:-1], float)
