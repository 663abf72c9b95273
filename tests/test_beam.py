"""Best ways through trees of searches, against listing all of them."""

import random
from itertools import product

from thicket.operators import beam

COLUMNS = "run long, state long, task long, up long, side int, depth int, delta double"


def grown(rng, run, depth=0, up=None, side=None, counter=None):
    """States of a search and of what lies below, each search with one to three alternatives."""
    counter = counter if counter is not None else [0, 0]
    counter[1] += 1
    task, rows = counter[1], []
    for _ in range(rng.randrange(1, 4 if depth < 2 else 3)):
        counter[0] += 1
        state = counter[0]
        rows.append((run, state, task, up, side, depth, float(rng.randrange(-6, 1))))
        for s in (0, 1):
            if depth < 2 and rng.random() < 0.6:
                rows += grown(rng, run, depth + 1, state, s, counter)
    return rows


def ways(rows, task):
    found = []
    for _, state, _, _, _, _, delta in [r for r in rows if r[2] == task]:
        subs = sorted({r[2] for r in rows if r[3] == state})
        for parts in product(*[ways(rows, t) for t in subs]):
            found.append((delta + sum(v for v, _ in parts), sorted([state] + [x for _, w in parts for x in w])))
    return found


def test_best_ways_equal_all_ways(spark):
    rng = random.Random(3)
    trees = {run: grown(rng, run) for run in range(25)}
    states = spark.createDataFrame([r for rows in trees.values() for r in rows], COLUMNS)
    for keep in (500, 4):
        got = {}
        for r in beam.universes(states, keep).collect():
            got.setdefault(r.run, []).append((r.place, r.value, r.way))
        for run, rows in trees.items():
            want = sorted(ways(rows, 1))[:keep]
            assert [v for _, v, _ in sorted(got[run])] == [v for v, _ in want]
            assert all((v, w) in ways(rows, 1) for _, v, w in got[run])
            if keep == 500:
                assert [(v, w) for _, v, w in sorted(got[run])] == want
    best = beam.universes(states)
    opened = {(r.run, r.state) for r in beam.followed(states, best, 2).filter("open").collect()}
    assert opened == {(run, s) for run, rows in trees.items() for _, w in sorted(ways(rows, 1))[:2] for s in w}
    assert beam.universes(states.limit(0)).count() == 0
