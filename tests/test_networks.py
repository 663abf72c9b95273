"""Networks: folding and unfolding, extended Newick, and matching, by round trips and against brute force."""

import random
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thicket.functions import folds
from thicket.functions.storage import stored
from thicket.functions.trees import parse_newick
from thicket.operators import canon, network
from thicket.plans.queries import QUERIES
from thicket.sources import corpus, newick

from test_sweep import grown

RELATED = ["((A,B),((B,A),C));", "((((a,b),c),d),(((b,a),c),e));", "((a,(b,b)),(a,(b,b)));", "(A,(B,C));", "A;", "((((x,y),z),(y,x)),((x,y),w));"]


def folded(spark, texts):
    parsed = stored(newick.parse(spark.createDataFrame(list(enumerate(texts)), "tree_id long, newick string")))
    trees = stored(network.named_trees(parsed))
    return trees, *(stored(x) for x in network.fold(trees))


def subtrees(t, u=0):
    """Every subtree's form, children in order."""
    own = t.name[u] if not t.children[u] else "(" + ",".join(sorted(subtrees(t, c)[0] for c in t.children[u])) + ")"
    return [own] + [x for c in t.children[u] for x in subtrees(t, c)]


def test_fold_unfold_and_extended_newick(spark):
    rng = random.Random(8)
    texts = RELATED + [grown(rng, [rng.choice("ABC") for _ in range(rng.randrange(1, 9))]) for _ in range(30)]
    trees, nodes, edges = folded(spark, texts)
    sizes = {r.net_id: r.asDict() for r in network.measures(nodes, edges).collect()}
    for k, text in enumerate(texts):
        t = parse_newick(text)
        forms = {}
        for u in t.by_post:
            forms.setdefault(subtrees(t, u)[0], u)
        into = {}
        for u in forms.values():
            for c in t.children[u]:
                into[subtrees(t, c)[0]] = into.get(subtrees(t, c)[0], 0) + 1
        assert sizes[k] == {"net_id": k, "n_nodes": len(forms), "n_edges": sum(into.values()), "n_reticulations": sum(x > 1 for x in into.values()), "n_in": sum(x for x in into.values() if x > 1)}
    form = lambda x: {r.tree_id: r.signature for r in canon.folded(x, ["tree_id"]).collect()}
    assert form(network.unfold(nodes, edges)) == form(trees)
    written = stored(network.write(nodes, edges))
    again = network.read(written)
    assert form(network.unfold(*(stored(x) for x in again))) == form(trees)
    assert {r.net_id: r.asDict() for r in network.measures(*again).collect()} == sizes
    assert written.filter("net_id = 3").first().newick.count("#") == 0


def test_given_network(spark):
    """One reticulation over the leaf e, written and read."""
    text = "((a,(b,(e)#H1)),(c,(#H1,d)));"
    nodes, edges = (stored(x) for x in network.read(spark.createDataFrame([(0, text)], "net_id long, newick string")))
    assert [r.leaves for r in network.below_reticulations(nodes, edges).collect()] == [["e"]]
    (names,) = [r.names for r in network.unfold(nodes, edges).collect()]
    assert sorted(names) == list("abcdee")
    deep = {r.depth for r in network.depths(nodes, edges).join(nodes.filter("name = 'e'"), ["net_id", "node"]).collect()}
    assert deep == {3}
    loop = spark.createDataFrame([(0, "r", "x", 1), (0, "x", "y", 1), (0, "y", "x", 1)], "net_id long, src string, dst string, n long")
    with pytest.raises(ValueError, match="cycle"):
        network.depths(spark.createDataFrame([(0, x, None) for x in "rxy"], "net_id long, node string, name string"), loop)


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.randoms(use_true_random=False))
def test_best_assignment(n, m, rng):
    weight = [[rng.randrange(0, 6) / 5 for _ in range(m)] for _ in range(n)]
    found = network.best_assignment(weight)
    assert len(found) == min(n, m) and len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
    if n <= m:
        best = max(sum(weight[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n))
    else:
        best = max(sum(weight[i][j] for j, i in enumerate(p)) for p in permutations(range(n), m))
    assert sum(weight[i][j] for i, j in found) == pytest.approx(best)


def test_matching_and_matrix(spark):
    sets = spark.createDataFrame([(1, ["a", "b"]), (1, ["c"]), (2, ["a"]), (2, ["c", "d"]), (2, ["x"]), (3, ["a", "b"])], "net_id long, leaves array<string>")
    nets = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5)], "net_id long")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (4, 5), (4, 1), (1, 4)], "a long, b long")
    got = {(r.a, r.b): tuple(round(x, 6) for x in (r.distance, r.fp, r.fn, r.tp)) for r in network.matched(sets, pairs).collect()}
    # {a,b} with {a}, {c} with {c,d}, one left in 2.
    assert got == {(1, 2): (0.666667, 0.5, 0.166667, 0.333333), (2, 1): (0.666667, 0.166667, 0.5, 0.333333), (1, 1): (0, 0, 0, 1), (4, 5): (0, 0, 0, 1), (4, 1): (1, 1, 0, 0), (1, 4): (1, 0, 1, 0)}
    full = {(r.a, r.b): r.distance for r in network.matrix(nets, sets).collect()}
    assert len(full) == 25 and all(full[a, b] == full[b, a] for a, b in full) and all(full[k, k] == 0 for k in range(1, 6))


def test_sets_below_reticulations(spark):
    _, nodes, edges = folded(spark, RELATED)
    got = {}
    for r in network.below_reticulations(nodes, edges).collect():
        got.setdefault(r.net_id, []).append("".join(r.leaves))
    assert {k: sorted(v) for k, v in got.items()} == {0: ["AB"], 1: ["abc"], 2: ["ab", "b"], 5: ["xy"]}
    assert nodes.select(F.count_if(F.col("name").isNotNull())).first()[0] == 3 + 5 + 2 + 3 + 1 + 4


def test_trees_in_rows_are_folded_as_tables_are(spark):
    rng = random.Random(9)
    texts = RELATED + [grown(rng, [rng.choice("ABCD") for _ in range(rng.randrange(1, 12))]) for _ in range(60)]
    trees, nodes, edges = folded(spark, texts)
    want = {r.net_id: tuple(r)[1:] for r in network.measures(nodes, edges).collect()}
    assert {r.tree_id: tuple(r)[1:] for r in network.tree_measures(trees).collect()} == want
    want = {}
    for r in network.below_reticulations(nodes, edges).collect():
        want.setdefault(r.net_id, []).append(r.leaves)
    assert {r.tree_id: r.sets for r in network.tree_sets(trees).collect() if r.sets} == {k: sorted(v) for k, v in want.items()}
    parsed = newick.parse(spark.createDataFrame(list(enumerate(texts)), "tree_id long, newick string"))
    want = network.reticulations(parsed).groupBy("tree_id").agg(F.count("*"), F.sum("n_copies"), F.sum("n_leaves"))
    assert {tuple(r) for r in network.tree_copies(trees).collect() if r.n_reticulations} == {tuple(r) for r in want.collect()}
    assert {r.tree_id for r in network.round_trips(trees).collect() if r.same} == set(range(len(texts)))
    read = network.read(network.write(nodes, edges))
    want = {r.tree_id: sorted(r.names) for r in network.unfold(*(stored(x) for x in read)).collect()}
    for r in trees.collect():
        names, spans = folds.unfolded(*folds.parsed(folds.text(*folds.network(folds.Forms(), r.names, [(x.lo, x.hi) for x in r.nodes]))))
        assert sorted(names) == want[r.tree_id] and len(spans) == len(r.nodes)


def test_a_changed_network_does_not_come_back(monkeypatch):
    spans = folds.balanced(4)
    assert folds.comes_back(folds.Forms(), list("abab"), spans)
    parsed = folds.parsed
    monkeypatch.setattr(folds, "parsed", lambda text: parsed(text.replace("b", "c")))
    assert not folds.comes_back(folds.Forms(), list("abab"), spans)


def test_shapes(spark):
    sizes = spark.createDataFrame([(n,) for n in range(1, 40)], "gt_id long")
    leaves = sizes.select("gt_id", F.explode(F.expr("sequence(1, int(gt_id))")).alias("place"))
    want = {}
    for r in corpus.balanced_nodes(leaves).collect():
        want.setdefault(r.tree_id, set()).add((r.lo, r.hi))
    assert {n: set(folds.balanced(n)) for n in range(1, 40)} == want and all(len(folds.balanced(n)) == 2 * n - 1 for n in range(1, 40))
    assert folds.balanced(3) == ((0, 2), (0, 1), (0, 0), (1, 1), (2, 2)) and folds.comb(3) == ((0, 2), (0, 1), (0, 0), (1, 1), (2, 2)) and folds.comb(1) == ((0, 0),)


@pytest.mark.parametrize("name, most", [("tree_containment", 1), ("network_folds", 1), ("network_round_trip", 1), ("reticulation_leaves", 2), ("balanced_networks", 1)])
def test_lineitems_are_shuffled_once(spark, name, most):
    """A row an order is made by one shuffle, nothing of a tree's nodes is shuffled; one more adds up what is found."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Those of the 25 nations' and five regions' rows go beside.
    few = ("n_regionkey", "(region#", "(0#")
    assert sum("Exchange hashpartitioning" in x and not any(f in x for f in few) for x in plan.splitlines()) == most


def test_orders_leaves_in_rows(spark):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in corpus.placed_leaves(spark, sf).orderBy("gt_id", "leaf").collect():
        want.setdefault(r.gt_id, []).append((r.nation, r.pos))
    got = {c: {r.tree_id: r.leaves for r in corpus.order_leaves(spark, sf, c).collect()} for c in ("nation", "pos")}
    assert {k: list(zip(v, got["pos"][k])) for k, v in got["nation"].items()} == want


def test_matching_equals_tables(spark):
    """network_matching, whose sets are made in rows, against sets from tables of nodes and edges."""
    from thicket.plans import balanced, queries

    sf = "/root/testdata/sf0.001"
    nodes, leaves = balanced.tables(spark, sf)
    listed = newick.listed(nodes, leaves.select("tree_id", "leaf", F.col("nation").alias("pos")), ["tree_id"])
    trees = stored(listed.select("tree_id", F.transform("pos", lambda x: x.cast("string")).alias("names"), "nodes"))
    sets = network.below_reticulations(*(stored(x) for x in network.fold(trees)))
    want = {(r.a, r.b): tuple(round(x, 6) for x in tuple(r)[2:]) for r in network.matched(sets, queries.next_orders(spark, sf)).collect()}
    assert {(r.a, r.b): tuple(r)[2:] for r in QUERIES["network_matching"](spark, sf).collect()} == want and len(want) > 1000
