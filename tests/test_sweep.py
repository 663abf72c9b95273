"""The sweep over cost vectors, units by every rule, and pins, against candidates built one by one."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.functions import costs, trees
from thicket.functions.storage import stored
from thicket.functions.trees import parse_newick
from thicket.operators import canon, sweep
from thicket.sources import newick

import brute_trees
from test_trees import GENES, S, TOTALS

WEIGHTED = "family long, newick string, weight long"
SPECIES = "family long, newick string"


def grown(rng, names):
    """A tree of these leaves, any shape."""
    while len(names) > 1:
        a, b = rng.sample(range(len(names)), 2)
        names = [x for i, x in enumerate(names) if i not in (a, b)] + [f"({names[a]},{names[b]})"]
    return names[0] + ";"


def test_whole_species_tree_of_25_leaves(spark):
    rng = random.Random(12)
    names = [f"S{i}" for i in range(25)]
    text = grown(rng, names)
    genes = [grown(rng, [f"g{i}_{rng.choice(names[:9] if k % 2 else names)}" for i in range(rng.randrange(1, 9))]) for k in range(12)]
    s = parse_newick(text)
    got = {(r.h, r.t): r.score for r in sweep.score_newicks(spark.createDataFrame([(0, g, 1 + k % 2) for k, g in enumerate(genes)], WEIGHTED), spark.createDataFrame([(0, text)], SPECIES)).collect()}
    pairs = brute_trees.candidates(s)
    assert len(got) == len(pairs) + 1
    parsed = [parse_newick(g) for g in genes]
    for h, t in rng.sample(pairs, 60):
        # Nodes of the brute force are in the order they are read, which is preorder.
        assert got[h, t] == sum((1 + k % 2) * brute_trees.score(g, s, (h, t)) for k, g in enumerate(parsed)), (h, t)
    assert got[None, None] == sum((1 + k % 2) * brute_trees.score(g, s, None) for k, g in enumerate(parsed))


def test_exact_rule_and_weights_of_costs(spark):
    weighted, species = spark.createDataFrame([(0, g, 1) for g in GENES], WEIGHTED), spark.createDataFrame([(0, str_of(S))], SPECIES)
    exact = {r.mt_id: r.score for r in sweep.score_newicks(weighted, species, rule="exact").collect()}
    assert [exact[k] for k in range(1, 32)] == [*TOTALS[:30], 18]
    dear = {(r.h, r.t): r.score for r in sweep.score_newicks(weighted, species, w_dup=2, w_loss=3).collect()}
    for pair in brute_trees.candidates(S):
        assert dear[pair] == sum(brute_trees.score(parse_newick(g), S, pair, 2, 3) for g in GENES)
    with pytest.raises(ValueError, match="too many"):
        sweep.score_newicks(weighted, species, most_units=30, rule="exact")
    with pytest.raises(ValueError, match="no such rule"):
        sweep.score_newicks(weighted, species, rule="loose")


def str_of(tree):
    def text(u):
        return f"({','.join(map(text, tree.children[u]))})" if tree.children[u] else tree.name[u]

    return text(0) + ";"


def test_trees_that_are_not_binary(spark):
    species = spark.createDataFrame([(0, "((A,B),C);")], SPECIES)
    for bad, reason in (("(a_A,b_B,c_C);", "unrooted"), ("((a_A,b_B,c_C),d_C);", "polytomy"), ("((a_A),b_B);", "unary")):
        with pytest.raises(ValueError, match=reason):
            sweep.score_newicks(spark.createDataFrame([(0, bad, 1)], WEIGHTED), species)
        _, _, kept, rejected = sweep.gene_tables(spark.createDataFrame([(0, bad, 2), (0, "(a_A,b_B);", 1), (0, "((", 1)], WEIGHTED), sweep.species_nodes(species))
        assert sorted((r.reason, r.weight) for r in rejected.collect()) == sorted([(reason, 2), ("no tree", 1)]) and kept.count() == 1
    for bad, reason in (("(A,B,C);", "unrooted"), ("((A,B),A);", "a species twice"), ("((", "no tree")):
        with pytest.raises(ValueError, match=reason):
            sweep.species_nodes(spark.createDataFrame([(0, bad)], SPECIES))


def test_families_over_the_limit_keep_their_rows(spark):
    weighted = spark.createDataFrame([(0, "((a_A,b_A),(c_A,d_A));", 1), (1, "(a_A,b_B);", 3)], WEIGHTED)
    species = spark.createDataFrame([(0, "(A,B);"), (1, "(A,B);")], SPECIES)
    got = sweep.score_newicks(weighted, species, most_units=2).collect()
    n = len(brute_trees.candidates(parse_newick("(A,B);"))) + 1
    assert sorted({(r.family, r.n_trees, r.n_skipped) for r in got}) == [(0, 0, 1), (1, 3, 0)] and len(got) == 2 * n
    assert all((r.score is None) == (r.family == 0) for r in got)


def as_rows(spark, texts, species):
    """Gene trees of family 0 as listed rows, with the species nodes; gt is the text's place."""
    nodes = stored(sweep.species_nodes(spark.createDataFrame([(0, species)], SPECIES)))
    parsed = stored(newick.parse(spark.createDataFrame(list(enumerate(texts)), "tree_id long, newick string")))
    tips = nodes.filter("lo = hi").select("species", F.col("lo").alias("pos"))
    key = [F.lit(0).cast("long").alias("family"), F.col("tree_id").alias("gt")]
    leaves = parsed.filter("is_leaf").join(tips, "species").select(*key, F.col("lo").alias("leaf"), "pos")
    genes = parsed.select(*key, F.col("node_id").alias("u"), F.col("parent_id").alias("parent"), "lo", "hi")
    return stored(newick.listed(genes, leaves, sweep.KEY)), nodes.drop("species")


def test_units_and_pins(spark):
    rng = random.Random(3)
    text = "((((A,B),C),D),(E,F));"
    texts = [*GENES, *[grown(rng, [f"g{i}_{rng.choice('ABCDEF')}" for i in range(rng.randrange(1, 9))]) for _ in range(15)]]
    rows, nodes = as_rows(spark, texts, text)
    s = parse_newick(text)
    found = stored(sweep.units(rows, nodes))
    got = {(r.gt, r.h, r.u) for r in found.collect()}
    parsed = [parse_newick(g) for g in texts]
    names = {h: {s.name[v] for v in s.leaves(h)} for h in s.order}
    assert got == {(k, h, u) for k, g in enumerate(parsed) for h in s.order for u in brute_trees.units(g, names[h])}
    pinned = {(r.gt, r.h, r.u, r.t): r.state for r in sweep.pins(rows, nodes, found).join(found.select("gt", "h", "unit", "u"), ["gt", "h", "unit"]).collect()}
    assert pinned == {(k, h, u, t): brute_trees.pinned(g, s, h, t, u) for k, g in enumerate(parsed) for h in s.order for u in brute_trees.units(g, names[h]) for t in s.order if t == h or not s.below(h, t)}
    free = {(r.gt, r.h, r.t): (r.n_units, r.n_free) for r in sweep.work(sweep.pins(rows, nodes, found)).collect()}
    assert all(free[k, h, h] == (len(brute_trees.units(g, names[h])),) * 2 for k, g in enumerate(parsed) for h in s.order if brute_trees.units(g, names[h]))
    # gt 4 has two genes of B side by side: apart by the engine's rule, together by the widest.
    b = next(u for u in s.order if s.name[u] == "B")
    count = lambda rule, gt, h: sweep.units(rows, nodes, rule).filter((F.col("gt") == gt) & (F.col("h") == h)).count()
    assert [count(r, 4, b) for r in sweep.RULES] == [2, 2, 1, 2] and count("engine", 0, 0) == 1 and count("exact", 0, 0) == 4


def test_canonical_forms(spark):
    rng = random.Random(6)
    texts = [grown(rng, [f"g{i}_{rng.choice('AB')}" for i in range(rng.randrange(1, 7))]) for _ in range(60)]
    rows = newick.parse(spark.createDataFrame(list(enumerate(texts)), "tree_id long, newick string"))
    nodes = rows.select("tree_id", F.col("node_id").alias("u"), F.col("parent_id").alias("parent"), "lo", "hi")
    leaves = rows.filter("is_leaf").select("tree_id", F.col("lo").alias("leaf"), F.ascii("species").alias("pos"))
    listed = newick.listed(nodes, leaves, ["tree_id"]).select("tree_id", F.transform("pos", lambda x: F.char(x)).alias("names"), "nodes")
    signed = stored(canon.folded(listed, ["tree_id"]))

    def form(t, u=0):
        return trees.species_of(t.name[u]) if not t.children[u] else "(" + ",".join(sorted(form(t, c) for c in t.children[u])) + ")"

    parsed = {k: parse_newick(x) for k, x in enumerate(texts)}
    groups = {}
    for k, t in parsed.items():
        groups.setdefault(form(t), []).append(k)
    assert sorted((r.rep, r.n_trees) for r in canon.classes(signed, "tree_id").collect()) == sorted((min(v), len(v)) for v in groups.values())
    for r in signed.collect():
        t = parsed[r.tree_id]
        by_digest = {}
        for x in r.digests:
            assert by_digest.setdefault(x.digest, form(t, x.u)) == form(t, x.u)
        assert sorted(r.leaf_order) == list(range(len(t.leaves(0))))
    pairs = spark.createDataFrame([(k, min(v)) for v in groups.values() for k in v], "tree long, rep long")
    for r in canon.corresponding(signed, "tree_id", pairs).collect():
        name = lambda k, leaf: trees.species_of(parsed[k].name[sorted(parsed[k].leaves(0), key=parsed[k].tin.__getitem__)[leaf]])
        assert name(r.tree, r.leaf) == name(r.rep, r.rep_leaf)


def test_named_donors_and_targets(spark):
    text = "((((A,B),C),D),(E,F));"
    s = parse_newick(text)
    named = stored(sweep.species_nodes(spark.createDataFrame([(0, text)], SPECIES)))
    wanted = lambda *texts: sweep.resolve(named, spark.createDataFrame([(0, x) for x in texts], "family long, text string"))
    leaf = {s.name[u]: u for u in s.leaves(0)}
    got = {r.text: r.node for r in wanted("A", "A, C", "E,F", "B,F", "<2>", "D").collect()}
    assert got == {"A": leaf["A"], "A, C": s.parent[s.parent[leaf["A"]]], "E,F": s.parent[leaf["E"]], "B,F": 0, "<2>": 2, "D": leaf["D"]}
    with pytest.raises(Exception, match="no such clade: Z"):
        wanted("A,Z").collect()
    donors, targets = wanted("A,B", "E"), wanted("D", "E", "E,F", "A,B,C")
    h, t = ({r.node for r in x.collect()} for x in (donors, targets))
    pairs = [p for p in brute_trees.candidates(s) if p[0] in h and p[1] in t]
    texts = ["((a_A,(b_B,e_E)),(c_C,d_D));", "((x_E,y_F),(a_A,z_E));"]
    genes, leaves, weights, _ = sweep.gene_tables(spark.createDataFrame([(0, g, 1) for g in texts], WEIGHTED), named)
    rows = sweep.score_candidates(genes, leaves, weights, named.drop("species"), donors=donors, targets=targets).orderBy("mt_id").collect()
    assert [(r.mt_id, r.h, r.t) for r in rows[1:]] == [(k, *p) for k, p in enumerate(pairs, 1)]
    assert [r.score for r in rows] == [sum(brute_trees.score(parse_newick(g), s, p) for g in texts) for p in [None, *pairs]]


def test_choices_are_costed_in_bounded_memory():
    """Trees of up to 15 units under a donor of 25 leaves: parts of any size give the same sums, and none takes much memory."""
    rng = random.Random(5)
    s = costs.Species([0] * 25 + list(range(1, 25)), [24 - i for i in range(25)] + list(range(1, 25)), list(range(25)) + [24 - i for i in range(24)])
    sizes = [15, 3, 9, 15, 1, 12, 6]
    pos = [[rng.randrange(25) for _ in range(n)] for n in sizes]
    nodes = [[(0, n - 1 - i) for i in range(n)] + [(i, i) for i in range(1, n)] for n in sizes]
    t = costs.Trees(s, pos, nodes)
    unit = np.array([(i, 0, j, j) for i, n in enumerate(sizes) for j in range(n)], np.int64)
    weight = np.arange(1.0, 1 + len(sizes))
    tracemalloc.start()
    got = costs.sweep(s, t, weight, *unit.T, 1, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    for most in (1, 997, 3000):
        few = np.isin(unit[:, 0], [1, 4, 6]) if most == 1 else np.ones(len(unit), bool)
        want = costs.sweep(s, t, weight, *unit[few].T, 1, 1, most=10_000_000)
        assert all(np.allclose(a, b) for a, b in zip(costs.sweep(s, t, weight, *unit[few].T, 1, 1, most=most), want))
    assert np.allclose(got[2], costs.sweep(s, t, weight, *unit.T, 1, 1, most=10_000_000)[2])
