"""All rootings at once, against trees rooted anew one by one."""

import random

from pyspark.sql import functions as F

from thicket.functions.storage import stored
from thicket.functions.trees import parse_newick
from thicket.operators import rooting
from thicket.sources import newick

import brute_trees
from test_events import by_span
from test_sweep import grown


def rooted(t, u):
    """Newick of t with its root on the edge above u."""

    def down(v):
        return f"({','.join(down(c) for c in t.children[v])})" if t.children[v] else t.name[v]

    def up(v):
        p = t.parent[v]
        (s,) = [c for c in t.children[p] if c != v]
        return down(s) if p == 0 else f"({up(p)},{down(s)})"

    return f"({down(u)},{up(u)});"


def test_all_rootings(spark):
    rng = random.Random(2)
    text = grown(rng, list("ABCDE"))
    texts = [grown(rng, [f"g{i}_{rng.choice('ABCDE')}" for i in range(rng.randrange(1, 9))]) for _ in range(30)]
    s = parse_newick(text)
    species = stored(newick.parse(spark.createDataFrame([(0, text)], "tree_id long, newick string")))
    genes = stored(newick.parse(spark.createDataFrame(list(enumerate(texts)), "tree_id long, newick string")))
    nodes = genes.select("tree_id", F.col("node_id").alias("u"), F.col("parent_id").alias("parent"), "lo", "hi")
    found = stored(rooting.rootings(nodes, newick.placed(genes, species), species))
    got = {(r.tree_id, r.u): (r.n_dups, r.n_losses) for r in found.collect()}
    want = {}
    leaf = {s.name[v]: v for v in s.leaves(0)}
    for k, x in enumerate(texts):
        t = parse_newick(x)
        for u in range(1, len(t.parent)):
            g = parse_newick(rooted(t, u))
            want[k, u] = brute_trees.cost(g, s, {v: leaf[g.name[v].rsplit("_", 1)[-1]] for v in g.leaves(0)})[1:]
    assert got == want
    for r in rooting.best(found).collect():
        scores = {u: sum(v) for (k, u), v in want.items() if k == r.tree_id}
        assert (r.score, r.u, r.n_rootings, r.worst) == (min(scores.values()), min(u for u, x in scores.items() if x == min(scores.values())), len(scores), max(scores.values()))
    assert newick.unresolved(newick.parse(spark.createDataFrame([(0, "((a,b,c),d);"), (1, "((a,b),c);")], "tree_id long, newick string"))).count() == 1


def form(t, u=0):
    return t.name[u] if not t.children[u] else "(" + ",".join(sorted(form(t, c) for c in t.children[u])) + ")"


def test_rerooted(spark):
    rng = random.Random(9)
    texts = [grown(rng, [f"g{i}" for i in range(rng.randrange(2, 10))]) for _ in range(40)]
    parsed = [parse_newick(x) for x in texts]
    at = [rng.randrange(1, len(t.parent)) for t in parsed]
    genes = newick.parse(spark.createDataFrame(list(enumerate(texts)), "tree_id long, newick string"))
    nodes = genes.select("tree_id", F.col("node_id").alias("u"), F.col("parent_id").alias("parent"), "lo", "hi")
    leaves = genes.filter("is_leaf").select("tree_id", F.col("lo").alias("leaf"), F.expr("int(substring(name, 2))").alias("pos"))
    chosen = spark.createDataFrame([(k, u) for k, u in enumerate(at)] + [(99, 0)], "tree_id long, at long")
    rows = newick.listed(nodes, leaves, ["tree_id"]).join(chosen, "tree_id")
    for r in rooting.rerooted(rows, ["tree_id"]).collect():
        got = by_span([(n.lo, n.hi) for n in r.nodes], [f"g{p}" for p in r.pos])
        assert form(parse_newick(got)) == form(parse_newick(rooted(parsed[r.tree_id], at[r.tree_id]))), (texts[r.tree_id], at[r.tree_id])
        assert len(r.nodes) == len(parsed[r.tree_id].parent)
    still = rooting.rerooted(rows.withColumn("at", F.lit(0).cast("long")), ["tree_id"]).collect()
    assert all(by_span([(n.lo, n.hi) for n in r.nodes], [f"g{p}" for p in r.pos]) == texts[r.tree_id].replace(" ", "") for r in still)
