"""Grafts, partitions, containment and rounds of events, against trees built and walked one by one."""

import random
from itertools import product

from pyspark.sql import functions as F

from thicket.functions.storage import stored
from thicket.functions.trees import parse_newick, species_of
from thicket.operators import events, surgery, sweep
from thicket.sources import files, newick

import brute_trees
from test_sweep import SPECIES, as_rows, grown


def text_of(tree, u=0):
    return f"({','.join(text_of(tree, c) for c in tree.children[u])})" if tree.children[u] else tree.name[u]


def grafted(s, h, t, mark):
    """Newick of s with a copy of clade h above t."""

    def copy(u):
        return f"({','.join(map(copy, s.children[u]))})" if s.children[u] else s.name[u] + mark

    def put(u):
        own = f"({','.join(map(put, s.children[u]))})" if s.children[u] else s.name[u]
        return f"({own},{copy(h)})" if u == t else own

    return put(0) + ";"


def by_span(nodes, names):
    """Newick of a binary tree of (lo, hi) spans."""
    spans = set(nodes)

    def text(lo, hi):
        if lo == hi:
            return names[lo]
        mid = max(b for a, b in spans if a == lo and b < hi)
        return f"({text(lo, mid)},{text(mid + 1, hi)})"

    return text(*max(spans, key=lambda x: x[1] - x[0])) + ";"


def first_best(g, s, pair):
    """(cost, copy of each leaf) of the cheapest choice, the first in order of units."""
    h, t = pair
    target, where = brute_trees.with_copy(s, h, t)
    donor = {s.name[v] for v in s.leaves(h)}
    order = sorted(g.leaves(0), key=g.tin.__getitem__)
    groups = sorted((sorted(g.leaves(r), key=g.tin.__getitem__) for r in brute_trees.units(g, donor)), key=lambda x: g.tin[x[0]])
    best = None
    for taken in product((0, 1), repeat=len(groups)):
        images = {u: where[0][species_of(g.name[u])] for u in order}
        copies = dict.fromkeys(order)
        for group, c in zip(groups, taken):
            for u in group:
                images[u], copies[u] = where[c][species_of(g.name[u])], c
        cost = brute_trees.cost(g, target, images)[0]
        if best is None or cost < best[0]:
            best = cost, [copies[u] for u in order]
    return best


def random_case(seed, n):
    rng = random.Random(seed)
    text = grown(rng, list("ABCDE"))
    return text, [grown(rng, [f"g{i}_{rng.choice('ABCDE')}" for i in range(rng.randrange(1, 7))]) for _ in range(n)]


def test_graft_and_winning_copies(spark):
    text, texts = random_case(2, 12)
    s, parsed = parse_newick(text), [parse_newick(x) for x in texts]
    rows, nodes = as_rows(spark, texts, text)
    named = stored(sweep.species_nodes(spark.createDataFrame([(0, text)], SPECIES)))
    found = stored(sweep.units(rows, nodes))
    for h, t in random.Random(1).sample(brute_trees.candidates(s), 4):
        won = spark.createDataFrame([(0, h, t)], "family long, h int, t int")
        got = surgery.graft(named, won, "|1.1").collect()
        tips = [r.species for r in sorted(got, key=lambda r: r.lo) if r.lo == r.hi]
        want = grafted(s, h, t, "|1.1")
        assert by_span([(r.lo, r.hi) for r in got], tips) == want
        tree = parse_newick(want)
        assert sorted(r.depth for r in got) == sorted(tree.depth) and sum(r.parent is None for r in got) == 1
        by = {r.node: r for r in got}
        assert all(r.parent is None or (by[r.parent].depth == r.depth - 1 and by[r.parent].lo <= r.lo <= r.hi <= by[r.parent].hi) for r in got)
        copies = {r.gt: (r.cost, r.copies) for r in events.winning_copies(rows, found, won, nodes).collect()}
        assert copies == {k: first_best(g, s, (h, t)) for k, g in enumerate(parsed)}


def test_three_rounds_equal_brute_force(spark):
    for seed in (5, 9):
        text, texts = random_case(seed, 9)
        rows, nodes = as_rows(spark, texts, text)
        named = sweep.species_nodes(spark.createDataFrame([(0, text)], SPECIES))
        got, last = events.full_search(*events.tables(rows), rows.select("family", "gt", F.lit(1).alias("weight")), named, 3)
        s, genes, want = parse_newick(text), list(texts), []
        for k in range(1, 4):
            parsed = [parse_newick(g) for g in genes]
            before = sum(brute_trees.score(g, s, None) for g in parsed)
            score, mt_id, (h, t) = min((sum(brute_trees.score(g, s, pair) for g in parsed), i, pair) for i, pair in enumerate(brute_trees.candidates(s), 1))
            want.append((k, mt_id, score, before, score < before))
            if score >= before:
                break
            for i, g in enumerate(parsed):
                for u, c in zip(sorted(g.leaves(0), key=g.tin.__getitem__), first_best(g, s, (h, t))[1]):
                    g.name[u] += f"|{k}.1" if c == 1 else ""
                genes[i] = text_of(g) + ";"
            if k < 3:
                s = parse_newick(grafted(s, h, t, f"|{k}.1"))
        assert sorted((r["round"], r.mt_id, r.score, r.before, r.passed) for r in got.collect()) == want
        tips = [r.species for r in last.filter("lo = hi").orderBy("lo").collect()]
        assert tips == [s.name[u] for u in sorted(s.leaves(0), key=s.tin.__getitem__)]


def partitioned(g, labels):
    """(inner, outer) Newick of a gene tree cut at its largest clades of one label, by leaf number."""
    order = {u: i for i, u in enumerate(sorted(g.leaves(0), key=g.tin.__getitem__))}
    inner = []

    def pure(u):
        held = {labels[order[v]] for v in g.leaves(u)}
        return len(held) == 1 and None not in held

    def text(u):
        return f"({','.join(map(text, g.children[u]))})" if g.children[u] else str(order[u])

    def rest(u):
        if pure(u):
            inner.append(text(u) + ";")
            return None
        if not g.children[u]:
            return str(order[u])
        left = [x for x in map(rest, g.children[u]) if x]
        return None if not left else left[0] if len(left) == 1 else f"({','.join(left)})"

    outer = rest(0)
    return sorted(inner), outer and outer + ";"


def test_partition(spark):
    rng = random.Random(7)
    text, texts = random_case(11, 40)
    rows, _ = as_rows(spark, texts, text)
    parsed = [parse_newick(x) for x in texts]
    labels = {k: [rng.choice([None, 0, 0, 1, 1]) for _ in g.leaves(0)] for k, g in enumerate(parsed)}
    table = spark.createDataFrame([(0, k, x) for k, x in labels.items()], "family long, gt long, copies array<int>")
    # Leaves' own numbers stand for species here, so that they can be told apart.
    numbered = rows.withColumn("pos", F.transform("pos", lambda x, i: i))
    inner, outer = (stored(x) for x in surgery.partition(events.labelled(numbered, table), ["family", "gt"]))
    name = lambda r: by_span([(n.lo, n.hi) for n in r.nodes], [str(p) for p in r.pos])
    cut, rest = {}, {r.gt: name(r) for r in outer.collect()}
    for r in inner.collect():
        cut.setdefault(r.gt, []).append(name(r))
        assert {labels[r.gt][p] for p in r.pos} == {r.label} and r.first == r.pos[0]
    for k, g in enumerate(parsed):
        assert (sorted(cut.get(k, [])), rest.get(k)) == partitioned(g, labels[k])
    # Leaves add up; small trees stay if there are no others.
    assert inner.unionByName(outer.withColumns({"part": F.lit(0), "label": F.lit(0), "first": F.lit(0)})).agg(F.sum(F.size("pos"))).first()[0] == sum(len(g.leaves(0)) for g in parsed)
    some = surgery.partition(events.labelled(numbered, table), ["family", "gt"], 3)
    assert all(r.n >= 3 for x in some for r in x.select(F.size("pos").alias("n")).collect()) and some[0].count() < inner.count()
    none = surgery.partition(events.labelled(numbered, table), ["family", "gt"], 99)
    assert (none[0].count(), none[1].count()) == (inner.count(), outer.count())


def test_encode_and_containment(spark):
    rng = random.Random(4)
    target = parse_newick("((((A,B),C),D),(E,(F,G)));")
    texts = []
    for _ in range(40):
        kept = sorted(rng.sample("ABCDEFG", rng.randrange(1, 7)))
        texts.append(grown(rng, kept))
    texts += ["(A,A);", "(A,Z);", "((A,B),C);", "((A,C),B);"]

    def cut(t, names, u=0):
        if not t.children[u]:
            return t.name[u] if t.name[u] in names else None
        left = [x for x in (cut(t, names, c) for c in t.children[u]) if x]
        return None if not left else left[0] if len(left) == 1 else f"({','.join(left)})"

    def clades(t):
        return {frozenset(t.name[v] for v in t.leaves(u)) for u in t.by_post if t.children[u]}

    def tree_rows(texts):
        parsed = newick.parse(spark.createDataFrame(list(enumerate(texts)), "tree_id long, newick string"))
        return parsed.groupBy("tree_id").agg(F.sort_array(F.collect_list(F.when(F.col("is_leaf"), F.struct("lo", "name")))).alias("n"), F.sort_array(F.collect_list(F.struct("lo", (-F.col("hi")).alias("z")))).alias("s")).select(
            "tree_id", F.col("n.name").alias("names"), F.transform("s", lambda x: F.struct(x["lo"].alias("lo"), (-x["z"]).alias("hi"))).alias("nodes")
        )

    rows = tree_rows(texts)
    got = {r.tree_id: (r.n_taxa, r.distance, r.contained) for r in surgery.contained(rows, tree_rows([text_of(target) + ";"]), ["tree_id"]).collect()}
    for k, text in enumerate(texts):
        t = parse_newick(text)
        names = [t.name[u] for u in t.leaves(0)]
        if len(set(names)) < len(names) or not set(names) <= set("ABCDEFG"):
            assert got[k] == (len(names), None, False)
        else:
            d = len(clades(t) ^ clades(parse_newick(cut(target, names) + ";")))
            assert got[k] == (len(names), d, d == 0)
    parents = {(r.tree_id, r.u): r.parent for r in surgery.encode(rows.select("tree_id", F.inline("nodes")), ["tree_id"]).collect()}
    code = lambda t, u: 100_000 * min(x) + max(x) if (x := [sorted(t.leaves(0), key=t.tin.__getitem__).index(v) for v in t.leaves(u)]) else None
    for k, text in enumerate(texts):
        t = parse_newick(text)
        assert all(parents[k, code(t, u)] == (code(t, t.parent[u]) if u else None) for u in t.by_post)


def test_reports(spark, tmp_path):
    trees = spark.createDataFrame([(1, "(a_A,b_B);"), (2, "(("), (3, "((a_A,b_A),c_B);")], "tree_id long, newick string")
    rejected, over = spark.createDataFrame([(2, "no tree")], "tree_id long, reason string"), spark.createDataFrame([(3, 17)], "tree_id long, n_units int")
    assert [r.line for r in files.tree_lines(trees, rejected, over).orderBy("tree_id").collect()] == ["(a_A,b_B);", "# left out: no tree", "# over the limit: 17 units"]
    load = spark.createDataFrame([(1, 3), (1, 4), (3, 9), (3, 5), (3, 2)], "tree_id long, n_units long")
    found = files.filtered(spark.createDataFrame([(1,), (2,), (3,), (4,)], "tree_id long"), trees.filter("tree_id IN (1, 3)"), load, 4).orderBy("tree_id").collect()
    assert [tuple(r) for r in found] == [(1, "kept", 0, "(a_A,b_B);"), (2, "gone", 0, "# gone before"), (3, "over", 2, "# over the limit for 2 donors"), (4, "gone", 0, "# gone before")]
    text, texts = random_case(6, 8)
    rows, nodes = as_rows(spark, texts, text)
    found = stored(sweep.units(rows, nodes))
    s = parse_newick(text)
    got = {(r.gt, r.h, r.t): (r.groups, r.fixed, r.combinations) for r in files.check_numbers(found, sweep.pins(rows, nodes, found)).collect()}
    for k, g in enumerate(map(parse_newick, texts)):
        for h, t in brute_trees.candidates(s, True):
            units = brute_trees.units(g, {s.name[v] for v in s.leaves(h)})
            tied = sum(brute_trees.pinned(g, s, h, t, u) is not None for u in units)
            assert got.get((k, h, t)) == ((len(units), tied, 2.0 ** (len(units) - tied)) if units else None)
    files.save_scores(spark.createDataFrame([(0, 1, None, None), (0, 2, 3, 1.5)], "family long, mt_id long, h int, score double").withColumn("t", F.lit(1)), str(tmp_path / "s"))
    (part,) = [x for x in (tmp_path / "s").iterdir() if x.suffix == ".csv"]
    assert part.read_text().splitlines()[1:] == ["2\t3\t1\t1.500", "1\t\t1\tNOT_SCORED"]
