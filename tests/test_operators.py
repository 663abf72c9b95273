"""Operators over small trees and files, with values worked out by hand."""

import os
import random

import pytest
from pyspark.sql import functions as F

from thicket.functions import names, trees
from thicket.operators import candidates, compare, grouping, network, select, sweep
from thicket.sources import files, newick
from thicket.streaming import scores

import brute_trees

S = "(((A,B),C),D);"
GENES = ["(((a1_A,b1_B),c1_C),d1_D);", "((a1_A,b1_B),(c1_C,(b2_B,d1_D)));", "((a1_A,b1_B),((b2_B,c1_C),d1_D));", "(((a1_A,b1_B),c1_C),(b2_B,d1_D));", "((a1_A,(b1_B,b2_B)),(c1_C,d1_D));"]


def test_general_scores(spark):
    genes = newick.parse(spark.createDataFrame(list(enumerate([*GENES, "broken((", ""])), "tree_id long, newick string"))
    species = newick.parse(spark.createDataFrame([(0, S)], "tree_id long, newick string"))
    got = sorted((r.tree_id, r.score, r.n_dups, r.n_losses) for r in newick.scored(genes, species).collect())
    assert got == [(0, 0, 0, 0), (1, 8, 2, 6), (2, 4, 1, 3), (3, 4, 1, 3), (4, 5, 2, 3)]
    with pytest.raises(Exception, match="no such species: Z"):
        newick.scored(newick.parse(spark.createDataFrame([(0, "(a_A,z_Z);")], "tree_id long, newick string")), species).collect()
    lost = newick.rejects(spark.createDataFrame([(1, "(a"), (2, "(a,b);")], "tree_id long, newick string"))
    assert [r.tree_id for r in lost.collect()] == [1]


def test_allowance(spark):
    table = newick.parse(spark.createDataFrame([(0, "((A,B),C);")], "tree_id long, newick string"))
    limits = spark.createDataFrame([("A", 1), ("B", 3)], "species string, max_copies int")
    copies = spark.createDataFrame([("A", 1), ("B", 1), ("C", 1)], "species string, copies int")
    tree = trees.parse_newick("((A,B),C);")
    got = {r.h: r.allowed for r in candidates.allowance(table, limits, copies).collect()}
    name = {tree.name[u]: u for u in tree.leaves(0)}
    assert got == {name["A"]: 0, name["B"]: 2, name["C"]: 998, tree.parent[name["A"]]: 0, 0: 0}


def test_search_and_stream(spark, tmp_path):
    weighted = spark.createDataFrame([(0, g, 2 if k == 0 else 1) for k, g in enumerate(GENES)], "family long, newick string, weight long")
    species = spark.createDataFrame([(0, S)], "family long, newick string")
    found = {r.mt_id: r for r in sweep.score_newicks(weighted, species).collect()}
    assert len(found) == 32 and found[0].score == 21 and found[28].score == 15 and found[30].score == 15 and found[28].n_trees == 6
    tight = sweep.score_newicks(weighted, species, most_units=0)
    assert sorted((r.mt_id, r.score, r.n_trees, r.n_skipped) for r in tight.collect()) == [(k, None, 0, 6) for k in range(32)]
    folder = str(tmp_path / "trees")
    for k in range(2):
        weighted.filter(F.col("weight") == k + 1).write.mode("append").parquet(folder)
    scores.follow(spark, folder, species, str(tmp_path / "sums"), str(tmp_path / "check")).awaitTermination()
    assert {r.mt_id: r.score for r in scores.totals(spark, str(tmp_path / "sums")).collect()} == {k: r.score for k, r in found.items()}
    files.save_scores(sweep.score_newicks(weighted, species), str(tmp_path / "out"))
    out = [f for f in os.listdir(tmp_path / "out") if f.endswith(".csv")]
    assert open(tmp_path / "out" / out[0]).read().splitlines()[1].split("\t")[-1] == "15.000"


def test_ploidy_file(spark, tmp_path):
    (tmp_path / "p.txt").write_text("A 2\n\n# note\nB\t3 # more\nC zero\nX 4\nA 1\nD 1 2\n")
    good, bad = files.ploidy(spark, str(tmp_path / "p.txt"), spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "species string"))
    assert sorted(map(tuple, good.collect())) == [("A", 1), ("B", 3)]
    assert sorted(r.reason for r in bad.collect()) == ["count", "fields", "unknown species"]


def test_ploidy_distance(spark):
    copies = spark.createDataFrame([(1, t, n) for t, n in zip("abcde", (2, 2, 1, 1, 1))] + [(2, t, n) for t, n in zip("abcde", (1, 2, 3, 1, 1))] + [(3, t, n) for t, n in zip("abc", (2, 3, 2))] + [(4, t, n) for t, n in zip("abc", (2, 2, 3))], "tree long, taxon string, n long")
    pairs = spark.createDataFrame([(1, 2), (3, 4), (1, 1)], "a long, b long")
    got = {(r.a, r.b): (r.tp, r.fp, r.fn, round(r.distance, 6)) for r in compare.ploidy_distance(copies, pairs).collect()}
    assert got == {(1, 2): (1, 2, 1, 0.75), (3, 4): (3, 1, 1, 0.4), (1, 1): (2, 0, 0, 0.0)}


def test_names(spark):
    row = spark.createDataFrame([("x_y_Z", "<3*|1.1", "A**|2.1", "a|<b>", "((A,B) ; ", "(A'[n]',B[&x])")], "a string, b string, c string, d string, e string, f string")
    got = row.select(names.species_of(F.col("a")), names.pure_name(F.col("b")), names.pure_name(F.col("c")), names.repaired(F.col("d")), names.with_semicolon(F.col("e")), names.without_annotations(F.col("f"))).first()
    assert tuple(got) == ("Z", "<3>", "A", "a.b", "((A,B);", "(A,B)")


def test_selection(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([5, 3, 3, 9, 1])], "gt_id long, score long")
    top = select.passed(select.best(df, 3), 4, 1)
    assert [(r.gt_id, r["rank"], r.passed) for r in top.orderBy("rank").collect()] == [(4, 1, True), (1, 2, False), (2, 3, False)]
    assert sum(r.n for r in select.histogram(df, 4).collect()) == 5
    two = spark.createDataFrame([(float(x),) for x in [1, 1.2, 0.8, 9, 9.1, 8.9]], "score double")
    assert select.density(two).filter("valley").count() >= 1


def test_quota_and_classes(spark):
    leaves = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 5), (2, 1, 6), (2, 2, 5), (2, 3, 5), (3, 1, 5), (3, 2, 5), (3, 3, 6)], "gt_id long, place int, nation int").withColumn("regions", F.lit(5))
    assert sorted((r.rep_gt_id, r.weight) for r in grouping.classes(leaves).collect()) == [(1, 2), (3, 1)]
    assert all(r.o == 1.0 and r.q == 1.0 for r in grouping.quotas(leaves).collect())


def test_networks(spark):
    table = newick.parse(spark.createDataFrame([(0, "((A,B),((B,A),C));"), (1, "(A,(B,C));"), (2, "(((a,b),(c,c)),((b,a),(c,c)));")], "tree_id long, newick string"))
    canon = {(r.tree_id, r.node_id): r.canon for r in network.canonical(table).collect()}
    assert canon[0, 1] == canon[0, 5] and canon[0, 0] != canon[0, 1]
    got = sorted((r.tree_id, r.n_copies, r.n_leaves) for r in network.reticulations(table).collect())
    assert got == [(0, 2, 2), (2, 2, 4)]
    edges = spark.createDataFrame([(0, s, d) for s, d in ("ra", "rb", "ax", "bx", "xy", "xz", "bw")], "net_id long, src string, dst string")
    assert {r.node: r.n_paths for r in network.unfolded_size(edges).collect()} == {"r": 1, "a": 1, "b": 1, "w": 1, "x": 2, "y": 2, "z": 2}


def test_sweep_equals_built_candidates(spark):
    """All candidates of five species over trees of every shape, and the fixed totals of the small case."""
    rng = random.Random(4)

    def grown(names):
        while len(names) > 1:
            a, b = rng.sample(range(len(names)), 2)
            names = [x for i, x in enumerate(names) if i not in (a, b)] + [f"({names[a]},{names[b]})"]
        return names[0] + ";"

    texts = [grown([f"g{i}_{rng.choice('ABCDE')}" for i in range(rng.randrange(1, 8))]) for _ in range(25)]
    species = ["((((A,B),C),D),E);", "((A,B),((C,D),E));"]
    weighted = spark.createDataFrame([(f, x, 1 + i % 3) for f in range(2) for i, x in enumerate(texts)], "family long, newick string, weight long")
    got = {(r.family, r.mt_id): (r.score, r.n_skipped) for r in sweep.score_newicks(weighted, spark.createDataFrame(list(enumerate(species)), "family long, newick string")).collect()}
    for f, text in enumerate(species):
        s = trees.parse_newick(text)
        for k, pair in enumerate([None, *brute_trees.candidates(s)]):
            assert got[f, k] == (sum((1 + i % 3) * brute_trees.score(trees.parse_newick(x), s, pair) for i, x in enumerate(texts)), 0)
    with pytest.raises(Exception, match="no such species: Z"):
        sweep.score_newicks(spark.createDataFrame([(0, "(a_A,z_Z);", 1)], "family long, newick string, weight long"), spark.createDataFrame([(0, S)], "family long, newick string")).collect()


def test_inputs_by_kind(spark, tmp_path):
    (tmp_path / "one.txt").write_text("(a,b);\r\n\n  (c,d);\n")
    (tmp_path / "two.txt").write_text("\n(e,\nf);\n")
    (tmp_path / "empty.txt").write_text(" \n")
    kinds = [newick.kind_of(spark, x) for x in ("(a,b)", str(tmp_path / "one.txt"), str(tmp_path), str(tmp_path / "t*.txt"), str(tmp_path / "no"), str(tmp_path / "no*"))]
    assert kinds == ["raw", "file", "dir", "glob", "missing", "missing"]
    got = [(os.path.basename(r.origin), r.newick) for r in newick.read(spark, str(tmp_path / "one.txt")).collect()]
    assert sorted(got) == [("one.txt:1", "(a,b);"), ("one.txt:3", "(c,d);")]
    assert [r.newick for r in newick.read(spark, str(tmp_path / "t*.txt")).collect()] == ["(e,\nf);"]
    assert newick.read(spark, str(tmp_path)).count() == 2 and newick.read(spark, " (a,b); ").first().newick == "(a,b);"
    with pytest.raises(FileNotFoundError):
        newick.read(spark, str(tmp_path / "no"))


def test_support_quotas(spark):
    texts = ["((a_A,b_B)50,(c_C,d_A)90);", "((a_A,b_B)0.5,c_C);", "(a_A,b_B);", "((a_A,b_B),(c_C,(d_D,e_A)80)100);", "a_A;", "((a_A,b_A)0,c_A);"]
    parsed = newick.parse(spark.createDataFrame(list(enumerate(texts)), "tree_id long, newick string"))
    got = {r.tree_id: (r.o, r.r, round(r.q, 6)) for r in grouping.support_quotas(parsed).collect()}
    # A missing support is 1 and is divided by 100 as the others are.
    assert got == {0: (0.75, 0.7, 0.724138), 1: (0.75, 0.5, 0.6), 2: (0.5, 1.0, 0.666667), 3: (1.0, (1 + 100 + 80) / 100 / 3, round(2 * 0.603333333 / 1.603333333, 6)), 4: (0.25, 1.0, 0.4), 5: (0.25, 0.0, 0.0)}
    assert grouping.support_quotas(parsed, 8).filter("tree_id = 2").first().o == 0.25


def test_species_names(spark):
    texts = ["((A,B)<x>,C)<y>;", "((A,B)x,A)<P*1>;", "((A|1,B)<x>,C)<x>;", "((A,B)0.9,C)80;", "(,B);"]
    parsed = newick.parse(spark.createDataFrame(list(enumerate(texts)), "tree_id long, newick string"))
    got = sorted((r.tree_id, r.name, r.reason) for r in newick.name_problems(parsed).collect())
    assert got == [(1, "<P*1>", "illegal sign in an inner name"), (1, "A", "name twice"), (1, "x", "inner name without brackets"), (2, "<x>", "name twice"), (2, "A|1", "illegal sign in a leaf name")]
    genes = newick.parse(spark.createDataFrame([(0, "((a_A,a_A),(b|1_B,z_Z));"), (1, "(A,x_B);")], "tree_id long, newick string"))
    known = spark.createDataFrame([("A",), ("B",)], "species string")
    assert sorted(map(tuple, newick.gene_name_problems(genes, known).collect())) == [(0, "a_A", "name twice"), (0, "b|1_B", "illegal sign in a leaf name"), (0, "z_Z", "no such species")]
    mended = {(r.tree_id, r.node_id): r.name for r in newick.repaired_names(parsed).collect()}
    assert (mended[1, 0], mended[1, 1], mended[2, 0], mended[2, 1], mended[2, 2], mended[3, 1]) == ("<p.1>", "<x>", "<x>", None, "A.1", None)


def test_knuckles(spark):
    texts = ["(((a:1,b:2)x:3)y:4,c);", "((((a:1)0.5:2)90:3,b)z:1);", "(a,b);"]
    parsed = newick.parse(spark.createDataFrame(list(enumerate(texts)), "tree_id long, newick string"))
    rows = newick.without_knuckles(parsed).collect()
    got = {k: sorted((r.lo, -r.hi, r["name"] or "", r.dist) for r in rows if r.tree_id == k) for k in range(3)}
    assert got[0] == [(0, -2, "", None), (0, -1, "y", 7.0), (0, 0, "a", 1.0), (1, -1, "b", 2.0), (2, -2, "c", None)]
    assert got[1] == [(0, -1, "z", 1.0), (0, 0, "a", 6.0), (1, -1, "b", None)] and len(got[2]) == 3
    by = {(r.tree_id, r.node_id): r for r in rows}
    assert all(r.parent_id is None or by[r.tree_id, r.parent_id].lo <= r.lo <= r.hi <= by[r.tree_id, r.parent_id].hi for r in rows)
    assert [r.support for r in rows if r.tree_id == 1 and r["name"] == "a"] == [0.5]
