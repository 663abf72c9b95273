"""Trees inside a task, against values worked out by brute force."""

import pytest

from thicket.functions import trees
from thicket.functions.trees import parse_newick

from brute_trees import candidates, pinned, score, units, with_copy

S = parse_newick("(((A,B),C),D);")
GENES = ["(((a1_A,b1_B),c1_C),d1_D);", "((a1_A,b1_B),(c1_C,(b2_B,d1_D)));", "((a1_A,b1_B),((b2_B,c1_C),d1_D));", "(((a1_A,b1_B),c1_C),(b2_B,d1_D));", "((a1_A,(b1_B,b2_B)),(c1_C,d1_D));"]
# Total collapsed scores of candidates 1 to 31.
TOTALS = [26, 26, 26, 29, 31, 26, 27, 25, 16, 26, 26, 25, 26, 29, 26, 22, 29, 23, 22, 23, 21, 26, 23, 26, 18, 29, 26, 14, 31, 14, 20]


def test_root_losses_and_exactness():
    s, g = parse_newick("(A,(B,C));"), parse_newick("((g1_A,g1_B),g1_C);")
    assert score(g, s, (0, 0)) == 5 and score(g, s, (0, 0), exact=True) == 3


@pytest.mark.parametrize("text, kept, off", [("(A,(B,C));", 15, 19), ("(((A,B),C),D);", 31, 37), ("((A,B),(C,D));", 33, 39), ("((((A,B),C),D),E);", 53, 61)])
def test_candidate_counts(text, kept, off):
    s = parse_newick(text)
    assert len(candidates(s)) == kept and len(candidates(s, redundant=True)) == off


def test_all_candidates_of_a_tree():
    genes = [parse_newick(x) for x in GENES]
    assert [score(g, S, None) for g in genes] == [0, 8, 4, 4, 5]
    assert [sum(score(g, S, pair) for g in genes) for pair in candidates(S)] == TOTALS
    exact = [sum(score(g, S, pair, exact=True) for g in genes) for pair in candidates(S)]
    assert exact == [*TOTALS[:30], 18]


def test_pins():
    b, d = (next(u for u in S.order if S.name[u] == x) for x in "BD")
    got = []
    for text in GENES:
        g = parse_newick(text)
        got.append([pinned(g, S, b, d, r) for r in units(g, {"B"})])
    assert got == [[0], [0, 1], [0, None], [0, 1], [None, None]]


def test_copies_and_errors():
    target, where = with_copy(S, 0, 0)
    assert len(target.parent) == 15 and sorted(where[1]) == list("ABCD")
    for bad in ("", "(A,B", "A,B;", "(A,,B);", "(A,B));", "(A,B)C(D);"):
        with pytest.raises(ValueError):
            parse_newick(bad)
    t = parse_newick("((a:1,b:2)0.9:3,'c d');")
    assert [t.name[u] for u in t.leaves(0)] == ["a", "b", "c d"] and t.dist[1] == 3
    assert trees.species_of("x_y_Z") == "Z" and trees.species_of("Z") == "Z"
