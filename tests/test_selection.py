"""Valleys and the choice of candidates, on values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from thicket.operators import select

SCORES = "family long, mt_id long, score double"
INF = float("inf")


def test_valleys_and_their_fallbacks(spark):
    two = [(0, k, float(x)) for k, x in enumerate([9.05, 1, 1.2, 0.8, 9, 9.1, 8.9, 1.1, 0.9])]
    few = [(1, 0, 5.0), (1, 1, 3.0)]
    same = [(2, k, 4.0) for k in range(5)]
    no_input = [(3, k, x) for k, x in enumerate([1.0, 1.1, 0.9, 7.0, 7.1, 6.9], 1)]
    got = {r.family: r for r in select.valleys(spark.createDataFrame(two + few + same + no_input + [(2, 9, None)], SCORES)).collect()}
    assert 1.2 < got[0].first < 8.9 and got[0].left == got[0].first and got[0].right == INF and got[0].input == 9.05
    assert tuple(got[1]) == (1, 5.0, 5.0, -INF, INF) and tuple(got[2]) == (2, 4.0, 4.0, -INF, INF)
    assert got[3].input == INF and got[3].left == got[3].first and 1.1 < got[3].first < 6.9


def test_a_flat_minimum_has_one_valley(spark):
    far = [(float(x),) for x in (0, 0.001, 0.002, 1e6, 1e6 + 0.001, 1e6 + 0.002)]
    found = select.density(spark.createDataFrame(far, "score double"), 100).filter("valley").collect()
    assert len(found) == 1 and abs(found[0].point - 49) <= 1


def chosen(spark, n_best, **more):
    scores = spark.createDataFrame([(0, 0, 10.0), (0, 1, 12.0), (0, 2, 7.0), (0, 3, 7.0), (0, 4, 10.0), (0, 5, None), (1, 0, 1.0), (1, 1, 4.0)], SCORES)
    bounds = spark.createDataFrame([(0, 10.0, 7.0, 6.0, 12.0), (1, 1.0, 4.0, -INF, INF)], "family long, input double, `first` double, `left` double, `right` double")
    return {(r.family, r.mt_id): (r["rank"], r.passed) for r in select.selected(scores, bounds, n_best, **more).collect()}


def test_selection(spark):
    own = {(0, 0): (None, True), (1, 0): (None, True)}
    # The best is always in, passed or not; a score equal to the break is in, one equal to the reference does not pass.
    assert chosen(spark, 1) == own | {(0, 2): (1, True), (1, 1): (1, False)}
    assert chosen(spark, 0) == own | {(0, 2): (1, True), (0, 3): (2, True), (0, 4): (3, False), (1, 1): (1, False)}
    assert chosen(spark, -1) == own | {(0, 2): (1, True), (0, 3): (2, True), (1, 1): (1, False)}
    assert chosen(spark, -2) == own | {(0, 2): (1, True), (1, 1): (1, False)}
    assert len(chosen(spark, -3)) == 7 and chosen(spark, -9) == chosen(spark, -3) == chosen(spark, 99)
    assert chosen(spark, 1, cutoff=("input", True, 0.3))[0, 2] == (1, False) and chosen(spark, 1, cutoff=("input", True, 0.29))[0, 2] == (1, True)
    assert chosen(spark, 1, cutoff=("none", False, 0.0))[1, 1] == (1, True) and chosen(spark, 1, cutoff=("right", False, 4.9))[0, 2] == (1, True)
    earlier = spark.createDataFrame([(0, 7.5)], "family long, score double")
    assert chosen(spark, 1, cutoff=("input", False, 0.5), previous=earlier)[0, 2] == (1, False)
    assert chosen(spark, 0, mode="no-st") == {k: v for k, v in chosen(spark, -1).items() if k not in own} and chosen(spark, 5, mode="st-only") == own
    with pytest.raises(ValueError):
        chosen(spark, 1, cutoff=("middle", False, 0.0))
    with pytest.raises(ValueError):
        chosen(spark, 1, mode="other")
    assert select.selected(spark.createDataFrame([], SCORES), select.valleys(spark.createDataFrame([], SCORES))).filter(F.lit(True)).count() == 0
