"""Search for the copied clade that explains gene trees best: every candidate of each region's tree over all orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..operators import events, select, surgery, sweep
from ..sources import corpus, files, newick

#: Free units above which a tree is left out.
MOST_UNITS = 15


def region_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node tables of the regions' trees, a caterpillar each; a node's number is 1000 times its first leaf plus its last."""
    tips = corpus.species_leaves(spark, sf_dir).select(F.col("region").alias("family"), F.col("rank").alias("hi"), F.col("size").alias("m"))
    code = lambda lo, hi: (1000 * lo + hi).cast("int")
    up = F.when(F.col("m") > 1, code(F.lit(0), F.greatest(F.lit(1), "hi")))
    leaf = tips.select("family", code(F.col("hi"), F.col("hi")).alias("node"), up.alias("parent"), F.col("hi").alias("lo"), "hi", (F.col("m") - F.greatest(F.lit(1), "hi")).alias("depth"))
    leaf = leaf.withColumn("depth", F.when(F.col("parent").isNull(), 0).otherwise(F.col("depth")))
    inner = tips.filter("hi > 0").select("family", code(F.lit(0), F.col("hi")).alias("node"), F.when(F.col("hi") < F.col("m") - 1, code(F.lit(0), F.col("hi") + 1)).alias("parent"), F.lit(0).alias("lo"), "hi", (F.col("m") - 1 - F.col("hi")).alias("depth"))
    return leaf.unionByName(inner).select("family", "node", "parent", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), F.col("depth").cast("int").alias("depth"))


def combs(parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(genes, leaves, weights) of caterpillars (family, s), s being their leaves' species leaves; equal trees count once with their number."""
    alike = F.concat(F.array_sort(F.slice("s", 1, 2)), F.slice("s", 3, F.size("s")))
    classes = stored(parts.groupBy("family", alike.alias("s")).agg(F.count("*").alias("weight")).withColumn("gt", F.monotonically_increasing_id()))
    leaves = classes.select("family", "gt", F.posexplode("s").alias("leaf", "pos"))
    n = F.size("s")
    tips = classes.select("family", "gt", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("hi")).withColumn("lo", F.col("hi"))
    inner = classes.filter(n > 1).select("family", "gt", n.alias("n"), F.explode(F.sequence(F.lit(1), n - 1)).alias("hi")).withColumn("lo", F.lit(0))
    code = lambda lo, hi: (100_000 * lo + hi).cast("long")
    # A tip hangs on the node that ends with it, the first two on the same; a node on the next one.
    up = F.when(F.col("lo") == F.col("hi"), F.greatest(F.lit(1), "hi")).otherwise(F.col("hi") + 1)
    genes = tips.unionByName(inner).select("family", "gt", code(F.col("lo"), F.col("hi")).alias("u"), F.when(up < F.col("n"), code(F.lit(0), up)).alias("parent"), "lo", "hi")
    return genes, leaves, classes.select("family", "gt", "weight")


def region_trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """combs() of each order's part in each region."""
    return combs(corpus.gene_leaves(spark, sf_dir).groupBy("gt_id", F.col("region").alias("family")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "rank"))), lambda x: x["rank"]).alias("s")))


def sweep_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of the whole species tree over all orders' whole trees; nodes are preorder numbers."""
    newicks = newick.species_newick(corpus.species_leaves(spark, sf_dir)).withColumnRenamed("tree_id", "family")
    species = sweep.species_nodes(newicks).drop("species")
    leaves = corpus.placed_leaves(spark, sf_dir)
    parts = leaves.groupBy("gt_id").agg(F.lit(0).cast("long").alias("family"), F.transform(F.array_sort(F.collect_list(F.struct("place", "pos"))), lambda x: x["pos"]).alias("s"))
    return sweep.score_candidates(*combs(parts), species, MOST_UNITS).drop("family")


def pin_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every different tree of a region, donor, unit and target, whether the unit is tied to the original (0), to the copy (1) or free; trees go by their leaves."""
    species = stored(region_species(spark, sf_dir))
    genes, leaves, _ = region_trees(spark, sf_dir)
    trees = stored(newick.listed(genes, leaves, sweep.KEY))
    found = stored(sweep.units(trees, species))
    named = trees.select(*sweep.KEY, F.array_join("pos", ",").alias("tree"))
    runs = found.select(*sweep.KEY, "h", "unit", "lo", "hi")
    tied = sweep.pins(trees, species, found).join(runs, [*sweep.KEY, "h", "unit"]).join(named, sweep.KEY)
    return tied.select("family", "tree", "h", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "t", "state")


def free_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every candidate of a region the number of different trees by how many units are free, and the choices that leaves."""
    species = stored(region_species(spark, sf_dir))
    genes, leaves, weights = region_trees(spark, sf_dir)
    trees = stored(newick.listed(genes, leaves, sweep.KEY))
    load = sweep.work(sweep.pins(trees, species, stored(sweep.units(trees, species))))
    return load.groupBy("family", "h", "t", "n_free").agg(F.count("*").alias("n_trees"), F.sum(F.pow(F.lit(2.0), "n_free")).alias("choices"))


def check_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every different tree of a region under each candidate: its units, how many of them are tied, and the choices left."""
    species = stored(region_species(spark, sf_dir))
    genes, leaves, _ = region_trees(spark, sf_dir)
    trees = stored(newick.listed(genes, leaves, sweep.KEY))
    found = stored(sweep.units(trees, species))
    named = trees.select(*sweep.KEY, F.array_join("pos", ",").alias("tree"))
    load = files.check_numbers(found, sweep.pins(trees, species, found)).join(named, sweep.KEY)
    return load.select("family", "tree", "h", "t", "groups", "fixed", "combinations")


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every region's tree over all orders, without building one."""
    species = stored(region_species(spark, sf_dir))
    genes, leaves, weights = region_trees(spark, sf_dir)
    return sweep.score_candidates(genes, leaves, weights, species, MOST_UNITS)


def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of each region and by how much each beats the species tree, which is always among the rows."""
    found = candidate_scores(spark, sf_dir)
    by = Window.partitionBy("family")
    ranked = found.withColumn("rank", F.row_number().over(by.orderBy("score", "mt_id")).cast("long")).withColumn("gain", F.max(F.when(F.col("mt_id") == 0, F.col("score"))).over(by) - F.col("score"))
    return ranked.filter((F.col("rank") <= 5) | (F.col("mt_id") == 0)).select("family", "mt_id", "h", "t", "score", "rank", "gain")


def full_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three events of each region, one after the other, each on the tree that the one before left."""
    species = region_species(spark, sf_dir).withColumn("species", F.when(F.col("lo") == F.col("hi"), F.concat(F.lit("s"), F.col("lo").cast("string"))))
    found, _ = events.full_search(*region_trees(spark, sf_dir), species, 3, MOST_UNITS)
    return found


def event_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's trees taken apart by the map of its best candidate: clades on the original and on the copy, and what is left, by their leaves."""
    species = stored(region_species(spark, sf_dir))
    genes, leaves, weights = region_trees(spark, sf_dir)
    trees = stored(newick.listed(genes, leaves, sweep.KEY))
    won = stored(events.winners(sweep.score_candidates(genes, leaves, weights, species, MOST_UNITS)))
    copies = events.winning_copies(trees, stored(sweep.units(trees, species)), won, species)
    inner, outer = surgery.partition(stored(events.labelled(trees, copies)), sweep.KEY)
    both = inner.select(*sweep.KEY, F.when(F.col("label") == 0, "original").otherwise("copy").alias("side"), F.size("pos").alias("n")).unionByName(outer.select(*sweep.KEY, F.lit("rest").alias("side"), F.size("pos").alias("n")))
    return both.join(weights, sweep.KEY).groupBy("family", "side", F.col("n").cast("long").alias("n_leaves")).agg(F.sum("weight").alias("n_trees"))


def score_valleys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valleys of each region's candidate scores; a side without one is null."""
    found = select.valleys(candidate_scores(spark, sf_dir))
    near = lambda c: F.when(F.abs(c) < float("inf"), F.round(c, 6)).alias(c)
    return found.select("family", near("input"), near("first"), near("left"), near("right"))


#: (n_best, cutoff) of candidate_selection.
CHOICES = [(3, ("input", False, 0.0)), (0, ("input", True, 0.1)), (-1, ("first", False, 500.0)), (-2, ("left", False, 0.0)), (-3, ("right", True, 0.05)), (-4, ("none", False, 0.0))]


def candidate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of each region that a search goes on with, for each way to say how many, and which of them pass."""
    scores = stored(candidate_scores(spark, sf_dir))
    bounds = stored(select.valleys(scores))
    found = None
    for n, cutoff in CHOICES:
        part = select.selected(scores, bounds, n, cutoff=cutoff).withColumn("n_best", F.lit(n))
        found = part if found is None else found.unionByName(part)
    return found


def region_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donor and target of each candidate of each region's tree."""
    return sweep.candidates(region_species(spark, sf_dir))


def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many targets each donor has, with and without those beside it."""
    species = region_species(spark, sf_dir)
    count = lambda redundant, name: sweep.candidates(species, redundant).groupBy("family", "h").agg(F.count("*").alias(name))
    return count(True, "n_all").join(count(False, "n"), ["family", "h"])


#: Trees, candidates and their node tables in SQL, after the corpus's leaves.
SPACE_SQL = """
sn AS (SELECT region AS family, CAST(1001 * rank AS INTEGER) AS node, CASE WHEN size > 1 THEN CAST(greatest(1, rank) AS INTEGER) END AS parent, rank AS lo, rank AS hi, CASE WHEN size > 1 THEN size - greatest(1, rank) ELSE 0 END AS depth FROM sl
       UNION ALL SELECT region, CAST(rank AS INTEGER), CASE WHEN rank < size - 1 THEN CAST(rank + 1 AS INTEGER) END, 0, rank, size - 1 - rank FROM sl WHERE rank > 0),
so AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY lo <> hi, hi) AS ord FROM sn),
al AS (SELECT a.family, a.node AS h, b.node AS t, a.ord AS ho, b.ord AS tb, a.node <> b.node AND a.parent IS NOT DISTINCT FROM b.parent AND a.parent IS NOT NULL AS beside
       FROM so a JOIN so b USING (family) WHERE a.node = b.node OR NOT (a.lo <= b.lo AND b.hi <= a.hi)),
ca AS (SELECT family, row_number() OVER (PARTITION BY family ORDER BY ho, tb) AS mt_id, h, t FROM al WHERE NOT beside)"""

#: Units of each donor clade under each target, and what their sister clade ties them to.
PINS_SQL = """
ls AS (SELECT gt_id, region AS family, list(rank ORDER BY place) AS s FROM gl GROUP BY ALL),
cl AS (SELECT DISTINCT family, list_concat(list_sort(s[1:2]), s[3:]) AS s FROM ls),
lf AS (SELECT family, s, unnest(s) AS pos, unnest(range(len(s))) AS leaf, len(s) AS n FROM cl),
gn AS (SELECT family, s, leaf AS lo, leaf AS hi, n FROM lf UNION ALL SELECT family, s, 0, leaf, n FROM lf WHERE leaf > 0),
sp2 AS (SELECT g.family, g.s, g.lo, g.hi, g.n, min(l.pos) AS f, max(l.pos) AS z, count(DISTINCT l.pos) AS kinds FROM gn g JOIN lf l ON g.family = l.family AND g.s = l.s AND l.leaf BETWEEN g.lo AND g.hi GROUP BY ALL),
fi AS (SELECT * FROM sp2 x WHERE lo = hi OR kinds = (SELECT sum(k.kinds) FROM sp2 k WHERE k.family = x.family AND k.s = x.s AND (k.lo = 0 AND k.hi = x.hi - 1 OR k.lo = x.hi AND k.hi = x.hi))),
mv AS (SELECT fi.*, sn.node AS h FROM fi JOIN sn ON fi.family = sn.family AND fi.f >= sn.lo AND fi.z <= sn.hi),
un AS (SELECT * FROM mv a WHERE NOT EXISTS (SELECT 1 FROM mv b WHERE b.family = a.family AND b.s = a.s AND b.h = a.h AND b.lo <= a.lo AND b.hi >= a.hi AND (b.lo <> a.lo OR b.hi <> a.hi))),
si AS (SELECT un.family, un.s, un.h, un.lo, un.hi, x.f, x.z FROM un LEFT JOIN sp2 x ON x.family = un.family AND x.s = un.s AND un.hi - un.lo + 1 < un.n
         AND (CASE WHEN un.lo = 0 THEN x.lo = un.hi + 1 AND x.hi = un.hi + 1 ELSE x.lo = 0 AND x.hi = un.lo - 1 END)),
ss AS (SELECT a.family, a.node AS h, a.lo AS hlo, a.hi AS hhi, b.lo AS slo, b.hi AS shi FROM sn a LEFT JOIN sn b ON a.family = b.family AND a.parent = b.parent AND a.node <> b.node),
st AS (SELECT si.*, ss.hlo, ss.hhi, ss.slo, ss.shi, t.node AS t, t.lo AS tlo, t.hi AS thi FROM si JOIN ss USING (family, h) JOIN al ON al.family = si.family AND al.h = si.h JOIN sn t ON t.family = si.family AND t.node = al.t),
pi AS (SELECT family, array_to_string(s, ',') AS tree, h, lo, hi, t, CAST(CASE WHEN slo <= f AND z <= shi AND t <> h AND NOT (slo <= tlo AND thi <= shi) THEN 0 WHEN tlo <= f AND z <= thi AND NOT (tlo <= hlo AND hhi <= thi) THEN 1 END AS INTEGER) AS state FROM st)
"""

#: Every candidate tree built, every choice for its units tried, every gene node's image found among its leaves' ancestors.
SCORED_SQL = (
    SPACE_SQL
    + f""",
ls AS (SELECT gt_id, region AS family, list(rank ORDER BY place) AS s FROM gl GROUP BY ALL),
cl AS (SELECT family, s, weight, row_number() OVER (ORDER BY family, s) AS gt FROM (SELECT family, list_concat(list_sort(s[1:2]), s[3:]) AS s, count(*) AS weight FROM ls GROUP BY ALL)),
lf AS (SELECT family, gt, unnest(s) AS pos, unnest(range(len(s))) AS leaf, len(s) AS n FROM cl),
gn AS (SELECT family, gt, leaf AS lo, leaf AS hi, CASE WHEN n > 1 THEN greatest(1, leaf) END AS up, 1 AS w FROM lf
       UNION ALL SELECT family, gt, 0, leaf, CASE WHEN leaf < n - 1 THEN leaf + 1 END, leaf + 1 FROM lf WHERE leaf > 0),
bl AS (SELECT g.family, g.gt, g.lo, g.hi, g.w, l.leaf, l.pos FROM gn g JOIN lf l ON g.gt = l.gt AND l.leaf BETWEEN g.lo AND g.hi),
sp2 AS (SELECT family, gt, lo, hi, w, min(pos) AS f, max(pos) AS l, count(DISTINCT pos) AS kinds FROM bl GROUP BY ALL),
ft AS (SELECT x.*, coalesce((SELECT sum(k.kinds) FROM sp2 k JOIN gn g ON k.gt = g.gt AND k.lo = g.lo AND k.hi = g.hi WHERE k.gt = x.gt AND g.up = x.hi), 0) AS apart FROM sp2 x),
fi AS (SELECT * FROM ft WHERE w = 1 OR kinds = apart),
mv AS (SELECT fi.family, fi.gt, s.node AS h, fi.lo, fi.hi, fi.w FROM fi JOIN sn s ON fi.family = s.family AND fi.f >= s.lo AND fi.l <= s.hi),
ul AS (SELECT b.gt, m.h, b.leaf, max((m.w, m.lo)) AS unit FROM bl b JOIN mv m ON b.gt = m.gt AND b.lo = m.lo AND b.hi = m.hi GROUP BY ALL),
ub AS (SELECT *, dense_rank() OVER (PARTITION BY gt, h ORDER BY unit) - 1 AS bit FROM ul),
uk AS (SELECT gt, h, max(bit) + 1 AS k FROM ub GROUP BY gt, h),
ov AS (SELECT DISTINCT gt FROM uk WHERE k > {MOST_UNITS}),
ch AS (SELECT cl.family, cl.gt, s.node AS h, unnest(range(CAST(2 ** coalesce(k, 0) AS BIGINT))) AS choice FROM cl JOIN sn s ON cl.family = s.family LEFT JOIN uk ON uk.gt = cl.gt AND uk.h = s.node WHERE cl.gt NOT IN (SELECT gt FROM ov)),
an AS (SELECT p.family, c.h, c.t, 0 AS copy, p.lo AS pos, a.node AS img, a.depth + CASE WHEN t.lo <= a.lo AND a.hi <= t.hi THEN 1 ELSE 0 END AS d
         FROM ca c JOIN sn p ON c.family = p.family AND p.lo = p.hi JOIN sn a ON a.family = p.family AND a.lo <= p.lo AND p.lo <= a.hi JOIN sn t ON t.family = c.family AND t.node = c.t
       UNION ALL SELECT p.family, c.h, c.t, 0, p.lo, -1, t.depth FROM ca c JOIN sn t ON t.family = c.family AND t.node = c.t JOIN sn p ON p.family = c.family AND p.lo = p.hi AND p.lo BETWEEN t.lo AND t.hi
       UNION ALL SELECT p.family, c.h, c.t, 1, p.lo, 100000 + a.node, t.depth + 1 + a.depth - h.depth
         FROM ca c JOIN sn h ON h.family = c.family AND h.node = c.h JOIN sn t ON t.family = c.family AND t.node = c.t JOIN sn a ON a.family = c.family AND h.lo <= a.lo AND a.hi <= h.hi JOIN sn p ON p.family = c.family AND p.lo = p.hi AND p.lo BETWEEN a.lo AND a.hi
       UNION ALL SELECT p.family, c.h, c.t, 1, p.lo, -1, t.depth FROM ca c JOIN sn h ON h.family = c.family AND h.node = c.h JOIN sn t ON t.family = c.family AND t.node = c.t JOIN sn p ON p.family = c.family AND p.lo = p.hi AND p.lo BETWEEN h.lo AND h.hi
       UNION ALL SELECT p.family, c.h, c.t, 1, p.lo, a.node, a.depth FROM ca c JOIN sn h ON h.family = c.family AND h.node = c.h JOIN sn t ON t.family = c.family AND t.node = c.t JOIN sn a ON a.family = c.family AND a.lo <= t.lo AND t.hi <= a.hi AND a.node <> t.node JOIN sn p ON p.family = c.family AND p.lo = p.hi AND p.lo BETWEEN h.lo AND h.hi),
ax AS (SELECT * FROM an UNION ALL SELECT p.family, -1, -1, 0, p.lo, a.node, a.depth FROM sn p JOIN sn a ON p.lo = p.hi AND a.family = p.family AND p.lo BETWEEN a.lo AND a.hi),
gc AS (SELECT bl.*, ch.h, ch.choice, CASE WHEN ub.bit IS NULL THEN 0 ELSE (ch.choice >> ub.bit) & 1 END AS copy FROM ch JOIN bl ON bl.gt = ch.gt LEFT JOIN ub ON ub.gt = ch.gt AND ub.h = ch.h AND ub.leaf = bl.leaf
       UNION ALL SELECT bl.*, -1, 0, 0 FROM bl WHERE gt NOT IN (SELECT gt FROM ov)),
cv AS (SELECT gc.family, gc.gt, gc.h, ax.t, gc.choice, gc.lo, gc.hi, gc.w, ax.img, ax.d FROM gc JOIN ax ON gc.family = ax.family AND gc.h = ax.h AND gc.copy = ax.copy AND gc.pos = ax.pos
       GROUP BY ALL HAVING count(*) = gc.w),
ig2 AS (SELECT family, gt, h, t, choice, lo, hi, w, arg_max(img, d) AS img, max(d) AS d FROM cv GROUP BY ALL),
up2 AS (SELECT i.*, g.up FROM ig2 i JOIN gn g ON g.gt = i.gt AND g.lo = i.lo AND g.hi = i.hi),
nd AS (SELECT p.family, p.gt, p.h, p.t, p.choice, p.d, max(CASE WHEN k.img = p.img THEN 1 ELSE 0 END) AS dup, list(k.d) AS ds FROM up2 p JOIN up2 k ON k.gt = p.gt AND k.h = p.h AND k.t = p.t AND k.choice = p.choice AND p.w > 1 AND k.up = p.hi GROUP BY p.family, p.gt, p.h, p.t, p.choice, p.lo, p.hi, p.d),
ns AS (SELECT family, gt, h, t, choice, sum(dup + list_sum(list_transform(ds, lambda x: greatest(0, x - d - 1 + dup)))) AS c FROM nd GROUP BY ALL),
ro AS (SELECT family, gt, h, t, choice, d FROM up2 WHERE up IS NULL),
co AS (SELECT ro.family, ro.gt, ro.h, ro.t, min(ro.d + coalesce(c, 0)) AS cost FROM ro LEFT JOIN ns USING (family, gt, h, t, choice) GROUP BY ALL),
su AS (SELECT co.family, co.h, co.t, CAST(sum(cost * weight) AS DOUBLE) AS score FROM co JOIN cl ON cl.gt = co.gt GROUP BY ALL),
ct AS (SELECT family, CAST(sum(CASE WHEN gt IN (SELECT gt FROM ov) THEN 0 ELSE weight END) AS BIGINT) AS n_trees, CAST(sum(CASE WHEN gt IN (SELECT gt FROM ov) THEN weight ELSE 0 END) AS BIGINT) AS n_skipped FROM cl GROUP BY family),
fs AS (SELECT su.family, coalesce(ca.mt_id, 0) AS mt_id, ca.h, ca.t, score, n_trees, n_skipped FROM su LEFT JOIN ca ON ca.family = su.family AND ca.h = su.h AND ca.t = su.t JOIN ct ON ct.family = su.family)
"""
)

QUERIES = {f.__name__: f for f in (candidate_scores, candidate_ranking, region_candidates, candidate_counts, sweep_scores, pin_states, free_units, check_numbers, full_events, event_partition, score_valleys, candidate_selection)}

_Q = "WITH " + corpus.LEAVES_SQL + ","
_VALLEYS = """,
vc AS (SELECT family, score, count(*) AS m FROM fs WHERE score IS NOT NULL GROUP BY ALL),
vt AS (SELECT family, count(*) AS n, min(score) AS low, max(score) AS high, stddev_samp(score) * count(*) ** -0.2 AS h, max(CASE WHEN mt_id = 0 THEN score END) AS input FROM fs WHERE score IS NOT NULL GROUP BY family),
vg AS (SELECT family, p, low + (high - low) * p / 99 AS x, n, h FROM vt, (SELECT unnest(range(100)) AS p) WHERE n >= 3 AND high > low),
vd AS (SELECT family, p, x, sum(m * exp(-power((x - score) / h, 2) / 2)) AS d FROM vg JOIN vc USING (family) GROUP BY family, p, x),
vl AS (SELECT family, x FROM (SELECT *, lag(d) OVER w AS b, lead(d) OVER w AS a FROM vd WINDOW w AS (PARTITION BY family ORDER BY p)) WHERE d < a AND d < b),
va AS (SELECT vt.family, input, coalesce(min(x), any_value(high)) AS "first", coalesce(max(x) FILTER (x < input), '-infinity'::DOUBLE) AS "left", coalesce(min(x) FILTER (x > input), 'infinity'::DOUBLE) AS "right" FROM vt LEFT JOIN vl USING (family) GROUP BY vt.family, input)
"""


def _selection_sql() -> str:
    rank = "rk AS (SELECT family, mt_id, score, row_number() OVER (PARTITION BY family ORDER BY score, mt_id) AS rank FROM fs WHERE mt_id > 0)"
    parts = ["SELECT family, 0 AS mt_id, input AS score, NULL::BIGINT AS rank, true AS passed, unnest([" + ", ".join(str(n) for n, _ in CHOICES) + "]) AS n_best FROM va"]
    for n, (reference, relative, offset) in CHOICES:
        keep = f'rank <= {n}' if n > 0 else f'(score <= "{select.BREAKS[n]}" OR rank = 1)' if n in select.BREAKS else "true"
        passed = "true" if reference == "none" else f'{offset}::DOUBLE * {chr(34) + reference + chr(34) if relative else "1"} < "{reference}" - score'
        parts.append(f"SELECT family, mt_id, score, rank, {passed}, {n} FROM rk JOIN va USING (family) WHERE {keep}")
    return _VALLEYS + ", " + rank + " ".join([" ", " UNION ALL ".join(parts)])


ORACLE_SQL = {
    "candidate_scores": _Q + SCORED_SQL + "SELECT family, mt_id, h, t, score, n_trees, n_skipped FROM fs",
    "candidate_ranking": _Q + SCORED_SQL + "SELECT family, mt_id, h, t, score, rank, gain FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score, mt_id) AS rank, max(CASE WHEN mt_id = 0 THEN score END) OVER (PARTITION BY family) - score AS gain FROM fs) WHERE rank <= 5 OR mt_id = 0",
    "score_valleys": _Q + SCORED_SQL + _VALLEYS + 'SELECT family, round(input, 6) AS input, round("first", 6) AS "first", CASE WHEN isfinite("left") THEN round("left", 6) END AS "left", CASE WHEN isfinite("right") THEN round("right", 6) END AS "right" FROM va',
    "candidate_selection": _Q + SCORED_SQL + _selection_sql(),
    "pin_states": _Q + SPACE_SQL + "," + PINS_SQL + "SELECT * FROM pi",
    "free_units": _Q + SPACE_SQL + "," + PINS_SQL + ", w AS (SELECT family, tree, h, t, count(*) FILTER (state IS NULL) AS n_free FROM pi GROUP BY ALL) SELECT family, h, t, n_free, count(*) AS n_trees, sum(2.0::DOUBLE ** n_free) AS choices FROM w GROUP BY family, h, t, n_free",
    "check_numbers": _Q + SPACE_SQL + "," + PINS_SQL + "SELECT family, tree, h, t, count(*) AS groups, count(state) AS fixed, 2.0::DOUBLE ** (count(*) - count(state)) AS combinations FROM pi GROUP BY family, tree, h, t",
    "region_candidates": _Q + SPACE_SQL + " SELECT * FROM ca",
    "candidate_counts": _Q + SPACE_SQL + " SELECT family, h, count(*) AS n_all, count(*) FILTER (NOT beside) AS n FROM al GROUP BY family, h",
}
