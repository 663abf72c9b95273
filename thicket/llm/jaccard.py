"""Join of documents by Jaccard similarity of their word n-grams, with prefix filters under several global token orders.

Two sets can only be similar enough if they share a token among the first few of each, in whatever order all tokens are put.
Three orders are used, all of which put tokens last that came up often and break ties by different hashes. How often is counted
by 2^BUCKET_BITS buckets of tokens, over all sets, so that what tasks hold stays small; any order is right. Documents with
equal sets form a class, of which one member stands for all. Classes meet on the tokens of their first prefix; a pair goes on
only if its sizes fit and its prefixes under the second and the third order meet as well; then the sets are compared. Before
prefixes are fetched, bitmaps of the parities of hashed tokens meet: they differ in no more bits than the sets in tokens, so
pairs whose bitmaps differ in too many can't be similar. Large sets fill a bitmap, so they have a wider one besides.

Most groups have a few members: all their pairs come from one sort by token, and the token is done with. Members of a larger group
are only paired with one leader there and in each of a few more rounds, and the links found join components; at the end the pairs left are those across components, taken as the members outside a
group's largest component against its others. Links inside a component would change nothing.

Pairs across components of a token with many members are further split by bands of set sizes, since sets too far apart in size can't be similar.
They carry the bitmaps folded to SKETCH bits, which bound the same number, so that most pairs end inside the join that makes them.
Members of a group that are of no common component are still compared there with each other, which grows with the group's square.

Defined results: a text without words, or null, has an empty set and is linked with nothing. Fewer words than n are one token.
component_id is the smallest doc_id of the component, null ids aside. Repeated rows are members each. `link` returns the three
columns doc_id, n_shingles and component_id alone; `one_of_each` keeps all columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forgotten, small_batches, stored, workers_find_package

#: Odd multipliers that mix word hashes, and that make one token order from another.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Buckets of tokens that are counted, and the occurrences from which a bucket of an average one's multiple is ranked by its count.
BUCKET_BITS, OFTEN, MULTIPLE = 21, 32, 4
ROUNDS = 2
#: Members of a token up to which all its pairs are made at once: at most (SMALL - 1) / 2 pairs for each member.
SMALL = 8
#: Bytes of tokens that a task gathers before it adds them to its counts of buckets.
GATHERED = 1 << 22
#: Members of a token up to which its last pairs aren't split by bands, which would copy each member three times.
UNBANDED = 64
#: Bits of a set's bitmap, and of its fold; the first is a multiple of the second.
BITMAP, SKETCH = 1024, 256
#: Tokens above which a set also has a wider bitmap, and its bits.
LARGE, WIDE = 2048, 8192
#: Ids up to this many are broadcast, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def mixed(h: np.ndarray, k: int = 0) -> np.ndarray:
    h = h * np.uint64(MIX[k])
    h ^= h >> np.uint64(29)
    h *= np.uint64(MIX[(k + 1) % 3])
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams, with A-Z in lower case."""
    words = (text or b"").lower().split()  # splits at exactly 0x20 and 0x09 to 0x0D
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    if len(h) < n:
        return np.array([xxhash.xxh3_64_intdigest(b"%d " % len(h) + h.tobytes())], dtype=np.uint64)
    token = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        token = mixed(token) + h[i : len(h) - n + 1 + i]
    return np.unique(mixed(token, 1))


def buckets(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def prefixes(tokens: np.ndarray, rank: np.ndarray, percent: int, orders=(0, 1, 2)) -> list[np.ndarray]:
    """The tokens that come first under given orders, as many as a similar set must meet; rank by bucket grows with how often."""
    p = len(tokens) - -(-len(tokens) * percent // 100) + 1
    if p >= len(tokens):
        return [tokens] * len(orders)
    high = rank[buckets(tokens)].astype(np.uint64) << np.uint64(48)
    return [tokens[np.argpartition(high | mixed(tokens, k) >> np.uint64(16), p - 1)[:p]] for k in orders]


def least_shared(percent: int) -> Column:
    """How many tokens the first prefixes of similar sets have in common at least; columns nx and ny are their sizes, ny the larger.

    Similar sets have percent / (100 + percent) of both sizes in common. Of these tokens in order the k-th lies in a set's prefix
    if k and all tokens that the set has alone are no more than the prefix's length, which is least so in the larger set.
    """
    return F.expr(f"({percent} * (nx + ny) + {99 + percent}) div {100 + percent} + 1 - ({percent} * ny + 99) div 100")


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """For each row of texts (a, b, doc_id, text) its set: sorted tokens as binary, their number, and a signature of the set."""

    def made(batches):
        for batch in batches:
            found = [shingles(text, n) for text in batch.column(3).cast(pa.binary()).to_pylist()]
            signs = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in found]
            high, low = pa.array([(s >> 64) - (1 << 63) for s in signs], pa.int64()), pa.array([(s & (1 << 64) - 1) - (1 << 63) for s in signs], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(map(len, found)), pa.int64()), high, low, pa.array([x.tobytes() for x in found], pa.binary())], names=["a", "b", "doc_id", "n", "s1", "s2", "tokens"])

    return texts.select("a", "b", "doc_id", "text").mapInArrow(made, "a long, b long, doc_id long, n long, s1 long, s2 long, tokens binary")


def _ranks(sets: DataFrame) -> np.ndarray:
    """How often the tokens of each bucket come up, where that is far more than on average, else 0."""

    def counted(batches):
        seen, held, size = np.zeros(1 << BUCKET_BITS, dtype=np.int64), [], 0
        for batch in batches:
            for tokens in batch.column(0).to_pylist():
                held.append(tokens)
                size += len(tokens)
                if size > GATHERED:
                    seen += counts(held)
                    held, size = [], 0
        yield told(seen + counts(held))

    def counts(held):
        return np.bincount(buckets(np.frombuffer(b"".join(held), np.uint64)), minlength=1 << BUCKET_BITS)

    def told(seen):
        at = np.flatnonzero(seen >= max(4, MULTIPLE * seen.mean()))
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "times"])

    found = sets.select("tokens").mapInArrow(counted, "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times")).filter(F.col("times") >= OFTEN).toArrow()
    rank = np.zeros(1 << BUCKET_BITS, dtype=np.uint16)
    rank[found["bucket"].to_numpy()] = np.minimum(found["times"].to_numpy(), 65535)
    return rank


def _described(sets: DataFrame, percent: int, held) -> DataFrame:
    """(id, n, first, bits, wide): each set's prefix under the first order, and its bitmaps; wide is null for small sets. held is the broadcast ranks."""

    def bitmap(x, bits):
        return np.packbits(np.bincount((x % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).view(np.int64)

    def describe(batches):
        for batch in batches:
            tokens = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            first = pa.array([prefixes(x, held.value, percent, (0,))[0].view(np.int64) for x in tokens], pa.list_(pa.int64()))
            bits = pa.array([bitmap(x, BITMAP) for x in tokens], pa.list_(pa.int64()))
            wide = pa.array([bitmap(x, WIDE) if len(x) > LARGE else None for x in tokens], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), first, bits, wide], names=["id", "n", "first", "bits", "wide"])

    return sets.select("id", "n", "tokens").mapInArrow(describe, "id long, n long, first array<long>, bits array<long>, wide array<long>")


def _other_prefixes(sets: DataFrame, percent: int, held) -> DataFrame:
    """(id, second, third): each set's prefixes under the other orders, their tokens cut to 32 bits."""

    def describe(batches):
        for batch in batches:
            rows = [prefixes(np.frombuffer(x, np.uint64), held.value, percent, (1, 2)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k].astype(np.uint32).view(np.int32) for r in rows], pa.list_(pa.int32())) for k in (0, 1)]], names=["id", "second", "third"])

    return sets.select("id", "tokens").mapInArrow(describe, "id long, second array<int>, third array<int>")


def _paired(entries: DataFrame, percent: int) -> DataFrame:
    """(token, id, n, others) of entries (id, n, token) that share their token: ids to compare each with; token is null once that settles its group."""
    order = Window.partitionBy("token").orderBy("id")
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct("id", "n")
    entries = entries.select("*", F.count("*").over(group).alias("size"), F.first(row).over(group).alias("lead"), F.array(*[F.lead(row, k).over(order) for k in range(1, SMALL)]).alias("next"))
    large = F.col("size") > SMALL
    near = lambda o: o.isNotNull() & (o["id"] != F.col("id")) & (100 * F.least("n", o["n"]) >= percent * F.greatest("n", o["n"]))
    others = F.filter(F.when(large, F.array("lead")).otherwise(F.col("next")), near)
    kept = entries.filter("size > 1").select(F.when(large, F.col("token")).alias("token"), "id", "n", others.alias("others"))
    return kept.filter("token IS NOT NULL OR size(others) > 0")


def _apart(x: str, y: str, bits: int) -> Column:
    """In how many places bitmaps differ; columns or array items are named by a pattern of the word's number."""
    return F.expr(" + ".join(f"bit_count({x.format(i)} ^ {y.format(i)})" for i in range(bits // 64)))


def _sketches(details: DataFrame) -> DataFrame:
    """(id, s0, s1, ...): the bitmaps of details folded to SKETCH bits."""
    words = SKETCH // 64
    return details.select("id", *[F.expr(" ^ ".join(f"bits[{j}]" for j in range(i, BITMAP // 64, words))).alias(f"s{i}") for i in range(words)])


def _small(ids: DataFrame) -> DataFrame:
    """A stored table of ids, to be broadcast if it is small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of stored pairs (x, y) whose sets are similar enough."""

    def compare(batches):
        for batch in batches:
            x, y, a, b = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for k in range(len(x)):
                p, q = np.frombuffer(a[k], np.uint64), np.frombuffer(b[k], np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= percent * (len(p) + len(q) - common):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["x", "y"])

    ends = stored(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct())
    some = stored(sets.join(_small(ends), "id", "left_semi").select("id", "tokens"))
    forgotten(ends)
    left = some.select(F.col("id").alias("x"), F.col("tokens").alias("a")).join(_small(pairs), "x")
    found = stored(left.join(some.select(F.col("id").alias("y"), F.col("tokens").alias("b")), "y").select("x", "y", "a", "b").mapInArrow(compare, "x long, y long"))
    forgotten(some)
    return found


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of the ends of edges (x, y): the smallest id that links reach. Labels jump to their label's label each round."""
    both = stored(edges.union(edges.select("y", "x")).distinct())
    labels = both.groupBy("x").agg(F.min(F.least("x", "y")).alias("component")).withColumnRenamed("x", "id")
    labels = stored(labels)
    while True:
        near = both.join(labels, both.y == labels.id).select(F.col("x").alias("id"), "component")
        jump = labels.join(labels.select(F.col("id").alias("component"), F.col("component").alias("to")), "component").select("id", F.col("to").alias("component"))
        new = stored(labels.unionByName(near).unionByName(jump).groupBy("id").agg(F.min("component").alias("component")))
        settled = new.join(labels.withColumnRenamed("component", "old"), "id").filter("component != old").isEmpty()
        forgotten(labels)
        labels = new
        if settled:
            forgotten(both)
            return labels


def link(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    texts = docs.select(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return components(texts, n, percent).select("doc_id", "n_shingles", "component_id")


def components(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, doc_id, n_shingles, component, component_id) for rows of texts (a, b, doc_id, text); component is null for an empty set."""
    workers_find_package(texts.sparkSession)
    small_batches(texts.sparkSession)
    made = stored(_sets(texts, n).withColumn("id", F.monotonically_increasing_id()))
    members = made.select("a", "b", "id", "doc_id", "n", "s1", "s2")
    filled = members.filter("n > 0")
    first_of = stored(filled.groupBy("s1", "s2").agg(F.min("id").alias("id")))
    # Mostly the smaller part of the rows: members of a class that another one stands for.
    others = stored(filled.select("id").join(first_of.select("id"), "id", "left_anti"))
    sets = made.filter("n > 0").join(_small(others), "id", "left_anti").select("id", "n", "tokens")
    ranks = made.sparkSession.sparkContext.broadcast(_ranks(sets))  # two bytes a bucket
    details = stored(_described(sets, percent, ranks))
    # Dealt before the window, which would send its own columns too.
    paired = stored(_paired(details.select("id", "n", F.explode("first").alias("token")).repartition("token"), percent))
    postings = paired.filter("token IS NOT NULL").select("token", "id", "n")
    edges, labels, links = None, None, []

    def labelled(p):
        if labels is None:
            return p.withColumn("component", F.col("id"))
        return p.join(_small(labels), "id", "left").withColumn("component", F.coalesce("component", "id"))

    def both_ends(pairs, made_of):
        """Stored pairs (x, y) with columns that made_of gives for ids of both ends."""
        ends = stored(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct())
        some = stored(made_of(_small(ends)))
        forgotten(ends)
        side = lambda end: some.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in some.columns if c != "id"])
        return pairs.join(side("x"), "x").join(side("y"), "y"), some

    def in_reach(apart, nx, ny):
        """Of similar sets, (100 - percent) / (100 + percent) of both sizes' sum are in one of them alone at most."""
        return (100 + percent) * apart <= (100 - percent) * (F.col(nx) + F.col(ny))

    def verified(pairs):
        """Those of stored pairs (x, y) that pass the bitmaps' and the other orders' filters."""
        apart = _apart("bits_x[{}]", "bits_y[{}]", BITMAP)
        both, maps = both_ends(pairs, lambda ends: details.select("id", "n", "bits").join(ends, "id", "left_semi"))
        near = stored(both.filter(in_reach(apart, "n_x", "n_y")).select("x", "y", (F.least("n_x", "n_y") > LARGE).alias("large")))
        # Wider bitmaps are only fetched for the pairs of large sets that these have left.
        wider = F.expr("aggregate(zip_with(wide_x, wide_y, (p, q) -> bit_count(p ^ q)), 0, (s, k) -> s + k)")
        both, wides = both_ends(near.filter("large").select("x", "y"), lambda ends: details.select("id", "n", "wide").join(ends, "id", "left_semi"))
        left = stored(both.filter(in_reach(wider, "n_x", "n_y")).select("x", "y").unionByName(near.filter("NOT large").select("x", "y")))
        meet = F.arrays_overlap("second_x", "second_y") & F.arrays_overlap("third_x", "third_y")
        both, others = both_ends(left, lambda ends: _other_prefixes(sets.join(ends, "id", "left_semi"), percent, ranks))
        found = stored(both.filter(meet).select("x", "y"))
        for table in (maps, near, wides, left, others):
            forgotten(table)
        return found

    def settle(pairs):
        """Adds the links among pairs to the edges; false if there were none."""
        nonlocal edges, labels
        met = stored(pairs)
        passed = verified(met)
        forgotten(met)
        if passed.isEmpty():
            forgotten(passed)
            return False
        new = _linked(passed, sets, percent)
        forgotten(passed)
        links.append(new)
        if new.isEmpty():
            return False
        edges = new if edges is None else edges.unionByName(new)
        if labels is not None:
            forgotten(labels)
        labels = connected(edges)
        return True

    sizes = lambda m, n: (F.least(m, n).alias("nx"), F.greatest(m, n).alias("ny"))
    other = paired.select("id", "n", "token", F.explode("others").alias("other"))
    pair = [F.least("id", "other.id").alias("x"), F.greatest("id", "other.id").alias("y")]
    small = other.filter("token IS NULL").select(*pair, *sizes("n", "other.n")).groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("met"))
    small = stored(small)
    # A pair may share all tokens that one of both has in larger groups.
    large = stored(postings.groupBy("id").agg(F.count("*").alias("large")))
    both = small
    for end in ("x", "y"):
        both = both.join(large.select(F.col("id").alias(end), F.col("large").alias(f"large_{end}")), end, "left")
    likely = both.filter(F.col("met") + F.least(F.coalesce("large_x", F.lit(0)), F.coalesce("large_y", F.lit(0))) >= least_shared(percent))
    found = settle(likely.select("x", "y").union(other.filter("token IS NOT NULL").select(*pair)).distinct())
    forgotten(large)
    for k in range(1, ROUNDS):
        if not found:
            break
        now = labelled(postings).repartition("token")
        groups = now.groupBy("token").agg(F.min_by(F.struct("id", "n", "component"), F.xxhash64("id", F.lit(k))).alias("lead"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("token", "lead")
        # Tokens whose members are all of one component have no more to tell.
        alive = stored(now.join(groups, "token"))
        forgotten(postings)
        postings = alive.select("token", "id", "n")
        near = 100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")
        star = alive.filter((F.col("component") != F.col("lead.component")) & near).select(F.least("id", "lead.id").alias("x"), F.greatest("id", "lead.id").alias("y")).distinct()
        found = settle(star)
    now = stored(labelled(postings).join(_sketches(details), "id"))
    marks = [f"s{i}" for i in range(SKETCH // 64)]
    parts = now.groupBy("token", "component").agg(F.count("*").alias("size"))
    largest = parts.groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.count("*").alias("parts"), (F.sum("size") > UNBANDED).alias("banded")).filter("parts > 1").select("token", "largest", "banded")
    # Sets may differ in size by one band at most; bands are a trifle wide for rounding.
    # Never null, or else a filter would keep Spark from reading one exchange for both joins.
    band = F.coalesce(F.floor(F.log("n") / (F.log(F.lit(100.0 / percent)) * 1.000001)).cast("int") if percent < 100 else F.col("n").cast("int"), F.lit(0))
    met = now.join(largest, "token")
    away = met.filter("component != largest")
    one = [F.col("id").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"), *[F.col(c).alias(f"{c}x") for c in marks]]
    other = [F.col("id").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"), "largest", *[F.col(c).alias(f"{c}y") for c in marks]]
    # A pair of two small components would come up from both sides.
    once = (F.col("cy") == F.col("largest")) | (F.col("x") < F.col("y"))
    fit = (F.col("cx") != F.col("cy")) & once & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & in_reach(_apart("s{}x", "s{}y", SKETCH), "nx", "ny")
    same = lambda c: F.col(f"l.{c}") == F.col(f"r.{c}")
    # Both sides lie by token already, so only what goes by bands is dealt again.
    few = away.filter("NOT banded").select("token", *one).alias("l").join(met.filter("NOT banded").select("token", *other).alias("r"), same("token") & fit)
    bands = F.explode(F.array(band - 1, band, band + 1)).alias("band")
    many = away.filter("banded").select("token", band.alias("band"), *one).alias("l").join(met.filter("banded").select("token", bands, *other).alias("r"), same("token") & same("band") & fit)
    across = few.select("x", "y", "nx", "ny").union(many.select("x", "y", "nx", "ny"))
    # Here a pair comes up once for each token of larger groups that it shares.
    across = across.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), *sizes("nx", "ny")).groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("more"))
    settle(across.join(small.select("x", "y", "met"), ["x", "y"], "left").filter(F.col("more") + F.coalesce("met", F.lit(0)) >= least_shared(percent)).select("x", "y"))
    class_of = filled.select("a", "b", "doc_id", "n", "s1", "s2").join(first_of, ["s1", "s2"]).select("a", "b", "doc_id", F.col("n").alias("n_shingles"), "id")
    alone = members.filter("n = 0").select("a", "b", "doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"))
    row = stored(labelled(class_of).drop("id").unionByName(alone))
    for table in (now, details, postings, small, made, first_of, others, *links, *([] if labels is None else [labels])):
        forgotten(table)
    smallest = row.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = row.filter("component IS NOT NULL").join(smallest, "component").select("a", "b", "doc_id", "n_shingles", "component", "component_id")
    return linked.unionByName(row.filter("component IS NULL").withColumn("component_id", F.col("doc_id")))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id, nulls last. Rows with an empty set all stay.

    Rows are named by 128 bits of doc_id and text, so that texts stay where they are; of equal rows of a component one stays.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    name = [F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit("second"), doc_id, text).alias("b")]
    every = components(docs.select(*name, doc_id.alias("doc_id"), text.alias("text")), n, percent)
    found = stored(every.filter("component IS NOT NULL").select("a", "b", "doc_id", "component"))
    forgotten(every)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")
    stays = found.groupBy("component").agg(F.min(first).alias("first")).select("first.a", "first.b")
    goes = stored(found.select("a", "b").distinct().join(stays, ["a", "b"], "left_anti").withColumn("more", F.lit(False)).unionByName(found.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").join(stays, ["a", "b"], "left_semi").select("a", "b", F.lit(True).alias("more"))))
    forgotten(found)
    inner = docs.withColumns({"_a": name[0], "_b": name[1]})
    same = (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b"))
    left = inner.join(_small(goes), same, "left_anti")
    again = goes.filter("more")
    if not again.isEmpty():
        left = left.unionByName(inner.join(_small(again), same, "left_semi").dropDuplicates(["_a", "_b"]))
    return left.drop("_a", "_b")
