"""Quality rules: simple counts, and how far a document's histograms lie from its language's, in DataFrame functions only.

Two histograms are compared with the language's reference by Jensen-Shannon distance (base 2, from 0 to 1): the classes of
the characters in words, and the language's most common words with all others as one more bin. References count every word of
every document of a language; languages with under `least_docs` documents, and documents without one, share a reference over
all documents. A document is rejected if a distance exceeds its limit and the document is long enough for that distance to
mean something. Limits come from the corpus: for each reference the median of the distances of its long enough documents that
pass the base rules, plus a multiple of their median deviation from it. Distances are counted by BINS equal bins first, so a
limit is made from a small table whatever the corpus. Rules without multiples use fixed limits.

Defined results: a null or blank text has no words, so it fails the base rules. Ties among common words go to the word that
sorts first. Repeated rows are judged each. Columns named like the added ones are replaced; the others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, stored

#: Character classes, by the pattern of their members; what is left is a class of its own.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "letter": r"\p{L}", "digit": r"\p{N}", "mark": r"\p{M}", "punctuation": r"\p{P}"}
GAPS = " \t\n\x0b\x0c\r"
#: Bins of a distance from 0 to 1, and the least median deviation in bins, for documents that are all alike.
BINS, LEAST_SPREAD = 10_000, 10
#: Names of rejected texts up to this many are broadcast, some 30 bytes each; more are joined by a shuffle.
BROADCAST_NAMES = 1_000_000
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]


@dataclass(frozen=True)
class Rules:
    least_words: int = 50
    #: Percent of words in repeated three-word windows.
    most_repeated: int = 50
    common_words: int = 32
    least_docs: int = 100
    class_limit: float = 0.35
    word_limit: float = 0.75
    #: Median deviations from the median that take the place of the fixed limits.
    class_spread: float | None = None
    word_spread: float | None = None
    #: Lengths under which a distance says too little to reject.
    class_guard: int = 200
    word_guard: int = 80


#: What the query and the pipeline judge by. Class distances are narrow with a long tail of short texts, word distances wide.
CORPUS = Rules(class_spread=12.0, word_spread=3.5)


def words(text):
    """Array of a text's words; empty for null."""
    for gap in GAPS[1:]:
        text = F.replace(text, F.lit(gap), F.lit(" "))
    return F.coalesce(F.array_remove(F.split(text, " "), ""), F.array().cast("array<string>"))


def class_counts(joined):
    """Characters of each class, then of none; each pattern only sees what the ones before it left."""
    counts, rest = [], joined
    for name, pattern in CLASSES.items():
        less = F.regexp_replace(F.regexp_replace(rest, "[a-z]+", "") if name == "lower" else rest, f"{pattern}+", "")
        counts.append(F.length(rest) - F.length(less))
        rest = less
    return F.array(*counts, F.length(rest)).cast("array<double>")


def measured(docs: DataFrame) -> DataFrame:
    """docs with its words, their hashes, the base counts and the class counts.

    Arrays are columns of their own, each used more than once by what follows, so that none is made again for every element.
    """
    docs = docs.withColumn("_words", words(F.col("text")))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(GAPS)) != "")
    docs = docs.withColumns({"_joined": F.array_join("_words", ""), "_lines": lines, "_hashes": F.transform("_words", lambda x: F.xxhash64(x)), "_bits": F.expr("greatest(1, int(ceil(log2(size(_words) + 1.0))))")})
    # Hashes and places of windows, sorted: the place is in the low bits.
    docs = docs.withColumn(
        "_keys",
        F.expr(
            "CASE WHEN size(_hashes) >= 4 THEN sort_array(transform(zip_with(zip_with(slice(_hashes, 1, size(_hashes) - 2), slice(_hashes, 2, size(_hashes) - 2), (a, b) -> xxhash64(a, b)), slice(_hashes, 3, size(_hashes) - 2), (a, b) -> xxhash64(a, b)), "
            "(x, i) -> shiftleft(x, _bits) | i)) ELSE cast(array() AS array<bigint>) END"
        ),
    )
    # Places of windows whose neighbour in the order has the same hash; only these are compared word by word.
    docs = docs.withColumn(
        "_pairs",
        F.expr(
            "CASE WHEN size(_keys) > 1 THEN filter(zip_with(_keys, slice(_keys, 2, size(_keys) - 1), (a, b) -> CASE WHEN shiftright(a ^ b, _bits) = 0 THEN struct(int(a & (shiftleft(1L, _bits) - 1)) AS p, int(b & (shiftleft(1L, _bits) - 1)) AS q) END), x -> x IS NOT NULL) "
            "ELSE cast(array() AS array<struct<p: int, q: int>>) END"
        ),
    )
    repeated = F.expr(
        "CASE WHEN size(_pairs) = 0 THEN 0L ELSE bigint(size(array_distinct(flatten(transform(filter(_pairs, x -> _words[x.p] = _words[x.q] AND _words[x.p + 1] = _words[x.q + 1] AND _words[x.p + 2] = _words[x.q + 2]), "
        "x -> array(x.p, x.p + 1, x.p + 2, x.q, x.q + 1, x.q + 2)))))) END"
    )
    symbols = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^#*$%&|<>]+", ""))
    return docs.select(
        *[c for c in docs.columns if c not in ("_lines", "_bits", "_keys", "_pairs", "_joined")],
        F.size("_words").cast("long").alias("n_words"),
        F.length("_joined").cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        class_counts(F.col("_joined")).alias("_classes"),
    )


def common_hits(docs: DataFrame, common, most: int) -> DataFrame:
    """docs with _hits, how often each of its language's common words occurs among _words.

    One letter stands for each word, the first for all that aren't common; letters are counted by what a text loses with them.
    """
    letters = [chr(0x100 + i) for i in range(most + 1)]
    docs = docs.withColumn("_common", F.transform(common, lambda x: F.xxhash64(x)))
    place = F.transform("_hashes", lambda x: F.get(F.array(*map(F.lit, letters)), F.array_position("_common", x).cast("int")))
    docs = docs.withColumn("_letters", F.array_join(place, ""))
    counts = F.array(*[(F.length("_letters") - F.length(F.replace("_letters", F.lit(x), F.lit("")))).cast("double") for x in letters[1:]])
    return docs.withColumn("_hits", F.slice(counts, F.lit(1), F.size("_common")))


def references(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(lang, class_share, common, common_share): what documents of a language look like; lang null is all documents."""
    each = docs.select(F.col("lang").cast("string").alias("lang"), F.explode(words(F.col("text"))).alias("word"))
    counts = checkpointed(each.groupBy("lang", "word").agg(F.count("*").alias("n")))
    enough = docs.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("docs")).filter((F.col("docs") >= rules.least_docs) & F.col("lang").isNotNull()).select("lang")
    bins = range(len(CLASSES) + 1)
    classed = counts.select("lang", "n", class_counts(F.col("word")).alias("classes"))
    by_lang = checkpointed(classed.groupBy("lang").agg(F.sum("n").alias("total"), *[F.sum(F.col("n") * F.col("classes")[i]).alias(f"c{i}") for i in bins]))
    overall = by_lang.agg(F.sum("total").alias("total"), *[F.sum(f"c{i}").alias(f"c{i}") for i in bins]).select(F.lit(None).cast("string").alias("lang"), "*")
    totals = by_lang.join(F.broadcast(enough), "lang", "left_semi").unionByName(overall)
    pooled = counts.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "word", "n")
    counts = counts.join(F.broadcast(enough), "lang", "left_semi").select("lang", "word", "n").unionByName(pooled)
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    common = counts.withColumn("place", F.row_number().over(by_count)).filter(F.col("place") <= rules.common_words)
    top = common.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
    both = totals.alias("t").join(top.alias("p"), F.col("t.lang").eqNullSafe(F.col("p.lang")))
    chars = sum((F.col(f"c{i}") for i in range(1, len(CLASSES) + 1)), F.col("c0"))
    shares = F.transform("top", lambda x: x["n"] / F.col("total"))
    return both.select(
        "t.lang",
        F.array(*[F.col(f"c{i}") / chars for i in range(len(CLASSES) + 1)]).alias("class_share"),
        F.transform("top", lambda x: x["word"]).alias("common"),
        F.concat(shares, F.array(1 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x))).alias("common_share"),
    )


def distance(p, q):
    """Jensen-Shannon distance of two arrays of shares."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda t, x: t + x) / 2))


def limits(judged: DataFrame, rules: Rules) -> DataFrame:
    """(ref, class_bound, word_bound) from documents (_lang, base_failed, n_words, word_chars and the distances)."""
    long_enough = [F.when(F.col("word_chars") >= rules.class_guard, F.col("class_distance")), F.when(F.col("n_words") >= rules.word_guard, F.col("word_distance"))]
    each = judged.filter(~F.col("base_failed")).select(F.col("_lang").alias("ref"), F.posexplode(F.array(*long_enough)).alias("kind", "distance")).filter("distance IS NOT NULL")
    counts = checkpointed(each.groupBy("ref", "kind", F.round(F.col("distance") * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n")))
    middle = counts.groupBy("ref", "kind").agg(F.expr("percentile(bin, 0.5D, n)").alias("median"))
    same = F.col("c.ref").eqNullSafe(F.col("m.ref")) & (F.col("c.kind") == F.col("m.kind"))
    off = counts.alias("c").join(F.broadcast(middle).alias("m"), same).select("c.ref", "c.kind", "median", F.abs(F.col("bin") - F.col("median")).alias("off"), "n")
    spread = off.groupBy("ref", "kind").agg(F.first("median").alias("median"), F.greatest(F.lit(LEAST_SPREAD), F.expr("percentile(off, 0.5D, n)")).alias("spread"))
    bound = lambda kind, times: F.max(F.when(F.col("kind") == kind, (F.col("median") + times * F.col("spread")) / BINS))
    fixed = lambda x: F.lit(x).cast("double")
    return spread.groupBy("ref").agg(
        (fixed(rules.class_limit) if rules.class_spread is None else bound(0, rules.class_spread)).alias("class_bound"),
        (fixed(rules.word_limit) if rules.word_spread is None else bound(1, rules.word_spread)).alias("word_bound"),
    )


def judge(docs: DataFrame, rules: Rules = CORPUS, carry: list[str] | None = None) -> DataFrame:
    """docs with the base counts, base_failed, the two distances and kept; carry names the columns of docs to keep, else all."""
    docs = docs.drop(*ADDED)
    found = references(docs, rules)
    reference = checkpointed(found)
    known = reference.filter("lang IS NOT NULL").select(F.col("lang").alias("_lang"), *[F.col(c).alias(f"_{c}") for c in ("class_share", "common", "common_share")])
    overall = reference.filter("lang IS NULL").select(*[F.col(c).alias(f"_all_{c}") for c in ("class_share", "common", "common_share")])
    # One row for each language; a table that large enough to matter here would not be one of languages.
    known, overall = (F.broadcast(known) if known.count() <= 10_000 else known), F.broadcast(overall)
    columns = docs.columns if carry is None else carry
    docs = measured(docs).join(known, F.col("lang").cast("string") == F.col("_lang"), "left").join(overall, F.lit(True), "left")
    pick = lambda c: F.coalesce(f"_{c}", f"_all_{c}")
    docs = common_hits(docs, pick("common"), rules.common_words)
    n = F.greatest(F.lit(1), F.col("n_words"))
    word_share = F.concat(F.transform("_hits", lambda x: x / n), F.array(1 - F.aggregate("_hits", F.lit(0.0), lambda a, x: a + x) / n))
    class_share = F.transform("_classes", lambda x: x / F.greatest(F.lit(1), F.col("word_chars")))
    docs = docs.withColumns({"class_distance": distance(class_share, pick("class_share")), "word_distance": distance(word_share, pick("common_share"))})
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))
    docs = docs.withColumn("base_failed", failed)
    # Documents are measured once and written: limits need all distances first, and a consumer's filter can't reach into the arrays.
    docs = stored(docs.select(*columns, "_lang", *[c for c in ADDED if c != "kept"]))
    if rules.class_spread is None and rules.word_spread is None:
        docs = docs.withColumns({"class_bound": F.lit(rules.class_limit), "word_bound": F.lit(rules.word_limit)})
    else:
        docs = docs.join(F.broadcast(checkpointed(limits(docs, rules))), F.col("_lang").eqNullSafe(F.col("ref")), "left")
    far = (F.col("word_chars") >= rules.class_guard) & (F.col("class_distance") > F.col("class_bound")) | (F.col("n_words") >= rules.word_guard) & (F.col("word_distance") > F.col("word_bound"))
    return docs.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).select(*columns, *ADDED)


def passing(docs: DataFrame, rules: Rules = CORPUS) -> DataFrame:
    """The rows of docs that are kept. A verdict hangs on text and lang alone: rejected ones are named by lang and 128 bits of the text, and texts stay where they are."""
    name = {"_t1": F.xxhash64("text"), "_t2": F.xxhash64(F.lit("second"), "text"), "_of": F.col("lang").cast("string")}
    judged = judge(docs.select("text", "lang").withColumns(name), rules, carry=list(name))
    rejected = stored(judged.filter("NOT kept").select(*name).distinct())
    rejected = (F.broadcast(rejected) if rejected.count() <= BROADCAST_NAMES else rejected).alias("r")
    same = (F.col("d._t1") == F.col("r._t1")) & (F.col("d._t2") == F.col("r._t2")) & F.col("d._of").eqNullSafe(F.col("r._of"))
    return docs.withColumns(name).alias("d").join(rejected, same, "left_anti").drop(*name)
