"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Two lines within t edits share one of t + 1 segments of the shorter, at nearly its place. Each different line is cut into
t + 1 even segments; it offers each as a key of its length, the segment's number and its characters, and asks for the keys
of equal or up to t shorter lines at the few places that t edits allow. Lines that meet on a key are compared by the
parities of their characters' counts, of which an edit changes two at most, then by a banded bit-parallel edit automaton, and only tell whether an earlier line is near: joins stop at the first, so no pairs of a group
come out.

Defined results: a line with a word goes if an earlier line (by doc_id, null last, then place) is equal to it, whatever its
length, or if both have at least `least_chars` characters besides white space at their ends and are within `edits` edits of
one another; whether that earlier line itself stays or goes doesn't matter. Lines without a word stay. Rows of equal doc_id and text count as one and keep the same lines; lines at one place of rows that share
a doc_id alone are not before one another. A text keeps its other lines as they are, and is empty if none is left. A null text
stays null. All columns stay; text is replaced, n_lines and n_removed are added or replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forgotten, stored

#: Line ids up to this many are broadcast, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
TRIMMED = " \t\n\x0b\x0c\r"


def places(edits: int) -> list[tuple]:
    """(less, segment, move, own) of each key of a line: it asks for all of them, and offers its own segments as well.

    It asks for segments of lines shorter by `less` where they can lie in it: one with i segments before it moves by at most i
    edits from the left and by at most edits - i from the right.
    """
    moves = [(less, i, move) for less in range(edits + 1) for i in range(edits + 1) for move in range(-edits, edits + 1)]
    return [(less, i, move, less == move == 0) for less, i, move in moves if abs(move) <= i and abs(move - less) <= edits - i]


def keys(lines: DataFrame, edits: int) -> DataFrame:
    """(entry, key) of lines (id, line), entry being twice the id, plus one for a line's own segment.

    Segments are even, the later ones longer by one where need be. Characters are four bytes each here, so that a segment is a
    slice of bytes.
    """
    parts = edits + 1
    listed = ", ".join(f"struct({less} AS less, {i} AS i, {move} AS move, {int(own)}L AS own)" for less, i, move, own in places(edits))
    found = lines.select("id", F.encode("line", "UTF-32").alias("wide"), F.length("line").alias("n"), F.expr(f"inline(array({listed}))"))
    found = found.withColumn("shorter", F.expr("n - less")).filter("shorter > 0")
    found = found.select("id", "wide", "n", "i", "move", "own", "shorter", F.expr(f"int(shorter div {parts})").alias("size"), F.expr(f"{parts} - shorter % {parts}").alias("even"))
    found = found.select("id", "wide", "n", "i", "own", "shorter", F.expr("i * size + greatest(0, i - even) + move").alias("start"), F.expr("size + CASE WHEN i >= even THEN 1 ELSE 0 END").alias("size"))
    return found.filter("start >= 0 AND start + size <= n").select(F.expr("2 * id + own").alias("entry"), F.expr("xxhash64(shorter, i, substring(wide, 4 * start + 1, 4 * size))").alias("key"))


def within(a: str, b: str, edits: int) -> str:
    """SQL: whether two arrays of characters, columns a and b, are at most `edits` edits apart.

    The automaton has a row of bits for each number of edits and in it a bit for each diagonal of the band; all rows lie in one
    number, a guard bit between two of them. A character of a moves all bits at once: on a match they stay, else they go up a
    row along the same diagonal (replaced), the one below (dropped) or the one above (added). Nothing moves once no bit is set.
    """
    if not 0 <= edits <= 4:
        raise ValueError("0 to 4 edits fit into one number of bits")
    band = 2 * edits + 1
    wide = band + 1
    rows = range(edits + 1)
    mask = sum(((1 << band) - 1) << wide * e for e in rows)
    start = sum(1 << wide * e + edits + d for e in rows for d in range(e + 1))
    match = " | ".join(f"CASE WHEN get({a}, i) = get({b}, i + {d}) THEN {sum(1 << wide * e + edits + d for e in rows)}L ELSE 0L END" for d in range(-edits, edits + 1))
    moved = f"(s & ({match}) | shiftleft(s, {wide}) | shiftleft(s, {wide - 1})) & {mask}L"
    for _ in range(edits):  # an added character takes none of a, so that several may follow one another
        moved = f"aggregate(array({moved}), 0L, (t, x) -> (x | shiftleft(x, {wide + 1})) & {mask}L)"
    last = f"aggregate(sequence(0, size({a}) - 1), {start}L, (s, i) -> CASE WHEN s = 0 THEN 0L ELSE {moved} END)"
    return f"(abs(size({a}) - size({b})) <= {edits} AND shiftright({last}, {wide * edits + edits} + size({b}) - size({a})) & 1 = 1)"


def parities(letters: str) -> str:
    """SQL: 64 bits, each whether an odd number of an array's characters falls there; an edit changes two bits at most."""
    return f"aggregate({letters}, 0L, (s, x) -> s ^ shiftleft(1L, x & 63))"


def near_lines(lines: DataFrame, edits: int) -> DataFrame:
    """Stored ids of lines (id, line, first) that are within `edits` edits of one with a smaller first; lines are all different."""
    entries = keys(lines, edits).repartition("key")
    # Keys on which different lines meet and that one of them owns; most keys are of one line alone.
    met = entries.groupBy("key").agg(F.min("entry").alias("low"), F.max("entry").alias("high"), F.max(F.expr("entry & 1")).alias("owned")).filter("low div 2 < high div 2 AND owned = 1").select("key")
    shared = stored(entries.join(met, "key").distinct().select(F.expr("entry div 2").alias("id"), "key", F.expr("entry & 1 = 1").alias("own")))
    ids = stored(shared.select("id").distinct())
    texts = lines.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id")
    texts = stored(texts.select("id", "first", F.expr("transform(split(line, ''), x -> ascii(x))").alias("letters")).withColumn("odd", F.expr(parities("letters"))))
    full = shared.join(texts, "id")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") != F.col("b.id")) & (F.col("b.first") < F.col("a.first")) & F.expr(f"bit_count(a.odd ^ b.odd) <= {2 * edits}") & F.expr(within("a.letters", "b.letters", edits))
    later_asks = full.alias("a").join(full.filter("own").alias("b"), near, "left_semi").select("id")
    later_owns = full.filter("own").alias("a").join(full.filter("NOT own").alias("b"), near, "left_semi").select("id")
    found = stored(later_asks.union(later_owns).distinct())
    for table in (shared, ids, texts):
        forgotten(table)
    return found


def drop_repeated_lines(docs: DataFrame, edits: int = 2, least_chars: int = 24) -> DataFrame:
    """docs with later equal or near-equal lines taken out of text, and n_lines and n_removed."""
    docs = docs.drop("n_lines", "n_removed")
    columns = docs.columns
    split = F.split(F.col("text"), "\n", -1)
    row = [F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_row")]
    each = docs.select(*row, F.posexplode(split).alias("place", "line")).filter(F.length(F.btrim("line", F.lit(TRIMMED))) > 0)
    # doc_id and place as one number that orders lines; one fixed-width value keeps the aggregation in memory.
    first = (F.coalesce(F.col("_doc").cast("decimal(20,0)"), F.lit(str(10**19)).cast("decimal(20,0)")) * F.lit(10**10).cast("decimal(11,0)") + F.col("place")).cast("decimal(38,0)")
    # A hash takes what went before as its seed, so that two hashes only differ throughout if their first values do.
    name = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2")]
    lines = each.groupBy("line").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    lines = stored(lines.select("line", "first", "n", *name, F.monotonically_increasing_id().alias("id")))
    # Edits weigh too much in short lines; those go by equality alone.
    long = lines.filter(F.length(F.btrim("line", F.lit(TRIMMED))) >= least_chars)
    near = near_lines(long.select("id", "line", "first"), edits).withColumn("near", F.lit(True))
    # Only lines that repeat or are near an earlier one matter to the texts.
    gone = lines.select("id", "h1", "h2", "first", "n").join(near, "id", "left").filter("near OR n > 1")
    gone = gone.select("h1", "h2", F.when(F.col("near"), None).otherwise(F.col("first")).alias("keep"))
    hit = each.select("_doc", "_row", "place", *name).join(gone, ["h1", "h2"]).filter(F.col("keep").isNull() | (first != F.col("keep")))
    places_of = hit.groupBy("_doc", "_row").agg(F.sort_array(F.collect_set("place")).alias("places"))
    # True at each place that goes, up to the last; stored, so that a text is split once and each line looked up at once.
    marks = F.expr("flatten(zip_with(places, concat(array(-1), slice(places, 1, size(places) - 1)), (p, q) -> concat(array_repeat(false, p - q - 1), array(true))))")
    removed = stored(places_of.select("_doc", "_row", marks.alias("_gone"), F.size("places").alias("_n_gone")))
    forgotten(lines)
    size = removed.agg(F.count("*").alias("rows"), F.sum(F.size("_gone")).alias("places")).first()
    if (size["rows"] or 0) + (size["places"] or 0) <= BROADCAST_IDS:
        removed = F.broadcast(removed)  # so that texts stay where they are
    joined = docs.withColumns({"_doc": row[0], "_row": row[1]}).alias("d").join(removed.alias("p"), F.col("d._doc").eqNullSafe(F.col("p._doc")) & (F.col("d._row") == F.col("p._row")), "left")
    stays = F.filter(split, lambda x, i: ~F.coalesce(F.get("_gone", i), F.lit(False)))
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    counts = [F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), F.coalesce("_n_gone", F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*[kept.alias("text") if c == "text" else F.col(f"d.{c}") for c in columns], *counts)
