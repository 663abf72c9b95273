"""Phrases of two to four words that come up often and together, mined by Misra-Gries summaries and a second, exact pass.

A text is cut at punctuation and line ends into pieces and those at blanks and tabs into words; a phrase lies within a piece.
Texts are read four times, each time to count what was named the time before and to name what is longer by a word. Naming an
occurrence is a hash of its language and words, dealt to partitions; a task sends a partition what it has of its hashes with
their counts, and how many occurrences that were. A partition then knows its mass before it sees a hash and keeps a summary of
more than mass / least counters: whenever more are in use, all are lowered by so much that enough fall to zero. All that is ever
taken from one counter is therefore less than `least`, so every phrase found `least` times keeps a counter; one whose counter
and all that was ever taken do not reach `least` goes. Summaries merge by adding their counters and lowering them again. Hashes
that meet only raise one another's counters.

The survivors mark a bit table of fixed size, built by Spark as bitmaps. The next reading counts the phrases whose bit is set,
by their words, and sums are exact; only those of at least `least` stay. Longer phrases are only named where both parts that
lack an end word survived: no other can be frequent. Tables only save work: as they fill up, more is counted for nothing and the
same is found.

Defined results: a null text has no words, a null language reads `und`. Rows count each, whatever their ids. Ties in score go to
the more frequent phrase, then to the one that sorts first by bytes. Columns other than text and lang are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forgotten, small_batches, stored, workers_find_package

#: What ends a piece, and the blanks between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
LONGEST = 4
#: Bits of a table as a power of two: 16 MB. Spark's bitmaps hold 32,768 bits each.
TABLE_BITS, BITMAP = 27, 32_768
#: Bits of a hash that are sent.
NAME_BITS = 44
#: Hashes, phrases and numbered words that a task keeps at most before it sends what it has or begins anew, and hashes in a row: batches of rows stay small.
HELD, PHRASES_HELD, WORDS_HELD, IN_A_ROW = 1_000_000, 600_000, 200_000, 2048
#: Counters of a partition's summary: there are so many partitions that mass / least needs no more, and a summary has them all, for
#: the more it has the less is taken from them.
COUNTERS = 1_000_000
#: Groups of a language's phrases whose best are taken first.
SALTS = 64
_LOWER = bytes(32 if b in BLANKS else 46 if b in ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = b"."


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) | 1


def _mixed(a, b):
    """A hash of a sequence from that of all but its last word and that of its last word."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15) + b) ^ (b >> np.uint64(29))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _blocks(batches, most: int = 1 << 20):
    """(language, words): the words of some texts of one language, END between pieces; texts may be cut between pieces or words, never lost."""
    waiting: dict[str, list] = {}
    size: dict[str, int] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for text, lang in zip(texts, langs):
            if not text:
                continue
            lang = "und" if lang is None else lang
            waiting.setdefault(lang, []).append(text.encode())
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= most:
                yield lang, _words(waiting.pop(lang))
                size[lang] = 0
    for lang, held in waiting.items():
        yield lang, _words(held)


def _words(texts: list[bytes]) -> list[bytes]:
    return _END.join(texts).translate(_LOWER).replace(_END, b" . ").split()


class Reader:
    """N-grams of blocks of words, with hashes; a bit table may say which shorter n-grams are worth extending.

    Words are numbered as they come up, so that numbers stand for words exactly; new numbers begin once there are many.
    """

    def __init__(self):
        self.clear()

    def clear(self):
        self.number: defaultdict = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[_END]  # 0
        self.hash = np.zeros(1, np.uint64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > WORDS_HELD:
            self.clear()
        found = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > len(self.hash):
            new = islice(self.number, len(self.hash), None)
            self.hash = np.append(self.hash, np.fromiter(map(_hash, new), np.uint64, len(self.number) - len(self.hash)))
        return found

    def chain(self, lang: str, found: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For 1 to `longest` words (hashes, within): of the n-gram that begins at each place, and whether it lies within a piece."""
        single, within = self.hash[found], found != 0
        names = [(_mixed(np.full(len(single), np.uint64(_hash(lang.encode("utf-8", "surrogatepass")))), single), within)]
        for k in range(2, longest + 1):
            before, good = names[-1]
            n = max(0, len(single) - k + 1)
            names.append((_mixed(before[:n], single[k - 1 :]), good[:n] & within[k - 1 :]))
        return names


def _opened(table: bytes | None) -> np.ndarray | None:
    return None if table is None else np.frombuffer(zlib.decompress(table), np.uint8)


def _marked(table: np.ndarray, names: np.ndarray, bits: int) -> np.ndarray:
    at = (names >> np.uint64(64 - bits)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _summed(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(names)
    names, counts = names[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
    return names[first], np.add.reduceat(counts, first) if len(first) else counts


def lowered(names: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A summary cut to capacity counters, and by how much all were lowered: by the largest of those that have no place."""
    by = 0
    if len(names) > capacity:
        by = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
        names, counts = names[counts > by], counts[counts > by] - by
    return names, counts, by


#: kind 0: a task's mass for a partition; kind 1: sorted hashes, as differences, and their counts; kind 2: a phrase's count.
_READ = "n int, kind int, part int, mass long, names binary, counts binary, lang string, phrase string, f long"
_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.int64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=[x.split()[0] for x in _READ.split(", ")])


class Sums:
    """A task's hashes of n-grams with their counts, until they are sent."""

    def __init__(self, n: int, parts: int):
        self.n, self.parts, self.raw, self.size = n, parts, [], 0
        self.names, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, names: np.ndarray) -> bool:
        """Whether so many are held that some should be sent."""
        self.raw.append(names)
        self.size += len(names)
        if self.size > HELD:
            self.settle()
        return len(self.names) > HELD

    def settle(self) -> None:
        names, counts = np.unique(np.concatenate(self.raw), return_counts=True)
        self.names, self.counts = _summed(np.concatenate([self.names, names]), np.concatenate([self.counts, counts])) if len(self.names) else (names, counts)
        self.raw, self.size = [], 0

    def sent(self) -> list[tuple]:
        if self.raw:
            self.settle()
        names, counts = self.names, self.counts
        self.names, self.counts = names[:0], counts[:0]
        # Partitions are ranges of hashes, so what is sorted by hash is so by partition.
        part = (names * np.uint64(self.parts)) >> np.uint64(NAME_BITS)
        ends = np.searchsorted(part, np.arange(self.parts + 1))
        rows = []
        for p in np.unique(part).tolist():
            rows.append((self.n, 0, p, int(counts[ends[p] : ends[p + 1]].sum()), None, None, None, None, None))
            for a in range(ends[p], ends[p + 1], IN_A_ROW):
                b = min(a + IN_A_ROW, ends[p + 1])
                rows.append((self.n, 1, p, None, np.diff(names[a:b], prepend=np.uint64(0)).tobytes(), counts[a:b].astype(np.uint32).tobytes(), None, None, None))
        return rows


def _read(named: dict[int, bytes | None], counted: dict[int, bytes], parts: int, bits: int):
    """Names n-grams of the lengths in named, where a table of shorter ones allows, and counts those of the lengths in counted whose bit is set."""
    longest = max([*named, *counted])

    def run(batches):
        reader, found = Reader(), {}
        tables = {n: _opened(x) for n, x in {**{n - 1: x for n, x in named.items() if x}, **counted}.items()}
        sums = {n: Sums(n, parts) for n in named}
        for lang, words in _blocks(batches):
            ids = reader.numbers(words)
            chain = reader.chain(lang, ids, longest)
            held = {n: _marked(x, chain[n - 1][0], bits) & chain[n - 1][1] for n, x in tables.items()}
            for n in named:
                names, good = chain[n - 1]
                if named[n]:
                    good = good & held[n - 1][: len(good)] & held[n - 1][1 : len(good) + 1]
                # The upper bits name an n-gram; more are not needed to tell most apart.
                if sums[n].add(names[good] >> np.uint64(64 - NAME_BITS)):
                    yield _batch(sums[n].sent())
            for n in counted:
                of = found.setdefault((n, lang), {})
                if n == 1:
                    of[None] = of.get(None, 0) + int(chain[0][1].sum())
                places = np.flatnonzero(held[n])
                # Numbers stand for words and then for longer and longer n-grams, so that counting compares words, not hashes.
                now = ids[places]
                for k in range(1, n):
                    now = np.unique((now << np.int64(32)) | ids[places + k], return_inverse=True)[1]
                _, first, counts = np.unique(now, return_index=True, return_counts=True)
                for at, c in zip(places[first].tolist(), counts.tolist()):
                    phrase = b" ".join(words[at : at + n]).decode()
                    of[phrase] = of.get(phrase, 0) + c
            if sum(map(len, found.values())) > PHRASES_HELD:
                yield from _phrases(found)
                found = {}
        for n in named:
            yield _batch(sums[n].sent())
        yield from _phrases(found)

    return run


def _phrases(found: dict, most: int = 20_000):
    """Batches of what was counted."""
    rows = ((n, 2, None, None, None, None, lang, phrase, f) for (n, lang), held in found.items() for phrase, f in held.items())
    while part := list(islice(rows, most)):
        yield _batch(part)


def _merge(least: int, counters: int):
    """Survivors of each partition's summary; rows come by partition, masses before hashes."""

    def run(batches):
        part, mass, names, counts, taken, buffer, held = None, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, [], 0

        def settled():
            nonlocal names, counts, taken, buffer, held
            names, counts = _summed(np.concatenate([names, *[a for a, _ in buffer]]), np.concatenate([counts, *[b for _, b in buffer]]))
            names, counts, by = lowered(names, counts, max(mass // least + 1, counters))
            taken, buffer, held = taken + by, [], 0

        def survivors():
            settled()
            # No count is above its counter and all that was taken, so less than `least` is none to keep.
            return pa.RecordBatch.from_arrays([pa.array(names[counts + taken >= least].astype(np.int64))], names=["name"])

        for batch in batches:
            for row in batch.to_pylist():  # some 25 KB each
                if row["part"] != part:
                    if part is not None:
                        yield survivors()
                    part, mass, taken, names, counts = row["part"], 0, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if row["kind"] == 0:
                    mass += row["mass"]
                    continue
                got = np.cumsum(np.frombuffer(row["names"], np.uint64), dtype=np.uint64)
                buffer.append((got, np.frombuffer(row["counts"], np.uint32).astype(np.int64)))
                held += len(got)
                if held > HELD:
                    settled()
        if part is not None:
            yield survivors()

    return run


def bit_table(names: DataFrame, bits: int) -> bytes:
    """2 ** bits bits, packed, set where a name (its NAME_BITS bits) falls; built by bitmaps, so only the table comes to the driver."""
    at = F.shiftrightunsigned("name", NAME_BITS - bits) + 1  # Spark numbers buckets and bits from 1
    bits_of = names.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).distinct()
    # Dealt before the bitmaps are made: else each task would send a bitmap of 4 KB for each bucket.
    maps = bits_of.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    table = bytearray((1 << bits) // 8)
    for row in maps.collect():  # as many bits as the table has
        begin = (row["bucket"] - 1) * BITMAP // 8
        table[begin : begin + BITMAP // 8] = row["map"]
    return zlib.compress(bytes(table), 1)  # tasks get it with their code, and it is mostly zeros


def survivors(read: DataFrame, n: int, least: int, parts: int, bits: int = TABLE_BITS, counters: int = COUNTERS) -> bytes:
    """Bit table of the n-grams of a reading that the summaries keep: all found `least` times in a language are in it."""
    dealt = read.filter((F.col("n") == n) & (F.col("kind") < 2)).select("part", "kind", "mass", "names", "counts").repartition(parts, "part").sortWithinPartitions("part", "kind")
    kept = stored(dealt.mapInArrow(_merge(least, counters), "name long"))
    table = bit_table(kept, bits)
    forgotten(kept)
    return table


def frequent(read: DataFrame, n: int, least: int) -> DataFrame:
    """(lang, phrase, f) of all phrases of n words found at least `least` times; for n = 1 also a row with null phrase and all words of a language."""
    counted = read.filter((F.col("n") == n) & (F.col("kind") == 2)).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return stored(counted.filter((F.col("f") >= least) | F.col("phrase").isNull()))


def mine(docs: DataFrame, least: int = 30, best: int = 2000, bits: int = TABLE_BITS, counters: int = COUNTERS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to four words, from docs (text, lang).

    A phrase's score is that of its weakest cut into a first part and a rest: floor(2,000,000 a / (l + r)) with a, l, r the counts
    of phrase, first part and rest. A phrase that mostly comes up inside a longer one, 80 of 100 times, is left out.
    """
    workers_find_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("text").cast("string"), F.col("lang").cast("string"))
    spark = docs.sparkSession
    # A word and a blank are two characters at least; partitions need not be more than the most that there may be to name.
    mass = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 2
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), mass // (least * counters) + 1)
    tables: dict[int, DataFrame] = {}
    named: dict[int, bytes | None] = {1: None, 2: None}
    counted: dict[int, bytes] = {}
    while named or counted:
        read = stored(docs.mapInArrow(_read(named, counted, parts, bits), _READ))
        tables |= {n: frequent(read, n, least) for n in counted}
        counted = {n: survivors(read, n, least, parts, bits, counters) for n in named}
        forgotten(read)
        longest = max(counted, default=LONGEST)
        named = {longest + 1: counted[longest]} if longest < LONGEST else {}
    totals = tables[1].filter("phrase IS NULL").select("lang", F.col("f").alias("n"))
    tables = [x.filter("phrase IS NOT NULL").withColumn("m", F.lit(n)) for n, x in sorted(tables.items())]
    counts = tables[0]
    for x in tables[1:]:
        counts = counts.unionByName(x)
    return ranked(scored(counts, totals), best)


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, m) of phrases that no longer one holds most of, from counts (lang, phrase, f, m) and totals (lang, n)."""
    words = F.split("phrase", " ")
    phrases = counts.filter("m > 1").select("lang", "phrase", F.col("f").alias("a"), "m", words.alias("w"))
    joined = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.withColumns({"head": joined(F.lit(1), F.col("k")), "rest": joined(F.col("k") + 1, F.col("m") - F.col("k"))})
    part = counts.select("lang", "phrase", "f")
    heads, rests = part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.expr("cast((cast(a AS decimal(20,0)) * 2000000) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0))) AS bigint)")
    cuts = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).withColumn("score", score)
    weakest = cuts.groupBy("lang", "phrase", "a", "m").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = phrases.filter("m > 2").select("lang", "a", "m", "w", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("size"))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)))
    held = inner.select("lang", joined(F.col("start"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = weakest.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * wide("longer") < 80 * wide("a")))
    return left.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def ranked(phrases: DataFrame, best: int) -> DataFrame:
    """The best of each language: first of groups of its phrases, then of what these leave."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt")
    first = phrases.select("*", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= best)
    top = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_GRAMS = " UNION ALL ".join(f"SELECT lang, {n} AS m, array_to_string(w[i:i + {n - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM p)" for n in range(1, LONGEST + 1))

ORACLE = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(s, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS s FROM d)),
tot AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM ({_GRAMS}) GROUP BY lang, m, phrase HAVING count(*) >= 30),
c AS (SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
s AS (SELECT c.lang, c.phrase, c.a, k, h.a AS l, t.a AS r, (2000000 * c.a::HUGEINT) // (h.a + t.a) AS score FROM c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[x:x + z - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, m - z + 2)) AS x FROM (SELECT *, unnest(range(2, m)) AS z FROM f WHERE m > 2)) GROUP BY ALL),
g AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM g)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o JOIN tot USING (lang) WHERE rank <= 2000
"""
