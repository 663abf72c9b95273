"""Language-model scoring with a probabilistic suffix tree over words.

A state is a context of up to `depth` words before the next token. A context seen `least_context` times or more in the training
texts becomes a state if its next-token distribution diverges from that of its longest proper suffix that is a state: twice the
count-weighted relative entropy must exceed `divergence` for every successor it names. At a state s with n(s) occurrences the
successors seen there `least_successor` times or more are named, and

    P(w | s) = (n(s, w) + strength * P(w | s')) / (n(s) + strength)                       w named
    P(w | s) = P(w | s') * left(s)                                                        w not named

where s' is the next shorter state and left(s) makes the sum one. The empty context is the add-one unigram distribution with
one place for all unseen words, so the model is a proper distribution over the training vocabulary and that place.

The least counts are the same for every corpus, so the tree grows with the input; counts, states and successors are tables. A
text's score is a sum over its word n-grams: log10 left(s) for an n-gram that is a state, and for one that is a named successor
its log10 P less what its shorter n-grams give already. So scoring is one join of n-grams with their weights. Words and
weights that make up `head_share` of all training tokens or more, at most 1 / head_share for each length, are looked up inside
tasks; hence no other key of the join has more of the training n-grams than that. So are the next most frequent, up to
`head_words` and `head_grams` in all, which are most of what texts hold; only what is left is shuffled. Filters of a fixed size
keep n-grams without a weight, or without a hope of one, out of the shuffles; when they fill up, more is shuffled and the result stays.

N-grams are named by 64 bits, so a few in 10^12 could share a weight; n_tokens, n_known and the base use the words themselves.

Defined results: a null text is an empty one, whose only token is the end. Rows with a null doc_id are scored, are not held
out and are not learned from. Repeated rows count and are scored each. With no training text N and V are 0 and a token's
probability is one. Other columns are dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import UID, cleaned, fold, forgotten, small_batches, stored, with_uid, workers_find_package
from .jaccard import mixed

#: Stands for the end of a text among words; no word holds a space.
END = b" "
#: Distinct words that a task counts before it sends what it has, and n-grams likewise.
BUFFER, GRAM_BUFFER = 1 << 18, 4_000_000
#: A filter of keys has 2^FILTER_BITS bits, 16 MB.
FILTER_BITS = 27
#: Texts that are taken together in a task.
SLICE = 200
#: Contexts are counted by 2^BUCKET_BITS ranges of their keys at least; a task sends one row for each.
BUCKET_BITS = 10
#: Sorted keys are looked up from the first one with the same leading bits, so many.
INDEX_BITS = 20


@dataclass(frozen=True)
class Settings:
    depth: int = 2
    least_context: int = 128
    least_successor: int = 4
    divergence: float = 4.0
    strength: float = 50.0
    head_share: float = 1e-6
    head_words: int = 300_000
    head_grams: int = 2_000_000


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, and the end. bytes.split() splits at exactly 0x20 and 0x09 to 0x0D."""
    return [*(text or b"").lower().split(), END]


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def longer_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a context and one more word; the empty context's is 0 and a word's is its hash."""
    return mixed(context) + word


def gram_keys(words: np.ndarray, most: int) -> list[np.ndarray]:
    """For each length up to most the key of the n-gram that ends at each place; places too near the start are meaningless."""
    keys = [words]
    for _ in range(1, most):
        longer = words.copy()
        longer[1:] = longer_key(keys[-1][:-1], words[1:])
        keys.append(longer)
    return keys


def places(lengths: np.ndarray) -> np.ndarray:
    """The place of each token in its text, for texts in a row."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


@F.pandas_udf(LongType())
def _longer(context: pd.Series, word: pd.Series) -> pd.Series:
    return pd.Series(_signed(longer_key(context.to_numpy(np.int64).view(np.uint64), word.to_numpy(np.int64).view(np.uint64))))


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bitmap of the leading bits of a key column; what comes to the driver has at most 2^(FILTER_BITS - 6) rows."""
    at = keys.select(F.shiftrightunsigned(F.col("key"), 64 - FILTER_BITS).alias("at"))
    with cleaned(keys.sparkSession):
        found = at.groupBy(F.shiftright("at", 6).alias("place")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, dtype="<i8")
    bits[found["place"].to_numpy()] = found["bits"].to_numpy()
    return bits.view(np.uint8)


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def key_index(keys: np.ndarray) -> np.ndarray:
    """For each of the leading bits that a key may have, the place of the first of sorted keys that has them or greater ones."""
    return np.searchsorted(keys, np.arange(1 << INDEX_BITS, dtype=np.uint64) << np.uint64(64 - INDEX_BITS))


def looked_up(keys: np.ndarray, index: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place among sorted keys for each one that is wanted, and whether that is its own; keys are hashes, so few steps lead there."""
    at, left = index[(wanted >> np.uint64(64 - INDEX_BITS)).astype(np.int64)], np.arange(len(wanted))
    last = len(keys) - 1
    while len(left):
        left = left[(at[left] < last) & (keys[np.minimum(at[left], last)] < wanted[left])]
        at[left] += 1
    at = np.minimum(at, last)
    return at, keys[at] == wanted


def count_words(train: DataFrame) -> DataFrame:
    """(word binary, n) over all training texts; each task adds up its own before the shuffle."""

    def count(batches):
        seen = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(tokens_of(text))
                if len(seen) > BUFFER:
                    yield _counted(seen)
                    seen = Counter()
        yield _counted(seen)

    return train.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


def _successors(train: DataFrame, length: int, contexts: DataFrame, below: DataFrame, least: int, total: int) -> DataFrame:
    """(ctx, word, n): how often words follow contexts of `length` words, if at least so often, for a superset of given contexts.

    An n-gram can't come up more often than the one without its first word, so those not in the level below are left out.
    Tasks send what they have of a range of contexts (a bucket) together, so rows follow tasks and not contexts; the successors of a
    context seen more than GRAM_BUFFER times are spread over buckets. There are more buckets in larger corpora, so that one stays small.
    """
    shift = np.uint64(64 - max(BUCKET_BITS, (total // GRAM_BUFFER).bit_length()))
    heavy = contexts.filter(F.col("n_ctx") > GRAM_BUFFER).select("ctx", "n_ctx").toArrow()  # at most total / GRAM_BUFFER rows
    keys = heavy["ctx"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    parts = -(-heavy["n_ctx"].to_numpy()[order] // GRAM_BUFFER)
    filters = (key_filter(contexts.select(F.col("ctx").alias("key"))), key_filter(below.select("key")))
    held = train.sparkSession.sparkContext.broadcast((filters, keys[order], parts.astype(np.uint64)))

    def count(batches):
        (known, shorter), heavy, parts = held.value
        found, size = [], 0
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                texts = [tokens_of(text) for text in batch.column(0).slice(at, SLICE).cast(pa.binary()).to_pylist()]
                words = hashed([t for text in texts for t in text])
                keys = gram_keys(words, length)[-1]
                good = places(np.array(list(map(len, texts))))[1:] >= length
                good &= may_hold(known, keys[:-1])
                good &= may_hold(shorter, keys[1:])
                found.append((keys[:-1][good], words[1:][good]))
                size += len(found[-1][0])
                if size > GRAM_BUFFER:
                    yield together(found, heavy, parts)
                    found, size = [], 0
        if size:
            yield together(found, heavy, parts)

    def together(found, heavy, parts):
        context, word = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        bucket = context >> shift
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, context), len(heavy) - 1)
            bucket = np.where(heavy[at] == context, mixed(context + word % parts[at]) >> shift, bucket)
        bucket, context, word, n = _added_up(bucket, context, word, np.ones(len(word), dtype=np.int32), bool(len(heavy)))
        turns = bucket[1:] != bucket[:-1]
        starts = np.flatnonzero(np.concatenate([[True], turns | (context[1:] != context[:-1])]))
        pairs = np.append(np.flatnonzero(np.concatenate([[True], turns])), len(word))
        sizes, ends = np.diff(np.append(starts, len(word))).astype(np.int32), np.searchsorted(starts, pairs)
        packed = lambda x, ends: pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
        columns = [pa.array(_signed(bucket[pairs[:-1]])), packed(context[starts], ends), packed(sizes, ends), packed(word, pairs), packed(n, pairs)]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "contexts", "sizes", "words", "times"])

    def merged(batches):
        spread = len(held.value[1]) > 0
        rest = (*(np.zeros(0, np.uint64) for _ in range(3)), np.zeros(0, np.int32))
        for batch in batches:
            contexts, sizes, words, times = (batch.column(i).to_pylist() for i in range(1, 5))
            lengths = np.array(list(map(len, words))) // 8
            of = lambda x, kind: np.frombuffer(b"".join(x), kind)
            now = (np.repeat(batch.column(0).to_numpy().view(np.uint64), lengths), np.repeat(of(contexts, np.uint64), of(sizes, np.int32)), of(words, np.uint64), of(times, np.int32))
            if not len(now[0]):
                continue
            rows = _added_up(*[np.concatenate(x) for x in zip(rest, now)], spread)
            # The last bucket in this batch may go on in the next one.
            last = rows[0] == now[0][-1]
            rest = tuple(x[last] for x in rows)
            yield often(*[x[~last] for x in rows])
        yield often(*rest)

    def often(_, context, word, n):
        keep = n >= least
        return pa.RecordBatch.from_arrays([pa.array(_signed(context[keep])), pa.array(_signed(word[keep])), pa.array(n[keep].astype(np.int64))], names=["ctx", "word", "n"])

    sent = train.select("text").mapInArrow(count, "bucket long, contexts binary, sizes binary, words binary, times binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merged, "ctx long, word long, n long")


def _added_up(bucket: np.ndarray, context: np.ndarray, word: np.ndarray, n: np.ndarray, spread: bool) -> tuple:
    """Sorted and distinct (bucket, context, word), with n summed; a sum stays under 2^31, for a bucket has few more than GRAM_BUFFER of a context.

    Buckets are ranges of contexts unless some contexts are spread over several.
    """
    if not len(word):
        return bucket, context, word, n
    order = np.lexsort((word, context, bucket) if spread else (word, context))
    bucket, context, word, n = bucket[order], context[order], word[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])]))
    return bucket[starts], context[starts], word[starts], np.add.reduceat(n, starts, dtype=np.int32)


def _met(rows: DataFrame, table: DataFrame, on: str, often: str, hot: float) -> DataFrame:
    """Stored rows joined with a stored table; its keys that are seen `hot` times, few by their share of all tokens, are broadcast."""
    return rows.join(F.broadcast(table.filter(F.col(often) >= hot)), on).unionByName(rows.join(table.filter(F.col(often) < hot), on))


@dataclass
class Tree:
    """total and distinct training tokens; weights (key, n, weight) of n-grams; states (ctx, length, n_ctx, named, left) to look at."""

    total: int
    distinct: int
    weights: DataFrame | None = None
    states: DataFrame | None = None


def grow(train: DataFrame, counts: DataFrame, s: Settings = Settings()) -> Tree:
    """The suffix tree of training texts, whose word counts are given as a stored table."""
    sums = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).first()
    tree = Tree(int(sums["total"] or 0), int(sums["distinct"]))
    if not tree.total:
        return tree
    hot = max(s.least_context, 10 * s.head_share * tree.total)

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_signed(hashed(batch.column(0).to_pylist()))), batch.column(1)], names=["key", "n"])

    words = counts.filter(F.col("n") >= s.least_successor).select("word", "n").mapInArrow(keyed, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    base = F.log10(F.col("n") + 1) - F.log10(F.lit(float(tree.total + tree.distinct + 1)))
    below = stored(words.select("key", F.lit(0).cast("long").alias("skey"), F.col("key").alias("word"), "n", base.alias("chain")))
    end, levels = int(_signed(hashed([END]))[0]), [below]
    for length in range(1, s.depth + 1):
        contexts = stored(below.filter((F.col("n") >= s.least_context) & (F.col("word") != end)).select(F.col("key").alias("ctx"), F.col("n").alias("n_ctx"), F.col("skey").alias("sctx")))
        if contexts.isEmpty():
            break
        counted = stored(_successors(train, length, contexts, below, s.least_successor, tree.total))
        met = stored(_met(counted, contexts, "ctx", "n_ctx", hot).select("ctx", "n_ctx", "word", "n", _longer("ctx", "word").alias("key"), _longer("sctx", "word").alias("skey")))
        shorter = below.select(F.col("key").alias("skey"), F.col("chain").alias("above"), F.col("n").alias("often"))
        rows = stored(_met(met, shorter, "skey", "often", hot).drop("often"))
        states = stored(_states(rows, s))
        smoothed = (F.col("n") + s.strength * F.pow(F.lit(10.0), "above")) / (F.col("n_ctx") + s.strength)
        chain = F.when(F.col("left").isNull(), F.col("above")).otherwise(F.log10(smoothed))
        level = stored(_met(rows.drop("n_ctx"), states, "ctx", "n_ctx", hot).select("key", "skey", "word", "n", "above", "left", chain.alias("chain")))
        kept = states.filter("left IS NOT NULL").select("ctx", F.lit(length).alias("length"), "n_ctx", "named", "left")
        more = level.filter("left IS NOT NULL").select("key", "n", (F.col("chain") - F.col("left") - F.col("above")).alias("weight")).unionByName(
            kept.select(F.col("ctx").alias("key"), F.col("n_ctx").alias("n"), F.col("left").alias("weight"))
        )
        tree.states = kept if tree.states is None else tree.states.unionByName(kept)
        tree.weights = more if tree.weights is None else tree.weights.unionByName(more)
        for table in (counted, contexts, met, rows):
            forgotten(table)
        below, levels = level, [*levels, level]
    if tree.weights is not None:
        tree.weights = stored(tree.weights.groupBy("key").agg(F.max("n").alias("n"), F.sum("weight").alias("weight")))
    for table in levels:
        forgotten(table)
    return tree


def _states(rows: DataFrame, s: Settings) -> DataFrame:
    """(ctx, n_ctx, named, left) of each context of rows; left is log10 and null for a context that is no state."""
    share, above = F.col("n") / F.col("n_ctx"), F.pow(F.lit(10.0), "above")
    sums = rows.groupBy("ctx", "n_ctx").agg(F.count("*").alias("named"), F.sum(share).alias("share"), F.sum(above).alias("above"), F.sum(share * F.log(share / above)).alias("entropy"))
    # The rest, all words not named, is one more outcome.
    rest, rest_above = F.greatest(F.lit(0.0), 1 - F.col("share")), F.greatest(F.lit(1e-12), 1 - F.col("above"))
    entropy = F.col("entropy") + F.when(rest > 0, rest * F.log(rest / rest_above)).otherwise(0.0)
    left = (1 - (F.col("share") * F.col("n_ctx") + s.strength * F.col("above")) / (F.col("n_ctx") + s.strength)) / rest_above
    diverges = 2 * F.col("n_ctx") * entropy > s.divergence * F.col("named")
    return sums.select("ctx", "n_ctx", "named", F.when(diverges & (left > 0), F.log10(left)).alias("left"))


def head_least(table: DataFrame, most: int, least: float) -> int:
    """The least n of the rows of table that tasks look up: all of `least` or more, and the next ones while they are `most` in all."""
    least, held = math.ceil(least), 0
    with cleaned(table.sparkSession):
        sizes = dict(table.groupBy(F.least("n", F.lit(least)).alias("n")).count().collect())  # at most `least` rows
    for n in sorted(sizes, reverse=True):
        held += sizes[n]
        if held > most and n < least:
            break
        least = n
    return least


def _partly_scored(docs: DataFrame, counts: DataFrame, tree: Tree, s: Settings, least_word: int, least_gram: int) -> DataFrame:
    """docs with the sums over frequent words and n-grams, the other words with how often each occurs, and the other n-grams' keys."""
    head = counts.filter(F.col("n") >= least_word).toArrow() if tree.total else None  # at most 1 / head_share or head_words rows
    words = [bytes(w) for w in head["word"].to_pylist()] if head else []
    base = np.append(np.log10((head["n"].to_numpy() + 1) / (tree.total + tree.distinct + 1)) if head else [], 0.0)
    if tree.weights is not None:
        heavy = tree.weights.filter(F.col("n") >= least_gram).select("key", "weight").toArrow()  # at most (depth + 1) / head_share or head_grams rows
        keys = heavy["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        grams = (key_filter(tree.weights), key_filter(tree.states.select(F.col("ctx").alias("key"))), keys[order], heavy["weight"].to_numpy()[order])
    else:
        grams = None
    held = docs.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(words)}, np.append(hashed(words), np.uint64(0)), base, grams))
    depth = s.depth
    names = ["doc_id", "held_out", "n_tokens", "n_head", "head_base", "head_gain", "rare", "times", "grams"]

    def score(batches):
        number, hashes, base, grams = held.value
        size, index = len(number), key_index(grams[2]) if grams else None
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                rare, line, unknown, lengths = [], [], [], []
                for text in part.column(2).cast(pa.binary()).to_pylist():
                    tokens = tokens_of(text)
                    ids = [number.get(x, size) for x in tokens]
                    others = [x for x, i in zip(tokens, ids) if i == size]
                    rare.append(Counter(others))
                    unknown += others
                    line += ids
                    lengths.append(len(ids))
                seq, lengths = np.array(line, dtype=np.int64), np.array(lengths)
                starts = np.cumsum(lengths) - lengths
                gain, offsets, left = np.zeros(len(seq)), np.zeros(len(lengths) + 1, dtype=np.int32), np.zeros(0, dtype=np.uint64)
                if grams is not None:
                    words = hashes[seq]
                    words[seq == size] = hashed(unknown)
                    gain, ends, left = weighed(words, places(lengths), index, *grams)
                    offsets[1:] = np.cumsum(np.bincount(np.searchsorted(starts, ends, side="right") - 1, minlength=len(lengths)))
                total = lambda x: np.add.reduceat(x, starts)
                columns = [
                    part.column(0),
                    part.column(1),
                    pa.array(lengths, pa.int64()),
                    pa.array(total((seq < size).astype(np.int64)), pa.int64()),
                    pa.array(total(base[seq])),
                    pa.array(total(gain)),
                    pa.array([list(r) for r in rare], pa.list_(pa.binary())),
                    pa.array([list(r.values()) for r in rare], pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(left))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def weighed(words, place, index, bits, states, keys, weights):
        """By place the weights of n-grams that end there and are among the keys; place and key of the others, in order of places."""
        gain, ends, left, before = np.zeros(len(words)), [], [], None
        for n, gram in enumerate(gram_keys(words, depth + 1)):
            at = np.flatnonzero((place >= n) & may_hold(bits, gram))
            # What has a weight is a state or follows one.
            at = at[may_hold(states, gram[at]) | (may_hold(states, before[at - 1]) if n else False)]
            before = gram
            own = gram[at]
            hit = np.zeros(len(at), dtype=bool)
            if len(keys):
                found, hit = looked_up(keys, index, own)
                gain[at[hit]] += weights[found[hit]]
            ends.append(at[~hit])
            left.append(own[~hit])
        ends, left = np.concatenate(ends), np.concatenate(left)
        order = np.argsort(ends, kind="stable")
        return gain, ends[order], left[order]

    return docs.select(F.col("doc_id").cast("long"), "held_out", F.col("text").cast("string")).mapInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_head long, head_base double, head_gain double, rare array<binary>, times array<int>, grams array<long>"
    )


def score_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Counts and log10 probabilities of all docs under the base and the suffix tree of those not held out."""
    workers_find_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    held = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    docs = docs.select("doc_id", "text").withColumn("held_out", held)
    train = docs.filter(F.col("doc_id").isNotNull() & ~F.col("held_out"))
    counts = stored(count_words(train))
    return scored(docs, counts, grow(train, counts, settings), settings)


def scored(docs: DataFrame, counts: DataFrame, tree: Tree, settings: Settings) -> DataFrame:
    """The rows of score_documents for docs (doc_id, text, held_out) under a tree and its word counts."""
    share = settings.head_share * tree.total
    least_word = head_least(counts, settings.head_words, share)
    least_gram = head_least(tree.weights, settings.head_grams, share) if tree.weights is not None else 0
    partly = stored(with_uid(_partly_scored(docs, counts, tree, settings, least_word, least_gram)))
    rare = partly.select(UID, F.explode(F.arrays_zip("rare", "times")).alias("x")).select(UID, F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    # Words and n-grams that no task knows: of the training texts' tokens, each has less than head_share.
    unseen = np.log10(tree.total + tree.distinct + 1).item()
    sums = rare.join(counts.filter(F.col("n") < least_word), "word", "left").groupBy(UID).agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).cast("long").alias("n_rare"),
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1) - unseen)).alias("rare_base"),
    )
    sums = stored(sums)
    row = partly.drop("rare", "times", "grams").join(sums, UID, "left")
    gain = F.col("head_gain")
    if tree.weights is not None:
        grams = partly.select(UID, F.explode("grams").alias("key")).join(tree.weights.filter(F.col("n") < least_gram), "key")
        row = row.join(stored(grams.groupBy(UID).agg(F.sum("weight").alias("more"))), UID, "left")
        gain = gain + F.coalesce("more", F.lit(0.0))
    base = F.col("head_base") + F.coalesce("rare_base", F.lit(0.0))
    return row.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + gain).alias("score"),
    )
