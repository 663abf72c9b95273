"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies are counted over every training text. The weights are fitted by FTRL-proximal with elastic-net
penalties on a sample of at most `sample_docs` labelled training documents, drawn alike from every language by a hash of
the row, in `shards` parts that learn on their own and are averaged; a further sample, on which nothing was fitted, sets
the temperature that calibrates the probabilities. The sample bounds are the only ones: idf and predictions cover all rows
and whole texts.

Defined results: a null text, or one without a letter, is `und` with score 0. A null or unseen lang is never learned;
rows with a null doc_id are predicted, are not held out and are not learned from. Without any training row every text is
`und`. Repeated rows are predicted each. Ties go to the language that sorts first. Columns named like the added ones are
replaced; all other columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import code_points, fold, workers_find_package

UNKNOWN = "und"
#: Temperatures tried when the probabilities are calibrated.
TEMPERATURES = np.round(np.geomspace(0.05, 8, 120), 6)


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    #: Labelled documents from which the weights are fitted at most, and as many again at most a quarter for calibration.
    sample_docs: int = 6000
    shards: int = 2
    epochs: int = 10
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.0005
    #: Logits are weights times the mean TF-IDF of a text, which is small; this scales features to about one.
    scale: float = 10.0


def ngram_buckets(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each code point; the last n - 1 have none."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint32)
    h = np.full(m, 2166136261 + n, dtype=np.uint32)
    for i in range(n):
        h ^= codes[i : i + m]
        h *= np.uint32(2654435761)
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)


def features(texts: pa.Array, s: Settings):
    """Per block of rows: (first row, counts of n-grams by row, buckets, row of each bucket)."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    reach, before = max(s.orders) - 1, -1
    for row, bounds, codes in code_points(lowered, overlap=reach):
        repeated = reach if row == before else 0
        before = row if len(bounds) == 2 else -1
        rows = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
        buckets, owners = [], []
        for n in s.orders:
            got = ngram_buckets(codes, n, s.bits)
            own = rows[: len(got)]
            inside = own == rows[n - 1 :]
            if repeated:
                inside[: reach - n + 1] = False
            buckets.append(got[inside])
            owners.append(own[inside])
        yield row, len(bounds) - 1, np.concatenate(buckets), np.concatenate(owners)


def document_frequencies(docs: DataFrame, s: Settings) -> DataFrame:
    """(bucket, df) over all texts; each task adds up its own before the shuffle."""

    def count(batches):
        df = np.zeros(1 << s.bits, dtype=np.int64)
        for batch in batches:
            long_text = np.zeros(1 << s.bits, dtype=bool)
            before = -1
            for row, n, buckets, owners in features(batch.column(0), s):
                if n == 1:  # perhaps a further block of the same text
                    if row != before:
                        df += long_text
                        long_text[:] = False
                    long_text[buckets] = True
                    before = row
                    continue
                keys = np.unique(owners.astype(np.int64) << s.bits | buckets)
                df += np.bincount(keys & ((1 << s.bits) - 1), minlength=1 << s.bits)
            df += long_text
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(df[seen])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("df"))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bucket, class) and biases after `epochs` passes of FTRL-proximal over (buckets, values, class)."""
    size = 1 << s.bits
    z, q = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))  # the last row is the bias

    def weights(zi, qi):
        w = -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(qi)) / s.alpha + s.l2)
        return np.where(np.abs(zi) <= s.l1, 0.0, w)

    rng = np.random.default_rng(7)
    for _ in range(s.epochs):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, size), np.append(x, 1.0)
            zi, qi = z[at], q[at]
            w = weights(zi, qi)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(qi + g * g) - np.sqrt(qi)) / s.alpha
            z[at] = zi + g - sigma * w
            q[at] = qi + g * g
    w = weights(z, q)
    return w[:-1], w[-1]


@dataclass
class Model:
    languages: list[str]
    #: idf times weight, by bucket and language.
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    settings: Settings

    def logits(self, texts: pa.Array) -> np.ndarray:
        s = self.settings
        total, grams = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for row, n, buckets, owners in features(texts, s):
            grams[row : row + n] += np.bincount(owners, minlength=n)
            for c in range(len(self.languages)):
                total[row : row + n, c] += np.bincount(owners, weights=self.table[c][buckets], minlength=n)
        return self.bias + s.scale * total / np.maximum(grams, 1)[:, None]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, s: Settings = Settings()) -> Model | None:
    """A model of the labelled documents of docs (doc_id, text, lang); None if there are none. doc_id only helps to draw the sample."""
    workers_find_package(docs.sparkSession)
    docs = docs.select("text", F.xxhash64("doc_id", "text", F.lit("langid")).alias("mixed"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    by_lang = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).limit(1001).collect()}
    if len(by_lang) > 1000:
        raise ValueError("lang has over 1,000 values")
    if not by_lang:
        return None
    languages = sorted(by_lang)
    total = sum(by_lang.values())
    idf = np.zeros(1 << s.bits)
    for r in document_frequencies(docs, s).collect():  # one row for each of 2 ** bits buckets at most
        idf[r["bucket"]] = np.log((1 + total) / (1 + r["df"])) + 0.1
    each = max(1, s.sample_docs // len(languages))
    spark = docs.sparkSession
    # At most `each` rows of a language for fitting and a quarter of that for calibration, by a hash of the row.
    rates = spark.createDataFrame([(k, min(1.0, 1.25 * each / by_lang[k])) for k in languages], "lang string, rate double")
    mixed = F.col("mixed")
    drawn = docs.join(F.broadcast(rates), "lang").filter(F.pmod(mixed, F.lit(1 << 30)) < F.col("rate") * (1 << 30)).select("text", "lang", F.pmod(F.shiftright(mixed, 30), F.lit(5 * s.shards)).alias("part"))
    place = {k: i for i, k in enumerate(languages)}

    def rows(pdf: pd.DataFrame):
        out = []
        texts = pa.array(pdf.text, pa.string())
        for i, lang in enumerate(pdf.lang):
            found = [b for _, _, b, _ in features(texts.slice(i, 1), s)]
            at, counts = np.unique(np.concatenate(found) if found else np.empty(0, np.uint32), return_counts=True)
            out.append((at, s.scale * idf[at] * counts / max(1, counts.sum()), place[lang]))
        return out

    def learn(pdf):
        weights, bias = ftrl(rows(pdf.sort_values(["part", "lang", "text"])), len(languages), s)
        at, c = np.nonzero(weights)
        return pd.DataFrame({"bucket": np.append(at, np.full(len(bias), -1)), "class": np.append(c, np.arange(len(bias))), "weight": np.append(weights[at, c], bias)})

    sample = drawn.persist()
    try:
        if sample.count() > 2 * s.sample_docs:  # only where one row repeats very often
            sample = sample.limit(2 * s.sample_docs)
        # Four parts in five learn; the fifth sets the temperature.
        shard = F.pmod(F.col("part"), F.lit(s.shards))
        learned = sample.filter(F.col("part") < 4 * s.shards).withColumn("shard", shard).groupBy("shard").applyInPandas(learn, "bucket int, class int, weight double")
        used = max(1, sample.filter(F.col("part") < 4 * s.shards).select(shard).distinct().count())
        table, bias = np.zeros((len(languages), 1 << s.bits)), np.zeros(len(languages))
        for r in learned.groupBy("bucket", "class").agg(F.sum("weight").alias("weight")).toArrow().to_pandas().itertuples(index=False):
            if r[0] < 0:
                bias[r[1]] = r[2] / used
            else:
                table[r[1], r[0]] = r[2] / used * idf[r[0]]
        model = Model(languages, table, bias, 1.0, s)
        held = sample.filter(F.col("part") >= 4 * s.shards).select("text", "lang")

        def losses(batches):
            total = np.zeros(len(TEMPERATURES))
            for batch in batches:
                logits = model.logits(batch.column(0))
                y = [place[x] for x in batch.column(1).to_pylist()]
                for k, t in enumerate(TEMPERATURES):
                    total[k] -= np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).sum()
            yield pa.RecordBatch.from_arrays([pa.array(TEMPERATURES), pa.array(total)], names=["t", "loss"])

        best = held.mapInArrow(losses, "t double, loss double").groupBy("t").agg(F.sum("loss").alias("loss")).orderBy("loss", "t").first()
        model.temperature = best["t"] if best and best["loss"] > 0 else 1.0
    finally:
        drawn.unpersist()
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score, from text alone."""
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    workers_find_package(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits weights a language, whatever the corpus

    def guess(batches):
        m = held.value
        names = np.array(m.languages, dtype=object)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            logits = m.logits(texts)
            best = logits.argmax(axis=1)
            score = softmax(logits / m.temperature)[np.arange(len(texts)), best]
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(letters, names[best], UNKNOWN), pa.string()), pa.array(np.where(letters, score, 0.0))], names=schema.names)

    return docs.mapInArrow(guess, schema)


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with held_out, lang_pred and score; learned from the documents that are not held out."""
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    known = docs.filter(F.col("doc_id").isNotNull() & ~held)
    return predict(docs.withColumn("held_out", held), train(known, settings))
