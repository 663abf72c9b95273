"""Packing against the tokenizer itself, the rules of a packing, and one-at-a-time best fit."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from thicket.llm import packing

FILES = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(FILES[0])
    out.encode_special_tokens = True
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 'st\n\t\r1é \x1c .#", max_size=60))
def test_words_alone_equal_whole_text(text):
    whole = Tokenizer.from_file(FILES[0])
    whole.encode_special_tokens = True
    assert np.frombuffer(packing.byte_bpe(*FILES).encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pieces_and_places(spark, tokenizer):
    rng = random.Random(1)
    texts = ["", None, "a b c", "same text here"] + ["same text here"] * 30 + [" ".join("word%d" % rng.randrange(99) for _ in range(rng.choice([3, 40, 200, 900, 2500]))) for _ in range(40)]
    rows = [(i // 2 if i > 3 else i, x, "clash") for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows + [(None, "no id", "clash")], "doc_id long, text string, piece string").repartition(5)
    got = [r.asDict() for r in packing.pack_documents(docs, *FILES).collect()]
    want = []
    for doc_id, text, _ in rows + [(None, "no id", "")]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : first if k == 0 else start + 1024]
            want.append((doc_id, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    check(got, 1024)


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("sizes", [[5], [10] * 50, [6, 4, 6, 4, 7, 3, 10, 1, 1, 1], [random.Random(k).randint(1, 10) for k in range(300)], [1] * 95, [7] * 40 + [3] * 20 + [1] * 60])
def test_close_to_serial_best_fit(spark, sizes):
    items = spark.createDataFrame(list(enumerate(sizes)), "id long, size long").repartition(4)
    got = packing.best_fit(items, 10).join(items, "id").select("sequence_id", "offset", F.col("size").alias("length")).collect()
    assert len(got) == len(sizes)
    gaps = []
    for size in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= size]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else 10) - size)
    assert check(got, 10) <= max(len(gaps) + 1, 1.02 * len(gaps))


def test_empty_and_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none, *FILES).count() == 0
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(30)], "doc_id long, text string")
    packed = packing.pack_documents(docs, *FILES)
    ids = {r.sequence_id: r.ids for r in packing.packed_ids(docs, packed, *FILES).collect()}
    for r in packed.collect():
        part = ids[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32


def test_rounds_take_few_tasks(spark):
    """Where every shuffle has 40 partitions, a round costs two such shuffles and small tables, not each table of a round several times."""
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    context = spark.sparkContext
    for k, v in names.items():
        spark.conf.set(k, v)
    context.setJobGroup("rounds", "best fit")
    try:
        rng = random.Random(1)
        items = spark.createDataFrame([(k, rng.randint(1, 50)) for k in range(2000)], "id long, size long")
        assert packing.best_fit(items, 64).count() == 2000
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("rounds")]
    stages = {k: tracker.getStageInfo(k) for j in jobs if j for k in j.stageIds}
    tasks = sum(s.numCompletedTasks for s in stages.values() if s)
    assert tasks < 3000
