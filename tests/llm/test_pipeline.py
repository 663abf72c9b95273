"""The pipeline's stages on a small table, each against plain Python on its own input."""

import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from thicket.llm.queries import byte_bpe_files

from test_jaccard import brute as components
from test_linedup import brute as lines_left
from test_quality import base


@pytest.fixture(scope="module")
def made():
    rng = random.Random(8)
    words = {"en": "the of and ing to in is that word story".split(), "fr": "le que de la un et pour dans une les".split()}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        line = lambda: " ".join(rng.choice(words[lang]) if rng.random() < 0.4 else f"{lang}{rng.randrange(3000)}" for _ in range(rng.randrange(12, 30)))  # noqa: B023, E731
        rows.append((i, "\n".join(line() for _ in range(rng.randrange(1, 7))), lang, f"s{i % 3}"))
    rows += [(100 + i, rows[i][1], rows[i][2], "copy") for i in range(8)]
    near = rows[11][1].split(" ")
    near[5] = "changed"
    rows += [(200, " ".join(near), "en", "near"), (201, None, "en", "x"), (202, "", None, "x"), (203, "12 34 !! " * 40, "en", "x"), (204, "same words again " * 60, "en", "x")]
    return [(i, x, lang, s, len(x or "")) for i, x, lang, s in rows]


def test_stages(spark, made, tmp_path):
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r.doc_id, r.text) for r in docs.collect())
        columns = docs.columns
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = before, docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, out = seen["quality_rules"]
    kept = {r.doc_id for r in out.collect()}
    assert kept <= {i for i, x in before if not base(x)[5]} and len(kept) >= 40 and not kept & {201, 202, 204}
    before, out = seen["language_id"]
    assert {r.doc_id for r in out.collect()} >= {i for i, _ in before if i < 60}
    before, out = seen["line_dedup"]
    want = sorted((i, x) for i, x, *_ in lines_left(before, 2, 24) if x.strip())
    assert sorted((r.doc_id, r.text) for r in out.collect()) == want and all(r.n_chars == len(r.text) for r in out.collect())
    before, out = seen["near_duplicates"]
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _, c in components(before, 5, 80) if i == c)
    before, out = seen["best_fit_packing"]
    tokenizer = Tokenizer.from_file(byte_bpe_files()[0])
    total = sum(len(tokenizer.encode(x, add_special_tokens=False).ids) + 1 for _, x in before)
    rows = out.collect()
    assert sum(r.length for r in rows) == total and {r.doc_id for r in rows} == {i for i, _ in before}
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id").collect()))[0][0] == min(i for i, _ in before)
