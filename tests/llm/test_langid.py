"""Language identification: held-out accuracy, the learner against plain logistic regression, and its defined results."""

import random
import zlib

import numpy as np
import pyarrow as pa

from thicket.llm import langid

SMALL = langid.Settings(bits=12, sample_docs=400, shards=2)
SYLLABLES = {"en": "the of and ing tion er", "fr": "le que eau oi ment de", "de": "der und ich sch ung ei"}


def text(rng, lang):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60)))


def test_held_out_accuracy_and_defined_results(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang := rng.choice(list(SYLLABLES))), lang, "clash") for i in range(600)]
    odd = [(1000, None, "en"), (1001, "", "fr"), (1002, "123 !?", "de"), (1003, "xq zz", None), (None, rows[0][1], "en"), (1004, "the of " * 30000, "en"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame(rows + [(*r, "clash") for r in odd], "doc_id long, text string, lang string, score string").repartition(4)
    got = langid.identify(docs, SMALL).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.lang_pred in {*SYLLABLES, "und"}
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1000].score == 0
    assert by_id[1004].lang_pred == "en"
    held = [r for r in got if r.held_out and r.lang and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)


def test_no_training_rows(spark):
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string"), SMALL).collect() == []
    got = langid.identify(spark.createDataFrame([(4, "words", None)], "doc_id long, text string, lang string"), SMALL).first()
    assert (got.lang_pred, got.score) == ("und", 0.0)


def test_blocks_change_nothing(monkeypatch):
    texts = pa.array(["", None, "Ab" * 40, "é ü x", "a"])
    def counts():
        out = {}
        for row, _, buckets, owners in langid.features(texts, SMALL):
            for b, o in zip(buckets.tolist(), owners.tolist()):
                out[row + o, b] = out.get((row + o, b), 0) + 1
        return out
    whole = counts()
    real = langid.code_points
    monkeypatch.setattr(langid, "code_points", lambda t, overlap: real(t, most=16, overlap=overlap))
    assert counts() == whole
    assert sum(n for (row, _), n in whole.items() if row == 2) == 80 + 79 + 78


def test_ftrl_separates_and_is_sparse():
    rng = np.random.default_rng(2)
    rows = [(np.array([y, 5 + rng.integers(40)]), np.array([1.0, 0.3]), int(y)) for y in rng.integers(0, 3, 300)]
    weights, bias = langid.ftrl(rows, 3, langid.Settings(bits=7, epochs=3, l1=0.5))
    assert all((x @ weights[at] + bias).argmax() == y for at, x, y in rows)
    assert (weights != 0).mean() < 0.5
