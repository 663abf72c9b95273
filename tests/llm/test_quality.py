"""Quality rules against plain Python."""

import math
import random
import re
import time
import unicodedata
from collections import Counter

from thicket.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    places = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(places), len(w) < 50 or 100 * len(places) > 50 * len(w))


def kind(c):
    g = unicodedata.category(c)
    return {"Ll": 0, "Lu": 1}.get(g, {"L": 2, "N": 3, "M": 4, "P": 5}.get(g[0], 6))


def jsd(p, q):
    return math.sqrt(max(0, sum(a * math.log2(2 * a / (a + b)) if a else 0 for x, y in zip(p, q) for a, b in ((x, y), (y, x))) / 2))


def texts():
    rng = random.Random(5)
    out = [("", "en"), (None, "en"), (" \t\n", None), ("a b a b a b " * 30, "en"), ("#*$ %&| <>" * 40, "xx"), ("x\n\nx\n \ny\nx\x0b\nx", "en"), ("9" * 5000, None), ("é à ü " * 90, "fr"), ("one two three one two three", "en")]
    for k in range(150):
        lang = "en" if k % 3 else "fr"
        common = ["the", "of", "a", "to"] if lang == "en" else ["le", "de", "un", "à"]
        line = [rng.choice(common) if rng.random() < 0.5 else "w%d" % rng.randrange(300) for _ in range(rng.randrange(1, 400))]
        out.append((rng.choice([" ", "\n", "  \t"]).join(line), lang))
    return out + out[-3:]


def test_against_plain_python(spark):
    rules = quality.Rules(least_docs=20, common_words=4, word_limit=0.5)
    rows = [(i, x, lang, "clash", True) for i, (x, lang) in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string, source boolean").repartition(3)
    got = {r.doc_id: r for r in quality.judge(docs, rules).collect()}
    assert len(got) == len(rows)
    by_lang = Counter(r[2] for r in rows)
    counts = {}
    for _, x, lang, *_ in rows:
        for key in {lang if lang and by_lang[lang] >= 20 else None, None}:
            counts.setdefault(key, Counter()).update(WORD.findall(x or ""))
    reference = {}
    for key, c in counts.items():
        top = sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:4]
        total, chars = sum(c.values()), Counter()
        for w, n in c.items():
            for ch in w:
                chars[kind(ch)] += n
        shares = [n / total for _, n in top]
        reference[key] = [w for w, _ in top], [*shares, 1 - sum(shares)], [chars[i] / sum(chars.values()) for i in range(7)]
    for i, x, lang, *_ in rows:
        r, w = got[i], WORD.findall(x or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(x), x
        common, share, classes = reference[lang if lang in reference else None]
        n = max(1, len(w))
        hits = [w.count(c) / n for c in common]
        chars = Counter(map(kind, "".join(w)))
        d = jsd([chars[k] / max(1, len("".join(w))) for k in range(7)], classes), jsd([*hits, 1 - sum(hits)], share)
        assert abs(r.class_distance - d[0]) < 1e-6 and abs(r.word_distance - d[1]) < 1e-6
        far = r.word_chars >= 200 and d[0] > rules.class_limit or len(w) >= 80 and d[1] > 0.5
        assert r.kept == (not r.base_failed and not far)


def test_no_rows(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_limits_from_the_corpus(spark):
    """Production rules: words without any common one and symbols stuck to words go, clean texts stay."""
    rng = random.Random(9)
    common = ["the", "of", "and", "to", "in", "a", "is", "that", *["c%d" % k for k in range(24)]]
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(4, 9)))
    clean = lambda: [rng.choice(common) if rng.random() < 0.25 else rare() for _ in range(rng.randrange(250, 300))]
    rows = [(i, " ".join(clean()), "en") for i in range(150)]
    rows += [(1000 + i, " ".join(rare() for _ in range(150)), "en") for i in range(5)]
    rows += [(2000 + i, " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in clean()), "en") for i in range(5)]
    rows += [(3000 + i, " | ".join(clean()), "en") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.judge(docs, quality.CORPUS).collect()
    assert not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if not r.kept and r.doc_id >= 1000} == {i for i, *_ in rows if i >= 1000}
    assert sum(r.kept for r in got if r.doc_id < 1000) >= 145
    again = quality.judge(docs, carry=["doc_id"])
    assert again.columns == ["doc_id", *quality.ADDED] and {r.doc_id for r in again.filter("kept").collect()} == {r.doc_id for r in got if r.kept}


def test_long_text_takes_time_in_proportion(spark):
    """A text of 40,000 words takes about the time of twenty of 2,000, filtered or not."""
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else f"w{rng.randrange(900)}" for _ in range(n))
    took = []
    for texts_of in ([say(2000) for _ in range(20)], [say(40_000)]):
        docs = spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts_of)], "doc_id long, text string, lang string").repartition(1)
        for filtered in (False, True):
            began = time.time()
            got = quality.judge(docs).filter("kept" if filtered else "true").collect()
            took.append(time.time() - began)
            assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text) for r in got)
    assert took[3] < 5 * took[1] + 5 and took[2] < 5 * took[0] + 5
