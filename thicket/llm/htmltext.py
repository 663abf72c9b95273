"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: text between block-level tags, each with the tags and class or id words above it.
A bidirectional LSTM in numpy reads a hashed tag-path vector, a hashed word vector and a few counts of every block in page
order and says which blocks are main text, so each block is judged with the whole page as context.

Pages carry no labels. The labeller learns from at most `sample_pages` pages, drawn by a hash of their markup, whose blocks get
seed labels from the meaning of HTML's own elements and usual class words; each page is also used with further menus,
notices, forms, comments and the like put in, and with its article's element renamed, so that the network has seen the usual
wrappers whatever the sample holds. Some are used once more with all telling elements and class words taken away, their labels
kept: there only length, links, punctuation, words, place and what stands around a block can tell main text from the rest; the
first and last blocks of such an article may still be misjudged. On pages that use the usual elements and words the network hardly
differs from the seed labels. Every page is labelled whole; nothing but the training sample is bounded.

Defined results: null, empty or blank html has an empty text. Unclosed tags and comments end with the page. A < that opens no
tag is text. White space is Python's, U+00A0 included. A block whose chance is exactly one half is no main text. Character
references are decoded once. Comments, scripts, styles and the head are no blocks. Repeated rows are each extracted. Columns
named like the added ones are replaced, all others stay.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import workers_find_package

PATH_DIM, WORD_DIM, COUNTS, HIDDEN = 96, 32, 6, 16

# Element names of HTML and usual class words.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noframes ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD_TAGS = "script style template"
SIDE_TAGS = frozenset("nav footer aside form button select option textarea label fieldset menu dialog head title iframe".split())
MAIN_TAGS = frozenset("article main".split())
PLAIN_TAGS = frozenset("html head title body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th pre blockquote".split())
SIDE_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie consent copyright disqus footer form header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
MAIN_WORDS = frozenset("article body content entry main post story text".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + UNREAD_TAGS.replace(" ", "|") + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*?(?:/>|>.*?(?:</\1\s*>|\Z)|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
#: Elements that a new one of these ends, if they are open inside the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}


@dataclass(frozen=True)
class Settings:
    sample_pages: int = 400
    variants: int = 3
    plain: int = 2
    epochs: int = 6
    batch: int = 32
    rate: float = 0.01
    seed: int = 11


def leaf_blocks(page: str | None) -> list[tuple[str, tuple, int]]:
    """(text, path, characters in links) of a page's blocks; path is of (tag, class words) from the outside in."""
    page = page or ""
    out, parts, stack = [], [], []
    linked, in_link, at = 0, 0, 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, tuple(stack), linked))
            parts, linked = [], 0

    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) if in_link else 0
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "a":
            in_link = 0 if m[2] else 1
        if tag == "br":
            parts.append(" ")
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        if tag in ENDS:
            ended, within = ENDS[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in within:
                    break
                if stack[k][0] in ended:
                    del stack[k:]
                    break
        if tag not in VOID_TAGS and not m[4].endswith("/"):
            names = " ".join(filter(None, (x for g in NAMES.findall(m[4]) for x in g))) if "=" in m[4] else ""
            stack.append((tag, tuple(WORDS.findall(names.lower()))))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def seed_label(path: tuple) -> float:
    """1 for main text, 0 for what is not, 0.5 for no opinion, from the elements and class words above a block."""
    inside = False
    for tag, words in path:
        side = any(w in SIDE_WORDS for w in words)
        if tag in SIDE_TAGS or side or tag == "header" and not inside:
            return 0.0
        inside |= tag in MAIN_TAGS or tag != "body" and any(w in MAIN_WORDS for w in words)
    return 1.0 if inside else 0.5


def varied(blocks: list, rng: random.Random) -> list:
    """A page's blocks with usual side matter put in, and perhaps the article's element renamed."""
    side = [(("nav", ()), ("ul", ()), ("li", ())), (("header", ()),), (("footer", ()),), (("aside", ()), ("p", ())), (("form", ()), ("label", ())), (("form", ()), ("button", ()))]
    side += [(("div", (w,)), *rest) for w in rng.sample(sorted(SIDE_WORDS), 8) for rest in ((), (("p", ()),))] + [(("section", (w,)), ("div", ()), ("p", ())) for w in ("comments", "related", "respond", "comment")]
    top = (("html", ()), ("body", ()))
    wrap = rng.choice([("article", ()), ("main", ()), ("div", (rng.choice(sorted(MAIN_WORDS)),))])
    out = []
    for text, path, linked in blocks:
        path = tuple(wrap if x[0] in MAIN_TAGS else x for x in path)
        out.append((text, path, linked))
    for _ in range(rng.randrange(1, 6)):
        text = rng.choice(blocks)[0]
        own = rng.choice(side)
        place = rng.randrange(len(out) + 1)
        inner = (wrap,) if rng.random() < 0.3 and own[0][0] not in ("header",) else ()
        run = [(" ".join(text.split()[: rng.randrange(1, 40)]), top + inner + own, 0) for _ in range(rng.randrange(1, 4))]
        out[place:place] = run
    return out


def plainly(blocks: list, rng: random.Random) -> list:
    """A page's blocks without class words and with plain elements alone; perhaps with nothing but div elements in its body."""
    kept = PLAIN_TAGS if rng.random() < 0.5 else frozenset(("html", "head", "title", "body"))
    return [(text, tuple((tag if tag in kept else "div", ()) for tag, _ in path), linked) for text, path, linked in blocks]


def vectors(blocks: list) -> np.ndarray:
    """One row of inputs for each block."""
    out = np.zeros((len(blocks), PATH_DIM + WORD_DIM + COUNTS), dtype=np.float32)
    for i, (text, path, linked) in enumerate(blocks):
        row = out[i]
        for k, (tag, words) in enumerate(path):
            row[_path_bucket(tag)] = 1
            if k == len(path) - 1:
                row[_path_bucket("last " + tag)] = 1
            for w in words:
                row[_path_bucket("word " + w)] = 1
        spoken = text.split()
        counts = np.bincount([zlib.crc32(w.encode()) % WORD_DIM for w in spoken], minlength=WORD_DIM)
        row[PATH_DIM : PATH_DIM + WORD_DIM] = counts / len(spoken)
        n = len(text)
        row[PATH_DIM + WORD_DIM :] = min(1.0, np.log1p(n) / 8), min(1.0, len(spoken) / 100), min(1.0, linked / n), text[-1] in ".!?", i / len(blocks), 1.0
    return out


_BUCKETS: dict[str, int] = {}


def _path_bucket(name: str) -> int:
    got = _BUCKETS.get(name)
    if got is None:
        # Side and main words share two inputs besides their own, so that an unseen one means something.
        got = zlib.crc32(name.encode()) % (PATH_DIM - 2)
        if name.startswith("word ") and name[5:] in SIDE_WORDS:
            got = PATH_DIM - 2
        elif name.startswith("word ") and name[5:] in MAIN_WORDS:
            got = PATH_DIM - 1
        if len(_BUCKETS) < 100_000:
            _BUCKETS[name] = got
    return got


class Labeller:
    """A bidirectional LSTM with a logistic output; arrays are (step, page, unit)."""

    def __init__(self, rng: np.random.Generator):
        n = PATH_DIM + WORD_DIM + COUNTS
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"W{d}": draw(n, 4 * HIDDEN), f"U{d}": draw(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"V": draw(2 * HIDDEN, 1), "v": np.zeros(1, np.float32)}

    def run(self, x: np.ndarray, mask: np.ndarray, d: str):
        """States of one direction, and what its backward pass needs. Masked steps keep the state as it was."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        into = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        states, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = into[t] + h @ self.p[f"U{d}"]
            gates = 1 / (1 + np.exp(-np.clip(a[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            kept.append((t, h, c, i, f, o, g, tc, m))
            c = m * new + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            states[t] = h
        return states, kept

    def chances(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.run(x, mask, d)[0] for d in "fb"], axis=2)
        return 1 / (1 + np.exp(-np.clip(both @ self.p["V"] + self.p["v"], -30, 30)))[..., 0]

    def gradients(self, x, mask, y, weight):
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        runs = {d: self.run(x, mask, d) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.p["V"] + self.p["v"], -30, 30)))[..., 0]
        e = ((p - y) * weight / max(1.0, weight.sum()))[..., None]
        g["V"], g["v"] = np.einsum("tph,tpo->ho", both, e), e.sum(axis=(0, 1))
        back = e @ self.p["V"].T
        for k, d in enumerate("fb"):
            dh, dc = np.zeros(both.shape[1:2] + (HIDDEN,), np.float32), np.zeros(both.shape[1:2] + (HIDDEN,), np.float32)
            for t, h, c, i, f, o, gg, tc, m in reversed(runs[d][1]):
                dh = dh + back[t][:, k * HIDDEN : (k + 1) * HIDDEN]
                own = dh * m
                dn = dc * m + own * o * (1 - tc * tc)
                a = np.concatenate([dn * gg * i * (1 - i), dn * c * f * (1 - f), own * tc * o * (1 - o), dn * i * (1 - gg * gg)], axis=1)
                g[f"W{d}"] += x[t].T @ a
                g[f"U{d}"] += h.T @ a
                g[f"c{d}"] += a.sum(axis=0)
                dh = dh * (1 - m) + a @ self.p[f"U{d}"].T
                dc = dc * (1 - m) + dn * f
        return g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), PATH_DIM + WORD_DIM + COUNTS), np.float32), np.zeros((steps, len(pages)), np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i], mask[: len(p), i] = p, 1
    return x, mask


def fit(pages: list[str], s: Settings = Settings()) -> dict[str, np.ndarray]:
    """Weights learned from pages' seed labels, by Adam."""
    rng, dice = np.random.default_rng(s.seed), random.Random(s.seed)
    shown = []
    for blocks in filter(None, map(leaf_blocks, pages)):
        shapes = [(one, one) for one in [blocks, *(varied(blocks, dice) for _ in range(s.variants))]]
        for known, one in shapes + [(blocks, plainly(blocks, dice)) for _ in range(s.plain)]:
            labels = np.array([seed_label(path) for _, path, _ in known], dtype=np.float32)
            for at in range(0, len(one), 400):  # a long page is learned from in parts
                shown.append((vectors(one)[at : at + 400], labels[at : at + 400]))
    model = Labeller(rng)
    first, second, step = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    for _ in range(s.epochs):
        order = sorted(rng.permutation(len(shown)), key=lambda i: len(shown[i][0]) // 8)
        batches = [order[i : i + s.batch] for i in range(0, len(order), s.batch)]
        for b in rng.permutation(len(batches)):
            x, mask = padded([shown[i][0] for i in batches[b]])
            y = np.full(mask.shape, 0.5, np.float32)
            for k, i in enumerate(batches[b]):
                y[: len(shown[i][1]), k] = shown[i][1]
            step += 1
            for k, g in model.gradients(x, mask, y, mask * (y != 0.5)).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] -= (s.rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model.p


def train(pages: DataFrame, s: Settings = Settings()) -> dict[str, np.ndarray]:
    """Weights learned by one task from a sample of at most sample_pages pages, which don't leave the executors."""
    workers_find_package(pages.sparkSession)
    some = pages.filter(F.length("html") > 0)
    total = some.count()
    # About as many again as needed are drawn by hash, so that only these are ordered.
    drawn = some.select("html", F.xxhash64("html").alias("h")).filter(F.pmod(F.col("h"), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, 3 * s.sample_pages / max(1, total))))
    sample = drawn.distinct().orderBy("h", "html").limit(s.sample_pages)

    def learn(pdf):
        p = fit(pdf.sort_values("html").html.tolist(), s)
        return pd.DataFrame({"name": list(p), "shape": [list(v.shape) for v in p.values()], "value": [v.ravel().astype(float).tolist() for v in p.values()]})

    rows = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "name string, shape array<int>, value array<double>").collect()
    return {r["name"]: np.array(r["value"], dtype=np.float32).reshape(r["shape"]) for r in rows}


def extract(pages: DataFrame, settings: Settings = Settings(), weights: dict | None = None) -> DataFrame:
    """pages with text and n_chars of their html."""
    workers_find_package(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    weights = weights or train(pages.select("html"), settings) or Labeller(np.random.default_rng(0)).p
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def label(batches):
        model = Labeller(np.random.default_rng(0))
        model.p = weights
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [leaf_blocks(x) for x in part.column(part.schema.get_field_index("html")).to_pylist()]
                texts = [""] * len(found)
                order = sorted((i for i in range(len(found)) if found[i]), key=lambda i: len(found[i]))
                while order:
                    run, steps = [], len(found[order[0]])
                    while order and (not run or len(found[order[0]]) <= max(steps + 8, steps * 5 // 4) and len(run) < 128):
                        run.append(order.pop(0))
                    p = model.chances(*padded([vectors(found[i]) for i in run]))
                    for k, i in enumerate(run):
                        texts[i] = "\n\n".join(b[0] for b, c in zip(found[i], p[:, k]) if c > 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return pages.mapInArrow(label, schema)
