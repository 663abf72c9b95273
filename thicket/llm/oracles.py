"""The corpus operators that SQL can express, as SQL over the input tables."""

from __future__ import annotations

from . import chat, phrases, quality, secrets, topk, treap

_GAP = r"[\x20\x09-\x0D]+"

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_GAP}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
u AS (SELECT doc_id, unnest(s) AS t FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce((SELECT min(other) FROM r WHERE r.doc_id = n.doc_id), n.doc_id)) AS component_id FROM n
"""

#: Character classes of the quality rules, in their order.
_CLASSES = [r"\p{Ll}", r"\p{Lu}", r"[\p{Lt}\p{Lm}\p{Lo}]", r"\p{N}", r"\p{M}", r"\p{P}"]
_COUNTS = ", ".join(f"length(j) - length(regexp_replace(j, '{c}', '', 'g'))" for c in _CLASSES)
_JSD = "CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END"

_RULES = quality.CORPUS

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '{_GAP}'), lambda x: x <> '') AS w FROM d),
j AS (SELECT *, array_to_string(w, '') AS j FROM w),
k AS (SELECT *, len(w) AS n_words, length(j) AS word_chars, [{_COUNTS}] AS six FROM j),
cc AS (SELECT *, list_append(six, word_chars - list_sum(six)) AS classes FROM k),
wi AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
re AS (SELECT rid, unnest([i, i + 1, i + 2]) AS place FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM wi) WHERE n > 1),
rp AS (SELECT rid, count(DISTINCT place) AS n_repeat_words FROM re GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
en AS (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 100),
fam AS (SELECT cc.*, CASE WHEN lang IN (SELECT lang FROM en) THEN lang END AS fam FROM cc),
al AS (SELECT * FROM (SELECT rid, lang AS fam, w, classes FROM cc WHERE lang IN (SELECT lang FROM en) UNION ALL SELECT rid, NULL, w, classes FROM cc)),
wc AS (SELECT fam, word, count(*) AS n FROM (SELECT fam, unnest(w) AS word FROM al) GROUP BY fam, word),
wt AS (SELECT fam, sum(n) AS total FROM wc GROUP BY fam),
tp AS (SELECT fam, word, n / total AS q, place FROM (SELECT wc.*, wt.total, row_number() OVER (PARTITION BY wc.fam ORDER BY n DESC, word) AS place FROM wc JOIN wt ON wc.fam IS NOT DISTINCT FROM wt.fam) WHERE place <= 32),
cs AS (SELECT fam, i, sum(classes[i]) AS n FROM al, (SELECT unnest(range(1, 8)) AS i) GROUP BY fam, i),
cq AS (SELECT fam, i, n / sum(n) OVER (PARTITION BY fam) AS q FROM cs),
cd AS (SELECT rid, sqrt(greatest(0, sum({_JSD}) / 2)) AS class_distance FROM (SELECT fam.rid, classes[cq.i] / greatest(1, word_chars) AS p, q FROM fam JOIN cq ON fam.fam IS NOT DISTINCT FROM cq.fam) GROUP BY rid),
dw AS (SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(w) AS word FROM w) GROUP BY rid, word),
wp AS (SELECT fam.rid, coalesce(dw.n, 0) / greatest(1, fam.n_words) AS p, tp.q FROM fam JOIN tp ON fam.fam IS NOT DISTINCT FROM tp.fam LEFT JOIN dw ON dw.rid = fam.rid AND dw.word = tp.word),
wr AS (SELECT rid, p, q FROM wp UNION ALL SELECT rid, 1 - sum(p), 1 - sum(q) FROM wp GROUP BY rid),
wd AS (SELECT rid, sqrt(greatest(0, sum({_JSD}) / 2)) AS word_distance FROM (SELECT rid, CASE WHEN p < 1e-12 THEN 0 ELSE p END AS p, q FROM wr) GROUP BY rid),
f AS (SELECT fam.doc_id, fam.fam, n_words, word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, class_distance, word_distance,
             n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
      FROM fam LEFT JOIN rp USING (rid) LEFT JOIN ln USING (rid) JOIN cd USING (rid) JOIN wd USING (rid)),
kd AS (SELECT fam, 0 AS kind, round(class_distance * {quality.BINS}) AS bin FROM f WHERE NOT base_failed AND word_chars >= {_RULES.class_guard}
       UNION ALL SELECT fam, 1, round(word_distance * {quality.BINS}) FROM f WHERE NOT base_failed AND n_words >= {_RULES.word_guard}),
md AS (SELECT fam, kind, quantile_cont(bin, 0.5) AS median FROM kd GROUP BY fam, kind),
sp AS (SELECT kd.fam, kd.kind, any_value(median) AS median, greatest({quality.LEAST_SPREAD}, quantile_cont(abs(bin - median), 0.5)) AS spread FROM kd JOIN md ON kd.fam IS NOT DISTINCT FROM md.fam AND kd.kind = md.kind GROUP BY kd.fam, kd.kind),
bo AS (SELECT fam, max(CASE WHEN kind = 0 THEN (median + {_RULES.class_spread} * spread) / {quality.BINS} END) AS class_bound, max(CASE WHEN kind = 1 THEN (median + {_RULES.word_spread} * spread) / {quality.BINS} END) AS word_bound FROM sp GROUP BY fam)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(word_chars >= {_RULES.class_guard} AND class_distance > class_bound OR n_words >= {_RULES.word_guard} AND word_distance > word_bound, false) AS kept, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM f LEFT JOIN bo ON f.fam IS NOT DISTINCT FROM bo.fam
"""

LINES = r"""
WITH e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents),
b AS (SELECT *, length(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))) AS size, size > 0 AS counts FROM e),
o AS (SELECT line, size, min(doc_id * 10000000000::HUGEINT + place) AS first FROM b WHERE counts GROUP BY line, size),
g AS (SELECT DISTINCT a.line FROM o a JOIN o b ON b.first < a.first AND a.size >= 24 AND b.size >= 24 AND abs(length(a.line) - length(b.line)) <= 2 AND a.line <> b.line AND levenshtein(a.line, b.line) <= 2),
k AS (SELECT b.doc_id, b.place, b.line, NOT counts OR (g.line IS NULL AND o.first = b.doc_id * 10000000000::HUGEINT + b.place) AS stays FROM b LEFT JOIN o ON b.line = o.line LEFT JOIN g ON b.line = g.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (stays), '') AS text FROM k GROUP BY doc_id
"""

ORACLE_SQL = {"op4_chat": chat.ORACLE, "op5_topk": topk.ORACLE, "op6_linedup": LINES, "op8_quality": QUALITY, "op9_jaccard": JACCARD, "op11_treap": treap.ORACLE, "op12_phrases": phrases.ORACLE, "op13_secrets": secrets.ORACLE}
