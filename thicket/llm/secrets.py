"""Secrets in texts: three fixed patterns, and a battery of randomness tests, in DataFrame functions only.

The patterns are an assignment to a name like token, an access key, and a long run of hexadecimal digits. Beside them every
run of at least `least_chars` signs that encodings use is a candidate. Its encoding is the smallest alphabet that holds its
signs; it must have a letter and a digit. Three tests ask whether its signs are drawn evenly and one by one from that alphabet:
chi-squared of their counts, runs above and below the alphabet's middle, and correlation of neighbours. A candidate that one of
them rejects (at `reject`, for the three together) is none. What is left must also be unlikely as text: the number of equal
pairs of signs, which is what chi-squared counts, has a known mean and variance under the shares that the alphabet's signs have
in all texts of the corpus, and the probability of so few pairs is the candidate's p. Short candidates can't have a small one.

p is held against the false discovery rate `rate` by Benjamini and Hochberg's rule, apart for each encoding and band of
lengths, over different candidates; one that the battery rejects counts with a p of 1. Logarithms of p are counted by bins
first, so that a limit is made from a small table whatever the corpus, and never from all candidates in one task.

Defined results: a null text is empty and has no spans. Spans of the patterns stay whatever the tests say, those of one pattern
don't overlap, those of two may; a candidate that shares a sign with one of them is left out. Repeated rows and rows with equal
or null ids are searched each. Places are code points, ends exclusive. A text without spans has an empty array.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: The patterns, in the order of their kinds; the last kind is the battery's.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]
TOKEN = r"[A-Za-z0-9+/_-]{%d,}={0,2}"
#: Alphabets by name, smallest first, each with its signs in the order of their values.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "hex": DIGITS + LOWER[:6],
    "HEX": DIGITS + UPPER[:6],
    "base32": UPPER + DIGITS[2:8],
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
SIGNS = DIGITS + UPPER + LOWER + "+/-_"
#: The Chebyshev fit of the complementary error function, highest power first.
ERFC = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223]
#: Bins of the logarithm of p: so many for each power of ten, down to 10 to the minus LEAST_POWER.
BINS_A_POWER, LEAST_POWER = 50, 40


@dataclass(frozen=True)
class Battery:
    least_chars: int = 20
    #: Least group 2 of an assignment.
    least_value: int = 8
    reject: float = 0.001
    rate: float = 0.01


def matches(kind: int, pattern: str):
    """Array of (kind, i, gap, found) of a text's matches: their number, the code points since the one before, and their text."""
    text = F.col("text")
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    listed = F.transform(F.filter(parts, lambda x: x["found"].isNotNull()), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["found"].alias("found")))
    return F.when(text.rlike(pattern), listed).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,found:string>>"))


def tail(z):
    """Probability that a normal value exceeds z: half the complementary error function of z / sqrt(2), to a relative 1.2e-7."""
    far = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + far / 2)
    half = t * F.exp(-far * far + functools.reduce(lambda total, c: total * t + c, map(F.lit, ERFC))) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def sign_shares(docs: DataFrame) -> DataFrame:
    """A row (encoding, size, p2, p3) an alphabet: sums of squares and cubes of its signs' shares in all texts; even shares where none occurs."""
    text = F.coalesce("text", F.lit(""))
    each = docs.select(F.posexplode(F.array(*[F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in SIGNS])).alias("place", "n"))
    counts = each.groupBy("place").agg(F.sum("n").cast("double").alias("n"))
    alphabets = F.array(*[F.struct(F.lit(name).alias("encoding"), F.lit(signs).alias("signs"), F.lit(len(signs)).alias("size")) for name, signs in ALPHABETS.items()])
    sign = F.substring(F.lit(SIGNS), F.col("place") + 1, F.lit(1))
    held = counts.select("n", sign.alias("sign"), F.inline(alphabets)).filter(F.contains("signs", "sign"))
    total = F.sum("n")
    power = lambda k: F.when(total > 0, F.sum(F.pow("n", F.lit(float(k)))) / F.pow(total, F.lit(float(k)))).otherwise(F.pow("size", F.lit(1.0 - k)))
    found = held.groupBy("encoding", "size").agg(power(2).alias("p2"), power(3).alias("p3"))
    # An empty table has no counts.
    even = docs.sparkSession.createDataFrame([(name, len(signs), 1 / len(signs), 1 / len(signs) ** 2) for name, signs in ALPHABETS.items()], "encoding string, size int, e2 double, e3 double")
    return even.join(found.drop("size"), "encoding", "left").select("encoding", "size", F.coalesce("p2", "e2").alias("p2"), F.coalesce("p3", "e3").alias("p3"))


def spans(docs: DataFrame, battery: Battery) -> DataFrame:
    """docs' rows, once for each pattern's span and candidate: kind, start, end, and found, a candidate's text; a text without any has a row of nulls.

    docs must have _row, a name of the row. All windows lie within a text.
    """
    patterns = [ASSIGN, ACCESS, HEX, TOKEN % battery.least_chars]
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(*others, F.inline_outer(F.concat(*[matches(k, p) for k, p in enumerate(patterns)]))).repartition("_row")
    along = Window.partitionBy("_row", "kind").orderBy("i")
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("found")).over(along).cast("long")).withColumn("start", F.col("end") - F.length("found"))
    base = (F.col("kind") > 0) | (F.length(F.regexp_extract("found", ASSIGN, 2)) >= battery.least_value)
    placed = placed.filter(F.col("kind").isNull() | base | (F.col("kind") == 0) & (F.col("i") == 0))  # a first failing one may be all that a text has
    placed = placed.withColumn("kind", F.when(base, F.col("kind")))
    # A candidate shares a sign with a pattern's span if one that starts before its end ends after its start.
    other = F.col("kind") == 3
    before = Window.partitionBy("_row").orderBy(F.when(other, F.col("end")).otherwise(F.col("start")), F.when(other, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(before)
    placed = placed.withColumn("kind", F.when(other & (F.coalesce(reached, F.lit(-1)) > F.col("start")), None).otherwise(F.col("kind")))
    return placed.select(*others, "kind", "start", "end", F.when(F.col("kind") == 3, F.col("found")).alias("found"))


def symbols(candidates: DataFrame) -> DataFrame:
    """(name, encoding, size, n, i, x) of each sign of the different candidates (found) that have an encoding; name is a digest of a candidate."""
    s = F.regexp_replace("found", "=+$", "")
    known = candidates.select("found").distinct().select(F.sha2("found", 256).alias("name"), s.alias("s")).filter(F.col("s").rlike("[0-9]") & F.col("s").rlike("[A-Za-z]"))
    alphabet = F.coalesce(*[F.when(F.translate("s", signs, "") == "", F.struct(F.lit(name).alias("encoding"), F.lit(signs).alias("signs"))) for name, signs in ALPHABETS.items()])
    known = known.withColumn("a", alphabet).filter("a IS NOT NULL").select("name", "s", "a.*")
    each = known.select("name", "encoding", "signs", F.length("signs").alias("size"), F.length("s").alias("n"), F.posexplode(F.split("s", "")).alias("i", "sign"))
    return each.select("name", "encoding", "size", "n", "i", (F.instr(F.col("signs"), F.col("sign")) - 1).cast("long").alias("x"))


def tested(candidates: DataFrame, shares: DataFrame, battery: Battery) -> DataFrame:
    """Different candidates with an encoding: (name, encoding, band, bin), bin growing with the logarithm of p."""
    along = Window.partitionBy("name").orderBy("i")
    group = ["name", "encoding", "size", "n"]
    last = F.lag("x").over(along)
    high, was_high = 2 * F.col("x") >= F.col("size"), 2 * last >= F.col("size")
    each = symbols(candidates).withColumns({"beside": F.col("x") * last, "turn": (high != was_high).cast("int"), "edge": F.when((F.col("i") == 0) | (F.col("i") == F.col("n") - 1), F.col("x")), "high": high.cast("int")})
    by_sign = each.groupBy(*group, "x").agg(F.count("*").alias("c"), *[F.sum(x).alias(x) for x in ("beside", "turn", "edge", "high")])
    x, c = F.col("x"), F.col("c")
    sums = by_sign.groupBy(*group).agg(F.sum(c * (c - 1) / 2).alias("pairs"), F.sum(c * x).alias("s1"), F.sum(c * x * x).alias("s2"), *[F.sum(y).alias(y) for y in ("beside", "turn", "edge", "high")])
    sums = sums.join(F.broadcast(shares.drop("size")), "encoding").withColumn("n", F.col("n").cast("double"))  # shares: a row an alphabet
    n, mean, high = F.col("n"), F.col("s1") / F.col("n"), F.col("high")
    two, three = n * (n - 1) / 2, n * (n - 1) * (n - 2) / 6
    spread = lambda p2, p3: F.sqrt(two * (p2 - p2 * p2) + 6 * three * F.greatest(F.lit(0.0), p3 - p2 * p2))
    even = 1.0 / F.col("size")
    sums = sums.withColumns({"around": F.col("s2") - F.col("s1") * mean, "runs_mean": 1 + 2 * high * (n - high) / n})
    sums = sums.withColumn("runs_var", (F.col("runs_mean") - 1) * (F.col("runs_mean") - 2) / (n - 1))
    beside = F.col("beside") - mean * (2 * F.col("s1") - F.col("edge")) + (n - 1) * mean * mean
    sums = sums.select(
        *["name", "encoding", "n"],
        ((F.col("pairs") - two * even) / spread(even, even * even)).alias("z_chi"),
        F.when(F.col("runs_var") > 0, F.abs(F.col("turn") + 1 - F.col("runs_mean")) / F.sqrt("runs_var")).otherwise(99.0).alias("z_runs"),
        F.when(F.col("around") > 0, F.abs(beside / F.col("around") + 1 / n) * F.sqrt(n)).otherwise(99.0).alias("z_serial"),
        ((F.col("pairs") - two * F.col("p2")) / spread(F.col("p2"), F.col("p3"))).alias("z_text"),
    )
    probed = sums.withColumn("even", F.least(tail(F.col("z_chi")), 2 * tail(F.col("z_runs")), 2 * tail(F.col("z_serial"))))
    probed = probed.withColumn("p", F.when(3 * F.col("even") >= battery.reject, tail(-F.col("z_text"))).otherwise(1.0))
    power = F.greatest(F.lit(-float(LEAST_POWER)), F.log10(F.greatest("p", F.lit(1e-300))))
    return probed.select("name", "encoding", F.floor(2 * F.log2("n")).cast("int").alias("band"), F.ceil(power * BINS_A_POWER).cast("int").alias("bin"))


def limits(candidates: DataFrame, rate: float) -> DataFrame:
    """(encoding, band, most): the last bin of each group whose candidates keep the false discovery rate, if any."""
    counts = candidates.groupBy("encoding", "band", "bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy("encoding", "band")  # at most LEAST_POWER * BINS_A_POWER + 1 bins
    upto = F.sum("n").over(group.orderBy("bin"))
    kept = counts.withColumns({"upto": upto, "all": F.sum("n").over(group)}).filter(F.pow(F.lit(10.0), F.col("bin") / BINS_A_POWER) * F.col("all") <= rate * F.col("upto"))
    return kept.groupBy("encoding", "band").agg(F.max("bin").alias("most"))


def find(docs: DataFrame, carry: list[str] | None = None, battery: Battery = Battery()) -> DataFrame:
    """A row for each of docs with the columns carry (all but text if None) and secrets, an array of (start, kind, end) by start, then kind.

    Kinds are numbers in the order of KINDS.
    """
    carry = [c for c in docs.columns if c not in ("text", "secrets")] if carry is None else carry
    named = docs.select(F.struct(*carry).alias("_kept"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row"))
    found = stored(spans(named, battery))
    judged = stored(tested(found.filter("kind = 3"), sign_shares(docs), battery))
    most = stored(limits(judged, battery.rate))
    secret = judged.join(F.broadcast(most), ["encoding", "band"]).filter("bin <= most").select("name")  # a row for each encoding and band at most
    # Apart, for a row without a candidate has no key to be joined by.
    candidates = found.filter("kind = 3").withColumn("name", F.sha2("found", 256)).join(secret.withColumn("secret", F.lit(True)), "name", "left")
    kept = ["_row", "_kept", "kind", "start", "end"]
    both = found.filter("kind IS NULL OR kind < 3").select(*kept, F.lit(None).cast("boolean").alias("secret")).unionByName(candidates.select(*kept, "secret"))
    span = F.when((F.col("kind") < 3) | F.col("secret"), F.struct("start", "kind", "end"))
    # A text's spans lie in one row, as the text itself does.
    return both.groupBy("_row").agg(F.first("_kept").alias("_kept"), F.sort_array(F.collect_list(span)).alias("secrets")).select("_kept.*", "secrets")


def digest(found: DataFrame) -> DataFrame:
    """Counts of each pattern's spans, the SHA-256 of all of these, and all spans, written kind:start:end."""
    name = F.array(*[F.lit(k) for k in KINDS])
    written = lambda x: F.concat_ws(",", F.transform(x, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    others = [c for c in found.columns if c != "secrets"]
    return found.select(*others, *[count(k) for k in range(3)], F.sha2(written(F.filter("secrets", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), written("secrets").alias("spans"))


def _cased(pattern: str) -> str:
    """The pattern of assignments with both cases of each letter of its names spelled out, and quotes doubled, for SQL."""
    names, rest = pattern.removeprefix("(?i)").split(")", 1)
    return ("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in names) + ")" + rest).replace("'", "''")


_TAIL = "CASE WHEN {z} >= 0 THEN {f} ELSE 1 - {f} END"


def _tail_sql(z: str) -> str:
    far = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + {far} / 2))"
    half = f"({t} * exp(-{far} * {far} + ({functools.reduce(lambda total, c: f'({total}) * {t} + {c}::DOUBLE', [f'{c!r}::DOUBLE' if i == 0 else repr(c) for i, c in enumerate(ERFC)])})) / 2)"
    return _TAIL.format(z=z, f=half)


_PATTERNS = ", ".join(f"({k}, '{p}')" for k, p in enumerate([_cased(ASSIGN), ACCESS, HEX, TOKEN % Battery.least_chars]))
_ALPHABETS = ", ".join(f"({i}, '{name}', '{signs}', {len(signs)})" for i, (name, signs) in enumerate(ALPHABETS.items()))
_SPREAD = "sqrt(n * (n - 1) / 2 * ({p2} - {p2} * {p2}) + n * (n - 1) * (n - 2) * greatest(0, {p3} - {p2} * {p2}))"
_WRITTEN = "coalesce(string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, kind){only}, '')"

ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
pt AS (SELECT * FROM (VALUES {_PATTERNS}) v(kind, pat)),
al AS (SELECT * FROM (VALUES {_ALPHABETS}) v(ord, encoding, signs, size)),
fo AS (SELECT rid, kind, regexp_extract_all(text, pat, 0) AS f, string_split_regex(text, pat) AS g FROM d, pt WHERE regexp_matches(text, pat)),
mt AS (SELECT rid, kind, i, f[i] AS f, length(g[i]) AS gap FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM fo)),
ps AS (SELECT rid, kind, f, CAST(sum(gap + length(f)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS e FROM mt),
bs AS (SELECT rid, kind, f, e - length(f) AS s, e FROM ps WHERE kind IN (1, 2) OR kind = 0 AND length(regexp_extract(f, '{_cased(ASSIGN)}', 2)) >= {Battery.least_value}),
cd AS (SELECT rid, f, e - length(f) AS s, e FROM ps WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM bs WHERE bs.rid = ps.rid AND bs.s < ps.e AND ps.e - length(ps.f) < bs.e)),
sg AS (SELECT unnest(string_split('{SIGNS}', '')) AS c),
sc AS (SELECT c, sum(length(text) - length(replace(text, c, ''))) AS m FROM d, sg GROUP BY c),
sh AS (SELECT encoding, CASE WHEN sum(m) > 0 THEN sum(CAST(m AS DOUBLE) ** 2) / sum(m) ** 2 ELSE 1.0 / size END AS p2, CASE WHEN sum(m) > 0 THEN sum(CAST(m AS DOUBLE) ** 3) / CAST(sum(m) AS DOUBLE) ** 3 ELSE 1.0 / size ** 2 END AS p3 FROM al JOIN sc ON contains(signs, c) GROUP BY encoding, size),
un AS (SELECT DISTINCT f, regexp_replace(f, '=+$', '') AS t FROM cd WHERE regexp_matches(f, '[0-9]') AND regexp_matches(f, '[A-Za-z]')),
en AS (SELECT f, t, arg_min(encoding, ord) AS encoding, arg_min(signs, ord) AS signs, arg_min(size, ord) AS size FROM un JOIN al ON translate(t, signs, '') = '' GROUP BY f, t),
ch AS (SELECT f, encoding, size, length(t) AS n, i, CAST(instr(signs, substr(t, i, 1)) - 1 AS BIGINT) AS x FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM en)),
lg AS (SELECT *, lag(x) OVER (PARTITION BY f ORDER BY i) AS px FROM ch),
sm AS (SELECT f, encoding, size, CAST(n AS DOUBLE) AS n, sum(x) AS s1, sum(x * x) AS s2, sum(x * px) AS bd, sum(CASE WHEN (2 * x >= size) <> (2 * px >= size) THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN i IN (1, n) THEN x ELSE 0 END) AS eg, sum(CASE WHEN 2 * x >= size THEN 1 ELSE 0 END) AS hi FROM lg GROUP BY ALL),
pr AS (SELECT f, sum(c * (c - 1) / 2) AS pairs FROM (SELECT f, x, count(*) AS c FROM ch GROUP BY f, x) GROUP BY f),
rn AS (SELECT *, s1 / n AS mean, s2 - s1 * (s1 / n) AS ar, 1 + 2 * hi * (n - hi) / n AS rm FROM sm JOIN pr USING (f) JOIN sh USING (encoding)),
rv AS (SELECT *, (rm - 1) * (rm - 2) / (n - 1) AS vr FROM rn),
zs AS (SELECT f, encoding, n, (pairs - n * (n - 1) / 2 / size) / {_SPREAD.format(p2="(1.0 / size)", p3="(1.0 / size / size)")} AS zc, CASE WHEN vr > 0 THEN abs(tn + 1 - rm) / sqrt(vr) ELSE 99 END AS zr,
         CASE WHEN ar > 0 THEN abs((bd - mean * (2 * s1 - eg) + (n - 1) * mean * mean) / ar + 1 / n) * sqrt(n) ELSE 99 END AS zl, (pairs - n * (n - 1) / 2 * p2) / {_SPREAD.format(p2="p2", p3="p3")} AS zt FROM rv),
pv AS (SELECT f, encoding, CAST(floor(2 * log2(n)) AS INTEGER) AS band, CASE WHEN 3 * least({_tail_sql("zc")}, 2 * ({_tail_sql("zr")}), 2 * ({_tail_sql("zl")})) >= {Battery.reject} THEN {_tail_sql("(-zt)")} ELSE 1 END AS p FROM zs),
bn AS (SELECT f, encoding, band, CAST(ceil(greatest(-{LEAST_POWER}, log10(greatest(p, 1e-300))) * {BINS_A_POWER}) AS INTEGER) AS bin FROM pv),
lm AS (SELECT encoding, band, max(bin) AS most FROM (SELECT encoding, band, bin, count(*) OVER (PARTITION BY encoding, band ORDER BY bin) AS upto, count(*) OVER (PARTITION BY encoding, band) AS m FROM bn) WHERE 10 ** (bin / {BINS_A_POWER}) * m <= {Battery.rate} * upto GROUP BY encoding, band),
sp AS (SELECT rid, kind, s, e FROM bs UNION ALL SELECT rid, 3, s, e FROM cd WHERE f IN (SELECT f FROM bn JOIN lm USING (encoding, band) WHERE bin <= most)),
nm AS (SELECT *, (['{"', '".join(KINDS)}'])[kind + 1] AS k FROM sp)
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256({_WRITTEN.format(only=" FILTER (kind < 3)")}) AS base_sha256, {_WRITTEN.format(only=" FILTER (kind IS NOT NULL)")} AS spans
FROM d LEFT JOIN nm ON nm.rid = d.rid GROUP BY d.rid
"""
