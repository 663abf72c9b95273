"""Line dedup against all pairs of lines."""

import random

from pyspark.sql import functions as F

from thicket.llm import linedup


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, edits, least):
    first = {}
    for i, x in rows:
        for k, line in enumerate((x or "").split("\n") if x is not None else []):
            if len(line.strip(" \t\n\x0b\x0c\r")) >= least:
                at = (10**19 if i is None else i, k)
                first[line] = min(first.get(line, at), at)
    near = {a for a in first if any(first[b] < first[a] and abs(len(a) - len(b)) <= edits and edit(a, b) <= edits for b in first if a != b)}
    out = []
    for i, x in rows:
        if x is None:
            out.append((i, None, 0, 0))
            continue
        keep = [line for k, line in enumerate(x.split("\n")) if line not in first or line not in near and first[line] == (10**19 if i is None else i, k)]
        n = len(x.split("\n"))
        out.append((i, "\n".join(keep), n, n - len(keep)))
    return out


def test_against_all_pairs(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(6, 40))) for _ in range(25)]

    def changed(line):
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(line) + 1)
            line = rng.choice([line[:k] + line[k + 1 :], line[:k] + rng.choice("xyz") + line[k:], line[:k] + rng.choice("xyz") + line[k + 1 :]])
        return line

    rows = [(i, "\n".join(changed(rng.choice(pool)) for _ in range(rng.randrange(1, 7)))) for i in range(60)]
    rows += [(200, ""), (201, None), (202, "\n\n"), (203, "  short  "), (None, pool[0] + "\nnobody else has this"), (-5, pool[1]), (204, pool[1]), (205, rows[3][1]), (205, rows[3][1]), (206, "a long line of its own\r\nfirst here it is again\nfirst here it is again")]
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, n_lines int, first string").repartition(4)
    got = linedup.drop_repeated_lines(docs, edits=2, least_chars=6)
    assert got.columns == ["doc_id", "text", "first", "n_lines", "n_removed"]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=key) == sorted(brute(rows, 2, 6), key=key)


def test_no_rows(spark):
    assert linedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_short_lines_go_by_equality(spark):
    rows = [(1, "Menu\nab\n\n"), (2, "Menu\nac\n\n \nnew"), (3, " Menu\nMenu\nab"), (None, "ac\nend\nend"), (4, "a line that is long enough to count\nMenu"), (5, "a line that is long enough to count!")]
    got = {r.doc_id: (r.text, r.n_removed) for r in linedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("Menu\nab\n\n", 0), 2: ("ac\n\n \nnew", 1), 3: (" Menu", 2), None: ("end", 2), 4: ("a line that is long enough to count", 1), 5: ("", 1)}


def test_automaton_tells_distances(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("ab𝄞") for _ in range(rng.randrange(1, 14)))
        b = list(a)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "a", "c", "𝄞"])
        rows.append((a, "".join(b) or "a"))
    letters = [f"transform(split({c}, ''), x -> ascii(x)) AS {c}" for c in "ab"]
    df = spark.createDataFrame(rows, "a string, b string").selectExpr("a AS x", "b AS y", *letters)
    for edits in range(5):
        got = df.selectExpr("x", "y", f"{linedup.within('a', 'b', edits)} AS near").collect()
        assert [r.near for r in got] == [edit(r.x, r.y) <= edits for r in got]


def test_long_text_takes_time_in_proportion(spark):
    """Twenty thousand lines in one text, half of them repeated; a filter on the result changes nothing."""
    rng = random.Random(2)
    lines = [f"line {i} {'x' * rng.randrange(30)}" if i % 2 else f"again {i % 50}" for i in range(20_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    want = list(dict.fromkeys(lines))
    near = linedup.drop_repeated_lines(docs, edits=0)
    assert near.filter(F.length("text") > 0).collect()[0].text == "\n".join(want)


def test_parities_never_part_near_lines(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        a = [rng.choice("abcdefgé𝄞 ") for _ in range(rng.randrange(1, 40))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "x", "c", "𝄞"])
        rows.append(("".join(a), "".join(b) or "a"))
    odd = [linedup.parities(f"transform(split({c}, ''), x -> ascii(x))") for c in "ab"]
    apart = lambda rows: spark.createDataFrame(rows, "a string, b string").selectExpr("a", "b", f"bit_count({odd[0]} ^ {odd[1]}) AS apart").collect()
    assert all(r.apart <= 2 * edit(r.a, r.b) for r in apart(rows))
    others = [(a, b) for (a, _), (_, b) in zip(rows, rows[1:])]
    assert sum(r.apart > 4 for r in apart(others)) > 50  # most lines further apart are told without the automaton
