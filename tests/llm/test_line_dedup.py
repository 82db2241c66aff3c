import random

import pytest

from pitpanel.llm import line_dedup


def close(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    a, b = sorted((a, b), key=len)
    return a[i:] == b[i + 1 :]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def near(a, b, edits):
    return close(a, b) if edits == 1 else abs(len(a) - len(b)) <= edits and distance(a, b) <= edits


def brute(rows, edits=1, least=0):
    lines = []
    for d, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if x.strip():
                lines.append((d, k, x))
    lines.sort()
    gone, seen = set(), []
    for d, k, x in lines:
        if any(x == y or (edits and min(len(x), len(y)) >= least and near(x, y, edits)) for y in seen):
            gone.add((d, k))
        seen.append(x)
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        n = sum(1 for x in parts if x.strip())
        m = sum((d, k) in gone for k in range(len(parts)))
        out.append((d, None if t is None else "\n".join(x for k, x in enumerate(parts) if (d, k) not in gone), n, m))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(*x, 1, "q") for x in rows], "doc_id long, text string, n_lines int, d string").repartition(3)
    out = line_dedup.dedup(docs, **kw)
    assert out.columns == ["doc_id", "text", "d", "n_lines", "n_removed"]
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)


ROWS = [
    (5, "a line that is long enough here\nshort\n\nshort"),
    (6, "a line that is long enough her\nshord\n \n"),
    (7, "A line that is long enough here\nb line that is long enough here\nother"),
    (8, None),
    (9, ""),
    (10, "\n\n"),
    (2, "line number 1 of a list with a counter\nline number 2 of a list with a counter\nline number 31 of a list with a counter"),
    (11, "x" * 5000 + "\n" + "x" * 4999),
    (12, "ünïcödé lïné öf thé tést 🙂 end\nünïcödé lïné öf thé tést end"),
    (14, "1.\n2.\na\nb\nab\nabcd\nMenu\nmenu\nMenus >"),
    (13, "aaaaaaaaaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaaaaaaaaaaab"),
]


@pytest.mark.parametrize("kw", [{}, {"max_edits": 0}, {"least_chars": 3}, {"least_chars": 20}])
def test_cases(spark, kw):
    assert run(spark, ROWS, **kw) == brute(ROWS, kw.get("max_edits", 1), kw.get("least_chars", 0))


def test_random(spark):
    r = random.Random(4)
    pool = ["".join(r.choices("ab ", k=r.randint(1, 30))) for _ in range(40)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(r.randint(0, 6)):
            x = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 2])):
                at = r.randrange(len(x) + 1)
                x[at : at + r.randint(0, 1)] = r.choice(["", "a", "c"])
            lines.append("".join(x))
        rows.append((i, "\n".join(lines)))
    assert run(spark, rows, least_chars=8) == brute(rows, 1, 8)
    assert run(spark, rows) == brute(rows)


TWO = [
    (1, "the quick brown fox\nab\na\nxyz"),
    (2, "the quick brown ox.\nthe quick brown f\nthe quick brown foxes\nTHe quick brown fox"),
    (3, "teh quick brown fox\nthe quikc brown fox\nthe quick browwn fxo\ncd\nabcd\nb"),
    (4, "he quick brown foxx\nthe quick fox\nünïcödé 🙂 lïné\nünicödé lïné\naaaaaa\naaaa\naabbaa\nabaaba"),
    (5, None),
    (6, ""),
]


def test_two_edits(spark):
    assert run(spark, TWO, max_edits=2) == brute(TWO, 2)
    assert run(spark, TWO, max_edits=2, least_chars=5) == brute(TWO, 2, 5)
    r = random.Random(7)
    pool = ["".join(r.choices("abc", k=r.randint(1, 18))) for _ in range(12)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(r.randint(0, 4)):
            x = list(r.choice(pool))
            for _ in range(r.choice([0, 1, 2, 3])):
                at = r.randrange(len(x) + 1)
                x[at : at + r.randint(0, 1)] = r.choice(["", "a", "d"])
            lines.append("".join(x))
        rows.append((i, "\n".join(lines)))
    assert run(spark, rows, max_edits=2) == brute(rows, 2)


def test_a_line_and_its_neighbours_share_a_piece():
    r = random.Random(1)
    for edits in (1, 2):
        for _ in range(400):
            a = r.choices("ab", k=r.randint(1, 9))
            b = list(a)
            for _ in range(edits):
                at = r.randrange(len(b) + 1)
                b[at : at + r.randint(0, 1)] = r.choice(["", "a", "c"])
            b = "".join(b) or "c"
            _, names = line_dedup._line_names(["".join(a), b], 0, edits)
            x, y = ({int(h[i]) for h in names[2:]} - {-1} for i in (0, 1))
            if near("".join(a), b, edits):
                assert x & y


def test_stage_and_empty(spark):
    docs = spark.createDataFrame([(1, "one line of text, long enough", 29, "x"), (2, "one line of text, long enough", 29, "x"), (3, None, 0, "y"), (4, "one line of text, long enough\nnew", 33, "y")], "doc_id long, text string, n_chars long, n_lines string")
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "one line of text, long enough", 29, "x"), (3, None, None, "y"), (4, "new", 3, "y")]
    assert line_dedup.dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup(docs, max_edits=3)


def test_rows_that_repeat_an_id(spark):
    rows = [(1, "the same row again and again"), (1, "the same row again and again")]
    out = run(spark, rows)
    assert out == [(1, rows[0][1], 1, 0)] * 2
