import random

import pytest

from pitpanel.llm import ngram_jaccard, shared


def brute(rows, words=5, percent=75):
    sets = []
    for _, t in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        for c in ngram_jaccard.SPACES[1:]:
            lower = lower.replace(c, " ")
        w = [x for x in lower.split(" ") if x]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    done = set()
    for group in by.values():
        for i in group:
            for j in group:
                if i < j and (i, j) not in done:
                    done.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * len(sets[i] | sets[j]):
                        root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d if d is not None else -1, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_cases(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [
        (5, " ".join(base)),
        (3, " ".join(base).upper()),
        (9, " ".join(base[:30] + ["new"] + base[31:])),
        (7, None),
        (8, ""),
        (2, "\t\n "),
        (11, "a b c"),
        (10, "A  b\tc"),
        (12, "a b c d"),
        (None, "a b c"),
        (13, "naïve   x"),
        (14, "naïve   x"),
        (14, "naïve   x"),
        (15, "lone document of words that nobody else has " * 50),
    ]
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, n long, name string")
    assert got(ngram_jaccard.join(docs)) == brute(rows)
    kept = ngram_jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [2, 3, 7, 8, 10, 12, 13, 15]


def test_empty(spark):
    assert ngram_jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_groups_with_chains_and_hot_lines(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(400)]
    common = [r.choices(vocabulary, k=12) for _ in range(3)]
    rows, i = [], 100
    for g in range(25):
        now = r.choices(vocabulary, k=r.randint(10, 90))
        for _ in range(r.choice([1, 2, 3, 15])):
            text = list(now)
            if r.random() < 0.7:
                text = r.choice(common) + text
            rows.append((i, " ".join(text)))
            i += r.randint(1, 3)
            for _ in range(r.randint(0, 2)):
                now[r.randrange(len(now))] = r.choice(vocabulary)
            if r.random() < 0.2:
                now = now[: len(now) - len(now) // 6]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(ngram_jaccard.join(docs)) == brute(rows)


def test_sets_on_both_sides_of_a_block_of_columns(spark):
    """Sets of more columns than a block holds, and pairs of which only one has: counts of several blocks are added."""
    r = random.Random(9)
    base = [f"u{i}" for i in range(9000)]
    rows = [(1, base[:4200]), (2, base[:3800]), (3, base[:5400]), (4, base), (5, base[:8000]), (6, base[3000:])]
    for i in (7, 8):
        text = list(base[:4300])
        for _ in range(60 * (i - 6)):
            text[r.randrange(len(text))] = f"new{i}-{r.random()}"
        rows.append((i, text))
    rows = [(i, " ".join(t)) for i, t in rows]
    out = got(ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == brute(rows) and len({x[2] for x in out}) == 3


def test_a_crowd_of_near_copies_grows_together(spark):
    """Copies with many edits each: most pairs lie below the threshold, links run over others; the crowd's blocks take part in rounds."""
    r = random.Random(21)
    base = [f"b{i}" for i in range(160)]
    rows = []
    for i in range(150):
        text = list(base)
        for at in r.sample(range(160), r.choice([1, 2, 3, 4, 5])):
            text[at] = f"e{i}-{at}"
        rows.append((i, " ".join(text)))
    assert got(ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_op8_equals_brute_force_on_the_small_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert got(ngram_jaccard.op8(spark, d)) == brute(rows)


def test_components(spark):
    space = shared.Workspace(spark, "t")
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7), (200, 201), (201, 200)]
    out = {r.node: r.label for r in shared.components(spark.createDataFrame(edges, "a long, b long"), space, "c").collect()}
    assert out == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 104), 100), 200: 200, 201: 200}
    assert shared.components(spark.createDataFrame([], "a long, b long"), space, "d").count() == 0


def test_open_pairs_are_those_of_the_bounds(spark):
    rnd = random.Random(8)
    for percent in (50, 75, 90, 100):
        rows = []
        for i in range(300):
            n = rnd.choice([1, 2, 9, 10, 11, 40, 41, 55, rnd.randint(1, 200)])
            rows.append((rnd.randrange(6), i, n, rnd.randrange(n - -(-percent * n // 100) + 1), rnd.randrange(250)))
        want = set()
        for x in rows:
            for y in rows:
                shared = min(x[2] - x[3], y[2] - y[3])
                if x[0] == y[0] and x[4] < y[4] and 100 * min(x[2], y[2]) >= percent * max(x[2], y[2]) and (100 + percent) * shared >= percent * (x[2] + y[2]):
                    want.add((min(x[1], y[1]), max(x[1], y[1])))
        blocks = spark.createDataFrame(rows, "block long, name long, n int, place int, label long")
        assert {tuple(r) for r in ngram_jaccard.open_pairs(blocks, percent).collect()} == want and want


def test_pages_of_one_template_below_the_threshold_make_no_pairs(spark):
    """165 words of a template and 36 own ones: 197 shingles, of which the 40 rarest are a page's own."""
    blocks = spark.range(20_000).selectExpr("1L AS block", "id AS name", "CAST(195 + id % 5 AS INT) AS n", "CAST(40 + id % 3 AS INT) AS place", "id AS label")
    assert ngram_jaccard.open_pairs(blocks, 75).count() == 0
    rnd = random.Random(3)
    template = [f"t{i}" for i in range(165)]
    rows = [(i, " ".join([f"p{i}x{k}" for k in range(18)] + template + [f"p{i}y{k}" for k in range(18)])) for i in range(150)]
    rows += [(500 + i, rows[i][1] + " more") for i in rnd.sample(range(150), 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(ngram_jaccard.join(docs)) == brute(rows)
