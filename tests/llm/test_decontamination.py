import hashlib
import random
import re

import pyarrow as pa
import pytest

from pitpanel.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        if w:
            k = min(n, len(w))
            for a in range(len(w) - k + 1):
                windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if ids := windows.get(tuple(w[a : a + k])):
                    hit.update(range(a, a + k))
                    found |= {str(x) for x in ids if x is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, 0, "x") for r in docs], "doc_id long, text string, start int, words string").repartition(3)
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, key string")
    return got(D.contamination(d, b))


def test_cases(spark):
    item = "One two three, four five six seven eight nine ten eleven twelve. Thirteen!"
    items = [(1, item), (2, "short item"), (3, None), (4, "..."), (10, item), (None, "null item id here"), (5, "aa " * 14), (6, "ünï cödé 7x")]
    docs = [
        (1, item.upper() + " tail " + item),
        (2, "x one two three four five six seven eight nine ten y"),
        (3, "one two three four five six seven eight nine TEM"),
        (4, None),
        (5, ""),
        (6, "a Short\nITEM; null item-id here, short item"),
        (7, "aa " * 40),
        (8, "aa " * 9),
        (9, "ÜNÏ cödé 7x ünï cödé 7x"),
        (None, "short item"),
        (2, "x one two three four five six seven eight nine ten y"),
        (11, "word " * 3000 + item),
    ]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, [(1, item)]) == brute(docs, [(1, item)])


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_random(spark):
    r = random.Random(5)
    v = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(r.choices(v, k=r.choice([1, 3, 9, 10, 11, 30])))) for i in range(40)]
    docs = []
    for i in range(60):
        w = r.choices(v + [f"z{k}" for k in range(30)], k=r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            src = r.choice(items)[1].split()
            a = r.randrange(len(src))
            at = r.randint(0, len(w))
            w[at:at] = src[a : a + r.randint(1, 30)]
        docs.append((i, " ".join(w)))
    assert run(spark, docs, items) == brute(docs, items)


def test_near(spark):
    d = spark.createDataFrame([(1, "rare1 x x rare2 x rare3"), (2, "rare1 " + "x " * 40 + "rare2 rare3"), (3, "rare3 rare2 rare1"), (4, "rare1 rare1 rare2")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "rare1 common rare2 common rare3")], "item_id long, text string")
    out = D.Index(d, b, least=1).near(3, 10)
    assert sorted(r.doc_id for r in out.collect()) == []  # "common" never occurs: it is the rarest word
    b = spark.createDataFrame([(7, "rare1 rare2 rare3")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.Index(d, b, least=1).near(3, 10).collect()) == [(1, "7"), (3, "7")]


def near_by_brute_force(docs, items, terms, within):
    import hashlib
    from collections import Counter

    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    hashed = lambda w: next(D.word_names(pa.array([w])))[2].view("int64")[0]
    freq = Counter(w for _, t in docs for w in split(t))
    out = []
    for i, t in docs:
        words, near = split(t), set()
        for item, text in items:
            own = set(split(text))
            rare = sorted((w for w in own if freq[w]), key=lambda w: (freq[w], hashed(w.decode())))[:terms]
            if own and len(rare) == min(terms, len(own)) and any(set(rare) <= set(words[k : k + within]) for k in range(len(words))):
                near.add(str(item))
        out.append((i, len(near), hashlib.sha256(",".join(sorted(near)).encode()).hexdigest()))
    return sorted(out)


def test_proximity_sees_reordered_passages_that_windows_miss(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa nowhere"
    docs = [
        (1, "alpha x beta x gamma delta x epsilon x zeta eta x theta iota kappa"),
        (2, "kappa iota theta eta zeta epsilon delta gamma beta alpha"),
        (3, " x".join(item.split()[:10]).replace(" ", " x " * 30)),
        (4, "nothing of it"),
        (5, None),
        (6, ""),
    ]
    items = [(7, item), (8, "theta iota"), (9, "nowhere else"), (10, ""), (11, "kappa KAPPA")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert all(r.n_hit <= 2 for r in D.contamination(d, b).collect())  # no more than the short item 8
    out = sorted(tuple(r) for r in D.proximity(d, b).collect())
    assert out == near_by_brute_force(docs, items, 3, 20)
    assert [r[1] for r in out][:2] == [3, 3]
    with pytest.raises(ValueError):
        D.Index(d, spark.createDataFrame([(7, item)], "item_id long, text string")).near()


def test_op5_proximity_on_the_small_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = near_by_brute_force(docs, items, 3, 20)
    assert any(x[1] for x in want)
    assert sorted(tuple(r) for r in D.op5_near(spark, d).collect()) == want


def test_op5_on_the_small_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert any(x[5] for x in want)
    assert got(D.op5(spark, d)) == want
