import math
import random
import re
from collections import Counter

from pitpanel.llm import lexical_search as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))


def brute(docs, items, k=50):
    held = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    n, total = sum(1 for *_, s in held if s), sum(s for *_, s in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for i, t in {*items}:
        found = []
        for d, c, s in held:
            m = 50 + (50 * s * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in {*words(t)} if c[w])
            if score > 0:
                found.append((-score, d is not None, d or 0))
        out += [(i, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def got(spark, docs, items, parts=3, **kw):
    d = spark.createDataFrame([(*r, 0, "x") for r in docs], "doc_id long, text string, item long, terms string").repartition(parts)
    b = spark.createDataFrame([(*r, 7) for r in items], "item_id long, text string, doc_id long")
    return sorted((tuple(r) for r in L.search(d, b, **kw).collect()), key=str)


def text(rnd, n, top):
    return " ".join(f"w{int(rnd.paretovariate(0.6)) % top}" for _ in range(n))


def test_equals_brute_force_over_many_blocks(spark):
    rnd = random.Random(1)
    docs = [(i, text(rnd, rnd.choice([1, 5, 30, 200]), 900)) for i in range(700)]
    docs += [(2000 + i, docs[3][1]) for i in range(90)] + [(5, docs[8][1])] * 3  # crowds of copies, shared ids
    docs += [(None, docs[4][1]), (3000, None), (3001, ""), (3002, "...!"), (3003, "w1 " * 60_000 + "Rare"), (3004, "ÜNÏ cödé RARE")]
    items = [(i, text(rnd, rnd.choice([1, 8, 60]), 900)) for i in range(30)] + [(30, docs[3][1]), (31, "w1"), (31, "w1 w2"), (31, "w1"), (None, "rare word"), (33, None), (34, "nowhere"), (35, "ÜnÏ cödÉ")]
    want = brute(docs, items)
    for block, bands in ((16, L.BANDS), (64, (0.002, 0.05)), (2048, (0.01, 0.1, 0.3))):
        assert got(spark, docs, items, block=block, bands=bands) == want
    assert got(spark, docs, items, k=3, block=32) == brute(docs, items, 3)


def test_pruning_keeps_ties(spark):
    docs = [(i, "alpha beta gamma") for i in range(400)] + [(1000 + i, "alpha beta") for i in range(30)] + [(5000 + i, f"other{i}") for i in range(3000)]
    items = [(1, "alpha beta gamma"), (2, "gamma"), (3, "alpha"), (4, "other5 alpha")]
    assert got(spark, docs, items, block=8) == brute(docs, items)


def test_many_items_go_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEMS", 4)
    rnd = random.Random(2)
    docs, items = [(i, text(rnd, 20, 200)) for i in range(200)], [(i, text(rnd, 6, 200)) for i in range(25)]
    assert got(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b")]) == [] == got(spark, [(1, "a b")], []) == got(spark, [(1, None)], [(1, "a")]) == got(spark, [(1, "b")], [(1, "a")])


def test_sql_agrees(spark, tmp_path):
    import duckdb

    rnd = random.Random(3)
    docs, items = [(i, text(rnd, 40, 300).upper() + " Éa") for i in range(300)] + [(900, None)], [(i, text(rnd, 10, 300)) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(con.execute(L.OP12_SQL).fetchall(), key=str) == sorted((tuple(r) for r in L.op12(spark, str(tmp_path)).collect()), key=str) == brute(docs, items)
