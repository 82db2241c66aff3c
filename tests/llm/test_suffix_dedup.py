import random
from collections import Counter

import pytest

from pitpanel.llm import suffix_dedup


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r[0], r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()), key=str)


CASES = [
    (1, None),
    (2, ""),
    (3, "a" * 900),
    (4, "ab" * 300 + "x"),
    (5, "short"),
    (None, "q" * 30 + "unique middle part of this text" + "é" * 100),
    (7, "the same row twice, long enough to count as a repeat"),
    (7, "the same row twice, long enough to count as a repeat"),
    (8, "the same row twice, long enough to count as a repeat, and more"),
    (9, "é" * 100),
]


@pytest.mark.parametrize("length", [2, 7, 20, 33])
def test_cases(spark, length):
    docs = spark.createDataFrame([(*x, 1, "q") for x in CASES], "doc_id long, text string, key int, name string").repartition(3)
    assert got(suffix_dedup.remove_repeats(docs, length)) == brute(CASES, length)


@pytest.mark.parametrize(("seed", "length"), [(1, 16), (2, 31)])
def test_random_with_planted_repeats(spark, seed, length):
    r = random.Random(seed)
    rows = []
    for i in range(60):
        text = "".join(r.choices("abcd é\n", k=r.randint(0, 200)))
        for _ in range(r.randint(0, 3)):
            if rows:
                src = r.choice(rows)[1]
                a = r.randrange(len(src) + 1)
                at = r.randint(0, len(text))
                text = text[:at] + src[a : a + r.randint(length - 5, 120)] + text[at:]
        rows.append((i, text))
    for i in range(20):  # near copies of one text
        t = list(rows[5][1] + rows[6][1])
        t[r.randrange(len(t))] = "#"
        rows.append((100 + i, "".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(suffix_dedup.remove_repeats(docs, length)) == brute(rows, length)


def test_empty(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op10_on_the_small_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert got(suffix_dedup.remove_repeats(spark.read.parquet(f"{d}/documents.parquet"))) == brute(rows, 400)
    assert suffix_dedup.op10(spark, d).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
