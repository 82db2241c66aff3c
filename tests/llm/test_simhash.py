import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from pitpanel.llm import simhash


def edits(rows):
    rows = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 4
        out.append((d, t, t[: len(t) - k] + nxt[:k], nxt))
    return out


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = [x for x in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def h64(x, seed):
    return xxhash.xxh64_intdigest(x, seed)


def brute_fp(text):
    """The same votes in plain Python; Spark's xxhash64 chains values as seeds."""
    votes, terms = [0] * 64, shingles(text)
    for t in terms:
        hs = [h64(w.encode(), 42) for w in t]
        h = 42
        if len(t) == 5:
            for x in hs:
                h = h64(x.to_bytes(8, "little"), h)
        else:
            for x in hs:
                h = h64(x.to_bytes(8, "little"), h)
            h = h64((5).to_bytes(4, "little"), h)
        for i in range(64):
            votes[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * votes[i] > len(terms))


CASES = [
    (3, "some words of a text that is long enough to have many shingles in it " * 3),
    (1, None),
    (2, ""),
    (9, "short one"),
    (9, "short one"),
    (9, "other text under the same id, a little longer"),
    (7, "  \t\n "),
    (None, "no id but a text with some words"),
    (20, "ünï cödé Wörter 🙂🙂 und mehr davon und mehr"),
    (12, "x"),
]


@pytest.mark.parametrize("buckets", [1, 2, 5, 512])
def test_against_plain_python(spark, buckets):
    r = random.Random(1)
    rows = CASES + [(100 + i, " ".join(r.choices("abcdefgh", k=r.randint(0, 60)))) for i in range(40)]
    docs = spark.createDataFrame([(*x, 1, "q") for x in rows], "doc_id long, text string, rn int, bucket string").repartition(4)
    out = simhash.fingerprint_table(docs, buckets=buckets).collect()
    unsigned = lambda v: v % (1 << 64)
    got = sorted(((x.doc_id, x.n_chars, x.edited_sha256, unsigned(x.fp), unsigned(x.edited_fp), unsigned(x.next_fp)) for x in out), key=str)
    want = [(d, len(t), hashlib.sha256(e.encode()).hexdigest(), brute_fp(t), brute_fp(e), brute_fp(n)) for d, t, e, n in edits(rows)]
    assert got == sorted(want, key=str)


def test_one_and_none(spark):
    one = simhash.fingerprint_table(spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].fp == one[0].next_fp
    assert simhash.fingerprint_table(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("radius", "blocks"), [(3, 6), (2, 4), (0, 1)])
def test_near_finds_all(spark, radius, blocks):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = base + [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(8)]
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    held = spark.createDataFrame([(v,) for v in signed + signed[:9]] + [(None,)], "fp long")
    asked = held.limit(30)
    got = sorted((x.asked, x.held, x.distance) for x in simhash.near(held, asked, radius, blocks).collect())
    ask = {x.fp for x in asked.collect()}
    want = sorted((a, b, d) for a in ask for b in set(signed) if (d := bin((a ^ b) % (1 << 64)).count("1")) <= radius)
    assert got == want


def test_op4_is_native_and_tells_edits_from_strangers(spark):
    out = simhash.op4(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    row = out.agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("w")).first()
    assert row.e > 0.7 and row.n < 0.6 and row.w > 0.9
