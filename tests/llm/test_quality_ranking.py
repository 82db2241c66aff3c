import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pitpanel.llm import quality_ranking as Q
from pitpanel.llm import shared as S


def prose(rnd, n):
    out = []
    for i in range(n):
        w = "".join(rnd.choice(["an", "ter", "ó", "ing", "re", "st", "la"]) for _ in range(rnd.choice([1, 2, 2, 3])))
        out.append(w.capitalize() if i % 9 == 0 else w + "." if i % 9 == 8 else w)
    return " ".join(out)


def junk(rnd, n, kind):
    w = prose(rnd, n).split()
    if kind == 0:
        return " ".join(x.upper() + "!!" for x in w)
    if kind == 1:
        return " ".join(x + rnd.choice(["***", "###"]) for x in w)
    if kind == 2:
        return " | ".join(w)
    return " ".join(x for x in w[: max(1, n // 8)] for _ in range(8))


def corpus(n=600, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.8
        size = rnd.choice([9, 40, 300])
        docs.append((i, prose(rnd, size) if good else junk(rnd, size, rnd.randrange(4)), "en", "src0", 1))
        if i % 2:
            labels.append((i, int(good), 0))
    return docs, labels


def write(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_held_out_accuracy(spark, tmp_path):
    docs, labels = corpus()
    truth = {i: t for i, t, *_ in docs}
    write(spark, tmp_path, docs, labels)
    got = {r["doc_id"]: r for r in Q.op11(spark, str(tmp_path)).collect()}
    assert got.keys() == truth.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(y, got[i]["predicted"]) for i, y, _ in labels if got[i]["held_out"]]
    assert len(held) > 40 and sum(y == p for y, p in held) / len(held) > 0.97


def test_pairs_equal_a_direct_fit(spark):
    """The weights minimise the penalised pairwise logistic loss."""
    docs, labels = corpus(200, 4)
    d = spark.createDataFrame([r[:2] for r in docs], "doc_id long, text string")
    la = spark.createDataFrame([r[:2] for r in labels], "doc_id long, quality int")
    model = Q.fit(d, la, train_docs=60, pairs=500, penalty=0.05)
    x = dict(zip([i for i, *_ in docs], Q.features(pa.array([t for _, t, *_ in docs])), strict=True))
    strength = {i: float(v @ model["weights"]) for i, v in x.items()}
    good, bad = ([strength[i] for i, y, _ in labels if y == k] for k in (1, 0))
    wins = np.mean([g > b for g in good for b in bad])
    assert wins > 0.98
    # the share of bad labels lies below the threshold
    below = sum(s < model["threshold"] for s in good + bad)
    assert abs(below - len(bad)) <= 0.1 * len(good + bad)


def test_quantile_by_weights():
    assert Q.quantile([(0, 1.0), (0, 2.0), (1, 4.0), (1, 9.0)], {0: 1.0, 1: 1.0}) == 3.0
    assert Q.quantile([(1, 1.0), (0, 2.0)], {0: 1.0, 1: 5.0}) == 1.5


def test_edges_of_labels_and_texts(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x", "c"), (None, "y", "d"), (3, "x", "c")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 1), (None, 0), (3, 5)], "doc_id long, quality int")
    for labels in (none, odd):  # never both labels: no preferences
        model = Q.fit(docs, labels)
        assert model["weights"] is None
        assert {r["score"] for r in Q.score(docs, model).collect()} == {0.5}
    both = spark.createDataFrame([(2, 0), (3, 1), (3, 1)], "doc_id long, quality int")
    model = Q.fit(docs, both)
    got = {(r["doc_id"], r["score"]) for r in Q.score(docs, model).collect()}
    assert len(got) == 4 and dict(got)[1] == dict(got)[2] < 0.7 < dict(got)[3]
    kept = Q.keep_best(docs, model, 0.4)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {3}
    assert Q.score(docs.limit(0), model).count() == 0 == Q.keep_best(docs.limit(0), model, 0.5).count()


def plain(t):
    """Word counts of a text, one by one."""
    w = (t or "").split()
    box = [w[i : i + Q.WINDOW] for i in range(0, len(w), Q.WINDOW)]
    return [len(w), sum(a == b for a, b in zip(w, w[1:], strict=False)), sum(len({*b}) for b in box), sum(len({*zip(b, b[1:], strict=False)}) for b in box), sum(max(len(b) - 1, 0) for b in box), len(box)]


@pytest.mark.parametrize("n", [0, 1, 7])
def test_counts_equal_plain_ones(n):
    rnd = random.Random(n)
    texts = [prose(rnd, k) + rnd.choice(["", "\n", " \t x x x"]) for k in (1, 63, 64, 65, 130)][:n] + ["", "a", "a a", " "]
    raw, offsets = S.utf8(pa.array(texts))
    got = Q._counts(raw, offsets)
    for row, t in zip(got, texts, strict=True):
        assert list(row[-6:]) == plain(t)
        kinds = Counter(int(k) for k in Q._CLASS[np.frombuffer(t.encode(), np.uint8)])
        assert all(row[k] == kinds[k] for k in range(Q.CLASSES))


def test_long_text_in_pieces(monkeypatch):
    rnd = random.Random(5)
    t = prose(rnd, 4000)
    whole = Q.features(pa.array([t, None, "b"]))
    monkeypatch.setattr(Q, "_PIECE", 4096)
    parts = Q.features(pa.array([t, None, "b"]))
    assert np.abs(whole - parts).max() < 0.02 and not whole[1].any()


def test_every_labelled_document_teaches(spark, monkeypatch):
    """2,300 good documents and 30 bad ones: a trait of the last ones in hash order counts, and the threshold is the quantile of all strengths."""
    docs = [(i, ("a b " * (1 + i % 7)) if i % 78 else "x !! " * (1 + i % 5)) for i in range(2340)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    la = spark.createDataFrame([(i, int(i % 78 != 0)) for i, _ in docs], "doc_id long, quality int")
    seen, inner = [], Q.LogisticRegression.fit
    monkeypatch.setattr(Q.LogisticRegression, "fit", lambda self, pairs: seen.append(pairs.count()) or inner(self, pairs))
    model = Q.fit(d, la, pairs=1)
    assert seen == [2310]  # a pair for each good document
    own = [(int(i % 78 != 0), float(v @ model["weights"])) for (i, _), v in zip(docs, Q.features(pa.array([t for _, t in docs])), strict=True)]
    assert model["threshold"] == pytest.approx(Q.quantile(own, {0: 1.0, 1: 1.0}), abs=1e-9)
    assert max(s for y, s in own if y == 0) < model["threshold"] < min(s for y, s in own if y == 1)
