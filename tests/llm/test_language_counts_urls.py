import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel.llm import language_id, token_counts, url_reputation

D = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang")
    got = language_id.op3(spark, D).join(docs, "doc_id")
    r = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("ok"), F.count("*").alias("n")).first()
    assert r.n > 100 and r.ok > 0.9
    assert got.filter("score < 0 or score > 1 or lang_pred is null").count() == 0


def test_language_cases(spark):
    rows = [(1, "aaa aab aaa abab", "x"), (2, "zzz yzy zyz", "y"), (3, None, "x"), (4, "12 !!", "x"), (5, "zzy", None), (6, "", None), (7, "a" * 600_000, None), (None, "aab", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    model = language_id.fit(docs)
    out = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 7, None)] == ["x", "y", "und", "und", "y", "und", "x", "x"]
    assert out[3].score == 0 and out[1].score > 0.5
    kept = language_id.keep_known(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 7]
    empty = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_training_does_not_see_held_out_rows(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang")
    hidden = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    a = language_id.fit(docs.filter(~hidden))
    b = language_id.fit(docs.withColumn("lang", F.when(hidden, "zz").otherwise(F.col("lang"))).filter(~hidden))
    assert a["langs"] == b["langs"] and np.array_equal(a["matrix"], b["matrix"])


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_counts_across_blocks(spark, tmp_path, block):
    files = {"a": [1, 2, 9, 9, 3, 9], "b": [9], "c": [4, 5, 6], "d": [], "e": [7] * 50 + [9] + [8] * 3, "f": [9, 1]}
    for k, ids in files.items():
        (tmp_path / f"{k}.tokens").write_bytes(np.array(ids, "<u2").tobytes())
    out = token_counts.count(token_counts.files(spark, str(tmp_path)), 9, block_bytes=block)
    got = sorted((r.path.rsplit("/", 1)[-1][0], r.doc_no, r.start, r.n_tokens, r.closed) for r in out.collect())
    want = []
    for k, ids in files.items():
        start, no = 0, 0
        for i, x in enumerate(ids):
            if x == 9:
                want.append((k, no, start, i - start, True))
                start, no = i + 1, no + 1
        if start < len(ids):
            want.append((k, no, start, len(ids) - start, False))
    assert got == sorted(want)


def test_scores_equal_a_plain_naive_bayes(spark):
    """Log-scores of counts in dictionaries, n-gram by n-gram, over the same sample and buckets."""
    import math
    from collections import Counter, defaultdict

    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    bits = 12
    grams = lambda t: [int(b) for x in language_id._buckets(language_id._codes(t), bits) for b in x]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.fit(table, train_docs=10**9, bits=bits)
    counts, sizes = defaultdict(Counter), Counter()
    for _, t, lang in docs:
        if lang is not None and any(c.isalpha() for c in t or ""):
            counts[lang].update(grams(t))
            sizes[lang] += 1
    total = {k: sum(c.values()) + 0.5 * 2**bits for k, c in counts.items()}
    for r in language_id.predict(table.limit(60), model).collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        scores = {k: math.log(sizes[k] / sum(sizes.values())) + sum(math.log((counts[k][g] + 0.5) / total[k]) for g in grams(r.text)) for k in counts}
        best = max(scores, key=scores.get)
        assert r.lang_pred == best and abs(r.score - 1 / sum(math.exp(v - scores[best]) for v in scores.values())) < 1e-3


def test_op6_equals_the_encoder(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.op6(spark, d).collect()} == want


def test_flat_files_of_odd_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<|endoftext|> a", "x"), (3, "<|endoftext|> a", "x"), (None, "b", "x")], "doc_id long, text string, path string")
    named = token_counts.write_flat(docs.coalesce(1), str(tmp_path)).persist()
    assert named.count() == 5
    # the text's own end of text is an id like any other, and no end of a document
    n = sorted(r.n_tokens for r in token_counts.count(token_counts.files(spark, str(tmp_path)), 50257).collect())
    assert n == [0, 0, 1, 2, 2]
    assert token_counts.write_flat(docs.limit(0), str(tmp_path)).count() == 0


def test_urls(spark):
    urls = [
        (1, "http://A.Example.COM/en/7x?q"),
        (2, "https://example.com/en/8"),
        (3, "x://sub.example.net/de/8/9#f"),
        (4, "x://other.net/de/8"),
        (5, "x://net/de/"),
        (6, "x://notexample.com.org/es/1"),
        (7, None),
        (8, "no scheme/en/"),
        (9, "http://h?x/y"),
        (10, "http://bad.org/en/100"),
        (11, "http://good.org/en/3"),
        (11, "http://good.org/en/3"),
        (None, "http://myexample.com/en/7"),
    ]
    good = [(100 + i, 0) for i in range(60)] + [(200 + i, 1) for i in range(60)] + [(300, None), (100, 1)]
    urls += [(1000 + i, f"http://bad.org/en/{100 + i}.html") for i in range(60)] + [(2000 + i, f"http://good.org/en/{200 + i}/") for i in range(60)]
    pages = spark.createDataFrame([(*u, "h", 1) for u in urls], "page_id long, url string, host string, n int")
    labels = spark.createDataFrame(good, "doc_id long, good int")
    rows = url_reputation.judge(pages, labels).collect()
    assert len(rows) == len(urls)
    out = {r.page_id: r for r in rows}
    want = {
        1: ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        2: ("example.com", "/en/8", "com/en/", "block"),
        3: ("sub.example.net", "/de/8/9", "example.net/de/8", "block"),
        4: ("other.net", "/de/8", "net/de/", "allow"),
        5: ("net", "/de/", "net/de/", "allow"),
        6: ("notexample.com.org", "/es/1", "org/es/", "block"),
        None: ("myexample.com", "/en/7", "com/en/", "block"),
    }
    for k, v in want.items():
        assert (out[k].host, out[k].path, out[k].rule, out[k].verdict) == v
    assert (out[7].host, out[7].path, out[7].rule) == ("", "", None) and out[8].host == "" and (out[9].host, out[9].path) == ("h", "")
    assert out[10].verdict == "block" and out[11].verdict == "allow" and out[10].n_labelled == 61
    assert url_reputation.judge(pages.limit(0), labels).count() == 0
    assert {r.verdict for r in url_reputation.judge(pages.filter("page_id in (9, 10)"), labels.limit(0)).collect()} == {"allow"}


def test_op7_equals_its_sql(spark):
    out = url_reputation.op7(spark, D)
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    want = con.execute(url_reputation.OP7_SQL).to_arrow_table().select(out.columns).to_pylist()
    assert sorted(map(str, want)) == sorted(str(r.asDict()) for r in out.collect())
