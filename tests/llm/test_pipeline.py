import numpy as np
import pytest

from pitpanel.llm import decontamination, language_id

D = "/root/testdata/sf0.001"
cp = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark):
    from tests.llm.test_decontamination import brute as hits
    from tests.llm.test_line_dedup import brute as lines
    from tests.llm.test_ngram_jaccard import brute as groups

    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    model = language_id.fit(docs)
    want = {r.doc_id: r.text for r in language_id.predict(docs, model).collect() if r.lang_pred != "und" and r.score >= 0.5}
    one = cp.language_stage(spark, docs, D).persist()
    assert one.columns == columns and {r.doc_id: r.text for r in one.collect()} == want

    want = {d: t for d, t, n, m in lines(list(want.items())) if not (n and n == m)}
    two = cp.line_stage(spark, one, D).persist()
    assert two.columns == columns and {r.doc_id: r.text for r in two.collect()} == want
    assert all(r.n_chars == len(r.text) for r in two.collect())

    want = {d: want[d] for d, _, c in groups(list(want.items())) if d == c}
    three = cp.near_duplicate_stage(spark, two, D).persist()
    assert three.columns == columns and {r.doc_id: r.text for r in three.collect()} == want

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    want = {d: want[d] for d, *_, bad in hits(list(want.items()), items) if not bad}
    four = cp.benchmark_stage(spark, three, D).persist()
    assert four.columns == columns and {r.doc_id: r.text for r in four.collect()} == want

    five = {r.doc_id: r for r in cp.token_stage(spark, four, D).collect()}
    assert five.keys() == want.keys() and all(r.round_trip and r.n_tokens == len(np.frombuffer(r.ids, "<u4")) for r in five.values())
    assert {r.doc_id for r in cp.run(spark, D).collect()} == want.keys()


def test_drop_contaminated_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "k", 3), (2, "x y", "k", 3), (None, "a b", "k", 3)], "doc_id long, text string, key string, start int")
    out = decontamination.drop_contaminated(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [2]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_lines int, name string, d long, k string"
LONG = " ".join(f"wort{i}" for i in range(40))


def odd(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 7, "a", 3, "k") for r in rows], SCHEMA).repartition(3)


def test_stages_take_nulls_repeats_and_clashing_names(spark):
    rows = [
        (1, LONG + "\nline of its own", "de", "s", 10),
        (2, LONG + "\nline of its oWn", None, None, None),
        (None, "a text without an id\nline of its own", "de", "s", 1),
        (None, "another text that has no id", "de", "s", 1),
        (3, "the same row twice", "de", "s", 1),
        (3, "the same row twice", "de", "s", 1),
        (3, "another text with that id", "de", None, 1),
        (4, None, "de", "s", None),
        (5, "", "de", "s", 0),
        (6, "   \n", "de", "s", 4),
        (7, "x" * 20_000 + " " + LONG, "de", "s", 4),
    ]
    docs = odd(spark, rows)
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    rest = lambda df: {tuple(r)[5:] for r in df.collect()}

    one = cp.language_stage(spark, docs, D)
    assert one.columns == docs.columns and rest(one) <= {(0.5, 7, "a", 3, "k")}
    assert {t for _, t in key(one)} <= {t for _, t, *_ in rows if t and t.strip()}

    two = cp.line_stage(spark, docs, D)
    got = key(two)
    assert two.columns == docs.columns and rest(two) == {(0.5, 7, "a", 3, "k")}
    assert (None, "a text without an id\nline of its own") in got and (4, None) in got and (5, "") in got
    assert (1, LONG) in got and all(d != 2 for d, _ in got)  # its lines came before, by id

    three = cp.near_duplicate_stage(spark, docs, D)
    got = key(three)
    assert three.columns == docs.columns and rest(three) == {(0.5, 7, "a", 3, "k")}
    assert got.count((3, "the same row twice")) == 1 and (3, "another text with that id") in got and (4, None) in got and (5, "") in got
    assert (1, rows[0][1]) in got and all(d != 2 for d, _ in got) and sum(d is None for d, _ in got) == 2

    four = cp.benchmark_stage(spark, docs, D)
    assert four.columns == docs.columns and len(key(four)) == len(rows)

    five = cp.token_stage(spark, docs, D).collect()
    assert len(five) == len(rows) and all(r.round_trip for r in five if r.doc_id not in (4,))
    assert {r.n_tokens for r in five if r.doc_id in (4, 5)} == {0}


def test_stages_take_an_empty_table(spark):
    docs = odd(spark, [])
    for name, stage in cp.STAGES:
        out = stage(spark, docs, D)
        assert out.count() == 0, name
        assert name == "byte_bpe" or out.columns == docs.columns
