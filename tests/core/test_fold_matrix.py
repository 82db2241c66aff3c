"""The matrix of all folds: written once a record, and equal to the base matrix with each fold's histories swapped in."""

import pytest
from pyspark.sql import functions as F

from pitpanel.operators import features, history, scan, sequences, splits
from pitpanel.plans import evaluation_queries as Q
from pitpanel.plans import feature_queries
from pitpanel.sources.fixtures import panel

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("often", [0, 3])
def test_a_record_is_written_once_for_all_folds(spark, monkeypatch, often):
    p = panel(spark, SMALL)
    hot = [r.entity for r in p.groupBy("entity").count().orderBy(F.desc("count"), "entity").limit(often).collect()]
    monkeypatch.setattr(scan, "hot_values", lambda *a, **k: hot)
    monkeypatch.setattr(Q, "_HELD", {})
    got = Q.fold_matrix(spark, SMALL)
    few = {f for f in got[1][0].inputFiles() + got[1][1].inputFiles() if "/few/" in f}
    assert spark.read.parquet(*few).count() == p.filter(~scan.is_hot("entity", hot)).count()
    s = splits.stratified(p)
    base = feature_queries.matrix(spark, SMALL, p, p).join(s.select("row_id", "fold"), "row_id")
    want = features.swap_history(history.explode_folds(base, "fold", 5), history.fold_isolated(s), ["fold", "row_id"]).cache()
    assert list(got) == [1, 2, 3, 4, 5]
    for f in (2,):
        for role, side in zip(("train", "valid"), got[f], strict=True):
            assert side.columns == ["row_id", "label", *feature_queries.COLUMNS]
            one = want.filter((F.col("fold") == f) & (F.col("role") == role))
            assert side.count() == one.count() > 0
            diff = history.history_diff(side.withColumn("fold", F.lit(f)), one, ["row_id", "fold"], feature_queries.COLUMNS)
            assert diff.count() == one.count() and diff.filter("changed").count() == 0


def test_moments_of_lists_are_those_of_counts(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"], 3), (2, ["c"], None), (3, None, 2), (4, ["a", "b", "x"], 0)], "row_id long, tokens array<string>, s int")
    counts = sequences.transfer(sequences.token_counts(rows, "tokens"), spark.createDataFrame([("a",), ("b",), ("c",)], "token string"))
    names = ["row_id", *[f"m_{k}" for k in ("std", "mean", "skew", "kurt")]]
    want = sequences.token_moments(rows, counts, 3, "m", scalars=["s"]).select(names)
    got = sequences.list_moments(rows, "tokens", ["a", "b", "c"], "m", ["s"])
    assert sorted(got.columns) == sorted([*rows.columns, *names[1:]])
    for a, b in zip(sorted(got.select(names).collect()), sorted(want.collect()), strict=True):
        assert a == pytest.approx(b, abs=1e-12)


def test_a_digest_tells_where_nulls_are(spark):
    from pitpanel.operators.reports import digest

    of = lambda rows: digest(spark.createDataFrame(rows, "a int, b int")).first()
    assert of([(1, 2), (3, None)]) == of([(3, None), (1, 2)])
    assert len({tuple(of(r)) for r in ([(1, 2)], [(2, 1)], [(1, None)], [(None, 1)], [(1, 2), (1, 2)], [])}) == 6
