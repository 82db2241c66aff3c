"""Checks, compared reports, ledgers and differences on small tables; metrics with string ids; the size of generated methods."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pitpanel.operators import history as H
from pitpanel.operators import metrics as M
from pitpanel.operators import reports as R
from pitpanel.operators import sequences as S
from pitpanel.sources import io


def values(df):
    return {r["check"]: (r["value"], r["ok"]) for r in df.collect()}


def test_aligned_tables(spark):
    a = spark.createDataFrame([(1, 0, "x"), (2, 1, "y"), (2, 1, "y"), (None, None, "z")], "row_id long, label int, c string")
    assert values(R.aligned(a, a.orderBy(F.desc("row_id")), "row_id", "label", ["c"])) == {"length": (0, True), "label_equal": (0, True), "schema": (0, True)}
    other = spark.createDataFrame([(2, 1), (1, 0), (1, 0), (None, None)], "row_id long, label int")  # as many rows, another one twice
    assert values(R.aligned(a, other, "row_id", "label", ["c", "d"])) == {"length": (0, True), "label_equal": (1, False), "schema": (1, False)}
    assert values(R.aligned(a, other.limit(0), "row_id", "label", []))["length"] == (4, False)
    assert values(R.aligned(a.limit(0), other.limit(0), "row_id", "label", []))["label_equal"] == (0, True)


def test_load_features_refuses_other_labels(spark, tmp_path):
    a = spark.createDataFrame([(1, 0, 5.0), (2, 1, 6.0)], "row_id long, label int, x double")
    io.save_features(a, f"file://{tmp_path}/f")
    assert io.load_features(spark, f"file://{tmp_path}/f", ["x"], targets=a.select("row_id", "label")).count() == 2
    with pytest.raises(ValueError, match="label_equal"):
        io.load_features(spark, f"file://{tmp_path}/f", ["x"], targets=a.select("row_id", (1 - F.col("label")).alias("label")))
    with pytest.raises(ValueError, match="length"):
        io.load_features(spark, f"file://{tmp_path}/f", ["x"], targets=a.limit(1))


def test_compared_reports(spark):
    t = spark.createDataFrame([("a", 1, 0.5, None), ("b", 2, 0.25, 1.0), ("c", None, None, 2.0)], "k string, j int, v double, w double")
    s = spark.createDataFrame([("a", 1, 0.5000001, None), ("b", 2, 0.5, None), ("d", 4, 1.0, 1.0), ("d", 4, 1.0, 1.0)], "k string, j int, v double, w double")
    got = {(r["report"], r["key"], r["column"], r["kind"]) for r in R.compare_reports([("one", s, t, ["k", "j"], ["v", "w"], 1e-3), ("two", t, t, ["k"], ["v"], 0.0)]).collect()}
    assert got == {("one", "b|2", "v", "differs"), ("one", "b|2", "w", "differs"), ("one", "c|null", None, "missing"), ("one", "d|4", None, "extra"), ("one", "d|4", None, "repeated")}


def test_ledger_of_formulas(spark):
    v = spark.createDataFrame([("d", "auc", 0.75), ("b", "auc", 0.5), ("d", "brier", 0.25)], "entry string, metric string, value double")
    f = [("x", "auc", "d", "b", None), ("y", "auc", "d", "b", "b"), ("z", "auc", "d", "b", "c"), ("u", "brier", "d", "b", None), ("w", "auc", "q", "b", None), ("s", "auc", "d", None, None)]
    got = {r["key"]: (r["value"], r["delta"]) for r in R.ledger(v, spark.createDataFrame(f, "key string, metric string, minuend string, subtrahend string, condition string")).collect()}
    assert got == {"x": (0.75, 0.25), "y": (0.75, 0.25), "z": (0.75, None), "u": (0.25, None), "w": (None, None), "s": (0.75, None)}


def test_differences_by_column(spark):
    base = {c: float(i) for i, c in enumerate(H.FEATURES)}
    rows = [(i, "g", *base.values()) for i in range(4)]
    schema = "row_id long, g string, " + ", ".join(f"{c} double" for c in H.FEATURES)
    a = spark.createDataFrame(rows, schema)
    b = a.drop("g").withColumn(H.SAME[2], F.when(F.col("row_id") < 2, F.col(H.SAME[2]) + 1).otherwise(F.col(H.SAME[2]))).withColumn(H.OTHER[0], F.when(F.col("row_id") == 3, None).otherwise(F.col(H.OTHER[0])))
    got = {(r["block"], r["column"]): r["changed"] for r in H.history_diff_columns(a, b, ["row_id"], ["g"]).collect()}
    assert len(got) == 19 and {k: v for k, v in got.items() if v} == {("same", H.SAME[2]): 2, ("same", None): 2, ("opposite", H.OTHER[0]): 1, ("opposite", None): 1}


def test_metrics_of_string_ids_equal_those_of_numbers(spark):
    rnd = random.Random(2)
    rows = [(i, f"t{i:06d}", int(rnd.random() < 0.3), rnd.choice([0.1, 0.5, 0.5, rnd.random()])) for i in range(700)]
    t = spark.createDataFrame(rows, "n long, s string, y int, p double").withColumn("model", F.lit("m"))
    by_number, by_text = t.withColumnRenamed("n", "row_id").drop("s"), t.withColumnRenamed("s", "row_id").drop("n")
    for f in (lambda x: M.metric_vector(x, ["model"]), lambda x: M.topk(x, ["model"]), lambda x: M.reliability(x, ["model"], adaptive=True)):
        a, b = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f(x).collect()) for x in (by_number, by_text))
        assert a == b
    bins = {r["row_id"]: r["bin"] for r in M.with_bins(by_text, ["model"], adaptive=True).collect()}
    order = sorted(rows, key=lambda r: (r[3], r[1]))
    assert all(bins[r[1]] == k // 70 for k, r in enumerate(order))


def test_row_moments_fit_a_compiled_method(spark):
    t = spark.range(100).selectExpr("id", *[f"CASE WHEN id % {k + 2} > 0 THEN CAST(id * {k} % 7 AS DOUBLE) END AS c{k}" for k in range(4)])
    out = S.row_moments(t, [f"c{k}" for k in range(4)], "m")
    text = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000
    for r in out.collect():
        v = [r[f"c{k}"] for k in range(4) if r[f"c{k}"] is not None]
        n, m = len(v), sum(v) / len(v) if v else None
        assert r["m_mean"] == (pytest.approx(m) if v else None)
        s2 = sum((x - m) ** 2 for x in v) if v else 0
        assert r["m_std"] == (pytest.approx((s2 / (n - 1)) ** 0.5) if n > 1 else None)
        flat = len(set(v)) == 1
        if n > 2:
            g = 0.0 if flat else (sum((x - m) ** 3 for x in v) / n) / (s2 / n) ** 1.5 * (n * (n - 1)) ** 0.5 / (n - 2)
            assert r["m_skew"] == pytest.approx(g, abs=1e-9)
        if n > 3:
            g = 0.0 if flat else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (sum((x - m) ** 4 for x in v) / n / (s2 / n) ** 2 - 3) + 6)
            assert r["m_kurt"] == pytest.approx(g, abs=1e-9)
        assert (r["m_skew"] is None) == (n < 3) and (r["m_kurt"] is None) == (n < 4)
