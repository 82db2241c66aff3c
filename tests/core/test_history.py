import pytest
from pyspark.sql import functions as F

from pitpanel.operators import features, history, metrics, ranks, reports, sequences, splits

SCHEMA = "row_id long, entity long, side string, period int, ym_index int, label int"


def rows(spark, data):
    return spark.createDataFrame([(i, e, s, p, None if p is None else p // 100 * 12 + p % 100, y) for i, e, s, p, y in data], SCHEMA)


def test_ties_first_rows_and_sides(spark):
    p = rows(spark, [(1, 1, "A", 202001, 1), (2, 1, "A", 202002, 0), (3, 1, "A", 202002, 1), (4, 1, "B", 202003, 1), (5, 2, "A", 202001, 0), (6, 2, "A", 202001, 1), (7, 3, "B", None, 1)])
    h = {r.row_id: r for r in history.fold_history(p, p).collect()}
    assert all(h[1][c] is None for c in history.FEATURES) and all(h[5][c] is None and h[6][c] is None for c in history.FEATURES)
    for i in (2, 3):
        assert (h[i].prev_ab_all_label_mean, h[i].prev_ab_all_label_sum, h[i].prev_ab_all_label_std) == (1.0, 1, None)
    assert h[4].prev_all_label_mean is None and h[4].other_test_Test_id_count == 3
    assert h[4].other_test_Label_mean == pytest.approx(2 / 3) and h[4].prev_ab_all_label_sum == 2
    assert h[7].prev_ab_all_label_sum is None
    assert history.fold_history(p.limit(0), p).count() == 0


def test_window_equals_theta_join_and_ignores_validation_labels(spark):
    import random

    r = random.Random(0)
    p = rows(spark, [(i, r.randint(1, 30), r.choice("AB"), 202000 + r.randint(1, 12), r.randint(0, 1)) for i in range(400)])
    a, b = history.fold_history(p, p).select("row_id", *history.FEATURES), history.theta_history(p, p).select("row_id", *history.FEATURES)
    assert history.history_diff(a, b, ["row_id"]).filter("changed").count() == 0
    f = splits.stratified(p)
    each = history.explode_folds(f, "fold", 5)
    flipped = each.withColumn("label", F.when(F.col("role") == "valid", 1 - F.col("label")).otherwise(F.col("label")))
    x, y = (history.fold_history(t, t.filter("role = 'train'"), ["fold"]).select("fold", "row_id", *history.FEATURES) for t in (each, flipped))
    assert history.history_diff(x, y, ["fold", "row_id"]).filter("changed").count() == 0
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 2
    g = splits.grouped(p)
    assert g.groupBy("entity").agg(F.countDistinct("fold").alias("c")).filter("c > 1").count() == 0 and g.count() == 400


def test_auc_with_ties_and_bins(spark):
    same = spark.createDataFrame([(i, i % 2, 0.5, "m") for i in range(10)], "row_id long, y int, p double, model string")
    r = metrics.auc_ap(same, ["model"]).first()
    assert r.auc == 0.5 and r.average_precision == 0.5
    edge = spark.createDataFrame([(1, 1, 0.1), (2, 0, 1.0), (3, 0, 0.0)], "row_id long, y int, p double")
    assert {r.row_id: r.bin for r in metrics.with_bins(edge).collect()} == {1: 1, 2: 9, 3: 0}
    many = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0, i / 23) for i in range(23)], "row_id long, y int, p double")
    sizes = [r["count"] for r in metrics.with_bins(many, adaptive=True).groupBy("bin").count().orderBy("bin").collect()]
    assert sizes == [3, 3, 3, 2, 2, 2, 2, 2, 2, 2]
    assert metrics.metric_vector(many).count() == 1
    assert metrics.auc_ap(many.filter("y = 0")).first().auc is None


def test_prefix_sums_do_not_depend_on_edges(spark):
    df = spark.createDataFrame([(i % 3, float(i % 17), i) for i in range(200)], "g int, v double, id long")
    a = sorted(tuple(r) for r in ranks.row_numbers(df, ["g"], "v", "id", cuts=[]).select("id", "rn", "n").collect())
    for cuts in ([3.0], [0.0, 5.5, 16.0], None):
        assert sorted(tuple(r) for r in ranks.row_numbers(df, ["g"], "v", "id", cuts=cuts).select("id", "rn", "n").collect()) == a


def test_moments_and_lists(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 10.0), (2, 5.0, 5.0, 5.0, 5.0), (3, 1.0, 2.0, None, None)], "row_id long, a double, b double, c double, d double")
    m = {r.row_id: r for r in sequences.row_moments(df, ["a", "b", "c", "d"], "m").collect()}
    assert m[1].m_skew == pytest.approx(1.763633, abs=1e-5) and m[1].m_kurt == pytest.approx(3.228, abs=1e-3)
    assert (m[2].m_skew, m[2].m_kurt, m[2].m_std) == (0, 0, 0) and m[3].m_skew is None and m[3].m_mean == 1.5
    t = spark.createDataFrame([(1, "5,-7,9"), (2, "5,,7"), (3, "5,7"), (4, None)], "row_id long, times string")
    out = {r.row_id: (r.times_mean, r.times_std) for r in sequences.numeric_list(t, "times").collect()}
    assert out[1] == (7.0, pytest.approx(1.632993, abs=1e-5)) and out[2] == out[3] == out[4] == (None, None)
    z = spark.createDataFrame([("1,2,3", "9,8")], "a string, b string").select(sequences.zip_tokens([F.col("a"), F.col("b")], "A1").alias("t")).first().t
    assert z == ["a1_19", "a1_28"]


def test_missing_count_and_variants(spark):
    columns = ["Age", "amount", "isna_sum", *history.FEATURES]
    v = features.variants(columns)
    assert v["D"] == columns and "Age" not in v["A"] and not set(v["no_history"]) & set(history.FEATURES)
    df = spark.createDataFrame([(1, 2, *([None] * 16))], "row_id long, isna_sum int, " + ", ".join(f"{c} double" for c in history.FEATURES))
    with pytest.raises(Exception, match="missing count"):
        features.without_history(df).collect()
    old = spark.createDataFrame([(1, 2)], "k int, v int")
    assert sorted(tuple(r) for r in reports.upsert(old, spark.createDataFrame([(1, 5), (2, 6)], "k int, v int"), ["k"]).collect()) == [(1, 5), (2, 6)]


def test_sources_and_sinks(spark, tmp_path):
    from pitpanel.sources import io

    p = rows(spark, [(1, 1, "A", 202001, 1), (2, 1, "B", 202002, 0)])
    io.write_report(p.withColumn("x", F.lit(1 / 3)), str(tmp_path / "r"))
    back = io.read_csv(spark, str(tmp_path / "r"), SCHEMA + ", x double", ["row_id", "x"])
    assert sorted(tuple(r) for r in back.collect()) == [(1, 0.333333), (2, 0.333333)]
    io.write_predictions(p.withColumn("fold", F.col("row_id").cast("int")), str(tmp_path / "p"))
    assert [r.row_id for r in io.read_folds(spark, str(tmp_path / "p"), [2]).collect()] == [2]
    io.write_manifest(p, str(tmp_path / "m"), seed=42)
    assert spark.read.json(str(tmp_path / "m")).first().asDict() == {"rows": 2, "positives": 1, "rate": 0.5, "seed": 42}
    snap = io.GuardedSnapshot(spark, str(tmp_path / "s"))
    build = lambda: history.fold_history(p, p)
    assert snap.load(build, [p]).count() == 2 and snap.load(None, [p]).count() == 2
    with pytest.raises(ValueError, match="other inputs"):
        snap.load(build, [p.limit(1)])
    assert io.fill_text(spark.createDataFrame([(None, None)], "a string, b int")).first() == ("", None)


def test_one_sort_serves_all_blocks(spark):
    """Rows are sorted and held once, whatever the blocks; a table that is its own source is not read twice."""
    p = spark.createDataFrame([(i, i % 5, "AB"[i % 2], 200001 + i % 9, 24000 + i % 9, i % 2) for i in range(60)], "row_id long, entity long, side string, period int, ym_index int, label int")
    plan = history.fold_history(p, p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Sort [") == 1 and "Union" not in plan
    plan = history.fold_history(p, p.filter("row_id < 30"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Sort [") == 1


def test_mutated_labels_are_compared_in_one_pass(spark):
    import random

    r = random.Random(3)
    p = splits.stratified(rows(spark, [(i, r.randint(1, 20), r.choice(["A", "B", None]), None if i % 50 == 7 else 202000 + r.randint(1, 12), r.randint(0, 1)) for i in range(300)]))
    each = history.explode_folds(p, "fold", 5)
    seen = []
    for mutate in (lambda trains, y: F.when(trains, y).otherwise(1 - y), lambda trains, y: F.when(trains & (F.col("row_id") % 9 == 0), 1 - y).otherwise(y)):
        other = each.withColumn("label", mutate(F.col("role") == "train", F.col("label")))
        a, b = (history.fold_history(t, t.filter("role = 'train'"), ["fold"]).select("fold", "row_id", *history.FEATURES) for t in (each, other))
        want = {(x.fold, x.row_id): x.changed for x in history.history_diff(a, b, ["fold", "row_id"]).collect()}
        for hot in ([], [1, 2, 3])[: 1 if len(seen) else 2]:
            out = history.label_mutation(p, mutate, hot=hot)
            got = {(x.fold, x.row_id): x.changed for x in out.collect()}
            assert got == want and len(got) == 1500
            seen.append(hot)
        plan = history.label_mutation(p, mutate, hot=[])._jdf.queryExecution().executedPlan().toString()
        assert "rdinality" not in plan and plan.count("FullOuter") == 0  # nothing is joined again
    assert any(want.values()) and not all(want.values())


def test_label_diff_finds_what_a_join_finds(spark):
    import random

    r = random.Random(4)
    p = rows(spark, [(i, r.randint(1, 20), r.choice("AB"), 202000 + r.randint(1, 12), r.randint(0, 1)) for i in range(300)])
    q = p.withColumn("other", F.when(F.col("row_id") % 11 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    a, b = (history.fold_history(t, t).select("row_id", *history.FEATURES) for t in (p, q.withColumn("label", F.col("other"))))
    want = {x.row_id for x in history.history_diff(a, b, ["row_id"]).filter("changed").collect()}
    out = history.label_diff(q, "other", ("any", "same", "other"), [])
    assert {x.row_id for x in out.filter("changed").collect()} == want and 0 < len(want) < 300
    assert set(out.columns) == {*q.columns, "changed"}
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(entity") == 1
