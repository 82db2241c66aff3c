"""Edge cases of ranks, metrics, splits, comparisons and sources on small hand-made tables."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pitpanel.operators import history as H
from pitpanel.operators import metrics as M
from pitpanel.operators import ranks, splits
from pitpanel.operators import reports as R
from pitpanel.operators import sequences as S
from pitpanel.sources import io


def scored(spark, rows):
    return spark.createDataFrame(rows, "g string, row_id long, y int, p double").repartition(4)


def hot_scores(n=600, seed=5):
    """A third of all rows share one score; others are tied in fives."""
    r = random.Random(seed)
    return [("ab"[i % 2], i, r.randint(0, 1), 0.5 if i % 3 == 0 else r.randint(0, 40) / 40) for i in range(n)]


def test_metrics_of_tied_scores_equal_sorted_rows(spark):
    rows = hot_scores()
    got = {r.g: r for r in M.metric_vector(scored(spark, rows), ["g"]).collect()}
    top = {(r.g, r.k): r for r in M.topk(scored(spark, rows), ["g"]).collect()}
    bins = {(r.g, r.bin): r for r in M.reliability(scored(spark, rows), ["g"], adaptive=True).collect()}
    for g in "ab":
        own = sorted([r for r in rows if r[0] == g], key=lambda r: (r[3], r[1]))
        size, extra, at, gap = len(own) // 10, len(own) % 10, 0, 0.0
        for b in range(10):
            part = own[at : at + size + (b < extra)]
            at += len(part)
            assert bins[g, b].n == len(part)
            assert bins[g, b].mean_pred == pytest.approx(sum(r[3] for r in part) / len(part)) and bins[g, b].observed_rate == pytest.approx(sum(r[2] for r in part) / len(part))
            gap += abs(sum(r[2] - r[3] for r in part))
        assert got[g].ece_adaptive == pytest.approx(gap / len(own)) and got[g].brier == pytest.approx(sum((r[2] - r[3]) ** 2 for r in own) / len(own))
        down = sorted(own, key=lambda r: (-r[3], r[1]))
        for k in (1, 5, 10):
            n = math.ceil(len(own) * k / 100)
            assert (top[g, k].n, top[g, k].positives) == (n, sum(r[2] for r in down[:n]))


@pytest.mark.parametrize("descending", [False, True])
def test_row_numbers_split_a_frequent_value(spark, descending):
    rows = hot_scores()
    df = scored(spark, rows)
    found = ranks.quantiles(df, "p")[0]
    assert len(found) > len(set(found))  # the frequent value is several quantiles, so its rows are dealt by row_id
    got = {r.row_id: (r.rn, r.n) for r in ranks.row_numbers(df, ["g"], "p", "row_id", descending).collect()}
    for g in "ab":
        own = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[3] if descending else r[3], r[1]))
        assert [got[r[1]] for r in own] == [(i, len(own)) for i in range(len(own))]


def test_buckets_count_the_edges_at_or_below(spark):
    cuts = [float(i) for i in range(0, 600, 3)]
    out = ranks.with_bucket(spark.range(-5, 610), "b", F.col("id").cast("double"), cuts).collect()
    assert all(r.b == sum(c <= r.id for c in cuts) for r in out)


def panel(spark, rows):
    return spark.createDataFrame(rows, "row_id long, entity long, side string, period int, ym_index int, label int, fold int")


def test_fold_histories_in_one_pass_equal_exploded_ones(spark):
    r = random.Random(2)
    rows = [(i, r.choice([1, 2, 3, None]), r.choice(["A", "B", None]), r.choice([200001, 200002, 200105, None]), r.randint(24000, 24030), r.randint(0, 1), i % 5 + 1) for i in range(120)]
    rows += [(1000 + i, 77, "AB"[i % 2], 200001 + i % 12, 24000 + i % 12, i % 2, i % 5 + 1) for i in range(200)]
    p = panel(spark, rows)
    each = H.explode_folds(p, "fold", 5)
    want = H.fold_history(each, each.filter("role = 'train'"), ["fold"])
    got = H.fold_isolated(p)
    assert got.count() == want.count() == 5 * len(rows)
    assert H.history_diff(got.select("fold", "row_id", *H.FEATURES), want.select("fold", "row_id", *H.FEATURES), ["fold", "row_id"]).filter("changed").count() == 0
    assert got.filter("role = 'valid'").count() == len(rows)


def test_groups_of_one_class_are_dealt_evenly(spark):
    rows = [(i, i // 2, "A", 200001, 24000, 0, 1) for i in range(2000)]  # every entity has two rows and no positive
    out = splits.grouped(panel(spark, rows).drop("fold"))
    assert out.groupBy("entity").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    assert {r["count"] for r in out.groupBy("fold").count().collect()} == {400}


def test_nested_audit_finds_what_is_put_in(spark):
    outer = spark.createDataFrame([(1, i, "valid" if i < 3 else "train") for i in range(9)], "outer_fold int, row_id long, role string")
    inner = [(1, 1, i, i, 200001 + i, "valid" if i > 6 else "train") for i in range(3, 9)]
    schema = "outer_fold int, inner_fold int, row_id long, entity long, period int, role string"
    zero = dict.fromkeys(splits.VIOLATIONS, 0)
    audit = lambda rows, o=outer: {k: v for k, v in splits.nested_audit(o, spark.createDataFrame(rows, schema)).first().asDict().items() if k in zero}
    assert audit(inner) == zero
    assert audit([*inner, (1, 1, 3, 3, 200001, "valid")]) == zero | {"row_overlap": 1, "entity_overlap": 1, "not_forward": 4}
    assert audit([*inner, (1, 1, 2, 2, 200001, "train")]) == zero | {"not_contained": 1, "outer_leakage": 1}
    assert audit([*inner, (1, 1, 50, 50, 200001, "train")]) == zero | {"not_contained": 1}
    twice = outer.unionByName(spark.createDataFrame([(1, 0, "train")], outer.schema))
    assert audit(inner, twice) == zero | {"outer_overlap": 1}


def test_comparison_and_verdict(spark):
    saved = spark.createDataFrame([(1, 1.0), (2, 2.5), (3, None), (9, 1.0), (4, 4.0), (4, 4.0)], "k int, v double")
    now = spark.createDataFrame([(1, 1.0 + 1e-12), (2, 2.0), (3, 1.0), (4, 4.0), (5, 0.0)], "k int, v double")
    out = sorted(((r.k, r.column, r["kind"]) for r in R.compare(saved, now, ["k"], ["v"]).collect()))
    assert out == sorted([(2, "v", "differs"), (3, "v", "differs"), (9, None, "extra"), (4, None, "repeated"), (5, None, "missing")])
    assert R.compare(now, now, ["k"], ["v"]).count() == 0
    row = lambda *r: tuple(R.verdict(spark.createDataFrame(list(r), "check string, value long, ok boolean")).first())
    assert row(("a", 0, True), ("b", 0, True)) == (2, 0, "", "PASS")
    assert row(("a", 1, False), ("c", 0, None), ("b", 0, True)) == (3, 2, "a,c", "FAIL")
    assert row() == (0, 0, "", "FAIL")


def test_validated_join_refuses_a_repeated_key(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted((r.k, r.v) for r in R.validated_join(left, right, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, None)]
    with pytest.raises(PySparkException):
        R.validated_join(left, right.unionByName(right), ["k"]).collect()


def test_row_moments_skip_nulls(spark):
    rows = [(1, 1.0, 2.0, 3.0, 10.0), (2, 5.0, 5.0, None, 5.0), (3, None, None, None, None), (4, 1.0, None, None, 2.0), (5, 0.1, 0.1, 0.1, 0.1)]
    out = {r.k: r for r in S.row_moments(spark.createDataFrame(rows, "k int, a double, b double, c double, d double"), list("abcd"), "m").collect()}
    assert (round(out[1].m_skew, 6), round(out[1].m_kurt, 3), out[1].m_mean) == (1.763633, 3.228, 4.0)
    assert (out[2].m_std, out[2].m_skew, out[2].m_kurt) == (0.0, 0.0, None) and out[3].m_mean is None and out[4].m_skew is None
    assert (out[5].m_std, out[5].m_skew, out[5].m_kurt) == (0.0, 0.0, 0.0)


def test_tokens_are_picked_by_the_character_at_a_place(spark):
    c = spark.createDataFrame([(1, t, 2) for t in ("a1_11", "a1_21", "a1_31", "b1_11", "a1")], "row_id int, token string, n int")
    assert sorted(r.token for r in S.select_tokens(c, [("a1", 4, ("1", "3"))]).collect()) == ["a1_11", "a1_31"]
    assert S.select_tokens(c, []).count() == 0


def test_features_are_loaded_through_checks(spark, tmp_path):
    good = spark.createDataFrame([(i, i % 2, float(i)) for i in range(20)], "row_id long, label int, x double")
    io.save_features(good, str(tmp_path / "good"))
    assert io.load_features(spark, str(tmp_path / "good"), ["x"]).count() == 20
    with pytest.raises(ValueError, match="missing: z"):
        io.load_features(spark, str(tmp_path / "good"), ["z"])
    io.save_features(good.unionByName(spark.createDataFrame([(3, 7, 0.0)], good.schema)), str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="binary_label, unique_key"):
        io.load_features(spark, str(tmp_path / "bad"), ["x"])
    io.write_predictions(good.withColumn("fold", F.col("row_id") % 2), str(tmp_path / "p"))
    assert io.read_folds(spark, str(tmp_path / "p"), [1]).count() == 10


@pytest.mark.parametrize("group", [False, True])
def test_packed_audit_holds_every_row_once(spark, group):
    rows = [(i, i % 37, "A", 200001 + i % 12, 24000, i % 3 == 0, 1) for i in range(400)]
    p = panel(spark, [(*r[:5], int(r[5]), r[6]) for r in rows]).drop("fold")
    folds = splits.grouped(p) if group else splits.stratified(p)
    packed, cells = splits.packed(splits.inner_places(folds, group=group))
    assert packed.count() == 400 and len(cells) == 15
    outer = H.explode_folds(folds, "fold", 5).select(F.col("fold").alias("outer_fold"), "row_id", "role")
    inner = splits.inner_roles(splits.inner(folds, group=group)).select("outer_fold", "inner_fold", "row_id", "entity", "period", "role")
    found = lambda df: {tuple(r) for r in df.collect()}
    want = found(splits.nested_audit(outer, inner))
    assert found(splits.audit_packed(packed, packed, cells)) == want and len(want) == 15
    # a validation row of outer fold 1 in the training rows of its first inner fold
    leak = packed.filter("ov & 1 <> 0").orderBy("row_id").limit(1).withColumns({"t": F.lit(1).cast("long"), "v": F.lit(0).cast("long")})
    out = splits.audit_packed(packed, packed.unionByName(leak), cells).agg(F.sum("outer_leakage"), F.sum("not_contained"), F.sum("row_overlap")).first()
    assert tuple(out) == (1, 1, 0)


def test_audit_of_more_folds_than_a_number_has_bits(spark):
    outer = spark.range(5).selectExpr("id as row_id", "explode(sequence(1, 70)) as outer_fold", "if(row_id = 0, 'valid', 'train') as role")
    inner = outer.filter("role = 'train'").selectExpr("outer_fold", "1 as inner_fold", "row_id", "row_id as entity", "200001 as period", "if(row_id = 1, 'valid', 'train') as role")
    out = splits.nested_audit(outer, inner).collect()
    assert {(r.outer_fold, r.train_rows, r.valid_rows, r.outer_leakage) for r in out} == {(f, 3, 1, 0) for f in range(1, 71)}
