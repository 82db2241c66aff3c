"""Queries whose final plan may read a table that was made once, not make it again for each use."""

from pyspark.sql import functions as F

from pitpanel.operators import history, models, splits
from pitpanel.plans import feature_queries, model_queries, scored_queries
from pitpanel.sources.fixtures import panel

SMALL = "/root/testdata/sf0.001"


def test_the_matrix_reads_codes_once_made(spark):
    for q in (feature_queries.feature_matrix, feature_queries.token_group_moments):
        files = q(spark, SMALL).inputFiles()
        assert files and not any("lineitem" in f for f in files)


def test_time_variants_pass_the_matrix_once(spark):
    plan = feature_queries.time_variants(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1


def test_few_entities_make_their_weights_in_many_tasks(spark):
    assert scored_queries.bootstrap_weights_500(spark, SMALL).rdd.getNumPartitions() >= 8


def test_a_factorial_makes_its_histories_once(spark, monkeypatch):
    """Entities are whole on one side of every fold, so one pass over the records, each of them once, serves both sides and all folds."""
    plain, seen = model_queries.H.fold_history, []
    monkeypatch.setattr(model_queries.H, "fold_history", lambda targets, *a, **k: seen.append(targets.count()) or plain(targets, *a, **k))
    rows = spark.read.parquet(f"{SMALL}/orders.parquet").count()
    model_queries.factorial(spark, SMALL)
    assert seen == [rows]
    model_queries.factorial_all(spark, SMALL)
    assert seen == [rows] * 2


def test_no_fold_of_whole_entities_changes_a_history(spark):
    g = splits.grouped(panel(spark, SMALL))
    each = history.explode_folds(g, "fold", 5)
    by_fold = history.fold_history(each, each, ["fold", "role"]).select("row_id", *history.FEATURES)
    once = history.fold_history(g, g).select("row_id", *history.FEATURES)
    assert by_fold.count() == 5 * once.count() > 0
    assert by_fold.exceptAll(once.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("i")).count() == 0


def test_a_side_of_a_fold_is_read_from_its_own_files(spark):
    h = model_queries._folds(spark, SMALL)
    side = h.filter("fold = 2 and role = 'valid'").select(F.input_file_name().alias("f"))
    assert "PartitionFilters: [isnotnull(fold" in side._jdf.queryExecution().executedPlan().toString()
    files = [r.f for r in side.distinct().collect()]
    assert files and all("fold=2/role=valid" in f for f in files)
    assert h.count() == 5 * spark.read.parquet(f"{SMALL}/orders.parquet").count()


def test_members_and_vote_are_scored_in_one_pass(spark):
    rows = spark.createDataFrame([(i, i % 2, float(i % 7)) for i in range(60)], "row_id long, label int, x double")
    scored = models.fit_score(rows, rows, ["x"], depth=2, rounds=2)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    got = {(r.row_id, r.model): r.p for r in scored.collect()}
    members = {m for _, m in got} - {"vote"}
    assert len(got) == 300 and len(members) == 4
    assert all(abs(sum(got[i, m] for m in members) / 4 - got[i, "vote"]) < 1e-12 for i in range(60))


def test_histories_of_some_columns_are_those_of_all(spark):
    g = splits.stratified(panel(spark, SMALL))
    some = ["prev_ab_YearMonthIndex_mean", "prev_all_label_std", "other_test_Label_mean"]
    whole = history.fold_isolated(g).select("row_id", "fold", "role", *some)
    hot = [r.entity for r in g.groupBy("entity").count().orderBy("entity").limit(3).collect()]
    for chosen in ([], hot):
        part = history.fold_isolated(g, columns=some, hot=chosen)
        assert not set(part.columns) & (set(history.FEATURES) - set(some))
        diff = history.history_diff(part.select(*whole.columns), whole, ["row_id", "fold"], some)
        assert diff.count() == whole.count() and diff.filter("changed").count() == 0
