"""Model queries; results are held against invariants, since other learners give other numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import features as X
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import reports as R
from ..operators import scan, splits
from ..sources import io
from ..sources.fixtures import PANEL, panel
from .feature_queries import COLUMNS, matrix
from .panel_queries import _ENTITY, TRAIN, VALID, rounded
from .registry import query

HISTORY = ["prev_ab_YearMonthIndex_mean", "prev_ab_all_label_mean", "prev_ab_all_label_sum", "other_test_Test_id_count", "other_test_Label_mean"]
FEATURES = ["amount", "ym_index", *HISTORY]
_COUNT = f"WITH {PANEL}, v AS (SELECT count(*) AS n FROM panel WHERE period // 100 BETWEEN 2000 AND 2001)"


def _keep(spark):
    """Write a table into the shared folder and read it back: models read it many times, and a lost executor costs nothing."""

    return lambda df: io.kept(df, "models")


def _temporal(spark, d):
    r = splits.temporal(panel(spark, d), TRAIN, VALID)
    m = _keep(spark)(H.fold_history(r, r.filter("role = 'train'")).select("row_id", "entity", "label", "role", *FEATURES))
    return m.filter("role = 'train'"), m.filter("role = 'valid'")


@query(f"WITH {PANEL} SELECT row_id, label, round((SELECT avg(label) FROM panel WHERE period // 100 BETWEEN 1995 AND 1999), 6) AS p FROM panel WHERE period // 100 BETWEEN 2000 AND 2001")
def prior_baseline(spark, d):
    r = splits.temporal(panel(spark, d), TRAIN, VALID)
    return rounded(ML.prevalence(r.filter("role = 'train'"), r.filter("role = 'valid'")))


def _summary(scored, groups=("model",)):
    """Per model (or ``groups``): rows and scores outside 0..1."""
    return scored.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("p").between(0, 1) | F.isnan("p")).alias("bad"))


@query(_COUNT + " SELECT 'logistic' AS model, n, CAST(0 AS BIGINT) AS bad FROM v")
def logistic_cv(spark, d):
    """Median, scale and logistic regression from training years, scores for the later ones."""
    return _summary(ML.fit_logistic(*_temporal(spark, d), FEATURES))


@query("SELECT CAST(3 AS BIGINT) AS candidates, CAST(0 AS BIGINT) AS unscored, CAST(1 AS BIGINT) AS best")
def c_search(spark, d):
    """Nested search of the penalty over inner folds of the training years."""
    train, _ = _temporal(spark, d)
    out = ML.search_c(splits.stratified(train, 3, 43, "inner_fold"), FEATURES, [0.01, 0.1, 1.0], keep=_keep(spark))
    return out.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("mean_score").isNull()).alias("unscored"), F.count_if(F.col("rank") == 1).alias("best"))


@query(_COUNT + ", m(model) AS (VALUES ('gbt_deep'), ('gbt_shallow'), ('gbt_sampled'), ('forest'), ('vote')) SELECT model, n, CAST(0 AS BIGINT) AS bad, CAST(0 AS BIGINT) AS off FROM m, v")
def tree_vote(spark, d):
    """Four tree ensembles and their vote; ``off`` counts rows whose vote is not the mean of the members."""
    s = _keep(spark)(ML.fit_score(*_temporal(spark, d), FEATURES))
    mean = s.filter("model <> 'vote'").groupBy("row_id").agg(F.avg("p").alias("m"))
    off = s.filter("model = 'vote'").join(mean, "row_id").agg(F.count_if(F.abs(F.col("p") - F.col("m")) > 1e-9).alias("off"))
    return _summary(s).join(F.broadcast(off))


@query(_COUNT + ", m(condition) AS (VALUES ('A'), ('B'), ('D'), ('no_opposite')) SELECT condition, n, CAST(0 AS BIGINT) AS bad FROM m, v")
def ablation(spark, d):
    """Refits with stepwise feature sets and without one group."""
    train, valid = _temporal(spark, d)
    sets = {"A": ["amount"], "B": ["amount", "ym_index"], "D": FEATURES, "no_opposite": [c for c in FEATURES if not c.startswith("other_")]}
    out = None
    for name, columns in sets.items():
        s = _summary(ML.fit_logistic(train, valid, columns)).select(F.lit(name).alias("condition"), "n", "bad")
        out = s if out is None else out.unionByName(s)
    return out


def _factorial(spark, d, folds):
    """Scores of each fold's unseen entities, without history and with their own.

    An entity is whole on one side of every fold, so no fold changes its history: one pass makes it for both sides, all folds and conditions.
    """
    p = panel(spark, d)
    g = splits.grouped(p)
    h = io.kept(H.fold_history(g, g, hot=scan.hot_values(p)).select("row_id", "label", "fold", *FEATURES), "models", ["fold"])
    tasks = []
    for fold in folds:
        a, b = h.filter(F.col("fold") != fold), h.filter(F.col("fold") == fold)
        for name, columns in (("no_history", ["amount", "ym_index"]), ("self_history", FEATURES)):
            tasks.append(lambda a=a, b=b, c=columns, f=fold, n=name: ML.fit_logistic(a, b, c).withColumns({"fold": F.lit(f), "condition": F.lit(n)}))
    return reduce(DataFrame.unionByName, ML._at_once(tasks, ML.side_by_side(h.count(), 4)))


@query(
    f"""WITH {PANEL}, ent AS (SELECT entity, CAST((row_number() OVER (ORDER BY pos DESC, n DESC, md5('42:' || entity), entity) - 1) % 10 AS INT) AS z FROM (SELECT entity, sum(label) AS pos, count(*) AS n FROM panel GROUP BY entity)),
    v AS (SELECT count(*) AS n FROM panel JOIN ent USING (entity) WHERE z IN (0, 9)), m(condition) AS (VALUES ('no_history'), ('self_history')) SELECT condition, n, CAST(0 AS BIGINT) AS bad FROM m, v"""
)
def factorial(spark, d):
    """Unseen entities: without history, and with the validation rows' own earlier records."""
    scored = _factorial(spark, d, [1])
    return _summary(scored, ["condition"])


@query(
    f"""WITH {PANEL}{_ENTITY}, v AS (SELECT CAST(fold AS INT) AS fold, count(*) AS n FROM g GROUP BY ALL), m(condition) AS (VALUES ('no_history'), ('self_history'))
    SELECT fold, condition, n, CAST(0 AS BIGINT) AS bad FROM m, v"""
)
def factorial_all(spark, d):
    """``factorial`` with each of the five folds fitted and scored."""
    return _summary(_factorial(spark, d, range(1, 6)), ["fold", "condition"])


@query(_COUNT + " SELECT CAST(least(n, 50) AS BIGINT) AS n, CAST(0 AS BIGINT) AS off FROM v")
def shap_additivity(spark, d):
    """Permutation attributions of a sample of validation rows: the sum over features is the score less the background's."""
    from pyspark.ml.functions import vector_to_array

    train, valid = _temporal(spark, d)
    columns = ["amount", "ym_index", "prev_ab_all_label_mean"]
    a = ML._prepare(train, columns)
    fitted = ML.logistic(columns, 1.0, a.count()).fit(a)
    predict = lambda t: fitted.transform(t).withColumn("p", vector_to_array("probability")[1])
    rows, background = splits.sample(ML._prepare(valid, columns), 50), splits.sample(a, 20).select(*columns)
    phi = ML.permutation_shap(predict, rows, background, columns)
    per = phi.groupBy("row_id").agg(F.sum("phi").alias("s"), F.max("fx").alias("fx"), F.max("base").alias("base"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("s") - (F.col("fx") - F.col("base"))) > 1e-9).alias("off"))


# ---------------------------------------------------------------- whole evaluations; tests/core/test_models.py holds the operators against plain computations

#: The penalties of the nested search (fixed values).
PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 1e1, 1e2, 1e3, 1e4)


def _folds(spark, d, columns=FEATURES):
    """Records of every outer fold with their role there and histories from its training rows; a fold's side is read from files of its own."""
    p = panel(spark, d)
    made = H.fold_isolated(splits.stratified(p), hot=scan.hot_values(p), columns=columns)
    return io.kept(made.select("row_id", "entity", "label", "fold", "role", *columns), "models", ["fold", "role"])


@query()
def c_search_nine(spark, d):
    """outer_fold, c, mean_score, rank: the nested search over nine penalties and three inner folds of every outer fold's training rows."""
    h, keep = _folds(spark, d), _keep(spark)

    def one(fold: int) -> DataFrame:
        train = splits.stratified(h.filter((F.col("fold") == fold) & (F.col("role") == "train")), 3, 43, "inner_fold")
        return ML.search_c(train, FEATURES, PENALTIES, parallelism=4, keep=keep).select(F.lit(fold).alias("outer_fold"), "c", "mean_score", "rank")

    with io.without_leftovers(spark):
        return rounded(reduce(DataFrame.unionByName, ML._at_once([lambda f=f: one(f) for f in range(1, 6)], 2)))


@query()
def random_search(spark, d):
    """Seeded random settings of a boosted ensemble over inner folds of the training years."""
    train, _ = _temporal(spark, d)
    return rounded(ML.random_search(splits.stratified(train, 3, 43, "inner_fold"), FEATURES, 4, keep=_keep(spark)))


@query()
def outer_evaluation(spark, d):
    """fold, model and metrics of four tree ensembles and their vote, fitted on every outer fold's training rows, by way of the prediction sink; fails if a score is not finite."""
    h, path = _folds(spark, d), io.scratch(spark, "outer")
    finite = F.assert_true(F.col("p").isNotNull() & ~F.isnan("p") & F.col("p").between(0, 1), "a score is not a probability").isNull()
    for fold in range(1, 6):
        a, b = (h.filter((F.col("fold") == fold) & (F.col("role") == r)) for r in ("train", "valid"))
        scored = ML.fit_score(a, b, FEATURES, keep=_keep(spark), depth=3, rounds=5).withColumn("fold", F.lit(fold))
        io.write_predictions(scored.filter(finite), path, ["fold", "model"], deal=False, mode="append")
    return rounded(M.metric_vector(io.read_folds(spark, path), ["fold", "model"]))


@query()
def ablation_matrix(spark, d):
    """condition and metrics: the logistic model refitted on stepwise sets, without each group, and on the time variants of the whole matrix."""
    r = splits.temporal(panel(spark, d), TRAIN, VALID)
    train = r.filter("role = 'train'")
    m = _keep(spark)(matrix(spark, d, r, train, train))
    sets = {k: (m, c) for k, c in X.variants(COLUMNS).items()} | {f"time_{k}": v for k, v in X.time_variants(m, COLUMNS).items()}
    # all conditions have the same training rows, so a column's median is found once, whatever reads it
    gaps, own = sets["time_relative_time"]
    medians = ML.medians_of(m.filter("role = 'train'"), COLUMNS)
    medians |= ML.medians_of(gaps.filter("role = 'train'"), [c for c in own if c not in medians])
    tasks = [lambda k=k, t=t, c=c: ML.fit_logistic(t.filter("role = 'train'"), t.filter("role = 'valid'"), c, medians=medians).withColumn("condition", F.lit(k)) for k, (t, c) in sets.items()]
    return rounded(M.metric_vector(_keep(spark)(reduce(DataFrame.unionByName, ML._at_once(tasks, 4))), ["condition"]))


@query()
def factorial_metrics(spark, d):
    """fold, condition and metrics of the factorial: entities unseen in training, without history and with their own earlier records."""
    return rounded(M.metric_vector(_keep(spark)(_factorial(spark, d, range(1, 6))), ["fold", "condition"]))


@query()
def shap_importance(spark, d):
    """fold, feature, mean_abs, mean_signed, rank: attributions of 2,000 validation rows against 100 training rows in every outer fold."""
    from pyspark.ml.functions import vector_to_array

    h, out = _folds(spark, d), []
    for fold in range(1, 6):
        a, b = (ML._prepare(h.filter((F.col("fold") == fold) & (F.col("role") == r)), FEATURES) for r in ("train", "valid"))
        fitted = ML.logistic(FEATURES, 1.0, a.count()).fit(a)
        predict = lambda t, m=fitted: m.transform(t).withColumn("p", vector_to_array("probability")[1])
        phi = ML.permutation_shap(predict, splits.sample(b, 2000), splits.sample(a, 100).select(*FEATURES), FEATURES)
        out.append(phi.withColumn("fold", F.lit(fold)))
    return rounded(R.importance(_keep(spark)(reduce(DataFrame.unionByName, out))))
