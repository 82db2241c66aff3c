"""Models on Spark ML over feature tables (row_id, label, …): baselines, logistic regression, tree ensembles, their vote.

Everything is fitted on training rows only, medians and scales included.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from threading import Lock
from typing import TypeVar

from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import io
from .metrics import metric_vector

T = TypeVar("T")


def prevalence(train: DataFrame, valid: DataFrame) -> DataFrame:
    """row_id, label, p: the training rate for every validation row."""
    return valid.select("row_id", "label").join(F.broadcast(train.agg(F.avg("label").alias("p"))))


def _prepare(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys`` and doubles, with an indicator for each column that may be missing: trees read it, medians fill the rest."""
    gaps = [F.col(c).isNull().cast("double").alias("na_" + c) for c in features]
    return df.select("row_id", *keys, F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in features], *gaps)


class Filled(Transformer):
    """Adds ``<feature>_filled``: the feature, or its median where it is null or NaN; 0 where there is no median."""

    def __init__(self, medians: dict[str, float | None]):
        super().__init__()
        self.medians = medians

    def _transform(self, df: DataFrame) -> DataFrame:
        null = F.lit(None).cast("double")
        return df.withColumns({c + "_filled": F.lit(0.0) if m is None else F.coalesce(F.nanvl(F.col(c), null), F.lit(m)) for c, m in self.medians.items()})


class Medians(Estimator):
    """Medians (relative error 0.001) of all features in one pass.

    A feature without a value in the training rows is 0 everywhere: a constant, which
    no model learns from. Spark's ``Imputer`` refuses such a column.
    """

    def __init__(self, features: Sequence[str]):
        super().__init__()
        self.features = list(features)

    def _fit(self, df: DataFrame) -> Filled:
        value = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
        return Filled(df.agg(*[F.percentile_approx(value(c), 0.5, 1000).alias(c) for c in self.features]).first().asDict())


def _stages(features: Sequence[str], indicators: bool, medians: dict[str, float | None] | None = None):
    filled = [c + "_filled" for c in features]
    fill = Medians(features) if medians is None else Filled({c: medians[c] for c in features})
    return fill, VectorAssembler(inputCols=filled + (["na_" + c for c in features] if indicators else []), outputCol="raw")


def logistic(features: Sequence[str], c: float, n: int, medians: dict[str, float | None] | None = None) -> Pipeline:
    """Median (those of the training rows, if they are known), standardise, penalised logistic regression: ``c`` as in 1 / (c * n) per row."""
    fill, assemble = _stages(features, False, medians)
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[fill, assemble, scale, _penalised(c, n)])


def _penalised(c: float, n: int) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=50)


def members(seed: int = 42, depth: int = 4, rounds: int = 8) -> dict[str, object]:
    """Four differently set tree ensembles."""
    gbt = lambda **kw: GBTClassifier(featuresCol="raw", labelCol="label", seed=seed, **kw)
    return {
        "gbt_deep": gbt(maxDepth=depth, maxIter=rounds, stepSize=0.1),
        "gbt_shallow": gbt(maxDepth=2, maxIter=rounds + 4, stepSize=0.2),
        "gbt_sampled": gbt(maxDepth=depth, maxIter=rounds, stepSize=0.1, subsamplingRate=0.7, featureSubsetStrategy="sqrt"),
        "forest": RandomForestClassifier(featuresCol="raw", labelCol="label", seed=seed, maxDepth=depth + 2, numTrees=rounds * 2),
    }


def score(model, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).select("row_id", F.col("label").cast("int").alias("y"), F.lit(name).alias("model"), vector_to_array("probability")[1].alias("p"))


def fit_score(
    train: DataFrame, valid: DataFrame, features: Sequence[str], names: Sequence[str] | None = None, parallelism: int = 4, keep: Callable[[DataFrame], DataFrame] | None = None, **settings
) -> DataFrame:
    """row_id, y, model, p on ``valid`` for each tree ensemble and for ``vote``, the mean of their probabilities; ``keep`` as in ``search_c``.

    A row is read once and scored by all of them side by side, so the vote needs no shuffle.
    """
    chosen = {k: m for k, m in members(**settings).items() if names is None or k in names}
    scored = fit_vote(train, features, chosen, parallelism, keep)(valid.select("row_id", "label", *features))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.col(c).alias("p")) for k, c in [*((k, f"p_{k}") for k in chosen), ("vote", "p")]]))
    return scored.select("row_id", F.col("label").cast("int").alias("y"), each.alias("s")).select("row_id", "y", "s.model", "s.p")


def with_indicators(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with its features as doubles and an indicator for each that may be missing."""
    return df.withColumns({**{"na_" + c: F.col(c).isNull().cast("double") for c in features}, **{c: F.col(c).cast("double") for c in features}})


def fit_vote(
    train: DataFrame, features: Sequence[str], chosen: dict[str, object] | None = None, parallelism: int = 4, keep: Callable[[DataFrame], DataFrame] | None = None, **settings
) -> Callable[[DataFrame], DataFrame]:
    """Fits the ensembles on ``train`` and returns what scores a table of features.

    It adds ``p_<member>`` for each ensemble and ``p``, the vote; the features'
    vector is made once for all of them. ``chosen``: the ensembles by name, else
    those of ``members(**settings)``; ``keep`` as in ``search_c``.
    """
    fill, assemble = _stages(features, True)
    a = _prepare(train, features)
    ready = Pipeline(stages=[fill, assemble]).fit(a)
    a = (keep or (lambda df: df))(ready.transform(a).select("row_id", "label", "raw"))
    chosen = members(**settings) if chosen is None else chosen
    if keep:  # what was kept is counted by its files
        parallelism = side_by_side(a.count(), parallelism)
    fitted = dict(zip(chosen, _at_once([lambda m=m: m.fit(a) for m in chosen.values()], parallelism), strict=True))
    for name, m in fitted.items():
        m.setRawPredictionCol(f"__r_{name}").setProbabilityCol(f"__p_{name}").setPredictionCol(f"__c_{name}")

    def scored(df: DataFrame) -> DataFrame:
        out = ready.transform(with_indicators(df, features))
        for name, m in fitted.items():
            out = m.transform(out).withColumn(f"p_{name}", vector_to_array(f"__p_{name}")[1])
        out = out.withColumn("p", reduce(lambda x, y: x + y, [F.col(f"p_{n}") for n in fitted]) / len(fitted))
        return out.select(*df.columns, *[f"p_{n}" for n in fitted], "p")

    return scored


def fit_logistic(train: DataFrame, valid: DataFrame, features: Sequence[str], c: float = 1.0, medians: dict[str, float | None] | None = None) -> DataFrame:
    """row_id, y, model, p on ``valid``; ``medians`` of the training rows, where several fits share them."""
    a = _prepare(train, features)
    return score(logistic(features, c, a.count(), medians).fit(a), _prepare(valid, features), "logistic")


def medians_of(train: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    """What ``Medians`` finds in the training rows, for fits on several sets of their columns."""
    return Medians(features).fit(_prepare(train, features)).medians


#: Training rows up to which several models are fitted side by side. A fit holds its rows in memory; with more of them one fit fills a cluster.
SIDE_BY_SIDE = 4_000_000


def side_by_side(rows: int, parallelism: int) -> int:
    """How many fits on so many rows run at once: ``parallelism`` for small tables, fewer the more rows there are."""
    return max(1, min(parallelism, 4 * SIDE_BY_SIDE // max(rows, 1)))


def _at_once(tasks: Sequence[Callable[[], T]], parallelism: int) -> list[T]:
    """Results in order; so many fits are submitted side by side, since small ones don't fill a cluster."""
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return pool.map(lambda task: task(), tasks)


def _mean_scores(scored: DataFrame, candidate: Sequence[str]) -> DataFrame:
    """candidate and mean_score: the composite, averaged over the inner folds."""
    keys = [*candidate, "fold"]
    v = metric_vector(scored, keys)
    return v.groupBy(*candidate).agg(F.avg("composite").alias("mean_score"))


#: Searches that run side by side fit at once, and score one after the other: the sorted scores are what fills a disk.
_SCORING = Lock()


def search_c(
    train: DataFrame, features: Sequence[str], grid: Sequence[float], inner: str = "inner_fold", k: int = 3, parallelism: int = 4, keep: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """c, mean_score (composite over the inner folds, lower is better), rank; equal scores go to the smaller c.

    ``keep`` (writes a table and reads it back, say) holds the prepared rows and
    the scored ones; without it they are computed as often as they are read. Inner
    folds are fitted side by side and scored one after the other; a fold's tables and
    shuffles go when it is scored, so the disk holds the scores of one at a time.
    """
    keep, spark = keep or (lambda df: df), train.sparkSession
    with io.without_leftovers(spark):
        ready = keep(_prepare(train, features, [inner]))
        sizes = {r[inner]: r["n"] for r in ready.groupBy(inner).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each inner fold

        def one(f: int) -> list[tuple[float, int, float]]:
            fit, check = ready.filter(F.col(inner) != f), ready.filter(F.col(inner) == f)
            # medians and scales don't depend on the penalty
            fill, assemble = _stages(features, False)
            scaled = Pipeline(stages=[fill, assemble, StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)]).fit(fit)
            a, n = keep(scaled.transform(fit).select("label", "features")), sum(m for g, m in sizes.items() if g != f)
            fitted = _at_once([lambda c=c: _penalised(c, n).fit(a) for c in grid], -(-parallelism // min(k, parallelism)))
            with _SCORING:
                scored = keep(_side_by_side_scores(dict(zip(map(float, grid), fitted, strict=True)), scaled.transform(check).select("row_id", "label", "features")))
                found = metric_vector(scored, ["c"]).select("c", "composite").collect()  # a row for each c
                io.release(a, scored)
            return [(r["c"], f, r["composite"]) for r in found]

        found = [x for rows in _at_once([lambda f=f: one(f) for f in range(1, k + 1)], parallelism) for x in rows]
        io.release(ready)
    mean = spark.createDataFrame(found, "c double, fold int, composite double").groupBy("c").agg(F.avg("composite").alias("mean_score"))
    return mean.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy("mean_score", "c")))  # a row for each c


def _side_by_side_scores(fitted: dict[float, object], df: DataFrame) -> DataFrame:
    """c, row_id, y, p: a row is read once and scored by the model of every c."""
    for i, m in enumerate(fitted.values()):
        m.setRawPredictionCol(f"__r{i}").setProbabilityCol(f"__p{i}").setPredictionCol(f"__c{i}")
        df = m.transform(df).drop(f"__r{i}", f"__c{i}")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), vector_to_array(f"__p{i}")[1].alias("p")) for i, c in enumerate(fitted)]))
    return df.select("row_id", F.col("label").cast("int").alias("y"), each.alias("s")).select("s.c", "row_id", "y", "s.p")


#: Ranges that ``random_search`` draws from: low, high, and whether on a log scale.
SPACE = {"depth": (2, 5, False), "rounds": (3, 10, False), "step": (0.03, 0.3, True), "share": (0.6, 1.0, False)}


def candidates(n: int, seed: int = 42, space: dict = SPACE) -> list[dict[str, float]]:
    """``n`` settings drawn at random; the same ones for the same seed, and the first of more."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        one = {}
        for name, (low, high, log) in space.items():
            x = math.exp(draw.uniform(math.log(low), math.log(high))) if log else draw.uniform(low, high)
            one[name] = round(draw.uniform(low - 0.5, high + 0.5)) if isinstance(low, int) else round(x, 6)
        out.append({k: min(max(v, space[k][0]), space[k][1]) for k, v in one.items()})
    return out


def random_search(
    train: DataFrame, features: Sequence[str], n: int = 4, inner: str = "inner_fold", k: int = 3, seed: int = 42, parallelism: int = 4, keep: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """candidate, its settings, mean_score (over the inner folds, lower is better), rank of seeded random settings of a boosted ensemble."""
    keep = keep or (lambda df: df)
    fill, assemble = _stages(features, True)
    drawn = candidates(n, seed)

    def of_fold(f: int) -> tuple[DataFrame, DataFrame]:
        fit, check = (_prepare(train.filter(c), features) for c in (F.col(inner) != f, F.col(inner) == f))
        ready = Pipeline(stages=[fill, assemble]).fit(fit)
        return keep(ready.transform(fit).select("row_id", "label", "raw")), keep(ready.transform(check).select("row_id", "label", "raw"))

    folds = {f: of_fold(f) for f in range(1, k + 1)}

    def one(i: int, f: int) -> DataFrame:
        s = drawn[i]
        model = GBTClassifier(featuresCol="raw", labelCol="label", seed=seed, maxDepth=int(s["depth"]), maxIter=int(s["rounds"]), stepSize=s["step"], subsamplingRate=s["share"])
        return score(model.fit(folds[f][0]), folds[f][1], "gbt").withColumns({"candidate": F.lit(i + 1), "fold": F.lit(f)})

    parts = _at_once([lambda i=i, f=f: one(i, f) for i in range(n) for f in folds], parallelism)
    mean = _mean_scores(keep(reduce(DataFrame.unionByName, parts)), ["candidate"])
    settings = F.element_at(F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in s.items()]) for s in drawn]), F.col("candidate"))
    mean = mean.withColumn("s", settings).withColumn("rank", F.row_number().over(Window.partitionBy().orderBy("mean_score", "candidate")))  # a row for each candidate
    return mean.select("candidate", "s.*", "mean_score", "rank")


#: Background rows at most: they are broadcast, and every row meets all of them at every step.
MOST_BACKGROUND = 10_000


def permutation_shap(model: Callable[[DataFrame], DataFrame], rows: DataFrame, background: DataFrame, features: Sequence[str], seed: int = 42, outputs: Sequence[str] = ("p",)) -> DataFrame:
    """row_id, feature, phi, fx, base: attributions along one shuffled order of the features and back; with several outputs ``output`` too.

    ``model`` maps a table of features to one with the columns ``outputs``, so
    several models score each coalition in one pass. ``rows`` and ``background`` are
    samples of stated size; a row takes 2 * features + 1 steps, each the mean over
    the background of the prediction with the features so far taken from the row.
    A row's coalitions are made and averaged in one task, so only its means by step
    are shuffled. The sum of phi is fx - base exactly.
    """
    k = len(features)
    order = F.array_sort(F.array(*[F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row_id").cast("string"), F.lit(f))).alias("h"), F.lit(f).alias("f")) for f in features]))
    held = background.select(*[F.col(f).alias("b_" + f) for f in features]).limit(MOST_BACKGROUND + 1)
    if held.count() > MOST_BACKGROUND:
        raise ValueError(f"more than {MOST_BACKGROUND} background rows")
    base = rows.select("row_id", *features).withColumn("__o", F.transform(order, lambda x: x["f"]))
    # forward: the first s features are the row's; backward: the last 2k - s of the order
    steps = base.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(2 * k)))).join(F.broadcast(held))
    on = lambda f: F.when(F.col("s") <= k, F.array_position("__o", F.lit(f)) <= F.col("s")).otherwise(F.array_position("__o", F.lit(f)) > F.col("s") - k)
    mixed = steps.select("row_id", "s", *[F.when(on(f), F.col(f)).otherwise(F.col("b_" + f)).alias(f) for f in features])
    means = model(mixed).groupBy("row_id", "s").agg(*[F.avg(o).alias(o) for o in outputs])
    w = Window.partitionBy("row_id").orderBy("s")
    whole = Window.partitionBy("row_id")
    held_at = lambda o, at: F.max(F.when(F.col("s") == at, F.col(o))).over(whole)
    walked = [F.struct(F.lit(o).alias("output"), (F.col(o) - F.lag(o).over(w)).alias("d"), held_at(o, k).alias("fx"), held_at(o, 0).alias("base")) for o in outputs]
    each = means.select("row_id", "s", F.array(*walked).alias("z")).select("row_id", "s", F.explode("z").alias("z"))
    each = each.filter("s > 0").join(rows.select("row_id", F.transform(order, lambda x: x["f"]).alias("__o")), "row_id")
    d = each.select("row_id", "z.*", "s", F.element_at("__o", F.when(F.col("s") <= k, F.col("s")).otherwise(F.col("s") - k)).alias("feature"))
    signed = F.when(F.col("s") <= k, F.col("d")).otherwise(-F.col("d"))
    out = d.groupBy("row_id", "output", "feature").agg(F.avg(signed).alias("phi"), F.max("fx").alias("fx"), F.max("base").alias("base"))
    return out.drop("output") if len(outputs) == 1 else out
