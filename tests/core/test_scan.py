"""Two-level scans of hot entities, and as-of merges of a state, against plain loops and theta joins."""

import random

import pytest
from pyspark.sql import functions as F

from pitpanel.operators import history as H
from pitpanel.operators import scan

SCHEMA = "row_id long, entity long, side string, period int, ym_index int, label int"


def rows(n=600, seed=1, sides=("A", "B", None)):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        period = rnd.choice([None, *range(200001, 200190)])
        out.append((i, rnd.choice([7, 7, 1, 2, 3, None]), rnd.choice(sides), period, period and period % 1000 + 24000, rnd.choice([0, 1])))
    return out


def near(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (p is not None and q is not None and abs(p - q) < 1e-6) for p, q in zip(x[1:], y[1:], strict=True)), (x, y)


def ordered(df, *first):
    return sorted((tuple(r) for r in df.select(F.concat_ws("-", *first), *H.FEATURES).collect()), key=lambda r: r[0])


def test_hot_entity_equals_theta_and_one_level(spark):
    p = spark.createDataFrame(rows(), SCHEMA)
    plain = ordered(H.fold_history(p, p, hot=()), "row_id")
    near(ordered(H.fold_history(p, p, hot=[7, 99]), "row_id"), plain)
    near(ordered(H.theta_history(p, p), "row_id"), plain)


def test_hot_entity_by_folds(spark):
    p = spark.createDataFrame(rows(), SCHEMA).withColumn("fold", (F.col("row_id") % 3 + 1).cast("int")).withColumn("fold", F.when(F.col("row_id") % 17 != 0, F.col("fold")))
    near(ordered(H.fold_isolated(p, k=3, hot=[7]), "fold", "row_id", "role"), ordered(H.fold_isolated(p, k=3, hot=()), "fold", "row_id", "role"))
    each = H.explode_folds(p, "fold", 3)
    near(ordered(H.fold_history(each, each.filter("role = 'train'"), ["fold"], hot=[7]), "fold", "row_id", "role"), ordered(H.fold_isolated(p, k=3, hot=[7]), "fold", "row_id", "role"))


def test_hot_values_are_found(spark):
    p = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("entity"))
    assert scan.hot_values(p, least=5000, small=0) == ["hot"]
    assert scan.hot_values(p, small=0) == [] == scan.hot_values(p.limit(0), least=0, small=0)
    assert scan.hot_values(p, least=5000) == []  # one task can hold the whole table


def test_a_hot_entity_runs_in_many_tasks(spark):
    """Its days are dealt over ranges: no window holds more than a part of them."""
    p = spark.range(40_000).select(F.lit(7).alias("entity"), (F.col("id") % 10_000).cast("int").alias("period"), F.lit(1).alias("v"))
    ranged = scan.with_ranges(p, "period")
    sizes = [r["count"] for r in ranged.groupBy("entity", "__range").count().collect()]
    assert len(sizes) == scan.RANGES and max(sizes) < 40_000 / 16
    out = scan.strict_sums(ranged, ["entity"], "period", ["v"], "s_")
    assert out.filter(F.col("s_v") != F.col("period") * 4).count() == 0


def test_sides_are_parameters_and_others_fail(spark):
    p = spark.createDataFrame(rows(200, 2, ("x", "y")), SCHEMA)
    q = p.withColumn("side", F.when(F.col("side") == "x", "A").otherwise("B"))
    for hot in ((), [7]):
        near(ordered(H.fold_history(p, p, sides=("x", "y"), hot=hot), "row_id"), ordered(H.fold_history(q, q, hot=hot), "row_id"))
        folds = lambda t: t.withColumn("fold", (F.col("row_id") % 2 + 1).cast("int"))
        near(ordered(H.fold_isolated(folds(p), k=2, sides=("x", "y"), hot=hot), "fold", "row_id"), ordered(H.fold_isolated(folds(q), k=2, hot=hot), "fold", "row_id"))
        for f in (lambda: H.fold_history(p, p, hot=hot), lambda: H.fold_isolated(folds(p), k=2, hot=hot)):
            with pytest.raises(Exception, match="unknown side"):  # of one stage or of several
                f().collect()


def test_merge_state_equals_a_loop(spark):
    rnd = random.Random(5)
    state = {(e, p): (p * 10 + e, rnd.choice([None, "s"])) for e in (1, 2, 7) for p in rnd.sample(range(100), 30)}
    targets = [(i, rnd.choice([1, 2, 7, 7, 8, None]), rnd.choice([None, *range(-5, 110)]), "old") for i in range(400)]
    s = spark.createDataFrame([(*k, *v) for k, v in state.items()] + [(None, 3, 9, "n"), (1, None, 9, "n")], "entity long, period int, v long, w string")
    t = spark.createDataFrame(targets, "row_id long, entity long, period int, w string")

    def last(e, p):
        found = [q for (f, q) in state if f == e and p is not None and q < p]
        return state[e, max(found)] if found else (None, None)

    want = [(i, e, p, *last(e, p)) for i, e, p, _ in targets]
    for hot in ((), [7], [1, 2, 7, 8]):
        assert sorted(tuple(r) for r in H.merge_state(t, s, hot=hot).select("row_id", "entity", "period", "v", "w").collect()) == want
    assert H.merge_state(t, s.limit(0), hot=[7]).filter("v is not null").count() == 0
