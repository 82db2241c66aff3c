"""Weighted AUC and average precision against a loop over replicates."""

import random

import pytest
from pyspark.sql import functions as F

from pitpanel.operators import bootstrap as B
from pitpanel.operators import metrics as M

SCHEMA = "row_id string, entity string, model string, y int, p double"


def rows(n, kind, seed=1):
    rnd = random.Random(seed)
    draw = {"distinct": rnd.random, "ties": lambda: rnd.randrange(7) / 10, "hot": lambda: 0.25 if rnd.random() < 0.5 else rnd.random(), "one": lambda: 0.5}[kind]
    return [(f"r{i}", f"e{rnd.randrange(40)}", rnd.choice(["m1", "m2"]), int(rnd.random() < 0.3), draw()) for i in range(n)]


def loop(data, weights, replicates):
    out = {}
    for m in {r[2] for r in data}:
        for k in range(1, replicates + 1):
            own = [(p, y, weights[e][k - 1]) for _, e, model, y, p in data if model == m and p is not None and weights[e][k - 1]]
            pos, neg = sum(w for _, y, w in own if y), sum(w for _, y, w in own if not y)
            if not own:
                continue
            area, step = 0.0, 0.0
            for q in {p for p, *_ in own}:
                a, b = (sum(w for p, y, w in own if p == q and y == v) for v in (1, 0))
                area += a * (sum(w for p, y, w in own if p < q and not y) + b / 2)
                tp, fp = (sum(w for p, y, w in own if p >= q and y == v) for v in (1, 0))
                step += a * tp / (tp + fp)
            out[k, m] = (area / (pos * neg) if pos * neg else None, step / pos if pos else None)
    return out


@pytest.mark.parametrize("kind", ["distinct", "ties", "hot", "one"])
def test_equals_a_loop(spark, monkeypatch, kind):
    monkeypatch.setattr(B, "BLOCK", 16)
    data = rows(500, kind) + [("n", "e1", "m1", 1, None)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    arrays = B.weight_arrays(df, 13)
    held = {r["entity"]: r["w"] for r in arrays.collect()}
    got = {(r["replicate"], r["model"]): (r["auc"], r["average_precision"]) for r in B.weighted_auc_ap(df, arrays).collect()}
    want = loop(data, held, 13)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert all(a == b or abs(a - b) < 1e-9 for a, b in zip(got[k], v, strict=True)), (k, got[k], v)


def test_unit_weights_give_the_plain_metrics(spark):
    df = spark.createDataFrame(rows(400, "ties", 3), SCHEMA)
    ones = df.select("entity").distinct().withColumn("w", F.expr("array(1Y, 1Y)"))
    plain = {r["model"]: (r["auc"], r["average_precision"]) for r in M.auc_ap(df, ["model"]).collect()}
    for r in B.weighted_auc_ap(df, ones).collect():
        assert abs(r["auc"] - plain[r["model"]][0]) < 1e-12 and abs(r["average_precision"] - plain[r["model"]][1]) < 1e-12


def test_few_rows_and_missing_labels(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert B.weighted_auc_ap(empty, B.weight_arrays(empty, 5)).count() == 0
    one = spark.createDataFrame([("a", "e", "m", 1, 0.5)], SCHEMA)
    got = B.weighted_auc_ap(one, one.select("entity", F.expr("array(2Y, 0Y)").alias("w"))).collect()
    assert [tuple(r) for r in got] == [(1, "m", None, 1.0)]


def test_weights_are_one_row_for_each_entity(spark):
    """Replicates are places of an array: the pairs that are joined with it are not multiplied."""
    df = spark.createDataFrame(rows(300, "distinct"), SCHEMA)
    entities = df.select("entity").distinct().count()
    arrays = B.weight_arrays(df, 500)
    assert arrays.count() == entities and {r["n"] for r in arrays.select(F.size("w").alias("n")).collect()} == {500}
    flat = {(r["entity"], r["replicate"]): r["w"] for r in M.poisson_weights(df, 5).collect()}
    assert len(flat) == 5 * entities and all(flat[r["entity"], k + 1] == r["w"][k] for r in arrays.collect() for k in range(5))


def test_more_records_make_more_ranges_not_larger_ones(spark, monkeypatch):
    monkeypatch.setattr(B, "ROWS", 10)
    sizes, inner = [], B.ranks.with_bucket
    monkeypatch.setattr(B.ranks, "with_bucket", lambda df, name, column, cuts: sizes.append(len(cuts)) or inner(df, name, column, cuts))
    for n in (500, 2000):
        df = spark.createDataFrame(rows(n, "distinct"), SCHEMA)
        B.weighted_auc_ap(df, B.weight_arrays(df, 3))
    assert sizes == [63, 199]
