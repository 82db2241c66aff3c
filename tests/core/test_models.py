"""Models held against plain computations: a Newton fit in numpy, brute-force ranks, permutations walked one by one."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pitpanel.operators import attribution as A
from pitpanel.operators import metrics as M
from pitpanel.operators import models as ML
from pitpanel.operators import reports as R

FEATURES = ["x1", "x2", "x3"]


def table(n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x = [r.gauss(0, 1), r.gauss(5, 3), float(r.randint(0, 4))]
        y = int(r.random() < 1 / (1 + math.exp(-(1.2 * x[0] - 0.4 * (x[1] - 5) + 0.3 * x[2]))))
        rows.append((i, y, None if r.random() < 0.1 else x[0], x[1], x[2], i % 3 + 1))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(table(), "row_id long, label int, x1 double, x2 double, x3 double, inner_fold int").repartition(3).cache()


def newton(train, valid, c):
    """Median, standardise (sample deviation), penalty 1 / (2 c n) times the squared weights, intercept free."""
    x = np.array([[np.nan if v is None else v for v in r[2:5]] for r in train])
    median = np.array([np.sort(col[~np.isnan(col)])[(np.sum(~np.isnan(col)) - 1) // 2] for col in x.T])
    fill = lambda a: np.where(np.isnan(a), median, a)
    x = fill(x)
    mean, std = x.mean(0), x.std(0, ddof=1)
    design = lambda a: np.hstack([np.ones((len(a), 1)), (a - mean) / std])
    a, y, w = design(x), np.array([r[1] for r in train], float), np.zeros(4)
    ridge = np.diag([0, 1, 1, 1]) / (c * len(a))
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) / len(a) + ridge, a.T @ (p - y) / len(a) + ridge @ w)
    other = design(fill(np.array([[np.nan if v is None else v for v in r[2:5]] for r in valid])))
    return 1 / (1 + np.exp(-other @ w))


def plain_auc(y, p):
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def plain_composite(y, p):
    bins = {}
    for a, b in zip(y, p):
        bins.setdefault(min(int(b * 10), 9), []).append((a, b))
    ece = sum(abs(sum(a - b for a, b in v)) for v in bins.values()) / len(y)
    return 0.5 * (1 - plain_auc(y, p)) + 0.25 * sum((a - b) ** 2 for a, b in zip(y, p)) / len(y) + 0.25 * ece


@pytest.mark.parametrize("c", [0.01, 1.0, 100.0])
def test_logistic_equals_a_newton_fit(data, c):
    rows = table()
    train, valid = [r for r in rows if r[5] < 3], [r for r in rows if r[5] == 3]
    got = {r.row_id: r.p for r in ML.fit_logistic(data.filter("inner_fold < 3"), data.filter("inner_fold = 3"), FEATURES, c).collect()}
    want = newton(train, valid, c)
    assert max(abs(got[r[0]] - p) for r, p in zip(valid, want)) < 2e-3
    scored = data.sparkSession.createDataFrame([(r[0], r[1], float(got[r[0]])) for r in valid], "row_id long, y int, p double")
    auc = M.auc_ap(scored).first().auc
    assert auc == pytest.approx(plain_auc([r[1] for r in valid], [got[r[0]] for r in valid])) and auc > 0.7


def test_search_over_nine_penalties_equals_plain_scores(data):
    grid = [10.0**k for k in range(-4, 5)]
    got = {r.c: r for r in ML.search_c(data, FEATURES, grid).collect()}
    rows = table()
    want = {}
    for c in grid:
        parts = []
        for f in (1, 2, 3):
            train, valid = [r for r in rows if r[5] != f], [r for r in rows if r[5] == f]
            parts.append(plain_composite([r[1] for r in valid], newton(train, valid, c)))
        want[c] = sum(parts) / 3
    assert got.keys() == want.keys() and sorted(r.rank for r in got.values()) == list(range(1, 10))
    for c in grid:  # a score near the edge of a bin may fall to its other side
        assert got[c].mean_score == pytest.approx(want[c], abs=6e-3)
    best = min(got.values(), key=lambda r: (r.mean_score, r.c))
    assert best.rank == 1 and want[best.c] <= min(want.values()) + 6e-3


def test_trees_learn_what_a_line_cannot(spark):
    r = random.Random(3)
    rows = [(i, int((a > 0) != (b > 0)), a, b, None if r.random() < 0.05 else a * 0) for i in range(600) for a, b in [(r.uniform(-1, 1), r.uniform(-1, 1))]]
    t = spark.createDataFrame(rows, "row_id long, label int, x1 double, x2 double, x3 double")
    train, valid = t.filter("row_id % 2 = 0"), t.filter("row_id % 2 = 1")
    scored = ML.fit_score(train, valid, FEATURES).cache()
    auc = {x.model: x.auc for x in M.auc_ap(scored, ["model"]).collect()}
    assert auc.keys() == {"gbt_deep", "gbt_shallow", "gbt_sampled", "forest", "vote"}
    assert min(auc[m] for m in ("gbt_deep", "forest", "vote")) > 0.9
    assert M.auc_ap(ML.fit_logistic(train, valid, FEATURES)).first().auc < 0.65
    by_row = {}
    for x in scored.collect():
        by_row.setdefault(x.row_id, {})[x.model] = x.p
    assert len(by_row) == 300 and all(abs(v.pop("vote") - sum(v.values()) / 4) < 1e-9 for v in by_row.values())


def test_random_search_ranks_seeded_candidates(data):
    drawn = ML.candidates(3)
    assert drawn == ML.candidates(5)[:3] and drawn != ML.candidates(3, seed=7)
    for c in ML.candidates(200):
        assert all(low <= c[k] <= high for k, (low, high, _) in ML.SPACE.items())
    out = sorted(ML.random_search(data, FEATURES, 2).collect(), key=lambda r: r.candidate)
    assert [r.depth for r in out] == [float(c["depth"]) for c in drawn[:2]] and sorted(r.rank for r in out) == [1, 2]
    assert out[0].rank == (1 if out[0].mean_score <= out[1].mean_score else 2) and all(0 < r.mean_score < 0.5 for r in out)


def test_attributions_equal_permutations_walked_one_by_one(data):
    import hashlib

    a = ML._prepare(data, FEATURES)
    fitted = ML.logistic(FEATURES, 1.0, 400).fit(a)
    predict = lambda t: fitted.transform(t).withColumn("p", vector_to_array("probability")[1])
    some, back = a.filter("row_id < 6"), a.filter("row_id >= 390").select(*FEATURES)
    got = {(r.row_id, r.feature): r for r in ML.permutation_shap(predict, some, back, FEATURES).collect()}
    background = [tuple(r) for r in back.collect()]

    def value(x, chosen):
        mixed = [tuple(x[k] if f in chosen else b[k] for k, f in enumerate(FEATURES)) for b in background]
        t = data.sparkSession.createDataFrame([(i, *m) for i, m in enumerate(mixed)], "row_id long, x1 double, x2 double, x3 double")
        return predict(t).agg(F.avg("p")).first()[0]

    for row in some.filter("row_id < 2").collect():
        x = [row[f] for f in FEATURES]
        order = sorted(FEATURES, key=lambda f: hashlib.md5(f"42:{row.row_id}:{f}".encode()).hexdigest())
        phi = dict.fromkeys(FEATURES, 0.0)
        for walk in (order, order[::-1]):
            for k, f in enumerate(walk):
                phi[f] += (value(x, set(walk[: k + 1])) - value(x, set(walk[:k]))) / 2
        for f in FEATURES:
            assert got[row.row_id, f].phi == pytest.approx(phi[f], abs=1e-9)
    imp = {r.feature: r for r in R.importance(data.sparkSession.createDataFrame([(1, r.feature, r.phi) for r in got.values()], "fold int, feature string, phi double")).collect()}
    for f in FEATURES:
        own = [r.phi for (_, g), r in got.items() if g == f]
        assert imp[f].mean_abs == pytest.approx(np.mean(np.abs(own))) and imp[f].mean_signed == pytest.approx(np.mean(own))
    assert sorted(r.rank for r in imp.values()) == [1, 2, 3]


def test_a_feature_without_training_values(spark):
    """Neither a logistic model nor the trees fail on it, and later rows' values of it change no score."""
    rows = [(i, i % 2, float(i % 2) + (i % 7) / 10, None if i < 60 else float(i), 1.0 if i < 60 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, label int, x1 double, x2 double, x3 double")
    train, valid = df.filter("row_id < 60"), df.filter("row_id >= 60")
    columns = ["x1", "x2", "x3"]
    p = lambda t: {(r["model"], r["row_id"]): round(r["p"], 9) for r in t.collect()}
    got = p(ML.fit_logistic(train, valid, columns))
    assert len(got) == 20 and got == p(ML.fit_logistic(train, valid.withColumn("x2", F.lit(None).cast("double")), columns))
    assert all((v > 0.5) == (k[1] % 2 == 1) for k, v in got.items())
    trees = p(ML.fit_score(train, valid, columns, depth=2, rounds=2))
    assert len(trees) == 100 and all((v > 0.5) == (k[1] % 2 == 1) for k, v in trees.items() if k[0] == "vote")
    vote = A.fit(train, columns, depth=2, rounds=2)
    other = vote.scores(np.array([[0.1, 70.0, np.nan], [1.1, np.nan, np.nan]]))["vote"]
    assert other[0] < 0.5 < other[1]


def test_a_fold_is_prepared_once_for_all_penalties(data, monkeypatch):
    fitted = []
    plain = ML.StandardScaler.fit
    monkeypatch.setattr(ML.StandardScaler, "fit", lambda self, df, *a: fitted.append(1) or plain(self, df, *a))
    ML.search_c(data, FEATURES, [0.1, 1.0])
    assert len(fitted) == 3


def test_a_search_leaves_no_tables_behind(data):
    import os

    from pitpanel.sources import io

    made = []
    keep = lambda df: made.append(io.kept(df, "search")) or made[-1]
    out = ML.search_c(data, FEATURES, [0.1, 1.0], keep=keep)
    assert len(made) == 7 and not any(os.path.exists(t.kept_at.removeprefix("file://")) for t in made)
    assert sorted(r["rank"] for r in out.collect()) == [1, 2]
    assert data.sparkSession.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_known_medians_are_not_found_again(data, monkeypatch):
    train, valid = data.filter("inner_fold < 3"), data.filter("inner_fold = 3")
    known = ML.medians_of(train, FEATURES)
    p = lambda t: {r.row_id: r.p for r in t.collect()}
    want = p(ML.fit_logistic(train, valid, FEATURES[:2]))
    monkeypatch.setattr(ML.Medians, "_fit", lambda *a: pytest.fail("medians were found again"))
    assert p(ML.fit_logistic(train, valid, FEATURES[:2], medians=known)) == pytest.approx(want, abs=1e-9)
