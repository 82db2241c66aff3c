"""Queries over all folds and all replicates: against their SQL, and against the queries of one fold."""

import duckdb
import pytest

import __spark_entry__ as E

FOLDER = "/root/testdata/sf0.001"


def equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    out = E.queries()[name](spark, FOLDER)
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({E.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((v is None, v) for v in r)
    got, want = sorted(map(tuple, out.collect()), key=key), sorted(want, key=key)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6), (a, b)
    return [dict(zip(out.columns, r, strict=True)) for r in got]


@pytest.mark.parametrize("name", ["hist_self_valid", "missing_count_swap"])
def test_all_folds_and_the_first_as_before(spark, name):
    rows = equals_its_sql(spark, name + "_all")
    assert {r["fold"] for r in rows} == {1, 2, 3, 4, 5}
    one = {r["row_id"]: r for r in rows if r.pop("fold") == 1}
    assert one == {r.row_id: r.asDict() for r in E.queries()[name](spark, FOLDER).collect()}


def test_self_history_of_every_row(spark):
    rows = E.queries()["hist_self_valid_all"](spark, FOLDER)
    assert rows.count() == rows.select("row_id").distinct().count() == spark.read.parquet(f"{FOLDER}/orders.parquet").count()


def test_factorial_scores_every_fold(spark):
    assert {(r["fold"], r["condition"]) for r in equals_its_sql(spark, "factorial_all")} == {(f, c) for f in range(1, 6) for c in ("no_history", "self_history")}


@pytest.mark.parametrize("name", ["bootstrap_weights_500", "bootstrap_weighted_auc_ap_500", "bootstrap_summary_500"])
def test_bootstrap_draws_five_hundred_replicates(spark, name):
    rows = equals_its_sql(spark, name)
    if "replicate" in rows[0]:
        assert {r["replicate"] for r in rows} == set(range(1, 501))
    else:
        assert all(r["low"] < r["mean"] < r["high"] for r in rows)


def test_bootstrap_default_is_the_references(spark):
    from pitpanel.operators import metrics

    assert metrics.poisson_weights(spark.createDataFrame([(1,)], "entity long")).count() == 500
