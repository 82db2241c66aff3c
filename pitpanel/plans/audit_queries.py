"""Audits of nested splits, of saved tables and their verdict, clean and with faults put in that must be found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import history as H
from ..operators import metrics as M
from ..operators import ranks
from ..operators import reports as R
from ..operators import scan, splits
from ..sources import io
from ..sources.fixtures import IMPORTANCE, PANEL, SCORED, importance, panel, scored_long
from .feature_queries import COLUMNS
from .panel_queries import CHAIN, TRAIN, VALID, _ENTITY, _FOLDS, _ROLE, rounded
from .registry import query
from .scored_queries import _SUMMARY, _summary, _topk, _vector


def _nested(spark, d, scheme: str) -> tuple[DataFrame, DataFrame]:
    """(outer, inner) of one scheme in the form that the audit takes."""
    p = panel(spark, d)
    if scheme == "temporal":
        r = splits.temporal(p, TRAIN, VALID)
        inner = splits.forward_chain(r.filter("role = 'train'").drop("role"), CHAIN)
        one = F.lit(1).alias("outer_fold")
        return r.select(one, "row_id", "role"), inner.select(one, "inner_fold", "row_id", "entity", "period", "role")
    folds = splits.grouped(p) if scheme == "group" else splits.stratified(p)
    outer = H.explode_folds(folds, "fold", 5).select(F.col("fold").alias("outer_fold"), "row_id", "role")
    inner = splits.inner_roles(splits.inner(folds, group=scheme == "group"))
    return outer, inner.select("outer_fold", "inner_fold", "row_id", "entity", "period", "role")


def _packed(spark, d, scheme: str) -> tuple[DataFrame, list]:
    """What ``_nested`` gives, every row once with a bit for each fold it is in; made once."""
    p = panel(spark, d).select("row_id", "entity", "period", "label")
    rows, cells = splits.packed(splits.inner_places(splits.grouped(p) if scheme == "group" else splits.stratified(p), group=scheme == "group"))
    return io.kept(rows, "nested"), cells


_SPLITS = f"""{PANEL}{_FOLDS}, es AS (SELECT d.*, CAST(f AS INT) AS outer_fold FROM d, range(1, 6) r(f) WHERE f <> own),
 si AS (SELECT outer_fold, row_id, entity, CAST((row_number() OVER (PARTITION BY outer_fold, label ORDER BY md5('43:' || row_id), row_id) - 1) % 3 + 1 AS INT) AS own FROM es){_ENTITY},
 eg AS (SELECT g.* EXCLUDE fold, CAST(f AS INT) AS outer_fold FROM g, range(1, 6) r(f) WHERE f <> g.fold),
 ng AS (SELECT outer_fold, entity, sum(label) AS pos, count(*) AS n FROM eg GROUP BY ALL),
 ag AS (SELECT *, (row_number() OVER (PARTITION BY outer_fold ORDER BY pos DESC, n DESC, md5('43:' || entity), entity) - 1) % 6 AS z FROM ng),
 gi AS (SELECT outer_fold, row_id, entity, CAST(CASE WHEN z < 3 THEN z + 1 ELSE 6 - z END AS INT) AS own FROM eg JOIN ag USING (outer_fold, entity)),
 ch(i, a, b, c) AS (VALUES (1, 1995, 1996, 1997), (2, 1995, 1997, 1998), (3, 1995, 1998, 1999)),
 i AS (SELECT 'stratified' AS scheme, outer_fold, CAST(j AS INT) AS inner_fold, row_id, entity, own = j AS v FROM si, range(1, 4) r(j)
   UNION ALL SELECT 'group', outer_fold, CAST(j AS INT), row_id, entity, own = j FROM gi, range(1, 4) r(j)
   UNION ALL SELECT 'temporal', 1, CAST(i AS INT), row_id, entity, period // 100 = c FROM panel JOIN ch ON period // 100 BETWEEN a AND c),
 late AS (SELECT i.scheme, i.outer_fold, i.inner_fold, i.row_id, p.period FROM i JOIN panel p USING (row_id) WHERE NOT v),
 starts AS (SELECT scheme, outer_fold, inner_fold, min(period) AS s FROM i JOIN panel USING (row_id) WHERE v GROUP BY ALL),
 fw AS (SELECT scheme, outer_fold, inner_fold, count(*) FILTER (WHERE period >= s) AS not_forward FROM late JOIN starts USING (scheme, outer_fold, inner_fold) GROUP BY ALL),
 en AS (SELECT scheme, outer_fold, inner_fold, count(*) AS entity_overlap FROM (SELECT scheme, outer_fold, inner_fold, entity FROM i GROUP BY ALL HAVING bool_or(v) AND bool_or(NOT v)) GROUP BY ALL),
 sz AS (SELECT scheme, outer_fold, inner_fold, count(*) FILTER (WHERE NOT v) AS train_rows, count(*) FILTER (WHERE v) AS valid_rows FROM i GROUP BY ALL)"""


@query(
    f"""WITH {_SPLITS} SELECT scheme, outer_fold, inner_fold, train_rows, valid_rows, CAST(0 AS BIGINT) AS row_overlap, coalesce(entity_overlap, 0) AS entity_overlap, CAST(0 AS BIGINT) AS outer_overlap,
    CAST(0 AS BIGINT) AS not_contained, CAST(0 AS BIGINT) AS outer_leakage, coalesce(not_forward, 0) AS not_forward
    FROM sz LEFT JOIN en USING (scheme, outer_fold, inner_fold) LEFT JOIN fw USING (scheme, outer_fold, inner_fold)"""
)
def nested_audit(spark, d):
    """Sizes and violations of all inner folds of three schemes."""
    out = [splits.nested_audit(*_nested(spark, d, "temporal")).withColumn("scheme", F.lit("temporal"))]
    for scheme in ("stratified", "group"):
        rows, cells = _packed(spark, d, scheme)
        out.append(splits.audit_packed(rows, rows, cells).withColumn("scheme", F.lit(scheme)))
    return reduce(DataFrame.unionByName, out)


@query(
    f"""WITH {PANEL}{_ENTITY}, o AS (SELECT row_id, entity, fold AS own FROM g), f AS (SELECT CAST(range AS INT) AS outer_fold FROM range(1, 6))
    SELECT outer_fold, CAST(1 AS INT) AS inner_fold, count(*) FILTER (WHERE own = outer_fold AND row_id % 97 = 0) AS outer_leakage,
      count(*) FILTER (WHERE own = outer_fold AND row_id % 97 = 0 AND row_id % 79 <> 0) + count(*) FILTER (WHERE own <> outer_fold AND row_id % 89 = 0) AS not_contained,
      count(*) FILTER (WHERE own <> outer_fold AND row_id % 83 = 0) AS row_overlap, count(*) FILTER (WHERE own = outer_fold AND row_id % 79 = 0) AS outer_overlap
    FROM o, f GROUP BY outer_fold"""
)
def nested_audit_faults(spark, d):
    """What the audit finds in inner fold 1 when validation rows of the outer fold reach its training rows, rows stand there that the panel lacks, rows stand on both sides, and outer validation rows are training rows too."""
    outer, inner = _nested(spark, d, "group")
    base = panel(spark, d).select("row_id", "entity", "period")
    valid = outer.filter("role = 'valid'").join(base, "row_id")
    one = F.lit(1).alias("inner_fold")
    train = outer.filter("role = 'train'").join(base, "row_id")
    reached = valid.filter("row_id % 97 = 0").select("outer_fold", one, "row_id", "entity", "period", F.lit("train").alias("role"))
    strange = train.filter("row_id % 89 = 0").select("outer_fold", one, (-1 - F.col("row_id")).alias("row_id"), (-1 - F.col("entity")).alias("entity"), "period", F.lit("train").alias("role"))
    both = inner.filter("inner_fold = 1 and row_id % 83 = 0").withColumn("role", F.when(F.col("role") == "valid", "train").otherwise("valid"))
    twice = outer.unionByName(outer.filter("role = 'valid' and row_id % 79 = 0").withColumn("role", F.lit("train")))
    out = splits.nested_audit(twice, reduce(DataFrame.unionByName, [inner, reached, strange, both])).filter("inner_fold = 1")
    return out.select("outer_fold", "inner_fold", "outer_leakage", "not_contained", "row_overlap", "outer_overlap")


@query(
    f"""WITH {PANEL}{_ROLE} SELECT role, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS rate, count(DISTINCT entity) AS entities, CAST({len(COLUMNS)} AS INT) AS features,
    (SELECT count(*) FROM (SELECT entity FROM r GROUP BY entity HAVING count(DISTINCT role) = 2)) AS shared_entities FROM r GROUP BY role"""
)
def split_summary(spark, d):
    """Rows, positives, rate and entities of each role, how many features the matrix of a role has, and how many entities are in both."""
    r = splits.temporal(panel(spark, d), TRAIN, VALID)
    shared = r.groupBy("entity").agg(F.countDistinct("role").alias("c")).agg(F.count_if(F.col("c") > 1).alias("shared_entities"))
    out = r.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.avg("label").alias("rate"), F.countDistinct("entity").alias("entities"))
    return rounded(out.withColumn("features", F.lit(len(COLUMNS))).join(F.broadcast(shared)))


@query(f"WITH {PANEL} SELECT entity FROM panel WHERE period >= 200001 EXCEPT SELECT entity FROM panel WHERE period < 200001")
def subset_test(spark, d):
    """Entities of the later years that the earlier ones lack: empty if they were contained."""
    p = panel(spark, d)
    return R.subset(p.filter("period >= 200001"), p.filter("period < 200001"), ["entity"])


@query(f"WITH {PANEL} SELECT row_id, entity, c_nationkey AS nation FROM panel LEFT JOIN customer ON c_custkey = entity")
def validated_join(spark, d):
    """Records with their customer's nation; a customer that stood twice would fail the job."""
    nation = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("nation"))
    return R.validated_join(panel(spark, d).select("row_id", "entity"), nation, ["entity"])


@query(
    f"""WITH {SCORED}, {_vector('model, fold')}, s AS (SELECT model, fold, round(auc + CASE WHEN fold = 2 THEN 0.01 ELSE 0 END, 6) AS saved, auc FROM vec WHERE NOT (model = 'm1' AND fold = 3))
    SELECT model, fold, 'auc' AS "column", 'differs' AS kind, saved, auc AS expected FROM s WHERE fold = 2 UNION ALL
    SELECT model, fold, NULL, 'missing', NULL, NULL FROM vec WHERE model = 'm1' AND fold = 3 UNION ALL
    SELECT model, 9, NULL, 'extra', NULL, NULL FROM vec WHERE model = 'm2' AND fold = 5 UNION ALL
    SELECT model, fold, NULL, 'repeated', NULL, NULL FROM vec WHERE fold = 4"""
)
def saved_vs_recomputed(spark, d):
    """Fold metrics as a report holds them, against those computed again: of a changed, a missing, a foreign and a repeated row each is found, and nothing else."""
    v = rounded(M.metric_vector(scored_long(spark, d), ["model", "fold"])).select("model", "fold", "auc", "brier")
    saved = v.filter("not (model = 'm1' and fold = 3)").withColumn("auc", F.round(F.col("auc") + F.when(F.col("fold") == 2, 0.01).otherwise(0.0), 6))
    saved = saved.unionByName(v.filter("model = 'm2' and fold = 5").withColumn("fold", F.lit(9))).unionByName(v.filter("fold = 4"))
    return rounded(R.compare(saved, v, ["model", "fold"], ["auc", "brier"], 1e-6))


@query(f"WITH {SCORED}, t AS ({'WITH ' + SCORED + ', ' + _topk('model')}) SELECT 'topk' AS report, count(*) AS n, CAST(0 AS BIGINT) AS failures FROM t")
def saved_report_matches(spark, d):
    """A top-k report written as CSV, read back and compared with one computed by ranking every row."""
    from ..sources import io

    rows, path = scored_long(spark, d), io.scratch(spark, "report")
    io.write_report(M.topk(rows, ["model"]), path, 9)
    saved = io.read_csv(spark, path, "model string, k int, n long, positives long, rate double, lift double, recall double, base_rate double")
    ranked = ranks.row_numbers(rows, ["model"], "p", "row_id", descending=True).withColumn("k", F.explode(F.array(*map(F.lit, (1, 5, 10)))))
    top = ranked.filter(F.col("rn") < F.ceil(F.col("n") * F.col("k") / 100)).groupBy("model", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.avg("y").alias("rate"))
    bad = R.compare(saved, top, ["model", "k"], ["n", "positives", "rate"], 1e-8).agg(F.count(F.lit(1)).alias("failures"))
    return saved.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(bad)).select(F.lit("topk").alias("report"), "n", "failures")


@query(f"WITH {SCORED} SELECT DISTINCT model, true AS auc_ok, true AS ap_ok, true AS brier_ok, true AS ece_ok, true AS ece_adaptive_ok FROM long")
def two_pass_metrics(spark, d):
    """All metrics from collapsed scores against second formulas over ranked rows, to 1e-8."""
    rows = scored_long(spark, d)
    one = M.metric_vector(rows, ["model"])
    r = ranks.average_ranks(rows, ["model"], "p")
    # precision at each row's score, from the ranks of rows and of positives among themselves
    own = ranks.average_ranks(rows.filter("y = 1"), ["model"], "p").select("model", "row_id", F.col("avg_rank").alias("pos_rank"))
    ties = rows.groupBy("model", "p").agg(F.count(F.lit(1)).alias("t"), F.sum("y").alias("tp"))
    total = rows.groupBy("model").agg(F.count(F.lit(1)).alias("nn"), F.sum("y").alias("pp"))
    r = r.join(ties, ["model", "p"]).join(total, "model").join(own, ["model", "row_id"], "left")
    above, hits = F.col("nn") - F.col("avg_rank") + (F.col("t") + 1) / 2, F.col("pp") - F.col("pos_rank") + (F.col("tp") + 1) / 2
    two = r.groupBy("model").agg(
        ((F.sum(F.col("avg_rank") * F.col("y")) - F.max("pp") * (F.max("pp") + 1) / 2) / (F.max("pp") * (F.max("nn") - F.max("pp")))).alias("auc2"),
        (F.sum(F.when(F.col("y") == 1, hits / above)) / F.max("pp")).alias("ap2"),
        F.avg(F.pow(F.col("y") - F.col("p"), 2)).alias("brier2"),
    )
    for name, adaptive in (("ece2", False), ("adaptive2", True)):
        bins = M.with_bins(rows, ["model"], adaptive=adaptive).groupBy("model", "bin").agg(F.abs(F.sum(F.col("y") - F.col("p"))).alias("gap"), F.count(F.lit(1)).alias("c"))
        two = two.join(bins.groupBy("model").agg((F.sum("gap") / F.sum("c")).alias(name)), "model")
    ok = lambda a, b: (F.abs(F.col(a) - F.col(b)) < 1e-8)
    return one.join(two, "model").select(
        "model", ok("auc", "auc2").alias("auc_ok"), ok("average_precision", "ap2").alias("ap_ok"), ok("brier", "brier2").alias("brier_ok"), ok("ece_uniform", "ece2").alias("ece_ok"), ok("ece_adaptive", "adaptive2").alias("ece_adaptive_ok")
    )


@query("SELECT * FROM (VALUES ('as it is', CAST(6 AS BIGINT), CAST(0 AS BIGINT), '', 'PASS'), ('with faults', CAST(6 AS BIGINT), CAST(3 AS BIGINT), 'history_equal,outer_leakage,unique_key', 'FAIL')) v(panel, checks, failed, failures, verdict)")
def audit_verdict(spark, d):
    """The verdict over checks of the panel, of a nested split and of histories: as they are, and with a repeated key, a leaked row and a changed label put in."""
    p = panel(spark, d)
    rows, cells = _packed(spark, d, "group")
    first = p.orderBy("row_id").limit(1)
    # the cell of outer fold 1 and inner fold 1 has bit 0, as has outer fold 1
    leak = rows.filter("ov & 1 <> 0").orderBy("row_id").limit(1).withColumns({"t": F.lit(1).cast("long"), "v": F.lit(0).cast("long")})
    early = p.filter("period is not null").groupBy("entity").agg(F.min("period").alias("a"), F.max("period").alias("b"), F.min(F.struct("period", "row_id")).alias("x")).filter("a < b").orderBy("entity").limit(1)
    found = p.join(F.broadcast(early.select(F.col("x.row_id").alias("__r"))), F.col("row_id") == F.col("__r"), "left")
    changed = found.withColumn("other", F.when(F.col("__r").isNotNull(), 1 - F.col("label")).otherwise(F.col("label"))).drop("__r")
    hot, out = scan.hot_values(p), []
    for name, table, i, source in (("as it is", p, rows, p.withColumn("other", F.col("label"))), ("with faults", p.unionByName(first), rows.unionByName(leak), changed)):
        audit = splits.audit_rows(rows, i, cells).agg(F.sum("outer_leakage").alias("a"), F.sum("outer_overlap").alias("b"))
        audit = audit.selectExpr("stack(2, 'outer_leakage', a, 'outer_overlap', b) AS (check, value)").withColumn("ok", F.col("value") == 0)
        same = H.label_diff(source, "other", hot=hot)
        same = same.agg(F.count_if("changed").alias("v")).select(F.lit("history_equal").alias("check"), F.col("v").alias("value"), (F.col("v") == 0).alias("ok"))
        checked = reduce(DataFrame.unionByName, [R.checks(table, "row_id", "label"), audit, same])
        out.append(R.verdict(checked).select(F.lit(name).alias("panel"), "checks", "failed", "failures", "verdict"))
    return out[0].unionByName(out[1])


@query(f"WITH {PANEL} SELECT side, format('{{:,}}', count(*)) AS n_text, printf('%.4f', avg(label)) AS rate_text, printf('%.4f', avg(amount)) AS amount_text FROM panel GROUP BY side")
def display_numbers(spark, d):
    """Thousands with commas and four decimals, as reports print them."""
    return panel(spark, d).groupBy("side").agg(C.format_thousands(F.count(F.lit(1))).alias("n_text"), C.format_fixed(F.avg("label")).alias("rate_text"), C.format_fixed(F.avg("amount")).alias("amount_text"))


@query(f"WITH {SCORED}, {_vector('model')} SELECT CAST(CASE model WHEN 'm2' THEN 1 ELSE 2 END AS INT) AS position, CASE model WHEN 'm2' THEN 'knows the label' ELSE 'value alone' END AS label, model, auc FROM vec")
def condition_table(spark, d):
    """Models in a report's order, under its labels."""
    v = rounded(M.metric_vector(scored_long(spark, d), ["model"])).select("model", "auc")
    return R.ordered(v, "model", [("m2", "knows the label"), ("m1", "value alone")])


@query(
    f"""WITH {IMPORTANCE}, r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY value DESC, feature) AS rn FROM imp), t AS (SELECT fold, feature, CAST(k AS INT) AS k FROM r, (VALUES (5), (10), (20)) v(k) WHERE rn <= k),
    s AS (SELECT fold, k, count(*) AS n FROM t GROUP BY ALL), x AS (SELECT a.fold AS l, b.fold AS r, k, count(*) AS shared FROM t a JOIN t b USING (k, feature) WHERE a.fold < b.fold GROUP BY ALL),
    o AS (SELECT a.fold AS l, b.fold AS r, k, coalesce(shared, 0) AS shared, coalesce(shared, 0) / (a.n + b.n - coalesce(shared, 0)) AS jaccard FROM s a JOIN s b USING (k) LEFT JOIN x ON x.l = a.fold AND x.r = b.fold AND x.k = a.k WHERE a.fold < b.fold)
    SELECT k, round(avg(shared), 6) AS shared_mean, min(shared) AS shared_min, max(shared) AS shared_max, round(avg(jaccard), 6) AS jaccard_mean, round(min(jaccard), 6) AS jaccard_min, round(max(jaccard), 6) AS jaccard_max FROM o GROUP BY k"""
)
def topk_overlap_summary(spark, d):
    return rounded(R.overlap_summary(R.topk_overlap(importance(spark, d))))


# ---------------------------------------------------------------- saved reports


def _reports(spark, d) -> dict[str, tuple[DataFrame, list[str], list[str]]]:
    """Reports by name: the table, its keys and its values."""
    rows = scored_long(spark, d)
    bins = reduce(DataFrame.unionByName, [M.reliability(rows, ["model"], adaptive=a).withColumn("strategy", F.lit("adaptive" if a else "uniform")) for a in (False, True)])
    v = rounded(M.metric_vector(rows, ["model", "fold"]))
    return {
        "fold_metrics": (v, ["model", "fold"], ["auc", "average_precision", "brier", "ece_uniform", "ece_adaptive", "composite"]),
        "summary": (R.mean_std(v, ["model"], ["auc", "brier"]), ["model"], ["auc_mean", "auc_std", "brier_mean", "brier_std"]),
        "topk": (M.topk(rows, ["model"]), ["model", "k"], ["n", "positives", "rate", "lift", "recall", "base_rate"]),
        "reliability": (bins, ["strategy", "model", "bin"], ["n", "mean_pred", "observed_rate"]),
        "distribution": (R.year_side(panel(spark, d)), ["year", "side"], ["n", "positives", "rate"]),
        "bootstrap": (_summary(spark, d, 20), ["metric"], ["observed", "mean", "low", "high"]),
    }


def _saved(spark, df: DataFrame, fault=lambda t: t) -> DataFrame:
    """A report written as CSV, its faults planted, and read back."""
    from ..sources import io

    path = io.scratch(spark, "report")
    io.write_report(fault(df), path, 9)
    return io.read_csv(spark, path, df.schema)


def _kept(spark, df: DataFrame) -> DataFrame:
    from ..sources import io

    path = io.scratch(spark, "expected")
    df.write.parquet(path)
    return spark.read.parquet(path)


#: What is put into each report; ``at`` picks a row, the change is on one value of it, or the row goes or comes twice.
_AT = lambda where, column, value: lambda t: t.withColumn(column, F.when(F.expr(where), value(F.col(column))).otherwise(F.col(column)))
_FAULTS = {
    "fold_metrics": lambda t: t.filter("not (model = 'm1' and fold = 3)"),
    "summary": _AT("model = 'm2'", "auc_std", lambda c: c + 0.5),
    "topk": lambda t: t.withColumn("k", F.when((F.col("model") == "m1") & (F.col("k") == 5), 20).otherwise(F.col("k"))),
    "reliability": _AT("strategy = 'uniform' and model = 'm1' and bin = 2", "observed_rate", lambda c: c + 0.01),
    "distribution": lambda t: t.unionByName(t.filter("year = 1996 and side = 'A'")),
    "bootstrap": lambda t: t.withColumns({"low": F.when(F.col("metric") == "auc", F.col("high")).otherwise(F.col("low")), "high": F.when(F.col("metric") == "auc", F.col("low")).otherwise(F.col("high"))}),
}


@query(
    f"""WITH {SCORED}, vec AS (WITH {SCORED}, {_vector('model, fold')} SELECT * FROM vec), boot AS ({_SUMMARY}), {PANEL},
    s AS (SELECT model, coalesce(stddev_samp(auc), 0) AS auc_std FROM vec GROUP BY model),
    b AS (SELECT avg(y) AS rate FROM long WHERE model = 'm1' AND least(floor(p * 10), 9) = 2)
    SELECT 'fold_metrics' AS report, 'm1|3' AS key, NULL AS "column", 'missing' AS kind, NULL::DOUBLE AS saved, NULL::DOUBLE AS expected FROM vec WHERE model = 'm1' AND fold = 3 UNION ALL
    SELECT 'summary', model, 'auc_std', 'differs', round(auc_std + 0.5, 6), round(auc_std, 6) FROM s WHERE model = 'm2' UNION ALL
    SELECT 'topk', 'm1|5', NULL, 'missing', NULL, NULL UNION ALL SELECT 'topk', 'm1|20', NULL, 'extra', NULL, NULL UNION ALL
    SELECT 'reliability', 'uniform|m1|2', 'observed_rate', 'differs', round(rate + 0.01, 6), round(rate, 6) FROM b WHERE rate IS NOT NULL UNION ALL
    SELECT DISTINCT 'distribution', '1996|A', NULL, 'repeated', NULL, NULL FROM panel WHERE period // 100 = 1996 AND side = 'A' UNION ALL
    SELECT 'bootstrap', 'auc', 'low', 'differs', high, low FROM boot WHERE metric = 'auc' UNION ALL SELECT 'bootstrap', 'auc', 'high', 'differs', low, high FROM boot WHERE metric = 'auc'"""
)
def saved_reports_faults(spark, d):
    """Six saved reports with a fault in each, against those computed again: every fault is found in one table, and nothing else."""
    held = {name: (_kept(spark, t), keys, values) for name, (t, keys, values) in _reports(spark, d).items()}
    return rounded(R.compare_reports([(name, _saved(spark, t, _FAULTS[name]), t, keys, values, 1e-6) for name, (t, keys, values) in held.items()]))


@query(
    f"""WITH {SCORED}, {PANEL}, b AS (SELECT DISTINCT model, CAST(least(floor(p * 10), 9) AS INT) AS bin FROM long), n AS (SELECT count(*) AS n FROM long WHERE model = 'm1')
    SELECT 'fold_metrics' AS report, (SELECT count(*) FROM (SELECT DISTINCT model, fold FROM long)) AS n, 0::BIGINT AS failures UNION ALL SELECT 'summary', 2, 0 UNION ALL SELECT 'topk', 6, 0 UNION ALL
    SELECT 'reliability', (SELECT count(*) FROM b) + 2 * (SELECT least(n, 10) FROM n), 0 UNION ALL SELECT 'distribution', (SELECT count(*) FROM (SELECT DISTINCT period // 100, side FROM panel)), 0 UNION ALL SELECT 'bootstrap', 2, 0"""
)
def saved_reports_match(spark, d):
    """Six reports written as CSV and read back, against a second computation of each: rows and failures."""
    saved = {name: _saved(spark, t) for name, (t, _, _) in _reports(spark, d).items()}
    again = _reports(spark, d)
    found = R.compare_reports([(name, saved[name], t, keys, values, 1e-6) for name, (t, keys, values) in again.items()]).groupBy("report").agg(F.count(F.lit(1)).alias("failures"))
    sizes = reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("report"), "n") for name, t in saved.items()])
    return sizes.join(found, "report", "left").select("report", "n", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"))


#: key, metric, minuend, subtrahend, condition: the formulas of the ledger; entries that no evaluation has stand for conditions that don't hold.
FORMULAS = [
    ("reference", "auc", "m1", None, None),
    ("full", "auc", "m2", "m1", None),
    ("full", "average_precision", "m2", "m1", "m2"),
    ("full_if_third", "auc", "m2", "m1", "m3"),
    ("full_less_third", "brier", "m2", "m3", None),
    ("third", "auc", "m3", "m1", None),
]


@query(
    f"""WITH {SCORED}, {_vector('model')}, f(key, metric, a, b, c) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in FORMULAS)}),
    v AS (SELECT model, unnest(['auc', 'average_precision', 'brier']) AS metric, unnest([auc, average_precision, brier]) AS value FROM vec)
    SELECT key, f.metric, x.value, CASE WHEN c IS NULL OR c IN (SELECT model FROM v) THEN round(x.value - y.value, 6) END AS delta
    FROM f LEFT JOIN v x ON x.model = a AND x.metric = f.metric LEFT JOIN v y ON y.model = b AND y.metric = f.metric"""
)
def figure_ledger_deltas(spark, d):
    """Key figures by formula: values, and differences that stand only where the other entry and the condition are there."""
    v = rounded(M.metric_vector(scored_long(spark, d), ["model"]))
    values = v.selectExpr("model AS entry", "stack(3, 'auc', auc, 'average_precision', average_precision, 'brier', brier) AS (metric, value)")
    return rounded(R.ledger(values, spark.createDataFrame(FORMULAS, "key string, metric string, minuend string, subtrahend string, condition string")))
