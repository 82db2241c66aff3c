"""Metric, bootstrap, sequence and stability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap as B
from ..operators import metrics as M
from ..operators import ranks
from ..operators import reports as R
from ..operators import sequences as S
from ..sources.fixtures import IMPORTANCE, SCORED, SEQ, importance, scored_long, seq
from .panel_queries import rounded
from .registry import query


def _auc(groups: str, source: str = "long", w: str = "1") -> str:
    """CTE ``auc``: direct global windows, the other plan."""
    return f"""pts AS (SELECT {groups}, p, sum({w} * y) AS pos, sum({w} * (1 - y)) AS neg FROM {source} GROUP BY ALL),
 cum AS (SELECT *, sum(pos) OVER g AS all_pos, sum(neg) OVER g AS all_neg, coalesce(sum(neg) OVER (PARTITION BY {groups} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
   sum(pos) OVER (PARTITION BY {groups} ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY {groups} ORDER BY p DESC) AS fp FROM pts WINDOW g AS (PARTITION BY {groups})),
 auc AS (SELECT {groups}, CAST(sum(pos * (below + neg / 2)) AS DOUBLE) / nullif(max(all_pos) * max(all_neg), 0) AS auc, sum(pos * coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0)) / nullif(max(all_pos), 0) AS average_precision FROM cum GROUP BY {groups})"""


def _bins(groups: str, source: str = "long") -> str:
    return f"""bu AS (SELECT {groups}, CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS mean_pred, avg(y) AS observed_rate FROM {source} GROUP BY ALL),
 ba AS (SELECT {groups}, bin, count(*) AS n, avg(p) AS mean_pred, avg(y) AS observed_rate FROM (SELECT *, CAST(ntile(10) OVER (PARTITION BY {groups} ORDER BY p, row_id) - 1 AS INT) AS bin FROM {source}) GROUP BY ALL),
 eu AS (SELECT {groups}, sum(n * abs(observed_rate - mean_pred)) / sum(n) AS ece_uniform FROM bu GROUP BY ALL),
 ea AS (SELECT {groups}, sum(n * abs(observed_rate - mean_pred)) / sum(n) AS ece_adaptive FROM ba GROUP BY ALL)"""


def _vector(groups: str, source: str = "long") -> str:
    return f"""{_auc(groups, source)}, {_bins(groups, source)}, br AS (SELECT {groups}, count(*) AS n, avg((y - p) * (y - p)) AS brier FROM {source} GROUP BY ALL),
 vec AS (SELECT {groups}, n, round(auc, 6) AS auc, round(average_precision, 6) AS average_precision, round(brier, 6) AS brier, round(ece_uniform, 6) AS ece_uniform, round(ece_adaptive, 6) AS ece_adaptive,
   round(0.5 * (1 - auc) + 0.25 * brier + 0.25 * ece_uniform, 6) AS composite FROM auc JOIN br USING ({groups}) JOIN eu USING ({groups}) JOIN ea USING ({groups}))"""


def _topk(groups: str) -> str:
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY p DESC, row_id) AS rn, count(*) OVER (PARTITION BY {groups}) AS total FROM long),
 b AS (SELECT {groups}, avg(y) AS base_rate, sum(y) AS all_pos FROM long GROUP BY ALL),
 t AS (SELECT {groups}, CAST(k AS INT) AS k, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, avg(y) AS rate FROM r, (VALUES (1), (5), (10)) v(k) WHERE rn <= ceil(total * k / 100) GROUP BY ALL)
 SELECT {groups}, k, n, positives, round(rate, 6) AS rate, round(rate / base_rate, 6) AS lift, round(positives / all_pos, 6) AS recall, round(base_rate, 6) AS base_rate FROM t JOIN b USING ({groups})"""


@query(f"WITH {SCORED}, {_auc('model')} SELECT model, round(auc, 6) AS auc FROM auc")
def auc(spark, d):
    return rounded(M.auc_ap(scored_long(spark, d), ["model"]).select("model", "auc"))


@query(f"WITH {SCORED}, {_auc('model')} SELECT model, round(average_precision, 6) AS average_precision FROM auc")
def average_precision(spark, d):
    return rounded(M.auc_ap(scored_long(spark, d), ["model"]).select("model", "average_precision"))


@query(f"WITH {SCORED} SELECT model, count(*) AS n, round(avg((y - p) * (y - p)), 6) AS brier FROM long GROUP BY model")
def brier(spark, d):
    return rounded(M.brier(scored_long(spark, d), ["model"]))


@query(f"WITH {SCORED}, {_bins('model')} SELECT model, round(ece_uniform, 6) AS ece FROM eu")
def ece_uniform(spark, d):
    return rounded(M.ece(scored_long(spark, d), ["model"]))


@query(f"WITH {SCORED}, {_bins('model')} SELECT model, round(ece_adaptive, 6) AS ece FROM ea")
def ece_adaptive(spark, d):
    return rounded(M.ece(scored_long(spark, d), ["model"], adaptive=True))


@query(f"WITH {SCORED}, {_vector('model')} SELECT * FROM vec")
def metric_vector(spark, d):
    return rounded(M.metric_vector(scored_long(spark, d), ["model"]))


@query(f"WITH {SCORED}, both_ AS (SELECT * REPLACE (CAST(fold AS VARCHAR) AS fold) FROM long UNION ALL SELECT * REPLACE ('pooled' AS fold) FROM long), {_vector('model, fold', 'both_')} SELECT * FROM vec")
def metric_by_fold_and_pooled(spark, d):
    rows = scored_long(spark, d)
    each = rows.withColumn("fold", F.explode(F.array(F.col("fold").cast("string"), F.lit("pooled"))))
    return rounded(M.metric_vector(each, ["model", "fold"]))


@query(f"WITH {SCORED}, {_vector('model, side')} SELECT * FROM vec")
def metric_subgroup(spark, d):
    return rounded(M.metric_vector(scored_long(spark, d), ["model", "side"]))


@query(f"WITH {SCORED}, {_topk('model')}")
def topk(spark, d):
    return rounded(M.topk(scored_long(spark, d), ["model"]))


@query(f"WITH {SCORED}, {_topk('model, side')}")
def topk_subgroup(spark, d):
    return rounded(M.topk(scored_long(spark, d), ["model", "side"]))


@query(f"WITH {SCORED}, {_bins('model')} SELECT model, bin, n, round(mean_pred, 6) AS mean_pred, round(observed_rate, 6) AS observed_rate FROM bu")
def reliability_uniform(spark, d):
    return rounded(M.reliability(scored_long(spark, d), ["model"]))


@query(f"WITH {SCORED}, {_bins('model')} SELECT model, bin, n, round(mean_pred, 6) AS mean_pred, round(observed_rate, 6) AS observed_rate FROM ba")
def reliability_adaptive(spark, d):
    return rounded(M.reliability(scored_long(spark, d), ["model"], adaptive=True))


@query(f"WITH {SCORED} SELECT model, row_id, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2 AS avg_rank FROM long")
def avg_rank(spark, d):
    return ranks.average_ranks(scored_long(spark, d), ["model"], "p").select("model", "row_id", "avg_rank")


_WEIGHTS = f"""w AS (SELECT entity, CAST(r AS INT) AS replicate, CAST({' + '.join(f"(u >= {c!r}::DOUBLE)::INT" for c in M.POISSON)} AS INT) AS w
  FROM (SELECT entity, r, CAST(CAST('0x' || substr(md5('42:' || r || ':' || entity), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u FROM (SELECT DISTINCT entity FROM scored), range(1, 21) t(r))),
 wl AS (SELECT long.*, replicate, w FROM long JOIN w USING (entity) WHERE w > 0)"""
_DELTA = f"{_auc('replicate, model', 'wl', 'w')}, dl AS (SELECT replicate, max(auc) FILTER (WHERE model = 'm2') - max(auc) FILTER (WHERE model = 'm1') AS delta_auc, max(average_precision) FILTER (WHERE model = 'm2') - max(average_precision) FILTER (WHERE model = 'm1') AS delta_average_precision FROM auc GROUP BY replicate)"


@query(f"WITH {SCORED}, {_WEIGHTS} SELECT entity, replicate, w FROM w")
def bootstrap_weights(spark, d):
    return M.poisson_weights(scored_long(spark, d), 20)


@query(f"WITH {SCORED}, {_WEIGHTS}, {_DELTA} SELECT replicate, model, round(auc, 6) AS auc, round(average_precision, 6) AS average_precision FROM auc")
def bootstrap_weighted_auc_ap(spark, d):
    rows = scored_long(spark, d)
    return rounded(B.weighted_auc_ap(rows, B.weight_arrays(rows, 20)))


_OBS = _auc("model").replace("pts AS", "opts AS").replace("FROM pts", "FROM opts").replace("cum AS", "ocum AS").replace("FROM cum", "FROM ocum").replace("\n auc AS", "\n oauc AS")


_SUMMARY = f"""WITH {SCORED}, {_WEIGHTS}, {_DELTA}, {_OBS}, x AS (SELECT replicate, unnest(['auc', 'average_precision']) AS metric, unnest([delta_auc, delta_average_precision]) AS v FROM dl),
    o AS (SELECT 'auc' AS metric, max(auc) FILTER (WHERE model = 'm2') - max(auc) FILTER (WHERE model = 'm1') AS observed FROM oauc
      UNION ALL SELECT 'average_precision', max(average_precision) FILTER (WHERE model = 'm2') - max(average_precision) FILTER (WHERE model = 'm1') FROM oauc)
    SELECT metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(max(observed), 6) AS observed FROM x JOIN o USING (metric) GROUP BY metric"""


@query(_SUMMARY)
def bootstrap_summary(spark, d):
    return _summary(spark, d, 20)


def _summary(spark, d, replicates: int):
    rows, values = scored_long(spark, d), ["auc", "average_precision"]
    deltas = M.paired_delta(B.weighted_auc_ap(rows, B.weight_arrays(rows, replicates)), ["replicate"], "model", "m1", "m2", values)
    observed = M.paired_delta(M.auc_ap(rows, ["model"]), [], "model", "m1", "m2", values)
    return rounded(M.bootstrap_summary(deltas, observed, values))


def _of_500(sql: str) -> str:
    return sql.replace("range(1, 21)", "range(1, 501)")


@query(_of_500(f"WITH {SCORED}, {_WEIGHTS} SELECT entity, replicate, w FROM w"))
def bootstrap_weights_500(spark, d):
    """``bootstrap_weights`` with the reference's number of replicates."""
    return M.poisson_weights(scored_long(spark, d))


@query(_of_500(f"WITH {SCORED}, {_WEIGHTS}, {_DELTA} SELECT replicate, model, round(auc, 6) AS auc, round(average_precision, 6) AS average_precision FROM auc"))
def bootstrap_weighted_auc_ap_500(spark, d):
    rows = scored_long(spark, d)
    return rounded(B.weighted_auc_ap(rows, B.weight_arrays(rows)))


@query(_of_500(_SUMMARY))
def bootstrap_summary_500(spark, d):
    """``bootstrap_summary`` with the reference's number of replicates, which its percentiles need."""
    return _summary(spark, d, 500)


@query(f"WITH {SCORED}, {_vector('model')} SELECT {', '.join(f'''round(max({c}) FILTER (WHERE model = 'm2') - max({c}) FILTER (WHERE model = 'm1'), 4) AS delta_{c}''' for c in ('auc', 'average_precision', 'brier', 'composite'))} FROM vec")
def incremental_value(spark, d):
    v = M.metric_vector(scored_long(spark, d), ["model"])
    return rounded(M.paired_delta(rounded(v), [], "model", "m1", "m2", ["auc", "average_precision", "brier", "composite"]), 4)


@query(f"WITH {SCORED} SELECT DISTINCT model, true AS auc_ok, true AS brier_ok FROM long")
def two_pass_reconcile(spark, d):
    """AUC by prefix sums against AUC by average ranks; the Brier score against its bin-wise decomposition by label."""
    rows = scored_long(spark, d)
    r = ranks.average_ranks(rows, ["model"], "p").groupBy("model").agg(F.sum(F.col("avg_rank") * F.col("y")).alias("r"), F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    r = r.select("model", ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc2"))
    b = rows.groupBy("model", "y").agg(F.sum(F.pow(F.col("y") - F.col("p"), 2)).alias("s"), F.count(F.lit(1)).alias("c")).groupBy("model").agg((F.sum("s") / F.sum("c")).alias("brier2"))
    both = M.auc_ap(rows, ["model"]).join(M.brier(rows, ["model"]), "model").join(r, "model").join(b, "model")
    return both.select("model", (F.abs(F.col("auc") - F.col("auc2")) < 1e-8).alias("auc_ok"), (F.abs(F.col("brier") - F.col("brier2")) < 1e-8).alias("brier_ok"))


@query(f"WITH {SCORED} SELECT (SELECT count(*) FROM scored) AS n, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS misaligned")
def coverage_check(spark, d):
    """Two sets of predictions over the same records: repeated, missing and extra rows, and rows whose labels differ."""
    rows = scored_long(spark, d)
    a, b = (rows.filter(F.col("model") == m).select("row_id", "y") for m in ("m1", "m2"))
    per = a.select("row_id", F.col("y").alias("ya"), F.lit(None).cast("int").alias("yb")).unionByName(b.select("row_id", F.lit(None).cast("int").alias("ya"), F.col("y").alias("yb")))
    per = per.groupBy("row_id").agg(F.count("ya").alias("na"), F.count("yb").alias("nb"), F.max("ya").alias("ya"), F.max("yb").alias("yb"))
    return per.agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("na") > 1) | (F.col("nb") > 1)).alias("repeated"), F.count_if(F.col("nb") == 0).alias("missing"),
        F.count_if(F.col("na") == 0).alias("extra"), F.count_if(F.col("ya") != F.col("yb")).alias("misaligned"),
    )


# ---------------------------------------------------------------- folds and models


_FOLD = f"WITH {SCORED}, {_vector('model, fold')}"


@query(f"{_FOLD} SELECT model, round(avg(auc), 5) AS auc_mean, round(coalesce(stddev_samp(auc), 0), 5) AS auc_std, round(avg(brier), 5) AS brier_mean, round(coalesce(stddev_samp(brier), 0), 5) AS brier_std FROM vec GROUP BY model")
def fold_mean_std(spark, d):
    v = rounded(M.metric_vector(scored_long(spark, d), ["model", "fold"]))
    return rounded(R.mean_std(v, ["model"], ["auc", "brier"]), 5)


@query(f"{_FOLD}, dd AS (SELECT fold, max(auc) FILTER (WHERE model = 'm2') - max(auc) FILTER (WHERE model = 'm1') AS x FROM vec GROUP BY fold) SELECT round(avg(x), 5) AS mean_delta, round(stddev_samp(x), 5) AS std_delta, count(*) FILTER (WHERE x > 0) AS positive_folds FROM dd")
def paired_contrast(spark, d):
    v = rounded(M.metric_vector(scored_long(spark, d), ["model", "fold"]))
    return rounded(R.contrast(M.paired_delta(v, ["fold"], "model", "m1", "m2", ["auc"]), "delta_auc"), 5)


@query(f"{_FOLD} SELECT model, fold, auc, round(auc - first_value(auc) OVER (PARTITION BY fold ORDER BY model), 5) AS delta FROM vec")
def delta_vs_reference(spark, d):
    v = rounded(M.metric_vector(scored_long(spark, d), ["model", "fold"])).select("model", "fold", "auc")
    return R.delta_to_first(v, ["fold"], "model", "auc").withColumn("delta", F.round("delta", 5))


@query(f"{_FOLD} SELECT model, fold, composite FROM vec QUALIFY row_number() OVER (PARTITION BY model ORDER BY composite, fold) = 1")
def best_per_group(spark, d):
    v = rounded(M.metric_vector(scored_long(spark, d), ["model", "fold"])).select("model", "fold", "composite")
    return R.best(v, ["model"], "composite", "fold", largest=False)


# ---------------------------------------------------------------- sequences

_TOK = """tok AS (SELECT row_id, unnest(list_transform(range(1, least(len(string_split(code_1, ',')), len(string_split(code_2, ','))) + 1), lambda i: 'a1_' || string_split(code_1, ',')[i] || string_split(code_2, ',')[i])) AS token FROM seq),
 cnt AS (SELECT row_id, token, count(*) AS n FROM tok GROUP BY ALL)"""


def _tokens(spark, d):
    return seq(spark, d).withColumn("tokens", S.zip_tokens([F.col("code_1"), F.col("code_2")], "A1"))


@query(f"WITH {SEQ}, {_TOK} SELECT row_id, token, n FROM cnt")
def token_counts(spark, d):
    return S.token_counts(_tokens(spark, d), "tokens")


@query(f"WITH {SEQ}, {_TOK}, l AS (SELECT row_id, len(string_split(code_1, ',')) AS k, list_transform(range(1, least(len(string_split(code_1, ',')), len(string_split(code_2, ','))) + 1), lambda i: 'a1_' || string_split(code_1, ',')[i] || string_split(code_2, ',')[i]) AS t FROM seq) SELECT row_id, array_to_string(t, ' ') AS tokens FROM l")
def token_zip(spark, d):
    return _tokens(spark, d).select("row_id", F.array_join("tokens", " ").alias("tokens"))


_CODES = [f"a1_{a}{b}" for a in "123" for b in "12"]


@query(f"WITH {SEQ}, {_TOK} SELECT row_id, {', '.join(f'''CAST(coalesce(sum(n) FILTER (WHERE token = '{t}'), 0) AS BIGINT) AS {t}''' for t in _CODES)} FROM cnt GROUP BY row_id")
def token_pivot(spark, d):
    return S.pivot(S.token_counts(_tokens(spark, d), "tokens"), _CODES)


@query(f"WITH {SEQ}, {_TOK} SELECT row_id, token, n FROM cnt WHERE row_id % 2 = 1 AND token IN (SELECT token FROM cnt WHERE row_id % 2 = 0 AND token NOT LIKE '%12')")
def token_vocab_transfer(spark, d):
    """Counts of one part of the orders in the vocabulary of the other part (without one code, so that something is unseen)."""
    c = S.token_counts(_tokens(spark, d), "tokens")
    vocab = S.vocabulary(c.filter("row_id % 2 = 0 and token not like '%12'"))
    return S.transfer(c.filter("row_id % 2 = 1"), vocab)


@query(
    f"""WITH {SEQ}, v AS (SELECT row_id, list_transform(string_split(times, ','), lambda x: abs(CAST(x AS DOUBLE))) AS a FROM seq), m AS (SELECT max(len(a)) AS k FROM v)
    SELECT row_id, CASE WHEN len(a) = k THEN round(list_avg(a), 6) END AS times_mean, CASE WHEN len(a) = k THEN round(list_stddev_pop(a), 6) END AS times_std FROM v, m"""
)
def seq_numeric_stats(spark, d):
    return rounded(S.numeric_list(seq(spark, d), "times").select("row_id", "times_mean", "times_std"))


_MOM = ["l_quantity", "l_discount", "l_tax", "x"]


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest([l_quantity, round(l_discount * 100, 6), round(l_tax * 100, 6), CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS DOUBLE) END]) AS v, l_extendedprice FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(stddev_samp(v), 4) AS m_std, round(avg(v), 4) AS m_mean, CASE WHEN count(v) >= 3 THEN CASE WHEN max(v) = min(v) THEN 0 ELSE round(skewness(v), 4) + 0.0 END END AS m_skew, CASE WHEN count(v) >= 4 THEN CASE WHEN max(v) = min(v) THEN 0 ELSE round(kurtosis(v), 4) + 0.0 END END AS m_kurt FROM r GROUP BY ALL"""
)
def row_moments(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", F.round(F.col("l_discount") * 100, 6).alias("dd"), F.round(F.col("l_tax") * 100, 6).alias("t"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("double")).alias("x"),
    )
    out = S.row_moments(rows, ["l_quantity", "dd", "t", "x"], "m")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "m_std", "m_mean", "m_skew", "m_kurt"), 4)


@query(
    f"""WITH {SEQ}, {_TOK}, g AS (SELECT row_id, unnest({_CODES!r}) AS token FROM seq), f AS (SELECT g.row_id, coalesce(n, 0) AS n FROM g LEFT JOIN cnt USING (row_id, token))
    SELECT row_id, round(stddev_samp(n), 5) AS acc_stats_std, round(avg(n), 5) AS acc_stats_mean,
      CASE WHEN max(n) = min(n) THEN 0 ELSE round(skewness(n), 5) + 0.0 END AS acc_stats_skew, CASE WHEN max(n) = min(n) THEN 0 ELSE round(kurtosis(n), 5) + 0.0 END AS acc_stats_kurt FROM f GROUP BY row_id"""
)
def token_moments(spark, d):
    """Moments of a row's counts over the whole vocabulary, absent tokens as zeros."""
    t = _tokens(spark, d)
    return rounded(S.token_moments(t, S.token_counts(t, "tokens"), len(_CODES), "acc_stats"), 5)


# ---------------------------------------------------------------- stability of rankings


@query(f"WITH {IMPORTANCE} SELECT fold, feature, value, CAST(rank() OVER (PARTITION BY fold ORDER BY value DESC) AS INT) AS rank FROM imp")
def importance_rank(spark, d):
    return R.importance_rank(importance(spark, d))


@query(
    f"""WITH {IMPORTANCE}, r AS (SELECT *, CAST(rank() OVER (PARTITION BY fold ORDER BY value DESC) AS INT) AS rank FROM imp)
    SELECT feature, round(avg(rank), 6) AS mean_rank, round(stddev_samp(rank), 6) AS std_rank, min(rank) AS min_rank, max(rank) AS max_rank, {', '.join(f'count(*) FILTER (WHERE rank <= {k}) AS top{k}' for k in (5, 10, 20))},
    {', '.join(f'max(rank) FILTER (WHERE fold = {k}) AS fold_{k}' for k in range(1, 6))}, CAST(row_number() OVER (ORDER BY avg(rank), feature) AS INT) AS consensus FROM r GROUP BY feature"""
)
def importance_aggregate(spark, d):
    return rounded(R.importance_summary(importance(spark, d)))


@query(
    f"""WITH {IMPORTANCE}, r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY value) + (count(*) OVER (PARTITION BY fold, value) - 1) / 2 AS r FROM imp)
    SELECT a.fold AS "left", b.fold AS "right", round(corr(a.r, b.r), 6) AS spearman FROM r a JOIN r b ON a.feature = b.feature AND a.fold < b.fold GROUP BY ALL"""
)
def spearman_pairs(spark, d):
    return rounded(R.spearman(importance(spark, d)))


@query(
    f"""WITH {IMPORTANCE}, r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY value DESC, feature) AS rn FROM imp), t AS (SELECT fold, feature, CAST(k AS INT) AS k FROM r, (VALUES (5), (10), (20)) v(k) WHERE rn <= k),
    s AS (SELECT fold, k, count(*) AS n FROM t GROUP BY ALL), x AS (SELECT a.fold AS l, b.fold AS r, k, count(*) AS shared FROM t a JOIN t b USING (k, feature) WHERE a.fold < b.fold GROUP BY ALL)
    SELECT a.fold AS "left", b.fold AS "right", k, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / (a.n + b.n - coalesce(shared, 0)), 6) AS jaccard FROM s a JOIN s b USING (k) LEFT JOIN x ON x.l = a.fold AND x.r = b.fold AND x.k = a.k WHERE a.fold < b.fold"""
)
def topk_overlap(spark, d):
    return rounded(R.topk_overlap(importance(spark, d)))
