"""The base feature build, and tables assembled from metric tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import metrics as M
from ..operators import sequences as S
from ..sources.fixtures import PANEL, SCORED, SEQ, panel, scored_long, seq
from ..functions import columns as C
from ..operators import features as X
from ..operators import scan, splits
from ..sources import io
from .panel_queries import _ALL, _ROLE, TRAIN, VALID, rounded
from .registry import query
from .scored_queries import _CODES, _TOK, _tokens, _vector

TIMES = ("times", "times_2", "times_3", "times_4")
#: Which tokens count as right and as wrong answers: start, place from 1, characters there.
RIGHT, WRONG = (("a1", 4, ("1",)),), (("a1", 4, ("2", "3")),)


@query(
    f"""WITH {PANEL}, {SEQ}, {_TOK}, h AS (SELECT t.row_id, t.period, avg(s.label) AS l, count(s.row_id) AS n FROM panel t LEFT JOIN panel s ON s.entity = t.entity AND s.period < t.period GROUP BY ALL),
    g AS (SELECT row_id, unnest({_CODES!r}) AS token FROM seq), f AS (SELECT g.row_id, round(avg(coalesce(n, 0)), 5) AS m FROM g LEFT JOIN cnt USING (row_id, token) GROUP BY 1),
    v AS (SELECT row_id, list_transform(string_split(times, ','), lambda x: abs(CAST(x AS DOUBLE))) AS a FROM seq), k AS (SELECT max(len(a)) AS k FROM v)
    SELECT h.row_id, CAST(period // 100 AS INT) AS year, round(l, 5) AS prev_ab_all_label_mean, m AS acc_stats_mean, CASE WHEN len(a) = k THEN round(list_avg(a), 5) END AS rt_mean,
      CAST((l IS NULL)::INT + (m IS NULL)::INT + (a IS NULL OR len(a) <> k)::INT AS INT) AS isna_sum
    FROM h LEFT JOIN f USING (row_id) LEFT JOIN v USING (row_id), k"""
)
def base_features(spark, d):
    """History, token moments, response times and the missing count of every record, in one plan."""
    p = panel(spark, d)
    t = _tokens(spark, d)
    moments = S.token_moments(t, S.token_counts(t, "tokens"), len(_CODES), "acc_stats").select("row_id", "acc_stats_mean")
    times = S.numeric_list(seq(spark, d), "times").select("row_id", F.col("times_mean").alias("rt_mean"))
    out = H.fold_history(p, p, blocks=("any",)).join(moments, "row_id", "left").join(times, "row_id", "left")
    columns = ["prev_ab_all_label_mean", "acc_stats_mean", "rt_mean"]
    year = F.floor(F.col("period") / 100).cast("int").alias("year")
    return rounded(out.select("row_id", year, *columns, S.missing_count(columns).alias("isna_sum")), 5)


@query(f"WITH {SCORED}, {_vector('model, side')} SELECT model, max(auc) FILTER (WHERE side = 'A') AS A_auc, max(brier) FILTER (WHERE side = 'A') AS A_brier, max(auc) FILTER (WHERE side = 'B') AS B_auc, max(brier) FILTER (WHERE side = 'B') AS B_brier FROM vec GROUP BY model")
def wide_assembly(spark, d):
    """Both sides' metrics of a model in one row."""
    v = rounded(M.metric_vector(scored_long(spark, d), ["model", "side"]))
    return v.groupBy("model").pivot("side", ["A", "B"]).agg(F.max("auc").alias("auc"), F.max("brier").alias("brier"))


@query(f"WITH {SCORED}, {_vector('model')}, w(key, model, metric) AS (VALUES ('reference_auc', 'm1', 'auc'), ('full_auc', 'm2', 'auc'), ('full_brier', 'm2', 'brier')) SELECT key, CASE metric WHEN 'auc' THEN auc ELSE brier END AS value FROM w JOIN vec USING (model)")
def figure_ledger(spark, d):
    """Named key figures, one row each, in the form of a literal table joined with the metrics."""
    v = rounded(M.metric_vector(scored_long(spark, d), ["model"])).selectExpr("model", "stack(2, 'auc', auc, 'brier', brier) AS (metric, value)")
    wanted = spark.createDataFrame([("reference_auc", "m1", "auc"), ("full_auc", "m2", "auc"), ("full_brier", "m2", "brier")], "key string, model string, metric string")
    return v.join(F.broadcast(wanted), ["model", "metric"]).select("key", "value")


# ---------------------------------------------------------------- the whole matrix

#: The 37 feature columns, by group.
COLUMNS = [
    *X.TIMING,
    *H.FEATURES,
    *[f"{p}_{s}" for p in ("acc_stats", "err_stats", "rt_mean_stats", "rt_std_stats") for s in ("std", "mean", "skew", "kurt")],
    "isna_sum",
]


def _coded(spark, d) -> DataFrame:
    """(row_id, tokens, n_codes, lists of numbers) of every order's lines, made once."""
    return io.kept(_tokens(spark, d).select("row_id", "tokens", F.size(F.split("code_1", ",")).alias("n_codes"), *TIMES), "codes")


def base(spark, d, targets, train=None):
    """``targets`` with the 21 features that are no history, token vocabulary from the ``train`` rows; ``isna_sum`` counts what is missing beside the history.

    Tokens that training rows lack count nowhere. The missing count is taken
    before the moments are, and so covers the response times that they are made of.
    An order's lists are moved to its record once and read there. Lowers
    ``spark.sql.codegen.hugeMethodLimit`` of the session and leaves it so.
    """
    # Java never compiles a generated method of more than 8,000 bytes; stages that would have one run faster operator by operator
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    codes = _coded(spark, d)
    text = F.concat((20 + 10 * (F.col("c_nationkey") % 6)).cast("string"), F.when(F.col("c_custkey") % 2 == 1, "b").otherwise("a"))
    age = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("entity"), C.age_band(text).alias("Age"))
    y, m = F.floor(F.col("period") / 100).cast("int"), F.pmod("period", F.lit(100)).cast("int")
    learn = (targets if train is None else targets.join(train.select("row_id"), "row_id", "left_semi")).select("row_id")
    known = S.vocabulary(codes.join(learn, "row_id", "left_semi").select(F.explode("tokens").alias("token")))
    longest = codes.agg(*[F.max(F.size(F.split(c, ","))).alias(c) for c in TIMES]).first()
    made = codes
    for c in TIMES:
        made = S.numeric_list(made, c, longest[c] or 0)
    rows = targets.join(made.drop(*TIMES), "row_id", "left").join(age, "entity", "left").withColumns({"TestDate_year": y, "TestDate_month": m, "YearMonthIndex": F.col("ym_index")})
    measured = {k: [f"{c}_{k}" for c in TIMES] for k in ("mean", "std")}
    rows = rows.withColumn("isna_sum", S.missing_count([*X.TIMING, *measured["mean"], *measured["std"]]))
    for k, names in measured.items():
        rows = S.row_moments(rows, names, f"rt_{k}_stats")
    rules = {"acc_stats": (RIGHT, ["n_codes", "TestDate_month"]), "err_stats": (WRONG, [])}
    words = known.select("token", *[S.picked(one).alias(prefix) for prefix, (one, _) in rules.items()]).collect()  # the tokens are bounded by the code book
    for prefix, (_, scalars) in rules.items():
        rows = S.list_moments(rows, "tokens", sorted(w["token"] for w in words if w[prefix]), prefix, scalars)
    return rows.select(*targets.columns, *[c for c in COLUMNS if c not in H.FEATURES])


def matrix(spark, d, targets, sources, train=None):
    """(row_id, entity, period, ym_index, label, role if there, 37 features) of ``targets``: history from ``sources``, token vocabulary from the ``train`` rows."""
    hot = scan.hot_values(sources) if targets is sources else scan.hot_values(targets, sources)
    rows = base(spark, d, targets, train)
    rows = io.kept(rows, "base") if hot else rows  # rows of hot entities and the others are read apart
    rows = H.fold_history(rows, rows if targets is sources else sources, hot=hot).withColumn("isna_sum", F.col("isna_sum") + S.missing_count(H.FEATURES))
    return rows.select("row_id", "entity", "period", "ym_index", "label", *[c for c in ("role",) if c in targets.columns], *COLUMNS)


def _moments(prefix: str, v: str = "v") -> str:
    return (
        f"round(stddev_samp({v}), 5) AS {prefix}_std, round(avg({v}), 5) AS {prefix}_mean, CASE WHEN count({v}) >= 3 THEN CASE WHEN max({v}) = min({v}) THEN 0 ELSE round(skewness({v}), 5) + 0.0 END END AS {prefix}_skew, "
        f"CASE WHEN count({v}) >= 4 THEN CASE WHEN max({v}) = min({v}) THEN 0 ELSE round(kurtosis({v}), 5) + 0.0 END END AS {prefix}_kurt"
    )


def _matrix_sql(targets: str, sources: str, train: str, ctes: str = "", extra: str = "") -> str:
    listed = ", ".join(f"list_transform(string_split({c}, ','), lambda x: abs(CAST(x AS DOUBLE))) AS {c}" for c in TIMES)
    longest = ", ".join(f"max(len({c})) AS k_{c}" for c in TIMES)
    each = ", ".join(f"CASE WHEN len({c}) = k_{c} THEN list_avg({c}) END AS {c}_mean, CASE WHEN len({c}) = k_{c} THEN list_stddev_pop({c}) END AS {c}_std" for c in TIMES)
    gaps = " + ".join(f"(h.{c} IS NULL)::INT" for c in H.FEATURES) + " + (Age IS NULL)::INT + " + " + ".join(f"(n.{c}_{k} IS NULL)::INT" for c in TIMES for k in ("mean", "std"))
    rt = lambda k: ", ".join(f"{c}_{k}" for c in TIMES)
    return f"""WITH {PANEL}{ctes}, {SEQ}, {_TOK}, targets AS (SELECT * FROM {targets}), sources AS (SELECT * FROM {sources}),
    voc AS (SELECT DISTINCT token FROM cnt JOIN {train} USING (row_id)),
    h AS (SELECT t.row_id, {_ALL.replace(', 6)', ', 5)')} FROM targets t LEFT JOIN sources s ON s.entity = t.entity AND s.period < t.period GROUP BY t.row_id),
    l AS (SELECT row_id, {listed} FROM seq), k AS (SELECT {longest} FROM l), n AS (SELECT row_id, {each} FROM l, k),
    m1 AS (SELECT row_id, {_moments('rt_mean_stats')} FROM (SELECT row_id, unnest([{rt('mean')}]) AS v FROM n) GROUP BY row_id),
    m2 AS (SELECT row_id, {_moments('rt_std_stats')} FROM (SELECT row_id, unnest([{rt('std')}]) AS v FROM n) GROUP BY row_id),
    va AS (SELECT row_id, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM (SELECT row_id, token FROM targets, voc WHERE token LIKE 'a1_1%') LEFT JOIN cnt USING (row_id, token)
      UNION ALL SELECT row_id, len(string_split(code_1, ',')) FROM seq JOIN targets USING (row_id) UNION ALL SELECT row_id, period % 100 FROM targets),
    ve AS (SELECT row_id, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM (SELECT row_id, token FROM targets, voc WHERE token LIKE 'a1_2%' OR token LIKE 'a1_3%') LEFT JOIN cnt USING (row_id, token)),
    a AS (SELECT row_id, {_moments('acc_stats')} FROM va GROUP BY row_id), e AS (SELECT row_id, {_moments('err_stats')} FROM ve GROUP BY row_id),
    c AS (SELECT c_custkey AS entity, CAST(20 + 10 * (c_nationkey % 6) + CASE WHEN c_custkey % 2 = 1 THEN 5 ELSE 0 END AS INT) AS Age FROM customer)
    SELECT t.row_id, {extra}Age, CAST(period // 100 AS INT) AS TestDate_year, CAST(period % 100 AS INT) AS TestDate_month, ym_index AS YearMonthIndex, h.* EXCLUDE row_id, m1.* EXCLUDE row_id, m2.* EXCLUDE row_id,
      a.* EXCLUDE row_id, e.* EXCLUDE row_id, CAST({gaps} AS INT) AS isna_sum
    FROM targets t JOIN h USING (row_id) LEFT JOIN n USING (row_id) LEFT JOIN m1 USING (row_id) LEFT JOIN m2 USING (row_id) LEFT JOIN a USING (row_id) LEFT JOIN e USING (row_id) LEFT JOIN c USING (entity)"""


@query(_matrix_sql("panel", "panel", "panel"))
def feature_matrix(spark, d):
    """All 37 features of every record, history from all records."""
    p = panel(spark, d)
    return rounded(matrix(spark, d, p, p).select("row_id", *COLUMNS), 5)


@query(_matrix_sql("r", "(SELECT * FROM r WHERE role = 'train')", "(SELECT row_id FROM r WHERE role = 'train')", _ROLE, "role, "))
def temporal_features(spark, d):
    """Training years with their own history, later years with theirs from training years, both in the training years' vocabulary."""
    r = splits.temporal(panel(spark, d), TRAIN, VALID)
    train = r.filter("role = 'train'")
    return rounded(matrix(spark, d, r, train, train).select("row_id", "role", *COLUMNS), 5)


@query(
    f"""WITH {SEQ}, {_TOK}, v AS (SELECT DISTINCT token FROM cnt), x AS (SELECT row_id, CASE WHEN token LIKE 'a1_1%' THEN 'acc' ELSE 'err' END AS kind, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM (SELECT row_id, token FROM seq, v) LEFT JOIN cnt USING (row_id, token)
      UNION ALL SELECT row_id, 'acc', len(string_split(code_1, ',')) FROM seq)
    SELECT row_id, kind, {_moments('m')} FROM x GROUP BY ALL"""
)
def token_group_moments(spark, d):
    """Moments of the counts of tokens picked by a character's place: right answers (with the length of the list beside them) and wrong ones."""
    t = _coded(spark, d).select("row_id", "tokens", "n_codes").repartition("row_id")
    counts = S.token_counts(t, "tokens")
    known = io.kept(S.vocabulary(t.select(F.explode("tokens").alias("token"))), "vocabulary")
    parts = []
    for kind, rules, scalars in (("acc", RIGHT, ["n_codes"]), ("err", WRONG, [])):
        own = S.select_tokens(counts, rules)
        parts.append(S.token_moments(t, own, S.select_tokens(known, rules).count(), "m", scalars=scalars).withColumn("kind", F.lit(kind)))
    return rounded(parts[0].unionByName(parts[1]).select("row_id", "kind", "m_std", "m_mean", "m_skew", "m_kurt"), 5)


def _filled_sql(sets: dict[str, list[str]], name: str) -> str:
    one = lambda k, cols: f"SELECT '{k}' AS {name}, CAST({len(cols)} AS BIGINT) AS columns, CAST(sum({' + '.join(f'({c} IS NOT NULL)::INT' for c in cols)}) AS BIGINT) AS filled FROM m"
    return f"WITH m AS ({_matrix_sql('panel', 'panel', 'panel')}) " + " UNION ALL ".join(one(k, c) for k, c in sets.items())


def _filled(spark, d, choose, name: str):
    """For each set of columns that ``choose`` takes from the matrix's own: how many, and how many of their values are not null."""
    p = panel(spark, d)
    made = matrix(spark, d, p, p)
    sets = choose([c for c in made.columns if c in COLUMNS])
    sums = made.agg(*[F.sum(sum((F.col(c).isNotNull().cast("long") for c in cols), F.lit(0))).alias(k) for k, cols in sets.items()])
    listed = F.array(*[F.struct(F.lit(k).alias(name), F.lit(len(cols)).cast("long").alias("columns"), F.col(k).alias("filled")) for k, cols in sets.items()])
    return sums.select(F.explode(listed).alias("x")).select("x.*")


@query(_filled_sql(X.groups(COLUMNS), '"group"'))
def column_groups(spark, d):
    """Columns of each group of the matrix, found by name and prefix, and their filled values."""
    return _filled(spark, d, X.groups, "group")


@query(_filled_sql(X.variants(COLUMNS), "variant"))
def feature_variants(spark, d):
    """Columns of each stepwise and leave-one-group-out set, and their filled values."""
    return _filled(spark, d, X.variants, "variant")


#: What the time variants read, and the matrix column behind each gap.
_REST = [c for c in COLUMNS if c not in X.ABSOLUTE]
_GAPS = {f"{p}_month_gap_{s}": f"{p}_YearMonthIndex_{s}" for p in ("prev_ab", "prev") for s in ("mean", "sum")} | {"other_test_month_gap_mean": "other_test_YearMonthIndex_mean"}


@query(_filled_sql({"full": COLUMNS, "without_absolute_time": _REST, "relative_time": [*_REST, *_GAPS.values()]}, "variant"))
def time_variants(spark, d):
    """Columns of the matrix with absolute months, without them, and with gaps to the present in their place, and their filled values."""
    p = panel(spark, d)
    # the gaps' table with a copy of each column, so one pass over the matrix serves all variants
    made = X.time_variants(matrix(spark, d, p, p).withColumns({f"__{c}": F.col(c) for c in COLUMNS}), COLUMNS)
    t = made["relative_time"][0]
    sets = {k: columns if k == "relative_time" else [f"__{c}" for c in columns] for k, (_, columns) in made.items()}
    sums = t.agg(*[F.sum(sum((F.col(c).isNotNull().cast("long") for c in columns), F.lit(0))).alias(k) for k, columns in sets.items()])
    listed = F.array(*[F.struct(F.lit(k).alias("variant"), F.lit(len(columns)).cast("long").alias("columns"), F.col(k).alias("filled")) for k, columns in sets.items()])
    return sums.select(F.explode(listed).alias("x")).select("x.*")


@query(
    f"""WITH {PANEL} SELECT row_id, entity, period, CASE WHEN side = 'A' THEN 'a' ELSE 'b' END AS origin FROM panel"""
)
def common_schema(spark, d):
    """Two tables with columns of their own, stacked in those that both have."""
    p = panel(spark, d)
    a = p.filter("side = 'A'").select("row_id", "entity", "period", "amount", F.lit("a").alias("origin"))
    b = p.filter("side = 'B'").select("row_id", "label", "entity", "period", F.lit("b").alias("origin"))
    return X.union_common(a, b)


@query(f"WITH {PANEL}, {SEQ} SELECT row_id, coalesce(code_1, '') AS code_1, coalesce(times, '') AS times, label FROM panel LEFT JOIN (SELECT row_id, code_1, times FROM seq WHERE row_id % 3 = 0) USING (row_id)")
def fill_text(spark, d):
    """Text that a join left empty becomes the empty string; numbers keep their nulls."""
    from ..sources.io import fill_text as fill

    some = seq(spark, d).filter("row_id % 3 = 0").select("row_id", "code_1", "times")
    return fill(panel(spark, d).select("row_id", "label").join(some, "row_id", "left")).select("row_id", "code_1", "times", "label")
