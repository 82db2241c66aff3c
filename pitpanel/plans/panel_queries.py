"""History, split, feature and report queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import history as H
from ..operators import reports as R
from ..operators import scan, splits
from ..sources.fixtures import PANEL, panel
from .registry import query

TRAIN, VALID = (1995, 1999), (2000, 2001)
CHAIN = ((1995, 1996, 1997), (1995, 1997, 1998), (1995, 1998, 1999))


def rounded(df, digits: int = 6):
    """Doubles rounded, with no negative zero, so that values compare across engines."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _sql_any(p="prev_ab", where=""):
    f = f" FILTER (WHERE {where})" if where else ""
    out = []
    for x, c in (("YearMonthIndex", "ym_index"), ("all_label", "label")):
        out += [f"round(avg(s.{c}){f}, 6) AS {p}_{x}_mean", f"CAST(sum(s.{c}){f} AS BIGINT) AS {p}_{x}_sum", f"round(stddev_samp(s.{c}){f}, 6) AS {p}_{x}_std"]
    return ", ".join(out)


_OTHER = ", ".join(
    [
        "nullif(count(s.row_id) FILTER (WHERE s.side <> t.side), 0) AS other_test_Test_id_count",
        "round(avg(s.ym_index) FILTER (WHERE s.side <> t.side), 6) AS other_test_YearMonthIndex_mean",
        "round(stddev_samp(s.ym_index) FILTER (WHERE s.side <> t.side), 6) AS other_test_YearMonthIndex_std",
        "round(avg(s.label) FILTER (WHERE s.side <> t.side), 6) AS other_test_Label_mean",
    ]
)
_ALL = f"{_sql_any()}, {_sql_any('prev', 's.side = t.side')}, {_OTHER}"


def _hist(keys: str, aggs: str, targets: str = "panel", sources: str = "panel", on: str = "", ctes: str = "") -> str:
    group = ", ".join(f"t.{k}" for k in keys.split())
    return f"WITH {PANEL}{ctes} SELECT {group}, {aggs} FROM {targets} t LEFT JOIN {sources} s ON s.entity = t.entity AND s.period < t.period{on} GROUP BY {group}"


_FOLDS = ", d AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) - 1) % 5 + 1 AS INT) AS own FROM panel)"
_EACH = _FOLDS + ", e AS (SELECT d.*, CAST(f AS INT) AS fold, CASE WHEN f = own THEN 'valid' ELSE 'train' END AS role FROM d, range(1, 6) r(f)), src AS (SELECT * FROM e WHERE role = 'train')"
_ENTITY = """, ent AS (SELECT entity, CAST((row_number() OVER (ORDER BY pos DESC, n DESC, md5('42:' || entity), entity) - 1) % 10 AS INT) AS z
  FROM (SELECT entity, sum(label) AS pos, count(*) AS n FROM panel GROUP BY entity)),
 g AS (SELECT p.*, CASE WHEN z < 5 THEN z + 1 ELSE 10 - z END AS fold FROM panel p JOIN ent USING (entity))"""


@query(_hist("row_id", _sql_any()))
def hist_any_side(spark, d):
    p = panel(spark, d)
    return rounded(H.fold_history(p, p, blocks=("any",)).select("row_id", *H.ANY))


@query(_hist("row_id", _sql_any("prev", "s.side = t.side")))
def hist_same_side(spark, d):
    p = panel(spark, d)
    return rounded(H.fold_history(p, p, blocks=("same",)).select("row_id", *H.SAME))


@query(_hist("row_id", _OTHER))
def hist_opposite_side(spark, d):
    p = panel(spark, d)
    return rounded(H.fold_history(p, p, blocks=("other",)).select("row_id", *H.OTHER))


@query(_hist("fold row_id role", _ALL, "e", "src", " AND s.fold = t.fold", _EACH))
def hist_fold_isolated(spark, d):
    p = panel(spark, d)
    return rounded(H.fold_isolated(splits.stratified(p), hot=scan.hot_values(p)).select("fold", "row_id", "role", *H.FEATURES))


@query(_hist("row_id", _sql_any(), "(SELECT * FROM panel WHERE period >= 200001)", "(SELECT * FROM panel WHERE period < 200001)"))
def hist_static_source(spark, d):
    p = panel(spark, d)
    return rounded(H.static_history(p.filter("period >= 200001"), p.filter("period < 200001")).select("row_id", *H.ANY))


@query(_hist("row_id", _ALL, "v", "v", "", _ENTITY + ", v AS (SELECT * FROM g WHERE fold = 1)"))
def hist_self_valid(spark, d):
    v = splits.grouped(panel(spark, d)).filter("fold = 1")
    return rounded(H.fold_history(v, v).select("row_id", *H.FEATURES))


@query(_hist("fold row_id", _ALL, "v", "v", " AND s.fold = t.fold", _ENTITY + ", v AS (SELECT * EXCLUDE fold, CAST(fold AS INT) AS fold FROM g)"))
def hist_self_valid_all(spark, d):
    """``hist_self_valid`` for the validation rows of all five folds."""
    p = panel(spark, d)
    v = splits.grouped(p)
    return rounded(H.fold_history(v, v, ["fold"], hot=scan.hot_values(p)).select("fold", "row_id", *H.FEATURES))


_ROLE = ", r AS (SELECT *, CASE WHEN period // 100 <= 1999 THEN 'train' ELSE 'valid' END AS role FROM panel WHERE period // 100 BETWEEN 1995 AND 2001)"


@query(_hist("row_id role", _ALL, "r", "(SELECT * FROM r WHERE role = 'train')", "", _ROLE))
def hist_temporal(spark, d):
    p = panel(spark, d)
    r = splits.temporal(p, TRAIN, VALID)
    return rounded(H.fold_history(r, r.filter("role = 'train'"), hot=scan.hot_values(p)).select("row_id", "role", *H.FEATURES))


@query(
    f"""WITH {PANEL} SELECT t.entity, t.period, count(*) AS n, CAST(sum(s.label) AS BIGINT) AS label_sum, CAST(sum(s.ym_index) AS BIGINT) AS ym_sum, round(stddev_samp(s.ym_index), 6) AS ym_std
    FROM (SELECT DISTINCT entity, period FROM panel) t JOIN panel s ON s.entity = t.entity AND s.period <= t.period GROUP BY ALL"""
)
def hist_entity_month_state(spark, d):
    return rounded(H.month_state(panel(spark, d)).select("entity", "period", "n", "label_sum", "ym_sum", "ym_std"))


_HOT = PANEL + """, hp AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS entity, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'A' WHEN o_orderkey % 11 <> 0 THEN 'B' END AS side,
  CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INT) AS period, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS ym_index,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT) AS label FROM orders)"""


def hot_panel(spark, d):
    """The panel by days, with a third of all records on one entity and some without side."""
    rows = panel(spark, d).join(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("row_id"), "o_orderdate"), "row_id")
    day = F.year("o_orderdate") * 10000 + F.month("o_orderdate") * 100 + F.dayofmonth("o_orderdate")
    side = F.when((F.col("side") == "A") | (F.col("row_id") % 11 != 0), F.col("side"))
    return rows.select("row_id", F.when(F.col("row_id") % 3 == 0, 0).otherwise(F.col("entity")).cast("long").alias("entity"), side.alias("side"), day.cast("int").alias("period"), "ym_index", "label")


def hot_entities(p):
    """Entities with more rows than a task of a cluster should hold, were the tables a hundred times as large."""
    return scan.hot_values(p, least=1000, small=0)


@query(_hist("row_id", _ALL, "hp", "hp").replace(PANEL, _HOT))
def hist_hot_entity(spark, d):
    """All three blocks where an entity holds a third of all records: it is summed by day and scanned in two levels."""
    p = hot_panel(spark, d)
    return rounded(H.fold_history(p, p, hot=hot_entities(p)).select("row_id", *H.FEATURES))


@query(
    _hist("fold row_id role", _ALL, "e", "src", " AND s.fold = t.fold", _EACH).replace(PANEL, _HOT).replace("d AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) - 1) % 5 + 1 AS INT) AS own FROM panel)", "d AS (SELECT *, CAST(row_id % 5 + 1 AS INT) AS own FROM hp)")
)
def hist_hot_entity_folds(spark, d):
    """Fold-isolated histories where an entity holds a third of all records."""
    p = hot_panel(spark, d).withColumn("fold", (F.col("row_id") % 5 + 1).cast("int"))
    return rounded(H.fold_isolated(p, hot=hot_entities(p)).select("fold", "row_id", "role", *H.FEATURES))


_SHIPPED = """, t AS (SELECT l_orderkey AS row_id, l_linenumber AS line, l_partkey AS part, o_custkey AS entity, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'A' ELSE 'B' END AS side,
  CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS period FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def shipped(spark, d):
    """Another table of targets: lines by the month they were shipped, with their customer and the order's side."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("int").alias("period"))
    return lines.join(panel(spark, d).select("row_id", "entity", "side"), "row_id")


def _merged(by: str) -> str:
    on = " AND ".join(f"s.{k} = t.{k}" for k in by.split())
    return f"""WITH {PANEL}{_SHIPPED}, u AS (SELECT DISTINCT {", ".join(by.split())}, period FROM t),
    m AS (SELECT {", ".join("t." + k for k in by.split())}, t.period, nullif(count(s.row_id), 0) AS n, CAST(sum(s.label) AS BIGINT) AS label_sum, CAST(sum(s.ym_index) AS BIGINT) AS ym_sum, round(stddev_samp(s.ym_index), 6) AS ym_std
      FROM u t LEFT JOIN panel s ON {on} AND s.period < t.period GROUP BY ALL)
    SELECT row_id, line, part, entity, side, period, n, label_sum, ym_sum, ym_std FROM t JOIN m USING ({", ".join(by.split())}, period)"""


@query(_merged("entity"))
def hist_state_merge(spark, d):
    """Targets of another table meet their entity's latest earlier monthly state."""
    out = H.merge_state(shipped(spark, d), H.month_state(panel(spark, d)))
    return rounded(out.select("row_id", "line", "part", "entity", "side", "period", "n", "label_sum", "ym_sum", "ym_std"))


@query(_merged("entity side"))
def hist_state_merge_side(spark, d):
    """The same by entity and side."""
    out = H.merge_state(shipped(spark, d), H.month_state(panel(spark, d), ("entity", "side")), ("entity", "side"))
    return rounded(out.select("row_id", "line", "part", "entity", "side", "period", "n", "label_sum", "ym_sum", "ym_std"))


@query(
    f"""WITH {PANEL}{_EACH},
    w AS (SELECT t.row_id, count(s.row_id) AS n, sum(s.label) AS l FROM panel t LEFT JOIN panel s ON s.entity = t.entity AND s.period < t.period GROUP BY ALL),
    i AS (SELECT t.fold, t.role, t.row_id, count(s.row_id) AS n, sum(s.label) AS l FROM e t LEFT JOIN src s ON s.entity = t.entity AND s.period < t.period AND s.fold = t.fold GROUP BY ALL)
    SELECT fold, role, count(*) AS n, CAST(sum((w.n <> i.n)::INT) AS BIGINT) AS changed, round(avg((w.n <> i.n)::INT), 6) AS changed_rate FROM i JOIN w USING (row_id) GROUP BY ALL"""
)
def hist_fold_diff(spark, d):
    """Rows whose any-side history differs between all data and the fold's training rows: they lost a source."""
    p = splits.stratified(panel(spark, d))
    isolated = H.fold_isolated(p).select("fold", "role", "row_id", *H.ANY)
    whole = H.fold_history(p, p, blocks=("any",)).select("row_id", *H.ANY)
    whole = whole.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(5))))
    out = H.history_diff(isolated, whole, ["fold", "row_id"], H.ANY).groupBy("fold", "role")
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("changed"), F.avg(F.col("changed").cast("int")).alias("changed_rate")))


_BY_BLOCK = [(b, c) for b, cs in H.BLOCKS.items() for c in (*cs, None)]


@query(
    f"""WITH {PANEL}{_EACH}, i AS (SELECT t.fold, t.role, t.row_id, {_ALL} FROM e t LEFT JOIN src s ON s.entity = t.entity AND s.period < t.period AND s.fold = t.fold GROUP BY ALL),
    w AS (SELECT t.row_id, {_ALL} FROM panel t LEFT JOIN panel s ON s.entity = t.entity AND s.period < t.period GROUP BY ALL),
    x AS (SELECT i.fold, i.role, {", ".join(f"(i.{c} IS DISTINCT FROM w.{c})::INT AS {c}" for c in H.FEATURES)} FROM i JOIN w USING (row_id)),
    g AS (SELECT fold, role, count(*) AS n, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in H.FEATURES)}, {", ".join(f"CAST(sum(greatest({', '.join(cs)})) AS BIGINT) AS any_{b}" for b, cs in H.BLOCKS.items())} FROM x GROUP BY ALL)
    """
    + " UNION ALL ".join(f"""SELECT fold, role, '{b}' AS block, {f"'{c}'" if c else "NULL"} AS "column", n, {c or "any_" + b} AS changed, round({c or "any_" + b} / n, 6) AS changed_rate FROM g""" for b, c in _BY_BLOCK)
)
def hist_fold_diff_columns(spark, d):
    """All 16 columns and three blocks: rows of each fold and role whose history differs between all data and the fold's training rows."""
    p = panel(spark, d)
    hot = scan.hot_values(p)
    s = splits.stratified(p)
    isolated = H.fold_isolated(s, hot=hot).select("fold", "role", "row_id", *H.FEATURES)
    whole = H.fold_history(p, p, hot=hot).select("row_id", *H.FEATURES).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return rounded(H.history_diff_columns(isolated, whole, ["fold", "row_id"], ["fold", "role"]))


@query(f"WITH {PANEL} SELECT count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM panel")
def hist_bruteforce_mismatch(spark, d):
    """Range windows against the theta join, all rows and all 16 columns."""
    p = panel(spark, d)
    out = H.history_diff(H.fold_history(p, p).select("row_id", *H.FEATURES), H.theta_history(p, p).select("row_id", *H.FEATURES), ["row_id"])
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("mismatches"))


@query(f"WITH {PANEL} SELECT 5 * count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM panel")
def hist_label_mutation(spark, d):
    """Flipping the labels of each fold's validation rows leaves every history of the fold as it was."""
    out = H.label_mutation(splits.stratified(panel(spark, d)), lambda trains, label: F.when(trains, label).otherwise(1 - label))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("mismatches"))


@query(
    f"""WITH {PANEL}, h AS (SELECT t.row_id, t.ym_index, avg(s.ym_index) AS m, sum(s.ym_index) AS k, count(s.row_id) AS n,
      avg(s.ym_index) FILTER (WHERE s.side = t.side) AS m1, sum(s.ym_index) FILTER (WHERE s.side = t.side) AS k1, count(s.row_id) FILTER (WHERE s.side = t.side) AS n1,
      avg(s.ym_index) FILTER (WHERE s.side <> t.side) AS m2
      FROM panel t LEFT JOIN panel s ON s.entity = t.entity AND s.period < t.period GROUP BY ALL)
    SELECT row_id, round(ym_index - m, 6) AS prev_ab_month_gap_mean, CAST(n * ym_index - k AS DOUBLE) AS prev_ab_month_gap_sum, round(ym_index - m1, 6) AS prev_month_gap_mean,
      CAST(n1 * ym_index - k1 AS DOUBLE) AS prev_month_gap_sum, round(ym_index - m2, 6) AS other_test_month_gap_mean FROM h"""
)
def relative_time(spark, d):
    p = panel(spark, d)
    out = H.relative_time(H.fold_history(p, p))
    return rounded(out.select("row_id", "prev_ab_month_gap_mean", "prev_ab_month_gap_sum", "prev_month_gap_mean", "prev_month_gap_sum", "other_test_month_gap_mean"))


_MISS = f"""WITH {PANEL}, h AS (SELECT t.row_id, t.amount, count(s.row_id) AS n, count(s.row_id) FILTER (WHERE s.side = t.side) AS n1, count(s.row_id) FILTER (WHERE s.side <> t.side) AS n2
  FROM panel t LEFT JOIN panel s ON s.entity = t.entity AND s.period < t.period GROUP BY ALL),
 m AS (SELECT row_id, amount, CASE WHEN n = 0 THEN 6 WHEN n = 1 THEN 2 ELSE 0 END + CASE WHEN n1 = 0 THEN 6 WHEN n1 = 1 THEN 2 ELSE 0 END + CASE WHEN n2 = 0 THEN 4 WHEN n2 = 1 THEN 1 ELSE 0 END AS c FROM h)"""


@query(_MISS + " SELECT row_id, CAST(c + (amount IS NULL)::INT AS INT) AS isna_sum FROM m")
def missing_count(spark, d):
    from ..operators.sequences import missing_count as missing

    p = panel(spark, d)
    return H.fold_history(p, p).select("row_id", missing(["amount", *H.FEATURES]).alias("isna_sum"))


@query(
    f"""WITH {PANEL}{_EACH}, h AS (SELECT t.fold, t.row_id, count(s.row_id) AS n, count(s.row_id) FILTER (WHERE s.side = t.side) AS n1, count(s.row_id) FILTER (WHERE s.side <> t.side) AS n2
      FROM e t LEFT JOIN src s ON s.entity = t.entity AND s.period < t.period AND s.fold = t.fold WHERE t.fold = 1 GROUP BY ALL)
    SELECT row_id, CAST(CASE WHEN n = 0 THEN 6 WHEN n = 1 THEN 2 ELSE 0 END + CASE WHEN n1 = 0 THEN 6 WHEN n1 = 1 THEN 2 ELSE 0 END + CASE WHEN n2 = 0 THEN 4 WHEN n2 = 1 THEN 1 ELSE 0 END AS INT) AS isna_sum FROM h"""
)
def missing_count_swap(spark, d):
    """The missing count after the whole-data history of a matrix is swapped for that of fold 1: the other columns' part stays."""
    from ..operators.features import swap_history

    p = splits.stratified(panel(spark, d))
    from ..operators.sequences import missing_count as missing

    base = H.fold_history(p, p).withColumn("isna_sum", missing(["amount", *H.FEATURES]))
    one = H.explode_folds(p, "fold", 5).filter("fold = 1")
    new = H.fold_history(one, one.filter("role = 'train'"), ["fold"]).select("row_id", *H.FEATURES)
    return swap_history(base, new, "row_id").select("row_id", "isna_sum")


@query(
    f"""WITH {PANEL}{_EACH}, h AS (SELECT t.fold, t.row_id, t.amount, count(s.row_id) AS n, count(s.row_id) FILTER (WHERE s.side = t.side) AS n1, count(s.row_id) FILTER (WHERE s.side <> t.side) AS n2
      FROM e t LEFT JOIN src s ON s.entity = t.entity AND s.period < t.period AND s.fold = t.fold GROUP BY ALL)
    SELECT fold, row_id, CAST((amount IS NULL)::INT + CASE WHEN n = 0 THEN 6 WHEN n = 1 THEN 2 ELSE 0 END + CASE WHEN n1 = 0 THEN 6 WHEN n1 = 1 THEN 2 ELSE 0 END + CASE WHEN n2 = 0 THEN 4 WHEN n2 = 1 THEN 1 ELSE 0 END AS INT) AS isna_sum FROM h"""
)
def missing_count_swap_all(spark, d):
    """``missing_count_swap`` for all five folds: every row once in each of them."""
    from ..operators.features import swap_history
    from ..operators.sequences import missing_count as missing

    p = splits.stratified(panel(spark, d))
    base = H.fold_history(p, p).withColumn("isna_sum", missing(["amount", *H.FEATURES]))
    base = base.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return swap_history(base, H.fold_isolated(p), ["fold", "row_id"]).select("fold", "row_id", "isna_sum")


@query(_MISS + " SELECT row_id, round(amount, 6) AS amount, CAST((amount IS NULL)::INT AS INT) AS isna_sum FROM m")
def no_history_features(spark, d):
    from ..operators.features import without_history
    from ..operators.sequences import missing_count as missing

    p = panel(spark, d)
    base = H.fold_history(p, p).withColumn("isna_sum", missing(["amount", *H.FEATURES]))
    return rounded(without_history(base).select("row_id", "amount", "isna_sum"))


@query(f"WITH {PANEL} SELECT row_id, CAST(period // 100 AS INT) AS year, CAST(period % 100 AS INT) AS month, CAST(period // 100 * 12 + period % 100 AS INT) AS ym FROM panel")
def period_parts(spark, d):
    y, m = F.floor(F.col("period") / 100).cast("int"), F.pmod("period", F.lit(100)).cast("int")
    return panel(spark, d).select("row_id", y.alias("year"), m.alias("month"), (y * 12 + m).cast("int").alias("ym"))


@query("SELECT c_custkey AS entity, CAST(20 + 10 * (c_nationkey % 6) + CASE WHEN c_custkey % 2 = 1 THEN 5 ELSE 0 END AS INT) AS age FROM customer")
def age_band(spark, d):
    text = F.concat((20 + 10 * (F.col("c_nationkey") % 6)).cast("string"), F.when(F.col("c_custkey") % 2 == 1, "b").otherwise("a"))
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("entity"), C.age_band(text).alias("age"))


@query(f"WITH {PANEL} SELECT row_id, entity, side, period, CASE WHEN side = 'A' THEN amount END AS a_amount, CASE WHEN side = 'B' THEN label END AS b_flag FROM panel")
def side_union(spark, d):
    """Two detail tables with their own columns, projected, renamed and stacked; what a side lacks is null."""
    p = panel(spark, d)
    a = p.filter("side = 'A'").select("row_id", "entity", "side", "period", F.col("amount").alias("a_amount"))
    b = p.filter("side = 'B'").select("row_id", "entity", "side", "period", F.col("label").alias("b_flag"))
    return a.unionByName(b, allowMissingColumns=True)


# ---------------------------------------------------------------- splits


@query(f"WITH {PANEL}{_FOLDS} SELECT row_id, label, own AS fold FROM d")
def split_stratified(spark, d):
    return splits.stratified(panel(spark, d)).select("row_id", "label", "fold")


@query(f"WITH {PANEL}{_ENTITY} SELECT row_id, entity, CAST(fold AS INT) AS fold FROM g")
def split_group(spark, d):
    return splits.grouped(panel(spark, d)).select("row_id", "entity", "fold")


@query(f"WITH {PANEL}{_ROLE} SELECT row_id, role FROM r")
def split_temporal(spark, d):
    return splits.temporal(panel(spark, d), TRAIN, VALID).select("row_id", "role")


@query(
    f"""WITH {PANEL}{_FOLDS}, e AS (SELECT d.*, CAST(f AS INT) AS outer_fold FROM d, range(1, 6) r(f) WHERE f <> own)
    SELECT outer_fold, row_id, CAST((row_number() OVER (PARTITION BY outer_fold, label ORDER BY md5('43:' || row_id), row_id) - 1) % 3 + 1 AS INT) AS inner_fold FROM e"""
)
def split_inner(spark, d):
    return splits.inner(splits.stratified(panel(spark, d))).select("outer_fold", "row_id", "inner_fold")


@query(
    f"""WITH {PANEL}{_ENTITY}, e AS (SELECT g.* EXCLUDE fold, CAST(f AS INT) AS outer_fold FROM g, range(1, 6) r(f) WHERE f <> g.fold),
    n AS (SELECT outer_fold, entity, sum(label) AS pos, count(*) AS n FROM e GROUP BY ALL),
    a AS (SELECT *, (row_number() OVER (PARTITION BY outer_fold ORDER BY pos DESC, n DESC, md5('43:' || entity), entity) - 1) % 6 AS z FROM n)
    SELECT outer_fold, row_id, CAST(CASE WHEN z < 3 THEN z + 1 ELSE 6 - z END AS INT) AS inner_fold FROM e JOIN a USING (outer_fold, entity)"""
)
def split_inner_group(spark, d):
    return splits.inner(splits.grouped(panel(spark, d)), group=True).select("outer_fold", "row_id", "inner_fold")


@query(
    f"""WITH {PANEL}, s(i, a, b, c) AS (VALUES (1, 1995, 1996, 1997), (2, 1995, 1997, 1998), (3, 1995, 1998, 1999))
    SELECT CAST(i AS INT) AS inner_fold, row_id, CASE WHEN period // 100 = c THEN 'valid' ELSE 'train' END AS role FROM panel JOIN s ON period // 100 BETWEEN a AND c"""
)
def split_forward_chain(spark, d):
    return splits.forward_chain(panel(spark, d), CHAIN).select("inner_fold", "row_id", "role")


@query(
    f"""WITH {PANEL}{_ENTITY} SELECT CAST(f AS INT) AS fold, CAST(count(*) FILTER (WHERE fold <> f) AS BIGINT) AS train_rows, CAST(count(*) FILTER (WHERE fold = f) AS BIGINT) AS valid_rows,
    CAST(sum(label) FILTER (WHERE fold = f) AS BIGINT) AS valid_positives, CAST(0 AS BIGINT) AS row_overlap, CAST(0 AS BIGINT) AS entity_overlap FROM g, range(1, 6) r(f) GROUP BY f"""
)
def split_audit(spark, d):
    return splits.audit(splits.grouped(panel(spark, d)))


@query(f"WITH {PANEL} SELECT row_id, entity FROM panel ORDER BY md5('42:' || row_id), row_id LIMIT 500")
def sample_rows(spark, d):
    return splits.sample(panel(spark, d), 500).select("row_id", "entity")


@query(f"WITH {PANEL}, s AS (SELECT DISTINCT entity FROM panel ORDER BY md5('42:' || entity), entity LIMIT 100) SELECT row_id, entity, side FROM panel WHERE entity IN (SELECT entity FROM s)")
def sample_semi(spark, d):
    """All records of a sample of entities."""
    p = panel(spark, d)
    return p.join(splits.sample(p.select("entity").distinct(), 100, "entity"), "entity", "left_semi").select("row_id", "entity", "side")


# ---------------------------------------------------------------- reports


@query(
    f"""WITH {PANEL}, h AS (SELECT t.row_id, t.side, t.label, nullif(count(s.row_id), 0) AS c, avg(s.label) AS l FROM panel t LEFT JOIN panel s ON s.entity = t.entity AND s.period < t.period AND s.side <> t.side GROUP BY ALL)
    SELECT coalesce(side, 'all') AS side, count(*) AS n, round(avg(label), 6) AS rate, count(c) AS other_test_Test_id_count_count, round(avg(c), 6) AS other_test_Test_id_count_mean,
    count(l) AS other_test_Label_mean_count, round(avg(l), 6) AS other_test_Label_mean_mean FROM h GROUP BY ROLLUP (side)"""
)
def availability_rollup(spark, d):
    p = panel(spark, d)
    return rounded(R.composition(H.fold_history(p, p, blocks=("other",)), ["other_test_Test_id_count", "other_test_Label_mean"]))


@query(f"WITH {PANEL} SELECT CAST(period // 100 AS INT) AS year, side, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS rate FROM panel GROUP BY ALL")
def year_side_distribution(spark, d):
    return rounded(R.year_side(panel(spark, d)))


@query(
    f"""WITH {PANEL} SELECT CAST(period // 100 AS INT) AS year, count(*) FILTER (WHERE side = 'A') AS n_A, round(avg(label) FILTER (WHERE side = 'A'), 6) AS rate_A, round(avg((side = 'A')::INT), 6) AS share_A,
    count(*) FILTER (WHERE side = 'B') AS n_B, round(avg(label) FILTER (WHERE side = 'B'), 6) AS rate_B, round(avg((side = 'B')::INT), 6) AS share_B, count(*) AS n FROM panel GROUP BY 1"""
)
def year_side_pivot(spark, d):
    return rounded(R.year_side_wide(panel(spark, d)))


@query(f"WITH {PANEL} SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM panel GROUP BY label")
def class_share(spark, d):
    return rounded(R.class_share(panel(spark, d)))


@query(
    f"WITH {PANEL}, e AS (SELECT entity, count(*) AS c FROM panel GROUP BY 1) SELECT CAST(least(c, 4) AS INT) AS records, count(*) AS entities, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM e GROUP BY 1"
)
def records_per_entity(spark, d):
    return rounded(R.per_entity(panel(spark, d)))


@query(f"WITH {PANEL}, e AS (SELECT count(*) OVER (PARTITION BY entity) AS c FROM panel) SELECT round(avg((c > 1)::INT), 6) AS repeat_share FROM e")
def repeat_record_share(spark, d):
    return rounded(R.repeat_share(panel(spark, d)))


@query(f"WITH {PANEL}, e AS (SELECT entity, count(DISTINCT side) AS c FROM panel GROUP BY 1) SELECT count(*) AS entities, round(avg((c > 1)::INT), 6) AS both_share FROM e")
def both_sides_share(spark, d):
    return rounded(R.both_sides(panel(spark, d)))


@query(f"WITH {PANEL} SELECT coalesce(side, 'all') AS side, count(*) AS n, round(avg(label), 6) AS rate FROM panel GROUP BY ROLLUP (side)")
def composition_rollup(spark, d):
    return rounded(R.composition(panel(spark, d)))


@query(
    f"""WITH {PANEL}, o AS (SELECT entity, period, count(*) AS n FROM panel WHERE period < 200001 GROUP BY ALL), w AS (SELECT entity, period, count(*) AS n FROM panel WHERE period >= 199907 GROUP BY ALL)
    SELECT * FROM w UNION ALL SELECT o.* FROM o ANTI JOIN w USING (entity, period)"""
)
def keyed_upsert(spark, d):
    """Monthly counts up to 1999, replaced and continued by counts from July 1999 on."""
    count = lambda x: x.groupBy("entity", "period").agg(F.count(F.lit(1)).alias("n"))
    p = panel(spark, d)
    return R.upsert(count(p.filter("period < 200001")), count(p.filter("period >= 199907")), ["entity", "period"])


@query(f"WITH {PANEL} SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5(row_id || '|' || entity || '|' || side || '|' || period || '|' || label), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM panel")
def fingerprint(spark, d):
    return R.fingerprint(panel(spark, d), ["row_id", "entity", "side", "period", "label"])


#: What a feature table of the panel has to have.
_WANTED = ("row_id", "entity", "side", "period", "ym_index", "label", "amount")


def _six(features, targets):
    return R.checks(features, "row_id", "label").unionByName(R.aligned(features, targets, "row_id", "label", _WANTED))


@query(
    f"""WITH {PANEL}, t AS (SELECT o_orderkey AS row_id, (o_orderstatus = 'F')::INT AS label FROM orders),
    m AS (SELECT count(*) AS d FROM ((SELECT row_id, label FROM panel EXCEPT ALL SELECT * FROM t) UNION ALL (SELECT * FROM t EXCEPT ALL SELECT row_id, label FROM panel)))
    SELECT 'unique_key' AS "check", count(*) - count(DISTINCT row_id) AS value, count(*) = count(DISTINCT row_id) AS ok FROM panel UNION ALL
    SELECT 'null_key', count(*) FILTER (WHERE row_id IS NULL), count(*) FILTER (WHERE row_id IS NULL) = 0 FROM panel UNION ALL
    SELECT 'binary_label', count(*) FILTER (WHERE label NOT IN (0, 1)), count(*) FILTER (WHERE label NOT IN (0, 1)) = 0 FROM panel UNION ALL
    SELECT 'length', abs((SELECT count(*) FROM panel) - (SELECT count(*) FROM t)), (SELECT count(*) FROM panel) = (SELECT count(*) FROM t) UNION ALL
    SELECT 'label_equal', (d > 0)::BIGINT, d = 0 FROM m UNION ALL SELECT 'schema', 0::BIGINT, true"""
)
def panel_checks(spark, d):
    """Six checks of the panel against the table that its labels come from: keys, labels, length, equal labels, columns."""
    targets = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    return _six(panel(spark, d), targets)


#: A fault for each check, planted by itself: the value that the check must give, in SQL over the panel.
_PLANTED = {
    "unique_key": "(SELECT count(*) FROM panel WHERE row_id % 97 = 0)",
    "null_key": "1",
    "binary_label": "(SELECT count(*) FROM panel WHERE row_id % 89 = 0)",
    "length": "(SELECT count(*) FROM panel WHERE row_id % 83 = 0)",
    "label_equal": "(SELECT (count(DISTINCT label) = 2)::BIGINT FROM panel WHERE row_id % 79 = 0)",
    "schema": "1",
}


@query(f"WITH {PANEL} " + " UNION ALL ".join(f"""SELECT '{k}' AS fault, CAST({v} AS BIGINT) AS value, {v} = 0 AS ok FROM (SELECT 1)""" for k, v in _PLANTED.items()))
def panel_checks_faults(spark, d):
    """Each of the six checks with its fault planted: repeated rows, null keys, labels of 2, dropped rows, two labels changed for each other, a column that lacks."""
    p = panel(spark, d)
    key, label = F.col("row_id"), F.col("label")
    other = p.withColumn("label", F.when(key % 79 == 0, 1 - label).otherwise(label))  # as many rows, other labels
    planted = {
        "unique_key": (p.unionByName(p.filter(key % 97 == 0)), p),
        "null_key": (p.withColumn("row_id", F.when(key % 101 != 0, key)), p),
        "binary_label": (p.withColumn("label", F.when(key % 89 == 0, 2).otherwise(label)), p),
        "length": (p.filter(key % 83 != 0), p),
        "label_equal": (other, p),
        "schema": (p.drop("amount"), p),
    }
    out = [_six(*tables).filter(F.col("check") == name).select(F.lit(name).alias("fault"), "value", "ok") for name, tables in planted.items()]
    return reduce(DataFrame.unionByName, out)


@query(f"WITH {PANEL} SELECT side, count(*) AS n, printf('%.2f%%', 100 * avg(label)) AS rate_text FROM panel GROUP BY side")
def display_format(spark, d):
    return panel(spark, d).groupBy("side").agg(F.count(F.lit(1)).alias("n"), C.format_share(F.avg("label")).alias("rate_text"))
