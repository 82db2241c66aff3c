"""Adapters from the test tables to the shapes the operators work on: panel, scored, seq, importance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, entity, side, period, ym_index, label, amount): an order is a record of its customer."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS row_id",
        "o_custkey AS entity",
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'A' ELSE 'B' END AS side",
        "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS period",
        "CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS ym_index",
        "CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT) AS label",
        "o_totalprice AS amount",
    )


PANEL = """panel AS (
  SELECT o_orderkey AS row_id, o_custkey AS entity, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'A' ELSE 'B' END AS side,
         CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS period, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS ym_index,
         CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT) AS label, o_totalprice AS amount
  FROM orders)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, entity, side, fold, y, p_m1, p_m2): an event with two scores; the second one knows the label."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS row_id",
        "user_id AS entity",
        "CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS side",
        "CAST(event_id % 5 + 1 AS INT) AS fold",
        "CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS INT) AS y",
        "least(value / 500.0D, 1.0D) AS p_m1",
        "least((value + CASE WHEN event_type = 'purchase' THEN 40 ELSE 0 END) / 600.0D, 1.0D) AS p_m2",
    )


SCORED = """scored AS (
  SELECT event_id AS row_id, user_id AS entity, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS side, CAST(event_id % 5 + 1 AS INT) AS fold,
         CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS INT) AS y, least(value / 500.0::DOUBLE, 1.0::DOUBLE) AS p_m1,
         least((value + CASE WHEN event_type = 'purchase' THEN 40 ELSE 0 END) / 600.0::DOUBLE, 1.0::DOUBLE) AS p_m2
  FROM events), long AS (
  SELECT row_id, entity, side, fold, y, 'm1' AS model, p_m1 AS p FROM scored UNION ALL SELECT row_id, entity, side, fold, y, 'm2', p_m2 FROM scored)"""


def scored_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record and model: (row_id, entity, side, fold, y, model, p)."""
    return scored(spark, sf_dir).selectExpr("row_id", "entity", "side", "fold", "y", "stack(2, 'm1', p_m1, 'm2', p_m2) AS (model, p)")


def seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, code_1, code_2, times, times_2, times_3, times_4): encoded comma lists, one row for each order."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"]
    flag = F.when(F.col("l_returnflag") == "A", "1").when(F.col("l_returnflag") == "N", "2").otherwise("3")
    status = F.when(F.col("l_linestatus") == "O", "1").otherwise("2")
    time = lambda c, by=1: F.round(F.col(c) * by).cast("int")
    lists = {"code_1": flag, "code_2": status, "times": time("l_quantity"), "times_2": time("l_discount", 100), "times_3": time("l_tax", 100), "times_4": time("l_linenumber")}
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.struct(*order, *[v.alias(n) for n, v in lists.items()]).alias("x"))
    # lines are moved as they are: nothing adds up before the shuffle, as an order has few
    rows = lines.repartition("row_id").groupBy("row_id").agg(F.array_sort(F.collect_list("x")).alias("i"))
    return rows.select("row_id", *[F.array_join(F.col("i").getField(n).cast("array<string>"), ",").alias(n) for n in lists])


_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus, l_quantity, l_discount, l_tax"
SEQ = f"""seq AS (
  SELECT l_orderkey AS row_id, string_agg(CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END, ',' {_ORDER}) AS code_1,
         string_agg(CASE l_linestatus WHEN 'O' THEN '1' ELSE '2' END, ',' {_ORDER}) AS code_2,
         string_agg(CAST(CAST(l_quantity AS INT) AS VARCHAR), ',' {_ORDER}) AS times,
         string_agg(CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR), ',' {_ORDER}) AS times_2,
         string_agg(CAST(CAST(round(l_tax * 100) AS INT) AS VARCHAR), ',' {_ORDER}) AS times_3,
         string_agg(CAST(l_linenumber AS VARCHAR), ',' {_ORDER}) AS times_4
  FROM lineitem GROUP BY l_orderkey)"""


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fold, feature, value): the mean price of the lines of a part's brand in each of five folds of orders, as a stand-in for attributions."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    fold = (F.col("l_orderkey") % 5 + 1).cast("int").alias("fold")
    return lines.groupBy(fold, F.col("p_brand").alias("feature")).agg(F.round(F.avg("l_extendedprice"), 4).alias("value"))


IMPORTANCE = """imp AS (
  SELECT CAST(l_orderkey % 5 + 1 AS INT) AS fold, p_brand AS feature, round(avg(l_extendedprice), 4) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
