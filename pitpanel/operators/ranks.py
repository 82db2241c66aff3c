"""Global ranks and prefix sums without a single-partition window.

Rows are dealt to buckets by quantiles of the order column, a few for each shuffle
partition; a window runs inside each bucket and an offset, a prefix sum over the
bucket totals of each group, is added. Exact whatever the edges are. A value that
several quantiles fall on holds many rows: they are dealt again, by quantiles of
the column that breaks ties.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets at least and at most; between them, two for each shuffle partition.
EDGES = (64, 4096)


def quantiles(df: DataFrame, *columns: str, most: int | None = None) -> list[list[float]]:
    """Of each column, in one pass: ascending quantiles, repeated where a value holds many rows; few, whatever the number of rows."""
    most = most or min(max(EDGES[0], 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), EDGES[1])
    shares = [i / most for i in range(1, most)]
    return [sorted(x or []) for x in df.agg(*[F.percentile_approx(F.col(c), shares, 10 * most) for c in columns]).first()]


def ordinal(df: DataFrame, column: str) -> Column:
    """A number that ascends with the column: itself, or a string's first six bytes. Equal numbers need the column itself to be told apart."""
    if dict(df.dtypes)[column] not in ("string", "binary"):
        return F.col(column)
    return F.conv(F.rpad(F.substring(F.hex(F.col(column).cast("binary")), 1, 12), 12, "0"), 16, 10).cast("double")


def edges(df: DataFrame, column: str, most: int | None = None) -> list[float]:
    """Ascending different quantiles."""
    return sorted(set(quantiles(df, column, most=most)[0]))


def with_bucket(df: DataFrame, name: str, column: Column, cuts: Sequence[float]) -> DataFrame:
    """``df`` with ``name``, the number of edges at or below the (numeric) column, by binary search; nulls lie below all, as they sort."""
    inner = sorted({float(c) for c in cuts if math.isfinite(c)})
    if not inner:
        return df.withColumn(name, F.lit(0))
    rows = df.withColumn("__edge", F.coalesce(column.cast("double"), F.lit(-math.inf)))
    rows = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="__edge", outputCol="__found", handleInvalid="keep").transform(rows)
    return rows.withColumn(name, F.col("__found").cast("int")).drop("__edge", "__found")


def prefix_sums(df: DataFrame, groups: Sequence[str], order: str, values: Sequence[str], cuts: Sequence[float] | None = None) -> DataFrame:
    """``df`` (one row for each value of ``order`` in a group) with ``below_<v>``, the sum over smaller ones, and ``all_<v>``.

    A column ``__b`` that ``df`` has is taken as the rows' buckets.
    """
    rows = df if "__b" in df.columns else with_bucket(df, "__b", F.col(order), edges(df, order) if cuts is None else cuts)
    by = Window.partitionBy(*groups)
    before = by.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    total = rows.groupBy(*groups, "__b").agg(*[F.sum(v).alias("__t_" + v) for v in values])
    total = total.select(
        *[F.col(g).alias("__g_" + g) for g in groups],
        F.col("__b").alias("__bb"),
        *[F.coalesce(F.sum("__t_" + v).over(before), F.lit(0)).alias("__o_" + v) for v in values],
        *[F.sum("__t_" + v).over(by).alias("all_" + v) for v in values],
    )
    on = F.col("__b") == F.col("__bb")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col("__g_" + g))
    inside = Window.partitionBy(*groups, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({"__s_" + v: F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).join(total, on)
    out = out.withColumns({"below_" + v: F.col("__o_" + v) + F.col("__s_" + v) for v in values})
    return out.drop("__b", "__bb", *["__g_" + g for g in groups], *[x + v for v in values for x in ("__o_", "__s_")])


def row_numbers(df: DataFrame, groups: Sequence[str], order: str, tie: str, descending: bool = False, cuts: Sequence[float] | None = None) -> DataFrame:
    """``df`` with ``rn`` (from 0, by ``order``, equals by ascending ``tie``) and ``n`` (rows of the group)."""
    found = quantiles(df, order)[0] if cuts is None else list(cuts)
    rows, own = with_bucket(df, "__b", F.col(order), found), F.col("__b")
    often = sorted({a for a, b in zip(found, found[1:], strict=False) if a == b})
    if often:  # rows of a frequent value come before (descending: behind) the others of its bucket, by their tie
        parts = edges(df.select(ordinal(df, tie).alias("__t")), "__t")
        size = len(parts) + 2
        rows = with_bucket(rows, "__tie", ordinal(df, tie), parts)
        late = F.when(F.col(order).isin(often), F.col("__tie") + (1 if descending else 0)).otherwise(0 if descending else size - 1)
        place = own * (-size if descending else size) + late
    else:
        place = own * (-1 if descending else 1)
    rows = rows.withColumn("__b", place).drop("__tie")
    by = Window.partitionBy(*groups)
    counts = rows.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = by.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *[F.col(g).alias("__g_" + g) for g in groups], F.col("__b").alias("__bb"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"), F.sum("__c").over(by).alias("n")
    )
    on = F.col("__b") == F.col("__bb")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col("__g_" + g))
    inside = Window.partitionBy(*groups, "__b").orderBy(F.desc(order) if descending else F.asc(order), tie)
    out = rows.withColumn("__r", F.row_number().over(inside)).join(counts, on).withColumn("rn", F.col("__o") + F.col("__r") - 1)
    return out.drop("__b", "__bb", "__o", "__r", *["__g_" + g for g in groups])


def tile(rn: Column, n: Column, k: int) -> Column:
    """Bin from 0 of row ``rn`` of ``n`` in ``k`` bins; the first n mod k bins have one row more."""
    q, r = F.floor(n / k), n % k
    return F.when(rn < r * (q + 1), F.floor(rn / (q + 1))).otherwise(r + F.floor((rn - r * (q + 1)) / F.nullif(q, F.lit(0)))).cast("int")


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, cuts: Sequence[float] | None = None) -> DataFrame:
    """``df`` with ``avg_rank`` of ``value`` within its group; ties share the mean of their ranks."""
    peers = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = prefix_sums(peers, groups, value, ["__n"], cuts)
    ranked = ranked.select(*[F.col(g).alias("__p_" + g) for g in groups], F.col(value).alias("__pv"), (F.col("below___n") + (F.col("__n") + 1) / 2).alias("avg_rank"))
    on = F.col(value) == F.col("__pv")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col("__p_" + g))
    return df.join(ranked, on).drop("__pv", *["__p_" + g for g in groups])
