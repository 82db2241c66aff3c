"""Running sums in two levels, for groups that no single task should hold.

A window over an entity sends all of its rows to one task. Where an entity holds
more rows than that, its records are first summed by period (before anything is
shuffled), what is left is dealt in ranges of periods, each range keeps its own
running sums, and ranges receive the sums of those before them. All records of a
period have the same strict past, so they look it up by period.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of periods at most, whatever the number of rows.
RANGES = 32


def _estimate(df: DataFrame) -> int:
    """Bytes that the optimizer expects of a table, at most."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def hot_values(*tables: DataFrame, column: str = "entity", least: int = 100_000, most: int = 1000, small: int = 64 << 20) -> list:
    """Values of ``column`` that hold more rows than a task should: ``least``, and half of a shuffle partition's share.

    One pass with a sketch of fixed size, without a shuffle; at most ``most`` values.
    Tables of at most ``small`` bytes, which one task can hold as a whole, are not read
    for it. Which values are found decides how sums are made, never what they are.
    """
    if sum(_estimate(t) for t in tables) <= small:
        return []
    rows = reduce(DataFrame.unionByName, [t.select(column) for t in tables])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = min(most, 2 * parts)
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{column}`, {k}, {max(1024, 4 * k)})").alias("top")).first()
    bound = max(least, (found["n"] or 0) / (2 * parts))
    return [x["item"] for x in found["top"] or [] if x["item"] is not None and x["count"] > bound]


def is_hot(column: str, hot: Sequence) -> Column:
    return F.coalesce(F.col(column).isin(list(hot)), F.lit(False))


def null_safe(pairs: Sequence[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in pairs])


def with_ranges(rows: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """``rows`` with ``__range``, the number of quantiles of ``order`` at or below it: equal values share a range."""
    cuts = rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("__cuts"))
    held = rows.join(F.broadcast(cuts))  # one row
    return held.withColumn("__range", F.coalesce(F.size(F.filter(F.array_distinct("__cuts"), lambda c: c <= F.col(order))), F.lit(0))).drop("__cuts")


def _offsets(totals: DataFrame, by: Sequence[str], values: dict[str, Column]) -> DataFrame:
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*[F.col(b).alias("__g_" + b) for b in by], F.col("__range").alias("__gr"), *[v.over(before).alias("__o_" + n) for n, v in values.items()])


def _joined(rows: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    on = null_safe([*[(F.col(b), F.col("__g_" + b)) for b in by], (F.col("__range"), F.col("__gr"))])
    return rows.join(offsets, on).drop("__gr", *["__g_" + b for b in by])


def strict_sums(rows: DataFrame, by: Sequence[str], order: str, values: Sequence[str], prefix: str) -> DataFrame:
    """``rows`` (with ``__range``) with ``prefix + v``: the sum of v over the group's rows with a smaller ``order``; 0 where there are none."""
    inside = Window.partitionBy(*by, "__range").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "__range").agg(*[F.sum(v).alias(v) for v in values])
    out = rows.withColumns({"__i_" + v: F.sum(v).over(inside) for v in values})
    out = _joined(out, _offsets(totals, by, {v: F.sum(v) for v in values}), by)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.withColumns({prefix + v: zero(F.col("__i_" + v)) + zero(F.col("__o_" + v)) for v in values}).drop(*[x + v for v in values for x in ("__i_", "__o_")])


def strict_last(rows: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """``rows`` (with ``__range``) with ``name``: the value that is not null of the group's largest smaller ``order``."""
    inside = Window.partitionBy(*by, "__range").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col(value).isNotNull(), F.col(order))
    totals = rows.groupBy(*by, "__range").agg(F.max_by(value, known).alias("v"))
    out = rows.withColumn("__i", F.last(value, ignorenulls=True).over(inside))
    out = _joined(out, _offsets(totals, by, {"v": F.last("v", ignorenulls=True)}), by)
    return out.withColumn(name, F.coalesce("__i", "__o_v")).drop("__i", "__o_v")
