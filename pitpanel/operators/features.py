"""Feature matrices: swapping or dropping the history part, column groups, feature-set variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import FEATURES, OTHER
from .sequences import missing_count

TIMING = ["Age", "TestDate_year", "TestDate_month", "YearMonthIndex"]


def swap_history(matrix: DataFrame, new: DataFrame, key: str | Sequence[str] = "row_id", count: str = "isna_sum") -> DataFrame:
    """``matrix`` with the history columns of ``new``; the missing count keeps the other columns' part."""
    keys = [key] if isinstance(key, str) else list(key)
    base = matrix.withColumn(count, F.col(count) - missing_count(FEATURES)).drop(*FEATURES)
    out = base.join(new.select(*keys, *FEATURES), keys, "left")
    return out.withColumn(count, F.col(count) + missing_count(FEATURES))


def without_history(matrix: DataFrame, count: str = "isna_sum") -> DataFrame:
    """``matrix`` without history columns; fails if the missing count was smaller than their part of it."""
    rest = F.col(count) - missing_count(FEATURES)
    checked = F.when(F.assert_true(rest >= 0, "missing count below that of the history columns").isNull(), rest)
    return matrix.withColumn(count, checked).drop(*FEATURES)


def groups(columns: list[str]) -> dict[str, list[str]]:
    """The columns of each group that a matrix has."""
    by_prefix = lambda *p: [c for c in columns if c.startswith(p)]
    return {
        "timing": [c for c in columns if c in TIMING],
        "history": [c for c in columns if c in FEATURES],
        "opposite": [c for c in columns if c in OTHER],
        "accuracy": by_prefix("acc_stats_", "err_stats_"),
        "response_time": by_prefix("rt_mean_stats_", "rt_std_stats_"),
        "missing": [c for c in columns if c == "isna_sum"],
    }


def variants(columns: list[str]) -> dict[str, list[str]]:
    """Stepwise sets A-D and one set without each group."""
    g = groups(columns)
    base = [c for c in columns if c not in g["history"] and c not in g["timing"]]
    own = [c for c in g["history"] if c not in g["opposite"]]
    steps = {"A": base, "B": base + g["timing"], "C": base + g["timing"] + own, "D": list(columns)}
    return steps | {f"no_{k}": [c for c in columns if c not in v] for k, v in g.items() if v}


#: Columns that hold a calendar position, which a time variant leaves out.
ABSOLUTE = ("TestDate_year", "YearMonthIndex", *[c for c in FEATURES if "YearMonthIndex" in c and not c.endswith("_std")])


def time_variants(matrix: DataFrame, columns: list[str]) -> dict[str, tuple[DataFrame, list[str]]]:
    """full, without_absolute_time and relative_time: a table and the feature columns of each.

    The last one reads gaps to the present instead of positions in the calendar.
    """
    from .history import relative_time

    rest = [c for c in columns if c not in ABSOLUTE]
    gaps = relative_time(matrix)
    new = [c for c in gaps.columns if "month_gap" in c]
    return {"full": (matrix, list(columns)), "without_absolute_time": (matrix, rest), "relative_time": (gaps, [c for c in rest if c in gaps.columns] + new)}


def union_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both tables' rows in the columns that both have."""
    common = [c for c in a.columns if c in b.columns]
    return a.select(common).unionByName(b.select(common))
