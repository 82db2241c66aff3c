"""Encoded sequences: tokens, counts, numeric lists, row moments. Long form throughout; nothing is pivoted unless asked for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sample_kurtosis, sample_skew


def zip_tokens(lists: Sequence[Column], prefix: str) -> Column:
    """Parallel comma lists to tokens ``<prefix>_<codes>``, as many as the shortest list has."""
    parts = [F.split(c, ",") for c in lists]
    n = F.least(*[F.size(p) for p in parts]) if len(parts) > 1 else F.size(parts[0])
    zipped = F.arrays_zip(*[F.slice(p, F.lit(1), n).alias(f"c{i}") for i, p in enumerate(parts)])
    return F.transform(zipped, lambda z: F.lower(F.concat(F.lit(prefix + "_"), *[z[f"c{i}"] for i in range(len(parts))])))


def token_counts(df: DataFrame, tokens: str, key: str = "row_id") -> DataFrame:
    """(key, token, n)."""
    return df.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def picked(rules: Sequence[tuple[str, int, Sequence[str]]]) -> Column:
    """Whether a rule (start of the token, place from 1, characters) picks ``token``: the character at that place is one of them."""
    return reduce(lambda a, b: a | b, [F.col("token").startswith(start) & F.substring("token", at, 1).isin(*codes) for start, at, codes in rules], F.lit(False))


def select_tokens(counts: DataFrame, rules: Sequence[tuple[str, int, Sequence[str]]]) -> DataFrame:
    """Counts of the tokens that a rule picks."""
    return counts.filter(picked(rules))


def vocabulary(counts: DataFrame) -> DataFrame:
    """The tokens of a training set; bounded by the code book, not by the rows."""
    return counts.select("token").distinct()


def transfer(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Counts of another set's rows with tokens that the vocabulary lacks left out."""
    return counts.join(vocab, "token", "left_semi")


def pivot(counts: DataFrame, tokens: Sequence[str], key: str = "row_id") -> DataFrame:
    """A column for each of ``tokens``, 0 where a row lacks it."""
    return counts.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("token") == t, F.col("n"))), F.lit(0)).alias(t) for t in tokens])


def numeric_list(df: DataFrame, column: str, longest: int | None = None) -> DataFrame:
    """``df`` with ``<column>_mean`` and ``<column>_std`` (population) of absolute values; null where an element is missing or the list is shorter than the longest."""
    parts = F.split(column, ",")
    if longest is None:
        longest = df.agg(F.max(F.size(parts))).first()[0] or 0
    # shorter lists are null anyway, so only the longest are read
    values = F.transform(parts, lambda x: F.abs(x.try_cast("double")))
    rows = df.withColumn("__v", F.when(F.size(parts) == longest, values))
    n = F.size("__v")
    whole = (n == longest) & ~F.exists("__v", lambda x: x.isNull())
    mean = F.aggregate("__v", F.lit(0.0), lambda a, x: a + x) / n
    rows = rows.withColumn("__m", F.when(whole, mean))
    var = F.aggregate("__v", F.lit(0.0), lambda a, x: a + (x - F.col("__m")) * (x - F.col("__m"))) / n
    return rows.withColumns({column + "_mean": F.col("__m"), column + "_std": F.when(whole, F.sqrt(var))}).drop("__v", "__m")


def row_moments(df: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    """``df`` with std (sample), mean, skew, kurt over the columns of a row that are not null.

    Values are taken from the row's first one and then from the mean, so nothing
    cancels and equal values are exactly 0. Every intermediate is a number, never
    null, which keeps the generated method small enough to be compiled.
    """
    values = [F.col(c).cast("double") for c in columns]
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    is_there = {f"__h{i}": F.when(v.isNotNull(), 1.0).otherwise(0.0) for i, v in enumerate(values)}
    rows = df.withColumns({**is_there, "__f": F.coalesce(*values, F.lit(0.0))})
    rows = rows.withColumns({**{f"__d{i}": F.coalesce(v, F.col("__f")) - F.col("__f") for i, v in enumerate(values)}, "__n": total([F.col(h) for h in is_there])})
    rows = rows.withColumn("__m", total([F.col(f"__d{i}") for i in range(len(values))]) / F.greatest("__n", F.lit(1.0)))
    rows = rows.withColumns({f"__e{i}": (F.col(f"__d{i}") - F.col("__m")) * F.col(f"__h{i}") for i in range(len(values))})
    rows = rows.withColumns({f"__q{i}": F.col(f"__e{i}") * F.col(f"__e{i}") for i in range(len(values))})
    each = [(F.col(f"__e{i}"), F.col(f"__q{i}")) for i in range(len(values))]
    rows = rows.withColumns({"__2": total([q for _, q in each]), "__3": total([e * q for e, q in each]), "__4": total([q * q for _, q in each])})
    n, s2, s3, s4 = (F.col(c) for c in ("__n", "__2", "__3", "__4"))
    rows = rows.withColumn("__v", F.when(s2 > 0, s2 / F.greatest(n, F.lit(1.0))).otherwise(1.0))
    v, less = F.col("__v"), lambda k: F.greatest(n - k, F.lit(1.0))
    skew = F.when(s2 > 0, s3 / n / (v * F.sqrt(v)) * F.sqrt(n * less(1)) / less(2)).otherwise(0.0)
    kurt = F.when(s2 > 0, less(1) / (less(2) * less(3)) * ((n + 1) * (s4 / n / (v * v) - 3) + 6)).otherwise(0.0)
    new = {"std": F.when(n > 1, F.sqrt(s2 / less(1))), "mean": F.when(n > 0, F.col("__f") + F.col("__m")), "skew": F.when(n > 2, skew), "kurt": F.when(n > 3, kurt)}
    helpers = [f"__{k}{i}" for k in "hdeq" for i in range(len(values))]
    return rows.withColumns({f"{prefix}_{k}": c for k, c in new.items()}).drop("__f", "__m", "__n", "__2", "__3", "__4", "__v", *helpers)


def _from_sums(rows: DataFrame, prefix: str) -> DataFrame:
    n, s1, s2, s3, s4 = (F.col(c) for c in ("__n", "__1", "__2", "__3", "__4"))
    n = F.nullif(n, F.lit(0.0))
    return rows.withColumns(
        {
            f"{prefix}_std": F.when(n > 1, F.sqrt(F.greatest((s2 - s1 * s1 / n) / F.nullif(n - 1, F.lit(0.0)), F.lit(0.0)))),
            f"{prefix}_mean": s1 / n,
            f"{prefix}_skew": sample_skew(n, s1, s2, s3),
            f"{prefix}_kurt": sample_kurtosis(n, s1, s2, s3, s4),
        }
    )


def token_moments(rows: DataFrame, counts: DataFrame, size: int, prefix: str, key: str = "row_id", scalars: Sequence[str] = ()) -> DataFrame:
    """(key, moments) over the counts of all ``size`` tokens of a vocabulary, zeros of absent ones included: power sums, no pivot.

    ``scalars`` are columns of ``rows`` that count as values beside the tokens, where they are not null.
    """
    n = F.col("n").cast("double")
    sums = counts.groupBy(key).agg(*[F.sum(F.pow(n, F.lit(k))).alias(f"__{k}") for k in (1, 2, 3, 4)])
    values = [F.col(c).cast("double") for c in scalars]
    total = lambda xs, first: reduce(lambda a, b: a + b, xs, first)
    power = {f"__{k}": total([F.coalesce(F.pow(v, F.lit(k)), F.lit(0.0)) for v in values], F.coalesce(F.col(f"__{k}"), F.lit(0.0))) for k in (1, 2, 3, 4)}
    out = rows.select(key, *scalars).join(sums, key, "left").withColumns({"__n": total([v.isNotNull().cast("double") for v in values], F.lit(float(size))), **power})
    return _from_sums(out, prefix).drop("__n", "__1", "__2", "__3", "__4", *scalars)


def list_moments(rows: DataFrame, tokens: str, words: Sequence[str], prefix: str, scalars: Sequence[str] = ()) -> DataFrame:
    """``rows`` with the moments of :func:`token_moments`, from the row's own list of tokens: nothing is moved.

    ``words`` is the vocabulary, which the code book bounds: each is counted by a term of its own. A row without a list has none of them.
    """
    n = lambda w: F.coalesce(F.size(tokens) - F.size(F.array_remove(tokens, w)), F.lit(0)).cast("double")
    held = rows.withColumns({f"__w{i}": n(w) for i, w in enumerate(words)} | {f"__w{len(words) + i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(scalars)})
    values = [F.col(f"__w{i}") for i in range(len(words) + len(scalars))]
    power = lambda x, k: reduce(lambda a, b: a * b, [x] * k)
    sums = {f"__{k}": reduce(lambda a, b: a + b, [power(v, k) for v in values], F.lit(0.0)) for k in (1, 2, 3, 4)}
    held = held.withColumns({"__n": reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("double") for c in scalars], F.lit(float(len(words)))), **sums})
    return _from_sums(held, prefix).drop("__n", "__1", "__2", "__3", "__4", *[f"__w{i}" for i in range(len(values))])


def missing_count(columns: Sequence[str]) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + F.col(c).isNull().cast("int")
    return out
