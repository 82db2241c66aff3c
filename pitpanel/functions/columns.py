"""Column functions: calendar parts, bands, hashes, moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_band(c: Column) -> Column:
    """``30a`` is 30, ``30b`` is 35."""
    return F.regexp_extract(c, r"^\d+", 0).try_cast("int") + F.when(c.endswith("b"), 5).otherwise(0)


#: The two sides of a panel, unless a caller names others.
SIDES = ("A", "B")


def known_side(side: Column, sides: Sequence[str] = SIDES) -> Column:
    """The side itself; a value that is neither of the two fails the job, null stays."""
    return F.when(side.isNull() | side.isin(*sides), side).otherwise(F.raise_error(F.concat(F.lit("unknown side: "), side.cast("string"))))


def flip(side: Column, sides: Sequence[str] = SIDES) -> Column:
    """The other side; as in ``known_side``."""
    return F.when(side == sides[0], sides[1]).when(side == sides[1], sides[0]).otherwise(known_side(side, sides))


def order_hash(seed: int, *keys: Column | str) -> Column:
    """A reproducible shuffle order: md5 of seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def unit_hash(seed: int, *keys: Column | str) -> Column:
    """Uniform in [0, 1) from the first 32 bits of :func:`order_hash`."""
    return F.conv(F.substring(order_hash(seed, *keys), 1, 8), 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def sample_skew(n: Column, s1: Column, s2: Column, s3: Column) -> Column:
    """Bias-corrected skewness from power sums: null below three values, 0 where all are equal."""
    m = s1 / n
    m2, m3 = s2 / n - m * m, s3 / n - 3 * m * s2 / n + 2 * m * m * m
    flat = m2 <= 1e-12 * (s2 / n + 1e-300)
    g = m3 / F.pow(F.when(~flat, m2), 1.5) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.when(n >= 3, F.when(flat, 0.0).otherwise(g))


def sample_kurtosis(n: Column, s1: Column, s2: Column, s3: Column, s4: Column) -> Column:
    """Bias-corrected excess kurtosis from power sums: null below four values, 0 where all are equal."""
    m = s1 / n
    m2 = s2 / n - m * m
    m4 = s4 / n - 4 * m * s3 / n + 6 * m * m * s2 / n - 3 * m * m * m * m
    flat = m2 <= 1e-12 * (s2 / n + 1e-300)
    g2 = m4 / F.pow(F.when(~flat, m2), 2) - 3
    out = (n - 1) / (F.when(n > 2, n - 2) * F.when(n > 3, n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.when(flat, 0.0).otherwise(out))


def sample_std(n: Column, total: Column, squares: Column) -> Column:
    """From sums: null for one value or none, never negative under the root."""
    return F.when(n > 1, F.sqrt(F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0))))


def format_fixed(c: Column, digits: int = 4) -> Column:
    """A number with a fixed number of decimals, without separators."""
    return F.format_string(f"%.{digits}f", c.cast("double"))


def format_thousands(c: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(c.cast("long"), 0)


def format_share(c: Column, digits: int = 2) -> Column:
    """A share as text in percent."""
    return F.concat(F.format_number(100 * c, digits), F.lit("%"))
