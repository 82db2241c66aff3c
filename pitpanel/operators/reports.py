"""Report tables over panels and metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def year() -> Column:
    return F.floor(F.col("period") / 100).cast("int")


def composition(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """side (``all`` for the total), n, rate, and non-null count and mean of ``columns``."""
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate")]
    for c in columns:
        aggs += [F.count(c).alias(c + "_count"), F.avg(c).alias(c + "_mean")]
    return df.rollup("side").agg(*aggs).withColumn("side", F.coalesce("side", F.lit("all")))


def year_side(df: DataFrame) -> DataFrame:
    return df.groupBy(year().alias("year"), "side").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.avg("label").alias("rate"))


def year_side_wide(df: DataFrame) -> DataFrame:
    """One row for each year: n, rate and share of both sides; an absent side has n = 0."""
    out = df.groupBy(year().alias("year")).pivot("side", ["A", "B"]).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate"))
    n = {s: F.coalesce(f"{s}_n", F.lit(0)) for s in "AB"}
    both = n["A"] + n["B"]
    return out.select("year", *[x for s in "AB" for x in (n[s].alias(f"n_{s}"), F.col(f"{s}_rate").alias(f"rate_{s}"), (n[s] / both).alias(f"share_{s}"))], both.alias("n"))


def class_share(df: DataFrame) -> DataFrame:
    """label, n, share; the window runs over the few classes."""
    c = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def per_entity(df: DataFrame, most: int = 4) -> DataFrame:
    """records (most = that many or more), entities, share."""
    e = df.groupBy("entity").agg(F.count(F.lit(1)).alias("c")).groupBy(F.least("c", F.lit(most)).cast("int").alias("records")).agg(F.count(F.lit(1)).alias("entities"))
    return e.withColumn("share", F.col("entities") / F.sum("entities").over(Window.partitionBy()))


def repeat_share(df: DataFrame) -> DataFrame:
    """Share of records of entities with more than one record."""
    e = df.groupBy("entity").agg(F.count(F.lit(1)).alias("c"))
    return e.agg((F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("repeat_share"))


def both_sides(df: DataFrame) -> DataFrame:
    """Share of entities seen on both sides."""
    e = df.groupBy("entity").agg(F.countDistinct("side").alias("c"))
    return e.agg(F.count(F.lit(1)).alias("entities"), F.avg((F.col("c") > 1).cast("int")).alias("both_share"))


def mean_std(df: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample std over folds; 0 for a single fold."""
    return df.groupBy(*groups).agg(*[x for v in values for x in (F.avg(v).alias(v + "_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(v + "_std"))])


def contrast(deltas: DataFrame, value: str) -> DataFrame:
    """Of paired differences by fold: mean, sample std, number above zero."""
    return deltas.agg(F.avg(value).alias("mean_delta"), F.stddev_samp(value).alias("std_delta"), F.count_if(F.col(value) > 0).alias("positive_folds"))


def delta_to_first(df: DataFrame, groups: Sequence[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("delta", F.col(value) - F.first(value).over(w))


def best(df: DataFrame, groups: Sequence[str], value: str, tie: str, largest: bool = True) -> DataFrame:
    """One row for each group: the best value, ties by the smallest ``tie``."""
    w = Window.partitionBy(*groups).orderBy(F.desc(value) if largest else F.asc(value), tie)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` without the rows whose keys ``new`` brings, and ``new``."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


# ---------------------------------------------------------------- stability of rankings over folds


def importance_rank(imp: DataFrame) -> DataFrame:
    """fold, feature, value, rank (1 is the largest; equal values share the smaller rank)."""
    return imp.withColumn("rank", F.rank().over(Window.partitionBy("fold").orderBy(F.desc("value"))))


def importance_summary(imp: DataFrame, folds: int = 5) -> DataFrame:
    r = importance_rank(imp)
    aggs = [F.avg("rank").alias("mean_rank"), F.stddev_samp("rank").alias("std_rank"), F.min("rank").alias("min_rank"), F.max("rank").alias("max_rank")]
    aggs += [F.count_if(F.col("rank") <= k).alias(f"top{k}") for k in (5, 10, 20)]
    aggs += [F.max(F.when(F.col("fold") == f, F.col("rank"))).alias(f"fold_{f}") for f in range(1, folds + 1)]
    out = r.groupBy("feature").agg(*aggs)  # a row for each feature
    return out.withColumn("consensus", F.row_number().over(Window.partitionBy().orderBy("mean_rank", "feature")))


def spearman(imp: DataFrame) -> DataFrame:
    """Rank correlation of every two folds (left < right)."""
    w = Window.partitionBy("fold")
    peers = Window.partitionBy("fold", "value")
    r = imp.withColumn("r", F.rank().over(w.orderBy("value")) + (F.count(F.lit(1)).over(peers) - 1) / 2)
    a, b = r.select(F.col("fold").alias("left"), "feature", F.col("r").alias("x")), r.select(F.col("fold").alias("right"), "feature", F.col("r").alias("y"))
    return a.join(b, "feature").filter("left < right").groupBy("left", "right").agg(F.corr("x", "y").alias("spearman"))


def topk_overlap(imp: DataFrame, ks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """left, right, k, shared, jaccard of the k highest features of every two folds; ties by name."""
    rn = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("value"), "feature"))
    r = imp.withColumn("rn", rn).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("rn <= k")
    size = r.groupBy("fold", "k").agg(F.count(F.lit(1)).alias("n"))
    a, b = r.select(F.col("fold").alias("left"), "k", "feature"), r.select(F.col("fold").alias("right"), "k", "feature")
    shared = a.join(b, ["k", "feature"]).filter("left < right").groupBy("left", "right", "k").agg(F.count(F.lit(1)).alias("shared"))
    l, m = size.select(F.col("fold").alias("left"), "k", F.col("n").alias("ln")), size.select(F.col("fold").alias("right"), "k", F.col("n").alias("rn"))
    pairs = l.join(m, "k").filter("left < right").join(shared, ["left", "right", "k"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return pairs.select("left", "right", "k", "shared", (F.col("shared") / (F.col("ln") + F.col("rn") - F.col("shared"))).alias("jaccard"))


# ---------------------------------------------------------------- audits


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n and an order-free sum of 60-bit prefixes of md5 over the columns: equal tables have equal rows."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("digest"))


def digest(df: DataFrame) -> DataFrame:
    """n and an order-free sum of 64-bit hashes of whole rows: a guard for tables of many numbers, which ``fingerprint`` would format as text."""
    names = sorted(df.columns)
    h = F.xxhash64(*names, *[F.col(c).isNull() for c in names]).cast("decimal(20,0)")  # a null leaves a hash as it is, so where nulls are counts too
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("digest"))


def checks(df: DataFrame, key: str, label: str) -> DataFrame:
    """(check, value, ok) of one pass: unique keys, no null keys, binary labels."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("bad"))
    one = per.agg(F.count_if(F.col("c") > 1).alias("a"), F.count_if(F.col(key).isNull()).alias("b"), F.coalesce(F.sum("bad"), F.lit(0)).alias("c"))
    return one.selectExpr("stack(3, 'unique_key', a, 'null_key', b, 'binary_label', c) AS (check, value)").withColumn("ok", F.col("value") == 0)


def aligned(features: DataFrame, targets: DataFrame, key: str, label: str, columns: Sequence[str]) -> DataFrame:
    """(check, value, ok) of two tables that should hold the same records: ``length`` (rows that one has more), ``label_equal``
    (1 if their multisets of key and label differ), ``schema`` (columns that ``features`` lacks).

    One pass over both: an order-free digest adds up two hashes of each (key, label),
    with a minus for the other side, so equal multisets come to 0.
    """
    tall = [t.select(F.col(key).cast("string").alias("k"), F.col(label).cast("string").alias("v"), F.lit(s).alias("s")) for t, s in ((features, 1), (targets, -1))]
    text = F.concat_ws("|", F.coalesce("k", F.lit("~")), F.coalesce("v", F.lit("~")))
    h = [F.conv(F.substring(F.md5(text), at, 15), 16, 10).cast("decimal(20,0)") * F.col("s") for at in (1, 16)]
    one = tall[0].unionByName(tall[1]).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).alias(f"h{i}") for i, x in enumerate(h)])
    lacking = len([c for c in columns if c not in features.columns])
    one = one.select(F.abs("n").cast("long").alias("n"), ((F.col("h0") != 0) | (F.col("h1") != 0)).cast("long").alias("d"), F.lit(lacking).cast("long").alias("c"))
    return one.selectExpr("stack(3, 'length', n, 'label_equal', d, 'schema', c) AS (check, value)").withColumn("ok", F.col("value") == 0)


def compare_reports(reports: Sequence[tuple[str, DataFrame, DataFrame, Sequence[str], Sequence[str], float]]) -> DataFrame:
    """report, key, column, kind, saved, expected: what ``compare`` finds, for a table of (name, saved, expected, keys, values, tolerance).

    ``key`` has the values of a report's keys, joined by ``|``.
    """
    out = None
    for name, saved, expected, keys, values, tolerance in reports:
        key = F.array_join(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]), "|")
        one = compare(saved, expected, keys, values, tolerance).select(F.lit(name).alias("report"), key.alias("key"), "column", "kind", "saved", "expected")
        out = one if out is None else out.unionByName(one)
    return out


def ledger(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, metric, value, delta of a literal table of formulas.

    ``values``: (entry, metric, value). ``wanted``: (key, metric, minuend, subtrahend,
    condition). ``value`` is the minuend's, ``delta`` what it has more than the
    subtrahend; both are null where the entry lacks, and so is ``delta`` where no
    subtrahend is named or the ``condition``, an entry that must be there too, lacks.
    """
    side = lambda n: values.select(F.col("entry").alias(n), "metric", F.col("value").alias(f"__{n}"))
    there = values.select(F.col("entry").alias("condition"), F.lit(True).alias("__there")).distinct()
    out = wanted.join(side("minuend"), ["minuend", "metric"], "left").join(side("subtrahend"), ["subtrahend", "metric"], "left").join(there, "condition", "left")
    holds = F.col("condition").isNull() | F.coalesce("__there", F.lit(False))
    return out.select("key", "metric", F.col("__minuend").alias("value"), F.when(holds, F.col("__minuend") - F.col("__subtrahend")).alias("delta"))


def compare(saved: DataFrame, expected: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-8) -> DataFrame:
    """One row for each failure: keys, ``column`` (null for whole rows), ``kind`` (missing, extra, repeated, differs), saved, expected.

    Values compare as doubles, null only with null. Rows of ``expected`` that
    ``saved`` lacks are missing, the others extra; keys that ``saved`` has twice
    are repeated. No rows: the table was saved as it is computed again.
    """
    side = lambda df, p: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(p + "_times"), *[F.first(F.col(v).cast("double")).alias(p + v) for v in values])
    both = side(saved, "__s_").join(side(expected, "__e_"), list(keys), "full")
    none = F.lit(None).cast("double")
    fault = lambda when, kind, column=None, a=none, b=none: F.when(when, F.struct(F.lit(column).cast("string").alias("column"), F.lit(kind).alias("kind"), a.alias("saved"), b.alias("expected")))
    found = [fault(F.col("__s__times").isNull(), "missing"), fault(F.col("__e__times").isNull(), "extra"), fault(F.col("__s__times") > 1, "repeated")]
    for v in values:
        a, b = F.col("__s_" + v), F.col("__e_" + v)
        off = (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > tolerance, F.lit(False))
        found.append(fault(F.col("__s__times").isNotNull() & F.col("__e__times").isNotNull() & off, "differs", v, a, b))
    return both.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("f")).select(*keys, "f.*")


def verdict(checked: DataFrame) -> DataFrame:
    """One row from (check, value, ok): checks, failed, failures (their sorted names, comma-joined), verdict PASS or FAIL. A null ok fails; no checks fail too."""
    bad = ~F.coalesce(F.col("ok"), F.lit(False))
    one = checked.agg(F.count(F.lit(1)).alias("checks"), F.count_if(bad).alias("failed"), F.array_join(F.array_sort(F.collect_set(F.when(bad, F.col("check")))), ",").alias("failures"))
    return one.withColumn("verdict", F.when((F.col("failed") == 0) & (F.col("checks") > 0), "PASS").otherwise("FAIL"))


def subset(part: DataFrame, whole: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of ``part`` that ``whole`` lacks; none: it is contained."""
    return part.select(*keys).distinct().join(whole.select(*keys).distinct(), list(keys), "left_anti")


def validated_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``left`` joined with at most one row of ``right`` each; the job fails where ``right`` has a key twice."""
    rest = [c for c in right.columns if c not in keys]
    once = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in rest])
    checked = F.when(F.assert_true(F.coalesce(F.col("__n"), F.lit(1)) == 1, "a key of the right table repeats").isNull(), F.lit(True))
    return left.join(once, list(keys), how).withColumn("__ok", checked).filter("__ok").drop("__n", "__ok")


def ordered(df: DataFrame, key: str, labels: Sequence[tuple[str, str]]) -> DataFrame:
    """The rows of the named keys with ``position`` (from 1) and ``label``, as a report lists them."""
    made = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(k).alias("k"), F.lit(t).alias("label")) for i, (k, t) in enumerate(labels)])
    own = F.filter(made, lambda x: x["k"] == F.col(key))
    return df.withColumn("__x", F.try_element_at(own, F.lit(1))).filter("__x is not null").select(F.col("__x.position").alias("position"), F.col("__x.label").alias("label"), *df.columns)


def overlap_summary(pairs: DataFrame) -> DataFrame:
    """k: mean, min and max of shared and of jaccard over the pairs of folds."""
    return pairs.groupBy("k").agg(*[f(c).alias(f"{c}_{n}") for c in ("shared", "jaccard") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def importance(phi: DataFrame, groups: Sequence[str] = ("fold",)) -> DataFrame:
    """groups, feature, mean_abs, mean_signed, rank: attributions of rows as importance of features; 1 is the largest."""
    out = phi.groupBy(*groups, "feature").agg(F.avg(F.abs(F.col("phi"))).alias("mean_abs"), F.avg("phi").alias("mean_signed"))
    return out.withColumn("rank", F.rank().over(Window.partitionBy(*groups).orderBy(F.desc("mean_abs"))))
