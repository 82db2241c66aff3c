"""Deterministic splits: stratified, entity-disjoint, temporal; outer and inner. Order comes from md5, so every engine agrees."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import order_hash


def _shards(rows: DataFrame) -> int:
    """Hash ranges of a class that is dealt in parts: one for each shuffle partition, 64 to 65,536."""
    return min(max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 65_536)


def _shard(digest: Column | str, shards: int) -> Column:
    """The range of a hash: ranges follow the order of the hashes."""
    return F.floor(F.conv(F.substring(digest, 1, 4), 16, 10).cast("long") * shards / 65536)


def stratified(rows: DataFrame, k: int = 5, seed: int = 42, name: str = "fold", within: Sequence[str] = (), shards: int | None = None) -> DataFrame:
    """``rows`` with a fold 1..k: rows of one label are dealt in turn, in hash order.

    Labels are few and may hold nearly all rows, so the deal runs in ``shards``
    hash ranges of each label, with an offset of what the ranges before hold.
    """
    rows = rows.withColumn("__h", order_hash(seed, "row_id")).withColumn("__s", _shard("__h", shards or _shards(rows)))
    by = [*within, "label"]
    sizes = rows.groupBy(*by, "__s").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "__s", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    rn = F.row_number().over(Window.partitionBy(*by, "__s").orderBy("__h", "row_id")) + F.col("__o") - 1
    return rows.join(sizes, [*by, "__s"]).withColumn(name, (F.pmod(rn, F.lit(k)) + 1).cast("int")).drop("__h", "__s", "__o")


def grouped(rows: DataFrame, k: int = 5, seed: int = 42, name: str = "fold", within: Sequence[str] = ()) -> DataFrame:
    """``rows`` with a fold 1..k in which entities are whole.

    Entities are dealt to and fro, those with equal numbers of positives and rows
    in hash order. Each hash range of a (positives, rows) class is ranked on its
    own and starts where those before it end: most entities may be of one class.
    """
    entity = rows.groupBy(*within, "entity").agg(F.sum("label").alias("__pos"), F.count(F.lit(1)).alias("__n"))
    return rows.join(_dealt(entity, k, seed, name, within), [*within, "entity"])


def _dealt(entity: DataFrame, k: int, seed: int, name: str, within: Sequence[str]) -> DataFrame:
    """within, entity and its fold, from (within, entity, __pos, __n)."""
    entity = entity.withColumn("__h", order_hash(seed, "entity")).withColumn("__s", _shard("__h", _shards(entity)))
    part = [*within, "__pos", "__n", "__s"]
    sizes = entity.groupBy(*part).agg(F.count(F.lit(1)).alias("__c"))
    # classes first (few: one for each pair of numbers), then the ranges within them
    classes = sizes.groupBy(*part[:-1]).agg(F.sum("__c").alias("__all"))
    before = Window.partitionBy(*within).orderBy(F.desc("__pos"), F.desc("__n")).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("__start", F.coalesce(F.sum("__all").over(before), F.lit(0))).drop("__all")
    ranges = Window.partitionBy(*part[:-1]).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__o", F.coalesce(F.sum("__c").over(ranges), F.lit(0))).join(classes, part[:-1])
    sizes = sizes.select(*part, (F.col("__o") + F.col("__start")).alias("__o"))
    inside = Window.partitionBy(*part).orderBy("__h", "entity")
    dealt = entity.withColumn("__r", F.row_number().over(inside) - 1).join(sizes, part)
    at = F.pmod(F.col("__o") + F.col("__r"), F.lit(2 * k))
    return dealt.select(*within, "entity", F.when(at < k, at + 1).otherwise(2 * k - at).cast("int").alias(name))


def temporal(rows: DataFrame, train: tuple[int, int], valid: tuple[int, int]) -> DataFrame:
    """Rows of the two (inclusive) year ranges with ``role``."""
    year = F.floor(F.col("period") / 100)
    role = F.when(year.between(*train), "train").when(year.between(*valid), "valid")
    return rows.withColumn("role", role).filter("role is not null")


def inner_places(rows: DataFrame, k: int = 3, outer: int = 5, seed: int = 43, group: bool = False) -> DataFrame:
    """``rows`` with ``inner_folds``: at place f - 1 the inner fold 1..k among the training rows of the outer fold f, null where the row is none.

    The order of the deal is the same in all outer folds, so rows are moved and sorted
    once, and each outer fold counts those that are its own.
    """
    folds = range(1, outer + 1)
    used = {f: F.coalesce(F.col("fold") != f, F.lit(False)) for f in folds}
    if group:
        each = rows.groupBy("entity", "fold").agg(F.sum("label").alias("__pos"), F.count(F.lit(1)).alias("__n"))
        each = each.withColumn("outer_fold", F.explode(F.sequence(F.lit(1), F.lit(outer)))).filter("fold <> outer_fold")
        each = each.groupBy("outer_fold", "entity").agg(F.sum("__pos").alias("__pos"), F.sum("__n").alias("__n"))
        dealt = _dealt(each, k, seed, "__i", ["outer_fold"])
        dealt = dealt.groupBy("entity").agg(*[F.max(F.when(F.col("outer_fold") == f, F.col("__i"))).alias(f"__i{f}") for f in folds])
        return rows.join(dealt, "entity").withColumn("inner_folds", F.array(*[F.when(used[f], F.col(f"__i{f}")) for f in folds])).drop(*[f"__i{f}" for f in folds])
    rows = rows.withColumn("__h", order_hash(seed, "row_id")).withColumn("__s", _shard("__h", _shards(rows)))
    sizes = rows.groupBy("label", "__s").agg(*[F.count_if(use).alias(f"__c{f}") for f, use in used.items()])
    before = Window.partitionBy("label").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("label", "__s", *[F.coalesce(F.sum(f"__c{f}").over(before), F.lit(0)).alias(f"__o{f}") for f in folds])
    run = Window.partitionBy("label", "__s").orderBy("__h", "row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"__r{f}": F.count_if(use).over(run) for f, use in used.items()}).join(sizes, ["label", "__s"])
    places = [F.when(use, (F.pmod(F.col(f"__r{f}") + F.col(f"__o{f}") - 1, F.lit(k)) + 1).cast("int")) for f, use in used.items()]
    return rows.withColumn("inner_folds", F.array(*places)).drop("__h", "__s", *[f"__{x}{f}" for x in "ro" for f in folds])


def inner(rows: DataFrame, k: int = 3, outer: int = 5, seed: int = 43, group: bool = False) -> DataFrame:
    """For each outer fold: an inner fold 1..k for its training rows (``outer_fold``, ``inner_fold``)."""
    each = inner_places(rows, k, outer, seed, group).drop("fold")
    each = each.select(*[c for c in each.columns if c != "inner_folds"], F.posexplode("inner_folds").alias("outer_fold", "inner_fold")).filter("inner_fold is not null")
    return each.withColumn("outer_fold", F.col("outer_fold") + 1)


def forward_chain(rows: DataFrame, specs: Sequence[tuple[int, int, int]]) -> DataFrame:
    """For each (first year, last year, next year): training rows of the range, valid rows of the next year."""
    year = F.floor(F.col("period") / 100)
    made = F.array(*[F.struct(F.lit(i + 1).alias("inner_fold"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for i, (a, b, c) in enumerate(specs)])
    out = rows.withColumn("__x", F.explode(made)).withColumn("role", F.when(year.between(F.col("__x.a"), F.col("__x.b")), "train").when(year == F.col("__x.c"), "valid"))
    return out.filter("role is not null").withColumn("inner_fold", F.col("__x.inner_fold")).drop("__x")


def audit(rows: DataFrame, fold: str = "fold", k: int = 5) -> DataFrame:
    """For each fold: sizes, positives, and how many rows and entities are on both sides."""
    out = None
    from .history import explode_folds

    each = explode_folds(rows, fold, k)
    train = F.col("role") == "train"
    row = each.groupBy(fold, "row_id").agg(F.countDistinct("role").alias("roles")).groupBy(fold).agg(F.count_if(F.col("roles") > 1).alias("row_overlap"))
    entity = each.groupBy(fold, "entity").agg(F.countDistinct("role").alias("roles")).groupBy(fold).agg(F.count_if(F.col("roles") > 1).alias("entity_overlap"))
    out = each.groupBy(fold).agg(
        F.count_if(train).alias("train_rows"), F.count_if(~train).alias("valid_rows"), F.sum(F.when(~train, F.col("label"))).alias("valid_positives")
    )
    return out.join(row, fold).join(entity, fold)


def inner_roles(rows: DataFrame, k: int = 3) -> DataFrame:
    """Rows with an inner fold of their own: each once in every inner fold 1..k of its outer fold, with its role there."""
    out = rows.withColumnRenamed("inner_fold", "__own").withColumn("inner_fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return out.withColumn("role", F.when(F.col("__own") == F.col("inner_fold"), "valid").otherwise("train")).drop("__own")


#: What ``nested_audit`` counts, in order.
VIOLATIONS = ("row_overlap", "entity_overlap", "outer_overlap", "not_contained", "outer_leakage", "not_forward")

#: Cells (an inner fold of an outer one) that one number holds a bit of.
CELLS = 62


def _bit(place: int) -> Column:
    return F.lit(1 << place).cast("long")


def _has(mask: str, bit: str) -> Column:
    return F.col(mask).bitwiseAND(F.col(bit)) != 0


def _masks(rows: DataFrame, cell: DataFrame, keys: Sequence[str], names: tuple[str, str], *columns: str) -> DataFrame:
    """``columns``, and as ``names`` the bit of each row's cell where its role is train and valid. Rows of other cells go."""
    held = rows.join(F.broadcast(cell.select(*[F.col(k).alias("__c_" + k) for k in keys], "__bit")), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("__c_" + k)) for k in keys]))
    return held.select(*columns, *[F.when(F.col("role") == r, F.col("__bit")).otherwise(F.lit(0)).cast("long").alias(n) for r, n in zip(("train", "valid"), names, strict=True)])


def packed(folds: DataFrame, k: int = 3, outer: int = 5) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Rows with ``fold`` and ``inner_folds`` in the form that ``audit_packed`` takes, and its cells: every row once, with a bit for each cell it is in."""
    cells = [(f, j) for f in range(1, outer + 1) for j in range(1, k + 1)]
    either = lambda one: reduce(lambda a, b: a.bitwiseOR(b), one)
    none = F.lit(0).cast("long")
    # of an outer fold's k bits, that of the row's inner fold is validation, the others are training
    v = either([F.coalesce(F.expr(f"shiftleft(1L, {(f - 1) * k - 1} + inner_folds[{f - 1}])"), none) for f in range(1, outer + 1)])
    used = either([F.when(F.expr(f"inner_folds[{f - 1}] is not null"), F.lit(((1 << k) - 1) << (f - 1) * k).cast("long")).otherwise(none) for f in range(1, outer + 1)])
    t = used.bitwiseXOR(v)
    ov = either([F.when(F.col("fold") == f, _bit(f - 1)).otherwise(none) for f in range(1, outer + 1)])
    ot = either([F.when(F.col("fold") != f, _bit(f - 1)).otherwise(none) for f in range(1, outer + 1)])
    return folds.select("row_id", "entity", "period", t.alias("t"), v.alias("v"), ot.alias("ot"), ov.alias("ov")), cells


def _cells(spark, cells: Sequence[tuple]) -> DataFrame:
    """outer_fold, inner_fold, and their bits ``c`` and ``o``."""
    outers = {o: i for i, o in enumerate(dict.fromkeys(o for o, _ in cells))}
    return spark.createDataFrame([(o, j, 1 << i, 1 << outers[o]) for i, (o, j) in enumerate(cells)], "outer_fold int, inner_fold int, c long, o long")


def audit_rows(outer: DataFrame, inner: DataFrame, cells: Sequence[tuple]) -> DataFrame:
    """outer_fold, inner_fold, train_rows, valid_rows and the violations that rows show: each row is looked at once, with all of its cells.

    ``outer`` has (row_id, ot, ov), ``inner`` (row_id, t, v); of a row's masks, and
    those of its repetitions, only how often each combination occurs goes on.
    """
    none = F.lit(0).cast("long")
    both = inner.select("row_id", "t", "v", none.alias("ot"), none.alias("ov")).unionByName(outer.select("row_id", none.alias("t"), none.alias("v"), "ot", "ov"))
    masks = both.groupBy("row_id").agg(*[F.bit_or(m).alias(m) for m in ("t", "v", "ot", "ov")])
    kinds = masks.groupBy("t", "v", "ot", "ov", F.col("row_id").isNotNull().alias("known")).agg(F.count(F.lit(1)).alias("n"))
    each = kinds.join(F.broadcast(_cells(inner.sparkSession, cells)))
    t, v, held = _has("t", "c"), _has("v", "c"), _has("t", "c") | _has("v", "c")
    counts = {
        "train_rows": t, "valid_rows": v, "row_overlap": t & v, "outer_overlap": _has("ot", "o") & _has("ov", "o"),
        "not_contained": held & ~(_has("ot", "o") & F.col("known")), "outer_leakage": held & _has("ov", "o") & F.col("known"),
    }
    out = each.groupBy("outer_fold", "inner_fold").agg(*[F.sum(F.when(x, F.col("n")).otherwise(none)).alias(n) for n, x in counts.items()])
    return out.filter("train_rows + valid_rows > 0")


def audit_packed(outer: DataFrame, inner: DataFrame, cells: Sequence[tuple]) -> DataFrame:
    """``nested_audit`` of rows with masks: ``outer`` has (row_id, ot, ov), ``inner`` (row_id, entity, period, t, v)."""
    keys, cell = ["outer_fold", "inner_fold"], F.broadcast(_cells(inner.sparkSession, cells))
    entity = inner.groupBy("entity").agg(F.bit_or("t").alias("t"), F.bit_or("v").alias("v")).select(F.col("t").bitwiseAND(F.col("v")).alias("t")).filter("t <> 0")
    entity = entity.groupBy("t").agg(F.count(F.lit(1)).alias("n")).join(cell).filter(_has("t", "c")).groupBy(*keys).agg(F.sum("n").alias("entity_overlap"))
    # rows by period: a row for each period and combination of cells
    period = inner.groupBy("t", "v", "period").agg(F.count(F.lit(1)).alias("n")).join(cell).filter(_has("t", "c") | _has("v", "c"))
    period = period.groupBy(*keys, "period").agg(F.sum(F.when(_has("t", "c"), F.col("n"))).alias("nt"), F.max(_has("v", "c")).alias("nv"))
    period = period.withColumn("__start", F.min(F.when(F.col("nv"), F.col("period"))).over(Window.partitionBy(*keys)))
    forward = period.groupBy(*keys).agg(F.sum(F.when(F.col("period") >= F.col("__start"), F.col("nt"))).alias("not_forward"))
    out = audit_rows(outer, inner, cells).join(entity, keys, "left").join(forward, keys, "left")
    return out.select(*keys, "train_rows", "valid_rows", *[F.coalesce(v, F.lit(0)).cast("long").alias(v) for v in VIOLATIONS])


def nested_audit(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """For each (outer_fold, inner_fold): train_rows, valid_rows, and violations of a nested split.

    ``outer`` has (outer_fold, row_id, role), ``inner`` (outer_fold, inner_fold,
    row_id, entity, period, role). Rows and entities on both sides of the inner
    fold; rows on both sides of the outer fold; inner rows that the outer fold's
    training rows lack (``left_anti`` in effect), or that its validation rows
    have; training rows no earlier than the first validation row. Which of them
    are faults depends on the scheme: entities may be on both sides of a
    stratified split, and only a temporal one must run forward.
    """
    keys = ["outer_fold", "inner_fold"]
    found = sorted((tuple(r) for r in inner.select(*keys).distinct().collect()), key=lambda r: [(x is None, x) for x in r])  # a row for each fold
    spark, parts = inner.sparkSession, [found[i : i + CELLS] for i in range(0, max(len(found), 1), CELLS)]
    out = []
    for cells in parts:
        cell = _cells(spark, cells)
        a = _masks(inner, cell.withColumnRenamed("c", "__bit"), keys, ("t", "v"), "row_id", "entity", "period")
        b = _masks(outer, cell.select("outer_fold", F.col("o").alias("__bit")).distinct(), keys[:1], ("ot", "ov"), "row_id")
        out.append(audit_packed(b, a, cells))
    return reduce(DataFrame.unionByName, out)


def sample(rows: DataFrame, n: int, key: str = "row_id", seed: int = 42) -> DataFrame:
    """The ``n`` rows that come first in hash order: sampling without replacement."""
    return rows.orderBy(order_hash(seed, key), key).limit(n)
