"""Cluster bootstrap of exact ranking metrics: one sort of the scores serves all replicates.

Every entity has an array with its weight in each replicate. A pair (entity, score)
is moved once, with that array: pairs are dealt in ranges of scores, each range is
packed into one row with its weighted totals, and the totals of the ranges below
are handed to it, one number for each replicate. The weighted curve inside a range
is then a cumulative sum down a matrix of scores by replicates, so nothing is
multiplied by the number of replicates but the arrays themselves. A score that
many entities share is summed before it becomes a range of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import unit_hash
from . import ranks
from .metrics import POISSON

#: Rows of a matrix of scores by replicates that are worked on at once.
BLOCK = 2048
#: Records of a range of scores, about: a task holds their weights, so more records make more ranges, not larger ones.
ROWS = 20_000
#: Tasks that a shared score is first summed in.
SALT = 64
#: Ranges (of some kilobytes each) below which their totals are broadcast.
SMALL = 4096


def weight_arrays(entities: DataFrame, replicates: int = 500, seed: int = 42) -> DataFrame:
    """(entity, w): how often an entity is drawn in each replicate, by md5, so the same everywhere; place 0 is replicate 1."""
    rows = entities.select(F.col("entity").alias("__e")).distinct()  # a name of its own, for joins with the same table
    u = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: unit_hash(seed, r, F.col("__e")))
    return rows.select(F.col("__e").alias("entity"), F.transform(u, lambda x: reduce(lambda a, b: a + b, [(x >= c).cast("int") for c in POISSON]).cast("tinyint")).alias("w"))


def _weights(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def _totals(count: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sum of count * w for each replicate; whole numbers below 2**53 are exact."""
    out = np.zeros(w.shape[1])
    for i in range(0, len(count), BLOCK):
        out += count[i : i + BLOCK].astype(float) @ w[i : i + BLOCK].astype(float)
    return out


def _packed(fields: list[T.StructField], names: list[str]):
    """A range of scores as one row: scores, counts and weights in order of the score, and their totals."""

    def run(table: pa.Table) -> pa.Table:
        p, pos, neg = (table.column(c).to_numpy().astype(float) for c in ("p", "pos", "neg"))
        order = np.argsort(p, kind="stable")
        w = np.ascontiguousarray(_weights(table.column("w"))[order], np.int8)
        p, pos, neg = p[order], pos[order], neg[order]
        row = {"__kind": 1, "p": p.tobytes(), "pos": pos.tobytes(), "neg": neg.tobytes(), "w": w.tobytes(), "tp": _totals(pos, w).tobytes(), "tn": _totals(neg, w).tobytes()}
        return _one(table, names, row)

    return run


_CHUNK = [("__kind", pa.int32()), ("p", pa.binary()), ("pos", pa.binary()), ("neg", pa.binary()), ("w", pa.binary()), ("tp", pa.binary()), ("tn", pa.binary())]


def _one(table: pa.Table, names: list[str], row: dict) -> pa.Table:
    first = table.slice(0, 1).select(names)
    return pa.table([*first.columns, *[pa.array([row[n]], t) for n, t in _CHUNK]], names=[*names, *[n for n, _ in _CHUNK]])


def _summed(names: list[str], again: bool):
    """All pairs of one score as one row of weighted sums; ``again``: from such rows."""

    def run(table: pa.Table) -> pa.Table:
        if again:
            tp, tn = (np.sum([np.frombuffer(x) for x in table.column(c).to_pylist()], axis=0) for c in ("tp", "tn"))
            p = table.column("p")[0].as_py()
        else:
            w = _weights(table.column("w"))
            tp, tn = (_totals(table.column(c).to_numpy().astype(float), w) for c in ("pos", "neg"))
            p = table.column("p").to_numpy().astype(float)[:1].tobytes()
        return _one(table, names, {"__kind": 0, "p": p, "pos": None, "neg": None, "w": None, "tp": tp.tobytes(), "tn": tn.tobytes()})

    return run


def _below(names: list[str], places: list[str]):
    """Of the ranges of a group: the totals of those below each, and of all."""

    def run(table: pa.Table) -> pa.Table:
        at = np.lexsort([table.column(c).to_numpy() for c in reversed(places)])
        tp, tn = (np.stack([np.frombuffer(x) for x in table.column(c).to_pylist()])[at] for c in ("tp", "tn"))
        below = [np.cumsum(x, axis=0) - x for x in (tp, tn)]
        whole = [[x.sum(0).tobytes()] * len(at) for x in (tp, tn)]
        first = table.take(pa.array(at)).select([*names, *places])
        return pa.table([*first.columns, *[pa.array([r.tobytes() for r in x], pa.binary()) for x in below], *[pa.array(x, pa.binary()) for x in whole]], names=[*first.column_names, "bp", "bn", "ap", "an"])

    return run


def _curve(p, pos, neg, w, below_pos, below_neg, all_pos, all_neg) -> tuple[np.ndarray, np.ndarray]:
    """Area and precision steps of a range, for every replicate."""
    area, step = np.zeros_like(all_pos), np.zeros_like(all_pos)
    bp, bn = below_pos.copy(), below_neg.copy()
    start = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    end = np.concatenate([start[1:], [len(p)]])
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
        rows = slice(start[i], end[j - 1])
        m = w[rows].astype(float)
        ties = start[i:j] - start[i]
        a, b = (np.add.reduceat(m * c[rows, None], ties, axis=0) for c in (pos, neg))
        ca, cb = bp + np.cumsum(a, axis=0) - a, bn + np.cumsum(b, axis=0) - b
        area += (a * (cb + b / 2)).sum(0)
        tp, fp = all_pos - ca, all_neg - cb
        step += (a * np.divide(tp, tp + fp, out=np.zeros_like(tp), where=tp + fp > 0)).sum(0)
        bp, bn = ca[-1] + a[-1], cb[-1] + b[-1]
        i = j
    return area, step


def _curves(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("__kind", "p", "pos", "neg", "w", "tp", "tn", "bp", "bn", "ap", "an")}
                v = {c: np.frombuffer(row[c]) for c in ("p", "tp", "tn", "bp", "bn", "ap", "an")}
                if row["__kind"]:
                    w = np.frombuffer(row["w"], np.int8).reshape(len(v["p"]), -1)
                    area, step = _curve(v["p"], np.frombuffer(row["pos"]), np.frombuffer(row["neg"]), w, v["bp"], v["bn"], v["ap"], v["an"])
                else:  # one score
                    tp, fp = v["ap"] - v["bp"], v["an"] - v["bn"]
                    area, step = v["tp"] * (v["bn"] + v["tn"] / 2), v["tp"] * np.divide(tp, tp + fp, out=np.zeros_like(tp), where=tp + fp > 0)
                held = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (area, step, v["ap"], v["an"])]
                yield pa.RecordBatch.from_arrays([*[batch.column(n).slice(k, 1) for n in names], *held], [*names, "area", "step", "ap", "an"])

    return run


def weighted_auc_ap(df: DataFrame, weights: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """replicate, groups, auc, average_precision with each record counted as often as its entity is drawn.

    ``weights``: (entity, w) of ``weight_arrays``. Entities without weights and null
    scores are left out; a replicate that draws no record of a group has no row, one
    without positives or negatives has null.
    """
    from ..sources import io

    spark, groups = df.sparkSession, list(groups)
    small = df.filter("p is not null").groupBy(*groups, "entity", "p").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    least, most = ranks.EDGES
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = ranks.quantiles(df, "p", most=min(max(least, parts, -(-df.count() // ROWS)), most))[0]
    often = sorted({a for a, b in zip(found, found[1:], strict=False) if a == b})
    small = ranks.with_bucket(small, "__b", F.col("p"), found)
    each = small.join(weights, "entity")
    names = [*groups, "__b"]
    fields = [*[df.schema[g] for g in groups], T.StructField("__b", T.IntegerType())]
    binary = lambda *cs: [T.StructField(c, T.BinaryType()) for c in cs]
    chunk = T.StructType([*fields, T.StructField("__kind", T.IntegerType()), *binary("p", "pos", "neg", "w", "tp", "tn")])
    shared = F.col("p").isin(often) if often else F.lit(False)
    chunks = each.filter(~shared).groupBy(*names).applyInArrow(_packed(fields, names), chunk)
    if often:
        salted = each.filter(shared).groupBy(*names, "p", F.pmod(F.xxhash64("entity"), F.lit(SALT)).alias("__salt"))
        part = salted.applyInArrow(_summed(names, False), chunk)
        chunks = chunks.unionByName(part.groupBy(*names, "p").applyInArrow(_summed(names, True), chunk))
    path = io.scratch(spark, "bootstrap")
    chunks.write.parquet(path)
    chunks = spark.read.schema(chunk).parquet(path)
    places = ["__b", "__kind"]
    sums = T.StructType([*fields, T.StructField("__kind", T.IntegerType()), *binary("bp", "bn", "ap", "an")])
    # a row for each range and group: their number is bounded by that of the ranges
    below = chunks.select(*names, "__kind", "tp", "tn").groupBy(*groups).applyInArrow(_below(groups, places), sums)
    below = below.select(*[F.col(g).alias("__g_" + g) for g in groups], F.col("__b").alias("__bb"), F.col("__kind").alias("__bk"), "bp", "bn", "ap", "an")
    if chunks.count() <= SMALL:
        below = F.broadcast(below)
    on = (F.col("__b") == F.col("__bb")) & (F.col("__kind") == F.col("__bk"))
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col("__g_" + g))
    double = T.ArrayType(T.DoubleType())
    out = chunks.join(below, on).drop("__bb", "__bk", *["__g_" + g for g in groups])
    out = out.mapInArrow(_curves(groups), T.StructType([*fields[:-1], *[T.StructField(c, double) for c in ("area", "step", "ap", "an")]]))
    each = out.select(*groups, F.posexplode(F.arrays_zip("area", "step", "ap", "an")).alias("__r", "z"))
    each = each.groupBy(*groups, "__r").agg(F.sum("z.area").alias("area"), F.sum("z.step").alias("step"), F.max("z.ap").alias("ap"), F.max("z.an").alias("an")).filter("ap + an > 0")
    return each.select((F.col("__r") + 1).alias("replicate"), *groups, F.try_divide("area", F.col("ap") * F.col("an")).alias("auc"), F.try_divide("step", "ap").alias("average_precision"))
