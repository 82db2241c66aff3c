"""Quality classifier by Bradley-Terry pairwise ranking (operator 11).

A document's strength is linear in its features; that one is preferred to another
has the odds exp(difference of strengths). Pairs of a good and a bad labelled
document are drawn, and logistic regression without intercept on the differences
of their features (Spark ML) gives the weights. The threshold is a quantile of the
strengths: the share of bad labels among the labelled documents lies below it. A
score is the logistic function of the strength above the threshold, shifted so that
the threshold itself scores ``CUT``.

Features are shares, so texts of any length compare: classes of bytes, neighbouring
runs of classes (a word, then three stars, say), and how often words and word pairs
come again within windows of ``WINDOW`` words. A long text is read in pieces whose
counts are added.

Training reads all labelled documents: each is in a pair at least, and the threshold
is taken from the strengths of all. A caller may bound them by ``train_docs`` of each
label, those with the smallest hashes; the query does not. Every document is scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ranks
from . import shared as S

#: Score at the threshold; at or above it a document is predicted good.
CUT = 0.7
WINDOW = 64
_PAIR_BITS = 9
_PIECE = 1 << 20  # bytes of a text worked on at once

#: Class of each byte: a-z, A-Z, 0-9, space, newline, other control, above ASCII, then every sign of its own.
_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10], _CLASS[128:] = 0, 1, 2, 3, 4, 6
_SIGNS = [b for b in range(33, 127) if _CLASS[b] == 5]
_CLASS[_SIGNS] = np.arange(7, 7 + len(_SIGNS))
CLASSES = 7 + len(_SIGNS)
_WORD = S.word_table(" \t\n\v\f\r")
#: bytes, runs, words, words like the one before, distinct words and distinct pairs within windows, pairs within windows, windows
_PLAIN = 8
WIDTH = CLASSES + (1 << _PAIR_BITS) + _PLAIN


def _counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of each row: classes, pairs of runs, plain ones."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    out = np.zeros((n, WIDTH))
    kind = _CLASS[raw]
    out[:, :CLASSES] = np.bincount(row * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    new = np.ones(len(raw), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    k, r = kind[at], row[at]
    both = r[1:] == r[:-1]
    pair = ((k[:-1] * CLASSES + k[1:])[both] * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - _PAIR_BITS)
    out[:, CLASSES:-_PLAIN] = np.bincount(r[1:][both] << _PAIR_BITS | pair, minlength=n << _PAIR_BITS).reshape(n, -1)
    start, end, first = S.token_spans(raw, _WORD, offsets)
    name, words = S.span_names(raw, start, end), np.diff(first)
    w = np.repeat(np.arange(n), words)
    place = np.arange(len(name)) - first[w] if len(name) else np.zeros(0, np.int64)
    box = np.concatenate([[0], np.cumsum(-(-words // WINDOW))])
    window = box[w] + place // WINDOW  # numbered over all rows
    same = w[1:] == w[:-1]
    plain = out[:, -_PLAIN:]
    plain[:, 0], plain[:, 1], plain[:, 2] = size, np.bincount(r, minlength=n), words
    plain[:, 3] = np.bincount(w[1:][same & (name[1:] == name[:-1])], minlength=n)

    def distinct(win: np.ndarray, value: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if not len(win):
            return np.zeros(n)
        order = np.lexsort((value, win))
        a, b = win[order], value[order]
        once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return np.bincount(rows[order[once]], minlength=n)

    plain[:, 4] = distinct(window, name, w)
    inner = window[1:] == window[:-1]
    plain[:, 5] = distinct(window[1:][inner], S.mix(name[:-1][inner]) ^ name[1:][inner], w[1:][inner])
    plain[:, 6], plain[:, 7] = np.bincount(w[1:][inner], minlength=n), np.diff(box)
    return out


def features(column: pa.Array) -> np.ndarray:
    """A row of ``WIDTH`` + 1 numbers for each text, all 0 for a null or empty one."""
    raw, offsets = S.utf8(column)
    n = len(offsets) - 1
    total = np.zeros((n, WIDTH))
    size = np.diff(offsets)
    parts = np.maximum(1, -(-size // _PIECE))
    owner = np.repeat(np.arange(n), parts)
    starts = offsets[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * _PIECE
    cuts = np.concatenate([starts, offsets[-1:]]) if n else offsets
    for i, j in S.slices(cuts):
        np.add.at(total, owner[i:j], _counts(raw[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i]))
    plain = total[:, -_PLAIN:]
    size, runs, words, again, once, twice, pairs, _ = plain.T
    some = lambda a, b: a / np.maximum(b, 1)
    dense = [some(again, words), some(once, words), some(twice, pairs), np.log1p(words) / 10, np.log1p(some(size, words)) / 5, some(runs, size), (words == 1) * 1.0, (words > 0) * 1.0, some(total[:, 4], words)]
    return np.concatenate([np.sqrt(some(total[:, :CLASSES].T, size).T), np.sqrt(some(total[:, CLASSES:-_PLAIN].T, runs).T), np.stack(dense, 1)], 1)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, place, x) from (label, place, text)."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            x = features(part.column(2))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), flat], ["label", "place", "x"])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train_docs: int | None = None,
    pairs: int = 16_000,
    penalty: float = 1e-3,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "quality",
) -> dict:
    """``{"weights", "threshold"}`` from labels 1 (good) and 0 (bad).

    All labelled documents are read, or ``train_docs`` of each label. Documents of the
    commoner label meet one of the other label in turn, all of them as often as
    ``pairs`` pairs take, once at least.

    Null and other labels, null ids and ids with both labels teach nothing; repeated
    rows count once; a null text is empty. Without documents of both labels there are
    no preferences and weights are ``None``.
    """
    spark = docs.sparkSession
    space = S.Workspace(spark, "quality")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("k"), text.alias("text"))
    value = labels[label_col].cast("int")
    given = labels.select(labels[label_id].alias("id"), value.alias("label")).filter("label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    known = rows.select("id", "k").distinct().join(given.filter("label = other").select("id", "label"), "id")
    known = space.save(known.withColumn("h", F.xxhash64("id", "k", F.lit("draw"))), "labelled")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return {"weights": None, "threshold": 0.0}
    n = {k: min(v, train_docs or v) for k, v in sizes.items()}
    drawn = ranks.row_numbers(known, ["label"], "h", "id").select("label", F.col("rn").cast("long").alias("place"), "id", "k")
    drawn = space.save(drawn.filter(F.col("place") < F.when(F.col("label") == 1, n[1]).otherwise(n[0])), "drawn")
    # texts are moved once: repeated rows are dropped where the join has put them
    texts = rows.join(drawn.hint("merge"), ["id", "k"]).groupBy("id", "k").agg(F.first("label").alias("label"), F.first("place").alias("place"), F.first("text").alias("text")).drop("id", "k")
    held = space.save(texts.mapInArrow(_vectors, "label int, place long, x array<double>"), "vectors")
    many, few = (1, 0) if n[1] >= n[0] else (0, 1)
    rounds = max(1, -(-pairs // n[many]))
    # a round takes every document of the commoner label, and with it every one of the other; the next one shifts them by one
    met = spark.range(rounds * n[many]).select((F.col("id") % 2).alias("y"), (F.col("id") % n[many]).alias("many"), F.expr(f"(id % {n[many]} + id div {n[many]}) % {n[few]}").alias("few"))
    side = lambda label, name: held.filter(F.col("label") == label).select(F.col("place").alias(name), F.col("x").alias(f"{name}_x"))
    met = met.join(side(many, "many"), "many").join(side(few, "few"), "few")
    # half of the pairs are turned round, so both answers occur
    differ = F.zip_with("many_x", "few_x", lambda a, b: a - b)
    met = space.save(met.select(F.col("y").cast("double").alias("label"), F.when(F.col("y") == many, differ).otherwise(F.transform(differ, lambda x: -x)).alias("d")), "pairs")
    model = LogisticRegression(featuresCol="features", fitIntercept=False, regParam=penalty, maxIter=60).fit(met.select("label", array_to_vector("d").alias("features")))
    weights = model.coefficients.toArray()
    if n != sizes:
        own = [(r["label"], float(weights @ np.array(r["x"]))) for r in held.select("label", "x").toLocalIterator()]  # at most 2 * train_docs
        return {"weights": weights, "threshold": quantile(own, {k: sizes[k] / n[k] for k in n})}
    return {"weights": weights, "threshold": _middle(space.save(held.mapInArrow(_strengths(weights), "place long, s double"), "strengths"), n[0])}


def _strengths(weights: np.ndarray):
    """(place, s) from the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, len(weights))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x @ weights)], ["place", "s"])

    return run


def _middle(strengths: DataFrame, below: int) -> float:
    """Half way between the ``below``-th and the next strength, in ascending order: ``quantile`` where every document weighs 1."""
    return ranks.row_numbers(strengths, [], "s", "place").filter(F.col("rn").isin(below - 1, below)).agg(F.avg("s")).first()[0]


def quantile(strengths: list[tuple[int, float]], weight: dict[int, float]) -> float:
    """The strength below which the weighted share of bad labels lies: between the two documents that the share falls on."""
    ordered = sorted(strengths, key=lambda x: x[1])
    share = sum(weight[y] for y, _ in ordered if y == 0)
    held = 0.0
    for (y, s), (_, following) in zip(ordered, ordered[1:], strict=False):
        held += weight[y]
        if held >= share - 1e-9:
            return (s + following) / 2
    return ordered[-1][1]


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1, six decimals). Null and empty texts have the score of no features; without weights all have 0.5.

    A column of ``docs`` of that name is replaced; all others stay.
    """
    S.small_batches(docs.sparkSession)
    weights, shift = model["weights"], math.log(CUT / (1 - CUT)) - model["threshold"]
    kept = docs.drop(score_col)
    at, names = kept.columns.index(text_col), [*kept.columns, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                column = part.column(at)
                if weights is None:
                    p = np.full(part.num_rows, 0.5)
                else:
                    p = 1 / (1 + np.exp(-np.clip((features(column) * weights).sum(1) + shift, -500, 500)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.round(p, 6))], names)

    held = kept.withColumn(text_col, kept[text_col].cast("string"))
    return held.mapInArrow(run, T.StructType([*held.schema.fields, T.StructField(score_col, T.DoubleType())]))


def keep_best(docs: DataFrame, model: dict, share: float, text_col: str = "text") -> DataFrame:
    """``docs`` (all columns) without the ``share`` of them with the lowest scores; rows that score as the quantile itself stay."""
    space = S.Workspace(docs.sparkSession, "quality")
    marked = space.save(score(docs, model, text_col, "__score"), "scored")
    cut = marked.agg(F.percentile_approx("__score", F.lit(float(share)), 10_000)).first()[0]
    return marked.filter(F.col("__score") >= F.lit(cut if cut is not None else 0.0)).select(*docs.columns)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the labels of three quarters of the ids, score every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out_of = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.filter(~out_of("doc_id")), labels.filter(~out_of("doc_id")))
    out = score(docs, model).select("doc_id", out_of("doc_id").alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
