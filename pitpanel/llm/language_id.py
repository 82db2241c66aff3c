"""Language ID (operator 3): multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and its n-grams of ``ORDERS`` characters are hashed into
``2**bits`` buckets. Training counts come from Spark: each task sums its
documents, the sums are added by (language, bucket). The log-probability matrix
(languages x buckets; bounded by ``MAX_LANGUAGES`` and ``bits``) is broadcast and
tasks score batches with numpy: the log-probabilities of a text's n-grams are
gathered and summed, which is its sparse count row times the matrix.

Training reads at most about ``train_docs`` documents of each language (a
document is in when the hash of its id falls below the bound divided by the
language's count); everything is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

ORDERS = (1, 2, 3)
MAX_LANGUAGES = 512
UNKNOWN = "und"
_BLOCK = 1 << 18  # characters worked on at once


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")


def _buckets(codes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Bucket of every n-gram, by order."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint64)
        for k in range(max(ORDERS)):
            if len(codes) <= k:
                return
            h = (h[: len(codes) - k] + codes[k:].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if k + 1 in ORDERS:
                yield ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)


def _blocks(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, codes) in bounded pieces; pieces of one text overlap by no n-gram start."""
    for row, text in enumerate(texts):
        codes = _codes(text)
        for i in range(0, len(codes), _BLOCK):
            yield row, codes[i : i + _BLOCK + max(ORDERS) - 1]


def fit(labelled: DataFrame, train_docs: int = 3_000, bits: int = 16, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """A model from the rows with text and language: ``{"langs", "matrix", "prior"}``.

    Null texts, null languages and texts without a letter teach nothing. No rows:
    a model without languages, which predicts ``und``.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(labelled[id_col].alias("__id"), labelled[text_col].alias("__text"), labelled[lang_col].cast("string").alias("__lang"))
    rows = rows.filter("__lang is not null and __text rlike '\\\\p{L}'")
    sizes = {r["__lang"]: r["n"] for r in rows.groupBy("__lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "matrix": np.zeros((0, 1 << bits), np.float32), "prior": np.zeros(0), "bits": bits}
    share: Column = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, train_docs / sizes[k]))])[F.col("__lang")]
    unit = F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(unit < share).select(F.array_position(F.array(*map(F.lit, langs)), F.col("__lang")).cast("int").alias("__k"), "__text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            ks = batch.column(0).to_pylist()
            for row, codes in _blocks(batch.column(1).to_pylist()):
                into = sums.setdefault(ks[row] - 1, np.zeros(1 << bits, np.int64))
                for b in _buckets(codes, bits):
                    into += np.bincount(b[:_BLOCK], minlength=1 << bits)
        for k, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["k", "b", "n"])

    counted = sample.mapInArrow(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # at most languages x buckets rows
    counts = np.zeros((len(langs), 1 << bits))
    counts[table.column("k").to_numpy(), table.column("b").to_numpy()] = table.column("n").to_numpy()
    smooth = counts + 0.5
    matrix = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)
    prior = np.log(np.array([sizes[k] for k in langs], float) / sum(sizes.values()))
    return {"langs": langs, "matrix": matrix, "prior": prior, "bits": bits}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior probability of that language per text.

    ``und`` with score 0 where the text is null or has no letter. A column of
    ``docs`` with one of these two names is replaced; all others stay.
    """
    langs, bits = model["langs"], model["bits"]
    small_batches(docs.sparkSession)
    # buckets by languages: the values of one n-gram lie side by side
    held = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(model["matrix"].T), model["prior"]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, prior = held.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [t or "" for t in part.column(at).to_pylist()]
                sums = np.tile(prior, (len(texts), 1))
                for row, codes in _blocks(texts):
                    for b in _buckets(codes, bits):
                        used, n = np.unique(b[:_BLOCK], return_counts=True)
                        sums[row] += n @ matrix[used]
                best = sums.argmax(1) if langs else np.zeros(len(texts), int)
                likely = np.exp(sums - sums.max(1, keepdims=True)) if langs else None
                pred, conf = [], []
                for k, t in enumerate(texts):
                    known = bool(langs) and any(c.isalpha() for c in t)
                    pred.append(langs[best[k]] if known else UNKNOWN)
                    conf.append(float(1 / likely[k].sum()) if known else 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(conf, pa.float64())], names)

    kept = docs.drop("lang_pred", "score").withColumn(text_col, docs[text_col].cast("string"))
    at, names = kept.columns.index(text_col), [*kept.columns, "lang_pred", "score"]
    from pyspark.sql import types as T

    fields = [*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return kept.mapInArrow(score, T.StructType(fields))


def op3(spark, sf_dir: str) -> DataFrame:
    """Train on three quarters of ``documents`` by id, predict every one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit(docs.filter(~F.coalesce(held_out, F.lit(False))))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


def keep_known(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """``docs`` (all columns) without those whose language is ``und`` or less likely than ``least``."""
    marked = predict(docs.withColumns({"__" + c: docs[c] for c in ("lang_pred", "score") if c in docs.columns}), model)
    kept = marked.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col("__" + c if c in ("lang_pred", "score") else c).alias(c) for c in docs.columns])
