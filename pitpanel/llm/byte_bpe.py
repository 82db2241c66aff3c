"""Byte-level BPE encoding and decoding by overlapping chunks (operator 9).

Texts of at most ``chunk_chars`` characters are one chunk. Longer ones are cut
by Spark into chunks that overlap; the chunks are dealt over all tasks and
pre-tokenised there from their first character, although that may lie within a
pre-token. Two neighbours are stitched at the first boundary that both see in
their overlap and that does not follow white space: a pre-token depends only on
the text from its start on, so from a common boundary on they agree. The pieces
between the stitches are then encoded on their own, in parallel; only a run of
white space looks at what follows it, and no piece but the last ends with one.
Should two neighbours have no such boundary (one pre-token longer than the
overlap), the text is one piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches

#: Characters that a pre-token's choice looks at beyond its start at least ('ll, 're, 've), or beyond its end (one).
_LOOKS = 3


@lru_cache(maxsize=2)
def _encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _encode(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks_path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            for i in range(0, batch.num_rows, 256):  # a part at a time: its ids are held as Python bytes
                part = batch.slice(i, 256)
                ids = [np.array(enc.encode_ordinary(t or ""), "<u4").tobytes() for t in part.column(at).to_pylist()]
                cols = [c for k, c in enumerate(part.columns) if k != at] + [pa.array(ids, pa.binary())]
                names = [n for n in batch.schema.names if n != "__text"] + ["__ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _boundaries(pattern: str, chunk: int, overlap: int):
    """head, tail: starts of pre-tokens in the overlap with the chunk before and after, as positions in the text; in tail not those behind white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, space = regex.compile(pattern).finditer, regex.compile(r"\s").match
        for batch in batches:
            head, tail = [], []
            for text, first, last in zip(*(batch.column(n).to_pylist() for n in ("__text", "__first", "__last")), strict=True):
                starts = np.fromiter((m.start() for m in find(text)), np.int64)
                if not last:  # the end of the text is not in sight
                    starts = starts[starts + _LOOKS <= len(text)]
                head.append(starts[starts < overlap] + first)
                late = starts[starts >= chunk]
                tail.append(late[[space(text, s - 1) is None for s in late.tolist()]] + first)
            cols = [pa.array(x, pa.list_(pa.int64())) for x in (head, tail)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "__head", "__tail"])

    return run


def encode(
    docs: DataFrame,
    ranks_path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    chunk_chars: int = 32_768,
    overlap: int = 1_024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_tokens, ids): ids are little-endian unsigned 32-bit integers in one binary value.

    Null text is empty and gives no ids; rows that repeat are encoded each; a
    null id is kept. Other columns are not looked at.
    """
    if not 0 < overlap <= chunk_chars:
        raise ValueError("overlap must be between 1 and chunk_chars")
    small_batches(docs.sparkSession)
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("__id"), F.coalesce(docs[text_col], F.lit("")).alias("__text"))
    encoder = _encode(ranks_path, pattern)
    is_long = F.length("__text") > chunk_chars
    short = rows.filter(~is_long).mapInArrow(encoder, f"__id {kind}, __ids binary")

    # the same text under the same id is cut once; n says how often the row stands there
    long = rows.filter(is_long).withColumn("__key", F.sha2("__text", 256))
    n = F.length("__text")
    chunks = long.select(
        "__id", "__key", n.alias("__n"), "__text", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk_chars).cast("int"))).alias("__no")
    )
    chunks = chunks.select(
        "__id",
        "__key",
        "__no",
        "__n",
        F.expr(f"substring(__text, __no * {chunk_chars} + 1, {chunk_chars + overlap})").alias("__text"),
        (F.col("__no").cast("long") * chunk_chars).alias("__first"),
        (F.col("__no") == F.floor((F.col("__n") - 1) / chunk_chars)).alias("__last"),
    ).dropDuplicates(["__id", "__key", "__no"])
    fields = f"__id {kind}, __key string, __no int, __n int, __text string, __first long, __last boolean"
    seen = chunks.mapInArrow(_boundaries(pattern, chunk_chars, overlap), f"{fields}, __head array<long>, __tail array<long>")
    order = Window.partitionBy("__id", "__key").orderBy("__no")
    cut = seen.withColumn("__cut", F.array_min(F.array_intersect("__tail", F.lead("__head").over(order))))
    cut = cut.withColumns(
        {
            "__from": F.coalesce(F.lag("__cut").over(order), F.lit(0)),
            "__to": F.when(F.col("__last"), F.col("__n")).otherwise(F.col("__cut")),
            "__whole": F.max(F.col("__cut").isNull() & ~F.col("__last")).over(Window.partitionBy("__id", "__key")),
        }
    )
    # a text without a stitch somewhere is put together again from its chunks and encoded as one piece
    again = (
        cut.filter("__whole")
        .groupBy("__id", "__key")
        .agg(F.array_sort(F.collect_list(F.struct("__no", F.expr(f"substring(__text, 1, {chunk_chars})").alias("t")))).alias("c"), F.max("__n"))
        .select("__id", "__key", F.lit(0).alias("__no"), F.array_join(F.transform("c", lambda c: c["t"]), "").alias("__text"))
    )
    pieces = cut.filter("not __whole").select(
        "__id", "__key", "__no", F.expr("substring(__text, int(__from - __first + 1), int(__to - __from))").alias("__text")
    )
    encoded = pieces.unionByName(again).mapInArrow(encoder, f"__id {kind}, __key string, __no int, __ids binary")
    joined = (
        encoded.groupBy("__id", "__key")
        .agg(F.array_sort(F.collect_list(F.struct("__no", F.hex("__ids").alias("h")))).alias("c"))
        .select("__id", "__key", F.unhex(F.array_join(F.transform("c", lambda c: c["h"]), "")).alias("__ids"))
    )
    # every row of the input again, repeated ones too
    whole = (
        long.select(F.col("__id").alias("i"), F.col("__key").alias("k"))
        .join(joined, F.col("i").eqNullSafe(F.col("__id")) & (F.col("k") == F.col("__key")))
        .select("__id", "__ids")
    )
    return short.unionByName(whole).select(
        F.col("__id").alias(id_col), (F.octet_length("__ids") / 4).cast("long").alias("n_tokens"), F.col("__ids").alias("ids")
    )


def decode(tokens: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with a binary column ``decoded``: the raw bytes of its ids, one after another (null: null)."""
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks_path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = [b if b is None else enc.decode_bytes(np.frombuffer(b, "<u4").tolist()) for b in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    from pyspark.sql import types as T

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())]))


def op9(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, encoded and decoded again."""
    done = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
