"""Token counts from flat, unindexed token files (operator 6).

A flat file is nothing but ids, little-endian and of one width, each document
followed by the end-of-document id. Spark deals out blocks of equal size; a task
reads its block and finds the end ids with one vectorised comparison. Blocks are
stitched by a prefix scan over (number of ends, last end): where a block starts,
the scan says how many documents lie before it and where the open one began.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace
from .token_files import _open
from .tokens import encoder

SUFFIX = ".tokens"


def free_id(tokenizer_path: str) -> int:
    """The first id behind the vocabulary: no text can hold it."""
    return encoder(tokenizer_path).size


def write_flat(docs: DataFrame, out_dir: str, tokenizer_path: str | None = None, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One flat file for each task; returns the (lazy) list id, path, doc_no, width: who is the n-th document of a file.

    ``end_id`` is by default the first id behind the vocabulary; ids are as wide as
    it needs. Null text is empty. A repeated attempt writes a file of its own; the saved
    list names only the files of attempts that succeeded.
    """
    tok = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tok)
        last = free_id(tok) if end_id is None else end_id
        dtype = enc.dtype if last < 1 << (8 * enc.dtype.itemsize) else np.dtype("<u4")
        ids = (lambda t: enc.encode(t)) if dtype == enc.dtype else (lambda t: np.frombuffer(enc.encode(t), enc.dtype).astype(dtype).tobytes())
        path, out, no = f"{out_dir}/{uuid.uuid4().hex}{SUFFIX}", None, 0
        end = np.array([last], dtype).tobytes()
        for batch in batches:
            if out is None:
                fs, name = _open(path)
                out = fs.open_output_stream(name)
            for i in range(0, batch.num_rows, 256):
                out.write(b"".join(ids(t or "") + end for t in batch.column(1).slice(i, 256).to_pylist()))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([path] * n, pa.string()), pa.array(np.arange(no, no + n)), pa.array(np.full(n, dtype.itemsize, np.int32))],
                ["__id", "path", "doc_no", "width"],
            )
            no += n
        if out is not None:
            out.close()

    rows = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"))
    return rows.mapInArrow(run, f"__id {kind}, path string, doc_no long, width int").withColumnRenamed("__id", id_col)


def files(spark: SparkSession, folder: str, suffix: str = SUFFIX) -> DataFrame:
    """path, length (bytes) of the files in a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return found.select("path", "length")


def count(listed: DataFrame, end_id: int, width: int = 2, block_bytes: int = 8 << 20) -> DataFrame:
    """path, doc_no, start, n_tokens, closed for every document of the files (path, length) ``listed``.

    start is the place of its first id in the file; n_tokens leaves out the end
    id. Ids behind the last end are one more document with closed = false. A file
    without ids has no documents; one whose bytes don't fill whole ids fails.
    """
    if block_bytes % width:
        raise ValueError("block_bytes must be a multiple of width")
    dtype = np.dtype(f"<u{width}")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, no in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if length % width:
                    raise ValueError(f"{path}: {length} bytes are not whole ids")
                fs, name = _open(path)
                with fs.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, length - no * block_bytes), no * block_bytes), dtype)
                ends = np.flatnonzero(ids == end_id) + no * (block_bytes // width)
                row = [[path], [no], [length // width], [len(ends)], [int(ends[-1]) if len(ends) else None], [ends]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["path", "no", "size", "n", "last", "ends"])

    blocks = listed.filter("length > 0").select("path", "length", F.explode(F.expr(f"sequence(0, (length - 1) div {block_bytes})")).alias("no"))
    seen = blocks.repartition("path", "no").mapInArrow(scan, "path string, no long, size long, n long, last long, ends array<long>")
    before = Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    final = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("no"))) == 1
    known = seen.withColumns({"docs": F.coalesce(F.sum("n").over(before), F.lit(0)), "open": F.coalesce(F.max("last").over(before), F.lit(-1)), "final": final})
    # the ids behind a file's last end close with the file
    close = F.when(F.col("final") & (F.coalesce("last", "open") < F.col("size") - 1), F.concat("ends", F.array(F.col("size")))).otherwise(F.col("ends"))
    each = known.select("path", "docs", "open", "size", close.alias("ends")).select("path", "docs", "open", "size", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.expr("try_element_at(ends, i)")) + 1
    return each.select(
        "path", (F.col("docs") + F.col("i")).alias("doc_no"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), (F.col("end") < F.col("size")).alias("closed")
    )


def op6(spark, sf_dir: str) -> DataFrame:
    """Token count of every text of ``documents``, from flat files that the query writes first."""
    end_id = free_id(public_tokenizers.path("byte_bpe_50k.json"))
    width = 2 if end_id < 1 << 16 else 4
    space = Workspace(spark, "token-counts")
    folder = space.folder("flat")
    named = space.save(write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), "names")
    base = lambda c: F.substring_index(c, "/", -1)
    listed = files(spark, folder).join(named.select(base("path").alias("f")).distinct(), base("path") == F.col("f"), "left_semi")
    counted = count(listed, end_id, width).select(base("path").alias("f"), "doc_no", "start", "n_tokens")
    # both sides grow with the documents: neither is broadcast
    return named.select("doc_id", base("path").alias("f"), "doc_no").join(counted.hint("merge"), ["f", "doc_no"]).select("doc_id", "n_tokens")
