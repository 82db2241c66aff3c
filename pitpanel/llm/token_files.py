"""Token-ID output in Arrow files of equal-length sequences (operator 2).

Documents are sorted by id over all tasks; each task writes one Arrow IPC file
(the stream of record batches between magic bytes, plus a footer of their
places), uncompressed, so that a reader maps it and takes any sequence without
a copy. A row is one sequence: ``tokens``, a fixed-size list of the smallest
unsigned type that holds the vocabulary, and ``mask``, a fixed-size list of
booleans that is false on the padding of a file's last sequence. Every batch but
the last has ``batch_rows`` sequences, so sequence ``i`` is row ``i % batch_rows``
of batch ``i // batch_rows``.

A file's name is its own for each attempt of a task. The index (document, file,
place, length) is a table that Spark commits; it names only files of attempts
that succeeded, so repeated or lost tasks leave at most unnamed files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace
from .tokens import encoder


def _uri(path: str) -> str:
    """A path as Arrow names it: Hadoop's names of the S3 scheme become ``s3``, a path without a scheme is a file."""
    scheme, found, rest = path.partition("://")
    if found:
        return "s3://" + rest if scheme in ("s3a", "s3n") else path
    return path if path.startswith("file:") else f"file://{path}"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and name of a path; the region and keys of an S3 bucket come from the environment of the executors."""
    uri = _uri(path)
    if uri.startswith("s3://") and "?" not in uri:
        return pafs.S3FileSystem(), uri.removeprefix("s3://")
    return pafs.FileSystem.from_uri(uri)


class TokenFile:
    """Random access to one file; sequences and spans are views of the mapped file where that is possible."""

    def __init__(self, path: str):
        fs, name = _open(path)
        source = pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)
        self.file = pa.ipc.open_file(source)
        meta = self.file.schema.metadata
        self.length, self.batch_rows = int(meta[b"sequence_length"]), int(meta[b"batch_rows"])

    def _flat(self, batch: int, name: str) -> np.ndarray:
        column = self.file.get_batch(batch).column(name)
        return column.flatten().to_numpy(zero_copy_only=pa.types.is_integer(column.type.value_type))

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch, row = divmod(i, self.batch_rows)
        at = slice(row * self.length, (row + 1) * self.length)
        return self._flat(batch, "tokens")[at], self._flat(batch, "mask")[at]

    def span(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start`` of the file on; a view if they lie in one batch."""
        size, parts = self.batch_rows * self.length, []
        while n > 0:
            batch, at = divmod(start, size)
            parts.append(self._flat(batch, "tokens")[at : at + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _writer(out_dir: str, tokenizer_path: str, end_id: int, length: int, batch_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        dtype = enc.dtype if end_id < 1 << (8 * enc.dtype.itemsize) else np.dtype("<u4")
        part = TaskContext.get().partitionId()
        path = f"{out_dir}/tokens-{part:06d}-{uuid.uuid4().hex}.arrow"
        fs, name = _open(path)
        kinds = {"tokens": pa.list_(pa.from_numpy_dtype(dtype), length), "mask": pa.list_(pa.bool_(), length)}
        schema = pa.schema(kinds, {"sequence_length": str(length), "batch_rows": str(batch_rows), "end_id": str(end_id)})
        end, size, held, n_held, at, sink = np.array([end_id], dtype).tobytes(), batch_rows * length * dtype.itemsize, [], 0, 0, None

        def put(raw: bytes, fill: int) -> None:
            rows = -(-len(raw) // (length * dtype.itemsize))
            ids = np.frombuffer(raw.ljust(rows * length * dtype.itemsize, b"\0"), dtype)
            mask = np.arange(rows * length) < fill
            sink.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (ids, mask)], schema=schema))

        with fs.open_output_stream(name) as out:
            sink = pa.ipc.new_file(out, schema)
            for batch in batches:
                lengths = []
                for text in batch.column(1).to_pylist():
                    ids = enc.encode(text or "")
                    if dtype != enc.dtype:
                        ids = np.frombuffer(ids, enc.dtype).astype(dtype).tobytes()
                    held += [ids, end]
                    n_held += len(ids) + len(end)
                    lengths.append(len(ids) // dtype.itemsize + 1)
                    if n_held >= size:
                        raw = b"".join(held)
                        for i in range(0, n_held - size + 1, size):
                            put(raw[i : i + size], size // dtype.itemsize)
                        held = [raw[n_held - n_held % size :]]
                        n_held %= size
                n = np.array(lengths, np.int64)
                ends = at + np.cumsum(n)
                at = int(ends[-1]) if len(n) else at
                names = ["__id", "part", "path", "place", "n_tokens"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array([path] * len(n), pa.string()), pa.array(ends - n), pa.array(n)], names
                )
            if n_held:
                put(b"".join(held), n_held // dtype.itemsize)
            sink.close()

    return run


def write(
    docs: DataFrame,
    out_dir: str,
    tokenizer_path: str | None = None,
    end_id: int = 2,
    length: int = 2048,
    batch_rows: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write ``docs`` in ascending id order below ``out_dir`` and return the (lazy) index; saving it does the writing.

    Index: id, part (files in order), path, place (of the first id in the file),
    n_tokens (with the end id). Null text is empty: its end id alone. Null ids
    come first; rows with equal ids are ordered by a hash of their texts, which
    also lets them lie in several files.
    """
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"), F.xxhash64(docs[text_col]).alias("__k"))
    rows = rows.repartitionByRange("__id", "__k").sortWithinPartitions("__id", "__k")
    index = rows.mapInArrow(_writer(out_dir, path, end_id, length, batch_rows), f"__id {kind}, part int, path string, place long, n_tokens long")
    return index.withColumnRenamed("__id", id_col)


def read(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document from the files: id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit, binary)."""
    kind = index.schema[id_col].dataType.simpleString()
    # one row for each file: few beside the documents
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    files = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path, file = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, ids = batch.slice(i, 256), []
                for path, place, n in zip(*(part.column(c).to_pylist() for c in ("path", "place", "n_tokens")), strict=True):
                    if path != open_path:
                        open_path, file = path, TokenFile(path)
                    ids.append(file.span(place, n).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column("n_tokens"), pa.array(ids, pa.binary())], ["__id", "start", "n_tokens", "ids"]
                )

    placed = index.join(files, "part").select(F.col(id_col).alias("__id"), (F.col("before") + F.col("place")).alias("start"), "n_tokens", "path", "place")
    ordered = placed.repartition("path").sortWithinPartitions("path", "place")
    return ordered.mapInArrow(run, f"__id {kind}, start long, n_tokens long, ids binary").withColumnRenamed("__id", id_col)


def op2(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, encoded, written to Arrow files and read back from them."""
    space = Workspace(spark, "token-files")
    index = space.save(write(spark.read.parquet(f"{sf_dir}/documents.parquet"), space.folder("arrow")), "index")
    return read(index).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
