"""Small helpers shared by the training-data operators.

* :class:`Workspace` keeps intermediate tables in the folder that the cluster
  names in ``spark.checkpoint.dir``; every executor and the driver can read it,
  so a lost executor costs only the tasks it was running.
* :func:`bitmap` / :func:`in_bitmap` are a fixed-size prefilter: a bitmap of
  ``BITMAP_BITS`` bits however many keys it holds. It may let others pass, never
  drops a key, and is always followed by an exact join.
* Names of byte strings come in three strengths. :func:`span_names` are 64-bit
  hashes of words and lines, :func:`exact_names` are sums modulo the prime 2**61 - 1
  over any span: these two decide equality. :func:`span_hash` sums modulo 2**64 are
  cheaper, but differ for some regular strings less often than chance would have it:
  they choose and filter only, and what they let through is compared again.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a prefilter bitmap (1 MiB), independent of the data.
BITMAP_BITS = 1 << 23
_BUCKET = 32768  # bits in one bitmap of bitmap_construct_agg


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="pitpanel-")
    atexit.register(shutil.rmtree, folder, True)
    return f"file://{folder}"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a private folder in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is unset on {master}: intermediate tables need a folder that all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


#: Rows handed to Python at once: texts are long, and a worker holds a batch in and out.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows; a smaller setting stays.

    It holds for the session from then on, since plans read it when they run.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class Workspace:
    """Tables and files of one operator call, below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._hadoop(self.path).deleteOnExit(self._path(self.path))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _hadoop(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folder(self, name: str) -> str:
        path = f"{self.path}/{name}"
        self._hadoop(path).mkdirs(self._path(path))
        return path

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back: its lineage is cut."""
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            self._hadoop(self.path).delete(self._path(f"{self.path}/{name}"), True)


def columns(prefix: str, df: DataFrame, *names: str) -> list[Column]:
    """``names`` of ``df`` under ``prefix``: internal names can't clash with a caller's columns."""
    return [df[n].alias(prefix + n) for n in names]


# ---------------------------------------------------------------- prefilter


def slots(key: Column | str) -> Column:
    """The slot of an integer key in a bitmap."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(BITMAP_BITS)).cast("int")


def bitmap(keys: DataFrame, slot: Column) -> np.ndarray:
    """Bitmap (``BITMAP_BITS`` bits as uint8) of the slots of all rows.

    The collected rows are at most ``BITMAP_BITS / 32768`` bitmaps of 4 KiB.
    """
    rows = (
        keys.select(slot.alias("slot"))
        .groupBy(F.floor(F.col("slot") / _BUCKET).cast("int").alias("bucket"))
        .agg(F.expr(f"bitmap_construct_agg(int(slot % {_BUCKET}))").alias("bits"))
        .collect()
    )
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in rows:
        at = r["bucket"] * (_BUCKET // 8)
        out[at : at + _BUCKET // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


# ---------------------------------------------------------------- text as bytes


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets, without a copy; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each: work arrays stay small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# ---------------------------------------------------------------- hashing in numpy

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: One 64-bit value for each byte, from a fixed seed: the same on every worker.
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, np.uint64, False)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i (mod 2**64) for i < n; kept by the worker while small."""
    if n > len(_powers[0]):
        size = 1 << max(20, int(n - 1).bit_length())
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        if size > 1 << 22:
            return made[0][:n], made[1][:n]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums; the name of values[s:e] is (out[e]-out[s]) * base**-s."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_CHUNKS = 4  # spans of up to so many 8-byte words are hashed in bulk


def span_names(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans raw[start:end], whatever they hold.

    Short spans are mixed eight bytes at a time, all at once; longer ones, few for
    their bytes, go to xxHash one by one.
    """
    size = (end - start).astype(np.int64)
    held = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.ndarray((len(held) - 7,), "<u8", held, strides=(1,))
    out = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    short = size <= 8 * _CHUNKS
    todo = np.arange(len(size)) if short.all() else np.flatnonzero(short)
    for k in range(_CHUNKS):
        todo = todo[size[todo] > 8 * k]
        if not len(todo):
            break
        left = np.minimum(size[todo] - 8 * k, 8).astype(np.uint64)
        value = words[start[todo] + 8 * k] & (_TOP >> (np.uint64(64) - np.uint64(8) * left))
        out[todo] = mix(out[todo] ^ mix(value + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)))
    for i in np.flatnonzero(~short):
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].tobytes(), 20240229)
    return out


#: The prime of exact names, and a fixed base and value for each byte drawn below it.
_PRIME = (1 << 61) - 1
_EXACT_BASE = 0x12D687E3A5C94B17 % _PRIME
_EXACT_VALUES = np.random.Generator(np.random.PCG64(61)).integers(1, 1 << 31, 256).astype(np.uint64)
_TOP, _P, _LOW31, _LOW30 = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(_PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_U31, _U30, _U61, _TWO = np.uint64(31), np.uint64(30), np.uint64(61), np.uint64(2)


def _fold(x: np.ndarray) -> np.ndarray:
    return (x & _P) + (x >> _U61)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, up to one multiple of it; both below 2**61 + 8."""
    a1, a0, b1, b0 = a >> _U31, a & _LOW31, b >> _U31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _fold(_fold(_TWO * (a1 * b1)) + (middle >> _U30) + ((middle & _LOW30) << _U31) + _fold(a0 * b0))


@lru_cache(maxsize=2)
def _prime_powers(size: int, inverse: bool) -> np.ndarray:
    base, out, done = np.array([pow(_EXACT_BASE, -1 if inverse else 1, _PRIME)], np.uint64), np.ones(size, np.uint64), 1
    while done < size:
        step = np.array([pow(int(base[0]), done, _PRIME)], np.uint64)
        more = _times(out[: min(done, size - done)], step)
        out[done : done + len(more)] = np.where(more >= _P, more - _P, more)
        done += len(more)
    return out


def exact_sums(raw: np.ndarray) -> np.ndarray:
    """Running sums modulo 2**61 - 1 of the bytes' values times powers of a base."""
    power = _prime_powers(1 << max(16, int(len(raw)).bit_length()), False)[: len(raw)]
    value = _EXACT_VALUES[raw]
    high = value * (power >> _U31)
    term = _fold(_fold((high >> _U30) + ((high & _LOW30) << _U31)) + _fold(value * (power & _LOW31)))
    out = np.zeros(len(raw) + 1, np.uint64)
    top = np.cumsum(term >> _U31, dtype=np.uint64)
    out[1:] = _fold((top >> _U30) + ((top & _LOW30) << _U31) + np.cumsum(term & _LOW31, dtype=np.uint64))
    return out


def exact_names(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name of the bytes of each span from their ``exact_sums``; spans of unequal length have names of their own."""
    inverse = _prime_powers(1 << max(16, int(len(sums)).bit_length()), True)
    x = _times(_fold(sums[end] + (_P + _P - sums[start])), inverse[start])
    x = np.where(x >= _P, x - _P, x)
    return mix(x + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def token_spans(raw: np.ndarray, is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, and for each row the index of its first run.

    Runs never cross rows.
    """
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = is_word[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0], edge[-1] = inside[0], inside[-1]
    cut = np.unique(offsets[1:-1])
    cut = cut[(cut > 0) & (cut < len(raw))]
    both = inside[cut] & inside[cut - 1]
    at = np.flatnonzero(edge)
    if both.any():  # a run that goes over the end of a row is cut there
        twice = np.repeat(cut[both], 2)
        at = np.insert(at, np.searchsorted(at, twice), twice)
    start, end = at[0::2], at[1::2]
    return start, end, np.searchsorted(start, offsets)


def word_table(separators: str) -> np.ndarray:
    """True for every byte that is not one of the (ASCII) separators."""
    table = np.ones(256, bool)
    table[[ord(c) for c in separators]] = False
    return table


#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lists(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """List column of ``n`` rows from ``values`` and the (ascending) row of each."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


# ---------------------------------------------------------------- components


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b: long) is linked with, itself included.

    Alternating stars: every node hands its larger, then its smaller neighbours
    to the smallest node it knows, until all hang at their component's minimum.
    The number of rounds grows with the logarithm of the longest chain. Nodes
    and links stay in Spark; each round is a table in the shared folder.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now, said, step = space.save(now, f"{name}-0"), None, 0

    def least(links: DataFrame) -> DataFrame:
        """``links`` with m, the smallest v of each u; the joins may split a node with many links."""
        return links.join(links.groupBy("u").agg(F.min("v").alias("m")).hint("merge"), "u")

    while True:
        print_now = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if print_now == said:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        said, step = print_now, step + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        small = least(large)
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        # links never grow in number: so few files hold them
        now = space.save(small.select("e.u", "e.v").filter("u <> v").distinct().coalesce(1 + 2 * said[0] // 200_000), f"{name}-{step}")
        space.drop(f"{name}-{step - 1}")
