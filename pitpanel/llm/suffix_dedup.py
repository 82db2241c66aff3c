"""Suffix-array dedup (operator 10): remove bytes covered by long repeated strings.

Distributed prefix doubling on the positions that can matter. A suffix's rank
among all suffixes by their first k bytes is held as the 64-bit name of those
bytes: names are equal exactly where ranks are, and only equality is asked for.
A round sorts pairs (rank at p, rank at p + k); the name of a pair is the rank by
2k bytes. Positions whose rank is unique are resolved and leave the rounds.

1. *Anchors.* The positions whose name of half the length (200 bytes) is the least
   among ``length - half + 1`` neighbouring ones: every string of ``length`` bytes
   holds one, and equal strings hold the same. Where no anchor's name occurs twice
   nothing repeats, and such stretches (starts between two anchors) go no further.
   Of the others, one that occurs twice as a whole is settled as a whole, and only
   its first copy goes on; so copies of a document cost as much as their stretches.
2. *Doubling.* In what is left, positions chosen by their own first bytes are
   ranked by length/8 (50) bytes, then by pairs of ranks at offset 50 (100 bytes),
   then 100 (200 bytes), until unique or past half the length. A start whose string
   holds a unique one is unique itself: it is resolved.
3. *The last round.* The starts left over are ranked by the pair of their halves
   (200 bytes at p, 200 at p + 200). One whose pair occurs twice repeats.

Names of step 2 only resolve; those of whole stretches and of step 3 decide, and
are taken modulo the prime 2**61 - 1 (``exact_names``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

#: One position in so many is ranked in step 2.
_EVERY = 16


def _extreme(x: np.ndarray, width: int, fold) -> np.ndarray:
    """fold (minimum, maximum) of each window of ``width``; len(x) - width + 1 values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = fold(x[: len(x) - step], x[step:])
        done += step
    return x


class _Text:
    """Rolling names of one document's bytes."""

    def __init__(self, raw: np.ndarray):
        self.sums, self.n = S.prefix_hash(S.BYTE_VALUES[raw]), len(raw)

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return S.span_hash(self.sums, start, end)

    def chosen(self, first: np.ndarray, last: np.ndarray, length: int, unit: int) -> tuple[np.ndarray, np.ndarray]:
        """Ascending positions, chosen by the name of their ``unit`` bytes, within the strings that start in the ranges, and how many units follow there (4 at most)."""
        change = np.zeros(self.n + 1, np.int32)
        np.add.at(change, first, 1)
        np.add.at(change, last + length, -1)
        inside = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, size = edge[0::2], edge[1::2] - edge[0::2]
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        units = np.minimum((np.repeat(edge[1::2], size) - at) // unit, 4)
        at, units = at[units > 0], units[units > 0]
        own = self.names(at, at + unit) % np.uint64(_EVERY) == 0
        return at[own], units[own]

    def anchors(self, length: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ascending anchor positions, their names, and for each start of a string the name of its anchor.

        The text has ``length`` bytes at least.
        """
        at = np.arange(self.n - half + 1)
        names = self.names(at, at + half)
        width = length - half + 1
        least = _extreme(names, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        # the greatest of the minima of the windows around a position equals its name where it is the least of one
        found = np.flatnonzero(_extreme(np.concatenate([edge, least, edge]), width, np.maximum) == names)
        return found, names[found], least


def _round1(length: int, half: int):
    """Rows (key, name, twice) of the different anchor names of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = S.utf8(batch.column(1))
            key, rows, names, twice, held = batch.column(0).to_numpy(), [], [], [], 0
            for i in np.flatnonzero(np.diff(off) >= length):
                _, found, _ = _Text(raw[off[i] : off[i + 1]]).anchors(length, half)
                found, n = np.unique(found, return_counts=True)
                rows.append(np.full(len(found), key[i]))
                names.append(found.view(np.int64))
                twice.append(n > 1)
                held += len(found)
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rows, names, twice)], ["key", "name", "twice"])
                    rows, names, twice, held = [], [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rows, names, twice)], ["key", "name", "twice"])

    return run


def _stretches(text: _Text, repeated: np.ndarray, length: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the stretches in which a repeated string may start."""
    at, _, least = text.anchors(length, half)
    count = text.n - length + 1
    may = np.isin(least, repeated)
    cut = np.zeros(count + 1, bool)
    cut[at[at < count] + 1] = True
    before = np.concatenate([[False], may[:-1]])
    start = np.flatnonzero(may & (~before | cut[:-1]))
    after = np.concatenate([may[1:], [False]])
    end = np.flatnonzero(may & (~after | cut[1:]))
    return start, end


def _round2a(length: int, half: int):
    """Rows (key, name, firsts, lasts) of the stretches of (key, text, repeated): one for each different name of a document.

    A periodic text has the same stretch at every position; its places are one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = S.utf8(batch.column(1))
            keys, names, sizes, firsts, lasts = [], [], [], [], []
            for i, key in enumerate(batch.column(0).to_pylist()):
                text = _Text(raw[off[i] : off[i + 1]])
                start, end = _stretches(text, batch.column(2)[i].values.to_numpy().view(np.uint64), length, half)
                name = S.exact_names(S.exact_sums(raw[off[i] : off[i + 1]]), start, end + length).view(np.int64)
                order = np.argsort(name, kind="stable")
                found, n = np.unique(name, return_counts=True)
                for into, x in ((keys, np.full(len(found), key, np.int64)), (names, found), (sizes, n), (firsts, start[order].astype(np.int32)), (lasts, end[order].astype(np.int32))):
                    into.append(x)
            if keys:
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
                places = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (firsts, lasts)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(names)), *places], ["key", "name", "firsts", "lasts"])

    return run


def _ranked(length: int, unit: int):
    """Rows (key, at, r0, r1, r2, r3): ranks of four units from each chosen position of (key, text, firsts, lasts, asks) on, null beyond the strings that are open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "at", "r0", "r1", "r2", "r3"]
        for batch in batches:
            raw, off = S.utf8(batch.column(1))
            for i, key in enumerate(batch.column(0).to_pylist()):
                text = _Text(raw[off[i] : off[i + 1]])
                at, units = text.chosen(*(batch.column(c)[i].values.to_numpy().astype(np.int64) for c in (2, 3)), length, unit)
                if len(at):
                    ranks = []
                    for k in range(4):
                        start = np.where(units > k, at + k * unit, 0)
                        ranks.append(pa.array(text.names(start, start + unit).view(np.int64), mask=units <= k))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key, np.int64)), pa.array(at.astype(np.int32)), *ranks], names)

    return run


def _last_round(length: int):
    """Rows (name, key, at, asks) of the starts of (key, text, firsts, lasts, asks, at, size) whose strings hold no unique span (at, size)."""
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", "key", "at", "asks"]
        for batch in batches:
            raw, off = S.utf8(batch.column(1))
            out: list[list[np.ndarray]] = [[], [], [], []]
            held = 0
            for i, key in enumerate(batch.column(0).to_pylist()):
                first, last, asks = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3, 4))
                n = (last - first + 1).astype(np.int64)
                at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                asks = np.repeat(asks, n)
                if batch.column(5)[i].is_valid:
                    span, size = (batch.column(c)[i].values.to_numpy().astype(np.int64) for c in (5, 6))
                    change = np.zeros(off[i + 1] - off[i] + 1, np.int32)
                    np.add.at(change, np.maximum(span + size - length, 0), 1)
                    np.add.at(change, span + 1, -1)
                    left = (np.cumsum(change) <= 0)[at]
                    at, asks = at[left], asks[left]
                if not len(at):
                    continue
                sums = S.exact_sums(raw[off[i] : off[i + 1]])
                pair = S.exact_names(sums, at, at + half) * np.uint64(0x9FB21C651E98DF25) + S.exact_names(sums, at + half, at + length)
                for k, x in enumerate((S.mix(pair).view(np.int64), np.full(len(at), key, np.int64), at.astype(np.int32), asks)):
                    out[k].append(x)
                held += len(at)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)
                    out, held = [[], [], [], []], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)

    return run


def _resolved(going: DataFrame, space: S.Workspace, length: int) -> DataFrame | None:
    """(key, spans, sizes): unique strings within the starts of (key, text, firsts, lasts, asks), by doubling; None for short lengths."""
    unit = length // 8
    if not unit:
        return None
    ranked = space.save(going.mapInArrow(_ranked(length, unit), "key long, at int, r0 long, r1 long, r2 long, r3 long"), "ranked")
    found = None
    for n in (1, 2, 4):
        rank = [f"r{k}" for k in range(n)]
        groups = ranked.filter(f"r{n - 1} is not null").groupBy(*rank).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.min("at").alias("at"))
        if n < 4:
            groups = space.save(groups.select("n", "key", "at", *rank), f"groups-{n}")
        unique = groups.filter("n = 1").select("key", "at", F.lit(n * unit).alias("size"))
        found = unique if found is None else found.unionByName(unique)
        if n < 4:  # only positions that are not unique yet are ranked by the next pair
            again = groups.filter("n > 1").select(*rank)
            # saved, so that a frequent rank is split by the join and combined before the next round deals it out
            ranked = space.save(ranked.join(again.hint("merge"), rank, "left_semi"), f"ranked-{n}")
    held = found.groupBy("key").agg(F.collect_list(F.struct("at", "size")).alias("s"))
    return held.select("key", F.col("s.at").alias("spans"), F.col("s.size").alias("sizes"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, n_bytes, n_removed, n_spans, kept) of (id, text, starts, ends): runs of bytes to remove."""
    for batch in batches:
        raw, off = S.utf8(batch.column(1))
        removed, spans, kept = [], [], []
        for i in range(batch.num_rows):
            text = raw[off[i] : off[i + 1]]
            start, end = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
            change = np.zeros(len(text) + 1, np.int32)
            np.add.at(change, start, 1)
            np.add.at(change, end, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0)
            kept.append(text[~gone].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            ["__id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def _only(held):
    """Rows of (slot, ...) that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            part = batch.filter(pa.array(S.in_bitmap(bits, batch.column(0).to_numpy())))
            if part.num_rows:
                yield part

    return run


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (binary) of each row of ``docs``.

    Removed is each byte (UTF-8) covered by a string of ``length`` bytes that also
    starts anywhere else, in the same document too; matches don't cross documents
    and are judged on the input. What is kept may cut a character in two. Null
    text is empty. Rows that repeat are documents that repeat; null ids are kept.
    """
    if length < 2:
        raise ValueError("length must be 2 at least")
    spark, half = docs.sparkSession, -(-length // 2)
    space = S.Workspace(spark, "suffix-dedup")
    rows = docs.select(docs[id_col].alias("__id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("__text"))
    # rows that are equal in id and text share a key: what is found for one holds for all
    rows = rows.withColumn("key", F.xxhash64("__id", "__text"))
    long = rows.filter(F.octet_length("__text") >= length)

    # step 1: names of anchors that occur more than once
    anchors = space.save(long.select("key", "__text").mapInArrow(_round1(length, half), "key long, name long, twice boolean"), "anchors")
    twice = anchors.groupBy("name").agg((F.count(F.lit(1)) + F.max(F.col("twice").cast("int"))).alias("n")).filter("n > 1").select("name")
    again = anchors.join(twice.hint("merge"), "name")
    repeated = space.save(again.groupBy("key").agg(F.collect_set("name").alias("repeated")), "repeated")
    space.drop("anchors")

    # the documents with such an anchor
    bits = spark.sparkContext.broadcast(S.bitmap(repeated, S.slots("key")))
    kind = rows.schema["__id"].dataType.simpleString()
    slotted = rows.select(S.slots("key").alias("slot"), "key", "__id", "__text")
    some = slotted.filter(F.octet_length("__text") >= length).mapInArrow(_only(bits), f"slot int, key long, __id {kind}, __text string")
    texts = space.save(some.select("key", "__text").join(repeated, "key"), "texts")

    # stretches as a whole: of equal ones the first place of the first document goes on
    stretches = texts.select("key", "__text", "repeated").mapInArrow(_round2a(length, half), "key long, name long, firsts array<int>, lasts array<int>")
    stretches = space.save(stretches, "stretches")
    lead = stretches.groupBy("name").agg(F.sum(F.size("firsts")).alias("n"), F.min(F.struct("key", F.col("firsts")[0].alias("first"), F.col("lasts")[0].alias("last"))).alias("l"))
    lead = space.save(lead.select("name", (F.col("n") > 1).alias("settled"), "l.*"), "leads")
    going = lead.groupBy("key").agg(F.collect_list(F.struct("first", "last", (~F.col("settled")).alias("asks"))).alias("s"))
    going = going.select("key", F.col("s.first").alias("firsts"), F.col("s.last").alias("lasts"), F.col("s.asks").alias("asks"))
    going = space.save(texts.select("key", "__text").join(going, "key"), "going")
    settled = stretches.join(lead.filter("settled").select("name").hint("merge"), "name", "left_semi").select("key", "firsts", "lasts")
    space.drop("texts")

    # steps 2 and 3
    resolved = _resolved(going, space, length)
    none = F.lit(None).cast("array<int>")
    left = going.withColumns({"spans": none, "sizes": none}) if resolved is None else going.join(resolved.hint("merge"), "key", "left")
    positions = left.mapInArrow(_last_round(length), "name long, key long, at int, asks boolean")
    positions = space.save(positions, "positions")
    twice = positions.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")
    met = positions.filter("asks").join(twice.hint("merge"), "name", "left_semi").select("key", "at")
    # neighbouring starts of a document become one run of bytes
    by_key = Window.partitionBy("key")
    first = F.when(F.col("at") - F.lag("at").over(by_key.orderBy("at")) <= length, 0).otherwise(1)
    runs = met.withColumn("new", first)
    runs = runs.withColumn("run", F.sum("new").over(by_key.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("key", "run").agg(F.min("at").alias("first"), F.max("at").alias("last")).select("key", "first", "last")
    each = F.explode(F.arrays_zip("firsts", "lasts")).alias("x")
    covered = settled.select("key", each).select("key", F.col("x.firsts").alias("first"), F.col("x.lasts").alias("last")).unionByName(runs)
    gone = covered.groupBy("key").agg(F.collect_set(F.struct(F.col("first").alias("s"), (F.col("last") + length).alias("e"))).alias("r"))
    gone = space.save(gone.select("key", F.col("r.s").alias("starts"), F.col("r.e").alias("ends")), "gone")
    space.drop("stretches", "leads", "going", "ranked", "ranked-1", "ranked-2", "groups-1", "groups-2", "positions")

    # only documents that lose bytes meet their runs
    bits = spark.sparkContext.broadcast(S.bitmap(gone, S.slots("key")))
    hit = slotted.mapInArrow(_only(bits), f"slot int, key long, __id {kind}, __text string").select("key", "__id", "__text")
    none = F.array().cast("array<int>")
    cut = hit.join(gone, "key", "left").select("__id", "__text", F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"))
    fields = f"__id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(~S.in_bitmap(bits.value, batch.column(0).to_numpy())))
            if part.num_rows:
                raw, off = S.utf8(part.column(2))
                zero = pa.array(np.zeros(part.num_rows, np.int64))
                kept = part.column(2).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(np.diff(off)), zero, zero, kept], ["__id", "n_bytes", "n_removed", "n_spans", "kept"])

    whole = slotted.select("slot", "__id", "__text").mapInArrow(others, fields)
    out = whole.unionByName(cut.mapInArrow(_remove, fields))
    return out.withColumnRenamed("__id", id_col)


def op10(spark, sf_dir: str) -> DataFrame:
    """All texts of ``documents``."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
