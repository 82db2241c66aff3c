"""Benchmark decontamination by a distributed positional inverted index (operator 5).

1. The words of the benchmark items are named (64 bits) and a fixed-size bitmap
   of them is broadcast.
2. One pass over the documents stores their postings: word and position, for
   stretches of benchmark words that are long enough to hold a window. Whatever
   lies outside cannot be part of a match.
3. The length of every posting list is counted. Each window of an item is looked
   up by its rarest word: the lists of these words alone are read, each posting
   moved back by the word's place in the item. What remains is a few alignments
   (document, stretch, item, offset).
4. At each alignment the other words' postings are compared; stretches of equal
   words that hold a window are matches.

A word's list may be long (a hot word, a hot passage): it is joined with the few
items that have it as their rarest word, and such alignments grow with the
passages found, not with their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

#: Bytes of a word after lower-casing: digits, a-z and everything above ASCII (fixed value).
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_TRUE = np.array([False, True])
#: Stands for a null id within the joins.
_NO_ID = -(1 << 63)


def word_names(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, names, first): the names of the words of rows i to j and the index of each row's first word."""
    raw, offsets = S.utf8(column)
    for i, j in S.slices(offsets):
        part = S.LOWER[raw[offsets[i] : offsets[j]]]
        start, end, first = S.token_spans(part, _WORD, offsets[i : j + 1] - offsets[i])
        yield i, j, S.span_names(part, start, end), first


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, names, first in word_names(batch.column(1)):
            words = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(names.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), words], ["item_id", "words"])


def _postings(held, least: int):
    mask = np.uint64(S.BITMAP_BITS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            for i, j, names, first in word_names(batch.column(1)):
                known = S.in_bitmap(bits, (names & mask).astype(np.int64))
                start, end, _ = S.token_spans(known.view(np.uint8), _TRUE, first)
                long = end - start >= least
                start, end = start[long], end[long]
                row = np.searchsorted(first, start, "right") - 1
                n = end - start
                inside = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else start
                at = np.cumsum(n) - n
                words = S.lists(names[inside].view(np.int64), np.repeat(row, n), j - i, pa.int64())
                base = np.concatenate([[0], np.cumsum(np.bincount(row, n, j - i))]).astype(np.int64)  # words stored before each row
                ints = [S.lists(x.astype(np.int32), row, j - i, pa.int32()) for x in (start - first[row], n, at - base[row])]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in (0, 2)), pa.array(np.diff(first)), *ints, words],
                    ["__id", "__k", "n_words", "starts", "lengths", "places", "words"],
                )

    return run


def _counts(held):
    """(term, freq) of each slice of (id, text): how often its benchmark words occur."""
    mask = np.uint64(S.BITMAP_BITS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            for _, _, names, _ in word_names(batch.column(1)):
                terms, n = np.unique(names[S.in_bitmap(bits, (names & mask).astype(np.int64))], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "freq"])

    return run


def _places(held):
    """(id, k, pos, term) of the words of (id, text, k) that the bitmap has."""
    mask = np.uint64(S.BITMAP_BITS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            for i, j, names, first in word_names(batch.column(1)):
                at = np.flatnonzero(S.in_bitmap(bits, (names & mask).astype(np.int64)))
                row = np.searchsorted(first, at, "right") - 1
                ids = [batch.column(c).slice(i, j - i).take(pa.array(row)) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array((at - first[row]).astype(np.int64)), pa.array(names[at].view(np.int64))], ["__id", "__k", "pos", "term"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches (id, k, key, start, end) of the alignments (id, k, key, run_start, shift, window, run, item)."""
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(3, 6)]
        rows, starts, ends = [], [], []
        for k, (run_start, shift, window) in enumerate(zip(*cols, strict=True)):
            run, item = (batch.column(c)[k].values.to_numpy() for c in (6, 7))
            d = shift - run_start  # the item's first word lies at run[d]
            lo, hi = max(0, d), min(len(run), len(item) + d)
            same = run[lo:hi] == item[lo - d : hi - d]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
            for s, e in zip(edge[0::2], edge[1::2], strict=True):
                if e - s >= window:
                    rows.append(k)
                    starts.append(run_start + lo + int(s))
                    ends.append(run_start + lo + int(e))
        if rows:
            part = batch.select([0, 1, 2]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["__id", "__k", "key", "start", "end"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, k): a document is an id with its text (named k), so texts that share or lack an id stay apart."""
    text = docs[text_col].cast("string")
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)).alias("__id"), text.alias("__text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__k"))


class Index:
    """Positional index of the documents for the words of a benchmark."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int | None = None):
        """``least``: shortest stretch of benchmark words that is stored; by default the shortest window."""
        self.space = S.Workspace(docs.sparkSession, "decontamination")
        items = benchmark.select(benchmark[item_col].cast("string").alias("item_id"), benchmark[item_text_col].cast("string").alias("text"))
        items = items.mapInArrow(_words, "item_id string, words array<long>").filter("size(words) > 0")
        items = self.space.save(items.withColumn("key", F.xxhash64("words")), "items")
        self.named = items.select("item_id", "key").distinct()
        #: one row for each different item text: equal items are looked up once
        self.items = items.groupBy("key").agg(F.first("words").alias("words")).withColumn("window", F.least(F.size("words"), F.lit(window)))
        self.kind = "long"
        shortest = self.items.agg(F.min("window")).first()[0] or window
        self.least = least or shortest
        terms = items.select(F.explode("words").alias("term"))
        bits = docs.sparkSession.sparkContext.broadcast(S.bitmap(terms, F.pmod("term", F.lit(S.BITMAP_BITS)).cast("int")))
        rows = _rows(docs, id_col, text_col)
        fields = f"__id {self.kind}, __k long, n_words long, starts array<int>, lengths array<int>, places array<int>, words array<long>"
        self.stored = self.space.save(rows.mapInArrow(_postings(bits, self.least), fields), "postings")
        runs = self.stored.filter("size(starts) > 0").select("__id", "__k", "words", F.explode(F.arrays_zip("starts", "lengths", "places")).alias("r"))
        self.runs = runs.select("__id", "__k", F.col("r.starts").alias("run_start"), F.expr("slice(words, r.places + 1, r.lengths)").alias("run"))
        #: (id, k, run_start, pos, term) of every stored word
        self.postings = self.runs.select("__id", "__k", "run_start", F.posexplode("run").alias("i", "term")).select("__id", "__k", "run_start", (F.col("run_start") + F.col("i")).alias("pos"), "term")
        self.words = self.items.select("key", "window", F.size("words").alias("size"), F.posexplode("words").alias("place", "term"))
        counts = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
        counts = counts.join(self.words.select("term").distinct(), "term", "left_semi")
        self.words = self.space.save(self.words.join(counts, "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0))), "words")

    def phrases(self) -> DataFrame:
        """(id, k, key, start, end): every maximal stretch of words of a document that are the item's words in order and hold a window of it."""
        order = Window.partitionBy("key").orderBy("place")
        each = F.struct("freq", "place", "term")
        full = Window.partitionBy("key")
        n = F.col("window")
        # the rarest word of each window: ten words from here on, or all words of a shorter item
        widest = self.words.agg(F.max("window")).first()[0] or 1
        pick = F.when(F.col("size") > n, F.min(each).over(order.rowsBetween(0, widest - 1))).otherwise(F.min(each).over(full))
        anchors = self.words.withColumn("pick", pick).filter("place <= size - window").select("key", "pick.*").filter("freq > 0").distinct()
        at = self.postings.join(anchors.select("key", F.col("place"), "term"), "term")
        lined = at.select("__id", "__k", "run_start", "key", (F.col("pos") - F.col("place")).alias("shift")).distinct()
        both = lined.join(self.items, "key").join(self.runs, ["__id", "__k", "run_start"])
        found = both.select("__id", "__k", "key", F.col("run_start").cast("long").alias("run_start"), F.col("shift").cast("long").alias("shift"), "window", "run", F.col("words").alias("item"))
        return found.mapInArrow(_compare, f"__id {self.kind}, __k long, key long, start long, end long")

    def near(self, terms: int = 3, within: int = 20) -> DataFrame:
        """(id, item_id): documents that have the item's ``terms`` rarest words (all, if it has fewer) within ``within`` words, in any order.

        Words outside the stored stretches would not be seen, so the index must be built with ``least=1``. A word that
        no document has counts as rarest: such an item matches nothing. ``proximity`` ranks only words that occur.
        """
        if self.least > 1:
            raise ValueError("proximity needs an index with least=1")
        distinct = self.words.groupBy("key", "term").agg(F.min("freq").alias("freq"))
        rank = F.row_number().over(Window.partitionBy("key").orderBy("freq", "term"))
        rare = distinct.withColumn("rank", rank).filter(F.col("rank") <= terms).withColumn("wanted", F.count(F.lit(1)).over(Window.partitionBy("key")))
        at = self.postings.join(rare.select("key", "term", "wanted"), "term")
        frame = Window.partitionBy("__id", "__k", "key").orderBy(F.col("pos").cast("long")).rangeBetween(0, within - 1)
        close = at.withColumn("met", F.size(F.collect_set("term").over(frame))).filter("met >= wanted")
        return close.select("__id", "key").distinct().join(self.named, "key").select(F.nullif("__id", F.lit(_NO_ID)).alias("doc_id"), "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keyed: bool = False) -> DataFrame:
    """One row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words; an item without words matches nothing; items with
    null ids are found but not listed. Texts that share an id, or have none, are
    documents of their own; rows equal in id and text are judged alike. Ids are
    whole numbers or null. An empty benchmark hits nothing. ``keyed`` adds
    ``__k``, the name of the text.
    """
    index = Index(docs, benchmark, window, id_col, text_col, item_col, item_text_col)
    hits = index.space.save(index.phrases(), "hits")
    doc = ["__id", "__k"]
    order = Window.partitionBy(*doc).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = hits.select(*doc, "start", "end").withColumn("seen", F.greatest(F.coalesce(F.max("end").over(order), F.lit(0)), "start"))
    n_hit = new.groupBy(*doc).agg(F.sum(F.greatest(F.col("end") - F.col("seen"), F.lit(0))).alias("n_hit"))
    items = hits.select(*doc, "key").distinct().join(index.named, "key").groupBy(*doc).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = n_hit.join(items, doc, "left")
    out = index.stored.select(*doc, "n_words").join(found, doc, "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        *(["__k"] if keyed else []),
        F.nullif("__id", F.lit(_NO_ID)).alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op5(spark, sf_dir: str) -> DataFrame:
    """All texts of ``documents`` against all of ``benchmark``."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def proximity(docs: DataFrame, benchmark: DataFrame, terms: int = 3, within: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_near (items near), items_sha256 (of their sorted ids).

    An item is near if its ``terms`` rarest words among those that occur in any
    document (all words of an item with fewer) lie within ``within`` words of the
    document, in any order and with any words between them. An item of which
    fewer words than that occur is near nowhere. Ids and nulls as in ``contamination``.

    Two passes over the texts: the first counts the benchmark's words, the second
    keeps the places of each item's rarest words alone.
    """
    space = S.Workspace(docs.sparkSession, "proximity")
    spread = docs.sparkSession.sparkContext.broadcast
    items = benchmark.select(benchmark[item_col].cast("string").alias("item_id"), benchmark[item_text_col].cast("string").alias("text"))
    items = items.mapInArrow(_words, "item_id string, words array<long>").filter("size(words) > 0")
    items = space.save(items.withColumn("words", F.array_sort(F.array_distinct("words"))).withColumn("key", F.xxhash64("words")), "items")
    named = items.select("item_id", "key").distinct()
    words = items.groupBy("key").agg(F.first("words").alias("words")).select("key", F.least(F.size("words"), F.lit(terms)).alias("wanted"), F.explode("words").alias("term"))
    bitmap = lambda t: spread(S.bitmap(t, F.pmod("term", F.lit(S.BITMAP_BITS)).cast("int")))
    rows, doc = _rows(docs, id_col, text_col), ["__id", "__k"]
    counts = rows.mapInArrow(_counts(bitmap(words.select("term"))), "term long, freq long").groupBy("term").agg(F.sum("freq").alias("freq"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("freq", "term"))
    rare = words.join(counts, "term").withColumn("rank", rank).filter("rank <= wanted")
    rare = rare.withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("found = wanted").select("key", "wanted", "term")
    rare = space.save(rare, "rare")
    at = rows.mapInArrow(_places(bitmap(rare.select("term"))), "__id long, __k long, pos long, term long").join(rare, "term")
    frame = Window.partitionBy(*doc, "key").orderBy("pos").rangeBetween(0, within - 1)
    close = at.withColumn("met", F.size(F.collect_set("term").over(frame))).filter("met >= wanted").select(*doc, "key").distinct()
    near = close.join(named, "key").groupBy(*doc).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    out = rows.select(*doc).join(near, doc, "left")
    return out.select(F.nullif("__id", F.lit(_NO_ID)).alias(id_col), F.size(listed).cast("long").alias("n_near"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"))


def op5_near(spark, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` near a place of each text of ``documents``, which ``op5`` does not look for."""
    return proximity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (all columns) without those that hold a window of a benchmark item."""
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col, keyed=True).filter("contaminated").select(F.col(id_col).alias("__bad"), F.col("__k").alias("__bad_k")).distinct()
    own = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(F.col("__bad")) & (own == F.col("__bad_k")), "left_anti")
