"""Ranked lexical search by pipelined term partitioning (operator 12).

1. One pass over the documents stores, by blocks of ``BLOCK`` documents, a posting
   list for each word of the items: places of documents in the block, occurrences.
   A fixed-size bitmap of the items' words is broadcast; what passes it by chance
   goes when the lists are joined with the words.
2. Every word has an owner: the first one owns the rarest words, the last one the
   most frequent ones (``BANDS``: shares of the documents). An owner's lists lie
   together, cut into blocks, so a word that every document has is many groups.
3. An item travels as one bundle for each block: the words that it still looks
   for, with their weights, and a sparse accumulator, documents with their score
   so far. At each owner bundles and lists of a block meet by cogroup; whole-number
   contributions are added, and the bundle goes on to the next owner.
4. Between two owners the k-th best score so far is taken for each item over all
   blocks. It is a lower bound of the final one, so documents that cannot reach it
   by all words still to come leave the bundle, and new ones enter only while they
   could: what is dropped cannot be among the k. Equal scores stay.
5. The last owner's bundles give their k best of each block, from which the k best
   of all are chosen.

Scores and orders are whole numbers, so results do not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared as S
from .decontamination import word_names

#: Documents of a block, and postings after which it ends early: what a group holds, whatever the table's size.
BLOCK, POSTINGS = 2048, 1 << 20
#: Upper bounds of the share of documents that have an owner's words; the last owner has the rest.
BANDS = (0.001, 0.01, 0.1)
#: Items that meet the lists of a block in one group.
ITEMS = 256
#: Rows of a side below which it is broadcast (a few tens of bytes each).
SMALL = 200_000

_INDEX = "block long, term long, n_docs int, most long, total long, least long, docs binary, counts binary, ids array<long>"
_NAMES = [f.strip().split()[0] for f in _INDEX.split(",")]


class _Block:
    """Postings of up to ``BLOCK`` documents, collected by a task."""

    def __init__(self, task: int):
        self.task, self.number = task, 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.sizes, self.parts, self.held, self.docs = [], [], [], 0, 0

    def add(self, ids: pa.Array, sizes: np.ndarray, row: np.ndarray, term: np.ndarray) -> None:
        key = np.lexsort((row, term))
        row, term = row[key], term[key]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])) if len(row) else row
        self.parts.append((term[new], row[new] + self.docs, np.diff(np.concatenate([new, [len(row)]]))))
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.docs += len(sizes)
        self.held += len(new)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row for each word, and one without word for the documents themselves."""
        if not self.docs:
            return
        name, sizes = (self.task << 32) + self.number, np.concatenate(self.sizes).astype("<i8")
        ids = pa.concat_arrays(self.ids)
        term, row, count = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        key = np.lexsort((row, term))
        term, row, count = term[key], row[key].astype("<u2"), count[key].astype("<i8")
        cut = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        end = np.concatenate([cut[1:], [len(term)]]).astype(np.int64)[: len(cut)]
        most = np.maximum.reduceat(count, cut) if len(cut) else count
        one = len(cut)
        some = sizes[sizes > 0]
        out = [
            pa.array([name] * (one + 1), pa.int64()),
            pa.concat_arrays([pa.array(term[cut].view(np.int64)), pa.nulls(1, pa.int64())]),
            pa.array([*(end - cut), len(some)], pa.int32()),
            pa.array([*most, 0], pa.int64()),
            pa.array([*[0] * one, int(sizes.sum())], pa.int64()),
            pa.array([*[None] * one, int(some.min()) if len(some) else None], pa.int64()),
            pa.array([*(row[a:b].tobytes() for a, b in zip(cut, end, strict=True)), b""], pa.binary()),
            pa.array([*(count[a:b].tobytes() for a, b in zip(cut, end, strict=True)), sizes.tobytes()], pa.binary()),
            pa.concat_arrays([pa.nulls(one, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]),
        ]
        self.number += 1
        self.clear()
        batch = pa.RecordBatch.from_arrays(out, _NAMES)
        for i in range(0, batch.num_rows, 512):
            yield batch.slice(i, 512)


def _indexed(held, block: int):
    """Rows of the index from (id, text)."""
    mask = np.uint64(S.BITMAP_BITS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, now = held.value, _Block(TaskContext.get().partitionId())
        for batch in batches:
            for i, j, names, first in word_names(batch.column(1)):
                at = i
                while at < j:  # as many rows as the block has room for
                    to = min(j, at + block - now.docs)
                    a, b = first[at - i], first[to - i]
                    own = names[a:b]
                    pos = np.flatnonzero(S.in_bitmap(bits, (own & mask).astype(np.int64)))
                    starts = first[at - i : to - i + 1] - a
                    now.add(batch.column(0).slice(at, to - at), np.diff(starts), np.searchsorted(starts, pos, "right") - 1, own[pos])
                    at = to
                    if now.docs >= block or now.held >= POSTINGS:
                        yield from now.rows()
        yield from now.rows()

    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, terms): the different words of each (item, text)."""
    for batch in batches:
        for i, j, names, first in word_names(batch.column(1)):
            own = [np.unique(names[first[k] : first[k + 1]]).view(np.int64) for k in range(j - i)]
            lists = S.lists(np.concatenate(own), np.repeat(np.arange(j - i), [len(x) for x in own]), j - i, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["item", "terms"])


_BUNDLE = "item long, bucket int, block long, owners array<int>, terms array<long>, weights array<long>, bounds array<long>, docs binary, scores binary, best array<long>"
_BUNDLES = [f.strip().split()[0] for f in _BUNDLE.split(",")]


def _saturation(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


def _best(ids: pa.Array, docs: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, equal scores by ascending id, null first."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    own = ids.take(pa.array(docs[at]))
    known = np.asarray(own.is_valid())
    value = own.fill_null(0).to_numpy(zero_copy_only=False)
    return at[np.lexsort((value, known, -scores[at]))][:k]


def _owner_stage(owner: int, last: bool, k: int, n: int, total: int):
    """One owner's work on a block: bundles (with ``least``, the k-th best score so far) meet the lists."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in (["item", "doc_id", "score"] if last else _BUNDLES)]
        found, lists = None, {}
        for term, docs, counts, ids in zip(*(right.column(c).to_pylist() for c in ("term", "docs", "counts")), range(right.num_rows), strict=True):
            if term is None:
                sizes = np.frombuffer(counts, "<i8")
                own = right.column("ids").slice(ids, 1).combine_chunks()
                found = own.flatten() if isinstance(own, pa.ListArray) else own.chunk(0).flatten()
            else:
                lists[term] = (np.frombuffer(docs, "<u2"), np.frombuffer(counts, "<i8"))
        if found is not None:
            m = 50 + (50 * sizes * n) // max(total, 1)
            lists = {t: (d, _saturation(c, m[d])) for t, (d, c) in lists.items()}
            room = np.zeros(len(found), np.int64)
            for b in left.to_pylist():
                mine = [(t, w) for o, t, w in zip(b["owners"], b["terms"], b["weights"], strict=True) if o == owner]
                ahead = sum(u for o, u in zip(b["owners"], b["bounds"], strict=True) if o >= owner)
                after = sum(u for o, u in zip(b["owners"], b["bounds"], strict=True) if o > owner)
                least = b["least"] or 0
                room[:] = 0
                docs, scores = np.frombuffer(b["docs"], "<u2"), np.frombuffer(b["scores"], "<i8")
                kept = scores + ahead >= least
                docs, scores = docs[kept], scores[kept]
                room[docs] = scores
                for t, w in mine:
                    if t in lists:
                        at, c = lists[t]
                        room[at] += w * c
                if ahead < least:  # no document can still enter
                    scores = room[docs]
                else:
                    docs = np.flatnonzero(room).astype("<u2")
                    scores = room[docs]
                kept = scores + after >= max(least, 1)
                docs, scores = docs[kept], scores[kept]
                if last:
                    at = _best(found, docs, scores, k)
                    out[0] += [b["item"]] * len(at)
                    out[1] += found.take(pa.array(docs[at])).to_pylist()
                    out[2] += scores[at].tolist()
                elif len(docs) or after >= max(least, 1):
                    best = np.sort(scores)[::-1][:k]
                    row = {**b, "docs": docs.tobytes(), "scores": scores.astype("<i8").tobytes(), "best": best.tolist()}
                    for o, c in zip(out, _BUNDLES, strict=True):
                        o.append(row[c])
        kinds = [pa.int64()] * 3 if last else [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names=["item", "doc_id", "score"] if last else _BUNDLES)

    return run


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast where its counted rows are few; else Spark decides."""
    return F.broadcast(df) if rows <= SMALL else df


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", bands: Sequence[float] = BANDS, block: int = BLOCK
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score (long): the ``k`` best documents of each item by a whole-number BM25 (k1 2, b 0.5).

    A document is a row: rows that share an id, or lack one, are ranked each for
    itself, equal scores by ascending id, null first. Null and empty texts have no
    words and are never found. An item is an id with its text; equal rows are one
    item, two texts under one id are two. An item without words that occur has no
    rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    space = S.Workspace(spark, "search")
    asked = items.select(items[item_col].alias("item_id"), items[item_text_col].cast("string").alias("text")).distinct()
    asked = space.save(asked.withColumn("item", F.xxhash64(F.col("item_id").cast("string"), F.coalesce("text", F.lit("")))), "items")
    wanted = space.save(asked.select("item", "text").mapInArrow(_terms, "item long, terms array<long>").filter("size(terms) > 0"), "wanted")
    words = wanted.select("item", F.explode("terms").alias("term"))
    bits = spark.sparkContext.broadcast(S.bitmap(words, F.pmod("term", F.lit(S.BITMAP_BITS)).cast("int")))
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    index = space.save(rows.mapInArrow(_indexed(bits, block), _INDEX), "index")

    whole = index.filter("term is null").agg(F.sum("n_docs").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least")).first()
    n, total, shortest = whole["n"] or 0, whole["total"] or 0, whole["least"] or 0
    lightest = 50 + 50 * shortest * n // max(total, 1)
    freq = index.join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"), F.max("most").alias("most"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n + 2)) / (2 * F.col("df") + 1))).cast("long")
    owner = F.lit(len(bands)).cast("int")
    for i in range(len(bands) - 1, -1, -1):
        owner = F.when(F.col("df") <= F.lit(bands[i] * n), F.lit(i)).otherwise(owner)
    bound = F.col("weight") * F.expr(f"(1000000000L * most) div (1000L * most + {20 * lightest}L)")
    known = space.save(freq.withColumns({"weight": weight, "owner": owner}).withColumn("bound", bound).drop("most", "df"), "terms")

    # items and the words they look for, in groups of ITEMS
    size = wanted.count()
    buckets = -(-size // ITEMS) or 1
    bucketed = wanted.select("item", F.pmod(F.hash("item"), F.lit(buckets)).alias("bucket"), F.explode("terms").alias("term"))
    use = space.save(bucketed.join(known, "term"), "use")
    plans = use.groupBy("item", "bucket").agg(F.array_sort(F.collect_list(F.struct("owner", F.col("weight").alias("w"), "term", "bound"))).alias("p"))
    plans = plans.select("item", "bucket", F.col("p.owner").alias("owners"), F.col("p.term").alias("terms"), F.col("p.w").alias("weights"), F.col("p.bound").alias("bounds"))
    lists = use.groupBy("term", "owner").agg(F.collect_set("bucket").alias("buckets"))
    count = known.count()
    owned = index.filter("term is not null").join(_small(lists, count), "term").select("owner", F.explode("buckets").alias("bucket"), "block", "term", "docs", "counts")
    owned.write.partitionBy("owner").parquet(f"{space.path}/owned")
    kinds = "owner int, bucket int, block long, term long, docs binary, counts binary"
    owned = spark.read.schema(kinds).parquet(f"{space.path}/owned") if count else spark.createDataFrame([], kinds)
    heads = index.filter("term is null").select("block", "counts", "ids")

    blank = F.lit(b"")
    # the stated query set goes to every block of documents once, an item a bundle
    bundles = heads.select("block").crossJoin(_small(plans, size)).withColumns({"docs": blank, "scores": blank, "best": F.expr("cast(array() as array<long>)")}).select(*_BUNDLES)
    least, owners = None, len(bands) + 1
    for o in range(owners):
        last = o == owners - 1
        if least is None:
            left = bundles.withColumn("least", F.lit(0).cast("long"))
        else:
            left = bundles.drop("best").join(_small(least, size), "item", "left").withColumn("best", F.expr("cast(array() as array<long>)"))
        own = owned.filter(F.col("owner") == o).select("bucket", "block", "term", "docs", "counts", F.expr("cast(null as array<long>)").alias("ids"))
        doc_rows = heads.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "block", F.lit(None).cast("long").alias("term"), blank.alias("docs"), "counts", "ids")
        met = left.groupBy("bucket", "block").cogroup(own.unionByName(doc_rows).groupBy("bucket", "block"))
        done = met.applyInArrow(_owner_stage(o, last, k, n, total), "item long, doc_id long, score long" if last else _BUNDLE)
        if last:
            break
        bundles = space.save(done, f"bundles-{o}")
        ranked = bundles.select("item", F.explode("best").alias("score"))
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).filter(F.col("r") <= k)
        least = space.save(ranked.filter(F.col("r") == k).select("item", F.col("score").alias("least")), f"least-{o}")
        if o:
            space.drop(f"bundles-{o - 1}", f"least-{o - 1}")
    top = done.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).filter(F.col("rank") <= k)
    return top.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all ``documents`` for each ``benchmark`` item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
 p AS (SELECT doc_id, term, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM d) GROUP BY doc_id, term),
 q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
 t AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM s) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
 r AS (SELECT item_id, doc_id, CAST(sum(t.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size * n) // l)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN t USING (term), s GROUP BY item_id, doc_id),
 k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0)
 SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50"""
