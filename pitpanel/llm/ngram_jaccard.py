"""N-gram Jaccard join (operator 8).

The document by shingle incidence is multiplied with its transpose block by
block, only where a pair can still reach the threshold; Spark sums a pair's
overlap counts over the blocks:

1. Documents with equal shingle sets are one class (named by the set).
2. A class puts only a prefix of its shingles into the product: the
   ``n - ceil(t*n) + 1`` least frequent ones. Two sets of Jaccard t or more share
   a shingle of their prefixes, whatever the common order is; the order here is
   by a count sketch of all documents, so frequent shingles come last.
3. Columns that the same classes have are one block, with the number of its columns
   as weight. First every class is multiplied with a few of the classes that lead
   its blocks (each block's smallest), and pairs that reach the threshold are
   merged into components.
4. Blocks whose classes are then all in one component are done. In crowded ones each
   class tries leaders of other components for a few rounds, those with the fewest
   shingles rarer than the block's, so that a group of near copies grows together
   around its middle before its pairs are made. What is open
   then is multiplied in full: pairs of different components, within bands of sizes
   that can match; pairs below the bounds that follow from their sizes and from the
   place of the first shared shingle in either order are never made. The places take part in the join: a class asks only for sizes that its place in the
   block leaves, and answers only if its place leaves its own.

For the pairs of either step the weights of their common blocks are summed: this is
their overlap within both prefixes. Pairs for which that and the rest of the shorter
prefix cannot reach the threshold are discarded. Of the others the rows of the whole
incidence matrix, cut into blocks of about ``COLUMNS`` columns, are multiplied block
by block, and the sums decide; so a set of any size meets another in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

#: White space that ends a word (fixed value).
SPACES = " \t\n\x0b\x0c\r"
_WORD = S.word_table(SPACES)
SKETCH = 1 << 20  # counters of the count sketch: its size does not grow with the data
HUBS = 3  # leaders that a class tries first
ROUNDS = 2  # rounds with new leaders, at most
DRAWN = 8  # leaders that a class tries in a round
CROWD = 64  # classes of a block that takes part in rounds; smaller ones make few pairs
_NO_ID = -(1 << 63)  # stands for a null id within the joins
COLUMNS = 4096  # a set's columns in one block of the whole matrix, about
_WEIGHT = 1 << 20  # the low bits of a block's name hold its weight; one less than this stands for any larger one
_PART = 1 << 16  # counters in one row of a sketch
_FACTORS = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(column: pa.Array, words: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingle names) of each row of a string column."""
    raw, offsets = S.utf8(column)
    factor = np.resize(_FACTORS, words) + np.arange(words, dtype=np.uint64) * np.uint64(2)
    for i, j in S.slices(offsets):
        part = S.LOWER[raw[offsets[i] : offsets[j]]]
        start, end, first = S.token_spans(part, _WORD, offsets[i : j + 1] - offsets[i])
        h = S.span_names(part, start, end)
        padded = np.concatenate([h, np.zeros(words, np.uint64)])
        names = np.zeros(len(h), np.uint64)
        for k in range(words):
            names += padded[k : k + len(h)] * factor[k]
        names = S.mix(names)
        for row in range(i, j):
            a, b = first[row - i], first[row - i + 1]
            if b - a >= words:
                yield row, np.unique(names[a : b - words + 1])
            elif b > a:
                yield row, S.mix((h[a:b] * factor[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield row, names[:0]


def _name(names: np.ndarray) -> int:
    """Name of a set of shingles, as a signed integer."""
    if not len(names):
        return 0
    powers = S.powers(len(names))[0]
    return int(S.mix((names * powers).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(names))).view(np.int64)[0])


def _profile(words: int):
    """Rows (id, k, n, name) of documents (id, k, text), then the rows (part, counts) of this task's count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, kinds = np.zeros(SKETCH, np.uint32), [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        names = ["__id", "__k", "n", "name", "part", "counts"]
        for batch in batches:
            n, name, seen = [], [], []
            for _, s in shingle_sets(batch.column(2), words):
                n.append(len(s))
                name.append(_name(s))
                seen.append(s)
                if len(seen) >= 256:
                    sketch += np.bincount((np.concatenate(seen) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
                    seen = []
            if seen:
                sketch += np.bincount((np.concatenate(seen) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            none = [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip((n, name, none, none), kinds, strict=True))], names)
        for p in range(SKETCH // _PART):
            part = sketch[p * _PART : (p + 1) * _PART]
            if part.any():
                row = ([None], [None], [p], [part.tobytes()])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(pa.array(x, k) for x, k in zip(row, kinds, strict=True))], names)

    return run


def _sum_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums.setdefault(part, np.zeros(_PART, np.uint64))[:] += np.frombuffer(counts.as_buffer(), np.uint32)
    for part, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], ["part", "counts"])


def _prefixes(words: int, percent: int, held, only=None):
    """Rows (shingle, name, n, place): the rarest shingles of each set, those that the bitmap ``only`` has; one set of a name for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, done, names = held.value, set(), ["h", "name", "n", "place"]
        bits, mask = only and only.value, np.uint64(S.BITMAP_BITS - 1)
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            held_now = 0
            for _, s in shingle_sets(batch.column(0), words):
                n, name = len(s), _name(s)
                if not n or name in done:
                    continue
                done.add(name)
                p = n - -(-percent * n // 100) + 1
                order = np.lexsort((s, sketch[(s & np.uint64(SKETCH - 1)).astype(np.int64)]))[:p]
                h, place = s[order], np.arange(p, dtype=np.int32)
                if bits is not None:
                    met = S.in_bitmap(bits, (h & mask).astype(np.int64))
                    h, place = h[met], place[met]
                for k, x in enumerate((h.view(np.int64), np.full(len(h), name, np.int64), np.full(len(h), n, np.int32), place)):
                    out[k].append(x)
                held_now += len(h)
                if held_now > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)
                    out, held_now = [[], [], [], []], 0
            if held_now:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)

    return run


def _levels(n: int, percent: int) -> range:
    """Cuts of a set of ``n`` into 2**level blocks: its own, and those of the larger sets that it may meet."""
    level = lambda size: max(0, (-(-size // COLUMNS) - 1).bit_length())
    return range(level(n), level(100 * n // percent) + 1)


def _incidence(words: int, percent: int, held):
    """Rows (id, k, level, cb, shingles): the blocks of columns of the documents (slot, id, k, text) that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            part = batch.filter(pa.array(S.in_bitmap(bits, batch.column(0).to_numpy())))
            if not part.num_rows:
                continue
            rows, levels, blocks, sizes, values = [], [], [], [], []
            for row, s in shingle_sets(part.column(3), words):
                for level in _levels(len(s), percent):
                    block = (s & np.uint64((1 << level) - 1)).astype(np.int64)
                    found, n = np.unique(block, return_counts=True)
                    rows.append(np.full(len(found), row))
                    levels.append(np.full(len(found), level, np.int32))
                    blocks.append(found)
                    sizes.append(n)
                    values.append(s[np.argsort(block, kind="stable")].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            ids = [part.column(c).take(pa.array(np.concatenate(rows))) for c in (1, 2)]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))
            cols = [*ids, pa.array(np.concatenate(levels)), pa.array(np.concatenate(blocks)), lists]
            yield pa.RecordBatch.from_arrays(cols, ["__id", "__k", "level", "cb", "shingles"])

    return run


def _document(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k, text): a document is an id with its text (named k)."""
    text = docs[text_col].cast("string")
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)).alias("__id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__k"), text.alias("__text"))


def open_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of names of different labels that a block (block, name, n, place, label) lets reach the threshold.

    A pair is looked for at the first shingle that both have: all that they share
    lies from there on, so at its place a class of size n can only meet sizes up to
    ``most``. Of a pair the larger class asks for the sizes that the threshold and its
    place leave (by bands of sizes), the smaller one answers if its place lets it
    meet its own size at least. Pages of one template that their own part keeps below
    the threshold ask for smaller sizes than any of them has, or don't answer: none
    of their pairs is made.
    """
    band = lambda n: F.floor(F.log(n) * (0.999 / np.log(100 / percent))) if percent < 100 else n.cast("long")
    size, most = F.col("n").cast("long"), F.expr(f"({100 + percent}L * (n - place) - {percent}L * n) div {percent}L")
    held = blocks.withColumn("most", most)
    low, high = F.ceil(size * percent / 100), F.least(size, "most")
    x = held.filter(high >= low).withColumn("band", F.explode(F.sequence(band(low), band(high)))).alias("x")
    y = held.filter(F.col("most") >= size).withColumn("band", band(size)).alias("y")
    pairs = x.join(y, F.expr(f"x.block = y.block and x.band = y.band and x.label <> y.label and y.n <= x.n and y.n <= x.most and x.n <= y.most and 100 * y.n >= {percent} * x.n"))
    return pairs.select(F.least("x.name", "y.name").alias("a"), F.greatest("x.name", "y.name").alias("b")).distinct()


def groups(docs: DataFrame, percent: int = 75, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __k, n, component, first): per document (id and name of its text) the size of its set, the smallest id of its component, and whether it is the first there."""
    spark = docs.sparkSession
    context = spark.sparkContext
    space = S.Workspace(spark, "ngram-jaccard")
    rows = _document(docs, id_col, text_col)
    seen = space.save(rows.mapInArrow(_profile(words), "__id long, __k long, n int, name long, part int, counts binary"), "profile")
    profile = seen.filter("part is null").select("__id", "__k", "n", "name")
    # sketches are added in two rounds: many tasks add some of a part's, then one those sums
    some = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * _PART // SKETCH)
    parts = seen.filter("part is not null").select("part", "counts", (F.spark_partition_id() % some).alias("g"))
    parts = parts.repartition("part", "g").select("part", "counts").mapInArrow(_sum_sketches, "part int, counts binary")
    parts = parts.repartition("part").mapInArrow(_sum_sketches, "part int, counts binary")
    sketch = np.zeros(SKETCH, np.uint32)
    for r in parts.collect():  # SKETCH / _PART rows of 256 KiB, whatever the input
        sketch[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["counts"], np.uint32)
    held = context.broadcast(sketch)

    # steps 1 and 2: columns that more than one class has; tasks combine what they see of a column before it is dealt out
    order = F.struct((F.col("__id") == _NO_ID).alias("none"), "__id", "__k")
    classes = profile.filter("n > 0").groupBy("name").agg(F.min(order).alias("first"), F.max("n").alias("n"))
    classes = space.save(classes.select("name", "n", "first"), "classes")
    entry = "h long, name long, n int, place int"
    columns = rows.select("__text").mapInArrow(_prefixes(words, percent, held), entry).groupBy("h")
    columns = columns.agg(F.min("name").alias("hub"), F.max("name").alias("last"), F.bit_xor(F.xxhash64("name")).alias("x")).filter("hub <> last")
    # the block of a column is named by its classes; a class that several tasks saw may keep blocks apart, and never hides one
    columns = space.save(columns.select("h", "hub", F.xxhash64("hub", "last", "x").alias("x")), "columns")
    weight = F.least(F.count(F.lit(1)), F.lit(_WEIGHT - 1))
    weights = space.save(columns.groupBy("x").agg((F.col("x") - F.pmod("x", F.lit(_WEIGHT)) + weight).alias("block")), "weights")
    columns = space.save(columns.join(weights.hint("merge"), "x").drop("x"), "named-columns")
    bits = context.broadcast(S.bitmap(columns, F.pmod("h", F.lit(S.BITMAP_BITS)).cast("int")))
    entries = rows.select("__text").mapInArrow(_prefixes(words, percent, held, bits), entry).join(columns.hint("merge"), "h")
    blocks = entries.groupBy("block", "name").agg(F.min("hub").alias("hub"), F.max("n").alias("n"), F.min("place").alias("place"))
    blocks = space.save(blocks, "blocks")
    parts = space.save(blocks.groupBy("name").agg(F.collect_list("block").alias("part")), "parts")
    of_block = lambda block: F.pmod(block, F.lit(_WEIGHT))

    def incidence(names: DataFrame, step: str) -> DataFrame:
        """(name, level, cb, shingles): the rows of the whole matrix of the classes ``names``, each from one of its documents."""
        wanted = space.save(classes.join(names.hint("merge"), "name", "left_semi").select("name", "first.__id", "first.__k"), f"wanted-{step}")
        bits = context.broadcast(S.bitmap(wanted, S.slots("__k")))
        whole = rows.select(S.slots("__k").alias("slot"), "__id", "__k", "__text").mapInArrow(_incidence(words, percent, bits), "__id long, __k long, level int, cb long, shingles array<long>")
        whole = whole.join(wanted.hint("merge"), ["__id", "__k"]).dropDuplicates(["name", "level", "cb"]).select("name", "level", "cb", "shingles")
        return space.save(whole, f"whole-{step}")

    def linked(pairs: DataFrame, step: str, whole: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) that reach the threshold: first by the product of prefixes, then by that of the whole rows."""
        held = parts.join(classes.select("name", "n").hint("merge"), "name")
        for k in "ab":
            pairs = pairs.join(held.select(F.col("name").alias(k), F.col("n").alias("n" + k), F.col("part").alias("p" + k)).hint("merge"), k)
        pairs = pairs.filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        each = F.transform(F.array_intersect("pa", "pb"), lambda x: F.when(of_block(x) < _WEIGHT - 1, of_block(x)).otherwise(1 << 40))
        shared = pairs.withColumn("c", F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x))
        # shared shingles lie in both prefixes, or behind the end of the prefix that ends first
        behind = f"greatest(-floor(-{percent} * na / 100) - 1, -floor(-{percent} * nb / 100) - 1)"
        able = space.save(shared.filter(f"{100 + percent} * (c + {behind}) >= {percent} * (na + nb)").select("a", "b", "na", "nb"), f"able-{step}")
        if whole is None:
            whole = incidence(able.select(F.explode(F.array("a", "b")).alias("name")).distinct(), step)
        left, right = (whole.select(F.col("name").alias(k), "level", "cb", F.col("shingles").alias("s" + k)).hint("merge") for k in "ab")
        level = F.expr(f"if(greatest(na, nb) <= {COLUMNS}, 0, length(bin(int(ceil(greatest(na, nb) / {COLUMNS})) - 1)))").cast("int")
        product = able.withColumn("level", level).withColumn("cb", F.explode(F.expr("sequence(0L, shiftleft(1L, level) - 1)")))
        product = product.join(right, ["b", "level", "cb"]).join(left, ["a", "level", "cb"])
        counts = product.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("c")).groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
        links = space.save(counts.filter(f"100 * c >= {percent} * (na + nb - c)").select("a", "b"), f"links-{step}")
        space.drop(f"able-{step}", f"wanted-{step}", f"whole-{step}")
        return links

    def leaders(led: DataFrame, step: str, most: int) -> DataFrame:
        """(a, b) of rows (name, hub, c): the leaders with which a class shares most."""
        rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("c"), "hub"))
        return space.save(led.withColumn("rank", rank).filter(F.col("rank") <= most).select(F.least("hub", "name").alias("a"), F.greatest("hub", "name").alias("b")).distinct(), step)

    def still_open(some: DataFrame, label: DataFrame, step: str) -> DataFrame:
        """(block, name, n, place, label) of those of ``some`` blocks that have classes of more than one component."""
        marked = some.join(label.hint("merge"), some["name"] == label["node"], "left").select("block", "name", "n", "place", F.coalesce("label", "name").alias("label"))
        marked = space.save(marked, f"marked-{step}")
        apart = marked.groupBy("block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("block")
        out = space.save(marked.join(space.save(apart, f"apart-{step}").hint("merge"), "block"), f"open-{step}")
        space.drop(f"marked-{step}", f"apart-{step}")
        return out

    weight = F.sum(of_block(F.col("block"))).alias("c")
    # step 3
    tried = leaders(blocks.filter("name <> hub").groupBy("name", "hub").agg(weight), "star", HUBS)
    links = linked(tried, "star")
    label = S.components(links, space, "labels-0")

    # step 4: rounds with leaders of other components, then the rest in full
    crowds = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= CROWD).select("block")
    crowded = space.save(blocks.join(crowds.hint("merge"), "block"), "crowded")
    apart = still_open(crowded, label, "0")
    whole = None
    for step in range(1, ROUNDS + 1):
        if apart.isEmpty():
            break
        whole = whole or incidence(apart.select("name").distinct(), "crowd")
        # a class with few shingles rarer than the block's has few of its own: it is near the middle of the crowd and most others link with it;
        # blocks of a crowd have much the same classes: they draw among equals by DRAWN different orders, the second round among eight places
        place = F.shiftright("place", 3 * (step - 1))
        tie = F.xxhash64("name", F.lit(step), F.pmod(F.xxhash64("block"), F.lit(DRAWN)))
        drawn = F.struct(place.alias("place"), tie.alias("tie"), F.col("name").alias("hub"), F.col("label").alias("__l"))
        lead = space.save(apart.groupBy("block").agg(F.min(drawn).alias("l")).select("block", "l.hub", "l.__l"), f"lead-{step}")
        led = apart.join(lead.hint("merge"), "block").filter("label <> __l").groupBy("name", "hub").agg(weight)
        new = leaders(led, f"try-{step}", DRAWN)
        found = linked(new.join(tried, ["a", "b"], "left_anti"), f"round-{step}", whole)
        tried, links = tried.unionByName(new), links.unionByName(found)
        label = S.components(links, space, f"labels-{step}")
        apart = still_open(crowded, label, str(step))
        space.drop(f"lead-{step}", f"open-{step - 1}")
    open_blocks = still_open(blocks, label, "rest")
    pairs = open_pairs(space.save(open_blocks, "open-blocks"), percent)
    more = linked(pairs.join(tried, ["a", "b"], "left_anti"), "rest")
    label = S.components(links.unionByName(more), space, "labels-rest")

    # back to documents
    named = classes.join(label.hint("merge"), classes["name"] == label["node"], "left").select("name", "first", F.coalesce("label", "name").alias("label"))
    named = space.save(named, "named")
    smallest = named.groupBy("label").agg(F.min("first").alias("f"))
    found = named.join(smallest.hint("merge"), "label").select(F.col("name").alias("c"), "f")
    out = profile.join(found.hint("merge"), (profile["name"] == F.col("c")) & (profile["n"] > 0), "left")
    own = F.col("n") == 0
    return out.select(
        "__id",
        "__k",
        F.col("n").cast("long").alias("n"),
        F.when(own, F.col("__id")).otherwise(F.col("f.__id")).alias("component"),
        (own | ((F.col("f.__id") == F.col("__id")) & (F.col("f.__k") == F.col("__k")))).alias("first"),
    )


def join(docs: DataFrame, percent: int = 75, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): documents linked by shingle sets of Jaccard ``percent`` / 100 or more.

    component_id is the smallest id that links lead to, its own included. Null
    text or text without words has no shingles and no links; fewer than ``words``
    words are one shingle. Rows that repeat are linked with each other; a null id
    is kept and never the smallest unless all are null. Other columns are not
    looked at. Ids are whole numbers.
    """
    found = groups(docs, percent, words, id_col, text_col)
    none = F.lit(_NO_ID)
    return found.select(F.nullif("__id", none).alias(id_col), F.col("n").alias("n_shingles"), F.nullif("component", none).alias("component_id"))


def op8(spark, sf_dir: str) -> DataFrame:
    """All texts of ``documents``."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (all columns) with one document of each group of linked ones: the one with the smallest id.

    Of texts that share an id the order depends on the texts alone; a null id
    comes last. Rows equal in id and text are one document, and one of them stays.
    """
    found = groups(docs, id_col=id_col, text_col=text_col).filter("not first").select(F.col("__id").alias("__gone"), F.col("__k").alias("__gone_k")).distinct()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own = docs.withColumns({"__id": F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)), "__k": F.xxhash64(text)})
    # tasks drop the equal rows that they see before rows are dealt out, once for both steps
    one = own.dropDuplicates(["__id", "__k"])
    return one.join(found.hint("merge"), (one["__id"] == F.col("__gone")) & (one["__k"] == F.col("__gone_k")), "left_anti").select(*docs.columns)
