"""Line dedup (operator 1): a deletion-neighbourhood join over the lines of all documents.

A line goes if an earlier line (by document id, then line number) equals it or
is within one edit (insertion, deletion or substitution of a character). Equal
lines are found by name and count. For the rest:

1. Two lines within one edit agree on a half: cut both at the middle of the
   longer one, and the half without the edit is equal, counted from its end. Each
   different line hands out the names of its halves (as the longer and as the
   shorter line); only lines that meet another one go on.
2. These emit the names of all their variants: themselves, and with each single
   character deleted. The names come from running sums, so a line of n
   characters costs n steps, not n squared.
3. Equal variants are joined. A line equal to a variant of another is one
   insertion away; two lines that give the same variant by deleting at the same
   place are one substitution away. The earliest of each such group stands for
   it, so groups are never expanded into pairs.
4. The edit distance of each pair found is verified on the lines themselves.

With two edits (a parameter) lines are cut into thirds, variants lack up to two
characters, and the groups are those of ``_earlier_of_two``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

_NO_ID = -(1 << 63)


def _values(codes: np.ndarray) -> np.ndarray:
    """A 64-bit value for each code point."""
    return S.mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


#: Code points that ``str.strip`` takes for white space.
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)])


def _places(edits: int) -> list[tuple[int, int, int]]:
    """(less, piece, shift): where a line that has ``less`` characters less than another may hold a piece of it.

    The longer line is cut into one piece more than there are edits, so one is
    whole in the shorter line; what was inserted before it shifts it, and the rest
    of the edits must make up the difference behind it.
    """
    found = []
    for less in range(edits + 1):
        for piece in range(edits + 1):
            shifts = [0] if piece == 0 else [-less] if piece == edits else [s for s in range(-edits, edits + 1) if abs(s) + abs(less + s) <= edits]
            found += [(less, piece, s) for s in shifts]
    return found


def _line_names(texts: list[str], least_chars: int, edits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of all lines of some texts: (row of the text, number in it), and name in two words and the names of its ``_places``.

    Lines of white space are left out. A piece that a line has no room for has no
    name (-1), nor have those of lines below ``least_chars``.
    """
    codes = _codes("\n".join(texts))
    breaks = np.flatnonzero(codes == 10)
    start, end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(codes)]])
    per = np.array([t.count("\n") + 1 for t in texts])
    row = np.repeat(np.arange(len(texts)), per)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    shown = np.concatenate([[0], np.cumsum(~_SPACE[np.minimum(codes, 0x3000)] | (codes > 0x3000))])
    keep = shown[end] > shown[start]
    start, end, row, number = start[keep], end[keep], row[keep], number[keep]
    values = _values(codes)
    sums = S.prefix_hash(values)
    shown = itertools.compress("\n".join(texts).split("\n"), keep)
    named = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in shown), "<i8").reshape(-1, 2)
    halves, n = [], end - start
    for less, piece, shift in _places(edits):
        longer = n + less
        x = start + longer * piece // (edits + 1) + shift
        y = start + longer * (piece + 1) // (edits + 1) + shift
        fits = (x >= start) & (y <= end) & (n >= least_chars)
        x, y = np.where(fits, x, start), np.where(fits, y, start)
        half = _signed(S.mix(S.span_hash(sums, x, y) ^ ((edits + 1) * longer + piece).astype(np.uint64)))
        halves.append(np.where(fits, half, -1))
    return np.stack([row, number]), [named[:, 0], named[:, 1], *halves]


def _halves(edits: int) -> list[str]:
    return [f"h{k}" for k in range(len(_places(edits)))]


def _lines(least_chars: int, edits: int):
    """One row for each line of (d, k, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = S.utf8(batch.column(2))
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in S.slices(off):
                (row, number), names = _line_names([t or "" for t in batch.column(2).slice(i, j - i).to_pylist()], least_chars, edits)
                cols = [ids[i:j][row], keys[i:j][row], number.astype(np.int32), *names]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["d", "k", "no", "a", "b", *_halves(edits)])

    return run


def _pick(held):
    """(d, no, line) of (slot, d, text, ...): lines of documents that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            part = batch.filter(pa.array(S.in_bitmap(bits, batch.column(0).to_numpy())))
            if part.num_rows:
                yield part

    return run


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, p, d, k, no) for each line (d, k, no, line): its name with p = -1, and its name without its p-th character."""
    names = ["h", "p", "d", "k", "no"]
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        held = 0
        for d, key, no, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes = _codes(line)
            n, values = len(codes), _values(codes)
            sums = S.prefix_hash(values)
            inverse = np.uint64(S._INVERSE)
            p = np.arange(n)
            less = sums[p] + (sums[n] - sums[p + 1]) * inverse
            whole = sums[n : n + 1]
            h = S.mix(np.concatenate([whole, less]) + np.concatenate([[n], np.full(len(p), n - 1)]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            place = np.concatenate([[-1], p]).astype(np.int32)
            for k, x in enumerate((_signed(h), place, np.full(len(h), d, np.int64), np.full(len(h), key, np.int64), np.full(len(h), no, np.int32))):
                out[k].append(x)
            held += len(h)
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)
                out, held = [[], [], [], [], []], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)


def _variants_of_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n, p, q, d, k, no) for each line (d, k, no, line): names without n = 0, 1 or 2 characters, and the gaps p <= q where they were.

    A gap is counted in what is left, so that two lines with a gap in common have a
    substitution there. A line of n characters has about n * n / 2 such names; they
    are handed on in parts.
    """
    names, inverse = ["h", "n", "p", "q", "d", "k", "no"], np.uint64(S._INVERSE)
    spread = np.uint64(0xD6E8FEB86659FD93)

    def part(held: list[tuple]) -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names)

    with np.errstate(over="ignore"):
        for batch in batches:
            held, size = [], 0
            for d, key, no, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = _codes(line)
                n = len(codes)
                sums = S.prefix_hash(_values(codes))

                def row(sum_, gone, p, q, n=n, d=d, key=key, no=no):
                    m = len(sum_)
                    h = _signed(S.mix(sum_ + np.full(m, n - gone, np.uint64) * spread))
                    full = lambda x, kind: np.full(m, x, kind)
                    return (h, full(gone, np.int32), p.astype(np.int32), q.astype(np.int32), full(d, np.int64), full(key, np.int64), full(no, np.int32))

                at, none = np.arange(n), np.array([-1])
                held += [row(sums[n : n + 1], 0, none, none), row(sums[at] + (sums[n] - sums[at + 1]) * inverse, 1, at, at)]
                size += n + 1
                for p in range(n - 1):
                    q = np.arange(p + 1, n)
                    two = sums[p] + (sums[q] - sums[p + 1]) * inverse + (sums[n] - sums[q + 1]) * inverse * inverse
                    held.append(row(two, 2, np.full(len(q), p), q - 1))
                    size += len(q)
                    if size > 100_000:
                        yield part(held)
                        held, size = [], 0
            if held:
                yield part(held)


def _earlier_of_two(variants: DataFrame) -> DataFrame:
    """(d, k, no, e): for each line, the earliest members of the groups of lines within two edits that it is in.

    Of lines with a name in common, all are within two edits of each other that are
    whole and lack two (two insertions), are whole and lack one, or lack one each (an insertion
    and a deletion); that lack one and two with a gap in common (a substitution and an
    insertion); or that lack two each at the same gaps (two substitutions).
    """
    at = F.struct("d", "k", "no")
    gaps = variants.withColumn("gap", F.explode(F.array_distinct(F.array("p", "q"))))
    lacks = lambda n: F.min(F.when(F.col("n") == n, at))
    by_h, by_gap, by_both = Window.partitionBy("h"), Window.partitionBy("h", "gap"), Window.partitionBy("h", "p", "q")
    seen = gaps.withColumns({f"all{n}": lacks(n).over(by_h) for n in range(3)} | {f"gap{n}": lacks(n).over(by_gap) for n in (1, 2)} | {"same": lacks(2).over(by_both)})
    near = {0: ("all1", "all2"), 1: ("all0", "all1", "gap2"), 2: ("all0", "gap1", "same")}
    found = F.array(*[F.when(F.col("n") == n, F.col(c)) for n, cs in near.items() for c in cs])
    return seen.select("d", "k", "no", F.explode(F.filter(found, lambda x: x < at)).alias("e"))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, text, gone) to (d, text without the lines numbered in gone, n_lines, n_removed)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch, texts, n, m = whole.slice(at, 256), [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                drop = set(gone or ())
                n.append(sum(1 for x in lines if x.strip()))
                m.append(len(drop))
                texts.append(text if not drop else "\n".join(x for k, x in enumerate(lines) if k not in drop))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], ["d", "text", "n_lines", "n_removed"]
            )


def repeated_lines(docs: DataFrame, space: S.Workspace, max_edits: int = 1, least_chars: int = 0) -> DataFrame:
    """(d, k, gone): for documents (d, k, text), in order of d and k, the numbers of the lines that go."""
    spark = docs.sparkSession
    line, halves = ["d", "k", "no"], _halves(max_edits)
    lines = docs.select("d", "k", "text").mapInArrow(_lines(least_chars, max_edits), "d long, k long, no int, a long, b long, " + ", ".join(f"{h} long" for h in halves))
    lines = space.save(lines, "lines")
    first = lines.groupBy("a", "b").agg(F.min(F.struct(*line)).alias("at"), F.count(F.lit(1)).alias("n"), *[F.max(h).alias(h) for h in halves])
    first = space.save(first.select("a", "b", "at.*", (F.col("n") > 1).alias("many"), *halves), "different")
    if max_edits:
        # step 1: lines that share a half with another
        each = first.select("a", *line, F.explode(F.array(*halves)).alias("half")).filter("half <> -1")
        met = each.groupBy("half").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).filter("lo <> hi").select("half")
        some = each.join(met.hint("merge"), "half", "left_semi").select(*line).distinct()
        at = F.struct(*line)
        wanted = space.save(some.groupBy("d", "k").agg(F.collect_list("no").alias("nos")), "wanted")
        bits = spark.sparkContext.broadcast(S.bitmap(wanted, S.slots("k")))
        texts = docs.select(S.slots("k").alias("slot"), "d", "k", "text").mapInArrow(_pick(bits), "slot int, d long, k long, text string")
        # rows that are equal in id and text are one document
        texts = texts.join(wanted.hint("merge"), ["d", "k"])
        cut = F.split("text", "\n", -1)
        some = texts.select("d", "k", "nos", cut.alias("ls")).select("d", "k", F.explode("nos").alias("no"), "ls")
        some = some.select(*line, F.expr("try_element_at(ls, no + 1)").alias("line")).filter("line is not null")
        some = space.save(some.dropDuplicates(line), "candidates")
        # steps 2 and 3; only different lines meet here, so a group is bounded by the neighbours that one string can have
        if max_edits == 1:
            variants = some.mapInArrow(_variants, "h long, p int, d long, k long, no int")
            whole, less = F.col("p") < 0, F.col("p") >= 0
            by_h, by_place = Window.partitionBy("h"), Window.partitionBy("h", "p")
            seen = variants.withColumns(
                {"whole": F.min(F.when(whole, at)).over(by_h), "less": F.min(F.when(less, at)).over(by_h), "same": F.min(at).over(by_place)}
            )
            earlier = F.filter(F.array(F.when(whole, F.col("less")), F.when(less, F.col("whole")), F.when(less, F.col("same"))), lambda x: x < at)
            found = seen.select(*line, F.explode(earlier).alias("e"))
        else:
            found = _earlier_of_two(some.mapInArrow(_variants_of_two, "h long, n int, p int, q int, d long, k long, no int"))
        pairs = found.select(*line, *[F.col("e")[c].alias("e" + c) for c in line]).distinct()
        # step 4
        other = some.select(*[F.col(c).alias("e" + c) for c in line], F.col("line").alias("earlier"))
        close = pairs.join(other.hint("merge"), ["e" + c for c in line]).join(some.hint("merge"), line).filter(F.levenshtein("line", "earlier", max_edits) >= 0)
        near = space.save(close.select(*line).distinct(), "near")
        marked = first.join(near.withColumn("all", F.lit(True)).hint("merge"), line, "left")
    else:
        marked = first.withColumn("all", F.lit(None).cast("boolean"))
    # lines that occur once and have no earlier neighbour stay: only the others are joined back
    marked = marked.filter("many or all").select("a", "b", F.coalesce("all", F.lit(False)).alias("all"), *[F.col(c).alias("f" + c) for c in line])
    marked = space.save(marked, "marked")  # so that the join below may split a line that many documents have
    gone = lines.select(*line, "a", "b").join(marked.hint("merge"), ["a", "b"]).filter("all or d <> fd or k <> fk or no <> fno")
    return gone.groupBy("d", "k").agg(F.collect_set("no").alias("gone"))


def dedup(docs: DataFrame, max_edits: int = 1, least_chars: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, ``text_col`` without repeated lines, and the columns n_lines and n_removed.

    Lines end at line feeds. Lines of white space stay and count neither as lines
    nor as repeats. A line goes if an earlier one equals it or is within ``max_edits``
    (0, 1 or 2), whatever its length; a caller who wants that for long lines only names
    ``least_chars``: shorter ones then go only if an earlier line equals them. With two
    edits a line of n characters that shares a third with another one emits about
    n * n / 2 variants. Null text stays null, without lines.

    An id is a whole number. Null ids come first; texts that share an id, or lack
    one, are documents of their own, in an order that depends on the texts alone.
    Rows equal in id and text are one document: each of them gets what it gets.
    """
    if max_edits not in (0, 1, 2):
        raise ValueError("max_edits must be 0, 1 or 2")
    space = S.Workspace(docs.sparkSession, "line-dedup")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    named = docs.drop("n_lines", "n_removed").withColumns({"__d": F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)), "__k": F.xxhash64(text)})
    pairs = named.select(F.col("__d").alias("d"), F.col("__k").alias("k"), F.col(text_col).cast("string").alias("text"))
    gone = space.save(repeated_lines(pairs, space, max_edits, least_chars), "gone")
    space.drop("lines", "candidates", "different", "near", "wanted", "marked")
    from pyspark.sql import types as T

    kept = [c for c in named.columns if c != text_col]
    found = gone.withColumnsRenamed({"d": "__gd", "k": "__gk", "gone": "__gone"})
    rows = named.join(found.hint("merge"), (F.col("__d") == F.col("__gd")) & (F.col("__k") == F.col("__gk")), "left").drop("__gd", "__gk")
    rows = rows.select(F.struct(*[F.col(c) for c in kept]).alias("d"), F.col(text_col).cast("string").alias("text"), F.col("__gone"))
    schema = T.StructType([rows.schema["d"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = rows.mapInArrow(_strip, schema)
    order = [F.col("text").alias(text_col) if c == text_col else F.col("d")[c].alias(c) for c in named.columns if c not in ("__d", "__k")]
    return out.select(*order, "n_lines", "n_removed")


def op1(spark, sf_dir: str) -> DataFrame:
    """All lines of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` (its columns) without repeated lines; documents all of whose lines go are left out, and ``chars_col`` is counted anew."""
    renamed = {c: "__" + c for c in ("n_lines", "n_removed") if c in docs.columns}
    out = dedup(docs.withColumnsRenamed(renamed), id_col=id_col, text_col=text_col)
    out = out.filter(~((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines")))).drop("n_lines", "n_removed")
    out = out.withColumnsRenamed({v: k for k, v in renamed.items()})
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out.select(*docs.columns)


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents
), f AS (
  SELECT line, doc_id, no, length(line) AS n FROM l WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, no) = 1
), m AS (
  SELECT line, n, doc_id, no, n AS longer FROM f UNION ALL SELECT line, n, doc_id, no, n + 1 FROM f
), h AS (
  SELECT *, longer // 2 AS cut FROM m
), k AS (
  SELECT *, longer || 'L' || left(line, cut) AS half FROM h UNION ALL SELECT *, longer || 'R' || right(line, longer - cut) FROM h
), near AS (
  SELECT DISTINCT y.line FROM k x JOIN k y ON x.half = y.half AND (x.doc_id, x.no) < (y.doc_id, y.no)
  WHERE x.line <> y.line AND abs(x.n - y.n) <= 1 AND CASE WHEN strlen(x.line) = x.n AND strlen(y.line) = y.n THEN levenshtein(x.line, y.line) <= 1
    -- levenshtein counts bytes: beyond ASCII, the lines without their i-th characters (or the longer one without its own) are compared
    ELSE len(list_filter(range(greatest(x.n, y.n)), lambda i: CASE WHEN x.n = y.n THEN left(x.line, i) || substr(x.line, i + 2) = left(y.line, i) || substr(y.line, i + 2)
      WHEN x.n > y.n THEN left(x.line, i) || substr(x.line, i + 2) = y.line ELSE left(y.line, i) || substr(y.line, i + 2) = x.line END)) > 0 END
), out AS (
  SELECT l.doc_id, l.text, l.no, l.line, f.line IS NOT NULL AS counted,
         f.line IS NOT NULL AND (near.line IS NOT NULL OR (l.doc_id, l.no) <> (f.doc_id, f.no)) AS gone
  FROM l LEFT JOIN f ON f.line = l.line LEFT JOIN near ON near.line = l.line
), t AS (
  SELECT doc_id, CAST(sum(counted::INT) AS BIGINT) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS kept FROM out GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CAST(length(CASE WHEN d.text IS NOT NULL THEN kept END) AS BIGINT) AS n_chars_kept,
       sha256(CASE WHEN d.text IS NOT NULL THEN kept END) AS text_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""
