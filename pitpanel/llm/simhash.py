"""SimHash fingerprints (operator 4); DataFrame and SQL functions only.

A document's terms are its five-word shingles, each weighted by how often it
stands there. A term's 64-bit hash votes on every bit; the fingerprint has the
bits with more votes for than against. The votes are counted three bits to a
sum: bits i, i+21 and i+42 of a hash lie 21 places apart, so 21 masked sums
(plus one for bit 63) hold all 64 counters; a row of sums covers at most 2**20
terms and is unpacked before rows of one document are added.

:func:`near` finds all fingerprints within a Hamming radius with permuted block
tables: the 64 bits are cut into blocks and there is a table for every choice of
``blocks - radius`` of them. Two fingerprints within the radius agree on all
blocks of at least one choice.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FIELDS = 1 | 1 << 21 | 1 << 42  # a counter each in the low 63 bits of a sum
_CHUNK = 20  # 2**20 terms at most in one row of sums
_NO_ID = -(1 << 63)


def word_hashes(text: Column) -> Column:
    w = F.filter(F.split(F.translate(text, UPPER, LOWER), r"[\t-\r ]+"), lambda x: x != "")
    return F.transform(w, lambda x: F.xxhash64(x))


def shingle_hashes(h: Column, words: int = 5) -> Column:
    """Hashes of the shingles of a text, one for each occurrence; fewer words are one shingle, none gives none.

    ``h`` must be a column of its own, not an expression: it is read for every shingle.
    """
    n = F.size(h)
    many = F.transform(F.sequence(F.lit(1), n - (words - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(words)]))
    return F.when(n >= words, many).when(n > 0, F.array(F.xxhash64(h, F.lit(words))))


def fingerprints(rows: DataFrame, text: str, keys: list[str], words: int = 5) -> DataFrame:
    """One row for each row of ``rows``: ``keys`` (together unique) and ``fp``, a long. Null or wordless text: 0."""
    hashed = rows.select(*keys, word_hashes(F.col(text)).alias("__h"))
    each = hashed.select(*keys, F.posexplode_outer(shingle_hashes(F.col("__h"), words)).alias("p", "h"))
    sums = [F.sum(F.shiftright("h", i).bitwiseAND(F.lit(_FIELDS))).alias(f"s{i}") for i in range(21)]
    part = F.shiftright("p", _CHUNK).alias("__part")
    packed = each.groupBy(*keys, part).agg(F.count("h").alias("n"), F.sum(F.shiftrightunsigned("h", 63)).alias("s63"), *sums)
    votes = [F.shiftright(f"s{i % 21}", 21 * (i // 21)).bitwiseAND(F.lit((1 << 21) - 1)) for i in range(63)] + [F.col("s63")]
    total = packed.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(v).alias(f"v{i}") for i, v in enumerate(votes)])
    bits = [F.when(2 * F.col(f"v{i}") > F.col("n"), F.expr(f"shiftleft(1L, {i})")).otherwise(F.lit(0).cast("long")) for i in range(64)]
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return total.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def text_form(fp: Column) -> Column:
    """16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def in_order(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """(bucket, rn, real, id, text): rows dealt to buckets of neighbouring ids, in order within each.

    The first row after a bucket's last one also stands at its end (real =
    false), so that every real row finds the next document beside it; behind the
    last document comes the first. Order: id, then text; null ids come first.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("id", F.lit(_NO_ID)))
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    # at most ``buckets`` ids, whatever the number of documents
    edges, first = rows.agg(F.percentile_approx("k", shares, 10 * buckets), F.min("k")).first()
    edges = sorted({e for e in edges or [] if e > first})
    step = 64
    held = F.array(*map(F.lit, edges)).cast("array<bigint>") if edges else F.array().cast("array<bigint>")
    coarse = F.array(*map(F.lit, edges[::step])).cast("array<bigint>") if edges else held
    rows = rows.withColumn("c", F.size(F.filter(coarse, lambda e: e <= F.col("k"))))
    inner = F.size(F.filter(F.slice(held, (F.col("c") - 1) * step + 1, F.lit(step)), lambda e: e <= F.col("k")))
    rows = rows.withColumn("b", F.when(F.col("c") == 0, 0).otherwise((F.col("c") - 1) * step + inner))
    own = F.struct(F.col("b").alias("bucket"), F.lit(0).alias("late"), F.lit(True).alias("real"))
    ahead = F.struct((F.col("b") - 1).alias("bucket"), F.lit(1).alias("late"), F.lit(False).alias("real"))
    around = F.struct(F.lit(len(edges)).alias("bucket"), F.lit(1).alias("late"), F.lit(False).alias("real"))
    leads = (F.col("b") > 0) & (F.try_element_at(held, F.col("b")) == F.col("k"))
    places = F.when(leads, F.array(own, ahead)).when(F.col("k") == F.lit(first), F.array(own, around)).otherwise(F.array(own))
    rows = rows.select("id", "k", "text", F.explode(places).alias("at")).select("id", "k", "text", "at.*")
    order = Window.partitionBy("bucket").orderBy("late", "k", "text")
    return rows.withColumn("rn", F.row_number().over(order)).select("bucket", "rn", "real", "id", "text")


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, buckets: int | None = None) -> DataFrame:
    """id, n_chars, edited_sha256, fp, edited_fp, next_fp (longs) for each row of ``docs``.

    The edited text has its last quarter of characters replaced by the first as
    many (or all) of the next document. Null text is empty, and so is its edited
    text. Rows that repeat follow each other. A single document is its own next.
    """
    buckets = buckets or max(512, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = Window.partitionBy("bucket").orderBy("rn")
    rows = in_order(docs, id_col, text_col, buckets).withColumn("next", F.lead("text").over(order))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut))
    rows = rows.select("bucket", "rn", "real", "id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t"))))
    each = rows.select("bucket", "rn", "real", "id", "n_chars", F.sha2("edited", 256).alias("sha"), both.alias("x")).select(
        "bucket", "rn", "real", "id", "n_chars", "sha", "x.v", "x.t"
    )
    keys = ["bucket", "rn", "real", "id", "n_chars", "sha"]
    fp = fingerprints(each, "t", [*keys, "v"], words)
    fp = fp.groupBy(*keys).agg(F.max(F.when(F.col("v") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("v") == 1, F.col("fp"))).alias("edited_fp"))
    out = fp.withColumn("next_fp", F.lead("fp").over(order)).filter("real")
    return out.select(F.col("id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), "fp", "edited_fp", "next_fp")


def near(held: DataFrame, asked: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(asked, held, distance): for each different ``fp`` of ``asked`` all different ``fp`` of ``held`` within ``radius`` bits.

    More blocks make more tables with longer keys: keys of 64 * (blocks -
    radius) / blocks bits should be well above the logarithm of the number of
    different fingerprints. Equal fingerprints count once, so copies make no
    large groups; a pair is made in the first table that finds it only.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be below blocks, blocks at most 64")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = [signed(sum(masks[i] for i in c)) for c in combinations(range(blocks), blocks - radius)]

    def spread(df: DataFrame, name: str) -> DataFrame:
        keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(tables)]))
        return df.select(F.col("fp").alias(name)).filter(F.col(name).isNotNull()).distinct().select(name, keys.alias("x")).select(name, "x.t", "x.key")

    x, y = spread(asked, "asked"), spread(held, "held")
    diff = F.col("asked").bitwiseXOR(F.col("held"))
    found_at = F.lit(len(tables))
    for t, m in reversed(list(enumerate(tables))):
        found_at = F.when(diff.bitwiseAND(F.lit(m)) == 0, t).otherwise(found_at)
    on = (x["t"] == y["t"]) & (x["key"] == y["key"]) & (F.bit_count(diff) <= radius) & (found_at == x["t"])
    # both sides grow with the documents: neither is broadcast
    return x.join(y.hint("merge"), on).select("asked", "held", F.bit_count(diff).alias("distance"))


def op4(spark, sf_dir: str) -> DataFrame:
    """All texts of ``documents``; documents whose id is divisible by 50 are also searched for (n_near: others within 3 bits)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = Workspace(spark, "simhash").save(fingerprint_table(docs), "fingerprints")
    asked = F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
    sizes = table.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    close = near(sizes, table.filter(asked)).join(sizes.withColumnRenamed("fp", "held").hint("merge"), "held").groupBy("asked").agg((F.sum("n") - 1).alias("n_near"))
    # only the rows that ask meet the counts
    done = table.filter(asked).join(close.hint("merge"), F.col("fp") == F.col("asked"), "left").drop("asked")
    out = done.unionByName(table.filter(~asked).withColumn("n_near", F.lit(None).cast("long")))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_form(F.col("fp")).alias("fingerprint"),
        text_form(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_near",
    )
