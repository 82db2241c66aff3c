"""A training-data pipeline over ``documents``: each stage takes what the one before kept.

Every stage but the last returns the columns of ``documents``; the last adds the
encoded ids. A stage gets its predecessor's rows as a table that was written and
read again.

In every stage: an empty table gives an empty one; columns beyond those of
``documents`` stay as they are, whatever their names (those that begin with two
underscores are the stages' own; the last stage leaves all out); a null in ``lang``, ``source`` or ``n_chars`` changes nothing; a null id comes
first among the lines' documents and last among near duplicates. Texts that share
an id, or lack one, are documents of their own; rows equal in id and text are one
document, of which the third stage keeps one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm import byte_bpe, decontamination, language_id, line_dedup, ngram_jaccard
from pitpanel.llm.shared import Workspace


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised (no text, no letters, or no language at one half) go. Null and empty texts have no letter."""
    return language_id.keep_known(docs, language_id.fit(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; so do documents that consist of nothing else. Null and empty texts have no lines and stay."""
    return line_dedup.without_repeats(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles (Jaccard 0.75) the one with the smallest id stays. Null and empty texts have no shingles and stay."""
    return ngram_jaccard.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go. Null and empty texts hold none and stay."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids (little-endian 32-bit) and whether decoding gives the text back. A null text is empty."""
    named = docs.withColumn("__key", F.struct("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")))
    done = byte_bpe.decode(byte_bpe.encode(named, id_col="__key"))
    return done.select("__key.doc_id", "__key.lang", "__key.source", "__key.n_chars", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("__key.sha")).alias("round_trip"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("byte_bpe", token_stage),
]

#: SQL cannot express the first stage; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
