"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontamination, language_id, lexical_search, line_dedup, merkle, ngram_jaccard, quality_ranking, simhash, suffix_dedup, token_counts, token_files, url_reputation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1,
    "op2_token_files": token_files.op2,
    "op3_language_id": language_id.op3,
    "op4_simhash": simhash.op4,
    "op5_decontamination": decontamination.op5,
    "op5_proximity": decontamination.op5_near,
    "op6_token_counts": token_counts.op6,
    "op7_url_reputation": url_reputation.op7,
    "op8_ngram_jaccard": ngram_jaccard.op8,
    "op9_byte_bpe": byte_bpe.op9,
    "op10_suffix_array": suffix_dedup.op10,
    "op11_quality_ranking": quality_ranking.op11,
    "op12_lexical_search": lexical_search.op12,
    "op13_merkle": merkle.op13,
}

ORACLE: dict[str, str] = {"op1_line_dedup": line_dedup.OP1_SQL, "op7_url_reputation": url_reputation.OP7_SQL, "op12_lexical_search": lexical_search.OP12_SQL, "op13_merkle": merkle.OP13_SQL}
