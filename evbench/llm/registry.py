"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, divergence, exactdedup, licences, linededup, media, neardup, packing, quality, records, search, suffixdedup, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_records": records.query,
    "op2_line_crf": quality.query,
    "op3_minhash": neardup.query,
    "op4_licences": licences.query,
    "op5_line_dedup": linededup.query,
    "op6_packing": packing.query,
    "op7_substrings": suffixdedup.query,
    "op8_urls": urls.query,
    "op9_media": media.query,
    "op10_bpe_chunks": bpe.query,
    "op11_exact_dedup": exactdedup.query,
    "op12_divergence": divergence.query,
    "op13_search": search.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_minhash": neardup.SQL,
    "op4_licences": licences.SQL,
    "op5_line_dedup": linededup.SQL,
    "op8_urls": urls.SQL,
    "op11_exact_dedup": exactdedup.SQL,
    "op12_divergence": divergence.SQL,
    "op13_search": search.SQL,
}
