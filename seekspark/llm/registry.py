"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, flac, html, line_dedup, near_duplicates, outliers, packing, pii, quality, sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.query,
    "op2_line_dedup": line_dedup.query,
    "op3_pii": pii.query,
    "op4_quality_classifier": quality.query,
    "op5_sharding": sharding.query,
    "op6_flac_media": flac.query,
    "op7_ngram_jaccard_join": near_duplicates.query,
    "op8_html_extraction": html.query,
    "op9_packing": packing.query,
    "op10_robust_outliers": outliers.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op6_flac_media": flac.ORACLE,
}
