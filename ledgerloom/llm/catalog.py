"""Queries over whole tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, jaccard, licenses, lines, quality, secrets, sharding, toxicity, warc, winnowing
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_flow_resharding": lambda s, d: sharding.op1(table(s, d, "documents")),
        "op2_ngram_jaccard_join": lambda s, d: jaccard.op2(table(s, d, "documents")),
        "op3_weak_toxicity": lambda s, d: toxicity.op3(table(s, d, "documents"), table(s, d, "labels")),
        "op4_line_dedup": lambda s, d: lines.op4(table(s, d, "documents")),
        "op5_winnowing_decontamination": lambda s, d: winnowing.op5(table(s, d, "documents"), table(s, d, "benchmark")),
        "op6_license_scan": lambda s, d: licenses.op6(table(s, d, "documents")),
        "op7_warc_bundles": lambda s, d: warc.op7(table(s, d, "pages")),
        "op8_byte_bpe": lambda s, d: bpe.op8(table(s, d, "documents")),
        "op9_secret_scan": lambda s, d: secrets.op9(table(s, d, "documents")),
        "op10_quality_rules": lambda s, d: quality.op10(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": jaccard.ORACLE,
        "op5_winnowing_decontamination": winnowing.ORACLE,
        "op7_warc_bundles": warc.ORACLE,
    }
