"""Queries of the operators in this subpackage, for the driver's contract: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from . import html_text, imatch, language_id, line_quality, mixing, near_dup, packing, pii, secrets_cnn, substring_dedup
from .runtime import documents, table


def queries():
    return {
        "op1_pii_bootstrap": lambda spark, d: pii.report(documents(spark, d)),
        "op2_line_quality": lambda spark, d: line_quality.report(documents(spark, d), table(spark, d, "labels")),
        "op3_imatch": lambda spark, d: imatch.report(documents(spark, d)),
        "op4_mixing": lambda spark, d: mixing.report(documents(spark, d)),
        "op5_html_text": lambda spark, d: html_text.report(table(spark, d, "pages")),
        "op6_language_id": lambda spark, d: language_id.report(documents(spark, d)),
        "op7_substring_dedup": lambda spark, d: substring_dedup.report(documents(spark, d)),
        "op8_near_dup": lambda spark, d: near_dup.report(documents(spark, d)),
        "op9_secrets_cnn": lambda spark, d: secrets_cnn.report(documents(spark, d)),
        "op10_packing": lambda spark, d: packing.report(documents(spark, d)),
    }


def oracle_sql():
    return {}
