"""Query catalogue of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import boilerplate, bpe, budget, history, markup, packing, repetition, splitting


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def queries() -> dict:
    return {
        "p2_found": history.p2_found,
        "p4_found": boilerplate.p4_found,
        "p5_found": markup.p5_found,
        "p5_clean": markup.p5_clean,
        "p6_budget": budget.p6_budget,
        "p6_against_log": budget.p6_against_log,
        "p7_found": splitting.p7_found,
        "p7_pieces": splitting.p7_pieces,
        "p8_ids": p8_ids,
        "p9_packing": packing.p9_packing,
        "p9_filling": packing.p9_filling,
        "p10_found": repetition.p10_found,
        "p10_thresholds": repetition.p10_thresholds,
    }


def oracle_sql() -> dict:
    return {"p7_found": splitting.P7_FOUND_SQL, "p10_found": repetition.P10_FOUND_SQL}
