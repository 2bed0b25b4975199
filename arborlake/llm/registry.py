"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborlake.llm import bpe, chat, decontaminate, jpeg, licenses, pages, secrets, simhash, toxicity, url_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_rules": url_rules.op1_url_rules,
        "op2_pages": pages.op2_pages,
        "op3_simhash": simhash.op3_simhash,
        "op4_bpe": bpe.op4_bpe,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_chat": chat.op6_chat,
        "op7_licenses": licenses.op7_licenses,
        "op8_jpeg": jpeg.op8_jpeg,
        "op9_secrets": secrets.op9_secrets,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": decontaminate.ORACLE, "op6_chat": chat.ORACLE}
