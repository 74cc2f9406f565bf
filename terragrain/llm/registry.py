"""Queries of this subpackage by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, langid, licenses, mixing, quality, secrets, sharding, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_quality": quality.op2_quality,
    "op3_mixing": mixing.op3_mixing,
    "op4_simhash": simhash.op4_simhash,
    "op5_langid": langid.op5_langid,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_licenses": licenses.op8_licenses,
    "op9_secrets": secrets.op9_secrets,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES: dict[str, str] = {"op6_exact_dedup": exact_dedup.ORACLE, "op8_licenses": licenses.ORACLE, "op9_secrets": secrets.ORACLE}
