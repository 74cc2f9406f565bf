"""Delimited text: x, y, z in the first three fields, a header line that is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ascii(spark: SparkSession, paths: str | list[str], sep: str = ",") -> DataFrame:
    """Points x, y, z by position; further fields are ignored. The first line of every file is its header, whatever it
    says. Fields that are no number become 0, as C readers have it; a missing one is 0 too."""
    lines = spark.read.option("header", "true").option("enforceSchema", "true").option("sep", sep).schema("x string, y string, z string").option("mode", "PERMISSIVE").csv(paths)
    return lines.select(*[F.coalesce(F.expr(f"try_cast(trim({c}) as double)"), F.lit(0.0)).alias(c) for c in "xyz"])
