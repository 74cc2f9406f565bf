"""A corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it has kept. What a stage returns
is written as Parquet into the shared folder and read again, so a lost executor never reaches back over a stage.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terragrain.llm import decontaminate, mixing, quality, sharding, simhash
from terragrain.llm._shared import discard, materialise, scratch, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity stays below the threshold of their language; the others go.

    Null and empty texts go. Very long texts are judged as a whole; repeated rows, and rows with repeated or null ids, are each judged by
    their own text, so equal texts of a language fare alike. Without labels only null and empty texts go; an empty table gives an
    empty one. Further columns are passed on, whatever their names.
    """
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the least id stays.

    Texts without words (null and empty ones too) are copies of each other. Of rows that share the least id the one with the least text
    hash stays; null ids come after all others; rows alike in id and text are one document and stay or go together. Long texts count
    as a whole. An empty table gives an empty one. Further columns are passed on, whatever their names.
    """
    return simhash.without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows are judged by their own text, so null and repeated ids and repeated rows are no exception. Null, empty and short texts
    stay, long ones are searched as a whole. Items of under five tokens match nothing; without items all rows stay, and an empty table
    gives an empty one. Further columns are passed on, whatever their names.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Null and empty texts have no words, are part of no budget and stay once. A null source is a source of its own. Null and repeated
    ids are no exception; of rows alike in id and text any will do, so ties leave the result the same. An empty table gives an empty one.
    Further columns are passed on, whatever their names.
    """
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: eight shards of near equal bytes.

    One row for each row, null and repeated ids, null and empty texts (of size 1) and copies included. Rows alike in id and text take
    the places of their slot in any order. An empty table gives an empty one; of further columns none is returned.
    """
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_filter),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mix),
    ("sharding", shards),
]

#: No stage but the last counting ones can be said in SQL; tests hold the run against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other; what a stage has written on the way goes when its result is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch():
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        if before is not None:
            discard(before)
        before = docs
    return docs
