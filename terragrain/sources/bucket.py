"""Bucket files (.bkt): id and count as int32, then the points as three doubles each; and buckets as Parquet."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, x, y, z) of all .bkt files at ``path``, by any URL that Spark can read."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                ident, n = struct.unpack_from("<2i", data)
                if len(data) < 8 + 24 * n:
                    raise ValueError(f"bucket {ident} is cut short")
                p = np.frombuffer(data, "<f8", 3 * n, 8).reshape(n, 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, ident, np.int32)), *[pa.array(p[:, k]) for k in range(3)]], ["bucket", "x", "y", "z"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bkt").load(path)
    return files.select("content").mapInArrow(scan, "bucket int, x double, y double, z double")


def dump_bucket(folder: str, ident: int, points: np.ndarray) -> str:
    """One bucket to <folder>/<id>.bkt; an older file of that name is replaced."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{ident}.bkt")
    with open(path, "wb") as f:
        f.write(struct.pack("<2i", ident, len(points)) + np.ascontiguousarray(points, "<f8").tobytes())
    return path


def write_buckets(points: DataFrame, path: str, by: str = "bucket") -> None:
    """Buckets at scale: Parquet, one folder per bucket, older content replaced."""
    points.write.mode("overwrite").partitionBy(by).parquet(path)
