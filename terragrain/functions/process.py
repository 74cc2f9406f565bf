"""Memory of the processes that do the work."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def memory() -> tuple[int, int]:
    """(virtual, resident) bytes of this process, (0, 0) where the system does not say."""
    try:
        with open("/proc/self/statm") as f:
            size, resident = map(int, f.read().split()[:2])
    except OSError:
        return 0, 0
    page = os.sysconf("SC_PAGE_SIZE")
    return size * page, resident * page


def worker_memory(spark: SparkSession, tasks: int) -> DataFrame:
    """(task, virtual, resident) of the Python workers that run so many tasks."""

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, r = memory()
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x] * b.num_rows, pa.int64()) for x in (v, r))], ["task", "virtual", "resident"])

    return spark.range(0, tasks, 1, tasks).mapInArrow(ask, "task long, virtual long, resident long")
