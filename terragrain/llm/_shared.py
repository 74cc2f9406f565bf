"""Helpers shared by the training-data operators: shared storage, word rules, column hygiene."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator between words in every contract of this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of keys (some 32 bytes each) up to which one side of a join is broadcast; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: Columns of ``row_key``.
KEY = ["__tg_none", "__tg_id", "__tg_text"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session of one process gets a
    temporary one; a session on a cluster is refused, since no other folder is known to be shared."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = jvm.get() if jvm.isDefined() else ""
    if not path:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="terragrain-shared-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Tables made within each open ``scratch``.
_made: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables of ``materialise`` made within are deleted at the end, but for those made with ``keep``."""
    _made.append([])
    try:
        yield
    finally:
        discard(*_made.pop())


def materialise(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends at replicated files,
    so a lost executor costs a re-read and never a recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terragrain/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tg_path = path
    if _made and not keep:
        _made[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df._tg_path)
        at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(at, True)


def row_key(docs: DataFrame) -> list[Column]:
    """__tg_none, __tg_id, __tg_text: what tells rows apart where ids repeat or are null; rows alike in all three are one
    document."""
    ident, text = docs["doc_id"], docs["text"]
    return [ident.isNull().alias(KEY[0]), F.coalesce(ident.cast("long"), F.lit(0).cast("long")).alias(KEY[1]), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias(KEY[2])]


def small(keys: DataFrame) -> DataFrame:
    """``keys`` marked for broadcast if there are few enough of them."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone`` (a written table of KEY); columns as they came."""
    g = small(gone)
    same = [mine == F.col(name) for mine, name in zip(row_key(docs), KEY)]
    return docs.join(g, same[0] & same[1] & same[2], "left_anti")


def give_back() -> None:
    """Return freed memory to the system: workers live on between stages, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every system has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(scan: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``scan`` for mapInArrow, with its memory given back now and then between batches and at the end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        for batch in scan(batches):
            yield batch
            del batch
            if time.monotonic() - last > 0.5:
                give_back()
                last = time.monotonic()
        give_back()

    return run


def values(column: pa.Array | pa.ChunkedArray, rows: int = 500) -> Iterator[Any]:
    """The values of a column one by one, of which only a slice is held as Python objects at a time."""
    for k in range(0, len(column), rows):
        yield from column.slice(k, rows).to_pylist()


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes Spark's byte-wise lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text, without the empty pieces that leading or trailing white space leaves."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m: the fold of a document. A null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m).cast("int")


def seeded_rows(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The ``most`` rows with the least long in column ``h`` (a hash, ties by ``order``). A threshold on the hash, from
    the number of rows, comes first: what tasks send on follows ``most`` and not the number of partitions."""
    n = rows.count()
    if n > 2 * most:
        share = 1.5 * most / n + 100 / n
        rows = rows.where(F.col("h") < int(-(2**63) + 2**64 * min(1.0, share)) if share < 1 else F.lit(True))
    return rows.orderBy("h", *order).limit(most)
