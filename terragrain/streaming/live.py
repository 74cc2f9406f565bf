"""Rasters of a stream of points: the same stencil and aggregation, kept up to date by Structured Streaming.

The extent has to be fixed up front. The state is one row per node that any point has reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregate import node_measures
from ..operators.filters import in_bbox
from ..operators.stencil import stencil
from ..spec import GridSpec, default_radius


def live_grid(points: DataFrame, spec: GridSpec, radius: float | None = None, measures: list[str] | None = None) -> DataFrame:
    """Nodes of all points so far; for output modes ``update`` and ``complete``."""
    near = stencil(points.where(in_bbox(spec.bbox)), spec, default_radius(spec.dx) if radius is None else radius)
    return node_measures(near, measures)


def windowed_grid(points: DataFrame, spec: GridSpec, ts: str, every: str, late: str, radius: float | None = None, measures: list[str] | None = None) -> DataFrame:
    """A raster per window of event time (columns window, i, j and the measures); points later than ``late`` are dropped and
    closed windows leave the state, so that output mode ``append`` works."""
    near = stencil(points.withWatermark(ts, late).where(in_bbox(spec.bbox)), spec, default_radius(spec.dx) if radius is None else radius, [ts])
    return node_measures(near, measures, by=[F.window(ts, every).alias("window")])


def write_batches(nodes: DataFrame, path: str, checkpoint: str, mode: str = "complete", once: bool = True) -> StreamingQuery:
    """Every batch as Parquet below ``path`` (batch=<number>), written by the executors. In mode ``complete`` the last one
    is the raster; ``once`` ends when all input at hand is read. A batch that is run again replaces what it wrote before."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = nodes.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def last_batch(spark: SparkSession, path: str) -> DataFrame:
    """The raster of the last batch written in mode ``complete``."""
    batches = spark.read.parquet(path)
    last = batches.agg(F.max("batch")).first()[0]
    return batches.where(F.col("batch") == last).drop("batch")
