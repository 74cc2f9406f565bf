"""ARC and GRID ASCII rasters: rows from the top (greatest j) down, columns from i = 0 on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import MEASURES, NODATA, GridSpec


def output_name(prefix: str, measure: str, suffix: str) -> str:
    """<prefix>.<measure>.<asc|grid|tif>"""
    return f"{prefix}.{measure}.{suffix}"


def arc_header(spec: GridSpec) -> str:
    """One cell size only: that of x."""
    return f"ncols {spec.gx}\nnrows {spec.gy}\nxllcorner {spec.min_x:f}\nyllcorner {spec.min_y:f}\ncellsize {spec.dx:f}\nNODATA_value {NODATA}\n"


def grid_header(spec: GridSpec) -> str:
    return f"north: {spec.max_y:f}\nsouth: {spec.min_y:f}\neast: {spec.max_x:f}\nwest: {spec.min_x:f}\nrows: {spec.gy}\ncols: {spec.gx}\n"


def raster_lines(nodes: DataFrame, spec: GridSpec, measure: str) -> DataFrame:
    """(j, line) for every row of the grid; each value is followed by a blank, the last one too.

    A row is put together from its populated nodes and the lengths of the gaps before them, so the work
    follows the data and not the size of the grid. One task holds one row, at most gx values.
    """
    col, empty = MEASURES[measure], f"{NODATA} "
    text = F.format_string("%d ", F.col(col)) if measure == "den" else F.format_string("%.6f ", F.col(col))
    row = Window.partitionBy("j").orderBy("i")
    gap = F.col("i") - F.coalesce(F.lag("i").over(row), F.lit(-1)) - 1
    pieces = nodes.where(F.col(col).isNotNull()).select("j", "i", F.concat(F.repeat(F.lit(empty), gap.cast("int")), text).alias("piece"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), "")
    rows = pieces.groupBy("j").agg(F.concat(whole, F.repeat(F.lit(empty), (F.lit(spec.gx - 1) - F.max("i")).cast("int"))).alias("line"))
    every = nodes.sparkSession.range(spec.gy).select(F.col("id").cast("int").alias("j"))
    return every.join(rows, "j", "left").select("j", F.coalesce("line", F.lit(empty * spec.gx) if spec.gx <= 4096 else F.repeat(F.lit(empty), spec.gx)).alias("line"))


HEADERS = {"arc": arc_header, "grid": grid_header}


def write_text(nodes: DataFrame, spec: GridSpec, measure: str, path: str, kind: str = "arc", shared: bool = False) -> None:
    """One file: header, then rows streamed to it in order, one partition at a time. Where ``path`` is on a file system that all
    executors share (``shared``), the lengths of the rows (one number a row of the grid) give their places first, and each
    task then puts its rows there itself."""
    header, lines = HEADERS[kind](spec), raster_lines(nodes, spec, measure)
    if not shared:
        with open(path, "w") as f:
            f.write(header)
            for r in lines.orderBy(F.desc("j")).toLocalIterator():
                f.write(r["line"] + "\n")
        return
    sizes = np.zeros(spec.gy, np.int64)
    for r in lines.select("j", F.length("line").alias("n")).toLocalIterator():
        sizes[spec.gy - 1 - r["j"]] = r["n"] + 1
    starts = len(header) + np.concatenate([[0], np.cumsum(sizes)])
    with open(path, "w") as f:
        f.write(header)
        f.truncate(int(starts[-1]))
    at = nodes.sparkSession.sparkContext.broadcast(starts)  # eight bytes a row of the grid

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "r+b") as f:
            for b in batches:
                for j, line in zip(b.column("j").to_pylist(), b.column("line").to_pylist()):
                    f.seek(int(at.value[spec.gy - 1 - j]))
                    f.write(line.encode() + b"\n")
                yield b.select(["j"])

    lines.mapInArrow(put, "j int").write.format("noop").mode("overwrite").save()


def write_text_parts(nodes: DataFrame, spec: GridSpec, measure: str, path: str) -> None:
    """The body as ordered part files, written where the rows are; their concatenation behind a header is the raster."""
    parts = nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")
    lines = raster_lines(nodes, spec, measure).repartitionByRange(int(parts), F.desc("j")).sortWithinPartitions(F.desc("j"))
    lines.select("line").write.mode("overwrite").text(path)
