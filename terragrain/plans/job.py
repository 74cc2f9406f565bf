"""From points to rasters: one declarative plan, whatever the size."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import node_measures
from ..operators.fill import row_fill, row_fill_strict, window_fill
from ..operators.filters import BBox, in_bbox, keep_points, require_overlap
from ..operators.polygon import Segment, in_polygon, outside_nodes, shape_bbox
from ..operators.stencil import stencil
from ..sinks.geotiff import write_geotiff
from ..sinks.text import output_name, write_text
from ..spec import DEFAULT_RESOLUTION, MEASURES, GridSpec, default_radius, pick_measures


@dataclass
class Options:
    """Parameters of a gridding job. ``bbox`` replaces the extent of the data; a shape replaces ``bbox``."""

    resolution_x: float = DEFAULT_RESOLUTION
    resolution_y: float = DEFAULT_RESOLUTION
    radius: float | None = None
    measures: list[str] = field(default_factory=list)
    bbox: BBox | None = None
    shape: list[Segment] | None = None
    classes: list[int] | None = None
    first_returns: bool = False
    last_returns: bool = False
    window: int = 0
    fill_empty: bool = False
    strict_fill: bool = False
    legacy_idw: bool = False
    order: str | None = None
    epsg: int = 0
    bigtiff: bool = True

    @property
    def search_radius(self) -> float:
        return default_radius(self.resolution_x) if self.radius is None else self.radius


class Phases:
    """Wall-clock seconds by phase."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def phase(self, name: str):
        t = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - t


def grid_spec(points: DataFrame, o: Options, extent: BBox | None = None) -> GridSpec:
    """``extent`` is that of the data where it is known without reading points (file headers)."""
    bbox = shape_bbox(o.shape) if o.shape else o.bbox
    if bbox is None:
        return GridSpec(*extent, o.resolution_x, o.resolution_y) if extent else GridSpec.from_points(points, o.resolution_x, o.resolution_y)
    if extent:
        require_overlap(extent, bbox)
    return GridSpec.from_bbox(bbox, o.resolution_x, o.resolution_y)


def filtered(points: DataFrame, spec: GridSpec, o: Options) -> DataFrame:
    """Cheapest test first: the box, the attributes, the polygon. Points outside the box reach no node, even of its edge."""
    p = points.where(in_bbox(spec.bbox))
    keep = keep_points(o.classes, o.first_returns, o.last_returns)
    if keep is not None:
        p = p.where(keep)
    if o.shape:
        p = in_polygon(p, o.shape).where("inside").drop("inside")
    return p


def grid(points: DataFrame, spec: GridSpec, o: Options) -> DataFrame:
    """Sparse nodes (i, j, measures, filled); what is absent is empty."""
    keep = [o.order] if o.order else []
    near = stencil(filtered(points, spec, o), spec, o.search_radius, keep + (["x", "y"] if o.legacy_idw else []))
    if o.legacy_idw:
        right = F.col("i") > F.floor((F.col("x") - spec.min_x) / spec.dx)
        up = F.col("j") > F.floor((F.col("y") - spec.min_y) / spec.dy)
        near = near.withColumn("up_right", right & up)
    nodes = node_measures(near, o.measures, o.order, o.legacy_idw).withColumn("filled", F.lit(False))
    if o.window:
        nodes = window_fill(nodes, spec, o.window)
    if o.fill_empty:
        mask = outside_nodes(points.sparkSession, spec, o.shape) if o.shape else None
        nodes = (row_fill_strict if o.strict_fill else row_fill)(nodes if o.window else nodes.drop("filled"), spec, mask)
    return nodes


def dense(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """Every node of the grid; measures of empty ones are NULL."""
    every = nodes.sparkSession.range(spec.nodes).select((F.col("id") % spec.gx).cast("int").alias("i"), F.expr(f"id div {spec.gx}").cast("int").alias("j"))
    return every.join(nodes, ["i", "j"], "left")


def write_all(nodes: DataFrame, spec: GridSpec, o: Options, prefix: str, formats: tuple[str, ...] = ("arc", "grid", "tif"), shared: bool = False) -> list[str]:
    """One file per measure and format. ``shared``: the files are on a file system of all executors, which then write them."""
    out = []
    for m in pick_measures(o.measures):
        if MEASURES[m] not in nodes.columns:
            continue
        for kind in formats:
            path = output_name(prefix, m, {"arc": "asc", "grid": "grid", "tif": "tif"}[kind])
            if kind == "tif":
                write_geotiff(nodes, spec, m, path, o.epsg, o.bigtiff, shared=shared)
            else:
                write_text(nodes, spec, m, path, kind, shared)
            out.append(path)
    return out


def run(spark: SparkSession, points: DataFrame, o: Options, prefix: str, formats: tuple[str, ...] = ("arc", "grid", "tif"), extent: BBox | None = None, shared: bool = False) -> tuple[list[str], Phases]:
    """Points to files, with the seconds of: extent, plan, process (scan, stencil, exchange and aggregation, which Spark runs as
    one), write, and total. A bbox or shape that the data does not overlap is an error, whatever the source."""
    ph = Phases()
    with ph.phase("total"):
        with ph.phase("extent"):
            if extent is None and (o.bbox or o.shape):
                extent = GridSpec.from_points(points, o.resolution_x, o.resolution_y).bbox
            spec = grid_spec(points, o, extent)
        with ph.phase("plan"):
            nodes = grid(points, spec, o).persist()  # computed once for all files
        try:
            with ph.phase("process"):
                nodes.count()
            with ph.phase("write"):
                files = write_all(nodes, spec, o, prefix, formats, shared)
        finally:
            nodes.unpersist()
    return files, ph
