"""Point in polygon by ray crossing, over all segments of all rings: holes work, overlaps cancel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import GridSpec

Segment = tuple[float, float, float, float]
#: Segments written into the expression itself, so few that the generated method stays small; more are joined by strips of y.
INLINE = 16
#: Segment copies over strips up to which the strip table is broadcast (about 40 bytes each).
BROADCAST_SEGMENTS = 500_000


def segments_of(rings: list[list[tuple[float, float]]]) -> list[Segment]:
    """Closed rings to segments; an open ring is closed."""
    out = []
    for ring in rings:
        pts = ring if ring and ring[0] == ring[-1] else [*ring, *ring[:1]]
        out += [(*a, *b) for a, b in zip(pts, pts[1:])]
    return out


def upward(segments: list[Segment]) -> list[Segment]:
    """Segments from their lower to their upper end; horizontal ones meet no ray towards greater x and go."""
    return [(x1, y1, x2, y2) if y1 < y2 else (x2, y2, x1, y1) for x1, y1, x2, y2 in segments if y1 != y2]


def crosses(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, y: Column) -> Column:
    """Whether a ray from (x, y) towards greater x crosses an upward segment: y lies in [y1, y2) and the point strictly left
    of the segment. So an edge owns its lower end, and a point on an edge is not inside because of it."""
    return (y >= y1) & (y < y2) & ((x - x1) * (y2 - y1) < (x2 - x1) * (y - y1))


def strip_table(spark: SparkSession, segments: list[Segment], strips: int | None = None) -> tuple[DataFrame, float, float, int]:
    """(strip, segs): for each strip of y the segments that reach into it."""
    low, high = min(min(s[1], s[3]) for s in segments), max(max(s[1], s[3]) for s in segments)
    n = strips or max(1, min(4096, len(segments) // 4))
    height = (high - low) / n or 1.0
    t = spark.createDataFrame(segments, "x1 double, y1 double, x2 double, y2 double")
    a, b = (F.floor((f("y1", "y2") - low) / height).cast("int") for f in (F.least, F.greatest))
    t = t.withColumn("strip", F.explode(F.sequence(a, b)))
    return t.groupBy("strip").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("segs")), low, height, len(segments) + t.count()


def in_polygon(points: DataFrame, segments: list[Segment], x: str = "x", y: str = "y", strips: int | None = None) -> DataFrame:
    """``points`` with a boolean column ``inside`` (false for null coordinates). Segments come to the points by strip of y:
    by broadcast up to BROADCAST_SEGMENTS, and only beyond that do points move to the strips."""
    px, py = F.col(x), F.col(y)
    segments = upward(segments)
    if not segments:
        return points.withColumn("inside", F.lit(False))
    if len(segments) <= INLINE and strips is None:
        total = sum((crosses(*map(F.lit, s), px, py).cast("int") for s in segments), F.lit(0))
        return points.withColumn("inside", F.coalesce(total % 2 == 1, F.lit(False)))
    table, low, height, size = strip_table(points.sparkSession, segments, strips)
    table = F.broadcast(table) if size <= BROADCAST_SEGMENTS else table
    joined = points.withColumn("strip", F.floor((py - low) / height).cast("int")).join(table, "strip", "left")
    count = F.aggregate("segs", F.lit(0), lambda n, s: n + crosses(s["x1"], s["y1"], s["x2"], s["y2"], px, py).cast("int"))
    return joined.withColumn("inside", F.coalesce(count, F.lit(0)) % 2 == 1).drop("strip", "segs")


def shape_bbox(segments: list[Segment]) -> tuple[float, float, float, float]:
    """Floor of the lower corner, the upper corner as it is."""
    xs, ys = [v for s in segments for v in (s[0], s[2])], [v for s in segments for v in (s[1], s[3])]
    return float(min(xs) // 1), float(min(ys) // 1), max(xs), max(ys)


def outside_nodes(spark: SparkSession, spec: GridSpec, segments: list[Segment]) -> DataFrame:
    """Nodes none of whose four corners (the node and its right, upper and upper right neighbours) is inside."""
    nodes = spark.range(spec.nodes).select((F.col("id") % spec.gx).cast("int").alias("i"), F.expr(f"id div {spec.gx}").cast("int").alias("j"))
    x, y = F.col("i") * spec.dx + spec.min_x, F.col("j") * spec.dy + spec.min_y
    for n, (a, b) in enumerate(((0.0, 0.0), (spec.dx, 0.0), (spec.dx, spec.dy), (0.0, spec.dy))):
        nodes = in_polygon(nodes.withColumn("__x", x + a).withColumn("__y", y + b), segments, "__x", "__y")
        nodes = nodes.where(~F.col("inside")).select("i", "j")
    return nodes
