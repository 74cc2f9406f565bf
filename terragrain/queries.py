"""Registered queries over the test tables, and the SQL that gives the same rows.

Floating results are rounded to six places on both sides, since sums depend on the order of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import bbox as B
from .functions import crs, point
from .operators.bins import PixelGrid, bin_mean, longest_axis
from .operators.blocks import BlockScheme, assign_blocks, sort_by_block
from .operators.filters import header_overlaps, overlaps_closed
from .operators.polygon import Segment, in_polygon, outside_nodes, segments_of
from .plans import views
from .plans.job import Options, grid, grid_spec
from .sinks.text import raster_lines
from .spec import MEASURES, GridSpec, default_radius

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RINGS = [[(-25.0, -20.0), (20.0, -28.0), (30.0, 18.0), (-15.0, 27.0)], [(-5.0, -5.0), (6.0, -5.0), (6.0, 7.0), (-5.0, 7.0)]]
SEGMENTS: list[Segment] = segments_of(RINGS)
BOX = (3.0, 100.0, 120.0, 500.0)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def grid_sql(view: str, dx: float, dy: float | None = None, r: float | None = None, where: str = "true", box: tuple | None = None, legacy: bool = False) -> str:
    """CTEs up to ``n``: the nodes with all measures, unrounded."""
    dy = dx if dy is None else dy
    r = default_radius(dx) if r is None else r
    ext = f"{box[0]!r}::DOUBLE AS x0, {box[1]!r}::DOUBLE AS y0, {box[2]!r}::DOUBLE AS x1, {box[3]!r}::DOUBLE AS y1" if box else "min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1"
    once = "LIMIT 1" if box else ""
    w = "CASE WHEN d2 > 0 THEN 1 / d2 END"
    if legacy:
        w = f"CASE WHEN d2 > 0 THEN CASE WHEN i > floor(xr / {dx!r}) AND j > floor(yr / {dy!r}) THEN 1 / (d2 * d2) ELSE 1 / d2 END END"
    return f"""WITH src AS ({views.SQL[view]}), e0 AS (SELECT {ext} FROM src {once}),
e AS (SELECT *, CAST(ceil((x1 - x0) / {dx!r}) AS INTEGER) + 1 AS gx, CAST(ceil((y1 - y0) / {dy!r}) AS INTEGER) + 1 AS gy FROM e0),
p0 AS (SELECT x - x0 AS xr, y - y0 AS yr, z, gx, gy FROM src, e WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND ({where})),
p1 AS (SELECT *, unnest(range(greatest(0, CAST(ceil((xr - {r!r}) / {dx!r}) AS INTEGER) - 1), least(gx - 1, CAST(floor((xr + {r!r}) / {dx!r}) AS INTEGER) + 1) + 1)) AS i FROM p0),
p2 AS (SELECT *, unnest(range(greatest(0, CAST(ceil((yr - {r!r}) / {dy!r}) AS INTEGER) - 1), least(gy - 1, CAST(floor((yr + {r!r}) / {dy!r}) AS INTEGER) + 1) + 1)) AS j FROM p1),
c AS (SELECT *, (xr - i * {dx!r}) * (xr - i * {dx!r}) + (yr - j * {dy!r}) * (yr - j * {dy!r}) AS d2 FROM p2),
n AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, min(z) AS zmin, max(z) AS zmax, avg(z) AS zmean, coalesce(min(z) FILTER (d2 = 0), sum(z * ({w})) / sum({w})) AS zidw,
  count(*) AS den, stddev_pop(z) AS zstd FROM c WHERE d2 <= {r * r!r} GROUP BY i, j)
"""


ROUNDED = ", ".join(f"round({c}, 6) AS {c}" if c != "den" else "den" for c in MEASURES.values())
VIEW = {"li": views.lineitem_points, "evt": views.event_points, "emb": views.embedding_points}


def grid_query(view: str, o: Options, returns: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pts = views.lineitem_points(spark, sf_dir, returns) if view == "li" else VIEW[view](spark, sf_dir)
        spec = grid_spec(pts, o)
        return rounded(grid(pts, spec, o).drop("filled") if not (o.window or o.fill_empty) else grid(pts, spec, o))

    return query


def _grids() -> None:
    register("grid_all", grid_query("li", Options(6.0, 6.0)), grid_sql("li", 6.0) + f"SELECT i, j, {ROUNDED} FROM n")
    for m, c in MEASURES.items():
        sel = c if m == "den" else f"round({c}, 6) AS {c}"
        register(f"grid_{m}", grid_query("evt", Options(6.0, 6.0, measures=[m])), grid_sql("evt", 6.0) + f"SELECT i, j, {sel} FROM n")
    register("grid_bbox", grid_query("evt", Options(6.0, 6.0, bbox=BOX)), grid_sql("evt", 6.0, box=BOX) + f"SELECT i, j, {ROUNDED} FROM n")
    register("grid_keep_class", grid_query("evt", Options(6.0, 6.0, classes=[2, 3])), grid_sql("evt", 6.0, where="classification IN (2, 3)") + f"SELECT i, j, {ROUNDED} FROM n")
    register("grid_first_last", grid_query("li", Options(6.0, 6.0, first_returns=True, last_returns=True), True), grid_sql("li", 6.0, where="return_number = 1 OR return_number = return_count") + f"SELECT i, j, {ROUNDED} FROM n")
    register("grid_aniso", grid_query("evt", Options(5.0, 10.0)), grid_sql("evt", 5.0, 10.0) + f"SELECT i, j, {ROUNDED} FROM n")
    register("grid_idw_coincident", grid_query("li", Options(1.0, 1.0, radius=1.0, measures=["idw", "den"])), grid_sql("li", 1.0, r=1.0) + "SELECT i, j, round(zidw, 6) AS zidw, den FROM n")
    register("grid_incore_idw", grid_query("emb", Options(2.0, 2.0, measures=["idw"], legacy_idw=True)), grid_sql("emb", 2.0, legacy=True) + "SELECT i, j, round(zidw, 6) AS zidw FROM n")


def inside_sql(x: str, y: str) -> str:
    """A scalar: whether (x, y) is inside SEGMENTS."""
    rows = ", ".join(f"({', '.join(f'{v!r}::DOUBLE' for v in s)})" for s in SEGMENTS)
    turn = f"sign((x2 - x1) * ({y} - y2) - (y2 - y1) * ({x} - x2))"
    cross = f"""CASE WHEN NOT (x1 < {x} AND x2 < {x}) AND NOT ({x} = x2 AND {y} = y2) AND ((y1 > {y} AND y2 <= {y}) OR (y2 > {y} AND y1 <= {y}))
      AND CASE WHEN y2 < y1 THEN -{turn} ELSE {turn} END > 0 THEN 1 ELSE 0 END"""
    return f"(SELECT sum({cross}) % 2 = 1 FROM (VALUES {rows}) s(x1, y1, x2, y2))"


def _polygons() -> None:
    xs, ys = [p[0] for r in RINGS for p in r], [p[1] for r in RINGS for p in r]
    box = (float(math.floor(min(xs))), float(math.floor(min(ys))), max(xs), max(ys))
    register("grid_polygon", grid_query("emb", Options(2.0, 2.0, shape=SEGMENTS)), grid_sql("emb", 2.0, box=box, where=inside_sql("x", "y")) + f"SELECT i, j, {ROUNDED} FROM n")

    def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
        return in_polygon(views.embedding_points(spark, sf_dir), SEGMENTS, strips=16).select("pid", "inside")

    register("polygon_strips", strips, f"WITH src AS ({views.SQL['emb']}) SELECT pid, {inside_sql('x', 'y')} AS inside FROM src")

    def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
        return outside_nodes(spark, GridSpec(-40.0, -40.0, 40.0, 40.0, 2.0, 2.0), SEGMENTS)

    corners = " AND ".join(f"NOT {inside_sql(f'(x + {a})', f'(y + {b})')}" for a, b in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)))
    register("outside_mask", mask, f"WITH g AS (SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, a.i * 2.0::DOUBLE - 40.0 AS x, b.j * 2.0::DOUBLE - 40.0 AS y FROM range(41) a(i), range(41) b(j)) SELECT i, j FROM g WHERE {corners}")


def fill_sql(size: int) -> str:
    r = size // 2
    vals = ", ".join(f"sum({v} * w) / sum(w) AS {v}" for v in MEASURES.values() if v != "den")
    cols = "i, j, zmin, zmax, zmean, zidw, den, zstd"
    return f""", o AS (SELECT a.a, b.b, 1.0 / pow(greatest(abs(a.a), abs(b.b)), 2) AS w FROM range({-r}, {r + 1}) a(a), range({-r}, {r + 1}) b(b) WHERE a.a <> 0 OR b.b <> 0),
t AS (SELECT CAST(i + a AS INTEGER) AS i, CAST(j + b AS INTEGER) AS j, w, zmin, zmax, zmean, zidw, zstd FROM n, o),
f AS (SELECT i, j, {vals}, 0::BIGINT AS den FROM t, e WHERE i BETWEEN 0 AND gx - 1 AND j BETWEEN 0 AND gy - 1 AND (i, j) NOT IN (SELECT (i, j) FROM n) GROUP BY i, j),
nf AS (SELECT {cols}, false AS filled FROM n UNION ALL SELECT {cols}, true FROM f)
"""


def row_fill_sql() -> str:
    """Dense rows, nearest populated nodes on either side by windows."""
    vals = [v for v in MEASURES.values() if v != "den"]
    up, down = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    near = ", ".join(f"last_value({v} IGNORE NULLS) OVER (PARTITION BY j ORDER BY i {up}) AS {v}_a, first_value({v} IGNORE NULLS) OVER (PARTITION BY j ORDER BY i {down}) AS {v}_b" for v in ["k", *vals])
    lin = ", ".join(f"round(CASE WHEN k IS NOT NULL THEN {v} WHEN k_a IS NULL THEN {v}_b WHEN k_b IS NULL THEN {v}_a ELSE {v}_a + ({v}_b - {v}_a) * ((i - k_a) / (k_b - k_a)) END, 6) AS {v}" for v in vals)
    return f""", g AS (SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j FROM e, range((SELECT gx FROM e)) a(i), range((SELECT gy FROM e)) b(j)),
d AS (SELECT g.i, g.j, n.* EXCLUDE (i, j), n.i AS k FROM g LEFT JOIN n ON g.i = n.i AND g.j = n.j), w AS (SELECT *, {near} FROM d)
SELECT i, j, {lin}, coalesce(den, 0) AS den, k IS NULL AS filled FROM w WHERE k_a IS NOT NULL OR k_b IS NOT NULL"""


def strict_fill_sql() -> str:
    """Anchors by a running fold over each row's populated nodes: one counts if it lies beyond the node after the last."""
    vals = [v for v in MEASURES.values() if v != "den"]
    lin = ", ".join(f"round(CASE WHEN a IS NULL THEN {v} WHEN lo IS NULL THEN h_{v} WHEN hi IS NULL THEN l_{v} ELSE l_{v} + (h_{v} - l_{v}) * ((i - lo) / (hi - lo)) END, 6) AS {v}" for v in vals)
    side = lambda s: ", ".join(f"{s}.{v} AS {s}_{v}" for v in vals)
    return f""", lists AS (SELECT j, list(i ORDER BY i) AS l FROM n GROUP BY j),
anchors AS (SELECT j, list_reduce(list_prepend([0], list_transform(l, lambda x: [x])), lambda acc, x: CASE WHEN x[1] > acc[1] THEN list_prepend(x[1] + 1, list_append(acc[2:], x[1])) ELSE acc END) AS acc FROM lists),
an AS (SELECT j, unnest(acc[2:]) AS a FROM anchors),
gaps AS (SELECT j, lag(a) OVER w AS lo, a AS hi FROM an WINDOW w AS (PARTITION BY j ORDER BY a)
  UNION ALL SELECT j, max(a), NULL FROM an JOIN (SELECT j, max(i) AS last FROM n GROUP BY j) m USING (j), e WHERE last < gx - 1 GROUP BY j),
cells AS (SELECT j, lo, hi, unnest(range(coalesce(lo + 1, 0), coalesce(hi, gx))) AS i FROM gaps, e),
u AS (SELECT CAST(coalesce(c.i, n.i) AS INTEGER) AS i, coalesce(c.j, n.j) AS j, c.i AS a, c.lo, c.hi, n.den, n.i AS k, {', '.join(f'n.{v}' for v in vals)}, {side('l')}, {side('h')}
  FROM n FULL JOIN cells c ON n.i = c.i AND n.j = c.j LEFT JOIN n l ON l.j = c.j AND l.i = c.lo LEFT JOIN n h ON h.j = c.j AND h.i = c.hi)
SELECT i, j, {lin}, coalesce(den, 0) AS den, k IS NULL AS filled FROM u"""


def _fills() -> None:
    for size in (3, 5, 7):
        register(f"grid_fill{size}", grid_query("emb", Options(2.0, 2.0, window=size)), grid_sql("emb", 2.0) + fill_sql(size) + f"SELECT i, j, {ROUNDED}, filled FROM nf")
    register("grid_fill_empty", grid_query("emb", Options(2.0, 2.0, fill_empty=True)), grid_sql("emb", 2.0) + row_fill_sql())
    register("grid_fill_empty_strict", grid_query("emb", Options(2.0, 2.0, fill_empty=True, strict_fill=True)), grid_sql("emb", 2.0) + strict_fill_sql())
    register("grid_fill_window_then_rows", grid_query("emb", Options(2.0, 2.0, window=3, fill_empty=True)), grid_sql("emb", 2.0) + row_fill_sql())

    def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
        pts = views.embedding_points(spark, sf_dir)
        o = Options(2.0, 2.0, measures=["max", "den"])
        spec = grid_spec(pts, o)
        nodes = grid(pts, spec, o)
        return raster_lines(nodes, spec, "max").withColumnRenamed("line", "max_line").join(raster_lines(nodes, spec, "den").withColumnRenamed("line", "den_line"), "j")

    register("raster_rows", raster, grid_sql("emb", 2.0) + """, g AS (SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j FROM e, range((SELECT gx FROM e)) a(i), range((SELECT gy FROM e)) b(j))
SELECT g.j, string_agg(CASE WHEN n.i IS NULL THEN '-9999 ' ELSE printf('%.6f ', n.zmax) END, '' ORDER BY g.i) AS max_line,
  string_agg(CASE WHEN n.i IS NULL THEN '-9999 ' ELSE printf('%d ', n.den) END, '' ORDER BY g.i) AS den_line FROM g LEFT JOIN n ON g.i = n.i AND g.j = n.j GROUP BY g.j""")


RES, B_LIMIT, PROCS = (5.0, 10.0), 100, 7
#: The pixel window over the whole table, and the tiling of it in blocks of 10 x 10 pixels.
PIX_SQL = f"""ext AS (SELECT min(x) AS x0, max(y) AS y1, CAST(greatest(1, ceil((max(x) - min(x)) / {RES[0]!r})) AS BIGINT) AS cols, CAST(greatest(1, ceil((max(y) - min(y)) / {RES[1]!r})) AS BIGINT) AS rows FROM src),
tiles AS (SELECT *, CAST(ceil(cols / 10.0) AS BIGINT) AS b_cols, CAST(ceil(rows / 10.0) AS BIGINT) AS b_rows FROM ext),
px AS (SELECT *, CAST(least(floor((x - x0) / {RES[0]!r}), cols - 1) AS INTEGER) AS col, CAST(least(floor((y1 - y) / {RES[1]!r}), rows - 1) AS INTEGER) AS row FROM src, tiles)"""


def pixels(points: DataFrame) -> tuple[PixelGrid, BlockScheme]:
    g = PixelGrid.of(points, *RES)
    return g, BlockScheme.fit(g, B_LIMIT, PROCS)


def _toolkit() -> None:
    evt = views.SQL["evt"]

    def means(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = views.event_points(spark, sf_dir)
        return rounded(bin_mean(p, pixels(p)[0]))

    register("bin_mean", means, f"WITH src AS ({evt}), {PIX_SQL} SELECT row, col, count(*) AS count, round(avg(z), 6) AS mean FROM px GROUP BY row, col")
    blocks = f"WITH src AS ({evt}), {PIX_SQL}, b AS (SELECT pid, (row // 10) * b_cols + col // 10 AS block FROM px)"

    def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = views.event_points(spark, sf_dir)
        return assign_blocks(p, *pixels(p))

    register("block_assign", lambda s, d: assigned(s, d).select("pid", "block", "rank"), f"{blocks} SELECT pid, block, CAST(block % {PROCS} AS INTEGER) AS rank FROM b")
    register("block_rank", lambda s, d: assigned(s, d).groupBy("rank").agg(F.count(F.lit(1)).alias("points"), F.count_distinct("block").alias("blocks")), f"{blocks} SELECT CAST(block % {PROCS} AS INTEGER) AS rank, count(*) AS points, count(DISTINCT block) AS blocks FROM b GROUP BY 1")
    register("distinct_blocks", lambda s, d: assigned(s, d).select("block").distinct(), f"{blocks} SELECT DISTINCT block FROM b")

    def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        scheme, b = pixels(views.event_points(spark, sf_dir))[1], F.col("id")
        at = scheme.position_of(b)
        return spark.range(scheme.count).select(b.alias("block"), scheme.rank_of(b).alias("rank"), at[0].alias("block_col"), at[1].alias("block_row"))

    register("block_count", counts, f"WITH src AS ({evt}), {PIX_SQL} SELECT b AS block, CAST(b % {PROCS} AS INTEGER) AS rank, b % b_cols AS block_col, b // b_cols AS block_row FROM (SELECT unnest(range(b_cols * b_rows)) AS b, b_cols FROM tiles)")

    def block_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Blocks dealt to partitions by rank and sorted within: each row's rank and block, and whether the block before it in the partition is no larger."""
        p = views.event_points(spark, sf_dir)
        rows = sort_by_block(p, *pixels(p)).select("pid", "rank", "block", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n"))
        w = Window.partitionBy("part").orderBy("n")
        return rows.select("pid", "rank", "block", (F.coalesce(F.lag("block").over(w), F.lit(-1)) <= F.col("block")).alias("in_order"))

    register("block_sort", lambda s, d: block_sort(s, d).groupBy("rank").agg(F.count(F.lit(1)).alias("points"), F.max("block").alias("last"), F.bool_and("in_order").alias("in_order")), f"{blocks} SELECT CAST(block % {PROCS} AS INTEGER) AS rank, count(*) AS points, max(block) AS last, true AS in_order FROM b GROUP BY 1")

    def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, o = (F.col("x"), F.col("y"), F.col("z")), (F.lit(5.0), F.lit(15.0), F.lit(25.0))
        p = views.embedding_points(spark, sf_dir)
        return rounded(p.select(
            "pid", point.magnitude(a).alias("magnitude"), point.dot(a, o).alias("dot"), point.distance(a, o).alias("distance"), point.altitude(a, o, strict=False).alias("altitude"),
            point.slope(a, o).alias("slope"), point.azimuth(a, o).alias("azimuth"), point.quadrant(a, o).alias("quadrant"),
        ))

    d2 = "((x - 5) * (x - 5) + (y - 15) * (y - 15) + (z - 25) * (z - 25))"
    register("point_metrics", metrics, f"""WITH src AS ({views.SQL['emb']}) SELECT pid, round(sqrt(x * x + y * y + z * z), 6) AS magnitude, round(x * 5 + y * 15 + z * 25, 6) AS dot, round(sqrt{d2}, 6) AS distance,
  round(degrees(atan2(y - 15, sqrt((x - 5) * (x - 5) + (z - 25) * (z - 25)))), 6) AS altitude, round((25 - z) / sqrt{d2}, 6) AS slope, round(degrees(atan2(5 - x, 25 - z)), 6) AS azimuth,
  CASE WHEN 5 > x THEN 1 ELSE 0 END + CASE WHEN 15 > y THEN 2 ELSE 0 END AS quadrant FROM src""")

    e = crs.WGS84
    rn = f"({e.a!r} / sqrt(1 - {e.e2!r} * sin(radians(lat)) * sin(radians(lat))))"
    q = "radians(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END)"
    ecef = f"({rn} + h) * cos(radians(lat)) * cos({q})", f"({rn} + h) * cos(radians(lat)) * sin({q})", f"({rn} * (1 - {e.e2!r}) + h) * sin(radians(lat))"

    def geocentric(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = views.customer_lonlat(spark, sf_dir)
        return rounded(p.select("pid", crs.to_geocentric(F.col("lon"), F.col("lat"), F.col("h")).alias("g")).select("pid", "g.x", "g.y", "g.z"), 3)

    register("geocentric", geocentric, f"WITH src AS ({views.SQL['geo']}) SELECT pid, round({ecef[0]}, 3) AS x, round({ecef[1]}, 3) AS y, round({ecef[2]}, 3) AS z FROM src")

    def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = views.customer_lonlat(spark, sf_dir)
        p = p.select("*", crs.to_geocentric(F.col("lon"), F.col("lat"), F.col("h")).alias("g"))
        p = p.select("pid", crs.to_geodetic(F.col("g.x"), F.col("g.y"), F.col("g.z")).alias("b"))
        return p.select("pid", F.round("b.lon", 7).alias("lon"), (F.round("b.lat", 7) + 0.0).alias("lat"), F.round("b.h", 4).alias("h"))

    # Its right result is where the points came from, which SQL has at hand.
    register("geodetic_roundtrip", roundtrip, f"WITH src AS ({views.SQL['geo']}) SELECT pid, round(lon, 7) AS lon, round(lat, 7) + 0.0 AS lat, round(h, 4) AS h FROM src")

    def subdivide(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = B.box_of(views.event_points(spark, sf_dir)).select(F.explode(B.subdivide(F.col("box"))).alias("q"))
        return rounded(b.select("q.quadrant", *[F.col(f"q.box.{m}.{c}").alias(f"{m}_{c}") for m in ("min", "max") for c in "xyz"], B.area(F.col("q.box")).alias("area")))

    half = {"W": ("min(x)", "(min(x) + max(x)) / 2"), "E": ("(min(x) + max(x)) / 2", "max(x)"), "N": ("(min(y) + max(y)) / 2", "max(y)"), "S": ("min(y)", "(min(y) + max(y)) / 2")}
    parts = [f"SELECT '{v + h}' AS quadrant, round({half[h][0]}, 6) AS min_x, round({half[v][0]}, 6) AS min_y, round(min(z), 6) AS min_z, round({half[h][1]}, 6) AS max_x, round({half[v][1]}, 6) AS max_y, round(max(z), 6) AS max_z, round(({half[h][1]} - {half[h][0]}) * ({half[v][1]} - {half[v][0]}), 6) AS area FROM src" for v in "NS" for h in "WE"]
    register("bbox_subdivide", subdivide, f"WITH src AS ({evt}) " + " UNION ALL ".join(parts))
    register("max_dim", lambda s, d: rounded(longest_axis(views.event_points(s, d))), f"WITH src AS ({evt}), e AS (SELECT max(x) - min(x) AS x, max(y) - min(y) AS y, max(z) - min(z) AS z FROM src) SELECT round(x, 6) AS extent_x, round(y, 6) AS extent_y, round(z, 6) AS extent_z, CAST(CASE WHEN x >= y AND x >= z THEN 0 WHEN y >= z THEN 1 ELSE 2 END AS INTEGER) AS axis FROM e")
    register("extent", lambda s, d: rounded(views.event_points(s, d).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), F.count(F.lit(1)).alias("points"))), f"WITH src AS ({evt}) SELECT round(min(x), 6) AS min_x, round(min(y), 6) AS min_y, round(max(x), 6) AS max_x, round(max(y), 6) AS max_y, count(*) AS points FROM src")

    def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
        tiles = views.event_points(spark, sf_dir).groupBy(F.floor(F.col("x") / 25).cast("long").alias("file")).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))
        box = (24.0, 100.0, 75.0, 500.0)
        return tiles.select("file", header_overlaps(box).alias("scan"), overlaps_closed(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"), box).alias("touches"))

    register("file_prune", prune, f"""WITH src AS ({evt}), t AS (SELECT CAST(floor(x / 25) AS BIGINT) AS file, min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM src GROUP BY 1)
SELECT file, a < 75.0 AND c > 24.0 AND b < 500.0 AND d > 100.0 AS scan, a <= 75.0 AND c >= 24.0 AND b <= 500.0 AND d >= 100.0 AS touches FROM t""")


_grids()
_polygons()
_fills()
_toolkit()

from . import file_queries  # noqa: E402, F401  registers the queries that write and read files
