"""LAS point files as a data source: ``spark.read.format("las")``, or :func:`read_las`.

A file is cut into ranges of points, each of which one task maps and decodes column by column. Filters on
x and y prune whole files by their header before any point is read; the option ``columns`` limits decoding.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Fixed record lengths by point format, used where the header gives none.
STRIDES = {0: 20, 1: 28, 2: 26, 3: 34, 6: 30, 7: 36, 8: 38}
COLUMNS = {
    "x": ("double", pa.float64()), "y": ("double", pa.float64()), "z": ("double", pa.float64()), "intensity": ("int", pa.int32()),
    "return_number": ("smallint", pa.int16()), "return_count": ("smallint", pa.int16()), "classification": ("smallint", pa.int16()),
    "file": ("string", pa.string()), "idx": ("bigint", pa.int64()),
}
POINTS_PER_TASK, POINTS_PER_BATCH = 4_000_000, 262_144
#: Headers read at once where a scan is planned.
PEEKS = 32
HEADER_SCHEMA = "file string, version string, format int, stride int, offset bigint, points bigint, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"


class LasError(ValueError):
    """A file that is not a LAS file this reader knows, or is damaged."""


@dataclass(frozen=True)
class Header:
    file: str
    major: int
    minor: int
    format: int
    stride: int
    offset: int
    points: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]

    @property
    def wide(self) -> bool:
        """Whether the point format has the wide return and class fields."""
        return self.format >= 6

    @property
    def row(self) -> tuple:
        return (self.file, f"{self.major}.{self.minor}", self.format, self.stride, self.offset, self.points, *self.low, *self.high)


def parse_header(data: bytes, size: int, file: str = "", strict: bool = True) -> Header:
    """``data`` holds at least the header, ``size`` is that of the file. ``strict`` refuses data behind the points and
    takes the layout of the fields from the version instead of the point format."""
    if len(data) < 227 or data[:4].upper() != b"LASF":
        raise LasError(f"{file}: not a LAS file")
    major, minor = data[24], data[25]
    if major != 1 or minor not in (0, 1, 2, 4):
        raise LasError(f"{file}: LAS version {major}.{minor} is not supported")
    (offset,) = struct.unpack_from("<I", data, 96)
    fmt = data[104] & 0x3F
    stride, n = struct.unpack_from("<HI", data, 105)
    if minor == 4:
        if len(data) < 255:
            raise LasError(f"{file}: the header is cut short")
        (n,) = struct.unpack_from("<Q", data, 247)
    if stride == 0:
        if fmt not in STRIDES:
            raise LasError(f"{file}: point format {fmt} has no known record length")
        stride = STRIDES[fmt]
    body = size - offset
    if body < n * stride or (strict and (body % stride or body // stride != n)):
        raise LasError(f"{file}: {body} bytes of points do not hold {n} records of {stride}")
    scale, shift = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    hx, lx, hy, ly, hz, lz = struct.unpack_from("<6d", data, 179)
    return Header(file, major, minor, fmt, stride, offset, n, scale, shift, (lx, ly, lz), (hx, hy, hz))


def open_file(path: str) -> pa.NativeFile:
    """A file for reading ranges: a plain path, or a URL of any file system that Arrow knows (file, hdfs, s3, gs)."""
    if "://" not in path and not path.startswith("file:"):
        return pa.OSFile(path, "rb")
    if path.startswith("file:"):
        path = "file://" + path.removeprefix("file:").removeprefix("//")
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def peek(path: str, strict: bool = True) -> Header:
    """The header alone; no point is read."""
    with open_file(path) as f:
        return parse_header(f.read(375), f.size(), path, strict)


def decode(buf: memoryview, h: Header, start: int, count: int, columns: list[str], strict: bool = False, base: int | None = None) -> pa.RecordBatch:
    """``count`` points from number ``start`` on; ``base`` is where they begin in ``buf`` (by default that of the file)."""
    raw = np.frombuffer(buf, np.uint8, count * h.stride, h.offset + start * h.stride if base is None else base).reshape(count, h.stride)
    wide = h.minor == 4 if strict else h.wide
    at = lambda k, kind: raw[:, k : k + np.dtype(kind).itemsize].copy().view(kind)[:, 0]
    make = {
        "x": lambda: at(0, "<i4") * h.scale[0] + h.shift[0],
        "y": lambda: at(4, "<i4") * h.scale[1] + h.shift[1],
        "z": lambda: at(8, "<i4") * h.scale[2] + h.shift[2],
        "intensity": lambda: at(12, "<u2").astype(np.int32),
        "return_number": lambda: (raw[:, 14] & (0x0F if wide else 0x07)).astype(np.int16),
        "return_count": lambda: (raw[:, 14] >> 4 if wide else (raw[:, 14] & 0x38) >> 3).astype(np.int16),
        "classification": lambda: (raw[:, 16] if wide else raw[:, 15] & 0x1F).astype(np.int16),
        "file": lambda: [h.file] * count,
        "idx": lambda: np.arange(start, start + count, dtype=np.int64),
    }
    return pa.RecordBatch.from_arrays([pa.array(make[c](), COLUMNS[c][1]) for c in columns], columns)


@dataclass
class Range(InputPartition):
    header: Header
    start: int
    count: int


class LasReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.columns = options.get("columns", ",".join(COLUMNS)).split(",")
        self.strict = options.get("strict", "true").lower() == "true"
        self.per_task = int(options.get("pointspertask", POINTS_PER_TASK))
        self.start, self.count = int(options.get("start", 0)), int(options.get("count", -1))
        box = options.get("bbox")
        self.low, self.high = [-np.inf, -np.inf], [np.inf, np.inf]
        if box:
            x0, y0, x1, y1 = map(float, box.split(","))
            self.low, self.high = [x0, y0], [x1, y1]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on x and y narrow the window that files must touch; Spark still tests every point."""
        for f in filters:
            axis = {("x",): 0, ("y",): 1}.get(getattr(f, "attribute", None))
            if axis is not None and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.low[axis] = max(self.low[axis], float(f.value))
            if axis is not None and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.high[axis] = min(self.high[axis], float(f.value))
            yield f

    def partitions(self) -> list[Range]:
        """Headers are peeked at many at a time; of each file the points ``start`` to ``start + count`` are dealt to tasks."""
        out = []
        with ThreadPoolExecutor(PEEKS) as pool:
            headers = list(pool.map(lambda p: peek(p, self.strict), self.paths))
        for h in headers:
            if any(h.low[k] > self.high[k] or h.high[k] < self.low[k] for k in (0, 1)):
                continue
            end = h.points if self.count < 0 else min(h.points, self.start + self.count)
            out += [Range(h, s, min(self.per_task, end - s)) for s in range(self.start, end, self.per_task)]
        return out or [Range(None, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """Reads the task's range of the file and nothing else, a batch of points at a time."""
        h = part.header
        if h is None or part.count <= 0:
            return
        with open_file(h.file) as f:
            for s in range(part.start, part.start + part.count, POINTS_PER_BATCH):
                n = min(POINTS_PER_BATCH, part.start + part.count - s)
                f.seek(h.offset + s * h.stride)
                yield decode(memoryview(f.read_buffer(n * h.stride)), h, s, n, self.columns, self.strict, base=0)


class LasDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return ", ".join(f"{c} {COLUMNS[c][0]}" for c in self.options.get("columns", ",".join(COLUMNS)).split(","))

    def reader(self, schema) -> LasReader:
        return LasReader(self.options)


def read_las(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, bbox: tuple[float, float, float, float] | None = None, strict: bool = True, points_per_task: int = POINTS_PER_TASK, start: int = 0, count: int = -1) -> DataFrame:
    """Points of all files, a bag union. ``bbox`` prunes files by their headers; points are not filtered by it. Of each file the
    points from number ``start`` on are read, at most ``count`` of them (-1: all); ``extent_of`` gives the extent of such a part."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasDataSource)
    r = spark.read.format("las").option("paths", "\n".join([paths] if isinstance(paths, str) else paths)).option("strict", str(strict).lower()).option("pointspertask", points_per_task).option("start", start).option("count", count)
    if columns:
        r = r.option("columns", ",".join(columns))
    if bbox:
        r = r.option("bbox", ",".join(map(repr, bbox)))
    return r.load()


def extent_of(points: DataFrame) -> tuple[float, ...]:
    """min_x, min_y, min_z, max_x, max_y, max_z of what is read, found anew from the points."""
    return tuple(points.agg(*[f(c) for f in (F.min, F.max) for c in "xyz"]).first())


def read_las_binary(spark: SparkSession, path: str, columns: list[str] | None = None, strict: bool = True) -> DataFrame:
    """The same through Spark's own file systems, for URLs that Arrow cannot open: one task decodes one whole file, of less than
    2 GiB. Larger files are read by ranges, see ``read_las``."""
    cols = columns or list(COLUMNS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                h = parse_header(data[:375], len(data), name, strict)
                for s in range(0, h.points, POINTS_PER_BATCH):
                    yield decode(memoryview(data), h, s, min(POINTS_PER_BATCH, h.points - s), cols)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.las").option("recursiveFileLookup", "false").load(path)
    return files.select("path", "content").mapInArrow(scan, ", ".join(f"{c} {COLUMNS[c][0]}" for c in cols))


def las_headers(spark: SparkSession, paths: list[str], strict: bool = True) -> DataFrame:
    """One row per file, from headers alone, read where the tasks run."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [peek(p, strict).row for p in batch.column("path").to_pylist()]
            names = [c.split(" ")[0] for c in HEADER_SCHEMA.split(", ")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[n]) for n, c in zip(names, zip(*rows))], names)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 256))).mapInArrow(scan, HEADER_SCHEMA)


_ARROW = {c.split(" ")[0]: {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[c.split(" ")[1]] for c in HEADER_SCHEMA.split(", ")}


def header_bytes(n: int, low: np.ndarray, high: np.ndarray, scale: float, minor: int, fmt: int) -> bytes:
    stride, size = STRIDES[fmt], 375 if minor == 4 else 227
    head = bytearray(size)
    head[:4] = b"LASF"
    head[24:26] = bytes([1, minor])
    struct.pack_into("<HI", head, 94, size, size)
    head[104] = fmt
    struct.pack_into("<HI", head, 105, stride, n if minor != 4 else 0)
    struct.pack_into("<6d", head, 131, scale, scale, scale, 0.0, 0.0, 0.0)
    struct.pack_into("<6d", head, 179, high[0], low[0], high[1], low[1], high[2], low[2])
    if minor == 4:
        struct.pack_into("<Q", head, 247, n)
    return bytes(head)


def record_bytes(points: np.ndarray, scale: float, fmt: int, a: dict[str, np.ndarray]) -> bytes:
    n, wide = len(points), fmt >= 6
    body = np.zeros((n, STRIDES[fmt]), np.uint8)
    body[:, :12] = np.round(points / scale).astype("<i4").view(np.uint8).reshape(n, 12)
    body[:, 12:14] = a.get("intensity", np.zeros(n)).astype("<u2").view(np.uint8).reshape(n, 2)
    rn, rc, cl = (a.get(k, np.full(n, v)).astype(np.uint8) for k, v in (("return_number", 1), ("return_count", 1), ("classification", 0)))
    body[:, 14] = rn | rc << (4 if wide else 3)
    body[:, 16 if wide else 15] = cl
    return body.tobytes()


def write_las(path: str, points: np.ndarray, scale: float = 0.01, minor: int = 2, fmt: int = 0, attributes: dict[str, np.ndarray] | None = None) -> None:
    """A small LAS file of an (n, 3) array; for tests and examples."""
    points = np.round(points / scale) * scale
    low, high = (points.min(axis=0), points.max(axis=0)) if len(points) else (np.zeros(3), np.zeros(3))
    with open(path, "wb") as f:
        f.write(header_bytes(len(points), low, high, scale, minor, fmt))
        f.write(record_bytes(points, scale, fmt, attributes or {}))


def write_las_tiles(points: DataFrame, folder: str, scale: float = 0.01, minor: int = 2, fmt: int = 0) -> list[str]:
    """One LAS file for each partition of ``points`` (x, y, z and any of the attributes), written by its task into ``folder``, a
    path that all executors share; returns the files. A task that is run again replaces its file as a whole."""
    cols = ["x", "y", "z", *[c for c in ("intensity", "return_number", "return_count", "classification") if c in points.columns]]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path, part = (f"{folder}/part-{task.partitionId():06d}{x}" for x in (".las", f".las.{task.attemptNumber()}"))
        n, low, high = 0, np.full(3, np.inf), np.full(3, -np.inf)
        with open(part, "wb") as f:
            f.write(header_bytes(0, np.zeros(3), np.zeros(3), scale, minor, fmt))
            for b in batches:
                if b.num_rows:
                    a = {c: b.column(c).to_numpy(zero_copy_only=False) for c in cols}
                    xyz = np.round(np.stack([a.pop(c) for c in "xyz"], axis=1) / scale) * scale
                    n, low, high = n + len(xyz), np.minimum(low, xyz.min(axis=0)), np.maximum(high, xyz.max(axis=0))
                    f.write(record_bytes(xyz, scale, fmt, a))
            f.seek(0)
            f.write(header_bytes(n, low, high, scale, minor, fmt) if n else header_bytes(0, np.zeros(3), np.zeros(3), scale, minor, fmt))
        os.replace(part, path)
        yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    os.makedirs(folder, exist_ok=True)
    return sorted(r["path"] for r in points.select(*cols).mapInArrow(put, "path string").collect())  # one row a file
