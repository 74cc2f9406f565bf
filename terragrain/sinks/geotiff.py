"""GeoTIFF of one Float32 band, rows from the top down; classic or BigTIFF, in the public layout of both."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import MEASURES, NODATA, GridSpec

#: TIFF field types used here: code, bytes.
SHORT, LONG, DOUBLE, ASCII, LONG8 = (3, 2), (4, 4), (12, 8), (2, 1), (16, 8)
STRIP_BYTES = 4 << 20


def rows_per_strip(spec: GridSpec) -> int:
    return max(1, min(spec.gy, STRIP_BYTES // (4 * spec.gx)))


def strips(nodes: DataFrame, spec: GridSpec, measure: str) -> DataFrame:
    """(strip, data): Float32 little endian, from the top; strips without a populated node are absent."""
    per, gx, gy = rows_per_strip(spec), spec.gx, spec.gy
    col = MEASURES[measure]
    top = F.lit(gy - 1) - F.col("j")
    cells = nodes.where(F.col(col).isNotNull()).select(F.floor(top / per).cast("int").alias("strip"), (top % per).cast("int").alias("row"), "i", F.col(col).cast("float").alias("v"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["strip"].iloc[0])
        block = np.full((min(per, gy - s * per), gx), NODATA, "<f4")
        block[pdf["row"].to_numpy(), pdf["i"].to_numpy()] = pdf["v"].to_numpy()
        return pd.DataFrame({"strip": [s], "data": [block.tobytes()]})

    return cells.groupBy("strip").applyInPandas(pack, "strip int, data binary")


def head(spec: GridSpec, epsg: int, big: bool, wkt: str | None = None, transform: tuple[float, ...] | None = None) -> bytes:
    """Everything before the pixels; strips follow without gaps. ``transform``: x of the upper left corner, x per column,
    x per row, y of the corner, y per column, y per row; by default that of the grid, from the top down."""
    per = rows_per_strip(spec)
    n = -(-spec.gy // per)
    sizes = [4 * spec.gx * min(per, spec.gy - k * per) for k in range(n)]
    word, at_kind = (8, LONG8) if big else (4, LONG)
    keys = [1, 1, 0, 1, 1025, 0, 1, 1]  # raster type: pixel is area
    if epsg:
        geographic = 4000 <= epsg < 5000
        keys[3] = 3
        keys += [1024, 0, 1, 2 if geographic else 1, 2048 if geographic else 3072, 0, 1, epsg]
        keys[4:] = [1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg]
    x0, xc, xr, y0, yc, yr = transform or (spec.min_x, spec.dx, 0.0, spec.min_y + spec.gy * spec.dy, 0.0, -spec.dy)
    place = [(33550, DOUBLE, [xc, -yr, 0.0]), (33922, DOUBLE, [0.0, 0.0, 0.0, x0, y0, 0.0])]
    if xr or yc or xc < 0 or yr > 0:
        place = [(34264, DOUBLE, [xc, xr, 0.0, x0, yc, yr, 0.0, y0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])]
    fields: list[tuple[int, tuple[int, int], list]] = [
        (256, LONG, [spec.gx]), (257, LONG, [spec.gy]), (258, SHORT, [32]), (259, SHORT, [1]), (262, SHORT, [1]),
        (273, at_kind, [0] * n), (277, SHORT, [1]), (278, LONG, [per]), (279, at_kind, sizes), (339, SHORT, [3]),
        *place,
        (34735, SHORT, keys), (42113, ASCII, list(f"{NODATA}\0".encode())),
    ]
    if wkt:
        fields.insert(-1, (34737, ASCII, list(wkt.encode() + b"|\0")))
    code = {SHORT: "H", LONG: "I", DOUBLE: "d", ASCII: "B", LONG8: "Q"}
    start = 16 if big else 8
    table = (8 + 20 * len(fields) + 8) if big else (2 + 12 * len(fields) + 4)
    extra_at = start + table
    extra = sum(-(-len(v) * k[1] // 8) * 8 for _, k, v in fields if len(v) * k[1] > word)
    data_at, at = extra_at + extra, 0
    offsets = []
    for s in sizes:
        offsets.append(data_at + at)
        at += s
    if not big and data_at + at > 0xFFFFFFFF:
        raise ValueError("the raster needs BigTIFF")
    fields[5] = (273, at_kind, offsets)
    out = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)
    out += struct.pack("<Q" if big else "<H", len(fields))
    tail, pos = b"", extra_at
    for tag, kind, values in fields:
        raw = struct.pack(f"<{len(values)}{code[kind]}", *values)
        out += struct.pack("<HHQ" if big else "<HHI", tag, kind[0], len(values))
        if len(raw) <= word:
            out += raw.ljust(word, b"\0")
        else:
            out += struct.pack("<Q" if big else "<I", pos)
            raw = raw.ljust(-(-len(raw) // 8) * 8, b"\0")
            tail += raw
            pos += len(raw)
    return out + struct.pack("<Q" if big else "<I", 0) + tail


def strip_sizes(spec: GridSpec) -> list[int]:
    per = rows_per_strip(spec)
    return [4 * spec.gx * min(per, spec.gy - k * per) for k in range(-(-spec.gy // per))]


def write_geotiff(nodes: DataFrame, spec: GridSpec, measure: str, path: str, epsg: int = 0, big: bool = True, wkt: str | None = None, transform: tuple[float, ...] | None = None, shared: bool = False) -> None:
    """Strips are packed by the executors. They are streamed to the file in order, one partition at a time; where ``path`` is
    on a file system that all executors share (``shared``), each task puts its strips at their places itself, since the size of
    every strip is known, and nothing but the head passes through the driver."""
    if epsg < 0:
        raise ValueError("EPSG codes are positive")
    top, sizes, packed = head(spec, epsg, big, wkt, transform), strip_sizes(spec), strips(nodes, spec, measure)
    every = nodes.sparkSession.range(len(sizes)).select(F.col("id").cast("int").alias("strip"))
    packed = every.join(packed, "strip", "left")  # strips without a populated node are written too
    blank = lambda k: np.full(sizes[k] // 4, NODATA, "<f4").tobytes()
    if not shared:
        with open(path, "wb") as f:
            f.write(top)
            for r in packed.orderBy("strip").toLocalIterator():
                f.write(r["data"] if r["data"] is not None else blank(r["strip"]))
        return
    full, start, plain = 4 * spec.gx * rows_per_strip(spec), len(top), sizes[-1]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "r+b") as f:
            for b in batches:
                for k, data in zip(b.column("strip").to_pylist(), b.column("data").to_pylist()):
                    f.seek(start + k * full)
                    f.write(data if data is not None else np.full((plain if k == last else full) // 4, NODATA, "<f4").tobytes())
                yield b.select(["strip"])

    last = len(sizes) - 1
    with open(path, "wb") as f:
        f.write(top)
        f.truncate(start + sum(sizes))
    packed.mapInArrow(put, "strip int").write.format("noop").mode("overwrite").save()


def read_geotiff(path: str) -> tuple[np.ndarray, dict[int, tuple]]:
    """(rows from the top, tags) of a file that this module wrote."""
    with open(path, "rb") as f:
        data = f.read()
    big = data[2] == 43
    kinds = {k[0]: (c, k[1]) for k, c in ((SHORT, "H"), (LONG, "I"), (DOUBLE, "d"), (ASCII, "B"), (LONG8, "Q"))}
    at = struct.unpack_from("<Q" if big else "<I", data, 8 if big else 4)[0]
    n = struct.unpack_from("<Q" if big else "<H", data, at)[0]
    at += 8 if big else 2
    tags: dict[int, tuple] = {}
    for _ in range(n):
        tag, kind, count = struct.unpack_from("<HHQ" if big else "<HHI", data, at)
        c, size = kinds[kind]
        where = at + (12 if big else 8)
        if count * size > (8 if big else 4):
            where = struct.unpack_from("<Q" if big else "<I", data, where)[0]
        tags[tag] = struct.unpack_from(f"<{count}{c}", data, where)
        at += 20 if big else 12
    parts: Iterable[bytes] = (data[a : a + s] for a, s in zip(tags[273], tags[279]))
    return np.frombuffer(b"".join(parts), "<f4").reshape(tags[257][0], tags[256][0]), tags
