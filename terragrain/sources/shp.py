"""Polygons of a shapefile (.shp), as segments."""

from __future__ import annotations

import struct

from ..operators.polygon import Segment, segments_of

POLYGON = 5


def parse_polygons(data: bytes) -> list[Segment]:
    """Every ring of every record. Raises ValueError for anything but a shapefile of plain polygons."""
    if len(data) < 100 or struct.unpack_from(">i", data, 0)[0] != 9994:
        raise ValueError("not a shapefile")
    if struct.unpack_from("<i", data, 32)[0] != POLYGON:
        raise ValueError("only polygon shapefiles are supported")
    rings, at = [], 100
    while at + 8 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        at += 8
        if struct.unpack_from("<i", data, at)[0] == POLYGON:
            parts, points = struct.unpack_from("<2i", data, at + 36)
            first = list(struct.unpack_from(f"<{parts}i", data, at + 44)) + [points]
            xy = struct.unpack_from(f"<{2 * points}d", data, at + 44 + 4 * parts)
            pts = list(zip(xy[::2], xy[1::2]))
            rings += [pts[a:b] for a, b in zip(first, first[1:])]
        at += size
    return segments_of(rings)


def read_polygons(path: str) -> list[Segment]:
    with open(path, "rb") as f:
        return parse_polygons(f.read())


def polygon_bytes(records: list[list[list[tuple[float, float]]]]) -> bytes:
    """A .shp file of the given records, each a list of rings; for tests and examples."""
    body = b""
    every = [p for r in records for ring in r for p in ring]
    box = lambda ps: struct.pack("<4d", min(p[0] for p in ps), min(p[1] for p in ps), max(p[0] for p in ps), max(p[1] for p in ps))
    for n, rings in enumerate(records, 1):
        pts = [p for ring in rings for p in ring]
        starts, at = [], 0
        for ring in rings:
            starts.append(at)
            at += len(ring)
        rec = struct.pack("<i", POLYGON) + box(pts) + struct.pack("<2i", len(rings), len(pts)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        body += struct.pack(">2i", n, len(rec) // 2) + rec
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i", 1000, POLYGON) + box(every) + struct.pack("<4d", 0, 0, 0, 0)
    return head + body
