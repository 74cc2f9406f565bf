"""Grid geometry, measures and parameters."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Measures in the order in which they are reported, and the column that holds each of them.
MEASURES = {"min": "zmin", "max": "zmax", "mean": "zmean", "idw": "zidw", "den": "den", "std": "zstd"}
#: The value that stands for "no data" in raster files; inside the engine it is NULL.
NODATA = -9999
DEFAULT_RESOLUTION = 6.0
WEIGHT_POWER = 2


def float32(x: float) -> float:
    """A parameter as single precision keeps it: 0.1 becomes 0.10000000149..."""
    return struct.unpack("<f", struct.pack("<f", x))[0]


def default_radius(dx: float) -> float:
    """Half a diagonal over two cells; depends on the spacing in x alone."""
    return math.sqrt(2.0) * dx


def pick_measures(names: list[str] | None = None) -> list[str]:
    """The measures asked for, in reporting order; none asked for means all."""
    names = [n for n in names or [] if n != "all"] if "all" not in (names or []) else []
    unknown = [n for n in names if n not in MEASURES]
    if unknown:
        raise ValueError(f"unknown measures: {', '.join(unknown)}")
    return [m for m in MEASURES if m in names] if names else list(MEASURES)


@dataclass(frozen=True)
class GridSpec:
    """Nodes (i, j) at (min_x + i * dx, min_y + j * dy); nodes are lattice corners, not cell centres."""

    min_x: float
    min_y: float
    max_x: float
    max_y: float
    dx: float = DEFAULT_RESOLUTION
    dy: float = DEFAULT_RESOLUTION

    def __post_init__(self) -> None:
        if not (self.dx > 0 and self.dy > 0):
            raise ValueError("spacing must be positive")
        if self.max_x < self.min_x or self.max_y < self.min_y:
            raise ValueError("extent is empty")

    @property
    def gx(self) -> int:
        return math.ceil((self.max_x - self.min_x) / self.dx) + 1

    @property
    def gy(self) -> int:
        return math.ceil((self.max_y - self.min_y) / self.dy) + 1

    @property
    def nodes(self) -> int:
        return self.gx * self.gy

    @classmethod
    def from_bbox(cls, bbox: tuple[float, float, float, float], dx: float, dy: float | None = None) -> GridSpec:
        """bbox: min_x, min_y, max_x, max_y, each minimum below its maximum."""
        x0, y0, x1, y1 = bbox
        if not (x0 < x1 and y0 < y1):
            raise ValueError("bbox must be min_x min_y max_x max_y with each minimum below its maximum")
        return cls(x0, y0, x1, y1, dx, dx if dy is None else dy)

    @classmethod
    def from_points(cls, points: DataFrame, dx: float, dy: float | None = None) -> GridSpec:
        """The extent of the data: one aggregation, four numbers to the driver."""
        e = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        if e[0] is None:
            raise ValueError("no points")
        return cls(e[0], e[1], e[2], e[3], dx, dx if dy is None else dy)

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        return self.min_x, self.min_y, self.max_x, self.max_y
