"""All measures of a node in one pass: one hash aggregation, combined on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import MEASURES, pick_measures


def _idw(order: str | None) -> Column:
    """Sum of z / d2 over sum of 1 / d2; a point on the node itself decides alone: the first by ``order``, else the lowest."""
    w = F.when(F.col("d2") > 0, 1 / F.col("d2"))
    on = F.col("d2") == 0
    exact = F.min_by(F.when(on, F.col("z")), F.when(on, F.col(order))) if order else F.min(F.when(on, F.col("z")))
    return F.coalesce(exact, F.sum(F.col("z") * w) / F.sum(w))


def _idw_legacy() -> Column:
    """The same with weights of the fourth power for points whose node lies up and right of them (residual d2 used
    as a distance there); kept for comparison with rasters made that way. Needs column ``up_right``."""
    w = F.when(F.col("d2") > 0, F.when(F.col("up_right"), 1 / (F.col("d2") * F.col("d2"))).otherwise(1 / F.col("d2")))
    return F.coalesce(F.min(F.when(F.col("d2") == 0, F.col("z"))), F.sum(F.col("z") * w) / F.sum(w))


def node_measures(contributions: DataFrame, measures: list[str] | None = None, order: str | None = None, legacy_idw: bool = False, by: Sequence[Column] = ()) -> DataFrame:
    """(i, j, measures..., filled): one row per node that any point reaches; others are absent.

    ``order`` names a long column that says which of several points on one node comes first. std is the population
    standard deviation, den the number of points within the radius.
    """
    make = {
        "min": lambda: F.min("z"),
        "max": lambda: F.max("z"),
        "mean": lambda: F.avg("z"),
        "idw": lambda: _idw_legacy() if legacy_idw else _idw(order),
        "den": lambda: F.count(F.lit(1)),
        "std": lambda: F.stddev_pop("z"),
    }
    return contributions.groupBy(*by, "i", "j").agg(*[make[m]().alias(MEASURES[m]) for m in pick_measures(measures)])
