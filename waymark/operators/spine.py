"""The spine of a segment: its strictly rising times that no other point of the segment shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import usable
from .presegment import KEYS


def spine(points: DataFrame, order: str = "gpx_index") -> DataFrame:
    """Spine points: a kept time is always the greatest so far, so the walk is one running maximum."""
    same = Window.partitionBy(*KEYS, "time_ms")
    before = Window.partitionBy(*KEYS).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    alone = points.filter(usable("time_ms")).withColumn("_n", F.count("*").over(same)).filter("_n = 1")
    kept = alone.withColumn("_top", F.max("time_ms").over(before)).filter("_top is null or time_ms > _top")
    return kept.drop("_n", "_top")


def envelopes(points: DataFrame, order: str = "gpx_index") -> DataFrame:
    """For each segment the range of its spine; nulls for a segment without one."""
    env = spine(points, order).groupBy(*KEYS).agg(F.min("time_ms").alias("env_min"), F.max("time_ms").alias("env_max"))
    return points.select(*KEYS).distinct().join(env, KEYS, "left")


def intervals(points: DataFrame, order: str = "gpx_index") -> DataFrame:
    """For each segment its spine as a list of points in order, and its envelope."""
    rows = spine(points, order).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("time_ms", "gpx_index"))).alias("spine"))
    return envelopes(points, order).join(rows, KEYS, "left")
