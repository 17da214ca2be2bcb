"""Flags of steps between points that follow one another: what keeps a speed from being known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import valid_distance

FLAGS = ("time_unresolvable", "backward_time", "zero_time_delta", "non_finite_distance", "ele_unresolvable")
ELE_FLOOR, ELE_CEILING = -500.0, 9500.0


def _ele_ok(c: str, floor: float, ceiling: float) -> Column:
    return F.coalesce(F.col(c).between(floor, ceiling), F.lit(False))


def pair_flags(steps: DataFrame, floor: float = ELE_FLOOR, ceiling: float = ELE_CEILING) -> DataFrame:
    """steps with the five FLAGS and dt_sec."""
    unknown = F.col("from_ms").isNull() | F.col("to_ms").isNull()
    return steps.withColumns({
        "time_unresolvable": unknown, "backward_time": F.coalesce(F.col("dt_ms") < 0, F.lit(False)), "zero_time_delta": F.coalesce(F.col("dt_ms") == 0, F.lit(False)),
        "non_finite_distance": ~valid_distance(), "ele_unresolvable": ~(_ele_ok("from_ele", floor, ceiling) & _ele_ok("to_ele", floor, ceiling)), "dt_sec": F.col("dt_ms") / 1000})


def annotations(flagged: DataFrame) -> DataFrame:
    """The steps that have a flag, with the list of their flags; the distance only where the time is unknown."""
    flags = F.array_compact(F.array(*(F.when(F.col(f), F.lit(f)) for f in FLAGS)))
    out = flagged.withColumn("flags", flags).filter(F.size("flags") > 0)
    return out.select("track_id", "from_gpx", "to_gpx", "flags", F.when(F.col("backward_time"), F.col("dt_sec")).alias("dt_sec"), F.when(F.col("time_unresolvable"), F.col("dd_m")).alias("dd_m"))


def tag_counts(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("track_id").agg(F.count("*").alias("pairs"), *(F.count_if(f).alias(f) for f in FLAGS))


def segment_counts(points: DataFrame, flagged: DataFrame) -> DataFrame:
    """By segment: pairs that end in it, and flags of the pairs that start in it. Tracks of one point have no rows."""
    keys = ["track_id", "trk_seg_index"]
    longer = points.groupBy("track_id").count().filter("count > 1").select("track_id")
    segments = points.select(*keys).distinct().join(longer, "track_id", "left_semi")
    ends = flagged.groupBy("track_id", F.col("to_seg").alias("trk_seg_index")).agg(F.count("*").alias("pairs"))
    starts = flagged.groupBy("track_id", F.col("from_seg").alias("trk_seg_index")).agg(*(F.count_if(f).alias(f) for f in FLAGS))
    return segments.join(ends, keys, "left").join(starts, keys, "left").fillna(0, ["pairs", *FLAGS])
