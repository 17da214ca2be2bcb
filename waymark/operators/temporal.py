"""Timestamp labels of accepted points, over the whole stream of a track (never reset at a segment)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import usable

TAGS = ("missing", "unparsable", "adjacent_duplicate", "below_anchor", "below_prev_valid", "non_adjacent_repeat")


def stream():
    """The window of a track in stream order. Segments are numbered along the stream, so this order serves windows of segments too:
    a table sorted by it is not sorted again for either."""
    return Window.partitionBy("track_id").orderBy("trk_seg_index", "gpx_index")


def labels(points: DataFrame) -> DataFrame:
    """points with the six TAGS, anchor_ms (the greatest time before), depth_ms below it, first_gpx (first point of the same time)."""
    t, g = F.col("time_ms"), F.col("gpx_index")
    absent = F.coalesce("time_absent", t.isNull())
    out = points.withColumns({
        "anchor_ms": F.max("time_ms").over(stream().rowsBetween(Window.unboundedPreceding, -1)),
        "_prev_gpx": F.lag("gpx_index").over(stream()),
        "_prev_ms": F.lag("time_ms").over(stream()),
        "first_gpx": F.when(t.isNotNull(), F.min("gpx_index").over(Window.partitionBy("track_id", "time_ms"))),
    })
    follows = F.col("_prev_gpx") == g - 1
    flag = lambda c: F.coalesce(c, F.lit(False))
    out = out.withColumns({
        "missing": flag(absent), "unparsable": flag(~absent & t.isNull()),
        "adjacent_duplicate": flag(follows & (t == F.col("_prev_ms"))),
        "below_anchor": flag(t < F.col("anchor_ms")),
        "below_prev_valid": flag(follows & (t < F.col("_prev_ms"))),
    })
    out = out.withColumn("non_adjacent_repeat", flag((F.col("first_gpx") < g) & ~F.col("adjacent_duplicate")))
    return out.withColumn("depth_ms", F.when(F.col("below_anchor"), F.col("anchor_ms") - t)).drop("_prev_gpx", "_prev_ms")


def annotations(labelled: DataFrame) -> DataFrame:
    """The points that have a tag, with the list of their tags."""
    tags = F.array_compact(F.array(*(F.when(F.col(t), F.lit(t)) for t in TAGS)))
    return labelled.withColumn("tags", tags).filter(F.size("tags") > 0)


def tag_counts(labelled: DataFrame) -> DataFrame:
    """One row for each track: counts of the tags, of times, and the session's length (last time less first time, perhaps negative)."""
    timed = F.when(F.col("time_ms").isNotNull(), F.col("gpx_index"))
    span = F.max_by("time_ms", timed) - F.min_by("time_ms", timed)
    return labelled.groupBy("track_id").agg(*(F.count_if(t).alias(t) for t in TAGS), F.count("time_ms").alias("parseable"), (span / 1000).alias("session_sec"))


def tag_index(labelled: DataFrame) -> DataFrame:
    """track_id, tag, gpx_index: one row for each tag of each point."""
    pairs = F.array(*(F.when(F.col(t), F.lit(t)) for t in TAGS))
    return labelled.select("track_id", F.explode(F.array_compact(pairs)).alias("tag"), "gpx_index")


def segment_pairs(points: DataFrame) -> DataFrame:
    """For each segment its usable times and the pairs of following ones (points without a usable time are passed over)."""
    seg = Window.partitionBy("track_id", "trk_seg_index").orderBy("gpx_index")
    timed = points.filter(usable("time_ms")).withColumn("prev", F.lag("time_ms").over(seg))
    up = F.coalesce(F.col("time_ms") > F.col("prev"), F.lit(False))
    return timed.groupBy("track_id", "trk_seg_index").agg(
        F.count("*").alias("parseable"), F.count("prev").alias("pairs"), F.count_if(up).alias("positive_pairs"), F.count_if(F.col("time_ms") <= F.col("prev")).alias("violations"))


def segment_summary(labelled: DataFrame) -> DataFrame:
    """One row for each segment: counts of the tags, and segment_pairs()."""
    tags = labelled.groupBy("track_id", "trk_seg_index").agg(*(F.count_if(t).alias(t) for t in TAGS))
    out = tags.join(segment_pairs(labelled), ["track_id", "trk_seg_index"], "left")
    return out.fillna(0, ["parseable", "pairs", "positive_pairs", "violations"]).withColumn("any_positive", F.col("positive_pairs") > 0)


def rollup(labelled: DataFrame) -> DataFrame:
    """Counts of the tags by segment and by track (trk_seg_index null, level 1) in one aggregation."""
    out = labelled.rollup("track_id", "trk_seg_index").agg(F.grouping_id().cast("long").alias("level"), *(F.count_if(t).alias(t) for t in TAGS))
    return out.filter("level < 3")
