"""From raw points to accepted points: validity, counts, boundaries and summaries of segments.

Raw points: track_id, gpx_index, trk_seg_index, track_index, lat, lon (null if not a number), ele, ele_absent, time_absent, time_ms.
Structure: track_id, kind (trkseg, wpt or rte), trk_seg_index, track_index: a row for each segment, also an empty one, waypoint and route.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_A_NUMBER, OUT_OF_RANGE = "not_a_number", "out_of_range"


def rejection_reason(lat: str = "lat", lon: str = "lon") -> Column:
    """Why a point's coordinates are refused; null if they are valid. The bounds themselves are valid."""
    lat, lon = F.col(lat), F.col(lon)
    unknown = lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon)
    return F.when(unknown, NOT_A_NUMBER).when(~(lat.between(-90, 90) & lon.between(-180, 180)), OUT_OF_RANGE)


def accepted(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def rejections(raw: DataFrame) -> DataFrame:
    """track_id, gpx_index, trk_seg_index, reason_code of every refused point."""
    return raw.select("track_id", "gpx_index", "trk_seg_index", rejection_reason().alias("reason_code")).filter("reason_code is not null")


def structure_of(raw: DataFrame) -> DataFrame:
    """The structure of points that come without a scan of segments: the segments that have points."""
    return raw.groupBy("track_id", "trk_seg_index").agg(F.first("track_index").alias("track_index")).select("track_id", F.lit("trkseg").alias("kind"), "trk_seg_index", "track_index")


def counts(raw: DataFrame, structure: DataFrame | None = None) -> DataFrame:
    """One row for each track, also one without a point: points found, accepted and rejected, segments, waypoints, routes, and context flags."""
    good = rejection_reason().isNull()
    found = raw.groupBy("track_id").agg(
        F.count("*").alias("total"), F.count_if(good).alias("valid"), F.count_if(~good).alias("rejected"),
        F.coalesce(F.bool_or(F.when(good, ~F.col("time_absent"))), F.lit(False)).alias("has_any_time"))
    parts = (structure_of(raw) if structure is None else structure).groupBy("track_id").agg(
        *(F.count_if(F.col("kind") == kind).alias(name) for kind, name in (("trkseg", "segments"), ("wpt", "waypoints"), ("rte", "routes"))))
    numbers = ["total", "valid", "rejected", "segments", "waypoints", "routes"]
    return found.join(parts, "track_id", "full").fillna(0, numbers).select(
        "track_id", *numbers, F.coalesce("has_any_time", F.lit(False)).alias("has_any_time"), (F.col("waypoints") > 0).alias("has_waypoints"), (F.col("routes") > 0).alias("has_routes"),
        (F.col("segments") > 1).alias("multi_segment"))


def segment_boundaries(points: DataFrame) -> DataFrame:
    """For each segment of accepted points its first and last index and time (as they are, perhaps null) and its least and greatest time."""
    return points.groupBy("track_id", "trk_seg_index").agg(
        F.min("gpx_index").alias("first_gpx"), F.max("gpx_index").alias("last_gpx"),
        F.min_by("time_ms", "gpx_index").alias("first_ms"), F.max_by("time_ms", "gpx_index").alias("last_ms"),
        F.min("time_ms").alias("min_ms"), F.max("time_ms").alias("max_ms"))


def _segments(structure: DataFrame) -> DataFrame:
    return structure.filter("kind = 'trkseg'").select("track_id", "trk_seg_index", "track_index")


def segment_summaries(raw: DataFrame, structure: DataFrame | None = None) -> DataFrame:
    """For each segment (with structure also an empty one) of all points its counts and its first, last, least and greatest usable time; the coordinates of the first and
    the last point that has a usable time and valid coordinates."""
    timed = F.when(F.col("time_ms").isNotNull(), F.col("gpx_index"))
    placed = F.when(F.col("time_ms").isNotNull() & rejection_reason().isNull(), F.col("gpx_index"))
    spot = F.struct("lat", "lon")
    out = raw.groupBy("track_id", "trk_seg_index").agg(
        F.first("track_index").alias("track_index"), F.count("*").alias("point_count"), F.count("time_ms").alias("usable_time_count"),
        F.min_by("time_ms", timed).alias("first_ms"), F.max_by("time_ms", timed).alias("last_ms"), F.min("time_ms").alias("min_ms"), F.max("time_ms").alias("max_ms"),
        F.min_by(spot, placed).alias("a"), F.max_by(spot, placed).alias("b"))
    if structure is not None:
        out = _segments(structure).join(out.drop("track_index"), ["track_id", "trk_seg_index"], "left").fillna(0, ["point_count", "usable_time_count"])
    return out.select("*", F.col("a.lat").alias("first_lat"), F.col("a.lon").alias("first_lon"), F.col("b.lat").alias("last_lat"), F.col("b.lon").alias("last_lon")).drop("a", "b")


def segment_times(raw: DataFrame, structure: DataFrame | None = None) -> DataFrame:
    """For each segment the list of its usable times in order; a segment is part of one recording."""
    spot = F.when(F.col("time_ms").isNotNull(), F.struct("gpx_index", "time_ms"))
    out = raw.groupBy("track_id", "trk_seg_index").agg(F.transform(F.sort_array(F.collect_list(spot)), lambda x: x["time_ms"]).alias("times"))
    if structure is None:
        return out
    return _segments(structure).select("track_id", "trk_seg_index").join(out, ["track_id", "trk_seg_index"], "left").withColumn("times", F.coalesce("times", F.array().cast("array<bigint>")))
