"""Faults of an export: steps back inside a segment, and gaps, overlaps and misorder between the segments of one track element."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MS_PER_HOUR, haversine_m, scaled_round

MISSING_CHUNK_MS, ZONE_TOLERANCE = 30 * 60_000, 0.1


def intra_segment(raw: DataFrame) -> DataFrame:
    """Every step back in the list of a segment's known times; position counts those times."""
    seg = Window.partitionBy("track_id", "trk_seg_index").orderBy("gpx_index")
    timed = raw.filter("time_ms is not null").withColumns({"position": (F.row_number().over(seg) - 1).cast("long"), "preceding_ms": F.lag("time_ms").over(seg)})
    return timed.filter("time_ms < preceding_ms").select("track_id", "trk_seg_index", "position", "preceding_ms", F.col("time_ms").alias("violating_ms"))


def inter_segment(summaries: DataFrame, missing_ms: int = MISSING_CHUNK_MS, tolerance: float = ZONE_TOLERANCE) -> DataFrame:
    """Faults between neighbouring segments of one track element: type, severity, confidence, gap_ms and what belongs to the type."""
    order = Window.partitionBy("track_id", "track_index").orderBy("trk_seg_index")
    nxt = {f"next_{c}": F.lead(c).over(order) for c in ("trk_seg_index", "first_ms", "last_ms", "first_lat", "first_lon")}
    pairs = summaries.withColumns(nxt).filter("last_ms is not null and next_first_ms is not null").withColumn("gap_ms", F.col("next_first_ms") - F.col("last_ms"))
    back = F.abs("gap_ms") / MS_PER_HOUR
    hours = F.round(back)
    gap = F.col("gap_ms")
    overlap = (F.col("next_first_ms") < F.col("last_ms")) & (F.col("next_last_ms") > F.col("first_ms"))
    kind = (
        F.when((gap < 0) & (hours >= 1) & (F.abs(back - hours) < tolerance), "timestamp_discontinuity_fault").when((gap < 0) & overlap, "duplicate_chunk_fault")
        .when(gap < 0, "chunk_ordering_fault").when(gap > missing_ms, "missing_chunk_fault"))
    pairs = pairs.withColumn("type", kind).filter("type is not null")
    by_type = lambda **v: F.coalesce(*(F.when(F.col("type") == f"{k}_fault", F.lit(x)) for k, x in v.items()))
    far = F.round(haversine_m("last_lat", "last_lon", "next_first_lat", "next_first_lon"))
    missing = F.col("type") == "missing_chunk_fault"
    return pairs.select(
        "track_id", "track_index", F.col("trk_seg_index").alias("from_seg"), F.col("next_trk_seg_index").alias("to_seg"), "type",
        by_type(timestamp_discontinuity="medium", duplicate_chunk="critical", chunk_ordering="critical", missing_chunk="high").alias("severity"),
        by_type(timestamp_discontinuity=0.9, duplicate_chunk=0.95, chunk_ordering=1.0, missing_chunk=0.85).alias("confidence"), "gap_ms",
        F.when(F.col("type") == "timestamp_discontinuity_fault", hours.cast("long")).alias("offset_hours"),
        F.when(F.col("type") == "duplicate_chunk_fault", F.least("last_ms", "next_last_ms")).alias("overlap_end_ms"),
        F.when(missing, far).alias("implied_m"), F.when(missing, scaled_round(far / 1000 / (gap / MS_PER_HOUR), 1)).alias("implied_kph"))


def all_faults(raw: DataFrame, summaries: DataFrame) -> DataFrame:
    """Both kinds of faults; columns that a kind lacks are null."""
    inner = intra_segment(raw).withColumn("type", F.lit("intra_segment_fault"))
    return inner.unionByName(inter_segment(summaries), allowMissingColumns=True)
