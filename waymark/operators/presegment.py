"""Correction before segments are worked on: participation, boundary classes, objective drops, idleness, reversal and chunk order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MS_PER_HOUR, same_utc_day, usable

def in_segment():
    """The window of a segment in stream order."""
    return Window.partitionBy("track_id", "trk_seg_index").orderBy("gpx_index")


KEYS = ["track_id", "trk_seg_index"]
MIN_COVERAGE, ZONE_TOLERANCE = 0.8, 0.1
#: Reasons and kinds as the output documents name them (fixed values).
CROSS_DUPLICATE, EXACT_DUPLICATE, DUPLICATE_CHUNK, REVERSAL_MEMBER = "cross_segment_duplicate", "adjacent-exact-duplicate", "duplicate_chunk_segment", "reversal_unconfirmed_member"


def _mode(parseable: Column, positive: Column, coverage: Column, reversed_: Column | None = None, least: float = MIN_COVERAGE) -> Column:
    geometry = (parseable == 0) | (~positive if reversed_ is None else ~positive & ~reversed_)
    out = F.when(geometry, "geometry-only")
    out = out if reversed_ is None else out.when(reversed_, "fully-reversed")
    return out.when(coverage < least, "timestamp-sparse").otherwise("full")


def participation(context: DataFrame, least: float = MIN_COVERAGE) -> DataFrame:
    """For each track its mode and the share of timed pairs that go forward; context is that of the sampling audit."""
    coverage = F.when(F.col("timed_pairs") > 0, F.col("positive") / F.col("timed_pairs")).otherwise(0.0)
    mode = _mode(F.col("timestamped_points"), F.col("positive") > 0, coverage, least=least or MIN_COVERAGE)
    reason = F.when(F.col("timestamped_points") == 0, "no-parseable-timestamps").when(F.col("positive") == 0, "all-timestamps-uniform").when(coverage < (least or MIN_COVERAGE), "insufficient-pair-coverage")
    return context.select("track_id", mode.alias("mode"), coverage.alias("coverage"), reason.alias("reason"))


def immediate_pairs(points: DataFrame) -> DataFrame:
    """For each segment the pairs of usable times of rows next to each other (a row without one breaks the chain)."""
    t = F.when(usable("time_ms"), F.col("time_ms"))
    out = points.withColumn("_t", t).withColumn("_p", F.lag("_t").over(in_segment()))
    return out.groupBy(*KEYS).agg(
        F.count("_t").alias("parseable"), F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("pairs"),
        F.count_if(F.col("_t") > F.col("_p")).alias("positive_pairs"), F.count_if(F.col("_t") < F.col("_p")).alias("falling_pairs"))


def participation_without_audit(points: DataFrame, least: float = MIN_COVERAGE) -> DataFrame:
    """participation() from the points alone: the sums of immediate_pairs() over a track's segments."""
    near = immediate_pairs(points).groupBy("track_id").agg(F.sum("parseable").alias("timestamped_points"), F.sum("pairs").alias("timed_pairs"), F.sum("positive_pairs").alias("positive"))
    return participation(near, least)


def segment_profiles(summary: DataFrame, points: DataFrame, least: float = MIN_COVERAGE) -> DataFrame:
    """For each segment mode, coverage and flags; summary is that of the timestamp audit."""
    near = immediate_pairs(points).select(*KEYS, F.col("pairs").alias("_near"), "falling_pairs")
    falling = (F.col("parseable") >= 2) & (F.col("_near") >= 1) & (F.col("falling_pairs") == F.col("_near"))
    coverage = F.when(F.col("pairs") > 0, F.col("positive_pairs") / F.col("pairs")).otherwise(0.0)
    anomalies = F.greatest("below_anchor", "below_prev_valid", "non_adjacent_repeat", "adjacent_duplicate") > 0
    return summary.join(near, KEYS).select(
        *KEYS, _mode(F.col("parseable"), F.col("any_positive"), coverage, falling, least or MIN_COVERAGE).alias("mode"), anomalies.alias("has_anomalies"),
        (F.col("parseable") >= 2).alias("has_usable_times"), coverage.alias("coverage"), falling.alias("is_fully_reversed"))


def boundaries(ranges: DataFrame, tolerance: float = ZONE_TOLERANCE) -> DataFrame:
    """For each pair of neighbouring segments its class, gap and suspected offset; ranges are segment_boundaries() or segment_summaries()."""
    order = Window.partitionBy("track_id").orderBy("trk_seg_index")
    nxt = {f"n_{c}": F.lead(c).over(order) for c in ("trk_seg_index", "first_ms", "min_ms", "max_ms")}
    both = ranges.withColumns(nxt).filter("n_trk_seg_index is not null").withColumn("gap_ms", F.col("n_first_ms") - F.col("last_ms"))
    gap = F.col("gap_ms")
    back = -gap / MS_PER_HOUR
    hours = F.round(back)
    zone = (gap < 0) & (hours >= 1) & (F.abs(back - hours) <= tolerance)
    overlap = F.coalesce((F.col("n_min_ms") < F.col("max_ms")) & (F.col("n_max_ms") > F.col("min_ms")), F.lit(False))
    kind = (
        F.when(zone, "timestamp_discontinuity").when((gap < 0) & overlap, "duplicate_chunk").when(gap < 0, "chunk_ordering")
        .when((gap > 0) & same_utc_day(F.col("last_ms"), F.col("n_first_ms")), "same_day").when(gap > 0, "cross_day"))
    return both.select(
        "track_id", F.col("trk_seg_index").alias("from_seg"), F.col("n_trk_seg_index").alias("to_seg"), kind.alias("classification"), F.coalesce(gap > 0, F.lit(False)).alias("is_gap"),
        "gap_ms", F.when(zone, hours.cast("long")).alias("offset_hours"))


def cross_segment_duplicates(points: DataFrame) -> DataFrame:
    """Points of one time in two segments or more, but for two points that end one segment and begin the next."""
    order = Window.partitionBy("track_id").orderBy("trk_seg_index")
    ends = points.groupBy(*KEYS).agg(F.min("gpx_index").alias("_first"), F.max("gpx_index").alias("_last")).withColumn("_next_first", F.lead("_first").over(order))
    pairs = ends.select("track_id", F.col("_last").alias("lo"), F.col("_next_first").alias("hi"))
    groups = points.filter(usable("time_ms")).groupBy("track_id", "time_ms").agg(
        F.count("*").alias("n"), F.min("gpx_index").alias("lo"), F.max("gpx_index").alias("hi"), F.min("trk_seg_index").alias("_a"), F.max("trk_seg_index").alias("_b")).filter("_a < _b")
    seams = groups.filter("n = 2").join(pairs, ["track_id", "lo", "hi"], "left_semi").select("track_id", "time_ms")
    hit = groups.join(seams, ["track_id", "time_ms"], "left_anti").select("track_id", "time_ms")
    return points.join(hit, ["track_id", "time_ms"], "left_semi").select("track_id", "gpx_index", "time_ms")


def ele_class(ele: Column, absent: Column, floor: float = -500.0, ceiling: float = 9500.0) -> Column:
    return F.when(F.coalesce(absent, F.lit(False)) | ele.isNull() | F.isnan(ele), "absent").when((ele < floor) | (ele > ceiling), "oob").otherwise("usable")


def objective_pairs(points: DataFrame) -> DataFrame:
    """Neighbours (by index, in one segment) equal in time and place: keep, drop, action. Actions: drop, drop_clear (the survivor's
    elevation is cleared), mismatch (both stay), none (absent beside out of bounds)."""
    prev = {f"p_{c}": F.lag(c).over(in_segment()) for c in ("gpx_index", "time_ms", "lat", "lon", "ele", "ele_absent")}
    same = (F.col("gpx_index") == F.col("p_gpx_index") + 1) & usable("time_ms") & (F.col("time_ms") == F.col("p_time_ms")) & (F.col("lat") == F.col("p_lat")) & (F.col("lon") == F.col("p_lon"))
    out = points.withColumns(prev).filter(same)
    out = out.withColumn("pe", ele_class(F.col("p_ele"), F.col("p_ele_absent"))).withColumn("ce", ele_class(F.col("ele"), F.col("ele_absent")))
    both = F.concat_ws("/", "pe", "ce")
    action = (
        F.when((both == "usable/usable") & (F.col("p_ele") != F.col("ele")), "mismatch").when(both == "oob/oob", "drop_clear")
        .when(both.isin("absent/oob", "oob/absent"), "none").otherwise("drop"))
    later = both.isin("absent/usable", "oob/usable")
    return out.select(
        *KEYS, F.when(later, F.col("gpx_index")).otherwise(F.col("p_gpx_index")).alias("keep"),
        F.when(later, F.col("p_gpx_index")).otherwise(F.col("gpx_index")).alias("other"), action.alias("action"))


def apply_objective(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """points without the dropped ones; a survivor of two elevations out of bounds has none."""
    drops = pairs.filter("action in ('drop', 'drop_clear')").select("track_id", F.col("other").alias("gpx_index")).distinct()
    clear = pairs.filter("action = 'drop_clear'").select("track_id", F.col("keep").alias("gpx_index"), F.lit(True).alias("_clear")).distinct()
    out = points.join(drops, ["track_id", "gpx_index"], "left_anti").join(clear, ["track_id", "gpx_index"], "left")
    return out.withColumn("ele", F.when(F.col("_clear"), F.lit(None)).otherwise(F.col("ele"))).select(*points.columns)


def split_times(points: DataFrame) -> DataFrame:
    """Segments that have points of one usable time at different places."""
    groups = points.filter(usable("time_ms")).groupBy(*KEYS, "time_ms").agg(((F.min("lat") != F.max("lat")) | (F.min("lon") != F.max("lon"))).alias("split"))
    return groups.filter("split").select(*KEYS).distinct()


def idle_segments(summary: DataFrame, points: DataFrame) -> DataFrame:
    """For each segment of the audit whether there is nothing to correct, by its labels and its present points."""
    clean = (F.col("below_anchor") == 0) & (F.col("below_prev_valid") == 0) & (F.col("non_adjacent_repeat") == 0) & (F.col("positive_pairs") == F.col("pairs"))
    split = split_times(points).withColumn("_split", F.lit(True))
    return summary.join(split, KEYS, "left").select(*KEYS, (clean & F.col("_split").isNull()).alias("idle"))


def _falling(points: DataFrame) -> DataFrame:
    """For each segment: usable times, whether they fall strictly from one to the next, and their range."""
    timed = points.filter(usable("time_ms")).withColumn("_p", F.lag("time_ms").over(in_segment()))
    falls = timed.groupBy(*KEYS).agg(F.count_if(F.col("time_ms") >= F.col("_p")).alias("_up"), F.min("time_ms").alias("lo"), F.max("time_ms").alias("hi"))
    every = points.groupBy(*KEYS).agg(F.count("*").alias("n"))
    return every.join(falls, KEYS, "left").withColumn("falls", F.coalesce(F.col("_up") == 0, F.lit(True))).drop("_up")


def global_reversal(points: DataFrame) -> DataFrame:
    """For each track whether its points, all reversed, have nothing to correct: every segment's times rise and no time is split."""
    split = split_times(points).withColumn("_split", F.lit(True))
    out = _falling(points).join(split, KEYS, "left")
    return out.groupBy("track_id").agg(F.bool_and(F.col("falls") & F.col("_split").isNull()).alias("accepted"))


def segment_reversals(points: DataFrame, profiles: DataFrame) -> DataFrame:
    """For each fully reversed segment of two points or more: whether it rises once reversed, fits its neighbours' ranges, and is accepted.
    A reversal leaves a segment's range as it was, so all segments can be judged at once."""
    order = Window.partitionBy("track_id").orderBy("trk_seg_index")
    out = _falling(points).withColumn("_before", F.lag("hi").over(order)).withColumn("_after", F.lead("lo").over(order))
    fits = F.coalesce(F.col("lo") >= F.col("_before"), F.lit(True)) & F.coalesce(F.col("hi") <= F.col("_after"), F.lit(True))
    rev = profiles.filter("is_fully_reversed").select(*KEYS)
    out = out.join(rev, KEYS, "left_semi").filter("n >= 2")
    return out.select(*KEYS, F.col("falls").alias("monotonic"), fits.alias("seam_ok"), (F.col("falls") & fits).alias("accepted"))


def chunk_order(classes: DataFrame, summaries: DataFrame) -> DataFrame:
    """For each segment beside a chunk_ordering boundary: its slot and the slot it moves to (by its least time, unknown ones last)."""
    at = classes.filter("classification = 'chunk_ordering'")
    touched = at.select("track_id", F.col("from_seg").alias("trk_seg_index")).union(at.select("track_id", "to_seg")).distinct()
    track = Window.partitionBy("track_id")
    met = touched.join(summaries.select(*KEYS, "min_ms"), KEYS, "left")
    return met.select(
        *KEYS, F.row_number().over(track.orderBy("trk_seg_index")).cast("long").alias("slot"),
        F.row_number().over(track.orderBy(F.asc_nulls_last("min_ms"), "trk_seg_index")).cast("long").alias("new_slot"))


def reorder_chunks(points: DataFrame, order: DataFrame) -> DataFrame:
    """points with position: segments moved into each other's slots, the others where they are."""
    slots = order.select("track_id", F.col("slot").alias("new_slot"), F.col("trk_seg_index").alias("_place"))
    to = order.join(slots, ["track_id", "new_slot"]).select(*KEYS, "_place")
    track = Window.partitionBy("track_id")
    out = points.join(to, KEYS, "left").withColumn("_place", F.coalesce("_place", "trk_seg_index"))
    return out.withColumn("position", (F.row_number().over(track.orderBy("_place", "gpx_index")) - 1).cast("long")).drop("_place")


def duplicate_chunk_points(points: DataFrame, classes: DataFrame) -> DataFrame:
    """The points of segments that repeat the one before, which are dropped."""
    later = classes.filter("classification = 'duplicate_chunk'").select("track_id", F.col("to_seg").alias("trk_seg_index")).distinct()
    return points.join(later, KEYS, "left_semi").select("track_id", "gpx_index", F.lit(DUPLICATE_CHUNK).alias("reason"))


def boundary_annotations(classes: DataFrame) -> DataFrame:
    """Annotations that boundaries alone give: timestamp_discontinuity and segment_boundary_gap, on the later segment."""
    kind = F.when(F.col("classification") == "timestamp_discontinuity", "timestamp_discontinuity").when(F.col("is_gap"), "segment_boundary_gap")
    return classes.select("track_id", F.col("to_seg").alias("trk_seg_index"), kind.alias("kind"), F.col("from_seg"), "gap_ms", "offset_hours").filter("kind is not null")
