"""Audit and correction documents: one JSON text for each track, written and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correction, elevation, ingestion, motion, phases, presegment, sampling, spine, temporal

AUDIT_VERSION, CORRECTION_VERSION = "2.0.0", "1.0.0"


def _packed(df: DataFrame, name: str, *order: str) -> DataFrame:
    """track_id and the rest of a one-row-a-track table as a struct, or with order of a table as a sorted list of structs."""
    rest = [c for c in df.columns if c != "track_id"]
    if not order:
        return df.select("track_id", F.struct(*rest).alias(name))
    first = F.struct(*order, *(c for c in rest if c not in order))
    return df.groupBy("track_id").agg(F.sort_array(F.collect_list(first)).alias(name))


def _tags(labelled: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """For each track the sorted indexes of the points of every tag."""
    return labelled.groupBy("track_id").agg(*(F.sort_array(F.collect_list(F.when(F.col(t), F.col("gpx_index")))).alias(t) for t in tags))


def _joined(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "track_id", "left"), parts)


def audit_documents(raw: DataFrame, structure: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """track_id, document: the audit of every track of raw points.

    structure: segments (also empty ones), waypoints and routes, as gpx.structure() gives them; files: track_id, file_name of the sources.
    """
    points = ingestion.accepted(raw)
    labelled, steps, heights = temporal.labels(points), sampling.edges(points), elevation.labels(points)
    flagged = motion.pair_flags(steps)
    time, far = sampling.time_deltas(steps), sampling.distance_deltas(steps)
    parts = [
        _packed(ingestion.counts(raw, structure), "counts"), _packed(ingestion.segment_boundaries(points), "segment_boundaries", "trk_seg_index"),
        _packed(ingestion.segment_summaries(raw, structure), "segment_summaries", "trk_seg_index"), _packed(ingestion.rejections(raw), "rejections", "gpx_index"),
        _packed(temporal.tag_counts(labelled), "temporal_counts"), _packed(_tags(labelled, temporal.TAGS), "temporal_index"), _packed(temporal.segment_summary(labelled), "temporal_segments", "trk_seg_index"),
        _packed(temporal.annotations(labelled).select("track_id", "gpx_index", "trk_seg_index", "tags", "depth_ms", "first_gpx"), "temporal_annotations", "gpx_index"),
        _packed(sampling.context(points, steps), "sampling_context"), _packed(sampling.stats(time, "dt_sec"), "time_stats"), _packed(sampling.stats(far, "dd_m"), "distance_stats"),
        _packed(sampling.clusters(time, "dt_sec"), "time_clusters", "ordinal"), _packed(sampling.cluster_counts(time, "dt_sec"), "time_cluster_counts"),
        _packed(sampling.clusters(far, "dd_m"), "distance_clusters", "ordinal"), _packed(sampling.cluster_counts(far, "dd_m"), "distance_cluster_counts"), _packed(sampling.segment_stats(points, steps), "sampling_segments", "from_seg"),
        _packed(motion.tag_counts(flagged), "motion_counts"), _packed(motion.annotations(flagged), "motion_annotations", "from_gpx"), _packed(motion.segment_counts(points, flagged), "motion_segments", "trk_seg_index"),
        _packed(elevation.counts(heights), "elevation_counts"), _packed(_tags(heights, elevation.TAGS), "elevation_index"), _packed(elevation.counts(heights, "trk_seg_index"), "elevation_segments", "trk_seg_index")]
    if files is not None:
        parts.append(files.select("track_id", "file_name"))
    name = F.col("file_name") if files is not None else F.lit(None).cast("string")
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    numbers = ("total", "valid", "rejected", "segments", "waypoints", "routes")
    flags = ("has_any_time", "has_waypoints", "has_routes", "multi_segment")
    group = lambda *names, **renamed: F.struct(*names, *(F.col(v).alias(k) for k, v in renamed.items()))
    body = F.struct(
        F.struct(
            F.lit(AUDIT_VERSION).alias("schema_version"), now.alias("generated_at_utc"), F.struct(name.alias("file_name")).alias("source"),
            F.struct(F.col("counts.total").alias("total_point_count")).alias("summary")).alias("metadata"),
        F.struct(
            F.struct(
                F.struct(*(F.col(f"counts.{c}") for c in numbers)).alias("counts"), F.struct(*(F.col(f"counts.{c}") for c in flags)).alias("context"),
                "segment_boundaries", "segment_summaries", "rejections").alias("ingestion"),
            group(counts="temporal_counts", tag_index="temporal_index", per_segment="temporal_segments", annotations="temporal_annotations").alias("temporal"),
            group("time_stats", "distance_stats", "time_clusters", "time_cluster_counts", "distance_clusters", "distance_cluster_counts", context="sampling_context", per_segment="sampling_segments").alias("sampling"),
            group(counts="motion_counts", annotations="motion_annotations", per_segment="motion_segments").alias("motion"),
            group(counts="elevation_counts", tag_index="elevation_index", per_segment="elevation_segments").alias("elevation")).alias("audit"))
    return _joined(parts).select("track_id", F.to_json(body).alias("document"))


def correction_documents(log: DataFrame, points: DataFrame) -> DataFrame:
    """track_id, document: the correction of every track, from its log and its accepted points.

    What the audit labels decide before the first pass (participation, classes of boundaries, spines) is made from the points, residual
    diagnostics from the trusted points in their final order.
    """

    def some(entry: str, *columns: str) -> Column:
        row = F.struct("seq", *columns)
        return F.sort_array(F.collect_list(F.when(F.col("entry") == entry, row)))

    lists = {
        "drops": some("drop", "gpx_index", "kind", "stage"), "excluded_from_trust": some("excluded", "gpx_index", "kind", "stage", "details"), "annotations": some("annotation", "trk_seg_index", "kind", "stage", "details"),
        "rearrangements": some("rearrangement", "trk_seg_index", "kind", "stage", "details"), "proposals": some("proposal", "gpx_index", "trk_seg_index", "kind", "stage", "details"),
        "pass_log": some("pass", "trk_seg_index", "kind", "details"), "segment_profiles": some("profile", "trk_seg_index", "kind", "stage", "details"), "full_ordered_points": F.transform(some("working", "gpx_index"), lambda r: r["gpx_index"])}
    by_track = log.groupBy("track_id").agg(*(c.alias(k) for k, c in lists.items()))
    final = correction.trusted_points(log, points)
    trusted = _packed(final, "canonical_trusted_points", "position")
    staged = log.filter("entry = 'proposal' and stage like '%edge%'").select("track_id", "seq", "gpx_index", "trk_seg_index", "kind", "stage", "details")
    skipped = log.filter("entry = 'proposal' and kind like '%block%'").select("track_id", "seq", "gpx_index", "trk_seg_index", F.col("stage").alias("resolution"))
    coupled = log.filter("entry = 'proposal' and stage = 'coupling_blocked'").select("track_id", "seq", "gpx_index", "trk_seg_index")
    more = {
        "participation": _packed(presegment.participation_without_audit(points), "participation"),
        "boundary_classes": _packed(presegment.boundaries(ingestion.segment_boundaries(points)), "boundary_classes", "from_seg"),
        "spine_intervals": _packed(spine.intervals(points), "spine_intervals", "trk_seg_index"),
        "residual_diagnostics": _packed(phases.residuals(final, "position"), "residual_diagnostics", "trk_seg_index", "gpx_index"),
        "same_time_groups": _packed(phases.same_time(final), "same_time_groups", "trk_seg_index", "time_ms"),
        "staged_edge_proposals": _packed(staged, "staged_edge_proposals", "seq"), "block_resolution": _packed(skipped, "block_resolution", "seq"),
        "coupled_proposals": _packed(coupled, "coupled_proposals", "seq")}
    proof = _packed(correction.partition(log), "partition_invariant")
    head = F.struct(F.lit(CORRECTION_VERSION).alias("schema_version")).alias("metadata")
    return _joined([by_track, trusted, proof, *more.values()]).select("track_id", F.to_json(F.struct(head, *lists, *more, "canonical_trusted_points", "partition_invariant")).alias("document"))


def safe_name(track_id: Column) -> Column:
    return F.regexp_replace(track_id.cast("string"), "[^a-zA-Z0-9_-]", "_")


def file_name(track_id: Column) -> Column:
    """The sanitised id and a hash of the id itself: ids that look alike once sanitised have different names."""
    return F.concat(safe_name(track_id), F.lit("-"), F.lower(F.hex(F.xxhash64(track_id.cast("string")))))


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64(F.col("track_id").cast("string")), F.lit(n)).cast("int").alias("bucket")


def write_documents(docs: DataFrame, path: str, buckets: int = 64) -> None:
    """Documents as JSON lines (track_id, name, document) in as many folders as there are buckets, however many tracks there are."""
    rows = docs.select("track_id", file_name(F.col("track_id")).alias("name"), "document", _bucket(buckets))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """track_id (as text), name, value (JSON) of written documents; fields are reached with get_json_object or from_json."""
    return spark.read.schema("track_id string, name string, document string").json(path).select("track_id", "name", F.col("document").alias("value"))


def write_deltas(deltas: DataFrame, path: str, buckets: int = 64) -> None:
    """Time or distance steps (or both) as JSON lines with the name of their track, in as many folders as there are buckets."""
    deltas.withColumn("track", file_name(F.col("track_id"))).withColumn("bucket", _bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)
