"""Reports over a corpus: which anomalies each track has, days of its segments, and counts of it all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import motion, temporal
from .correction import PARTITION


def anomalies(temporal_counts: DataFrame, motion_counts: DataFrame) -> DataFrame:
    """track_id, tag, n: the labels that a track has at all, as temporal.<tag> and motion.<flag>."""
    one = lambda df, group, names: df.select("track_id", F.explode(F.array(*(F.struct(F.lit(f"{group}.{c}").alias("tag"), F.col(c).alias("n")) for c in names))).alias("x")).select("track_id", "x.*")
    return one(temporal_counts, "temporal", temporal.TAGS).union(one(motion_counts, "motion", motion.FLAGS)).filter("n > 0")


def segment_days(ranges: DataFrame) -> DataFrame:
    """For each segment the UTC days of its least and greatest time."""
    day = lambda c: F.date_format(F.timestamp_millis(F.col(c)), "yyyy-MM-dd")
    return ranges.select("track_id", "trk_seg_index", day("min_ms").alias("first_day"), day("max_ms").alias("last_day"))


def corpus_summary(counts: DataFrame, found: DataFrame, log: DataFrame) -> DataFrame:
    """One row: tracks, clean ones, ones with anomalies, of several segments, in which correction dropped or excluded points, in which it
    lost or doubled a point (partition_failures), and with other errors."""
    odd = found.groupBy("track_id").agg(F.lit(True).alias("odd"))
    acted = log.filter("entry in ('drop', 'excluded')").groupBy("track_id").agg(F.lit(True).alias("acted"))
    torn = F.coalesce(F.col("kind").startswith(PARTITION), F.lit(False))
    failed = log.filter("entry = 'error'").groupBy("track_id").agg(F.max(F.when(torn, True)).alias("torn"), F.max(F.when(~torn, True)).alias("failed"))
    out = counts.select("track_id", "multi_segment").join(odd, "track_id", "left").join(acted, "track_id", "left").join(failed, "track_id", "left")
    return out.agg(
        F.count("*").alias("tracks"), F.count_if(F.col("odd").isNull()).alias("clean"), F.count("odd").alias("with_anomalies"), F.count_if("multi_segment").alias("multi_segment"),
        F.count("acted").alias("acted"), F.count("torn").alias("partition_failures"), F.count("failed").alias("failed"))


def correction_summary(log: DataFrame) -> DataFrame:
    """For each track: points left, dropped and excluded, proposals, applied ones, and rearrangements."""
    count = lambda c: F.count_if(c)
    e = F.col("entry")
    return log.groupBy("track_id").agg(
        count(e == "working").alias("working"), count(e == "drop").alias("drops"), count(e == "excluded").alias("excluded"), count(e == "proposal").alias("proposals"),
        count((e == "proposal") & (F.col("stage") == "applied")).alias("applied"), count(e == "rearrangement").alias("rearrangements"))
