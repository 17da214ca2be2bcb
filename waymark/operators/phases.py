"""After the segments: seams between them, what is left over, the trusted points and the proof that nothing is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import usable
from .presegment import KEYS
from .spine import spine


def seam_duplicates(points: DataFrame, order: str = "gpx_index") -> DataFrame:
    """Where the last point of a segment equals the first of the next (time, place, elevation): keep, drop and whether both are on a spine."""
    ele = F.when(~F.coalesce("ele_absent", F.lit(False)), F.col("ele"))
    spot = F.struct("gpx_index", "time_ms", "lat", "lon", ele.alias("e"))
    ends = points.groupBy(*KEYS).agg(F.min_by(spot, order).alias("a"), F.max_by(spot, order).alias("b"), F.min(order).alias("_at"))
    pair = ends.withColumns({"c": F.lead("a").over(Window.partitionBy("track_id").orderBy("_at")), "to_seg": F.lead("trk_seg_index").over(Window.partitionBy("track_id").orderBy("_at"))})
    same = usable("b.time_ms") & (F.col("b.time_ms") == F.col("c.time_ms")) & (F.col("b.lat") == F.col("c.lat")) & (F.col("b.lon") == F.col("c.lon")) & F.col("b.e").eqNullSafe(F.col("c.e"))
    pair = pair.filter(same).select("track_id", F.col("trk_seg_index").alias("from_seg"), "to_seg", F.col("b.gpx_index").alias("keep"), F.col("c.gpx_index").alias("drop"))
    on = spine(points, order).select("track_id", F.col("gpx_index").alias("keep"), F.lit(True).alias("_k"))
    pair = pair.join(on, ["track_id", "keep"], "left").join(on.toDF("track_id", "drop", "_d"), ["track_id", "drop"], "left")
    return pair.select("track_id", "from_seg", "to_seg", "keep", "drop", (F.col("_k").isNotNull() & F.col("_d").isNotNull()).alias("stable"))


def residuals(points: DataFrame, order: str = "gpx_index") -> DataFrame:
    """Points whose time is not after the usable one before in their segment."""
    seg = Window.partitionBy(*KEYS).orderBy(order)
    timed = points.filter(usable("time_ms")).withColumns({"prev_gpx": F.lag("gpx_index").over(seg), "prev_ms": F.lag("time_ms").over(seg)})
    return timed.filter("time_ms <= prev_ms").select(*KEYS, "gpx_index", "prev_gpx", "prev_ms", "time_ms", (F.col("time_ms") - F.col("prev_ms")).alias("delta_ms"))


def residual_segments(left: DataFrame) -> DataFrame:
    return left.groupBy(*KEYS).agg(F.count("*").alias("violations"))


def same_time(points: DataFrame) -> DataFrame:
    """Groups of points of one time in one segment."""
    out = points.filter(usable("time_ms")).groupBy(*KEYS, "time_ms").agg(F.count("*").alias("n"), F.min("gpx_index").alias("first_gpx"), F.max("gpx_index").alias("last_gpx"))
    return out.filter("n >= 2")


def cross_segment_same_time(points: DataFrame) -> DataFrame:
    """Groups of points of one time in two segments or more."""
    out = points.filter(usable("time_ms")).groupBy("track_id", "time_ms").agg(F.count("*").alias("n"), F.count_distinct("trk_seg_index").alias("segments"))
    return out.filter("segments >= 2")


def coverage(working: DataFrame, drops: DataFrame, excluded: DataFrame) -> DataFrame:
    """For each track that has points left: segments, points, trusted, dropped and excluded ones."""
    keys = ["track_id", "gpx_index"]
    left = working.join(excluded.select(*keys).distinct().withColumn("_x", F.lit(True)), keys, "left").groupBy("track_id").agg(
        F.count_distinct("trk_seg_index").alias("segments"), F.count("*").alias("_n"), F.count_if(F.col("_x").isNull()).alias("trusted"))
    d = drops.groupBy("track_id").agg(F.count_distinct("gpx_index").alias("dropped"))
    e = excluded.groupBy("track_id").agg(F.count_distinct("gpx_index").alias("excluded"))
    out = left.join(d, "track_id", "left").join(e, "track_id", "left").fillna(0, ["dropped", "excluded"])
    return out.select("track_id", "segments", (F.col("_n") + F.col("dropped")).alias("total_points"), "trusted", "dropped", "excluded")


def trusted(working: DataFrame, excluded: DataFrame, order: str = "gpx_index") -> DataFrame:
    """The points left that are not excluded from trust."""
    keys = ["track_id", "gpx_index"]
    return working.join(excluded.select(*keys).distinct(), keys, "left_anti").select("track_id", "gpx_index", "trk_seg_index", "lat", "lon", "ele", "time_ms", order)


def partition_report(ingested: DataFrame, working: DataFrame, drops: DataFrame, excluded: DataFrame) -> DataFrame:
    """For each track the sizes of its parts and whether every point is in exactly one of dropped, excluded and trusted."""
    keys = ["track_id", "gpx_index"]
    mark = lambda df, c: df.select(*keys).distinct().withColumn(c, F.lit(True))
    every = mark(ingested, "i").join(mark(working, "w"), keys, "full").join(mark(drops, "d"), keys, "full").join(mark(excluded, "x"), keys, "full")
    has = lambda c: F.col(c).isNotNull()
    wrong = (has("d") & has("x")) | (has("d") & has("w")) | (has("x") & ~has("w")) | (has("d") == has("w")) | ~has("i")
    return every.groupBy("track_id").agg(
        F.count_if(has("i")).alias("ingested"), F.count_if(has("d")).alias("drops"), F.count_if(has("x")).alias("excluded"), F.count_if(has("w")).alias("working"),
        F.count_if(has("w") & ~has("x")).alias("trusted"), (F.count_if(wrong) == 0).alias("ok"))
