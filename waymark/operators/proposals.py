"""First-pass proposals over the accepted points: blocks, singletons, exact drops and groups of one time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import usable
from .presegment import KEYS, in_segment


def _ele() -> Column:
    return F.when(~F.coalesce("ele_absent", F.lit(False)), F.col("ele"))


def _edge(lo: Column, hi: Column) -> Column:
    """Whether a range touches or leaves its segment's envelope."""
    none = F.col("env_min").isNull() | F.col("env_max").isNull()
    return F.when(none, True).otherwise(F.coalesce((lo <= F.col("env_min")) | (hi >= F.col("env_max")), F.lit(False)))


def _islands(labelled: DataFrame) -> DataFrame:
    """Points below the anchor with run, a number for each unbroken run of them in a segment."""
    flag = Window.partitionBy(*KEYS, "below_anchor").orderBy("gpx_index")
    out = labelled.withColumn("run", F.row_number().over(in_segment()) - F.row_number().over(flag)).filter("below_anchor")
    return out.withColumn("_n", F.count("*").over(Window.partitionBy(*KEYS, "run")))


def blocks(labelled: DataFrame, env: DataFrame) -> DataFrame:
    """Runs of two points or more below the anchor: first, last, length, members, violation, b_min, b_max, is_edge."""
    runs = _islands(labelled).filter("_n >= 2")
    runs = runs.withColumn("_p", F.lag("time_ms").over(Window.partitionBy(*KEYS, "run").orderBy("gpx_index")))
    good = F.when(usable("time_ms"), F.col("time_ms"))
    out = runs.groupBy(*KEYS, "run").agg(
        F.min("gpx_index").alias("first_gpx"), F.max("gpx_index").alias("last_gpx"), F.count("*").alias("length"), F.sort_array(F.collect_list("gpx_index")).alias("members"),
        F.coalesce(F.bool_or(F.col("time_ms") <= F.col("_p")), F.lit(False)).alias("violation"), F.min(good).alias("b_min"), F.max(good).alias("b_max"))
    return out.join(env, KEYS).withColumn("is_edge", _edge(F.col("b_min"), F.col("b_max"))).drop("run", "env_min", "env_max")


def brackets(points: DataFrame) -> DataFrame:
    """points with prev and next: struct(gpx, ms) of the nearest usable times around them in their segment."""
    spot = F.when(usable("time_ms"), F.struct(F.col("gpx_index").alias("gpx"), F.col("time_ms").alias("ms")))
    before, after = in_segment().rowsBetween(Window.unboundedPreceding, -1), in_segment().rowsBetween(1, Window.unboundedFollowing)
    return points.withColumn("_spot", spot).withColumns({"prev": F.last("_spot", True).over(before), "next": F.first("_spot", True).over(after)}).drop("_spot")


def singletons(labelled: DataFrame, env: DataFrame) -> DataFrame:
    """Points below the anchor that are in no block: target time, bracket, is_edge."""
    alone = _islands(labelled).filter("_n = 1").filter(usable("time_ms")).select("track_id", "gpx_index")
    out = brackets(labelled).join(alone, ["track_id", "gpx_index"], "left_semi").join(env, KEYS)
    t = F.col("time_ms")
    return out.select(*KEYS, "gpx_index", t.alias("target_ms"), F.col("prev.ms").alias("t_prev"), F.col("next.ms").alias("t_next"), F.col("prev.gpx").alias("prev_gpx"), F.col("next.gpx").alias("next_gpx"), _edge(t, t).alias("is_edge"))


def exact_drops(points: DataFrame) -> DataFrame:
    """Neighbours in a segment that are equal in time, place and elevation: keep, drop."""
    own = points.withColumn("_e", _ele())
    prev = {f"p_{c}": F.lag(c).over(in_segment()) for c in ("gpx_index", "time_ms", "lat", "lon", "_e")}
    same = usable("time_ms") & (F.col("time_ms") == F.col("p_time_ms")) & (F.col("lat") == F.col("p_lat")) & (F.col("lon") == F.col("p_lon")) & F.col("_e").eqNullSafe(F.col("p__e"))
    return own.withColumns(prev).filter(same).select(*KEYS, F.col("p_gpx_index").alias("keep"), F.col("gpx_index").alias("drop"))


def same_time_groups(points: DataFrame, env: DataFrame) -> DataFrame:
    """Two points or more of one time in a segment, without those of exact_drops(): members, is_exact, bracket, is_edge.

    The bracket is that of the first member: the nearest usable point before it, and after it the first that is no
    member, which begins the next run of rows of one group.
    """
    dropped = exact_drops(points).select("track_id", F.col("drop").alias("gpx_index"), F.lit(True).alias("_dropped"))
    timed = points.filter(usable("time_ms")).join(dropped, ["track_id", "gpx_index"], "left")
    group = F.when(F.col("_dropped"), -1 - F.col("gpx_index")).otherwise(F.col("time_ms"))
    timed = timed.withColumn("_e", _ele()).withColumn("_g", group)
    timed = timed.withColumn("prev", F.lag(F.struct("gpx_index", "time_ms")).over(in_segment()))
    timed = timed.withColumn("_new", F.coalesce(F.lag("_g").over(in_segment()) != F.col("_g"), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(in_segment()))
    runs = timed.groupBy(*KEYS, "_run").agg(F.min(F.struct("gpx_index", "time_ms")).alias("_at"))
    runs = runs.withColumn("next", F.lead("_at").over(Window.partitionBy(*KEYS).orderBy("_run"))).drop("_at")
    members = timed.filter("_dropped is null")
    out = members.groupBy(*KEYS, "time_ms").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list("gpx_index")).alias("members"), F.min("gpx_index").alias("first_gpx"), (F.count_distinct(F.struct("lat", "lon", "_e")) == 1).alias("is_exact"),
        F.min_by("prev", "gpx_index").alias("prev"), F.min_by("_run", "gpx_index").alias("_run")).filter("n >= 2")
    out = out.join(runs, [*KEYS, "_run"]).join(env, KEYS)
    t = F.col("time_ms")
    return out.select(
        *KEYS, t.alias("target_ms"), "n", "members", "first_gpx", "is_exact", F.col("prev.time_ms").alias("t_prev"), F.col("next.time_ms").alias("t_next"),
        F.col("prev.gpx_index").alias("prev_gpx"), F.col("next.gpx_index").alias("next_gpx"), _edge(t, t).alias("is_edge"))


def inserts(single: DataFrame, groups: DataFrame) -> DataFrame:
    """Singletons and groups as one relation with key (kind:first point) and members."""
    one = single.select(*KEYS, F.concat(F.lit("single:"), F.col("gpx_index").cast("string")).alias("key"), F.array("gpx_index").alias("members"), F.lit(False).alias("is_exact"), "target_ms", "t_prev", "t_next", "prev_gpx", "next_gpx", "is_edge")
    many = groups.select(*KEYS, F.concat(F.lit("group:"), F.col("first_gpx").cast("string")).alias("key"), "members", "is_exact", "target_ms", "t_prev", "t_next", "prev_gpx", "next_gpx", "is_edge")
    return one.unionByName(many)
