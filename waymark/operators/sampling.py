"""Time and distance steps between points that follow one another in the stream, their statistics and their clusters."""

from __future__ import annotations

from collections.abc import Iterable
from heapq import heappop, heappush, heappushpop

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import haversine_m
from .temporal import stream

#: A step joins a cluster if it differs from the cluster's median by less than this share.
ALPHA = 0.02


def edges(points: DataFrame) -> DataFrame:
    """track_id, from_gpx, to_gpx, from_seg, to_seg, dt_ms, dd_m, both_ele_ok and the times and elevations of both ends."""
    prev = {f"from_{c}": F.lag(c).over(stream()) for c in ("gpx_index", "trk_seg_index", "time_ms", "lat", "lon", "ele")}
    out = points.withColumns(prev).filter(F.col("from_gpx_index") == F.col("gpx_index") - 1)
    return out.select(
        "track_id", F.col("from_gpx_index").alias("from_gpx"), F.col("gpx_index").alias("to_gpx"), F.col("from_trk_seg_index").alias("from_seg"), F.col("trk_seg_index").alias("to_seg"),
        F.col("from_time_ms").alias("from_ms"), F.col("time_ms").alias("to_ms"), (F.col("time_ms") - F.col("from_time_ms")).alias("dt_ms"),
        haversine_m("from_lat", "from_lon", "lat", "lon").alias("dd_m"), F.col("from_ele"), F.col("ele").alias("to_ele"))


def valid_distance() -> Column:
    return F.col("dd_m").isNotNull() & ~F.isnan("dd_m") & (F.col("dd_m") >= 0) & (F.col("dd_m") < float("inf"))


def time_deltas(steps: DataFrame) -> DataFrame:
    """The steps that go forward in time, in seconds."""
    return steps.filter("dt_ms > 0").select("track_id", "from_gpx", "to_gpx", "from_seg", (F.col("dt_ms") / 1000).alias("dt_sec"))


def distance_deltas(steps: DataFrame) -> DataFrame:
    return steps.filter(valid_distance()).select("track_id", "from_gpx", "to_gpx", "from_seg", "dd_m")


def time_distance_pairs(steps: DataFrame) -> DataFrame:
    """Steps that go forward in time and have a distance, with both."""
    return steps.filter((F.col("dt_ms") > 0) & valid_distance()).select("track_id", "from_gpx", "to_gpx", (F.col("dt_ms") / 1000).alias("dt_sec"), "dd_m")


def nonpositive_steps(steps: DataFrame) -> DataFrame:
    return steps.filter("dt_ms <= 0").select("track_id", "from_gpx", "to_gpx", "dt_ms")


def context(points: DataFrame, steps: DataFrame) -> DataFrame:
    """For each track: points with a time, adjacent pairs, pairs with two times, forward, zero and backward pairs, refused distances."""
    base = points.groupBy("track_id").agg(F.count("time_ms").alias("timestamped_points"))
    pairs = steps.groupBy("track_id").agg(
        F.count("*").alias("adjacent_pairs"), F.count("dt_ms").alias("timed_pairs"), F.count_if(F.col("dt_ms") > 0).alias("positive"), F.count_if(F.col("dt_ms") == 0).alias("zero"),
        F.count_if(F.col("dt_ms") < 0).alias("negative"), F.count_if(~valid_distance()).alias("rejected_distances"), F.count_if((F.col("dt_ms") > 0) & valid_distance()).alias("time_conditioned"))
    counts = ["adjacent_pairs", "timed_pairs", "positive", "zero", "negative", "rejected_distances", "time_conditioned"]
    return base.join(pairs, "track_id", "left").fillna(0, counts)


def stats(deltas: DataFrame, value: str, *by: str) -> DataFrame:
    """count, least, greatest and median value by the columns given."""
    return deltas.groupBy("track_id", *by).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.median(value).alias("median"))


def segment_stats(points: DataFrame, steps: DataFrame) -> DataFrame:
    """Time and distance statistics by segment; a step belongs to the segment it starts in."""
    segments = points.select("track_id", F.col("trk_seg_index").alias("from_seg")).distinct()
    time = stats(time_deltas(steps), "dt_sec", "from_seg").toDF("track_id", "from_seg", "time_n", "time_min", "time_max", "time_median")
    far = stats(distance_deltas(steps), "dd_m", "from_seg").toDF("track_id", "from_seg", "dist_n", "dist_min", "dist_max", "dist_median")
    keys = ["track_id", "from_seg"]
    return segments.join(time, keys, "left").join(far, keys, "left").fillna(0, ["time_n", "dist_n"])


def _run_median(a: Column, start: Column, end: Column) -> Column:
    """The median of the ascending array a from start to before end (0-based)."""
    n = end - start
    return (F.get(a, start + F.floor((n - 1) / 2).cast("int")) + F.get(a, start + F.floor(n / 2).cast("int"))) / 2


def _joins(x: Column, center: Column) -> Column:
    return F.abs(x - center) / F.when(center > 0, center) < ALPHA


def sorted_runs(a: Column) -> Column:
    """Starts of the clusters of an ascending array: a value joins the running cluster if it is near its median (never if that is 0)."""
    begin = F.struct(F.lit(1).alias("i"), F.lit(0).alias("s"), F.array(F.lit(0)).alias("starts"))

    def step(acc, x):
        joins = F.coalesce(_joins(x, _run_median(a, acc["s"], acc["i"])), F.lit(False))
        return F.struct((acc["i"] + 1).alias("i"), F.when(joins, acc["s"]).otherwise(acc["i"]).alias("s"), F.when(joins, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"]))).alias("starts"))

    return F.aggregate(F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), begin, step, lambda acc: acc["starts"])


def _sequential(values: Iterable[float]) -> int:
    """How many clusters values have in their own order. The running cluster is two heaps that meet at its median, so a track of n
    steps takes n log n, not a sort of the cluster at every step."""
    k, low, high = 1, [], []
    for x in values:
        if low:
            center = (high[0] - low[0]) / 2 if len(low) == len(high) else -low[0]
            if center > 0 and not abs(x - center) / center < ALPHA:
                k, low, high = k + 1, [], []
        heappush(low, -heappushpop(high, x))
        if len(low) > len(high) + 1:
            heappush(high, -heappop(low))
    return k


def sequential_count(b: Column) -> Column:
    """How many clusters an array has in its own order; while a cluster's median is 0 everything joins it. An empty array has one."""

    @F.pandas_udf("long")
    def count(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda values: _sequential(values.tolist())).astype("int64")

    return count(b)


def _series(deltas: DataFrame, value: str) -> DataFrame:
    """For each track its values in ascending and in stream order. One track is one row: a recording, not the corpus."""
    out = deltas.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("to_gpx", value))).alias("rows"))
    return out.select("track_id", F.transform("rows", lambda r: r[value]).alias("b")).withColumn("a", F.array_sort("b"))


def clusters(deltas: DataFrame, value: str) -> DataFrame:
    """One row for each cluster of sorted values: ordinal by size (then by center), center, count, share, min, max, spread, mean and
    greatest deviation from the final center (absolute and relative) and spread over center."""
    runs = _series(deltas, value).withColumn("starts", sorted_runs(F.col("a")))
    one = runs.select("track_id", "a", F.size("a").alias("total"), F.posexplode("starts").alias("k", "s"), F.col("starts").alias("all"))
    end = F.coalesce(F.get("all", F.col("k") + 1), F.col("total"))
    one = one.withColumn("v", F.slice("a", F.col("s") + 1, end - F.col("s"))).withColumn("count", F.size("v").cast("long"))
    one = one.withColumn("center", _run_median(F.col("v"), F.lit(0), F.size("v"))).withColumn("min", F.get("v", F.lit(0))).withColumn("max", F.element_at("v", -1))
    off = F.transform("v", lambda x: F.abs(x - F.col("center")))
    center = F.when(F.col("center") > 0, F.col("center"))
    mean = F.aggregate(off, F.lit(0.0), lambda t, x: t + x) / F.col("count")
    out = one.select(
        "track_id", "k", "center", "count", (F.col("count") / F.col("total")).alias("share"), "min", "max", (F.col("max") - F.col("min")).alias("spread"),
        mean.alias("mean_abs"), F.array_max(off).alias("max_abs"), F.coalesce(mean / center, F.lit(0.0)).alias("mean_rel"), F.coalesce(F.array_max(off) / center, F.lit(0.0)).alias("max_rel"),
        F.coalesce((F.col("max") - F.col("min")) / center, F.lit(0.0)).alias("spread_over_center"))
    size = Window.partitionBy("track_id").orderBy(F.desc("count"), "k")
    return out.withColumn("ordinal", F.row_number().over(size).cast("long")).drop("k")


def cluster_counts(deltas: DataFrame, value: str) -> DataFrame:
    """For each track: values, clusters of the sorted and of the sequential pass, and their ratios."""
    s = _series(deltas, value)
    out = s.select("track_id", F.size("a").cast("long").alias("total"), F.size(sorted_runs(F.col("a"))).cast("long").alias("k_sorted"), sequential_count(F.col("b")).alias("k_sequential"))
    return out.select(
        "*", (F.col("k_sorted") / F.col("total")).alias("sorted_over_total"), (F.col("k_sequential") / F.col("total")).alias("sequential_over_total"),
        F.when(F.col("k_sorted") > 1, F.col("k_sequential") / F.col("k_sorted")).otherwise(1.0).alias("sequential_over_sorted"))


def normalization(clustered: DataFrame) -> DataFrame:
    """For each track mean and greatest deviation of its values from their clusters' centers."""
    return clustered.groupBy("track_id").agg(
        (F.sum(F.col("mean_abs") * F.col("count")) / F.sum("count")).alias("mean_abs"), F.max("max_abs").alias("max_abs"),
        (F.sum(F.col("mean_rel") * F.col("count")) / F.sum("count")).alias("mean_rel"), F.max("max_rel").alias("max_rel"))


def insertion_deviations(deltas: DataFrame, value: str) -> DataFrame:
    """For each cluster (by its place k in ascending order) mean and greatest deviation of a value from the center it met when it joined."""
    runs = _series(deltas, value).withColumn("starts", sorted_runs(F.col("a")))
    one = runs.select("track_id", "a", F.size("a").alias("total"), F.posexplode("starts").alias("k", "s"), F.col("starts").alias("all"))
    one = one.withColumn("v", F.slice("a", F.col("s") + 1, F.coalesce(F.get("all", F.col("k") + 1), F.col("total")) - F.col("s")))
    met = F.transform("v", lambda x, i: F.when(i == 0, F.struct(F.lit(0.0).alias("abs"), F.lit(0.0).alias("rel"))).otherwise(F.struct(
        F.abs(x - _run_median(F.col("v"), F.lit(0), i)).alias("abs"), (F.abs(x - _run_median(F.col("v"), F.lit(0), i)) / _run_median(F.col("v"), F.lit(0), i)).alias("rel"))))
    one = one.withColumn("m", met)
    mean = lambda f: F.aggregate("m", F.lit(0.0), lambda t, x: t + x[f]) / F.size("m")
    top = lambda f: F.array_max(F.transform("m", lambda x: x[f]))
    return one.select("track_id", F.col("k").cast("long").alias("k"), mean("abs").alias("mean_insertion_abs"), top("abs").alias("max_insertion_abs"), mean("rel").alias("mean_insertion_rel"), top("rel").alias("max_insertion_rel"))
