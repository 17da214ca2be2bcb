"""Seeded synthetic tracks, for tests and trials of scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE_MS = 1_000_000


def _chance(salt: int) -> Column:
    """A number in [0, 1) of a row."""
    return F.pmod(F.xxhash64(F.lit(salt), "track_id", "gpx_index"), F.lit(1 << 40)) / F.lit(float(1 << 40))


def tracks(spark: SparkSession, n: int, points: int = 60, segments: int = 3, seed: int = 1) -> DataFrame:
    """n tracks: 5 % of the times missing, 10 % repeated, 10 % up to 5 s back, the rest up to 1 s forward; 2 % of the places far off; 30 %
    of the elevations missing."""
    rows = spark.range(n * points).select(F.floor(F.col("id") / points).alias("track_id"), (F.col("id") % points).alias("gpx_index"))
    rows = rows.withColumn("trk_seg_index", F.floor(F.col("gpx_index") * segments / points).cast("int"))
    kind = _chance(seed)
    step = F.when(kind < 0.1, 0).when(kind < 0.2, -_chance(seed + 1) * 5000).otherwise(1 + _chance(seed + 1) * 1000).cast("long")
    so_far = Window.partitionBy("track_id").orderBy("gpx_index")
    far = F.when(_chance(seed + 2) < 0.02, 1.0).otherwise(0.0)
    no_ele = _chance(seed + 4) < 0.3
    out = rows.withColumn("_t", F.lit(BASE_MS) + F.sum(step).over(so_far))
    return out.select(
        "track_id", "gpx_index", "trk_seg_index", F.lit(0).alias("track_index"), (47.0 + F.col("gpx_index") * 1e-5 + far).alias("lat"), (8.0 + F.floor(_chance(seed + 3) * 3) * 1e-5).alias("lon"),
        F.when(~no_ele, F.floor(_chance(seed + 5) * 50) + 500.0).alias("ele"), no_ele.alias("ele_absent"), (_chance(seed + 6) < 0.05).alias("time_absent"), F.when(_chance(seed + 6) >= 0.05, F.col("_t")).alias("time_ms"))
