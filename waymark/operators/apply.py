"""Kinematic checks and the choice among candidates of one time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import speed_kph
from .presegment import KEYS

LENIENT_KPH = 80.0


def _over(speed: Column, limit: float) -> Column:
    """Faster than the limit; a speed that is not a number (a step back in time) is not."""
    return F.coalesce((speed > limit) & ~F.isnan(speed), F.lit(False))


def kinematic_check(candidates: DataFrame, limit: float = LENIENT_KPH) -> DataFrame:
    """candidates (lat, lon, time_ms and p_, n_ of the same) with speed_prev, speed_next, score, passed, fail_reason."""
    prev = F.when(F.col("p_time_ms").isNotNull(), speed_kph("p_lat", "p_lon", F.col("p_time_ms"), "lat", "lon", F.col("time_ms")))
    nxt = F.when(F.col("n_time_ms").isNotNull(), speed_kph("lat", "lon", F.col("time_ms"), "n_lat", "n_lon", F.col("n_time_ms")))
    out = candidates.withColumn("speed_prev", prev).withColumn("speed_next", nxt)
    a, b = F.col("speed_prev"), F.col("speed_next")
    none = a.isNull() & b.isNull()
    fast_a, fast_b = _over(a, limit), _over(b, limit)
    reason = F.when(none, "no_bracket").when(fast_a & fast_b, "both_exceeded").when(fast_a, "speed_prev_exceeded").when(fast_b, "speed_next_exceeded")
    score = F.when(~none, F.coalesce(a * a, F.lit(0.0)) + F.coalesce(b * b, F.lit(0.0)))
    return out.withColumn("score", score).withColumn("passed", ~none & ~fast_a & ~fast_b).withColumn("fail_reason", reason)


def insert_candidates(inserts: DataFrame, points: DataFrame) -> DataFrame:
    """One row for each candidate of the inserts that are no exact group, with the points of its bracket."""
    spot = points.select("track_id", "gpx_index", "lat", "lon", "time_ms")
    one = inserts.filter("not is_exact").select(*KEYS, "key", F.size("members").alias("n"), F.explode("members").alias("gpx_index"), "prev_gpx", "next_gpx")
    out = one.join(spot, ["track_id", "gpx_index"])
    for p, c in (("p", "prev_gpx"), ("n", "next_gpx")):
        out = out.join(spot.toDF("track_id", c, f"{p}_lat", f"{p}_lon", f"{p}_time_ms"), ["track_id", c], "left")
    return out


def competition_winners(checked: DataFrame) -> DataFrame:
    """Of the candidates of one group (two or more): those that pass before those that fail, then the least score (unknown and
    not-a-number last), then the least index."""
    score = F.when(F.isnan("score") | F.col("score").isNull(), F.lit(float("inf"))).otherwise(F.col("score"))
    order = Window.partitionBy("track_id", "key").orderBy(F.desc("passed"), score, "gpx_index")
    won = checked.filter("n >= 2").withColumn("_r", F.row_number().over(order))
    everyone = won.groupBy("track_id", "key").agg((~F.bool_or("passed")).alias("all_failed"))
    return won.filter("_r = 1").join(everyone, ["track_id", "key"]).select(*KEYS, "key", F.col("gpx_index").alias("winner"), "n", "all_failed")
