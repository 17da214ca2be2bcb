"""Track points derived from the `events` table, the same in Spark and in SQL.

A track is a user. Late events, reversed and swapped stretches, repeated points, bad coordinates, missing and unreadable times and
elevations are made from event_id by arithmetic, so that every label occurs. 25 points are a segment, two segments a track element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ingestion

SEGMENT = 25

#: SQL (DuckDB) of the relations `raw` (all points) and `pts` (accepted points), to follow WITH.
SQL = """
bnd_e as (
  select event_id, epoch_us(ts) as us, user_id, event_type, value, cast(json_extract_string(props, '$.k') as double) as k,
    unnest(case when event_id % 40 = 7 then [0, 1] else [0] end) as copy from events),
bnd_o as (
  select *, row_number() over (partition by user_id order by
    case when user_id % 13 = 0 then -event_id else event_id + case when event_id % 17 < 2 then 1000 else 0 end end, event_id, copy) - 1 as g0 from bnd_e),
bnd_q as (
  select *, row_number() over (partition by user_id order by case when user_id % 11 = 3 and g0 // 25 < 2 then 1 - g0 // 25 else g0 // 25 end, g0) - 1 as g from bnd_o),
raw as (
  select user_id as track_id, cast(g as bigint) as gpx_index, cast(g // 25 as int) as trk_seg_index, cast(g // 50 as int) as track_index,
    case when event_id % 53 = 0 then null when event_id % 37 = 0 then 95.0 else 46.0 + k / 10000.0 end as lat,
    8.0 + value / 10000.0 as lon,
    case when event_type = 'signup' and event_id % 5 = 0 then null when copy = 1 and event_id % 3 = 0 then null
         when event_id % 31 = 0 or (copy = 1 and event_id % 9 = 1) then 9999.0 else round(value * 4) end as ele,
    (event_type = 'signup' and event_id % 5 = 0) or (copy = 1 and event_id % 6 = 0) as ele_absent,
    (event_id % 23 = 0) as time_absent,
    case when event_id % 23 = 0 or event_id % 29 = 0 then null
         when user_id % 3 = 0 then (us // 21600000000) * 21600000 else (us // 6000000000) * 6000000 end as time_ms
  from bnd_q),
pts as (select * from raw where lat between -90 and 90 and lon between -180 and 180),
segs as (
  select distinct track_id, trk_seg_index, track_index from raw
  union all select track_id, max(trk_seg_index) + 1, max(track_index) from raw where track_id % 4 = 1 group by track_id),
spots as (select track_id, track_id % 3 as waypoints, track_id % 2 as routes from raw group by track_id)
"""


def structure(raw: DataFrame) -> DataFrame:
    """Segments (every fourth track ends with an empty one), waypoints and routes of the tracks of raw points."""
    tracks = raw.groupBy("track_id").agg(F.max("trk_seg_index").alias("last"), F.max("track_index").alias("track_index"))
    none = F.lit(None).cast("int")
    empty = tracks.filter("track_id % 4 = 1").select("track_id", F.lit("trkseg").alias("kind"), (F.col("last") + 1).alias("trk_seg_index"), "track_index")
    kinds = F.concat(F.array_repeat(F.lit("wpt"), (F.col("track_id") % 3).cast("int")), F.array_repeat(F.lit("rte"), (F.col("track_id") % 2).cast("int")))
    spots = tracks.select("track_id", F.explode(kinds).alias("kind"), none.alias("trk_seg_index"), none.alias("track_index"))
    return ingestion.structure_of(raw).unionByName(empty).unionByName(spots)


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points: track_id, gpx_index, trk_seg_index, track_index, lat, lon, ele, ele_absent, time_absent, time_ms."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = events.select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.explode(F.when(F.col("event_id") % 40 == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    n, user = F.col("event_id"), F.col("user_id")
    late = F.when(user % 13 == 0, -n).otherwise(n + F.when(n % 17 < 2, 1000).otherwise(0))
    track = Window.partitionBy("user_id")
    e = e.withColumn("g0", F.row_number().over(track.orderBy(late, "event_id", "copy")) - 1)
    place = F.floor(F.col("g0") / SEGMENT)
    swapped = F.when((user % 11 == 3) & (place < 2), 1 - place).otherwise(place)
    e = e.withColumn("g", (F.row_number().over(track.orderBy(swapped, "g0")) - 1).cast("long"))
    no_ele = (F.col("event_type") == "signup") & (n % 5 == 0)
    again = F.col("copy") == 1
    lat = F.when(n % 53 == 0, F.lit(None)).when(n % 37 == 0, 95.0).otherwise(46.0 + F.col("k") / 10000.0)
    ele = F.when(no_ele | (again & (n % 3 == 0)), F.lit(None)).when((n % 31 == 0) | (again & (n % 9 == 1)), 9999.0).otherwise(F.round(F.col("value") * 4))
    bucket = F.when(user % 3 == 0, F.expr("us div 21600000000 * 21600000")).otherwise(F.expr("us div 6000000000 * 6000000"))
    return e.select(
        user.alias("track_id"), F.col("g").alias("gpx_index"), F.floor(F.col("g") / 25).cast("int").alias("trk_seg_index"), F.floor(F.col("g") / 50).cast("int").alias("track_index"),
        lat.alias("lat"), (8.0 + F.col("value") / 10000.0).alias("lon"), ele.alias("ele"),
        (no_ele | (again & (n % 6 == 0))).alias("ele_absent"), (n % 23 == 0).alias("time_absent"),
        F.when((n % 23 == 0) | (n % 29 == 0), F.lit(None)).otherwise(bucket).cast("long").alias("time_ms"))
