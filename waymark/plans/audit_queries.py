"""Queries of ingestion, faults and the four audits, with the SQL (DuckDB) that each is compared with."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from ..functions.tables import written
from ..operators import elevation, faults, ingestion, motion, sampling, temporal
from . import binding

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: SQL of intermediate relations, each to follow binding.SQL and a comma.
HAVERSINE = """2 * 6371000.0 * atan2(sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)),
  sqrt(1 - (pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"""
LABELS = """
lab0 as (
  select *, max(time_ms) over (partition by track_id order by gpx_index rows between unbounded preceding and 1 preceding) as anchor_ms,
    lag(gpx_index) over (partition by track_id order by gpx_index) as pg, lag(time_ms) over (partition by track_id order by gpx_index) as pt,
    case when time_ms is not null then min(gpx_index) over (partition by track_id, time_ms) end as first_gpx from pts),
lab1 as (
  select *, time_absent as missing, not time_absent and time_ms is null as unparsable, coalesce(pg = gpx_index - 1 and time_ms = pt, false) as adjacent_duplicate,
    coalesce(time_ms < anchor_ms, false) as below_anchor, coalesce(pg = gpx_index - 1 and time_ms < pt, false) as below_prev_valid from lab0),
lab as (select *, coalesce(first_gpx < gpx_index and not adjacent_duplicate, false) as non_adjacent_repeat, case when below_anchor then anchor_ms - time_ms end as depth_ms from lab1)"""
EDGES = f"""
edge0 as (
  select track_id, gpx_index as to_gpx, trk_seg_index as to_seg, time_ms as to_ms, ele as to_ele, lat as b_lat, lon as b_lon,
    lag(gpx_index) over w as from_gpx, lag(trk_seg_index) over w as from_seg, lag(time_ms) over w as from_ms, lag(ele) over w as from_ele, lag(lat) over w as a_lat, lag(lon) over w as a_lon
  from pts window w as (partition by track_id order by gpx_index)),
edge as (select *, to_ms - from_ms as dt_ms, {HAVERSINE.format(a="a_", b="b_")} as dd_m from edge0 where from_gpx = to_gpx - 1)"""
COUNTS = ", ".join(f"count(*) filter (where {t}) as {t}" for t in temporal.TAGS)
SUMMARIES = """
summ as (
  select track_id, trk_seg_index, first(track_index) as track_index, count(*) as point_count, count(time_ms) as usable_time_count,
    arg_min(time_ms, gpx_index) filter (where time_ms is not null) as first_ms, arg_max(time_ms, gpx_index) filter (where time_ms is not null) as last_ms, min(time_ms) as min_ms, max(time_ms) as max_ms,
    arg_min(lat, gpx_index) filter (where time_ms is not null and lat between -90 and 90) as first_lat, arg_min(lon, gpx_index) filter (where time_ms is not null and lat between -90 and 90) as first_lon,
    arg_max(lat, gpx_index) filter (where time_ms is not null and lat between -90 and 90) as last_lat, arg_max(lon, gpx_index) filter (where time_ms is not null and lat between -90 and 90) as last_lon
  from raw group by track_id, trk_seg_index)"""
ELE = """
ele0 as (
  select *, ele is null and ele_absent as ele_missing, ele is null and not ele_absent as ele_unparsable, coalesce(ele < -500 or ele > 9500, false) as ele_out_of_bounds,
    case when ele between -500 and 9500 and not ele_absent then ele end as good from pts),
el as (select *, coalesce(good = lag(good) over (partition by track_id order by gpx_index), false) as ele_adjacent_duplicate from ele0)"""
ELE_COUNTS = ", ".join(f"count(*) filter (where {t}) as {t}" for t in elevation.TAGS) + ", count(*) filter (where not (ele_missing or ele_unparsable or ele_out_of_bounds)) as valid"
MOTION = """
mot as (
  select *, from_ms is null or to_ms is null as time_unresolvable, coalesce(dt_ms < 0, false) as backward_time, coalesce(dt_ms = 0, false) as zero_time_delta, dd_m is null or isnan(dd_m) as non_finite_distance,
    not (coalesce(from_ele between -500 and 9500, false) and coalesce(to_ele between -500 and 9500, false)) as ele_unresolvable, dt_ms / 1000.0 as dt_sec from edge)"""
MOTION_COUNTS = ", ".join(f"count(*) filter (where {t}) as {t}" for t in motion.FLAGS)


def sql(body: str, *parts: str) -> str:
    """A query over the bound points; parts are relations that it needs."""
    return "with recursive " + ",".join([binding.SQL, *parts]) + "\n" + body


def query(name: str, oracle: str | None):
    """Register a query under a name, with its SQL (None: none)."""

    def add(make):
        QUERIES[name] = make
        if oracle:
            ORACLE[name] = oracle
        return make

    return add


_KEPT: dict = {}


def _state(spark, sf_dir):
    """The application and the input as it is now: another write of the folder makes other relations. Those of the write before are let go of, as Spark tells
    what it caches apart by path alone and would read their rows for the new ones."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    at = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    state = spark.sparkContext.applicationId, at.getPath().toString(), at.getModificationTime(), at.getLen()
    for key in [k for k in _KEPT if k[:2] == state[:2] and k[2:4] != state[2:]]:
        _KEPT.pop(key).unpersist()
    return state


def forget() -> None:
    """Let go of all kept relations, so that the next query starts from its files."""
    for df in _KEPT.values():
        df.unpersist()
    _KEPT.clear()


def kept(make):
    """make(spark, sf_dir), kept by Spark (memory, then disk) for the queries that share it.

    The point table keeps the hash distribution by track and the order that its windows gave it, so that what is built on it needs no
    further exchange and hardly a sort.
    """

    @wraps(make)
    def of(spark, sf_dir):
        key = *_state(spark, sf_dir), make.__module__, make.__name__
        df = _KEPT.get(key)
        if df is None:
            df = _KEPT[key] = make(spark, sf_dir)
        level = df.storageLevel
        return df if level.useMemory or level.useDisk else df.persist()

    return of


def stored(make):
    """make(spark, sf_dir) as a table written once for each session: relations of proposals are read by many gates, whose plans
    would otherwise hold all of their making several times over."""

    @wraps(make)
    def of(spark, sf_dir):
        key = *_state(spark, sf_dir), make.__module__, make.__name__
        if key not in _KEPT:
            _KEPT[key] = written(make(spark, sf_dir), make.__name__)
        return _KEPT[key]

    return of


@kept
def raw(spark, sf_dir):
    return binding.raw_points(spark, sf_dir).sortWithinPartitions("track_id", "trk_seg_index", "gpx_index")


def structure(spark, sf_dir):
    return binding.structure(raw(spark, sf_dir))


def points(spark, sf_dir):
    return ingestion.accepted(raw(spark, sf_dir))


def _round(df, *columns: str, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


query("ing_accepted_points", sql("select track_id, gpx_index, trk_seg_index, lat, lon, ele, time_ms from pts"))(
    lambda s, d: points(s, d).select("track_id", "gpx_index", "trk_seg_index", "lat", "lon", "ele", "time_ms"))
query("ing_rejections", sql("""select track_id, gpx_index, trk_seg_index, case when lat is null then 'not_a_number' else 'out_of_range' end as reason_code
from raw where lat is null or not (lat between -90 and 90 and lon between -180 and 180)"""))(lambda s, d: ingestion.rejections(raw(s, d)))
query("ing_counts", sql("""select track_id, count(*) as total, count(*) filter (where lat between -90 and 90) as valid, count(*) filter (where lat is null or lat > 90) as rejected,
  any_value(n) as segments, any_value(waypoints) as waypoints, any_value(routes) as routes, coalesce(bool_or(not time_absent) filter (where lat between -90 and 90), false) as has_any_time,
  any_value(waypoints) > 0 as has_waypoints, any_value(routes) > 0 as has_routes, any_value(n) > 1 as multi_segment
from raw join (select track_id, count(*) as n from segs group by 1) using (track_id) join spots using (track_id) group by track_id"""))(lambda s, d: ingestion.counts(raw(s, d), structure(s, d)))
query("ing_segment_boundaries", sql("""select track_id, trk_seg_index, min(gpx_index) as first_gpx, max(gpx_index) as last_gpx, arg_min_null(time_ms, gpx_index) as first_ms, arg_max_null(time_ms, gpx_index) as last_ms,
  min(time_ms) as min_ms, max(time_ms) as max_ms from pts group by track_id, trk_seg_index"""))(lambda s, d: ingestion.segment_boundaries(points(s, d)))
query("ing_segment_summaries", sql("""select track_id, trk_seg_index, g.track_index, coalesce(point_count, 0) as point_count, coalesce(usable_time_count, 0) as usable_time_count,
  first_ms, last_ms, min_ms, max_ms, first_lat, first_lon, last_lat, last_lon from segs g left join summ using (track_id, trk_seg_index)""", SUMMARIES))(lambda s, d: ingestion.segment_summaries(raw(s, d), structure(s, d)))
query("ing_segment_times", sql("""select track_id, trk_seg_index, coalesce(string_agg(time_ms, ',' order by gpx_index) filter (where time_ms is not null), '') as times
from segs left join raw using (track_id, trk_seg_index) group by 1, 2"""))(
    lambda s, d: ingestion.segment_times(raw(s, d), structure(s, d)).withColumn("times", F.array_join(F.transform("times", lambda t: t.cast("string")), ",")))

FLT_INTRA = """
fin as (
  select track_id, trk_seg_index, row_number() over w - 1 as position, lag(time_ms) over w as preceding_ms, time_ms as violating_ms
  from raw where time_ms is not null window w as (partition by track_id, trk_seg_index order by gpx_index))"""
FLT_INTER = f"""
fle0 as (
  select *, lead(trk_seg_index) over w as to_seg, lead(first_ms) over w as nf, lead(last_ms) over w as nl, last_lat as a_lat, last_lon as a_lon, lead(first_lat) over w as b_lat, lead(first_lon) over w as b_lon
  from summ window w as (partition by track_id, track_index order by trk_seg_index)),
fle1 as (select *, nf - last_ms as gap_ms, abs(nf - last_ms) / 3600000.0 as back, round({HAVERSINE.format(a="a_", b="b_")}) as far from fle0 where nf is not null and last_ms is not null),
fle2 as (
  select *, case when gap_ms < 0 and round(back) >= 1 and abs(back - round(back)) < 0.1 then 'timestamp_discontinuity_fault' when gap_ms < 0 and nf < last_ms and nl > first_ms then 'duplicate_chunk_fault'
    when gap_ms < 0 then 'chunk_ordering_fault' when gap_ms > 1800000 then 'missing_chunk_fault' end as type from fle1),
fle as (
  select track_id, track_index, trk_seg_index as from_seg, to_seg, type,
    case type when 'timestamp_discontinuity_fault' then 'medium' when 'missing_chunk_fault' then 'high' else 'critical' end as severity,
    cast(case type when 'timestamp_discontinuity_fault' then 0.9 when 'duplicate_chunk_fault' then 0.95 when 'chunk_ordering_fault' then 1.0 else 0.85 end as double) as confidence, gap_ms,
    case when type = 'timestamp_discontinuity_fault' then cast(round(back) as bigint) end as offset_hours, case when type = 'duplicate_chunk_fault' then least(last_ms, nl) end as overlap_end_ms,
    case when type = 'missing_chunk_fault' then far end as implied_m, case when type = 'missing_chunk_fault' then round(far / 1000 / (gap_ms / 3600000.0), 1) end as implied_kph
  from fle2 where type is not null)"""
query("flt_intra_segment", sql("select * from fin where violating_ms < preceding_ms", FLT_INTRA))(lambda s, d: faults.intra_segment(raw(s, d)))
query("flt_inter_segment", sql("select * from fle", SUMMARIES, FLT_INTER))(lambda s, d: faults.inter_segment(ingestion.segment_summaries(raw(s, d), structure(s, d))))
query("flt_all", sql("""select track_id, trk_seg_index, position, preceding_ms, violating_ms, 'intra_segment_fault' as type, null::int as track_index, null::int as from_seg, null::int as to_seg, null::varchar as severity, null::double as confidence,
  null::bigint as gap_ms, null::bigint as offset_hours, null::bigint as overlap_end_ms, null::double as implied_m, null::double as implied_kph from fin where violating_ms < preceding_ms
union all select track_id, null, null, null, null, type, track_index, from_seg, to_seg, severity, confidence, gap_ms, offset_hours, overlap_end_ms, implied_m, implied_kph from fle""", SUMMARIES, FLT_INTRA, FLT_INTER))(
    lambda s, d: faults.all_faults(raw(s, d), ingestion.segment_summaries(raw(s, d), structure(s, d))))

LABEL_COLUMNS = ("track_id", "gpx_index", *temporal.TAGS, "anchor_ms", "depth_ms", "first_gpx")
query("tmp_labels", sql(f"select {', '.join(LABEL_COLUMNS)} from lab", LABELS))(lambda s, d: temporal.labels(points(s, d)).select(*LABEL_COLUMNS))
query("tmp_annotations", sql(f"""select track_id, gpx_index, tags from (
  select *, array_to_string(list_filter([{', '.join(f"case when {t} then '{t}' end" for t in temporal.TAGS)}], lambda x: x is not null), ',') as tags from lab) where tags <> ''""", LABELS))(
    lambda s, d: temporal.annotations(temporal.labels(points(s, d))).select("track_id", "gpx_index", F.array_join("tags", ",").alias("tags")))
query("tmp_tag_counts", sql(f"""select track_id, {COUNTS}, count(time_ms) as parseable,
  (arg_max(time_ms, gpx_index) filter (where time_ms is not null) - arg_min(time_ms, gpx_index) filter (where time_ms is not null)) / 1000.0 as session_sec from lab group by track_id""", LABELS))(
    lambda s, d: temporal.tag_counts(temporal.labels(points(s, d))))
query("tmp_tag_index", sql(" union all ".join(f"select track_id, '{t}' as tag, gpx_index from lab where {t}" for t in temporal.TAGS), LABELS))(lambda s, d: temporal.tag_index(temporal.labels(points(s, d))))
PAIRS = """
pair0 as (select *, lag(time_ms) over (partition by track_id, trk_seg_index order by gpx_index) as prev from pts where time_ms > 0),
pair as (select track_id, trk_seg_index, count(*) as parseable, count(prev) as pairs, count(*) filter (where time_ms > prev) as positive_pairs, count(*) filter (where time_ms <= prev) as violations from pair0 group by all),
segtags as (select track_id, trk_seg_index, """ + COUNTS + """ from lab group by track_id, trk_seg_index),
segsum as (
  select segtags.*, coalesce(parseable, 0) as parseable, coalesce(pairs, 0) as pairs, coalesce(positive_pairs, 0) as positive_pairs, coalesce(violations, 0) as violations, coalesce(positive_pairs, 0) > 0 as any_positive
  from segtags left join pair using (track_id, trk_seg_index))"""
query("tmp_segment_summary", sql("select * from segsum", LABELS, PAIRS))(lambda s, d: temporal.segment_summary(temporal.labels(points(s, d))))
query("audit_rollup", sql(f"select track_id, trk_seg_index, grouping(track_id, trk_seg_index)::bigint as level, {COUNTS} from lab group by grouping sets ((track_id, trk_seg_index), (track_id))", LABELS))(
    lambda s, d: temporal.rollup(temporal.labels(points(s, d))))


def steps(spark, sf_dir):
    return sampling.edges(points(spark, sf_dir))


query("smp_edges", sql("select track_id, from_gpx, to_gpx, from_seg, to_seg, dt_ms, round(dd_m, 6) as dd_m from edge", EDGES))(
    lambda s, d: _round(steps(s, d), "dd_m").select("track_id", "from_gpx", "to_gpx", "from_seg", "to_seg", "dt_ms", "dd_m"))
query("smp_time_deltas", sql("select track_id, from_gpx, to_gpx, from_seg, dt_ms / 1000.0 as dt_sec from edge where dt_ms > 0", EDGES))(lambda s, d: sampling.time_deltas(steps(s, d)))
query("smp_distance_deltas", sql("select track_id, from_gpx, to_gpx, from_seg, round(dd_m, 6) as dd_m from edge", EDGES))(lambda s, d: _round(sampling.distance_deltas(steps(s, d)), "dd_m"))
query("smp_time_distance_pairs", sql("select track_id, from_gpx, to_gpx, dt_ms / 1000.0 as dt_sec, round(dd_m, 6) as dd_m from edge where dt_ms > 0", EDGES))(lambda s, d: _round(sampling.time_distance_pairs(steps(s, d)), "dd_m"))
query("smp_nonpositive_steps", sql("select track_id, from_gpx, to_gpx, dt_ms from edge where dt_ms <= 0", EDGES))(lambda s, d: sampling.nonpositive_steps(steps(s, d)))
query("smp_context", sql("""select p.track_id, timestamped_points, coalesce(adjacent_pairs, 0) as adjacent_pairs, coalesce(timed_pairs, 0) as timed_pairs, coalesce(positive, 0) as positive, coalesce(zero, 0) as zero, coalesce(negative, 0) as negative,
  coalesce(rejected_distances, 0) as rejected_distances, coalesce(time_conditioned, 0) as time_conditioned
from (select track_id, count(time_ms) as timestamped_points from pts group by 1) p left join (
  select track_id, count(*) as adjacent_pairs, count(dt_ms) as timed_pairs, count(*) filter (where dt_ms > 0) as positive, count(*) filter (where dt_ms = 0) as zero, count(*) filter (where dt_ms < 0) as negative,
    count(*) filter (where dd_m is null) as rejected_distances, count(*) filter (where dt_ms > 0 and dd_m is not null) as time_conditioned from edge group by 1) e using (track_id)""", EDGES))(
    lambda s, d: sampling.context(points(s, d), steps(s, d)))
STATS = "count(*) as n, min({v}) as min, max({v}) as max, median({v}) as median"
query("smp_time_stats", sql(f"select track_id, {STATS.format(v='dt_ms / 1000.0')} from edge where dt_ms > 0 group by 1", EDGES))(lambda s, d: sampling.stats(sampling.time_deltas(steps(s, d)), "dt_sec"))
query("smp_distance_stats", sql("select track_id, count(*) as n, round(min(dd_m), 6) as min, round(max(dd_m), 6) as max, round(median(dd_m), 5) as median from edge group by 1", EDGES))(
    lambda s, d: _round(_round(sampling.stats(sampling.distance_deltas(steps(s, d)), "dd_m"), "min", "max"), "median", digits=5))
query("smp_segment_stats", sql("""select s.track_id, s.from_seg, coalesce(time_n, 0) as time_n, time_min, time_max, time_median, coalesce(dist_n, 0) as dist_n, dist_min, dist_max, dist_median
from (select distinct track_id, trk_seg_index as from_seg from pts) s
left join (select track_id, from_seg, count(*) as time_n, min(dt_ms / 1000.0) as time_min, max(dt_ms / 1000.0) as time_max, median(dt_ms / 1000.0) as time_median from edge where dt_ms > 0 group by 1, 2) t using (track_id, from_seg)
left join (select track_id, from_seg, count(*) as dist_n, round(min(dd_m), 5) as dist_min, round(max(dd_m), 5) as dist_max, round(median(dd_m), 5) as dist_median from edge group by 1, 2) d using (track_id, from_seg)""", EDGES))(
    lambda s, d: _round(sampling.segment_stats(points(s, d), steps(s, d)), "dist_min", "dist_max", "dist_median", digits=5))


def _folds(channel: str) -> str:
    """Both clustering passes, one value at a time over the list of a track's values."""
    value, keep = ("dt_ms / 1000.0", "where dt_ms > 0") if channel == "time" else ("round(dd_m, 6)", "")
    return f"""
ser as (select track_id, list(v order by v) as a, list(v order by to_gpx) as b, len(list(v)) as n from (select track_id, to_gpx, {value} as v from edge {keep}) group by track_id),
fa(track_id, i, s, k) as (
  select track_id, 1, 1, 1 from ser union all
  select track_id, i + 1, case when j then s else i + 1 end, case when j then k else k + 1 end from (
    select track_id, i, s, k, coalesce(case when m > 0 then abs(a[i + 1] - m) / m < 0.02 end, false) as j from (
      select fa.*, a, (a[s + (i - s) // 2] + a[s + (i - s + 1) // 2]) / 2 as m from fa join ser using (track_id) where i < n))),
fb(track_id, i, s, k) as (
  select track_id, 1, 1, 1 from ser union all
  select track_id, i + 1, case when j then s else i + 1 end, case when j then k else k + 1 end from (
    select track_id, i, s, k, coalesce(case when m > 0 then abs(b[i + 1] - m) / m < 0.02 end, true) as j from (
      select fb.*, b, list_median(b[s:i]) as m from fb join ser using (track_id) where i < n))),
mem as (select fa.track_id, fa.k, fa.i, fa.s, a[i] as v, n, a from fa join ser using (track_id)),
cen as (select track_id, k, median(v) as center, count(*) as count, min(n) as n, min(v) as lo, max(v) as hi from mem group by 1, 2),
des as (
  select track_id, k, center, cen.count, cen.count / cen.n as share, lo as min, hi as max, hi - lo as spread, avg(abs(v - center)) as mean_abs, max(abs(v - center)) as max_abs,
    case when center > 0 then avg(abs(v - center)) / center else 0 end as mean_rel, case when center > 0 then max(abs(v - center)) / center else 0 end as max_rel, case when center > 0 then (hi - lo) / center else 0 end as spread_over_center
  from mem join cen using (track_id, k) group by track_id, k, center, cen.count, cen.n, lo, hi)"""


def _deltas(channel):
    if channel == "time":
        return lambda s, d: (sampling.time_deltas(steps(s, d)), "dt_sec")
    return lambda s, d: (_round(sampling.distance_deltas(steps(s, d)), "dd_m"), "dd_m")


_DES = ("center", "share", "min", "max", "spread", "mean_abs", "max_abs", "mean_rel", "max_rel", "spread_over_center")
for _channel in ("time", "distance"):
    _of = _deltas(_channel)
    query(f"smp_clusters_{_channel}", sql(f"select track_id, count, {', '.join(f'round({c} + 1.37e-8, 6) as {c}' for c in _DES)}, row_number() over (partition by track_id order by count desc, k) as ordinal from des", EDGES, _folds(_channel)))(
        lambda s, d, f=_of: sampling.clusters(*f(s, d)).withColumns({c: F.round(F.col(c) + 1.37e-8, 6) for c in _DES}))  # half of a rounded sum would be a tie
    query(f"smp_cluster_counts_{_channel}", sql("""select track_id, n as total, ka as k_sorted, kb as k_sequential, round(ka / n, 9) as sorted_over_total, round(kb / n, 9) as sequential_over_total, round(case when ka > 1 then kb / ka else 1 end, 9) as sequential_over_sorted
from (select track_id, max(k)::bigint as ka from fa group by 1) join (select track_id, max(k)::bigint as kb from fb group by 1) using (track_id) join ser using (track_id)""", EDGES, _folds(_channel)))(
        lambda s, d, f=_of: _round(sampling.cluster_counts(*f(s, d)), "sorted_over_total", "sequential_over_total", "sequential_over_sorted", digits=9))
    query(f"smp_normalization_{_channel}", sql("""select track_id, round(sum(mean_abs * count) / sum(count), 6) as mean_abs, round(max(max_abs), 6) as max_abs, round(sum(mean_rel * count) / sum(count), 6) as mean_rel, round(max(max_rel), 6) as max_rel
from des group by 1""", EDGES, _folds(_channel)))(lambda s, d, f=_of: _round(sampling.normalization(sampling.clusters(*f(s, d))), "mean_abs", "max_abs", "mean_rel", "max_rel"))
    query(f"smp_insertion_deviations_{_channel}", sql("""select track_id, k - 1 as k, round(avg(da), 6) as mean_insertion_abs, round(max(da), 6) as max_insertion_abs, round(avg(dr), 6) as mean_insertion_rel, round(max(dr), 6) as max_insertion_rel
from (select track_id, k::bigint as k, case when i = s then 0 else abs(v - m) end as da, case when i = s then 0 else abs(v - m) / m end as dr
  from (select *, case when i > s then (a[s + (i - 1 - s) // 2] + a[s + (i - s) // 2]) / 2 end as m from mem)) group by 1, 2""", EDGES, _folds(_channel)))(
        lambda s, d, f=_of: _round(sampling.insertion_deviations(*f(s, d)), "mean_insertion_abs", "max_insertion_abs", "mean_insertion_rel", "max_insertion_rel"))

query("mot_pair_flags", sql(f"select track_id, from_gpx, to_gpx, {', '.join(motion.FLAGS)}, dt_sec from mot", EDGES, MOTION))(
    lambda s, d: motion.pair_flags(steps(s, d)).select("track_id", "from_gpx", "to_gpx", *motion.FLAGS, "dt_sec"))
query("mot_annotations", sql(f"""select track_id, from_gpx, to_gpx, flags, case when backward_time then dt_sec end as dt_sec, case when time_unresolvable then round(dd_m, 6) end as dd_m
from (select *, array_to_string(list_filter([{', '.join(f"case when {t} then '{t}' end" for t in motion.FLAGS)}], lambda x: x is not null), ',') as flags from mot) where flags <> ''""", EDGES, MOTION))(
    lambda s, d: _round(motion.annotations(motion.pair_flags(steps(s, d))), "dd_m").withColumn("flags", F.array_join("flags", ",")))
query("mot_tag_counts", sql(f"select track_id, count(*) as pairs, {MOTION_COUNTS} from mot group by 1", EDGES, MOTION))(lambda s, d: motion.tag_counts(motion.pair_flags(steps(s, d))))
query("mot_segment_counts", sql(f"""select s.track_id, s.trk_seg_index, coalesce(pairs, 0) as pairs, {', '.join(f'coalesce({t}, 0) as {t}' for t in motion.FLAGS)}
from (select distinct track_id, trk_seg_index from pts where track_id in (select track_id from pts group by 1 having count(*) > 1)) s
left join (select track_id, to_seg as trk_seg_index, count(*) as pairs from mot group by 1, 2) e using (track_id, trk_seg_index)
left join (select track_id, from_seg as trk_seg_index, {MOTION_COUNTS} from mot group by 1, 2) f using (track_id, trk_seg_index)""", EDGES, MOTION))(
    lambda s, d: motion.segment_counts(points(s, d), motion.pair_flags(steps(s, d))))

query("ele_labels", sql(f"select track_id, gpx_index, {', '.join(elevation.TAGS)} from el", ELE))(lambda s, d: elevation.labels(points(s, d)).select("track_id", "gpx_index", *elevation.TAGS))
query("ele_counts", sql(f"select track_id, {ELE_COUNTS} from el group by 1", ELE))(lambda s, d: elevation.counts(elevation.labels(points(s, d))))
query("ele_segment_counts", sql(f"select track_id, trk_seg_index, {ELE_COUNTS} from el group by 1, 2", ELE))(lambda s, d: elevation.counts(elevation.labels(points(s, d)), "trk_seg_index"))
