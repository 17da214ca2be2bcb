"""Queries of the correction operators, with the SQL (DuckDB) that each is compared with.

Queries on proposals are those of a first pass over the accepted points, which needs no loop.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import apply, correction, gates, ingestion, motion, phases, presegment, proposals, report, sampling, temporal
from ..operators import spine as spines
from .audit_queries import COUNTS, EDGES, HAVERSINE, LABELS, MOTION, MOTION_COUNTS, PAIRS, SUMMARIES, _round, points, raw, sql, steps, stored, structure
from .audit_queries import query as _register

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name, oracle):
    def add(make):
        from . import audit_queries

        _register(name, oracle)(make)
        QUERIES[name] = audit_queries.QUERIES.pop(name)
        if oracle:
            ORACLE[name] = audit_queries.ORACLE.pop(name)
        return make

    return add


@stored
def labelled(s, d):
    return temporal.labels(points(s, d))


@stored
def summary(s, d):
    return temporal.segment_summary(labelled(s, d))


@stored
def profiles(s, d):
    return presegment.segment_profiles(summary(s, d), points(s, d))


def classes(s, d):
    return presegment.boundaries(ingestion.segment_boundaries(points(s, d)))


NEAR = """
near0 as (select *, case when time_ms > 0 then time_ms end as t, case when lag(time_ms) over w > 0 then lag(time_ms) over w end as p from pts window w as (partition by track_id, trk_seg_index order by gpx_index)),
near as (select track_id, trk_seg_index, count(t) as parseable, count(*) filter (where t is not null and p is not null) as pairs, count(*) filter (where t > p) as positive_pairs, count(*) filter (where t < p) as falling_pairs from near0 group by 1, 2)"""
PROFILES = """
prof0 as (
  select s.*, s.parseable >= 2 and n.pairs >= 1 and n.falling_pairs = n.pairs as rev, case when s.pairs > 0 then s.positive_pairs / s.pairs else 0 end as cov from segsum s join near n using (track_id, trk_seg_index)),
prof as (
  select track_id, trk_seg_index, case when parseable = 0 or (not any_positive and not rev) then 'geometry-only' when rev then 'fully-reversed' when cov < 0.8 then 'timestamp-sparse' else 'full' end as mode,
    below_anchor + below_prev_valid + non_adjacent_repeat + adjacent_duplicate > 0 as has_anomalies, parseable >= 2 as has_usable_times, cov as coverage, rev as is_fully_reversed from prof0)"""
BOUNDS = """
rng as (select track_id, trk_seg_index, arg_min_null(time_ms, gpx_index) as first_ms, arg_max_null(time_ms, gpx_index) as last_ms, min(time_ms) as min_ms, max(time_ms) as max_ms from pts group by 1, 2),
bnd0 as (
  select *, lead(trk_seg_index) over w as to_seg, lead(first_ms) over w as nf, lead(min_ms) over w as nmin, lead(max_ms) over w as nmax from rng window w as (partition by track_id order by trk_seg_index)),
bnd1 as (select *, nf - last_ms as gap_ms, (last_ms - nf) / 3600000.0 as back from bnd0 where to_seg is not null),
bnd as (
  select track_id, trk_seg_index as from_seg, to_seg,
    case when gap_ms < 0 and round(back) >= 1 and abs(back - round(back)) <= 0.1 then 'timestamp_discontinuity' when gap_ms < 0 and nmin < max_ms and nmax > min_ms then 'duplicate_chunk' when gap_ms < 0 then 'chunk_ordering'
      when gap_ms > 0 and last_ms // 86400000 = nf // 86400000 then 'same_day' when gap_ms > 0 then 'cross_day' end as classification,
    coalesce(gap_ms > 0, false) as is_gap, gap_ms, case when gap_ms < 0 and round(back) >= 1 and abs(back - round(back)) <= 0.1 then cast(round(back) as bigint) end as offset_hours from bnd1)"""
CROSS = """
seam as (select track_id, max(gpx_index) as lo, lead(min(gpx_index)) over (partition by track_id order by trk_seg_index) as hi from pts group by track_id, trk_seg_index),
grp as (select track_id, time_ms, count(*) as n, min(gpx_index) as lo, max(gpx_index) as hi from pts where time_ms > 0 group by 1, 2 having count(distinct trk_seg_index) > 1),
xdup as (
  select p.track_id, p.gpx_index, p.time_ms from pts p join grp g using (track_id, time_ms)
  where not (g.n = 2 and exists (select 1 from seam s where s.track_id = g.track_id and s.lo = g.lo and s.hi = g.hi)))"""


def _objective(source: str, name: str) -> str:
    return f"""
{name}0 as (
  select *, lag(gpx_index) over w as pg, lag(time_ms) over w as pt, lag(lat) over w as pla, lag(lon) over w as plo, lag(ele) over w as pe,
    case when ele_absent or ele is null then 'absent' when ele < -500 or ele > 9500 then 'oob' else 'usable' end as cc from {source} window w as (partition by track_id, trk_seg_index order by gpx_index)),
{name}1 as (select *, lag(cc) over (partition by track_id, trk_seg_index order by gpx_index) as pc from {name}0),
{name} as (
  select track_id, trk_seg_index, case when cc = 'usable' and pc <> 'usable' then gpx_index else pg end as keep, case when cc = 'usable' and pc <> 'usable' then pg else gpx_index end as other,
    case when cc = 'usable' and pc = 'usable' and ele <> pe then 'mismatch' when cc = 'oob' and pc = 'oob' then 'drop_clear' when (cc = 'absent' and pc = 'oob') or (cc = 'oob' and pc = 'absent') then 'none' else 'drop' end as action
  from {name}1 where pg = gpx_index - 1 and time_ms > 0 and time_ms = pt and lat = pla and lon = plo)"""


SPLIT = "split as (select distinct track_id, trk_seg_index from (select track_id, trk_seg_index from pts where time_ms > 0 group by track_id, trk_seg_index, time_ms having min(lat) <> max(lat) or min(lon) <> max(lon)))"
FALL = """
fall0 as (select *, lag(time_ms) over (partition by track_id, trk_seg_index order by gpx_index) as p from pts where time_ms > 0),
fall as (
  select track_id, trk_seg_index, n, coalesce(up = 0, true) as falls, lo, hi from (select track_id, trk_seg_index, count(*) as n from pts group by 1, 2)
  left join (select track_id, trk_seg_index, count(*) filter (where time_ms >= p) as up, min(time_ms) as lo, max(time_ms) as hi from fall0 group by 1, 2) using (track_id, trk_seg_index))"""
REVERSALS = """
rv0 as (select *, lag(hi) over (partition by track_id order by trk_seg_index) as bf, lead(lo) over (partition by track_id order by trk_seg_index) as af from fall),
rv as (
  select track_id, trk_seg_index, falls as monotonic, coalesce(lo >= bf, true) and coalesce(hi <= af, true) as seam_ok, falls and coalesce(lo >= bf, true) and coalesce(hi <= af, true) as accepted
  from rv0 join prof using (track_id, trk_seg_index) where is_fully_reversed and n >= 2)"""
CHUNKS = """
tch as (select track_id, from_seg as trk_seg_index from bnd where classification = 'chunk_ordering' union select track_id, to_seg from bnd where classification = 'chunk_ordering'),
chk as (select track_id, trk_seg_index, row_number() over (partition by track_id order by trk_seg_index) as slot, row_number() over (partition by track_id order by min_ms nulls last, trk_seg_index) as new_slot
  from tch left join summ using (track_id, trk_seg_index))"""
SPINE = """
alone as (select * from (select *, count(*) over (partition by track_id, trk_seg_index, time_ms) as c from pts where time_ms > 0) where c = 1),
spn as (select * from (select *, max(time_ms) over (partition by track_id, trk_seg_index order by gpx_index rows between unbounded preceding and 1 preceding) as top from alone) where top is null or time_ms > top),
env as (select track_id, trk_seg_index, env_min, env_max from (select distinct track_id, trk_seg_index from pts) left join (select track_id, trk_seg_index, min(time_ms) as env_min, max(time_ms) as env_max from spn group by 1, 2) using (track_id, trk_seg_index))"""
BLOCKS = """
isl0 as (select *, row_number() over (partition by track_id, trk_seg_index order by gpx_index) - row_number() over (partition by track_id, trk_seg_index, below_anchor order by gpx_index) as run from lab),
isl as (select *, count(*) over (partition by track_id, trk_seg_index, run) as n, lag(time_ms) over (partition by track_id, trk_seg_index, run order by gpx_index) as p from isl0 where below_anchor),
blk0 as (
  select track_id, trk_seg_index, run, min(gpx_index) as first_gpx, max(gpx_index) as last_gpx, count(*) as length, list(gpx_index order by gpx_index) as members, coalesce(bool_or(time_ms <= p), false) as violation,
    min(time_ms) filter (where time_ms > 0) as b_min, max(time_ms) filter (where time_ms > 0) as b_max from isl where n >= 2 group by 1, 2, 3),
blk as (select blk0.*, case when env_min is null then true else coalesce(b_min <= env_min or b_max >= env_max, false) end as is_edge from blk0 join env using (track_id, trk_seg_index))"""
SINGLES = """
use as (select * from pts where time_ms > 0),
sng0 as (
  select i.*, (select max(u.gpx_index) from use u where u.track_id = i.track_id and u.trk_seg_index = i.trk_seg_index and u.gpx_index < i.gpx_index) as prev_gpx,
    (select min(u.gpx_index) from use u where u.track_id = i.track_id and u.trk_seg_index = i.trk_seg_index and u.gpx_index > i.gpx_index) as next_gpx from isl i where n = 1 and time_ms > 0),
sng as (
  select s.track_id, s.trk_seg_index, s.gpx_index, s.time_ms as target_ms, a.time_ms as t_prev, b.time_ms as t_next, s.prev_gpx, s.next_gpx, case when env_min is null then true else s.time_ms <= env_min or s.time_ms >= env_max end as is_edge
  from sng0 s join env using (track_id, trk_seg_index) left join pts a on a.track_id = s.track_id and a.gpx_index = s.prev_gpx left join pts b on b.track_id = s.track_id and b.gpx_index = s.next_gpx)"""
GROUPS = """
ex0 as (select *, case when not ele_absent then ele end as e from pts),
ex1 as (select *, lag(gpx_index) over w as pg, lag(time_ms) over w as pt, lag(lat) over w as pla, lag(lon) over w as plo, lag(e) over w as pe from ex0 window w as (partition by track_id, trk_seg_index order by gpx_index)),
exd as (select track_id, trk_seg_index, pg as keep, gpx_index as drop from ex1 where time_ms > 0 and time_ms = pt and lat = pla and lon = plo and e is not distinct from pe),
left_over as (select * from ex0 where time_ms > 0 and (track_id, gpx_index) not in (select (track_id, drop) from exd)),
grp0 as (
  select track_id, trk_seg_index, time_ms, count(*) as n, list(gpx_index order by gpx_index) as members, min(gpx_index) as first_gpx, count(distinct (lat, lon, coalesce(e, -1e9))) = 1 as is_exact
  from left_over group by 1, 2, 3 having count(*) >= 2),
grp1 as (
  select g.*, (select max(u.gpx_index) from use u where u.track_id = g.track_id and u.trk_seg_index = g.trk_seg_index and u.gpx_index < g.first_gpx) as prev_gpx,
    (select min(u.gpx_index) from use u where u.track_id = g.track_id and u.trk_seg_index = g.trk_seg_index and u.gpx_index > g.first_gpx and not list_contains(g.members, u.gpx_index)) as next_gpx from grp0 g),
gsm as (
  select g.track_id, g.trk_seg_index, g.time_ms as target_ms, g.n, g.members, g.first_gpx, g.is_exact, a.time_ms as t_prev, b.time_ms as t_next, g.prev_gpx, g.next_gpx, case when env_min is null then true else g.time_ms <= env_min or g.time_ms >= env_max end as is_edge
  from grp1 g join env using (track_id, trk_seg_index) left join pts a on a.track_id = g.track_id and a.gpx_index = g.prev_gpx left join pts b on b.track_id = g.track_id and b.gpx_index = g.next_gpx),
ins as (
  select track_id, trk_seg_index, 'single:' || gpx_index as key, [gpx_index] as members, false as is_exact, target_ms, t_prev, t_next, prev_gpx, next_gpx, is_edge from sng
  union all select track_id, trk_seg_index, 'group:' || first_gpx, members, is_exact, target_ms, t_prev, t_next, prev_gpx, next_gpx, is_edge from gsm)"""
OVERLAP = """
ovl0 as (
  select b.track_id, b.trk_seg_index, b.first_gpx, b.last_gpx, b.violation, b.b_min, b.b_max, b.members, max(s.time_ms) filter (where s.time_ms < b.b_min and not list_contains(b.members, s.gpx_index)) as tp,
    min(s.time_ms) filter (where s.time_ms > b.b_max and not list_contains(b.members, s.gpx_index)) as tn, coalesce(bool_or(s.time_ms between b.b_min and b.b_max and not list_contains(b.members, s.gpx_index)), false) as inside
  from blk b left join spn s on s.track_id = b.track_id and s.trk_seg_index = b.trk_seg_index where not b.is_edge group by all),
ovl as (
  select o.track_id, o.trk_seg_index, o.first_gpx, o.last_gpx, b_min, b_max,
    case when violation or b_min is null then 'overlap' when tp is null and tn is null then 'no-bracket' when tp is not null and tn is not null and inside then 'overlap' else 'socket-ok' end as status,
    not violation and b_min is not null and tp is not null and tn is not null and inside as pierced,
    case when not violation then tp end as t_prev, case when not violation then tn end as t_next, case when not violation then p.gpx_index end as prev_gpx, case when not violation then n.gpx_index end as next_gpx
  from ovl0 o left join spn p on p.track_id = o.track_id and p.trk_seg_index = o.trk_seg_index and p.time_ms = tp left join spn n on n.track_id = o.track_id and n.trk_seg_index = o.trk_seg_index and n.time_ms = tn)"""
CONFLICTS = """
inb as (select i.track_id, i.trk_seg_index, i.key, b.first_gpx as block_first, target_ms, b_min, b_max from ins i join blk b using (track_id, trk_seg_index) where not i.is_edge and not is_exact and not b.is_edge and target_ms between b_min and b_max),
cor0 as (select track_id, trk_seg_index, key, target_ms as t, coalesce(t_prev, -4611686018427387904) as lo, coalesce(t_next, 4611686018427387904) as hi from ins where not is_edge and not is_exact),
cor as (
  select track_id, trk_seg_index, key_a, key_b from (
    select a.track_id, a.trk_seg_index, a.key as key_a, b.key as key_b, a.t as ta, b.t as tb, greatest(a.lo, b.lo) as f, least(a.hi, b.hi) as u from cor0 a join cor0 b using (track_id, trk_seg_index) where a.key < b.key)
  where (ta > f and ta < u) or (tb > f and tb < u))"""
COUPLING = """
nb as (select track_id, trk_seg_index, gpx_index, lag(gpx_index) over w as p, lead(gpx_index) over w as n from pts window w as (partition by track_id, trk_seg_index order by gpx_index)),
mem as (select track_id, trk_seg_index, key, unnest(members) as gpx_index from ins where not is_edge),
rol as (
  select distinct * from (
    select track_id, trk_seg_index, key, p as gpx, 9 as rank from mem join nb using (track_id, trk_seg_index, gpx_index) union all select track_id, trk_seg_index, key, n, 9 from mem join nb using (track_id, trk_seg_index, gpx_index)
    union all select o.track_id, o.trk_seg_index, 'block:' || first_gpx, p, 9 from ovl o join nb on nb.track_id = o.track_id and nb.gpx_index = o.first_gpx
    union all select o.track_id, o.trk_seg_index, 'block:' || first_gpx, n, 9 from ovl o join nb on nb.track_id = o.track_id and nb.gpx_index = o.last_gpx
    union all select track_id, trk_seg_index, key, prev_gpx, 0 from ins where not is_edge union all select track_id, trk_seg_index, key, next_gpx, 1 from ins where not is_edge
    union all select track_id, trk_seg_index, 'block:' || first_gpx, prev_gpx, 0 from ovl union all select track_id, trk_seg_index, 'block:' || first_gpx, next_gpx, 1 from ovl) where gpx is not null),
cpl as (
  select a.track_id, a.trk_seg_index, a.key as key_a, b.key as key_b, arg_min(a.gpx, a.rank) as disturbed_gpx from rol a join rol b on a.track_id = b.track_id and a.trk_seg_index = b.trk_seg_index and a.gpx = b.gpx and a.key <> b.key
  where a.rank < 9 group by 1, 2, 3, 4),
bkd as (select track_id, trk_seg_index, key_a as key from cpl union select track_id, trk_seg_index, key_b from cpl)"""
KINEMATIC = f"""
cand as (
  select i.track_id, i.trk_seg_index, key, n, i.gpx_index, c.lat as c_lat, c.lon as c_lon, c.time_ms as ct, a.lat as p_lat, a.lon as p_lon, a.time_ms as pt, b.lat as n_lat, b.lon as n_lon, b.time_ms as nt
  from (select track_id, trk_seg_index, key, len(members) as n, unnest(members) as gpx_index, prev_gpx, next_gpx from ins where not is_exact) i
  join pts c on c.track_id = i.track_id and c.gpx_index = i.gpx_index left join pts a on a.track_id = i.track_id and a.gpx_index = i.prev_gpx left join pts b on b.track_id = i.track_id and b.gpx_index = i.next_gpx),
kin0 as (
  select *, case when pt is null then null when ct = pt then 'infinity'::double when ct < pt then 'nan'::double else {HAVERSINE.format(a="p_", b="c_")} / (ct - pt) * 3600.0 end as sp,
    case when nt is null then null when nt = ct then 'infinity'::double when nt < ct then 'nan'::double else {HAVERSINE.format(a="c_", b="n_")} / (nt - ct) * 3600.0 end as sn from cand),
kin as (
  select *, coalesce(sp > 80 and not isnan(sp), false) as fp, coalesce(sn > 80 and not isnan(sn), false) as fn, case when sp is not null or sn is not null then coalesce(sp * sp, 0) + coalesce(sn * sn, 0) end as score from kin0)"""

FIRST_PASS = (LABELS, SPINE, BLOCKS, SINGLES, GROUPS)

query("cor_participation", sql("""select track_id, case when ts = 0 or pos = 0 then 'geometry-only' when cov < 0.8 then 'timestamp-sparse' else 'full' end as mode, cov as coverage,
  case when ts = 0 then 'no-parseable-timestamps' when pos = 0 then 'all-timestamps-uniform' when cov < 0.8 then 'insufficient-pair-coverage' end as reason
from (select track_id, ts, coalesce(pos, 0) as pos, case when tp > 0 then pos / tp else 0 end as cov from (select track_id, count(time_ms) as ts from pts group by 1)
  left join (select track_id, count(dt_ms) as tp, count(*) filter (where dt_ms > 0) as pos from edge group by 1) using (track_id))""", EDGES))(
    lambda s, d: presegment.participation(sampling.context(points(s, d), steps(s, d))))
query("cor_immediate_pairs", sql("select * from near", NEAR))(lambda s, d: presegment.immediate_pairs(points(s, d)))
query("cor_segment_profiles", sql("select * from prof", LABELS, PAIRS, NEAR, PROFILES))(profiles)
query("cor_boundary_class", sql("select * from bnd", BOUNDS))(classes)
query("cor_boundary_annotations", sql("""select track_id, to_seg as trk_seg_index, case when classification = 'timestamp_discontinuity' then classification else 'segment_boundary_gap' end as kind, from_seg, gap_ms, offset_hours
from bnd where classification = 'timestamp_discontinuity' or is_gap""", BOUNDS))(lambda s, d: presegment.boundary_annotations(classes(s, d)))
query("cor_cross_segment_duplicates", sql("select * from xdup", CROSS))(lambda s, d: presegment.cross_segment_duplicates(points(s, d)))
query("cor_objective_dedupe", sql("select * from obj", _objective("pts", "obj")))(lambda s, d: presegment.objective_pairs(points(s, d)))
query("cor_deduped_points", sql("""select track_id, gpx_index, trk_seg_index, case when exists (select 1 from obj o where o.track_id = p.track_id and o.keep = p.gpx_index and action = 'drop_clear') then null else ele end as ele
from pts p where not exists (select 1 from obj o where o.track_id = p.track_id and o.other = p.gpx_index and action in ('drop', 'drop_clear'))""", _objective("pts", "obj")))(
    lambda s, d: presegment.apply_objective(points(s, d), presegment.objective_pairs(points(s, d))).select("track_id", "gpx_index", "trk_seg_index", "ele"))
query("cor_idle_segments", sql("""select s.track_id, s.trk_seg_index, below_anchor = 0 and below_prev_valid = 0 and non_adjacent_repeat = 0 and positive_pairs = pairs and split.track_id is null as idle
from segsum s left join split on split.track_id = s.track_id and split.trk_seg_index = s.trk_seg_index""", LABELS, PAIRS, SPLIT))(lambda s, d: presegment.idle_segments(summary(s, d), points(s, d)))
query("cor_global_reversal", sql("""select f.track_id, bool_and(falls and split.track_id is null) as accepted from fall f left join split on split.track_id = f.track_id and split.trk_seg_index = f.trk_seg_index group by 1""", SPLIT, FALL))(
    lambda s, d: presegment.global_reversal(points(s, d)))
query("cor_segment_reversals", sql("select * from rv", LABELS, PAIRS, NEAR, PROFILES, FALL, REVERSALS))(lambda s, d: presegment.segment_reversals(points(s, d), profiles(s, d)))
query("cor_chunk_order", sql("select * from chk", BOUNDS, SUMMARIES, CHUNKS))(lambda s, d: presegment.chunk_order(classes(s, d), ingestion.segment_summaries(raw(s, d))))
query("cor_chunk_reorder", sql("""select p.track_id, p.gpx_index, p.trk_seg_index, row_number() over (partition by p.track_id order by coalesce(b.trk_seg_index, p.trk_seg_index), gpx_index) - 1 as position
from pts p left join chk a on a.track_id = p.track_id and a.trk_seg_index = p.trk_seg_index left join chk b on b.track_id = a.track_id and b.slot = a.new_slot""", BOUNDS, SUMMARIES, CHUNKS))(
    lambda s, d: presegment.reorder_chunks(points(s, d), presegment.chunk_order(classes(s, d), ingestion.segment_summaries(raw(s, d)))).select("track_id", "gpx_index", "trk_seg_index", "position"))
query("cor_duplicate_chunk_drop", sql("""select p.track_id, p.gpx_index, 'duplicate_chunk_segment' as reason from pts p
where exists (select 1 from bnd b where b.track_id = p.track_id and b.to_seg = p.trk_seg_index and classification = 'duplicate_chunk')""", BOUNDS))(lambda s, d: presegment.duplicate_chunk_points(points(s, d), classes(s, d)))


@stored
def env(s, d):
    return spines.envelopes(points(s, d))


@stored
def blocks(s, d):
    return proposals.blocks(labelled(s, d), env(s, d))


@stored
def groups(s, d):
    return proposals.same_time_groups(points(s, d), env(s, d))


@stored
def inserts(s, d):
    return proposals.inserts(proposals.singletons(labelled(s, d), env(s, d)), groups(s, d))


@stored
def overlap(s, d):
    return gates.overlap_blocks(blocks(s, d), spines.spine(points(s, d)))


@stored
def coupling(s, d):
    return gates.coupling_edges(points(s, d), inserts(s, d), overlap(s, d))


@stored
def checked(s, d):
    return apply.kinematic_check(apply.insert_candidates(inserts(s, d), points(s, d)))


def _list(df, *columns):
    """df with arrays as text, which both engines print alike."""
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in columns})


query("spn_spine", sql("select track_id, trk_seg_index, gpx_index, time_ms from spn", SPINE))(lambda s, d: spines.spine(points(s, d)).select("track_id", "trk_seg_index", "gpx_index", "time_ms"))
query("spn_envelope", sql("select * from env", SPINE))(env)
query("prp_blocks", sql("select track_id, trk_seg_index, first_gpx, last_gpx, length, array_to_string(members, ',') as members, violation, b_min, b_max, is_edge from blk", LABELS, SPINE, BLOCKS))(lambda s, d: _list(blocks(s, d), "members"))
query("prp_singletons", sql("select * from sng", LABELS, SPINE, BLOCKS, SINGLES))(lambda s, d: proposals.singletons(labelled(s, d), env(s, d)))
query("prp_exact_drops", sql("select * from exd", *FIRST_PASS))(lambda s, d: proposals.exact_drops(points(s, d)))
query("prp_same_time_groups", sql("select * replace (array_to_string(members, ',') as members) from gsm", *FIRST_PASS))(lambda s, d: _list(groups(s, d), "members"))
query("gat_edge_sides", sql("""select track_id, trk_seg_index, key, side, row_number() over (partition by track_id, trk_seg_index, side order by kind, spot) = 1 as staged from (
  select track_id, trk_seg_index, key, kind, spot, case when env_min is null or lo <= env_min then 'firstEdge' else 'lastEdge' end as side from (
    select track_id, trk_seg_index, 'block:' || first_gpx as key, b_min as lo, 0 as kind, first_gpx as spot from blk where is_edge
    union all select track_id, trk_seg_index, key, target_ms, case when key like 'single%' then 1 else 2 end, members[1] from ins where is_edge) join env using (track_id, trk_seg_index))""", *FIRST_PASS))(
    lambda s, d: gates.edge_sides(inserts(s, d), blocks(s, d), env(s, d)))
query("gat_overlap_block", sql("select * from ovl", *FIRST_PASS, OVERLAP))(overlap)
query("gat_insert_in_block", sql("select * from inb", *FIRST_PASS, CONFLICTS))(lambda s, d: gates.inserts_in_blocks(inserts(s, d), blocks(s, d)))
query("gat_corridor_conflicts", sql("select * from cor", *FIRST_PASS, CONFLICTS))(lambda s, d: gates.corridor_conflicts(inserts(s, d)))
query("gat_coupling_edges", sql("select * from cpl", *FIRST_PASS, OVERLAP, COUPLING))(coupling)
query("gat_blocked", sql("select * from bkd", *FIRST_PASS, OVERLAP, COUPLING))(lambda s, d: gates.blocked(coupling(s, d)))
query("app_applyable", sql("""select track_id, trk_seg_index, key from ins where not is_edge union all select track_id, trk_seg_index, 'block:' || first_gpx from ovl
except (select track_id, trk_seg_index, 'block:' || first_gpx from ovl where status <> 'socket-ok' union select track_id, trk_seg_index, key from inb union select track_id, trk_seg_index, 'block:' || block_first from inb
  union select track_id, trk_seg_index, key_a from cor union select track_id, trk_seg_index, key_b from cor union select track_id, trk_seg_index, key from bkd)""", *FIRST_PASS, OVERLAP, CONFLICTS, COUPLING))(
    lambda s, d: gates.applyable(inserts(s, d), overlap(s, d), coupling(s, d), gates.inserts_in_blocks(inserts(s, d), blocks(s, d)), gates.corridor_conflicts(inserts(s, d))))
_SPEEDS = ("speed_prev", "speed_next", "score")
query("app_kinematic_check", sql("""select track_id, trk_seg_index, key, gpx_index, case when isfinite(sp) then round(sp, 5) end as speed_prev, case when isfinite(sn) then round(sn, 5) end as speed_next, case when isfinite(score) then round(score, 3) end as score,
  coalesce(isinf(sp), false) as zero_prev, coalesce(isinf(sn), false) as zero_next, (sp is not null or sn is not null) and not fp and not fn as passed,
  case when sp is null and sn is null then 'no_bracket' when fp and fn then 'both_exceeded' when fp then 'speed_prev_exceeded' when fn then 'speed_next_exceeded' end as fail_reason from kin""", *FIRST_PASS, KINEMATIC))(
    lambda s, d: checked(s, d).withColumns({"zero_prev": F.coalesce(F.col("speed_prev") == float("inf"), F.lit(False)), "zero_next": F.coalesce(F.col("speed_next") == float("inf"), F.lit(False))}).withColumns(
        {c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c, 3 if c == "score" else 5)) for c in _SPEEDS}).select("track_id", "trk_seg_index", "key", "gpx_index", *_SPEEDS, "zero_prev", "zero_next", "passed", "fail_reason"))
query("app_competition_winner", sql("""select track_id, trk_seg_index, key, winner, n, all_failed from (
  select track_id, trk_seg_index, key, gpx_index as winner, n, not bool_or(ok) over (partition by track_id, key) as all_failed,
    row_number() over (partition by track_id, key order by ok desc, case when score is null or isnan(score) then 'infinity'::double else score end, gpx_index) as r
  from (select *, (sp is not null or sn is not null) and not fp and not fn as ok from kin) where n >= 2) where r = 1""", *FIRST_PASS, KINEMATIC))(
    lambda s, d: apply.competition_winners(checked(s, d)).withColumn("n", F.col("n").cast("long")))

SEAMS = """
sem0 as (
  select track_id, trk_seg_index, max(gpx_index) as keep, lead(min(gpx_index)) over w as drop, lead(trk_seg_index) over w as to_seg from pts group by track_id, trk_seg_index window w as (partition by track_id order by trk_seg_index)),
sem as (
  select s.track_id, trk_seg_index as from_seg, to_seg, keep, drop, exists (select 1 from spn where spn.track_id = s.track_id and spn.gpx_index = keep) and exists (select 1 from spn where spn.track_id = s.track_id and spn.gpx_index = drop) as stable
  from sem0 s join (select track_id, gpx_index as keep, time_ms, lat, lon, case when not ele_absent then ele end as e from pts) a using (track_id, keep)
  join (select track_id, gpx_index as drop, time_ms as t2, lat as la2, lon as lo2, case when not ele_absent then ele end as e2 from pts) b using (track_id, drop)
  where time_ms > 0 and time_ms = t2 and lat = la2 and lon = lo2 and e is not distinct from e2)"""
query("ph2_cross_segment_drop", sql("select * from sem", SPINE, SEAMS))(lambda s, d: phases.seam_duplicates(points(s, d)))
RESIDUALS = """
res as (select * from (select track_id, trk_seg_index, gpx_index, lag(gpx_index) over w as prev_gpx, lag(time_ms) over w as prev_ms, time_ms, time_ms - lag(time_ms) over w as delta_ms
  from pts where time_ms > 0 window w as (partition by track_id, trk_seg_index order by gpx_index)) where time_ms <= prev_ms)"""
query("ph3_residuals", sql("select * from res", RESIDUALS))(lambda s, d: phases.residuals(points(s, d)))
query("ph3_residual_segments", sql("select track_id, trk_seg_index, count(*) as violations from res group by 1, 2", RESIDUALS))(lambda s, d: phases.residual_segments(phases.residuals(points(s, d))))
query("ph3_same_time_groups", sql("select track_id, trk_seg_index, time_ms, count(*) as n, min(gpx_index) as first_gpx, max(gpx_index) as last_gpx from pts where time_ms > 0 group by 1, 2, 3 having count(*) >= 2"))(lambda s, d: phases.same_time(points(s, d)))
query("ph3_cross_segment_groups", sql("select track_id, time_ms, count(*) as n, count(distinct trk_seg_index) as segments from pts where time_ms > 0 group by 1, 2 having count(distinct trk_seg_index) >= 2"))(
    lambda s, d: phases.cross_segment_same_time(points(s, d)))


def first_stages(s, d):
    """working, drops, excluded after the drops before segments are worked on: cross-segment duplicates, then objective ones; refused
    reversals are excluded."""
    every = points(s, d)
    cross = presegment.cross_segment_duplicates(every).select("track_id", "gpx_index", F.lit(presegment.CROSS_DUPLICATE).alias("reason"))
    left = every.join(cross, ["track_id", "gpx_index"], "left_anti")
    pairs = presegment.objective_pairs(left)
    exact = pairs.filter("action in ('drop', 'drop_clear')").select("track_id", F.col("other").alias("gpx_index"), F.lit(presegment.EXACT_DUPLICATE).alias("reason")).distinct()
    working = presegment.apply_objective(left, pairs)
    refused = presegment.segment_reversals(every, profiles(s, d)).filter("not accepted").select("track_id", "trk_seg_index")
    excluded = working.join(refused, ["track_id", "trk_seg_index"], "left_semi").select("track_id", "gpx_index", F.lit(presegment.REVERSAL_MEMBER).alias("reason"))
    return working, cross.unionByName(exact), excluded


STAGES = (LABELS, PAIRS, NEAR, PROFILES, FALL, REVERSALS, CROSS, "w1 as (select * from pts p where not exists (select 1 from xdup x where x.track_id = p.track_id and x.gpx_index = p.gpx_index))", _objective("w1", "ob2"), """
w2 as (
  select p.* replace (case when exists (select 1 from ob2 o where o.track_id = p.track_id and o.keep = p.gpx_index and action = 'drop_clear') then null else ele end as ele)
  from w1 p where not exists (select 1 from ob2 o where o.track_id = p.track_id and o.other = p.gpx_index and action in ('drop', 'drop_clear'))),
drp as (select track_id, gpx_index from xdup union select track_id, other from ob2 where action in ('drop', 'drop_clear')),
exc as (select w2.track_id, w2.gpx_index from w2 join rv using (track_id, trk_seg_index) where not accepted)""")
query("ph3_coverage", sql("""select track_id, segments, left_n + coalesce(dropped, 0) as total_points, left_n - coalesce(excluded, 0) as trusted, coalesce(dropped, 0) as dropped, coalesce(excluded, 0) as excluded
from (select track_id, count(distinct trk_seg_index) as segments, count(*) as left_n from w2 group by 1) left join (select track_id, count(*) as dropped from drp group by 1) using (track_id) left join (select track_id, count(*) as excluded from exc group by 1) using (track_id)""", *STAGES))(
    lambda s, d: phases.coverage(*first_stages(s, d)))
query("exp_trusted_points", sql("select track_id, gpx_index, trk_seg_index, lat, lon, ele, time_ms from w2 where (track_id, gpx_index) not in (select (track_id, gpx_index) from exc)", *STAGES))(
    lambda s, d: phases.trusted(*[first_stages(s, d)[k] for k in (0, 2)]).select("track_id", "gpx_index", "trk_seg_index", "lat", "lon", "ele", "time_ms"))
query("exp_partition", sql("""select track_id, count(*) as ingested, count(d.g) as drops, count(x.g) as excluded, count(*) - count(d.g) as working, count(*) - count(d.g) - count(x.g) as trusted, true as ok
from pts p left join (select track_id as t, gpx_index as g from drp) d on d.t = p.track_id and d.g = p.gpx_index left join (select track_id as t, gpx_index as g from exc) x on x.t = p.track_id and x.g = p.gpx_index group by 1""", *STAGES))(
    lambda s, d: (lambda w: phases.partition_report(points(s, d), *w))(first_stages(s, d)))


query("rpt_anomalies", sql("select * from (" + " union all ".join(
    [f"select track_id, 'temporal.{t}' as tag, count(*) filter (where {t}) as n from lab group by 1" for t in temporal.TAGS] + [f"select track_id, 'motion.{t}', count(*) filter (where {t}) from mot group by 1" for t in motion.FLAGS]) + ") where n > 0", LABELS, EDGES, MOTION))(
    lambda s, d: report.anomalies(temporal.tag_counts(labelled(s, d)), motion.tag_counts(motion.pair_flags(steps(s, d)))))
query("rpt_segment_days", sql("select track_id, trk_seg_index, strftime(epoch_ms(min_ms), '%Y-%m-%d') as first_day, strftime(epoch_ms(max_ms), '%Y-%m-%d') as last_day from rng", BOUNDS))(
    lambda s, d: report.segment_days(ingestion.segment_boundaries(points(s, d))))


@stored
def correction_log(s, d):
    return correction.correct(raw(s, d))


query("correct_full", None)(lambda s, d: correction.correct(raw(s, d)))
query("correct_partition", None)(lambda s, d: correction.partition(correction.correct(raw(s, d))))


def calm(s, d):
    """Segments whose own labels and steps are clean, each as a track: what correction finishes without its grouped step, among others that it does not."""
    odd = raw(s, d).withColumn("track_id", F.col("track_id") * 1_000_000 + F.col("trk_seg_index"))
    late = F.max("time_ms").over(Window.partitionBy("track_id").orderBy("gpx_index").rowsBetween(Window.unboundedPreceding, -1))
    return odd.withColumn("_late", late).filter("time_ms is null or _late is null or time_ms >= _late or track_id % 3 = 0").drop("_late")


query("correct_finished", sql("""select track_id, count(*) as ingested, count(d.g) as drops, 0::bigint as excluded, count(*) - count(d.g) as working, count(*) - count(d.g) as trusted, true as ok
from pts p join done using (track_id) left join (select track_id as t, gpx_index as g from drp) d on d.t = p.track_id and d.g = p.gpx_index group by 1""", """
raw_all as (select * from raw),
calm0 as (select * replace (track_id * 1000000 + trk_seg_index as track_id) from raw_all),
calm as (select * exclude (late) from (select *, max(time_ms) over (partition by track_id order by gpx_index rows between unbounded preceding and 1 preceding) as late from calm0)
  where time_ms is null or late is null or time_ms >= late or track_id % 3 = 0)""", *(x.replace("from pts", "from calm_pts").replace("join pts", "join calm_pts") for x in ("calm_pts as (select * from calm where lat between -90 and 90 and lon between -180 and 180)", *STAGES)), """
split2 as (select distinct track_id, trk_seg_index from (select track_id, trk_seg_index from w2 where time_ms > 0 group by track_id, trk_seg_index, time_ms having min(lat) <> max(lat) or min(lon) <> max(lon))),
done as (select s.track_id from segsum s left join split2 sp on sp.track_id = s.track_id and sp.trk_seg_index = s.trk_seg_index group by 1
  having bool_and(below_anchor = 0 and below_prev_valid = 0 and non_adjacent_repeat = 0 and positive_pairs = pairs and sp.track_id is null))""").replace("from pts p join done", "from calm_pts p join done"))(
    lambda s, d: (lambda r: correction.partition(correction.correct(r)).join(correction.finished_tracks(temporal.labels(ingestion.accepted(r))), "track_id", "left_semi"))(calm(s, d)))
query("correct_trusted_points", None)(lambda s, d: correction.trusted_points(correction_log(s, d), points(s, d)))
query("rpt_correction_summary", None)(lambda s, d: report.correction_summary(correction_log(s, d)))
query("rpt_corpus_summary", None)(lambda s, d: report.corpus_summary(ingestion.counts(raw(s, d), structure(s, d)), report.anomalies(temporal.tag_counts(labelled(s, d)), motion.tag_counts(motion.pair_flags(steps(s, d)))), correction_log(s, d)))

query("cor_participation_without_audit", sql("""select track_id, case when ts = 0 or pos = 0 then 'geometry-only' when cov < 0.8 then 'timestamp-sparse' else 'full' end as mode, cov as coverage,
  case when ts = 0 then 'no-parseable-timestamps' when pos = 0 then 'all-timestamps-uniform' when cov < 0.8 then 'insufficient-pair-coverage' end as reason
from (select track_id, sum(parseable) as ts, sum(positive_pairs) as pos, case when sum(pairs) > 0 then cast(sum(positive_pairs) as double) / cast(sum(pairs) as double) else 0 end as cov from near group by 1)""", NEAR))(
    lambda s, d: presegment.participation_without_audit(points(s, d)))
query("cor_boundary_class_of_summaries", sql("select * from bnd", SUMMARIES, BOUNDS.replace("rng as (select track_id, trk_seg_index, arg_min_null(time_ms, gpx_index) as first_ms, arg_max_null(time_ms, gpx_index) as last_ms, min(time_ms) as min_ms, max(time_ms) as max_ms from pts group by 1, 2)", "rng as (select track_id, trk_seg_index, first_ms, last_ms, min_ms, max_ms from summ)")))(
    lambda s, d: presegment.boundaries(ingestion.segment_summaries(raw(s, d))))
query("gat_coupled_regions", sql("""select track_id, trk_seg_index, key, least(key, min(other)) as region from reach group by 1, 2, 3""", *FIRST_PASS, OVERLAP, COUPLING, """
cpl2 as (select track_id, trk_seg_index, key_a, key_b from cpl union select track_id, trk_seg_index, key_b, key_a from cpl),
reach(track_id, trk_seg_index, key, other) as (
  select * from cpl2 union select r.track_id, r.trk_seg_index, r.key, c.key_b from reach r join cpl2 c on c.track_id = r.track_id and c.trk_seg_index = r.trk_seg_index and c.key_a = r.other)"""))(
    lambda s, d: gates.coupled_regions(coupling(s, d)))
query("exp_spine_intervals", sql("""select track_id, trk_seg_index, env_min, env_max, spine from env left join (select track_id, trk_seg_index, string_agg(gpx_index, ',' order by time_ms) as spine from spn group by 1, 2) using (track_id, trk_seg_index)""", SPINE))(
    lambda s, d: spines.intervals(points(s, d)).withColumn("spine", F.array_join(F.transform("spine", lambda p: p["gpx_index"].cast("string")), ",")))
