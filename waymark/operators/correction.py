"""Correction of whole corpora: labels and ranges by DataFrame, then one grouped step for each track that needs it.

Tracks in which nothing is left to correct after the objective drops are finished by joins and anti joins and never reach
Python; the others are dealt by track_id, one track a task at a time.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from . import ingestion, presegment, temporal
from .track_state import Params, Point, Segment, Track

#: One row for each fact: entry says which (working, drop, excluded, annotation, rearrangement, proposal, pass, profile, error).
LOG = "track_id long, entry string, seq long, gpx_index long, trk_seg_index int, kind string, stage string, details string"
_COLUMNS = [c.split()[0] for c in LOG.split(", ")]
#: How the error of a track begins whose points are not each in one part.
PARTITION = "partition violated"
_TAGS = ("below_anchor", "below_prev_valid", "non_adjacent_repeat", "adjacent_duplicate")


def _plain(x):
    """JSON has no NaN or Infinity: they are null."""
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple, set)) else x


def _none(x):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) or x is pd.NA else x


def load(rows: pd.DataFrame, params: Params) -> Track:
    """The state of a track from its labelled points (any order) with least_ms, the least time of the segment before rejection."""
    rows = rows.sort_values("gpx_index", kind="stable")
    whole = lambda v: None if _none(v) is None else int(v)
    points = [
        Point(int(r.gpx_index), int(r.trk_seg_index), float(r.lat), float(r.lon), _none(r.ele), bool(r.ele_absent), whole(r.time_ms))
        for r in rows.itertuples()]
    by_seg: dict[int, list[Point]] = {}
    for p in points:
        by_seg.setdefault(p.seg, []).append(p)
    tags = {seg: {t: set() for t in _TAGS} for seg in by_seg}
    for r in rows.itertuples():
        for t in _TAGS:
            if getattr(r, t):
                tags[int(r.trk_seg_index)][t].add(int(r.gpx_index))
    segments = []
    for seg, pts in by_seg.items():
        times = [p.time for p in pts if p.time is not None]
        near = [(a.time, b.time) for a, b in zip(pts, pts[1:]) if a.time is not None and b.time is not None]
        s = Segment(seg, tags[seg], max(len(times) - 1, 0), sum(a < b for a, b in zip(times, times[1:])), len(times))
        s.coverage = s.positive / s.pairs if s.pairs else 0.0
        s.reversed_ = len(times) >= 2 and bool(near) and all(b < a for a, b in near)
        s.anomalies = any(s.tags.values())
        low = s.coverage < (params.min_coverage or 0.8)
        s.mode = "geometry-only" if not times or (not s.positive and not s.reversed_) else "fully-reversed" if s.reversed_ else "timestamp-sparse" if low else "full"
        segments.append(s)
    edges = []
    order = sorted(by_seg)
    for a, b in zip(order, order[1:]):
        last, first = by_seg[a][-1].ms, by_seg[b][0].ms
        gap = None if last is None or first is None else first - last
        kind = hours = None
        if gap is not None and gap < 0:
            back = -gap / 3_600_000
            near_hour = math.floor(back + 0.5)
            ranges = [[p.ms for p in by_seg[k] if p.ms is not None] for k in (a, b)]
            if near_hour >= 1 and abs(back - near_hour) <= params.zone_tolerance:
                kind, hours = "timestamp_discontinuity", near_hour
            else:
                kind = "duplicate_chunk" if min(ranges[1]) < max(ranges[0]) and max(ranges[1]) > min(ranges[0]) else "chunk_ordering"
        elif gap:
            kind = "same_day" if last // 86_400_000 == first // 86_400_000 else "cross_day"
        edges.append({"from_seg": a, "to_seg": b, "classification": kind, "is_gap": bool(gap and gap > 0), "gap_ms": gap, "offset_hours": hours})
    least = {int(k): whole(v) for k, v in rows.groupby("trk_seg_index")["least_ms"].first().items()}
    return Track(points, segments, edges, least, params)


def correct_track(rows: pd.DataFrame, params: Params) -> pd.DataFrame:
    """The log of one track. A track that breaks a rule of the state or the partition gives a single error row."""
    track_id = int(rows["track_id"].iloc[0])
    out: list[tuple] = []

    def add(entry, seq, gpx=None, seg=None, kind=None, stage=None, details=None):
        out.append((track_id, entry, seq, gpx, seg, kind, stage, json.dumps(_plain(details)) if details else None))

    try:
        track = load(rows, params)
        track.run()
        wrong = {k: v for k, v in track.violations().items() if v}
        if wrong:
            raise ValueError(f"{PARTITION}: {wrong}")
    except ValueError as e:
        add("error", 0, kind=str(e))
        return pd.DataFrame(out, columns=_COLUMNS)
    log = track.log
    for k, p in enumerate(track.order):
        add("working", k, p.gpx, p.seg, details={"cleared": True} if p.gpx in track.cleared else None)
    for k, (g, (reason, stage)) in enumerate(log.drops.items()):
        add("drop", k, g, None, reason, stage)
    for k, (g, (reason, stage, details)) in enumerate(log.excluded.items()):
        add("excluded", k, g, None, reason, stage, details)
    for k, n in enumerate(log.notes):
        add("annotation", k, None, n["seg"], n["kind"], n["scope"], {"proposal_id": n["proposal"]} | n["details"])
    for k, m in enumerate(log.moves):
        add("rearrangement", k, None, m["details"].get("seg"), m["kind"], m["stage"], m["details"])
    for k, p in enumerate(log.proposals):
        row = {x: v for x, v in vars(p).items() if x not in ("kind", "seg")} | {"prev": p.prev and p.prev.gpx, "next": p.next and p.next.gpx}
        add("proposal", k, p.members[0], p.seg, p.kind, p.skip or "applied", row)
    for k, f in enumerate(log.passes):
        add("pass", k, None, f["seg"], f["exit_reason"], None, f)
    for k, s in enumerate(track.segments):
        row = {"coverage": s.coverage, "is_fully_reversed": s.reversed_, "has_anomalies": s.anomalies, "has_usable_times": s.parseable >= 2, "idle": s.idle, "iterations": s.iterations, "envelope": s.envelope}
        add("profile", k, None, s.index, s.mode, s.exit_reason, row)
    return pd.DataFrame(out, columns=_COLUMNS)


def objective_drops(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The points left after cross-segment and objective duplicates, and the drops."""
    cross = presegment.cross_segment_duplicates(labelled).select("track_id", "gpx_index", F.lit(presegment.CROSS_DUPLICATE).alias("kind"), F.lit("pre-segment").alias("stage"))
    left = labelled.join(cross, ["track_id", "gpx_index"], "left_anti")
    pairs = presegment.objective_pairs(left)
    exact = pairs.filter("action in ('drop', 'drop_clear')").select("track_id", F.col("other").alias("gpx_index"), F.lit(presegment.EXACT_DUPLICATE).alias("kind"), F.lit("pre-segment-objective-dedupe").alias("stage")).distinct()
    return presegment.apply_objective(left, pairs), cross.unionByName(exact)


def finished_tracks(labelled: DataFrame) -> DataFrame:
    """track_id of the tracks in which nothing is left to correct after the objective drops."""
    working, _ = objective_drops(labelled)
    idle = presegment.idle_segments(temporal.segment_summary(labelled), working)
    return idle.groupBy("track_id").agg(F.bool_and("idle").alias("done")).filter("done").select("track_id")


def correct(raw: DataFrame, params: Params | None = None) -> DataFrame:
    """The correction log (LOG) of all tracks of raw points."""
    params = params or Params()
    labelled = written(temporal.labels(ingestion.accepted(raw)), "labelled")
    done = written(finished_tracks(labelled), "finished")  # ids alone, read three times
    working, drops = objective_drops(labelled.join(done, "track_id", "left_semi"))
    blank = lambda t: F.lit(None).cast(t)
    kept = working.select("track_id", F.lit("working").alias("entry"), F.col("gpx_index").alias("seq"), "gpx_index", "trk_seg_index", blank("string").alias("kind"), blank("string").alias("stage"), blank("string").alias("details"))
    dropped = drops.select("track_id", F.lit("drop").alias("entry"), F.col("gpx_index").alias("seq"), "gpx_index", blank("int").alias("trk_seg_index"), "kind", "stage", blank("string").alias("details"))
    least = ingestion.segment_summaries(raw).select("track_id", "trk_seg_index", F.col("min_ms").alias("least_ms"))
    rest = labelled.join(done, "track_id", "left_anti").join(least, ["track_id", "trk_seg_index"], "left")
    rest = rest.select("track_id", "gpx_index", "trk_seg_index", "lat", "lon", "ele", "ele_absent", "time_ms", "least_ms", *_TAGS)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        return correct_track(rows, params)

    keys = labelled.join(done, "track_id", "left_semi")
    profiles = presegment.segment_profiles(temporal.segment_summary(keys), keys)
    details = F.to_json(F.struct("coverage", "is_fully_reversed", "has_anomalies", "has_usable_times", F.lit(True).alias("idle"), F.lit(0).alias("iterations")))
    profiles = profiles.select("track_id", F.lit("profile").alias("entry"), F.col("trk_seg_index").cast("long").alias("seq"), blank("long").alias("gpx_index"), "trk_seg_index", F.col("mode").alias("kind"), blank("string").alias("stage"), details.alias("details"))
    return kept.unionByName(dropped).unionByName(profiles).unionByName(rest.groupBy("track_id").applyInPandas(one, LOG))


def entries(log: DataFrame, entry: str) -> DataFrame:
    return log.filter(F.col("entry") == entry)


def partition(log: DataFrame) -> DataFrame:
    """For each track the sizes of its parts, and whether it ended without an error."""
    count = lambda e: F.count_if(F.col("entry") == e)
    out = log.groupBy("track_id").agg(count("drop").alias("drops"), count("excluded").alias("excluded"), count("working").alias("working"), (count("error") == 0).alias("ok"))
    return out.withColumn("ingested", F.col("drops") + F.col("working")).withColumn("trusted", F.col("working") - F.col("excluded"))


def trusted_points(log: DataFrame, points: DataFrame) -> DataFrame:
    """The trusted points in their final order (position)."""
    keys = ["track_id", "gpx_index"]
    left = entries(log, "working").select(*keys, F.col("seq").alias("position"), F.col("details").isNotNull().alias("_cleared"))
    left = left.join(entries(log, "excluded").select(*keys), keys, "left_anti")
    out = left.join(points.select(*keys, "trk_seg_index", "lat", "lon", "ele", "time_ms"), keys)
    return out.withColumn("ele", F.when(~F.col("_cleared"), F.col("ele"))).drop("_cleared")
