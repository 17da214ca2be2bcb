"""Correction of one track: the bounded, order-dependent part that joins and windows can't express.

A track's points are few enough for one task. The result is a flat log of entries; correction.py turns it into tables.
Fixed names (reasons, kinds, stages, exit reasons) are those of the output documents.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from typing import Any, NamedTuple

EARTH_RADIUS_M = 6_371_000.0
FIRST, LAST = "firstEdge", "lastEdge"


class Point(NamedTuple):
    gpx: int
    seg: int
    lat: float
    lon: float
    ele: float | None
    ele_absent: bool
    ms: int | None

    @property
    def time(self) -> int | None:
        """The time, if correction works with it."""
        return self.ms if self.ms is not None and self.ms > 0 else None

    @property
    def height(self) -> float | None:
        return None if self.ele_absent else self.ele


@dataclass
class Params:
    lenient_kph: float = 80.0
    max_passes: int = 500
    min_coverage: float = 0.8
    zone_tolerance: float = 0.1
    ele_floor: float = -500.0
    ele_ceiling: float = 9500.0


@dataclass
class Segment:
    """What the audit says of a segment, and its profile."""

    index: int
    tags: dict[str, set[int]]
    pairs: int
    positive: int
    parseable: int
    mode: str = "full"
    coverage: float = 0.0
    reversed_: bool = False
    anomalies: bool = False
    idle: bool = False
    exit_reason: str | None = None
    iterations: int = 0
    envelope: tuple[int | None, int | None] = (None, None)


@dataclass
class Proposal:
    kind: str  # block-finding, insert, adjacent-exact-drop
    id: str
    seg: int
    members: list[int]
    edge: bool = False
    exact: bool = False
    target: int | None = None
    low: int | None = None
    high: int | None = None
    violation: bool = False
    prev: Point | None = None
    next: Point | None = None
    status: str | None = None
    winner: int | None = None
    applied: bool | None = None
    skip: str | None = None
    kinematics: dict | None = None


@dataclass
class Log:
    """drops and excluded: the first entry for a point counts."""

    drops: dict[int, tuple[str, str]] = field(default_factory=dict)
    excluded: dict[int, tuple[str, str, dict]] = field(default_factory=dict)
    notes: list[dict] = field(default_factory=list)
    moves: list[dict] = field(default_factory=list)
    proposals: list[Proposal] = field(default_factory=list)
    passes: list[dict] = field(default_factory=list)

    def drop(self, gpx: int, reason: str, stage: str) -> None:
        self.drops.setdefault(gpx, (reason, stage))

    def exclude(self, gpx: int, reason: str, stage: str, **details: Any) -> None:
        self.excluded.setdefault(gpx, (reason, stage, details))

    def note(self, scope: str, kind: str, seg: int | None = None, proposal: str | None = None, **details: Any) -> None:
        self.notes.append({"scope": scope, "kind": kind, "seg": seg, "proposal": proposal, "details": details})

    def move(self, kind: str, stage: str, **details: Any) -> None:
        self.moves.append({"kind": kind, "stage": stage, "details": details})


def metres(a: Point, b: Point) -> float:
    p, q = math.radians(a.lat), math.radians(b.lat)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b.lon - a.lon) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def implied_kph(a: Point, b: Point) -> float:
    dt = (b.ms or 0) - (a.ms or 0)
    return math.inf if dt == 0 else math.nan if dt < 0 else metres(a, b) / dt * 3600.0


def check(prev: Point | None, at_prev: Point, at_next: Point, nxt: Point | None, limit: float) -> dict:
    """Speeds to the anchors. A step back (not a number) passes, equal times (infinite) fail, no anchor at all fails."""
    a = implied_kph(prev, at_prev) if prev else None
    b = implied_kph(at_next, nxt) if nxt else None
    fast_a, fast_b = a is not None and a > limit, b is not None and b > limit
    known = [s * s for s in (a, b) if s is not None]
    reason = "no_bracket" if not known else "both_exceeded" if fast_a and fast_b else "speed_prev_exceeded" if fast_a else "speed_next_exceeded" if fast_b else None
    return {"speed_prev_kph": a, "speed_next_kph": b, "score": sum(known) if known else None, "threshold_kph": limit, "passed": reason is None, "fail_reason": reason}


def exact_pair(a: Point, b: Point) -> bool:
    return a.time is not None and a.time == b.time and (a.lat, a.lon, a.height) == (b.lat, b.lon, b.height)


class Track:
    def __init__(self, points: list[Point], segments: list[Segment], boundaries: list[dict], least_ms: dict[int, int | None], params: Params):
        self.order, self.params, self.log = list(points), params, Log()
        self.segments = sorted(segments, key=lambda s: s.index)
        self.boundaries, self.least_ms = boundaries, least_ms
        self.staged: dict[int, dict[str, Proposal]] = {}
        self.resolved: set[int] = set()
        self.cleared: set[int] = set()
        self.numbers = Counter()

    # ---- views of the working order
    def by_segment(self) -> dict[int, list[Point]]:
        out: dict[int, list[Point]] = {}
        for p in self.order:
            out.setdefault(p.seg, []).append(p)
        return out

    def of(self, seg: int) -> list[Point]:
        return [p for p in self.order if p.seg == seg]

    def remove(self, gpxs: set[int]) -> None:
        self.order = [p for p in self.order if p.gpx not in gpxs]

    def relocate(self, run: list[int], after: int | None) -> bool:
        """Move a run behind a point (None: to the very start). False, and nothing moved, if something is not there."""
        place = {g: k for k, g in enumerate(run)}
        moved = sorted((p for p in self.order if p.gpx in place), key=lambda p: place[p.gpx])
        rest = [p for p in self.order if p.gpx not in place]
        at = 0 if after is None else next((k + 1 for k, p in enumerate(rest) if p.gpx == after), -1)
        if len(moved) != len(run) or at < 0:
            return False
        self.order = rest[:at] + moved + rest[at:]
        return True

    @staticmethod
    def spine(points: list[Point]) -> list[Point]:
        often = Counter(p.time for p in points)
        out: list[Point] = []
        for p in points:
            if p.time is not None and often[p.time] == 1 and (not out or p.time > out[-1].time):
                out.append(p)
        return out

    # ---- before the segments
    def cross_segment_duplicates(self) -> None:
        parts = list(self.by_segment().values())
        seams = {frozenset((a[-1].gpx, b[0].gpx)) for a, b in zip(parts, parts[1:])}
        times: dict[int, list[Point]] = {}
        for p in self.order:
            if p.time is not None:
                times.setdefault(p.time, []).append(p)
        gone = set()
        for group in times.values():
            if len({p.seg for p in group}) < 2 or (len(group) == 2 and frozenset(p.gpx for p in group) in seams):
                continue
            for p in group:
                self.log.drop(p.gpx, "cross_segment_duplicate", "pre-segment")
                gone.add(p.gpx)
        self.remove(gone)

    def objective_duplicates(self) -> None:
        stage = "pre-segment-objective-dedupe"

        def kind(p: Point) -> str:
            if p.height is None or not math.isfinite(p.height):
                return "absent"
            return "usable" if self.params.ele_floor <= p.height <= self.params.ele_ceiling else "oob"

        gone, clear = set(), set()
        for a, b in zip(self.order, self.order[1:]):
            if b.gpx != a.gpx + 1 or a.seg != b.seg or a.time is None or (a.time, a.lat, a.lon) != (b.time, b.lat, b.lon):
                continue
            ka, kb = kind(a), kind(b)
            if {ka, kb} == {"absent", "oob"}:
                continue
            if ka == kb == "usable" and a.ele != b.ele:
                self.log.note("proposal", "adjacent_duplicate_ele_mismatch", a.seg, f"adjacent-pair:{a.gpx}:{b.gpx}", a_ele=a.ele, b_ele=b.ele)
                continue
            loser = a if kb == "usable" and ka != "usable" else b
            if ka == kb == "oob":
                clear.add(a.gpx)
            self.log.drop(loser.gpx, "adjacent-exact-duplicate", stage)
            gone.add(loser.gpx)
        self.order = [p._replace(ele=None) if p.gpx in clear else p for p in self.order if p.gpx not in gone]
        self.cleared = clear

    def find_idle(self) -> bool:
        """Set every segment's idle flag from the audit's labels, which stay as they were, and the present points."""
        parts = self.by_segment()
        for s in self.segments:
            clean = not (s.tags["below_anchor"] or s.tags["below_prev_valid"] or s.tags["non_adjacent_repeat"]) and s.positive == s.pairs
            s.idle = clean and not self.split_times(parts.get(s.index, []))
        return all(s.idle for s in self.segments)

    @staticmethod
    def split_times(points: list[Point]) -> bool:
        spots: dict[int, tuple[float, float]] = {}
        return any(p.time is not None and spots.setdefault(p.time, (p.lat, p.lon)) != (p.lat, p.lon) for p in points)

    @staticmethod
    def rises(points: list[Point]) -> bool:
        times = [p.time for p in points if p.time is not None]
        return all(a < b for a, b in zip(times, times[1:]))

    def reversals(self) -> None:
        stage, parts = "reversal-check", self.by_segment()
        turned = {seg: pts[::-1] for seg, pts in parts.items()}
        if all(self.rises(turned.get(s.index, [])) and not self.split_times(parts.get(s.index, [])) for s in self.segments):
            self.order.reverse()
            self.log.move("full-array-reversal", stage, count=len(self.order))
            return
        self.log.note("session", "reversal_unconfirmed", reason="reversed-snapshot-not-correction-idle")
        times = {seg: [p.time for p in pts if p.time is not None] for seg, pts in parts.items()}
        indexes = sorted(parts)
        for s in self.segments:
            pts = parts.get(s.index, [])
            if not s.reversed_ or len(pts) < 2:
                continue
            k, own = indexes.index(s.index), times[s.index]
            before = times[indexes[k - 1]] if k else []
            after = times[indexes[k + 1]] if k + 1 < len(indexes) else []
            fits = not (before and own and min(own) < max(before)) and not (after and own and max(own) > min(after))
            if self.rises(turned[s.index]) and fits:
                there = iter(turned[s.index])
                self.order = [next(there) if p.seg == s.index else p for p in self.order]
                self.log.move("segment-reversal", stage, seg=s.index, count=len(pts))
                self.log.note("segment", "is_fully_reversed", s.index, count=len(pts))
            else:
                self.log.note("segment", "segment_reversal_unconfirmed", s.index, internal_monotonic=self.rises(turned[s.index]), seam_ok=fits)
                for p in pts:
                    self.log.exclude(p.gpx, "reversal_unconfirmed_member", "pre-segment", seg=s.index)

    def export_fixes(self) -> None:
        stage = "deterministic-export-fix"
        touched = sorted({b[k] for b in self.boundaries if b["classification"] == "chunk_ordering" for k in ("from_seg", "to_seg")})
        wanted = sorted(touched, key=lambda s: (self.least_ms.get(s) is None, self.least_ms.get(s) or 0))
        if wanted != touched:
            parts = self.by_segment()
            turn = iter(wanted)
            places = [next(turn, seg) if seg in touched else seg for seg in parts]
            self.order = [p for seg in places for p in parts.get(seg, [])]
            self.log.move("segment-chunk-reorder", stage, affected=touched, new_order=wanted)
            for k, (a, b) in enumerate(zip(touched, wanted)):
                if a != b:
                    self.log.note("segment", "chunk_ordering_resolved", b, previous=touched.index(b), new=k)
        for b in self.boundaries:
            if b["classification"] == "duplicate_chunk":
                gone = [p.gpx for p in self.of(b["to_seg"])]
                for g in gone:
                    self.log.drop(g, "duplicate_chunk_segment", stage)
                self.remove(set(gone))
                self.log.note("segment", "duplicate_chunk_excluded", b["to_seg"], dropped=gone, beside=b["from_seg"], gap_ms=b["gap_ms"])
                for s in self.segments:
                    if s.index == b["to_seg"]:
                        s.mode, s.exit_reason = "geometry-only", "duplicate-chunk-excluded"
        for b in self.boundaries:
            if b["classification"] == "timestamp_discontinuity":
                self.log.note("segment", "timestamp_discontinuity", b["to_seg"], from_seg=b["from_seg"], gap_ms=b["gap_ms"], offset_hours=b["offset_hours"])
        for b in self.boundaries:
            if b["is_gap"]:
                self.log.note("segment", "segment_boundary_gap", b["to_seg"], from_seg=b["from_seg"], gap_ms=b["gap_ms"])

    # ---- proposals of one pass over one segment
    def _id(self, kind: str, seg: int) -> str:
        self.numbers[kind] += 1
        return f"{kind}:{seg}:{self.numbers[kind]}"

    @staticmethod
    def at_edge(low: int | None, high: int | None, env: tuple) -> bool:
        return env[0] is None or (low is not None and high is not None and (low <= env[0] or high >= env[1]))

    def propose(self, s: Segment, env: tuple) -> list[Proposal]:
        pts, below = self.of(s.index), s.tags["below_anchor"]
        skip = self.log.excluded.keys() | self.resolved
        runs: list[list[int]] = []
        for k, p in enumerate(pts):
            if p.gpx in below and p.gpx not in skip:
                if k and runs and runs[-1][-1] == k - 1:
                    runs[-1].append(k)
                else:
                    runs.append([k])
        timed = [k for k, p in enumerate(pts) if p.time is not None]
        # a point moved to the very start may lie apart from its segment; a bracket does not reach over foreign points
        places = [k for k, p in enumerate(self.order) if p.seg == s.index]
        together = lambda a, b: places[b] - places[a] == b - a
        out = []
        for run in runs:
            if len(run) > 1:
                times = [pts[k].time for k in run]
                known = [t for t in times if t is not None]
                low, high = (min(known), max(known)) if known else (None, None)
                falls = any(a is None or b is None or b <= a for a, b in zip([pts[k].ms for k in run], [pts[k].ms for k in run[1:]]))
                out.append(Proposal("block-finding", self._id("block", s.index), s.index, [pts[k].gpx for k in run], self.at_edge(low, high, env), low=low, high=high, violation=falls))
        for run in runs:
            p = pts[run[0]]
            if len(run) == 1 and p.time is not None:
                at = bisect_left(timed, run[0])
                prev = pts[timed[at - 1]] if at and together(timed[at - 1], run[0]) else None
                nxt = pts[timed[at + 1]] if at + 1 < len(timed) and together(run[0], timed[at + 1]) else None
                out.append(Proposal("insert", self._id("insert", s.index), s.index, [p.gpx], self.at_edge(p.time, p.time, env), target=p.time, prev=prev, next=nxt))
        gone = set()
        for a, b in zip(pts, pts[1:]):
            if exact_pair(a, b):
                out.append(Proposal("adjacent-exact-drop", self._id("drop", s.index), s.index, [b.gpx], winner=a.gpx))
                gone.add(b.gpx)
        groups: dict[int, list[int]] = {}
        for k in timed:
            if pts[k].gpx not in gone and pts[k].gpx not in skip:
                groups.setdefault(pts[k].time, []).append(k)
        for t, ks in groups.items():
            if len(ks) < 2:
                continue
            ks = sorted(ks, key=lambda k: pts[k].gpx)
            inside, at = set(ks), bisect_left(timed, ks[0])
            prev = next((pts[k] for k in reversed(timed[:at]) if k not in inside), None)
            nxt = next((pts[k] for k in timed[at + 1 :] if k not in inside), None)
            same = all(exact_pair(pts[ks[0]], pts[k]) for k in ks[1:])
            out.append(Proposal("insert", self._id("insert", s.index), s.index, [pts[k].gpx for k in ks], self.at_edge(t, t, env), same, t, prev=prev, next=nxt))
        return out

    @staticmethod
    def side(p: Proposal, env: tuple) -> str | None:
        if not p.edge or p.kind == "adjacent-exact-drop":
            return None
        low, high = (p.target, p.target) if p.kind == "insert" else (p.low, p.high)
        if env[0] is None or low is None or low <= env[0]:
            return FIRST
        return LAST if high is not None and high >= env[1] else FIRST

    # ---- gates
    def overlap(self, props: list[Proposal], spine: list[Point]) -> set[str]:
        stopped: set[str] = set()
        times = [p.time for p in spine]

        def stop(p: Proposal, kind: str, **details: Any) -> None:
            stopped.add(p.id)
            self.log.note("proposal", kind, p.seg, p.id, **details)

        blocks = [p for p in props if p.kind == "block-finding"]
        for b in blocks:
            if b.violation or b.low is None:
                b.status = "overlap"
                stop(b, "block_internal_monotonicity_fail" if b.violation else "overlap_block", members=b.members)
                continue
            own = set(b.members)
            lo, hi = bisect_left(times, b.low), bisect_right(times, b.high)
            b.prev = next((p for p in reversed(spine[:lo]) if p.gpx not in own), None)
            b.next = next((p for p in spine[hi:] if p.gpx not in own), None)
            if not b.prev and not b.next:
                b.status = "no-bracket"
                stop(b, "overlap_bracket_missing", b_min=b.low, b_max=b.high)
            elif b.prev and b.next and any(p.gpx not in own for p in spine[lo:hi]):
                b.status = "overlap"
                stop(b, "overlap_spine_pierce_detected", b_min=b.low, b_max=b.high)
            else:
                b.status = "socket-ok"
        inserts = [p for p in props if p.kind == "insert" and not p.exact]
        for i in inserts:
            for b in blocks:
                if b.low is not None and b.low <= i.target <= b.high:
                    stop(i, "overlap_singleton_block_conflict", other=b.id)
                    stop(b, "overlap_singleton_block_conflict", other=i.id)
        spans = [(p, p.prev.time if p.prev else -math.inf, p.next.time if p.next else math.inf) for p in inserts]
        for k, (a, alo, ahi) in enumerate(spans):
            for b, blo, bhi in spans[k + 1 :]:
                lo, hi = max(alo, blo), min(ahi, bhi)
                if lo < a.target < hi or lo < b.target < hi:
                    stop(a, "overlap_singleton_singleton_conflict", other=b.id)
                    stop(b, "overlap_singleton_singleton_conflict", other=a.id)
        return stopped

    def coupling(self, props: list[Proposal]) -> set[str]:
        rows = self.order
        place = {p.gpx: k for k, p in enumerate(rows)}
        zone: dict[int, set[str]] = defaultdict(set)
        refs: dict[str, set[int]] = {}
        for p in props:
            if p.kind == "adjacent-exact-drop":
                continue
            refs[p.id] = {q.gpx for q in (p.prev, p.next) if q}
            near = set(refs[p.id])
            for g, steps in ((p.members[0], (-1,)), (p.members[-1], (1,))) if p.kind == "block-finding" else ((g, (-1, 1)) for g in p.members):
                beside = (place[g] + d for d in steps if g in place)
                near |= {rows[k].gpx for k in beside if 0 <= k < len(rows) and rows[k].seg == p.seg}
            for g in near:
                zone[g].add(p.id)
        out: set[str] = set()
        for own, gs in refs.items():
            others = set().union(*(zone[g] for g in gs)) - {own} if gs else set()
            if others:
                out |= others | {own}
        return out

    # ---- application
    def apply(self, p: Proposal, stage: str) -> None:
        here = {q.gpx: q for q in self.order}
        fail = lambda reason: (setattr(p, "applied", False), setattr(p, "skip", reason))
        if p.kind == "adjacent-exact-drop":
            self.log.drop(p.members[0], "adjacent-exact-duplicate", stage)
            self.remove(set(p.members))
            self.log.move("adjacent-exact-drop", stage, seg=p.seg, gpx=p.members)
            p.applied = True
        elif p.kind == "block-finding":
            first, last = here.get(p.members[0]), here.get(p.members[-1])
            if p.status != "socket-ok" or not first or not last:
                return fail("overlap_vetoed")
            p.kinematics = k = check(p.prev, first, last, p.next, self.params.lenient_kph)
            if not k["passed"]:
                for g in p.members:
                    self.log.exclude(g, "block_kinematic_guard_failed", stage, proposal=p.id)
                self.log.note("proposal", "block_reorder_kinematic_guard_failed", p.seg, p.id, kinematics=k)
                return fail("kinematic_guard_failed")
            if not self.relocate(p.members, p.prev.gpx if p.prev else None):
                raise ValueError("a block's members or anchor are gone")
            self.resolved |= set(p.members)
            self.log.note("proposal", "block_reorder_applied", p.seg, p.id, gpx=p.members, kinematics=k)
            self.log.move("block-reorder", stage, seg=p.seg, gpx=p.members, after=p.prev.gpx if p.prev else None)
            p.applied = True
        elif p.exact:
            p.winner = min(p.members)
            for g in p.members:
                if g != p.winner:
                    self.log.drop(g, "adjacent-exact-duplicate", stage)
            self.remove(set(p.members) - {p.winner})
            p.applied = True
        else:
            prev, nxt = (here.get(q.gpx) if q else None for q in (p.prev, p.next))
            tried = [(g, check(prev, here[g], here[g], nxt, self.params.lenient_kph) if g in here else None) for g in p.members]
            if len(tried) == 1:
                g, k = tried[0]
                if k is None:
                    return fail("kinematic_guard_failed")
                if not k["passed"]:
                    self.log.exclude(g, "insert_kinematic_guard_failed", stage, proposal=p.id)
                    self.log.note("proposal", "insert_kinematic_guard_failed", p.seg, p.id, kinematics=k)
                    return fail("kinematic_guard_failed")
                self._move(p, g, stage)
                self.log.note("proposal", "insert_applied", p.seg, p.id, gpx=g)
            else:
                passers = [x for x in tried if x[1] and x[1]["passed"]]
                rank = lambda x: (math.inf if x[1] is None or x[1]["score"] is None or math.isnan(x[1]["score"]) else x[1]["score"], x[0])
                g = min(passers or tried, key=rank)[0]
                self.log.note("proposal", "insert_competition_resolved" if passers else "insert_competition_kinematic_guard_failed", p.seg, p.id, winner=g, candidates=p.members)
                for other in p.members:
                    if other != g:
                        self.log.exclude(other, "insert_competition_loser", stage, proposal=p.id)
                self._move(p, g, stage)
            p.winner, p.applied = g, True

    def _move(self, p: Proposal, gpx: int, stage: str) -> None:
        after = p.prev.gpx if p.prev else None
        self.relocate([gpx], after)  # an anchor that is gone leaves the point where it is; the move is logged all the same
        self.resolved.add(gpx)
        self.log.move("insert-move", stage, seg=p.seg, gpx=[gpx], after=after, proposal=p.id)

    # ---- one segment to its end
    def solve(self, s: Segment) -> None:
        frames: list[dict] = []
        for n in range(1, self.params.max_passes + 1):
            stage, pts = f"phase1_pass_{n}", self.of(s.index)
            spine = self.spine(pts)
            env = (spine[0].time, spine[-1].time) if spine else (None, None)
            props = self.propose(s, env)
            frame = {"pass": n, "total": len(props), "applyable": 0, "applied": 0, "vetoed": 0, "coupled": 0, "staged": 0, "out_of_scope": 0}
            frames.append(frame)
            if not props:
                s.exit_reason = "no_proposals" if n == 1 else "stable"
                break
            inside = []
            for p in props:
                side = self.side(p, env)
                if side is None:
                    inside.append(p)
                elif side in self.staged.get(s.index, {}):
                    for g in p.members:
                        self.log.exclude(g, "out_of_segment_scope", stage, proposal=p.id)
                    p.applied, p.skip = False, "out_of_segment_scope"
                    self.log.proposals.append(p)
                    frame["out_of_scope"] += 1
                else:
                    self.staged.setdefault(s.index, {})[side] = p
                    frame["staged"] += 1
            if not inside:
                s.exit_reason = "stable"
                break
            vetoed, coupled = self.overlap(inside, spine), self.coupling(inside)
            for p in inside:
                if p.id in vetoed or p.id in coupled:
                    p.applied, p.skip = False, "overlap_vetoed" if p.id in vetoed else "coupling_blocked"
                else:
                    self.apply(p, stage)
                self.log.proposals.append(p)
            done = sum(p.applied is True for p in inside)
            frame.update(applyable=len(inside), applied=done, vetoed=len(vetoed), coupled=len(coupled))
            if not done:
                s.exit_reason = "stalemate"
                break
            if done == len(inside):
                spine = self.spine(self.of(s.index))
                env = (spine[0].time, spine[-1].time) if spine else (None, None)
                again = self.propose(s, env)
                active = [p for p in again if not p.edge or self.side(p, env) not in (None, *self.staged.get(s.index, {}))]
                if not active:
                    s.exit_reason = "stable"
                    break
        else:
            s.exit_reason = "max_iterations"
            frames.append({"pass": self.params.max_passes + 1})
            self.log.note("segment", "multipass_cap_hit", s.index, cap=self.params.max_passes)
        s.iterations = len(frames)
        self.log.passes += [{"seg": s.index, "exit_reason": s.exit_reason, **f} for f in frames]

    # ---- after the segments
    def reconcile_edges(self) -> None:
        stage, parts = "edge-reconciliation", self.by_segment()
        on_spine = {p.gpx for pts in parts.values() for p in self.spine(pts)}
        rows = list(parts.items())
        for (_, a), (seg, b) in zip(rows, rows[1:]):
            keep, drop = a[-1], b[0]
            if not exact_pair(keep, drop):
                continue
            if keep.gpx in on_spine and drop.gpx in on_spine:
                if drop.gpx not in self.log.excluded:
                    self.log.drop(drop.gpx, "adjacent-exact-duplicate", stage)
                    self.remove({drop.gpx})
                    self.log.move("cross-segment-adjacent-drop", stage, seg=seg, gpx=[drop.gpx], keep=keep.gpx)
            else:
                self.log.note("segment", "edge_coupling_unstable", seg, reason="cross_segment_dup_unstable", from_gpx=keep.gpx, to_gpx=drop.gpx)
        into = {b["to_seg"]: b["classification"] for b in self.boundaries}
        out_of = {b["from_seg"]: b["classification"] for b in self.boundaries}
        left = {p.gpx for p in self.order}
        for seg, sides in self.staged.items():
            for side, known in ((FIRST, into), (LAST, out_of)):
                p = sides.get(side)
                if not p:
                    continue
                reason = "edge_deferred_stable" if known.get(seg) == "chunk_ordering" else "edge_unresolved"
                for g in p.members:
                    if g in left:
                        self.log.exclude(g, reason, stage, proposal=p.id)
                if reason == "edge_unresolved":
                    self.log.note("segment", "edge_coupling_unstable", seg, side=side, proposal=p.id, boundary=known.get(seg))
                p.applied, p.skip = False, reason
                self.log.proposals.append(p)

    def violations(self) -> dict[str, list[int]]:
        """Points in more or fewer than one part."""
        left = {p.gpx for p in self.order}
        drops, excluded = set(self.log.drops), set(self.log.excluded)
        return {"drops_excluded": sorted(drops & excluded), "drops_working": sorted(drops & left), "excluded_not_working": sorted(excluded - left)}

    def run(self) -> None:
        self.cross_segment_duplicates()
        self.objective_duplicates()
        for stage in (lambda: None, self.reversals, self.export_fixes):
            stage()
            if self.find_idle():
                return
        spines = {seg: self.spine(pts) for seg, pts in self.by_segment().items()}
        for s in self.segments:
            if spines.get(s.index):
                s.envelope = (spines[s.index][0].time, spines[s.index][-1].time)
        for s in self.segments:
            if s.idle or s.mode == "geometry-only":
                self.log.passes.append({"seg": s.index, "exit_reason": "no_proposals", "pass": 0})
                continue
            self.solve(s)
            self.find_idle()
        self.reconcile_edges()
