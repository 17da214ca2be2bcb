"""The state of one track, branch by branch, and its invariants on random tracks."""

import math
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.operators.correction import correct_track, load
from waymark.operators.track_state import Params, Point, Track, check

T0 = 1_000_000


def rows(points, tags=()):
    """Labelled rows of (seg, seconds after T0 or None, lat step) by index; below-anchor labels are derived."""
    out, anchor = [], None
    for g, (seg, sec, step, *ele) in enumerate(points):
        ms = None if sec is None else T0 + int(sec * 1000)
        low = ms is not None and anchor is not None and ms < anchor
        prev = out[-1]["time_ms"] if out else None
        out.append({
            "track_id": 1, "gpx_index": g, "trk_seg_index": seg, "lat": 47.0 + step * 1e-5, "lon": 8.0, "ele": ele[0] if ele else 500.0, "ele_absent": False, "time_ms": ms, "least_ms": None,
            "below_anchor": low, "below_prev_valid": ms is not None and prev is not None and ms < prev, "non_adjacent_repeat": False, "adjacent_duplicate": ms is not None and ms == prev})
        anchor = ms if anchor is None else anchor if ms is None else max(anchor, ms)
    df = pd.DataFrame(out).astype({"time_ms": "Int64", "least_ms": "Int64"})
    df["least_ms"] = df.groupby("trk_seg_index")["time_ms"].transform("min")
    return df


def log(points, **params):
    out = correct_track(rows(points), Params(**params))
    assert not (out.entry == "error").any(), out
    return out


def kinds(out, entry):
    return out[out.entry == entry].kind.tolist()


def order(out):
    return out[out.entry == "working"].sort_values("seq").gpx_index.astype(int).tolist()


def test_clean_track_has_nothing_to_do():
    out = log([(0, k, k) for k in range(6)])
    assert order(out) == list(range(6)) and kinds(out, "pass") == [] and kinds(out, "drop") == []


def test_block_moves_into_its_socket():
    # 0..3, then 8, 9, then a block of 5, 6 (below the anchor), then 12
    times = [0, 1, 2, 3, 8, 9, 5, 6, 12]
    out = log([(0, t, t) for t in times])
    assert order(out) == [0, 1, 2, 3, 6, 7, 4, 5, 8]
    assert "block_reorder_applied" in kinds(out, "annotation")


def test_block_that_is_too_fast_is_distrusted():
    out = log([(0, t, t if t not in (5, 6) else 9_000) for t in [0, 1, 2, 3, 8, 9, 5, 6, 12]])
    assert kinds(out, "excluded").count("block_kinematic_guard_failed") == 2


def test_block_that_falls_inside_is_vetoed():
    out = log([(0, t, t) for t in [0, 1, 2, 3, 8, 9, 6, 5, 12]])
    assert "block_internal_monotonicity_fail" in kinds(out, "annotation") and order(out) == list(range(9))


def test_objective_duplicates():
    out = log([(0, 0, 0), (0, 1, 1), (0, 1, 1), (0, 2, 2)])
    assert out[out.entry == "drop"].gpx_index.tolist() == [2]
    out = log([(0, 0, 0), (0, 1, 1, 500.0), (0, 1, 1, 600.0), (0, 2, 2)])
    assert "adjacent_duplicate_ele_mismatch" in kinds(out, "annotation")
    out = log([(0, 0, 0), (0, 1, 1, 99999.0), (0, 1, 1, 500.0), (0, 2, 2)])
    assert out[out.entry == "drop"].gpx_index.tolist() == [1]


def test_elevation_out_of_bounds_on_both_sides_is_cleared():
    out = log([(0, 0, 0), (0, 1, 1, 99999.0), (0, 1, 1, 88888.0), (0, 2, 2)])
    assert out[out.entry == "drop"].gpx_index.tolist() == [2]
    assert out[(out.entry == "working") & out.details.notna()].gpx_index.tolist() == [1]


def test_competition_keeps_the_best_candidate():
    # two points of one time, the second far away
    out = log([(0, 0, 0), (0, 1, 1), (0, 5, 5), (0, 5, 3_000), (0, 9, 9), (0, 10, 10)])
    assert out[out.entry == "excluded"][["gpx_index", "kind"]].values.tolist() == [[3, "insert_competition_loser"]]


def test_cross_segment_duplicates_are_dropped_but_for_a_seam():
    out = log([(0, 0, 0), (0, 5, 5), (0, 6, 6), (1, 7, 7), (1, 8, 8), (1, 5, 9)])
    assert sorted(out[out.entry == "drop"].gpx_index) == [1, 5] and set(kinds(out, "drop")) == {"cross_segment_duplicate"}


def test_seam_is_left_to_the_end():
    out = log([(0, 0, 0), (0, 3, 3), (0, 2, 2), (0, 6, 6), (1, 6, 6), (1, 7, 7)])
    drops = out[out.entry == "drop"][["gpx_index", "stage"]].values.tolist()
    assert drops == [[4, "edge-reconciliation"]]


def test_reversed_track_is_turned_and_stale_labels_exclude():
    """Labels stay as the audit gave them, so after an accepted reversal they form one edge block, which is excluded."""
    out = log([(0, 10 - k, k) for k in range(6)])
    assert kinds(out, "rearrangement")[0] == "full-array-reversal" and order(out) == [5, 4, 3, 2, 1, 0]
    assert kinds(out, "excluded") == ["edge_unresolved"] * 5


def test_duplicate_chunk_is_dropped():
    out = log([(0, t, t) for t in (0, 100, 200)] + [(1, t, t + 1) for t in (150, 201, 260)])
    assert kinds(out, "drop") == ["duplicate_chunk_segment"] * 3


def test_chunks_are_put_in_order():
    out = log([(0, t, t) for t in (2000, 2100)] + [(1, t, t) for t in (0, 100)] + [(2, t, t) for t in (5000, 5100)])
    assert order(out) == [2, 3, 0, 1, 4, 5] and "chunk_ordering_resolved" in kinds(out, "annotation")


def test_whole_hour_back_is_flagged_only():
    out = log([(0, t, t) for t in (7200, 7300)] + [(1, t, t) for t in (3700, 3800)])
    assert "timestamp_discontinuity" in kinds(out, "annotation") and kinds(out, "drop") == []


def test_pass_cap():
    track = load(rows([(0, t, t) for t in [0, 1, 2, 3, 8, 9, 5, 6, 12]]), Params(max_passes=0))
    track.run()
    assert track.segments[0].exit_reason == "max_iterations"
    assert "multipass_cap_hit" in [n["kind"] for n in track.log.notes]


def test_checks_of_speed():
    p = lambda step, sec: Point(0, 0, 47.0 + step * 1e-5, 8.0, None, True, T0 + sec * 1000)
    assert check(None, p(0, 0), p(0, 0), None, 80)["fail_reason"] == "no_bracket"
    same = check(p(0, 0), p(1, 0), p(1, 0), None, 80)
    assert same["speed_prev_kph"] == math.inf and not same["passed"]
    back = check(p(0, 5), p(1, 0), p(1, 0), None, 80)
    assert math.isnan(back["speed_prev_kph"]) and back["passed"]
    assert check(p(0, 0), p(9000, 1), p(9000, 1), p(0, 2), 80)["fail_reason"] == "both_exceeded"


def test_relocation():
    track = Track([Point(g, 0, 47.0, 8.0, None, True, None) for g in range(4)], [], [], {}, Params())
    assert track.relocate([3], 0) and [p.gpx for p in track.order] == [0, 3, 1, 2]
    assert track.relocate([1, 2], None) and [p.gpx for p in track.order] == [1, 2, 0, 3]
    assert not track.relocate([9], 0) and not track.relocate([0], 7)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_every_point_ends_in_one_part(seed):
    rng = random.Random(seed)
    points, t = [], 0.0
    for seg in range(rng.randint(1, 3)):
        for k in range(rng.randint(1, 40)):
            kind = rng.random()
            t += 0 if kind < 0.1 else -rng.random() * 5 if kind < 0.2 else rng.random()
            points.append((seg, None if rng.random() < 0.05 else t + 10, k + (10**5 if rng.random() < 0.02 else 0), None if rng.random() < 0.3 else rng.choice([500.0, 501.0])))
    out = correct_track(rows(points), Params())
    if (out.entry == "error").any():  # a point that was distrusted and then dropped: reported, not hidden
        assert "partition" in out.kind.iloc[0] and len(out) == 1
        return
    working, drops = set(order(out)), set(out[out.entry == "drop"].gpx_index)
    excluded = set(out[out.entry == "excluded"].gpx_index)
    assert working | drops == set(range(len(points))) and not working & drops and excluded <= working
    track = load(rows(points), Params())
    track.run()
    for pts in track.by_segment().values():
        times = [p.time for p in track.spine(pts)]
        assert times == sorted(set(times))


def test_long_clean_track_is_fast():
    import time

    began = time.time()
    log([(0, k, k) for k in range(5000)])
    assert time.time() - began < 30


@pytest.mark.parametrize("n", [1, 2])
def test_tiny_tracks(n):
    assert order(log([(0, k, k) for k in range(n)])) == list(range(n))
