"""Timestamp and elevation labels as points arrive: what batch windows compute, from a state for each track.

Points of a track must arrive in stream order (gpx_index); the state holds the greatest and last time, the first point of every time, and
the last elevation.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = (
    "track_id long, gpx_index long, missing boolean, unparsable boolean, adjacent_duplicate boolean, below_anchor boolean, below_prev_valid boolean, "
    "non_adjacent_repeat boolean, anchor_ms long, ele_adjacent_duplicate boolean")
STATE = "state string"


def _known(v: Any):
    return None if v is None or pd.isna(v) else v


def advance(state: dict, row: Any, floor: float = -500.0, ceiling: float = 9500.0) -> tuple:
    """The labels of one point, and the state after it (changed in place)."""
    g, t, ele = int(row.gpx_index), _known(row.time_ms), _known(row.ele)
    t = None if t is None else int(t)
    anchor, last_gpx, last = state.get("anchor"), state.get("gpx"), state.get("ms")
    follows = last_gpx == g - 1
    same = follows and t is not None and t == last
    seen = state.setdefault("first", {})
    repeat = t is not None and str(t) in seen and not same
    good = ele if ele is not None and floor <= ele <= ceiling and not bool(row.ele_absent) else None
    out = (
        g, bool(row.time_absent), not row.time_absent and t is None, bool(same), t is not None and anchor is not None and t < anchor,
        bool(follows and t is not None and last is not None and t < last), repeat, anchor, good is not None and good == state.get("ele"))
    if t is not None:
        seen.setdefault(str(t), g)
        state["anchor"] = t if anchor is None else max(anchor, t)
    state.update(gpx=g, ms=t, ele=good)
    return out


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = json.loads(state.get[0]) if state.exists else {}
    rows = pd.concat(list(batches)).sort_values("gpx_index")
    out = [(key[0], *advance(now, r)) for r in rows.itertuples()]
    state.update((json.dumps(now),))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
    yield frame.astype({"anchor_ms": "Int64"})


def labels(points: DataFrame) -> DataFrame:
    """A stream of labelled points from a stream of accepted points."""
    return points.groupBy("track_id").applyInPandasWithState(_update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
