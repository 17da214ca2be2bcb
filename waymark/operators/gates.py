"""Gates between proposals and their application, over the proposals of a first pass that do not touch a segment's edge."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .presegment import KEYS, in_segment


def _beyond(block: DataFrame, spine: DataFrame, bound: str, sign: int) -> DataFrame:
    """For each block the nearest spine point before bound (sign 1) or after it (-1), and how many there are: one ordered pass over
    the spine and the bounds of a segment together."""
    at = lambda c: F.col(c) * sign
    none = F.lit(None).cast("long")
    events = block.select(*KEYS, at(bound).alias("t"), F.col("first_gpx").alias("block_first"), none.alias("s_ms"), none.alias("s_gpx"))
    events = events.unionByName(spine.select(*KEYS, at("s_ms").alias("t"), none.alias("block_first"), "s_ms", "s_gpx"))
    before = Window.partitionBy(*KEYS).orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    spot = F.when(F.col("s_ms").isNotNull(), F.struct((F.col("s_ms") * sign).alias("o"), (F.col("s_gpx") * sign).alias("g")))
    met = events.withColumns({"near": F.max(spot).over(before), "n": F.count("s_ms").over(before)}).filter("block_first is not null")
    return met.select(*KEYS, F.col("block_first").alias("first_gpx"), F.when(F.col("near").isNotNull(), F.struct((F.col("near.o") * sign).alias("s_ms"), (F.col("near.g") * sign).alias("s_gpx"))).alias("near"), "n")


def overlap_blocks(blocks: DataFrame, spine_points: DataFrame) -> DataFrame:
    """blocks (inside their envelope) with status and the anchors on the spine.

    Status: overlap (not rising inside, no usable time, or a spine point between the anchors that is no member), no-bracket, socket-ok.
    Members lie between a block's bounds, so the points beyond them are never its own; those between that are its own are counted by a join.
    """
    block = blocks.filter("not is_edge")
    s = spine_points.select(*KEYS, F.col("gpx_index").alias("s_gpx"), F.col("time_ms").alias("s_ms"))
    below = _beyond(block, s, "b_min", 1).select(*KEYS, "first_gpx", F.col("near").alias("_prev"), F.col("n").alias("_below"))
    above = _beyond(block, s, "b_max", -1).select(*KEYS, "first_gpx", F.col("near").alias("_next"), F.col("n").alias("_above"))
    own = block.select(*KEYS, "first_gpx", F.explode("members").alias("s_gpx")).join(s, [*KEYS, "s_gpx"]).groupBy(*KEYS, "first_gpx").agg(F.count("*").alias("_own"))
    every = s.groupBy(*KEYS).agg(F.count("*").alias("_all"))
    keys = [*KEYS, "first_gpx"]
    out = block.select(*keys, "last_gpx", "violation", "b_min", "b_max").join(below, keys, "left").join(above, keys, "left").join(own, keys, "left").join(every, KEYS, "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.withColumn("_inside", F.col("b_min").isNotNull() & (number("_all") - number("_below") - number("_above") - number("_own") > 0))
    known = ~F.col("violation") & F.col("b_min").isNotNull()
    both = F.col("_prev").isNotNull() & F.col("_next").isNotNull()
    status = (
        F.when(~known, "overlap").when(F.col("_prev").isNull() & F.col("_next").isNull(), "no-bracket").when(both & F.col("_inside"), "overlap").otherwise("socket-ok"))
    return out.select(
        *KEYS, "first_gpx", "last_gpx", "b_min", "b_max", status.alias("status"), (known & both & F.col("_inside")).alias("pierced"),
        *(F.when(known, F.col(f"_{a}.{c}")).alias(n) for a, c, n in (("prev", "s_ms", "t_prev"), ("next", "s_ms", "t_next"), ("prev", "s_gpx", "prev_gpx"), ("next", "s_gpx", "next_gpx"))))


def inserts_in_blocks(inserts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs of an insert and a block whose range holds its target: both are vetoed."""
    i = inserts.filter("not is_edge and not is_exact").select(*KEYS, "key", "target_ms")
    b = blocks.filter("not is_edge").select(*KEYS, F.col("first_gpx").alias("block_first"), "b_min", "b_max")
    return i.join(b, KEYS).filter("target_ms between b_min and b_max").select(*KEYS, "key", "block_first", "target_ms", "b_min", "b_max")


def corridor_conflicts(inserts: DataFrame) -> DataFrame:
    """Pairs of inserts whose open corridors meet with a target of either inside: both are vetoed."""
    lo, hi = F.coalesce("t_prev", F.lit(-(2**62))), F.coalesce("t_next", F.lit(2**62))
    i = inserts.filter("not is_edge and not is_exact").select(*KEYS, "key", "target_ms", lo.alias("lo"), hi.alias("hi"))
    other = i.toDF(*KEYS, "key_b", "target_b", "lo_b", "hi_b")
    pair = i.join(other, KEYS).filter("key < key_b").withColumn("from_ms", F.greatest("lo", "lo_b")).withColumn("to_ms", F.least("hi", "hi_b"))
    inside = lambda t: (F.col(t) > F.col("from_ms")) & (F.col(t) < F.col("to_ms"))
    return pair.filter(inside("target_ms") | inside("target_b")).select(*KEYS, F.col("key").alias("key_a"), "key_b")


def _roles(points: DataFrame, inserts: DataFrame, overlap: DataFrame) -> DataFrame:
    """key, gpx, role and rank: points that a proposal leaves (neighbours) or refers to (bracket, in order)."""
    near = points.select(*KEYS, "gpx_index", F.lag("gpx_index").over(in_segment()).alias("_p"), F.lead("gpx_index").over(in_segment()).alias("_n"))
    one = inserts.filter("not is_edge").select(*KEYS, "key", F.explode("members").alias("gpx_index"))
    leave = one.join(near, [*KEYS, "gpx_index"]).select(*KEYS, "key", F.explode(F.array("_p", "_n")).alias("gpx"))
    block = overlap.select(*KEYS, F.concat(F.lit("block:"), F.col("first_gpx").cast("string")).alias("key"), "first_gpx", "last_gpx", "prev_gpx", "next_gpx")
    before = block.join(near.select(*KEYS, F.col("gpx_index").alias("first_gpx"), "_p"), [*KEYS, "first_gpx"]).select(*KEYS, "key", F.col("_p").alias("gpx"))
    after = block.join(near.select(*KEYS, F.col("gpx_index").alias("last_gpx"), "_n"), [*KEYS, "last_gpx"]).select(*KEYS, "key", F.col("_n").alias("gpx"))
    leaving = leave.union(before).union(after).withColumns({"role": F.lit("leaving"), "rank": F.lit(9)})
    own = inserts.filter("not is_edge").select(*KEYS, "key", "prev_gpx", "next_gpx").unionByName(block.select(*KEYS, "key", "prev_gpx", "next_gpx"))
    refs = own.select(*KEYS, "key", F.posexplode(F.array("prev_gpx", "next_gpx")).alias("rank", "gpx")).withColumn("role", F.lit("arriving"))
    return leaving.unionByName(refs.select(*leaving.columns)).filter("gpx is not null").distinct()


def coupling_edges(points: DataFrame, inserts: DataFrame, overlap: DataFrame) -> DataFrame:
    """Ordered pairs of proposals of a segment of which the first refers to a point that the second disturbs; disturbed is the first
    such point in the order of the bracket."""
    roles = _roles(points, inserts, overlap)
    refs = roles.filter("role = 'arriving'").select(*KEYS, F.col("key").alias("key_a"), "gpx", "rank")
    zone = roles.select(*KEYS, F.col("key").alias("key_b"), "gpx").distinct()
    hit = refs.join(zone, [*KEYS, "gpx"]).filter("key_a <> key_b")
    return hit.groupBy(*KEYS, "key_a", "key_b").agg(F.min_by("gpx", "rank").alias("disturbed_gpx"))


def blocked(edges: DataFrame) -> DataFrame:
    """Proposals at either end of a coupling."""
    return edges.select(*KEYS, F.col("key_a").alias("key")).union(edges.select(*KEYS, "key_b")).distinct()


def coupled_regions(edges: DataFrame) -> DataFrame:
    """key, region of every coupled proposal: the least key that it is coupled with over any number of steps. The proposals of one
    segment are few enough for one task."""

    def regions(rows: pd.DataFrame) -> pd.DataFrame:
        up: dict[str, str] = {}

        def root(k: str) -> str:
            while up.setdefault(k, k) != k:
                k = up[k]
            return k

        for a, b in zip(rows["key_a"], rows["key_b"]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
        keys = list(up)
        return pd.DataFrame({"track_id": rows["track_id"].iloc[0], "trk_seg_index": rows["trk_seg_index"].iloc[0], "key": keys, "region": [root(k) for k in keys]})

    return edges.groupBy(*KEYS).applyInPandas(regions, "track_id long, trk_seg_index int, key string, region string")


def applyable(inserts: DataFrame, overlap: DataFrame, edges: DataFrame, in_blocks: DataFrame, corridors: DataFrame) -> DataFrame:
    """Keys of the proposals that no gate stops."""
    block_key = lambda c: F.concat(F.lit("block:"), F.col(c).cast("string"))
    every = inserts.filter("not is_edge").select(*KEYS, "key").union(overlap.select(*KEYS, block_key("first_gpx")))
    vetoed = overlap.filter("status <> 'socket-ok'").select(*KEYS, block_key("first_gpx").alias("key"))
    vetoed = vetoed.union(in_blocks.select(*KEYS, "key")).union(in_blocks.select(*KEYS, block_key("block_first")))
    vetoed = vetoed.union(corridors.select(*KEYS, "key_a")).union(corridors.select(*KEYS, "key_b"))
    keys = [*KEYS, "key"]
    return every.join(vetoed.distinct(), keys, "left_anti").join(blocked(edges), keys, "left_anti")


def edge_sides(inserts: DataFrame, blocks: DataFrame, env: DataFrame) -> DataFrame:
    """Proposals at the edge of their segment with side and staged: the first of each side (blocks, singletons, groups, each in order) is staged."""
    b = blocks.filter("is_edge").select(*KEYS, F.concat(F.lit("block:"), F.col("first_gpx").cast("string")).alias("key"), F.col("b_min").alias("lo"), F.lit(0).alias("kind"), F.col("first_gpx").alias("at"))
    i = inserts.filter("is_edge").select(*KEYS, "key", F.col("target_ms").alias("lo"), F.when(F.col("key").startswith("single"), 1).otherwise(2).alias("kind"), F.element_at("members", 1).alias("at"))
    both = b.unionByName(i).join(env, KEYS)
    side = F.when(F.col("env_min").isNull() | (F.col("lo") <= F.col("env_min")), "firstEdge").otherwise("lastEdge")
    order = Window.partitionBy(*KEYS, "side").orderBy("kind", "at")
    return both.withColumn("side", side).withColumn("staged", F.row_number().over(order) == 1).select(*KEYS, "key", "side", "staged")
