"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


#: A node with more links than this, or than twice the links by MOST_HUBS if that is more, is a hub.
HUB, MOST_HUBS = 256, 100_000


def _star(links: DataFrame, large: bool, n: int) -> DataFrame:
    """One round over n links: hang the neighbours of every node on the smallest node it knows.

    The links of a hub are never brought together: its least node is counted before the shuffle, and hubs (MOST_HUBS at most, as every link has
    two ends) are broadcast with it; only nodes of few links meet theirs in a shuffle.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("m"), F.count("*").alias("n"))
    least = materialize(least, "least-nodes")
    hubs = F.broadcast(least.filter(F.col("n") > max(HUB, 2 * n // MOST_HUBS)).select(F.col("node").alias("hub"), F.col("m").alias("hub_m")))
    met = both.join(hubs, F.col("a") == F.col("hub"), "left")
    few = met.filter("hub is null").select("a", "b").join(least.select("node", "m"), F.col("a") == F.col("node")).select("a", "b", "m")
    met = few.union(met.filter("hub is not null").select("a", "b", F.col("hub_m").alias("m")))
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of `links` (columns a, b of one orderable type); root is the smallest node reachable.

    Each round is written to the shared folder. Nulls, self-links and repeated links are ignored; an empty table gives an empty one.
    """
    now = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    n, seen = now.count(), None
    for _ in range(rounds):
        if not n:
            break
        half = materialize(_star(now, True, n), "links")
        then = materialize(_star(half, False, n), "links")
        n, mark = then.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        for table in (now, half):
            drop_table(table)
        now = then
        if (n, mark) == seen:
            break
        seen = n, mark
    else:
        raise RuntimeError(f"no stable components after {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
