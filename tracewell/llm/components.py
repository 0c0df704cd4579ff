"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def hung(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect what ``links`` (a, b) connect, many of them once: each ``a``, and each ``b`` of it, hangs on its smallest ``b``.

    Of members that have the same few hubs one link stays for each, and links between the hubs. The
    links of one ``a`` meet in a task, so nodes with many links belong in ``b``.
    """
    each = links.select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("m"))
    # the smallest b's own row is the link of a, any other row that of its b
    return each.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links, longs or binaries, to (node, component): component is the smallest node reachable.

    Only nodes with a link to another node are returned; null ends, self links and repeated links
    count for nothing. Each round hangs every node's neighbours on the smallest neighbour, first
    the larger ones, then the smaller ones, so paths shrink at each round and a star remains. No
    neighbour list is ever gathered: minima are aggregated map-side and joined back, so a node with
    a third of all links is a skewed join that adaptive execution splits, not a group in one task.
    Each round is written to the shared folder and the one before it deleted; nothing but two
    numbers a round reaches the driver. An empty table gives no rows.
    """
    now = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = staged(small.select("e.*").where("u > v").distinct(), "links")
        released(now)
        now = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
