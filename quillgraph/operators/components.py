"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.storage import durable


def components(links: DataFrame, stored: Callable[[DataFrame, str], DataFrame] = durable) -> DataFrame:
    """node, root for every node of ``links`` (columns a and b): equal roots, one component.

    Each level points every node at the neighbour (or itself) of least random priority,
    follows the pointer once more, and contracts the links along it, so levels grow with
    the logarithm of a component. Minima are aggregated before the shuffle, so a node's
    links never meet in a task; in joins a hub's links stand on one side and one row of the
    hub on the other, which adaptive execution splits; every level is ``stored``: a lost
    executor costs one level.
    """
    links = links.select("a", "b").where("a <> b")
    labels = None
    level = 0
    while True:
        links = stored(links.distinct(), "links")
        if links.isEmpty():
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.lit(level), "b").alias("h"), F.col("b").alias("x"))).alias("m"))
        up = stored(best.select(F.col("a").alias("node"), F.least("m", F.struct(F.xxhash64(F.lit(level), "a").alias("h"), F.col("a").alias("x")))["x"].alias("up")), "up")
        twice = up.alias("u").join(up.alias("v"), F.col("u.up") == F.col("v.node")).select(F.col("u.node").alias("node"), F.col("v.up").alias("up"))
        up = stored(twice, "up")
        if labels is None:
            labels = up.select("node", F.col("up").alias("root"))
        else:
            joined = labels.join(up.select(F.col("node").alias("_n"), "up"), F.col("root") == F.col("_n"), "left")
            labels = stored(joined.select("node", F.coalesce("up", "root").alias("root")), "labels")
        a = links.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
        links = a.join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b").select(F.col("ua").alias("a"), F.col("ub").alias("b")).where("a <> b")
        level += 1
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels
