"""Joins on inequalities without comparing every row with every row.

One side's value is a point, the other side's bounds an interval, open where a bound is
missing. Points are cut into bins by quantiles of a sample of their values; a point lies in one
bin, an interval's row goes to every bin that it overlaps, and rows of a bin meet by an equi
join that checks the whole condition. As a point has one bin, no pair comes twice. The join is
dealt by the pairs of its bins, so that a bin of many pairs is many tasks.

Which rows are joined at all is asked by semi joins within the bins, which end at a row's first
match, so semi and anti joins make no pairs, and outer joins make them once.

The sample only places the bins; results do not depend on it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.dealt import dealt
from quillgraph.storage import durable

#: Points of a bin, most bins (of intervals open on one side, which overlap half of them), and sampled values a bin.
POINTS, MOST_BINS, MOST_OPEN, SAMPLED = 2_000, 1024, 64, 64


@dataclass(frozen=True)
class Interval:
    """``point`` of one side lies at or above all ``lows`` and at or below all ``highs`` of the other."""

    point: Column
    lows: tuple[Column, ...] = ()
    highs: tuple[Column, ...] = ()


def _place(value: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``, by binary search; null for null."""
    steps = [1 << j for j in reversed(range(len(bounds).bit_length()))]
    held = F.array(*map(F.lit, bounds))
    step = lambda at, s: F.when((at + s <= len(bounds)) & (F.get(held, at + s - 1) <= value), at + s).otherwise(at)
    return F.when(value.isNotNull(), F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step) if bounds else F.lit(0))


def quantiles(points: DataFrame, value: Column, most: int = MOST_BINS) -> list:
    """Bounds between bins of about equal numbers of points."""
    given = points.select(value.alias("v")).where("v IS NOT NULL")
    n = given.count()
    if not n:
        return []
    k = min(most, max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // POINTS))
    sample = sorted(r.v for r in given.sample(min(1.0, k * SAMPLED / n), 7).collect() if r.v == r.v)
    return sorted({sample[i * len(sample) // k] for i in range(1, k)}) if sample else []


def bins(points: DataFrame, value: Column) -> tuple[list, list[int]]:
    """Bounds of the bins, and by how much each holds more points than usual."""
    bounds = quantiles(points, value)
    sizes = {r["b"]: r["count"] for r in points.select(_place(value, bounds).alias("b")).where("b IS NOT NULL").groupBy("b").count().collect()}  # a row a bin
    usual = max(1, sum(sizes.values()) // (len(bounds) + 1))
    return bounds, [max(1, math.ceil(sizes.get(b, 0) / (2 * usual))) for b in range(len(bounds) + 1)]


def interval_join(left: DataFrame, right: DataFrame, on: Column, interval: Interval, point_left: bool, side: str = "inner", names: tuple[str, str] | None = None) -> DataFrame:
    """``left`` and ``right`` where ``on`` holds, of which ``interval`` is a part.

    ``side``: inner, left, right, full, semi, anti. ``names`` are the aliases of both sides, which
    ``on`` uses. Columns keep their order and names.
    """
    outer = {"inner": (), "left": ("left",), "semi": ("left",), "anti": ("left",), "right": ("right",), "full": ("left", "right")}[side]
    held = {}
    for which, df in (("left", left), ("right", right)):
        if which in outer:  # a row may stand in several cells, and is told by a number
            df = durable(df.withColumn(f"_n{which}", F.monotonically_increasing_id()), "numbered")
            df = df.alias(names[which == "right"]) if names and names[which == "right"] else df
        held[which] = df
    points, spans = (held["left"], held["right"]) if point_left else (held["right"], held["left"])
    bounds = quantiles(points, interval.point, MOST_BINS if interval.lows and interval.highs else MOST_OPEN)
    first = F.greatest(*[_place(x, bounds) for x in interval.lows], F.lit(0)) if interval.lows else F.lit(0)
    last = F.least(*[_place(x, bounds) for x in interval.highs], F.lit(len(bounds))) if interval.highs else F.lit(len(bounds))
    known = F.lit(True)
    for x in (*interval.lows, *interval.highs):
        known = known & x.isNotNull()
    points = points.withColumn("_pb", _place(interval.point, bounds))
    spans = spans.withColumn("_ib", F.explode(F.when(known & (first <= last), F.sequence(first, F.greatest(first, last)))))
    points, spans, meet, own = dealt(points, spans, F.col("_pb"), F.col("_ib"))
    a, b = (points, spans) if point_left else (spans, points)
    meet = meet & on

    def met(which: str) -> tuple[DataFrame, Column]:
        """Numbers of the rows of a side that have a match, and the condition that a row's is one of them."""
        x, y = (a, b) if which == "left" else (b, a)
        return x.join(y, meet, "left_semi").select(F.col(f"_n{which}").alias("_met")).distinct(), F.col(f"_n{which}") == F.col("_met")

    if side in ("semi", "anti"):
        return held["left"].join(*met("left"), f"left_{side}").drop("_nleft")
    out = a.join(b, meet).drop("_pb", "_ib", *own, "_nleft", "_nright")
    void = lambda fields: [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    width, whole = len(left.columns), out.schema.fields
    for which in outer:
        alone = held[which].join(*met(which), "left_anti").drop(f"_n{which}")
        out = out.union(alone.select("*", *void(whole[width:])) if which == "left" else alone.select(*void(whole[:width]), "*"))
    return out
