"""Recursive tables: a step is applied to new rows until there are none.

Each round runs the step on the rows that the round before found for the first time (the
frontier), takes out those met earlier by an anti join, and stores what is left in the shared
folder, so rounds do not pile up in one plan and a lost executor costs one round. Rows met
before are never stepped from again: a cycle ends by itself, and the number of paths does not matter.

A step that only follows pairs of values from one column is a walk: ``walked`` makes the pairs once.
Where they lead both ways, all that a value reaches is its connected component, so no
round looks at the rows of every start: components are labelled once, and starts meet their members.
Pairs of whatever meets in the same middle are not even made: a link to one value of the middle for each is enough.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.components import components
from quillgraph.operators.dealt import dealt
from quillgraph.storage import durable

#: Rounds whose tables stand side by side before they are written as one.
MERGED = 8


def _united(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str] | None = None, distinct: bool = True, most: int | None = None) -> DataFrame:
    """The rows of ``base`` and whatever ``step`` makes of them, of its results, and so on.

    A row is told by ``keys`` (all columns if not given) and kept as first found; the step's
    columns are taken by position. Without ``distinct`` every row is stepped from, as UNION ALL does,
    which ends only where the step runs out of rows. ``most`` bounds the rounds.
    """
    fields = base.schema.fields
    keys = keys or base.columns
    frontier = durable(base.dropDuplicates(keys) if distinct else base, "frontier")
    met = [frontier]
    rounds = 0
    while (most is None or rounds < most) and not frontier.isEmpty():
        rounds += 1
        made = step(frontier).toDF(*base.columns).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])
        if distinct:
            made = made.dropDuplicates(keys)
            known = _united(met).select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)])
            same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
            made = made.join(known, same, "left_anti")
        frontier = durable(made, "frontier")
        met.append(frontier)
        if len(met) > MERGED:
            met = [durable(_united(met), "met")]
    return _united(met)


def closure(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """start, node, and depth (steps of the shortest way) of all that can be reached from ``starts``.

    ``edges`` has _src and _dst, ``starts`` a column node. Each pair is stepped from once, in the
    round of its depth, so cycles and many ways cost nothing. ``most`` bounds the depth.
    """
    base = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))

    def step(frontier: DataFrame) -> DataFrame:
        return frontier.join(edges.select("_src", "_dst"), F.col("node") == F.col("_src")).select("start", F.col("_dst").alias("node"), (F.col("depth") + 1).alias("depth"))

    return fixpoint(base, step, ["start", "node"], most=most)


def walked(base: DataFrame, hops: DataFrame, column: str, halves: DataFrame | None = None) -> DataFrame:
    """The rows of ``base``, and again with every value of ``column`` that ``hops`` (_src, _dst) lead to from theirs.

    Rows are distinct. All other columns are carried along. ``halves`` (_src, _mid) may be given where
    ``hops`` are the pairs of different _src that have a _mid in common, and perhaps pairs of a value and itself.
    """
    if halves is not None:
        halves = durable(halves, "halves")
        if halves.where("_src IS NULL").isEmpty():  # nothing leads on from null, so pairs with it lead one way
            first = halves.groupBy("_mid").agg(F.min("_src").alias("b"))
            return _members(base, components(halves.join(first, "_mid").select(F.col("_src").alias("a"), "b")), column)
    hops = durable(hops.where("_src IS NOT NULL").distinct(), "hops")
    if hops.select(F.col("_dst").alias("_src"), F.col("_src").alias("_dst")).subtract(hops).isEmpty():
        return _members(base, components(hops.select(F.col("_src").alias("a"), F.col("_dst").alias("b"))), column)

    def step(frontier: DataFrame) -> DataFrame:
        return frontier.join(hops, F.col(f"`{column}`") == F.col("_src")).select(*[F.col("_dst").alias(c) if c == column else F.col(f"`{c}`") for c in base.columns])

    return fixpoint(base, step)


def _members(base: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """The distinct rows of ``base``, with every value of the component (``labels``: node, root) that ``column`` lies in."""
    carried = [f"`{c}`" for c in base.columns if c != column]
    base = durable(base.distinct(), "base")
    roots = labels.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    alone = base.join(roots, F.col(f"`{column}`") == F.col("_node"), "left_anti")
    starts = durable(base.join(roots, F.col(f"`{column}`") == F.col("_node")).select(*carried, "_root").distinct(), "starts")
    members = labels.select(F.col("node").alias("_member"), F.col("root").alias("_of"))
    a, b, meet, _ = dealt(starts, members, F.col("_root"), F.col("_of"))
    found = a.join(b, meet).select(*[F.col("_member").alias(c) if c == column else F.col(f"`{c}`") for c in base.columns])
    return alone.unionByName(found)
