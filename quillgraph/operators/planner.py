"""Order of the joins of a path, from counts and degrees of its edges.

``analyzed`` sums up each edge table once: rows, nodes at either end, and the sums of
squared degrees, which tell how many neighbours a node has that an edge leads to (a hub
weighs by its square). A chain of edges is joined from the stretch and in the direction that
make the fewest rows on the way. Without statistics patterns are joined as they are written.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from quillgraph.catalog import EdgeTable, PropertyGraph


@dataclass(frozen=True)
class Degrees:
    """Edges, the nodes at one end, and the sum of their squared degrees."""

    rows: int
    nodes: int
    squares: int

    @property
    def met(self) -> float:
        """Degree of a node that one of these edges leads to."""
        return self.squares / max(1, self.rows)


@dataclass(frozen=True)
class Statistics:
    """Nodes by label; degrees by edge table and end (source: True)."""

    nodes: dict[str, int]
    ends: dict[tuple[str, str, str, bool], Degrees]

    def end(self, e: EdgeTable, source: bool) -> Degrees:
        return self.ends[e.type, e.source_label, e.target_label, source]

    def fan(self, e: EdgeTable, source: bool, label: str, before: EdgeTable | None) -> float:
        """Edges of ``e`` that a node at its source (or target) end has, come upon by ``before``."""
        d = self.end(e, source)
        # By an edge of the same table hubs are come upon as often as they have edges.
        return d.met if before is e else d.rows / max(1, self.nodes.get(label, d.nodes))


def analyzed(graph: PropertyGraph) -> Statistics:
    """One aggregation by key for each end of each edge table; a few numbers come back."""
    nodes = {label: t.df.count() for label, t in graph.nodes.items()}
    ends = {}
    for tables in graph.edges.values():
        for e in tables:
            for source in (True, False):
                per = e.df.groupBy(F.col(e.source if source else e.target).alias("k")).count().where("k IS NOT NULL")
                r = per.agg(F.sum("count").alias("rows"), F.count(F.lit(1)).alias("nodes"), F.sum(F.col("count") * F.col("count")).alias("squares")).first()
                ends[e.type, e.source_label, e.target_label, source] = Degrees(r.rows or 0, r.nodes, r.squares or 0)
    return Statistics(nodes, ends)


def turned(s):
    """A step walked the other way."""
    return replace(s, forward=not s.forward, left=s.right, right=s.left)


def estimated(steps: tuple, labels: dict[str, str], stats: Statistics) -> float:
    """Rows of a chain of steps."""
    rows, before = float(stats.end(steps[0].edge, True).rows), steps[0].edge
    for s in steps[1:]:
        rows *= stats.fan(s.edge, s.forward, labels[s.left], before)
        before = s.edge
    return rows


def planned(steps: tuple, labels: dict[str, str], stats: Statistics) -> tuple:
    """The steps of a path in the order of the fewest estimated rows on the way, by dynamic
    programming over its stretches; what is joined to the left is walked backwards."""
    n = len(steps)
    best: dict[tuple[int, int], tuple[float, tuple]] = {}
    for i in range(n):
        s = steps[i]
        # A single edge is best walked from the end with fewer nodes.
        few = stats.nodes.get(labels[s.left], 0) <= stats.nodes.get(labels[s.right], 0)
        best[i, i + 1] = (estimated((s,), labels, stats), (s if few else turned(s),))
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            j = i + size
            rows = estimated(steps[i:j], labels, stats)
            right = (best[i, j - 1][0] + rows, (*best[i, j - 1][1], steps[j - 1]))
            left = (best[i + 1, j][0] + rows, (*best[i + 1, j][1], turned(steps[i])))
            best[i, j] = min(right, left, key=lambda x: x[0])
    return best[0, n][1]
