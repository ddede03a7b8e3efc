"""Graph patterns as DataFrames.

A variable v has the columns v__p for its properties and v___id (nodes) or v___eid,
v___src, v___dst (relationships); what a query does not use is pruned by Catalyst.

Labels and types that a pattern leaves open are resolved against the catalog first: each
consistent choice is a branch, and branches are united by name. In a branch, an edge that
is a foreign key costs no join at the end whose table holds it, and an end that the query
does not look into costs none where the catalog says that ends always exist.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.catalog import EdgeTable, PropertyGraph
from quillgraph.operators.planner import planned, turned
from quillgraph.plans import ir


@dataclass(frozen=True)
class Step:
    rel: ir.RelPat
    edge: EdgeTable
    forward: bool
    left: str
    right: str
    both: bool = False


@dataclass(frozen=True)
class Branch:
    labels: tuple[tuple[str, str], ...]  # variable, label
    paths: tuple[tuple[str, tuple[Step, ...]], ...]  # first variable, steps
    also: tuple[tuple[str, str], ...] = ()  # variable, a further label it has to have


def named(paths: tuple[ir.Path, ...], fresh: Iterator[int]) -> tuple[ir.Path, ...]:
    """Every node and relationship with a variable."""
    out = []
    for p in paths:
        nodes = tuple(n if n.var else ir.NodePat(f"_n{next(fresh)}", n.labels) for n in p.nodes)
        rels = tuple(r if r.var else ir.RelPat(f"_r{next(fresh)}", r.types, r.direction) for r in p.rels)
        out.append(ir.Path(p.var, nodes, rels))
    return tuple(out)


def branches(graph: PropertyGraph, paths: tuple[ir.Path, ...], known: dict[str, str]) -> list[Branch]:
    """Every consistent choice of labels, edge tables and directions."""
    want: dict[str, set[str]] = {}
    for p in paths:
        for n in p.nodes:
            for label in n.labels:
                want.setdefault(n.var, set()).add(graph.label(label))

    def fits(labels: dict[str, str], var: str, label: str) -> bool:
        return labels.get(var, label) == label and label in want.get(var, {label})

    found = [(dict(known), ())]
    for p in paths:
        grown = []
        for labels, done in found:
            partial = [(labels, ())]
            for i, r in enumerate(p.rels):
                a, b = p.nodes[i].var, p.nodes[i + 1].var
                types = [graph.type(t) for t in r.types] or list(graph.edges)
                after = []
                for own, steps in partial:
                    for t in types:
                        for e in graph.edges[t]:
                            for forward in {"out": (True,), "in": (False,), "both": (True, False)}[r.direction]:
                                x, y = (e.source_label, e.target_label) if forward else (e.target_label, e.source_label)
                                if fits(own, a, x) and fits(own | {a: x}, b, y):
                                    after.append((own | {a: x, b: y}, (*steps, Step(r, e, forward, a, b, r.direction == "both"))))
                partial = after
            if not p.rels:
                v = p.nodes[0].var
                # Of several labels one gives the scan; the others are joined to it.
                options = [labels[v]] if v in labels else sorted(want[v])[:1] if v in want else sorted(graph.nodes)
                partial = [(labels | {v: x}, ()) for x in options if fits(labels, v, x)]
            grown += [(own, (*done, (p.nodes[0].var, steps))) for own, steps in partial]
        found = grown
    return [Branch(tuple(sorted(labels.items())), done, tuple((v, x) for v, all_ in sorted(want.items()) for x in sorted(all_ - {labels[v]}))) for labels, done in found]


class Matcher:
    def __init__(self, graph: PropertyGraph, trail: bool = True) -> None:
        self.graph, self.trail = graph, trail

    def node(self, var: str, label: str) -> DataFrame:
        """Scan of a label; foreign keys that are edges are v___fk_TYPE."""
        t = self.graph.nodes[label]
        held = [e for es in self.graph.edges.values() for e in es if self._held(e, label)]
        fks = [F.col(self._fk(e)).alias(f"{var}___fk_{e.type}_{e.source_label}_{e.target_label}") for e in held]
        return t.df.select(F.col(t.key).alias(f"{var}___id"), *[F.col(c).alias(f"{var}__{c}") for c in t.properties], *fks)

    @staticmethod
    def _held(e: EdgeTable, label: str) -> bool:
        return e.held_by == "target" and e.target_label == label or e.held_by == "source" and e.source_label == label

    @staticmethod
    def _fk(e: EdgeTable) -> str:
        return e.source if e.held_by == "target" else e.target

    def edge(self, var: str, e: EdgeTable) -> DataFrame:
        return e.df.select(
            F.col(e.eid).alias(f"{var}___eid"), F.col(e.source).alias(f"{var}___src"), F.col(e.target).alias(f"{var}___dst"),
            *[F.col(c).alias(f"{var}__{c}") for c in e.properties],
        )

    def _step(self, df: DataFrame | None, s: Step, bound: set[str], looked: set[str], labels: dict[str, str]) -> DataFrame:
        """``df`` with the relationship and both its ends."""
        r, e = s.rel.var, s.edge
        left, right = s.left, s.right
        near, far = (f"{r}___src", f"{r}___dst") if s.forward else (f"{r}___dst", f"{r}___src")
        # Which end's own table holds the edge, seen from left to right.
        holder = None if e.held_by is None else right if (e.held_by == "target") == s.forward else left
        fk = f"___fk_{e.type}_{e.source_label}_{e.target_label}"

        def from_node(d: DataFrame, v: str) -> DataFrame:
            mine, other = (f"{v}___id", f"{v}{fk}")
            src, dst = (mine, other) if e.held_by == "source" else (other, mine)
            return d.select("*", F.col(mine).alias(f"{r}___eid"), F.col(src).alias(f"{r}___src"), F.col(dst).alias(f"{r}___dst")).where(F.col(other).isNotNull())

        scanned = df is not None and f"{left}{fk}" in df.columns
        if df is None and left not in bound and left in looked:
            df = self.node(left, labels[left])
            bound.add(left)
            scanned = True
        if df is not None and left in bound:
            if holder == left and scanned and not e.properties:
                df = from_node(df, left)
                if right in bound:
                    return df.where(F.col(far) == F.col(f"{right}___id"))
            elif holder == right and right in looked and right not in bound and not e.properties:
                new = from_node(self.node(right, labels[right]), right)
                bound.add(right)
                return df.join(new, F.col(f"{left}___id") == F.col(near))
            else:
                on = F.col(f"{left}___id") == F.col(near)
                if right in bound:
                    return df.join(self.edge(r, e), on & (F.col(f"{right}___id") == F.col(far)))
                df = df.join(self.edge(r, e), on)
        else:
            own = self.edge(r, e)
            if df is None and holder == right and right in looked and right not in bound and left != right and not e.properties:
                bound.update((left, right))
                return self._end(from_node(self.node(right, labels[right]), right), left, near, labels, looked, e)
            if df is None:
                df = own
            elif right in bound:
                df = df.join(own, F.col(f"{right}___id") == F.col(far))
            else:
                df = df.crossJoin(own)
            df = self._end(df, left, near, labels, looked, e)
            bound.add(left)
            if right in bound:
                return df if left != right else df.where(F.col(near) == F.col(far))
        if right in bound:
            return df.where(F.col(far) == F.col(f"{right}___id"))
        bound.add(right)
        return self._end(df, right, far, labels, looked, e)

    def _end(self, df: DataFrame, var: str, at: str, labels: dict[str, str], looked: set[str], e: EdgeTable) -> DataFrame:
        if var in looked:
            return df.join(self.node(var, labels[var]), F.col(at) == F.col(f"{var}___id"))
        out = df.withColumn(f"{var}___id", F.col(at))
        if e.complete:
            return out.where(F.col(at).isNotNull())
        t = self.graph.nodes[labels[var]]
        return out.join(t.df.select(F.col(t.key).alias("_end")), F.col(at) == F.col("_end"), "left_semi")

    @staticmethod
    def _is_triangle(path: tuple[Step, ...]) -> bool:
        return len(path) == 3 and path[2].right == path[0].left and len({x.left for x in path}) == 3

    @staticmethod
    def _ids(s: Step) -> tuple[str, str]:
        """The columns of a step's left and right end."""
        a, b = f"{s.rel.var}___src", f"{s.rel.var}___dst"
        return (a, b) if s.forward else (b, a)

    def wedges(self, path: tuple[Step, ...]) -> list[tuple[DataFrame, DataFrame]]:
        """For each corner of a triangle the pairs of edges that meet there, where it has the
        fewest edges of the three corners (of equal ones the first), and the edge that closes them.

        A corner's degree counts its edges of both sides of the pattern. Every triangle has one
        such corner, so it comes once, and a hub is never where two edges are paired unless its
        neighbours are hubs as well. What grows with the edges is merged, never broadcast: a dozen
        joins at once, each of a table just below Spark's threshold, would fill the driver.
        """
        edges = [self.edge(s.rel.var, s.edge) for s in path]
        degrees = []
        for k, s in enumerate(path):
            before = path[k - 1]
            ends = edges[k].select(F.col(self._ids(s)[0]).alias("k")).unionAll(edges[k - 1].select(F.col(self._ids(before)[1]).alias("k")))
            degrees.append(ends.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("d")))

        def graded(k: int) -> DataFrame:
            """An edge with the degrees of its left and right corner."""
            df = edges[k]
            for at, corner in zip(self._ids(path[k]), (k, (k + 1) % 3), strict=True):
                df = df.join(degrees[corner].select(F.col("k").alias("_k"), F.col("d").alias(f"_d{corner}")).hint("merge"), F.col(at) == F.col("_k")).drop("_k")
            return df

        out = []
        for i in range(3):
            into, onto = (i + 2) % 3, (i + 1) % 3
            def above(other: int, i: int = i):
                return F.col(f"_d{other}") > F.col(f"_d{i}") if other < i else F.col(f"_d{other}") >= F.col(f"_d{i}")

            a = graded(into).where(above(into)).drop(f"_d{into}", f"_d{i}")
            b = graded(i).where(above(onto)).drop(f"_d{onto}", f"_d{i}")
            out.append((a.join(b.hint("merge"), F.col(self._ids(path[into])[1]) == F.col(self._ids(path[i])[0])), edges[onto]))
        return out

    def _triangle(self, path: tuple[Step, ...], labels: dict[str, str], looked: set[str]) -> DataFrame:
        """Three edges that close, paired at the corner of the lowest degree."""
        out = None
        for i, (pairs, third) in enumerate(self.wedges(path)):
            into, onto = path[(i + 2) % 3], path[(i + 1) % 3]
            start, end = self._ids(onto)
            closed = pairs.join(third.hint("merge"), (F.col(self._ids(path[i])[1]) == F.col(start)) & (F.col(self._ids(into)[0]) == F.col(end)))
            out = closed if out is None else out.unionByName(closed)
        for s in path:
            out = self._end(out, s.left, self._ids(s)[0], labels, looked, s.edge)
        return out

    def branch(self, b: Branch, looked: set[str]) -> DataFrame:
        labels, df, bound = dict(b.labels), None, set()
        waiting = list(b.paths)
        steps: list[Step] = []
        while waiting:
            # A path that touches what is bound comes first.
            k = next((i for i, (v, s) in enumerate(waiting) if v in bound or any(x.right in bound for x in s)), 0)
            first, path = waiting.pop(k)
            if not path and first not in bound:
                new = self.node(first, labels[first])
                df = new if df is None else df.crossJoin(new)
                bound.add(first)
            if path and first not in bound and any(x.right in bound for x in path):
                # Begin at the bound variable and walk both ways from it.
                at = next(i for i, x in enumerate(path) if x.right in bound)
                path = (*map(turned, reversed(path[: at + 1])), *path[at + 1 :])
            elif df is None and self.graph.statistics is not None and path and not any(x.both for x in path):
                if self._is_triangle(path):
                    df = self._triangle(path, labels, looked)
                    bound.update(x.left for x in path)
                    steps += path
                    continue
                path = planned(path, labels, self.graph.statistics)
            for s in path:
                df = self._step(df, s, bound, looked, labels)
                if s.both and not s.forward and s.edge.source_label == s.edge.target_label:
                    df = df.where(F.col(f"{s.rel.var}___src") != F.col(f"{s.rel.var}___dst"))  # a loop is met once
                steps.append(s)
        for var, label in b.also:
            other = self.node("_also", label)
            own = {c: f"{var}{c[5:]}" for c in other.columns if c.startswith("_also__") and not c.startswith("_also___")}
            new = other.select("_also___id", *[F.col(c).alias(n) for c, n in own.items() if n not in df.columns])
            df = df.join(new, F.col(f"{var}___id") == F.col("_also___id")).drop("_also___id")
        if self.trail:
            for i, a in enumerate(steps):
                for c in steps[:i]:
                    if a.edge is c.edge and a.rel.var != c.rel.var:
                        df = df.where(F.col(f"{a.rel.var}___eid") != F.col(f"{c.rel.var}___eid"))
        return df.select(*[c for c in df.columns if "___fk_" not in c])

    def match(self, paths: tuple[ir.Path, ...], known: dict[str, str], looked: set[str]) -> tuple[DataFrame, dict[str, str | None]]:
        """Rows of all branches, and the label of each node variable (None if several)."""
        found = branches(self.graph, paths, known)
        if not found:
            raise ValueError("no label or relationship type fits the pattern")
        if len(found) == 1:
            return self.branch(found[0], looked), dict(found[0].labels)
        mixed = {v: len({dict(b.labels)[v] for b in found}) > 1 for v, _ in found[0].labels}
        parts = []
        for b in found:
            df, labels = self.branch(b, looked), dict(b.labels)
            extra = [F.lit(labels[v]).alias(f"{v}___label") for v, many in mixed.items() if many]
            extra += [F.lit(s.edge.type).alias(f"{s.rel.var}___type") for _, path in b.paths for s in path]
            parts.append(df.select("*", *extra))
        # A column of several types in several branches is a text.
        kinds: dict[str, set[str]] = {}
        for p in parts:
            for c, k in p.dtypes:
                kinds.setdefault(c, set()).add(k)
        clash = [c for c, k in kinds.items() if len(k) > 1]
        out = None
        for p in parts:
            p = p.withColumns({c: F.col(c).cast("bigint" if kinds[c] <= {"int", "bigint"} else "string") for c in clash if c in p.columns}) if clash else p
            out = p if out is None else out.unionByName(p, allowMissingColumns=True)
        return out, {v: None if many else dict(found[0].labels)[v] for v, many in mixed.items()}
