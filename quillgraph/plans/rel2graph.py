"""Relational join specifications as graph patterns.

Tables are entities (nodes) or join tables (relationships). An inner equi join that
follows a known edge becomes a path; every join keeps its predicate, so results never
depend on whether an edge was found. Unlike a rewrite that only looks at equalities, outer
sides, theta joins and alternatives of equalities keep their meaning.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.dealt import dealt
from quillgraph.operators.ranges import Interval, interval_join
from quillgraph.plans import ir


@dataclass(frozen=True)
class Table:
    name: str
    alias: str


@dataclass(frozen=True)
class Join:
    """``on`` is an IR expression over Prop(alias, column); ``side``: inner, left, right, full,
    semi, anti, cross. ``using`` are columns that the table before has too; ``hint`` is a join
    hint of Spark's for the joined side, which only frames take."""

    table: Table
    on: object = None
    side: str = "inner"
    using: tuple[str, ...] = ()
    hint: str | None = None


@dataclass(frozen=True)
class Edge:
    """An edge of the catalog: a foreign key, or a join table (``via``) whose columns
    ``via_source`` and ``via_target`` hold the keys of its ends."""

    label: str
    source: str
    target: str
    source_columns: tuple[str, ...]
    target_columns: tuple[str, ...]
    via: str | None = None
    via_source: tuple[str, ...] = ()
    via_target: tuple[str, ...] = ()


def conjuncts(x) -> list:
    return [] if x is None else [*conjuncts(x.left), *conjuncts(x.right)] if isinstance(x, ir.Bin) and x.op == "and" else [x]


def normal(on):
    """A join condition in normal form: a bare column is compared with 0, and an equality
    that is compared with a column is never true."""
    if isinstance(on, ir.Prop):
        return ir.Bin("<>", on, ir.Lit(0))
    if isinstance(on, ir.Bin) and on.op == "=" and (isinstance(on.left, ir.Bin) or isinstance(on.right, ir.Bin)):
        return ir.Lit(False)
    return on


def equal_columns(x) -> tuple[ir.Prop, ir.Prop] | None:
    """The two columns of an equality, also under LOWER on both sides."""
    if not (isinstance(x, ir.Bin) and x.op == "="):
        return None
    a, b = x.left, x.right
    if all(isinstance(y, ir.Call) and y.name == "lower" for y in (a, b)):
        a, b = a.args[0], b.args[0]
    return (a, b) if isinstance(a, ir.Prop) and isinstance(b, ir.Prop) and a.var != b.var else None


def condition(j: Join, before: str) -> object:
    """A join's condition, with USING spelled out against the table ``before``."""
    out = normal(j.on)
    for c in j.using:
        same = ir.Bin("=", ir.Prop(before, c), ir.Prop(j.table.alias, c))
        out = same if out is None else ir.Bin("and", out, same)
    return out


class _Rewriter:
    """Paths for joins, one after another."""

    def __init__(self, tables: dict[str, str], edges: list[Edge], join_tables: set[str]) -> None:
        self.tables, self.edges = tables, edges
        self.joining = set(join_tables) | {e.via for e in edges if e.via}
        #: For each alias of a join table: its edge, and the variables of its ends.
        self.ends: dict[str, tuple[Edge | None, dict[str, str]]] = {}

    def element(self, alias: str) -> ir.Path:
        name = self.tables[alias]
        if name not in self.joining:
            return ir.Path(None, (ir.NodePat(alias, (name,)),), ())
        edge, ends = self.ends.get(alias, (None, {}))
        if edge is None:  # a relationship with open ends
            return ir.Path(None, (ir.NodePat(), ir.NodePat()), (ir.RelPat(alias, (name,)),))
        nodes = [ir.NodePat(ends[side], (label,)) if side in ends else ir.NodePat() for side, label in (("source", edge.source), ("target", edge.target))]
        return ir.Path(None, tuple(nodes), (ir.RelPat(alias, (edge.label,)),))

    def groups(self, on) -> dict[tuple[str, str], list[tuple[str, str]]]:
        """Pairs of aliases and the pairs of columns that a condition holds equal."""
        out: dict[tuple[str, str], list[tuple[str, str]]] = {}
        for c in conjuncts(on):
            pair = equal_columns(c)
            if pair:
                a, b = sorted(pair, key=lambda p: p.var)
                out.setdefault((a.var, b.var), []).append((a.name, b.name))
        return out

    def attach(self, conditions: list) -> set[tuple[str, str]]:
        """Find the edge of every join table by all conditions; the pairs of aliases that an end stands for."""
        held = set()
        wanted: dict[str, list[tuple[str, list[tuple[str, str]]]]] = {}
        for on in conditions:
            for (a, b), cols in self.groups(on).items():
                for x, y, pairs in ((a, b, cols), (b, a, [(q, p) for p, q in cols])):
                    if self.tables.get(x) in self.joining and self.tables.get(y) not in self.joining:
                        wanted.setdefault(x, []).append((y, pairs))
        for alias, found in wanted.items():
            best: tuple[int, Edge | None, dict[str, str]] = (0, None, {})
            for e in self.edges:
                if e.via != self.tables[alias]:
                    continue
                ends: dict[str, str] = {}
                for other, pairs in found:
                    for side, label, own, key in (("source", e.source, e.via_source, e.source_columns), ("target", e.target, e.via_target, e.target_columns)):
                        if side not in ends and self.tables[other] == label and sorted(zip(own, key, strict=True)) == sorted(pairs):
                            ends[side] = other
                            break
                if len(ends) > best[0]:
                    best = (len(ends), e, ends)
            if best[1] is not None:
                self.ends[alias] = best[1:]
                held |= {tuple(sorted((alias, v))) for v in best[2].values()}
        return held

    def paths(self, on, alias: str) -> list[ir.Path]:
        """Paths of the foreign keys that a condition follows, else the joined table alone."""
        out = []
        for (a, b), cols in self.groups(on).items():
            for x, y, pairs in ((a, b, cols), (b, a, [(q, p) for p, q in cols])):
                for e in self.edges:
                    if e.via is None and (e.source, e.target) == (self.tables.get(x), self.tables.get(y)) and sorted(zip(e.source_columns, e.target_columns, strict=True)) == sorted(pairs):
                        out.append(ir.Path(None, (ir.NodePat(x, (e.source,)), ir.NodePat(y, (e.target,))), (ir.RelPat(None, (e.label,)),)))
                        break
        return out or [self.element(alias)]


def _aliases(on) -> set[str]:
    return {p.var for p in ir.find_all(on, ir.Prop)} if on is not None else set()


def pattern(first: Table, joins: list[Join], edges: list[Edge], join_tables: set[str] = frozenset()) -> list[ir.Match]:
    """MATCH clauses for joins: paths where edges fit, nodes side by side else.

    A join table is the relationship between the tables it joins; where an edge's end stands
    for a condition the condition goes, all others stay. Semi and anti joins are EXISTS and
    NOT EXISTS. A full join has no clause: ``query`` unites its two halves.
    """
    tables = {t.alias: t.name for t in [first, *[j.table for j in joins]]}
    ons, before = [], first.alias
    for j in joins:
        ons.append(condition(j, before))
        before = j.table.alias if j.side not in ("semi", "anti") else before
    w = _Rewriter(tables, edges, set(join_tables))
    held = w.attach([on for j, on in zip(joins, ons, strict=True) if j.side in ("inner", "cross")])

    def rest(on):
        """A condition without what the ends of relationships say."""
        def stays(c) -> bool:
            pair = equal_columns(c)
            if not pair or tuple(sorted(p.var for p in pair)) not in held:
                return True
            return isinstance(c.left, ir.Call)  # LOWER is not what the key says

        return _all([c for c in conjuncts(on) if stays(c)])

    segments = [{"must": [w.element(first.alias)], "where": [], "optional": []}]
    nullable: set[str] = set()
    for j, on in zip(joins, ons, strict=True):
        now, alias = segments[-1], j.table.alias
        if j.side == "full":
            raise ValueError("a full join is no pattern: build a query or join frames")
        if j.side in ("semi", "anti"):
            inner = ir.Exists(ir.Single((ir.Match(tuple(w.paths(on, alias)), on), ir.Return((ir.Item(ir.Lit(1), "one"),)))))
            test = inner if j.side == "semi" else ir.Un("not", inner)
            if _aliases(on) & nullable or now["optional"]:
                segments.append({"must": [], "where": [test], "optional": []})
            else:
                now["where"].append(test)
        elif j.side == "left":
            now["optional"].append(ir.Match(tuple(w.paths(on, alias)), on, True))
            nullable.add(alias)
        elif j.side == "right":
            if len(segments) > 1 or _aliases(on) & nullable:
                raise ValueError("a right join on an optional table is no pattern: join frames")
            earlier = ir.Match(ir.merge_paths(tuple(now["must"]), any_way=True), _all([*now["where"], *([] if on is None else [on])]), True)
            nullable |= set(tables) & {n.var for p in now["must"] for n in p.nodes} | {r.var for p in now["must"] for r in p.rels}
            segments = [{"must": [w.element(alias)], "where": [], "optional": [earlier, *now["optional"]]}]
        else:
            left = rest(on)
            found = [w.element(alias)] if tables[alias] in w.joining else w.paths(left, alias)
            if _aliases(on) & nullable:
                segments.append({"must": found, "where": [on], "optional": []})
            else:
                # A join table's path may have to wait for its other end: it is merged by variable.
                segments[0]["must"] += found
                segments[0]["where"] += [] if left is None else [left]
    out = []
    for x in segments:
        if x["must"]:
            out.append(ir.Match(ir.merge_paths(tuple(dict.fromkeys(x["must"])), any_way=True), _all(x["where"])))
        elif x["where"]:
            out.append(ir.Filter(_all(x["where"])))
        out += x["optional"]
    return out


def query(first: Table, joins: list[Join], edges: list[Edge], items: tuple[ir.Item, ...], join_tables: set[str] = frozenset(), where=None) -> ir.Single | ir.SetOp:
    """A whole query of joins: ``items`` of the rows for which ``where`` holds.

    A last full join is the left join and, united with it, the joined table's rows without a partner.
    """
    tail = () if where is None else (ir.Filter(where),)
    if not joins or joins[-1].side != "full":
        return ir.Single((*pattern(first, joins, edges, join_tables), *tail, ir.Return(items)))
    *early, last = joins
    before = early[-1].table.alias if early else first.alias
    on = condition(last, before)
    kept = last.table.alias
    left = query(first, [*early, Join(last.table, on, "left")], edges, items, join_tables, where)
    partner = ir.Exists(ir.Single((*pattern(first, early, edges, join_tables), ir.Filter(on), ir.Return((ir.Item(ir.Lit(1), "one"),)))))
    # Whatever is of the other tables is null here.
    void = lambda x: ir.transform(x, lambda y: ir.Lit(None) if isinstance(y, ir.Prop) and y.var != kept else y)
    _, alone = tables_of(last.table)
    right = ir.Single((ir.Match((alone,), ir.Un("not", partner)), *(() if where is None else (ir.Filter(void(where)),)), ir.Return(tuple(ir.Item(void(i.x), i.alias) for i in items))))
    return ir.SetOp("union", False, left, right)


def tables_of(t: Table) -> tuple[str, ir.Path]:
    return t.alias, ir.Path(None, (ir.NodePat(t.alias, (t.name,)),), ())


def _all(xs: list):
    out = None
    for x in xs:
        out = x if out is None else ir.Bin("and", out, x)
    return out


def disjuncts(x) -> list:
    return [*disjuncts(x.left), *disjuncts(x.right)] if isinstance(x, ir.Bin) and x.op == "or" else [x]


#: A comparison seen from its other side.
TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _comparisons(on) -> list[ir.Bin]:
    out = []
    for c in conjuncts(on):
        if isinstance(c, ir.Between):
            out += [ir.Bin(">=", c.x, c.low), ir.Bin("<=", c.x, c.high)]
        elif isinstance(c, ir.Bin) and c.op in TURNED:
            out.append(c)
    return out


def _side(x, left: DataFrame, right: DataFrame, columns) -> str | None:
    """Which frame an expression is of: left, right, or None where it is of neither alone."""
    if not _aliases(x):
        return None
    found = []
    log = logging.getLogger("DataFrameQueryContextLogger")  # what a frame does not have is no error here
    was, log.disabled = log.disabled, True
    try:
        for name, df in (("left", left), ("right", right)):
            try:
                df.select(columns(x)).schema  # noqa: B018
                found.append(name)
            except AnalysisException:
                pass
    finally:
        log.disabled = was
    return found[0] if len(found) == 1 else None


def intervals(on, left: DataFrame, right: DataFrame, columns) -> dict[tuple[str, object], Interval]:
    """For each expression of one side that the condition bounds by the other side: its interval."""
    out: dict[tuple[str, object], Interval] = {}
    for c in _comparisons(on):
        sides = _side(c.left, left, right, columns), _side(c.right, left, right, columns)
        if set(sides) != {"left", "right"}:
            continue
        a, b = columns.pair(c.left, c.right)
        for key, op, point, bound in (((sides[0], c.left), c.op, a, b), ((sides[1], c.right), TURNED[c.op], b, a)):
            old = out.get(key, Interval(point))
            if str(old.point) != str(point):  # compared in another class
                continue
            out[key] = Interval(point, (*old.lows, bound), old.highs) if op in (">", ">=") else Interval(point, old.lows, (*old.highs, bound))
    return out


def _theta(left: DataFrame, right: DataFrame, on, side: str, columns) -> DataFrame | None:
    """A join whose condition bounds a value of one side by the other, or None where none is so."""
    if any(map(equal_columns, conjuncts(on))):
        return None  # an equi join takes the rest as its condition
    found = intervals(on, left, right, columns)
    if not found:
        return None
    own = "right" if side == "right" else "left"

    def worth(item) -> tuple:
        (where, _), i = item
        return bool(i.lows) and bool(i.highs), where == own

    (where, x), best = max(found.items(), key=worth)
    names = {}
    for p in ir.find_all(on, ir.Prop):
        names[_side(p, left, right, columns)] = p.var
    return interval_join(left, right, columns(on), best, where == "left", side, (names.get("left"), names.get("right")))


def join_frames(left: DataFrame, right: DataFrame, on, side: str = "inner", columns=None, using: tuple[str, ...] = (), hint: str | None = None) -> DataFrame:
    """A relational join with any condition; an OR of equalities is split into equi joins.

    ``on`` maps to a column through ``columns`` (a Compiler). Each further branch of an OR takes
    the rows of which no earlier one is true (false or null), so no pair comes twice; outer
    joins add the rows that no branch joins, and semi joins take them branch by branch. A condition
    that only bounds a value of one side by values of the other becomes an interval join. ``hint``
    is a join hint of Spark's, as broadcast (for a side that is known to be small), merge or
    shuffle_hash.
    """
    kinds = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
    right = right.hint(hint) if hint else right
    if using:
        return left.join(right, list(using), kinds[side])
    if side == "cross" or on is None:
        return left.crossJoin(right)
    on = normal(on)
    branches = disjuncts(on)
    if len(branches) > 1 and all(map(equal_columns, branches)):
        return _either(left, right, branches, columns, side)
    if columns is not None and not hint:
        out = _theta(left, right, on, side, columns)
        if out is not None:
            return out
    return left.join(right, columns(on), kinds[side])


def _either(left: DataFrame, right: DataFrame, branches: list, columns, side: str) -> DataFrame:
    """A join on any of several equalities, each an equi join dealt by the pairs it makes."""
    tests = [columns(x) for x in branches]

    def pairs(x, test, but) -> DataFrame:
        """The pairs of one equality for which ``but`` does not hold."""
        sides = _side(x.left, left, right, columns), _side(x.right, left, right, columns)
        if set(sides) != {"left", "right"}:
            return left.join(right, test & ~but)
        keys = dict(zip(sides, columns.pair(x.left, x.right), strict=True))
        a, b, meet, own = dealt(left, right, keys["left"], keys["right"])
        return a.join(b, meet & ~but).drop(*own)

    def alone(df: DataFrame, other: DataFrame) -> DataFrame:
        for t in tests:
            df = df.join(other, t, "left_anti")
        return df

    if side == "anti":
        return alone(left, right)
    out, seen, rest = None, F.lit(False), left
    for x, t in zip(branches, tests, strict=True):
        if side == "semi":
            part, rest = rest.join(right, t, "left_semi"), rest.join(right, t, "left_anti")
        else:
            part = pairs(x, t, seen)
            seen = seen | F.coalesce(t, F.lit(False))
        out = part if out is None else out.union(part)
    if side in ("inner", "semi"):
        return out
    width, fields = len(left.columns), out.schema.fields
    void = lambda some: [F.lit(None).cast(f.dataType).alias(f.name) for f in some]
    whole = out
    if side in ("left", "full"):
        whole = whole.union(alone(left, right).select("*", *void(fields[width:])))
    if side in ("right", "full"):
        whole = whole.union(alone(right, left).select(*void(fields[:width]), "*"))
    return whole
