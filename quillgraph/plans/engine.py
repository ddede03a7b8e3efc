"""Queries as DataFrames: clauses are lowered one after the other over a binding table."""

from __future__ import annotations

from copy import copy
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.catalog import PropertyGraph
from quillgraph.functions.expressions import Compiler, has_aggregate, is_aggregate, kind_of, ordered
from quillgraph.operators.match import Matcher, named
from quillgraph.operators.ordered import BY_ROW, BY_TIE, RUNNING, Over, over_all
from quillgraph.operators.planner import analyzed
from quillgraph.operators.recursion import fixpoint, walked
from quillgraph.plans import ir
from quillgraph.plans.parser import parse
from quillgraph.plans.rel2graph import conjuncts


def _subqueries(x) -> list:
    """The uppermost scalar, counting and collecting subqueries of an expression."""
    if isinstance(x, ir.Scalar) or isinstance(x, ir.Call) and x.name in ("count_sub", "collect_sub"):
        return [x]
    if isinstance(x, (ir.Exists, ir.Single, ir.SetOp)):
        return []
    parts = x if isinstance(x, tuple) else [getattr(x, f) for f in getattr(x, "__dataclass_fields__", {})]
    return [y for part in parts for y in _subqueries(part)]


def _plainly_correlated(x, query, around: set[str]) -> bool:
    """Whether a subquery is patterns and conditions with one plain aggregate, or a count of such rows."""
    if not isinstance(query, ir.Single):
        return False
    *clauses, last = query.clauses
    if not isinstance(last, ir.Return):
        clauses, last = query.clauses, None
    if not all(isinstance(c, ir.Filter) or isinstance(c, ir.Match) and not c.optional for c in clauses) or not clauses:
        return False
    if any(_subqueries(c.where) for c in clauses) or isinstance(x, ir.Call) and x.name == "collect_sub":
        return False
    if last is None:
        return isinstance(x, ir.Call)
    if last.distinct or last.group_by or last.qualify is not None or len(last.items) != 1:
        return False
    item = last.items[0].x
    if ({p.var for p in ir.find_all(item, ir.Prop)} | {v.name for v in ir.find_all(item, ir.Var)}) & around:
        return False
    return is_aggregate(item) if isinstance(x, ir.Scalar) else not has_aggregate(item)


@dataclass
class Bound:
    kind: str  # node, edge, value, path, row
    label: str | None = None
    hops: int | None = None
    types: tuple[str, ...] = ()


@dataclass
class State:
    """A binding table and its variables; ``outer`` is the state around a subquery, and
    ``pending`` the conditions that refer to it, which are put last.

    A table that looks at the query around cannot be analysed on its own; ``shape`` is then a
    table of the same columns that can. Where a subquery is answered for all rows around it at
    once, ``around`` gives for each column of theirs that it knows the variable that stands for
    it, and ``domain`` is the table of these variables.
    """

    df: DataFrame | None = None
    vars: dict[str, Bound] = field(default_factory=dict)
    outer: State | None = None
    lets: dict[str, object] = field(default_factory=dict)
    pending: list = field(default_factory=list)
    shape: DataFrame | None = None
    around: dict[str, str] = field(default_factory=dict)
    domain: DataFrame | None = None

    @property
    def keys(self) -> tuple[str, ...]:
        return tuple(self.around.values())

    @property
    def held(self) -> tuple[str, ...]:
        """Elements of the rows around, which stay known throughout."""
        return tuple(c[: -len(t)] for c in self.around for t in ("___id", "___eid") if c.endswith(t))

    @property
    def plain(self) -> DataFrame | None:
        return self.df if self.shape is None else self.shape

    def kinds(self) -> dict[str, str]:
        return {} if self.df is None else {c: kind_of(t) for c, t in self.plain.dtypes}


class Scope:
    """What the compiler asks about variables."""

    def __init__(self, engine: Engine, state: State) -> None:
        self.engine, self.state = engine, state

    def _find(self, name: str) -> tuple[State, bool]:
        s, outer = self.state, False
        while s is not None:
            if name in s.vars:
                return s, outer
            s, outer = s.outer, True
        raise KeyError(f"no variable {name}")

    @staticmethod
    def _col(name: str, outer: bool) -> Column:
        c = F.col(f"`{name}`")
        return c.outer() if outer else c

    def var(self, name: str) -> Column:
        s, outer = self._find(name)
        b = s.vars[name]
        if b.kind == "path":
            return F.lit(b.hops)
        return self._col({"node": f"{name}___id", "edge": f"{name}___eid"}.get(b.kind, name), outer)

    def value_kind(self, name: str) -> str | None:
        s, _ = self._find(name)
        return s.kinds().get({"node": f"{name}___id", "edge": f"{name}___eid"}.get(s.vars[name].kind, name))

    def prop(self, var: str, name: str) -> tuple[Column, str | None]:
        s, outer = self._find(var)
        kinds = s.kinds()
        if s.vars[var].kind == "value":
            return self._col(var, outer).getField(name), None
        full = f"{var}__{name}"
        if full not in kinds:
            full = next((c for c in kinds if c.lower() == full.lower()), None)
        # A property that no element has is null.
        return (F.lit(None), None) if full is None else (self._col(full, outer), kinds[full])

    def hops(self, name: str) -> int | None:
        s, _ = self._find(name)
        return s.vars[name].hops

    def type_of(self, name: str) -> Column:
        s, outer = self._find(name)
        b = s.vars[name]
        for c in (f"{name}___label", f"{name}___type"):
            if c in s.kinds():
                return self._col(c, outer)
        return F.lit(b.label or (b.types[0] if b.types else None))

    def let_query(self, x):
        s = self.state
        while s is not None and isinstance(x, ir.Var):
            if x.name in s.lets:
                return s.lets[x.name]
            s = s.outer
        return None

    def subquery(self, query, exists: bool = False) -> DataFrame:
        return self.engine.subquery(query, self.state, exists)

    def columns(self, df: DataFrame) -> list[str]:
        return self.engine.shape(df).columns


class Engine:
    """Runs Cypher and ISO-GQL text over a property graph.

    ``match_mode``: 'trail' (no relationship twice in a MATCH) or 'walk'. ``mode``: 'sql'
    (sums of nothing are null) or 'cypher' (they are 0). ``compat`` cuts substrings as
    translated queries do instead of by SQL's rules. Threads may share an engine.
    """

    def __init__(self, spark: SparkSession, graph: PropertyGraph, dialect: str = "cypher", match_mode: str = "trail", mode: str = "sql", compat: bool = False) -> None:
        self.spark, self.graph, self.dialect, self.mode, self.compat = spark, graph, dialect, mode, compat
        self.matcher = Matcher(graph, match_mode == "trail")
        self._fresh = count(1)

    def analyze(self) -> Engine:
        """Take counts and degrees of the graph, by which joins are ordered from now on."""
        self.graph.statistics = analyzed(self.graph)
        return self

    def query(self, text: str, dialect: str | None = None, params: dict | None = None) -> DataFrame:
        """The result of a query text; ``params`` are the values of its $names."""
        one = copy(self)
        one.dialect = dialect or self.dialect
        return one.run(parse(text, one.dialect), params)

    def run(self, query, params: dict | None = None) -> DataFrame:
        # What belongs to one query stands in a copy, so threads may share an engine.
        one, query = copy(self), ir.bound(query, params)
        one._looked, one._shapes, one._tables = self._uses(query), {}, {}
        return one._lower(query, None)

    def shape(self, df: DataFrame) -> DataFrame:
        """``df``, or the table that tells the columns of a correlated result."""
        return self._shapes.get(id(df), (df, df))[1]

    # -- what a query looks into
    @staticmethod
    def _uses(query) -> set[str]:
        """Variables whose properties, or whole selves, a query uses."""
        used = {p.var for p in ir.find_all(query, ir.Prop)}
        for r in ir.find_all(query, (ir.Return, ir.With)):
            for i in r.items:
                if isinstance(i.x, ir.Star):
                    used |= {n.var for n in ir.find_all(query, (ir.NodePat, ir.RelPat)) if n.var}
                elif isinstance(i.x, ir.Var):
                    used.add(i.x.name)
        return used

    def compiler(self, state: State) -> Compiler:
        return Compiler(Scope(self, state), self.dialect, self.mode, self.compat)

    def _lower(self, query, outer: State | None, start: State | None = None) -> DataFrame:
        if isinstance(query, ir.SetOp):
            a, b = self._lower(query.left, outer, start), self._lower(query.right, outer, start)
            if query.by_name:
                if query.op != "union":
                    raise NotImplementedError(f"{query.op} by name")
                out = a.unionByName(b, allowMissingColumns=True)
                return out.distinct() if query.distinct else out
            if id(a) in self._shapes or id(b) in self._shapes:
                raise NotImplementedError("a set operation in a correlated subquery")
            b = b.toDF(*a.columns)
            if query.op == "union":
                return a.union(b).distinct() if query.distinct else a.union(b)
            if query.op == "intersect":
                return a.intersect(b) if query.distinct else a.intersectAll(b)
            return a.subtract(b) if query.distinct else a.exceptAll(b)
        state = start or State(outer=outer)
        clauses = list(query.clauses)
        result = None
        while clauses:
            c = clauses.pop(0)
            if isinstance(c, ir.Return):
                tail = []
                while clauses and isinstance(clauses[0], (ir.OrderBy, ir.Skip, ir.Limit)):
                    tail.append(clauses.pop(0))
                result = self._return(c, tail, state)
                if clauses:  # NEXT: the result is the table that goes on
                    plain = self.shape(result)
                    state = State(result, {n: Bound("value") for n in plain.columns}, outer, {}, [], None if plain is result else plain, state.around, state.domain)
            else:
                after = self._clause(c, state)
                after.around, after.domain = state.around, state.domain
                state = after
        if result is not None:
            return result
        # Without RETURN the rows are the result, once conditions on the query around are put to them.
        state = self._settled(state)
        if state.shape is not None:
            self._shapes[id(state.df)] = (state.df, state.shape)
        return state.df

    def subquery(self, query, state: State, exists: bool = False) -> DataFrame:
        if not exists or isinstance(query, ir.SetOp):
            return self._lower(query, state)
        # Whether there is a row does not depend on what a plain RETURN makes of it.
        inner = State(outer=state)
        for c in query.clauses:
            if isinstance(c, ir.Return) and not any(has_aggregate(i.x) for i in c.items):
                continue
            if isinstance(c, ir.Return):
                return self._lower(query, state)
            if not isinstance(c, ir.OrderBy):
                inner = self._clause(c, inner)
        return self._settled(inner).df

    @staticmethod
    def _settled(s: State) -> State:
        """``s`` with the conditions that waited for the query around put to its rows."""
        if not s.pending:
            return s
        df = s.df
        for condition in s.pending:
            df = df.where(condition)
        return State(df, s.vars, s.outer, s.lets, [], s.plain)

    # -- subqueries that look at the rows around them
    def _lifted(self, xs: tuple, s: State) -> tuple[State, dict]:
        """Correlated subqueries of expressions, answered beforehand: their values in the state,
        and for each subquery its variable.

        A subquery of patterns and conditions with one plain aggregate is left to Spark's own
        decorrelation. Any other is run once for all distinct values of what it knows of the
        rows around: those are its first binding table, they group its aggregates and part its
        limits, and its results join the rows again. What an aggregate of no rows gives is put
        where a value of the rows around has none.
        """
        if s.df is None or s.shape is not None:
            return s, {}
        names: dict = {}
        for x in dict.fromkeys(y for x in xs for y in _subqueries(x)):
            query = x.query if isinstance(x, ir.Scalar) else x.args[0]
            inside = {n.var for n in ir.find_all(query, (ir.NodePat, ir.RelPat)) if n.var} - set(s.vars)
            known = {q.var for q in ir.find_all(query, ir.Prop)} | {v.name for v in ir.find_all(query, ir.Var)} | {n.var for n in ir.find_all(query, (ir.NodePat, ir.RelPat))}
            around, o = set(), s.outer
            while o is not None:
                around |= set(o.vars)
                o = o.outer
            used = sorted(v for v in known & set(s.vars) if s.vars[v].kind != "path")
            if not used or (known - inside - set(s.vars)) & around or _plainly_correlated(x, query, set(s.vars)):
                continue
            s = self._answered(x, query, used, s, names)
        return s, names

    def _answered(self, x, query, used: list[str], s: State, names: dict) -> State:
        """``s`` with the value of the subquery ``x`` for each row, under a new variable in ``names``."""
        n = next(self._fresh)
        props = {(p.var, p.name.lower()) for p in ir.find_all(query, ir.Prop)}

        def seen(c: str) -> bool:
            v = next((v for v in used if c == v or c.startswith(f"{v}__")), None)
            return v is not None and (c == v or c.startswith(f"{v}___") or (v, c[len(v) + 2 :].lower()) in props)

        own = [c for c in s.df.columns if seen(c)]
        around = {c: f"_d{n}_{i}" for i, c in enumerate(own)}
        keys = tuple(around.values())
        domain = s.df.select(*[F.col(f"`{c}`").alias(k) for c, k in around.items()]).distinct()
        start = domain.select(*keys, *[F.col(k).alias(c) for c, k in around.items()])
        vars_ = {v: s.vars[v] for v in used} | {v: b for v, b in s.vars.items() if b.kind == "path"} | {k: Bound("value") for k in keys}
        query = ir.replaced(query, self._standing_for(query, used, around, s))
        found = self._lower(query, None, State(start, vars_, None, s.lets, around=around, domain=domain))
        value = next(c for c in found.columns if c not in keys)
        kind = "scalar" if isinstance(x, ir.Scalar) else x.name
        v = F.col(f"`{value}`")
        many = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a subquery gives more than one row"))).otherwise(F.first(v))
        result = {"scalar": many, "count_sub": F.count(F.lit(1)), "collect_sub": F.collect_list(v)}[kind]
        name = f"_q{n}"
        found = found.groupBy(*keys).agg(result.alias(name))
        on = F.lit(True)
        for c, k in zip(own, keys, strict=True):
            on = on & F.col(f"`{c}`").eqNullSafe(F.col(k))
        df = s.df.join(found, on, "left").drop(*keys)
        if kind == "count_sub":
            df = df.withColumn(name, F.coalesce(name, F.lit(0)))
        elif kind == "collect_sub":
            df = df.withColumn(name, F.coalesce(name, F.array().cast(df.schema[name].dataType)))
        names[x] = ir.Var(name)
        return State(df, s.vars | {name: Bound("value")}, s.outer, s.lets, s.pending, s.shape, s.around, s.domain)

    @staticmethod
    def _standing_for(query, used: list[str], around: dict[str, str], s: State) -> dict:
        """For what a subquery says of the rows around, the variables that stand for it."""
        low = {c.lower(): k for c, k in around.items()}
        names: dict = {}
        for v in used:
            kind = s.vars[v].kind
            for p in ir.find_all(query, ir.Prop):
                if p.var == v:
                    key = low.get(f"{v}__{p.name}".lower())
                    names[p] = ir.Prop(around[v], p.name) if kind == "value" else ir.Lit(None) if key is None else ir.Var(key)
            names[ir.Var(v)] = ir.Var(around[v if kind == "value" else f"{v}___id" if kind == "node" else f"{v}___eid"])
            if kind == "value":
                continue
            # Labels and types, and elements that WITH passes on, are those of the element itself.
            for c in ir.find_all(query, ir.Call):
                if c.name in ("type", "labels") and c.args == (ir.Var(v),):
                    names[c] = c
            for w in ir.find_all(query, ir.With):
                names |= {i: i for i in w.items if i.x == ir.Var(v)}
            if any(i.x == ir.Var(v) for r in ir.find_all(query, ir.Return) for i in r.items):
                raise NotImplementedError("an element of the rows around returned by a correlated subquery")
        return names

    def _where(self, condition, s: State) -> State:
        """``s`` filtered; a condition on the query around waits for the end."""
        s, lifted = self._lifted((condition,), s)
        condition = self._replaced(condition, lifted)
        c = self.compiler(s).boolean(condition)
        names = {p.var for p in ir.find_all(condition, ir.Prop)} | {v.name for v in ir.find_all(condition, ir.Var)}
        inside = {n.var for q in ir.find_all(condition, ir.Match) for n in ir.find_all(q, (ir.NodePat, ir.RelPat))}
        if names - set(s.vars) - inside - set(s.lets) and s.outer is not None:
            return State(s.df, s.vars, s.outer, s.lets, [*s.pending, c], s.shape)
        return State(s.df.where(c), s.vars, s.outer, s.lets, s.pending, s.shape)

    # -- clauses
    def _clause(self, c, s: State) -> State:
        if s.shape is not None and isinstance(c, (ir.Match, ir.CallSub, ir.Unwind, ir.Let, ir.From)):
            raise NotImplementedError("a pattern, call or list after WITH or LIMIT in a correlated subquery")
        if isinstance(c, ir.Match):
            return self._match(c, s)
        if isinstance(c, ir.With):
            return self._with(c, s)
        if isinstance(c, ir.Filter):
            return self._where(c.where, s)
        if isinstance(c, ir.OrderBy):
            k = self.compiler(s)
            return State(s.df.orderBy(*[k.sort_key(x) for x in c.keys]), s.vars, s.outer, s.lets, s.pending, s.shape)
        if isinstance(c, (ir.Skip, ir.Limit)):
            if s.keys:
                raise NotImplementedError("SKIP or LIMIT before RETURN in a correlated subquery of this kind")
            s = self._settled(s)
            return State(s.df.offset(c.n) if isinstance(c, ir.Skip) else s.df.limit(c.n), s.vars, s.outer, s.lets, [], s.shape)
        if isinstance(c, ir.Let):
            if isinstance(c.x, ir.Scalar):  # a value list; IN makes it a semi join
                return State(s.df, s.vars, s.outer, s.lets | {c.name: c.x.query}, s.pending)
            df = self._table(s).withColumn(c.name, self.compiler(s)(c.x))
            return State(df, s.vars | {c.name: Bound("value")}, s.outer, s.lets, s.pending)
        if isinstance(c, ir.Unwind):
            df = self._table(s).select("*", F.explode(self.compiler(s)(c.x)).alias(c.name))
            return State(df, s.vars | {c.name: Bound("value")}, s.outer, s.lets, s.pending)
        if isinstance(c, ir.Recursive):
            self._recursive(c)
            return s
        if isinstance(c, ir.From):
            if c.name not in self._tables:
                raise KeyError(f"no table {c.name}")
            t = self._tables[c.name]
            rows = t.select(*[F.col(f"`{x}`").alias(f"{c.var}__{x}") for x in t.columns])
            return State(rows if s.df is None else s.df.crossJoin(rows), s.vars | {c.var: Bound("row")}, s.outer, s.lets, s.pending)
        if isinstance(c, ir.CallSub):
            sub = self._lower(c.query, s if s.df is not None else s.outer)
            correlated = s.df is not None and self._correlated(c.query, s)
            df = sub if s.df is None else s.df.lateralJoin(sub) if correlated else s.df.crossJoin(sub)
            return State(df, s.vars | {n: Bound("value") for n in self.shape(sub).columns}, s.outer, s.lets, s.pending)
        raise NotImplementedError(type(c).__name__)

    def _recursive(self, c: ir.Recursive) -> None:
        """Run a recursive table; its step looks at the rows of the round before only."""
        def step(frontier: DataFrame) -> DataFrame:
            self._tables[c.name] = frontier
            return self._lower(c.step, None)

        base = self._lower(c.base, None)
        walk = self._walk(c, base)
        self._tables[c.name] = walked(base, *walk) if walk else fixpoint(base, step, distinct=c.distinct)

    def _walk(self, c: ir.Recursive, base: DataFrame) -> tuple[DataFrame, str, DataFrame | None] | None:
        """The pairs that a recursive step follows, the column it follows them from, and halves of the pairs, if that is all it does.

        Such a step is one MATCH, of which one property equals that column, and returns another in
        its place; all other columns are returned as they are, and nothing else looks at the row before.
        """
        clauses = getattr(c.step, "clauses", ())
        if not c.distinct or tuple(map(type, clauses)) != (ir.From, ir.Match, ir.Return):
            return None
        row, match, back = clauses
        if row.name != c.name or match.optional or len(back.items) != len(base.columns) or any((back.distinct, back.group_by, back.grouping, back.qualify)):
            return None
        of_row = lambda x: isinstance(x, ir.Prop) and x.var == row.var
        names, tests, rest = dict(zip(base.columns, (i.x for i in back.items), strict=True)), [], None
        for x in conjuncts(match.where):
            if isinstance(x, ir.Bin) and x.op == "=" and of_row(x.left) != of_row(x.right):
                tests.append((x.left, x.right) if of_row(x.left) else (x.right, x.left))
            else:
                rest = x if rest is None else ir.Bin("and", rest, x)
        if len(names) != len(base.columns) or len(tests) != 1:
            return None
        (at, source), target = tests[0], names.get(tests[0][0].name)
        if not isinstance(source, ir.Prop) or not isinstance(target, ir.Prop) or of_row(target):
            return None
        pairs = ir.Single((replace(match, where=rest), ir.Return((ir.Item(source, "_src"), ir.Item(target, "_dst")))))
        carried = all(of_row(x) and x.name == n for n, x in names.items() if n != at.name)
        if not carried or any(getattr(x, "var", None) == row.var or getattr(x, "name", None) in (row.var, row.name) for x in ir.walk(pairs)):
            return None
        hops = self._lower(pairs, None)
        kind = dict(base.dtypes)[at.name]  # values have to be the same in all three places
        if kind not in ("int", "bigint", "string", "date") or {k for _, k in hops.dtypes} != {kind}:
            return None
        half = self._half(match.paths, rest, source, target)
        return hops, at.name, None if half is None else self._lower(half, None)

    @staticmethod
    def _half(paths: tuple, where, source: ir.Prop, target: ir.Prop) -> ir.Single | None:
        """_src and _mid of one half of a path of two relationships that is the same from both ends, or None.

        Nodes of different values are different nodes, so their relationships to the middle differ
        as well: trails and walks link the same values.
        """
        if len(paths) != 1 or paths[0].var is not None or len(paths[0].rels) != 2 or source.name != target.name:
            return None
        path = paths[0] if paths[0].nodes[0].var == source.var else ir.reversed_path(paths[0])
        (a, mid, b), (x, _), (y, _) = path.nodes, path.rels, ir.reversed_path(path).rels
        names = [v for v in (a.var, mid.var, b.var, x.var, y.var) if v]
        same = (a.labels, x.types, x.direction) == (b.labels, y.types, y.direction)
        if (a.var, b.var) != (source.var, target.var) or len(set(names)) != len(names) or not same or len(mid.labels) != 1:
            return None
        across = {b.var: a.var} | ({y.var: x.var} if x.var and y.var else {})
        kept, mirrored = [], []
        for test in conjuncts(where):
            used = {p.var for p in ir.find_all(test, ir.Prop)} | {v.name for v in ir.find_all(test, ir.Var)}
            if ir.find_all(test, (ir.Single, ir.SetOp, ir.NodePat)) or not (used <= {a.var, x.var, mid.var} or used <= {b.var, y.var, mid.var}):
                return None
            if used <= {a.var, x.var, mid.var}:
                kept.append(test)
            if used <= {b.var, y.var, mid.var}:
                mirrored.append(ir.transform(test, lambda z: replace(z, var=across.get(z.var, z.var)) if isinstance(z, ir.Prop) else replace(z, name=across.get(z.name, z.name)) if isinstance(z, ir.Var) else z))
        if any(t not in mirrored for t in kept) or any(t not in kept for t in mirrored):
            return None
        middle = replace(mid, var=mid.var or "_middle")
        match = ir.Match((ir.Path(None, (a, middle), (x,)),), reduce(lambda p, q: ir.Bin("and", p, q), kept) if kept else None)
        return ir.Single((match, ir.Return((ir.Item(source, "_src"), ir.Item(ir.Var(middle.var), "_mid")))))

    def _table(self, s: State) -> DataFrame:
        return self.spark.range(1).select() if s.df is None else s.df

    @staticmethod
    def _correlated(query, s: State) -> bool:
        inside = {n.var for n in ir.find_all(query, (ir.NodePat, ir.RelPat))}
        names = {p.var for p in ir.find_all(query, ir.Prop)} | {v.name for v in ir.find_all(query, ir.Var)} | inside
        return bool(names & set(s.vars))

    def _match(self, c: ir.Match, s: State) -> State:
        paths = named(ir.merge_paths(c.paths), self._fresh)
        # A variable of the query around is met anew under another name and held equal.
        held: dict[str, str] = {}
        around: dict[str, Bound] = {}
        o = s.outer
        while o is not None:
            around = o.vars | around
            o = o.outer
        for n in ir.find_all(paths, ir.NodePat):
            if n.var in around and n.var not in s.vars and around[n.var].kind == "node":
                held.setdefault(n.var, f"_x{next(self._fresh)}_{n.var}")
        if held:
            paths = ir.transform(paths, lambda x: ir.NodePat(held[x.var], x.labels) if isinstance(x, ir.NodePat) and x.var in held else x)
        known = {v: b.label for v, b in s.vars.items() if b.kind == "node" and b.label} | {new: around[old].label for old, new in held.items() if around[old].label}
        shared = [v for v in {n.var for n in ir.find_all(paths, ir.NodePat)} if v in s.vars]
        looked = self._looked - set(shared)
        df, labels = self.matcher.match(paths, {v: x for v, x in known.items() if v in {n.var for n in ir.find_all(paths, ir.NodePat)}}, looked)
        new: dict[str, Bound] = {}
        for p in paths:
            for n in p.nodes:
                if n.var not in s.vars:
                    new[n.var] = Bound("node", labels[n.var])
            for r in p.rels:
                new[r.var] = Bound("edge", types=tuple(self.graph.type(t) for t in r.types))
            if p.var:
                new[p.var] = Bound("path", hops=len(p.rels))
        vars_ = s.vars | new
        pending = [*s.pending, *[F.col(f"{met}___id") == F.col(f"{old}___id").outer() for old, met in held.items()]]
        # Shared variables join by id; their own columns stay as they are.
        other = df.select(*[F.col(x).alias(f"_m_{x}") if x.rpartition("___")[0] in shared or x.partition("__")[0] in shared else F.col(x) for x in df.columns])
        on = F.lit(True)
        for v in shared:
            on = on & (F.col(f"{v}___id") == F.col(f"_m_{v}___id"))
        drop = [x for x in other.columns if x.startswith("_m_")]
        if not c.optional:
            out = other if s.df is None else s.df.join(other, on).drop(*drop) if shared else s.df.crossJoin(other)
            state = State(out, vars_, s.outer, s.lets, pending)
            return state if c.where is None else self._where(c.where, state)
        base = self._table(s)
        if c.where is not None and ir.find_all(c.where, (ir.Exists, ir.In, ir.Scalar)):
            return State(self._optional_with_subquery(c.where, base, other, on, shared, vars_, s), vars_, s.outer, s.lets, pending)
        if c.where is not None:
            both = State(base.join(other, on) if shared else base.crossJoin(other), vars_, s.outer, s.lets)
            on = on & self.compiler(both).boolean(c.where)
        return State(base.join(other, on, "left").drop(*drop), vars_, s.outer, s.lets, pending)

    def _optional_with_subquery(self, where, base: DataFrame, other: DataFrame, on: Column, shared: list[str], vars_: dict[str, Bound], s: State) -> DataFrame:
        """``base`` with the rows of ``other`` for which ``where`` holds, or nulls.

        Subqueries cannot stand in a join condition. Where they only look at the pattern they
        filter its rows; else what the condition knows of ``base`` is joined, each combination
        once, filtered, and met by ``base`` again.
        """
        drop = [x for x in other.columns if x.startswith("_m_")]
        names = {p.var for p in ir.find_all(where, ir.Prop)} | {v.name for v in ir.find_all(where, ir.Var)} | {n.var for n in ir.find_all(where, (ir.NodePat, ir.RelPat))}
        used = names & set(s.vars)
        if not used:
            inner = State(other, {v: b for v, b in vars_.items() if v not in s.vars}, s.outer, s.lets)
            return base.join(other.where(self.compiler(inner).boolean(where)), on, "left").drop(*drop)
        keys = [x for x in base.columns if x.partition("__")[0] in used | set(shared)]
        pairs = base.select(*[f"`{x}`" for x in keys]).distinct()
        pairs = (pairs.join(other, on) if shared else pairs.crossJoin(other)).drop(*drop)
        inner = State(pairs, {v: b for v, b in vars_.items() if v in used or v in shared or v not in s.vars}, s.outer, s.lets)
        pairs = pairs.where(self.compiler(inner).boolean(where))
        met = pairs.select(*[F.col(f"`{x}`").alias(f"_k{i}") for i, x in enumerate(keys)], *[f"`{x}`" for x in pairs.columns if x not in keys])
        again = F.lit(True)
        for i, x in enumerate(keys):
            again = again & F.col(f"`{x}`").eqNullSafe(F.col(f"_k{i}"))
        return base.join(met, again, "left").drop(*[f"_k{i}" for i in range(len(keys))])

    # -- projection
    def _name(self, i: ir.Item, k: int) -> str:
        if i.alias:
            return i.alias
        if isinstance(i.x, ir.Var):
            return i.x.name
        if isinstance(i.x, ir.Prop):
            return f"{i.x.var}.{i.x.name}"
        return f"col{k}"

    def element(self, name: str, s: State) -> Column:
        """A whole element as a value: a struct of its id and properties."""
        b = s.vars[name]
        if b.kind in ("value", "path"):
            return Scope(self, s).var(name)
        ids = ["id"] if b.kind == "node" else ["eid", "src", "dst"]
        own = [x for x in s.plain.columns if x.startswith(f"{name}__") and not x.startswith(f"{name}___")]
        return F.when(
            F.col(f"{name}___{ids[0]}").isNotNull(),
            F.struct(*[F.col(f"{name}___{i}").alias(f"_{i}") for i in ids], *[F.col(x).alias(x[len(name) + 2 :]) for x in own]),
        )

    def _columns(self, items: tuple[ir.Item, ...], s: State) -> tuple[ir.Item, ...]:
        out = []
        for i in items:
            if isinstance(i.x, ir.Star):
                out += [ir.Item(ir.Var(v), v) for v in s.vars if not v.startswith("_")]
            else:
                out.append(i)
        return tuple(out)

    def _aggregated(self, items: tuple[ir.Item, ...], by: tuple | None, extra: tuple, s: State, grouping=None) -> tuple[State, dict]:
        """Groups: the state after it and, for each grouped or aggregated expression, its variable."""
        s = self._settled(s)
        rows = tuple(ir.Var(d) for d in (*s.keys, *[v for v in s.held if v in s.vars]))
        keys = tuple(by) if by else tuple(i.x for i in items if not has_aggregate(i.x) and i.x not in rows)
        alone, keys = bool(rows) and not keys, (*keys, *rows)
        if rows and grouping is not None:
            raise NotImplementedError("grouping sets in a correlated subquery")
        aliases = {i.alias: i.x for i in items if i.alias}
        keys = tuple(aliases.get(x.name, x) if isinstance(x, ir.Var) and x.name not in s.vars else x for x in keys)
        calls: list = []
        for x in [i.x for i in items] + list(extra):
            calls += [y for y in ir.walk(x) if is_aggregate(y) and y not in calls]
        k = self.compiler(s)
        grouped, named_by, vars_ = [], {}, {}
        for n, x in enumerate(keys):
            if isinstance(x, ir.Var) and s.vars.get(x.name, Bound("value")).kind in ("node", "edge"):
                grouped += [F.col(f"`{c}`") for c in s.plain.columns if c.startswith(f"{x.name}__")]
                vars_[x.name] = s.vars[x.name]
            else:
                grouped.append(k(x).alias(f"_g{n}"))
                named_by[x] = ir.Var(f"_g{n}")
                vars_[f"_g{n}"] = Bound("value")
        for n, x in enumerate(calls):
            named_by[x] = ir.Var(f"_a{n}")
            vars_[f"_a{n}"] = Bound("value")
        # Without an aggregate, grouping is taking distinct keys.
        aggs = [k(x).alias(f"_a{n}") for n, x in enumerate(calls)] or [F.count(F.lit(1)).alias("_a")]

        def groups(df: DataFrame) -> DataFrame:
            if grouping is None:
                return df.groupBy(*grouped).agg(*aggs) if grouped else df.select(*aggs)
            if isinstance(grouping, str):
                return getattr(df, grouping)(*grouped).agg(*aggs)
            # Grouping sets name columns, so keys become columns first.
            own = [f"_g{n}" for n in range(len(keys))]
            return df.select("*", *grouped).groupingSets([[own[k] for k in x] for x in grouping], *own).agg(*aggs)

        if s.shape is not None and grouped:
            raise NotImplementedError("groups in a correlated subquery")
        out = groups(s.df)
        if alone:  # an aggregate of no rows has a value too
            at = {d: f"_g{n}" for n, d in enumerate(s.keys)}
            on = F.lit(True)
            for d, g in at.items():
                on = on & F.col(d).eqNullSafe(F.col(g))
            out = s.domain.join(out, on, "left").withColumns({g: F.col(d) for d, g in at.items()} | {c: F.col(d) for c, d in s.around.items() if c in out.columns}).drop(*s.keys)
            none = {"count": F.lit(0), "collect": F.array(), "collect_list": F.array()} | ({"sum": F.lit(0)} if self.mode == "cypher" else {})
            out = out.withColumns({f"_a{n}": F.coalesce(f"_a{n}", none[x.name].cast(out.schema[f"_a{n}"].dataType)) for n, x in enumerate(calls) if x.name in none})
        return State(out, vars_, s.outer, s.lets, [], None if s.shape is None else groups(s.shape), s.around, s.domain), named_by

    @staticmethod
    def _with_rows_around(items: tuple[ir.Item, ...], s: State, elements: bool = False) -> tuple[ir.Item, ...]:
        """``items`` and the keys of the rows around, which part windows as well, and ``elements`` of them."""
        if not s.keys:
            return items
        rows = tuple(ir.Var(d) for d in (*s.keys, *[v for v in s.held if elements and v in s.vars]))
        keys = tuple(ir.Var(d) for d in s.keys)
        parted = lambda y: ir.Windowed(y.call, (*keys, *y.partition), y.order) if isinstance(y, ir.Windowed) else y
        return (*ir.transform(items, parted), *[ir.Item(r, r.name) for r in rows if all(i.x != r for i in items)])

    def _windows_of_all(self, xs: tuple, s: State) -> tuple[State, dict]:
        """Windows without PARTITION BY, computed beforehand: their columns in the state, and
        for each such expression its variable.

        Rows that a correlated subquery looks up are no table of their own yet; there the
        window stays what Spark makes of it.
        """
        found = list(dict.fromkeys(w for x in xs for w in ir.find_all(x, ir.Windowed) if not w.partition and w.call.name in (*BY_ROW, *BY_TIE, *RUNNING) and not w.call.distinct))
        s = self._settled(s)
        if not found or s.shape is not None or s.df is None or s.outer is not None:
            return s, {}
        k, names, df, vars_ = self.compiler(s), {}, s.df, dict(s.vars)
        for order in dict.fromkeys(w.order for w in found):
            calls = {}
            for w in (w for w in found if w.order == order):
                name = f"_w{next(self._fresh)}"
                names[w], vars_[name] = ir.Var(name), Bound("value")
                star = not w.call.args or isinstance(w.call.args[0], ir.Star)
                value = None if star else k(w.call.args[0])
                if w.call.name == "sum" and not star and k.kind(w.call.args[0]) == "bool":
                    value = value.cast("long")
                step = w.call.args[1].value if w.call.name in ("lag", "lead") and len(w.call.args) > 1 else 1
                calls[name] = Over(w.call.name, value, step)
            df = over_all(df, [k.sort_key(x) for x in order], calls)
        return State(df, vars_, s.outer, s.lets), names

    @staticmethod
    def _replaced(x, names: dict):
        # Outermost first: an aggregate of a grouping key is an aggregate.
        return ir.replaced(x, names)

    def _project(self, items: tuple[ir.Item, ...], distinct: bool, by: tuple | None, keys: list[ir.Key], s: State, grouping=None) -> tuple[DataFrame, list[Column]]:
        """Projected rows, with hidden columns for sort keys, and the sort order."""
        items = self._with_rows_around(self._columns(items, s), s)
        names = [self._name(i, k) for k, i in enumerate(items)]
        s, lifted = self._lifted((*[i.x for i in items], *[k.x for k in keys]), s)
        items = tuple(ir.Item(self._replaced(i.x, lifted), n) for i, n in zip(items, names, strict=True))
        order_x = [self._replaced(k.x, lifted) for k in keys]
        if by or any(has_aggregate(i.x) for i in items) or any(map(has_aggregate, order_x)):
            s, named_by = self._aggregated(items, by, tuple(order_x), s, grouping)
            whole = items
            items = tuple(ir.Item(self._replaced(i.x, named_by), n) for i, n in zip(items, names, strict=True))
            order_x = [x if isinstance(x, ir.Var) and x.name in names else next((ir.Var(n) for i, n in zip(whole, names, strict=True) if i.x == x), self._replaced(x, named_by)) for x in order_x]
        else:
            order_x = [next((ir.Var(n) for i, n in zip(items, names, strict=True) if i.x == x and n not in s.vars), x) for x in order_x]
        s, windows = self._windows_of_all((*[i.x for i in items], *order_x), s)
        if windows:
            items = tuple(ir.Item(self._replaced(i.x, windows), i.alias) for i in items)
            order_x = [self._replaced(x, windows) for x in order_x]
        k = self.compiler(s)
        cols = [(self.element(i.x.name, s) if isinstance(i.x, ir.Var) and i.x.name in s.vars else k(i.x)).alias(n) for i, n in zip(items, names, strict=True)]
        hidden, order = [], []
        for n, (x, key) in enumerate(zip(order_x, keys, strict=True)):
            if isinstance(x, ir.Var) and x.name in names:
                order.append(ordered(F.col(f"`{x.name}`"), key))
            elif distinct:
                raise ValueError("after DISTINCT, rows are ordered by returned columns only")
            else:
                # A key may use the names of returned columns too.
                given = dict(zip(names, (i.x for i in items), strict=True))
                x = ir.transform(x, lambda y, given=given: given.get(y.name, y) if isinstance(y, ir.Var) and y.name not in s.vars else y)
                hidden.append(k(x).alias(f"_s{n}"))
                order.append(ordered(F.col(f"_s{n}"), key))
        s = self._settled(s)
        made = lambda df: df.select(*cols, *hidden).distinct() if distinct else df.select(*cols, *hidden)
        out = made(self._table(s))
        if s.shape is not None:
            self._shapes[id(out)] = (out, made(s.shape))
        return out, order

    def _return(self, c: ir.Return, tail: list, s: State) -> DataFrame:
        keys = [k for t in tail if isinstance(t, ir.OrderBy) for k in t.keys]
        items = c.items
        if c.qualify is not None:  # returned names stand for what they return
            given = {i.alias: i.x for i in items if i.alias and i.alias not in s.vars}
            items = (*items, ir.Item(ir.transform(c.qualify, lambda y: given.get(y.name, y) if isinstance(y, ir.Var) else y), "_qualify"))
        df, order = self._project(items, c.distinct, c.group_by, keys, s, c.grouping)
        plain, correlated = self.shape(df), id(df) in self._shapes
        if c.qualify is not None:
            df, plain = df.where("_qualify").drop("_qualify"), plain.drop("_qualify")
        if s.keys and any(isinstance(t, (ir.Skip, ir.Limit)) for t in tail):
            # A limit counts the rows of each row around.
            after = sum(t.n for t in tail if isinstance(t, ir.Skip))
            most = min((t.n for t in tail if isinstance(t, ir.Limit)), default=None)
            df = df.withColumn("_s0_place", F.row_number().over(Window.partitionBy(*s.keys).orderBy(*(order or [F.lit(1)]))))
            df = df.where((F.col("_s0_place") > after) & (F.lit(True) if most is None else F.col("_s0_place") <= after + most)).drop("_s0_place")
            order, tail = [], []
        if order:
            df = df.orderBy(*order)
        for t in tail:
            if isinstance(t, ir.Skip):
                df = df.offset(t.n)
            elif isinstance(t, ir.Limit):
                df = df.limit(t.n)
        hidden = [c for c in plain.columns if c.startswith("_s") and c[2:].isdigit()]
        if hidden:
            df, plain = df.drop(*hidden), plain.drop(*hidden)
        if correlated:
            self._shapes[id(df)] = (df, plain)
        return df

    def _with(self, c: ir.With, s: State) -> State:
        items = c.items
        if any(isinstance(i.x, ir.Star) for i in items):
            items = (*[ir.Item(ir.Var(v), v) for v in s.vars], *[i for i in items if not isinstance(i.x, ir.Star)])
        names = [self._name(i, k) for k, i in enumerate(items)]
        s, lifted = self._lifted(tuple(i.x for i in items), self._settled(s))
        items = self._with_rows_around(tuple(ir.Item(self._replaced(i.x, lifted), n) for i, n in zip(items, names, strict=True)), s, elements=True)
        source = s
        if any(has_aggregate(i.x) for i in items):
            source, named_by = self._aggregated(items, None, (), s)
            items = tuple(ir.Item(self._replaced(i.x, named_by), self._name(i, k)) for k, i in enumerate(items))
        source, windows = self._windows_of_all(tuple(i.x for i in items), source)
        if windows:
            items = tuple(ir.Item(self._replaced(i.x, windows), self._name(i, k)) for k, i in enumerate(items))
        k, cols, vars_ = self.compiler(source), [], {}
        for n, i in enumerate(items):
            name = self._name(i, n)
            if isinstance(i.x, ir.Var) and i.x.name in source.vars and source.vars[i.x.name].kind != "value":
                old = i.x.name
                vars_[name] = source.vars[old]
                if source.vars[old].kind != "path":
                    cols += [F.col(f"`{x}`").alias(name + x[len(old) :]) for x in source.plain.columns if x.startswith(f"{old}__")]
            else:
                cols.append(k(i.x).alias(name))
                vars_[name] = Bound("value")
        made = lambda df: df.select(*cols).distinct() if c.distinct else df.select(*cols)
        state = State(made(self._table(source)), vars_, s.outer, s.lets, [], None if source.shape is None else made(source.shape))
        return state if c.where is None else self._where(c.where, state)
