"""Queries built by calls: SELECT-shaped queries over tables and joins that become graph patterns.

    q = (
        select(col("n.n_name").as_("nation"), func("count", star()).as_("k"))
        .from_(table("Customer", "c"))
        .join(table("Nation", "n"), on=col("c.c_nationkey") == col("n.n_nationkey"))
        .where(col("c.c_acctbal") > 0).group_by(col("n.n_name")).having(func("count", star()) > 10)
        .order_by(col("k").desc()).limit(5)
    )
    q.frame(Engine(spark, graph), edges)

Builders are values: every call gives a new one. Expressions wrap IR, so operators and
methods build IR; joins are lowered by ``rel2graph``; what has no place in query text (sort
within partitions, hints, sampling, writing a table) works on the resulting DataFrame.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.expressions import has_aggregate
from quillgraph.operators import relational
from quillgraph.plans import ir
from quillgraph.plans.engine import Engine
from quillgraph.plans.rel2graph import Edge, Join, Table, query

# -- expressions


def node(x: Any) -> Any:
    """A value as IR: expressions unwrap, queries become subqueries, lists and plain values literals."""
    if isinstance(x, Expr):
        return x.x
    if isinstance(x, (Select, Combined)):
        return ir.Scalar(x)
    if isinstance(x, (list, tuple)):
        return ir.ListOf(tuple(map(node, x)))
    if isinstance(x, (datetime.date, datetime.datetime)):
        return ir.Call("localdatetime", (ir.Lit(x.isoformat()),))
    return ir.Lit(x)


@dataclass(frozen=True, eq=False)
class Expr:
    """An expression; comparisons and arithmetic give expressions."""

    x: Any
    alias: str | None = None

    def _bin(self, op: str, other: Any, swap: bool = False) -> Expr:
        a, b = self.x, node(other)
        return Expr(ir.Bin(op, b, a) if swap else ir.Bin(op, a, b))

    def __eq__(self, o):
        return self._bin("=", o)

    def __ne__(self, o):
        return self._bin("<>", o)

    def __lt__(self, o):
        return self._bin("<", o)

    def __le__(self, o):
        return self._bin("<=", o)

    def __gt__(self, o):
        return self._bin(">", o)

    def __ge__(self, o):
        return self._bin(">=", o)

    def __add__(self, o):
        return self._bin("+", o)

    def __radd__(self, o):
        return self._bin("+", o, True)

    def __sub__(self, o):
        return self._bin("-", o)

    def __rsub__(self, o):
        return self._bin("-", o, True)

    def __mul__(self, o):
        return self._bin("*", o)

    def __rmul__(self, o):
        return self._bin("*", o, True)

    def __truediv__(self, o):
        return self._bin("/", o)

    def __rtruediv__(self, o):
        return self._bin("/", o, True)

    def __floordiv__(self, o):
        return func("div", self, o)

    def __mod__(self, o):
        return self._bin("%", o)

    def __pow__(self, o):
        return self._bin("^", o)

    def __and__(self, o):
        return self._bin("and", o)

    def __or__(self, o):
        return self._bin("or", o)

    def __xor__(self, o):
        return self._bin("xor", o)

    def __invert__(self):
        return Expr(ir.Un("not", self.x))

    def __neg__(self):
        return Expr(ir.Un("-", self.x))

    def __getitem__(self, i):
        return func("element_at", self, i + 1 if isinstance(i, int) and i >= 0 else i)

    __hash__ = object.__hash__

    def __bool__(self):
        raise TypeError("an expression is neither true nor false: use & | ~")

    def isin(self, *items: Any) -> Expr:
        if len(items) == 1 and isinstance(items[0], (Select, Combined)):
            return Expr(ir.In(self.x, items[0]))
        flat = items[0] if len(items) == 1 and isinstance(items[0], (list, tuple, set)) else items
        return Expr(ir.In(self.x, tuple(map(node, flat))))

    def between(self, low: Any, high: Any) -> Expr:
        return Expr(ir.Between(self.x, node(low), node(high)))

    def is_(self, other: Any) -> Expr:
        return Expr(ir.IsNull(self.x)) if other is None else self._bin("=", other)

    def is_null(self) -> Expr:
        return Expr(ir.IsNull(self.x))

    def is_not_null(self) -> Expr:
        return Expr(ir.IsNull(self.x, True))

    def like(self, pattern: Any) -> Expr:
        return Expr(ir.Call("like", (self.x, node(pattern))))

    def ilike(self, pattern: Any) -> Expr:
        return Expr(ir.Call("like", (ir.Call("lower", (self.x,)), ir.Call("lower", (node(pattern),)))))

    def rlike(self, pattern: str) -> Expr:
        return self._bin("=~", pattern)

    def contains(self, part: Any) -> Expr:
        return self._bin("contains", part)

    def eq(self, o: Any) -> Expr:
        return self == o

    def neq(self, o: Any) -> Expr:
        return self != o

    def div(self, o: Any) -> Expr:
        return self / o

    def asc(self, nulls_first: bool | None = None) -> ir.Key:
        return ir.Key(self.x, True, nulls_first)

    def desc(self, nulls_first: bool | None = None) -> ir.Key:
        return ir.Key(self.x, False, nulls_first)

    def as_(self, name: str) -> Expr:
        return Expr(self.x, name)

    def over(self, partition_by: Iterable[Expr] = (), order_by: Iterable = ()) -> Expr:
        return Expr(ir.Windowed(self.x, tuple(map(node, partition_by)), tuple(map(_key, order_by))))


def _key(x: Any) -> ir.Key:
    return x if isinstance(x, ir.Key) else ir.Key(node(x if isinstance(x, Expr) else col(x)))


def col(name: str) -> Expr:
    """A column: 'alias.name', or a returned name."""
    var, dot, prop = name.partition(".")
    return Expr(ir.Prop(var, prop) if dot else ir.Var(var))


def column(name: str, of: str | None = None) -> Expr:
    return Expr(ir.Prop(of, name) if of else ir.Var(name))


def var(name: str) -> Expr:
    return Expr(ir.Var(name))


def param(name: str) -> Expr:
    return Expr(ir.Param(name))


def identifier(name: str) -> str:
    """A name as query text writes it."""
    return name if name.isidentifier() else "`" + name.replace("`", "``") + "`"


def table(name: str, alias: str | None = None) -> Table:
    return Table(name, alias or name.lower())


def alias(x: Expr | Table, name: str) -> Expr | Table:
    return Table(x.name, name) if isinstance(x, Table) else x.as_(name)


def lit(v: Any) -> Expr:
    return Expr(node(v))


def null() -> Expr:
    return Expr(ir.Lit(None))


def true() -> Expr:
    return Expr(ir.Lit(True))


def false() -> Expr:
    return Expr(ir.Lit(False))


def star() -> Expr:
    return Expr(ir.Star())


def array(*items: Any) -> Expr:
    return Expr(ir.ListOf(tuple(map(node, items))))


tuple_ = array


def func(name: str, *args: Any, distinct: bool = False) -> Expr:
    return Expr(ir.Call(name.lower(), tuple(map(node, args)), distinct))


def cast(x: Any, to: str) -> Expr:
    from quillgraph.plans.parser import CASTS

    return Expr(ir.Cast(node(x), CASTS.get(to.lower(), to.lower())))


def and_(*xs: Any) -> Expr:
    return _folded("and", xs)


def or_(*xs: Any) -> Expr:
    return _folded("or", xs)


def xor(a: Any, b: Any) -> Expr:
    return Expr(ir.Bin("xor", node(a), node(b)))


def not_(x: Any) -> Expr:
    return Expr(ir.Un("not", node(x)))


def condition(x: Any) -> Expr:
    return x if isinstance(x, Expr) else lit(x)


def paren(x: Any) -> Expr:
    """IR is a tree, so parentheses are only for the reader."""
    return condition(x)


def _folded(op: str, xs: Iterable[Any]) -> Expr:
    out = None
    for x in xs:
        if x is not None:
            out = node(x) if out is None else ir.Bin(op, out, node(x))
    if out is None:
        raise ValueError(f"{op} of nothing")
    return Expr(out)


def exists(q: Select | Combined) -> Expr:
    return Expr(ir.Exists(q))


@dataclass(frozen=True, eq=False)
class Case(Expr):
    """``case().when(a, b).else_(c)``, or ``case(x).when(1, b)``."""

    def when(self, test: Any, then: Any) -> Case:
        return Case(replace(self.x, whens=(*self.x.whens, (node(test), node(then)))))

    def else_(self, value: Any) -> Expr:
        return Expr(replace(self.x, default=node(value)))


def case(base: Any = None) -> Case:
    return Case(ir.Case(None if base is None else node(base), ()))


# -- queries


@dataclass(frozen=True)
class _Query:
    """What selects and combined queries share: order, limits, combination, and what is done with the frame."""

    keys: tuple[ir.Key, ...] = ()
    skip: int | None = None
    most: int | None = None
    after: tuple[Callable[[DataFrame], DataFrame], ...] = ()

    def order_by(self, *keys: Any) -> Any:
        return replace(self, keys=self.keys + tuple(map(_key, keys)))

    def limit(self, n: int) -> Any:
        return replace(self, most=n)

    def offset(self, n: int) -> Any:
        return replace(self, skip=n)

    def union(self, *others: Any, distinct: bool = True, by_name: bool = False) -> Combined:
        return _combined("union", self, others, distinct, by_name)

    def intersect(self, *others: Any, distinct: bool = True) -> Combined:
        return _combined("intersect", self, others, distinct)

    def except_(self, *others: Any, distinct: bool = True) -> Combined:
        return _combined("except", self, others, distinct)

    def subquery(self, name: str) -> Derived:
        """This query as a table in FROM or JOIN."""
        return Derived(self, name)

    def then(self, step: Callable[[DataFrame], DataFrame]) -> Any:
        """``step`` on the resulting frame."""
        return replace(self, after=(*self.after, step))

    def sort_by(self, *keys: Column | str) -> Any:
        return self.then(lambda df: relational.sort_by(df, *keys))

    def cluster_by(self, *keys: Column | str) -> Any:
        return self.then(lambda df: relational.cluster_by(df, *keys))

    def distribute_by(self, *keys: Column | str) -> Any:
        return self.then(lambda df: relational.distribute_by(df, *keys))

    def hint(self, name: str, *args: Any) -> Any:
        return self.then(lambda df: df.hint(name, *args))

    def sample(self, fraction: float, columns: list[str], seed: int = 0) -> Any:
        return self.then(lambda df: relational.sampled(df, fraction, columns, seed))

    def ctas(self, name: str, temporary: bool = True) -> Callable[[Engine, list[Edge]], DataFrame]:
        """A function that makes a table (or a temporary view) of the result."""

        def make(engine: Engine, edges: list[Edge] = ()) -> DataFrame:
            df = self.frame(engine, edges)
            if temporary:
                df.createOrReplaceTempView(name)
            else:
                df.write.mode("overwrite").saveAsTable(name)
            return engine.spark.table(name)

        return make

    def lock(self, update: bool = True) -> Any:
        """Frames are snapshots; a lock has nothing to hold."""
        return self

    def _tail(self) -> tuple:
        tail = (ir.OrderBy(self.keys),) if self.keys else ()
        tail += (ir.Skip(self.skip),) if self.skip is not None else ()
        return tail + ((ir.Limit(self.most),) if self.most is not None else ())

    def lower(self, edges: Iterable[Edge] = (), join_tables: set[str] = frozenset()) -> Any:
        raise NotImplementedError

    def frame(self, engine: Engine, edges: Iterable[Edge] = (), params: dict | None = None, join_tables: set[str] = frozenset()) -> DataFrame:
        """The result as a DataFrame."""
        df = engine.run(self.lower(list(edges), join_tables), params)
        for step in self.after:
            df = step(df)
        return df

    def sql(self, edges: Iterable[Edge] = (), dialect: str = "cypher") -> str:
        """The query as graph text."""
        from quillgraph.plans.render import render

        return render(self.lower(list(edges)), dialect)


@dataclass(frozen=True)
class Derived:
    query: Any
    alias: str


@dataclass(frozen=True)
class Combined(_Query):
    op: str = "union"
    left: Any = None
    right: Any = None
    all_: bool = False
    by_name: bool = False

    def lower(self, edges: Iterable[Edge] = (), join_tables: set[str] = frozenset()) -> Any:
        out = ir.SetOp(self.op, not self.all_, self.left.lower(edges, join_tables), self.right.lower(edges, join_tables), self.by_name)
        tail = self._tail()
        return ir.Single((ir.CallSub(out), *tail, ir.Return((ir.Item(ir.Star()),)))) if tail else out


def _combined(op: str, first: Any, others: Iterable[Any], distinct: bool, by_name: bool = False) -> Combined:
    out = first
    for o in others:
        out = Combined(op=op, left=out, right=o, all_=not distinct, by_name=by_name)
    return out


def union(*queries: Any, distinct: bool = True) -> Combined:
    return queries[0].union(*queries[1:], distinct=distinct)


def intersect(*queries: Any, distinct: bool = True) -> Combined:
    return queries[0].intersect(*queries[1:], distinct=distinct)


def except_(*queries: Any, distinct: bool = True) -> Combined:
    return queries[0].except_(*queries[1:], distinct=distinct)


@dataclass(frozen=True)
class Select(_Query):
    items: tuple[Expr, ...] = ()
    first: Any = None
    joins: tuple[Join, ...] = ()
    derived: tuple[Derived, ...] = ()
    laterals: tuple[tuple[Any, str], ...] = ()
    test: Any = None
    groups: tuple[Any, ...] | None = None
    grouping: Any = None
    having_: Any = None
    qualify_: Any = None
    distinct_: bool = False
    ctes: tuple[tuple[str, Any], ...] = ()
    windows: tuple[tuple[str, tuple, tuple], ...] = ()

    def select(self, *items: Any, append: bool = True) -> Select:
        own = tuple(i if isinstance(i, Expr) else col(i) for i in items)
        return replace(self, items=self.items + own if append else own)

    def from_(self, t: Table | Derived) -> Select:
        return replace(self, derived=(*self.derived, t)) if isinstance(t, Derived) else replace(self, first=t)

    def join(self, t: Table | Derived, on: Any = None, side: str = "inner", using: Iterable[str] = (), hint: str | None = None) -> Select:
        if isinstance(t, Derived) or any(t.name == n for n, _ in self.ctes):
            if side not in ("inner", "cross") or using:
                raise ValueError("a derived table is joined inner, by ON")
            name = t.alias
            out = replace(self, derived=(*self.derived, t if isinstance(t, Derived) else Derived(dict(self.ctes)[t.name], name)))
            return out if on is None else out.where(on)
        return replace(self, joins=(*self.joins, Join(t, None if on is None else node(on), side, tuple(using), hint)))

    def lateral(self, q: Select | Combined, name: str) -> Select:
        """A derived table that may look at the tables before it."""
        return replace(self, laterals=(*self.laterals, (q, name)))

    def unnest(self, x: Any, name: str) -> Select:
        """A row for each element of a list."""
        return replace(self, laterals=(*self.laterals, (node(x), name)))

    def where(self, *tests: Any) -> Select:
        own = and_(*([Expr(self.test)] if self.test is not None else []), *tests)
        return replace(self, test=own.x)

    def group_by(self, *keys: Any) -> Select:
        return replace(self, groups=(self.groups or ()) + tuple(node(k if isinstance(k, Expr) else col(k)) for k in keys))

    def cube(self, *keys: Any) -> Select:
        return replace(self.group_by(*keys), grouping="cube")

    def rollup(self, *keys: Any) -> Select:
        return replace(self.group_by(*keys), grouping="rollup")

    def grouping_sets(self, *sets: Iterable[Any]) -> Select:
        own = [tuple(node(k if isinstance(k, Expr) else col(k)) for k in s) for s in sets]
        keys = tuple(dict.fromkeys(k for s in own for k in s))
        return replace(self, groups=keys, grouping=tuple(tuple(keys.index(k) for k in s) for s in own))

    def having(self, *tests: Any) -> Select:
        return replace(self, having_=and_(*([Expr(self.having_)] if self.having_ is not None else []), *tests).x)

    def window(self, name: str, partition_by: Iterable[Expr] = (), order_by: Iterable = ()) -> Select:
        """A named window, for ``over(name)``."""
        return replace(self, windows=(*self.windows, (name, tuple(map(node, partition_by)), tuple(map(_key, order_by)))))

    def qualify(self, *tests: Any) -> Select:
        return replace(self, qualify_=and_(*([Expr(self.qualify_)] if self.qualify_ is not None else []), *tests).x)

    def distinct(self, *on: str, order: Iterable[Column] = ()) -> Select:
        """Distinct rows, or with ``on`` the first row of each key by ``order``."""
        if on:
            return self.then(lambda df: relational.distinct_on(df, list(on), list(order) or [F.col(c) for c in df.columns]))
        return replace(self, distinct_=True)

    def with_(self, name: str, q: Select | Combined) -> Select:
        return replace(self, ctes=(*self.ctes, (name, q)))

    # -- lowering
    def lower(self, edges: Iterable[Edge] = (), join_tables: set[str] = frozenset()) -> Any:
        edges = list(edges)
        ctes = dict(self.ctes)
        first, derived = self.first, list(self.derived)
        if isinstance(first, Table) and first.name in ctes:
            derived.insert(0, Derived(ctes[first.name], first.alias))
            first = None
        given, asked = self.joins, self.test
        if first is None and given:  # FROM a derived table: a joined table begins the pattern
            begin, *rest = given
            if begin.side not in ("inner", "cross") or begin.using:
                raise ValueError("the first table after a derived one is joined inner, by ON")
            first, given = begin.table, tuple(rest)
            if begin.on is not None:
                asked = begin.on if asked is None else ir.Bin("and", begin.on, asked)
        inner = lambda q: q.lower(edges, join_tables) if isinstance(q, _Query) else q
        names = {d.alias for d in derived} | {n for _, n in self.laterals}

        def resolved(x: Any) -> Any:
            """Columns of derived tables are variables of their own, named windows their frames."""
            frames = {n: (p, o) for n, p, o in self.windows}

            def one(y: Any) -> Any:
                if isinstance(y, ir.Prop) and y.var in names:
                    return ir.Var(f"{y.var}__{y.name}")
                return ir.Windowed(y.call, *frames[y.name]) if isinstance(y, ir.Over) and y.name in frames else y

            def open_(y: Any) -> Any:
                if isinstance(y, (ir.Exists, ir.Scalar)) and isinstance(y.query, _Query):
                    return type(y)(inner(y.query))
                return ir.In(y.x, inner(y.items)) if isinstance(y, ir.In) and isinstance(y.items, _Query) else y

            return ir.transform(_opened(x, open_), one)

        items = []
        for i in self.items or (star(),):
            name = i.alias or (i.x.name if isinstance(i.x, (ir.Var, ir.Prop)) else None)
            items.append(ir.Item(resolved(i.x), name))
        items = tuple(items)
        test = None if asked is None else resolved(asked)
        joins = [replace(j, on=None if j.on is None else resolved(j.on)) for j in given]
        clauses: tuple = ()
        whole = None
        if first is not None:
            whole = query(first, joins, edges, items, join_tables, None)
        if isinstance(whole, ir.SetOp):
            if derived or self.laterals or self.groups or self.having_ is not None or self.qualify_ is not None:
                raise ValueError("a full join with more than WHERE: make it a subquery")
            whole = query(first, joins, edges, items, join_tables, test)
            if self.distinct_ or self._tail():
                return ir.Single((ir.CallSub(whole), *self._tail(), ir.Return((ir.Item(ir.Star()),), self.distinct_)))
            return whole
        if whole is not None:
            clauses = whole.clauses[:-1]
        calls = tuple(ir.CallSub(_renamed(inner(d.query), d.alias)) for d in derived)
        clauses = calls + clauses if first is not None else calls
        for q, name in self.laterals:
            clauses += (ir.Unwind(resolved(q), f"{name}__value") if not isinstance(q, _Query) else ir.CallSub(_renamed(inner(q), name)),)
        if test is not None:
            clauses += (ir.Filter(test),)
        groups = None if self.groups is None else tuple(map(resolved, self.groups))
        qualify = None if self.qualify_ is None else resolved(self.qualify_)
        if self.having_ is None:
            tail = self._resolved_tail(resolved)
            return ir.Single((*clauses, ir.Return(items, self.distinct_, groups, self.grouping, qualify), *tail))
        # HAVING: aggregates that are not returned become hidden columns of the groups.
        having, hidden = resolved(self.having_), []
        given = {i.x: ir.Var(i.alias) for i in items}
        for y in ir.walk(having):
            if has_aggregate(y) and isinstance(y, ir.Call) and y not in given:
                given[y] = ir.Var(f"_h{len(hidden)}")
                hidden.append(ir.Item(y, given[y].name))
        having = ir.replaced(having, given)
        back = tuple(ir.Item(ir.Var(i.alias), i.alias) for i in items)
        tail = tuple(ir.OrderBy(tuple(ir.Key(ir.replaced(k.x, given), k.ascending, k.nulls_first) for k in t.keys)) if isinstance(t, ir.OrderBy) else t for t in self._resolved_tail(resolved))
        return ir.Single((*clauses, ir.Return((*items, *hidden), False, groups, self.grouping), ir.Filter(having), ir.Return(back, self.distinct_, None, None, qualify), *tail))

    def _resolved_tail(self, resolved: Callable[[Any], Any]) -> tuple:
        return tuple(ir.OrderBy(tuple(ir.Key(resolved(k.x), k.ascending, k.nulls_first) for k in t.keys)) if isinstance(t, ir.OrderBy) else t for t in self._tail())


def _opened(x: Any, f: Callable[[Any], Any]) -> Any:
    """``x`` with builders inside subqueries lowered; a builder itself is no IR to walk into."""
    if isinstance(x, _Query):
        return x
    if isinstance(x, (ir.Exists, ir.Scalar, ir.In)):
        x = f(x)
        return replace(x, x=_opened(x.x, f)) if isinstance(x, ir.In) else x
    if isinstance(x, tuple):
        return tuple(_opened(y, f) for y in x)
    if hasattr(x, "__dataclass_fields__"):
        return replace(x, **{n: _opened(getattr(x, n), f) for n in x.__dataclass_fields__})
    return x


def _renamed(q: Any, name: str) -> Any:
    """A lowered query whose columns are called name__column."""
    if isinstance(q, ir.SetOp):
        return replace(q, left=_renamed(q.left, name), right=_renamed(q.right, name))
    k = max(i for i, c in enumerate(q.clauses) if isinstance(c, ir.Return))
    back = q.clauses[k]
    if any(isinstance(i.x, ir.Star) for i in back.items):
        raise ValueError("a derived table names its columns")
    items = tuple(ir.Item(i.x, f"{name}__{i.alias or i.x.name}") for i in back.items)
    old = {ir.Var(i.alias or getattr(i.x, "name", "")): ir.Var(n.alias) for i, n in zip(back.items, items, strict=True)}
    tail = tuple(ir.replaced(c, {v: n for v, n in old.items() if v.name}) if isinstance(c, ir.OrderBy) else c for c in q.clauses[k + 1 :])
    return ir.Single((*q.clauses[:k], replace(back, items=items), *tail))


def select(*items: Any) -> Select:
    return Select().select(*items)


def from_(t: Table | Derived) -> Select:
    return Select().from_(t)


def values(rows: Iterable[tuple], columns: Iterable[str]) -> Select | Combined:
    """Rows of plain values as a query."""
    names = list(columns)
    each = [Select(items=tuple(lit(v).as_(n) for v, n in zip(r, names, strict=True))) for r in rows]
    return each[0] if len(each) == 1 else union(*each, distinct=False)


def over(call: Expr, name: str) -> Expr:
    """``call`` over the window of that name."""
    return Expr(ir.Over(call.x, name))
