"""The intermediate representation: patterns, expressions, clauses, queries."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    var: str
    name: str


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Call:
    name: str  # lower case
    args: tuple = ()
    distinct: bool = False


@dataclass(frozen=True)
class Bin:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Un:
    op: str  # not, -
    x: Any


@dataclass(frozen=True)
class IsNull:
    x: Any
    negated: bool = False


@dataclass(frozen=True)
class In:
    x: Any
    items: Any  # tuple of expressions, a query, or an expression that is a list


@dataclass(frozen=True)
class Between:
    x: Any
    low: Any
    high: Any


@dataclass(frozen=True)
class Case:
    base: Any
    whens: tuple
    default: Any = None


@dataclass(frozen=True)
class Cast:
    x: Any
    type: str  # float, int, string, date


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class Exists:
    query: Any


@dataclass(frozen=True)
class Scalar:
    query: Any


@dataclass(frozen=True)
class Windowed:
    call: Call
    partition: tuple
    order: tuple


@dataclass(frozen=True)
class Over:
    """A call over a named window, until the name is resolved."""

    call: Call
    name: str


@dataclass(frozen=True)
class Param:
    """A query parameter, $name, until it is bound."""

    name: str


@dataclass(frozen=True)
class NodePat:
    var: str | None = None
    labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class RelPat:
    var: str | None = None
    types: tuple[str, ...] = ()
    direction: str = "out"  # out, in, both


@dataclass(frozen=True)
class Path:
    var: str | None
    nodes: tuple[NodePat, ...]
    rels: tuple[RelPat, ...]


@dataclass(frozen=True)
class Key:
    x: Any
    ascending: bool = True
    nulls_first: bool | None = None


@dataclass(frozen=True)
class Item:
    x: Any
    alias: str | None = None


@dataclass(frozen=True)
class Match:
    paths: tuple[Path, ...]
    where: Any = None
    optional: bool = False


@dataclass(frozen=True)
class With:
    items: tuple[Item, ...]
    distinct: bool = False
    where: Any = None


@dataclass(frozen=True)
class Return:
    """``grouping``: None, 'cube', 'rollup', or the grouping sets as places in ``group_by``."""

    items: tuple[Item, ...]
    distinct: bool = False
    group_by: tuple | None = None
    grouping: Any = None
    qualify: Any = None


@dataclass(frozen=True)
class OrderBy:
    keys: tuple[Key, ...]


@dataclass(frozen=True)
class Skip:
    n: int


@dataclass(frozen=True)
class Limit:
    n: int


@dataclass(frozen=True)
class Let:
    name: str
    x: Any


@dataclass(frozen=True)
class Unwind:
    x: Any
    name: str


@dataclass(frozen=True)
class Recursive:
    """A table of its own name: the rows of ``base`` and what ``step`` makes of rows found before."""

    name: str
    base: Any
    step: Any
    distinct: bool = True


@dataclass(frozen=True)
class From:
    """The rows of a recursive table; their columns are properties of ``var``."""

    name: str
    var: str


@dataclass(frozen=True)
class CallSub:
    query: Any


@dataclass(frozen=True)
class Filter:
    where: Any


@dataclass(frozen=True)
class Single:
    clauses: tuple


@dataclass(frozen=True)
class SetOp:
    op: str  # union, intersect, except
    distinct: bool
    left: Any
    right: Any
    by_name: bool = False


def walk(x: Any) -> Iterator[Any]:
    """Every IR node below ``x``, itself first."""
    if is_dataclass(x):
        yield x
        for f in fields(x):
            yield from walk(getattr(x, f.name))
    elif isinstance(x, tuple):
        for y in x:
            yield from walk(y)


def transform(x: Any, f) -> Any:
    """``x`` with every node replaced by f(node), children first."""
    if is_dataclass(x):
        return f(replace(x, **{k.name: transform(getattr(x, k.name), f) for k in fields(x)}))
    return tuple(transform(y, f) for y in x) if isinstance(x, tuple) else x


def children(x: Any) -> Iterator[Any]:
    """The IR nodes directly below ``x``."""
    for y in (getattr(x, f.name) for f in fields(x)) if is_dataclass(x) else x if isinstance(x, tuple) else ():
        if is_dataclass(y):
            yield y
        elif isinstance(y, tuple):
            yield from children(y)


def bfs(x: Any) -> Iterator[Any]:
    """Every IR node below ``x``, level by level."""
    line = deque([x])
    while line:
        y = line.popleft()
        yield y
        line.extend(children(y))


def find_all(x: Any, kind: type | tuple) -> list:
    return [y for y in walk(x) if isinstance(y, kind)]


def find(x: Any, kind: type | tuple) -> Any:
    """The uppermost node of a kind, or None."""
    return next((y for y in bfs(x) if isinstance(y, kind)), None)


def ancestors(root: Any, node: Any) -> list:
    """The nodes from ``root`` down to the one above ``node`` (the very object), root first."""
    if root is node:
        return []
    for y in children(root):
        if y is node:
            return [root]
        found = ancestors(y, node)
        if found:
            return [root, *found]
    return []


def replaced(x: Any, names: dict) -> Any:
    """``x`` with every node that is a key of ``names`` replaced by its value, outermost first."""
    if is_dataclass(x):
        if x in names:
            return names[x]
        return replace(x, **{f.name: replaced(getattr(x, f.name), names) for f in fields(x)})
    return tuple(replaced(y, names) for y in x) if isinstance(x, tuple) else x


def bound(x: Any, params: dict[str, Any] | None) -> Any:
    """``x`` with its parameters bound to values; lists become lists of literals."""
    missing = {p.name for p in find_all(x, Param)} - set(params or {})
    if missing:
        raise ValueError(f"no value for {', '.join(f'${m}' for m in sorted(missing))}")

    def value(v: Any) -> Any:
        return tuple(map(Lit, v)) if isinstance(v, (list, tuple)) else Lit(v)

    def put(y: Any) -> Any:
        if isinstance(y, In) and isinstance(y.items, Param):
            v = params[y.items.name]
            return In(y.x, value(v) if isinstance(v, (list, tuple)) else (Lit(v),))
        if isinstance(y, Param):
            v = value(params[y.name])
            return ListOf(v) if isinstance(v, tuple) else v
        return y

    # IN takes its list as it is, before the parameter turns into an expression.
    x = transform(x, lambda y: put(y) if isinstance(y, In) else y) if params else x
    return transform(x, put) if params else x


def expanded(x: Any, queries: dict[str, Any]) -> Any:
    """``x`` with every ``CALL`` of a query name (a Var) replaced by that query."""
    return transform(x, lambda y: CallSub(queries[y.query.name]) if isinstance(y, CallSub) and isinstance(y.query, Var) and y.query.name in queries else y)


def dump(x: Any) -> str:
    """IR as JSON text; ``load`` gives it back."""

    def plain(y: Any) -> Any:
        if is_dataclass(y):
            return {"is": type(y).__name__} | {f.name: plain(getattr(y, f.name)) for f in fields(y)}
        return [plain(z) for z in y] if isinstance(y, tuple) else y

    return json.dumps(plain(x), ensure_ascii=False)


def load(text: str) -> Any:
    def node(y: Any) -> Any:
        if isinstance(y, dict):
            kind = globals().get(y.get("is"))
            if not (isinstance(kind, type) and is_dataclass(kind)):
                raise ValueError(f"no IR node {y.get('is')}")
            return kind(**{k: node(v) for k, v in y.items() if k != "is"})
        return tuple(map(node, y)) if isinstance(y, list) else y

    return node(json.loads(text))


def path_findings(p: Path) -> list[str]:
    """What is wrong with a path's shape: nodes and relationships have to alternate."""
    out = []
    if len(p.nodes) != len(p.rels) + 1:
        out.append(f"{len(p.nodes)} nodes and {len(p.rels)} relationships do not alternate")
    out += [f"no node: {n}" for n in p.nodes if not isinstance(n, NodePat)]
    out += [f"no relationship: {r}" for r in p.rels if not isinstance(r, RelPat)]
    out += [f"no direction: {r.direction}" for r in p.rels if isinstance(r, RelPat) and r.direction not in ("out", "in", "both")]
    names = [r.var for r in p.rels if isinstance(r, RelPat) and r.var]
    return out + [f"relationship {n} stands twice" for n in sorted({n for n in names if names.count(n) > 1})]


def reversed_path(p: Path) -> Path:
    """The same path from its end."""
    turn = {"out": "in", "in": "out"}
    return Path(p.var, p.nodes[::-1], tuple(RelPat(r.var, r.types, turn.get(r.direction, r.direction)) for r in reversed(p.rels)))


def _joined_ends(a: Path, b: Path, any_way: bool) -> Path | None:
    """Two paths as one where an end of one is an end of the other, or None."""
    if a.var is not None or b.var is not None or not a.rels or not b.rels:
        return None
    for x, y in ((a, b), (reversed_path(a), b), (a, reversed_path(b))) if any_way else ((a, b),):
        if x.nodes[-1].var and x.nodes[-1].var == y.nodes[0].var:
            ends = NodePat(x.nodes[-1].var, tuple(dict.fromkeys((*x.nodes[-1].labels, *y.nodes[0].labels))))
            return Path(None, (*x.nodes[:-1], ends, *y.nodes[1:]), x.rels + y.rels)
    return None


def merge_paths(paths: tuple[Path, ...], any_way: bool = False) -> tuple[Path, ...]:
    """Paths that continue one another become one; lone nodes that stand in a path go, and so
    do lone relationships between open ends.

    A path continues another where its first node is the other's last by variable, and with
    ``any_way`` where any of their ends are the same, one of them walked backwards if need be.
    """
    whole = list(paths)
    merged = True
    while merged:
        merged = False
        for a in whole:
            for b in whole:
                one = _joined_ends(a, b, any_way) if a is not b else None
                if one is not None:
                    whole.remove(a)
                    whole.remove(b)
                    whole.append(one)
                    merged = True
                    break
            if merged:
                break
    longer = {r.var for p in whole if any(n.var for n in p.nodes) for r in p.rels if r.var}
    whole = [p for p in whole if not (len(p.rels) == 1 and p.rels[0].var in longer and not any(n.var or n.labels for n in p.nodes))]
    inside = {n.var: n for p in whole if p.rels for n in p.nodes if n.var}
    return tuple(p for p in whole if p.rels or p.nodes[0].var not in inside or set(p.nodes[0].labels) - set(inside[p.nodes[0].var].labels))
