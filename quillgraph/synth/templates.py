"""Seeded query templates for a schema: IR of every template type, rendered in either dialect."""

from __future__ import annotations

import random
from dataclasses import dataclass

from quillgraph.catalog import GraphSchema, Property
from quillgraph.plans import ir
from quillgraph.plans.render import render

TYPES = ("match", "match_where", "match_where_return", "complete_query", "complete_query_with_order", "aggregation", "path_length")
# Row limits of templates.
LIMITS = (1, 5, 10, 20, 50, 100)
MAX_HOPS = 5
_TEXT, _NUMBER, _TIME = ("string",), ("int", "float"), ("date", "datetime")
#: Shapes of conditions, and for which property and path each fits.
SHAPES = {
    "compare": lambda q, p: True, "null": lambda q, p: True, "in": lambda q, p: q.type not in _TIME, "and_or": lambda q, p: True, "nested": lambda q, p: True, "xor": lambda q, p: True,
    "not": lambda q, p: True, "part": lambda q, p: q.type in _TEXT, "regex": lambda q, p: q.type in _TEXT, "size": lambda q, p: q.type in _TEXT,
    "case_of_letters": lambda q, p: q.type in _TEXT, "cut": lambda q, p: q.type in _TEXT, "trimmed": lambda q, p: q.type in _TEXT, "swapped": lambda q, p: q.type in _TEXT,
    "between": lambda q, p: q.type in _NUMBER, "case": lambda q, p: q.type in _NUMBER, "math": lambda q, p: q.type in _NUMBER, "absolute": lambda q, p: q.type in _NUMBER,
    "cast": lambda q, p: q.type in _NUMBER, "given": lambda q, p: q.type in _TEXT + _NUMBER, "truncated": lambda q, p: q.type in _TIME,
    "exists": lambda q, p: bool(p.rels), "in_query": lambda q, p: q.type in _TEXT + _NUMBER,
}


@dataclass(frozen=True)
class Template:
    type: str
    query: object
    hops: int

    @property
    def complexity(self) -> str:
        return "basic" if self.hops <= 1 else "medium" if self.hops <= 3 else "high"

    def text(self, dialect: str = "cypher") -> str:
        return render(self.query, dialect)


class Templates:
    def __init__(self, schema: GraphSchema, seed: int = 0, values: dict[tuple[str, str], list] | None = None) -> None:
        """``values``: sampled values by (label, property), to write conditions that hold somewhere."""
        self.schema, self.random, self.values = schema, random.Random(f"{schema.name}-{seed}"), values or {}

    def path(self, hops: int) -> ir.Path | None:
        """A walk over the schema of that many hops, or None if the schema has none."""
        starts = [n.name for n in self.schema.nodes]
        self.random.shuffle(starts)
        for at in starts:
            nodes, rels = [ir.NodePat("n0", (at,))], []
            while len(rels) < hops:
                onward = [r for r in self.schema.relationships if r.source == at] + [r for r in self.schema.relationships if r.target == at and r.source != at]
                if not onward:
                    break
                r = self.random.choice(onward)
                forth = r.source == at
                at = r.target if forth else r.source
                rels.append(ir.RelPat(f"r{len(rels)}", (r.name,), "out" if forth else "in"))
                nodes.append(ir.NodePat(f"n{len(rels)}", (at,)))
            if len(rels) == hops:
                return ir.Path(None, tuple(nodes), tuple(rels))
        return None

    def cycle(self) -> ir.Path | None:
        """A declared cycle: as many hops as it has, closed on its first node."""
        if not self.schema.cycles:
            return None
        path = self.random.choice(self.schema.cycles).path
        rels = tuple(ir.RelPat(f"r{i}", (t,)) for i, t in enumerate(path[1::2]))
        nodes = [ir.NodePat(f"n{i}", (path[2 * i],)) for i in range(len(rels))]
        return ir.Path(None, (*nodes, nodes[0]), rels)

    def _property(self, p: ir.Path) -> tuple[ir.Prop, Property, str]:
        n = self.random.choice(p.nodes)
        q = self.random.choice(self.schema.node(n.labels[0]).properties)
        return ir.Prop(n.var, q.name), q, n.labels[0]

    def _value(self, q: Property, label: str):
        known = self.values.get((label, q.name))
        if known:
            return ir.Lit(self.random.choice(known))
        if q.allowed_values:
            return ir.Lit(self.random.choice(q.allowed_values))
        if q.type == "int":
            return ir.Lit(self.random.randint(int(q.min_value or 0), int(q.max_value or 1000)))
        if q.type == "float":
            return ir.Lit(round(self.random.uniform(q.min_value or 0, q.max_value or 1000), 2))
        if q.type == "boolean":
            return ir.Lit(self.random.random() < 0.5)
        if q.type in ("date", "datetime"):
            return ir.Call("localdatetime", (ir.Lit(f"{self.random.randint(2020, 2024)}-{self.random.randint(1, 12):02d}-01"),))
        return ir.Lit(f"{q.name}_{self.random.randint(0, 99999)}" if not q.unique else f"{label.upper()}_{self.random.randint(0, 60):06d}")

    def condition(self, p: ir.Path):
        """One condition, of a shape in SHAPES that fits a property drawn at random."""
        x, q, label = self._property(p)
        fitting = [s for s in SHAPES if SHAPES[s](q, p)]
        return getattr(self, "_" + self.random.choice(fitting))(p, x, q, label)

    def condition_simple(self, p: ir.Path):
        return self._compare(p, *self._property(p))

    def _word(self, q: Property, label: str) -> str:
        return str(self._value(q, label).value)

    def _compare(self, p, x, q, label):
        ops = ("=", "<>") if q.type in ("string", "boolean") else ("=", "<>", "<", "<=", ">", ">=")
        return ir.Bin(self.random.choice(ops), x, self._value(q, label))

    def _null(self, p, x, q, label):
        return ir.IsNull(x, self.random.random() < 0.7)

    def _part(self, p, x, q, label):
        op, s = self.random.choice(("contains", "starts with", "ends with")), self._word(q, label)
        return ir.Bin(op, x, ir.Lit(s[:3] if op != "ends with" else s[-2:]))

    def _regex(self, p, x, q, label):
        return ir.Bin("=~", x, ir.Lit(".*" + self._word(q, label)[:2] + ".*"))

    def _in(self, p, x, q, label):
        test = ir.In(x, (self._value(q, label), self._value(q, label)))
        return ir.Un("not", test) if self.random.random() < 0.3 else test

    def _between(self, p, x, q, label):
        a, b = sorted((self._value(q, label).value, self._value(q, label).value))
        return ir.Between(x, ir.Lit(a), ir.Lit(b))

    def _and_or(self, p, x, q, label):
        return ir.Bin(self.random.choice(("and", "or")), self.condition_simple(p), self.condition_simple(p))

    def _nested(self, p, x, q, label):
        return ir.Bin("and", ir.Bin("or", self.condition_simple(p), self.condition_simple(p)), self.condition_simple(p))

    def _xor(self, p, x, q, label):
        return ir.Bin("xor", self.condition_simple(p), self.condition_simple(p))

    def _not(self, p, x, q, label):
        return ir.Un("not", self.condition_simple(p))

    def _case(self, p, x, q, label):
        return ir.Bin(">", ir.Case(None, ((ir.Bin(">", x, self._value(q, label)), ir.Lit(1)),), ir.Lit(0)), ir.Lit(0))

    def _math(self, p, x, q, label):
        tree = ir.Bin(self.random.choice(("+", "-")), ir.Bin("*", x, ir.Lit(self.random.randint(2, 9))), ir.Lit(self.random.randint(1, 9)))
        return ir.Bin(self.random.choice(("<", ">")), tree, self._value(q, label))

    def _absolute(self, p, x, q, label):
        return ir.Bin("<", ir.Call("abs", (ir.Bin("-", x, self._value(q, label)),)), ir.Lit(self.random.randint(1, 200)))

    def _size(self, p, x, q, label):
        return ir.Bin(">", ir.Call("size", (x,)), ir.Lit(self.random.randint(1, 8)))

    def _case_of_letters(self, p, x, q, label):
        f = self.random.choice(("toupper", "tolower"))
        s = self._word(q, label)
        return ir.Bin("=", ir.Call(f, (x,)), ir.Lit(s.upper() if f == "toupper" else s.lower()))

    def _cut(self, p, x, q, label):
        n = self.random.randint(1, 4)
        return ir.Bin("=", ir.Call("substring", (x, ir.Lit(0), ir.Lit(n))), ir.Lit(self._word(q, label)[:n]))

    def _trimmed(self, p, x, q, label):
        return ir.Bin("<>", ir.Call("trim", (x,)), ir.Lit(self._word(q, label)))

    def _swapped(self, p, x, q, label):
        s = self._word(q, label)
        return ir.Bin("=", ir.Call("replace", (x, ir.Lit(s[:1]), ir.Lit("_"))), ir.Lit(s.replace(s[:1], "_") if s else "_"))

    def _given(self, p, x, q, label):
        v = self._value(q, label)
        return ir.Bin("=", ir.Call("coalesce", (x, v)), v)

    def _truncated(self, p, x, q, label):
        return ir.Bin(">=", ir.Call("localdatetime.truncate", (ir.Lit(self.random.choice(("year", "month"))), x)), self._value(q, label))

    def _cast(self, p, x, q, label):
        return ir.Bin("<>", ir.Cast(x, "string"), ir.Lit(str(self._value(q, label).value)))

    def _linked(self, p) -> ir.Single:
        inner = ir.Path(None, (ir.NodePat(p.nodes[0].var, p.nodes[0].labels), ir.NodePat("m1", p.nodes[1].labels)), (ir.RelPat("q0", p.rels[0].types, p.rels[0].direction),))
        return ir.Single((ir.Match((inner,)), ir.Return((ir.Item(ir.Lit(1), "one"),))))

    def _exists(self, p, x, q, label):
        test = ir.Exists(self._linked(p))
        return ir.Un("not", test) if self.random.random() < 0.3 else test

    def _in_query(self, p, x, q, label):
        other = ir.NodePat("m2", (label,))
        return ir.In(x, ir.Single((ir.Match((ir.Path(None, (other,), ()),)), ir.Return((ir.Item(ir.Prop("m2", q.name), "v"),)))))

    def returned(self, p: ir.Path) -> tuple[ir.Item, ...]:
        """Properties, functions of them, CASE, arithmetic, and names of labels and types."""
        out = []
        for k in range(self.random.randint(1, 3)):
            x, q, label = self._property(p)
            kind = self.random.randrange(9)
            if kind == 1 and q.type == "string":
                x = ir.Call(self.random.choice(("toupper", "tolower", "trim", "size")), (x,))
            elif kind == 2 and q.type in ("int", "float"):
                x = ir.Bin(self.random.choice(("+", "-", "*", "/")), x, ir.Lit(self.random.randint(1, 9)))
            elif kind == 3:
                x = ir.Case(None, ((ir.Bin("=", x, self._value(q, label)), ir.Lit("yes")),), ir.Lit("no"))
            elif kind == 4 and q.type == "string":
                x = ir.Call("substring", (x, ir.Lit(0), ir.Lit(3)))
            elif kind == 5:
                x = ir.Lit(label)  # the label as a value
            elif kind == 6 and p.rels:
                x = ir.Call("type", (ir.Var(self.random.choice(p.rels).var),))
            elif kind == 7 and q.type in ("int", "float"):
                x = ir.Call(self.random.choice(("abs", "round")), (x,))
            elif kind == 8 and q.type in ("string", "int"):
                x = ir.Call("coalesce", (x, ir.Lit("none" if q.type == "string" else 0)))
            out.append(ir.Item(x, f"c{k}"))
        return tuple(out)

    def ordered(self, p: ir.Path) -> tuple[ir.Key, ...]:
        """One or two sort keys, in any combination of directions and places of nulls."""
        keys = []
        for _ in range(self.random.choice((1, 2))):
            x, _, _ = self._property(p)
            keys.append(ir.Key(x, self.random.random() < 0.5, self.random.choice((None, None, True, False))))
        return tuple(dict.fromkeys(keys))

    def aggregate(self, p: ir.Path) -> ir.Call:
        y, q, _ = self._property(p)
        if q.type in ("int", "float"):
            return ir.Call(self.random.choice(("min", "max", "count", "sum", "avg")), (y,))
        return ir.Call(self.random.choice(("min", "max", "count")), (y,)) if q.type != "boolean" else ir.Call("count", (y,), self.random.random() < 0.5)

    def one(self, kind: str, p: ir.Path) -> Template:
        match, limit = ir.Match((p,)), ir.Limit(self.random.choice(LIMITS))
        if kind == "path_length":
            p = ir.Path("p", p.nodes, p.rels)
            tail = (ir.Return((ir.Item(ir.Call("length", (ir.Var("p"),)), "path_length"),)), limit)
            return Template(kind, ir.Single((ir.Match((p,)), *tail)), len(p.rels))
        if kind == "match":
            return Template(kind, ir.Single((match, ir.Return(tuple(ir.Item(ir.Var(n.var), n.var) for n in dict.fromkeys(p.nodes))))), len(p.rels))
        where = ir.Match((p,), self.condition(p))
        if kind == "match_where":
            return Template(kind, ir.Single((where, ir.Return((ir.Item(ir.Var("n0"), "n0"),)))), len(p.rels))
        if kind == "aggregation":
            x, q, _ = self._property(p)
            agg = self.aggregate(p)
            tail = (ir.Return((ir.Item(x, "k"), ir.Item(agg, "v"), ir.Item(ir.Call("count", (ir.Star(),)), "n"))), ir.OrderBy((ir.Key(ir.Var("n"), False), ir.Key(ir.Var("k")))), limit)
            return Template(kind, ir.Single((match, *tail)), len(p.rels))
        back = ir.Return(self.returned(p), self.random.random() < 0.2)
        if kind == "match_where_return":
            return Template(kind, ir.Single((where, back)), len(p.rels))
        if kind == "complete_query":
            return Template(kind, ir.Single((where, back, limit)), len(p.rels))
        keys = self.ordered(p)
        # The order stands before RETURN in this type.
        return Template(kind, ir.Single((where, ir.OrderBy(keys), ir.Return(back.items), limit)), len(p.rels))

    def generate(self, n: int, types: tuple[str, ...] = TYPES, hops: tuple[int, ...] = (0, 1, 1, 2, 2, 3, 4, MAX_HOPS), cycles: float = 0.15) -> list[Template]:
        """``n`` templates: ``types`` in turn, over paths of as many ``hops`` as drawn, and a share of ``cycles``."""
        out = []
        for _ in range(100 * n):  # a schema may have no path so long
            p = self.cycle() if self.random.random() < cycles else None
            p = p or self.path(self.random.choice(hops))
            if p is not None:
                out.append(self.one(types[len(out) % len(types)], p))
            if len(out) == n:
                break
        return out
