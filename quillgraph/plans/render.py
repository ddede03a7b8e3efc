"""IR as query text, in Cypher or ISO-GQL spelling; parsing the text gives the IR again."""

from __future__ import annotations

import re

from quillgraph.plans import ir

#: Binding strength of operators: weaker ones are parenthesised inside stronger ones.
STRENGTH = {"or": 1, "xor": 2, "and": 3, "not": 4, "=": 5, "<>": 5, "<": 5, "<=": 5, ">": 5, ">=": 5, "=~": 5, "contains": 5, "starts with": 5, "ends with": 5, "||": 6, "+": 7, "-": 7, "*": 8, "/": 8, "%": 8, "^": 9}
# Casts by dialect.
CYPHER_CASTS = {"float": "toFloat", "string": "toString", "int": "toInteger"}


class Renderer:
    def __init__(self, dialect: str = "cypher") -> None:
        self.gql = dialect == "gql"

    def name(self, n: str) -> str:
        if self.gql:
            n = re.sub(r"[ -]", "_", n)
        return n if re.fullmatch(r"[A-Za-z_]\w*", n) else f"`{n}`"

    def label(self, n: str) -> str:
        return f"`{n}`" if self.gql or not re.fullmatch(r"[A-Za-z_]\w*", n) else n

    def node(self, n: ir.NodePat) -> str:
        sign = "@" if self.gql else ":"
        return f"({self.name(n.var) if n.var else ''}{''.join(sign + self.label(x) for x in n.labels)})"

    def path(self, p: ir.Path) -> str:
        sign = "@" if self.gql else ":"
        out = (f"{self.name(p.var)} = " if p.var else "") + self.node(p.nodes[0])
        for r, n in zip(p.rels, p.nodes[1:], strict=True):
            types = sign + ("|".join(map(self.label, r.types))) if r.types else ""
            body = f"[{self.name(r.var) if r.var else ''}{types}]"
            out += {"out": f"-{body}->", "in": f"<-{body}-", "both": f"-{body}-"}[r.direction] + self.node(n)
        return out

    def expr(self, x, above: int = 0) -> str:
        s, own = self._expr(x)
        return f"({s})" if own < above else s

    def _expr(self, x) -> tuple[str, int]:
        e = self.expr
        if isinstance(x, ir.Lit):
            if x.value is None:
                return "NULL", 10
            if isinstance(x.value, bool):
                return str(x.value).lower(), 10
            if isinstance(x.value, str):
                text = x.value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
                return f"'{text}'", 10
            return str(x.value), 10
        if isinstance(x, ir.Var):
            return self.name(x.name), 10
        if isinstance(x, ir.Prop):
            return f"{self.name(x.var)}.{self.name(x.name)}", 10
        if isinstance(x, ir.Star):
            return "*", 10
        if isinstance(x, ir.Param):
            return f"${self.name(x.name)}", 10
        if isinstance(x, ir.Bin):
            k = STRENGTH[x.op]
            # The right side binds tighter: a - (b - c) keeps its parentheses.
            return f"{e(x.left, k + (k == 5) + (k == 9))} {x.op.upper() if x.op.isalpha() or ' ' in x.op else x.op} {e(x.right, k + (k != 9))}", k
        if isinstance(x, ir.Un):
            return (f"NOT {e(x.x, 4)}", 4) if x.op == "not" else (f"-{e(x.x, 10)}", 9)
        if isinstance(x, ir.IsNull):
            return f"{e(x.x, 6)} IS {'NOT ' * x.negated}NULL", 5
        if isinstance(x, ir.Between):
            return f"{e(x.x, 6)} BETWEEN {e(x.low, 6)} AND {e(x.high, 6)}", 5
        if isinstance(x, ir.In):
            if isinstance(x.items, (ir.Single, ir.SetOp)):
                return f"{e(x.x, 6)} IN {'VALUE' if self.gql else 'COLLECT'} {{ {self.query(x.items)} }}", 5
            inner = "[" + ", ".join(map(e, x.items)) + "]" if isinstance(x.items, tuple) else e(x.items, 6)
            return f"{e(x.x, 6)} IN {inner}", 5
        if isinstance(x, ir.Case):
            base = f" {e(x.base)}" if x.base is not None else ""
            whens = "".join(f" WHEN {e(a)} THEN {e(b)}" for a, b in x.whens)
            return f"CASE{base}{whens}{f' ELSE {e(x.default)}' if x.default is not None else ''} END", 10
        if isinstance(x, ir.Cast):
            if not self.gql and x.type in CYPHER_CASTS:
                return f"{CYPHER_CASTS[x.type]}({e(x.x)})", 10
            return f"cast({e(x.x)} as {x.type})", 10
        if isinstance(x, ir.ListOf):
            return f"[{', '.join(map(e, x.items))}]", 10
        if isinstance(x, ir.Exists):
            return f"EXISTS {{ {self.query(x.query)} }}", 10
        if isinstance(x, ir.Scalar):
            return f"VALUE {{ {self.query(x.query)} }}", 10
        if isinstance(x, ir.Windowed):
            by = f"PARTITION BY {', '.join(map(e, x.partition))} " if x.partition else ""
            order = f"ORDER BY {', '.join(map(self.key, x.order))}" if x.order else ""
            return f"{e(x.call)} OVER ({by}{order})", 10
        if isinstance(x, ir.Call):
            if x.name.startswith("trim_"):
                return f"trim({x.name[5:].upper()} {e(x.args[1])} FROM {e(x.args[0])})", 10
            if x.name in ("collect_sub", "count_sub"):
                return f"{x.name[:-4].upper()} {{ {self.query(x.args[0])} }}", 10
            if x.name == "apoc.text.indexof" and self.gql:
                return f"position({e(x.args[1])}, {e(x.args[0])})", 10
            return f"{x.name}({'DISTINCT ' * x.distinct}{', '.join(map(e, x.args))})", 10
        raise NotImplementedError(type(x).__name__)

    def key(self, k: ir.Key) -> str:
        nulls = "" if k.nulls_first is None else f" NULLS {'FIRST' if k.nulls_first else 'LAST'}"
        return f"{self.expr(k.x)}{'' if k.ascending else ' DESC'}{nulls}"

    def item(self, i: ir.Item) -> str:
        return self.expr(i.x) + (f" AS {self.name(i.alias)}" if i.alias else "")

    def clause(self, c) -> str:
        if isinstance(c, ir.Match):
            where = f" WHERE {self.expr(c.where)}" if c.where is not None else ""
            return f"{'OPTIONAL ' * c.optional}MATCH {', '.join(map(self.path, c.paths))}{where}"
        if isinstance(c, (ir.With, ir.Return)):
            word = "WITH" if isinstance(c, ir.With) else "RETURN"
            tail = f" WHERE {self.expr(c.where)}" if isinstance(c, ir.With) and c.where is not None else ""
            if isinstance(c, ir.Return):
                tail += f" GROUP BY {self.groups(c)}" if c.group_by is not None else ""
                tail += f" QUALIFY {self.expr(c.qualify)}" if c.qualify is not None else ""
            return f"{word} {'DISTINCT ' * c.distinct}{', '.join(map(self.item, c.items))}{tail}"
        if isinstance(c, ir.Unwind):
            return f"UNWIND {self.expr(c.x)} AS {self.name(c.name)}"
        if isinstance(c, ir.OrderBy):
            return f"ORDER BY {', '.join(map(self.key, c.keys))}"
        if isinstance(c, ir.Skip):
            return f"SKIP {c.n}"
        if isinstance(c, ir.Limit):
            return f"LIMIT {c.n}"
        if isinstance(c, ir.Let):
            return f"LET {self.name(c.name)} = {self.expr(c.x)}"
        if isinstance(c, ir.CallSub):
            return f"CALL {'' if self.gql else '(*) '}{{ {self.query(c.query)} }}"
        if isinstance(c, ir.Recursive):
            return f"WITH RECURSIVE {self.name(c.name)} AS {{ {self.query(c.base)} UNION {'DISTINCT' if c.distinct else 'ALL'} {self.query(c.step)} }}"
        if isinstance(c, ir.From):
            return f"FROM {self.name(c.name)} AS {self.name(c.var)}"
        if isinstance(c, ir.Filter):
            return f"FILTER WHERE {self.expr(c.where)}"
        raise NotImplementedError(type(c).__name__)

    def groups(self, c: ir.Return) -> str:
        keys = [self.expr(x) for x in c.group_by]
        if c.grouping is None:
            return ", ".join(keys)
        if isinstance(c.grouping, str):
            return f"{c.grouping.upper()} ({', '.join(keys)})"
        return f"GROUPING SETS ({', '.join('(' + ', '.join(keys[k] for k in own) + ')' for own in c.grouping)})"

    def query(self, q) -> str:
        if isinstance(q, ir.SetOp):
            word = f"{q.op.upper()} {'DISTINCT' if q.distinct else 'ALL'}{' BY NAME' * q.by_name}"
            a, b = self.query(q.left), self.query(q.right)
            return f"{{{a}}} {word} {{{b}}}" if self.gql or isinstance(q.right, ir.SetOp) else f"{a} {word} {b}"
        return " ".join(map(self.clause, q.clauses))


def render(query, dialect: str = "cypher") -> str:
    return Renderer(dialect).query(query)
