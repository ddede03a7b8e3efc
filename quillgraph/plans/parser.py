"""Recursive descent for both dialects: Cypher text and ISO-GQL text give one IR.

The grammar is a superset of both; ``dialect`` only matters where one text means two
things (substring positions, case of LIKE).
"""

from __future__ import annotations

import re

from quillgraph.plans import ir

TOKEN = re.compile(
    r"""\s+|//[^\n]*|/\*.*?\*/
    |(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?|\.\d+)
    |(?P<str>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
    |(?P<quoted>`(?:[^`]|``)*`)
    |(?P<name>[A-Za-z_][A-Za-z_0-9]*)
    |(?P<op><>|<=|>=|=~|!=|\|\||->|<-|[-+*/%^=<>()\[\]{},.:|@;$])""",
    re.X | re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class ParseError(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at : at + 20]!r} at {at}")
        at = m.end()
        if m.lastgroup == "str":
            q, body = m["str"][0], m["str"][1:-1]
            body = re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), body.replace(q * 2, q), flags=re.S)
            out.append(("str", body))
        elif m.lastgroup == "quoted":
            out.append(("id", m["quoted"][1:-1].replace("``", "`")))
        elif m.lastgroup:
            out.append((m.lastgroup, m[m.lastgroup]))
    out.append(("end", ""))
    return out


class Parser:
    def __init__(self, text: str, dialect: str = "cypher") -> None:
        self.t, self.i, self.dialect = tokens(text), 0, dialect

    # -- tokens
    def word(self, ahead: int = 0) -> str:
        kind, value = self.t[min(self.i + ahead, len(self.t) - 1)]
        return value.lower() if kind == "name" else value if kind == "op" else f"<{kind}>"

    def at(self, *words: str) -> bool:
        return all(self.word(k) == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise ParseError(f"expected {' '.join(words)} before {[v for _, v in self.t[self.i : self.i + 5]]}")

    def name(self) -> str:
        kind, value = self.t[self.i]
        if kind not in ("name", "id"):
            raise ParseError(f"expected a name before {[v for _, v in self.t[self.i : self.i + 5]]}")
        self.i += 1
        return value

    def many(self, one) -> tuple:
        out = [one()]
        while self.take(","):
            out.append(one())
        return tuple(out)

    # -- queries
    def whole(self):
        q = self.query()
        self.take(";")
        if self.t[self.i][0] != "end":
            raise ParseError(f"left over: {[v for _, v in self.t[self.i : self.i + 8]]}")
        return q

    def query(self):
        left = self.single()
        combined = False
        while self.word() in ("union", "intersect", "except"):
            op = self.word()
            self.i += 1
            distinct = not self.take("all")
            self.take("distinct")
            by_name = self.take("by", "name")
            left = ir.SetOp(op, distinct, left, self.single(), by_name)
            combined = True
        tail = []
        while self.word() in ("order", "skip", "offset", "limit"):
            tail.append(self.clause())
        if tail and not combined and isinstance(left, ir.Single):
            return ir.Single(left.clauses + tuple(tail))
        return ir.Single((ir.CallSub(left), *tail, ir.Return((ir.Item(ir.Star()),)))) if tail else left

    def single(self):
        if self.take("{"):
            q = self.query()
            self.need("}")
            return q
        out = []
        while self.word() in CLAUSES:
            out.append(self.clause())
            if isinstance(out[-1], ir.Return) and self.word() in ("union", "intersect", "except"):
                break
        if not out:
            raise ParseError(f"expected a clause before {[v for _, v in self.t[self.i : self.i + 5]]}")
        return ir.Single(tuple(x for x in out if x is not None))

    def clause(self):
        if self.take("optional"):
            self.need("match")
            return self.match(True)
        if self.take("match"):
            return self.match(False)
        if self.word() == "with" and self.word(1) == "recursive" and self.word(3) == "as" and self.word(4) == "{":
            self.i += 2
            name = self.name()
            self.need("as", "{")
            base = self.single()
            self.need("union")
            distinct = not self.take("all")
            self.take("distinct")
            step = self.single()
            self.need("}")
            return ir.Recursive(name, base, step, distinct)
        if self.take("from"):
            name = self.name()
            self.take("as")
            return ir.From(name, self.name())
        if self.take("with"):
            distinct = self.take("distinct")
            items = self.many(self.item)
            return ir.With(items, distinct, self.expr() if self.take("where") else None)
        if self.take("return"):
            distinct = self.take("distinct")
            items = self.many(self.item)
            by, grouping = self.groups() if self.take("group", "by") else (None, None)
            windows, qualify = {}, None
            while self.word() in ("window", "qualify"):
                if self.take("qualify"):
                    qualify = self.expr()
                else:
                    self.need("window")
                    windows |= dict(self.many(self.window))
            out = ir.Return(items, distinct, by, grouping, qualify)
            return ir.transform(out, lambda x: ir.Windowed(x.call, *windows[x.name]) if isinstance(x, ir.Over) and x.name in windows else x)
        if self.take("unwind"):
            x = self.expr()
            self.need("as")
            return ir.Unwind(x, self.name())
        if self.take("order", "by"):
            return ir.OrderBy(self.many(self.key))
        if self.take("skip") or self.take("offset"):
            return ir.Skip(self.integer())
        if self.take("limit"):
            return ir.Limit(self.integer())
        if self.take("let"):
            name = self.name()
            self.need("=")
            return ir.Let(name, self.expr())
        if self.take("call"):
            if self.take("("):
                self.take("*")
                self.need(")")
            self.need("{")
            q = self.query()
            self.need("}")
            return ir.CallSub(q)
        if self.take("filter"):
            self.take("where")
            return ir.Filter(self.expr())
        if self.take("where"):
            return ir.Filter(self.expr())
        self.need("next")
        return None

    def integer(self) -> int:
        kind, value = self.t[self.i]
        if kind != "num":
            raise ParseError(f"expected a number, not {value!r}")
        self.i += 1
        return int(value)

    def groups(self) -> tuple[tuple, object]:
        """Grouping keys and how they group."""
        if self.word() in ("cube", "rollup") and self.word(1) == "(":
            kind = self.word()
            self.i += 2
            keys = self.many(self.expr)
            self.need(")")
            return keys, kind
        if self.take("grouping", "sets"):
            self.need("(")
            sets = self.many(self.group_set)
            self.need(")")
            keys = tuple(dict.fromkeys(x for own in sets for x in own))
            return keys, tuple(tuple(keys.index(x) for x in own) for own in sets)
        return self.many(self.expr), None

    def group_set(self) -> tuple:
        self.need("(")
        items = () if self.at(")") else self.many(self.expr)
        self.need(")")
        return items

    def window(self) -> tuple[str, tuple]:
        name = self.name()
        self.need("as")
        self.need("(")
        return name, self.frame()

    def frame(self) -> tuple[tuple, tuple]:
        """Partition and order of a window, up to its closing parenthesis."""
        by = self.many(self.expr) if self.take("partition", "by") else ()
        order = self.many(self.key) if self.take("order", "by") else ()
        self.need(")")
        return by, order

    def key(self) -> ir.Key:
        x, up, first = self.expr(), True, None
        if self.take("desc") or self.take("descending"):
            up = False
        else:
            self.take("asc") or self.take("ascending")
        if self.take("nulls"):
            first = self.take("first")
            if not first:
                self.need("last")
        return ir.Key(x, up, first)

    def item(self) -> ir.Item:
        if self.take("*"):
            return ir.Item(ir.Star())
        x = self.expr()
        return ir.Item(x, self.name() if self.take("as") else None)

    # -- patterns
    def match(self, optional: bool) -> ir.Match:
        paths = self.many(self.path)
        return ir.Match(paths, self.expr() if self.take("where") else None, optional)

    def path(self) -> ir.Path:
        var = None
        if self.t[self.i][0] in ("name", "id") and self.word(1) == "=":
            var = self.name()
            self.need("=")
        nodes, rels = [self.node()], []
        while self.word() in ("-", "<-", "<", "->"):
            rels.append(self.rel())
            nodes.append(self.node())
        return ir.Path(var, tuple(nodes), tuple(rels))

    def node(self) -> ir.NodePat:
        self.need("(")
        var = self.name() if self.t[self.i][0] in ("name", "id") else None
        labels = []
        while self.take(":") or self.take("@"):
            labels.append(self.name())
        self.need(")")
        return ir.NodePat(var, tuple(labels))

    def rel(self) -> ir.RelPat:
        back = self.take("<-")
        if not back:
            self.need("-")
        var, types = None, []
        if self.take("["):
            var = self.name() if self.t[self.i][0] in ("name", "id") else None
            if self.take(":") or self.take("@"):
                types.append(self.name())
                while self.take("|"):
                    self.take(":") or self.take("@")
                    types.append(self.name())
            self.need("]")
        forth = self.take("->")
        if not forth:
            self.need("-")
        if back and forth:
            raise ParseError("a relationship has one direction")
        return ir.RelPat(var, tuple(types), "in" if back else "out" if forth else "both")

    # -- expressions, loosest first
    def expr(self):
        x = self.xor()
        while self.take("or"):
            x = ir.Bin("or", x, self.xor())
        return x

    def xor(self):
        x = self.conj()
        while self.take("xor"):
            x = ir.Bin("xor", x, self.conj())
        return x

    def conj(self):
        x = self.neg()
        while self.take("and"):
            x = ir.Bin("and", x, self.neg())
        return x

    def neg(self):
        return ir.Un("not", self.neg()) if self.take("not") else self.comparison()

    def comparison(self):
        x = self.concat()
        while True:
            if self.take("is", "not", "null"):
                x = ir.IsNull(x, True)
            elif self.take("is", "null"):
                x = ir.IsNull(x)
            elif self.take("is"):
                x = ir.Bin("=", x, self.concat())
            elif self.word() in ("=", "<>", "!=", "<", "<=", ">", ">=", "=~"):
                op = self.word()
                self.i += 1
                x = ir.Bin("<>" if op == "!=" else op, x, self.concat())
            elif self.take("not", "in"):
                x = ir.Un("not", ir.In(x, self.members()))
            elif self.take("in"):
                x = ir.In(x, self.members())
            elif self.take("contains"):
                x = ir.Bin("contains", x, self.concat())
            elif self.take("starts", "with"):
                x = ir.Bin("starts with", x, self.concat())
            elif self.take("ends", "with"):
                x = ir.Bin("ends with", x, self.concat())
            elif self.take("like"):
                x = ir.Call("like", (x, self.concat()))
            elif self.take("between"):
                low = self.concat()
                self.need("and")
                x = ir.Between(x, low, self.concat())
            else:
                return x

    def members(self):
        if self.word() in ("collect", "value") and self.word(1) == "{":
            self.i += 2
            q = self.query()
            self.need("}")
            return q
        if self.take("["):
            items = () if self.at("]") else self.many(self.expr)
            self.need("]")
            return items
        return self.concat()

    def concat(self):
        x = self.sum()
        while self.take("||"):
            x = ir.Bin("||", x, self.sum())
        return x

    def sum(self):
        x = self.product()
        while self.word() in ("+", "-"):
            op = self.word()
            self.i += 1
            x = ir.Bin(op, x, self.product())
        return x

    def product(self):
        x = self.power()
        while self.word() in ("*", "/", "%"):
            op = self.word()
            self.i += 1
            x = ir.Bin(op, x, self.power())
        return x

    def power(self):
        x = self.unary()
        return ir.Bin("^", x, self.power()) if self.take("^") else x

    def unary(self):
        if self.take("-"):
            x = self.unary()
            return ir.Lit(-x.value) if isinstance(x, ir.Lit) and isinstance(x.value, (int, float)) else ir.Un("-", x)
        self.take("+")
        return self.primary()

    def primary(self):
        kind, value = self.t[self.i]
        if kind == "num":
            self.i += 1
            return ir.Lit(int(value) if value.isdigit() else float(value))
        if kind == "str":
            self.i += 1
            return ir.Lit(value)
        if self.take("("):
            x = self.expr()
            self.need(")")
            return x
        if self.take("["):
            items = () if self.at("]") else self.many(self.expr)
            self.need("]")
            return ir.ListOf(items)
        if self.take("$"):
            return ir.Param(self.name())
        if self.take("null"):
            return ir.Lit(None)
        if self.word() in ("true", "false") and self.word(1) not in ("(", "."):
            self.i += 1
            return ir.Lit(value.lower() == "true")
        if self.word() in ("exists", "collect", "value", "count") and self.word(1) == "{":
            w = self.word()
            self.i += 2
            q = self.query()
            self.need("}")
            return ir.Exists(q) if w == "exists" else ir.Scalar(q) if w == "value" else ir.Call("collect_sub" if w == "collect" else "count_sub", (q,))
        if self.at("case"):
            return self.case()
        if self.word() == "cast" and self.word(1) == "(":
            self.i += 2
            x = self.expr()
            self.need("as")
            to = self.name().lower()
            self.need(")")
            return ir.Cast(x, CASTS.get(to, to))
        if self.word() == "trim" and self.word(1) == "(" and self.word(2) in ("both", "leading", "trailing"):
            side = self.word(2)
            self.i += 3
            chars = self.concat()
            self.need("from")
            x = self.concat()
            self.need(")")
            return ir.Call(f"trim_{side}", (x, chars))
        name = self.name()
        while self.word() == "." and self.t[self.i + 1][0] in ("name", "id") and self._is_call(2):
            self.i += 1
            name += "." + self.name()  # a function in a namespace
        if self.take("("):
            return self.call(name.lower())
        if self.take("."):
            return ir.Prop(name, self.name())
        return ir.Var(name)

    def _is_call(self, ahead: int) -> bool:
        """Whether names joined by dots lead to an opening parenthesis."""
        k = self.i + ahead
        while k + 1 < len(self.t) and self.t[k] == ("op", ".") and self.t[k + 1][0] in ("name", "id"):
            k += 2
        return self.t[k] == ("op", "(")

    def call(self, name: str):
        if self.take("*"):
            self.need(")")
            x = ir.Call(name, (ir.Star(),))
        else:
            distinct = self.take("distinct")
            args = () if self.at(")") else self.many(self.expr)
            self.need(")")
            if name == "position":  # position(part, whole), where indexOf has them the other way
                name, args = "apoc.text.indexof", args[::-1]
            if name in CONVERSIONS and len(args) == 1:
                return ir.Cast(args[0], CONVERSIONS[name])
            x = ir.Call(name, args, distinct)
        if self.take("over"):
            return ir.Windowed(x, *self.frame()) if self.take("(") else ir.Over(x, self.name())
        return x

    def case(self):
        self.need("case")
        base = None if self.at("when") else self.expr()
        whens = []
        while self.take("when"):
            c = self.expr()
            self.need("then")
            whens.append((c, self.expr()))
        default = self.expr() if self.take("else") else None
        self.need("end")
        return ir.Case(base, tuple(whens), default)


CLAUSES = {"optional", "match", "with", "return", "order", "skip", "offset", "limit", "let", "call", "filter", "where", "next", "unwind", "from"}
CONVERSIONS = {"tofloat": "float", "tostring": "string", "tointeger": "int"}
CASTS = {"double": "float", "text": "string", "varchar": "string", "integer": "int", "bigint": "int", "local_datetime": "datetime"}


def parse(text: str, dialect: str = "cypher"):
    q = Parser(text, dialect).whole()
    unknown = ir.find(q, ir.Over)
    if unknown is not None:
        raise ParseError(f"no window {unknown.name}")
    return q
