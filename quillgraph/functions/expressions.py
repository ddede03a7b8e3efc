"""IR expressions as Spark columns: functions, coercions, operators."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.plans import ir

AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "group_concat", "stdev", "collect_list"}
NUMBERS = ("int", "float")
#: Spark's own functions that queries may call by name, besides FUNCTIONS and registered ones.
PLAIN = set(
    "acos asin atan atan2 cos sin tan degrees radians exp ln log log10 log2 ceil ceiling floor sign pi e cbrt pow power mod "
    "ascii chr concat concat_ws initcap lpad rpad repeat reverse soundex translate levenshtein split split_part md5 sha1 sha2 crc32 "
    "year month day dayofmonth dayofweek dayofyear quarter hour minute second last_day add_months months_between date_add date_sub to_date "
    "array array_contains array_distinct array_max array_min array_position array_union array_intersect array_except slice flatten sequence "
    "element_at size sort_array array_join ifnull nvl nvl2 isnull isnotnull hash xxhash64".split()
)
#: User functions by lower-case name: columns in, a column out.
REGISTRY: dict[str, Callable[..., Column]] = {}


def register(name: str, fn: Callable[..., Column]) -> None:
    """Make ``fn`` callable in queries; it takes and returns columns (a pandas UDF will do)."""
    REGISTRY[name.lower()] = fn


def kind_of(dtype: str) -> str:
    """Class of a Spark type name."""
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if dtype in ("float", "double") or dtype.startswith("decimal"):
        return "float"
    if dtype.startswith("timestamp"):
        return "datetime"
    return {"string": "string", "boolean": "bool", "date": "date"}.get(dtype, "list" if dtype.startswith("array") else "other")


def is_aggregate(x) -> bool:
    return isinstance(x, ir.Call) and (x.name in AGGREGATES and not (x.name in ("min", "max") and len(x.args) > 1))


def has_aggregate(x) -> bool:
    if isinstance(x, ir.Windowed):
        return False
    if is_aggregate(x):
        return True
    if isinstance(x, (ir.Exists, ir.Scalar)) or isinstance(x, ir.In) and isinstance(x.items, (ir.Single, ir.SetOp)):
        return False
    if isinstance(x, tuple):
        return any(map(has_aggregate, x))
    return any(has_aggregate(getattr(x, f)) for f in getattr(x, "__dataclass_fields__", {}))


# Strftime directives and their Spark patterns.
DATE_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD"}


def date_pattern(fmt: str) -> str:
    return re.sub(r"%.|[A-Za-z]+", lambda m: DATE_FORMATS.get(m[0], f"'{m[0]}'"), fmt)


def sql_substring(s: Column, start: Column, length: Column | None = None, compat: bool = False) -> Column:
    """Substring with SQLite's rules: 1-based, a negative start counts from the end, a
    negative length takes the characters before the start, start 0 counts a place before
    the first character.

    With ``compat``, as translated queries compute it: a negative length ends with the
    character at the start, and start 0 with a length gives the empty text.
    """
    if compat and length is not None:
        start, length = F.when((length < 0) & (start > 0), start + 1).otherwise(start), F.when(start == 0, F.lit(0)).otherwise(length)
    n = F.length(s)
    at = F.when(start > 0, start - 1).when(start < 0, n + start).otherwise(F.lit(-1))
    at = F.when((start < 0) & (n + start < 0) & F.lit(length is None), F.lit(0)).otherwise(at)
    end = n if length is None else F.when(length < 0, at).otherwise(at + length)
    begin = at if length is None else F.when(length < 0, at + length).otherwise(at)
    begin, end = F.greatest(begin, F.lit(0)), F.least(end, n)
    whole = F.substring(s, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))
    given = start.isNotNull() & (F.lit(True) if length is None else length.isNotNull())
    return F.when(given, whole)


def divide(a: Column, b: Column, integral: bool) -> Column:
    """Division that is null at zero and truncates between integers."""
    if integral:
        return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))
    return F.try_divide(a.cast("double"), b.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, 0 where either is zero."""
    add = lambda s, x: s + x
    total = lambda z: F.aggregate(z, F.lit(0.0), add)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot / norm)


def numeric_similarity(pairs: list[tuple[Column, Column, float]]) -> Column:
    """1 - mean(|a - b| / range) within [0, 1]; 0.5 without attributes."""
    if not pairs:
        return F.lit(0.5)
    total = sum((F.abs(a - b) / F.lit(float(r)) for a, b, r in pairs), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - total / len(pairs)))


def attribute_string(columns: list[str]) -> Column:
    """{name:value,...} in the given order, nulls skipped."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(c + ":"), F.col(c).cast("string"))) for c in columns]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


#: Arithmetic of lists; + joins them. Nothing is divided by 0.
ELEMENTWISE: dict[str, Callable[[Column, Column], Column]] = {
    "-": lambda a, b: a - b, "*": lambda a, b: a * b, "^": F.pow,
    "/": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), "%": lambda a, b: F.when(b != 0, a % F.when(b != 0, b)),
}


class Compiler:
    """Columns for expressions over a scope.

    ``resolve(var)`` gives (kind, column, is_outer) of a variable, ``prop(var, name)`` the
    column and class of a property; ``subquery`` lowers a query to a DataFrame.
    """

    def __init__(self, scope, dialect: str = "cypher", mode: str = "sql", compat: bool = False) -> None:
        self.scope, self.dialect, self.mode, self.compat = scope, dialect, mode, compat

    # -- classes of values
    def kind(self, x) -> str | None:
        if isinstance(x, ir.Lit):
            v = x.value
            return "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "string" if isinstance(v, str) else None
        if isinstance(x, ir.Prop):
            return self.scope.prop(x.var, x.name)[1]
        if isinstance(x, ir.Var):
            return self.scope.value_kind(x.name)
        if isinstance(x, ir.Cast):
            return {"float": "float", "int": "int", "string": "string", "date": "date", "datetime": "datetime"}.get(x.type)
        if isinstance(x, ir.Un):
            return "bool" if x.op == "not" else self.kind(x.x)
        if isinstance(x, (ir.IsNull, ir.In, ir.Between, ir.Exists)):
            return "bool"
        if isinstance(x, ir.ListOf):
            return "list"
        if isinstance(x, ir.Bin):
            if x.op in ("+", "-", "*", "/", "%"):
                kinds = {self.kind(x.left), self.kind(x.right)}
                return "list" if "list" in kinds else "float" if "float" in kinds else "int" if kinds <= {"int", None} else "string" if "string" in kinds and x.op == "+" else "float"
            return "list" if x.op == "^" and "list" in (self.kind(x.left), self.kind(x.right)) else "float" if x.op == "^" else "string" if x.op == "||" else "bool"
        if isinstance(x, ir.Case):
            return next((k for k in (self.kind(v) for _, v in x.whens) if k), None)
        if isinstance(x, ir.Call):
            if x.name in ("count", "length", "size", "char_length", "len", "apoc.text.indexof", "instr", "datediff", "count_sub", "timestampdiff", "div"):
                return "int"
            if x.name in ("avg", "sqrt", "julianday", "cosine", "numeric_similarity"):
                return "float"
            if x.name in ("sum", "abs", "min", "max", "round", "coalesce", "greatest", "least"):
                return self.kind(x.args[0]) if x.args else None
            if x.name in ("upper", "lower", "toupper", "tolower", "trim", "replace", "substring", "left", "right", "lcase", "ucase", "time", "join"):
                return "string"
            if x.name in ("collect", "collect_list", "sort", "collect_sub"):
                return "list"
            if x.name in ("contains", "starts_with", "ends_with", "like", "regexp_like"):
                return "bool"
            if x.name in ("strftime", "apoc.temporal.format"):
                return "string"
            if x.name.startswith(("localdatetime", "local_datetime")):
                return "datetime"
            if x.name == "date":
                return "date" if self.dialect == "gql" else "datetime"
        return None

    # -- coercions
    def boolean(self, x) -> Column:
        """A condition: numbers are true unless 0, texts where they are such numbers."""
        k = self.kind(x)
        if k in NUMBERS:
            return self(x) != 0
        if k == "string":
            return F.coalesce(self(x).try_cast("double") != 0, F.lit(False))
        return self(x)

    def pair(self, a, b) -> tuple[Column, Column]:
        """Both sides of a comparison or an arithmetic operation in one class."""
        ka, kb = self.kind(a), self.kind(b)
        ca, cb = self(a), self(b)

        def fit(c: Column, own: str | None, other: str | None) -> Column:
            if own == "string" and other in NUMBERS:
                return c.try_cast("double")
            if own == "string" and other == "datetime":
                return F.try_to_timestamp(c).cast("timestamp_ntz")
            if own == "string" and other == "date":
                return c.try_cast("date")
            if own == "bool" and other in NUMBERS:
                return c.cast("int")
            return c

        return fit(ca, ka, kb), fit(cb, kb, ka)

    # -- compilation
    def __call__(self, x) -> Column:
        return getattr(self, "_" + type(x).__name__.lower())(x)

    def _lit(self, x: ir.Lit) -> Column:
        return F.lit(x.value)

    def _var(self, x: ir.Var) -> Column:
        return self.scope.var(x.name)

    def _prop(self, x: ir.Prop) -> Column:
        return self.scope.prop(x.var, x.name)[0]

    def _star(self, x: ir.Star) -> Column:
        return F.lit(1)

    def _listof(self, x: ir.ListOf) -> Column:
        return F.array(*map(self, x.items))

    def _un(self, x: ir.Un) -> Column:
        return ~self.boolean(x.x) if x.op == "not" else -self(x.x)

    def _isnull(self, x: ir.IsNull) -> Column:
        return self(x.x).isNotNull() if x.negated else self(x.x).isNull()

    def _between(self, x: ir.Between) -> Column:
        return self(ir.Bin("and", ir.Bin(">=", x.x, x.low), ir.Bin("<=", x.x, x.high)))

    def _in(self, x: ir.In) -> Column:
        if isinstance(x.items, tuple):
            if not x.items:
                return F.lit(False)
            # Members of one class are compared with one form of the left side.
            by: dict[str | None, list[tuple[Column, Column]]] = {}
            for i in x.items:
                by.setdefault(self.kind(i), []).append(self.pair(x.x, i))
            tests = [fits[0][0].isin(*[b for _, b in fits]) for fits in by.values()]
            return reduce(lambda a, b: a | b, tests)
        if isinstance(x.items, (ir.Single, ir.SetOp)):
            return self(x.x).isin(self.scope.subquery(x.items))
        found = self.scope.let_query(x.items)
        if found is not None:
            return self(x.x).isin(self.scope.subquery(found))
        return F.array_contains(self(x.items), self(x.x))

    def _exists(self, x: ir.Exists) -> Column:
        return self.scope.subquery(x.query, exists=True).exists()

    def _scalar(self, x: ir.Scalar) -> Column:
        return self.scope.subquery(x.query).scalar()

    def _case(self, x: ir.Case) -> Column:
        out = None
        for when, then in x.whens:
            c = self(ir.Bin("=", x.base, when)) if x.base is not None else self.boolean(when)
            out = F.when(c, self(then)) if out is None else out.when(c, self(then))
        return out if x.default is None else out.otherwise(self(x.default))

    def _cast(self, x: ir.Cast) -> Column:
        c = self(x.x)
        if x.type == "int" and self.kind(x.x) == "string":
            return F.coalesce(c.try_cast("bigint"), F.when(F.abs(c.try_cast("double")) < 9.2e18, c.try_cast("double")).cast("bigint"))
        return c.try_cast({"float": "double", "int": "bigint", "string": "string", "date": "date", "datetime": "timestamp_ntz", "boolean": "boolean", "bool": "boolean"}[x.type])

    def _windowed(self, x: ir.Windowed) -> Column:
        from pyspark.sql import Window

        # Without PARTITION BY all rows are one window, which Spark warns of.
        w = Window.partitionBy(*map(self, x.partition))
        if x.order:
            w = w.orderBy(*map(self.sort_key, x.order))
        call = x.call
        own = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number, "percent_rank": F.percent_rank}
        if call.name in own:
            return own[call.name]().over(w)
        if call.name in ("lag", "lead"):
            n = call.args[1].value if len(call.args) > 1 else 1
            return getattr(F, call.name)(self(call.args[0]), n).over(w)
        return self(call).over(w)

    def sort_key(self, k: ir.Key) -> Column:
        return ordered(self(k.x), k)

    def _bin(self, x: ir.Bin) -> Column:
        op = x.op
        if op in ("and", "or"):
            a, b = self.boolean(x.left), self.boolean(x.right)
            return a & b if op == "and" else a | b
        if op == "xor":
            return self.boolean(x.left) != self.boolean(x.right)
        if op == "=~":
            return F.regexp_like(self(x.left), F.concat(F.lit("^(?:"), self(x.right), F.lit(")$")))
        if op == "contains":
            return self(x.left).contains(self(x.right))
        if op == "starts with":
            return self(x.left).startswith(self(x.right))
        if op == "ends with":
            return self(x.left).endswith(self(x.right))
        if op == "||":
            return F.concat(self(x.left).cast("string"), self(x.right).cast("string"))
        ka, kb = self.kind(x.left), self.kind(x.right)
        if op == "+" and "list" in (ka, kb):  # lists are joined, an element is appended
            return F.concat(*[self(y) if k == "list" else F.array(self(y)) for y, k in ((x.left, ka), (x.right, kb))])
        if op in ELEMENTWISE and "list" in (ka, kb):
            return self._each(op, x, ka, kb)
        if op == "+" and "string" in (ka, kb) and not {ka, kb} & {"date", "datetime"}:
            return F.concat(self(x.left).cast("string"), self(x.right).cast("string")) if {ka, kb} == {"string"} or None in (ka, kb) else self(x.left).try_cast("double") + self(x.right).try_cast("double")
        if op in ("+", "-", "*", "/", "%", "^"):
            if op == "-" and ka in ("date", "datetime") and kb in ("date", "datetime"):
                return self(x.left) - self(x.right)
            a, b = self(x.left), self(x.right)
            a = a.try_cast("double") if ka == "string" else a.cast("int") if ka == "bool" else a
            b = b.try_cast("double") if kb == "string" else b.cast("int") if kb == "bool" else b
            if op == "/":
                return divide(a, b, ka in ("int", "bool") and kb in ("int", "bool"))
            if op == "%":
                return F.when(b != 0, a % F.when(b != 0, b))
            return F.pow(a, b) if op == "^" else a + b if op == "+" else a - b if op == "-" else a * b
        a, b = self.pair(x.left, x.right)
        return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def _each(self, op: str, x: ir.Bin, ka: str | None, kb: str | None) -> Column:
        """Arithmetic of a list and a number, element by element, or of two lists place by place."""
        do = ELEMENTWISE[op]
        a, b = self(x.left), self(x.right)
        if ka == kb:
            return F.zip_with(a, b, do)
        return F.transform(a, lambda y: do(y, b)) if ka == "list" else F.transform(b, lambda y: do(a, y))

    def _call(self, x: ir.Call) -> Column:
        if is_aggregate(x):
            return self.aggregate(x)
        if x.name in REGISTRY:
            return REGISTRY[x.name](*map(self, x.args))
        if x.name == "length" and len(x.args) == 1 and isinstance(x.args[0], ir.Var) and (hops := self.scope.hops(x.args[0].name)) is not None:
            return F.lit(hops)
        if x.name in ("collect_sub", "count_sub"):
            sub = self.scope.subquery(x.args[0])
            if x.name == "count_sub":
                return sub.select(F.count(F.lit(1)).alias("x")).scalar()
            return sub.select(F.collect_list(F.col(f"`{self.scope.columns(sub)[0]}`")).alias("x")).scalar()
        if x.name in FUNCTIONS:
            return FUNCTIONS[x.name](self, x.args)
        if x.name not in PLAIN:
            raise ValueError(f"no function {x.name}; register() makes one known")
        return F.call_function(x.name, *map(self, x.args))

    def aggregate(self, x: ir.Call) -> Column:
        arg = x.args[0] if x.args else ir.Star()
        if x.name == "count":
            if isinstance(arg, ir.Star):
                return F.count(F.lit(1))
            return F.count_distinct(self(arg)) if x.distinct else F.count(self(arg))
        c = self(arg)
        if x.name == "sum":
            if self.kind(arg) == "bool":
                c = c.cast("long")
            out = F.sum_distinct(c) if x.distinct else F.sum(c)
            return F.coalesce(out, F.lit(0)) if self.mode == "cypher" else out
        if x.name in ("collect", "collect_list"):
            return F.collect_set(c) if x.distinct else F.collect_list(c)
        if x.name == "group_concat":
            sep = x.args[1] if len(x.args) > 1 else ir.Lit(",")
            return F.array_join(F.sort_array(F.collect_set(c.cast("string")) if x.distinct else F.collect_list(c.cast("string"))), sep.value)
        return {"avg": F.avg, "min": F.min, "max": F.max, "stdev": F.stddev}[x.name](c)


def ordered(c: Column, k: ir.Key) -> Column:
    first = k.ascending if k.nulls_first is None else k.nulls_first
    if k.ascending:
        return c.asc_nulls_first() if first else c.asc_nulls_last()
    return c.desc_nulls_first() if first else c.desc_nulls_last()


def _stamp(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(c.cast("string"), "Z$", "")).cast("timestamp_ntz")


def _datetime(k: Compiler, a: tuple) -> Column:
    if not a:
        return F.localtimestamp()
    if k.kind(a[0]) in ("date", "datetime"):
        return k(a[0]).cast("timestamp_ntz")
    if len(a) > 1:
        return F.try_to_timestamp(k(a[0]), F.lit(date_pattern(a[1].value))).cast("timestamp_ntz")
    return F.localtimestamp() if a[0] == ir.Lit("now") else _stamp(k(a[0]))


def _date(k: Compiler, a: tuple) -> Column:
    if not a:
        return F.current_date() if k.dialect == "gql" else F.localtimestamp()
    c = k(a[0]) if k.kind(a[0]) in ("date", "datetime") else _stamp(k(a[0]))
    return c.cast("date") if k.dialect == "gql" else F.date_trunc("day", c).cast("timestamp_ntz")


#: Short names of time units.
UNITS = {
    "y": "YEAR", "yy": "YEAR", "yyyy": "YEAR", "years": "YEAR", "mon": "MONTH", "mons": "MONTH", "mm": "MONTH", "months": "MONTH", "w": "WEEK", "weeks": "WEEK",
    "d": "DAY", "dd": "DAY", "days": "DAY", "h": "HOUR", "hh": "HOUR", "hours": "HOUR", "m": "MINUTE", "mi": "MINUTE", "minutes": "MINUTE", "s": "SECOND", "ss": "SECOND", "seconds": "SECOND",
}


def _unit(x) -> str:
    name = str(x.value if isinstance(x, ir.Lit) else x.name)
    return UNITS.get(name.lower(), name.upper())


def _moment(k: Compiler, x) -> Column:
    return k(x).cast("timestamp_ntz") if k.kind(x) in ("date", "datetime") else _stamp(k(x))


def _substring(k: Compiler, a: tuple) -> Column:
    # The text of queries counts from 0 (template form).
    s, start = k(a[0]).cast("string"), k(a[1])
    if len(a) == 2:
        return F.substring(s, (start + 1).cast("int"), F.length(s))
    return F.substring(s, (start + 1).cast("int"), k(a[2]).cast("int"))


def _length(k: Compiler, a: tuple) -> Column:
    return F.size(k(a[0])).cast("long") if k.kind(a[0]) == "list" else F.length(k(a[0]).cast("string")).cast("long")


def _text(k: Compiler, x) -> Column:
    return k(x).cast("string")


FUNCTIONS: dict[str, Callable[[Compiler, tuple], Column]] = {
    "toboolean": lambda k, a: k(a[0]).try_cast("boolean"),
    "abs": lambda k, a: F.abs(k(a[0])),
    "sqrt": lambda k, a: F.sqrt(k(a[0])),
    "round": lambda k, a: F.round(k(a[0]), a[1].value if len(a) > 1 else 0),
    "length": _length, "len": _length, "size": _length, "char_length": _length, "character_length": _length,
    "lower": lambda k, a: F.lower(k(a[0])), "lcase": lambda k, a: F.lower(k(a[0])), "tolower": lambda k, a: F.lower(k(a[0])),
    "upper": lambda k, a: F.upper(k(a[0])), "ucase": lambda k, a: F.upper(k(a[0])), "toupper": lambda k, a: F.upper(k(a[0])),
    "trim": lambda k, a: F.trim(k(a[0])), "ltrim": lambda k, a: F.ltrim(k(a[0])), "rtrim": lambda k, a: F.rtrim(k(a[0])),
    "trim_both": lambda k, a: F.btrim(_text(k, a[0]), k(a[1])),
    "trim_leading": lambda k, a: F.ltrim(_text(k, a[0]), k(a[1])),
    "trim_trailing": lambda k, a: F.rtrim(_text(k, a[0]), k(a[1])),
    "substring": _substring,
    "substr": lambda k, a: sql_substring(_text(k, a[0]), k(a[1]), k(a[2]) if len(a) > 2 else None, k.compat),
    "left": lambda k, a: F.substring(_text(k, a[0]), 1, k(a[1]).cast("int")),
    "right": lambda k, a: sql_substring(_text(k, a[0]), -k(a[1])),
    # indexOf counts from 0 and gives -1 where nothing is found.
    "apoc.text.indexof": lambda k, a: (F.locate(a[1].value, _text(k, a[0])) - 1).cast("long") if isinstance(a[1], ir.Lit) else (F.position(k(a[1]), _text(k, a[0])) - 1).cast("long"),
    "instr": lambda k, a: F.position(k(a[1]), _text(k, a[0])).cast("long"),
    "replace": lambda k, a: F.replace(_text(k, a[0]), k(a[1]), k(a[2])),
    "contains": lambda k, a: k(a[0]).contains(k(a[1])),
    "starts_with": lambda k, a: k(a[0]).startswith(k(a[1])),
    "ends_with": lambda k, a: k(a[0]).endswith(k(a[1])),
    "regexp_like": lambda k, a: k(ir.Bin("=~", a[0], a[1])),
    "like": lambda k, a: F.ilike(_text(k, a[0]), k(a[1])) if k.dialect == "cypher" else F.like(_text(k, a[0]), k(a[1])),
    "coalesce": lambda k, a: F.coalesce(*map(k, a)),
    "nullif": lambda k, a: F.nullif(k(a[0]), k(a[1])),
    "if": lambda k, a: F.when(k.boolean(a[0]), k(a[1])).otherwise(k(a[2]) if len(a) > 2 else F.lit(None)),
    "iif": lambda k, a: FUNCTIONS["if"](k, a),
    "max": lambda k, a: F.greatest(*map(k, a)), "min": lambda k, a: F.least(*map(k, a)),
    "greatest": lambda k, a: F.greatest(*map(k, a)), "least": lambda k, a: F.least(*map(k, a)),
    "localdatetime": _datetime, "local_datetime": _datetime, "datetime": _datetime,
    "localdatetime.realtime": lambda k, a: F.localtimestamp(), "current_timestamp": lambda k, a: F.localtimestamp(),
    "localdatetime.truncate": lambda k, a: F.date_trunc(a[0].value, k(a[1]) if k.kind(a[1]) in ("date", "datetime") else _stamp(k(a[1]))).cast("timestamp_ntz"),
    "date": _date,
    "apoc.temporal.format": lambda k, a: F.date_format(k(a[0]), a[1].value),
    "strftime": lambda k, a: F.date_format(k(a[1]), date_pattern(a[0].value)),
    "duration.between": lambda k, a: k(a[1]) - k(a[0]),
    "duration_between": lambda k, a: k(a[1]) - k(a[0]),
    "datediff": lambda k, a: F.datediff(k(a[0]), k(a[1])).cast("long"),
    "timestampdiff": lambda k, a: F.timestamp_diff(_unit(a[0]), _moment(k, a[1]), _moment(k, a[2])),
    "time": lambda k, a: F.date_format(_datetime(k, a), "HH:mm:ss"),
    "julianday": lambda k, a: F.unix_micros(_datetime(k, a).cast("timestamp")) / 86400e6 + 2440587.5,
    "div": lambda k, a: divide(k(a[0]), k(a[1]), True),
    "sort": lambda k, a: F.sort_array(k(a[0])),
    "join": lambda k, a: F.array_join(k(a[0]).cast("array<string>"), a[1].value),
    "numeric_similarity": lambda k, a: numeric_similarity([(k(x), k(y), float(r.value)) for x, y, r in zip(a[::3], a[1::3], a[2::3], strict=True)]),
    "week": lambda k, a: F.weekofyear(k(a[0])),
    "year": lambda k, a: F.year(k(a[0])).cast("long"),
    "cosine": lambda k, a: cosine(k(a[0]), k(a[1])),
    "id": lambda k, a: k(a[0]), "elementid": lambda k, a: k(a[0]).cast("string"),
    "type": lambda k, a: k.scope.type_of(a[0].name), "labels": lambda k, a: F.array(k.scope.type_of(a[0].name)),
}
