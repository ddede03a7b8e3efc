"""Joins on inequalities and on alternatives against a plain double loop."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.expressions import Compiler
from quillgraph.operators import dealt
from quillgraph.operators.ranges import Interval, bins, interval_join
from quillgraph.plans import ir
from quillgraph.plans.rel2graph import join_frames
from quillgraph.queries import QUERIES

SIDES = ["inner", "left", "right", "full", "semi", "anti"]
A, B = "id long, x long, s string", "id long, lo long, hi long, t string"


class Columns:
    """Properties as columns of aliased frames."""

    def __init__(self, kinds):
        self.kinds = kinds

    def prop(self, var, name):
        return F.col(f"{var}.{name}"), self.kinds.get(name, "int")


def rows(seed, n, m, span):
    rng = random.Random(seed)
    some = lambda: None if rng.random() < 0.1 else rng.randrange(span)
    left = [(i, some(), "abcdef"[i % 6]) for i in range(n)]
    right = []
    for i in range(m):
        lo = some()
        right.append((i, lo, None if lo is None or rng.random() < 0.1 else lo + rng.randrange(-1, 4), "abcdef"[i % 5]))
    return left, right


def plain(left, right, test, side):
    pairs = [(a, b) for a in left for b in right if test(a, b)]
    out = Counter()
    if side == "semi":
        return Counter((a[0],) for a in left if any(p[0] is a for p in pairs))
    if side == "anti":
        return Counter((a[0],) for a in left if all(p[0] is not a for p in pairs))
    out.update((a[0], b[0]) for a, b in pairs)
    if side in ("left", "full"):
        out.update((a[0], None) for a in left if all(p[0] is not a for p in pairs))
    if side in ("right", "full"):
        out.update((None, b[0]) for b in right if all(p[1] is not b for p in pairs))
    return out


P = lambda v, c: ir.Prop(v, c)
BETWEEN = ir.Between(P("a", "x"), P("b", "lo"), P("b", "hi"))
CASES = {
    "between": (BETWEEN, lambda a, b: None not in (a[1], b[1], b[2]) and b[1] <= a[1] <= b[2]),
    "turned": (ir.Bin("and", ir.Bin("<", P("b", "lo"), P("a", "x")), ir.Bin("<>", P("a", "s"), P("b", "t"))), lambda a, b: None not in (a[1], b[1]) and b[1] < a[1] and a[2] != b[3]),
    "texts": (ir.Bin(">=", P("a", "s"), P("b", "t")), lambda a, b: a[2] >= b[3]),
}


@pytest.mark.parametrize("case", sorted(CASES))
@pytest.mark.parametrize("side", SIDES)
def test_inequalities(spark, case, side):
    on, test = CASES[case]
    left, right = rows(len(case), 60, 40, 25)
    a, b = spark.createDataFrame(left, A).repartition(3).alias("a"), spark.createDataFrame(right, B).repartition(2).alias("b")
    out = join_frames(a, b, on, side, Compiler(Columns({"s": "string", "t": "string"})))
    assert out.columns == (a.columns if side in ("semi", "anti") else a.columns + b.columns)
    got = Counter(tuple(r[i] for i in ((0,) if side in ("semi", "anti") else (0, 3))) for r in out.collect())
    assert got == plain(left, right, test, side)


@pytest.mark.parametrize("side", SIDES)
def test_empty_sides(spark, side):
    left, right = rows(1, 5, 5, 4)
    on, test = CASES["between"]
    for x, y in ((left, []), ([], right), ([], [])):
        out = join_frames(spark.createDataFrame(x, A).alias("a"), spark.createDataFrame(y, B).alias("b"), on, side, Compiler(Columns({})))
        got = Counter(tuple(r[i] for i in ((0,) if side in ("semi", "anti") else (0, 3))) for r in out.collect())
        assert got == plain(x, y, test, side)


def test_a_value_of_most_points_is_split(spark):
    points = spark.range(4000).select("id", F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("x"))
    bounds, pieces = bins(points, F.col("x"))
    assert max(pieces) > 1 and len(pieces) == len(bounds) + 1
    spans = spark.createDataFrame([(1, 7, 7), (2, 0, 100), (3, 9, 8)], "k long, lo long, hi long")
    on = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
    out = interval_join(points, spans, on, Interval(F.col("x"), (F.col("lo"),), (F.col("hi"),)), True)
    got = {r.k: r["count"] for r in out.groupBy("k").count().collect()}
    ids = [7 if i % 3 else i for i in range(4000)]
    assert got == {1: ids.count(7), 2: sum(x <= 100 for x in ids)}


@pytest.mark.parametrize("side", SIDES)
def test_alternatives(spark, side):
    left, right = rows(9, 40, 30, 12)
    on = ir.Bin("or", ir.Bin("=", P("a", "x"), P("b", "lo")), ir.Bin("=", P("a", "x"), P("b", "hi")))
    test = lambda a, b: a[1] is not None and a[1] in (b[1], b[2])
    out = join_frames(spark.createDataFrame(left, A).alias("a"), spark.createDataFrame(right, B).alias("b"), on, side, Compiler(Columns({})))
    got = Counter(tuple(r[i] for i in ((0,) if side in ("semi", "anti") else (0, 3))) for r in out.collect())
    assert got == plain(left, right, test, side)


NAMES = ["join_between", "join_less_than_pairs", "join_theta", *[f"join_near_{s}" for s in SIDES[1:]], "join_or", *[f"join_or_{s}" for s in ("left_side", "right_side", "full_side", "semi", "anti")]]


@pytest.mark.parametrize("name", NAMES)
def test_no_nested_loops(name, spark, sf):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("side", SIDES)
def test_cells_of_three_rows(spark, side, monkeypatch):
    # Every row five times over, and a residual condition: no cell loses or repeats a pair.
    monkeypatch.setattr(dealt, "CELL", 3)
    on, test = CASES["turned"]
    left, right = rows(4, 20, 12, 6)
    left, right = left * 5, right * 3
    out = join_frames(spark.createDataFrame(left, A).alias("a"), spark.createDataFrame(right, B).alias("b"), on, side, Compiler(Columns({"s": "string", "t": "string"})))
    got = Counter(tuple(r[i] for i in ((0,) if side in ("semi", "anti") else (0, 3))) for r in out.collect())
    met = lambda a, b: test(a, b)
    pairs = Counter((a[0], b[0]) for a in left for b in right if met(a, b))
    lone = [a[0] for a in left if not any(met(a, b) for b in right)]
    far = [b[0] for b in right if not any(met(a, b) for a in left)]
    want = {"semi": Counter((a[0],) for a in left if any(met(a, b) for b in right)), "anti": Counter((x,) for x in lone)}.get(side, pairs)
    want = want + Counter((x, None) for x in lone if side in ("left", "full")) + Counter((None, x) for x in far if side in ("right", "full"))
    assert got == want


def most_pairs_of_a_task(df):
    n = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(n), sum(n)


LESS = ir.Bin("<", P("a", "lo"), P("b", "hi"))
EITHER = ir.Bin("or", ir.Bin("=", P("a", "lo"), P("b", "lo")), ir.Bin("=", P("a", "hi"), P("b", "lo")))


@pytest.mark.parametrize("on", [BETWEEN, LESS, EITHER], ids=["between", "less", "either"])
def test_pairs_are_dealt_to_many_tasks(spark, on, monkeypatch):
    # A few KB make 90,000 pairs of one value, which bytes would put into one task.
    monkeypatch.setattr(dealt, "CELL", 20)
    df = spark.createDataFrame([(i, 5, 5, 6) for i in range(300)], "id long, x long, lo long, hi long")
    most, total = most_pairs_of_a_task(join_frames(df.alias("a"), df.alias("b"), on, "inner", Compiler(Columns({}))).select("a.id", "b.x"))
    assert total == 90_000 and most < total / 10


@pytest.mark.parametrize("side", ["semi", "anti"])
def test_existence_makes_no_pairs(spark, side):
    df = spark.range(300).selectExpr("id", "5L AS x", "5L AS lo", "6L AS hi")
    turned = ir.Between(P("b", "x"), P("a", "lo"), P("a", "hi"))
    out = join_frames(df.alias("a"), df.alias("b"), turned, side, Compiler(Columns({})))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "Join Inner" not in plan and out.count() == (300 if side == "semi" else 0)
