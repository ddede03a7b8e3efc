"""Window functions over all rows against a plain computation."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators.ordered import Over, collected, numbered, over_all
from quillgraph.queries import QUERIES


def rows_of(seed, n, kinds, nulls=True):
    rng = random.Random(seed)
    key = lambda: None if nulls and rng.random() < 0.1 else rng.randrange(kinds)
    return [(i, key(), None if rng.random() < 0.2 else rng.randrange(-50, 50)) for i in range(n)]


def plain(rows):
    """id -> rank, dense rank, running sum and minimum with peers, by key with nulls first."""
    order = lambda r: (r[1] is not None, r[1] or 0)
    keys = sorted({order(r) for r in rows})
    out = {}
    for r in rows:
        seen = [x[2] for x in rows if order(x) <= order(r) and x[2] is not None]
        before = sum(order(x) < order(r) for x in rows)
        out[r[0]] = (before + 1, keys.index(order(r)) + 1, sum(seen) if seen else None, min(seen) if seen else None, len(seen))
    return out


@pytest.mark.parametrize(("n", "kinds"), [(0, 1), (1, 1), (40, 1), (200, 7), (200, 400)])
def test_ranks_and_running_values(spark, n, kinds):
    rows = rows_of(n + kinds, n, kinds)
    df = spark.createDataFrame(rows, "id int, k int, v int").repartition(3)
    calls = {"r": Over("rank"), "d": Over("dense_rank"), "s": Over("sum", F.col("v")), "m": Over("min", F.col("v")), "c": Over("count", F.col("v"))}
    got = {r.id: tuple(r)[3:] for r in over_all(df, [F.asc("k")], calls).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("step", [1, 3, 150])
def test_neighbours_across_partitions(spark, step):
    rows = [(i, (i * 37) % 101 if i % 9 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(5)
    calls = {"b": Over("lag", F.col("v"), step), "f": Over("lead", F.col("v"), step), "n": Over("row_number")}
    value = dict(rows)
    for r in over_all(df, [F.desc("id")], calls).collect():
        assert (r.b, r.f, r.n) == (value.get(r.id + step), value.get(r.id - step), 100 - r.id)


def test_without_an_order_rows_are_peers(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    calls = {"s": Over("sum", F.col("id")), "r": Over("rank"), "n": Over("row_number")}
    got = over_all(df, [], calls).collect()
    assert sorted(r.n for r in got) == [1, 2, 3] and {(r.s, r.r) for r in got} == {(6, 1)}


def test_one_key_of_all_rows_is_numbered_in_many_tasks(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), "id")
    out = numbered(df, [F.asc("k")], "n")
    assert sorted(r.n for r in out.collect()) == list(range(1, 5001))


@pytest.mark.parametrize("name", ["rank_global", "running_sum_global", "lag_global"])
def test_no_task_takes_all_rows(name, spark, sf):
    text = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text


def test_groups_are_collected_in_chunks(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None]), rng.randrange(300), i) for i in range(3000)] + [("c", 1, 9000)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(6)
    got = {}
    for r in collected(df, ["g"], [F.desc("o"), F.asc("v")], F.col("v"), 70).collect():
        assert r.n == len(r["values"])
        got.setdefault(r.g, {})[r.chunk] = r["values"]
    for g in ("a", "b", "c", None):
        want = [v for _, v in sorted((-o, v) for x, o, v in rows if x == g)]
        assert [got[g][k] for k in range(len(got[g]))] == [want[i : i + 70] for i in range(0, len(want), 70)]
    assert collected(df.limit(0), ["g"], [F.asc("o")], F.col("v")).count() == 0
