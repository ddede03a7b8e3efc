"""Recursive tables on graphs with cycles."""

import pytest

from quillgraph.catalog import EdgeTable, NodeTable, PropertyGraph
from quillgraph.operators import dealt, recursion
from quillgraph.operators.recursion import MERGED, closure, fixpoint
from quillgraph.plans import engine
from quillgraph.plans.engine import Engine


def reached(edges, starts, most=None):
    """start, node -> depth, breadth first."""
    out = {}
    for s in starts:
        level, depth = {s}, 0
        while level and (most is None or depth <= most):
            out |= {(s, v): depth for v in level}
            level = {b for a, b in edges if a in level} - {v for x, v in out if x == s}
            depth += 1
    return out


LADDER = [e for k in range(25) for e in ((2 * k, 2 * k + 2), (2 * k, 2 * k + 3), (2 * k + 1, 2 * k + 2), (2 * k + 1, 2 * k + 3))] + [(50, 0), (51, 51), (None, 3), (7, None)]


@pytest.mark.parametrize("most", [None, 0, 3])
def test_closure_of_exponentially_many_ways(spark, most):
    # A ladder has 2 ** 25 ways from end to end, and a cycle back.
    e = spark.createDataFrame(LADDER, "_src long, _dst long")
    starts = spark.createDataFrame([(0,), (40,), (51,), (99,)], "node long")
    got = {(r.start, r.node): r.depth for r in closure(e, starts, most).collect()}
    assert got == reached([(a, b) for a, b in LADDER if a is not None], [0, 40, 51, 99], most)


def test_long_chains_are_merged_on_the_way(spark):
    n = 2 * MERGED + 3
    base = spark.createDataFrame([(0, "x")], "n int, s string")
    out = fixpoint(base, lambda f: f.where(f"n < {n}").selectExpr("n + 1L AS n", "s"))
    assert sorted(r.n for r in out.collect()) == list(range(n + 1)) and out.schema == base.schema
    assert fixpoint(base.limit(0), lambda f: f).count() == 0


def test_recursion_in_texts(spark):
    people = spark.createDataFrame([(i,) for i in range(5)], "id long")
    knows = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 4), (1, 0)], "s long, t long")
    e = Engine(spark, PropertyGraph().add(NodeTable("P", people, "id"), EdgeTable("K", "P", "P", knows.selectExpr("*", "s * 10 + t AS e"), "s", "t", "e")))
    run = lambda text: sorted(map(tuple, e.query(text).collect()))
    walk = "WITH RECURSIVE w AS { MATCH (p:P) WHERE p.id IN [0, 3] RETURN p.id AS a, p.id AS b UNION FROM w r MATCH (x:P)-[:K]->(y) WHERE x.id = r.b RETURN r.a, y.id } "
    assert run(walk + "FROM w AS z RETURN z.a AS a, z.b AS b") == [(0, 0), (0, 1), (0, 2), (3, 3), (3, 4)]
    assert run(walk + "FROM w z MATCH (p:P) WHERE p.id = z.b AND z.a = 3 RETURN p.id AS i, count(*) AS n") == [(3, 1), (4, 1)]
    bounded = "WITH RECURSIVE w AS { MATCH (p:P) WHERE p.id = 0 RETURN p.id AS b, 0 AS d UNION ALL FROM w r MATCH (x:P)-[:K]->(y) WHERE x.id = r.b AND r.d < 3 RETURN y.id, r.d + 1 } "
    assert run(bounded + "FROM w z RETURN z.d AS d, count(*) AS n") == [(0, 1), (1, 1), (2, 2), (3, 2)]
    with pytest.raises(KeyError, match="no table"):
        run("FROM nowhere z RETURN z.a AS a")


@pytest.mark.parametrize("both", [True, False])
def test_walks_are_not_stepped_from_every_start(spark, both, monkeypatch):
    # Rounds of a recursion over pairs that lead both ways: none. Cells of two rows deal the one large component to many tasks.
    monkeypatch.setattr(dealt, "CELL", 2)
    monkeypatch.setattr(engine, "fixpoint", None)
    if both:
        monkeypatch.setattr(recursion, "fixpoint", None)
    links = [(i, i + 1) for i in range(30) if i % 10 < 8] + [(40, 40)]
    links += [(b, a) for a, b in links] if both else []
    knows = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(links)], "s long, t long, e long")
    e = Engine(spark, PropertyGraph().add(NodeTable("P", spark.range(60), "id"), EdgeTable("K", "P", "P", knows, "s", "t", "e")))
    text = "WITH RECURSIVE w AS { MATCH (p:P) WHERE p.id % 5 = 0 RETURN p.id AS a, p.id AS b, p.id % 2 AS c UNION FROM w r MATCH (x:P)-[:K]->(y:P) WHERE r.b = x.id" + (" AND y.id <> 1" if not both else "") + " RETURN r.a, y.id, r.c } FROM w z RETURN z.a AS a, z.b AS b, z.c AS c"
    kept = [x for x in links if both or x[1] != 1]
    want = sorted((a, b, a % 2) for a, b in reached(kept, range(0, 60, 5)))
    assert sorted(map(tuple, e.query(text).collect())) == want


#: Steps over what meets in a middle, which pairs of lines they follow, and whether they are the same from both ends.
MIDDLES = [
    ("(a:P)<-[x:HAS]-(o:O)-[y:HAS]->(b:P) WHERE a.p = r.b AND o.h > 1", lambda h, q, s: h > 1, True),
    ("(b:P)<-[y:HAS]-(o:O)-[x:HAS]->(a:P) WHERE x.q < 9 AND o.h > 1 AND y.q < 9 AND r.b = a.p", lambda h, q, s: h > 1 and q < 9 and s < 9, True),
    ("(a:P)<-[x:HAS]-(o:O)-[y:HAS]->(b:P) WHERE a.p = r.b AND y.q < 9", lambda h, q, s: s < 9, False),
    ("(a:P)<-[x:HAS]-(o:O)-[y:HAS]->(b:P) WHERE a.p = r.b AND x.q < y.q", lambda h, q, s: q < s, False),
]


@pytest.mark.parametrize("path, follows, even, null", [(*m, None) for m in MIDDLES] + [(*MIDDLES[0], 7)])
def test_pairs_of_a_middle_are_not_made(spark, path, follows, even, null, monkeypatch):
    # A hub of 20 lines, small middles, nodes of one line alone, of the same value, and of none.
    value = {i: None if i == null else i % 50 for i in range(60)}
    heft = {o: o % 4 for o in range(40)} | {0: 5}
    lines = [(0, i, i % 10) for i in range(20)] + [(o, (o * 3 + j) % 60, (o + j) % 10) for o in range(1, 30) for j in range(1 + o % 3)]
    nodes = spark.createDataFrame(list(value.items()), "id long, p long")
    has = spark.createDataFrame([(*line, k) for k, line in enumerate(lines)], "o long, i long, q long, k long")
    graph = PropertyGraph().add(NodeTable("P", nodes, "id")).add(NodeTable("O", spark.createDataFrame(list(heft.items()), "id long, h long"), "id"))
    e = Engine(spark, graph.add(EdgeTable("HAS", "O", "P", has, "o", "i", "k", ("q",))))
    made, stored = [], recursion.durable
    monkeypatch.setattr(recursion, "durable", lambda df, tag: made.append(tag) or stored(df, tag))
    got = e.query("WITH RECURSIVE w AS { MATCH (p:P) WHERE p.id % 7 = 0 RETURN p.p AS a, p.p AS b UNION FROM w r MATCH " + path + " RETURN r.a, b.p } FROM w z RETURN z.a AS a, z.b AS b").collect()
    hops = {(value[i], value[j]) for x, (o, i, q) in enumerate(lines) for y, (m, j, s) in enumerate(lines) if o == m and x != y and follows(heft[o], q, s)}
    want = reached([(a, b) for a, b in hops if a is not None], [value[i] for i in range(0, 60, 7)])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert ("halves" in made, "hops" in made) == (even, not even or null is not None)
