"""Queries built by calls, against SQL on the smallest tables."""

import datetime

import duckdb
import pytest

from quillgraph.plans import ir
from quillgraph.plans.build import (
    alias, and_, array, case, cast, col, column, except_, exists, false, from_, func, identifier, intersect, lit, not_, null, or_, over, param, paren, select, star, table, true,
    union, values, var, xor,
)
from quillgraph.plans.engine import Engine
from quillgraph.plans.parser import parse
from quillgraph.plans.rel2graph import Edge
from quillgraph.plans.render import render
from quillgraph.sources.fixtures import star_graph

EDGES = [
    Edge("PLACED", "Customer", "Orders", ("c_custkey",), ("o_custkey",)), Edge("CUSTOMER_IN", "Customer", "Nation", ("c_nationkey",), ("n_nationkey",)),
    Edge("SUPPLIER_IN", "Supplier", "Nation", ("s_nationkey",), ("n_nationkey",)), Edge("IN_REGION", "Nation", "Region", ("n_regionkey",), ("r_regionkey",)),
    Edge("CONTAINS", "Orders", "Part", ("o_orderkey",), ("p_partkey",), "lineitem", ("l_orderkey",), ("l_partkey",)),
    Edge("FULFILLED_BY", "Orders", "Supplier", ("o_orderkey",), ("s_suppkey",), "lineitem", ("l_orderkey",), ("l_suppkey",)),
]
C, N, O, R, S = table("Customer", "c"), table("Nation", "n"), table("Orders", "o"), table("Region", "r"), table("Supplier", "s")
IN, OF, AT = col("c.c_nationkey") == col("n.n_nationkey"), col("c.c_custkey") == col("o.o_custkey"), col("n.n_regionkey") == col("r.r_regionkey")
COUNT = func("count", star())
NAMES = select(col("n.n_regionkey").as_("k")).from_(N)

CASES = {
    "where": (select("c.c_custkey").from_(C).where(col("c.c_acctbal") > 5000, col("c.c_nationkey").isin(1, 2, 3)), "SELECT c_custkey FROM customer WHERE c_acctbal>5000 AND c_nationkey IN (1,2,3)"),
    "join_group_having": (
        select(col("n.n_name").as_("nation"), COUNT.as_("k")).from_(C).join(N, IN).where(col("c.c_acctbal") > 0).group_by(col("n.n_name")).having(func("max", col("c.c_acctbal")) > 9000).order_by(col("k").desc(), col("nation")).limit(5),
        "SELECT n_name AS nation, count(*) AS k FROM customer JOIN nation ON n_nationkey=c_nationkey WHERE c_acctbal>0 GROUP BY 1 HAVING max(c_acctbal)>9000 ORDER BY 2 DESC, 1 LIMIT 5",
    ),
    "having_of_returned": (select(col("c.c_nationkey").as_("n"), COUNT.as_("k")).from_(C).group_by("c.c_nationkey").having(COUNT > 6), "SELECT c_nationkey AS n, count(*) AS k FROM customer GROUP BY 1 HAVING count(*)>6"),
    "left": (select(col("c.c_custkey").as_("c"), col("o.o_orderkey").as_("o")).from_(C).join(O, and_(OF, col("o.o_totalprice") > 400000), "left"), "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey=o_custkey AND o_totalprice>400000"),
    "left_then_inner": (
        select(col("c.c_custkey").as_("c"), col("o.o_orderkey").as_("o"), col("n.n_name").as_("n")).from_(C).join(O, and_(OF, col("o.o_totalprice") > 400000), "left").join(N, IN),
        "SELECT c_custkey AS c, o_orderkey AS o, n_name AS n FROM customer LEFT JOIN orders ON c_custkey=o_custkey AND o_totalprice>400000 JOIN nation ON c_nationkey=n_nationkey",
    ),
    "inner_on_the_optional": (
        select(col("n.n_name").as_("n"), col("s.s_suppkey").as_("s"), col("c.c_custkey").as_("c")).from_(N).join(S, and_(col("s.s_nationkey") == col("n.n_nationkey"), col("s.s_acctbal") > 0), "left").join(C, col("c.c_custkey") == col("s.s_suppkey")),
        "SELECT n_name AS n, s_suppkey AS s, c_custkey AS c FROM nation LEFT JOIN supplier ON s_nationkey=n_nationkey AND s_acctbal>0 JOIN customer ON c_custkey=s_suppkey",
    ),
    "left_then_right": (
        select(col("n.n_name").as_("n"), col("c.c_custkey").as_("c"), col("o.o_orderkey").as_("o")).from_(C).join(O, and_(OF, col("o.o_totalprice") > 400000), "left").join(N, and_(IN, col("c.c_acctbal") > 5000), "right"),
        "SELECT n_name AS n, c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey=o_custkey AND o_totalprice>400000 RIGHT JOIN nation ON c_nationkey=n_nationkey AND c_acctbal>5000",
    ),
    "semi": (select("c.c_custkey").from_(C).join(O, and_(OF, col("o.o_totalprice") > 300000), "semi"), "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey=o_custkey AND o_totalprice>300000"),
    "anti": (select("c.c_custkey").from_(C).join(O, and_(OF, col("o.o_totalprice") > col("c.c_acctbal") + 400000), "anti"), "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey=o_custkey AND o_totalprice>c_acctbal+400000"),
    "full": (
        select(col("s.s_suppkey").as_("s"), col("n.n_name").as_("n")).from_(S).join(N, and_(col("s.s_nationkey") == col("n.n_nationkey"), col("s.s_acctbal") > 5000), "full"),
        "SELECT s_suppkey AS s, n_name AS n FROM supplier FULL JOIN nation ON s_nationkey=n_nationkey AND s_acctbal>5000",
    ),
    "through_a_join_table": (
        select(col("o.o_orderkey").as_("o"), col("p.p_partkey").as_("p"), col("l.l_quantity").as_("q")).from_(O).join(table("lineitem", "l"), col("o.o_orderkey") == col("l.l_orderkey")).join(table("Part", "p"), col("p.p_partkey") == col("l.l_partkey")).where(col("p.p_size") > 40),
        "SELECT o_orderkey AS o, p_partkey AS p, l_quantity AS q FROM orders JOIN lineitem ON o_orderkey=l_orderkey JOIN part ON p_partkey=l_partkey WHERE p_size>40",
    ),
    "half_a_join_table": (select(col("s.s_suppkey").as_("s"), col("l.l_quantity").as_("q")).from_(table("lineitem", "l")).join(S, col("s.s_suppkey") == col("l.l_suppkey")).where(col("l.l_quantity") > 45), "SELECT s_suppkey AS s, l_quantity AS q FROM lineitem JOIN supplier ON s_suppkey=l_suppkey WHERE l_quantity>45"),
    "three_tables": (select(col("r.r_name").as_("r"), COUNT.as_("k")).from_(C).join(N, IN).join(R, AT).group_by("r.r_name"), "SELECT r_name AS r, count(*) AS k FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1"),
    "union": (NAMES.where(col("n.n_regionkey") < 3).union(NAMES.where(col("n.n_regionkey") > 1)).order_by("k").limit(4), "SELECT n_regionkey AS k FROM nation WHERE n_regionkey<3 UNION SELECT n_regionkey FROM nation WHERE n_regionkey>1 ORDER BY 1 LIMIT 4"),
    "union_all": (union(NAMES, NAMES, distinct=False), "SELECT n_regionkey AS k FROM nation UNION ALL SELECT n_regionkey FROM nation"),
    "by_name": (select(col("n.n_name").as_("a"), lit(1).as_("b")).from_(N).union(select(lit(2).as_("b"), col("r.r_name").as_("a")).from_(R), distinct=False, by_name=True), "SELECT n_name AS a, 1 AS b FROM nation UNION ALL BY NAME SELECT 2 AS b, r_name AS a FROM region"),
    "intersect": (intersect(NAMES.where(col("n.n_regionkey") < 3), NAMES.where(col("n.n_regionkey") > 1)), "SELECT 2 AS k"),
    "except": (except_(NAMES, NAMES.where(col("n.n_regionkey") > 1)), "SELECT DISTINCT n_regionkey AS k FROM nation WHERE n_regionkey<=1"),
    "derived": (
        from_(select(col("c.c_nationkey").as_("k"), COUNT.as_("n")).from_(C).group_by("c.c_nationkey").subquery("t")).join(N, None, "cross").select(col("n.n_name").as_("name"), col("t.n").as_("n")).where(col("t.k") == col("n.n_nationkey"), col("t.n") > 5),
        "SELECT n_name AS name, n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) JOIN nation ON k=n_nationkey WHERE n>5",
    ),
    "cte": (
        select(col("n.n_name").as_("name"), col("big.total").as_("total")).with_("rich", select(col("c.c_nationkey").as_("k"), func("round", func("sum", col("c.c_acctbal")), 2).as_("total")).from_(C).group_by("c.c_nationkey")).from_(N).join(table("rich", "big"), col("big.k") == col("n.n_nationkey")),
        "WITH rich AS (SELECT c_nationkey AS k, round(sum(c_acctbal),2) AS total FROM customer GROUP BY 1) SELECT n_name AS name, total FROM nation JOIN rich ON k=n_nationkey",
    ),
    "scalar": (select("c.c_custkey").from_(C).where(col("c.c_acctbal") > select(func("avg", col("x.c_acctbal")).as_("a")).from_(table("Customer", "x"))), "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)"),
    "in_query": (select("c.c_custkey").from_(C).where(col("c.c_nationkey").isin(select(col("n.n_nationkey").as_("k")).from_(N).where(col("n.n_regionkey") == 1))), "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey=1)"),
    "exists": (select("c.c_custkey").from_(C).where(exists(select(lit(1).as_("one")).from_(O).where(col("o.o_custkey") == col("c.c_custkey"), col("o.o_totalprice") > 300000))), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>300000)"),
    "lateral": (
        select(col("n.n_name").as_("n"), col("m.k").as_("k")).from_(N).lateral(select(COUNT.as_("k")).from_(S).where(col("s.s_nationkey") == col("n.n_nationkey")), "m"),
        "SELECT n_name AS n, k FROM nation, LATERAL (SELECT count(*) AS k FROM supplier WHERE s_nationkey=n_nationkey)",
    ),
    "unnest": (select(col("r.r_name").as_("r"), col("u.value").as_("v")).from_(R).unnest(array(1, 2), "u"), "SELECT r_name AS r, unnest([1,2]) AS v FROM region"),
    "case": (
        select(col("c.c_custkey").as_("c"), case().when(col("c.c_acctbal") < 0, "debt").when(col("c.c_acctbal") < 5000, "some").else_("much").as_("w"), case(col("c.c_nationkey")).when(1, "one").as_("o")).from_(C),
        "SELECT c_custkey AS c, CASE WHEN c_acctbal<0 THEN 'debt' WHEN c_acctbal<5000 THEN 'some' ELSE 'much' END AS w, CASE c_nationkey WHEN 1 THEN 'one' END AS o FROM customer",
    ),
    "arithmetic": (
        select(col("n.n_nationkey").as_("n"), (col("n.n_nationkey") // 2).as_("h"), (1 + col("n.n_nationkey") * 2 - 3).as_("s"), (col("n.n_nationkey") % 3).as_("m"), (-col("n.n_nationkey")).as_("g"), (2.0 ** lit(3) if False else col("n.n_regionkey") ** 2).as_("p"), (10 - col("n.n_regionkey")).as_("d")).from_(N),
        "SELECT n_nationkey AS n, CAST(n_nationkey//2 AS BIGINT) AS h, 1+n_nationkey*2-3 AS s, n_nationkey%3 AS m, -n_nationkey AS g, pow(n_regionkey,2) AS p, 10-n_regionkey AS d FROM nation",
    ),
    "logic": (
        select("n.n_name").from_(N).where(or_(not_(col("n.n_regionkey") >= 2), xor(col("n.n_nationkey") > 10, col("n.n_regionkey") == 3)), ~(col("n.n_name") == "PERU") & (paren(col("n.n_nationkey") <= 22) | false()), col("n.n_regionkey").between(0, 3), true()),
        "SELECT n_name FROM nation WHERE (NOT n_regionkey>=2 OR ((n_nationkey>10) <> (n_regionkey=3))) AND n_name<>'PERU' AND n_nationkey<=22 AND n_regionkey BETWEEN 0 AND 3",
    ),
    "texts": (
        select(col("n.n_name").as_("n"), func("lower", col("n.n_name")).as_("l"), cast(col("n.n_nationkey"), "varchar").as_("t"), col("n.n_name").contains("A").as_("a")).from_(N).where(col("n.n_name").rlike(".*[AI].*"), or_(col("n.n_name").like("%A%"), col("n.n_name").ilike("%i%")), col("n.n_name").is_not_null(), col("n.n_name").is_(None) == false()),
        "SELECT n_name AS n, lower(n_name) AS l, CAST(n_nationkey AS VARCHAR) AS t, contains(n_name,'A') AS a FROM nation WHERE regexp_full_match(n_name,'.*[AI].*') AND (n_name ILIKE '%A%' OR n_name ILIKE '%i%')",
    ),
    "windows": (
        select(col("c.c_custkey").as_("c"), func("rank").over([col("c.c_nationkey")], [col("c.c_acctbal").desc()]).as_("r"), over(func("count", star()), "w").as_("k")).from_(C).window("w", [col("c.c_mktsegment")]).qualify(col("r") <= 2),
        "SELECT c_custkey AS c, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS INTEGER) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS k FROM customer QUALIFY r<=2",
    ),
    "rollup": (select(col("o.o_orderstatus").as_("s"), col("o.o_orderpriority").as_("p"), COUNT.as_("k")).from_(O).rollup("o.o_orderstatus", "o.o_orderpriority"), "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS k FROM orders GROUP BY ROLLUP(1,2)"),
    "sets": (select(col("o.o_orderstatus").as_("s"), col("o.o_orderpriority").as_("p"), COUNT.as_("k")).from_(O).grouping_sets(["o.o_orderstatus"], ["o.o_orderpriority"], []), "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS k FROM orders GROUP BY GROUPING SETS ((1),(2),())"),
    "distinct": (select(col("c.c_mktsegment").as_("s")).from_(C).distinct(), "SELECT DISTINCT c_mktsegment AS s FROM customer"),
    "distinct_on": (select(col("o.o_custkey").as_("c"), col("o.o_orderkey").as_("o")).from_(O).distinct("c"), "SELECT o_custkey AS c, min(o_orderkey) AS o FROM orders GROUP BY 1"),
    "offset": (select(col("c.c_custkey").as_("c")).from_(C).order_by("c").offset(3).limit(4), "SELECT c_custkey AS c FROM customer ORDER BY 1 LIMIT 4 OFFSET 3"),
    "values": (values([(1, "a"), (2, None)], ["i", "s"]), "SELECT * FROM (VALUES (1,'a'),(2,NULL)) t(i, s)"),
    "frames": (select(col("c.c_custkey").as_("c")).from_(C).cluster_by("c").sort_by("c").distribute_by("c").hint("rebalance").lock(), "SELECT c_custkey AS c FROM customer"),
    "dates": (select(col("o.o_orderkey").as_("o")).from_(O).where(col("o.o_orderdate") >= datetime.date(1996, 1, 1)), "SELECT o_orderkey AS o FROM orders WHERE o_orderdate >= DATE '1996-01-01'"),
}


@pytest.fixture(scope="module")
def engine(spark, sf):
    return Engine(spark, star_graph(spark, sf))


@pytest.mark.parametrize("name", sorted(CASES))
def test_same_as_sql(name, engine, sf):
    q, sql = CASES[name]
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    df = q.frame(engine, EDGES)
    r = con.sql(sql)
    want = sorted((tuple(plain(x[r.columns.index(c)]) for c in df.columns) for x in r.fetchall()), key=str)
    assert sorted((tuple(map(plain, x)) for x in df.collect()), key=str) == want and want


def test_edges_are_followed():
    text = CASES["through_a_join_table"][0].sql(EDGES)
    assert text == "MATCH (o:Orders)-[l:CONTAINS]->(p:Part) FILTER WHERE p.p_size > 40 RETURN o.o_orderkey AS o, p.p_partkey AS p, l.l_quantity AS q"
    assert "-[:CUSTOMER_IN]->" in CASES["join_group_having"][0].sql(EDGES) and "EXISTS" in CASES["semi"][0].sql(EDGES)


def test_values_names_and_errors(engine):
    assert identifier("a b") == "`a b`" and alias(C, "x").alias == "x" and alias(col("a.b"), "y").alias == "y"
    assert column("b", "a").x == col("a.b").x and var("v").x == ir.Var("v") and null().x == ir.Lit(None) and (col("a.l")[0]).x.name == "element_at"
    with pytest.raises(TypeError):
        bool(col("a.b") == 1)
    with pytest.raises(ValueError):
        and_()
    q = select(col("n.n_name").as_("n")).from_(N).where(col("n.n_regionkey") == param("r"), col("n.n_nationkey").isin(1, 2, 3, 17, 24))
    assert {r.n for r in q.frame(engine, EDGES, {"r": 1}).collect()} == {r.n for r in q.frame(engine, EDGES, {"r": 1}).collect()}
    with pytest.raises(ValueError, match=r"\$r"):
        q.frame(engine, EDGES)
    made = select(col("r.r_name").as_("r")).from_(R).ctas("regions_made")(engine)
    assert made.count() == 5


def test_trees(engine):
    q = parse("MATCH (a:Nation)-[r:IN_REGION]->(b) WHERE a.n_name IN $names AND b.r_name = $one RETURN a.n_name AS n ORDER BY n LIMIT 3")
    assert ir.load(ir.dump(q)) == q and parse(render(q)) == q
    assert [type(x).__name__ for x in list(ir.bfs(q))[:4]] == ["Single", "Match", "Return", "OrderBy"]
    prop = ir.find(q, ir.Prop)
    assert [type(x).__name__ for x in ir.ancestors(q, prop)][:2] == ["Single", "Return"]
    assert {p.name for p in ir.find_all(ir.replaced(q, {ir.Prop("a", "n_name"): ir.Prop("a", "x")}), ir.Prop)} == {"x", "r_name"}
    assert {r.n for r in engine.run(q, {"names": ["PERU", "CHINA"], "one": "ASIA"}).collect()} <= {"CHINA"}
    with pytest.raises(ValueError):
        ir.load('{"is": "os"}')
    assert ir.path_findings(q.clauses[0].paths[0]) == []
    assert len(ir.path_findings(ir.Path(None, (ir.NodePat("a"),), (ir.RelPat("r"), ir.RelPat("r", (), "up"))))) == 3
    named = ir.expanded(ir.Single((ir.CallSub(ir.Var("q")),)), {"q": q})
    assert named.clauses[0].query == q
