"""Semantics on hand-made graphs, nulls included."""

import pytest
from pyspark.sql import functions as F

from quillgraph.catalog import EdgeTable, ForeignKey, NodeTable, PropertyGraph, numbered_labels, validate_catalog
from quillgraph.evaluation import execution_accuracy, filtered, remaining, results_equal, validate
from quillgraph.functions.expressions import register
from quillgraph.plans.engine import Engine
from quillgraph.sources import ingest


@pytest.fixture(scope="module")
def graph(spark):
    people = spark.createDataFrame([(1, "Ann", 30), (2, "bob", None), (3, None, 7), (4, "a%b", 0)], "id long, name string, age long")
    knows = spark.createDataFrame([(10, 1, 2, 1.5), (11, 2, 3, None), (12, 3, 1, 2.0), (13, 4, 4, 0.0)], "e long, s long, t long, w double")
    return PropertyGraph().add(NodeTable("Person", people, "id"), EdgeTable("KNOWS", "Person", "Person", knows, "s", "t", "e", ("w",)))


@pytest.fixture(scope="module")
def run(spark, graph):
    def rows(text, params=None, **kw):
        df = Engine(spark, graph, **kw).query(text, params=params)
        return sorted((tuple(r) for r in df.collect()), key=str)

    return rows


def test_trail_and_walk(run):
    two = "MATCH (a:Person)-[r:KNOWS]->(b)-[q:KNOWS]->(c) RETURN a.id AS a, c.id AS c"
    assert run(two) == [(1, 3), (2, 1), (3, 2)]
    assert run(two, match_mode="walk") == [(1, 3), (2, 1), (3, 2), (4, 4)]


def test_cycle_closes(run):
    assert run("MATCH (a:Person)-[:KNOWS]->(b)-[:KNOWS]->(c)-[:KNOWS]->(a) RETURN a.id AS a") == [(1,), (2,), (3,)]
    assert run("MATCH (a:Person)-[:KNOWS]->(a) RETURN a.id AS a") == [(4,)]


def test_undirected_meets_a_loop_once(run):
    assert run("MATCH (a:Person)-[:KNOWS]-(b) WHERE a.id = 4 RETURN b.id AS b") == [(4,)]
    assert run("MATCH (a:Person)-[:KNOWS]-(b) WHERE a.id = 1 RETURN b.id AS b") == [(2,), (3,)]


def test_where_belongs_to_its_optional_match(run):
    assert run("MATCH (a:Person) OPTIONAL MATCH (a)-[r:KNOWS]->(b) WHERE b.age > 5 RETURN a.id AS a, b.id AS b") == [(1, None), (2, 3), (3, 1), (4, None)]
    assert run("MATCH (a:Person) OPTIONAL MATCH (a)-[r:KNOWS]->(b) WITH a, b WHERE b.age > 5 RETURN a.id AS a") == [(2,), (3,)]


def test_nulls_in_conditions(run):
    assert run("MATCH (a:Person) WHERE a.age > 1 OR a.age IS NULL RETURN a.id AS a") == [(1,), (2,), (3,)]
    assert run("MATCH (a:Person) WHERE NOT a.age IN [7, null] RETURN a.id AS a") == []
    assert run("MATCH (a:Person) RETURN count(a.age) AS n, count(*) AS m, sum(a.age) AS s") == [(3, 4, 37)]
    assert run("MATCH (a:Person) WHERE a.id > 99 RETURN sum(a.age) AS s", mode="cypher") == [(0,)]


def test_not_in_with_a_null_inside(run):
    assert run("MATCH (a:Person) WHERE NOT a.age IN COLLECT { MATCH (b:Person) WHERE b.id = 2 RETURN b.age AS x } RETURN a.id AS a") == []


def test_exists_with_an_outer_property(run):
    assert run("MATCH (a:Person) WHERE EXISTS { MATCH (a)-[:KNOWS]->(b) WHERE b.id > a.id } RETURN a.id AS a") == [(1,), (2,)]
    assert run("MATCH (a:Person) WHERE NOT EXISTS { MATCH (b:Person) WHERE b.age < a.age } RETURN a.id AS a") == [(2,), (4,)]


def test_correlated_scalar_subqueries(run):
    assert run("MATCH (a:Person) RETURN a.id AS a, VALUE { MATCH (a)-[:KNOWS]->(b) WHERE b.id <> 4 RETURN count(b) AS n } AS n") == [(1, 1), (2, 1), (3, 1), (4, 0)]
    assert run("MATCH (a:Person) RETURN a.id AS a, VALUE { MATCH (b:Person) WHERE b.age = a.age RETURN max(b.name) AS n } AS n") == [(1, "Ann"), (2, None), (3, None), (4, "a%b")]
    assert run("MATCH (a:Person) WHERE VALUE { MATCH (a)-[:KNOWS]->(b) RETURN sum(b.age) AS s } = 7 RETURN a.id AS a") == [(2,)]
    assert run("MATCH (a:Person) RETURN a.id AS a, COUNT { MATCH (b:Person) WHERE b.id < a.id RETURN b } AS n") == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert run("MATCH (a:Person) WHERE a.id = 1 RETURN VALUE { MATCH (a)-[:KNOWS]->(b) WITH b.age AS g, b.id AS i WHERE i > 0 RETURN max(i) AS m } AS m") == [(2,)]


def test_count_blocks_look_at_the_row_around(run):
    assert run("MATCH (a:Person) RETURN a.id AS i, COUNT { MATCH (a)-[:KNOWS]->(b) } AS n") == [(1, 1), (2, 1), (3, 1), (4, 1)]
    assert run("MATCH (a:Person) RETURN a.id AS i, COUNT { MATCH (a)-[:KNOWS]->(b) WHERE b.age > 5 } AS n") == [(1, 0), (2, 1), (3, 1), (4, 0)]
    assert run("MATCH (a:Person) WHERE COUNT { MATCH (b:Person) WHERE b.id < a.id } = 2 RETURN a.id AS i") == [(3,)]
    assert run("MATCH (a:Person) RETURN sum(COUNT { MATCH (b:Person) WHERE b.id < a.id RETURN DISTINCT b.age > 8 AS o }) AS n") == [(6,)]
    assert run("MATCH (a:Person) WITH a, COUNT { MATCH (a)-[:KNOWS]->(b) WHERE b.id > a.id } AS n WHERE n = 1 RETURN a.id AS i ORDER BY COUNT { MATCH (a)<-[:KNOWS]-(c) } LIMIT 5") == [(1,), (2,)]


def test_subqueries_run_once_for_all_rows_around(run):
    value = lambda text: run(f"MATCH (a:Person) RETURN a.id AS a, VALUE {{ {text} }} AS v")
    assert value("MATCH (a)-[:KNOWS]->(b) RETURN max(b.id) + a.id AS n") == [(1, 3), (2, 5), (3, 4), (4, 8)]
    assert value("MATCH (b:Person) WHERE b.id < a.id RETURN count(b) + a.id AS n") == [(1, 1), (2, 3), (3, 5), (4, 7)]
    assert value("MATCH (b:Person) WHERE b.id < a.id RETURN max(b.id) + count(*) AS n") == [(1, None), (2, 2), (3, 4), (4, 6)]
    assert value("MATCH (a)-[:KNOWS]->(b) WITH b MATCH (b)-[:KNOWS]->(c) RETURN count(c) AS n") == [(1, 1), (2, 1), (3, 1), (4, 1)]
    assert value("MATCH (a)-[:KNOWS]->(b) WHERE b.id > a.id WITH count(b) AS k RETURN k * 10 AS n") == [(1, 10), (2, 10), (3, 0), (4, 0)]
    assert value("MATCH (b:Person) WHERE b.id <> a.id RETURN b.name AS n ORDER BY b.id DESC LIMIT 1") == [(1, "a%b"), (2, "a%b"), (3, "a%b"), (4, None)]
    assert value("MATCH (b:Person) WHERE b.id >= a.id WITH b.age > 8 AS o, count(*) AS k RETURN max(k) AS n") == [(1, 2), (2, 2), (3, 2), (4, 1)]
    assert value("MATCH (a)-[:KNOWS]->(b) RETURN b.id AS n") == [(1, 2), (2, 3), (3, 1), (4, 4)]
    assert value("OPTIONAL MATCH (a)-[:KNOWS]->(b) WHERE b.id > a.id RETURN b.id AS n") == [(1, 2), (2, 3), (3, None), (4, None)]
    assert value("MATCH (a)-[:KNOWS]->(b) RETURN b.id + VALUE { MATCH (c:Person) WHERE c.id < b.id AND c.id <> a.id RETURN count(c) + b.id AS m } AS n") == [(1, 4), (2, 7), (3, 2), (4, 11)]
    assert run("MATCH (a:Person) RETURN a.id AS a, COLLECT { MATCH (b:Person) WHERE b.id > a.id RETURN b.id ORDER BY b.id LIMIT 1 } AS v") == [(1, [2]), (2, [3]), (3, [4]), (4, [])]
    assert run("MATCH (a:Person) OPTIONAL MATCH (a)-[:KNOWS]->(b) WHERE b.id > a.id RETURN a.id AS a, COUNT { MATCH (b)-[:KNOWS]->(c) RETURN DISTINCT c.id AS c } AS n") == [(1, 1), (2, 1), (3, 0), (4, 0)]
    with pytest.raises(Exception, match="more than one row"):
        value("MATCH (b:Person) WHERE b.id > a.id RETURN b.id AS n")


def test_optional_match_with_a_subquery_on_both_sides(run):
    text = "MATCH (a:Person) OPTIONAL MATCH (a)-[:KNOWS]->(b) WHERE {} RETURN a.id AS a, b.id AS b"
    assert run(text.format("EXISTS { MATCH (b)-[:KNOWS]->(c) WHERE c.id > a.id }")) == [(1, 2), (2, None), (3, None), (4, None)]
    assert run(text.format("NOT EXISTS { MATCH (b)-[:KNOWS]->(c) WHERE c.id > a.id }")) == [(1, None), (2, 3), (3, 1), (4, 4)]
    assert run(text.format("b.age IN COLLECT { MATCH (c:Person) WHERE c.id = 3 RETURN c.age AS g }")) == [(1, None), (2, 3), (3, None), (4, None)]


def test_lists_of_several_classes(run):
    assert run("MATCH (a:Person) WHERE a.name IN ['Ann', 1] RETURN a.id AS a") == [(1,)]
    assert run("MATCH (a:Person) WHERE a.age IN ['7', 30, 0.0] RETURN a.id AS a") == [(1,), (3,), (4,)]
    assert run("MATCH (a:Person) WHERE NOT a.name IN ['Ann', 1] RETURN a.id AS a") == []  # whether 'bob' is 1 is unknown
    assert run("MATCH (a:Person) WHERE a.id IN $ids RETURN a.id AS a", params={"ids": [1, 4]}) == [(1,), (4,)]


def test_unwind_windows_and_group_sets(run):
    assert run("UNWIND [1, 2] AS x MATCH (a:Person) WHERE a.id = x RETURN x, a.name AS n") == [(1, "Ann"), (2, "bob")]
    named = run("MATCH (a:Person) RETURN a.id AS a, count(*) OVER w AS n, row_number() OVER (ORDER BY a.id) AS r WINDOW w AS () QUALIFY r > 2")
    assert named == [(3, 4, 3), (4, 4, 4)]
    assert run("MATCH (a:Person) RETURN a.id > 2 AS k, count(*) AS n GROUP BY ROLLUP (a.id > 2)") == [(False, 2), (None, 4), (True, 2)]
    assert run("MATCH (a:Person) RETURN a.id AS x UNION ALL BY NAME MATCH (a:Person) WHERE a.id = 1 RETURN a.age AS y, a.id AS x") == [(1, 30), (1, None), (2, None), (3, None), (4, None)]
    with pytest.raises(ValueError, match="no window"):
        run("MATCH (a:Person) RETURN count(*) OVER w AS n")


def test_functions_of_time_and_unknown_names(run):
    text = "MATCH (a:Person) WHERE a.id = 1 RETURN {} AS x"
    assert run(text.format("timestampdiff('hh', localdatetime('2020-01-01'), localdatetime('2020-01-02T03:30:00'))")) == [(27,)]
    assert run(text.format("timestampdiff(MONTH, '2020-01-31', '2020-03-01')")) == [(1,)]
    assert run(text.format("time('2020-01-02T03:04:05')")) == [("03:04:05",)]
    assert run(text.format("julianday('2000-01-01T12:00:00')")) == [(2451545.0,)]
    assert run(text.format("join(sort([3, 1, 2]), '-')")) == [("1-2-3",)]
    assert run(text.format("upper('x') || initcap('ab')")) == [("XAb",)]
    assert run(text.format("join([1, 2] + [3] + 4, ',') || size([1] + [2])")) == [("1,2,3,42",)]
    assert run(text.format("join([1, 2, 3] * 2 - [0, 1, 2], ',')")) == [("2,3,4",)] and run(text.format("join([4, 9] / 2, ',')")) == [("2.0,4.5",)]
    assert run(text.format("join(2 ^ [1, 3], ',') || join([7, 8] % 5, ',')")) == [("2.0,8.02,3",)] and run(text.format("size([1, 2] - 1) + size([1] + [2])")) == [(4,)]
    assert run(text.format("substr('abcde', 4, -2)")) == [("bc",)] and run(text.format("substr('abcde', 4, -2)"), compat=True) == [("cd",)]
    assert run(text.format("substr('abcde', 0, 2)"), compat=True) == [("",)]
    with pytest.raises(ValueError, match="no function"):
        run(text.format("reflect('java.lang.System', 'exit')"))


def test_threads_share_an_engine(spark, graph):
    from concurrent.futures import ThreadPoolExecutor

    e = Engine(spark, graph)
    texts = [(f"MATCH (a:Person)-[r:KNOWS]->(b) WHERE a.id = {k} RETURN a.name AS n, r.w AS w, date('2020-01-01') AS d", d) for k in (1, 2, 3, 4) for d in ("cypher", "gql")]
    alone = [e.query(t, d).collect() for t, d in texts]
    with ThreadPoolExecutor(8) as pool:
        assert list(pool.map(lambda x: e.query(*x).collect(), texts)) == alone
    assert e.dialect == "cypher"


def test_like_and_regex(run):
    assert run("MATCH (a:Person) WHERE like(a.name, 'A%') RETURN a.id AS a") == [(1,), (4,)]
    assert run("MATCH (a:Person) WHERE like(a.name, 'A%') RETURN a.id AS a", dialect="gql") == [(1,)]
    assert run("MATCH (a:Person) WHERE a.name =~ 'b|An' RETURN a.id AS a") == []


def test_elements_and_paths(run, spark, graph):
    df = Engine(spark, graph).query("MATCH p=(a:Person)-[r:KNOWS]->(b) WHERE a.id = 1 RETURN a, r, LENGTH(p) AS l")
    row = df.first()
    assert (row["a"]["_id"], row["a"]["name"], row["r"]["_src"], row["r"]["w"], row["l"]) == (1, "Ann", 1, 1.5, 1)
    assert run("MATCH (a:Person) RETURN a.nothing AS x LIMIT 1") == [(None,)]


def test_property_order_and_limits(run):
    assert run("MATCH (a:Person) RETURN a.id AS a ORDER BY a.age DESC NULLS LAST SKIP 1 LIMIT 2") == [(3,), (4,)]


def test_registered_function(run):
    register("twice", lambda c: c * 2)
    assert run("MATCH (a:Person) WHERE a.id = 3 RETURN twice(a.age) AS x") == [(14,)]


def test_substring_rules(spark):
    from quillgraph.functions.expressions import sql_substring

    cases = [(2, 3, "bcd"), (-3, 2, "cd"), (0, 3, "ab"), (4, -2, "bc"), (-9, 6, "ab"), (6, 2, ""), (1, 0, ""), (2, None, "bcde"), (-2, None, "de"), (-9, None, "abcde")]
    for start, length, want in cases:
        got = spark.range(1).select(sql_substring(F.lit("abcde"), F.lit(start), None if length is None else F.lit(length)).alias("x")).first()["x"]
        assert got == want, (start, length)


def test_results_equal(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i long, s string")
    b = spark.createDataFrame([(None, 2.0), ("x", 1.0), ("x", 1.0)], "t string, d double")
    assert results_equal(a, b)
    assert not results_equal(a, b.distinct())
    assert not results_equal(a, b, ordered=True)
    assert results_equal(a.limit(0), b.limit(0).select("t"))


def test_accuracy_and_validation(spark, graph):
    e = Engine(spark, graph)
    assert execution_accuracy(e, "MATCH (a:Person) RETURN a.id AS x", "MATCH (b:Person) RETURN b.id AS y").score == 1
    assert execution_accuracy(e, "MATCH (a:Nobody) RETURN a", "MATCH (b:Person) RETURN b.id AS y").score == 0
    assert not validate(e, "MATCH (a:Nobody) RETURN a").valid
    assert [v.result_count for v in filtered(e, ["MATCH (a:Person) RETURN a.id AS a", "MATCH (a:Person) WHERE a.id = 0 RETURN a.id AS a", "nonsense"])] == [4]
    t, d = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(2,), (2,)], "k long")
    assert [r.k for r in remaining(t, d, "k").collect()] == [1]


def test_join_tables_are_told_apart():
    keys = {"a": ["id"], "b": ["id"], "ab": ["a_id", "b_id"], "c": ["id"]}
    fks = [ForeignKey("ab", "a", ("a_id",), ("id",)), ForeignKey("ab", "b", ("b_id",), ("id",)), ForeignKey("c", "a", ("x",), ("id",)), ForeignKey("c", "b", ("y",), ("id",))]
    assert ingest.classify_tables(keys, fks) == {"a": "entity", "b": "entity", "ab": "join", "c": "open"}
    assert list(ingest.foreign_by_target(fks)["c"]) == ["a", "b"]
    assert len(ingest.valid_foreign(fks, {"ab": ["a_id", "b_id"], "a": ["id"], "b": ["id"]})) == 2


def test_coercions(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Id,When,N,R,B\n1,2020-01-02,7,1.5,true\n2,bad,NULL,,x\n")
    df = ingest.read_csv_table(spark, f"file://{tmp_path}/t.csv", {"Id": "INTEGER", "When": "DATETIME", "N": "INT", "R": "REAL", "B": "BOOL"})
    a, b = df.orderBy("id").collect()
    assert (a["n"], a["r"], a["b"], a["when"].year) == (7, 1.5, True, 2020)
    assert (b["n"], b["r"], b["b"], b["when"]) == (None, None, None, None)
    with pytest.raises(TypeError):
        ingest.declared_type("GEOMETRY")
    s = spark.createDataFrame([("1", "2.5", "true", "2020-01-01", "x"), (None, "3", None, None, "1")], "i string, f string, b string, d string, s string")
    assert [ingest.infer_property_type(s, c) for c in s.columns] == ["int", "float", "boolean", "datetime", "string"]


def test_json_graph(spark, tmp_path):
    (tmp_path / "g.json").write_text(
        '{"nodes": [{"id": "a", "type": "X", "properties": {"n": 1}}, {"id": "b", "type": "X", "properties": {"m": "z"}}, {"id": "c", "type": "Y", "properties": {}}],'
        ' "relationships": [{"id": "r", "type": "T", "from_node": "a", "to_node": "c", "properties": {"w": 2}}, {"id": "q", "type": "T", "from_node": "a", "to_node": "gone", "properties": {}}]}'
    )
    g = ingest.json_graph(spark, f"file://{tmp_path}/g.json")
    assert sorted(g.nodes) == ["X", "Y"] and sorted(g.nodes["X"].properties) == ["m", "n"]
    assert [tuple(r) for r in Engine(spark, g).query("MATCH (x:X)-[t:T]->(y:Y) RETURN x.n AS n, t.w AS w").collect()] == [(1, 2)]
    assert validate_catalog(g) == []


def test_row_ids_are_unique(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "i long, s string")
    assert ingest.row_ids(df).select("_id").distinct().count() == 3
    assert numbered_labels(["a", "b", "a"]) == ["a_1", "b", "a_2"]


def test_several_labels_meet_by_id(spark, graph):
    staff = spark.createDataFrame([(2, "clerk"), (3, "cook"), (9, "none")], "id long, job string")
    g = PropertyGraph(dict(graph.nodes), dict(graph.edges)).add(NodeTable("Staff", staff, "id"))
    e = Engine(spark, g)
    assert sorted(tuple(r) for r in e.query("MATCH (a:Person:Staff) RETURN a.id AS i, a.job AS j, a.age AS g").collect()) == [(2, "clerk", None), (3, "cook", 7)]
    assert sorted(tuple(r) for r in e.query("MATCH (a@Person@Staff)-[:KNOWS]->(b) RETURN a.job AS j, b.id AS b", "gql").collect()) == [("clerk", 3), ("cook", 1)]


def test_names_and_edges_are_aligned(spark, tmp_path):
    assert [ingest.aligned(x, ["Customer", "orders"]) for x in ("orders", "CUSTOMER", "custmer")] == ["orders", "Customer", "Customer"]
    assert ingest.canonical_edges([("buys", "a", "b"), ("purchases", "a", "b"), ("x", "a", "c")], {"purchases": "buys"}) == [("buys", "a", "b"), ("x", "a", "c")]
    (tmp_path / "p.json").write_text('[{"nl_query": "q", "gql_statement": "MATCH (n) RETURN n", "db_id": "d"}]')
    assert ingest.read_pairs(spark, f"file://{tmp_path}/p.json").first()["gql_dialect"] == "cypher"
