"""Databases, files, graphs in files, model stubs, and resumed evaluation."""

import sqlite3
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgraph.catalog import EdgeTable, NodeTable, PropertyGraph, register_views
from quillgraph.evaluation import ResultLog, evaluated, results_equal
from quillgraph.functions.expressions import register
from quillgraph.functions.models import Embedder, Labeler, PlainLabeler, TrigramEmbedder, questions
from quillgraph.operators.relational import sample_values, sampled
from quillgraph.plans.engine import Engine
from quillgraph.plans.rel2graph import Edge
from quillgraph.sources import ingest
from quillgraph.synth.schemas import SCHEMAS
from quillgraph.synth.templates import Templates


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = tmp_path_factory.mktemp("db") / "shop.sqlite"
    con = sqlite3.connect(path)
    con.executescript(
        """CREATE TABLE client (id INTEGER PRIMARY KEY, name TEXT, born DATE);
        CREATE TABLE item (sku TEXT, lot INT, price REAL, PRIMARY KEY (sku, lot)) WITHOUT ROWID;
        CREATE TABLE buys (client_id INT REFERENCES client, sku TEXT, lot INT, n INT, PRIMARY KEY (client_id, sku, lot), FOREIGN KEY (sku, lot) REFERENCES item (sku, lot));
        CREATE TABLE note (id INTEGER PRIMARY KEY, client_id INT REFERENCES client (id), body TEXT, broken INT REFERENCES gone (id));"""
    )
    con.executemany("INSERT INTO client VALUES (?, ?, ?)", [(k, f"n{k}", "2000-01-02" if k % 2 else "bad") for k in range(1, 101)])
    con.execute("INSERT INTO client VALUES (500, CAST(? AS TEXT), NULL)", (b"caf\xe9",))
    con.executemany("INSERT INTO item VALUES (?, ?, ?)", [("a", 1, 2.5), ("b", 1, None)])
    con.executemany("INSERT INTO buys VALUES (?, ?, ?, ?)", [(1, "a", 1, 3), (2, "b", 1, 4)])
    con.commit()
    con.close()
    return ingest.sqlite_database(str(path))


def test_database_tells_its_keys(spark, database):
    assert database.tables == ["buys", "client", "item", "note"]
    assert database.keys() == {"buys": ["client_id", "sku", "lot"], "client": ["id"], "item": ["sku", "lot"], "note": ["id"]}
    assert database.kinds() == {"buys": "join", "client": "entity", "item": "entity", "note": "entity"}  # a key to a missing table counts for nothing
    by = {(f.table, f.target): (f.columns, f.target_columns) for f in database.foreign}
    assert by["buys", "client"] == (("client_id",), ("id",)) and by["buys", "item"] == (("sku", "lot"), ("sku", "lot"))
    rows = {(r.table, r.column): (r.type, r.is_key) for r in database.schema(spark).collect()}
    assert rows["client", "born"] == ("timestamp_ntz", False) and rows["item", "lot"] == ("bigint", True) and len(rows) == 14


def test_tables_of_a_database(spark, database):
    df = ingest.read_sqlite_table(spark, database, "client", 7)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("born", "timestamp_ntz")]
    got = {r.id: r for r in df.collect()}
    assert len(got) == 101 and got[1].born.year == 2000 and got[2].born is None and got[500].name == "café"
    assert sorted((r.sku, r.price) for r in ingest.read_sqlite_table(spark, database, "item").collect()) == [("a", 2.5), ("b", None)]
    assert ingest.read_sqlite_table(spark, database, "note").count() == 0


def test_keys_are_discovered_in_data(spark, sf):
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("nation", "region", "customer", "orders")}
    keys = ingest.discovered_keys(t)
    assert "c_custkey" in keys["customer"] and "o_orderkey" in keys["orders"] and "c_mktsegment" not in keys["customer"]
    found = {(f.table, f.columns[0], f.target_columns[0]) for f in ingest.discovered_foreign(t, {k: v[:1] for k, v in keys.items()})}
    assert {("orders", "o_custkey", "c_custkey"), ("customer", "c_nationkey", "n_nationkey"), ("nation", "n_regionkey", "r_regionkey")} <= found
    rows = ingest.table_schema(t, keys).collect()
    assert len(rows) == sum(len(x.columns) for x in t.values()) and any(r.is_key for r in rows)


def test_encodings_are_tried(spark, tmp_path):
    for name, text in (("u", "Id,Name\n1,\u00e9t\u00e9\n".encode()), ("w", "Id,Name\n1,\u20ac\n".encode("cp1252"))):
        (tmp_path / f"{name}.csv").write_bytes(text)
    read = lambda n, **kw: ingest.read_csv_table(spark, f"file://{tmp_path}/{n}.csv", {"Id": "INT"}, **kw).first()["name"]
    assert read("u") == "\u00e9t\u00e9" and read("w") == "\u20ac"
    ingest.write_csv(spark.createDataFrame([(1, "x")], "id long, name string"), f"file://{tmp_path}/out")
    assert ingest.read_csv_table(spark, f"file://{tmp_path}/out", {"id": "INT"}).first()["id"] == 1


@pytest.fixture(scope="module")
def graph(spark):
    people = spark.createDataFrame([(1, "Ann", None), (2, "bob", 5)], "id long, name string, age long")
    knows = spark.createDataFrame([(10, 1, 2, 1.5)], "e long, s long, t long, w double")
    return PropertyGraph().add(NodeTable("Person", people, "id"), EdgeTable("KNOWS", "Person", "Person", knows, "s", "t", "e", ("w",)))


def test_graphs_in_files(spark, graph, tmp_path):
    text = "MATCH (a)-[r:KNOWS]->(b) RETURN a.name AS a, r.w AS w, b.age AS g"
    want = Engine(spark, graph).query(text).collect()
    ingest.write_graph(graph, f"file://{tmp_path}/g")
    assert Engine(spark, ingest.read_graph(spark, f"file://{tmp_path}/g")).query(text).collect() == want
    ingest.write_json_graph(graph, f"file://{tmp_path}/n", f"file://{tmp_path}/r")
    again = ingest.json_lines_graph(spark, f"file://{tmp_path}/n", f"file://{tmp_path}/r")
    assert Engine(spark, again).query(text).collect() == want
    assert sorted(register_views(graph, "v_")) == ["v_KNOWS", "v_Person"]
    assert spark.sql("SELECT p.name FROM v_KNOWS k JOIN v_Person p ON p._id = k._dst").first()[0] == "bob"


def test_schemas_and_templates_in_files(spark, tmp_path):
    for name in ("lending", "postal"):
        ingest.write_schema(spark, SCHEMAS[name], f"file://{tmp_path}/{name}")
        assert ingest.read_schema(spark, f"file://{tmp_path}/{name}") == SCHEMAS[name]
    made = Templates(SCHEMAS["postal"], 1).generate(9)
    ingest.write_templates(spark, made, f"file://{tmp_path}/t")
    assert spark.read.json(f"file://{tmp_path}/t").count() == 9
    asked = questions(made, PlainLabeler())
    assert len(asked) == 9 and all(q.endswith("?") for q, _ in asked)
    pairs = spark.createDataFrame([("q", "Postal"), ("q", "none")], "nl_query string, db_id string")
    got = {r.db_id: r.schema for r in ingest.with_schema(pairs, SCHEMAS.values()).collect()}
    assert "POSTED_AT" in got["Postal"] and got["none"] is None


def test_stubs_keep_the_protocols():
    e = TrigramEmbedder()
    assert isinstance(e, Embedder) and isinstance(PlainLabeler(), Labeler)
    a, b, c, none = e.embed(["customer", "customers", "zebra", ""])
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    assert dot(a, b) > 0.6 > dot(a, c) and dot(none, a) == 0 and e.embed(["customer"]) == [a]
    assert ingest.aligned("custmers", ["orders", "customer", "zebra"], e) == "customer"
    assert PlainLabeler().edge_label("shop", "item", ["x"]) == "SHOP_HAS_ITEM"


def test_edges_by_origin_and_meaning():
    edges = [Edge("OWNS", "a", "b", ("x",), ("y",)), Edge("BUYS", "a", "c", ("x",), ("y",), "buys", ("p",), ("q",))]
    maps = ingest.edge_maps(edges, {"buys": "join"})
    assert list(maps["fk"]) == [("a", "b")] and list(maps["jt"]) == [("a", "c")]
    assert ingest.canonical_edges([("has", "a", "b"), ("has", "a", "c")], {("has", "a", "b"): "OWNS"}) == [("OWNS", "a", "b"), ("has", "a", "c")]


def test_samples(spark):
    df = spark.range(10_000).select("id", (F.col("id") % 50).alias("v"))
    assert sample_values(df.withColumn("v", F.when(F.col("v") > 3, F.col("v"))), "v", 5, 1).count() == 5
    assert [r.v for r in sample_values(df, "v", 5, 1).collect()] == [r.v for r in sample_values(df.repartition(7), "v", 5, 1).collect()]
    assert 800 < sampled(df, 0.1, ["id"], 3).count() < 1200


def test_many_columns_are_compared(spark):
    n = 12
    a = spark.createDataFrame([tuple(range(k, k + n)) for k in range(5)], ", ".join(f"a{i} long" for i in range(n)))
    b = a.select(*[F.col(f"a{i}").alias(f"b{n - i}") for i in reversed(range(n))])
    assert results_equal(a, b) and not results_equal(a, b.withColumn(f"b{n}", F.col(f"b{n}") + 1))
    same = a.select(*[F.col("a0").alias(f"c{i}") for i in range(n)])
    assert results_equal(same, same)
    crossed = spark.createDataFrame([(1, 2), (2, 1)], "x long, y long")
    assert not results_equal(crossed, spark.createDataFrame([(1, 1), (2, 2)], "x long, y long"))


def test_order_is_compared_over_partitions(spark):
    df = spark.range(1000).repartition(8)
    up, down = df.orderBy("id"), df.orderBy(F.desc("id"))
    assert results_equal(up, up.limit(1000), ordered=True) and not results_equal(up, down, ordered=True) and results_equal(up, down)


def test_evaluation_resumes(spark, graph, tmp_path):
    gold = "MATCH (a:Person) RETURN a.id AS x"
    tasks = spark.createDataFrame([(k, gold if k % 3 else "MATCH (a:Person) WHERE a.id > 1 RETURN a.id AS x", gold) for k in range(7)] + [(9, "nonsense", gold)], "task long, predicted string, gold string")
    e, ran = Engine(spark, graph), []
    inner = e.query
    e.query = lambda text, *a, **k: ran.append(text) or inner(text, *a, **k)
    log = ResultLog(spark, f"file://{tmp_path}/log", "task long, score double, message string")
    done = evaluated(spark, e, tasks.where("task < 3"), "task", log, chunk=2)
    want = [(0, 0.0), (1, 1.0), (2, 1.0), (3, 0.0), (4, 1.0), (5, 1.0), (6, 0.0), (9, 0.0)]
    assert [(r.task, r.score) for r in done.orderBy("task").collect()] == want[:3]
    first = len(ran)
    # A compaction that broke off, and results that were appended after the last one.
    (tmp_path / "log" / "gen-7").mkdir()
    log.append([(3, 0.0, "")])
    more = evaluated(spark, e, tasks, "task", log)
    assert [(r.task, r.score) for r in more.orderBy("task").collect()] == want
    assert len(ran) - first <= 2 * 3 and [p.name for p in (tmp_path / "log").glob("gen-*") if p.name != "gen-7"] == ["gen-2"]
    assert evaluated(spark, e, tasks, "task", log).count() == len(want) and len(ran) - first <= 2 * 3  # nothing is left to run


def test_a_slow_query_is_cancelled_and_the_rest_resumed(spark, graph, tmp_path):
    @F.pandas_udf("long")
    def dawdling(x: pd.Series) -> pd.Series:
        time.sleep(60)
        return x

    register("dawdling", dawdling)
    gold = "MATCH (a:Person) RETURN a.id AS x"
    slow = "MATCH (a:Person) RETURN dawdling(a.id) AS x"
    tasks = spark.createDataFrame([(1, gold.replace("AS x", "AS y"), gold), (2, slow, gold), (3, gold.replace("AS x", "AS z"), gold)], "task long, predicted string, gold string")
    log = f"file://{tmp_path}/log"
    began = time.monotonic()
    out = {r.task: r for r in evaluated(spark, Engine(spark, graph), tasks, "task", log, threads=2, timeout=15).collect()}
    assert time.monotonic() - began < 50
    assert (out[1].score, out[2].score, out[3].score) == (1.0, 0.0, 1.0) and out[2].message.startswith("timeout")
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    # The verdict stands in the log; only a new task runs.
    more = spark.createDataFrame([(4, gold.replace("AS x", "AS w"), gold)], tasks.schema)
    began = time.monotonic()
    got = {r.task: r.score for r in evaluated(spark, Engine(spark, graph), tasks.unionAll(more), "task", log, timeout=30).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 1.0, 4: 1.0}
    assert time.monotonic() - began < 30
