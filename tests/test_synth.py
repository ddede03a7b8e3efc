from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillgraph.catalog import CONSTRAINT_KINDS, NodeTable, Property, PropertyGraph, RelationshipType
from quillgraph.evaluation import validate
from quillgraph.functions.models import TrigramEmbedder
from quillgraph.plans import ir
from quillgraph.plans.engine import Engine
from quillgraph.plans.parser import parse
from quillgraph.plans.render import render
from quillgraph.streaming.events import deduplicated, read_events, run_once, windowed_counts
from quillgraph.synth import data
from quillgraph.synth.data import cycle_text, generate, path_problems, violations
from quillgraph.synth.schemas import DOMAINS, SCHEMAS
from quillgraph.synth.templates import SHAPES, Templates


@pytest.mark.parametrize("name", ["banking", "logistics"])
def test_data_keeps_the_schema_and_holds_cycles(name, spark):
    schema = SCHEMAS[name]
    graph = generate(spark, schema, 60, 40, seed=3)
    assert violations(graph, schema).count() == 0
    e = Engine(spark, graph)
    for c in schema.cycles:
        assert e.query(cycle_text(c.path)).count() >= 3
    again = generate(spark, schema, 60, 40, seed=3)
    for t, n in graph.nodes.items():
        assert n.df.exceptAll(again.nodes[t].df).isEmpty()


def test_every_target_is_compared(spark, monkeypatch):
    monkeypatch.setattr(data, "uniform", lambda *_: F.lit(0.0))  # every candidate is taken
    number = lambda n: Property(n, "float", min_value=0.0, max_value=100.0)
    r = RelationshipType("r", "A", "B")
    a = spark.createDataFrame([("a", 0.0, 5.0)], "_id string, x float, y float")
    b = spark.createDataFrame([("far", 40.0, 5.0)] + [(f"b{k:02}", 1.0, 95.0) for k in range(20)], "_id string, x float, y float")
    for props, want in (([number("x"), number("y")], {"far"} | {f"b{k:02}" for k in range(9)}), ([], {f"b{k:02}" for k in range(10)})):
        schema = SimpleNamespace(node=lambda _, props=props: SimpleNamespace(properties=props))
        assert {e._dst for e in data.similar_edges(a, b, r, schema, 1).collect()} == want


def test_templates_run(spark):
    e = Engine(spark, generate(spark, SCHEMAS["social"], 30, 30, seed=1))
    results = [validate(e, t.text()) for t in Templates(SCHEMAS["social"], 2).generate(14)]
    assert all(v.valid for v in results), [v for v in results if not v.valid]
    assert sum(v.result_count > 0 for v in results) >= 5


def test_rules_of_every_kind_hold_and_are_checked(spark):
    """Generated data keeps each rule; data that breaks it is found."""
    broken = {
        "lending": [("Loan", "closed", "granted"), ("Loan", "interest", "interest + 1")], "shipping": [("Container", "gross", "gross + 1")], "library": [("Reader", "left_on", "date_sub(joined, 1)")],
    }
    kinds = set()
    for name in ("lending", "shipping", "library", "postal"):
        schema = SCHEMAS[name]
        graph = data.generate(spark, schema, 45, 30, seed=2)
        bad = data.violations(graph, schema).collect()
        assert bad == [], (name, bad[:3])
        kinds |= {c.kind for c in schema.constraints}
        for label, column, wrong in broken.get(name, ()):
            spoiled = PropertyGraph(dict(graph.nodes), dict(graph.edges))
            spoiled.add(NodeTable(label, graph.nodes[label].df.withColumn(column, F.expr(wrong)), "_id"))
            assert data.violations(spoiled, schema).count() > 0, (name, column)
    assert kinds == set(CONSTRAINT_KINDS)
    graph, schema = data.generate(spark, SCHEMAS["library"], 45, 30, seed=2), SCHEMAS["library"]
    e = graph.edges["STANDS_ON"][0]
    cut = PropertyGraph(dict(graph.nodes), {k: list(v) for k, v in graph.edges.items()})
    cut.edges["STANDS_ON"] = [replace(e, df=e.df.where("_src <> 'Book_1'"))]
    assert [r.id for r in data.violations(cut, schema).where("constraint = 'shelved'").collect()] == ["Book_1"]
    gone = PropertyGraph(dict(graph.nodes), dict(graph.edges))
    schema = SCHEMAS["shipping"]
    graph = data.generate(spark, schema, 45, 30, seed=2)
    gone = PropertyGraph({**graph.nodes, "Vessel": NodeTable("Vessel", graph.nodes["Vessel"].df.limit(2), "_id")}, dict(graph.edges))
    assert data.violations(gone, schema).where("constraint = 'stowed'").count() > 0


def test_edges_by_attributes_as_text(spark):
    schema = SCHEMAS["retail"]
    r = next(x for x in schema.relationships if x.name == "GOES_WITH")
    products = data.nodes(spark, schema, "Product", 25, 1)
    e = TrigramEmbedder()
    near = data.embedded_neighbours(products, products, r, schema, e).collect()
    matrix = {(m.from_id, m.to_id): m.score for m in data.embedded_matrix(products, products, r, schema, e).collect()}
    assert len(matrix) == 25 * 24
    for row in near:
        assert abs(matrix[row._src, row._dst] - row.score) < 1e-9
        assert sum(s > row.score + 1e-9 for (a, _), s in matrix.items() if a == row._src) < row.rank
    assert data.similar_edges(products, products, r, schema, 1, e).count() > 5


def test_mixes_of_templates():
    made = Templates(SCHEMAS["gaming"], 2).generate(12, ("aggregation", "path_length"), (2,), 0.0)
    assert {(t.type, t.hops) for t in made} == {("aggregation", 2), ("path_length", 2)} and len(made) == 12
    assert Templates(SCHEMAS["gaming"], 2).generate(3, cycles=1.0)[0].hops == 3


def test_payload_elements_once(spark):
    step = "struct<kind:string,id:string,from_node:string,to_node:string>"
    rows = [(k, [("node", "a", None, None), ("relationship", f"r{k}", "a", "a"), ("node", "a", None, None)]) for k in (1, 2)]
    nodes, rels = data.extracted(spark.createDataFrame(rows, f"cycle long, path array<{step}>"))
    assert [r.id for r in nodes.collect()] == ["a"] and sorted(r.id for r in rels.collect()) == ["r1", "r2"]


def test_every_shape_of_condition_is_made_and_runs(spark):
    e = Engine(spark, generate(spark, SCHEMAS["postal"], 30, 30, seed=1))
    maker = Templates(SCHEMAS["postal"], 3)
    p = maker.path(1)
    for shape, fits in SHAPES.items():
        for node in p.nodes:
            for q in SCHEMAS["postal"].node(node.labels[0]).properties:
                if fits(q, p):
                    test = getattr(maker, "_" + shape)(p, ir.Prop(node.var, q.name), q, node.labels[0])
                    text = render(ir.Single((ir.Match((p,), test), ir.Return((ir.Item(ir.Prop("n0", "letter_id"), "x"),)))))
                    assert parse(text).clauses[0].where == test, text
        assert validate(e, text).valid, (shape, validate(e, text))
    returned = {type(i.x).__name__ for _ in range(60) for i in maker.returned(p)}
    assert {"Prop", "Lit", "Call", "Case"} <= returned


def test_every_schema_is_whole():
    assert len(SCHEMAS) == 30 and sorted(x for d in DOMAINS.values() for x in d) == sorted(SCHEMAS) and all(len(d) == 3 for d in DOMAINS.values())
    for s in SCHEMAS.values():
        labels = {n.name for n in s.nodes}
        assert len(labels) == 3 and all(r.source in labels and r.target in labels for r in s.relationships)
        assert all(n.struct().fields for n in s.nodes)


def test_cycle_payload_checks(spark):
    step = "struct<kind:string,id:string,from_node:string,to_node:string>"
    rows = [
        (1, [("node", "a", None, None), ("relationship", "r", "a", "b"), ("node", "b", None, None)]),
        (2, [("node", "a", None, None), ("node", "b", None, None)]),
        (3, [("node", "a", None, None), ("relationship", "r", "x", "b"), ("node", "b", None, None)]),
    ]
    bad = path_problems(spark.createDataFrame(rows, f"cycle long, path array<{step}>")).collect()
    assert sorted((r.cycle, r.at) for r in bad) == [(2, 1), (3, 1)]


def test_stream_agrees_with_the_table(spark, sf, tmp_path):
    stream = windowed_counts(deduplicated(read_events(spark, sf)), late=None)
    out = run_once(stream, "windows", f"file://{tmp_path}/ck", "append")
    table = windowed_counts(spark.read.parquet(f"{sf}/events.parquet"))
    got, want = out.agg({"n": "sum"}).first()[0], table.agg({"n": "sum"}).first()[0]
    assert 0 < got <= want  # windows behind the watermark are final; the last ones wait
    assert out.join(table, ["start", "end", "event_type", "n"], "left_anti").isEmpty()
