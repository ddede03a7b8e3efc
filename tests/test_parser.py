import pytest

from quillgraph.plans import ir
from quillgraph.plans.parser import ParseError, parse
from quillgraph.plans.render import render
from quillgraph.queries import TEXTS
from quillgraph.synth.schemas import SCHEMAS
from quillgraph.synth.templates import TYPES, Templates


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_texts_round_trip(name):
    text, dialect, _, _ = TEXTS[name]
    q = parse(text, dialect)
    assert parse(render(q, "cypher")) == q


@pytest.mark.parametrize("schema", sorted(SCHEMAS))
def test_templates_round_trip_in_both_dialects(schema):
    made = Templates(SCHEMAS[schema], 5).generate(4 * len(TYPES))
    assert {t.type for t in made} == set(TYPES)
    for t in made:
        assert parse(t.text("cypher")) == t.query
        assert parse(t.text("gql"), "gql") == t.query
    assert [t.text() for t in made] == [t.text() for t in Templates(SCHEMAS[schema], 5).generate(4 * len(TYPES))]


def test_precedence():
    q = parse("MATCH (a:A) WHERE NOT a.x = 1 OR a.y = 2 AND a.z = 3 RETURN a.x - (a.y - 1) AS v")
    where = q.clauses[0].where
    assert where.op == "or" and isinstance(where.left, ir.Un) and where.right.op == "and"
    assert parse(render(q)) == q


def test_order_stands_before_or_after_return():
    a = parse("MATCH (a:A) ORDER BY a.x RETURN a.y AS y LIMIT 3")
    b = parse("MATCH (a:A) RETURN a.y AS y ORDER BY y LIMIT 3")
    assert [type(c).__name__ for c in a.clauses] == ["Match", "OrderBy", "Return", "Limit"]
    assert [type(c).__name__ for c in b.clauses] == ["Match", "Return", "OrderBy", "Limit"]


@pytest.mark.parametrize("text", ["", "MATCH (a", "MATCH (a) RETURN", "RETURN 1 AS", "MATCH (a)<-[]->(b) RETURN a", "MATCH (a) RETURN a §"])
def test_bad_texts(text):
    with pytest.raises(ParseError):
        parse(text)


def test_paths_merge_by_any_ends():
    paths = parse("MATCH (b:B)<-[x:R]-(a:A), (b)-[y:S]->(c:C), (d)-[z:T]-(c), p = (d)-[:U]->(e) RETURN a").clauses[0].paths
    plain, any_way = ir.merge_paths(paths), ir.merge_paths(paths, any_way=True)
    assert sorted(len(p.rels) for p in plain) == [1, 1, 1, 1] and sorted(len(p.rels) for p in any_way) == [1, 3]
    long = next(p for p in any_way if len(p.rels) == 3)
    if long.nodes[0].var != "a":
        long = ir.reversed_path(long)
    assert [n.var for n in long.nodes] == ["a", "b", "c", "d"] and [(r.var, r.direction) for r in long.rels] == [("x", "out"), ("y", "out"), ("z", "both")]
    assert ir.reversed_path(ir.reversed_path(long)) == long and long.nodes[1].labels == ("B",)


def test_paths_merge():
    q = parse("MATCH (a:A)-[:R]->(b), (b)-[:S]->(c:C), (c), (d:D) RETURN a")
    merged = ir.merge_paths(q.clauses[0].paths)
    assert sorted(len(p.rels) for p in merged) == [0, 2]
