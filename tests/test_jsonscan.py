"""One JSON document read in blocks against the standard parser and the one-task reader."""

import json
import random
from collections import Counter

import numpy as np
import pytest

from quillgraph.sources.ingest import json_graph
from quillgraph.sources.jsonscan import State, json_elements, large_json_graph, states, summary


def document(rng, n):
    """Elements with escapes, brackets in strings, nested objects and arrays, and other keys around."""
    odd = ['"', "\\", '\\"', "}{][", "\\\\", "a\nb", "é你", '","', "", "\\u007b", "x" * 40]
    value = lambda d=0: rng.choice([rng.randint(0, 9), None, True, "".join(rng.choices(odd, k=rng.randint(0, 4)))] + ([{"k": value(d + 1), "]": [value(d + 1)]}, [value(d + 1), {}]] if d < 2 else []))
    nodes = [{"id": f"n{i}", "type": rng.choice("AB"), "properties": {"name": "".join(rng.choices(odd, k=3)), "x": i, "y": i / 2}, "more": value()} for i in range(n)]
    rels = [{"id": f"r{i}", "type": "R", "from_node": f"n{rng.randrange(n)}", "to_node": f"n{rng.randrange(n)}", "properties": {"w": i}} for i in range(n)] if n else []
    return {"time": "[{\"", "nodes": nodes, "meta": {"nodes": [{"no": 1}], "deep": [[{"no": 2}]]}, "relationships": rels, "empty": [], "numbers": [1, [2], "{"], "node_count": n}


def elements(doc):
    return Counter((k, json.dumps(x, sort_keys=True)) for k, v in doc.items() if isinstance(v, list) for x in v if isinstance(x, dict))


@pytest.mark.parametrize(("block", "indent"), [(3, None), (7, 1), (64, None), (300, 2), (1 << 20, None)])
def test_blocks_of_any_size(spark, tmp_path, block, indent):
    for seed in range(2):
        doc = document(random.Random(seed), 1 if block < 7 else 12) | ({"meta": 0} if block < 7 else {})
        text = json.dumps(doc, indent=indent, ensure_ascii=bool(seed))
        path = tmp_path / f"{seed}.json"
        path.write_text(text)
        df = json_elements(spark, f"file://{path}", block)
        got = Counter((r.array, json.dumps(json.loads(r.value), sort_keys=True)) for r in df.coalesce(8).collect())
        assert got == elements(doc)


def test_summaries_add_up():
    rng = random.Random(2)
    text = json.dumps(document(rng, 20), ensure_ascii=False).encode()
    for _ in range(200):
        i, j = sorted((rng.randrange(len(text)), rng.randrange(len(text))))
        for string in (False, True):
            for escaped in (False, True):
                s = State(string, escaped, 5)
                *_, after = s.depths(np.frombuffer(text[i:j], np.uint8))
                odd, pending, plain, inside = summary(text[i:j])[escaped]
                assert after == State(string ^ odd, pending, 5 + (inside if string else plain))


def test_same_graph_as_one_task(spark, tmp_path):
    doc = document(random.Random(5), 60)
    path = f"file://{tmp_path}/graph.json"
    (tmp_path / "graph.json").write_text(json.dumps(doc, indent=1))
    assert len(states(spark, path, 2000)) > 5
    a, b = large_json_graph(spark, path, 2000), json_graph(spark, path)
    assert set(a.nodes) == set(b.nodes) == {"A", "B"} and {t: len(x) for t, x in a.edges.items()} == {t: len(x) for t, x in b.edges.items()}
    for label in a.nodes:
        assert Counter(map(tuple, a.nodes[label].df.collect())) == Counter(map(tuple, b.nodes[label].df.collect()))
    for x, y in zip(a.edges["R"], b.edges["R"], strict=True):
        assert Counter(map(tuple, x.df.collect())) == Counter(map(tuple, y.df.collect()))
    assert json_elements(spark, path, 2000).rdd.getNumPartitions() > 5


@pytest.mark.parametrize("text", ['{"nodes": [{"id": 1}', '{"nodes": [{"id": "x}]}', "[1"])
def test_cut_documents_are_refused(spark, tmp_path, text):
    (tmp_path / "cut.json").write_text(text)
    with pytest.raises(ValueError, match="no whole JSON document"):
        json_elements(spark, f"file://{tmp_path}/cut.json", 4)
