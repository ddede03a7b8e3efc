"""Bulk loads that fail, repeat and go on."""

import json
import os
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.catalog import EdgeTable, NodeTable, PropertyGraph
from quillgraph.sources.fixtures import read_table, star_graph
from quillgraph.sources.loader import MANIFEST, STAGING, _Writer, load, loaded, manifests, schema_statements, sent


def small(spark, marker=None):
    """People and what they know; edges of the last part fail while ``marker`` is missing."""
    people = spark.range(40).selectExpr("id", "CASE WHEN id % 3 > 0 THEN concat('n', id) END AS name").repartition(3)
    knows = spark.range(200).selectExpr("id AS e", "id % 40 AS s", "(id * 7) % 40 AS t", "id / 2 AS w").repartition(4, "e")
    if marker:
        @F.pandas_udf("double")
        def checked(w: pd.Series) -> pd.Series:
            if not os.path.exists(marker) and (w > 99).any():
                raise ValueError("this task fails")
            return w

        knows = knows.withColumn("w", checked("w"))
    likes = spark.createDataFrame([(1, 2), (None, 3), (3, 3)], "s long, t long").withColumn("e", F.col("s"))
    g = PropertyGraph().add(NodeTable("P", people, "id"))
    return g.add(EdgeTable("LIKES", "P", "P", likes, "s", "t", "e", held_by="source"), EdgeTable("KNOWS", "P", "P", knows, "s", "t", "e", ("w",)))


def test_a_failing_task_and_a_rerun_write_every_row_once(spark, tmp_path):
    path, marker = f"file://{tmp_path}/load", str(tmp_path / "mended")
    with pytest.raises(Exception, match="this task fails"):
        load(small(spark, marker), path, batch=7)
    # Nothing of the tasks that succeeded is published, and the stage does not count.
    assert [f for f, _ in manifests(path)] == ["00-schema", "01-node-P"]
    assert not list((tmp_path / "load" / "02-join-KNOWS-0").glob("batch-*"))
    before = sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "load" / "01-node-P").iterdir())
    open(marker, "w").close()
    assert load(small(spark, marker), path, batch=7) == ["join-KNOWS-0", "foreign-LIKES-0"]
    assert before == sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "load" / "01-node-P").iterdir())
    assert load(small(spark, marker), path) == []
    got = Counter((r._src, r._dst, r.w) for r in loaded(spark, path, "join-KNOWS-0").collect())
    assert got == Counter((k % 40, k * 7 % 40, k / 2) for k in range(200))
    assert Counter((r.id, r.name) for r in loaded(spark, path, "node-P").collect()) == Counter((k, f"n{k}" if k % 3 else None) for k in range(40))
    assert Counter((r._src, r._dst) for r in loaded(spark, path, "foreign-LIKES-0").collect()) == Counter([(1, 2), (3, 3)])
    sizes = [b["rows"] for f, m in manifests(path) for b in m["batches"]]
    assert max(sizes) == 7 and sum(sizes) == 40 + 200 + 2


def test_an_attempt_that_is_not_counted_leaves_nothing(tmp_path):
    w = _Writer({"path": f"file://{tmp_path}", "statement": "S", "batch": "2"})
    rows = lambda: iter([pa.RecordBatch.from_pydict({"x": [1, 2, 3]}), pa.RecordBatch.from_pydict({"x": [4, 5]})])
    w.write(rows())  # a lost executor's attempt
    second = w.write(rows())
    w.commit([second, None])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["batch-00000-000000.jsonl", "batch-00000-000001.jsonl", "batch-00000-000002.jsonl", MANIFEST]
    lines = [json.loads(x) for p in sorted(tmp_path.glob("batch-*")) for x in p.read_text().splitlines()]
    assert [x["x"] for x in lines if "x" in x] == [1, 2, 3, 4, 5] and {x["statement"] for x in lines if "statement" in x} == {"S"}
    assert not (tmp_path / STAGING).exists()


def test_a_commit_that_broke_off_is_written_anew(spark, tmp_path):
    path = f"file://{tmp_path}/load"
    g = small(spark)
    load(g, path, batch=50)
    stage = tmp_path / "load" / "02-join-KNOWS-0"
    (stage / MANIFEST).unlink()
    (stage / "batch-99999-000000.jsonl").write_text("{}\n")
    assert load(g, path, batch=50) == ["join-KNOWS-0"]
    assert loaded(spark, path, "join-KNOWS-0").count() == 200


def test_batches_are_sent_in_order_and_retried(spark, tmp_path):
    path = f"file://{tmp_path}/load"
    load(small(spark), path, batch=30)
    taken, refused, done = [], Counter(), set()

    def send(name, statement, rows):
        refused[name] += 1
        if refused[name] == 1 and "KNOWS" in name or refused["stop"] and "LIKES" in name:
            raise OSError("deadlock")
        taken.append((name, len(rows)))

    refused["stop"] = 1
    with pytest.raises(OSError):
        sent(path, send, done, retries=2)
    refused["stop"] = 0
    assert sent(path, send, done, retries=2) == sum("LIKES" in n for n, _ in taken)
    names = [n for n, _ in taken]
    assert names == sorted(names) and len(set(names)) == len(names) and sum(k for _, k in taken) == 242
    assert names[0].startswith("00-schema") and sent(path, send, done) == 0


@pytest.mark.parametrize("dialect", ["cypher", "gql"])
def test_the_star_graph_is_loaded(spark, sf, tmp_path, dialect):
    path = f"file://{tmp_path}/load"
    graph = star_graph(spark, sf)
    ran = load(graph, path, dialect, 2000)
    kinds = [n.partition("-")[0] for n in ran]
    assert kinds == sorted(kinds, key=["schema", "node", "join", "foreign"].index) and len(ran) == 1 + 6 + 3 + 4
    line = Counter((r.l_orderkey, r.l_partkey, r.l_quantity) for r in read_table(spark, sf, "lineitem").collect())
    assert Counter((r._src, r._dst, r.l_quantity) for r in loaded(spark, path, "join-CONTAINS-0").collect()) == line
    assert all(f"`{label}`" in " ".join(schema_statements(graph, dialect)) for label in graph.nodes)
