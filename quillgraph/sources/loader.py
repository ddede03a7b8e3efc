"""Bulk load of a graph: batches of rows with their statements, in order, each written once.

A graph database takes a load as statements over batches of rows: first what declares labels
and keys, then nodes, then edges of join tables, then edges of foreign keys. Each of these
stages is one Spark write through the data source ``graph_batches``. A task cuts its rows into
batches and stages them under names of its attempt; the driver's commit publishes the batches
of the attempts that Spark counted and then the stage's manifest. What a failed or repeated
attempt staged is never published, and a stage with a manifest is not run again, so a load that
broke off goes on where it was, and no row comes twice.

Paths are URIs that all executors can write to (a shared folder, or any store that Arrow knows).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quillgraph.catalog import EdgeTable, NodeTable, PropertyGraph

MANIFEST, STAGING = "manifest.json", "_staging"
# Property types of GQL by Spark's.
GQL_TYPES = {"tinyint": "INT", "smallint": "INT", "int": "INT", "bigint": "INT", "float": "FLOAT", "double": "FLOAT", "boolean": "BOOL", "date": "LOCAL DATETIME", "timestamp": "LOCAL DATETIME", "timestamp_ntz": "LOCAL DATETIME"}


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    fs, at = pafs.FileSystem.from_uri(path)
    return fs, at.rstrip("/")


def _written(fs: pafs.FileSystem, at: str, text: str) -> None:
    """A file that is there whole or not at all."""
    temporary = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as f:
        f.write(text.encode())
    fs.move(temporary, at)


@dataclass
class _Staged(WriterCommitMessage):
    files: list[tuple[str, int]]  # staged name, rows


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.statement, self.size = options["path"], options["statement"], int(options.get("batch", "500"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Batches of this attempt, staged under a name that no other attempt has."""
        fs, at = _store(self.path)
        attempt, files, waiting, rows = uuid.uuid4().hex, [], [], 0

        def stage(table: pa.Table) -> None:
            name = f"{attempt}-{len(files):06d}.jsonl"
            lines = [json.dumps({k: v for k, v in r.items() if v is not None}, ensure_ascii=False, default=str) for r in table.to_pylist()]
            with fs.open_output_stream(f"{at}/{STAGING}/{name}") as f:
                f.write("\n".join([json.dumps({"statement": self.statement, "rows": len(lines)}), *lines, ""]).encode())
            files.append((name, len(lines)))

        fs.create_dir(f"{at}/{STAGING}", recursive=True)
        for batch in iterator:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= self.size:
                table = pa.Table.from_batches(waiting)
                whole = rows - rows % self.size
                for k in range(0, whole, self.size):
                    stage(table.slice(k, self.size))
                waiting, rows = table.slice(whole).to_batches(), rows - whole
        if rows:
            stage(pa.Table.from_batches(waiting))
        return _Staged(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = _store(self.path)
        names = []
        for task, m in enumerate(messages):
            for k, (name, rows) in enumerate(m.files if m else ()):
                final = f"batch-{task:05d}-{k:06d}.jsonl"
                fs.move(f"{at}/{STAGING}/{name}", f"{at}/{final}")
                names.append({"file": final, "rows": rows})
        _written(fs, f"{at}/{MANIFEST}", json.dumps({"statement": self.statement, "batches": names}))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = _store(self.path)
        if fs.get_file_info(f"{at}/{STAGING}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{at}/{STAGING}")


class GraphBatches(DataSource):
    """Data source ``graph_batches``; options path, statement and batch (rows)."""

    @classmethod
    def name(cls) -> str:
        return "graph_batches"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def schema_statements(graph: PropertyGraph, dialect: str = "cypher") -> list[str]:
    """What has to be declared before rows come: keys, or a graph type."""
    if dialect == "cypher":
        return [f"CREATE CONSTRAINT IF NOT EXISTS FOR (n:{_quoted(label)}) REQUIRE n.{_quoted(n.key)} IS UNIQUE" for label, n in graph.nodes.items()]
    typed = lambda df, names: ", ".join(f"{_quoted(c)} {GQL_TYPES.get(dict(df.dtypes)[c], 'STRING')}" for c in names)
    parts = [f"NODE {_quoted(label)} (:{_quoted(label)} {{{typed(n.df, dict.fromkeys((n.key, *n.properties)))}, PRIMARY KEY ({_quoted(n.key)})}})" for label, n in graph.nodes.items()]
    for type_, tables in graph.edges.items():
        for e in tables:
            own = f" {{{typed(e.df, e.properties)}}}" if e.properties else ""
            parts.append(f"EDGE {_quoted(type_)} ({_quoted(e.source_label)})-[:{_quoted(type_)}{own}]->({_quoted(e.target_label)})")
    return [f"CREATE GRAPH TYPE IF NOT EXISTS loaded AS {{ {', '.join(parts)} }}"]


def _node_rows(n: NodeTable, dialect: str) -> tuple[DataFrame, str]:
    word = "CREATE" if dialect == "cypher" else "INSERT"
    return n.df.select(*[F.col(f"`{c}`") for c in dict.fromkeys((n.key, *n.properties))]), f"UNWIND $rows AS row {word} (n:{_quoted(n.label)}) SET n = row"


def _edge_rows(e: EdgeTable, graph: PropertyGraph, dialect: str) -> tuple[DataFrame, str]:
    word = "CREATE" if dialect == "cypher" else "INSERT"
    a, b = graph.nodes[e.source_label], graph.nodes[e.target_label]
    rows = e.df.select(F.col(e.source).alias("_src"), F.col(e.target).alias("_dst"), *[F.col(f"`{c}`") for c in e.properties]).where("_src IS NOT NULL AND _dst IS NOT NULL")
    ends = f"(a:{_quoted(a.label)} {{{_quoted(a.key)}: row._src}}), (b:{_quoted(b.label)} {{{_quoted(b.key)}: row._dst}})"
    sets = "".join(f"{', ' if i else ' SET '}r.{_quoted(c)} = row.{_quoted(c)}" for i, c in enumerate(e.properties))
    return rows, f"UNWIND $rows AS row MATCH {ends} {word} (a)-[r:{_quoted(e.type)}]->(b){sets}"


def stages(graph: PropertyGraph, dialect: str = "cypher") -> list[tuple[str, DataFrame, str]]:
    """Name, rows and statement of every stage after the schema, in the order of the load."""
    found = [(f"node-{label}", *_node_rows(n, dialect)) for label, n in graph.nodes.items()]
    edges = [(f"{type_}-{i}", e) for type_, tables in graph.edges.items() for i, e in enumerate(tables)]
    # Edges that are rows of a table of their own come before those that nodes' tables hold.
    for kind, own in (("join", [x for x in edges if x[1].held_by is None]), ("foreign", [x for x in edges if x[1].held_by is not None])):
        found += [(f"{kind}-{name}", *_edge_rows(e, graph, dialect)) for name, e in own]
    return found


def load(graph: PropertyGraph, path: str, dialect: str = "cypher", batch: int = 500) -> list[str]:
    """Write the load of a graph below ``path``; the names of the stages that this call ran."""
    fs, top = _store(path)
    ran = []
    if fs.get_file_info(f"{top}/00-schema/{MANIFEST}").type == pafs.FileType.NotFound:
        fs.create_dir(f"{top}/00-schema", recursive=True)
        _written(fs, f"{top}/00-schema/{MANIFEST}", json.dumps({"statements": schema_statements(graph, dialect), "batches": []}))
        ran.append("schema")
    for k, (name, rows, statement) in enumerate(stages(graph, dialect), 1):
        folder = f"{k:02d}-{name}"
        if fs.get_file_info(f"{top}/{folder}/{MANIFEST}").type != pafs.FileType.NotFound:
            continue
        if fs.get_file_info(f"{top}/{folder}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{top}/{folder}")  # published in part, before its manifest
        fs.create_dir(f"{top}/{folder}", recursive=True)
        rows.sparkSession.dataSource.register(GraphBatches)
        rows.write.format("graph_batches").option("path", f"{path.rstrip('/')}/{folder}").option("statement", statement).option("batch", str(batch)).mode("append").save()
        ran.append(name)
    return ran


def manifests(path: str) -> list[tuple[str, dict]]:
    """Folder and manifest of every complete stage, in order."""
    fs, top = _store(path)
    folders = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(top)) if x.type == pafs.FileType.Directory)
    out = []
    for f in folders:
        if fs.get_file_info(f"{top}/{f}/{MANIFEST}").type != pafs.FileType.NotFound:
            with fs.open_input_stream(f"{top}/{f}/{MANIFEST}") as s:
                out.append((f, json.loads(s.read())))
    return out


def loaded(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of a complete stage, read back from its published batches."""
    folder, m = next((f, m) for f, m in manifests(path) if f.partition("-")[2] == name)
    files = [f"{path.rstrip('/')}/{folder}/{b['file']}" for b in m["batches"]]
    return spark.read.json(files).where("statement IS NULL").drop("statement", "rows") if files else spark.createDataFrame([], "_src long")


def sent(path: str, send: Callable[[str, str, list[dict]], None], done: set[str], retries: int = 3) -> int:
    """Hand every batch that is not in ``done`` to ``send`` (name, statement, rows), in order.

    A batch that fails is tried again up to ``retries`` times, as servers refuse batches that
    deadlock; ``done`` then holds the names of what was taken, for a call that goes on. The
    number of batches sent.
    """
    fs, top = _store(path)
    n = 0
    for folder, m in manifests(path):
        for i, statement in enumerate(m.get("statements", ())):
            n += _tried(f"{folder}/{i}", statement, list, send, done, retries)
        for b in m["batches"]:
            def rows(at: str = f"{top}/{folder}/{b['file']}") -> list[dict]:
                with fs.open_input_stream(at) as s:
                    return [json.loads(x) for x in s.read().decode().splitlines()[1:]]

            n += _tried(f"{folder}/{b['file']}", m["statement"], rows, send, done, retries)
    return n


def _tried(name: str, statement: str, rows: Callable[[], list[dict]], send, done: set[str], retries: int) -> int:
    if name in done:
        return 0
    for left in range(retries, -1, -1):
        try:
            send(name, statement, rows())
            break
        except Exception:
            if not left:
                raise
    done.add(name)
    return 1
