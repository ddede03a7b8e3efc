"""From relational tables and JSON graphs to a property graph."""

from __future__ import annotations

import json
import sqlite3
from collections import defaultdict
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.catalog import (
    PROPERTY_TYPES, BusinessConstraint, CyclePattern, EdgeTable, ForeignKey, GraphSchema, NodeTable, NodeType, Property, PropertyGraph, RelationshipType,
)

# Words in a declared column type, in order of precedence, and the type read.
DECLARED = [
    (("datetime", "timestamp", "date"), "datetime"),
    (("text", "blob", "char", "string"), "string"),
    (("bool",), "boolean"),
    (("int", "bit", "year"), "int"),
    (("real", "float", "double", "number", "decimal", "numeric"), "float"),
]


def declared_type(declared: str | None) -> str:
    """Property type of a declared column type; none declared is a string."""
    if not declared:
        return "string"
    low = declared.lower()
    for words, kind in DECLARED:
        if any(w in low for w in words):
            return kind
    raise TypeError(f"no property type for {declared}")


def coerced(c: Column, kind: str) -> Column:
    """A text column as a property; what does not parse, '' and 'NULL' (numbers) are null."""
    text = c.cast("string")
    if kind == "string":
        return text
    if kind == "datetime":
        return F.try_to_timestamp(F.nullif(text, F.lit(""))).cast("timestamp_ntz")
    clean = F.nullif(F.nullif(text, F.lit("")), F.lit("NULL"))
    if kind == "boolean":
        return clean.try_cast("boolean")
    if kind == "int":
        return F.coalesce(clean.try_cast("bigint"), clean.try_cast("double").cast("bigint"))
    return clean.try_cast("double")


#: Encodings that texts of a database are tried in, one after another.
ENCODINGS = ("utf-8", "cp1252", "iso-8859-1")


def read_csv_table(spark: SparkSession, path: str, declared: dict[str, str], encoding: str = "auto") -> DataFrame:
    """A CSV export with the declared column types.

    Without an encoding it is UTF-8, unless that leaves a broken character (one pass, which
    ends at the first), and else cp1252: Spark reads that as ISO-8859-1, which differs from it
    in the places of control characters only.
    """
    def read(name: str) -> DataFrame:
        return spark.read.option("header", True).option("encoding", "iso-8859-1" if name == "cp1252" else name).csv(path)

    raw, name = read("utf-8" if encoding == "auto" else encoding), encoding
    if encoding == "auto":
        broken = F.lit(any("\ufffd" in c for c in raw.columns))
        for c in raw.columns:
            broken = broken | F.coalesce(F.col(f"`{c}`").contains("\ufffd"), F.lit(False))
        if not raw.where(broken).isEmpty():
            raw, name = read("cp1252"), "cp1252"
    places = {chr(b): bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)}
    text = lambda c: F.translate(c, "".join(places), "".join(places.values())) if name == "cp1252" else c
    return raw.select(*[coerced(text(F.col(f"`{c}`")), declared_type(declared.get(c))).alias(c.lower()) for c in raw.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


@dataclass(frozen=True)
class TableColumn:
    table: str
    name: str
    declared: str
    key: bool


@dataclass(frozen=True)
class Database:
    """What a SQLite file says of itself: columns, primary keys and foreign keys of its tables."""

    path: str
    columns: tuple[TableColumn, ...]
    foreign: tuple[ForeignKey, ...]

    @property
    def tables(self) -> list[str]:
        return list(dict.fromkeys(c.table for c in self.columns))

    def names(self, table: str) -> list[str]:
        return [c.name for c in self.columns if c.table == table]

    def keys(self) -> dict[str, list[str]]:
        return {t: [c.name for c in self.columns if c.table == t and c.key] for t in self.tables}

    def declared(self, table: str) -> dict[str, str]:
        return {c.name: c.declared for c in self.columns if c.table == table}

    def kinds(self) -> dict[str, str]:
        """'entity', 'join' or 'open' for each table, by keys that exist."""
        return classify_tables(self.keys(), valid_foreign(self.foreign, {t: self.names(t) for t in self.tables}))

    def schema(self, spark: SparkSession) -> DataFrame:
        """The catalogue as rows: table, column, declared type, Spark's type of it, and whether it is of the key."""
        rows = [(c.table, c.name, c.declared, PROPERTY_TYPES[declared_type(c.declared)].simpleString(), c.key) for c in self.columns]
        return spark.createDataFrame(rows, "table string, column string, declared string, type string, is_key boolean")


def sqlite_database(path: str) -> Database:
    """The catalogue of a SQLite file, read on the driver; its rows are read by ``read_sqlite_table``."""
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
        tables = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        columns, foreign = [], []
        for t in tables:
            columns += [TableColumn(t, r[1], r[2] or "", r[5] > 0) for r in con.execute("SELECT * FROM pragma_table_info(?)", (t,))]
            by = defaultdict(list)
            for r in con.execute("SELECT id, seq, \"table\", \"from\", \"to\" FROM pragma_foreign_key_list(?) ORDER BY id, seq", (t,)):
                by[r[0]].append(r)
            for rows in by.values():
                # Without a named column a foreign key means the target's primary key.
                keys = [r[0] for r in con.execute("SELECT name FROM pragma_table_info(?) WHERE pk > 0 ORDER BY pk", (rows[0][2],))]
                foreign.append(ForeignKey(t, rows[0][2], tuple(r[3] for r in rows), tuple(r[4] or (keys[k] if k < len(keys) else "") for k, r in enumerate(rows))))
    return Database(path, tuple(columns), tuple(foreign))


def decoded(raw: bytes) -> str:
    """Text in the first encoding that fits."""
    for name in ENCODINGS[:-1]:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            pass
    return raw.decode(ENCODINGS[-1])


def read_sqlite_table(spark: SparkSession, database: Database, table: str, parts: int | None = None) -> DataFrame:
    """A typed table of a SQLite file that all executors can open, read in ranges of row ids.

    Without a rowid (WITHOUT ROWID tables) one task reads all.
    """
    names, path = database.names(table), database.path
    quoted = '"' + table.replace('"', '""') + '"'
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted}").fetchone()
        except sqlite3.OperationalError:
            low = high = None
    parts = parts or spark.sparkContext.defaultParallelism
    step = 1 if low is None else max(1, -(-(high - low + 1) // parts))
    ranges = [(None, None)] if low is None else [(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
                    con.text_factory = bytes
                    where, values = ("", ()) if a is None else (" WHERE rowid BETWEEN ? AND ?", (a, b))
                    cursor = con.execute(f"SELECT * FROM {quoted}{where}", values)
                    while some := cursor.fetchmany(10_000):
                        cells = [[None if v is None else decoded(v) if isinstance(v, bytes) else str(v) for v in column] for column in zip(*some, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cells], names)

    asked = spark.createDataFrame(ranges, "a long, b long").repartition(len(ranges))
    raw = asked.mapInArrow(rows, ", ".join(f"`{n}` string" for n in names))
    kinds = database.declared(table)
    return raw.select(*[coerced(F.col(f"`{n}`"), declared_type(kinds[n])).alias(n.lower()) for n in names])


def table_schema(tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """The catalogue of tables as rows: table, column, type, nullable, and whether it is of the key."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable, f.name in (keys or {}).get(t, ())) for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table string, column string, type string, nullable boolean, is_key boolean")


def discovered_keys(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """For each table its columns whose values are unique and never null, by one pass a table.

    Distinct values are first estimated; only columns that may be unique are counted exactly.
    """
    out = {}
    for t, df in tables.items():
        plain = [c for c, k in df.dtypes if k in ("int", "bigint", "smallint", "string", "date")]
        about = df.agg(F.count(F.lit(1)).alias("_n"), *[F.approx_count_distinct(f"`{c}`", 0.02).alias(c) for c in plain]).first()
        maybe = [c for c in plain if about["_n"] and about[c] > 0.9 * about["_n"]]
        exact = df.agg(*[F.count_distinct(f"`{c}`").alias(c) for c in maybe]).first() if maybe else {}
        out[t] = [c for c in maybe if exact[c] == about["_n"]]
    return out


def discovered_foreign(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> list[ForeignKey]:
    """Foreign keys by inclusion: columns all of whose values (and some) are of another table's key.

    Only columns whose names end alike, as o_custkey and c_custkey, are compared. All columns in
    question become one table of distinct values, read once a table; a value meets the columns
    that have it, and inclusions are counted for all pairs at once.
    """
    tail = lambda c: c.lower().rsplit("_", 1)[-1]
    pairs = []
    for t, df in tables.items():
        for target, own in keys.items():
            for key in own:
                for c, kind in df.dtypes:
                    if (t, c) == (target, key) or tail(c) != tail(key) or kind != dict(tables[target].dtypes)[key]:
                        continue
                    if t == target or c in keys.get(t, ()) and key not in keys[target][:1]:
                        continue
                    pairs.append(((t, c), (target, key)))
    if not pairs:
        return []
    number = {x: i for i, x in enumerate(dict.fromkeys(x for pair in pairs for x in pair))}
    values = None
    for t, df in tables.items():
        cells = [F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for (x, c), i in number.items() if x == t]
        if cells:
            some = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
            values = some if values is None else values.unionAll(some)
    # A value has at most one entry a column.
    held = values.where("v IS NOT NULL").distinct().groupBy("v").agg(F.collect_set("i").alias("has"))
    has = lambda i: F.array_contains("has", i)
    sums = [F.sum(has(number[a]).cast("long")).alias(f"n{k}") for k, (a, _) in enumerate(pairs)]
    sums += [F.sum((has(number[a]) & has(number[b])).cast("long")).alias(f"m{k}") for k, (a, b) in enumerate(pairs)]
    r = held.agg(*sums).first()
    return [ForeignKey(t, target, (c,), (key,)) for k, ((t, c), (target, key)) in enumerate(pairs) if r[f"n{k}"] and r[f"n{k}"] == r[f"m{k}"]]


def read_jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of any database with a JDBC driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def infer_property_type(df: DataFrame, column: str) -> str:
    """Type of a text column by its values: datetime, boolean, int, float, else string."""
    c = F.col(column)
    flags = df.agg(
        F.max(F.try_to_timestamp(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c)).isNotNull()).alias("datetime"),
        F.coalesce(F.min(F.when(c.isNotNull(), F.lower(c).isin("true", "false"))), F.lit(False)).alias("boolean"),
        F.coalesce(F.min(F.when(c.isNotNull(), c.rlike(r"^[+-]?\d+$"))), F.lit(False)).alias("int"),
        F.coalesce(F.min(F.when(c.isNotNull(), c.try_cast("double").isNotNull())), F.lit(False)).alias("float"),
    ).first()
    return next((k for k in ("datetime", "boolean", "int", "float") if flags[k]), "string")


def classify_tables(keys: dict[str, list[str]], foreign: Iterable[ForeignKey]) -> dict[str, str]:
    """'entity', 'join' or 'open' for each table with primary key ``keys[table]``.

    At most one foreign key: an entity. A join table has its whole primary key inside
    foreign keys, at least two distinct ones of which lie inside the primary key.
    """
    by = defaultdict(list)
    for fk in foreign:
        by[fk.table].append(fk)
    out = {}
    for table, primary in keys.items():
        fks = by[table]
        pk = set(primary)
        covered = {c for fk in fks for c in fk.columns}
        inner = {tuple(fk.columns) for fk in fks if set(fk.columns) <= pk}
        out[table] = "entity" if len(fks) <= 1 else "join" if pk and pk <= covered and len(inner) >= 2 else "open"
    return out


def foreign_by_target(foreign: Iterable[ForeignKey]) -> dict[str, dict[str, list[tuple]]]:
    """For each table, its target tables and the column pairs that lead there."""
    out: dict[str, dict[str, list[tuple]]] = defaultdict(lambda: defaultdict(list))
    for fk in foreign:
        out[fk.table][fk.target].append((fk.columns, fk.target_columns))
    return {t: dict(x) for t, x in out.items()}


def valid_foreign(foreign: Iterable[ForeignKey], columns: dict[str, list[str]]) -> list[ForeignKey]:
    """Foreign keys whose tables and columns exist."""
    return [
        fk for fk in foreign
        if fk.table in columns and fk.target in columns and set(fk.columns) <= set(columns[fk.table]) and set(fk.target_columns) <= set(columns[fk.target])
    ]


def fk_edges(source: DataFrame, target: DataFrame, fk: ForeignKey, source_id: str, target_id: str, policy: str = "all_pairs") -> DataFrame:
    """_src, _dst of the edges of a foreign key.

    'all_pairs' links every matching pair; 'first_match' makes one edge for each distinct
    key, between the first row (least id) of either side. First rows are minima, so no key
    needs all of its rows in one task.
    """
    a = source.select(F.col(source_id).alias("_src"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(fk.columns)])
    b = target.select(F.col(target_id).alias("_dst"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(fk.target_columns)])
    keys = [f"_k{i}" for i in range(len(fk.columns))]
    if policy == "first_match":
        a, b = a.groupBy(*keys).agg(F.min("_src").alias("_src")), b.groupBy(*keys).agg(F.min("_dst").alias("_dst"))
    elif policy != "all_pairs":
        raise ValueError(policy)
    return a.join(b, keys).select("_src", "_dst")


def jt_edges(table: DataFrame, left: tuple[DataFrame, ForeignKey, str], right: tuple[DataFrame, ForeignKey, str], properties: str = "all") -> DataFrame:
    """_src, _dst and properties of the edges of a join table, repeated ones once.

    ``properties``: 'all' columns of the table, or only its 'non_key' ones.
    """
    (a, fa, ida), (b, fb, idb) = left, right
    own = [*fa.columns, *fb.columns]
    kept = [c for c in table.columns if properties == "all" or c not in own]
    rows = table.dropna(subset=own).select(*dict.fromkeys([*own, *kept])).distinct()
    x = a.groupBy(*fa.target_columns).agg(F.min(ida).alias("_src")).select("_src", *[F.col(c).alias(f"_a{i}") for i, c in enumerate(fa.target_columns)])
    y = b.groupBy(*fb.target_columns).agg(F.min(idb).alias("_dst")).select("_dst", *[F.col(c).alias(f"_b{i}") for i, c in enumerate(fb.target_columns)])
    on_x, on_y = F.lit(True), F.lit(True)
    for i, c in enumerate(fa.columns):
        on_x = on_x & (F.col(c) == F.col(f"_a{i}"))
    for i, c in enumerate(fb.columns):
        on_y = on_y & (F.col(c) == F.col(f"_b{i}"))
    return rows.join(x, on_x).join(y, on_y).select("_src", "_dst", *kept)


def json_graph(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph from JSON {nodes: [{id, type, properties}], relationships: [{id, type,
    from_node, to_node, properties}]}.

    Each type gets the union of its elements' properties; a relationship without one of its
    ends is left out. Values of ``properties`` are typed by what they look like.
    """
    doc = spark.read.option("multiLine", True).option("prefersDecimal", False).json(path)
    nodes = doc.select(F.explode("nodes").alias("x")).select("x.*")
    if "relationships" not in doc.columns or not str(doc.schema["relationships"].dataType).startswith("ArrayType(StructType"):
        return _element_graph(nodes, None)
    return _element_graph(nodes, doc.select(F.explode("relationships").alias("x")).select("x.*"))


def json_lines_graph(spark: SparkSession, nodes: str, relationships: str | None = None) -> PropertyGraph:
    """The same graph from files of one element a line, which many tasks read."""
    read = lambda p: spark.read.option("prefersDecimal", False).json(p)
    return _element_graph(read(nodes), read(relationships) if relationships else None)


def _fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema["properties"].dataType.fields] if "properties" in df.columns and str(df.schema["properties"].dataType).startswith("StructType") else []


def _used(df: DataFrame, by: list[str]) -> dict[tuple, list[str]]:
    """For each group the properties that some element has: one pass, one row a group."""
    own = _fields(df)
    some = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.max(F.col(f"properties.`{c}`").isNotNull()).alias(f"p{i}") for i, c in enumerate(own)])
    return {tuple(r[k] for k in by): [c for i, c in enumerate(own) if r[f"p{i}"]] for r in some.collect()}


def _element_graph(nodes: DataFrame, rels: DataFrame | None) -> PropertyGraph:
    graph = PropertyGraph()
    for (label,), own in sorted(_used(nodes, ["type"]).items()):
        graph.add(NodeTable(label, nodes.where(F.col("type") == label).select(F.col("id").alias("_id"), *[F.col(f"properties.`{c}`").alias(c) for c in own]), "_id"))
    if rels is None:
        return graph
    label_of = nodes.select("id", "type")
    ends = rels.join(label_of.select(F.col("id").alias("from_node"), F.col("type").alias("_a")), "from_node").join(label_of.select(F.col("id").alias("to_node"), F.col("type").alias("_b")), "to_node")
    for (kind, a, b), own in sorted(_used(ends, ["type", "_a", "_b"]).items()):
        some = ends.where((F.col("type") == kind) & (F.col("_a") == a) & (F.col("_b") == b))
        flat = some.select(F.col("id").alias("_eid"), F.col("from_node").alias("_src"), F.col("to_node").alias("_dst"), *[F.col(f"properties.`{c}`").alias(c) for c in own])
        graph.add(EdgeTable(kind, a, b, flat, "_src", "_dst", "_eid", tuple(own)))
    return graph


def _folder(*parts: str) -> str:
    return "/".join(p.strip("/") if i else p.rstrip("/") for i, p in enumerate(parts))


def write_graph(graph: PropertyGraph, path: str) -> None:
    """A graph as Parquet: nodes first, then edges, then the catalogue that says what is where."""
    spark, entries = None, []
    for label, n in graph.nodes.items():
        spark = n.df.sparkSession
        n.df.write.mode("overwrite").parquet(_folder(path, "nodes", label))
        entries.append({"kind": "node", "label": label, "key": n.key, "at": f"nodes/{label}"})
    for type_, tables in graph.edges.items():
        for i, e in enumerate(tables):
            at = f"edges/{type_}_{i}"
            plain = e.df.select(F.col(e.eid).alias("_eid"), F.col(e.source).alias("_src"), F.col(e.target).alias("_dst"), *[f"`{c}`" for c in e.properties])
            plain.write.mode("overwrite").parquet(_folder(path, at))
            entries.append({"kind": "edge", "type": type_, "source": e.source_label, "target": e.target_label, "properties": list(e.properties), "complete": e.complete, "at": at})
    rows = [(json.dumps(x, ensure_ascii=False),) for x in entries]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(_folder(path, "catalogue"))


def read_graph(spark: SparkSession, path: str) -> PropertyGraph:
    """The graph that ``write_graph`` wrote."""
    graph = PropertyGraph()
    for (line,) in spark.read.text(_folder(path, "catalogue")).collect():  # one row a table
        x = json.loads(line)
        df = spark.read.parquet(_folder(path, x["at"]))
        if x["kind"] == "node":
            graph.add(NodeTable(x["label"], df, x["key"]))
        else:
            graph.add(EdgeTable(x["type"], x["source"], x["target"], df, "_src", "_dst", "_eid", tuple(x["properties"]), x["complete"]))
    return graph


def write_json_graph(graph: PropertyGraph, nodes: str, relationships: str) -> None:
    """Elements as JSON lines, as ``json_lines_graph`` reads them; null properties are left out."""
    for i, (label, n) in enumerate(graph.nodes.items()):
        props = F.struct(*[f"`{c}`" for c in n.properties]) if n.properties else F.create_map().cast("map<string,string>")
        n.df.select(F.col(n.key).cast("string").alias("id"), F.lit(label).alias("type"), props.alias("properties")).write.mode("append" if i else "overwrite").json(nodes)
    done = False
    for type_, tables in graph.edges.items():
        for e in tables:
            props = F.struct(*[f"`{c}`" for c in e.properties]) if e.properties else F.create_map().cast("map<string,string>")
            rows = e.df.select(F.col(e.eid).cast("string").alias("id"), F.lit(type_).alias("type"), F.col(e.source).cast("string").alias("from_node"), F.col(e.target).cast("string").alias("to_node"), props.alias("properties"))
            rows.write.mode("append" if done else "overwrite").json(relationships)
            done = True


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines in UTF-8: results, templates, reports."""
    df.write.mode("overwrite").json(path)


def write_schema(spark: SparkSession, schema: GraphSchema, path: str) -> None:
    """A graph schema as one JSON document."""
    text = json.dumps(asdict(schema), ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_schema(spark: SparkSession, path: str) -> GraphSchema:
    x = json.loads(spark.read.option("wholetext", True).text(path).first()[0])
    props = lambda rows: tuple(Property(**(p | {"allowed_values": tuple(p["allowed_values"])})) for p in rows)
    return GraphSchema(
        x["name"],
        tuple(NodeType(n["name"], props(n["properties"])) for n in x["nodes"]),
        tuple(RelationshipType(**(r | {"properties": props(r["properties"])})) for r in x["relationships"]),
        tuple(BusinessConstraint(**c) for c in x["constraints"]),
        tuple(CyclePattern(c["name"], tuple(c["path"])) for c in x["cycles"]),
    )


def write_templates(spark: SparkSession, templates: Iterable, path: str) -> None:
    """Query templates as JSON lines: type, complexity, hops and the text in both dialects."""
    rows = [(t.type, t.complexity, t.hops, t.text("cypher"), t.text("gql")) for t in templates]
    write_json(spark.createDataFrame(rows, "type string, complexity string, hops int, cypher string, gql string"), path)


def row_ids(df: DataFrame, key: str | None = None) -> DataFrame:
    """``df`` with _id: its key, or a hash of the row numbered among equal rows."""
    if key:
        return df.withColumn("_id", F.col(key))
    h = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    n = F.row_number().over(Window.partitionBy("_h").orderBy(F.lit(1)))
    return df.withColumn("_h", h).withColumn("_id", F.concat("_h", F.lit("-"), n)).drop("_h")


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def aligned(name: str, names: list[str], embedder=None) -> str:
    """The name meant: as written, else without regard to case, else the nearest, by the
    cosine of an ``embedder``'s vectors or by edits."""
    if name in names:
        return name
    low = [x for x in names if x.lower() == name.lower()]
    if low:
        return low[0]
    if embedder is not None:
        mine, *others = embedder.embed([name, *names])
        return max(zip(names, others, strict=True), key=lambda p: (sum(a * b for a, b in zip(mine, p[1], strict=True)), p[0]))[0]
    return min(names, key=lambda x: (edit_distance(name.lower(), x.lower()), x))


def canonical_edges(edges: Iterable[tuple], synonyms: dict) -> list[tuple]:
    """Edge entries (label, source, target, ...) under their canonical labels, repeated ones once.

    ``synonyms`` maps a label, or (label, source, target) where a word means one thing between
    these tables only, to the canonical label.
    """
    return list(dict.fromkeys((synonyms.get((e[0], e[1], e[2]), synonyms.get(e[0], e[0])), *e[1:]) for e in edges))


def edge_maps(edges: Iterable, kinds: dict[str, str]) -> dict[str, dict[tuple[str, str], list]]:
    """Edges by how they came about: {'fk': {(source, target): [...]}, 'jt': {...}}; ``kinds`` tells join tables."""
    out: dict[str, dict[tuple[str, str], list]] = {"fk": {}, "jt": {}}
    for e in edges:
        out["jt" if e.via and kinds.get(e.via) == "join" else "fk"].setdefault((e.source, e.target), []).append(e)
    return out


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark pairs of questions and queries; a missing dialect is cypher."""
    schema = "nl_query string, gql_statement string, db_id string, gql_dialect string, source string, evidence string"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.withColumn("gql_dialect", F.coalesce("gql_dialect", F.lit("cypher")))


def with_schema(pairs: DataFrame, schemas: Iterable[GraphSchema]) -> DataFrame:
    """``pairs`` with ``schema``, the text of the graph schema that their ``db_id`` names (null if there is none)."""
    def text(s: GraphSchema) -> str:
        nodes = [f"({n.name} {{{', '.join(f'{p.name}: {p.type}' for p in n.properties)}}})" for n in s.nodes]
        return "; ".join(nodes + [f"({r.source})-[{r.name}]->({r.target})" for r in s.relationships])

    listed = pairs.sparkSession.createDataFrame([(s.name, text(s)) for s in schemas], "_name string, schema string")
    return pairs.join(listed, F.lower("db_id") == F.lower("_name"), "left").drop("_name")
