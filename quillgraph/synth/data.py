"""Seeded graph data for a schema, made in Spark: every value is a hash of (seed, name, row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.catalog import PROPERTY_TYPES, BusinessConstraint, EdgeTable, GraphSchema, NodeTable, Property, PropertyGraph, RelationshipType
from quillgraph.functions.expressions import attribute_string, numeric_similarity
from quillgraph.functions.models import embedded
from quillgraph.operators.relational import cardinality_violations, constraint_violations, missing_ends, similarity_matrix, similarity_top_k, top_k, unique_violations

#: Candidates kept for a node by similarity, and the probability of the geometric draw.
CANDIDATES, P = 10, 0.5
#: Blocks that targets are dealt to when compared.
BLOCKS = 16


def uniform(seed: int, *parts) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.lit(p) if isinstance(p, str) else p for p in parts]), F.lit(1 << 40)) / float(1 << 40)


def value(p: Property, label: str, seed: int) -> Column:
    """A property of row ``i``; what it depends on stands in columns of their names."""
    if p.formula:
        return F.expr(p.formula).cast(PROPERTY_TYPES[p.type])
    drawn = _drawn(p, label, seed)
    return F.when(F.expr(p.only_if), drawn) if p.only_if else drawn


def _drawn(p: Property, label: str, seed: int) -> Column:
    u = uniform(seed, f"{label}.{p.name}", F.col("i"))
    if p.unique:
        return F.format_string(f"{label.upper()}_%06d", F.col("i"))
    if p.allowed_values:
        return F.element_at(F.array(*map(F.lit, p.allowed_values)), (F.floor(u * len(p.allowed_values)) + 1).cast("int"))
    low = 0.0 if p.min_value is None else p.min_value
    high = 1000.0 if p.max_value is None else p.max_value
    if p.type == "int":
        return F.floor(low + u * (high - low + 1)).cast("long")
    if p.type == "float":
        return F.round(low + u * (high - low), 2)
    if p.type == "boolean":
        return u < 0.5
    if p.after and p.type == "date":
        return F.date_add(F.col(p.after), F.floor(u * 365).cast("int"))
    if p.after:
        return F.timestamp_add("SECOND", F.floor(u * 86400).cast("int"), F.col(p.after))
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.floor(u * 1826).cast("int"))
    if p.type == "date":
        return day
    if p.type == "datetime":
        return (day.cast("timestamp_ntz") + F.make_dt_interval(secs=F.floor(uniform(seed + 1, p.name, F.col("i")) * 86400).cast("int"))).cast("timestamp_ntz")
    return F.concat(F.lit(f"{p.name}_"), F.floor(u * 100_000).cast("string"))


def nodes(spark: SparkSession, schema: GraphSchema, label: str, n: int, seed: int) -> DataFrame:
    props = schema.node(label).properties
    df = spark.range(n).withColumnRenamed("id", "i")
    free = [p for p in props if not (p.formula or p.after or p.only_if)]
    df = df.select("i", F.concat(F.lit(f"{label}_"), F.col("i")).alias("_id"), *[value(p, label, seed).alias(p.name) for p in free])
    for p in props:  # what depends on others, in the order of the schema
        if p not in free:
            df = df.withColumn(p.name, value(p, label, seed))
    return df.select("_id", *[p.name for p in props])


def capped(edges: DataFrame, r: RelationshipType, seed: int) -> DataFrame:
    """At most the allowed connections of each source, then of each target, in seeded order."""
    order = F.xxhash64(F.lit(seed), "_src", "_dst")
    caps = [("_src", r.max_per_source or (1 if r.cardinality in ("1:1", "N:1") else None)), ("_dst", r.max_per_target or (1 if r.cardinality in ("1:1", "1:N") else None))]
    for column, most in caps:
        if most is not None:
            edges = edges.withColumn("_n", F.row_number().over(Window.partitionBy(column).orderBy(order, "_src", "_dst"))).where(F.col("_n") <= most).drop("_n")
    return edges


def random_edges(spark: SparkSession, r: RelationshipType, n_source: int, n_target: int, n: int, seed: int) -> DataFrame:
    """Distinct uniform pairs without loops, within the caps."""
    pick = lambda k, label, m: F.concat(F.lit(f"{label}_"), F.floor(uniform(seed, f"{r.name}{k}", F.col("id")) * m).cast("long"))
    pairs = spark.range(n).select(pick(0, r.source, n_source).alias("_src"), pick(1, r.target, n_target).alias("_dst")).where("_src <> _dst").distinct()
    return capped(pairs, r, seed)


def similar_edges(source: DataFrame, target: DataFrame, r: RelationshipType, schema: GraphSchema, seed: int, embedder=None) -> DataFrame:
    """Edges by likeness: of each source's most similar targets, the i-th is taken with
    probability (1 - P)^i * P, within the caps.

    Every source meets every target. With an ``embedder`` the likeness is the cosine of the
    vectors of their attributes as text; else it is that of the numbers both ends have,
    where targets are dealt to blocks that keep their best before blocks are merged. Without
    a shared number all are 0.5 alike.
    """
    near = embedded_neighbours(source, target, r, schema, embedder) if embedder is not None else _numeric_neighbours(source, target, r, schema)
    chance = F.pow(F.lit(1 - P), F.col("rank") - 1) * P
    return capped(near.where(uniform(seed, r.name, F.col("_src"), F.col("_dst")) < chance).select("_src", "_dst"), r, seed)


def _numeric_neighbours(source: DataFrame, target: DataFrame, r: RelationshipType, schema: GraphSchema) -> DataFrame:
    shared = [(p, q) for p in schema.node(r.source).properties for q in schema.node(r.target).properties if p.name == q.name and p.type in ("int", "float") and q.type == p.type]
    a = source.select(F.col("_id").alias("_src"), *[F.col(x.name).alias(f"a_{x.name}") for x, _ in shared]).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    b = target.select(F.col("_id").alias("_dst"), *[F.col(x.name).alias(f"b_{x.name}") for _, x in shared]).withColumn("_b", F.pmod(F.xxhash64("_dst"), F.lit(BLOCKS)).cast("int"))
    score = numeric_similarity([(F.col(f"a_{x.name}"), F.col(f"b_{x.name}"), (x.max_value or 1000.0) - (x.min_value or 0.0)) for x, _ in shared])
    pairs = a.join(b, "_b").where("_src <> _dst").withColumn("score", score)
    best = top_k(pairs, ["_src", "_b"], [F.desc("score"), F.asc("_dst")], CANDIDATES).drop("rank")
    return top_k(best, ["_src"], [F.desc("score"), F.asc("_dst")], CANDIDATES).select("_src", "_dst", "score", "rank")


def _described(df: DataFrame, names: list[str], embedder) -> DataFrame:
    """_id and the vector of the attributes as text; a missing one is skipped."""
    return df.select("_id", embedded(attribute_string([n for n in names if n in df.columns]), embedder).alias("vector"))


def embedded_neighbours(source: DataFrame, target: DataFrame, r: RelationshipType, schema: GraphSchema, embedder) -> DataFrame:
    """_src, _dst, score, rank of each source's most similar targets by the vectors of the source type's attributes."""
    names = [p.name for p in schema.node(r.source).properties]
    near = similarity_top_k(_described(source, names, embedder), _described(target, names, embedder), "_id", "vector", CANDIDATES)
    return near.select(F.col("from_id").alias("_src"), F.col("to_id").alias("_dst"), "score", "rank")


def embedded_matrix(source: DataFrame, target: DataFrame, r: RelationshipType, schema: GraphSchema, embedder) -> DataFrame:
    """from_id, to_id, score of all pairs of a relationship type's ends."""
    names = [p.name for p in schema.node(r.source).properties]
    return similarity_matrix(_described(source, names, embedder), _described(target, names, embedder), "_id", "vector")


def _allowed(edges: DataFrame, r: RelationshipType, schema: GraphSchema, frames: dict[str, DataFrame]) -> DataFrame:
    """Edges for which the rules on their type hold."""
    for c in schema.constraints:
        if c.edge == r.name and c.kind != "referential_integrity":
            edges = _with_ends(edges, r, frames).where(F.coalesce(F.expr(c.condition), F.lit(True))).select("_src", "_dst")
    return edges


def _with_ends(edges: DataFrame, r: RelationshipType, frames: dict[str, DataFrame]) -> DataFrame:
    """Edges with their ends as structs ``source`` and ``target``."""
    end = lambda label, name, key: frames[label].select(F.col("_id").alias(key), F.struct("*").alias(name))
    return edges.join(end(r.source, "source", "_src"), "_src").join(end(r.target, "target", "_dst"), "_dst")


def _completed(edges: DataFrame, r: RelationshipType, schema: GraphSchema, frames: dict[str, DataFrame], each: int, seed: int) -> DataFrame:
    """Edges for ends that have to have one and have none, to a partner by hash."""
    for c in schema.constraints:
        if c.edge == r.name and c.kind == "referential_integrity" and c.condition in ("source", "target"):
            own, other, far = ("_src", "_dst", r.target) if c.condition == "source" else ("_dst", "_src", r.source)
            alone = frames[r.source if c.condition == "source" else r.target].select(F.col("_id").alias(own)).join(edges, own, "left_anti")
            edges = edges.unionByName(alone.withColumn(other, F.concat(F.lit(f"{far}_"), F.floor(uniform(seed, r.name, F.col(own)) * each).cast("long"))))
    return edges


def generate(spark: SparkSession, schema: GraphSchema, n_nodes: int = 200, n_edges: int = 100, cycles: int = 3, seed: int = 0, embedder=None) -> PropertyGraph:
    """A graph of about ``n_nodes`` nodes and edges of every type, with whole cycles planted.

    Edges keep the schema's rules: pairs that break one are left out, ends that need an edge get one.
    """
    each = max(3, n_nodes // len(schema.nodes))
    graph, frames = PropertyGraph(), {}
    for t in schema.nodes:
        frames[t.name] = nodes(spark, schema, t.name, each, seed)
        graph.add(NodeTable(t.name, frames[t.name], "_id"))
    for r in schema.relationships:
        found = similar_edges(frames[r.source], frames[r.target], r, schema, seed, embedder)
        more = random_edges(spark, r, each, each, n_edges, seed)
        edges = capped(_allowed(found.unionByName(more).distinct(), r, schema, frames), r, seed)
        edges = _completed(edges, r, schema, frames, each, seed)
        planted = [c for c in schema.cycles if r.name in c.path]
        for c in planted:
            hops = len(c.path) // 2
            # Cycle k runs through nodes k*hops ... k*hops + hops - 1.
            rows = spark.range(cycles).select(F.col("id"), F.explode(F.sequence(F.lit(0), F.lit(hops - 1))).alias("h"))
            node = lambda h: F.concat(F.lit(f"{r.source}_"), F.pmod(F.col("id") * hops + F.pmod(h, F.lit(hops)), F.lit(each)))  # noqa: E731, B023
            edges = edges.unionByName(rows.select(node(F.col("h")).alias("_src"), node(F.col("h") + 1).alias("_dst"))).distinct()
        since = F.date_add(F.lit("2020-01-01").cast("date"), F.floor(uniform(seed, "since", F.col("_src"), F.col("_dst")) * 1826).cast("int"))
        edges = edges.select(F.concat_ws("-", F.lit(r.name), "_src", "_dst").alias("_eid"), "_src", "_dst", since.alias("since"))
        graph.add(EdgeTable(r.name, r.source, r.target, edges, "_src", "_dst", "_eid", ("since",)))
    return graph


def rule_violations(graph: PropertyGraph, schema: GraphSchema, c: BusinessConstraint) -> DataFrame:
    """constraint and id of what breaks one rule: nodes, or relationships by their id."""
    if c.edge is None:
        return constraint_violations(graph.nodes[c.node].df, "_id", c.name, c.condition)
    r = next(x for x in schema.relationships if x.name == c.edge)
    frames = {n: t.df for n, t in graph.nodes.items()}
    name = F.lit(c.name).alias("constraint")
    out = None
    for e in graph.edges[c.edge]:
        edges = e.df.select(F.col(e.eid).alias("_eid"), F.col(e.source).alias("_src"), F.col(e.target).alias("_dst"), F.struct("*").alias("edge"))
        if c.kind != "referential_integrity":
            bad = _with_ends(edges, r, frames).where(~F.coalesce(F.expr(c.condition), F.lit(True))).select(name, F.col("_eid").cast("string").alias("id"))
        elif c.condition == "ends":
            a, b = missing_ends(edges, "_src", frames[r.source], "_id"), missing_ends(edges, "_dst", frames[r.target], "_id")
            bad = a.unionByName(b).select(name, F.col("_eid").cast("string").alias("id")).distinct()
        else:
            label, key = (r.source, "_src") if c.condition == "source" else (r.target, "_dst")
            bad = frames[label].join(edges.select(F.col(key).alias("_id")), "_id", "left_anti").select(name, F.col("_id").alias("id"))
        out = bad if out is None else out.unionByName(bad)
    return out


def violations(graph: PropertyGraph, schema: GraphSchema) -> DataFrame:
    """constraint and id of everything that breaks the schema: rules, unique values, caps."""
    parts = [rule_violations(graph, schema, c) for c in schema.constraints]
    for t in schema.nodes:
        parts += [unique_violations(graph.nodes[t.name].df, p.name).select(F.lit(f"unique {t.name}.{p.name}").alias("constraint"), F.col(p.name).cast("string").alias("id")) for p in t.properties if p.unique]
    for r in schema.relationships:
        if not any(r.name in c.path for c in schema.cycles):
            for e in graph.edges[r.name]:
                bad = cardinality_violations(e.df, "_src", "_dst", r.max_per_source, r.max_per_target)
                parts.append(bad.select(F.concat(F.lit(f"cap {r.name} "), "side").alias("constraint"), "id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cycle_text(path: tuple[str, ...]) -> str:
    """The query that finds a declared cycle: its last node is its first."""
    names = [f"(n{i}:{path[2 * i]})" for i in range(len(path) // 2)]
    text = names[0]
    for i, rel in enumerate(path[1::2]):
        text += f"-[r{i}:{rel}]->" + (names[i + 1] if i + 1 < len(names) else "(n0)")
    return f"MATCH {text} RETURN n0"


def extracted(payload: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and relationships of listed cycles, each id once (its first place by cycle)."""
    steps = payload.select("cycle", F.posexplode("path").alias("at", "x")).where("x.id IS NOT NULL")
    once = steps.groupBy("x.kind", "x.id").agg(F.min_by("x", F.struct("cycle", "at")).alias("x")).select("x.*")
    return once.where("kind = 'node'").select("id"), once.where("kind = 'relationship'").select("id", "from_node", "to_node")


def path_problems(payload: DataFrame) -> DataFrame:
    """Findings on listed cycles (cycle, path: array of {kind, id, from_node, to_node}).

    Elements have to alternate, and each relationship has to join its neighbours.
    """
    steps = payload.select("cycle", F.posexplode("path").alias("at", "x"), F.size("path").alias("n"))
    w = Window.partitionBy("cycle").orderBy("at")
    steps = steps.withColumn("before", F.lag("x.id").over(w)).withColumn("after", F.lead("x.id").over(w))
    want = F.when(F.col("at") % 2 == 0, F.lit("node")).otherwise(F.lit("relationship"))
    wrong = F.when(F.col("x.kind") != want, F.lit("does not alternate"))
    linked = F.col("x.from_node").eqNullSafe(F.col("before")) & F.col("x.to_node").eqNullSafe(F.col("after"))
    wrong = wrong.when((F.col("x.kind") == "relationship") & ~linked, F.lit("does not join its neighbours"))
    return steps.withColumn("problem", wrong).where("problem is not null").select("cycle", "at", "problem")
