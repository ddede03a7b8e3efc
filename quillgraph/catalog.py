"""What a graph is made of: schemas, keys, edge types, and node and edge tables."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Property types of graph schemas and their Spark types.
PROPERTY_TYPES = {
    "string": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
}


@dataclass(frozen=True)
class Property:
    name: str
    type: str = "string"
    required: bool = True
    unique: bool = False
    min_value: float | None = None
    max_value: float | None = None
    allowed_values: tuple = ()
    #: SQL over earlier properties that gives this one, if it is not drawn.
    formula: str | None = None
    #: An earlier date that this one does not lie before.
    after: str | None = None
    #: SQL predicate on earlier properties without which this one is null.
    only_if: str | None = None


@dataclass(frozen=True)
class NodeType:
    name: str
    properties: tuple[Property, ...] = ()

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(p.name, PROPERTY_TYPES[p.type], not p.required) for p in self.properties])


@dataclass(frozen=True)
class RelationshipType:
    name: str
    source: str
    target: str
    properties: tuple[Property, ...] = ()
    cardinality: str = "N:M"
    max_per_source: int | None = None
    max_per_target: int | None = None


@dataclass(frozen=True)
class CyclePattern:
    name: str
    path: tuple[str, ...]  # node, relationship, node, ..., first node


#: Kinds of constraints.
CONSTRAINT_KINDS = ("business_logic", "temporal_consistency", "state_consistency", "referential_integrity", "numerical_consistency")


@dataclass(frozen=True)
class BusinessConstraint:
    """A rule on one node type: ``condition`` is a SQL predicate that every node satisfies.

    With ``edge`` the rule is on a relationship type instead: a predicate over source.x,
    target.x and edge.x of every relationship. Of referential integrity, ``edge`` alone says
    that both ends exist, and with a condition 'source' or 'target' that every node of that
    end has such a relationship.
    """

    name: str
    kind: str
    node: str
    condition: str
    edge: str | None = None


@dataclass(frozen=True)
class GraphSchema:
    name: str
    nodes: tuple[NodeType, ...]
    relationships: tuple[RelationshipType, ...]
    constraints: tuple[BusinessConstraint, ...] = ()
    cycles: tuple[CyclePattern, ...] = ()

    def node(self, name: str) -> NodeType:
        return next(n for n in self.nodes if n.name == name)


@dataclass(frozen=True)
class ForeignKey:
    table: str
    target: str
    columns: tuple[str, ...]
    target_columns: tuple[str, ...]


@dataclass(frozen=True)
class NodeTable:
    """Nodes of one label. ``key`` is the id column, unique in ``df``."""

    label: str
    df: DataFrame
    key: str

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("_")]


@dataclass(frozen=True)
class EdgeTable:
    """Edges of one type from label to label.

    ``df`` has the end ids in ``source`` and ``target``, an id in ``eid`` and properties.
    ``complete`` says that both ends always exist, so an end that a query does not look
    into needs no join. ``held_by`` names the label whose own table the edges are columns
    of (a foreign key): looking at that end costs no join either.
    """

    type: str
    source_label: str
    target_label: str
    df: DataFrame
    source: str
    target: str
    eid: str
    properties: tuple[str, ...] = ()
    complete: bool = True
    held_by: str | None = None


@dataclass
class PropertyGraph:
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    edges: dict[str, list[EdgeTable]] = field(default_factory=lambda: defaultdict(list))
    #: Counts and degrees that order joins, once ``Engine.analyze`` has taken them.
    statistics: object | None = None

    def add(self, *tables: NodeTable | EdgeTable) -> PropertyGraph:
        for t in tables:
            if isinstance(t, NodeTable):
                self.nodes[t.label] = t
            else:
                self.edges.setdefault(t.type, []).append(t)
        return self

    def label(self, name: str) -> str:
        """The label of that name; case is ignored if it isn't found as written."""
        if name in self.nodes:
            return name
        found = [x for x in self.nodes if x.lower() == name.lower()]
        if not found:
            raise KeyError(f"no node label {name}")
        return found[0]

    def type(self, name: str) -> str:
        if name in self.edges:
            return name
        found = [x for x in self.edges if x.lower() == name.lower()]
        if not found:
            raise KeyError(f"no relationship type {name}")
        return found[0]


def register_views(graph: PropertyGraph, prefix: str = "") -> list[str]:
    """A temporary view for every label and relationship type, for ``spark.sql``; their names.

    Nodes have _id, relationships _eid, _src, _dst; several tables of one type are united by name.
    """
    names = []
    for label, n in graph.nodes.items():
        n.df.select(F.col(n.key).alias("_id"), *[f"`{c}`" for c in n.properties]).createOrReplaceTempView(f"{prefix}{label}")
        names.append(f"{prefix}{label}")
    for type_, tables in graph.edges.items():
        out = None
        for e in tables:
            df = e.df.select(F.col(e.eid).alias("_eid"), F.col(e.source).alias("_src"), F.col(e.target).alias("_dst"), *[f"`{c}`" for c in e.properties])
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        out.createOrReplaceTempView(f"{prefix}{type_}")
        names.append(f"{prefix}{type_}")
    return names


def validate_catalog(graph: PropertyGraph) -> list[str]:
    """Findings: properties of one name and several types, edges without end labels, doubtful keys."""
    found, seen = [], defaultdict(dict)
    for n in graph.nodes.values():
        if n.key not in n.df.columns:
            found.append(f"label {n.label}: no column {n.key}")
        for name, kind in n.df.dtypes:
            seen[name].setdefault(kind, []).append(n.label)
    for type_, tables in graph.edges.items():
        for e in tables:
            found += [f"edge {type_}: no label {x}" for x in (e.source_label, e.target_label) if x not in graph.nodes]
            kinds = dict(e.df.dtypes)
            for name in e.properties:
                seen[name].setdefault(kinds.get(name, "missing"), []).append(type_)
    found += [f"property {name} has types {sorted(kinds)}" for name, kinds in seen.items() if len(kinds) > 1]
    return found


def numbered_labels(names: list[str]) -> list[str]:
    """Repeated edge labels get _1, _2, ... in order; single ones stay."""
    total, seen, out = defaultdict(int), defaultdict(int), []
    for n in names:
        total[n] += 1
    for n in names:
        seen[n] += 1
        out.append(f"{n}_{seen[n]}" if total[n] > 1 else n)
    return out
