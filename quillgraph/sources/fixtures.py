"""The star tables as a property graph."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillgraph.catalog import EdgeTable, NodeTable, PropertyGraph

#: Label, table, key.
NODES = [
    ("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"),
    ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Orders", "orders", "o_orderkey"),
]
#: Type, source label, target label, table, source column, target column, holder.
FOREIGN = [
    ("IN_REGION", "Nation", "Region", "nation", "n_nationkey", "n_regionkey", "source"),
    ("CUSTOMER_IN", "Customer", "Nation", "customer", "c_custkey", "c_nationkey", "source"),
    ("SUPPLIER_IN", "Supplier", "Nation", "supplier", "s_suppkey", "s_nationkey", "source"),
    ("PLACED", "Customer", "Orders", "orders", "o_custkey", "o_orderkey", "target"),
]
#: Edges with properties, all rows of lineitem.
LINES = [("CONTAINS", "Orders", "Part", "l_orderkey", "l_partkey"), ("FULFILLED_BY", "Orders", "Supplier", "l_orderkey", "l_suppkey"), ("SUPPLIES", "Supplier", "Part", "l_suppkey", "l_partkey")]
LINE_PROPERTIES = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nodes, foreign-key edges, and lineitem as three kinds of edges.

    No key of lineitem is unique, so an edge's id is its row's file and place there: equal rows
    are edges of their own, and no column is read for it.
    """
    graph = PropertyGraph()
    tables = {name: read_table(spark, sf_dir, name) for _, name, _ in NODES}
    for label, table, key in NODES:
        graph.add(NodeTable(label, tables[table], key))
    keys = {label: key for label, _, key in NODES}
    for type_, a, b, table, source, target, holder in FOREIGN:
        graph.add(EdgeTable(type_, a, b, tables[table], source, target, keys[a if holder == "source" else b], held_by=holder))
    line = read_table(spark, sf_dir, "lineitem")
    line = line.withColumn("_eid", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    for type_, a, b, source, target in LINES:
        graph.add(EdgeTable(type_, a, b, line, source, target, "_eid", LINE_PROPERTIES))
    return graph
