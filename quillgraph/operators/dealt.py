"""Equi joins dealt to tasks by the pairs they make, not by the bytes they read.

Two small tables may make many pairs: a key with a rows on one side and b on the other makes a
times b of them, and neither file splits nor adaptive execution, which go by bytes, see that.
Here the rows of such a key are cut into pieces of about ``CELL`` rows on both sides, and
every piece of one side meets every piece of the other in a cell of its own. As a row has
one piece of its own side, each pair comes in one cell, once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.storage import durable

#: Rows of either side in a cell.
CELL = 4096
WHOLE = {"tinyint", "smallint", "int", "bigint"}


def _counted(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.select(key.alias("_key")).where("_key IS NOT NULL").groupBy("_key").agg(F.count(F.lit(1)).alias(name))


def _pieces(df: DataFrame, key: Column, heavy: DataFrame, tag: str, own: str, other: str) -> DataFrame:
    """``df`` with its key, its own piece, and once for every piece of the other side."""
    cut = F.broadcast(heavy.select(F.col("_key").alias("_hk"), F.col(own).alias("_hown"), F.col(other).alias("_hother")))
    df = df.withColumn(f"_k{tag}", key).join(cut, F.col(f"_k{tag}") == F.col("_hk"), "left")
    # Equal rows are dealt to several pieces as well.
    df = df.withColumn(f"_{own}{tag}", F.pmod(F.monotonically_increasing_id(), F.coalesce("_hown", F.lit(1))).cast("int"))
    df = df.withColumn(f"_{other}{tag}", F.explode(F.sequence(F.lit(0), F.coalesce("_hother", F.lit(1)) - 1)))
    return df.drop("_hk", "_hown", "_hother")


def dealt(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> tuple[DataFrame, DataFrame, Column, list[str]]:
    """Both sides ready for a join on equal keys, its condition, and the columns to drop after it.

    Where there are few pairs both sides stay as they are. Counts the rows by key of both sides;
    only keys of many pairs come together in a broadcast table, one row for ``CELL`` squared pairs at most.
    """
    kinds = left.select(left_key).dtypes[0][1], right.select(right_key).dtypes[0][1]
    plain = left, right, left_key == right_key, []
    if kinds[0] != kinds[1]:
        if not set(kinds) <= WHOLE:
            return plain
        left_key, right_key = left_key.cast("bigint"), right_key.cast("bigint")
    pairs = F.col("_l").cast("double") * F.col("_r")
    met = _counted(left, left_key, "_l").join(_counted(right, right_key, "_r"), "_key").where(pairs > 0)
    total = met.agg(F.sum(pairs).alias("t")).first().t or 0
    if total <= CELL * CELL:
        return plain
    cuts = [F.ceil(F.col(c) / CELL).cast("int").alias(n) for c, n in (("_l", "i"), ("_r", "j"))]
    heavy = durable(met.where(pairs > CELL * CELL).select("_key", *cuts), "heavy")
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) + math.ceil(total / CELL / CELL)
    sides = []
    for df, key, tag, own, other in ((left, left_key, "l", "i", "j"), (right, right_key, "r", "j", "i")):
        sides.append(_pieces(df, key, heavy, tag, own, other).repartition(n, f"_k{tag}", f"_i{tag}", f"_j{tag}").hint("merge"))
    names = ("_k", "_i", "_j")
    meet = F.lit(True)
    for c in names:
        meet = meet & (F.col(f"{c}l") == F.col(f"{c}r"))
    return *sides, meet, [f"{c}{t}" for c in names for t in "lr"]
