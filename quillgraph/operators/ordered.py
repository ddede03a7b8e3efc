"""Window functions over all rows of a table, without putting them into one task.

Rows are range-partitioned by the order, sorted within partitions and stored with their
partition and their place there. Each partition computes ranks and running values of its own
and one summary row; the summaries, one a partition, are scanned on the driver into the
offsets that every partition adds. Rows that tie stay in one partition where a function
looks at ties (ranks, running aggregates); row numbers and neighbours may part them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.storage import durable

BY_ROW = ("row_number", "lag", "lead")
BY_TIE = ("rank", "dense_rank", "percent_rank", "cume_dist")
RUNNING = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Over:
    """A function over all rows: ``value`` is its argument, ``offset`` that of lag and lead."""

    name: str
    value: Column | None = None
    offset: int = 1


def arranged(df: DataFrame, order: list[Column], part_ties: bool = False) -> DataFrame:
    """``df`` stored in order: ``_part`` counts ranges of the order, ``_at`` places in a range from 0."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.rand(7)] if part_ties else []
    placed = df.repartitionByRange(n, *order, *ties).sortWithinPartitions(*order, *ties)
    # The id holds the partition above 33 bits and the row's place in it below.
    placed = placed.withColumn("_m", F.monotonically_increasing_id())
    return durable(placed.select("*", F.shiftright("_m", 33).cast("int").alias("_part"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_at")).drop("_m"), "arranged")


def _added(a, b):
    return b if a is None else a if b is None else a + b


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _most(a, b):
    return b if a is None else a if b is None else max(a, b)


def _scanned(summaries: DataFrame, how: dict) -> DataFrame:
    """Exclusive prefix sums (or minima, maxima) of one row a partition, and ``_rows`` of all."""
    found = sorted(summaries.collect(), key=lambda r: r["_part"])
    state: dict = {c: None for c in how}
    out = []
    for r in found:
        out.append((r["_part"], *[state[c] for c in how]))
        state = {c: how[c](state[c], r[c]) for c in how}
    fields = {f.name: f.dataType.simpleString() for f in summaries.schema.fields}
    schema = ", ".join(["_part int", *[f"{c}_before {fields[c]}" for c in how]])
    return F.broadcast(summaries.sparkSession.createDataFrame(out, schema))  # one row a partition


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row in the order of all, from 1; one shuffle and no window."""
    rows = arranged(df, order, part_ties=True)
    before = _scanned(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), {"_n": _added})
    rows = rows.join(before, "_part")
    return rows.withColumn(name, F.coalesce("_n_before", F.lit(0)) + F.col("_at") + 1).drop("_part", "_at", "_n_before")


def collected(df: DataFrame, by: list[str], order: list[Column], value: Column, size: int = 10_000) -> DataFrame:
    """COLLECT of groups of any size: ``by``, chunk (from 0), n and values, in order.

    A chunk holds ``size`` values of its group, the last one what is left. Rows are arranged by
    group and order; a group's rows of one range are numbered there, and its ranges, one row each,
    give the numbers they begin at. So no task and no row ever holds more than a range or a chunk.
    """
    keys = [F.col(f"`{k}`") for k in by]
    rows = arranged(df.withColumn("_value", value), [*keys, *order], part_ties=True).select(*keys, "_value", "_part", "_at")
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_part", *keys).orderBy("_at")) - 1)
    ranges = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_start"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"_k{i}"))
    rows = rows.join(starts, same).withColumn("_place", F.col("_place") + F.col("_start"))
    chunk = F.floor(F.col("_place") / size).cast("long")
    lists = rows.groupBy(*keys, chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("_place", "_value"))).alias("_l"))
    return lists.select(*keys, "chunk", "n", F.col("_l._value").alias("values"))


def _shifted(rows: DataFrame, calls: dict[str, Over]) -> DataFrame:
    """lag and lead: within partitions by a window, across their edges by a small join.

    A neighbour ``k`` rows away that is not in a row's own partition lies within ``k`` rows of
    some partition's edge, so edges of at most ``k`` rows a partition hold all such pairs.
    """
    local = Window.partitionBy("_part").orderBy("_at")
    reach = max(abs(o.offset) for o in calls.values())
    size = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = _scanned(size, {"_n": _added}).select("_part", F.coalesce("_n_before", F.lit(0)).alias("_b"))
    rows = rows.join(before, "_part").join(F.broadcast(size), "_part")  # one row a partition
    rows = rows.withColumn("_g", F.col("_b") + F.col("_at"))
    values = {c: (getattr(F, o.name)(F.struct(f"_v_{c}"), o.offset).over(local)) for c, o in calls.items()}
    rows = rows.select("*", *[v.alias(f"_l_{c}") for c, v in values.items()])
    edges = rows.where((F.col("_at") < reach) | (F.col("_at") >= F.col("_n") - reach))
    for c, o in calls.items():
        step = o.offset if o.name == "lag" else -o.offset
        far = edges.select((F.col("_g") + step).alias("_g"), F.struct(f"_v_{c}").alias(f"_f_{c}"))
        rows = rows.join(F.broadcast(far), "_g", "left")  # at most 2 * reach rows a partition
        rows = rows.withColumn(c, F.coalesce(f"_l_{c}", f"_f_{c}")[f"_v_{c}"]).drop(f"_l_{c}", f"_f_{c}")
    return rows.drop("_g", "_b", "_n")


def _ranked(rows: DataFrame, order: list[Column], calls: dict[str, Over]) -> DataFrame:
    """Ranks and running aggregates: those of each partition, and what stands before it."""
    local = Window.partitionBy("_part").orderBy(*order)
    made, summed, how = {}, {"_n": F.count(F.lit(1))}, {"_n": _added}
    for c, o in calls.items():
        v = F.col(f"_v_{c}") if o.value is not None else F.lit(1)
        if o.name in BY_TIE:
            made[f"_l_{c}"] = {"dense_rank": F.dense_rank, "cume_dist": lambda: F.count(F.lit(1))}.get(o.name, F.rank)().over(local).cast("long")
            if o.name == "dense_rank":
                summed[f"_{c}"], how[f"_{c}"] = F.max(f"_l_{c}"), _added
            continue
        parts = {"avg": {"s": F.sum(v.cast("double")), "k": F.count(v)}}.get(o.name, {"s": getattr(F, o.name)(v)} if o.name in RUNNING else None)
        if parts is None:
            raise NotImplementedError(f"{o.name} over all rows")
        for k, x in parts.items():
            made[f"_l{k}_{c}"] = x.over(local)
            summed[f"_{k}_{c}"] = x
            how[f"_{k}_{c}"] = {"min": _least, "max": _most}.get(o.name, _added)
    # The numbers within partitions do not depend on what stands before them.
    rows = durable(rows.select("*", *[x.alias(n) for n, x in made.items()]), "ranked")
    summaries = durable(rows.groupBy("_part").agg(*[x.alias(n) for n, x in summed.items()]), "summaries")
    rows = rows.join(_scanned(summaries, how), "_part")
    total = sum(r["_n"] for r in summaries.select("_n").collect())
    before = F.coalesce("_n_before", F.lit(0))
    plus = lambda a, b: F.coalesce(F.col(a) + F.col(b), F.col(a), F.col(b))
    for c, o in calls.items():
        if o.name == "rank":
            out = F.col(f"_l_{c}") + before
        elif o.name == "dense_rank":
            out = F.col(f"_l_{c}") + F.coalesce(f"_{c}_before", F.lit(0))
        elif o.name == "percent_rank":
            out = (F.col(f"_l_{c}") + before - 1) / F.lit(float(max(1, total - 1)))
        elif o.name == "cume_dist":
            out = (F.col(f"_l_{c}") + before) / F.lit(float(max(1, total)))
        elif o.name == "avg":
            out = plus(f"_ls_{c}", f"_s_{c}_before") / F.nullif(plus(f"_lk_{c}", f"_k_{c}_before"), F.lit(0))
        elif o.name in ("min", "max"):
            out = (F.least if o.name == "min" else F.greatest)(f"_ls_{c}", f"_s_{c}_before")
        else:
            out = plus(f"_ls_{c}", f"_s_{c}_before")
        rows = rows.withColumn(c, out)
    return rows.drop(*made, *[f"{c}_before" for c in how])


def _unordered(df: DataFrame, calls: dict[str, Over]) -> DataFrame:
    """Without an order all rows are peers: aggregates of the whole table beside each row."""
    aggs = {c: o for c, o in calls.items() if o.name in RUNNING}
    fixed = {"rank": F.lit(1), "dense_rank": F.lit(1), "percent_rank": F.lit(0.0), "cume_dist": F.lit(1.0)}
    df = df.withColumns({c: fixed[o.name] for c, o in calls.items() if o.name in fixed})
    if not aggs:
        return df
    one = df.agg(*[getattr(F, o.name)(F.col(f"_v_{c}") if o.value is not None else F.lit(1)).alias(c) for c, o in aggs.items()])
    return df.crossJoin(F.broadcast(one))  # a single row


def over_all(df: DataFrame, order: list[Column], calls: dict[str, Over]) -> DataFrame:
    """``df`` with a column for each of ``calls``: window functions over all rows in ``order``.

    Running aggregates take in all peers of a row, as SQL's default frame does. ``df`` must not
    have columns of the names of ``calls``, nor ones that begin with ``_v_``, ``_l_`` or ``_part``.
    """
    own = df.columns
    df = df.withColumns({f"_v_{c}": o.value for c, o in calls.items() if o.value is not None})
    by_row = {c: o for c, o in calls.items() if o.name in BY_ROW}
    rest = {c: o for c, o in calls.items() if c not in by_row}
    if not order:
        df, rest = _unordered(df, rest), {}
    if rest:
        df = _ranked(arranged(df, order), order, rest).drop("_part", "_at")
    shifts = {c: o for c, o in by_row.items() if o.name != "row_number"}
    if by_row:
        rows = arranged(df, order, part_ties=True)
        if shifts:
            rows = _shifted(rows, shifts)
        before = _scanned(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), {"_n": _added})
        rows = rows.join(before, "_part")
        number = F.coalesce("_n_before", F.lit(0)) + F.col("_at") + 1
        df = rows.withColumns({c: number for c, o in by_row.items() if o.name == "row_number"}).drop("_part", "_at", "_n_before")
    return df.select(*[F.col(f"`{c}`") for c in own], *calls)
