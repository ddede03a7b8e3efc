"""Relational extras beside the graph text: joins, group sets, top-k, similarity, sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.storage import durable


def top_k(df: DataFrame, partition: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each partition, numbered in ``rank``; Spark limits each task's
    groups before the shuffle."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def degrees(edges: DataFrame, source: str = "_src", target: str = "_dst") -> tuple[DataFrame, DataFrame]:
    """Out-degrees and in-degrees."""
    return edges.groupBy(source).agg(F.count(F.lit(1)).alias("degree")), edges.groupBy(target).agg(F.count(F.lit(1)).alias("degree"))


def cardinality_violations(edges: DataFrame, source: str, target: str, max_source: int | None = None, max_target: int | None = None) -> DataFrame:
    """side, id, degree of every node with more connections than allowed."""
    out, into = degrees(edges, source, target)
    none = F.lit(False)
    a = out.where(F.col("degree") > max_source if max_source is not None else none).select(F.lit("source").alias("side"), F.col(source).cast("string").alias("id"), "degree")
    b = into.where(F.col("degree") > max_target if max_target is not None else none).select(F.lit("target").alias("side"), F.col(target).cast("string").alias("id"), "degree")
    return a.unionByName(b)


def unique_violations(df: DataFrame, column: str) -> DataFrame:
    """Values that more than one row has, with their rows."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_repaired(df: DataFrame, column: str, order: list[str], prefix: str = "dup_") -> DataFrame:
    """Repeated values made unique: the first row keeps it, others get a numbered suffix."""
    n = F.row_number().over(Window.partitionBy(column).orderBy(*order))
    fixed = F.when(F.col(column).isNull() | (n == 1), F.col(column).cast("string")).otherwise(F.concat(F.lit(prefix), F.col(column).cast("string"), F.lit("_"), n))
    return df.withColumn(column, fixed)


def missing_ends(edges: DataFrame, column: str, nodes: DataFrame, key: str) -> DataFrame:
    """Edges whose end does not exist."""
    return edges.join(nodes.select(F.col(key).alias("_end")), F.col(column) == F.col("_end"), "left_anti")


def constraint_violations(df: DataFrame, key: str, name: str, condition: str) -> DataFrame:
    """constraint and id of the rows that do not satisfy a SQL predicate (unknown counts as satisfied)."""
    return df.where(~F.coalesce(F.expr(condition), F.lit(True))).select(F.lit(name).alias("constraint"), F.col(key).cast("string").alias("id"))


def _vectors(t: pa.Table) -> np.ndarray:
    """The column _v as a matrix, from Arrow's own flat values."""
    v = t["_v"].combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


#: Bytes of a strip of cosines, and how far a product of matrices may be off a sum taken in order.
STRIP, OFF = 16 << 20, 1e-9


def _ids(values: pa.ChunkedArray) -> np.ndarray:
    whole = pa.types.is_integer(values.type)
    return values.to_numpy() if whole else np.array(values.to_pylist(), object)


def _exact(a: np.ndarray, b: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Cosines of rows of ``a`` and ``b``, summed component by component, so that equal vectors have equal ones."""
    dot, na, nb = np.zeros(len(row)), np.zeros(len(a)), np.zeros(len(b))
    for x, y in zip(a.T, b.T, strict=True):
        dot, na, nb = dot + x[row] * y[place], na + x * x, nb + y * y
    norm = np.sqrt(na[row] * nb[place])
    return np.clip(np.divide(dot, norm, out=np.zeros(len(row)), where=norm > 0), -1, 1)


def _nearest(a: np.ndarray, b: np.ndarray, ids: np.ndarray | None, others: np.ndarray, k: int | None, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``a``, places of their ``k`` most similar rows of ``b`` (all without ``k``), best first, and cosines.

    ``others`` are the ids of ``b``, in order; a row that has an id of ``ids`` there leaves it out. Where the caller
    has ``k`` for every row already, ``least`` is the worst of them. Cosines are made in strips of queries of
    ``STRIP`` bytes. What comes within ``OFF`` of the k-th is summed exactly; ties go to the smaller id.
    """
    lengths = lambda v: np.sqrt((v * v).sum(1))
    unit = lambda v: np.divide(v, lengths(v)[:, None], out=np.zeros(v.shape), where=lengths(v)[:, None] > 0)
    ua, ub = unit(a), unit(b).T
    broken = ~np.isfinite(ub).all(0)
    if ids is not None:
        low, high = np.searchsorted(others, ids, "left"), np.searchsorted(others, ids, "right")  # a row and itself
    step = max(1, STRIP // (8 * len(b)))
    rows, places, scores = [], [], []
    for at in range(0, len(a), step):
        near = ua[at : at + step] @ ub
        near[:, broken] = -np.inf
        near[~np.isfinite(ua[at : at + step]).all(1)] = -np.inf
        if ids is not None:
            for i, (lo, hi) in enumerate(zip(low[at : at + step], high[at : at + step], strict=True)):
                near[i, lo:hi] = -np.inf
        bound = np.full(len(near), -np.inf) if least is None else least[at : at + step] - OFF
        if least is None and k is not None and k < len(b):
            bound = np.partition(near, len(b) - k, axis=1)[:, len(b) - k] - OFF
        row, place = np.nonzero(near >= np.maximum(bound, np.finfo(float).min)[:, None])
        score = _exact(a[at : at + step], b, row, place)
        best = np.lexsort((place, -score, row))
        best = best[np.isfinite(score[best])]
        if k is not None:
            best = best[_first(row[best], k)]
        rows.append(row[best] + at)
        places.append(place[best])
        scores.append(score[best])
    return tuple(map(np.concatenate, (rows, places, scores)))


def _first(of: np.ndarray, k: int) -> np.ndarray:
    """Which of the rows, ordered by ``of``, are among the first ``k`` of their value."""
    return np.arange(len(of)) - np.searchsorted(of, of) < k


def _of_blocks(k: int | None):
    """Of a block of queries and a block of rows, each query's ``k`` most similar other rows, or all."""

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        kinds = (pa.int32(), q["from_id"].type, x["to_id"].type if "to_id" in x.column_names else q["from_id"].type, pa.float64())
        names = ["_block", "from_id", "to_id", "score"]
        if not q.num_rows or not x.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})
        a, b, ids, others = _vectors(q), _vectors(x), _ids(q["from_id"]), _ids(x["to_id"])
        order = np.argsort(others, kind="stable")
        b, others = b[order], others[order]
        row, place, score = _nearest(a, b, ids, others, k)
        return pa.table(dict(zip(names, (pa.array(np.full(len(row), q["_block"][0].as_py()), kinds[0]), pa.array(ids[row], kinds[1]), pa.array(others[place], kinds[2]), pa.array(score)), strict=True)))

    return run


def _met_in_blocks(left: DataFrame, right: DataFrame, id_col: str, vector: str, rows: int) -> DataFrame:
    """Both sides dealt to blocks of about ``rows`` rows; each pair of blocks is one product of matrices in one task."""
    given = lambda df: df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull())
    left, right = given(left), given(right)
    n, m = max(1, -(-left.count() // rows)), max(1, -(-right.count() // rows))
    q = left.select(F.col(id_col).alias("from_id"), F.col(vector).cast("array<double>").alias("_v"), F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("_q"))
    x = right.select(F.col(id_col).alias("to_id"), F.col(vector).cast("array<double>").alias("_v"), F.pmod(F.xxhash64(id_col), F.lit(m)).cast("int").alias("_x"))
    q = q.withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select("from_id", "_v", (F.col("_q") * m + F.col("_x")).alias("_block"))
    x = x.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("to_id", "_v", (F.col("_q") * m + F.col("_x")).alias("_block"))
    a, b = dict(q.dtypes)["from_id"], dict(x.dtypes)["to_id"]
    return q.groupBy("_block").cogroup(x.groupBy("_block")).applyInArrow(_of_blocks(None), f"_block int, from_id {a}, to_id {b}, score double").drop("_block")


def _packed(t: pa.Table) -> pa.Table:
    """One row of a block: its number, its keys and least ids in the order of these, its vectors as bytes of doubles or floats."""
    order = np.argsort(_ids(t["_least"]), kind="stable")
    v = t["_v"].combine_chunks()
    kind = np.float32 if pa.types.is_float32(v.type.value_type) else np.float64
    matrix = v.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(v), -1)[order]
    of, least = (t[c].combine_chunks().take(pa.array(order)) for c in ("_of", "_least"))
    lists = [pa.array([x], pa.list_(x.type)) for x in (of, least)]
    return pa.table([pa.array([t["_block"][0].as_py()], pa.int32()), *lists, pa.array([matrix.tobytes()], pa.binary())], names=["block", "ofs", "leasts", "v"])


def _kinds(df: DataFrame, id_col: str, vector: str, rows: int, exact: str) -> tuple[DataFrame, DataFrame]:
    """id and _of (a key of its vector) of every row, and blocks of about ``rows`` different vectors, one row each."""
    given = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull())
    n = max(1, -(-given.count() // rows))
    given = given.select(F.col(id_col).alias("id"), F.col(vector).cast(exact).alias("_v"))
    # Stored, as the keys are made by chance; an id that stands twice may be the least of two vectors.
    of = durable(given.groupBy("_v").agg(F.min("id").alias("_least")).withColumn("_of", F.monotonically_increasing_id()), "vectors")
    all_ = durable(given.join(of.select("_v", "_of"), "_v").select("id", "_of"), "ids")
    dealt = of.withColumn("_block", F.pmod(F.xxhash64("_of"), F.lit(n)).cast("int")).repartition(n, "_block")
    return all_, durable(dealt.groupBy("_block").applyInArrow(_packed, f"block int, ofs array<long>, leasts array<{dict(of.dtypes)['_least']}>, v binary"), "blocks")


def _best_of_blocks(k: int, single: bool):
    """Of rows of a block of queries (block, ofs, v) and one of rows (xofs, xleasts, xv), each query's ``k`` most similar of the blocks met in the task."""

    def matrix(v: pa.Scalar, n: int) -> np.ndarray:
        return np.frombuffer(v.as_buffer(), np.float32 if single else np.float64).reshape(n, -1).astype(np.float64)

    def tables(of: np.ndarray, row: np.ndarray, met: np.ndarray, least: np.ndarray, score: np.ndarray, type_: pa.DataType):
        for at in range(0, len(row), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.record_batch([pa.array(of[row[cut]]), pa.array(met[cut]), pa.array(least[cut], type_), pa.array(score[cut])], names=["from_of", "to_of", "to_least", "score"])

    def run(batches):
        block = type_ = None
        for batch in batches:
            for i in range(batch.num_rows):
                at = {c: batch.column(c)[i] for c in batch.schema.names}
                others, ids = (_ids(pa.chunked_array([at[c].values])) for c in ("xofs", "xleasts"))
                if at["block"].as_py() != block:
                    if block is not None:
                        yield from tables(of, row, met, least, score, type_)
                    block, type_, of = at["block"].as_py(), at["xleasts"].values.type, at["ofs"].values.to_numpy()
                    a = matrix(at["v"], len(of))
                    row, met, least, score = np.zeros(0, int), others[:0], ids[:0], np.zeros(0)
                counts = np.bincount(row, minlength=len(of))
                # Where every row has its k, the worst of them stands last.
                worst = score[np.cumsum(counts) - 1] if (counts == k).all() else None
                r, place, s = _nearest(a, matrix(at["xv"], len(others)), None, others, k, worst)
                row, met, least, score = (np.concatenate(x) for x in ((row, r), (met, others[place]), (least, ids[place]), (score, s)))
                best = np.lexsort((least, -score, row))
                best = best[_first(row[best], k)]
                row, met, least, score = row[best], met[best], least[best], score[best]
        if block is not None:
            yield from tables(of, row, met, least, score, type_)

    return run


def similarity_top_k(left: DataFrame, right: DataFrame, id_col: str, vector: str, k: int, rows: int = 8192) -> DataFrame:
    """For each row of ``left`` its ``k`` most similar other rows of ``right`` by cosine (0 where a vector is zero).

    Equal vectors are compared once. Every block of different vectors meets every other as
    matrices, read from where they are stored, so no row is shuffled more than once however many blocks there
    are; a task keeps the best of all blocks it meets. Null ids and vectors take no part.
    """
    single = all(dict(df.dtypes)[vector] == "array<float>" for df in (left, right))
    exact = "array<float>" if single else "array<double>"
    ids, blocks = _kinds(left, id_col, vector, rows, exact)
    others, met = (ids, blocks) if left is right else _kinds(right, id_col, vector, rows, exact)
    # A row may be among the nearest of its own vector, as often as its id stands there.
    most = k + (others.groupBy("id").count().agg(F.max("count")).first()[0] or 1)
    pairs = blocks.select("block", "ofs", "v").crossJoin(met.selectExpr("ofs AS xofs", "leasts AS xleasts", "v AS xv").hint("shuffle_replicate_nl"))
    best = pairs.mapInArrow(_best_of_blocks(most, single), f"from_of long, to_of long, to_least {dict(others.dtypes)['id']}, score double")
    best = top_k(best, ["from_of"], [F.desc("score"), F.asc("to_least")], most).select("from_of", "to_of", "score")
    # Of the rows of a vector no more than the first may be among so many nearest.
    members = top_k(others, ["_of"], [F.asc("id")], most).select(F.col("id").alias("to_id"), F.col("_of").alias("to_of"))
    best = top_k(best.join(members, "to_of"), ["from_of"], [F.desc("score"), F.asc("to_id")], most).select("from_of", "to_id", "score")
    found = ids.select(F.col("id").alias("from_id"), F.col("_of").alias("from_of")).join(best, "from_of").where("from_id <> to_id")
    return top_k(found.select("from_id", "to_id", "score"), ["from_id"], [F.desc("score"), F.asc("to_id")], k)


def similarity_matrix(left: DataFrame, right: DataFrame, id_col: str, vector: str, rows: int = 1024) -> DataFrame:
    """from_id, to_id, score of all pairs of other ids; every row of ``left`` is a stated query.

    A pair of blocks gives at most about ``rows`` times ``rows`` pairs at once. Null ids and vectors take no part.
    """
    return _met_in_blocks(left, right, id_col, vector, rows)


def sample_values(df: DataFrame, column: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` values of a column in seeded order of their hashes, nulls left out."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(F.xxhash64(F.lit(seed), column), column).limit(n)


def distinct_on(df: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    """First row of each key by ``order``."""
    return top_k(df, on, order, 1).drop("rank")


def label_frequency(edges: DataFrame, column: str = "label") -> DataFrame:
    """How often each edge label stands in a list of edges, and its rank by that."""
    counted = edges.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    # One row a label.
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), column)))


def sampled(df: DataFrame, fraction: float, columns: list[str], seed: int = 0) -> DataFrame:
    """About ``fraction`` of the rows, the same ones in every run: those whose hash is low."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) < int(fraction * (1 << 30)))


def pivoted(df: DataFrame, by: list[str], column: str, values: list, agg: Column) -> DataFrame:
    """One column for each of ``values`` of ``column``; listing them spares a pass that looks for them."""
    return df.groupBy(*by).pivot(column, values).agg(agg)


def unpivoted(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def sort_by(df: DataFrame, *keys: Column | str) -> DataFrame:
    """SORT BY: order within partitions."""
    return df.sortWithinPartitions(*keys)


def distribute_by(df: DataFrame, *keys: Column | str) -> DataFrame:
    """DISTRIBUTE BY: rows of one key in one partition."""
    return df.repartition(*keys)


def cluster_by(df: DataFrame, *keys: Column | str) -> DataFrame:
    """CLUSTER BY: both."""
    return df.repartition(*keys).sortWithinPartitions(*keys)
