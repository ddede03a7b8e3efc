"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

A vector, scaled to length 1, has a number of values floor((a.x + b) / WIDTH) in each of
TABLES tables; together they are its bucket. A query visits a table's buckets in the order
of their estimated success: the probability, under the Gaussian (2-stable) projections,
that a vector of cosine rho to the query falls into the bucket, which is highest near the
query's own bucket and falls as values are perturbed towards farther borders. It goes on
until the visited buckets of all tables together would hold such a vector with probability
SUCCESS. Candidates of all tables are merged and ranked by the exact cosine of the
original vectors. PROBES buckets are ranked at first, and four times as many until they
are enough; a query that MOST_PROBES buckets of a table do not serve, or whose buckets hold
fewer than K others, is compared with every row instead, block by block, and marked
``exhausted`` in the results.

How finely tables cut (``hashes``) grows with the logarithm of the rows, from one value
for a table of a few, so that buckets keep their size and a query meets an ever smaller share
of a growing table; rho, the cosine of a K-th neighbour, is estimated on a sample of at most
SAMPLE rows and VALUES components (``fitted``), so close neighbours need few buckets.

Buckets are met block by block: at most BLOCK rows of a bucket stand in a block and every
query that probes the bucket visits all of its blocks, so a bucket of any size is searched
whole and no pair becomes a row. A task keeps the best few of at most HELD queries. Equal
vectors stand for each other: of each, the K + 1 smallest ids are indexed, and no more can
be among the K nearest of a query. An id of several vectors takes one place, with its largest
cosine; asked for, it is one query, as near to a row as the nearest of its vectors.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part, nor do null ids; only vectors of equal length meet; rows of the query's own id
are its own; repeated rows count once; a query without candidates returns no row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded_batches, lean, partitions, read, stored

K = 5
TABLES, WIDTH, SUCCESS = 8, 3.0, 0.9
#: Buckets that are ranked for a query and table at first, and before it is compared with all rows.
PROBES, MOST_PROBES = 256, 4096
#: Rows and components that rho is estimated on, and queries among them.
SAMPLE, VALUES, ASKED = 20_000, 4_000_000, 256
BLOCK, HELD = 4096, 50_000
#: Candidates that a task gathers before it keeps the best of each query.
PAIRS = 500_000
#: Values run from -RANGE to RANGE; those beyond count as the last.
RANGE = 2
SEED = 77

_erf = np.vectorize(math.erf, otypes=[float])
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Tables:
    """How vectors are hashed: values a table, the cosine to look for, and the type vectors are carried in."""

    hashes: int
    rho: float
    kind: str = "<f8"


def hashes(n: int) -> int:
    """Values of a table for ``n`` rows."""
    return min(24, max(1, round(math.log2(max(1, n))) - 4))


@lru_cache(maxsize=256)
def projections(dim: int, table: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((SEED, dim, table))
    return rng.normal(size=(m, dim)).T, rng.uniform(0, WIDTH, m)


def _bucket(values: np.ndarray, dim: int, table: int) -> np.ndarray:
    """One number from the values (..., hashes)."""
    key = np.full(values.shape[:-1], dim * TABLES + table, np.uint64)
    for j in range(values.shape[-1]):
        key = key * _P + (np.clip(values[..., j], -RANGE, RANGE) + RANGE + 1).astype(np.uint64)
    return ((key ^ (key >> np.uint64(32))) * _Q).view(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hashed(x: np.ndarray, table: int, t: Tables) -> np.ndarray:
    a, b = projections(x.shape[1], table, t.hashes)
    return _bucket(np.floor((_unit(x) @ a + b) / WIDTH).astype(np.int64), x.shape[1], table)


def _ranked(chance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` likeliest combinations of values of each query, likeliest first: probabilities, and values."""
    n, m, side = chance.shape
    score, path = np.ones((n, 1)), np.zeros((n, 1, 0), np.int64)
    for j in range(m):  # the best of all combinations begin with one of the best
        total = (score[:, :, None] * chance[:, j][:, None, :]).reshape(n, -1)
        best = np.argpartition(-total, most - 1, axis=1)[:, :most] if total.shape[1] > most else np.broadcast_to(np.arange(total.shape[1]), total.shape)
        score = np.take_along_axis(total, best, 1)
        path = np.concatenate([np.take_along_axis(path, (best // side)[:, :, None], 1), (best % side - RANGE)[:, :, None]], axis=2)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(score, order, 1), np.take_along_axis(path, order[:, :, None], 1)


def probes(x: np.ndarray, table: int, t: Tables) -> list[np.ndarray | None]:
    """Buckets of each query in order of estimated success, as many as its share of SUCCESS
    takes; None where MOST_PROBES are not enough."""
    a, b = projections(x.shape[1], table, t.hashes)
    at = t.rho * (_unit(x) @ a) + b  # where a neighbour's projection is expected
    sd = math.sqrt(1 - t.rho * t.rho)
    edges = np.arange(-RANGE, RANGE + 2) * WIDTH
    below = 0.5 * (1 + _erf((edges - at[:, :, None]) / (sd * math.sqrt(2))))
    below[:, :, 0], below[:, :, -1] = 0.0, 1.0
    chance = np.diff(below, axis=2)
    need = 1 - (1 - SUCCESS) ** (1 / TABLES)
    out: list[np.ndarray | None] = [None] * len(x)
    left, most = np.arange(len(x)), PROBES
    while len(left) and most <= MOST_PROBES:
        step = max(1, (1 << 22) // (most * chance.shape[2] * t.hashes))  # some dozen MB at a time
        for i in range(0, len(left), step):
            own = left[i : i + step]
            score, path = _ranked(chance[own], most)
            total = np.cumsum(score, axis=1)
            n = 1 + (total < need).sum(1)
            keys = _bucket(path, x.shape[1], table)
            for k, row, m in zip(own.tolist(), keys, n.tolist(), strict=True):
                out[k] = np.unique(row[:m]) if m <= len(row) else None
        left = np.array([k for k in left.tolist() if out[k] is None], np.int64)
        most *= 4
    return out


def fitted(vectors: DataFrame, n: int, k: int, kind: str = "<f8") -> Tables:
    """The tables for the ``n`` rows of ``vectors``: rho is the median cosine of
    sampled queries to their ``k``-th neighbour, or to the nearest one in a thinner sample."""
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    share = F.lit(int(min(1.0, min(SAMPLE, VALUES // longest) / max(1, n)) * (1 << 30)))
    pdf = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).select("vec_id", "embedding").toPandas()
    by: dict[int, list] = {}
    for i, v in sorted(zip(pdf["vec_id"], pdf["embedding"], strict=True), key=lambda r: r[0]):
        by.setdefault(len(v), []).append(v)
    x = _unit(np.array(max(by.values(), key=len), np.float64)) if by else np.zeros((0, 1))
    rho = 0.45
    if len(x) > 1:
        asked = x[np.random.default_rng(SEED).permutation(len(x))[:ASKED]]
        # A query meets itself first.
        place = min(len(x) - 1, max(1, round(k * len(x) / max(1, n))))
        near = np.array([-np.partition(-(x @ q), place)[place] for q in asked])
        rho = float(np.clip(np.median(near), 0.1, 0.98))
    return Tables(hashes(n), rho, kind)


def _placed(query: bool, t: Tables):
    """mapInArrow: a row of (key, id, vector) for each table, or each table and probe; queries
    that probes do not serve have a single row without a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, lengths = part.column(0).to_pylist(), part.column(1).value_lengths().to_numpy()
                flat, ends = part.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
                lists = [flat[b - n : b] for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                by: dict[int, list[int]] = {}
                for k, v in enumerate(lists):
                    by.setdefault(len(v), []).append(k)
                packed = [v.astype(t.kind).tobytes() for v in lists]
                for own in by.values():
                    x = np.stack([lists[k] for k in own])
                    per = [probes(x, table, t) if query else hashed(x, table, t)[:, None] for table in range(TABLES)]
                    beyond = [k for k in range(len(own)) if any(found[k] is None for found in per)]
                    if beyond:
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(beyond), pa.int64()), pa.array([ids[own[k]] for k in beyond], pa.int64()), pa.array([packed[own[k]] for k in beyond], pa.binary())], ["key", "id", "vec"])
                    served = sorted(set(range(len(own))) - set(beyond))
                    for found in per:
                        keys = [found[k] for k in served]
                        if not keys:
                            continue
                        at = np.repeat(np.array([own[k] for k in served]), [len(f) for f in keys]).tolist()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.concatenate(keys), pa.int64()), pa.array([ids[k] for k in at], pa.int64()), pa.array([packed[k] for k in at], pa.binary())],
                            ["key", "id", "vec"],
                        )

    return lean(run)


def _packed(t: Tables):
    """mapInArrow: every row's id and vector, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(v, np.float64).astype(t.kind).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "vec"])

    return lean(run)


def _leading(q: np.ndarray, ids: np.ndarray, score: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` best ids of each query, an id by its best score, ties to smaller ids."""
    order = np.lexsort((-score, ids, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.append(True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])) if len(q) else np.zeros(0, bool)
    q, ids, score = q[first], ids[first], score[first]
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return q[rank < keep], ids[rank < keep], score[rank < keep]


def _met(k: int, t: Tables):
    """mapInArrow over rows sorted by key, block, kind (0: indexed, 1: query): best of each query."""
    keep = k + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple[int, bytes], int] = {}  # of the queries met
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pairs = 0
        now, ids, vecs, asked = None, [], [], []  # asked too stays within BLOCK

        def plain(some: list[bytes]) -> np.ndarray:
            return np.frombuffer(b"".join(some), t.kind).astype(np.float64).reshape(len(some), -1)

        def merged() -> None:
            nonlocal pairs
            if found:
                found[:] = [_leading(*(np.concatenate(c) for c in zip(*found, strict=True)), keep)]
            pairs = 0

        def listed() -> Iterator[pa.RecordBatch]:
            merged()
            names = list(number)
            for q, own, score in found:
                for at in range(0, len(q), 10_000):
                    some = [names[x] for x in q[at : at + 10_000].tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i for i, _ in some], pa.int64()), pa.array([v for _, v in some], pa.binary()), pa.array(own[at : at + 10_000]), pa.array(score[at : at + 10_000])],
                        ["query_id", "vec", "vec_id", "score"],
                    )

        def meet() -> None:
            nonlocal pairs
            if not ids or not asked:
                return
            x = plain(vecs)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            own = np.array(ids)
            # Rows of one id are one result: so many rows hold ``keep`` ids.
            n = min(keep * int(np.unique(own, return_counts=True)[1].max()), len(ids))
            for at in range(0, len(asked), 256):
                part = asked[at : at + 256]
                q = plain([v for _, v in part])
                near = (q @ x.T) / norm
                near[np.array([i for i, _ in part])[:, None] == own[None, :]] = -np.inf
                some = np.argpartition(-near, n - 1, axis=1)[:, :n]
                r, c = np.nonzero(np.isfinite(np.take_along_axis(near, some, 1)))
                rows = some[r, c]
                exact = np.einsum("ij,ij->i", q[r], x[rows]) / (np.sqrt(np.einsum("ij,ij->i", q, q))[r] * norm[rows])
                at_query = np.array([number.setdefault(p, len(number)) for p in part])
                found.append((at_query[r], own[rows], exact))
                pairs += len(r)
            if pairs > PAIRS:
                merged()

        for batch in batches:
            for key, part, kind, i, v in zip(*[batch.column(c).to_pylist() for c in ("key", "part", "kind", "id", "vec")], strict=True):
                if (key, part) != now:
                    meet()
                    now, ids, vecs, asked = (key, part), [], [], []
                    if len(number) > HELD:
                        yield from listed()
                        number.clear()
                        found.clear()
                if kind == 0:
                    ids.append(i)
                    vecs.append(v)
                else:
                    asked.append((i, v))
                    if len(asked) == BLOCK:
                        meet()
                        asked = []
        meet()
        yield from listed()

    return lean(run)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part, repeated rows once."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return x.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).distinct()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """For each of ``queries`` its ``k`` nearest of ``vectors`` found: query_id, rank, vec_id, score,
    and whether its probes were exhausted and it met all rows."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    index = usable(vectors).withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).select("vec_id", "embedding")
    index = stored(index, "vectors")
    # Vectors of single precision are carried as such; all arithmetic is double.
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" and dict(queries.dtypes)["embedding"] == "array<float>" else "<f8"
    n = index.count()
    t = fitted(index, n, k, kind)
    rows = stored(index.mapInArrow(_placed(False, t), "key long, id long, vec binary"), "index")
    # Ranking buckets is work by the query, not by the byte: deal queries to all tasks.
    asked = stored(usable(queries).repartition(partitions(spark), "vec_id").mapInArrow(_placed(True, t), "key long, id long, vec binary"), "probes")
    large = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "large")
    parts = F.coalesce("parts", F.lit(1))
    served = asked.where("key IS NOT NULL").join(large, "key", "left").select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(1).alias("kind"), "id", "vec")
    rows = rows.join(large, "key", "left").select("key", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "vec")

    def met(line: DataFrame) -> DataFrame:
        line = line.repartition(partitions(spark), "key", "part").sortWithinPartitions("key", "part", "kind", "id")
        found = line.mapInArrow(_met(k, t), "query_id long, vec binary, vec_id long, score double")
        return stored(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")

    best = met(rows.unionByName(served))
    full = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    # A query of several vectors is asked anew with all of them.
    again = asked.groupBy("id").agg(F.max(F.col("key").isNull()).alias("out")).join(full, F.col("id") == F.col("query_id"), "left").where(F.col("out") | F.col("query_id").isNull())
    again = stored(again.select(F.col("id").alias("again")), "again")
    best = best.withColumn("exhausted", F.lit(False))
    if not again.isEmpty():
        blocks = max(1, math.ceil(n / BLOCK))  # of each length of vectors
        block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        every = index.mapInArrow(_packed(t), "id long, vec binary").select(F.length("vec").cast("long").alias("key"), block.alias("part"), F.lit(0).alias("kind"), "id", "vec")
        hard = asked.select("id", "vec").distinct().join(again, F.col("id") == F.col("again"), "left_semi")
        hard = hard.select(F.length("vec").cast("long").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), F.lit(1).alias("kind"), "id", "vec")
        best = best.join(again, F.col("query_id") == F.col("again"), "left_anti").unionByName(met(every.unionByName(hard)).withColumn("exhausted", F.lit(True)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score", "exhausted")


def op7_neighbours(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
