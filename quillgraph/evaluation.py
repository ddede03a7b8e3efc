"""Whether two results are the same: bags or lists of rows, columns in any order."""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.storage import shared_path

#: Orders of columns with equal fingerprints tried at most.
MAX_PERMUTATIONS = 5040


def normal_column(c: Column, kind: T.DataType) -> Column:
    """A value as comparable text: elements by id, maps as sorted pairs, stamps in one format."""
    if isinstance(kind, T.StructType):
        ids = [f.name for f in kind.fields if f.name in ("_id", "_eid")]
        return c[ids[0]].cast("string") if ids else F.to_json(c)
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(c)))
    if isinstance(kind, T.ArrayType):
        return F.to_json(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.FractionalType):
        whole = c == F.floor(c)
        return F.when(whole & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(F.round(c.cast("double"), 9).cast("string"))
    return c.cast("string")


def normalized(df: DataFrame) -> DataFrame:
    """Columns c0, c1, ... of comparable texts."""
    cols = [normal_column(F.col(f"`{f.name}`"), f.dataType).alias(f"c{i}") for i, f in enumerate(df.toDF(*[f"x{i}" for i in range(len(df.columns))]).schema.fields)]
    plain = df.toDF(*[f"x{i}" for i in range(len(df.columns))])
    return plain.select(*cols)


def _fingerprints(df: DataFrame) -> list[tuple]:
    """Of each column, a bag hash that row order does not change."""
    aggs = []
    for c in df.columns:
        h = F.xxhash64(F.coalesce(F.col(c), F.lit("\0null")))
        aggs += [F.sum(F.pmod(h, F.lit(1_000_003))).alias(f"{c}_a"), F.sum(F.pmod(F.shiftrightunsigned(h, 20), F.lit(1_000_033))).alias(f"{c}_b")]
    row = df.agg(*aggs).first()
    return [(row[f"{c}_a"], row[f"{c}_b"]) for c in df.columns]


def _row_key(df: DataFrame) -> tuple:
    """A bag hash of the rows' cells in sorted order: equal for equal bags, whatever the order of columns."""
    h = F.xxhash64(F.array_sort(F.array(*[F.coalesce(F.col(c), F.lit("\0null")) for c in df.columns])))
    row = df.agg(F.sum(F.pmod(h, F.lit(1_000_003))).alias("a"), F.bit_xor(h).alias("b")).first()
    return row["a"], row["b"]


def _assignments(fx: list[tuple], fy: list[tuple]) -> Iterator[list[int]]:
    """Orders of the columns of ``fy`` in which fingerprints meet, built group by group."""
    groups: dict[tuple, tuple[list[int], list[int]]] = {}
    for i, f in enumerate(fx):
        groups.setdefault(f, ([], []))[0].append(i)
    for j, f in enumerate(fy):
        groups.setdefault(f, ([], []))[1].append(j)
    if any(len(a) != len(b) for a, b in groups.values()):
        return
    waiting = list(groups.values())

    def fill(k: int, out: list[int]) -> Iterator[list[int]]:
        if k == len(waiting):
            yield list(out)
            return
        a, b = waiting[k]
        for own in permutations(b):
            for i, j in zip(a, own, strict=True):
                out[i] = j
            yield from fill(k + 1, out)

    yield from fill(0, [0] * len(fx))


def _same_bag(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def results_equal(a: DataFrame, b: DataFrame, ordered: bool = False) -> bool:
    """Equal as bags (or lists) of rows under some order of columns.

    Bags are compared in Spark; an ordered comparison numbers rows, which is for results
    that were meant to be read in order. Two hashes of each side reject most pairs of
    unequal results first; only columns of equal contents are tried in several orders.
    """
    if len(a.columns) != len(b.columns):
        return a.isEmpty() and b.isEmpty()
    x, y = normalized(a), normalized(b)
    n, m = x.count(), y.count()
    if n != m:
        return False
    if n == 0:
        return True
    if _row_key(x) != _row_key(y):
        return False
    cols = x.columns
    fx, fy = _fingerprints(x), _fingerprints(y)
    extra: list[str] = []
    held: list[DataFrame] = []
    try:
        if ordered:
            x, y, extra = _numbered(x, held), _numbered(y, held), ["_row"]
        for tried, p in enumerate(_assignments(fx, fy)):
            if tried == MAX_PERMUTATIONS:
                raise ValueError("too many columns with equal contents")
            if _same_bag(x.select(*extra, *cols), y.select(*extra, *[F.col(f"c{j}").alias(f"c{i}") for i, j in enumerate(p)])):
                return True
        return False
    finally:
        for at in held:
            at.unpersist()


def _numbered(df: DataFrame, held: list[DataFrame]) -> DataFrame:
    """``df`` with ``_row``, the number of each row in its order; what it keeps goes to ``held``.

    A row's number is its place in its partition after the rows of all partitions before; only
    the partitions' sizes are ranked in one task. The rows are kept while they are counted, so
    both passes see one order.
    """
    at = df.withColumn("_at", F.monotonically_increasing_id()).persist()
    held.append(at)
    part = F.shiftright("_at", 33)
    sizes = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.join(starts, part == F.col("_part")).select(*df.columns, (F.col("_start") + place).alias("_row"))


@dataclass(frozen=True)
class Outcome:
    score: float
    message: str = ""


def execution_accuracy(engine, predicted: str, gold: str) -> Outcome:
    """1 if both queries give the same result, else 0; order counts iff the gold orders."""
    if predicted.strip() == gold.strip():
        return Outcome(1.0)
    try:
        want = engine.query(gold)
    except Exception as e:
        return Outcome(0.0, f"gold: {e}")
    try:
        return Outcome(float(results_equal(engine.query(predicted), want, "order by" in gold.lower())))
    except Exception as e:
        return Outcome(0.0, str(e))


@dataclass(frozen=True)
class Validation:
    text: str
    valid: bool
    result_count: int
    message: str = ""


def validate(engine, text: str) -> Validation:
    """Whether a query runs, and its rows. A failure is no valid query of zero rows."""
    try:
        return Validation(text, True, engine.query(text).count())
    except Exception as e:
        return Validation(text, False, 0, str(e).splitlines()[0][:200])


def filtered(engine, texts: list[str]) -> list[Validation]:
    """Validated queries that give rows."""
    return [v for v in (validate(engine, t) for t in texts) if v.result_count > 0]


def rollup(results: DataFrame, by: list[str]) -> DataFrame:
    """Totals and rates of evaluation results (is_success 0/1) by group."""
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("is_success").cast("long")).alias("passed"), F.round(F.avg(F.col("is_success").cast("double")), 6).alias("rate"))


def remaining(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks without a result yet, to resume an evaluation."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")


class ResultLog:
    """An append-only log of results in the shared folder, which a later run resumes from.

    Appends add small files to the newest generation, a folder; ``compact`` writes all of them
    as a new generation, which counts from when Spark has marked it complete, and removes the old
    ones. One run at a time writes a log; a key that was logged twice counts once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key = schema.split()[0]
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _generations(self) -> list[int]:
        if not self._fs.exists(self._at()):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at())]
        found = sorted(int(n[4:]) for n in names if n.startswith("gen-") and n[4:].isdigit())
        # A generation of a compaction that broke off has no mark.
        return [g for g in found if g == 0 or self._fs.exists(self._at(f"gen-{g}", "all", "_SUCCESS"))]

    def read(self) -> DataFrame:
        newest = (self._generations() or [0])[-1]
        top = self._at(f"gen-{newest}")
        if not self._fs.exists(top):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(top.toString())
        return rows.dropDuplicates([self.key])

    def append(self, rows: list[tuple]) -> None:
        newest = (self._generations() or [0])[-1]
        part = self._at(f"gen-{newest}", f"part-{uuid.uuid4().hex}").toString()
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(part)

    def compact(self) -> None:
        old = self._generations()
        if not old:
            return
        self.read().write.mode("overwrite").parquet(self._at(f"gen-{old[-1] + 1}", "all").toString())
        for g in old:
            self._fs.delete(self._at(f"gen-{g}"), True)


class _Timed:
    """Runs a call in a thread of its own whose Spark jobs are cancelled when its time is up."""

    def __init__(self, spark: SparkSession, call: Callable[[], Outcome], timeout: float | None) -> None:
        self.spark, self.group, self.timeout = spark, f"evaluation-{uuid.uuid4().hex}", timeout
        self.outcome: Outcome | None = None
        self.thread = InheritableThread(target=self._run, args=(call,), daemon=True)
        self.thread.start()
        self.began = time.monotonic()

    def _run(self, call: Callable[[], Outcome]) -> None:
        self.spark.sparkContext.setJobGroup(self.group, "a query under evaluation", interruptOnCancel=True)
        try:
            self.outcome = call()
        except Exception as e:
            self.outcome = Outcome(0.0, str(e))

    def result(self) -> Outcome:
        """The outcome, or that there was none in time; a thread that hangs is left to itself."""
        self.thread.join(None if self.timeout is None else max(0.0, self.began + self.timeout - time.monotonic()))
        if not self.thread.is_alive():
            return self.outcome
        self.spark.sparkContext.cancelJobGroup(self.group)
        self.thread.join(5.0)
        return Outcome(0.0, f"timeout after {self.timeout} s")


def evaluated(spark: SparkSession, engine, tasks: DataFrame, key: str, log: ResultLog | str | None = None, threads: int = 4, timeout: float | None = None, chunk: int = 64) -> DataFrame:
    """key, score and message of every task (key, predicted, gold), also of those logged before.

    Tasks without a result in ``log`` (a ResultLog, or the folder of one) run in ``threads`` threads over one
    engine, each under a job group of its own; one that takes longer than ``timeout`` seconds is
    cancelled and scores 0. Tasks are walked in order of their keys; every ``chunk`` results are
    appended to the log, which is compacted at the end.
    """
    schema = f"{key} {dict(tasks.dtypes)[key]}, score double, message string"
    if not isinstance(log, ResultLog):
        log = ResultLog(spark, log or shared_path(spark, "results"), schema)
    running: deque[tuple] = deque()
    rows: list[tuple] = []

    def finish() -> None:
        k, run = running.popleft()
        o = run.result()
        rows.append((k, o.score, o.message))
        if len(rows) >= chunk:
            log.append(rows)
            rows.clear()

    for r in remaining(tasks, log.read(), key).select(key, "predicted", "gold").orderBy(key).toLocalIterator():
        if len(running) == threads:
            finish()
        running.append((r[key], _Timed(spark, lambda r=r: execution_accuracy(engine, r["predicted"], r["gold"]), timeout)))
    while running:
        finish()
    if rows:
        log.append(rows)
    log.compact()
    return log.read().join(tasks.select(key).distinct(), key, "left_semi")
