"""Helpers shared by the text operators: table access, the shared folder, text bytes."""

from __future__ import annotations

import ctypes
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule here: space and code points 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of ``sf_dir``, through Spark's reader so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder of the session.

    The folder is ``spark.checkpoint.dir``; only where that is unset in local mode (tests
    on one machine) a folder below /tmp is used, and on a cluster it has to be set. What is
    written there goes when the JVM ends.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file:///tmp/quillgraph-scratch"
    path = f"{top.rstrip('/')}/quillgraph-{tag}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends in durable files."""
    path = scratch(df.sparkSession, tag)
    # A writer keeps a row group in memory; texts make it large.
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> None:
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes from now on in this session.

    Texts are long: at Spark's 10,000 rows a batch, buffers of both sides and what Python
    makes of them take hundreds of MB a task. Smaller settings stay. The setting has to
    outlive this call, as frames are planned when their caller runs them.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(re.match(r"-?\d+", spark.conf.get(key))[0])
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def trim() -> None:
    """Give freed memory back to the system.

    Python workers live on between tasks, and what their allocators hold back counts for
    every worker of an executor.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library has its own ways
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a worker's function from batches to batches, with a trim at the end of its task."""

    @wraps(run)
    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed


def whole(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that no name of an operator's own meets them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, mod: int):
    """crc32 of the number as text, modulo ``mod``; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def crc_mod_py(value, mod: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % mod


def raw(text: str | None) -> bytes:
    """UTF-8 bytes; null is empty, and lone surrogates never stop a run."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
