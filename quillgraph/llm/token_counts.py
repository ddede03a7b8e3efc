"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but ids of WIDTH bytes (little-endian), every document ended by an
end-of-document id. The scan cuts files into blocks of BLOCK ids and searches each block
for the id with one vectorised comparison; per block it keeps the places of separators.
A prefix scan over a file's blocks then gives each block the number of documents before
it (a sum) and where the document that reaches into it began (a maximum), which stitches
documents across any number of blocks. Ids after a file's last separator are a document
that has no end; it is counted with ``ended`` false.

A file is read whole by one task (Spark's binary reader allows 2 GB), so writers bound their
files: ``write`` begins a new one after FILE_DOCS documents of a partition.

Counts go back to documents by the partition and place that their rows had when they were
written. ``write`` sums up what stood where, and ``placed`` stops unless a second scan sums
up to the same, so a table that is read in another order is noticed.

Defined results: a null or empty text is a document of 0 tokens; an empty file has no
document; repeated rows are documents of their own; an empty table gives an empty result;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded_batches, lean, read, scratch

#: Ids in a block.
BLOCK = 1 << 20
WIDTH = 2
EOD = 50_256
#: Documents in a file at most.
FILE_DOCS = 16_384

_open: dict[str, object] = {}


def encoding(path: str):
    """The byte-level BPE of a rank file, in this process."""
    if path not in _open:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _open[path] = tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _open[path]


def _separator(eod: int) -> str:
    """The id's bytes as the text writer's line separator under ISO-8859-1."""
    return eod.to_bytes(WIDTH, "little").decode("latin-1")


def order_key() -> Column:
    """One number for which rows stand at which places."""
    return F.bit_xor(F.xxhash64("at", "doc_id")).alias("key")


def order_of(docs: DataFrame) -> int | None:
    return docs.select("doc_id", F.monotonically_increasing_id().alias("at")).agg(order_key()).first()["key"]


def write(docs: DataFrame, to: str, path: str, eod: int = EOD) -> int | None:
    """Flat token files of the texts of ``docs``, numbered in each partition, rows in order; the order's key.

    Spark's text writer puts the id bytes of a row and then the separator, so commits,
    retries and stores are Spark's.
    """

    bounded_batches(docs.sparkSession)

    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoding(path)
        for s in batches:
            yield pd.Series([np.array(e.encode_ordinary(x), "<u2").tobytes() if isinstance(x, str) else b"" for x in s], dtype=object)

    seen = Observation()
    tokens = F.pandas_udf(lean(ids), "binary")(F.col("text").cast("string")).cast("string").alias("value")
    flat = docs.select(tokens, "doc_id", F.monotonically_increasing_id().alias("at")).observe(seen, order_key()).select("value")
    flat.write.option("maxRecordsPerFile", FILE_DOCS).option("encoding", "ISO-8859-1").option("lineSep", _separator(eod)).text(to)
    return seen.get["key"]


def scan(spark, files: str, eod: int = EOD, block: int = BLOCK) -> DataFrame:
    """file, ordinal (from 0), n_tokens and ended of every document in the token files."""
    kind = np.dtype(f"<u{WIDTH}")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                all_ids = np.frombuffer(content.as_buffer(), kind)
                for number, start in enumerate(range(0, len(all_ids), block)):
                    part = all_ids[start : start + block]
                    ends = np.flatnonzero(part == eod) + start
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([number], pa.int64()), pa.array([start + len(part)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                        ["file", "block", "stop", "ends"],
                    )

    found = spark.read.format("binaryFile").load(files).select("path", "content")
    found = found.mapInArrow(lean(blocks), "file string, block long, stop long, ends array<long>")
    # The prefix scan: windows are over the blocks of one file.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    found = found.select(
        "file", "ends", "stop",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("earlier"),
        F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(-1)).alias("last"),
        F.max("stop").over(after).isNull().alias("final"),
    )
    # A last document without an end stops where the file does.
    open_end = F.col("final") & (F.coalesce(F.array_max("ends"), F.col("last")) < F.col("stop") - 1)
    stops = F.when(open_end, F.concat("ends", F.array("stop"))).otherwise(F.col("ends"))
    return found.select("file", "ends", "earlier", "last", stops.alias("stops")).select("file", "ends", "earlier", "last", "stops", F.posexplode("stops").alias("i", "end")).select(
        "file",
        (F.col("earlier") + F.col("i")).alias("ordinal"),
        (F.col("end") - F.when(F.col("i") == 0, F.col("last")).otherwise(F.element_at("stops", F.greatest(F.col("i"), F.lit(1)))) - 1).alias("n_tokens"),
        (F.col("i") < F.size("ends")).alias("ended"),
    )


def placed(docs: DataFrame, counts: DataFrame, key: int | None) -> DataFrame:
    """doc_id and n_tokens by partition and place in it; stops where ``docs`` is not read as it was written (``key``)."""
    # The same scan of the table gives rows the same partition and place as when they were written.
    at = F.monotonically_increasing_id()
    if order_of(docs) != key:
        raise RuntimeError("the table was read in another order than its tokens were written in")
    rows = docs.select("doc_id", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("ordinal"), F.lit(True).alias("_row"))
    # Places are dense on both sides, so partitions of other sizes leave a row or a count alone.
    both = rows.join(counts.select("part", "ordinal", "n_tokens"), ["part", "ordinal"], "full")
    alone = F.col("_row").isNull() | F.col("n_tokens").isNull()
    stop = F.raise_error(F.lit("the table was read in other partitions than its tokens were written in")).cast("long")
    return both.select("doc_id", F.when(alone, stop).otherwise(F.col("n_tokens")).alias("n_tokens"))


def op5_token_counts(spark, sf_dir):
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    for _ in range(3):  # how a table is split can change while executors are still starting
        to = scratch(spark, "tokens")
        key = write(docs, to, public_tokenizers.path("byte_bpe_50k.tiktoken"))
        if key == order_of(docs):
            break
    part, number = (F.regexp_extract("file", r"part-(\d+)-.*-c(\d+)\.", k).cast("long") for k in (1, 2))
    counts = scan(spark, to).where("ended").select(part.alias("part"), (number * FILE_DOCS + F.col("ordinal")).alias("ordinal"), "n_tokens")
    return placed(docs, counts, key)
