"""Document fingerprints: threshold-scaled sketches, by DataFrame functions only.

A fingerprint keeps every hash of a text's five-word shingles (words lower-cased, a shorter
text is one shingle) below a fixed fraction of the range of hashes, so its size follows the
text's and a short text can be looked for in a long one. Where fewer than FLOOR hashes lie
below, the FLOOR least ones are kept, so short texts have fingerprints too. Both rules hold
for unions of texts as well: ``merged`` makes the fingerprint of a union from those of its parts.

Two fingerprints are compared up to the largest hash to which both are complete: ``containment``
estimates the share of the smaller text's shingles that the larger one has, ``resemblance``
that of all shingles of both.

``edited`` pairs each text with the one that follows in descending order of ids. Ids are put
in order by ranges (``operators.ordered``); texts travel once by their own key, and the
beginning of each once more to the text before it, so no task sees a run of texts.

Defined results: null and empty texts have no shingles and the empty fingerprint; two of these
are alike (1.0), one is unlike any other (0.0). Null ids come last in descending order; rows
of one id follow each other by the digests of their texts; rows that repeat id and text are one
document in the order, and each of them is returned. A single document follows itself. Texts of
any length are hashed whole; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import read, stored
from quillgraph.operators.ordered import Over, over_all

WORDS, FRACTION, FLOOR = 5, 16, 32
#: Hashes have 63 bits; those below stay.
THRESHOLD = (1 << 63) // FRACTION
_LARGEST = (1 << 63) - 1
_SPACE = " \t\n\x0b\x0c\r"


def _hash(words: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(words), 1)


def sketched(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of the column ``text`` as a sorted array of hashes."""
    # One column after the other, so that each is computed once.
    df = df.withColumn("_words", F.split(F.btrim(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(_SPACE)), r"[\x20\x09-\x0D]+"))
    words, n = F.col("_words"), F.size("_words")
    runs = F.transform(F.sequence(F.lit(1), n - (WORDS - 1)), lambda i: _hash(F.slice(words, i, WORDS)))
    every = F.when(n >= WORDS, runs).when(F.element_at(words, 1) != "", F.array(_hash(words))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_all", every).withColumn("_low", F.array_distinct(F.filter("_all", lambda h: h < THRESHOLD)))
    kept = F.when(F.size("_low") >= FLOOR, F.sort_array("_low")).otherwise(F.slice(F.sort_array(F.array_distinct("_all")), 1, FLOOR))
    return df.withColumn(out, kept).drop("_words", "_all", "_low")


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of the union of two texts' shingles."""
    both = F.sort_array(F.array_union(a, b))
    low = F.filter(both, lambda h: h < THRESHOLD)
    return F.when(F.size(low) >= FLOOR, low).otherwise(F.slice(both, 1, FLOOR))


def _complete(a: Column) -> Column:
    """The largest hash up to which a fingerprint holds all of its text's."""
    last = F.element_at(a, -1)
    return F.when(F.size(a) < FLOOR, F.lit(_LARGEST)).when((F.size(a) == FLOOR) & (last >= THRESHOLD), last).otherwise(F.lit(THRESHOLD - 1))


def _compared(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Sizes of both fingerprints and of what they share, as far as both are complete."""
    most = F.least(_complete(a), _complete(b))
    x, y = F.filter(a, lambda h: h <= most), F.filter(b, lambda h: h <= most)
    return F.size(x), F.size(y), F.size(F.array_intersect(x, y))


def _share(a: Column, b: Column, shared: Column, of: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(of > 0, shared / of).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller set of shingles that lies in the other one."""
    x, y, shared = _compared(a, b)
    return _share(a, b, shared, F.least(x, y))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of either text that are in both."""
    x, y, shared = _compared(a, b)
    return _share(a, b, shared, x + y - shared)


def as_text(a: Column) -> Column:
    """A fingerprint as 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (not null) and ``_key``, which tells rows apart by id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"))
    return rows.withColumn("_key", F.concat(own.cast("binary"), F.unhex(F.sha2(F.col("text").cast("binary"), 256))))


def ordered_keys(rows: DataFrame) -> DataFrame:
    """_key, doc_id, n_chars, copies, and the keys before and after in descending order of ids.

    The first row's predecessor is the last row, and the other way round.
    """
    keys = rows.groupBy("_key").agg(F.first("doc_id").alias("doc_id"), F.first(F.length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    order = [F.desc_nulls_last("doc_id"), F.desc("_key")]
    own = F.struct("_key", "n_chars")
    keys = stored(over_all(keys, order, {"before": Over("lag", own), "after": Over("lead", own)}), "id-order")
    # Two rows at most close the ring.
    ends = keys.select(F.max(F.when(F.col("before").isNull(), own)).alias("first"), F.max(F.when(F.col("after").isNull(), own)).alias("last"))
    keys = keys.crossJoin(F.broadcast(ends))
    return keys.select("_key", "doc_id", "n_chars", "copies", F.coalesce("before", "last").alias("before"), F.coalesce("after", "first")["_key"].alias("after"))


def edited(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The columns of ``keys``, the fingerprint ``f`` of each text and ``g`` of the next one, and
    the text whose last half (rounded down) the beginning of the next one replaces."""
    # Rows that repeat a key are dropped before they travel: a key's first row is as good as any.
    once = sketched(rows, "text", "f").select("_key", "text", "f").dropDuplicates(["_key"])
    both = once.join(keys, "_key")
    own = both.select("_key", "doc_id", "n_chars", "copies", "f", F.expr("substring(text, 1, CAST(n_chars - floor(n_chars / 2) AS INT))").alias("own"))
    need = F.floor(F.col("before.n_chars") / 2).cast("int")
    piece = both.select(F.col("before._key").alias("_key"), F.substring("text", F.lit(1), need).alias("piece"), F.col("f").alias("g"))
    return own.join(piece, "_key").withColumn("edited", F.concat("own", "piece")).drop("own", "piece")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint, that of its edited text, and how like its text these and the next one are."""
    rows = keyed(docs)
    keys = stored(ordered_keys(rows), "id-ring")
    out = sketched(edited(rows, keys).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), "edited", "e")
    f, e, g = F.col("f"), F.col("e"), F.col("g")
    out = out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(f).alias("fingerprint"), as_text(e).alias("edited_fingerprint"), containment(f, e).alias("near_edited"),
        containment(f, g).alias("near_next"), resemblance(f, e).alias("resemblance_edited"), resemblance(f, g).alias("resemblance_next"), "copies",
    )
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_copy", "copies")


def op12_fingerprints(spark, sf_dir):
    return fingerprinted(read(spark, sf_dir, "documents"))
