"""Source divergence audit: how far the term shares of a language's sources lie apart.

Texts are cut into terms (runs of letters and of anything beyond ASCII, A-Z lower-cased) in
one Arrow pass that counts occurrences and documents by (language, source, term); the counts
are summed by Spark, and a language keeps the terms of at least MIN_DOCS of its documents.
Kept terms are dealt to blocks of about BLOCK terms by hash. A block becomes a dense int64
tile of sources by terms; shares of all its cells come from exact integer division, and every
source meets every other one by broadcasting over the tile. A task adds its blocks' partial
matrices up and keeps one heap of the TOP terms a source; Spark sums the matrices of all
tasks and merges their heaps.

Sources of a language beyond STRIP are dealt to strips; a tile then holds two strips, and
each pair of strips is a task of its own, so a tile has at most 2 * STRIP rows. Nothing is
broadcast by Spark and no group's rows meet in one task: a source, language or term of any
share of the corpus is a row a block in the tiles.

Defined results: null texts, languages and sources are empty texts; a source without terms
takes part with counts of 0; a language without kept terms has pairs of value 0 and no term
rows; equal values rank by the item's UTF-8 bytes; repeated rows count as often as they stand;
texts of any length are counted whole, an empty table gives an empty result, and further
columns are not read. Arithmetic is exact up to 9e15 occurrences of kept terms in a language.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded_batches, lean, partitions, read, stored

MIN_DOCS = 30
TOP = 50
SCALE, PSEUDO = 10**9, 5
#: Terms of a block, sources of a strip, and distinct counts that a task gathers before it hands them on.
BLOCK, STRIP, HELD = 4096, 256, 400_000
#: Bytes that are letters keep their place (A-Z as a-z), other ASCII parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_TERM_BYTES).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of a task's rows; the empty term stands for the group itself."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            n[b""] = 0
            keys = list(n)
            for i in range(0, len(keys), 50_000):
                some = keys[i : i + 50_000]
                fill = lambda x: pa.array([x] * len(some), pa.binary())  # noqa: B023, E731
                counts = [pa.array([c[k] for k in some], pa.int64()) for c in (n, docs)]
                yield pa.RecordBatch.from_arrays([fill(lang), fill(source), pa.array(some, pa.binary()), *counts], ["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        cells = [c.cast(pa.binary()).to_pylist() for c in batch.columns]
        for text, lang, source in zip(*cells, strict=True):
            n, docs = held.setdefault((lang or b"", source or b""), (Counter(), Counter()))
            if text:
                before = len(n)
                own = Counter(terms(text))
                n.update(own)
                docs.update(own.keys())
                size += len(n) - before
        if size > HELD:
            yield from out()
            size = 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs of all rows, as UTF-8 binaries; the empty term is the group."""
    bounded_batches(docs.sparkSession)
    text = docs.select(*[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])
    made = text.mapInArrow(lean(_counted), "lang binary, source binary, term binary, n long, docs long")
    return made.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) without overflow: long division by digits of 1000."""
    out, rest = np.divmod(count, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return 1 + out


class _Reversed:
    """Bytes in descending order, for heaps whose least element goes first."""

    __slots__ = ("x",)

    def __init__(self, x: bytes) -> None:
        self.x = x

    def __lt__(self, other: _Reversed) -> bool:
        return other.x < self.x


_TILE = "lang binary, a int, b int, block int, at int, total long, size long, term binary, n long, lang_n long, lang_total long"
_PART = "lang binary, kind int, x int, y int, term binary, value long"


def _tiles(strip: int):
    """Partial pair matrices and heaps of a task, whose rows come sorted by language, strips and block.

    Of every block its sources come first (rows without a term), then the counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: np.ndarray | None = None
        heaps: dict[int, list] = {}
        now = None  # language and strips
        block, rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sums
            if sums is None:
                return
            lang, a, b = now
            x, y = np.nonzero(sums >= 0)
            first, second = a * strip + x, b * strip + y
            keep = first < second
            if keep.any():
                k = int(keep.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * k, pa.binary()), pa.array(np.zeros(k, np.int32)), pa.array(first[keep].astype(np.int32)), pa.array(second[keep].astype(np.int32)), pa.nulls(k, pa.binary()), pa.array(sums[x[keep], y[keep]])],
                    ["lang", "kind", "x", "y", "term", "value"],
                )
            best = [(at, term.x, value) for at, heap in heaps.items() for value, term in heap]
            if best:
                k = len(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * k, pa.binary()), pa.array(np.ones(k, np.int32)), pa.array([r[0] for r in best], pa.int32()), pa.nulls(k, pa.int32()), pa.array([r[1] for r in best], pa.binary()), pa.array([r[2] for r in best], pa.int64())],
                    ["lang", "kind", "x", "y", "term", "value"],
                )
            sums = None
            heaps.clear()

        def tile() -> None:
            """One block: add its pairs up, offer its terms to the heaps."""
            nonlocal sums
            t = pa.Table.from_batches(rows)
            lang, a, b = now
            heads = t.filter(pc.is_null(t["term"]))
            cells = t.filter(pc.is_valid(t["term"]))
            code = cells["term"].combine_chunks().dictionary_encode()
            names, col = code.dictionary.to_pylist(), code.indices.to_numpy()
            at, size = heads["at"].to_numpy(), int(heads["size"][0].as_py())
            height = strip if a == b else 2 * strip
            row = lambda x: np.where(x // strip == a, 0, strip) + x % strip
            total, known = np.ones(height, np.int64), np.zeros(height, bool)
            total[row(at)] = heads["total"].to_numpy() + PSEUDO * size
            known[row(at)] = True
            count = np.zeros((height, len(names)), np.int64)
            count[row(cells["at"].to_numpy()), col] = cells["n"].to_numpy()
            used = int(np.flatnonzero(known).max()) + 1  # sources fill strips from the front
            p = shares(count[:used] + PSEUDO, total[:used, None])
            left, right = p[:strip], p if a == b else p[strip:]
            if sums is None:
                sums = np.full((strip, strip), -1, np.int64)
                sums[np.ix_(known[:strip], known[-strip:])] = 0
            # As many rows against all others as keep the broadcast cube near 16 MB.
            step = max(1, (1 << 21) // max(1, right.size))
            for i in range(0, len(left), step):
                some = np.abs(left[i : i + step, None, :] - right[None, :, :]).sum(2)
                sums[i : i + len(some), : some.shape[1]] += some
            if a != b:
                return
            lang_n, lang_total = np.zeros(len(names), np.int64), int(cells["lang_total"][0].as_py()) if cells.num_rows else 0
            lang_n[col] = cells["lang_n"].to_numpy()
            q = shares(lang_n + PSEUDO, np.int64(lang_total + PSEUDO * size)) if len(names) else lang_n
            for i in np.flatnonzero(known[:used]).tolist():
                over = np.flatnonzero((count[i] > 0) & (p[i] > q))
                if not len(over):
                    continue
                value = p[i, over] - q[over]
                if len(over) > TOP:  # ties with the last one stay for the heap to settle
                    least = np.partition(value, -TOP)[-TOP]
                    over, value = over[value >= least], value[value >= least]
                heap = heaps.setdefault(a * strip + i, [])
                for k, v in zip(over.tolist(), value.tolist(), strict=True):
                    entry = (v, _Reversed(names[k]))
                    if len(heap) < TOP:
                        heapq.heappush(heap, entry)
                    elif heap[0] < entry:
                        heapq.heapreplace(heap, entry)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = list(zip(*[batch[c].to_pylist() for c in ("lang", "a", "b", "block")], strict=True))
            start = 0
            while start < len(key):
                end = start + 1
                while end < len(key) and key[end] == key[start]:
                    end += 1
                if key[start] != block:
                    if rows:
                        tile()
                        rows = []
                    block = key[start]
                    if block[:3] != now:
                        yield from flush()
                        now = block[:3]
                rows.append(batch.slice(start, end - start))
                start = end
        if rows:
            tile()
        yield from flush()

    return run


def audit(docs: DataFrame, block: int = BLOCK, strip: int = STRIP) -> DataFrame:
    """lang, source, part, item, value, rank of every source against the others and its language."""
    spark = docs.sparkSession
    counts = stored(term_counts(docs), "term-counts")
    # One row a source and one a language: small next to the counts, joined by Spark as their sizes tell.
    groups = counts.where("term = x''").select("lang", "source")
    groups = groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    per_term = counts.where("term <> x''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("by"))
    kept = stored(per_term.where(F.col("docs") >= MIN_DOCS).select("lang", "term", "lang_n", "by"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("lang_n").alias("lang_total"))
    cells = kept.select("lang", "term", "lang_n", F.explode("by").alias("c")).select("lang", "term", "lang_n", "c.source", "c.n")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = stored(groups.na.fill(0, ["size", "total", "lang_total"]).withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang"))), "groups")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / block)).cast("int")
    strips = F.ceil(F.col("sources") / strip).cast("int")
    own = F.floor(F.col("at") / strip).cast("int")

    def paired(df: DataFrame) -> DataFrame:
        """A row for each pair of strips that its source's strip is in."""
        df = df.withColumn("_o", F.explode(F.sequence(F.lit(0), strips - 1)))
        return df.withColumn("a", F.least(own, "_o")).withColumn("b", F.greatest(own, "_o"))

    columns = [c.split()[0] for c in _TILE.split(", ")]
    heads = paired(groups.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))))
    heads = heads.withColumn("term", F.lit(None).cast("binary")).withColumn("n", F.lit(0).cast("long")).withColumn("lang_n", F.lit(0).cast("long"))
    rows = cells.join(groups, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), blocks.cast("long")).cast("int"))
    cut = lambda df: df.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in _TILE.split(", "))])
    both = cut(heads).unionByName(cut(paired(rows)))
    tiles = both.repartition(partitions(spark), "lang", "a", "b", "block").sortWithinPartitions("lang", "a", "b", "block", F.col("term").asc_nulls_first())
    parts = stored(tiles.select(*columns).mapInArrow(lean(_tiles(strip)), _PART), "tile-sums")
    near = parts.where("kind = 0").groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    near = near.unionByName(near.select("lang", F.col("y").alias("x"), F.col("x").alias("y"), "value"))
    names = groups.select("lang", "source", "at")
    named = lambda df, c, n: df.join(names.select("lang", F.col("at").alias(c), F.col("source").alias(n)), ["lang", c])
    pair = named(named(near, "x", "source"), "y", "item").select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    term = named(parts.where("kind = 1"), "x", "source").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    pair = pair.withColumn("rank", F.row_number().over(w))
    term = term.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP)
    texts = [F.col(c).cast("string").alias(c) for c in ("lang", "source")]
    return pair.unionByName(term).select(*texts, "part", F.col("item").cast("string").alias("item"), "value", "rank")


def op11_divergence(spark, sf_dir):
    return audit(read(spark, sf_dir, "documents"))


#: DuckDB SQL for the same rows.
OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
  g AS (SELECT DISTINCT lang, source FROM d),
  k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
  c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN k USING (lang, term) GROUP BY ALL),
  v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
  t AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
  p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
    FROM t JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
  q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) AS q
    FROM c JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY 1) USING (lang) JOIN v USING (lang) GROUP BY ALL),
  f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM o QUALIFY part = 'pair' OR rank <= 50
"""
