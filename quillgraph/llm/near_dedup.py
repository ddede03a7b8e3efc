"""MinHash near-duplicates by an LSH forest.

A document's set is its distinct word shingles as 64-bit hashes; equal sets are one class
and everything else is on classes. A signature has TREES * DEPTH minhashes (16 bits each).
A tree sorts the signatures rotated by its number, behind the first DEPTH values by their low
bytes; in sorted order, neighbours are those of the longest common prefix, so a crowded region is told apart by as many more values as
it takes, and a sparse one by DEPTH only. Candidates are neighbours of LCP >= DEPTH whose
signatures agree enough (SLACK below the threshold) and whose sizes allow a link; every one
is confirmed on full sets. A row stands in the trees where others share its DEPTH-prefix only.

Round one takes each row's next neighbour. Components of the confirmed links then stand
for their members, and round two takes, at distances up to REACH, the neighbours in other
components. Sorting is by range over whole rotated signatures and the class id, which
splits any group; neighbours across partition bounds are stitched.

A row that shares its DEPTH-prefix with rows beyond REACH is crowded, and both ends of a
link that the window cuts off are. Crowded rows meet once more by prefix filtering of their
full sets (``crowds``), which misses no link: shingles are ordered from those within one
component over rare to frequent ones, and linked sets of different components share one
among the first few of each. So a link is missed only where a pair shares no DEPTH-prefix
in any tree: at similarity 0.85 with probability 5e-8, at 0.8 3e-6.

Defined results: documents without words (or null) have no shingle and are linked with
nothing; with fewer words than a shingle the word sequence is the one shingle; repeated
rows are each returned; null ids never are a component's id unless it has no other; an
empty table gives an empty result; extra columns are not read, and ``apply`` returns them
unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded_batches, lean, partitions, raw, read, stored, whole
from quillgraph.llm.components import components

TREES, DEPTH = 24, 4
VALUES = TREES * DEPTH
REACH = 16
SLACK = 0.2
ROWS = 20_000  # rows a sorted partition has at least, on average
BLOCK = 4096  # rows of a shingle that a part of its block has, on average
WORDS = 1 << 20  # 64-bit words that a filter has at most

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_RNG = np.random.default_rng(20_11)
_A = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; A-Z are lower-cased (bytes.lower is ASCII only)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = _mix(s * _P + h[k : len(h) - n + 1 + k])
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """VALUES minhashes, cut to 16 bits: the high bytes of all, then the low ones."""
    x = (s >> np.uint64(20)).astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        y = x[k : k + 512, None] * _A + _B
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out = np.minimum(out, y.min(0))
    return np.concatenate([out >> np.uint32(16), out >> np.uint32(8)]).astype(np.uint8)


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, ns, sigs = [], [], []
            for text in batch.column(2):
                s = shingles(raw(text.as_py()), size)
                ns.append(len(s))
                cids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cids, pa.binary()), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "rid", "cid", "n", "sig"])

    return lean(run)


def _prefix(more: int) -> str:
    """SQL: ``tree``'s DEPTH values of ``sig``, high bytes, then low ones and those of the ``more`` values after them."""
    return f"concat(substring(sig, 1 + tree * {DEPTH}, {DEPTH}), substring(sig, {VALUES + 1} + tree * {DEPTH}, {DEPTH + more}))"


def _forest(rows: DataFrame) -> DataFrame:
    """tree, rotated signature (DEPTH + VALUES bytes), and the other columns of ``rows``, for every tree in the bits of ``trees``."""
    tree = rows.withColumn("tree", F.explode(F.expr(f"filter(sequence(0, {TREES - 1}), x -> (shiftright(trees, x) & 1) = 1)")))
    turned = F.expr(f"concat({_prefix(VALUES)}, substring(sig, {VALUES + 1}, tree * {DEPTH}))")
    return tree.withColumn("key", turned).drop("sig", "trees")


def among(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is in ``keys``, and a few others: a Bloom filter ahead of a join.

    A join with a small part of ``rows`` would shuffle them all. A key sets four bits of one
    word; words are united by ``bit_or`` and broadcast. There are never more than WORDS, so
    with very many keys more of the other rows pass, which the join drops.
    """
    words = max(1, min(WORDS, keys.count() * 12 // 64))
    bits = " | ".join(f"shiftleft(1L, int(shiftright(_h, {k}) & 63))" for k in (40, 46, 52, 58))

    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumn("_h", F.xxhash64(column)).withColumns({"_word": F.expr(f"pmod(_h, {words}L)"), "_bits": F.expr(bits)})

    table = hashed(keys.select(column)).groupBy(F.col("_word").alias("_w")).agg(F.bit_or("_bits").alias("_set"))
    met = (F.col("_word") == F.col("_w")) & (F.col("_bits").bitwiseAND(F.col("_set")) == F.col("_bits"))
    return hashed(rows).join(F.broadcast(table), met).select(*rows.columns)


def in_play(classes: DataFrame) -> DataFrame:
    """cid, trees: classes (cid, sig) that share a DEPTH-prefix with another one, and in which trees, as bits."""
    tree = classes.select("cid", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    # The tree stands in the lowest bits; where hashes meet by chance, a row has a tree too many.
    prefixes = tree.select("cid", F.expr(f"xxhash64({_prefix(0)}) & ~31L | tree").alias("p"))
    shared = stored(prefixes.groupBy("p").agg(F.count(F.lit(1)).alias("f")).where("f > 1").select("p"), "shared")
    met = among(prefixes, shared, "p").join(shared, "p")
    return met.groupBy("cid").agg(F.expr("bit_or(shiftleft(1, int(p & 31)))").alias("trees"))


def _neighbours(reach: int, least: float, percent: int, mark: bool):
    """mapInArrow over sorted rows: pairs within ``reach`` of LCP >= DEPTH in different
    components, of sizes that allow ``percent``, with ``mark`` crowded rows as pairs with themselves (both ends of an LCP >=
    DEPTH beyond ``reach``), and the first and last rows of the partition for the bounds
    (kind 1, 2)."""
    far = reach + mark

    def pairs(rows: list[tuple], lo: int) -> list[tuple]:
        """Pairs whose later row is at ``lo`` or after."""
        if len(rows) < 2:
            return []
        key = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), DEPTH + VALUES)
        tree = np.array([r[0] for r in rows])
        names: dict[bytes, int] = {}
        comp = np.array([names.setdefault(r[3], len(names)) for r in rows])
        n = np.array([r[4] for r in rows])
        out = []
        for w in range(1, min(far, len(rows) - 1) + 1):
            j = np.arange(max(w, lo), len(rows))
            i = j - w
            ok = tree[i] == tree[j] if w > reach else (tree[i] == tree[j]) & (comp[i] != comp[j])
            i, j = i[ok], j[ok]
            ok = (key[i, : 2 * DEPTH] == key[j, : 2 * DEPTH]).all(1)
            i, j = i[ok], j[ok]
            if w > reach:
                out += [(x, x) for x in {rows[k][2] for k in np.union1d(i, j).tolist()}]
                continue
            ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = i[ok], j[ok]
            ok = (key[i, DEPTH:] == key[j, DEPTH:]).mean(1) >= least
            for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                x, y = rows[a][2], rows[b][2]
                out.append((min(x, y), max(x, y)))
        return out

    cols = ["kind", "at", "tree", "key", "cid", "comp", "n"]
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        head: list[tuple] = []
        tail: list[tuple] = []
        for b in batches:
            new = list(zip(*[b.column(c).to_pylist() for c in cols[2:]], strict=True))
            head += new[: far - len(head)] if len(head) < far else []
            rows = tail + new
            found = pairs(rows, len(tail))
            if found:
                yield batch([(0, None, None, None, x, y, None) for x, y in set(found)])
            tail = rows[-far:]
        # Rows of the next partition meet the last rows of this one.
        yield batch([(1, at, *r) for r in head] + [(2, at + 1, *r) for r in tail])

    def stitch(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*[table[c].to_pylist() for c in cols], strict=True), key=lambda r: (r[2], r[3], r[4]))
        found = pairs([r[2:] for r in rows], 1) if len({r[0] for r in rows}) == 2 else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return lean(run), stitch


def candidates(nodes: DataFrame, reach: int, percent: int, mark: bool = False) -> DataFrame:
    """Distinct candidate pairs a, b of ``nodes`` (cid, sig, n, trees, comp); with ``mark``, a = b is a crowded row."""
    run, stitch = _neighbours(reach, percent / 100 - SLACK, percent, mark)
    rows = _forest(nodes)
    total = nodes.agg(F.sum(F.bit_count("trees")).alias("n")).first().n or 0
    parts = int(min(4 * partitions(nodes.sparkSession), max(1, total // ROWS)))
    line = rows.repartitionByRange(parts, "tree", "key", "cid").sortWithinPartitions("tree", "key", "cid")
    found = stored(line.mapInArrow(run, "kind int, at long, tree int, key binary, cid binary, comp binary, n long"), "neighbours")
    inner = found.where("kind = 0").select(F.col("cid").alias("a"), F.col("comp").alias("b"))
    bounds = found.where("kind > 0").groupBy("at").applyInArrow(stitch, "a binary, b binary")
    return inner.unionByName(bounds).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for b in batches:
            ok = []
            for x, za, zb in zip(b.column(0), b.column(2), b.column(3), strict=True):
                if x != last:
                    last, mine = x, shingles(zstandard.decompress(za.as_py()), size)
                other = shingles(zstandard.decompress(zb.as_py()), size)
                both = np.concatenate([mine, other])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a = texts.select(F.col("cid").alias("a"), F.col("z").alias("za"))
    b = texts.select(F.col("cid").alias("b"), F.col("z").alias("zb"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "za", "zb").mapInArrow(lean(run), "a binary, b binary")


def crowds(nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Candidate pairs a, b of ``nodes`` (cid, comp) that hold every link between components.

    Sets of n and m >= n shingles with a similarity of ``percent`` share at least
    percent * (n + m) / (100 + percent). Counted in any one order of all shingles, their
    first common one stands before so many places of either end, so the smaller set's first
    shingles are met with somewhat more of the larger one's. Blocks of a frequent shingle
    are dealt to parts, so no task holds one whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cid, comp, z in zip(b.column(0), b.column(1), b.column(2), strict=True):
                s = shingles(zstandard.decompress(z.as_py()), size).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(cid, len(s)), pa.repeat(comp, len(s)), pa.repeat(pa.scalar(len(s), pa.int64()), len(s)), pa.array(s)], ["cid", "comp", "n", "s"])

    joined = nodes.select("cid", "comp").join(texts, "cid").select("cid", "comp", "z")
    sets = stored(joined.mapInArrow(lean(run), "cid binary, comp binary, n long, s long"), "sets")
    # Shingles within one component link nothing; they come first in the order and are only counted.
    met = sets.groupBy("s").agg(F.count(F.lit(1)).alias("f"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("s", "f")
    line = Window.partitionBy("cid").orderBy("f", "s")
    rows = sets.join(met, "s").withColumn("at", F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("cid")) + F.row_number().over(line) - 1)
    # ``at`` counts from 0; whole numbers keep the bounds exact.
    rows = stored(rows.where(100 * (F.col("n") - F.col("at")) >= percent * F.col("n")), "prefixes")
    parts = F.ceil(F.col("f") / BLOCK).cast("int")
    a = rows.where((100 + percent) * (F.col("n") - F.col("at")) >= 2 * percent * F.col("n")).withColumn("part", F.pmod(F.xxhash64("cid"), parts).cast("int"))
    b = rows.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    a = a.select("s", "part", *[F.col(c).alias(f"{c}_a") for c in ("cid", "comp", "n", "at")])
    b = b.select("s", "part", *[F.col(c).alias(f"{c}_b") for c in ("cid", "comp", "n", "at")])
    larger = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("cid_a") < F.col("cid_b")))
    room = (100 + percent) * F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= percent * (F.col("n_a") + F.col("n_b"))
    found = a.join(b, ["s", "part"]).where((F.col("comp_a") != F.col("comp_b")) & larger & (100 * F.col("n_a") >= percent * F.col("n_b")) & room)
    return found.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct()


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: rid and packed text."""
    for b in batches:
        z = [zstandard.compress(raw(t.as_py()).lower(), 3) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary())], ["rid", "z"])


def row_key() -> Column:
    """128 bits that tell rows of other ids or texts apart."""
    number, text = F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string")
    kind = F.when(text.isNull(), F.lit(" n")).otherwise(F.lit(" t"))
    return F.unhex(F.md5(F.concat(F.coalesce(number, F.lit("")), kind, F.coalesce(text, F.lit("")))))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, rid (of ``row_key``), n_shingles, component_id, is_first.

    ``is_first`` marks one row of each component: the least doc_id, then the least rid.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rid"), F.col("text").cast("string").alias("text"))
    rows = stored(slim.mapInArrow(_signed(size), "doc_id long, rid binary, cid binary, n long, sig binary"), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    classes = stored(rows.where("cid is not null").groupBy("cid").agg(F.min(first).alias("first"), F.max("sig").alias("sig"), F.max("n").alias("n")), "classes")
    play = stored(in_play(classes.select("cid", "sig")), "play")
    nodes = stored(among(classes, play, "cid").join(play, "cid").select("cid", "sig", "n", "trees", F.col("first.rid").alias("rid")), "nodes")
    # Only texts of classes in play are shuffled, packed; rows of one rid have one text.
    packed = among(slim.select("rid", "text"), nodes, "rid").mapInArrow(lean(_zipped), "rid binary, z binary")
    texts = stored(packed.dropDuplicates(["rid"]).join(nodes.select("rid", "cid"), "rid").select("cid", "z"), "texts")
    tried = stored(candidates(nodes.select("cid", "sig", "n", "trees", F.col("cid").alias("comp")), 1, percent), "candidates")
    links = stored(confirmed(tried, texts, size, percent), "links")
    comp = components(links)
    named = nodes.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "sig", "n", "trees", F.coalesce("root", "cid").alias("comp"))
    found = stored(candidates(stored(named, "named"), REACH, percent, True), "candidates")
    links = links.unionByName(stored(confirmed(found.where("a <> b").join(tried, ["a", "b"], "left_anti"), texts, size, percent), "links"))
    comp = components(links)
    crowded = stored(found.where("a = b").select(F.col("a").alias("cid")).join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("cid", F.coalesce("root", "cid").alias("comp")), "crowded")
    if not crowded.isEmpty():
        pairs = stored(crowds(crowded, texts, size, percent), "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("cid"))
        more = stored(confirmed(pairs, among(texts, ends, "cid"), size, percent), "links")
        if not more.isEmpty():
            comp = components(links.unionByName(more))
    # Every class's component, and the first row of each.
    root = stored(classes.select("cid", "first").join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "first", F.coalesce("root", "cid").alias("root")), "roots")
    firsts = root.groupBy("root").agg(F.min("first").alias("first"))
    root = stored(root.select("cid", "root").join(firsts, "root").select("cid", "first"), "firsts")
    out = rows.select("doc_id", "rid", "cid", "n").join(root, "cid", "left")
    alone = F.col("cid").isNull()
    return out.select(
        "doc_id", "rid", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (alone | ((F.col("first.rid") == F.col("rid")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id")))).alias("is_first"),
    )


def apply(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``docs`` as they are.

    Rows equal in id and text are copies too; of them one stays, the least by a hash of all
    columns, which is found without texts. Texts travel once, to meet the keys and hashes of the
    rows that stay; rows that are equal in all columns go to one task then.
    """
    keep = near_duplicates(docs, size, percent).where("is_first").select("rid").distinct()
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    rows = docs.select(row_key().alias("rid"), F.xxhash64(*plain).alias("h"), whole(docs).alias("row"))
    least = stored(rows.groupBy("rid").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("copies")).join(keep, "rid", "left_semi"), "keep")
    # Where a row is one of several, a task's are combined before they are shuffled.
    some = least.where("copies > 1").drop("copies")
    alone = rows.join(least.where("copies = 1").drop("copies"), ["rid", "h"], "left_semi")
    if some.isEmpty():
        return alone.select("row.*")
    twins = rows.join(some, ["rid", "h"], "left_semi").groupBy("rid").agg(F.first("row").alias("row"))
    return alone.unionByName(twins.select("rid", F.lit(0).cast("long").alias("h"), "row")).select("row.*")


def op10_near_dedup(spark, sf_dir):
    out = near_duplicates(read(spark, sf_dir, "documents"), 3, 85)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
