"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Everything is DataFrame functions. A source's target is its weighted share of all words,
at most MAX_COPIES times its own words, the excess reshared by weight. Its documents are
dealt to blocks by hash; the target is whole copies of all blocks, then blocks of one more
copy in permuted order, then documents of one boundary block in permuted order, each in if
it still fits (so a source stays below its target by less than any document left out).

The number of block items of each source is its exact quota. A binary tree splits the
quotas among output shards: at each node one half of the items goes left, its counts by
source being one multivariate-hypergeometric draw (sequential hypergeometric inversion,
seeded by the node). A shard takes its share of each source's permuted items,
disjoint from the others', and orders its documents by a seeded hash.

All draws are hashes of SEED, so reruns agree. No window is over the documents of a
source: block sums are aggregated, windows run over blocks (at most MAX_BLOCKS a source),
and of a boundary block's documents those of equal id and size are one entry with a number.
Where only some rows of such an entry still fit, they are numbered in two steps (within a
partition, then over partitions), so no number of equal rows meets in a task.

Sources are listed in one row and one task (their targets depend on one another): they may
be thousands, not one for each document.

Defined results: null and empty texts have size 0 and take nothing; a null source is the
last source; a source of no words has target 0; repeated rows are documents of their own,
which of them a copy takes is as their order is; an empty table gives an empty result;
``apply`` returns all columns of its input unchanged, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import WORD, read, stored, whole

SEED = 20240
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
BLOCK_DOCS, MAX_BLOCKS = 256, 65_536
#: Words in an output shard, about; the tree is as deep as that asks, within these bounds.
SHARD_WORDS, MIN_DEPTH, MAX_DEPTH = 2_000_000, 4, 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source of ``sizes`` (source, size): source_size, n_docs, target."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # These windows are over sources, one row each.
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1).cast("int"))
    src = src.withColumn("weight", w).withColumn("cap", MAX_COPIES * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # If this source and all with a larger cap for their weight are below their caps, this is their words a weight.
    src = src.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    src = src.withColumn("level", F.first(fits, ignorenulls=True).over(everything))
    return src.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).select("source", "source_size", "n_docs", "target")


def _log_factorial(x: Column) -> Column:
    small = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(16)])
    x = x.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(x < 16, F.element_at(small, (F.greatest(x, F.lit(0.0)) + 1).cast("int"))).otherwise(series)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """Inversion of the hypergeometric distribution at ``u``: how many good ones are drawn.

    Outside ten standard deviations of the mean (and one more) the mass is below 1e-20.
    """
    mean = drawn * good / F.greatest(total, F.lit(1))
    sd = F.sqrt(F.greatest(mean * (total - good) / F.greatest(total, F.lit(1)) * (total - drawn) / F.greatest(total - 1, F.lit(1)), F.lit(0.0)))
    low = F.greatest(F.lit(0), drawn - (total - good), F.floor(mean - 10 * sd) - 1).cast("long")
    high = F.least(drawn, good, F.ceil(mean + 10 * sd) + 1).cast("long")
    mass = F.transform(F.sequence(low, high), lambda k: F.struct(k.alias("k"), F.exp(_log_choose(good, k) + _log_choose(total - good, drawn - k) - _log_choose(total, drawn)).alias("p")))

    def pick(m: Column) -> Column:
        whole = F.aggregate(m, F.lit(0.0), lambda a, x: a + x["p"])
        start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("long").alias("k"))
        walked = F.aggregate(
            m, start,
            lambda a, x: F.struct((a["c"] + x["p"]).alias("c"), F.when(a["k"].isNull() & (a["c"] + x["p"] >= u * whole), x["k"]).otherwise(a["k"]).alias("k")),
        )
        return F.coalesce(walked["k"], high)

    return _let(mass, pick)


def _uniform(*parts: Column) -> Column:
    return (F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def split_quotas(quotas: DataFrame, depth: int) -> DataFrame:
    """The splitting tree. ``quotas``: one row with array<long> ``quota``; out: node (shard number), quota."""
    nodes = quotas.select(F.lit(1).cast("long").alias("node"), "quota")
    for level in range(depth):
        if level == 8:  # from here on the nodes of a deep tree are split by many tasks
            nodes = nodes.repartition("node")
        total = F.aggregate("quota", F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(total.alias("rest"), F.floor(total / 2).cast("long").alias("drawn"), F.array().cast("array<long>").alias("out"))

        def step(a: Column, i: Column) -> Column:
            good = F.element_at(F.col("quota"), i)
            u = _uniform(F.col("node"), i)
            return _let(hypergeometric(a["rest"], good, a["drawn"], u), lambda k: F.struct((a["rest"] - good).alias("rest"), (a["drawn"] - k).alias("drawn"), F.concat(a["out"], F.array(k)).alias("out")))

        left = F.aggregate(F.sequence(F.lit(1), F.size("quota")), start, step)["out"]
        nodes = nodes.withColumn("left", left).select(
            F.explode(
                F.array(
                    F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("quota")),
                    F.struct((2 * F.col("node") + 1).alias("node"), F.zip_with("quota", "left", lambda q, x: q - x).alias("quota")),
                )
            ).alias("n")
        ).select("n.*")
    return nodes.select((F.col("node") - (1 << depth)).alias("shard"), "quota")


def _block(n_docs: Column) -> Column:
    blocks = F.least(F.lit(MAX_BLOCKS), F.ceil(n_docs / BLOCK_DOCS)).cast("long")
    return F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("doc_id"), F.col("size")), blocks)


def _order() -> Column:
    return F.xxhash64(F.lit(SEED + 2), F.col("doc_id"), F.col("size"))


def _same(a: DataFrame, b: DataFrame, *names: str):
    on = F.lit(True)
    for n in names:
        on = on & a[n].eqNullSafe(b[n])
    return on


def plan(sizes: DataFrame, depth: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From rows of doc_id, source, size: the sources' targets, the items of every block, and the split entries.

    Items: source, block, and an array of (copy, shard, part) where part is null for a whole
    block and else lists the documents that are in: their (at, id), how many rows have that
    (n), and how many of these are in (k). Split entries are the (source, at, id) with k < n.
    """
    src = stored(targets(sizes), "targets")
    if depth is None:
        words = src.agg(F.sum("source_size")).first()[0] or 0
        depth = min(MAX_DEPTH, max(MIN_DEPTH, math.ceil(math.log2(max(1, words / SHARD_WORDS)))))
    s = src.select(F.col("source").alias("_source"), "n_docs", "target", "source_size")
    dealt = sizes.join(s, sizes["source"].eqNullSafe(s["_source"])).withColumn("block", _block(F.col("n_docs")))
    blocks = dealt.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    # A copy of a block is an item; items of a copy stand in permuted order.
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    items = blocks.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    items = items.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(MAX_COPIES)))).where(F.col("copy") <= F.col("whole") + 1)
    perm = Window.partitionBy("source", "copy").orderBy(F.xxhash64(F.lit(SEED + 3), F.col("copy"), F.col("block")), "block")
    items = items.withColumn("end", F.sum("words").over(perm.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(perm) - 1)
    partial = F.col("copy") > F.col("whole")
    items = items.where(~partial | (F.col("end") - F.col("words") < F.col("rest")))
    items = items.withColumn("cut_at", F.when(partial & (F.col("end") > F.col("rest")), F.col("rest") - (F.col("end") - F.col("words"))))
    number = Window.partitionBy("source").orderBy("copy", "rank")
    items = stored(items.withColumn("number", F.row_number().over(number) - 1).select("source", "block", "copy", "number", "cut_at"), "items")
    # Quotas by source in one row, split among the shards.
    by = items.groupBy("source").agg(F.count(F.lit(1)).alias("q"))
    listed = by.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("no_source"), "source", "q"))).alias("l"))
    listed = listed.where(F.size("l") > 0)
    leaves = split_quotas(listed.select(F.col("l.q").alias("quota")), depth)
    names = listed.select(F.posexplode("l").alias("i", "x")).select("i", F.col("x.source").alias("source"))
    per = leaves.select("shard", F.posexplode("quota").alias("i", "q")).where("q > 0")
    # A shard takes the next items of each source: the window is over the shards of a source.
    line = Window.partitionBy("i").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("stop", F.sum("q").over(line))
    per = per.select("i", "shard", F.explode(F.sequence(F.col("stop") - F.col("q"), F.col("stop") - 1)).alias("_number"))
    dealt_to = stored(names.join(per, "i").select(F.col("source").alias("_source"), "_number", "shard"), "shards")
    items = items.join(dealt_to, items["source"].eqNullSafe(dealt_to["_source"]) & (items["number"] == dealt_to["_number"])).drop("_source", "_number")
    # The boundary block of a source: its documents in permuted order, each in if it still fits.
    edge = stored(items.where("cut_at is not null").select("source", "block", "cut_at"), "edges")
    e = edge.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "cut_at")
    own = dealt.join(e, dealt["source"].eqNullSafe(e["_s"]) & (dealt["block"] == e["_b"]))
    own = own.where("size > 0").groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("cut_at").alias("cut_at"))
    own = own.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(_order().alias("at"), F.col("doc_id").alias("id"), "size", "n"))).alias("l"), F.first("cut_at").alias("cut_at"))
    entry = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("at", "id", "n", "k")])
    none = F.filter(F.array(entry), lambda x: F.lit(False))
    start = F.struct(F.lit(0).cast("long").alias("sum"), none.alias("out"))

    def fit(a: Column, x: Column) -> Column:
        k = F.least(x["n"], F.floor((F.col("cut_at") - a["sum"]) / x["size"]).cast("long"))
        more = F.struct((a["sum"] + k * x["size"]).alias("sum"), F.concat(a["out"], F.array(F.struct(x["at"].alias("at"), x["id"].alias("id"), x["n"].alias("n"), k.alias("k")))).alias("out"))
        return F.when(k > 0, more).otherwise(a)

    cuts = stored(own.select(F.col("source").alias("_s"), F.aggregate("l", start, fit)["out"].alias("part")), "cuts")
    split = cuts.select("_s", F.explode("part").alias("x")).where("x.k < x.n").select(F.col("_s").alias("_source"), F.col("x.at").alias("_at"), F.col("x.id").alias("_id"))
    items = items.join(cuts, items["source"].eqNullSafe(cuts["_s"]), "left")
    items = items.withColumn("part", F.when(F.col("cut_at").isNotNull(), F.coalesce("part", none)))
    return src, stored(items.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard", "part"))).alias("items")), "plan"), split.distinct()


def numbered(rows: DataFrame, split: DataFrame) -> DataFrame:
    """``rows`` (with doc_id, source, size, and ``tie`` to order equal ones) with ``rank``: a
    row's number among its equals where it is of a split entry, else 0."""
    if split.isEmpty():
        return rows.withColumn("rank", F.lit(0).cast("long"))
    on = rows["source"].eqNullSafe(split["_source"]) & rows["doc_id"].eqNullSafe(split["_id"]) & (_order() == split["_at"])
    calm = rows.join(split, on, "left_anti").withColumn("rank", F.lit(0).cast("long"))
    rest = stored(rows.join(split, on, "left_semi").withColumn("_part", F.spark_partition_id()), "split")
    keys = ["source", "doc_id", "size"]
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rest.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("_part").alias("_p"), "_before")
    here = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("tie")) - 1
    rest = rest.withColumn("_here", here)
    met = rest["_part"] == parts["_p"]
    for c in keys:
        met = met & rest[c].eqNullSafe(parts[f"_{c}"])
    rest = rest.join(parts, met).withColumn("rank", (F.col("_here") + F.col("_before")).cast("long"))
    return calm.unionByName(rest.select(*calm.columns))


def placed(rows: DataFrame, src: DataFrame, items: DataFrame) -> DataFrame:
    """``rows`` (of ``numbered``) with source_size, target and ``placements``: an array of
    (copy, shard, key), one entry for each time the mix takes the row."""
    kept = rows.columns
    s = src.select(F.col("source").alias("_source"), "n_docs", "source_size", "target")
    out = rows.join(s, rows["source"].eqNullSafe(s["_source"])).withColumn("_block", _block(F.col("n_docs")))
    i = items.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "items")
    out = out.join(i, out["source"].eqNullSafe(i["_s"]) & (out["_block"] == i["_b"]), "left").withColumn("_at", _order())
    mine = lambda x: (x["at"] == F.col("_at")) & x["id"].eqNullSafe(F.col("doc_id")) & (F.col("rank") < x["k"])
    taken = F.filter(F.coalesce("items", F.array()), lambda x: (F.col("size") > 0) & (x["part"].isNull() | F.exists(x["part"], mine)))
    places = F.transform(taken, lambda x: F.struct(x["copy"].alias("copy"), x["shard"].alias("shard"), F.xxhash64(F.lit(SEED + 4), x["copy"], F.col("doc_id"), F.col("size")).alias("key")))
    return out.withColumn("placements", places).select(*kept, "source_size", "target", "placements")


def apply(docs: DataFrame, depth: int | None = None) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as taken, shard by shard, shuffled in each."""
    size = n_words(F.col("text")).alias("size")
    src, items, split = plan(stored(docs.select("doc_id", "source", size), "sizes"), depth)
    rows = docs.select(whole(docs).alias("row"), "doc_id", "source", size, F.xxhash64(F.col("text").cast("string")).alias("tie"))
    out = placed(numbered(rows, split), src, items).select("row", "doc_id", "tie", F.explode("placements").alias("p"))
    return out.repartition(F.col("p.shard")).sortWithinPartitions("p.shard", "p.key", "p.copy", "doc_id", "tie").select("row.*")


def op8_mixing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    # A number for each row that stays as it is stored.
    sizes = stored(docs.select(F.monotonically_increasing_id().alias("tie"), "doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    src, items, split = plan(sizes)
    out = stored(placed(numbered(sizes, split), src, items), "placed")
    # A shard's documents are about SHARD_WORDS words, one window for each.
    line = Window.partitionBy("p.shard").orderBy("p.key", "p.copy", "doc_id", "tie")
    at = out.select("tie", "doc_id", F.explode("placements").alias("p")).select("tie", "p.copy", "p.shard", (F.row_number().over(line) - 1).cast("long").alias("position"))
    by = at.groupBy("tie").agg(F.sort_array(F.collect_list(F.struct("copy", "shard", "position"))).alias("places"))
    places = F.coalesce("places", F.filter(F.array(F.struct(F.lit(0).alias("copy"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("position"))), lambda x: F.lit(False)))
    out = out.join(by, "tie", "left").withColumn("places", places)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("places")).alias("taken"), "places")
