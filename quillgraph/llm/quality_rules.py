"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each (language, source) has a sketch of every rule's statistic: counts of logarithmic
bins whose width bounds the relative error of a quantile (ACCURACY). Sketches of parts
add up exactly, so the aggregation is partial everywhere, no group's rows meet in a task,
and reruns agree; copies of a text count once. Fences stand SPREAD times the quartiles' distance above the upper and,
for statistics that may be too small as well (RULES), below the lower quartile. Where a
group hardly varies, as one full of copies does, the distance is at least SHARE of its
language's, and never less than the rule's resolution. A group of fewer than LEAST rows
takes the fences of its language, a language as small those of the corpus. A text that the base rules pass is rejected where a
statistic is beyond its group's fences.

Defined results: null and empty texts have zero counts and fail the base rules; null
languages and sources form groups of their own; texts of any length are measured whole;
repeated rows are each judged, and a value on a fence passes; an empty table gives an empty result; ``apply`` returns all columns of its input unchanged,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded_batches, read, stored, whole
from quillgraph.llm.textstats import COUNTS, stats

#: Statistic -> its resolution (a smaller distance is no difference), and whether it has a lower fence too.
RULES = {
    "marks_per_word": (0.1, False), "upper_share": (0.02, False), "chars_per_word": (0.8, True),
    "top_word_share": (0.05, False), "distinct_share": (0.1, True), "ends_per_word": (0.05, True),
}
ACCURACY = 0.01
SPREAD, SHARE = 5.0, 0.5
LEAST = 50
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
_LEAST_VALUE = 1e-6


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Bin counts of every rule's statistic by group: the keys, rule, bin, n. Add n to merge."""
    melted = rows.select(*keys, F.explode(F.create_map(*[x for c in RULES for x in (F.lit(c), F.col(c))])).alias("rule", "value"))
    index = F.when(F.col("value") <= _LEAST_VALUE, F.lit(-(10**6))).otherwise(F.ceil(F.log(F.col("value")) / F.log(F.lit(_GAMMA)))).cast("int")
    return melted.groupBy(*keys, "rule", index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(binned: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and rule: lower and upper quartile (q1, q3), and the group's rows as ``n_rows``."""
    # A group has at most a few thousand bins a rule, whatever its rows.
    one = F.sort_array(F.collect_list(F.struct("bin", "n")))
    per = binned.groupBy(*keys, "rule").agg(one.alias("bins"), F.sum("n").alias("n_rows"))

    def at(q: float):
        walk = F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("bin")),
            lambda a, x: F.struct(
                (a["seen"] + x["n"]).alias("seen"),
                F.when(a["bin"].isNull() & (a["seen"] + x["n"] >= F.ceil(F.lit(q) * F.col("n_rows"))), x["bin"]).otherwise(a["bin"]).alias("bin"),
            ),
        )["bin"]
        return F.when(walk == -(10**6), F.lit(0.0)).otherwise(2 * F.pow(F.lit(_GAMMA), walk) / (_GAMMA + 1))

    return per.select(*keys, "rule", "n_rows", at(0.25).alias("q1"), at(0.75).alias("q3"))


def fences(binned: DataFrame) -> DataFrame:
    """Per (lang, source) and rule of the sketches: low, high, n_rows, and whether the group's own spread set them."""
    resolution = F.create_map(*[x for c, (v, _) in RULES.items() for x in (F.lit(c), F.lit(v))])[F.col("rule")]

    def level(keys: list[str], tag: str) -> DataFrame:
        """Quartiles and distance of the merged sketches of ``keys``."""
        merged = quartiles(binned.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n")), keys)
        names = [F.col(k).alias(f"{tag}_{k}") for k in (*keys, "rule", "n_rows", "q1", "q3")]
        return merged.withColumn("w", F.greatest(SPREAD * (F.col("q3") - F.col("q1")), resolution)).select(*names, F.col("w").alias(f"{tag}_w"))

    # One row a rule; the languages are a table that Spark broadcasts while it is small.
    per = quartiles(binned, ["lang", "source"]).join(F.broadcast(level([], "all")), F.col("rule") == F.col("all_rule"))
    per = per.join(level(["lang"], "its"), F.col("lang").eqNullSafe(F.col("its_lang")) & (F.col("rule") == F.col("its_rule")))
    rare, small = F.col("its_n_rows") < LEAST, F.col("n_rows") < LEAST
    wider = {c: F.when(rare, F.col(f"all_{c}")).otherwise(F.col(f"its_{c}")) for c in ("q1", "q3", "w")}
    q1, q3 = F.when(small, wider["q1"]).otherwise(F.col("q1")), F.when(small, wider["q3"]).otherwise(F.col("q3"))
    own = SPREAD * (F.col("q3") - F.col("q1"))
    # A quantile's own error never puts a fence inside the quantile.
    wide = F.when(small, wider["w"]).otherwise(F.greatest(own, SHARE * wider["w"], resolution, 2 * ACCURACY * q3))
    return per.select("lang", "source", "rule", "n_rows", (q1 - wide).alias("low"), (q3 + wide).alias("high"), (~small & (own >= wide)).alias("own"))


def thresholds(rows: DataFrame) -> DataFrame:
    """One row per group: lang, source, and maps from rule to its lowest and highest value.

    Copies of a text count once: a group's fences are those of its texts, however often one
    of them is repeated.
    """
    keys = ["lang", "source"]
    per = fences(stored(sketches(rows.select(*keys, "copy", *RULES).distinct(), keys), "sketches"))
    pairs = lambda c: F.map_from_entries(F.collect_list(F.struct("rule", c)))
    return stored(per.groupBy("lang", "source").agg(pairs("low").alias("lows"), pairs("high").alias("highs")), "fences")


def _keyed(t: DataFrame) -> DataFrame:
    return t.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "lows", "highs")


def _verdict(stat) -> tuple[Column, Column]:
    """Whether the base rules fail, and whether a fence is crossed; ``stat`` gives a statistic by name."""
    base = (stat("n_words") < MIN_WORDS) | (100 * stat("n_repeat_words") > MAX_REPEAT_PERCENT * stat("n_words"))
    out = F.lit(False)
    for c, (_, two_sided) in RULES.items():
        out = out | F.coalesce(stat(c) > F.col("highs")[c], F.lit(False))
        if two_sided:
            out = out | F.coalesce(stat(c) < F.col("lows")[c], F.lit(False))
    return base, out


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` of ``measure`` with base_failed and kept."""
    # The stored fences have a known size: Spark broadcasts them below its threshold and else shuffles.
    t = _keyed(thresholds(rows))
    base, out = _verdict(F.col)
    both = rows.join(t, rows["lang"].eqNullSafe(t["_lang"]) & rows["source"].eqNullSafe(t["_source"]), "left")
    return both.withColumn("base_failed", base).withColumn("kept", ~base & ~out).select(*rows.columns, "base_failed", "kept")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, a number that copies of a text share, and all statistics of every text."""
    bounded_batches(docs.sparkSession)
    own = docs.select("doc_id", "lang", "source", F.xxhash64(F.col("text").cast("string")).alias("copy"), stats(F.col("text")).alias("s"))
    return own.select("doc_id", "lang", "source", "copy", "s.*")


def apply(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns; no text is shuffled."""
    t = _keyed(thresholds(stored(measure(docs), "stats")))
    rows = docs.select(whole(docs).alias("row"), stats(F.col("text")).alias("s"))
    rows = rows.join(t, F.col("row.lang").eqNullSafe(t["_lang"]) & F.col("row.source").eqNullSafe(t["_source"]), "left")
    base, out = _verdict(lambda c: F.col("s")[c])
    return rows.where(~(base | out)).select("row.*")


def op6_quality_rules(spark, sf_dir):
    rows = stored(measure(read(spark, sf_dir, "documents")), "stats")
    return judged(rows).select("doc_id", *COUNTS, "base_failed", "kept")
