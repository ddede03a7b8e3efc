"""The text pipeline: stages in order, each written as Parquet and read by the next.

Every stage but the last returns the columns of ``documents``:

* quality: drops what the base rules and the adaptive thresholds reject;
* near_dedup: keeps one document of each group of near duplicates (five-word shingles,
  similarity 0.8 or more);
* pii: masks every span of personal data in the text (and counts its characters anew);
* mixing: takes documents as often as the source weights ask, in shuffled shards;
* bpe: encodes and decodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, mixing, near_dedup, pii, quality_rules
from quillgraph.llm.common import read, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.apply(docs, 5, 80)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.apply(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode(docs)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_dedup", dedup), ("pii", personal), ("mixing", mix), ("bpe", tokens)]

#: Dedup, the model of the PII stage and BPE are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
