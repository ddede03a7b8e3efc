"""Toxicity: a character n-gram linear classifier with naive Bayes features.

Character n-grams of the lower-cased text (NGRAMS code points long, white space as single
blanks, padded by one) are hashed into BUCKETS. On a bounded labelled sample every n-gram gets the log ratio of its
document frequencies in the two classes; the clearest KEPT n-grams stay, and a document's
features are their presences times those ratios. A logistic regression with a quadratic
penalty on these scaled features is trained on the driver, and every whole text is scored.

The sample is at most about ``TRAIN_ROWS`` labelled rows, chosen by a hash of the id; with
no labels of both kinds all scores are the share of label 1 (0 without labels).

Defined results: null and empty texts get the score of no feature; texts of any length are
read whole; equal texts and repeated rows get equal scores, and n-grams that are equally clear
are kept by their number; null labels are not learned from; an empty table gives an empty
result; ``scored`` returns the columns of its input, a ``score`` among them replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded_batches, crc_mod, lean, raw, read, stored
from quillgraph.llm.quality_model import sampled_labels

NGRAMS = (5, 7)
BUCKETS = 1 << 20
KEPT = 4096
TRAIN_ROWS = 16_000
SMOOTH, PENALTY, STEPS = 1.0, 1e-3, 300
THRESHOLD = 0.3
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def grams(text: str | None) -> np.ndarray:
    """Hash bucket of every n-gram at every position (with repeats)."""
    flat = b" " + b" ".join(raw(text.lower() if text else None).split()) + b" "
    a = np.frombuffer(flat.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    for n in NGRAMS:
        if len(a) >= n:
            h = np.full(len(a) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * _BASE + a[k : len(a) - n + 1 + k]
            out.append((h * _MIX) >> np.uint64(44))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def _class_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Document frequencies by class of one task's sample rows."""
    counts, rows = np.zeros((2, BUCKETS), np.int64), [0, 0]
    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["label"], strict=True):
            counts[label, np.unique(grams(text))] += 1
            rows[label] += 1
    for label in (0, 1):
        some = np.flatnonzero(counts[label])
        yield pd.DataFrame({"label": label, "gram": np.append(some, -1), "n": np.append(counts[label, some], rows[label])})


def train(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Weight of every bucket (mostly 0) and the intercept from rows of text and label."""
    bounded_batches(sample.sparkSession)
    counted = sample.mapInPandas(lean(_class_counts), "label int, gram long, n long")
    one = lambda k: F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0))
    by = stored(counted.groupBy("gram").agg(one(0).alias("n0"), one(1).alias("n1")), "grams")
    whole = by.where("gram = -1").first()  # gram -1: the rows
    rows = (whole["n0"], whole["n1"]) if whole else (0, 0)
    weights = np.zeros(BUCKETS)
    if min(rows) == 0:
        p = float(np.clip(rows[1] / sum(rows), 1e-3, 1 - 1e-3)) if sum(rows) else 1e-3
        return weights, float(np.log(p / (1 - p)))
    # How many standard errors a class difference is away from none; the clearest come to the driver.
    pooled = (F.col("n0") + F.col("n1") + 1) / (sum(rows) + 2)
    clear = F.abs(F.col("n1") / rows[1] - F.col("n0") / rows[0]) / F.sqrt(pooled * (1 - pooled) * (1 / rows[0] + 1 / rows[1]))
    top = by.where("gram >= 0").withColumn("clear", clear).where("clear > 3").orderBy(F.desc("clear"), "gram").limit(KEPT)
    top = sorted((r["gram"], r["n0"], r["n1"]) for r in top.collect())
    kept = np.array([r[0] for r in top], np.int64)
    n0, n1 = np.array([r[1] for r in top], float), np.array([r[2] for r in top], float)
    ratio = np.log((n1 + SMOOTH) / (rows[1] + 2 * SMOOTH)) - np.log((n0 + SMOOTH) / (rows[0] + 2 * SMOOTH))
    place = np.full(BUCKETS, -1, np.int16)
    place[kept] = np.arange(len(kept))

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = (place[grams(t)] for t in pdf["text"])
            own = [np.unique(p[p >= 0]).astype("<u2").tobytes() for p in found]
            yield pd.DataFrame({"label": pdf["label"], "own": own})

    pdf = sample.mapInPandas(lean(present), "label int, own binary").toPandas().sort_values(["own", "label"])
    y = pdf["label"].to_numpy(np.float64)
    own = [np.frombuffer(x, "<u2").astype(np.int64) for x in pdf["own"]]
    at = np.concatenate(own) if own else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    value = ratio[at]
    w, b = np.zeros(len(kept)), float(np.log(y.mean() / (1 - y.mean())))
    # Power iteration for the step.
    v = np.ones(len(kept))
    for _ in range(20):
        u = np.bincount(row, value * v[at], len(y))
        v = np.bincount(at, value * u[row], len(kept))
        norm = np.linalg.norm(v)
        v /= max(norm, 1e-12)
    step = 4.0 / (norm / len(y) + 1 + 4 * PENALTY)
    z, t, last = w.copy(), 1.0, w.copy()
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-(np.bincount(row, value * z[at], len(y)) + b))) - y
        w = z - step * (np.bincount(at, value * r[row], len(kept)) / len(y) + PENALTY * z)
        b -= step * r.mean()
        t, t0 = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, last = w + (t0 - 1) / t * (w - last), w
    weights[kept] = w * ratio
    return weights, b


def scored(docs: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """``docs`` with ``score``."""
    some = np.flatnonzero(weights)  # at most KEPT numbers travel to the tasks
    values = weights[some]

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place = np.zeros(BUCKETS, np.uint16)
        place[some] = np.arange(1, len(some) + 1)
        value = np.append(0.0, values)
        for s in batches:
            out = []
            for text in s:
                p = place[grams(text if isinstance(text, str) else None)]
                total = intercept + value[np.unique(p[p > 0])].sum()
                out.append(1 / (1 + np.exp(-np.clip(total, -500, 500))))
            yield pd.Series(out, dtype="float64")

    return docs.withColumn("score", F.pandas_udf(lean(score), "double")(F.col("text").cast("string")))


def op9_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    labels = sampled_labels(read(spark, sf_dir, "labels"), "toxic", TRAIN_ROWS)
    # The sample has about TRAIN_ROWS ids at most, so it may be sent to every task and no text is shuffled.
    sample = stored(docs.where(~F.col("held_out")).join(F.broadcast(labels), "doc_id").select("text", "label"), "toxic-sample")
    weights, intercept = train(sample)
    return scored(docs, weights, intercept).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
