"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow trees, each grown on a bootstrap of the training rows and a subset of the
statistics, give their root-to-node paths as conjunctive rules. A logistic regression
with an L1 penalty picks and weighs the rules; the ones left are compiled into one Spark
column expression over the statistics, which scores every row without Python.

Training uses at most about ``TRAIN_ROWS`` labelled rows, chosen by a hash of the id (all
of them if there are fewer). Without labels of both kinds the score is the share of label
1, or 0.5 without any.

Defined results: null and empty texts are scored from zero statistics; texts of any length
are measured whole; equal texts and repeated rows get equal scores; null labels are not learned
from, and of an id with several labels each counts; a null id is held in or out as the empty text
is; an empty table gives an empty result; other columns of the table are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded_batches, crc_mod, read, stored
from quillgraph.llm.textstats import COUNTS, RATIOS, stats

FEATURES = ["n_words", *RATIOS]
TRAIN_ROWS = 20_000
TREES, DEPTH, CUTS, LEAST_LEAF = 40, 3, 24, 10
PENALTY, STEPS = 2e-3, 400
THRESHOLD = 0.3

Rule = tuple[tuple[int, bool, float], ...]  # conditions: feature, is above, cut


def _grow(x: np.ndarray, y: np.ndarray, depth: int, features: np.ndarray, path: Rule, out: set[Rule]) -> None:
    if path:
        out.add(tuple(sorted(path)))
    n, p = len(y), y.mean() if len(y) else 0.0
    if depth == 0 or n < 2 * LEAST_LEAF or p in (0.0, 1.0):
        return
    best = (1e-9, 0, 0.0)
    whole = p * (1 - p)
    for j in features:
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, CUTS), method="lower")):
            left = x[:, j] <= cut
            k = int(left.sum())
            if k < LEAST_LEAF or n - k < LEAST_LEAF:
                continue
            a, b = y[left].mean(), y[~left].mean()
            gain = whole - (k * a * (1 - a) + (n - k) * b * (1 - b)) / n
            if gain > best[0]:
                best = (gain, int(j), float(cut))
    if best[0] <= 1e-9:
        return
    _, j, cut = best
    left = x[:, j] <= cut
    _grow(x[left], y[left], depth - 1, features, (*path, (j, False, cut)), out)
    _grow(x[~left], y[~left], depth - 1, features, (*path, (j, True, cut)), out)


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, above, cut in rule:
        ok &= (x[:, j] > cut) == above
    return ok


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return float(np.log(p / (1 - p))), []
    rng = np.random.default_rng(seed)
    rules: set[Rule] = set()
    for _ in range(TREES):
        rows = rng.integers(0, len(y), min(len(y), 4000))
        features = rng.choice(x.shape[1], max(4, x.shape[1] // 2), replace=False)
        _grow(x[rows], y[rows], DEPTH, features, (), rules)
    listed = sorted(rules)
    z = np.stack([_holds(r, x) for r in listed], axis=1).astype(np.float64)
    # Rules that hold for the same rows are one rule.
    _, first = np.unique(z, axis=1, return_index=True)
    listed, z = [listed[k] for k in sorted(first)], z[:, sorted(first)]
    mean, sd = z.mean(0), np.maximum(z.std(0), 0.02)
    z = (z - mean) / sd
    w, b = np.zeros(z.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    v, t, last = w.copy(), 1.0, w.copy()
    for _ in range(STEPS):  # accelerated proximal gradient
        r = 1 / (1 + np.exp(-(z @ v + b))) - y
        w = v - step * (z.T @ r) / len(y)
        w = np.sign(w) * np.maximum(np.abs(w) - step * PENALTY, 0)
        b -= step * r.mean()
        t, t0 = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, last = w + (t0 - 1) / t * (w - last), w
    w = w / sd
    return b - float(mean @ w), [(r, float(k)) for r, k in zip(listed, w, strict=True) if abs(k) > 1e-6]


def compiled(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The score as a column expression over the statistics."""
    total = F.lit(intercept)
    for rule, weight in rules:
        ok = F.lit(True)
        for j, above, cut in rule:
            c = F.col(FEATURES[j])
            ok = ok & ((c > cut) if above else (c <= cut))
        total = total + F.when(ok, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def sampled_labels(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id and the label as 0 or 1, about ``rows`` rows at most, by a hash of the id."""
    labels = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    share = rows / max(1, labels.count())
    return labels if share >= 1 else labels.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))


def op2_quality_model(spark, sf_dir):
    bounded_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", stats(F.col("text")).alias("s")).select("doc_id", "s.*")
    rows = stored(docs, "stats").withColumn("held_out", crc_mod("doc_id", 5) == 0)
    labels = sampled_labels(read(spark, sf_dir, "labels"), "quality", TRAIN_ROWS)
    # At most about TRAIN_ROWS rows of numbers.
    train = rows.where(~F.col("held_out")).join(labels, "doc_id").select(*FEATURES, "label").toPandas()
    train = train.sort_values([*FEATURES, "label"])
    intercept, rules = fit(train[FEATURES].to_numpy(np.float64), train["label"].to_numpy(np.float64))
    return rows.withColumn("score", compiled(intercept, rules)).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


__all__ = ["COUNTS", "FEATURES", "compiled", "fit", "op2_quality_model", "sampled_labels"]
