"""Target-distribution importance resampling over hashed word n-grams.

A text's features are its runs of 1 to NGRAM consecutive words; a feature's bucket is its
crc32 modulo BUCKETS. Two passes over Arrow batches: the first counts buckets with
``np.bincount`` into one vector a partition, and ``treeReduce`` adds the vectors of corpus and
target up, so the driver gets a few of BUCKETS numbers whatever the corpus; the second sends
the gains (BUCKETS numbers) to every task, gathers them by bucket and sums them by document
with weighted ``np.bincount``. Gumbel noise from a hash of the id makes the highest scores a
draw without replacement in proportion to the weights; the draw is ranked over all tasks by
ranges of the score.

The crc of a run is put together from those of its words: crc(a + b) is crc(a) moved on by
len(b) bytes, xor crc(b), and moving is linear, so a table for each length does it for arrays.

Defined results: null and empty texts have no features and weight 0; a null id is hashed as
the empty text, and comes last among ties; repeated rows are scored and ranked each; texts of
any length are read whole; without documents or without a target the sums are 0 and gains
follow from the formula; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded_batches, lean, read, stored
from quillgraph.operators.ordered import numbered

BUCKETS = 10_000
NGRAM = 3
MIN_WORDS, DRAWN_PERCENT, SEED = 20, 5, 42
#: Words remembered with their crc by a task, and the longest gap that tables move a crc over.
REMEMBERED, LONGEST = 100_000, 64
_BLANK = zlib.crc32(b" ")
#: A-Z become a-z, digits and what is beyond ASCII stay, all else parts words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _moves(longest: int) -> np.ndarray:
    """[length, byte, value]: what each byte of a crc becomes when ``length`` zero bytes follow."""
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    for j in range(4):
        out[0, j] = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
    # One zero byte: shift out eight bits and divide by the polynomial.
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    for n in range(1, longest + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ step[out[n - 1] & np.uint32(255)]
    return out


class Hasher:
    """Buckets of all features of texts."""

    def __init__(self) -> None:
        self.moves = _moves(LONGEST)
        self.ids: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self._known = [np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)]

    def _facts(self) -> list[np.ndarray]:
        """crc of each word, crc of a blank and the word, and the latter's length."""
        new = self.words[len(self._known[0]) :]
        if new:
            made = [
                np.fromiter(map(zlib.crc32, new), np.uint32, len(new)),
                np.fromiter((zlib.crc32(w, _BLANK) for w in new), np.uint32, len(new)),
                np.fromiter(map(len, new), np.int64, len(new)) + 1,
            ]
            self._known = [np.concatenate(x) for x in zip(self._known, made, strict=True)]
        return self._known

    def _then(self, crc: np.ndarray, word: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
        """The crc of runs with a blank and another word after them."""
        _, tail, length = known
        n = length[word]
        m = np.minimum(n, LONGEST)
        t = self.moves
        for _ in range(int(n.max() - 1) // LONGEST + 1 if len(n) else 0):  # once, but for very long words
            crc = t[m, 0, crc & 255] ^ t[m, 1, (crc >> 8) & 255] ^ t[m, 2, (crc >> 16) & 255] ^ t[m, 3, crc >> 24]
            n = n - m
            m = np.minimum(n, LONGEST)
        return crc ^ tail[word]

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; bucket and text of each feature."""
        words = [[] if t is None else t.translate(_WORD_BYTES).split() for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        if len(self.ids) > REMEMBERED:
            self.ids, self.words, self._known = {}, [], [x[:0] for x in self._known]
        for w in set(chain.from_iterable(words)):
            if w not in self.ids:
                self.ids[w] = len(self.words)
                self.words.append(w)
        word = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        text = np.repeat(np.arange(len(words)), n)
        known = self._facts()
        crc = known[0][word]
        buckets, owners = [crc % BUCKETS], [text]
        for k in range(1, NGRAM):
            # Runs that begin at a word and end k words on, where the text does not end before.
            crc = self._then(crc[: len(word) - k], word[k:], known) if len(word) > k else crc[:0]
            inside = text[: len(crc)] == text[len(text) - len(crc) :]
            buckets.append(crc[inside] % BUCKETS)
            owners.append(text[: len(crc)][inside])
        return n, np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def _slices(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list]]:
    """Texts in runs of about ``size`` bytes (a long one alone), with the place of the first."""
    texts = texts.cast(pa.binary()).to_pylist()
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held >= size:
            yield start, texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def _vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: the counts of its buckets."""
    total, hasher = np.zeros(BUCKETS, np.int64), Hasher()
    for batch in batches:
        for _, texts in _slices(batch.column(0)):
            total += np.bincount(hasher(texts)[1], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])


def bucket_counts(df: DataFrame) -> np.ndarray:
    """How many features of the column ``text`` fall into each bucket."""
    bounded_batches(df.sparkSession)
    parts = df.select(F.col("text").cast("string")).mapInArrow(lean(_vector), "counts binary").rdd
    tasks = parts.getNumPartitions()
    if not tasks:
        return np.zeros(BUCKETS, np.int64)
    vectors = parts.map(lambda r: np.frombuffer(r[0], np.int64))
    # Each level leaves the root of the number of vectors; the driver adds up some dozens.
    return vectors.treeReduce(lambda a, b: a + b, depth=2 if tasks <= 1000 else 3)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored thousandfold log ratio of target to corpus shares, each bucket counted once more."""
    all_s, all_t = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    ratio = lambda s, t: math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t)))
    return np.array([ratio(float(s), float(t)) for s, t in zip(corpus, target, strict=True)], np.float64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row; ``gain`` has BUCKETS numbers."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            n, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for start, texts in _slices(batch.column(1)):
                words, bucket, owner = hasher(texts)
                own = slice(start, start + len(texts))
                n[own] = words
                features[own] = np.bincount(owner, minlength=len(texts))
                # Sums of whole numbers far below 2 ** 53 are exact.
                weight[own] = np.bincount(owner, weights=sent.value[bucket], minlength=len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(weigh), "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, and the rank of those drawn.

    Of the rows with MIN_WORDS words or more, DRAWN_PERCENT in a hundred are drawn.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = weighed(docs, gain)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = stored(rows.withColumn("score", F.col("weight") + noise), "weights")
    able = F.col("n_words") >= MIN_WORDS
    drawn = rows.where(able).count() * DRAWN_PERCENT // 100
    ranked = numbered(rows.where(able), [F.desc("score"), F.asc_nulls_last("doc_id")], "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    out = ranked.withColumn("rank", rank).unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_resampling(spark, sf_dir):
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
