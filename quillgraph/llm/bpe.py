"""BPE encoding and decoding through a table of distinct words.

Texts are split at white space into words (the tokenizer's pre-tokenizer never joins
text across white space, so words encode independently). Each block of documents keeps
its words as positions into the block's own word list; the word lists, dealt by word
hash, meet in a table where every distinct word is encoded once; the ids go back to the
block and are placed by position. Decoding maps each id to its piece through the
vocabulary (at most ``MAX_VOCAB`` entries, checked) and joins pieces as the tokenizer does.

Rows: a block holds ``BLOCK_WORDS`` word occurrences (or one document that is longer), a
word list is split over ``buckets`` hash buckets, so every row and group has a bound that
does not depend on the corpus, and no word's frequency makes a hot key: a word occurs once
per block.

Defined results: null and empty texts have no ids and the empty decoded text; repeated
rows are each returned; an empty table gives an empty result; columns other than the id
and the text are not read.
"""

from __future__ import annotations

import json
import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded_batches, lean, partitions, raw, read

#: Word occurrences in a block.
BLOCK_WORDS = 500_000
#: Words of one bucket whose ids a task keeps; beyond it the table starts anew.
TABLE_WORDS = 500_000
#: Bound on the vocabulary that decoding sends to every task.
MAX_VOCAB = 1_000_000
#: Words encoded in one call.
BATCH = 4_000
#: Ids and texts in a batch that goes out, about.
OUT_BYTES = 2 << 20

_open: dict[str, object] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    """The tokenizer of ``path`` in this process, without truncation or padding."""
    if path not in _open:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _open[path] = t
    return _open[path]


def decodes_by_space(path: str) -> None:
    """Raise unless decoding joins pieces by one space and words encode independently."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    split = json.dumps(j["pre_tokenizer"])
    if j.get("decoder") is not None or j.get("post_processor") is not None or "\\\\s" not in split or '"Split"' not in split:
        raise ValueError("this operator needs a tokenizer that splits at white space and has no decoder or post-processor")
    if len(j["model"]["vocab"]) + len(j["added_tokens"]) > MAX_VOCAB:
        raise ValueError("the vocabulary is larger than MAX_VOCAB")


def _pack(a: np.ndarray) -> bytes:
    """Non-negative integers as byte planes under zstd."""
    a = a.astype("<u4")
    return zstandard.compress(a.view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


LISTS = "block string, bucket int, body binary, docs binary"


def _blocks(buckets: int, block_words: int, lists: bool):
    """mapInArrow function: rows of word lists by bucket, or else of positions (bucket -1).

    A block is named by its content, so both kinds agree although each is made on its own.
    """

    def flush(ids: list, parts: list[np.ndarray], order: list[bytes]) -> pa.RecordBatch:
        seen = np.concatenate(parts)
        bucket = (np.fromiter(map(xxhash.xxh3_64_intdigest, order), np.uint64, len(order)) % np.uint64(buckets)).astype(np.int64)
        # Words stand by bucket, in a bucket by frequency. A word's position is its rank in the
        # bucket times the buckets plus the bucket: small for frequent words, so it compresses well.
        rank = np.lexsort((-np.bincount(seen, minlength=len(order)), bucket))
        cuts = np.searchsorted(bucket[rank], np.arange(buckets + 1))
        place = np.empty(len(order), np.uint32)
        place[rank] = (np.arange(len(order)) - cuts[bucket[rank]]) * buckets + bucket[rank]
        docs = np.array([[0 if i is None else i, i is None, len(p)] for i, p in zip(ids, parts, strict=True)], np.int64).tobytes()
        name = xxhash.xxh3_128_hexdigest(seen.tobytes() + docs + b"\n".join(order))
        rows = [] if lists else [(name, -1, _pack(place[seen]), docs)]
        for b in np.flatnonzero(np.diff(cuts)).tolist() if lists else ():
            rows.append((name, b, zstandard.compress(b"\n".join([order[k] for k in rank[cuts[b] : cuts[b + 1]].tolist()]), 3), None))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.binary(), pa.binary()))],
            ["block", "bucket", "body", "docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, total = [], [], 0

        def table() -> defaultdict:
            return defaultdict(count().__next__)

        at = table()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = raw(text.as_py()).split()
                if total and total + len(words) > block_words:
                    yield flush(ids, parts, list(at))
                    ids, parts, total, at = [], [], 0, table()
                ids.append(i)
                parts.append(np.fromiter(map(at.__getitem__, words), np.uint32, len(words)))
                total += len(words)
        if ids:
            yield flush(ids, parts, list(at))

    return lean(run)


def _encoded(path: str):
    """mapInArrow function over word lists in order of buckets: each becomes its id counts and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, table, now = tokenizer(path), {}, None
        for batch in batches:
            out = []
            for bucket, body in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != now:  # words of another bucket are other words
                    now = bucket
                    table.clear()
                words = zstandard.decompress(body.as_buffer()).split(b"\n")
                fresh = [w for w in words if w not in table]
                if len(table) + len(fresh) > TABLE_WORDS:
                    table.clear()
                    fresh = words
                for k in range(0, len(fresh), BATCH):
                    part = fresh[k : k + BATCH]
                    texts = [w.decode("utf-8", "replace") for w in part]
                    for w, e in zip(part, t.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                        table[w] = np.array(e.ids, "<u4").tobytes()
                got = [table[w] for w in words]
                n = np.fromiter(map(len, got), np.uint32, len(got)) // 4
                out.append(len(got).to_bytes(8, "little") + _pack(np.concatenate([n, np.frombuffer(b"".join(got), "<u4")])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), batch.column(3)], ["block", "bucket", "body", "docs"])

    return lean(run)


def _block(found: list[tuple], pieces: list[str], buckets: int) -> Iterator[pa.RecordBatch]:
    """One block's rows (bucket, body, docs): ids placed by position, then decoded."""
    twins = sum(b < 0 for b, _, _ in found)  # equal blocks of different partitions share name and lists
    rows = sorted({r[0]: r for r in found}.values(), key=lambda r: r[0])
    if not twins:
        raise RuntimeError("the input's row order changed between two reads: store it before encoding")
    counts, ids, first = [], [], np.zeros(buckets, np.int64)
    total = 0
    for b, body, _ in rows[1:]:
        k, both = int.from_bytes(body[:8], "little"), _unpack(body[8:])
        counts.append(both[:k])
        ids.append(both[k:])
        first[b] = total
        total += k
    n = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    start = np.concatenate([[0], np.cumsum(n)])
    text = [" ".join([pieces[i] for i in flat[a:b].tolist()]) for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
    place = _unpack(rows[0][1]).astype(np.int64)
    place = first[place % buckets] + place // buckets
    if len(place) and (place.max() >= len(n) or len(np.unique(place)) != len(n)):
        raise RuntimeError("the input's row order changed between two reads: store it before encoding")
    docs = np.frombuffer(rows[0][2], np.int64).reshape(-1, 3).tolist()
    for _ in range(twins):
        own, out_ids, out_text, size, at = [], [], [], 0, 0
        for k, (i, null, words) in enumerate(docs):
            p = place[at : at + words]
            at += words
            m = n[p]
            # Ragged gather: the ids of every word, word after word.
            where = np.repeat(start[:-1][p] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum()) if words else np.zeros(0, np.int64)
            own.append(None if null else i)
            out_ids.append(flat[where].astype("<u4").tobytes())
            out_text.append(" ".join([x for x in map(text.__getitem__, p.tolist()) if x]))
            size += len(out_ids[-1]) + len(out_text[-1])
            if size >= OUT_BYTES or k + 1 == len(docs):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array([len(x) // 4 for x in out_ids], pa.int64()), pa.array(out_ids, pa.binary()), pa.array(out_text, pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )
                own, out_ids, out_text, size = [], [], [], 0


def _placed(pieces: list[str], buckets: int):
    """mapInArrow function over rows in order of blocks: the documents of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []
        for batch in batches:
            for name, *row in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if name != now:
                    if found:
                        yield from _block(found, pieces, buckets)
                    now, found = name, []
                found.append(tuple(row))
        if found:
            yield from _block(found, pieces, buckets)

    return lean(run)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded text.

    ``docs`` is read twice and has to give its rows in one order, as tables do; a difference
    is noticed and stops the run.
    """
    path = path or tokenizer_path()
    decodes_by_space(path)
    bounded_batches(docs.sparkSession)
    t = tokenizer(path)
    pieces = [t.id_to_token(i) or "" for i in range(max(t.get_vocab(with_added_tokens=True).values()) + 1)]
    buckets = min(4096, 4 * partitions(docs.sparkSession))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lists = slim.mapInArrow(_blocks(buckets, block_words, True), LISTS)
    dealt = lists.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    ids = dealt.mapInArrow(_encoded(path), LISTS)
    both = slim.mapInArrow(_blocks(buckets, block_words, False), LISTS).unionByName(ids)
    line = both.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block")
    return line.mapInArrow(_placed(pieces, buckets), "doc_id long, n_tokens long, ids binary, decoded string")


def op3_bpe(spark, sf_dir):
    out = encode(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
