"""Cosine searches in bounded memory, with ties of equal vectors in order of ids."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.operators.relational import _of_blocks, similarity_top_k
from quillgraph.queries import ORACLES, QUERIES


def block(name, ids, vectors):
    return pa.table({name: pa.array(ids), "_v": pa.array(list(vectors.astype(float)), pa.list_(pa.float64())), "_block": pa.array([0] * len(ids), pa.int32())})


def test_a_block_takes_strips_of_memory():
    rng = np.random.default_rng(5)
    q, x = rng.normal(size=(2000, 8)), rng.normal(size=(6000, 8))
    tables = block("from_id", range(2000), q), block("to_id", range(6000), x)
    tracemalloc.start()
    out = _of_blocks(3)(*tables)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 6000 and peak < 90 << 20  # all cosines at once are 96 MB


def test_equal_vectors_tie_by_id():
    rng = np.random.default_rng(6)
    own = rng.normal(size=(97, 64))
    x = np.vstack([own] * 7)  # row i and i + 97 are equal
    out = _of_blocks(10)(block("from_id", [0, 50], x[[0, 50]]), block("to_id", range(len(x)), x)).to_pydict()
    for query in (0, 50):
        got = sorted((-s, t) for f, t, s in zip(out["from_id"], out["to_id"], out["score"], strict=True) if f == query)
        c = (own @ own[query]) / np.sqrt((own * own).sum(1)) / np.sqrt((own[query] ** 2).sum())
        ranked = [i + 97 * j for i in np.argsort(-c) for j in range(7) if i + 97 * j != query]
        assert [t for _, t in got] == ranked[:10]
        assert len({s for s, t in got if t % 97 == got[-1][1] % 97}) == 1


def test_zero_and_broken_vectors():
    x = np.array([[0.0, 0], [1, 0], [0, 2], [np.nan, 1], [0, 0]])
    out = _of_blocks(2)(block("from_id", [0, 1], x[:2]), block("to_id", range(5), x)).to_pydict()
    assert list(zip(out["from_id"], out["to_id"], out["score"], strict=True)) == [(0, 1, 0.0), (0, 2, 0.0), (1, 0, 0.0), (1, 2, 0.0)]


def test_every_row_is_a_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    got = QUERIES["cosine_topk"](spark, sf)
    assert got.select("from_id").distinct().count() == rows and got.count() == 10 * rows
    assert "%" not in ORACLES["cosine_topk"]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_all_rows_in_blocks(spark, kind):
    # Many equal vectors, an id that stands twice, opposite, zero and missing vectors, blocks of 7.
    rng = np.random.default_rng(8)
    own = np.vstack([rng.integers(-2, 3, size=(40, 4)), [[9, 9, 9, 9]] * 12, [[0, 0, 0, 0]] * 2, [[1, 1, 1, 1], [2, 2, 2, 2], [-1, -1, -1, -1]]]).astype(float)
    name = (lambda i: i) if kind == "long" else str
    rows = [(name(i), v.tolist()) for i, v in enumerate(own)] + [(name(3), own[45].tolist()), (name(91), None), (None, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, f"id {kind}, v array<float>").repartition(3)
    got = {}
    for r in similarity_top_k(df, df, "id", "v", 5, rows=7).collect():
        got.setdefault(r.from_id, {})[r["rank"]] = (r.to_id, r.score)
    fine = [(i, np.array(v)) for i, v in rows if i is not None and v is not None]

    def cosine(a, b):
        norm = np.sqrt((a @ a) * (b @ b))
        return min(1.0, max(-1.0, a @ b / norm)) if norm else 0.0

    for i in {i for i, _ in fine}:
        want = sorted(((-cosine(a, b), j) for x, a in fine if x == i for j, b in fine if j != i))[:5]
        assert [got[i][n + 1] for n in range(5)] == [(j, -s) for s, j in want]
    assert set(got) == {i for i, _ in fine}
