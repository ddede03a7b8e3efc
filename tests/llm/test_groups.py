"""Near duplicates, components, mixing, neighbours and the pipeline against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import mixing, near_dedup, neighbours
from quillgraph.llm.common import read
from quillgraph.llm.components import components


def roots(edges, nodes):
    up = {n: n for n in nodes}

    def f(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a == b:
            continue
        x, y = sorted((f(a), f(b)))
        up[y] = x
    return {n: f(n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(1, 1), (2, 3), (3, 2)]])
def test_components(edges, spark):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    want = roots(edges, nodes)
    assert len(set(got.values())) == len(set(want.values())) == len({(got[n], want[n]) for n in nodes})


def brute_groups(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    links = set()
    for i, s in sets.items():
        n = Counter(j for x in s for j in by[x] if j > i)
        links |= {(i, j) for j, k in n.items() if 100 * k >= percent * (len(s) + len(sets[j]) - k)}
    return sets, roots(sorted(links), sets)


def test_near_duplicates(spark, sf):
    docs = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    for k in range(60):  # a group of near copies, each a few words from the first
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"v{k}"
        docs.append((50_000 + k, " ".join(w)))
    docs += [(60_000, None), (60_001, ""), (60_002, "two words"), (60_003, "Two  WORDS"), (60_004, "x"), (60_005, "É x"), (60_006, "é x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for size, percent in ((3, 85), (5, 80)):
        sets, want = brute_groups(docs, size, percent)
        rows = near_dedup.near_duplicates(df, size, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(sets[i]), want[i]) for i in sets}
        assert sum(r.is_first for r in rows) == len(set(want.values()))
    # All columns come back as they were, whatever their names.
    more = df.selectExpr("*", "doc_id + 1 as rid", "doc_id + 2 as h", "doc_id + 3 as row", "'k' as _keep", "map('a', doc_id) as m")
    kept = near_dedup.apply(more)
    assert kept.columns == more.columns
    for r in kept.collect():
        assert (r.rid, r.h, r["row"], r["_keep"], r.m) == (r.doc_id + 1, r.doc_id + 2, r.doc_id + 3, "k", {"a": r.doc_id})


def test_links_inside_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REACH", 2)
    common = [f"c{k}" for k in range(170)]
    docs = []
    for k in range(200):  # all are about 0.82 alike, every fifth and the one after it more
        own = [f"p{k // 5}x{j}" if k % 5 < 2 and j < 8 else f"o{k}x{j}" for j in range(19 + k % 3)]
        docs.append((k, " ".join(common + own)))
    docs += [(1000 + k, " ".join(common[:80] + ["same", f"z{k}"])) for k in range(60)]  # copies that fill windows
    sets, want = brute_groups(docs, 1, 85)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # blocks of several parts
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 1, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) == 161


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (None, "a b"), (3, ""), (3, "a b"), (3, "a b"), (4, "A b"), (5, "x")], "doc_id long, text string")
    kept = near_dedup.apply(df).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, None), (3, ""), (3, "a b"), (5, "x")])
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    many = spark.createDataFrame([(1, "the same words again", k) for k in range(300)] + [(2, "x " * 60_000, 0)], "doc_id long, text string, extra int").repartition(6)
    again = [sorted(map(tuple, near_dedup.apply(x).collect())) for x in (many, many.repartition(3))]
    assert again[0] == again[1] and [r[0] for r in again[0]] == [1, 2]


def test_query_of_near_duplicates(spark, sf):
    docs = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    sets, want = brute_groups(docs, 3, 85)
    got = near_dedup.op10_near_dedup(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted((i, len(sets[i]), want[i], want[i] == i) for i in sets)


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}


def test_texts_without_a_near_one_stay_where_they_are(spark):
    rng = random.Random(8)
    docs = [(k, " ".join(f"{rng.getrandbits(64):x}" for _ in range(400))) for k in range(300)]
    docs += [(1000 + k, docs[k][1] + " more") for k in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).localCheckpoint()
    before = shuffled(spark)
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")  # as for tables too large to be broadcast
    try:
        got = near_dedup.near_duplicates(df, 3, 85).collect()
    finally:
        spark.conf.unset(key)
    assert {r.doc_id: r.component_id for r in got} == {k: k % 1000 for k, _ in docs}
    moved = sum(v for k, v in shuffled(spark).items() if k not in before)
    assert moved < 0.3 * sum(len(t) for _, t in docs), moved


def test_filter_ahead_of_a_join(spark, monkeypatch):
    rows, keys = spark.range(20_000).withColumn("v", F.lit("x")), spark.range(0, 20_000, 20)
    for words, most in ((1 << 20, 2000), (8, 20_000)):  # too few words: more rows, none lost
        monkeypatch.setattr(near_dedup, "WORDS", words)
        got = [r.id for r in near_dedup.among(rows, keys, "id").collect()]
        assert set(range(0, 20_000, 20)) <= set(got) and len(got) == len(set(got)) <= most
    assert near_dedup.among(rows, keys.limit(0), "id").count() == 0


def test_hypergeometric_is_exact(spark):
    n, total, good, drawn = 4000, 30, 12, 9
    k = mixing.hypergeometric(F.lit(total).cast("long"), F.lit(good).cast("long"), F.lit(drawn).cast("long"), (F.col("id") + 0.5) / n)
    got = {r.k: r["count"] for r in spark.range(n).select(k.alias("k")).groupBy("k").count().collect()}
    for x in range(drawn + 1):
        p = comb(good, x) * comb(total - good, drawn - x) / comb(total, drawn)
        assert abs(got.get(x, 0) - n * p) <= 1.01


@pytest.mark.parametrize("depth", [3, 9])
def test_tree_splits_quotas_exactly(depth, spark):
    quota = [7, 0, 1000, 13]
    rows = mixing.split_quotas(spark.createDataFrame([(quota,)], "quota array<long>"), depth).collect()
    assert [sum(r.quota[i] for r in rows) for i in range(4)] == quota
    sizes = [sum(r.quota) for r in rows]
    assert sorted(r.shard for r in rows) == list(range(1 << depth)) and max(sizes) - min(sizes) <= 1 and min(min(r.quota) for r in rows) >= 0


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, out, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / w for s in open_}
        out |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return out


def test_mixing(spark, sf):
    rows = mixing.op8_mixing(spark, sf).collect()
    source = {r.doc_id: r.source for r in read(spark, sf, "documents").collect()}
    by, most, took = Counter(), Counter(), Counter()
    for r in rows:
        s = source[r.doc_id]
        by[s] += r["size"]
        took[s] += r.taken
        most[s] = max(most[s], r["size"])
        assert r.taken == r["size"] * len(r.places) <= 3 * r["size"]
        assert [p.copy for p in r.places] == list(range(1, len(r.places) + 1))
    want = brute_targets(by)
    for r in rows:
        assert r.source_size == by[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
    assert all(0 <= want[s] - took[s] <= most[s] for s in by)
    # Positions of a shard are 0, 1, 2, ...; no two documents share one.
    shards = defaultdict(list)
    for r in rows:
        for p in r.places:
            shards[p.shard].append(p.position)
    assert all(sorted(x) == list(range(len(x))) for x in shards.values()) and len(shards) > 8
    again = mixing.op8_mixing(spark, sf).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_shards_get_the_quotas_of_the_tree(spark, sf):
    docs = read(spark, sf.replace("0.001", "0.01"), "documents")
    sizes = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    depth = 5
    _, items, _ = mixing.plan(sizes, depth)
    got = Counter((r.source, i.shard) for r in items.collect() for i in r["items"])
    sources = sorted({s for s, _ in got})
    quota = [sum(n for (x, _), n in got.items() if x == s) for s in sources]
    leaves = mixing.split_quotas(spark.createDataFrame([(quota,)], "quota array<long>"), depth).collect()
    assert {(s, r.shard): n for r in leaves for s, n in zip(sources, r.quota, strict=True) if n} == got


def test_repeated_rows_never_overshoot(spark):
    rows = [(7, "s", "x y z")] * 2 + [(8, "s", "p q")] + [(1, "a", "w " * 3)] + [(k, "hot", "a b c d e") for k in (20, 20, 20, 20, 21)] * 40 + [(None, "n", "q r")] * 30 + [(9, None, "t")] * 5
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = mixing.apply(df).collect()
    took, by, most = Counter(), Counter(), {}
    for i, s, t in rows:
        by[s] += len(t.split())
        most[s] = max(most.get(s, 0), len(t.split()))
    for r in got:
        took[r.source] += len(r.text.split())
    want = brute_targets(by)
    assert all(0 <= want[s] - took[s] < most[s] + 1e-9 for s in by), (want, took)
    copies, there = Counter(map(tuple, got)), Counter(rows)
    assert all(n <= 3 * there[r] for r, n in copies.items())


def test_mix_of_odd_rows(spark):
    names = "doc_id long, source string, text string, size int, rank int, tie string, row int, _source int"
    rows = [(1, None, None), (None, "a", "x y z"), (3, "a", ""), (3, "a", "q w e r t y"), (4, "b", "one")]
    df = spark.createDataFrame([(*r, 9, 8, "t", 7, 6) for r in rows], names)
    out = mixing.apply(df)
    assert out.columns == df.columns
    got = out.collect()
    n = Counter(r.doc_id for r in got)
    assert max(n.values()) <= 3 and 1 not in n and {tuple(r) for r in got} <= {(*r, 9, 8, "t", 7, 6) for r in rows}
    assert mixing.apply(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", ["0.001", "0.1"])
def test_neighbours(spark, sf, size):
    sf = sf.replace("0.001", size)
    e = read(spark, sf, "embeddings")
    t = neighbours.fitted(neighbours.usable(e), e.count(), 5)
    for table in range(neighbours.TABLES):  # buckets at every size
        x = np.array([r.embedding for r in e.collect()], float)
        assert len(np.unique(neighbours.hashed(x, table, t))) > 20
    got = defaultdict(list)
    for r in neighbours.op7_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    rows = e.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    norm = np.sqrt((x * x).sum(1))
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q] / (norm * norm[q])
        s[q] = -9
        best = ids[np.lexsort((ids, -s))[:5]]
        hit += len({v for v, _ in got[ids[q]]} & set(best))
        total += 5
        exact = dict(zip(ids.tolist(), s.tolist()))
        assert all(abs(exact[v] - y) < 1e-12 for v, y in got[ids[q]])
        assert [y for _, y in got[ids[q]]] == sorted((y for _, y in got[ids[q]]), reverse=True)
    assert hit / total >= 0.9


def share_met(x, asked, k=5):
    """How much of the rows queries meet, and their recall, by the operator's own hashing."""
    u = neighbours._unit(x)
    s = u[asked] @ u.T
    s[np.arange(len(asked)), asked] = -9
    near = np.argsort(-s, axis=1)[:, :k]
    t = neighbours.Tables(neighbours.hashes(len(x)), float(np.median(np.take_along_axis(s, near, 1)[:, k - 1])))
    met = np.zeros(s.shape, bool)
    for table in range(neighbours.TABLES):
        at = neighbours.hashed(x, table, t)
        for r, found in enumerate(neighbours.probes(x[asked], table, t)):
            met[r] |= True if found is None else np.isin(at, found)
    return met.mean(), np.take_along_axis(met, near, 1).mean()


@pytest.mark.parametrize("noise, most", [(0.5, 0.3), (50.0, 0.75)])
def test_a_larger_table_is_met_in_a_smaller_share(noise, most):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 32))[rng.integers(0, 800, 60_000)] + noise * rng.normal(size=(60_000, 32))
    shares = []
    for n in (5000, 17_000, 60_000):
        met, recall = share_met(x[:n], np.arange(100))
        shares.append(met)
        assert recall >= 0.9, (n, recall)
    assert shares[0] > shares[1] > shares[2] and shares[2] < most, shares


def test_queries_that_probes_do_not_serve_meet_all_rows(spark, monkeypatch):
    # Values of 24 borders spread the chance of neighbours this far over too many buckets.
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 40))
    monkeypatch.setattr(neighbours, "hashes", lambda n: 24)
    monkeypatch.setattr(neighbours, "BLOCK", 700)
    monkeypatch.setattr(neighbours, "fitted", lambda *a: neighbours.Tables(24, 0.1))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 300 = 0")).orderBy("query_id", "rank").collect():
        assert r.exhausted
        got[r.query_id].append(r.vec_id)
    u = neighbours._unit(x)
    for q in range(0, 3000, 300):
        s = u @ u[q]
        s[q] = -9
        assert got[q] == np.argsort(-s)[:5].tolist()


def test_an_id_of_several_vectors_is_one_query(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.9, 0.1]), (2, [0.2, 0.8]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id) for r in neighbours.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3)]


def test_recall_on_a_larger_table(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(15_000, 48)).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>").repartition(4)
    df.write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = defaultdict(dict)
    for r in neighbours.op7_neighbours(spark, f"file://{tmp_path}").collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, len(x), 50):
        s = u @ u[q]
        s[q] = -9
        hit += len({v for v, _ in got[q].values()} & set(np.argsort(-s)[:5].tolist()))
        assert sorted(got[q]) == [1, 2, 3, 4, 5] and all(abs(s[v] - y) < 1e-12 for v, y in got[q].values())
    assert hit >= 0.9 * 5 * 300


def test_neighbours_of_odd_rows(spark, monkeypatch):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 1.0]), (7, [1.0, 1.0, 1.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (4096, 2):  # buckets of any number of blocks
        monkeypatch.setattr(neighbours, "BLOCK", block)
        monkeypatch.setattr(neighbours, "HELD", 0 if block == 2 else 50_000)
        monkeypatch.setattr(neighbours, "PAIRS", 3 if block == 2 else 500_000)
        got = [tuple(r)[:4] for r in neighbours.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
        assert got == [(0, 1, 1, 1.0), (0, 2, 50, 1.0), (0, 3, 6, 0.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 6, 0.0)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_of_repeated_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(10)] * 2 + [(0, [1.0, 0.0])] * 6
    rows += [(20, [0.6, 0.8 + k / 1e6]) for k in range(30)] + [(20 + i, [0.6, 0.9]) for i in range(1, 4)] + [(90, [0.6, 0.8])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id in (0, 9, 90)")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[9] == [0, 1, 2, 3, 4]
    assert got[90] == [20, 21, 22, 23, 0]


def test_pipeline(spark, sf):
    """Every stage against a brute-force version on the rows that the stage before gave."""
    import corpus_pipeline
    from quillgraph.llm import bpe, pii, quality_rules
    from quillgraph.llm.common import stored

    docs = read(spark, sf, "documents")
    columns, rows = docs.columns, {"start": docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, sf), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        rows[name] = docs.collect()
    start, quality, dedup, masked, mix, tokens = rows.values()
    verdict = {r.doc_id: r.kept for r in quality_rules.op6_quality_rules(spark, sf).collect()}
    assert sorted(quality) == sorted(r for r in start if verdict[r.doc_id])
    sets, group = brute_groups([(r.doc_id, r.text) for r in quality], 5, 80)
    assert sorted(dedup) == sorted(r for r in quality if group[r.doc_id] == r.doc_id)
    text = {r.doc_id: r.text for r in masked}
    spans = pii._search([r.text for r in dedup], pii.trained())
    for r, (base, more) in zip(dedup, spans, strict=True):
        want, last = "", 0
        for kind, a, b in sorted(base + more, key=lambda x: x[1]):
            if b > last:
                want += r.text[last : max(last, a)] + (f"[{kind}]" if a >= last else "")
                last = b
        assert text[r.doc_id] == want + r.text[last:]
    assert [r.n_chars for r in masked] == [len(r.text) for r in masked]
    assert any(text[r.doc_id] != r.text for r in dedup)
    by, took, most = Counter(), Counter(), Counter()
    for r in masked:
        by[r.source] += len(r.text.split())
        most[r.source] = max(most[r.source], len(r.text.split()))
    for r in mix:
        took[r.source] += len(r.text.split())
    want = brute_targets(by)
    assert all(0 <= want[s] - took[s] <= most[s] for s in by)
    assert set(mix) <= set(masked) and max(Counter(r.doc_id for r in mix).values()) <= 3
    t = bpe.tokenizer(bpe.tokenizer_path())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {r.doc_id: t.encode(r.text, add_special_tokens=False).ids for r in masked}
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokens) == Counter(
        (r.doc_id, len(ids[r.doc_id]), sha(np.array(ids[r.doc_id], "<u4").tobytes()), sha(t.decode(ids[r.doc_id], skip_special_tokens=False).encode())) for r in mix
    )
