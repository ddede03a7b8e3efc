"""Divergence of sources, fingerprints and resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import divergence, fingerprints, resampling
from quillgraph.llm.common import read
from quillgraph.llm.queries import ORACLES, QUERIES

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def made_up(seed, n, words="the of And Über naïve cat DOG 你好 x1y _a' z".split()):
    rng = random.Random(seed)
    text = lambda: None if rng.random() < 0.05 else rng.choice([" ", "\n", "-", " ! "]).join(rng.choices(words, [9, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1][: len(words)], k=rng.randrange(0, 12)))
    rows = [(i, text(), rng.choice(["en", "de", "", None]), rng.choice(["a", "b", "c", "é", "", None, "zz"])) for i in range(n)]
    return [*rows, *rows[:9], (n, None, "fr", "lone"), (n + 1, "only here", "fr", "other"), (None, "the of", "en", "a")]


# -- divergence
@pytest.mark.parametrize(("block", "strip"), [(4096, 256), (3, 2), (1, 1)])
def test_divergence_against_sql(spark, block, strip):
    df = spark.createDataFrame(made_up(3, 400), "doc_id long, text string, lang string, source string").repartition(5)
    got = sorted(map(tuple, divergence.audit(df, block, strip).collect()))
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = sorted(con.sql(ORACLES["op11_divergence"]).fetchall())
    assert got == want and {r[2] for r in got} == {"pair", "term"} and len(got) > 100


def test_divergence_query_against_sql(spark, sf):
    d = sf.replace("0.001", "0.01")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert sorted(map(tuple, QUERIES["op11_divergence"](spark, d).collect())) == sorted(con.sql(ORACLES["op11_divergence"]).fetchall())


def test_shares_are_exact_beyond_64_bits():
    rng = random.Random(1)
    total = [1, 7, 10**6, 9 * 10**15] + [rng.randrange(1, 9 * 10**15) for _ in range(500)]
    count = [1, 7, 999_999, 9 * 10**15] + [rng.randrange(0, t + 1) for t in total[4:]]
    got = divergence.shares(np.array(count), np.array(total))
    assert got.tolist() == [1 + 10**9 * c // t for c, t in zip(count, total, strict=True)]


# -- fingerprints
def plain_hashes(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    out = set()
    for i in range(max(1, len(w) - 4)) if w else ():
        h = 42
        for x in w[i : i + 5]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        out.add(h >> 1)
    return out


def plain_sketch(hashes):
    low = {h for h in hashes if h < fingerprints.THRESHOLD}
    return sorted(low) if len(low) >= fingerprints.FLOOR else sorted(hashes)[: fingerprints.FLOOR]


def in_hex(hashes):
    return "".join(f"{h:016x}" for h in hashes)


def plain_likeness(a, b):
    def complete(s):
        if len(s) < fingerprints.FLOOR:
            return math.inf
        return s[-1] if len(s) == fingerprints.FLOOR and s[-1] >= fingerprints.THRESHOLD else fingerprints.THRESHOLD - 1

    most = min(complete(a), complete(b))
    x, y = {h for h in a if h <= most}, {h for h in b if h <= most}
    return 1.0 if not a and not b else len(x & y) / min(len(x), len(y)) if x and y else 0.0


def held_to_brute_force(rows, found):
    """Rows of doc_id and text against the query's; repeated rows are one document in the order."""
    rows = [(i, t or "") for i, t in rows]
    digest = lambda r: hashlib.sha256(r[1].encode()).hexdigest()
    ring = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, f"{'-' if r[0] is None else r[0]}:{digest(r)}"), reverse=True)
    want = {}
    for k, (i, t) in enumerate(ring):
        nxt, half = ring[(k + 1) % len(ring)][1], len(t) // 2
        edit = t[: len(t) - half] + nxt[:half]
        f, e, g = (plain_sketch(plain_hashes(x)) for x in (t, edit, nxt))
        want[i, t] = (i, len(t), digest((i, edit)), in_hex(f), in_hex(e), round(plain_likeness(f, e), 9), round(plain_likeness(f, g), 9))
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found)
    assert got == Counter(want[r] for r in rows)


def test_fingerprints_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    held_to_brute_force(docs, QUERIES["op12_fingerprints"](spark, sf).collect())


def test_fingerprints_of_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("the of And É 你好 x".split(), k=rng.randrange(0, 60)))) for i in range(60)]
    rows += [(3, "same id"), (3, "same id, other text"), (5, None), (6, ""), (7, " \n\t"), (None, "null id"), (None, "another null id"), (None, None)]
    rows += rows[:7] + [(70, "twice " * 9)] * 40 + [(71, "w%d " * 2), (72, "x" * 50_000), (73, "long " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit(1)).repartition(3)
    held_to_brute_force(rows, fingerprints.fingerprinted(df).collect())
    held_to_brute_force([(1, "alone it stands")], fingerprints.fingerprinted(spark.createDataFrame([(1, "alone it stands")], "doc_id long, text string")).collect())


def test_fingerprints_merge_and_contain(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choices(words, k=20_000))
    part = " ".join(long.split()[7000:9000])
    other = " ".join(rng.choices(words, k=2000))
    rows = [(long, part, 1.0), (long, other, 0.0), (part, part, 1.0), ("a b c", "a b c d", 0.0), ("", "", 1.0), ("", "a", 0.0), (long, " ".join(part.split()[:1000] + other.split()[:1000]), 0.5)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    df = fingerprints.sketched(fingerprints.sketched(df, "a", "x"), "b", "y")
    for r in df.select("*", fingerprints.merged(F.col("x"), F.col("y")).alias("m"), fingerprints.containment(F.col("x"), F.col("y")).alias("c"), fingerprints.resemblance(F.col("y"), F.col("y")).alias("same")).collect():
        assert r.m == plain_sketch(plain_hashes(r.a) | plain_hashes(r.b))
        assert abs(r.c - r.want) < 0.12 and r.same == 1.0


def test_fingerprints_run_no_python(spark, sf):
    text = QUERIES["op12_fingerprints"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|SinglePartition", text)


# -- resampling
def plain_features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(A_Z))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resampling(docs, target):
    own = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in plain_features(x)[1])
    all_s, all_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10000)]
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = order[: 5 * len(order) // 100]
    out = Counter((r[0], *r[2:], k + 1) for k, r in enumerate(drawn))
    rest = Counter(r for r in rows) - Counter(drawn)
    return out + Counter({(r[0], *r[2:], None): n for r, n in rest.items()})


def test_resampling_query(spark, sf):
    d = sf.replace("0.001", "0.01")
    docs = [(r.doc_id, r.text) for r in read(spark, d, "documents").collect()]
    target = [r.text for r in read(spark, d, "benchmark").collect()]
    got = Counter(tuple(r) for r in QUERIES["op13_resampling"](spark, d).collect())
    assert got == plain_resampling(docs, target) and sum(r[4] is not None for r in got) > 40


def test_resampling_of_odd_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["a", "B2", "É", "你好", "x" * 70, "y" * 200, "it's", "_"], k=rng.randrange(0, 50)))) for i in range(300)]
    rows += [(None, "null id " * 20), (400, None), (401, ""), (402, "\x00\x7f-"), *rows[:30], (403, "a " * 100_000), (404, "z" * 300_000)] + [(500, "again and " * 20)] * 200
    target = ["a B2 a", None, "", "again and again"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(4)
    for t in (target, []):
        got = Counter(tuple(r) for r in resampling.resampled(df, spark.createDataFrame([(x,) for x in t], "text string")).collect())
        assert got == plain_resampling(rows, t)


def test_crc_moves_over_any_length():
    hasher = resampling.Hasher()
    texts = [b"ab " + b"q" * n + b" " + b"r" * (3 * n + 1) + b" s" for n in (1, 2, 63, 64, 65, 128, 129, 500)]
    for t in texts:
        assert sorted(hasher([t])[1]) == sorted(plain_features(t.decode())[1])


def test_gains_need_no_rows(spark):
    empty = spark.createDataFrame([], "text string")
    assert not resampling.bucket_counts(empty).any()
    assert set(resampling.gains(np.zeros(10_000, np.int64), np.zeros(10_000, np.int64))) == {0.0}
