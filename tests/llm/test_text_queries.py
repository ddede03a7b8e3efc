"""Every registered query on odd and on empty tables, and those that nothing else calls."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import bpe, pii, toxicity
from quillgraph.llm.common import crc_mod_py, read, stored
from quillgraph.llm.queries import QUERIES
from test_text_ops import brute_spans

PROSE = " ".join(f"{w}{k}" for k in range(9) for w in "day people town and of work. house water street".split())
DOCUMENTS = [
    (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 4), (4, PROSE, "en", "a", 9), (4, PROSE, "en", "a", 9), (5, PROSE, "de", None, 9),
    (None, PROSE + "more", "en", "a", 9), (None, None, None, None, None), (6, "word " * 60_000, "en", "b", 9), (7, "x" * 200_000, "en", "b", 9),
    (8, "mail ann@site.org, 10.0.0.1, 4111 1111 1111 1111 or +1 (212) 555-0182 " + PROSE, "en", "b", 9), (9, "A |#$%" * 40, "\u4e2d", "b", 9), (10, "\u4f60\u597d " * 80, "\u4e2d", "b", 9),
]
LABELS = [(4, 1, 0), (5, 1, 1), (6, 0, None), (7, None, 1), (None, 1, 1), (8, 1, 0)]
PAGES = [(1, None, None), (2, "u", ""), (2, "u", "<article><p>x</p></article>"), (None, "v", "<p>" + "y " * 60_000)]
VECTORS = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, None), (1, [0.0, 0.0]), (2, [3.0, 4.0]), (None, [1.0, 1.0]), (100, [None, 1.0])]
TABLES = {
    "documents": (DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long"),
    "labels": (LABELS, "doc_id long, quality int, toxic int"),
    "benchmark": ([(1, PROSE), (2, None), (3, "")], "item_id long, text string"),
    "pages": (PAGES, "page_id long, url string, html string"),
    "embeddings": (VECTORS, "vec_id long, embedding array<float>"),
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    for name, (rows, schema) in TABLES.items():
        df = spark.createDataFrame(rows, schema)
        for kind, x in (("odd", df.coalesce(2)), ("empty", df.limit(0)), ("unlabelled", df.limit(0) if name == "labels" else df.coalesce(2))):
            x.write.parquet(f"file://{top}/{kind}/{name}.parquet")
    return f"file://{top}"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_empty_tables(name, spark, folders):
    for kind in ("odd", "unlabelled") if name.startswith(("op2", "op9")) else ("odd",):
        rows = QUERIES[name](spark, f"{folders}/{kind}").collect()
        if name.startswith("op11"):  # no term is in 30 documents: pairs only, all equal
            sources = {(d[2] or "", d[3] or "") for d in DOCUMENTS}
            pairs = {(x, a, "pair", b, 0) for x, a in sources for y, b in sources if x == y and a != b}
            assert {tuple(r)[:5] for r in rows} == pairs and len(rows) == len(pairs)
        elif name.startswith("op7"):
            assert [tuple(r)[:3] for r in rows] == [(0, 1, 2)] and abs(rows[0].score - 0.6) < 1e-7
        else:
            table, key = ("pages", "page_id") if name.startswith("op1_") else ("documents", "doc_id")
            assert Counter(r[key] for r in rows) == Counter(r[0] for r in TABLES[table][0])
    out = QUERIES[name](spark, f"{folders}/empty")
    assert out.count() == 0 and out.columns


def test_pipeline_on_odd_and_empty_tables(spark, folders):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, f"{folders}/odd").collect()
    assert {r.doc_id for r in out} <= {4, 5, 8, 10, None} and out
    assert corpus_pipeline.run(spark, f"{folders}/empty").count() == 0


def test_stages_against_brute_force(spark, sf):
    import corpus_pipeline

    docs = read(spark, sf, "documents")
    names, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "pii", "mixing", "bpe"]
    step = lambda name, df: stored(stages[name](spark, df, sf), f"test-{name}")
    given = {r.doc_id: tuple(r) for r in docs.collect()}
    # Quality: the rows that the query keeps, as they were.
    good = step("quality", docs)
    kept = {r.doc_id for r in QUERIES["op6_quality_rules"](spark, sf).collect() if r.kept}
    assert good.columns == names and {tuple(r) for r in good.collect()} == {given[i] for i in kept} and len(kept) > 100
    # Near-dedup: one row, of the least id, of each component of all pairs at 0.8 or more on five-word shingles.
    one = step("near_dedup", good)
    sets = {i: plain_shingles(given[i][names.index("text")], 5) for i in kept}
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(kept)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    firsts = {i for i in kept if not sets[i] or find(i) == i}
    assert one.columns == names and {tuple(r) for r in one.collect()} == {given[i] for i in firsts} and len(firsts) < len(kept)
    # Personal data: what stands outside the query's spans stays, and nothing that the base patterns know.
    masked = {r.doc_id: r for r in step("pii", one).collect()}
    spans = {r.doc_id: r.spans for r in QUERIES["op4_pii"](spark, sf).collect()}
    touched = 0
    for i in firsts:
        text, r = given[i][names.index("text")], masked[i]
        listed = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans[i].split(",") if x))
        outside, at = [], 0
        for a, b, _ in listed:
            outside.append(text[at : max(at, a)])
            at = max(at, b)
        outside.append(text[at:])
        pattern = r"(?:\[[A-Za-z_]+\])*".join(re.escape(x) for x in outside)
        assert re.fullmatch(pattern, r.text, re.S) and r.n_chars == len(r.text) and not brute_spans(r.text)
        assert tuple(r[c] for c in names if c not in ("text", "n_chars")) == tuple(v for c, v in zip(names, given[i], strict=True) if c not in ("text", "n_chars"))
        touched += bool(listed)
    assert set(masked) == firsts and touched > 5
    # Mixing: only whole rows, none more than three times, words near the targets of their sources.
    mixed = step("mixing", spark.createDataFrame(list(masked.values()), docs.schema))
    rows = [tuple(r) for r in mixed.collect()]
    n = Counter(r[0] for r in rows)
    assert mixed.columns == names and {r for r in rows} <= {tuple(r) for r in masked.values()} and max(n.values()) <= 3
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in masked.items()}
    own = {s: sum(size[i] for i, r in masked.items() if r.source == s) for s in {r.source for r in masked.values()}}
    goal, open_ = {}, dict.fromkeys(own)
    for k, s in enumerate(sorted(own)):
        open_[s] = k % 3 + 1
    left = sum(own.values())
    while open_:
        total = sum(open_.values())
        over = [s for s, w in open_.items() if left * w / total > 3 * own[s]]
        if not over:
            goal |= {s: left * w / total for s, w in open_.items()}
            break
        for s in over:
            goal[s] = 3 * own[s]
            del open_[s]
        left = sum(own.values()) - sum(goal.values())
    for s in own:
        taken = sum(n[i] * size[i] for i, r in masked.items() if r.source == s)
        assert abs(taken - goal[s]) <= max(size[i] for i, r in masked.items() if r.source == s)
    # BPE: every copy's ids and text as the library has them.
    t = bpe.tokenizer(bpe.tokenizer_path())
    want = Counter()
    for i, k in n.items():
        found = t.encode(masked[i].text, add_special_tokens=False).ids
        decoded = t.decode(found, skip_special_tokens=False)
        want[i, len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += k
    assert Counter(tuple(r) for r in step("bpe", mixed).collect()) == want


def plain_shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def test_personal_data_query(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op4_pii"](spark, sf.replace("0.001", "0.01")).collect()}
    docs = read(spark, sf.replace("0.001", "0.01"), "documents").collect()
    order = {k: i for i, k in enumerate(pii.KINDS)}
    some = 0
    for d in docs:
        r, base = got[d.doc_id], sorted(brute_spans(d.text or ""), key=lambda s: (order[s[0]], s[1], s[2]))
        n = Counter(k for k, *_ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in pii.BASE)
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(listed) <= set(every) and r.n_spans == len(every) and r.n_secret == sum(x.startswith("secret") for x in every)
        keys = [(order[k], int(a), int(b)) for k, a, b in (x.split(":") for x in every)]
        assert keys == sorted(keys)
        some += r.n_secret
    assert some > 5


def test_bpe_query(spark, sf):
    t = bpe.tokenizer(bpe.tokenizer_path())
    got = {r.doc_id: r for r in QUERIES["op3_bpe"](spark, sf).collect()}
    for d in read(spark, sf, "documents").collect():
        ids = t.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_toxicity_on_held_out_rows(spark, sf):
    d = sf.replace("0.001", "0.1")
    rows = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, d).collect()}
    assert all(r.held_out == (crc_mod_py(i, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.THRESHOLD) for i, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.toxic) for r in read(spark, d, "labels").collect() if rows[r.doc_id].held_out]
    caught = np.mean([p for p, t in held if t == 1])
    false = np.mean([p for p, t in held if t == 0])
    assert len(held) > 900 and caught > 0.8 and false < 0.02, (caught, false)


def test_ngrams_are_of_characters():
    one, other = toxicity.grams("\u4f60\u597d\u4e16\u754c\u5417"), toxicity.grams("\u4f60\u597d\u4e16\u754c\u554a")
    assert len(one) == 3 + 1 == len(other)  # with the blanks around: seven code points
    assert len(set(one) & set(other)) == 1
