"""Quality, toxicity, personal data, BPE, token counts against brute force and held-out labels."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import bpe, pii, quality_model, quality_rules, token_counts, toxicity
from quillgraph.llm.common import crc_mod_py, read
from quillgraph.llm.textstats import COUNTS, RATIOS, one

TEXTS = [None, "", " \n\t ", "one", "a b c a b c a b c", "x\nx\n\nx", "#*$ %&|<>", "é\x85ü\xa0w", "w " * 3000, "A B! C!! d1 d2\r\nlast"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, "s") for i, t in enumerate(TEXTS)] + [(None, "null id text", None, None), (3, "one", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def brute_counts(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    cover = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_counts_of_texts(spark, sf):
    texts = TEXTS + [r.text for r in read(spark, sf, "documents").collect()]
    for t in texts:
        assert one(t)[:5] == brute_counts(t), t
        assert len(one(t)) == len(COUNTS) + len(RATIOS)


def test_quality_rules(spark, sf, odd):
    got = {r.doc_id: r for r in quality_rules.op6_quality_rules(spark, sf).collect()}
    for d in read(spark, sf, "documents").collect():
        n = brute_counts(d.text)
        r = got[d.doc_id]
        assert tuple(r[c] for c in COUNTS) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.apply(odd.limit(0)).count() == 0


def test_columns_of_any_name_keep_their_values(spark):
    names = ["s", "row", "lows", "highs", "_lang", "_source", "copy", "kept", "n_words", "score"]
    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice("some words of usual length and kind here. it is so".split()) + str(rng.randint(0, 40)) for _ in range(120))
    rows = [(i, prose() if i % 7 else "x" * i, "en", "a", *[i * 100 + k for k in range(len(names))]) for i in range(70)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string", *[f"{n} long" for n in names]]))
    out = quality_rules.apply(df)
    got = {tuple(r) for r in out.collect()}
    assert out.columns == df.columns and got <= set(rows) and {r[0] for r in got} == {r[0] for r in rows if r[0] % 7}
    scored = toxicity.scored(df, np.zeros(toxicity.BUCKETS), 0.0)
    assert scored.columns == df.columns and {tuple(r)[:-1] for r in scored.collect()} == {r[:-1] for r in rows}


def plain_statistics(t):
    """What the quality model looks at, counted one by one."""
    t = t or ""
    w, n = WORD.findall(t), brute_counts(t)
    if not w:
        return [0.0] * len(quality_model.FEATURES)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    some = lambda chars: sum(c in chars for c in t)
    upper, lower = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    wide = sum(len(c.encode()) for c in t if ord(c) > 127)
    marks = sum(33 <= ord(c) < 127 and not re.match("[A-Za-z0-9]", c) for c in t)
    return [
        n[0], n[2] / n[0], some("|") / n[0], some("!") / n[0], n[1] / n[0], upper / max(1, upper + lower), some("0123456789") / n[1], wide / len(t.encode()),
        n[3] / len(lines), n[4] / n[0], len(set(w)) / n[0], n[0] / len(lines), some(".!?") / n[0], max(len(x.encode()) for x in w), max(Counter(w).values()) / n[0], marks / n[0],
    ]


def test_quality_query_against_plain_rules(spark, sf):
    docs = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    facts = {i: plain_statistics(t) for i, t in docs.items()}
    for t in TEXTS:
        s = one(t)
        assert np.allclose([s[0], *s[len(COUNTS) :]], plain_statistics(t)), t
    train = [(*facts[r.doc_id], r.quality) for r in read(spark, sf, "labels").collect() if r.quality in (0, 1) and crc_mod_py(r.doc_id, 5)]
    train = np.array(sorted(train), float)
    intercept, rules = quality_model.fit(train[:, :-1], train[:, -1])
    assert rules
    for r in quality_model.op2_quality_model(spark, sf).collect():
        total = intercept
        for rule, weight in rules:
            if all((facts[r.doc_id][j] > cut) == above for j, above, cut in rule):
                total += weight
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9 and r.predicted == (r.score >= 0.3) and r.held_out == (crc_mod_py(r.doc_id, 5) == 0)


def plain_grams(t):
    """Buckets of 5- and 7-grams of characters, one by one."""
    text = " " + " ".join(x.decode("utf-8", "surrogatepass") for x in (t or "").lower().encode("utf-8", "surrogatepass").split()) + " "
    out = []
    for n in toxicity.NGRAMS:
        for i in range(len(text) - n + 1):
            h = n
            for c in text[i : i + n]:
                h = (h * 0xD6E8FEB86659FD93 + ord(c)) % (1 << 64)
            out.append((h * 0x9E3779B97F4A7C15 % (1 << 64)) >> 44)
    return out


def test_toxicity_query_against_plain_grams(spark, sf):
    d = sf.replace("0.001", "0.01")
    docs = {r.doc_id: r.text for r in read(spark, d, "documents").collect()}
    labels = {r.doc_id: r.toxic for r in read(spark, d, "labels").collect() if r.toxic in (0, 1) and crc_mod_py(r.doc_id, 4) != 2}
    for t in TEXTS:
        assert sorted(toxicity.grams(t).tolist()) == sorted(plain_grams(t)), t
    n, rows = {0: Counter(), 1: Counter()}, Counter(labels.values())
    grams = {i: set(plain_grams(t)) for i, t in docs.items()}
    for i, y in labels.items():
        n[y].update(grams[i])
    sample = spark.createDataFrame([(docs[i], y) for i, y in labels.items()], "text string, label int")
    weights, intercept = toxicity.train(sample)

    def clear(g):
        p = (n[0][g] + n[1][g] + 1) / (sum(rows.values()) + 2)
        return abs(n[1][g] / rows[1] - n[0][g] / rows[0]) / np.sqrt(p * (1 - p) * (1 / rows[0] + 1 / rows[1]))

    best = sorted((g for g in set(n[0]) | set(n[1]) if clear(g) > 3), key=lambda g: (-clear(g), g))[: toxicity.KEPT]
    assert set(np.flatnonzero(weights).tolist()) <= set(best) and len(best) > 20
    for r in toxicity.op9_toxicity(spark, d).collect():
        total = intercept + sum(weights[g] for g in grams[r.doc_id])
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(total, -500, 500)))) < 1e-9 and r.predicted == (r.score >= 0.3)


def test_rules_tell_junk_from_prose(spark, sf):
    d = sf.replace("0.001", "0.01")
    got = {r.doc_id: r for r in quality_rules.op6_quality_rules(spark, d).collect()}
    labels = {r.doc_id: r.quality for r in read(spark, d, "labels").collect()}
    fine = [r.kept for i, r in got.items() if labels.get(i) == 1 and not r.base_failed]
    junk = [r.kept for i, r in got.items() if labels.get(i) == 0 and not r.base_failed]
    assert np.mean(fine) > 0.99 and len(junk) > 10 and np.mean(junk) < 0.1


def test_spread_sets_the_fences(spark, sf):
    # In the corpus's large groups quartiles decide, not a rule's resolution or its language.
    rows = quality_rules.fences(quality_rules.sketches(quality_rules.measure(read(spark, sf.replace("0.001", "0.1"), "documents")), ["lang", "source"])).collect()
    large = [r for r in rows if r.n_rows >= quality_rules.LEAST]
    assert len(large) > 300 and np.mean([r.own for r in large]) > 0.95
    for rule in quality_rules.RULES:  # no constant could stand for them
        high = [r.high for r in large if r.rule == rule]
        assert max(high) > 1.1 * min(high), rule


def test_texts_of_few_words_are_below_the_lower_fence(spark):
    rng = random.Random(6)
    text = lambda kinds: " ".join(f"{rng.choice(['word', 'thing', 'house', 'Street.'])}{rng.randint(0, kinds)}" for _ in range(120))
    rows = [(i, text(60), "en", "a") for i in range(80)] + [(100, text(2), "en", "a")]
    stats_of = {i: dict(zip([*COUNTS, *RATIOS], one(t), strict=True)) for i, t, *_ in rows}
    assert stats_of[100]["n_repeat_words"] * 2 < 120 and stats_of[100]["distinct_share"] < 0.3
    got = {r.doc_id for r in quality_rules.apply(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == set(range(80))


def test_copies_do_not_reject_what_differs_from_them(spark):
    rng = random.Random(5)
    text = lambda k: " ".join(rng.choice(["some", "words", "of", "usual", "length", "and", "kind", "Here."]) + str(rng.randint(0, k)) for _ in range(120))
    copy = text(90)
    rows = [(i, copy, "en", "hot") for i in range(300)] + [(1000 + i, text(90), "en", "hot") for i in range(60)] + [(2000 + i, text(90), "en", "b") for i in range(60)]
    kept = quality_rules.apply(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert kept.count() >= 415


def test_fences_of_groups_decide(spark):
    rng = random.Random(2)
    text = lambda low, high: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(low, high))) for _ in range(80))
    rows = [(i, text(3, 7), "short", "s") for i in range(60)] + [(100 + i, text(7, 11), "long", "s") for i in range(60)]
    rows += [(200, text(7, 11), "short", "s"), (201, text(7, 11), "long", "s")]
    kept = {r.doc_id for r in quality_rules.apply(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert 200 not in kept and 201 in kept and len(kept) > 110  # the same kind of text: usual in one group only


def test_sketch_quantiles_have_bounded_error(spark):
    rng = random.Random(1)
    values = [rng.expovariate(1.0) for _ in range(4000)]
    names = list(quality_rules.RULES)
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double").selectExpr("g as lang", "g as source", *[f"v as {n}" for n in names])
    a, b = df.where(f"{names[0]} < 1"), df.where(f"{names[0]} >= 1")
    keys = ["lang", "source"]
    whole = quality_rules.sketches(df, keys)
    merged = quality_rules.sketches(a, keys).unionByName(quality_rules.sketches(b, keys)).groupBy(*keys, "rule", "bin").sum("n")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))  # sketches of parts add up
    got = {r.rule: r for r in quality_rules.fences(whole).collect()}
    q1, q3 = sorted(values)[999], sorted(values)[2999]
    for r in got.values():
        assert r.own and abs(r.high - (q3 + quality_rules.SPREAD * (q3 - q1))) < 0.08 * r.high and abs(r.low - (q1 - quality_rules.SPREAD * (q3 - q1))) < 0.08 * r.high


def test_quality_model_on_held_out_rows(spark, sf):
    d = sf.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in quality_model.op2_quality_model(spark, d).collect()}
    held = [(rows[r.doc_id].predicted, r.quality) for r in read(spark, d, "labels").collect() if rows[r.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95
    assert all(r.held_out == (crc_mod_py(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())


def test_rules_without_labels():
    x = np.zeros((0, len(quality_model.FEATURES)))
    assert quality_model.fit(x, np.zeros(0)) == (0.0, [])
    b, rules = quality_model.fit(np.zeros((5, len(quality_model.FEATURES))), np.ones(5))
    assert b > 0 and rules == []


def test_toxicity(spark, odd):
    bad = ["you idiot scum", "what trash, loser", "a pathetic clown", "such an idiot"]
    good = ["a fine day", "the cat sat", "reads very well", "such a day"]
    rng = random.Random(2)
    rows = [(f"{rng.choice(good)} {rng.choice(bad if k else good)} {rng.choice(good)}", k) for k in (0, 1) for _ in range(120)]
    w, b = toxicity.train(spark.createDataFrame(rows, "text string, label int"))
    test = spark.createDataFrame([("oh IDIOT", 1), ("the cat reads", 0), (None, None), ("", None)], "text string, want int")
    for r in toxicity.scored(test, w, b).collect():
        assert abs(r.score - 1 / (1 + np.exp(-b))) < 1e-12 if r.want is None else (r.score >= 0.3) == bool(r.want)
    none, base = toxicity.train(spark.createDataFrame([("x", 0)], "text string, label int"))
    assert not none.any() and toxicity.scored(odd, none, base).count() == odd.count()
    assert toxicity.scored(odd.limit(0), w, b).count() == 0


def test_bpe_is_the_library_and_back(spark, sf, odd):
    t = bpe.tokenizer(bpe.tokenizer_path())
    docs = read(spark, sf, "documents").select("doc_id", "text")
    more = spark.createDataFrame([(10_000 + i, x) for i, x in enumerate(["Don't<|endoftext|>stop", "Ｆull　width", "é İ ΑΣ", "\x1c\x85 tab\there", "a" * 3000])], "doc_id long, text string")
    for df, size in ((docs.unionByName(more), 500), (odd.select("doc_id", "text"), 3)):
        want = Counter()
        for r in df.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            want[(r.doc_id, np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False))] += 1
        got = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.encode(df, block_words=size).collect())
        assert got == want
    assert bpe.encode(odd.limit(0)).count() == 0


def brute_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("a1@.+- ()%_2é5,") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("ü 4111 1111 1111 1111.") == [("card", 2, 21)]
    for long in ("a" * 300_000, "1" * 300_000, "a." * 150_000 + "@", "+1" * 100_000):
        pii.base_spans(long)


def test_model_adds_to_base(spark, odd):
    m = pii.trained()
    x, y = pii.labelled(400, seed=99)
    assert (m.decode(x) == y)[y > 0].mean() > 0.9
    texts = ["call (017) 555-7713 now", "ref 12 4111111111111111 ok", "versions 3.0 and 2.14, page 99", "x" * 200 + " ask (212) 555-0182 " + "y" * 200, "no digits here at all"]
    found = [more for _, more in pii._search(texts, m)]
    assert found[0] and found[0][0][0] == "phone" and found[3]
    assert found[2] == found[4] == []
    rows = pii.find(odd.withColumn("pii", odd["doc_id"])).collect()
    assert len(rows) == odd.count() and all(r.pii.masked == (r.row.text or "") and r.row.pii == r.row.doc_id for r in rows)
    df = spark.createDataFrame([(1, "to ann@site.org or 10.0.0.1!", 5, "p", "r"), (2, None, 0, None, "r")], "doc_id long, text string, n_chars long, pii string, row string")
    assert sorted(map(tuple, pii.apply(df).collect())) == [(1, "to [email] or [ip]!", 19, "p", "r"), (2, None, 0, None, "r")]
    assert pii.apply(df.limit(0)).count() == 0


def planted(n, seed):
    """Made-up sentences, each with one item, and (text, kind, start, end)."""
    rng = random.Random(seed)
    words = "the of station under morning water letter seven house again between paper light".split()
    some = lambda k: " ".join(rng.choice(words) for _ in range(k))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    for i in range(n):
        kind = pii.KINDS[i % len(pii.KINDS)]
        if kind == "email":
            item, lead = f"{rng.choice(words)}.{rng.choice(words)} (at) {rng.choice(words)} (dot) org", ""
        elif kind == "phone":
            item, lead = rng.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}")), ""
        elif kind == "card":
            head = digits(15)
            item, lead = head + next(str(k) for k in range(10) if pii.luhn(head + str(k))), "+"  # the base pattern takes it as well
            item = "-".join(item[k : k + 4] for k in range(0, 16, 4)).replace("-", ".")
            lead = ""
        elif kind == "ip":
            item, lead = ".".join(str(rng.randint(1, 255)) for _ in range(4)), ""
        else:
            item, lead = "".join(rng.choice("0123456789abcdef") for _ in range(40)), rng.choice(('token = "', "secret: ", "api_key="))
        before = some(rng.randint(0, 40)) + " " + lead
        yield before + item + ('"' if lead.endswith('"') else "") + " " + some(rng.randint(0, 40)), kind, len(before), len(before) + len(item)


def test_recall_of_planted_items_by_kind():
    cases = list(planted(400, 8))
    hit = Counter()
    for (base, more), (_, kind, a, b) in zip(pii._search([c[0] for c in cases], pii.trained()), cases, strict=True):
        hit[kind] += (kind, a, b) in base + more
    assert all(hit[k] >= 0.85 * 80 for k in pii.KINDS), hit


def test_clean_texts_are_left_alone(spark, sf):
    m = pii.trained()
    texts = [r.text or "" for r in read(spark, sf.replace("0.001", "0.01"), "documents").collect()]
    item = re.compile(r"@|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\+1 \(|[0-9]{16}|token = ", re.I)
    clean = [t for t in texts if not item.search(t)]
    assert len(clean) > 800 and all(base + more == [] for base, more in pii._search(clean, m))
    secrets = [(t, x.span(1)) for t in texts for x in re.finditer('token = "([0-9a-f]{40})"', t, re.I)]
    assert len(secrets) > 5
    for t, (a, b) in secrets:
        assert ("secret", a, b) in pii._search([t], m)[0][1]


def test_spans_across_windows(spark):
    m = pii.trained()
    hit = 0
    for pad in range(30, 130):
        t = "word " * 10 + "z" * pad + " (415) 555-2671 " + "word " * 20
        got = [(k, t[a:b]) for k, a, b in pii._search([t], m)[0][1]]
        assert got in ([("phone", "(415) 555-2671")], []), t
        hit += len(got)
    assert hit > 90
    long = "x" * 30 + " first.last.name.and.more (at) sub.department.of.a-company-name (dot) example (dot) co (dot) uk " + "y" * 30
    for pad in range(0, 48, 5):  # longer than half a window
        assert [k for k, *_ in pii._search([" " * pad + long], m)[0][1]] in (["email"], []), pad


def test_scan_is_the_same_for_every_block_size(spark, tmp_path):
    eod = token_counts.EOD
    np.array([5, eod, eod, 1, 2, 3, eod, 7, 8], "<u2").tofile(tmp_path / "a.bin")
    np.array([], "<u2").tofile(tmp_path / "b.bin")
    np.array([9] * 7, "<u2").tofile(tmp_path / "c.bin")
    want = [("a.bin", 0, 1, True), ("a.bin", 1, 0, True), ("a.bin", 2, 3, True), ("a.bin", 3, 2, False), ("c.bin", 0, 7, False)]
    for block in (1, 2, 3, 100):
        got = token_counts.scan(spark, f"file://{tmp_path}", block=block)
        assert sorted((r.file[-5:], r.ordinal, r.n_tokens, r.ended) for r in got.collect()) == want


def test_other_orders_are_noticed(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.range(0, 10, 1, 2).selectExpr("id as doc_id", "repeat('word ', cast(id as int)) as text")
    key = token_counts.write(docs, f"file://{tmp_path}/a", path)
    counts = spark.createDataFrame([(p, k, 10 * p + k) for p in range(2) for k in range(5)], "part long, ordinal long, n_tokens long")
    assert sorted(map(tuple, token_counts.placed(docs, counts, key).collect())) == [(5 * p + k, 10 * p + k) for p in range(2) for k in range(5)]
    for other in (docs.repartition(3), docs.sortWithinPartitions("doc_id", ascending=False), docs.limit(9)):
        with pytest.raises(RuntimeError, match="another order"):
            token_counts.placed(other, counts, key)
    with pytest.raises(Exception, match="other partitions"):
        token_counts.placed(docs, counts.where("ordinal < 4"), key).collect()


def test_written_tokens_are_counted(spark, sf, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_counts, "FILE_DOCS", 17)  # several files a partition

    e = token_counts.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = {r.doc_id: len(e.encode_ordinary(r.text or "")) for r in read(spark, sf, "documents").collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.op5_token_counts(spark, sf).collect()} == want
