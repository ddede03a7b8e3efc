"""Personal data: base patterns and a character-level BiLSTM-CRF that adds to them.

Base spans are exact patterns of four kinds. The model is trained in numpy on spans that
are labelled when they are made (``labelled``): the four kinds in the usual ways of writing
them, and secrets (keys, tokens and passwords that are assigned to a name), among
look-alikes such as versions, dates, prices and checksums. A text is cut into windows of
WINDOW characters that overlap by half and are decoded each; over the whole text every
character takes its tag from the window it is most central in, so spans run on from window
to window, whatever their length. A span then grows to the ends of the words or numbers it
stands in, and is added if it can be an item of its kind (``can_be``: so many digits, a
right check digit) and overlaps no base span.

An item holds a digit or an at sign (also spelled out in brackets), so windows without one
in them or in the window before or after are not decoded: no span there can be added.

Defined results: null and empty texts have no spans and the hash of the empty list;
repeated rows are each searched; a text of any length is searched whole, in linear time;
an empty table gives an empty result; ``apply`` returns all other columns of its input
unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import span_model
from quillgraph.llm.common import bounded_batches, lean, read, whole
from quillgraph.llm.span_model import KINDS, WINDOW, Model, classes

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A number part begins where no digit stands before it and never gives digits back: the
# same matches as without these guards, in linear time.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AT_SIGN = re.compile(r"@|[\[(]\s?at\s?[\])]", re.I)
DOT_SIGN = re.compile(r"\w\s?(?:\.|[\[(]\s?dot\s?[\])])\s?\w", re.I)
TRIGGER = re.compile(r"[0-9@]|[\[(]\s?at\s?[\])]", re.I)
TRAIN_WINDOWS, STEPS = 5000, 450
#: Characters that a span grows by at most on either side.
GROW = 64

#: The kinds of base spans.
BASE = KINDS[:4]
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start; code point offsets, end exclusive."""
    out: list[Span] = []
    done = 0
    at = text.find("@")
    while at >= 0:
        # The local part is the run before the sign, as far as no earlier match took it.
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        m = HOST.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    for m in IP.finditer(text):
        if all(map(_small, m.groups())):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def labelled(n: int, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes and their tags: made-up text with made-up personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))

    def word() -> str:
        w = "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(1, 10))))
        return w.capitalize() if rng.random() < 0.15 else w.upper() if rng.random() < 0.05 else w

    def card() -> str:
        d = num(int(pick(13, 15, 16, 16, 16, 19)) - 1)
        d += next(str(k) for k in range(10) if luhn(d + str(k)))
        sep = pick("", "", " ", "-", ".")
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick(f"+{num(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {num(3)} {num(6)}", f"0{num(2)} {num(3)} {num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(3)}", f"+{num(11)}", f"({a}){b}-{c}")

    def email() -> str:
        name = pick(word(), word() + "." + word(), word() + num(2), num(2) + word(), word() + "_" + word()).lower()
        host, top = word().lower() + pick("", num(1), "-" + word().lower()), pick("com", "org", "net", "de", "fr", "example.com", "co.uk")
        return pick(f"{name}@{host}.{top}", f"{name}@{host}.{top}", f"{name} (at) {host} (dot) {top}", f"{name} [at] {host} [dot] {top}", f"{name}(at){host}.{top}")

    def ip() -> str:
        return ".".join(str(int(k)) for k in rng.integers(0, 256, 4))

    def mixed(k: int, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
        return "".join(pick(*letters, *"0123456789") for _ in range(k))

    def secret() -> tuple[str, str, str]:
        """What stands before a secret, the secret, and what stands after."""
        name = pick("token", "token", "secret", "api_key", "apikey", "password", "access key", "auth_token", "key")
        name = pick(name, name, name.upper())
        quote = pick('"', '"', "'", "")
        value = pick(mixed(40, "abcdef"), mixed(32, "abcdef"), mixed(64, "abcdef"), mixed(24), mixed(36), "sk_" + mixed(24), "gh" + mixed(30))
        return name + pick(" = ", " = ", "=", ": ") + quote, pick(value, value, value.upper()), quote

    make = {"email": email, "ip": ip, "card": card, "phone": phone}

    def other() -> str:
        return pick(
            num(int(rng.integers(1, 7))), f"{num(1)}.{num(1)}", f"version {num(1)}.{num(1)}.{num(2)}", f"20{num(2)}-{num(2)}-{num(2)}",
            f"${num(3)}.{num(2)}", f"sha1 {mixed(40, 'abcdef')}", f"commit {mixed(int(pick(8, 20, 40)), 'abcdef')}", f"#{num(5)}", f"{num(2)}:{num(2)}", f"@{word()}", f"{num(3)},{num(3)}", f"{word()}{num(2)}",
            f"{num(2)}%", f"{num(24)}", f"+ {word()}", f"({word()})", f"{num(1)}. {word()}", f"CC BY-NC {num(1)}.0", f'{pick("name", "title", "key", "token")} = "{word()}"',
            f"20{num(2)}-{num(2)}-{num(2)} {num(2)}:{num(2)}:{num(2)}", f"{num(4)} {num(4)}", f"{num(8)}-{num(4)}",
        )

    xs, ys = [], []
    for _ in range(n):
        text, tags = "", []

        def add(s: str, kind: int | None = None) -> None:
            nonlocal text
            text += s
            tags.extend([0] * len(s) if kind is None else [1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1))

        junk = pick("", "", "", "###", "***", "!!", "%%%")
        while len(text) < WINDOW + 80:
            r = rng.random()
            if r < 0.22:
                k = int(rng.integers(len(KINDS)))
                before, item, after = secret() if KINDS[k] == "secret" else ("", make[KINDS[k]](), "")
                add(before)
                add(item, k)
                add(after)
            elif r < 0.36:
                add(other())
            else:
                add(word())
            add(junk + pick(" ", " ", " ", ", ", ". ", "\n", " | "))
        start = int(rng.integers(0, 80))
        c, y = classes(text)[start : start + WINDOW].copy(), np.array(tags[start : start + WINDOW])
        if rng.random() < 0.2:  # the end of a text
            stop = int(rng.integers(20, WINDOW))
            c[stop:], y[stop:] = span_model.PAD, 0
        xs.append(c)
        ys.append(y)
    return np.array(xs), np.array(ys)


@lru_cache(maxsize=1)
def trained() -> Model:
    model = Model()
    x, y = labelled(TRAIN_WINDOWS)
    model.train(x, y, STEPS)
    return model


def _last(length: int) -> int:
    """Number of a text's last window."""
    return max(0, (length - WINDOW // 2 - 1) // (WINDOW // 2))


def _windows(text: str) -> list[int]:
    """Numbers of the windows that hold a trigger, and of their neighbours."""
    step, last = WINDOW // 2, _last(len(text))
    found: set[int] = set()
    for m in TRIGGER.finditer(text):
        k = m.start() // step
        if k + 1 not in found or k - 2 not in found:
            found.update(range(k - 2, k + 2))
    return sorted(x for x in found if 0 <= x <= last)


def can_be(kind: str, s: str) -> bool:
    """Whether ``s`` can be an item of its kind."""
    d, plain = _digits(s), not any(c.isalpha() for c in s)
    if "\n" in s:
        return False
    if kind == "email":
        ends = AT_SIGN.split(s)
        return len(ends) == 2 and ends[0].strip() != "" and " " not in ends[0].strip() and bool(DOT_SIGN.search(ends[1]))
    if kind == "ip":
        parts = [x for x in re.split("[^0-9]+", s) if x]
        return plain and len(parts) == 4 and all(map(_small, parts))
    if kind == "card":
        return plain and 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return plain and 9 <= len(d) <= 15 and len(d) < len(s)
    return " " not in s and sum(c.isalnum() for c in s) >= 16 and d != "" and not plain


def _grown(text: str, a: int, b: int) -> tuple[int, int] | None:
    """The span without blanks at its ends, grown to the ends of the words or numbers it cuts; None beyond GROW."""
    while a < b and text[a].isspace():
        a += 1
    while a < b and text[b - 1].isspace():
        b -= 1
    low, high = a - GROW, b + GROW
    while 0 < a and text[a - 1].isalnum() and text[a].isalnum():
        a -= 1
        if a < low:
            return None
    while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
        b += 1
        if b > high:
            return None
    return (a, b) if a < b else None


def model_spans(texts: list[str], model: Model) -> list[list[Span]]:
    """The model's spans of whole texts, before they are held against base spans."""
    tags, codes, place = [], [], []
    step, quarter = WINDOW // 2, WINDOW // 4
    for k, text in enumerate(texts):
        numbers = _windows(text)
        tags.append(np.zeros(len(text) + WINDOW if numbers else 0, np.uint8))
        if numbers:
            c = np.concatenate([classes(text), np.zeros(WINDOW, np.uint8)])
            codes += [c[x * step : x * step + WINDOW] for x in numbers]
            place += [(k, x) for x in numbers]
    for at in range(0, len(codes), 1024):
        for (k, x), t in zip(place[at : at + 1024], model.decode(np.stack(codes[at : at + 1024])), strict=False):
            # A window's own part: where it is the most central one.
            a, b = 0 if x == 0 else quarter, WINDOW if x == _last(len(texts[k])) else WINDOW - quarter
            tags[k][x * step + a : x * step + b] = t[a:b]
    out: list[list[Span]] = []
    for text, t in zip(texts, tags, strict=True):
        spans: list[Span] = []
        if t.any():
            kind = np.where(t > 0, (t + 1) // 2, 0)[: len(text)]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], kind, [0]])) != 0)
            cut = np.flatnonzero((t[: len(text)] % 2 == 1) & (kind > 0))  # an item that begins
            edge = np.unique(np.concatenate([edge, cut]))
            done = 0
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                whole = _grown(text, a, b) if kind[a] else None
                if whole and whole[0] >= done and can_be(KINDS[kind[a] - 1], text[whole[0] : whole[1]]):
                    spans.append((KINDS[kind[a] - 1], *whole))
                    done = whole[1]
        out.append(spans)
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _search(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of every text."""
    out = []
    for text, more in zip(texts, model_spans(texts, model), strict=True):
        base = base_spans(text)
        out.append((base, [s for s in more if all(s[2] <= a or s[1] >= b for _, a, b in base)]))
    return out


def found(text: Column, model: Model) -> Column:
    """Struct of a text's counts of base spans by kind and of all spans, both as lists in text, and the text with every span masked."""
    schema = ", ".join(f"n_{k} long" for k in BASE) + ", n_secret long, n_spans long, base string, spans string, masked string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            texts = [x if isinstance(x, str) else "" for x in s]
            for text, (base, more) in zip(texts, _search(texts, model), strict=True):
                parts, at = [], 0
                every = sorted(base + more, key=lambda x: x[1])
                for kind, a, b in every:
                    if b > at:
                        parts += [text[at : max(at, a)], f"[{kind}]" if a >= at else ""]
                        at = b
                rows.append((*[sum(k == x[0] for x in base) for k in BASE], sum(x[0] == "secret" for x in more), len(every), listed(base), listed(every), "".join(parts) + text[at:]))
            yield pd.DataFrame(rows, columns=names).astype({n: "int64" for n in names if n.startswith("n_")})

    return F.pandas_udf(lean(run), schema)(text.cast("string"))


def find(docs: DataFrame) -> DataFrame:
    """For every row of ``docs``: ``row``, all its columns, and ``pii``, what is found in its ``text``."""
    bounded_batches(docs.sparkSession)
    return docs.select(whole(docs).alias("row"), found(F.col("text"), trained()).alias("pii"))


def apply(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` masked by its kind in brackets; null stays null."""
    row, given = F.col("row"), F.col("row.text").isNotNull()
    new = {"text": F.when(given, F.col("pii.masked")), "n_chars": F.when(given, F.length("pii.masked")).otherwise(row["n_chars"]).cast("long") if "n_chars" in docs.columns else None}
    return find(docs).select(*[(new[c] if new.get(c) is not None else row[c]).alias(c) for c in docs.columns])


def op4_pii(spark, sf_dir):
    out = find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", *[f"pii.n_{k}" for k in BASE], F.sha2(F.col("pii.base").cast("binary"), 256).alias("base_sha256"), "pii.spans", "pii.n_secret", "pii.n_spans")


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
