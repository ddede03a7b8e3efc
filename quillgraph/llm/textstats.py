"""Statistics of whole texts, for quality rules and the quality classifier.

One Arrow pass per text; nothing of the text itself leaves the pass. Null and empty
texts have zero in every count and every ratio.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.llm.common import lean, raw

SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
UPPER, LOWER, DIGITS, ENDS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".!?"
HIGH = bytes(range(128, 256))
#: All ASCII signs that are neither letters nor digits.
MARKS = bytes(b for b in range(33, 127) if b not in UPPER + LOWER + DIGITS)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = [
    "symbols_per_word", "pipes_per_word", "bangs_per_word", "chars_per_word", "upper_share", "digit_share",
    "non_ascii_share", "dup_line_share", "repeat_share", "distinct_share", "words_per_line", "ends_per_word",
    "longest_word", "top_word_share", "marks_per_word",
]
SCHEMA = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in RATIOS])


def one(text: str | None) -> tuple:
    """COUNTS and RATIOS of a text."""
    b = raw(text)
    words = b.split()
    n = len(words)
    if not n:
        return (0, 0, len(b) - len(b.translate(None, SYMBOLS)), 0, 0, *[0.0] * len(RATIOS))

    def of(chars: bytes) -> int:
        return len(b) - len(b.translate(None, chars))

    chars = len(text) - of(SPACE)
    symbols = of(SYMBOLS)
    lines = [x for x in b.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    at = defaultdict(count().__next__)
    ids = np.fromiter(map(at.__getitem__, words), np.int64, n)
    kinds = len(at)
    repeat = 0
    if n > 3 and kinds < n:
        if kinds < 1 << 21:
            key = (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:]
        else:  # three numbers no longer fit: number the pairs first
            pair = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
            key = pair[:-1] * kinds + ids[2:]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if same.any():
            twice = np.zeros(n, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = twice.copy()
            cover[1:] |= twice[:-1]
            cover[2:] |= twice[:-2]
            repeat = int(cover.sum())
    upper, lower = of(UPPER), of(LOWER)
    return (
        n, chars, symbols, dup, repeat,
        symbols / n, b.count(b"|") / n, b.count(b"!") / n, chars / n, upper / max(1, upper + lower), of(DIGITS) / chars,
        of(HIGH) / len(b), dup / len(lines), repeat / n, kinds / n, n / len(lines), of(ENDS) / n,
        float(max(map(len, words))), int(np.bincount(ids).max()) / n, of(MARKS) / n,
    )


def _stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        out = pd.DataFrame([one(x if isinstance(x, str) else None) for x in s], columns=COUNTS + RATIOS)
        yield out.astype({c: "int64" for c in COUNTS} | {c: "float64" for c in RATIOS})


def stats(text: Column) -> Column:
    """Struct of COUNTS and RATIOS of a text column."""
    return F.pandas_udf(lean(_stats), SCHEMA)(text.cast("string"))
