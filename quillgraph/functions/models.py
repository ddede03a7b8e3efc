"""Places for language models: what a step that needs one asks for, and stubs that need none.

The stubs are deterministic and work offline; a service implements the same protocol.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@runtime_checkable
class Embedder(Protocol):
    """Texts to vectors of one length, of norm 1 (or 0 for an empty text)."""

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


@runtime_checkable
class Labeler(Protocol):
    """Names for what a schema leaves unnamed, and questions for queries."""

    def edge_label(self, source: str, target: str, columns: Sequence[str]) -> str: ...

    def question(self, query: object) -> str: ...


class TrigramEmbedder:
    """Hashed letter trigrams: texts that are spelled alike are near one another."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.size
            padded = f"  {text.lower()} "
            for k in range(len(padded) - 2) if text else ():
                v[zlib.crc32(padded[k : k + 3].encode()) % self.size] += 1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else v)
        return out


class PlainLabeler:
    """Labels from table names, and questions that spell a query out."""

    def edge_label(self, source: str, target: str, columns: Sequence[str]) -> str:
        return f"{source}_HAS_{target}".upper()

    def question(self, query: object) -> str:
        from quillgraph.plans import ir

        nodes = [n for n in ir.find_all(query, ir.NodePat) if n.labels]
        rels = [t for r in ir.find_all(query, ir.RelPat) for t in r.types]
        parts = [f"Which {' and '.join(dict.fromkeys(n.labels[0] for n in nodes)) or 'elements'} are there"]
        if rels:
            parts.append(f"that are linked by {', '.join(dict.fromkeys(rels))}")
        tests = len([m for m in ir.find_all(query, ir.Match) if m.where is not None])
        if tests:
            parts.append("under the given condition" + "s" * (tests > 1))
        limit = ir.find(query, ir.Limit)
        if limit is not None:
            parts.append(f"(at most {limit.n})")
        return " ".join(parts) + "?"


def embedded(text: Column, embedder: Embedder) -> Column:
    """An embedder as a column of vectors; a null text has the empty text's."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(embedder.embed(["" if x is None else x for x in s]), index=s.index, dtype=object)

    return F.pandas_udf(run, "array<double>")(text)


def questions(templates: Sequence, labeler: Labeler) -> list[tuple[str, str]]:
    """(question, query text) of every template."""
    return [(labeler.question(t.query), t.text()) for t in templates]
