"""One large JSON document read by many tasks.

Whether a byte of a document is inside a string, and how deep it is nested, depends on all
bytes before it. A first pass sums every block up for each state that it may begin in (inside
a string or not, after a backslash or not): how it ends, and by how much it nests. These
summaries, one a block, are scanned on the driver into the state that each block does begin
in. A second pass finds where the document's own arrays begin. The data source
``json_elements`` then has one partition a block, which gives the elements that begin there,
reading on into the next blocks for the last one. No element's place goes through the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillgraph.catalog import PropertyGraph
from quillgraph.sources.ingest import json_lines_graph
from quillgraph.storage import shared_path

BLOCK = 32 << 20
#: Bytes looked at before an array for its key.
KEY_REACH = 1 << 16


def _bytes(path: str, start: int, size: int) -> bytes:
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        return f.read_at(max(0, min(size, f.size() - start)), start)


def _quotes(b: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Which bytes are quotes that begin or end a string, and whether the byte after the last is escaped."""
    n = len(b)
    at = np.arange(n)
    other = np.maximum.accumulate(np.where(b != 92, at, -1)) if n else at
    # Backslashes right before each byte, and before the one after the last.
    before = np.concatenate([[-1], other])
    run = np.arange(n + 1) - 1 - before + np.where(before < 0, int(escaped), 0)
    odd = run % 2 == 1
    return (b == 34) & ~odd[:n], bool(odd[n])


def _nested(b: np.ndarray) -> np.ndarray:
    return ((b == 123) | (b == 91)).astype(np.int64) - ((b == 125) | (b == 93))


@dataclass(frozen=True)
class State:
    """How a block begins: inside a string, after a backslash, and how deep."""

    string: bool = False
    escaped: bool = False
    depth: int = 0

    def depths(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, State]:
        """Of each byte whether it is outside strings and the depth after it, and the state after all."""
        quotes, escaped = _quotes(b, self.escaped)
        count = np.cumsum(quotes)
        outside = ((count - quotes) % 2 == 1) == self.string
        depth = self.depth + np.cumsum(np.where(outside, _nested(b), 0))
        n = len(b)
        return outside & ~quotes, depth, State(self.string ^ bool(n and count[-1] % 2), escaped, int(depth[-1]) if n else self.depth)


def summary(block: bytes) -> list[tuple[bool, bool, int, int]]:
    """For a block that begins without and with a pending backslash: whether it has an odd number
    of quotes, whether it leaves a backslash pending, and its nesting outside and inside strings."""
    b = np.frombuffer(block, np.uint8)
    nested = _nested(b)
    out = []
    for escaped in (False, True):
        quotes, after = _quotes(b, escaped)
        inside = (np.cumsum(quotes) - quotes) % 2 == 1
        out.append((bool(quotes.sum() % 2), after, int(nested[~inside].sum()), int(nested[inside].sum())))
    return out


def states(spark: SparkSession, path: str, block: int = BLOCK) -> list[State]:
    """The state in which each block of the file begins."""
    fs, at = pafs.FileSystem.from_uri(path)
    n = max(1, -(-fs.get_file_info(at).size // block))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in pdf["id"].tolist():
                yield pd.DataFrame([(i, json.dumps(summary(_bytes(path, i * block, block))))], columns=["id", "s"])

    found = {r.id: json.loads(r.s) for r in spark.range(0, n, 1, n).mapInPandas(run, "id long, s string").collect()}  # a row a block
    now, out = State(), []
    for i in range(n):
        out.append(now)
        odd, after, plain, inside = found[i][now.escaped]
        now = State(now.string ^ odd, after, now.depth + (inside if now.string else plain))
    if now.string or now.depth:
        raise ValueError(f"{path} is no whole JSON document")
    return out


def _key(path: str, at: int) -> str:
    """The key whose value begins at a byte."""
    start = max(0, at - KEY_REACH)
    text = _bytes(path, start, at - start).rstrip()
    if not text.endswith(b":"):
        return ""
    text = text[:-1].rstrip()
    b = np.frombuffer(text, np.uint8)
    quotes = np.flatnonzero(_quotes(b, False)[0])  # a cut at the start can only touch far keys
    return json.loads(text[quotes[-2] :].decode())


def arrays(spark: SparkSession, path: str, begin: list[State], block: int = BLOCK) -> list[tuple[int, str]]:
    """Where the arrays of the document itself begin, and their keys, in order."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in pdf["id"].tolist():
                b = np.frombuffer(_bytes(path, i * block, block), np.uint8)
                outside, depth, _ = begin[i].depths(b)
                for k in np.flatnonzero(outside & (b == 91) & (depth == 2)).tolist():
                    yield pd.DataFrame([(i * block + k, _key(path, i * block + k))], columns=["at", "key"])

    rows = spark.range(0, len(begin), 1, len(begin)).mapInPandas(run, "at long, key string").collect()  # a row a key
    return sorted((r["at"], r["key"]) for r in rows)


@dataclass
class _Block(InputPartition):
    index: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.block = options["path"], int(options["block"])
        self.begin = [State(*s) for s in json.loads(options["states"])]
        self.arrays = [tuple(x) for x in json.loads(options["arrays"])]

    def partitions(self) -> list[InputPartition]:
        return [_Block(i) for i in range(len(self.begin))]

    def read(self, partition: _Block) -> Iterator[tuple[str, str]]:
        """Key of the array and text of every object in it that begins in the block."""
        first = partition.index * self.block
        data = _bytes(self.path, first, self.block)
        b = np.frombuffer(data, np.uint8)
        outside, depth, after = self.begin[partition.index].depths(b)
        starts = np.flatnonzero(outside & (b == 123) & (depth == 3))
        ends = np.flatnonzero(outside & (b == 125) & (depth == 2))
        opened, keys = np.array([at for at, _ in self.arrays]), [k for _, k in self.arrays]
        own = np.searchsorted(opened, first + starts, "right") - 1
        close = np.searchsorted(ends, starts)
        for at, k, c in zip(starts.tolist(), own.tolist(), close.tolist(), strict=True):
            text = data[at : ends[c] + 1] if c < len(ends) else data[at:] + self._rest(first + len(data), after)
            # Strings hold no line ends of their own, so those between tokens may go.
            yield keys[k], text.decode().replace("\r", " ").replace("\n", " ")

    def _rest(self, at: int, state: State) -> bytes:
        """What belongs to an element after its block."""
        parts = []
        while data := _bytes(self.path, at, self.block):
            b = np.frombuffer(data, np.uint8)
            outside, depth, state = state.depths(b)
            ends = np.flatnonzero(outside & (b == 125) & (depth == 2))
            if len(ends):
                return b"".join([*parts, data[: ends[0] + 1]])
            parts.append(data)
            at += len(data)
        raise ValueError(f"{self.path} ends in an element")


class JsonElements(DataSource):
    """Data source ``json_elements``; options as ``json_elements`` sets them."""

    @classmethod
    def name(cls) -> str:
        return "json_elements"

    def schema(self) -> str:
        return "array string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def json_elements(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """array (a key of the document) and value (JSON text) of every object in the arrays of one
    JSON object at a URI; blocks of ``block`` bytes are read by tasks of their own."""
    begin = states(spark, path, block)
    found = arrays(spark, path, begin, block)
    spark.dataSource.register(JsonElements)
    told = json.dumps([(s.string, s.escaped, s.depth) for s in begin])
    return spark.read.format("json_elements").option("path", path).option("block", str(block)).option("states", told).option("arrays", json.dumps(found)).load()


def large_json_graph(spark: SparkSession, path: str, block: int = BLOCK) -> PropertyGraph:
    """The graph of ``ingest.json_graph``, from a document that many tasks read.

    Elements are written once as lines of JSON to the shared folder, where Spark infers their types.
    """
    rows = json_elements(spark, path, block)
    top = shared_path(spark, "elements")
    rows.where("array IN ('nodes', 'relationships')").write.partitionBy("array").text(top)
    some = rows.sparkSession.read.text(top)
    kinds = {r[0] for r in some.select("array").distinct().collect()} if some.columns == ["value", "array"] else set()
    if "nodes" not in kinds:
        raise ValueError(f"{path} has no nodes")
    return json_lines_graph(spark, f"{top}/array=nodes", f"{top}/array=relationships" if "relationships" in kinds else None)
