"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillgraph.llm.common import stored
from quillgraph.operators import components as shared


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (columns a and b): equal roots, one component."""
    return shared.components(links, stored)
