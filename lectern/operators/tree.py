"""Trees and jagged arrays as rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def leaves(node, prefix: str, depth: int = 0) -> Iterator[tuple[str, str]]:
    """(reference, text) of the leaves of nested lists; positions count from one and empty leaves are left out."""
    if isinstance(node, list):
        for n, x in enumerate(node, 1):
            yield from leaves(x, f"{prefix}{':' if depth else ' '}{n}", depth + 1)
    elif isinstance(node, dict):
        for name, x in node.items():
            yield from leaves(x, f"{prefix}, {name}" if name else prefix, 0)
    elif isinstance(node, str) and node.strip():
        yield prefix, node


def flatten(rows: DataFrame) -> DataFrame:
    """(ref, text) of rows (title, body): body is JSON of any depth; what cannot be read gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out: list[tuple[str, str]] = []
            for title, body in zip(frame["title"], frame["body"], strict=True):
                try:
                    out += leaves(json.loads(body), title)
                except (TypeError, ValueError):
                    continue
            yield pd.DataFrame(out, columns=["ref", "text"]).astype(object)

    return rows.select("title", "body").mapInPandas(run, "ref string, text string")
