"""Counts in a fixed number of cells, gathered from all tasks: bounded, however large the input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CELLS = 1 << 20
BLOCK = 1 << 12


def rows(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A task's counts as (block, bytes), blocks without any left out."""
    for b in range(0, len(counts), BLOCK):
        part = counts[b : b + BLOCK]
        if part.any():
            yield b // BLOCK, part.astype(np.uint64).tobytes()


def _sum(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch["block"], batch["counts"]):
            part = np.frombuffer(data, np.uint64)
            if block in total:
                total[block] += part
            else:
                total[block] = part.copy()
    yield pd.DataFrame({"block": pd.Series(list(total), dtype="int64"), "counts": pd.Series([x.tobytes() for x in total.values()], dtype=object)})


def gather(parts: DataFrame) -> np.ndarray:
    """The sum of all tasks' (block, counts). Each block is summed as its rows stream by; the driver gets CELLS numbers."""
    out = np.zeros(CELLS, np.uint64)
    for row in parts.repartition("block").mapInPandas(_sum, "block long, counts binary").collect():
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], np.uint64)
    return out
