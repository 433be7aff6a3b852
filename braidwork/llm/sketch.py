"""Count vectors of fixed size, added over all tasks without a shuffle of single counts."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 4096


def pack(counts: np.ndarray, part: int) -> list[tuple[int, int, bytes]]:
    """(block, salt, bytes) of a task's counts (int64, a multiple of BLOCK), blocks without counts left out."""
    flat = counts.reshape(-1, BLOCK)
    return [(int(k), part % 64, zlib.compress(flat[k].tobytes(), 1)) for k in np.flatnonzero(flat.any(1))]


def _add(t: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for c in t.column("counts").to_pylist():
        total += np.frombuffer(zlib.decompress(c), np.int64)
    return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)])})


def total(packed: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' vectors of `size` counts, in two levels; only size / BLOCK rows reach the driver."""
    for by in (["block", "salt"], ["block"]):
        packed = packed.groupBy(*by).applyInArrow(_add, "block int, counts binary")
    out = np.zeros((size // BLOCK, BLOCK), np.int64)
    for r in packed.collect():
        out[r.block] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return out.ravel()
