"""Bloom filters over a column of 64-bit hashes, built in tasks and merged slice by slice.

Each of ``PROBES`` probes has a range of cells of its own. A cell knows whether it was hit once or more than once, so one
filter says "seen" and the other "possibly seen twice". The number of cells follows the number of rows and never passes
``max_cells``: what is sent to the driver and to the tasks is at most ``max_cells / 8`` bytes (16 MB by default). Beyond that,
more hashes are reported as possible; none is ever missed, so callers stay exact at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from transitloom.llm.text import mix, seeds, tidy

PROBES = 4
CELLS_PER_ROW = 16
MAX_CELLS = 1 << 27
SLICE = 1 << 16
_SCHEMA = "slice int, seen binary, again binary"


def cells_for(rows: int, max_cells: int = MAX_CELLS) -> int:
    return min(max_cells, max(SLICE * PROBES, 1 << (max(1, rows) * CELLS_PER_ROW - 1).bit_length()))


def probes(hashes: np.ndarray, cells: int) -> np.ndarray:
    """(PROBES, n) cell numbers."""
    part = cells // PROBES
    h = hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes.astype(np.uint64)
    return np.stack([i * part + (mix(h * s) % np.uint64(part)).astype(np.int64) for i, s in enumerate(seeds(PROBES, 77))])


def _fill(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(cells, dtype=np.uint8)
        for batch in batches:
            at, n = np.unique(probes(batch.column(0).to_numpy(zero_copy_only=False), cells), return_counts=True)
            hits[at] = np.minimum(hits[at] + np.minimum(n, 2), 2)
        for i in range(cells // SLICE):
            own = hits[i * SLICE : (i + 1) * SLICE]
            if own.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([np.packbits(own > 0).tobytes()], pa.binary()), pa.array([np.packbits(own > 1).tobytes()], pa.binary())],
                    names=["slice", "seen", "again"],
                )

    return tidy(run)


@tidy
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slice; only one slice is held."""

    def row(at, seen, again):
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([seen.tobytes()], pa.binary()), pa.array([again.tobytes()], pa.binary())], names=["slice", "seen", "again"])

    now, seen, again = None, None, None
    for batch in batches:
        for at, s, a in zip(*(c.to_pylist() for c in batch.columns)):
            s, a = np.frombuffer(s, np.uint8), np.frombuffer(a, np.uint8)
            if at != now:
                if now is not None:
                    yield row(now, seen, again)
                now, seen, again = at, s.copy(), a.copy()
            else:
                again |= a | (seen & s)
                seen |= s
    if now is not None:
        yield row(now, seen, again)


class Bloom:
    """``seen(column)`` and ``again(column)`` are boolean columns: possibly in the data, possibly twice or more in it."""

    def __init__(self, hashes: DataFrame, rows: int, max_cells: int = MAX_CELLS, twice: bool = False) -> None:
        """``hashes`` has one column of non-null longs."""
        cells = cells_for(rows, max_cells)
        slices = (
            hashes.mapInArrow(_fill(cells), _SCHEMA)
            .repartition(max(1, min(cells // SLICE, 64)), "slice").sortWithinPartitions("slice")
            .mapInArrow(_merge, _SCHEMA).select("slice", "again" if twice else "seen")
        )
        bits = bytearray(cells // 8)
        for at, own in slices.toLocalIterator():  # cells / 8 bytes in all, see MAX_CELLS
            bits[at * SLICE // 8 : (at + 1) * SLICE // 8] = own
        self.bits = hashes.sparkSession.sparkContext.broadcast(bytes(bits))
        self.cells = cells

    def test(self, column: Column) -> Column:
        bits, cells = self.bits, self.cells

        @F.pandas_udf("boolean")
        def possible(values: pd.Series) -> pd.Series:
            return pd.Series(hit(bits.value, values.to_numpy(dtype=np.int64), cells))

        return possible(column)


def hit(bits: bytes, hashes: np.ndarray, cells: int) -> np.ndarray:
    table, found = np.frombuffer(bits, np.uint8), np.ones(len(hashes), dtype=bool)
    for at in probes(hashes, cells):
        found &= (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return found
