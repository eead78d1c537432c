"""Words and hashes of many texts at once, for use inside tasks.

Texts of an Arrow column are laid end to end in blocks of about ``BLOCK`` bytes and handled as arrays. A text is never cut:
one longer than a block makes a block of its own, and memory is a small multiple of the longest text.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 18
BATCH_ROWS = 1000
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_FACTOR = 0x9E3779B97F4A7C15
_BACK = pow(_FACTOR, -1, 1 << 64)


def tidy(run):
    """Gives the memory of a finished task back to the system, as Python workers live on with what they have taken."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def whole_texts(df: DataFrame) -> DataFrame:
    """Sets smaller Arrow batches where the session has the default of 10,000 rows, as rows hold whole texts."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, start: int = 1) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix(np.arange(start, start + n, dtype=np.uint64) * np.uint64(_FACTOR)) | np.uint64(1)


_BYTE = seeds(256, 1000)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, f in enumerate((_FACTOR, _BACK)):
            grown = np.full(max(n, BLOCK + 1), f, dtype=np.uint64)
            grown[0] = 1
            _powers[i] = np.cumprod(grown, dtype=np.uint64)
    return _powers[0], _powers[1]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


class Block:
    """Some texts with the places of their words (runs of anything but ASCII white space)."""

    def __init__(self, first: int, texts: list[bytes], lower: bool = False) -> None:
        self.first, self.n = first, len(texts)
        self.buf = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.at = 1 + np.cumsum(sizes + 1) - sizes - 1
        space = SPACE[self.buf]
        self.starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        self.ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        #: words[i]:words[i + 1] are the words of text i
        self.words = np.append(np.searchsorted(self.starts, self.at), len(self.starts))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, equal for equal words wherever they stand."""
        return span_hashes(self.buf, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    ahead, back = _power(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * ahead[: len(buf)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts])


def groups(column: pa.Array, size: int, rows: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of consecutive texts that fit ``size`` bytes (or one longer text), at most ``rows`` at a time."""
    for begin in range(0, len(column), rows):
        texts, first, held = raw_texts(column.slice(begin, rows)), 0, 0
        for i, t in enumerate(texts):
            if held and held + len(t) > size:
                yield begin + first, texts[first:i]
                first, held = i, 0
            held += len(t) + 1
        yield begin + first, texts[first:]


def blocks(column: pa.Array, lower: bool = False, size: int = BLOCK) -> Iterator[Block]:
    for first, texts in groups(column, size, 256):
        yield Block(first, texts, lower)


def sequence_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; the first belongs to the run that starts at word 0."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, width, dtype=np.uint64)
    for i, k in enumerate(seeds(width, 5000)):
        total += words[i : i + n] * k
    return mix(total)


def shingle_sets(block: Block, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence is one where there are fewer words."""
    hashes, out = block.hashes(), []
    every = sequence_hashes(hashes, width)
    for a, b in zip(block.words[:-1].tolist(), block.words[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        else:
            out.append(sequence_hashes(hashes[a:b], b - a) if b > a else every[:0])
    return out


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
