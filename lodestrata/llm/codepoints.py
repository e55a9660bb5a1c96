"""Many texts at once as one array of code points, for the operators that work on characters inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters handled at once inside a task; bounds memory, changes no result.
BLOCK_CHARS = 1_000_000


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts hold about ``most`` bytes together; a longer text makes a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        run = (np.cumsum(sizes, dtype=np.int64) - 1) // most
        starts = np.append(0, np.flatnonzero(np.diff(run)) + 1)
        for i, j in zip(starts.tolist(), np.append(starts[1:], batch.num_rows).tolist(), strict=True):
            yield batch.slice(i, j - i)


def to_array(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def to_text(points: np.ndarray) -> str:
    return np.ascontiguousarray(points, np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


@cache
def table_of(name: str) -> np.ndarray:
    """For each code point whether the ``str`` method ``name`` (isalpha, isalnum, isspace, isupper) holds."""
    return np.fromiter((getattr(chr(i), name)() for i in range(0x110000)), np.bool_, 0x110000)


@cache
def _multipliers(size: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20_240_601)).integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)


def multipliers(size: int) -> np.ndarray:
    """Odd random 64-bit factors by position; a longer table begins with the shorter one."""
    return _multipliers(1 << max(12, int(size - 1).bit_length()))


def hash_segments(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit multilinear hash of each non-empty segment of ``points`` that begins at ``starts``; equal texts agree wherever they stand."""
    if not len(starts):
        return np.empty(0, np.int64)
    lengths = np.diff(np.append(starts, len(points)))
    within = np.arange(len(points)) - np.repeat(starts, lengths)
    product = (points.astype(np.uint64) + np.uint64(1)) * multipliers(int(lengths.max()))[within]
    h = np.add.reduceat(product, starts) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def rolling(points: np.ndarray, width: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial rolling hash of the ``width`` (a power of two) characters that end at each position, by doubling."""
    h = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    step, power = 1, factor
    while step < width:
        longer = h.copy()
        longer[step:] += h[:-step] * np.uint64(power)
        h, step, power = longer, step * 2, power * power % (1 << 64)
    return h


def map_text(df, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str):
    """``mapInArrow`` of ``fn`` over blocks of rows bounded by their text in the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            out = fn(block)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
