"""Texts as bytes inside Arrow batches, for the operators that work in Python tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text, None for null; one text at a time, without decoding."""
    # large_binary: a batch of long texts may hold over 2 GB
    for value in batch.column(column).cast(pa.large_string()).cast(pa.large_binary()):
        yield value.as_py()


def slices(batches: Iterator[pa.RecordBatch], chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `chars` bytes, so memory does not depend on the texts' lengths."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, int(batch.num_rows * chars / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
