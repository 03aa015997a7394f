"""Sorted records of many keys in few rows: the arrays that tasks exchange.

A batch's records, sorted by a hash, are cut into ranges of it; each range is
one row of packed arrays, and a later task takes all rows of a range together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def low_bytes(x: np.ndarray, width: int) -> bytes:
    """Lowest ``width`` bytes of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def from_low_bytes(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def digit_bytes(size: int) -> int:
    """Bytes of a first digit for a table of ``size`` bytes: few records share one by chance."""
    return min(8, max(5, math.ceil((math.log2(max(size, 2)) + 10) / 8)))


def split_digits(digit: np.ndarray, width: int, buckets: int) -> list[int]:
    """Edges of ``buckets`` equal ranges in sorted digits."""
    step = (1 << 8 * width) // buckets
    return [0, *np.searchsorted(digit, np.array([k * step for k in range(1, buckets)], np.uint64)), len(digit)]


def rows_by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each key together, from batches sorted by it."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != now and rows:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def members_of(doc: np.ndarray, ids: np.ndarray) -> tuple[bytes, bytes]:
    """Ids that occur, and the number of each record's id among them."""
    used, place = np.unique(doc, return_inverse=True)
    return ids[used].tobytes(), place.astype("<u2" if len(used) <= 1 << 16 else "<u4").tobytes()


def member_ids(ids: bytes, place: bytes) -> np.ndarray:
    """The id of each record, from what :func:`members_of` made."""
    kind = "<u2" if len(ids) <= 8 << 16 else "<u4"
    return np.frombuffer(ids, np.int64)[np.frombuffer(place, kind)]
