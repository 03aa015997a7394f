"""Sets of word shingles as sorted 64-bit hashes, for whole batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from coreline.llm.common import byte_view, slices
from coreline.llm.rolling import mixed, prefix_sums, span_hash

_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
STEP_BYTES = 1 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z lower-cased), and the number of words of each."""
    data, offsets = byte_view(pc.ascii_lower(pc.fill_null(texts, "")))
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    solid = ~_SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    counts = np.diff(np.searchsorted(start, offsets))
    return mixed(span_hash(prefix_sums(data), start, stop)), counts


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in rising order, laid end to end, and their owners.

    A text of fewer words than ``size`` has its whole word sequence as its only
    shingle; one without words has none.
    """
    at, found = 0, []
    for some in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", STEP_BYTES):
        values, owner = _sets(some.column(0), size)
        found.append((values, owner + at))
        at += some.num_rows
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    words, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(counts)), counts)
    last = np.cumsum(counts)[owner] if len(counts) else np.zeros(0, np.int64)
    at = np.arange(len(words))
    first = np.cumsum(counts)[owner] - counts[owner] if len(counts) else last
    short = (counts[owner] < size) & (at == first)
    starts = np.flatnonzero((at + size <= last) | short)
    value = np.zeros(len(starts), np.uint64)
    for k in range(size):
        inside = starts + k < last[starts]
        term = words[np.minimum(starts + k, max(len(words) - 1, 0))] if len(words) else value
        value = np.where(inside, mixed(value * _STEP + term), value)
    doc = owner[starts]
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], doc[new]
