"""Quality rules with repetition measured on word suffix arrays.

Within each task the texts of a small batch are laid end to end as word
numbers.  Prefix doubling ranks all their suffixes at depths 1, 2, 4, ... at
once, where no match crosses a document.  Suffixes whose first ``window`` words
occur twice go on until every rank is unique: that order is the suffix array,
and the ranks of all depths give the longest common prefix of neighbours.  The
maximal repeated substrings are read from these; their spans are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coreline.llm.common import bounded_batches, slices, words_of

BATCH_BYTES = 2 << 20
SYMBOLS = r"[#*$%&|<>]"

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "repeat_chars long, longest_repeat long, base_failed boolean, kept boolean"
)


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of pairs: equal pairs share one, order is that of the pairs."""
    _, out = np.unique(first * (int(second.max(initial=0)) + 2) + second + 1, return_inverse=True)
    return out


def _deeper(rank: np.ndarray, owner: np.ndarray, depth: int) -> np.ndarray:
    """Ranks by twice the depth; a suffix that ends before sorts first."""
    behind = np.full(len(rank), -1, np.int64)
    if depth < len(rank):
        same = owner[:-depth] == owner[depth:]
        behind[:-depth][same] = rank[depth:][same]
    return _ranks(rank, behind)


def _windows(rank: np.ndarray, depth: int, owner: np.ndarray, window: int) -> np.ndarray:
    """Number of each ``window``-word window (by overlap of two shorter ones), -1 where none starts."""
    out = np.full(len(rank), -1, np.int64)
    n = len(rank) - window + 1
    if n <= 0:
        return out
    whole = owner[:n] == owner[window - 1 :]
    out[:n][whole] = _ranks(rank[:n][whole], rank[window - depth : window - depth + n][whole])
    return out


def repeated_spans(codes: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a repeat of at least ``window`` words starts, and how long the longest one there is.

    ``codes`` are the words of all documents, ``owner`` the document of each
    word, in rising order.  A repeat lies twice within one document; the two may overlap.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(codes):
        return none
    levels, depth = [_ranks(owner, codes)], 1
    while 2 * depth <= window:
        levels.append(_deeper(levels[-1], owner, depth))
        depth *= 2
    number = _windows(levels[-1], depth, owner, window)
    times = np.bincount(number[number >= 0], minlength=1)
    starts = np.flatnonzero((number >= 0) & (times[number] > 1))
    if not len(starts):
        return none
    # only documents with a repeated window go on
    busy = np.zeros(int(owner[-1]) + 1, bool)
    busy[owner[starts]] = True
    here = np.flatnonzero(busy[owner])
    place = np.full(len(codes), -1, np.int64)
    place[here] = np.arange(len(here))
    owner, starts = owner[here], place[starts]
    levels = [x[here] for x in levels]
    while len(np.unique(levels[-1][starts])) < len(starts):
        levels.append(_deeper(levels[-1], owner, depth))
        depth *= 2
    order = starts[np.argsort(levels[-1][starts])]
    common = np.zeros(len(order) + 1, np.int64)
    a, b = order[:-1], order[1:]
    shared = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + shared, b + shared
        inside = (i < len(owner)) & (j < len(owner))
        i, j = np.minimum(i, len(owner) - 1), np.minimum(j, len(owner) - 1)
        same = inside & (owner[i] == owner[a]) & (owner[j] == owner[b]) & (levels[k][i] == levels[k][j])
        shared += np.where(same, 1 << k, 0)
    common[1:-1] = np.where(owner[a] == owner[b], shared, 0)
    length = np.empty(len(order), np.int64)
    length[:] = np.maximum(common[:-1], common[1:])
    back = np.argsort(order)
    return here[order[back]], length[back]


def _covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def _duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line, for each text."""
    lists = pc.split_pattern(texts, "\n")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(lists).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    wordy = pc.match_substring_regex(coded.dictionary, r"[^ \t-\r]").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), counts)
    real = wordy[codes] if len(codes) else np.zeros(0, bool)
    pairs = owner[real] * (len(wordy) + 1) + codes[real]
    distinct = np.unique(pairs) // (len(wordy) + 1)
    return np.bincount(owner[real], minlength=len(texts)) - np.bincount(distinct, minlength=len(texts))


def measure(
    texts: pa.Array, window: int, min_words: int, max_repeat_percent: int, max_chars_percent: int, max_longest: int
) -> list[pa.Array]:
    """The columns of ``MEASURES`` for a batch of texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    words, counts = words_of(texts)
    owner = np.repeat(np.arange(n), counts)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts, lengths = repeated_spans(codes, owner, window)
    covered = _covered(len(codes), starts, lengths)
    n_repeat = np.bincount(owner[covered], minlength=n)
    word_chars = np.bincount(owner, chars, minlength=n).astype(np.int64)
    repeat_chars = np.bincount(owner[covered], chars[covered], minlength=n).astype(np.int64)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner[starts] if len(starts) else starts, lengths)
    failed = (counts < min_words) | (100 * n_repeat > max_repeat_percent * counts)
    kept = ~failed & (100 * repeat_chars <= max_chars_percent * word_chars) & (longest <= max_longest)
    symbols = pc.count_substring_regex(texts, SYMBOLS).cast(pa.int64())
    numbers = (counts, word_chars, symbols, _duplicate_lines(texts), n_repeat, repeat_chars, longest)
    return [pa.array(x).cast(pa.int64()) for x in numbers] + [pa.array(failed), pa.array(kept)]


def quality_measures(
    docs: DataFrame,
    window: int = 5,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    max_chars_percent: int = 25,
    max_longest: int = 500,
) -> DataFrame:
    """Every row of ``docs`` as a struct ``doc`` with its measures and verdict.

    ``n_repeat_words`` and ``repeat_chars`` are the words, and their code points,
    in spans that occur twice or more in their text and have ``window`` words at
    least; ``longest_repeat`` is the longest of them in words (two occurrences may
    overlap).  ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` of the words in such spans.  ``kept``: not that, at most
    ``max_chars_percent`` of the characters in such spans, and no repeat of more
    than ``max_longest`` words.

    A NULL text counts as empty: no words, not kept.  Rows are judged alone, so
    repeated rows get the same verdict; a NULL doc_id and any further columns stay
    as they are.  An empty table gives no rows.
    """
    whole = bounded_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.struct_field(batch.column("doc"), "text")
            both = pa.RecordBatch.from_arrays([batch.column("doc"), text], ["doc", "text"])
            for some in slices(both, "text", BATCH_BYTES):
                found = measure(some.column("text"), window, min_words, max_repeat_percent, max_chars_percent, max_longest)
                yield pa.RecordBatch.from_arrays([some.column("doc"), *found], names)

    names = ["doc", *(x.split()[0] for x in MEASURES.split(", "))]
    return whole.mapInArrow(run, T.StructType([whole.schema["doc"], *T.StructType.fromDDL(MEASURES)]))


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that pass the quality rules, in their own columns."""
    kept = quality_measures(docs, **limits).where("kept")
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
