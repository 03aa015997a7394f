"""Alignment of two tokenizers' ids over the same bytes.

Method: lockstep vectorised merging.  Both tokenizers' tokens become byte end
offsets.  A batch's documents are cut into lanes of ``LANE`` bytes (a common end
depends on its own offset only, so lanes are free of each other and long texts
give many of them).  One NumPy state vector holds every lane's A and B pointer;
each step compares all lanes' ends at once, emits a link and a cut where they
agree, moves the pointer that is behind, and finished lanes are compacted away.

Tokenizer A (byte-level BPE) reads a space and the text, B (sentencepiece with
byte fallback) the text, before which it puts the space itself.  Special tokens'
strings inside texts are plain text for both.

Corpus-wide pair counts: texts are tokenized once.  A task keeps each text's
distinct links, and how often the text has them, as numbers into the distinct
pairs of about ``CHUNK_BYTES`` of text and writes both; sums over links need no
order.  Pairs are summed over chunks, each B id's highest count is found, and a
pair's count goes back to the chunks that hold it; a chunk meets its counts in one
row.  No pair or document list passes through the driver or a broadcast.  A reader
holds a row group's rows at once, so one has ``GROUP_ROWS`` chunks at most.

Results for odd input: NULL and empty texts, and texts whose joined A or B bytes
differ from space and text (B reads U+2581 as a space), have no tokens: zeros and
''.  Repeated rows and ids, also NULL ids, give a row each.  Of tokens without
bytes the first one that ends at an offset is linked.  Equal counts tie: both
pairs are best.  Other columns are ignored, so no name can clash; an empty table
gives no rows.  A chunk holds one text at least, whatever its length.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coreline.llm.common import bounded_batches, byte_view, frozen, slices

LANE = 1024
CHUNK_BYTES = 2 << 20
STEP_BYTES = 1 << 19
GROUP_ROWS = 8
_SPACE_MARK = "▁"


class Vocabulary:
    """The bytes of every id, laid end to end."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.arange(total) + np.repeat(self.start[ids] - (ends - size), size)]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others take the code points from
    256 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        from coreline.llm.pieces import PieceEncoder

        self.pieces = PieceEncoder(path, most_chars=2_000_000)
        self.pieces.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        entries = [b""] * self.pieces.tokenizer.get_vocab_size()
        special = {t.content for t in self.pieces.tokenizer.get_added_tokens_decoder().values()}
        for token, i in self.pieces.tokenizer.get_vocab().items():
            entries[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        self.vocabulary = Vocabulary(entries)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        space, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
        ids, counts = self.pieces.encode(pc.binary_join_element_wise(space, texts, nothing))
        return ids.astype(np.int64), counts


class Pieces:
    """A sentencepiece vocabulary with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.processor.get_piece_size()
        self.vocabulary = Vocabulary([self._bytes(i) for i in range(n)])

    def _bytes(self, i: int) -> bytes:
        piece = self.processor.id_to_piece(i)
        if self.processor.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        return piece.replace(_SPACE_MARK, " ").encode()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.processor.encode(texts.to_pylist(), num_threads=1)
        counts = np.array([len(ids) for ids in found], np.int64)
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
        return flat, counts


_KEPT: dict[tuple[type, str], ByteLevel | Pieces] = {}


def _kept(kind, path: str):
    """One tokenizer for each worker and file, kept between tasks."""
    if (kind, path) not in _KEPT:
        _KEPT[kind, path] = kind(path)
    return _KEPT[kind, path]


def _same_bytes(ids: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray):
    """Which texts' tokens have exactly the bytes ``data[starts[i]:starts[i + 1]]``."""
    owner = np.repeat(np.arange(len(counts)), counts)
    total = np.bincount(owner, vocabulary.size[ids], len(counts)).astype(np.int64)
    fits = total == np.diff(starts)
    own = vocabulary.bytes_of(ids[fits[owner]])
    wanted = data[np.repeat(fits, np.diff(starts))]
    bad = np.flatnonzero(own != wanted)
    where = np.repeat(np.flatnonzero(fits), total[fits])
    fits[where[bad]] = False
    return fits


def merge_ends(ends_a: np.ndarray, ends_b: np.ndarray, total: int, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Places in two ascending lists of offsets in ``(0, total]`` that hold the same offset.

    All lanes' pointers move in lockstep; the work of a step is one comparison of
    two vectors.
    """
    edges = np.append(np.arange(0, max(total, 1), lane), total)
    pa_, pb = (np.searchsorted(e, edges[:-1], side="right") for e in (ends_a, ends_b))
    stop_a, stop_b = (np.searchsorted(e, edges[1:], side="right") for e in (ends_a, ends_b))
    links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        running = (pa_ < stop_a) & (pb < stop_b)
        if not running.all():
            pa_, pb, stop_a, stop_b = (x[running] for x in (pa_, pb, stop_a, stop_b))
        if not len(pa_):
            break
        ea, eb = ends_a[pa_], ends_b[pb]
        cut = ea == eb
        links_a.append(pa_[cut])
        links_b.append(pb[cut])
        pa_ = pa_ + (ea <= eb)
        pb = pb + (eb <= ea)
    at_a, at_b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(at_a, kind="stable")
    return at_a[order], at_b[order]


@functools.cache
def _digits(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. 10**width - 1, left-aligned, and how many each has."""
    n = np.arange(10**width)
    size = np.ones(len(n), np.int64)
    for k in range(1, width):
        size += n >= 10**k
    shift = 10 ** np.maximum(size[:, None] - 1 - np.arange(width), 0)
    return (n[:, None] // shift % 10 + ord("0")).astype(np.uint8), size.astype(np.uint8)


def _group_texts(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``a1,a2|b1;a3|b2,b3;`` over all tokens, and where each group ends in them.

    ``last_a`` and ``last_b`` are the places of the last token of each group.
    """
    width = len(str(int(max(a.max(initial=0), b.max(initial=0)))))
    digits, length = _digits(width)
    n = len(a) + len(b)
    group_a = np.searchsorted(last_a, np.arange(len(a)))
    group_b = np.searchsorted(last_b, np.arange(len(b)))
    # A's tokens stand behind all B tokens of earlier groups, B's behind A's of their own too
    before_b, upto_a = np.append(0, last_b + 1), last_a + 1
    place_a = np.arange(len(a)) + before_b[group_a]
    place_b = np.arange(len(b)) + upto_a[group_b]
    ids, mark = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
    size = length[ids]
    out = np.empty((n, width + 1), np.uint8)
    out[:, :width] = digits[ids]
    out[np.arange(n), size] = mark
    used = np.arange(width + 1, dtype=np.uint8) <= size[:, None]
    ends = np.cumsum(size + 1, dtype=np.int64)
    return out[used], ends[place_b[last_b]]


def _aligned(texts: pa.Array, coder_a: ByteLevel, coder_b: Pieces) -> tuple[dict, np.ndarray]:
    """Measures of each text, and all links in order as ``a << 32 | b``."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    (a, count_a), (b, count_b) = coder_a.encode(texts), coder_b.encode(texts)
    space, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    data, starts = byte_view(pc.binary_join_element_wise(space, texts, nothing))
    good = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for ids, counts, coder in ((a, count_a, coder_a), (b, count_b, coder_b)):
        good = good & _same_bytes(ids, counts, coder.vocabulary, data, starts)
    a, b = a[np.repeat(good, count_a)], b[np.repeat(good, count_b)]
    count_a, count_b = count_a * good, count_b * good
    bytes_kept = np.diff(starts) * good
    ends_a, ends_b = np.cumsum(coder_a.vocabulary.size[a]), np.cumsum(coder_b.vocabulary.size[b])
    # texts end where both tokenizers end, so laying them end to end makes no new common ends
    at_a, at_b = merge_ends(ends_a, ends_b, int(bytes_kept.sum()))
    owner = np.searchsorted(np.cumsum(count_a), at_a, side="right")
    links = np.bincount(owner, minlength=n).astype(np.int64)
    shas = [""] * n
    if len(at_a):
        raw, ends = _group_texts(a, b, at_a, at_b)
        raw = raw.tobytes()
        begin, done = 0, np.cumsum(links)
        for i in np.flatnonzero(good):
            end = int(ends[done[i] - 1])
            shas[i] = hashlib.sha256(raw[begin : end - 1]).hexdigest()
            begin = end
    measures = {"n_a": count_a, "n_b": count_b, "n_groups": links, "groups_sha256": shas}
    return measures, a[at_a] << 32 | b[at_b]


def _counted(links: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each text's distinct links: their numbers in ``pairs`` and times, how many each text has; ``pairs``, counts."""
    pairs, numbers, counts = np.unique(links, return_inverse=True, return_counts=True)
    base = max(len(pairs), 1)
    keys, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * base + numbers, return_counts=True)
    return keys % base, times, np.bincount(keys // base, minlength=len(sizes)), pairs, counts


_CHUNK = (
    "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_distinct array<long>, "
    "groups_sha256 array<string>, links binary, times binary, pairs array<long>, counts array<long>"
)


def aligned_chunks(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of documents: measures, distinct pairs with their counts in the
    chunk, and each text's distinct links as the numbers of their pairs, with how often the
    text has them (both little-endian, 32 bits)."""

    def packed(parts: list[tuple[pa.Array, dict, tuple[np.ndarray, ...]]]) -> pa.RecordBatch:
        ids = pa.concat_arrays([p[0] for p in parts])
        pairs, place = np.unique(np.concatenate([p[2][3] for p in parts]), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, place, np.concatenate([p[2][4] for p in parts]))
        own = np.split(place, np.cumsum([len(p[2][3]) for p in parts])[:-1])
        links = np.concatenate([at[p[2][0]] for at, p in zip(own, parts, strict=True)])
        times = np.concatenate([p[2][1] for p in parts])
        columns = [pa.array([ids.to_pylist()], pa.list_(pa.int64()))]
        for key in ("n_a", "n_b", "n_groups"):
            columns.append(pa.array([np.concatenate([p[1][key] for p in parts])], pa.list_(pa.int64())))
        columns.append(pa.array([np.concatenate([p[2][2] for p in parts])], pa.list_(pa.int64())))
        shas = [s for p in parts for s in p[1]["groups_sha256"]]
        columns.append(pa.array([shas], pa.list_(pa.string())))
        columns += [pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (links, times)]
        columns += [pa.array([x], pa.list_(pa.int64())) for x in (pairs, counts)]
        return pa.RecordBatch.from_arrays(columns, names)

    names = [c.split()[0] for c in _CHUNK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder_a, coder_b = _kept(ByteLevel, path_a), _kept(Pieces, path_b)
        parts, held = [], 0
        for batch in batches:
            for some in slices(batch, "text", STEP_BYTES):
                measures, links = _aligned(some.column("text"), coder_a, coder_b)
                parts.append((some.column("doc_id"), measures, _counted(links, measures["n_groups"])))
                held += pc.sum(pc.binary_length(some.column("text"))).as_py() or 0
                if held >= chunk_bytes:
                    yield packed(parts)
                    parts, held = [], 0
        if parts:
            yield packed(parts)

    return bounded_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, _CHUNK)


def align_tokens(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document."""
    numbered = F.monotonically_increasing_id().alias("part")
    chunks = aligned_chunks(docs, path_a, path_b, chunk_bytes).select(numbered, "*")
    chunks = frozen(chunks, "alignment", group_rows=GROUP_ROWS)
    by_chunk = chunks.select("part", F.explode(F.arrays_zip("pairs", "counts")).alias("e")).select(
        "part", F.col("e.pairs").alias("pair"), F.col("e.counts").alias("n")
    )
    total = by_chunk.groupBy("pair").agg(F.sum("n").alias("n"))
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    highest = total.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    rated = frozen(
        total.withColumn("b", b_id).join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")),
        "pair-counts",
    )
    # as many entries for a chunk as it has distinct pairs, in their order
    back = (
        by_chunk.select("part", "pair")
        .join(rated, "pair")
        .groupBy("part")
        .agg(F.array_sort(F.collect_list(F.struct("pair", "n", "best"))).alias("found"))
        .select("part", F.col("found.n").alias("n"), F.col("found.best").alias("best"))
    )
    fields = "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_distinct", "links", "times"
    met = chunks.select("part", *fields).join(back, "part", "left").select(*fields, "n", "best")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n_a, n_b, groups, shas = (batch.column(c)[i].values for c in fields[:5])
                links, times = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u4") for c in fields[6:])
                size = batch.column("n_distinct")[i].values.to_numpy()
                count_sum = n_best = np.zeros(len(size), np.int64)
                if len(links):
                    n = batch.column("n")[i].values.to_numpy(zero_copy_only=False)[links]
                    best = batch.column("best")[i].values.to_numpy(zero_copy_only=False)[links]
                    ends = np.cumsum(size)
                    sums = [np.append(0, np.cumsum(x * times, dtype=np.int64)) for x in (n, best)]
                    count_sum, n_best = (s[ends] - s[ends - size] for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [ids, n_a, n_b, groups, groups, pa.array(n_best), pa.array(count_sum), shas],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    return met.mapInArrow(
        run,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    )
