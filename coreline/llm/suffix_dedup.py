"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every byte position starts a suffix of which only the first ``length`` bytes
count.  The sort goes by most significant digit, in three passes; a group that
holds one string, or strings of one document, leaves after each pass, and the
groups equal after the last one are exactly the repeated strings.

*   First digit: the smallest hash among the ``gram``-byte substrings of the
    string.  It depends on the string alone, so equal strings agree, and
    neighbouring suffixes mostly share it: a run of them is one record.
*   Second digit: the bytes under the whole run.  If an earlier document has the
    same run, all its strings are repeated, with nothing more to compare.
*   Third digit: the string itself, only in runs that share their first digit
    with a different run of another document, and only once for each such run.
    Their bytes are sent as they are, and cut into strings where they meet.  Under
    a digit of more than ``HOT_RUNS`` such runs, the strings' hashes are sent
    instead, in ranges of their own, so that its strings need not meet in one task.

Records travel as sorted arrays, one for each batch and range of the digit, so
no digit's group is a row each.  A first digit has as many bytes as tell the
records of the table apart; a second and a third one have 64 bits each, as runs
around one frequent phrase differ in nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coreline.llm.common import bounded_batches, byte_view, frozen, shares, slices, text_bytes
from coreline.llm.records import (
    digit_bytes,
    from_low_bytes,
    low_bytes,
    member_ids,
    members_of,
    rows_by_key,
    split_digits,
)
from coreline.llm.rolling import mixed, prefix_sums, span_hash, window_hash

BATCH_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20
CHUNK_BYTES = 4 << 20
#: A match of two contexts removes bytes and is not compared again: all 64 bits count.
CONTEXT_BYTES = 8
#: A first digit with more runs to look into than this is split by its strings' hashes.
HOT_RUNS = 4096
#: A NULL doc_id counts as the largest id.
NO_ID = (1 << 63) - 1
_C1, _C2 = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)

_RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span, out = 1, x
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Runs:
    """Runs of neighbouring strings with one first digit, for texts laid end to end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int, width: int):
        self.sums = prefix_sums(data)
        n = len(data) - length + 1
        starts, ends = offsets[:-1], offsets[1:]
        long = ends - starts >= length
        if n <= 0 or not long.any():
            self.start = self.stop = self.doc = np.zeros(0, np.int64)
            self.digit = self.context = np.zeros(0, np.uint64)
            return
        edge = np.zeros(n + 1, np.int8)
        edge[starts[long]] += 1
        edge[ends[long] - length + 1] -= 1
        real = np.cumsum(edge[:n], dtype=np.int8) > 0
        least = _sliding_min(mixed(window_hash(self.sums, gram)), length - gram + 1)
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | ~real[:-1]
        new[starts[long]] = True
        first = np.flatnonzero(new & real)
        # a run ends where the next one starts, or the document's last string
        self.doc = np.searchsorted(offsets, first, side="right") - 1
        self.start = first
        last = ends[self.doc] - length + 1
        self.stop = np.minimum(np.append(first[1:], n), last)
        # minima crowd at the low end; mixed again they fill all ranges alike
        self.digit = mixed(least[first]) >> np.uint64(64 - 8 * width)
        span = (self.stop - self.start).astype(np.uint64)
        self.context = mixed(span_hash(self.sums, self.start, self.stop + length - 1) + span * _C1)


def _join(digit: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mixed(digit * _C1 ^ mixed(context + _C2))


def _owned(ids: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mixed(key ^ mixed(ids.astype(np.uint64) + _C1))


def _chunk(ids: np.ndarray, chunks: int) -> np.ndarray:
    return (mixed(ids.astype(np.uint64)) % np.uint64(chunks)).astype(np.int32)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()


def _run_records(docs: DataFrame, length: int, gram: int, width: int, buckets: int) -> DataFrame:
    """First and second digits of all runs: arrays of one batch and digit range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 * BATCH_BYTES):
                ids = _ids(batch)
                found = []
                at = 0
                for some in slices(batch, "text", BATCH_BYTES):
                    runs = Runs(*byte_view(some.column("text")), length, gram, width)
                    found.append((runs.digit, runs.context, runs.doc + at))
                    at += some.num_rows
                digit, context, doc = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(digit)
                digit, context, doc = digit[order], context[order], doc[order]
                rows = []
                cuts = split_digits(digit, width, buckets)
                for k in range(buckets):
                    part = slice(cuts[k], cuts[k + 1])
                    if cuts[k] < cuts[k + 1]:
                        own = members_of(doc[part], ids)
                        rows.append((k, *own, low_bytes(digit[part], width), low_bytes(context[part], CONTEXT_BYTES)))
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(next(columns), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)],
                        ["bucket", "ids", "place", "digit", "context"],
                    )

    return docs.mapInArrow(run, "bucket int, ids binary, place binary, digit binary, context binary")


def _to_chunks(ids: np.ndarray, key: np.ndarray, kind: int, chunks: int) -> pa.RecordBatch:
    """Rows ``chunk, kind, doc_id, body``: sorted marks of documents of one chunk."""
    mark, chunk = _owned(ids, key), _chunk(ids, chunks)
    order = np.lexsort((mark, chunk))
    mark, chunk = mark[order], chunk[order]
    names, at = np.unique(chunk, return_index=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names),
            pa.array(np.full(len(names), kind, np.int32)),
            pa.nulls(len(names), pa.int64()),
            pa.array([x.tobytes() for x in np.split(mark, at[1:])], pa.binary()),
        ],
        ["chunk", "kind", "doc_id", "body"],
    )


_WORK = "chunk int, kind int, doc_id long, body binary"
REPEATED, OPEN, STRING, TEXT, HOT = 0, 1, 2, 3, 4


def _first_two_digits(records: DataFrame, width: int, buckets: int, chunks: int) -> DataFrame:
    """Marks of runs that an earlier document has (REPEATED), and of those to look into (OPEN, or HOT under a hot digit)."""

    def decide(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        digit = np.concatenate([from_low_bytes(r["digit"], width) for r in rows])
        context = np.concatenate([from_low_bytes(r["context"], CONTEXT_BYTES) for r in rows])
        ids = np.concatenate([member_ids(r["ids"], r["place"]) for r in rows])
        order = np.argsort(digit, kind="stable")
        same = digit[order][1:] == digit[order][:-1]
        several = np.zeros(len(order), bool)
        several[1:] |= same
        several[:-1] |= same
        order = order[several]  # a digit that occurs once leaves here
        if not len(order):
            return
        order = order[np.lexsort((ids[order], context[order], digit[order]))]
        digit, context, ids = digit[order], context[order], ids[order]
        new_digit = np.ones(len(order), bool)
        new_digit[1:] = digit[1:] != digit[:-1]
        new_run = new_digit.copy()
        new_run[1:] |= context[1:] != context[:-1]
        earliest = ids[np.maximum.accumulate(np.where(new_run, np.arange(len(ids)), 0))]
        at = np.flatnonzero(new_digit)
        mixed_up = np.minimum.reduceat(earliest, at) != np.maximum.reduceat(earliest, at)
        group = np.cumsum(new_digit) - 1
        late = ids > earliest
        key = _join(digit, context)
        look = ~late & mixed_up[group]
        hot = (np.bincount(group[look], minlength=len(at)) > HOT_RUNS)[group]
        for kind, some in ((REPEATED, late), (OPEN, look & ~hot), (HOT, look & hot)):
            if some.any():
                yield _to_chunks(ids[some], key[some], kind, chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in rows_by_key(batches, "bucket"):
            yield from decide(rows)

    return records.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _WORK)


def _texts(docs: DataFrame, chunks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zipped = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ids = _ids(batch)
            body = [zipped(x.as_buffer()) for x in batch.column("text").fill_null("").cast(pa.large_binary())]
            kind = np.full(len(ids), TEXT, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_chunk(ids, chunks)), pa.array(kind), pa.array(ids), pa.array(body, pa.binary())],
                ["chunk", "kind", "doc_id", "body"],
            )

    return docs.mapInArrow(run, _WORK)


def _known(mark: np.ndarray, lists: list[bytes]) -> np.ndarray:
    """Which marks are in one of these sorted lists."""
    if not lists:
        return np.zeros(len(mark), bool)
    pool = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in lists]))
    return pool[np.minimum(np.searchsorted(pool, mark), len(pool) - 1)] == mark


def _covered(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    edge = np.bincount(start, minlength=n + 1) - np.bincount(stop, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def _finish(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, gone: np.ndarray, keep: bool) -> list:
    """One result row for each text."""
    rows = []
    for i, doc_id in enumerate(ids):
        part = slice(offsets[i], offsets[i + 1])
        cut, own = gone[part], data[part]
        removed = int(np.count_nonzero(cut))
        left = (own[~cut] if removed else own).tobytes()
        spans = int(np.count_nonzero(cut[1:] & ~cut[:-1]) + cut[0]) if removed else 0
        id_or_none = None if doc_id == NO_ID else int(doc_id)
        rows.append((id_or_none, len(own), removed, spans, hashlib.sha256(left).hexdigest(), left if keep else None))
    return rows


def _bodies(rows: list[dict], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, bytes and offsets of the texts of some rows, about ``most`` bytes at a time."""
    unzip = zstandard.ZstdDecompressor().decompress
    some, ids, size = [], [], 0
    for k, row in enumerate(rows):
        some.append(unzip(row["body"]))
        ids.append(row["doc_id"])
        size += len(some[-1])
        if size >= most or k == len(rows) - 1:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int64)
            yield np.array(ids, np.int64), np.frombuffer(b"".join(some), np.uint8), offsets
            some, ids, size = [], [], 0


_OPEN = "bucket int, ids binary, place binary, digit binary, size binary, body binary"


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of some spans, end to end."""
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _open_runs(work: DataFrame, length: int, gram: int, width: int, buckets: int, chunks: int) -> DataFrame:
    """The bytes of OPEN runs: arrays of one chunk and range of the first digit.

    Of HOT runs, the strings' hashes by ranges of their own (buckets from
    ``buckets`` on), each with its smallest id; the marks of other ids are known
    here and only pass through (buckets from ``2 * buckets`` on, one for each chunk).
    """

    def hot_rows(chunk: int, runs: Runs, ids: np.ndarray, look: np.ndarray) -> list[tuple]:
        many = runs.stop[look] - runs.start[look]
        at = np.repeat(runs.start[look] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        string, doc = mixed(span_hash(runs.sums, at, at + length)), np.repeat(runs.doc[look], many)
        order = np.lexsort((ids[doc], string))
        string, doc = string[order], doc[order]
        new = np.ones(len(string), bool)
        new[1:] = string[1:] != string[:-1]
        late = ids[doc] > ids[doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]]
        out = []
        if late.any():
            out.append((2 * buckets + chunk, b"", b"", b"", b"", np.unique(_owned(ids[doc[late]], string[late])).tobytes()))
        string, doc = string[new], doc[new]
        cuts = split_digits(string, 8, buckets)
        for k in range(buckets):
            part = slice(cuts[k], cuts[k + 1])
            if cuts[k] < cuts[k + 1]:
                out.append((buckets + k, *members_of(doc[part], ids), b"", b"", string[part].tobytes()))
        return out

    def chunk_rows(chunk: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        lists = [r["body"] for r in rows if r["kind"] == OPEN]
        hot = [r["body"] for r in rows if r["kind"] == HOT]
        if not lists and not hot:
            return
        zipped = zstandard.ZstdCompressor(level=3).compress
        for ids, data, offsets in _bodies([r for r in rows if r["kind"] == TEXT], BATCH_BYTES):
            runs = Runs(data, offsets, length, gram, width)
            mark = _owned(ids[runs.doc], _join(runs.digit, runs.context))
            look = np.flatnonzero(_known(mark, lists))
            _, once = np.unique(mark[look], return_index=True)
            look = look[once]
            look = look[np.argsort(runs.digit[look])]
            cuts = split_digits(runs.digit[look], width, buckets)
            some = np.flatnonzero(_known(mark, hot))
            out = hot_rows(chunk, runs, ids, some) if len(some) else []
            for k in range(buckets):
                part = look[cuts[k] : cuts[k + 1]]
                if len(part):
                    size = runs.stop[part] - runs.start[part] + length - 1
                    body = zipped(_gather(data, runs.start[part], size).tobytes())
                    own = members_of(runs.doc[part], ids)
                    out.append((k, *own, low_bytes(runs.digit[part], width), size.astype("<u4").tobytes(), body))
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(next(columns), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)],
                    ["bucket", "ids", "place", "digit", "size", "body"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in rows_by_key(batches, "chunk"):
            yield from chunk_rows(chunk, rows)

    return work.repartition(chunks, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, _OPEN)


def _third_digit(opened: DataFrame, length: int, width: int, buckets: int, chunks: int) -> DataFrame:
    """Marks of strings that an earlier document has."""

    def decide_hot(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        string = np.concatenate([np.frombuffer(r["body"], np.uint64) for r in rows])
        ids = np.concatenate([member_ids(r["ids"], r["place"]) for r in rows])
        order = np.lexsort((ids, string))
        string, ids = string[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = string[1:] != string[:-1]
        late = ids > ids[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))]
        if late.any():
            yield _to_chunks(ids[late], string[late], STRING, chunks)

    def passed(chunk: int, rows: list[dict]) -> pa.RecordBatch:
        n = len(rows)
        kinds = (pa.array([chunk] * n, pa.int32()), pa.array([STRING] * n, pa.int32()), pa.nulls(n, pa.int64()))
        bodies = pa.array([r["body"] for r in rows], pa.binary())
        return pa.RecordBatch.from_arrays([*kinds, bodies], ["chunk", "kind", "doc_id", "body"])

    def decide(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        strings, counts = [], []
        for row in rows:
            size = np.frombuffer(row["size"], "<u4").astype(np.int64)
            counts.append(size - length + 1)
            sums = prefix_sums(np.frombuffer(unzip(row["body"]), np.uint8))
            inner = np.cumsum(counts[-1]) - counts[-1]
            at = np.repeat(np.cumsum(size) - size - inner, counts[-1]) + np.arange(int(counts[-1].sum()))
            strings.append(mixed(span_hash(sums, at, at + length)))
        string, many = np.concatenate(strings), np.concatenate(counts)
        digit = np.repeat(np.concatenate([from_low_bytes(r["digit"], width) for r in rows]), many)
        ids = np.repeat(np.concatenate([member_ids(r["ids"], r["place"]) for r in rows]), many)
        order = np.lexsort((ids, string, digit))
        digit, string, ids = digit[order], string[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = (digit[1:] != digit[:-1]) | (string[1:] != string[:-1])
        late = ids > ids[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))]
        if late.any():
            yield _to_chunks(ids[late], string[late], STRING, chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in rows_by_key(batches, "bucket"):
            if bucket >= 2 * buckets:
                yield passed(bucket - 2 * buckets, rows)
            else:
                yield from (decide if bucket < buckets else decide_hot)(rows)

    return opened.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _WORK)


def _results(work: DataFrame, length: int, gram: int, width: int, chunks: int, keep: bool) -> DataFrame:
    def chunk_rows(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        lists = {kind: [r["body"] for r in rows if r["kind"] == kind] for kind in (REPEATED, OPEN, STRING, HOT)}
        for ids, data, offsets in _bodies([r for r in rows if r["kind"] == TEXT], BATCH_BYTES):
            gone = np.zeros(len(data), bool)
            if lists[REPEATED] or lists[STRING]:
                runs = Runs(data, offsets, length, gram, width)
                mark = _owned(ids[runs.doc], _join(runs.digit, runs.context))
                hit = _known(mark, lists[REPEATED])
                gone = _covered(len(data), runs.start[hit], runs.stop[hit] + length - 1)
                look = np.flatnonzero(_known(mark, lists[OPEN] + lists[HOT])) if lists[STRING] else np.zeros(0, np.int64)
                many = runs.stop[look] - runs.start[look]
                at = np.repeat(runs.start[look] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                string = mixed(span_hash(runs.sums, at, at + length))
                at = at[_known(_owned(np.repeat(ids[runs.doc[look]], many), string), lists[STRING])]
                gone |= _covered(len(data), at, at + length)
            done = _finish(ids, data, offsets, gone, keep)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            columns = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in rows_by_key(batches, "chunk"):
            yield from chunk_rows(rows)

    dealt = work.repartition(chunks, "chunk").sortWithinPartitions("chunk", "kind")
    return dealt.mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 20, keep: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row of ``docs``.

    Removed is every byte under a ``length``-byte string of the text's UTF-8 bytes
    that also starts in a document with a smaller doc_id; overlaps count, and all
    texts are judged as they came in.  ``n_spans`` counts maximal removed runs,
    ``kept`` are the remaining bytes (NULL unless ``keep``; a cut may split a
    character).

    A NULL text counts as empty.  A NULL doc_id counts as larger than any other.
    Rows that share a doc_id never remove from each other.  Texts shorter than
    ``length`` stay whole.  Other columns are ignored, an empty table gives no rows.
    """
    docs = bounded_batches(docs.select("doc_id", "text"))
    size = text_bytes(docs)
    width, buckets, chunks = digit_bytes(size), shares(size, BUCKET_BYTES), shares(size, CHUNK_BYTES)
    records = _run_records(docs, length, gram, width, buckets)
    marks = frozen(_first_two_digits(records, width, buckets, chunks), "suffix-marks", "lz4")
    texts = _texts(docs, chunks)
    opened = _open_runs(marks.where(F.col("kind").isin(OPEN, HOT)).unionByName(texts), length, gram, width, buckets, chunks)
    strings = _third_digit(opened, length, width, buckets, chunks)
    work = marks.unionByName(strings).unionByName(texts)
    return _results(work, length, gram, width, chunks, keep)
