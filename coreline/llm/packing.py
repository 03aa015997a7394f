"""Concatenate-and-cut packing of token streams into fixed windows.

All documents are laid end to end as one token stream.  The first pass
tokenizes every text once, in place, and notes where each document starts in
its part (one part for each task); prefix sums over the part totals then give
global offsets, and the second pass cuts at the multiples of the window size.
Every document that meets a window is one boundary record.  Only the last
sequence has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coreline.llm.common import bounded_batches, frozen, running_offsets, slices
from coreline.llm.pieces import encoder

BATCH_BYTES = 4 << 20

_STREAM = "part int, seq long, doc_id long, start_in_part long, n_tokens long, ids binary"


def token_stream(docs: DataFrame, tokenizer: str, end_id: int, zipped: bool = False) -> DataFrame:
    """``part, seq, doc_id, start_in_part, n_tokens, ids`` of every row of ``docs``.

    ``ids`` are little-endian 16-bit numbers, 32-bit where the vocabulary needs
    it; zstd frames of them if ``zipped``.  A NULL text counts as empty: its
    document is the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        code = encoder(tokenizer)
        kind = "<u2" if max(code.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                flat, counts = code.encode(batch.column("text"))
                ends = np.cumsum(counts)
                closed = np.insert(flat, ends, end_id).astype(kind)
                counts = counts + 1
                ends = np.cumsum(counts)
                offsets = np.concatenate([[0], ends]) * closed.itemsize
                n = len(counts)
                ids = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(closed)]
                ).cast(pa.binary())
                if zipped:
                    pack = zstandard.ZstdCompressor(level=1).compress
                    ids = pa.array([pack(x.as_buffer()) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(np.arange(seq, seq + n)),
                        batch.column("doc_id").cast(pa.int64()),
                        pa.array(start + ends - counts),
                        pa.array(counts),
                        ids,
                    ],
                    ["part", "seq", "doc_id", "start_in_part", "n_tokens", "ids"],
                )
                seq += n
                start += int(ends[-1])

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(run, _STREAM)


def id_width(end_id: int, tokenizer: str) -> str:
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    return "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  A row for
    each piece: ``doc_id, start, length, doc_tokens, sequence_id, offset,
    padded_length`` and ``ids``, the piece's tokens as little-endian 32-bit numbers.
    A sequence is padded to ``window``, except one whose length is a power of two.

    Rows that repeat a document are packed as often as they occur, a NULL
    ``doc_id`` is kept, a NULL or empty text is one end id, and a very long text
    goes through as many sequences as it fills.  An empty table gives no rows.
    """
    stream = frozen(token_stream(docs, tokenizer, end_id), "token-stream")
    parts = stream.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    starts = running_offsets(parts, "part", "tokens", "part_start")
    total = stream.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    kind = id_width(end_id, tokenizer)
    left = total % window
    padded = left if left & (left - 1) == 0 else window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ids", BATCH_BYTES):
                at = batch.column("at").to_numpy()
                size = batch.column("n_tokens").to_numpy()
                first, last = at // window, (at + size - 1) // window
                pieces = last - first + 1
                row = np.repeat(np.arange(len(at)), pieces)
                sequence = np.repeat(first - (np.cumsum(pieces) - pieces), pieces) + np.arange(len(row))
                begin = np.maximum(at[row], sequence * window)
                end = np.minimum(at[row] + size[row], (sequence + 1) * window)
                start, length = begin - at[row], end - begin
                ids = [
                    np.frombuffer(batch.column("ids")[int(r)].as_buffer(), kind)[s : s + n].astype("<u4").tobytes()
                    for r, s, n in zip(row, start, length, strict=True)
                ]
                tail = sequence == total // window
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(size[row]),
                        pa.array(sequence),
                        pa.array(begin - sequence * window),
                        pa.array(np.where(tail, padded, window)),
                        pa.array(ids, pa.binary()),
                        pa.array(np.array([zlib.crc32(x) for x in ids], np.int64)),
                    ],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "padded_length", "ids", "ids_crc32"],
                )

    # a row for each task of the first pass: its size doesn't follow the data's rows
    placed = stream.join(F.broadcast(starts), "part").select(
        "doc_id", "n_tokens", "ids", (F.col("part_start") + F.col("start_in_part")).alias("at")
    )
    return placed.mapInArrow(
        cut,
        "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
        "padded_length long, ids binary, ids_crc32 long",
    )
