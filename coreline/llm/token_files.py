"""Token ids in files: frequency-ranked, byte-aligned, with control bytes apart.

An id is written as its rank by corpus frequency, in as few bytes as the rank
needs (one to four, little-endian).  The byte counts of four ids share one
control byte, two bits each, lowest bits first; control bytes and data bytes
lie in separate columns.  Decoding looks each control byte up in a table of
lengths and gathers the data bytes with numpy, without a loop over ids.

A token file is a folder of Parquet files, one row a block::

    part           documents are dealt to parts by ascending doc_id
    block          number of the block in its part
    start          ids before the block in its part
    doc_ids, sizes the block's documents in order and their numbers of ids
    control, data  the coded ranks

and ``ranks`` beside it: the vocabulary's ids by falling frequency.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coreline.llm.common import frozen, running_offsets, shares, text_bytes
from coreline.llm.packing import id_width, token_stream
from coreline.runtime import new_path

PART_BYTES = 32 << 20
BLOCK_IDS = 1 << 18

_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    ranks = ranks.astype("<u4")
    size = np.ones(len(ranks), np.uint8)
    for bits in (8, 16, 24):
        size += ranks >= 1 << bits
    widest = int(size.max(initial=1))
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    wanted = np.arange(widest, dtype=np.uint8) < size[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[:, :widest][wanted].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first ``n`` numbers behind these control bytes."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    out = raw[at]
    for k in range(1, int(size.max(initial=1))):
        longer = np.flatnonzero(size > k)
        out[longer] |= raw[at[longer] + k] << np.uint32(8 * k)
    return out


def _place(edges: list[int]) -> Column:
    """Number of the doc_id range of a row, by a short scan of ranges and one inside a range."""
    if not edges:
        return F.lit(0)
    width = max(1, int(len(edges) ** 0.5))
    coarse, fine = (F.array(*[F.lit(int(e)).cast("long") for e in some]) for some in (edges[::width], edges))
    below = lambda e: e < F.col("doc_id")
    skip = F.greatest(F.size(F.filter(coarse, below)) - 1, F.lit(0)) * width
    place = skip + F.size(F.filter(F.slice(fine, skip + 1, F.lit(width + 1)), below))
    return F.coalesce(place, F.lit(0)).cast("int")


def _sorted_parts(docs: DataFrame, tokenizer: str, end_id: int, part_bytes: int) -> DataFrame:
    """Zipped ids of all documents, dealt to parts by doc_id and sorted there."""
    parts = shares(text_bytes(docs), part_bytes)
    quantiles = [i / parts for i in range(1, parts)]
    bounds = docs.agg(F.percentile_approx("doc_id", quantiles, 10 * parts)).first()[0] if quantiles else []
    edges = sorted(set(bounds or []))
    coded = token_stream(docs, tokenizer, end_id, zipped=True).select("doc_id", "n_tokens", "ids")
    # a task for each part: a hash of part numbers would put several into one
    dealt = coded.withColumn("part", _place(edges)).repartitionById(parts, F.col("part"))
    return dealt.sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids")


def _numbered(rows: DataFrame) -> DataFrame:
    """Give each document of a part the number of ids before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            part, size = batch.column("part").to_numpy(), batch.column("n_tokens").to_numpy()
            starts = np.zeros(len(size), np.int64)
            for key, rows in groupby(range(len(part)), key=part.__getitem__):
                rows = list(rows)
                at = 0 if key != now else at
                now = key
                ends = at + np.cumsum(size[rows])
                starts[rows] = ends - size[rows]
                at = int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("doc_id"), pa.array(starts), batch.column("n_tokens"), batch.column("ids")],
                ["part", "doc_id", "start", "n_tokens", "ids"],
            )

    return rows.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids binary")


def _frequencies(stream: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            some = [np.frombuffer(unzip(x.as_buffer()), kind) for x in batch.column("ids")]
            found = np.bincount(np.concatenate(some)) if some else np.zeros(0, np.int64)
            if len(found) > len(counts):
                counts = np.concatenate([counts, np.zeros(len(found) - len(counts), np.int64)])
            counts[: len(found)] += found
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts[ids])], ["id", "n"])

    return stream.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_file(
    docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, part_bytes: int = PART_BYTES
) -> str:
    """Write every text's ids and the end id, in ascending doc_id order (NULL first).

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  A NULL text
    counts as empty, repeated rows are written as often as they occur (rows of
    one doc_id in an order that their ids fix).  ``part_bytes`` is about the text
    of one part; the bounds of all parts pass through the driver, so raise it with
    very large tables.  Returns the folder's path.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-file")
    kind = id_width(end_id, tokenizer)
    stream = frozen(_numbered(_sorted_parts(docs, tokenizer, end_id, part_bytes)), "sorted-ids", "none")
    # one row for each id of the vocabulary at most
    ranked = [r["id"] for r in _frequencies(stream, kind).orderBy(F.desc("n"), "id").collect()]
    rank_of = np.zeros(max([end_id, *ranked]) + 1, np.uint32)
    rank_of[np.array(ranked, np.int64)] = np.arange(len(ranked))
    ranks = spark.sparkContext.broadcast(rank_of)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            part, size = batch.column("part").to_numpy(), batch.column("n_tokens").to_numpy()
            start = batch.column("start").to_numpy()
            ends = np.cumsum(size)
            cut = np.flatnonzero((np.diff(part) != 0) | (np.diff(ends // BLOCK_IDS) != 0)) + 1
            for rows in np.split(np.arange(len(part)), cut):
                if not len(rows):
                    continue
                some = batch.slice(rows[0], len(rows))
                ids = np.concatenate([np.frombuffer(unzip(x.as_buffer()), kind) for x in some.column("ids")])
                control, data = encode_ranks(ranks.value[ids])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(part[rows[0]])], pa.int32()),
                        pa.array([int(start[rows[0]])]),
                        pa.array([some.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                        pa.array([size[rows]], pa.list_(pa.int64())),
                        pa.array([control], pa.binary()),
                        pa.array([data], pa.binary()),
                    ],
                    ["part", "start", "doc_ids", "sizes", "control", "data"],
                )

    stream.mapInArrow(
        blocks, "part int, start long, doc_ids array<long>, sizes array<long>, control binary, data binary"
    ).write.option("compression", "zstd").parquet(f"{path}/blocks")
    spark.createDataFrame(
        pa.table({"rank": pa.array(range(len(ranked)), pa.int64()), "id": pa.array(ranked, pa.int64())})
    ).coalesce(1).write.parquet(f"{path}/ranks")
    return path


def read_token_file(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and ``ids`` (little-endian 32-bit) of a token file.

    ``start`` counts the ids of all documents before this one in the file.
    """
    table = [r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    id_of = spark.sparkContext.broadcast(np.array(table or [0], np.uint32))
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)
    parts = blocks.groupBy("part").agg(F.sum(sizes).alias("ids"))
    starts = running_offsets(parts, "part", "ids", "part_start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size = batch.column("sizes")[i].values.to_numpy()
                ids = id_of.value[
                    decode_ranks(batch.column("control")[i].as_py(), batch.column("data")[i].as_py(), int(size.sum()))
                ].astype("<u4")
                ends = np.cumsum(size)
                raw = [x.tobytes() for x in np.split(ids, ends[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[i].values,
                        pa.array(batch.column("at")[i].as_py() + ends - size),
                        pa.array(size),
                        pa.array(np.array([zlib.crc32(x) for x in raw], np.int64)),
                        pa.array(raw, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    # a row for each part of the file
    placed = blocks.join(F.broadcast(starts), "part").select(
        (F.col("part_start") + F.col("start")).alias("at"), "doc_ids", "sizes", "control", "data"
    )
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
