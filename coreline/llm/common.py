"""Helpers the operators share: input columns, sizes, frozen tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coreline.runtime import new_path

#: A word is a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


BATCH = "4m"


def bounded_batches(df: DataFrame) -> DataFrame:
    """Let batches that go to Python hold about ``BATCH``, unless the session states a size."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in conf.getAll:
        conf.set(name, BATCH)
    return df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def frozen(df: DataFrame, name: str, compression: str = "zstd", group_rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back.

    What follows sees one fixed set of rows, whichever executors are lost.
    ``group_rows`` bounds the rows of a row group, for tables of long rows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", compression)
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shares(total: int, each: int, least: int = 1) -> int:
    """A number of shares of about ``each``: it follows the size of the data."""
    return max(least, math.ceil(total / each))


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes in ``column``.

    A longer single value stands alone.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at, done = 0, 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, stop - at)
        at, done = stop, int(ends[stop - 1])


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each value starts (and the last ends)."""
    flat = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = flat.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
    if data is None or not len(flat):
        return np.zeros(0, np.uint8), np.zeros(len(flat) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of every text in one array, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat = pc.list_flatten(lists)
    real = pc.not_equal(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    counts = np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return flat.filter(real), counts


def running_offsets(totals: DataFrame, key: str, size: str, name: str) -> DataFrame:
    """Where each part starts if the parts are laid end to end in key order.

    ``totals`` has a row for each part of a job, not for each record, so ordering
    it takes one small task.
    """
    from pyspark.sql import Window

    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(F.col(key), F.coalesce(F.sum(size).over(before), F.lit(0)).alias(name))
