"""Session settings and lineage cuts that hold on a cluster."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Let adaptive execution split a hot join key even if a later grouping on
    the same key then needs one more exchange.

    A setting that the session already states is left as it is.
    """
    name = "spark.sql.adaptive.forceOptimizeSkewedJoin"
    if name not in spark.conf.getAll:
        spark.conf.set(name, "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A machine-local folder is made only where the session names none and runs
    in local mode, as tests do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="coreline-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_CHECKPOINTS: WeakKeyDictionary = WeakKeyDictionary()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back."""
    path = new_path(df.sparkSession, "checkpoint")
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    _CHECKPOINTS[kept] = path
    return kept


def drop_checkpoint(df: DataFrame) -> None:
    """Delete what :func:`cut_lineage` wrote for this DataFrame."""
    if path := _CHECKPOINTS.pop(df, None):
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems, wherever it is."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/coreline/{name}-{uuid.uuid4().hex}"
