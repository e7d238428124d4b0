"""Where intermediate tables of the operators are kept."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only where that is unset, as in local tests, is a temporary folder made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="checkpoints-"))
    return _LOCAL[0]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there,
    and a lost executor costs no more than its unfinished tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes that a block sends to a shard on average, at least.
CELL_BYTES = 1024


def block_count(size: int, block_bytes: int) -> int:
    """How many blocks `size` bytes are dealt into: blocks of block_bytes, and beyond what that
    gives cells of CELL_BYTES for (about 30 GB at 6 MB), of the root of size * CELL_BYTES, so
    that the number of (block, shard) cells stays in proportion to the input."""
    return max(1, -(-size // max(block_bytes, math.isqrt(size * CELL_BYTES))))


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches of bounded bytes for the session, so that long texts don't pile up in a batch of many rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
