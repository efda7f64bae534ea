"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import gc
import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes of an Arrow batch of whole texts.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20
#: The six white-space characters of ASCII, as the contracts name them.
ASCII_SPACE = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the byte-wise fast path of ``lower``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash128(value: Column) -> list[Column]:
    """Two independent 64-bit hashes; the second starts from another seed, so they don't collide together."""
    return [F.xxhash64(value), F.xxhash64(F.lit(0x5EED), value)]


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> dict[str, str | None]:
    """From now on Arrow batches have at most so many rows, and ``BATCH_BYTES`` bytes where Spark knows that bound, for whole
    texts go through them; gives what held before. Results don't depend on it."""
    now = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in now}
    for k, v in now.items():
        spark.conf.set(k, v)
    return before


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """``bounded_batches`` while it holds."""
    before = bounded_batches(spark, rows)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where Spark runs in one machine's single
    process, as in tests, a folder of its own does where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends here, and a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Like ``cut``, but as compressed Parquet, for wide or large intermediate tables; removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Deletes tables that ``written`` gave once their last reader is done; they can't be read afterwards."""
    for df in stored:
        remove(df.sparkSession, df._stored_at)


def stored_bytes(stored: DataFrame) -> int:
    """What a table that ``written`` gave takes of the disk."""
    spark = stored.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stored._stored_at)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files and checkpoints of steps that are over: it does when the driver collects garbage,
    which a driver that has little to do itself may not for a long time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table; a stopped session leaves nothing to delete with."""
    if spark.sparkContext._jsc is None:
        return
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the gateway may be gone at exit
        pass
