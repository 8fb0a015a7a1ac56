"""The shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000  #: rows of a small table's few columns that are broadcast; beyond, joins are spread by salts
SALTS = 256


def checkpoint_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; only a local master without it gets a temporary folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sediment-checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back, so that later stages survive the loss of executors."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{what}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)  # hashes as text take half the bytes
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing that is still to be computed reads it."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def is_few(rows: DataFrame) -> bool:
    """Whether ``rows`` are few enough to be broadcast."""
    return rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def join_few(rows: DataFrame, few: DataFrame, on: str, by: str, fits: bool | None = None) -> DataFrame:
    """The inner join with a table whose keys stand in very many of the rows each, so that no task gets all rows of a key.

    By runtime figures Spark doesn't broadcast a side with fewer keys than partitions, so it is named here; a side that
    is too large for that is repeated for each salt, and rows are salted by their column ``by``. ``fits`` is whether the side is few, where that is known.
    """
    if is_few(few) if fits is None else fits:
        return rows.join(F.broadcast(few), on)
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [on, "_salt"]).drop("_salt")
