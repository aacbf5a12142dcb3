"""Session defaults and the shared scratch area used to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and local benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexiloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lexiloom/{name}-{uuid.uuid4().hex}"


# Cells (numbers of 8 bytes) a table may have to be sent to every executor: 32 MB.
BROADCAST_CELLS = 4_000_000


def small(df: DataFrame, rows: int, width: int = 1, text: int = 0) -> DataFrame:
    """Broadcast a table whose counted size is small, else leave the join to the optimizer.

    ``width`` is the numbers in a row and ``text`` the bytes of all its strings.
    """
    return F.broadcast(df) if rows * max(width, 1) + text // 8 <= BROADCAST_CELLS else df


def settled(df: DataFrame) -> DataFrame:
    """Checkpoint a derived side table, count it, and broadcast it if it is small.

    An aggregate's size is unknown before it runs, and a planned shuffle join would write
    the whole other side to disk even when the aggregate turns out to be tiny.
    """
    kept = checkpointed(df)
    strings = [F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)) for f in kept.schema.fields
               if f.dataType.typeName() in ("string", "binary")]
    row = kept.agg(F.count(F.lit(1)), *strings).first()
    return small(kept, row[0], len(kept.columns), sum(row[1:]))


# A string in more than this part of the rows is heavy; there are fewer such strings than this.
HEAVY_PARTS = 1024


def split_join(rows: DataFrame, sizes: DataFrame, key: str, side: Callable[[DataFrame], DataFrame], width: int) -> DataFrame:
    """Rows left-joined by ``key`` with what ``side`` gives for a table of keys, heavy keys apart.

    ``sizes`` is a settled table (key, _n) of how many rows each key has. Where all keys' results are small they are
    broadcast. Else the rows of heavy keys stay where they are and get those few keys' results broadcast, and only the
    other rows are shuffled, so that no task gets more of one key than a small part of the rows.
    """
    count, total = sizes.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if count * max(width, 1) <= BROADCAST_CELLS:
        return rows.join(F.broadcast(side(sizes.select(key))), key, "left")
    heavy = settled(sizes.filter(F.col("_n") * HEAVY_PARTS > F.lit(total)).select(key))
    if heavy.isEmpty():
        return rows.join(side(sizes.select(key)), key, "left")
    light = sizes.select(key).join(heavy, key, "left_anti")
    near = rows.join(heavy, key, "left_semi").join(small(side(heavy), HEAVY_PARTS, width), key, "left")
    return near.unionByName(rows.join(heavy, key, "left_anti").join(side(light), key, "left"))


def spread(df: DataFrame) -> DataFrame:
    """Spread rows that carry much work each over all cores.

    Only an input of fewer partitions than cores is moved, such as one small file; a
    large table has more and stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Bytes of a table that is passed over many times which a partition holds on average.
PORTION = 64 << 20


def portions(df: DataFrame, size: Column, portion: int | None = None) -> int:
    """How many partitions the rows need, ``size`` being a row's bytes; 0 where they have as many already."""
    parts = -(-int(df.agg(F.sum(size)).first()[0] or 0) // (portion or PORTION))
    return parts if parts > df.rdd.getNumPartitions() else 0


def released(spark: SparkSession) -> None:
    """Let go of the shuffles and checkpoints of tables that are no longer used.

    Spark removes them when the driver's garbage is collected, which passes over a table may not cause for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checked_in(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, which takes less room than a checkpoint."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors."""
    spark = df.sparkSession
    directory = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(directory)
    return df.checkpoint(eager=True)
