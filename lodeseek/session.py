"""Session conventions shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULT_BATCH = "67108864b"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the conventions of this package (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodeseek")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches of long texts small."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(32 << 20))  # fixed, so that freed memory above the next limit goes back
    env.setdefault("MALLOC_TRIM_THRESHOLD_", str(64 << 20))
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")  # so that it goes back too
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", DEFAULT_BATCH) == DEFAULT_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset.

    A local temporary folder is only right on one machine, so it is refused on a cluster.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodeseek-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet, with options, to the shared folder and read it again.

    Shuffle files of the write are deleted as it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before) if before is not None else spark.conf.unset(CLEAN_UP)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for frames that no later plan reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
