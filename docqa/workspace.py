"""Where jobs write shared tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``. A temporary folder is used only by a local-mode session without one."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="docqa-")
    return _local_root


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared root that no earlier call has returned."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to a shared table and read it back, so that it is computed once and survives lost executors."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def arrow_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """What is computed meanwhile sends Python workers batches of at most about ``most`` bytes, or one row."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)
