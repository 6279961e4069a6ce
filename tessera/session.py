"""Session construction, table reading and the shared scratch area.

Every intermediate table that cuts lineage goes under ``spark.checkpoint.dir``,
the folder that driver and executors of a cluster share. Only when that setting
is absent (a laptop, a test) is a folder of our own set.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; opened by Spark, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """A private folder of Parquet tables under the shared scratch root.

    ``save`` writes a frame and reads it back: the result has no lineage and
    survives the loss of any executor. ``drop`` removes tables that no returned
    frame reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, frame: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        writer = frame.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.at(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.at(name))

    def drop(self, *names: str) -> None:
        """Remove the named tables, or all."""
        for target in [self.at(n) for n in names] or [self.path]:
            path, files = self.files(target)
            files.delete(path, True)

    def drop_but(self, *names: str) -> None:
        """Remove all tables but the named ones."""
        path, files = self.files(self.path)
        for found in files.listStatus(path) if files.exists(path) else ():
            if found.getPath().getName() not in names:
                files.delete(found.getPath(), True)

    def settle(self) -> None:
        """Let shuffle files of what was written go: Spark removes them once the driver's garbage is collected, which may else take half an hour."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def files(self, target: str) -> tuple:
        """Hadoop path and file system of a place."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(target)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
