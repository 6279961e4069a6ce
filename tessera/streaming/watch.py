"""Watching a directory: snapshot diffs with at-least-once builds, and streamed ingest.

Spark's file source sees new files only; edits and deletions need a diff against
the last snapshot that was built. The snapshot advances only when the build
succeeded, so a failed build is tried again with the next poll.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.lifecycle import snapshot_diff

SNAPSHOT = "path string, mtime timestamp, size long"


def last_snapshot(spark: SparkSession, state: str) -> tuple[int, DataFrame]:
    """(number, snapshot) of the newest complete snapshot below ``state``; (0, empty) without one."""
    try:
        marks = spark.read.parquet(f"{state}/marks").agg({"n": "max"}).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        marks = 0
    return marks, spark.read.schema(SNAPSHOT).parquet(f"{state}/snapshot={marks}") if marks else spark.createDataFrame([], SNAPSHOT)


def poll(spark: SparkSession, listing: DataFrame, state: str, build: Callable[[DataFrame], None]) -> int:
    """Diff a listing with the last snapshot; build if it changed; then keep the listing. Returns the changes."""
    n, old = last_snapshot(spark, state)
    listing.select("path", "mtime", "size").write.mode("overwrite").parquet(f"{state}/snapshot={n + 1}")
    new = spark.read.schema(SNAPSHOT).parquet(f"{state}/snapshot={n + 1}")
    changes = snapshot_diff(old, new)
    count = changes.count()
    if count:
        build(changes)
        spark.createDataFrame([(n + 1,)], "n long").coalesce(1).write.mode("append").parquet(f"{state}/marks")
    return count


def watch(spark: SparkSession, listing: Callable[[], DataFrame], state: str, build: Callable[[DataFrame], None], seconds: float = 2.5) -> StreamingQuery:
    """Poll on a rate stream; a failed build ends the query, whose restart polls again."""

    def tick(_batch: DataFrame, _n: int) -> None:
        poll(spark, listing(), state, build)

    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(tick).trigger(processingTime=f"{seconds} seconds").start()


def ingest(stream: DataFrame, root: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Append a stream's batches, each to a folder named by its number: a replayed batch overwrites itself."""

    def write(batch: DataFrame, n: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{root}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
