"""The life of an index: catalog, sync with a directory, tombstones, compaction, generations.

A generation is a folder ``gen=N`` of Parquet tables; a manifest row, written last,
makes it visible. Readers take the greatest generation whose checksum holds.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the manifest format.
MAGIC, VERSION = 0x4244424D, 4
WORD = 4294967295


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def sync_diff(catalog: DataFrame, disk: DataFrame) -> DataFrame:
    """Status of every file of the live catalog or the disk: new, modified, unchanged or deleted.

    A catalog entry belongs to the file of its relative path; an entry that names no
    folder belongs to the file of that base name where exactly one is left. So files of
    one name in several folders stay apart.
    """
    old = catalog.filter(~F.col("is_deleted")).select(F.col("filename").alias("entry"), "doc_id", F.col("file_size").alias("old_size"), F.col("last_write_time").alias("old_time"))
    new = disk.select("filename", "file_size", "last_write_time")
    same = old.join(new, F.col("entry") == F.col("filename"), "left")
    found = same.filter("filename IS NOT NULL")
    bare = same.filter("filename IS NULL AND NOT contains(entry, '/')").select("entry", "doc_id", "old_size", "old_time")
    rest = new.join(found.select("filename"), "filename", "left_anti").withColumn("base", base_name(F.col("filename")))
    single = rest.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("filename", "file_size", "last_write_time")).alias("f")).filter("n = 1")
    by_name = bare.join(single, F.col("entry") == F.col("base")).select("entry", "doc_id", "old_size", "old_time", "f.*")
    matched = found.unionByName(by_name)
    gone = old.join(matched.select("doc_id"), "doc_id", "left_anti").select("entry", "doc_id", "old_size", "old_time")
    fresh = new.join(matched.select("filename"), "filename", "left_anti")
    both = matched.unionByName(gone, allowMissingColumns=True).unionByName(fresh, allowMissingColumns=True)
    status = (
        F.when(F.col("old_size").isNull(), "new")
        .when(F.col("file_size").isNull(), "deleted")
        .when((F.col("old_size") == F.col("file_size")) & (F.col("old_time") == F.col("last_write_time")), "unchanged")
        .otherwise("modified")
    )
    return both.select(F.coalesce("filename", "entry").alias("filename"), "doc_id", status.alias("status"), status.isin("new", "modified").alias("pending"), status.isin("modified", "deleted").alias("tombstoned"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two snapshots of (path, mtime, size); unchanged paths are left out."""
    both = old.select("path", F.struct("mtime", "size").alias("o")).join(new.select("path", F.struct("mtime", "size").alias("n")), "path", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "modified")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


def live(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """Records whose document is not tombstoned."""
    return records.join(catalog.filter("is_deleted").select("doc_id"), "doc_id", "left_anti")


def delete_documents(catalog: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The catalog with the given documents tombstoned."""
    gone = doc_ids.select("doc_id").distinct().withColumn("gone", F.lit(True))
    return catalog.join(gone, "doc_id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("gone", F.lit(False))).drop("gone")


def checksum(generation: Column, time_ns: Column, documents: Column, active: Column, extents: Column) -> Column:
    """Polynomial of the manifest's 32-bit words, modulo 2**32."""
    words = [generation.bitwiseAND(F.lit(WORD)), F.shiftrightunsigned(generation, 32), time_ns.bitwiseAND(F.lit(WORD)), F.shiftrightunsigned(time_ns, 32), documents, active, extents]
    c = F.lit(MAGIC ^ VERSION).cast("long")
    for w in words:
        c = (c * 31 + w.cast("long")).bitwiseAND(F.lit(WORD))
    return c


def manifest_row(generation: int, time_ns: int, documents: int, active: int, extents: int) -> tuple:
    c = MAGIC ^ VERSION
    for w in (generation & WORD, generation >> 32, time_ns & WORD, time_ns >> 32, documents, active, extents):
        c = (c * 31 + w) & WORD
    return MAGIC, VERSION, generation, time_ns, documents, active, extents, c


MANIFEST = "magic long, version int, generation_id long, commit_timestamp_ns long, num_documents long, active_documents long, total_extents long, checksum long"


def valid_manifests(manifest: DataFrame) -> DataFrame:
    good = checksum(F.col("generation_id"), F.col("commit_timestamp_ns"), F.col("num_documents"), F.col("active_documents"), F.col("total_extents"))
    return manifest.filter((F.col("magic") == MAGIC) & (F.col("version") == VERSION) & (F.col("checksum") == good))


def latest(manifest: DataFrame) -> DataFrame:
    return valid_manifests(manifest).orderBy(F.desc("generation_id")).limit(1)


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], catalog: DataFrame, extents: int, time_ns: int) -> int:
    """Write all tables as the next generation, then the manifest row; returns the generation."""
    generation = current(spark, root) + 1
    for name, frame in {**tables, "catalog": catalog}.items():
        frame.write.mode("overwrite").parquet(f"{root}/gen={generation}/{name}")
    totals = spark.read.parquet(f"{root}/gen={generation}/catalog").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((~F.col("is_deleted")).cast("long")), F.lit(0)).alias("a")).first()
    row = manifest_row(generation, time_ns, totals.n, totals.a, extents)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return generation


def current(spark: SparkSession, root: str) -> int:
    """The greatest valid generation, or 0."""
    try:
        rows = latest(spark.read.parquet(f"{root}/manifest")).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return rows[0].generation_id if rows else 0


def open_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/gen={current(spark, root)}/{name}")
