"""State and telemetry on disk: JSON records replaced as a whole, runs of telemetry, their retention.

All of it goes through Spark's writers and Hadoop's file systems, so any shared
place works.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A run with fewer files is incomplete; of the others the newest are kept.
LEAST_FILES, KEEP_RUNS = 10, 5


def file_system(spark: SparkSession, place: str) -> tuple:
    """(Hadoop path, its file system)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_json(frame: DataFrame, place: str) -> None:
    """Write records as JSON lines beside ``place``, then put them there: readers see the old or the new ones."""
    spark, beside = frame.sparkSession, f"{place.rstrip('/')}.{uuid.uuid4().hex}"
    frame.write.json(f"{beside}.new")
    path, files = file_system(spark, place)
    old, new = (file_system(spark, f"{beside}.{x}")[0] for x in ("old", "new"))
    had = files.exists(path)
    if had and not files.rename(path, old):
        raise OSError(f"cannot move {place}")
    if not files.rename(new, path):
        if had:
            files.rename(old, path)
        raise OSError(f"cannot replace {place}")
    if had:
        files.delete(old, True)


def read_json(spark: SparkSession, place: str, schema: str) -> DataFrame:
    """Records of ``replace_json``; none where nothing was written yet."""
    path, files = file_system(spark, place)
    return spark.read.schema(schema).json(place) if files.exists(path) else spark.createDataFrame([], schema)


def processed(spark: SparkSession, place: str) -> DataFrame:
    """(query) distinct lines of a text file without blanks around them; none without the file."""
    path, files = file_system(spark, place)
    if not files.exists(path):
        return spark.createDataFrame([], "query string")
    return spark.read.text(place).select(F.trim("value").alias("query")).filter("query <> ''").distinct()


def write_run(tables: dict[str, DataFrame], root: str, run: str) -> None:
    """One telemetry run: a folder of JSON files for every table, then the mark that it is complete."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").json(f"{root}/{run}/{name}")
    some = next(iter(tables.values())).sparkSession
    some.createDataFrame([(run, sorted(tables))], "run string, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{root}/{run}/run_meta")


def run_files(spark: SparkSession, root: str) -> DataFrame:
    """(run, files) of the run folders below ``root``."""
    path, files = file_system(spark, root)
    rows = []
    for run in files.listStatus(path) if files.exists(path) else ():
        if run.isDirectory() and run.getPath().getName().startswith("run_"):
            rows.append((run.getPath().getName(), int(files.getContentSummary(run.getPath()).getFileCount())))
    return spark.createDataFrame(rows, "run string, files long")


def retention(runs: DataFrame, least_files: int = LEAST_FILES, keep: int = KEEP_RUNS) -> DataFrame:
    """(run, files, keep): incomplete runs go, and all but the newest of the others."""
    whole = F.col("files") >= least_files
    place = F.row_number().over(Window.partitionBy(whole).orderBy(F.desc("run")))
    return runs.select("run", "files", (whole & (place <= keep)).alias("keep"))


def drop_runs(spark: SparkSession, root: str, least_files: int = LEAST_FILES, keep: int = KEEP_RUNS) -> list[str]:
    """Delete the runs that ``retention`` does not keep; returns their names."""
    gone = sorted(r.run for r in retention(run_files(spark, root), least_files, keep).filter("NOT keep").collect())
    for run in gone:
        path, files = file_system(spark, f"{root}/{run}")
        files.delete(path, True)
    return gone


def mask_secret(value: Column) -> Column:
    """First six and last four characters of a secret; shorter ones are hidden whole."""
    return F.when(F.length(value) > 12, F.concat(F.substring(value, 1, 6), F.lit("..."), F.substring(value, -4, 4))).otherwise(F.when(value.isNotNull(), F.lit("***")))


def settings(lines: DataFrame, line: str = "value") -> DataFrame:
    """(name, value) of ``name=value`` lines: comments, blank lines and lines without a name are left out, quotes around a value go; the last of a name counts."""
    rows = lines.select(F.monotonically_increasing_id().alias("at"), F.trim(line).alias("line")).filter("line NOT LIKE '#%' AND contains(line, '=')")
    name, value = F.trim(F.substring_index("line", "=", 1)), F.trim(F.expr("substring(line, instr(line, '=') + 1)"))
    found = rows.select("at", name.alias("name"), F.regexp_replace(value, r"""^(["'])(.*)\1$""", "$2").alias("value")).filter("name <> ''")
    return found.groupBy("name").agg(F.max_by("value", "at").alias("value"))
