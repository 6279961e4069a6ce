"""The build job: files in, the next generation of an index out.

``build`` compares the files with the catalog of the current generation, reads and
chunks what is new or modified, routes the chunks' vectors and writes records,
directory, substring table, planes and catalog as the next generation. Tombstones
(deleted and modified files, and documents that the caller deletes) make it compact:
live records are dealt to fresh extents together with the new ones. Otherwise new
records get extents after the last ones of their segments.

Defined results: a file without text gets no document; equal files in two folders
are two documents; without any change nothing is written and the current generation
is returned; a lost executor costs its tasks only, as every step reads tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import index, lifecycle
from tessera.session import Scratch

CATALOG = "doc_id long, filename string, file_size long, last_write_time long, page_count long, chunk_count long, is_deleted boolean"


def numbered(frame: DataFrame, scratch: Scratch, first: int, name: str = "doc_id") -> DataFrame:
    """``frame`` with consecutive numbers from ``first``: the counts of the partitions are added up, no row is moved."""
    mark = F.monotonically_increasing_id()
    rows = scratch.save(frame.withColumn("_part", F.shiftright(mark, 33)).withColumn("_at", mark.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    counts = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, now = [], first
    for part in sorted(counts):
        starts.append((part, now))
        now += counts[part]
    offsets = frame.sparkSession.createDataFrame(starts, "_part long, _start long")
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def build(
    spark: SparkSession,
    root: str,
    listing: DataFrame,
    read_pages: Callable[[DataFrame], DataFrame],
    embed: Callable[[Column], Column],
    planes: np.ndarray,
    centre: np.ndarray,
    time_ns: int,
    config: Config = Config(),
    rebuild: bool = False,
    compact: bool = False,
    delete: Iterable[int] = (),
) -> int:
    """The generation that holds the files of ``listing`` (filename, file_size, last_write_time).

    ``read_pages`` turns rows of the listing into (filename, page_num, text); ``embed``
    turns a text column into integer vectors.
    """
    scratch = Scratch(spark, "build")
    now = lifecycle.current(spark, root)
    known = bool(now) and not rebuild
    catalog = lifecycle.open_table(spark, root, "catalog") if known else spark.createDataFrame([], CATALOG)
    delete = list(delete)
    if delete:
        catalog = lifecycle.delete_documents(catalog, spark.createDataFrame([(d,) for d in delete], "doc_id long"))
    status = scratch.save(lifecycle.sync_diff(catalog, listing), "status")
    gone, pending = status.filter("tombstoned").select("doc_id"), status.filter("pending").select("filename")
    tombstones, fresh = bool(delete) or bool(gone.limit(1).count()), bool(pending.limit(1).count())
    if known and not (tombstones or fresh or compact):
        scratch.drop()
        return now
    catalog = lifecycle.delete_documents(catalog, gone)
    first = catalog.agg(F.max("doc_id").alias("m")).first().m
    files = scratch.save(numbered(listing.join(pending, "filename"), scratch, 0 if first is None else first + 1), "files")

    pages = read_pages(files.select("filename", "file_size", "last_write_time")).join(files.select("filename", "doc_id"), "filename")
    pages = scratch.save(pages.select("doc_id", "page_num", "text"), "pages")
    chunks = T.windows_of(T.carried_pages(pages, "doc_id", "page_num", "text"), ["doc_id", "page_num"])
    new = chunks.select("doc_id", "page_num", "chunk_no", F.format_string("%019d/%09d/%09d", "doc_id", "page_num", "chunk_no").alias("chunk_id"), "chunk", embed(F.col("chunk")).alias("v"))
    new = new.withColumn("signature", V.signature(planes, centre)("v")).withColumn("segment_id", F.col("signature").bitwiseAND(F.lit(config.segments - 1)).cast("int"))
    new = scratch.save(new, "new")

    counts = new.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count")).join(pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count")), "doc_id")
    added = files.join(counts, "doc_id").select("doc_id", "filename", "file_size", "last_write_time", "page_count", "chunk_count", F.lit(False).alias("is_deleted"))
    catalog = scratch.save(catalog.unionByName(added), "catalog")

    columns = ["chunk_id", "doc_id", "page_num", "chunk_no", "v", "signature", "segment_id"]
    records, texts = new.select(*columns), new.select("chunk_id", "chunk")
    if known:
        old = lifecycle.open_table(spark, root, "records")
        kept = lifecycle.live(old, catalog)
        texts = lifecycle.open_table(spark, root, "texts").join(kept.select("chunk_id"), "chunk_id", "left_semi").unionByName(texts)
        if tombstones or compact:
            records = index.assign_extents(kept.select(*columns).unionByName(records), config, "chunk_id")
        else:
            top = old.groupBy("segment_id").agg((F.max("extent_no") + 1).alias("base"))
            based = records.join(top, "segment_id", "left").withColumn("base", F.coalesce("base", F.lit(0)))
            records = old.unionByName(index.assign_extents(based, config, "chunk_id", base=F.col("base")).select(*columns, "extent_no"))
    else:
        records = index.assign_extents(records, config, "chunk_id")
    records = scratch.save(records, "records")
    directory = scratch.save(index.extent_directory(records), "directory")
    weights = spark.createDataFrame([(-1, [int(x) for x in centre]), *((n, [int(x) for x in row]) for n, row in enumerate(planes))], "plane int, weights array<long>")
    tables = {"records": records, "texts": texts, "directory": directory, "substrings": index.substring_table(records), "planes": weights}
    generation = lifecycle.commit(spark, root, tables, catalog, directory.count(), time_ns)
    scratch.drop()
    return generation
