"""Queries over a catalog, a directory listing and snapshots derived from the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import SMALL
from tessera.operators import index, lifecycle
from tessera.plans.vectors import DIR, REC, Index, open_index
from tessera.session import table
from tessera.sources import state

# Derived tables, in the SQL that both engines speak.
CATALOG = """SELECT doc_id, concat('doc_', CAST(doc_id AS STRING), '.pdf') AS filename, n_chars AS file_size, 1700000000 + doc_id * 3600 AS last_write_time,
 1 + CAST(floor(n_chars / 2000) AS BIGINT) AS page_count, 1 + CAST(floor(n_chars / 400) AS BIGINT) AS chunk_count, doc_id % 10 = 3 AS is_deleted FROM {documents}"""
DISK = """SELECT CASE WHEN doc_id % 10 = 9 THEN concat('new_', CAST(doc_id AS STRING), '.pdf') ELSE concat('doc_', CAST(doc_id AS STRING), '.pdf') END AS filename,
 n_chars + CASE WHEN doc_id % 10 = 5 THEN 1 ELSE 0 END AS file_size, 1700000000 + doc_id * 3600 + CASE WHEN doc_id % 10 = 6 THEN 60 ELSE 0 END AS last_write_time FROM {documents} WHERE doc_id % 10 <> 7"""
MANIFEST = """SELECT CAST(1111769677 AS BIGINT) AS magic, 4 AS version, doc_id + 1 AS generation_id, 1700000000000000000 + doc_id * 1000000007 AS commit_timestamp_ns,
 doc_id * 3 + 10 AS num_documents, doc_id * 2 + 9 AS active_documents, doc_id % 97 AS total_extents FROM {documents}"""


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, documents=table(spark, sf_dir, "documents"))


def catalog(spark, sf_dir):
    return derived(spark, sf_dir, CATALOG)


def catalog_list(spark, sf_dir):
    return catalog(spark, sf_dir).filter("NOT is_deleted").select("doc_id", "filename", "page_count", "chunk_count")


def catalog_totals(spark, sf_dir):
    return catalog(spark, sf_dir).filter("NOT is_deleted").agg(F.count(F.lit(1)).alias("documents"), F.sum("page_count").alias("pages"), F.sum("chunk_count").alias("chunks"))


def doc_catalog(spark, sf_dir):
    """Chunks and distinct segments of every document of the vector corpus."""
    r = open_index(spark, sf_dir).routed.withColumn("doc_id", F.floor(F.col("vec_id") / 10))
    return r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("segment_id").alias("segments"))


def sync_diff(spark, sf_dir):
    return lifecycle.sync_diff(catalog(spark, sf_dir), derived(spark, sf_dir, DISK))


def snapshot_diff(spark, sf_dir):
    old = catalog(spark, sf_dir).select(F.col("filename").alias("path"), F.col("last_write_time").alias("mtime"), F.col("file_size").alias("size"))
    new = derived(spark, sf_dir, DISK).select(F.col("filename").alias("path"), F.col("last_write_time").alias("mtime"), F.col("file_size").alias("size"))
    return lifecycle.snapshot_diff(old, new)


def vector_records(ix: Index) -> DataFrame:
    return ix.records.withColumn("doc_id", F.floor(F.col("vec_id") / 10))


def vector_catalog(ix: Index) -> DataFrame:
    return ix.corpus.select(F.floor(F.col("vec_id") / 10).alias("doc_id")).distinct().withColumn("is_deleted", F.col("doc_id") % 10 == 3)


def tombstone_filter(spark, sf_dir):
    ix = open_index(spark, sf_dir)
    return lifecycle.live(vector_records(ix), vector_catalog(ix)).select("vec_id", "doc_id", "segment_id")


def compact(spark, sf_dir):
    """Live records, routed anew and dealt to fresh extents."""
    ix = open_index(spark, sf_dir)
    kept = lifecycle.live(vector_records(ix), vector_catalog(ix)).select("vec_id", "signature", "segment_id")
    return index.assign_extents(kept, SMALL).select("vec_id", "segment_id", "extent_no")


def extent_append(spark, sf_dir):
    """Odd vectors appended to an index of the even ones: new extents after the last of a segment."""
    ix = open_index(spark, sf_dir)
    old = index.assign_extents(ix.routed.filter("vec_id % 2 = 0"), SMALL)
    top = old.groupBy("segment_id").agg((F.max("extent_no") + 1).alias("base"))
    fresh = ix.routed.filter("vec_id % 2 = 1").join(top, "segment_id", "left").withColumn("base", F.coalesce("base", F.lit(0)))
    added = index.assign_extents(fresh, SMALL, base=F.col("base"))
    return old.select("vec_id", "segment_id", "extent_no").unionByName(added.select("vec_id", "segment_id", "extent_no"))


def delete_doc(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return lifecycle.delete_documents(c, c.filter("doc_id % 7 = 0")).select("doc_id", "is_deleted")


def manifest(spark, sf_dir) -> DataFrame:
    """Manifest rows; the checksum of every 13th is damaged."""
    m = derived(spark, sf_dir, MANIFEST)
    good = lifecycle.checksum(F.col("generation_id"), F.col("commit_timestamp_ns"), F.col("num_documents"), F.col("active_documents"), F.col("total_extents"))
    return m.withColumn("checksum", good + F.when(F.col("generation_id") % 13 == 0, 1).otherwise(0))


def manifest_checksum(spark, sf_dir):
    return manifest(spark, sf_dir).select("generation_id", "checksum")


def manifest_latest(spark, sf_dir):
    return lifecycle.latest(manifest(spark, sf_dir)).select("generation_id", "num_documents", "active_documents")


def run_retention(spark, sf_dir):
    """Runs of a listing: fewer than ten files are dropped, the newest five of the rest are kept."""
    runs = table(spark, sf_dir, "documents").groupBy(F.concat(F.lit("run_"), F.col("source").cast("string")).alias("run")).agg(F.count(F.lit(1)).alias("files"))
    return state.retention(runs)


def index_stats(spark, sf_dir):
    ix = open_index(spark, sf_dir)
    d = ix.directory
    return d.agg(F.count(F.lit(1)).alias("extents"), F.sum(F.when(F.col("extent_no") == 0, F.col("record_count"))).alias("primary_chunks"), F.sum("record_count").alias("chunks"), F.countDistinct("segment_id").alias("segments"), (F.count(F.lit(1)) * 131072).alias("bytes"))


RUNS = "WITH runs AS (SELECT concat('run_', CAST(source AS STRING)) AS run, count(*) AS files FROM {documents} GROUP BY source)"
KEEP = " SELECT run, files, files >= 10 AND row_number() OVER (PARTITION BY files >= 10 ORDER BY run DESC) <= 5 AS keep FROM runs"
_CAT = "cat AS (" + CATALOG.format(documents="documents") + ")"
_DISK = "disk AS (" + DISK.format(documents="documents") + ")"
_MAN = "man AS (" + MANIFEST.format(documents="documents") + ")"


def _checksum() -> str:
    c = f"CAST({lifecycle.MAGIC ^ lifecycle.VERSION} AS BIGINT)"
    for w in ("generation_id & 4294967295", "generation_id >> 32", "commit_timestamp_ns & 4294967295", "commit_timestamp_ns >> 32", "num_documents", "active_documents", "total_extents"):
        c = f"(({c} * 31 + ({w})) & 4294967295)"
    return c


_SUM = f"mc AS (SELECT *, {_checksum()} AS good, {_checksum()} + CASE WHEN generation_id % 13 = 0 THEN 1 ELSE 0 END AS checksum FROM man)"
_EXT = "CAST((row_number() OVER (PARTITION BY segment_id ORDER BY signature, vec_id) - 1) // 4 AS INTEGER)"
SQL = {
    "catalog_list": f"WITH {_CAT} SELECT doc_id, filename, page_count, chunk_count FROM cat WHERE NOT is_deleted",
    "catalog_totals": f"WITH {_CAT} SELECT count(*) AS documents, CAST(sum(page_count) AS BIGINT) AS pages, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM cat WHERE NOT is_deleted",
    "doc_catalog": f"WITH {REC} SELECT vec_id // 10 AS doc_id, count(*) AS chunks, count(DISTINCT segment_id) AS segments FROM rec GROUP BY 1",
    "sync_diff": f"""WITH {_CAT}, {_DISK}, s AS (SELECT filename, doc_id, CASE WHEN c.file_size IS NULL THEN 'new' WHEN d.file_size IS NULL THEN 'deleted' WHEN c.file_size = d.file_size AND c.last_write_time = d.last_write_time THEN 'unchanged' ELSE 'modified' END AS status
 FROM (SELECT * FROM cat WHERE NOT is_deleted) c FULL JOIN disk d USING (filename)) SELECT filename, doc_id, status, status IN ('new', 'modified') AS pending, status IN ('modified', 'deleted') AS tombstoned FROM s""",
    "snapshot_diff": f"""WITH {_CAT}, {_DISK}, s AS (SELECT filename AS path, CASE WHEN c.file_size IS NULL THEN 'added' WHEN d.file_size IS NULL THEN 'deleted' WHEN c.file_size <> d.file_size OR c.last_write_time <> d.last_write_time THEN 'modified' END AS change
 FROM cat c FULL JOIN disk d USING (filename)) SELECT * FROM s WHERE change IS NOT NULL""",
    "tombstone_filter": f"WITH {REC} SELECT vec_id, vec_id // 10 AS doc_id, segment_id FROM rec WHERE (vec_id // 10) % 10 <> 3",
    "compact": f"WITH {REC} SELECT vec_id, segment_id, {_EXT} AS extent_no FROM rec WHERE (vec_id // 10) % 10 <> 3",
    "extent_append": f"""WITH {REC}, o AS (SELECT vec_id, segment_id, {_EXT} AS extent_no FROM rec WHERE vec_id % 2 = 0), b AS (SELECT segment_id, max(extent_no) + 1 AS base FROM o GROUP BY 1)
SELECT * FROM o UNION ALL SELECT vec_id, segment_id, CAST(e + coalesce(base, 0) AS INTEGER) FROM (SELECT vec_id, segment_id, {_EXT} AS e FROM rec WHERE vec_id % 2 = 1) LEFT JOIN b USING (segment_id)""",
    "delete_doc": f"WITH {_CAT} SELECT doc_id, is_deleted OR doc_id % 7 = 0 AS is_deleted FROM cat",
    "manifest_checksum": f"WITH {_MAN}, {_SUM} SELECT generation_id, checksum FROM mc",
    "manifest_latest": f"WITH {_MAN}, {_SUM} SELECT generation_id, num_documents, active_documents FROM mc WHERE good = checksum ORDER BY generation_id DESC LIMIT 1",
    "run_retention": (RUNS + KEEP).format(documents="documents"),
    "index_stats": f"WITH {DIR} SELECT count(*) AS extents, CAST(sum(record_count) FILTER (WHERE extent_no = 0) AS BIGINT) AS primary_chunks, CAST(sum(record_count) AS BIGINT) AS chunks, count(DISTINCT segment_id) AS segments, count(*) * 131072 AS bytes FROM ext",
}
QUERIES = {f.__name__: f for f in (catalog_list, catalog_totals, doc_catalog, sync_diff, snapshot_diff, tombstone_filter, compact, extent_append, delete_doc, manifest_checksum, manifest_latest, run_retention, index_stats)}
