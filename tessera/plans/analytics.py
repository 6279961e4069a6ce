"""Workload analytics over the probe log of the vector queries, and ingest windows over events.

The log has a row for every query, in query order, with the segments it probed;
its times are whole-number functions of the ids, so both engines see the same log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.vectors import PLAN, open_index, segment_counts
from tessera.session import table

#: Edges of the storage and access classes of the heat map; the last class is open.
SIZE_EDGES, HIT_EDGES = (1, 2, 3, 5), (1, 2, 3, 5)
CHECKPOINTS, STEPS = (10, 20, 40), (5, 10, 20, 25, 50, 100)


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    ix = open_index(spark, sf_dir)
    hits = ix.plan().withColumn("query_idx", (F.col("query_id") / 20).cast("long") + 1)
    seg = segment_counts(ix)
    log = hits.join(seg, "segment_id").groupBy("query_idx").agg(F.count(F.lit(1)).alias("probes"), F.sum("n").alias("records_scored"))
    latency = F.when(F.col("query_idx") % 11 == 0, F.lit(0.0)).otherwise((F.col("query_idx") * 37 % 50 + 5).cast("double"))
    log = log.select("query_idx", "probes", "records_scored", latency.alias("total_latency_ms"), (128.0 * F.col("probes")).alias("bulk_io_kb"), (F.col("query_idx") % 7 != 0).alias("success"), (F.col("query_idx") * 13 % 29).cast("double").alias("disk_ms"))
    return {"hits": hits, "seg": seg.select("segment_id", F.col("n").cast("long").alias("n")), "log": log}


_FRAMES = f"""{PLAN}, seg AS (SELECT CAST(g AS INTEGER) AS segment_id, count(rec.vec_id) AS n FROM (SELECT unnest(range(0, 256)) AS g) LEFT JOIN rec ON rec.segment_id = g GROUP BY g),
hits AS MATERIALIZED (SELECT *, query_id // 20 + 1 AS query_idx FROM plan),
log AS MATERIALIZED (SELECT query_idx, probes, records_scored, CASE WHEN query_idx % 11 = 0 THEN 0.0 ELSE CAST(query_idx * 37 % 50 + 5 AS DOUBLE) END AS total_latency_ms, CAST(128.0 * probes AS DOUBLE) AS bulk_io_kb, query_idx % 7 <> 0 AS success, CAST(query_idx * 13 % 29 AS DOUBLE) AS disk_ms
 FROM (SELECT query_idx, count(*) AS probes, CAST(sum(n) AS BIGINT) AS records_scored FROM hits JOIN seg USING (segment_id) GROUP BY 1))"""

_ACCESS = "acc AS (SELECT s.segment_id, max(s.n) AS n, count(h.query_idx) AS a, CAST(sum(CASE WHEN h.probe_no = 1 THEN 1 ELSE 0 END) AS BIGINT) AS p FROM {seg} s LEFT JOIN {hits} h ON s.segment_id = h.segment_id GROUP BY s.segment_id)"


def _bin(column: str, edges) -> str:
    return "CASE " + " ".join(f"WHEN {column} < {e} THEN {i}" for i, e in enumerate(edges)) + f" ELSE {len(edges)} END"


def _values(name: str, column: str, values) -> str:
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT CAST({v} AS BIGINT) AS {column}" for v in values) + ")"


#: One text for both engines; braces name the frames.
COMMON = {
    "segment_access": f"WITH {_ACCESS} SELECT segment_id, a AS accesses, p AS primary_accesses FROM acc",
    "storage_vs_access": f"WITH {_ACCESS} SELECT segment_id, n AS stored, a AS accesses FROM acc",
    "storage_access_corr": f"WITH {_ACCESS} SELECT round(regr_slope(a, n), 6) AS slope, round(regr_intercept(a, n), 6) AS intercept, round(corr(a, n), 6) AS r, CAST(sum(CASE WHEN a = 0 THEN 1 ELSE 0 END) AS BIGINT) AS cold, round(100e0 * sum(CASE WHEN n > 3 THEN a ELSE 0 END) / sum(a), 4) AS large_share FROM acc",
    "storage_access_heatmap": f"WITH {_ACCESS}, {_values('gx', 'x', range(len(SIZE_EDGES) + 1))}, {_values('gy', 'y', range(len(HIT_EDGES) + 1))}, b AS (SELECT {_bin('n', SIZE_EDGES)} AS bx, {_bin('a', HIT_EDGES)} AS bw FROM acc) SELECT x AS size_class, y AS hit_class, count(bx) AS segments FROM gx CROSS JOIN gy LEFT JOIN b ON b.bx = gx.x AND b.bw = gy.y GROUP BY x, y",
    "hotspot_shares": f"""WITH {_values('cp', 'k', CHECKPOINTS)}, h AS (SELECT k, segment_id, count(*) AS c FROM cp JOIN {{hits}} h ON h.query_idx <= cp.k GROUP BY k, segment_id),
r AS (SELECT k, segment_id, c, row_number() OVER (PARTITION BY k ORDER BY c DESC, segment_id) AS place FROM h)
SELECT k AS checkpoint, round(100e0 * sum(CASE WHEN place <= 5 THEN c ELSE 0 END) / sum(c), 4) AS top5, round(100e0 * sum(CASE WHEN place <= 20 THEN c ELSE 0 END) / sum(c), 4) AS top20, round(100e0 * sum(CASE WHEN segment_id < 128 THEN c ELSE 0 END) / sum(c), 4) AS lower_half, 256 - count(*) AS cold FROM r GROUP BY k""",
    "latency_by_hotness": f"""WITH {_ACCESS}, hot AS (SELECT segment_id FROM (SELECT segment_id, row_number() OVER (ORDER BY a DESC, segment_id) AS place FROM acc) WHERE place <= 15),
q AS (SELECT l.query_idx, l.total_latency_ms, count(t.segment_id) AS hot_probes FROM {{log}} l JOIN {{hits}} h ON l.query_idx = h.query_idx LEFT JOIN hot t ON t.segment_id = h.segment_id GROUP BY l.query_idx, l.total_latency_ms)
SELECT hot_probes, count(*) AS queries, round(avg(total_latency_ms), 6) AS mean_ms FROM q GROUP BY hot_probes""",
    "workload_scaling": f"""WITH {_values('st', 's', STEPS)}, n AS (SELECT count(*) AS total FROM {{log}}), ks AS (SELECT DISTINCT least(s, total) AS k FROM st CROSS JOIN n),
g AS (SELECT k, coalesce(avg(CASE WHEN total_latency_ms > 0 THEN total_latency_ms END), 20.0) AS mean, sum(total_latency_ms) AS total_ms, sum(bulk_io_kb) AS kb, CAST(sum(probes) AS BIGINT) AS extents FROM ks JOIN {{log}} l ON l.query_idx <= ks.k GROUP BY k)
SELECT k AS prompts, round(total_ms / 1000, 3) AS cumulative_s, round(mean, 2) AS mean_ms, round(1000 / mean, 1) AS qps, round(kb / 1024, 2) AS cumulative_mb, extents FROM g""",
    "compare_runs": """WITH b AS (SELECT query_idx, total_latency_ms AS a_ms, total_latency_ms + CASE WHEN query_idx % 2 = 0 THEN 3 ELSE -1 END AS b_ms, success FROM {log})
SELECT count(*) AS queries, round(avg(a_ms), 6) AS a_mean, round(avg(b_ms), 6) AS b_mean, round(avg(b_ms) - avg(a_ms), 6) AS gap, CAST(sum(CASE WHEN b_ms < a_ms THEN 1 ELSE 0 END) AS BIGINT) AS b_wins FROM b""",
}


def bench_summary(spark, sf_dir):
    """Latency of the queries that succeeded; percentiles by place, from counts of the distinct times."""
    ok = frames(spark, sf_dir)["log"].filter("success")
    by_time = ok.groupBy("total_latency_ms").agg(F.count(F.lit(1)).alias("c"))
    total = ok.agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.avg("total_latency_ms"), 6).alias("mean_ms"),
        F.round(F.median("total_latency_ms"), 6).alias("p50"),
        F.max("total_latency_ms").alias("p99"),
        F.round(F.avg(F.when(F.col("disk_ms") > 0, F.col("disk_ms"))), 6).alias("mean_disk"),
        F.round(F.avg("bulk_io_kb"), 6).alias("mean_io"),
    )
    # the time at a place: the least one with so many at or below it
    below = by_time.alias("a").join(by_time.alias("b"), F.col("b.total_latency_ms") <= F.col("a.total_latency_ms")).groupBy(F.col("a.total_latency_ms").alias("ms")).agg(F.sum("b.c").alias("reach"))
    at = lambda p: F.min(F.when(F.col("reach") >= F.floor(F.col("queries") * p) + 1, F.col("ms")))
    places = below.crossJoin(F.broadcast(total.select("queries"))).agg(at(0.9).alias("p90"), at(0.95).alias("p95"))
    return total.crossJoin(places).select("queries", "mean_ms", "p50", "p90", "p95", "p99", "mean_disk", "mean_io")


def common(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(COMMON[name], **{k: v for k, v in frames(spark, sf_dir).items() if f"{{{k}}}" in COMMON[name]})

    run.__name__ = name
    return run


def prompt_variations(spark, sf_dir):
    """Every benchmark question with every suffix."""
    suffixes = spark.createDataFrame([(i, s) for i, s in enumerate(SUFFIXES)], "n int, suffix string")
    return table(spark, sf_dir, "benchmark").crossJoin(F.broadcast(suffixes)).select("item_id", "n", F.md5(F.concat(F.trim("text"), F.lit(" "), F.col("suffix"))).alias("digest"))


SUFFIXES = ("in practice", "and its limits", "compared with other methods", "on large data", "step by step", "with examples", "in recent work", "for beginners")


def log_lines(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.format_string("[Rank %d] Score: %d | Document: doc_%d.pdf (Page %d)", "rank", "score", (F.col("vec_id") / 10).cast("long"), (F.col("vec_id") % 10).cast("long")).alias("line"))


def parse_log(lines: DataFrame) -> DataFrame:
    """Rank, score, file and page of ranked result lines."""
    pattern = r"\[Rank (\d+)\] Score: (-?\d+) \| Document: (.+) \(Page (\d+)\)"
    part = lambda i: F.regexp_extract("line", pattern, i)
    return lines.filter(F.col("line").rlike(pattern)).select("query_id", part(1).cast("int").alias("rank"), part(2).cast("long").alias("score"), part(3).alias("filename"), part(4).cast("long").alias("page"))


def log_parse(spark, sf_dir):
    from tessera.plans.vectors import probe_topk

    return parse_log(log_lines(probe_topk(spark, sf_dir)))


def events_tumbling(spark, sf_dir):
    """Events, users and value by type and five-minute window (an extension)."""
    e = table(spark, sf_dir, "events")
    w = F.window(F.col("ts").cast("timestamp"), "5 minutes")
    return e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_timestamp("w.start").alias("window_start"), "event_type", "events", "users", "total")


SUMMARY = """WITH ok AS (SELECT *, row_number() OVER (ORDER BY total_latency_ms) AS r, count(*) OVER () AS n FROM {log} WHERE success)
SELECT max(n) AS queries, round(avg(total_latency_ms), 6) AS mean_ms, round(median(total_latency_ms), 6) AS p50, max(CASE WHEN r = floor(n * 0.9) + 1 THEN total_latency_ms END) AS p90, max(CASE WHEN r = floor(n * 0.95) + 1 THEN total_latency_ms END) AS p95, max(total_latency_ms) AS p99, round(avg(CASE WHEN disk_ms > 0 THEN disk_ms END), 6) AS mean_disk, round(avg(bulk_io_kb), 6) AS mean_io FROM ok"""


def _sql() -> dict[str, str]:
    from tessera.plans import vectors

    out = {}
    for name, text in (COMMON | {"bench_summary": SUMMARY}).items():
        text = text.format(hits="hits", seg="seg", log="log")
        out[name] = f"WITH {_FRAMES}, " + text.removeprefix("WITH ")
    out["prompt_variations"] = "WITH s AS (SELECT unnest([" + ", ".join(f"'{s}'" for s in SUFFIXES) + "]) AS suffix, unnest(range(0, 8)) AS n) SELECT item_id, CAST(n AS INTEGER) AS n, md5(trim(text) || ' ' || suffix) AS digest FROM benchmark, s"
    out["log_parse"] = f"WITH hits AS ({vectors.SQL['probe_topk']}) SELECT query_id, rank, score, 'doc_' || (vec_id // 10) || '.pdf' AS filename, vec_id % 10 AS page FROM hits"
    out["events_tumbling"] = "SELECT CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS window_start, event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
    return out


SQL = _sql()
QUERIES = {name: common(name) for name in COMMON} | {f.__name__: f for f in (bench_summary, prompt_variations, log_parse, events_tumbling)}
