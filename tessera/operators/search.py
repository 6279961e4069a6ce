"""Top-K retrieval: exact, multi-probe, bound-pruned, substring and Hamming strategies.

Query batches are frames of (query_id, q). Ties order by record key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import vectors as V

#: Query vectors that one pass of the exact search ships to the tasks.
QUERY_BLOCK = 20_000
#: Bytes of the scores that a task holds at a time, and records of a batch.
TILE_BYTES, BATCH = 16 << 20, 4096
#: Segments of the directory that may be broadcast.
BROADCAST_ROWS = 1 << 16
#: Queries and items (records or extents) of a cell.
CELL_QUERIES, CELL_ITEMS = 8_192, 16_384


def top_k(scored: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """The k best of each query with their rank; prunes before the shuffle (WindowGroupLimit)."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def matrix(column) -> np.ndarray:
    """The rows of an Arrow column of vectors, as they are stored."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def products(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats whose products are exact: single where all sums of these whole numbers stay below 2**24, else double."""
    most = float(np.abs(q).max(initial=1)) * float(np.abs(x).max(initial=1)) * x.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64
    return q.astype(kind, copy=False), x.astype(kind, copy=False)


def firsts(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest of every row; of equal ones those further left."""
    n = scores.shape[1]
    if n <= k:
        return np.divmod(np.arange(scores.size), max(1, n))
    step, columns = max(1, (1 << 20) // n), []
    for at in range(0, len(scores), step):
        value = scores[at : at + step].astype(np.int64) * n - np.arange(n)
        columns.append(np.argpartition(value, n - k, axis=1)[:, n - k :])
    return np.repeat(np.arange(len(scores)), k), np.concatenate(columns).ravel() if columns else np.zeros(0, np.int64)


class Best:
    """The k best (score, key) of every query seen so far, ties by key."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.key = k, np.full((queries, 0), 0, np.int64), np.empty((queries, 0), object)

    def add(self, tile: slice, scores: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best of a tile's queries among what it had and new scores of ``keys``.

        Once a query has k, only what reaches its last one is looked at; where that is
        much, as with many equal vectors, the k first of the new ones.
        """
        held, names = self.score[tile], self.key[tile]
        if not scores.size:
            return held, names
        if (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys, kind="stable")
            scores, keys = scores[:, order], keys[order]
        had, n, rows = held.shape[1], scores.shape[1], None
        if had == self.k:
            reach = scores >= held[:, -1:].astype(scores.dtype)
            if np.count_nonzero(reach) <= 4 * self.k * len(scores):
                rows, column = np.nonzero(reach)
        if rows is None:
            rows, column = firsts(scores, self.k)
        values, found = scores[rows, column].astype(np.int64), keys[column]
        touched, rows = np.unique(rows, return_inverse=True)
        if had:
            rows = np.r_[np.repeat(np.arange(len(touched)), had), rows]
            values, found = np.r_[held[touched].ravel(), values], np.concatenate([names[touched].ravel(), found])
        place = np.unique(found, return_inverse=True)[1] if found.dtype == object else found
        order = np.lexsort((place, -values, rows))
        keep = order[np.arange(len(rows)) - np.searchsorted(rows[order], rows[order]) < self.k]
        width = min(self.k, had + n)
        values, found = values[keep].reshape(-1, width), found[keep].reshape(-1, width)
        if len(touched) == len(held):
            return values, found
        held, names = held.copy(), names.copy()
        held[touched], names[touched] = values, found
        return held, names


def exact_knn(queries: DataFrame, records: DataFrame, k: int, key: str = "vec_id", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, key, score, rank) over all records.

    Queries go to the tasks in blocks of a fixed number. A task multiplies its batches
    with tiles of a block (``TILE_BYTES`` of scores at a time, exact whole numbers)
    and keeps the k best of each query, so what is shuffled is k rows per query and task.
    """
    total = queries.count()
    parts = max(1, -(-total // query_block))
    dealt = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    out = None
    for n in range(parts):
        block = (dealt.filter(F.col("part") == n) if parts > 1 else queries).select("query_id", "q").toArrow()
        if not block.num_rows:
            continue
        ship = queries.sparkSession.sparkContext.broadcast((block["query_id"].to_numpy(), matrix(block["q"])))
        del block

        def best(batches, ship=ship):
            ids, q = ship.value
            step = max(1, TILE_BYTES // (8 * BATCH))
            tiles = [slice(at, at + step) for at in range(0, len(ids), step)]
            kept = Best(len(ids), k)
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH):
                    part = batch.slice(at, BATCH)
                    keys = part.column(0).to_numpy(zero_copy_only=False)
                    q, x = products(q, matrix(part.column(1)))
                    order = np.argsort(keys, kind="stable")
                    keys, x = keys[order], x[order]
                    found = [kept.add(tile, q[tile] @ x.T, keys) for tile in tiles]
                    kept.score, kept.key = np.concatenate([s for s, _ in found]), np.concatenate([n for _, n in found])
            width = kept.score.shape[1]
            for at in range(0, len(ids) if width else 0, 65_536):
                part = slice(at, at + 65_536)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[part], width)), pa.array(kept.key[part].ravel()), pa.array(kept.score[part].ravel())], ["query_id", key, "score"])

        found = records.select(key, "v").mapInArrow(best, f"query_id long, {key} {records.schema[key].dataType.simpleString()}, score long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = queries.select("query_id").join(records.select(key), F.lit(False)).withColumn("score", F.lit(0).cast("long"))
    return top_k(out, k, key)


def count_ahead(queries: DataFrame, records: DataFrame, key: str = "vec_id", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, ahead): records that come before a given one, from queries (query_id, q, score, key).

    A record is ahead if it scores higher, or the same with a smaller key; the query's
    own record does not count. A task sends on one number for every query.
    """
    total = queries.count()
    parts = max(1, -(-total // query_block))
    dealt = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    out = None
    for n in range(parts):
        block = dealt.filter(F.col("part") == n).select("query_id", "q", "score", F.col(key).alias("best")).toPandas()
        if block.empty:
            continue
        ship = queries.sparkSession.sparkContext.broadcast((block["query_id"].to_numpy(), np.stack(block["q"].to_numpy()).astype(np.float64), block["score"].to_numpy(), block["best"].to_numpy()))

        def count(frames, ship=ship):
            ids, q, score, mine = ship.value
            ahead, step = np.zeros(len(ids), np.int64), max(1, TILE_BYTES // (8 * BATCH))
            for frame in frames:
                for at in range(0, len(frame), BATCH):
                    keys, x = frame[key].to_numpy()[at : at + BATCH], np.stack(frame["v"].to_numpy()[at : at + BATCH]).astype(np.float64)
                    for t in range(0, len(ids), step):
                        tile = slice(t, t + step)
                        found, limit = q[tile] @ x.T, score[tile, None]
                        before = (found > limit) | (found == limit) & (keys[None, :] < mine[tile, None])
                        ahead[tile] += (before & (keys[None, :] != ids[tile, None])).sum(1)
            yield pd.DataFrame({"query_id": ids, "ahead": ahead})

        found = records.select(key, "v").mapInPandas(count, "query_id long, ahead long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.select("query_id", F.lit(0).cast("long").alias("ahead"))
    return out.groupBy("query_id").agg(F.sum("ahead").alias("ahead"))


def probe_margins(queries: DataFrame, planes: np.ndarray, centre: np.ndarray | None = None) -> DataFrame:
    """(query_id, plane, bit, margin): side and distance of a query for every plane through the centre."""
    norms = np.sqrt((planes.astype(np.float64) ** 2).sum(1)).tolist()
    lengths = F.array(*[F.lit(x) for x in norms])
    sides = queries.select("query_id", F.posexplode(V.projections(planes, centre)("q")).alias("plane", "product"))
    return sides.select("query_id", "plane", (F.col("product") >= 0).cast("int").alias("bit"), (F.abs("product") / F.element_at(lengths, F.col("plane") + 1)).alias("margin"))


def inner(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sized(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A frame as a broadcast side if it has few rows, else as it is."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def whole(frame: DataFrame) -> DataFrame:
    """A frame that a join shuffles: tables that grow with the queries are small as files, yet not once read, so no broadcast may be made of them."""
    return frame.hint("merge")


def probe_plan(queries: DataFrame, planes: np.ndarray, directory: DataFrame, config: Config, probes: int, centre: np.ndarray | None = None) -> DataFrame:
    """(query_id, segment_id, probe_no): segments to visit, in order.

    Class 0 is the query's own segment, always kept; then segments one and two bits
    away by margin rank; then the rest by the bound of their first extent. All but
    the first must hold records. The neighbours, 1 + b + b (b - 1) / 2 of b bits, are
    generated; only queries that find too few records' segments among them look at
    the rest of the directory.
    """
    bits = config.segment_bits
    margins = probe_margins(queries, planes, centre).filter(F.col("plane") < bits)
    ranked = margins.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("margin", "plane")))
    base = ranked.groupBy("query_id").agg(
        F.sum(F.col("bit") * F.pow(F.lit(2.0), F.col("plane").cast("double")).cast("long")).alias("base"),
        F.transform(F.array_sort(F.collect_list(F.struct("r", "plane"))), lambda t: F.pow(F.lit(2.0), t["plane"].cast("double")).cast("long")).alias("flips"),
    )
    first = directory.filter("extent_no = 0").select("segment_id", "centroid", "max_radius")
    held = sized(first.select("segment_id", F.lit(True).alias("held")))
    one = [(a, a, 1) for a in range(1, bits + 1)]
    two = [(a, b, 2) for a in range(1, bits + 1) for b in range(a + 1, bits + 1)]
    steps = F.array(*[F.struct(F.lit(a).alias("k1"), F.lit(b).alias("k2"), F.lit(c).alias("cls")) for a, b, c in [(0, 0, 0), *one, *two]])
    near = base.select("query_id", "base", "flips", F.explode(steps).alias("s"))
    flip = F.when(F.col("s.cls") == 0, 0).when(F.col("s.cls") == 1, F.expr("flips[s.k1 - 1]")).otherwise(F.expr("flips[s.k1 - 1] + flips[s.k2 - 1]"))
    near = near.select("query_id", F.col("base").bitwiseXOR(flip.cast("long")).cast("int").alias("segment_id"), "s.cls", "s.k1", F.when(F.col("s.cls") == 2, F.col("s.k2")).otherwise(0).alias("k2"), F.lit(0.0).alias("k3"))
    near = near.join(held, "segment_id", "left").filter("cls = 0 OR held").select("query_id", "segment_id", "cls", "k1", "k2", "k3")
    if probes > 1:
        short = near.groupBy("query_id").count().filter(F.col("count") < probes).select("query_id")
        asked = base.join(short, "query_id").join(queries, "query_id").select("query_id", "base", "q")
        bound = inner("q", "centroid") + V.norm("q") * F.col("max_radius")
        rest = asked.join(sized(first), F.bit_count(F.col("segment_id").cast("long").bitwiseXOR(F.col("base"))) > 2)
        near = near.unionByName(rest.select("query_id", "segment_id", F.lit(3).alias("cls"), F.lit(0).alias("k1"), F.lit(0).alias("k2"), (-F.round(bound, 6)).alias("k3")))
    order = Window.partitionBy("query_id").orderBy("cls", "k1", "k2", "k3", "segment_id")
    return near.withColumn("probe_no", F.row_number().over(order)).filter(F.col("probe_no") <= probes).select("query_id", "segment_id", "probe_no")


def in_cells(reach: DataFrame, items: DataFrame, block: str, work, kind: str, asked: int = CELL_QUERIES, held: int = CELL_ITEMS) -> DataFrame:
    """``work(queries, items)``, two Arrow tables, for the cells of every segment.

    The rows of ``reach`` (a query and a segment) and the items of a segment are dealt
    to blocks of some fixed size; a cell is a block of queries and one of items, so
    every pair meets once, and neither a large segment nor a hot one is one task.
    Items with the same ``block`` column stay together.
    """
    across = reach.groupBy("segment_id").agg(F.ceil(F.count(F.lit(1)) / asked).cast("int").alias("across"))
    down = items.groupBy("segment_id").agg(F.ceil(F.count(F.lit(1)) / held).cast("int").alias("down"))
    cells = sized(across.join(down, "segment_id"))
    left = reach.join(cells, "segment_id").withColumn("row", F.pmod(F.xxhash64("query_id"), F.col("across"))).withColumn("column", F.explode(F.sequence(F.lit(0).cast("int"), F.col("down") - 1)))
    right = items.join(cells, "segment_id").withColumn("column", F.pmod(F.xxhash64(block), F.col("down"))).withColumn("row", F.explode(F.sequence(F.lit(0).cast("int"), F.col("across") - 1)))
    at = [F.col("segment_id"), F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column")]
    left, right = left.select(*at, *[c for c in reach.columns if c != "segment_id"]), right.select(*at, *[c for c in items.columns if c != "segment_id"])
    names = ["segment_id", "row", "column"]
    return left.groupBy(*names).cogroup(right.groupBy(*names)).applyInArrow(work, kind)


def tiles(count: int, width: int):
    step = max(1, TILE_BYTES // (8 * max(1, width)))
    return [slice(at, min(count, at + step)) for at in range(0, count, step)]


def rows_of(kind: pa.Schema, found: list[list[np.ndarray]]) -> pa.Table:
    """One table of the columns of several pieces."""
    return pa.Table.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*found), kind.types)], schema=kind) if found else kind.empty_table()


def probe_topk(queries: DataFrame, plan: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """The k best of each query among the records of its planned segments; a cell sends on k rows a query."""
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def work(asked, held):
        if not asked.num_rows or not held.num_rows:
            return kind.empty_table()
        ids, keys = asked["query_id"].to_numpy(), held["vec_id"].to_numpy()
        q, x = products(matrix(asked["q"]), matrix(held["v"]))
        order, found = np.argsort(keys, kind="stable"), []
        keys, x = keys[order], x[order]
        for tile in tiles(len(ids), BATCH):
            kept = Best(len(ids[tile]), k)
            for at in range(0, len(keys), BATCH):
                kept.score, kept.key = kept.add(slice(None), q[tile] @ x[at : at + BATCH].T, keys[at : at + BATCH])
            found.append([np.repeat(ids[tile], kept.score.shape[1]), kept.key.ravel(), kept.score.ravel()])
        return rows_of(kind, found)

    reach = plan.select("query_id", "segment_id").join(whole(queries.select("query_id", "q")), "query_id")
    return top_k(in_cells(reach, records.select("segment_id", "vec_id", "v"), "vec_id", work, "query_id long, vec_id long, score long"), k)


def bounds_of(asked: pa.Table, held: pa.Table, tile: slice, q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, whether scored) of a tile's queries and all extents; queries without a floor have all scored."""
    x = q[tile]
    bound = x @ centroids.T + np.sqrt((x * x).sum(1))[:, None] * held["max_radius"].to_numpy()[None, :]
    floor = asked["floor"].to_numpy(zero_copy_only=False).astype(np.float64)[tile, None]
    return bound, np.isnan(floor) | (asked["probe_no"].to_numpy()[tile, None] == 1) | (bound + 1e-6 >= floor)


def floors(queries: DataFrame, plan: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """(query_id, segment_id, probe_no, q, floor): the planned segments with the k-th best score of the query's own segment, null where that has fewer."""
    own = probe_topk(queries, plan.filter("probe_no = 1"), records, k)
    floor = own.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    return plan.join(whole(floor), "query_id", "left").join(whole(queries.select("query_id", "q")), "query_id").select("query_id", "segment_id", "probe_no", "q", "floor")


def visits(reach: DataFrame, directory: DataFrame) -> DataFrame:
    """Every query and planned extent with its bound and whether it is scored, a row each, in small cells."""
    kind = pa.schema([("query_id", pa.int64()), ("segment_id", pa.int32()), ("extent_no", pa.int32()), ("probe_no", pa.int32()), ("record_count", pa.int64()), ("bound", pa.float64()), ("is_scored", pa.bool_())])

    def work(asked, held):
        found, n = [], held.num_rows
        if not asked.num_rows or not n:
            return kind.empty_table()
        q, centroids = matrix(asked["q"]).astype(np.float64), matrix(held["centroid"])
        each = [asked[c].to_numpy() for c in ("query_id", "segment_id", "probe_no")]
        extents = [held[c].to_numpy() for c in ("extent_no", "record_count")]
        for tile in tiles(len(q), n):
            bound, scored = bounds_of(asked, held, tile, q, centroids)
            ids, segments, probes = (np.repeat(c[tile], n) for c in each)
            numbers, counts = (np.tile(c, len(bound)) for c in extents)
            found.append([ids, segments, numbers, probes, counts, bound.ravel(), scored.ravel()])
        return rows_of(kind, found)

    extents = directory.select("segment_id", "extent_no", "record_count", "centroid", "max_radius")
    return in_cells(reach, extents, "extent_no", work, "query_id long, segment_id int, extent_no int, probe_no int, record_count long, bound double, is_scored boolean", 512, 1024)


def extent_bounds(queries: DataFrame, plan: DataFrame, directory: DataFrame) -> DataFrame:
    """q . centroid + |q| radius of every query and planned extent: no record of it scores higher."""
    reach = plan.join(whole(queries.select("query_id", "q")), "query_id").withColumn("floor", F.lit(None).cast("long"))
    return visits(reach, directory).drop("is_scored")


def visit_counts(reach: DataFrame, directory: DataFrame) -> DataFrame:
    """(query_id, candidates, scored, bypassed_extents) of ``visits``, added up where the bounds are: a cell sends on a row a query."""
    names = ["candidates", "scored", "bypassed_extents"]
    kind = pa.schema([(c, pa.int64()) for c in ["query_id", *names]])

    def work(asked, held):
        if not asked.num_rows or not held.num_rows:
            return kind.empty_table()
        q, centroids = matrix(asked["q"]).astype(np.float64), matrix(held["centroid"])
        ids, counts, found = asked["query_id"].to_numpy(), held["record_count"].to_numpy(), []
        for tile in tiles(len(q), len(counts)):
            scored = bounds_of(asked, held, tile, q, centroids)[1]
            found.append([ids[tile], np.full(len(scored), counts.sum()), scored @ counts, (~scored).sum(1)])
        return rows_of(kind, found)

    extents = directory.select("segment_id", "extent_no", "record_count", "centroid", "max_radius")
    some = in_cells(reach, extents, "extent_no", work, "query_id long, candidates long, scored long, bypassed_extents long")
    return some.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in names])


def bounded_hits(reach: DataFrame, records: DataFrame, directory: DataFrame, k: int) -> DataFrame:
    """Top k from the extents that no bound skips; extents come to the cells with their records."""
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def work(asked, items):
        records, extents = items.filter(items["v"].is_valid()), items.filter(items["centroid"].is_valid()).sort_by("extent_no")
        if not asked.num_rows or not records.num_rows:
            return kind.empty_table()
        ids, keys = asked["query_id"].to_numpy(), records["vec_id"].to_numpy()
        floor = np.nan_to_num(asked["floor"].to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
        whole, centroids = matrix(asked["q"]).astype(np.float64), matrix(extents["centroid"])
        q, x = products(matrix(asked["q"]), matrix(records["v"]))
        order, found = np.argsort(keys, kind="stable"), []
        home = np.searchsorted(extents["extent_no"].to_numpy(), records["extent_no"].to_numpy())[order]
        keys, x = keys[order], x[order]
        for tile in tiles(len(ids), max(BATCH, len(centroids))):
            wanted = np.flatnonzero(bounds_of(asked, extents, tile, whole, centroids)[1].any(0)[home])
            kept = Best(len(ids[tile]), k)
            for at in range(0, len(wanted), BATCH):
                part = wanted[at : at + BATCH]
                kept.score, kept.key = kept.add(slice(None), q[tile] @ x[part].T, keys[part])
            reached = kept.score >= floor[tile, None]
            found.append([np.repeat(ids[tile], reached.sum(1)), kept.key[reached].astype(np.int64), kept.score[reached]])
        return rows_of(kind, found)

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    items = records.select("segment_id", "extent_no", "vec_id", "v", none("array<double>", "centroid"), none("double", "max_radius"))
    items = items.unionByName(directory.select("segment_id", "extent_no", none("long", "vec_id"), none("array<int>", "v"), "centroid", "max_radius"))
    return top_k(in_cells(reach, items, "extent_no", work, "query_id long, vec_id long, score long"), k)


def bounded_topk(queries: DataFrame, plan: DataFrame, records: DataFrame, directory: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(top k, visited extents with whether they were scored).

    The k-th best score of the query's own segment is a floor; planned extents whose
    bound is below it are skipped. The result equals the unpruned one.
    """
    reach = floors(queries, plan, records, k)
    return bounded_hits(reach, records, directory, k), visits(reach, directory)


class Engine:
    """One interface over the strategies: ``search(queries, k)`` gives (query_id, vec_id, score, rank), ``stats()`` the size of the index."""

    def __init__(self, index, config: Config, probes: int = 4):
        self.index, self.config, self.probes = index, config, probes

    def search(self, queries: DataFrame, k: int, strategy: str = "probe") -> DataFrame:
        if strategy not in ("exact", "probe", "bounded", "hamming"):
            raise ValueError(f"unknown strategy {strategy}")
        ix = self.index
        if strategy == "exact":
            return exact_knn(queries, ix.vectors, k)
        if strategy == "hamming":
            return exact_knn(queries.withColumn("q", V.signs("q")), ix.vectors.withColumn("v", V.signs("v")), k)
        plan = probe_plan(queries, ix.planes, ix.directory, self.config, self.probes, ix.centre)
        if strategy == "bounded":
            return bounded_topk(queries, plan, ix.records, ix.directory, k)[0]
        return probe_topk(queries, plan, ix.records, k)

    def stats(self) -> DataFrame:
        """Extents, records, segments with records and bytes of the vectors."""
        d = self.index.directory
        return d.agg(F.count(F.lit(1)).alias("extents"), F.sum("record_count").alias("records"), F.countDistinct("segment_id").alias("segments"), (F.sum("record_count") * self.index.dimension).alias("vector_bytes"))
