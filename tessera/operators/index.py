"""The vector index: routing, segments, extents and their bounds, the substring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import vectors as V

#: Upper signature bits by which the records of a segment are dealt for numbering.
RANGE_BITS = 12


def dimension_of(corpus: DataFrame, vector: str = "embedding") -> int:
    row = corpus.select(F.size(vector).alias("d")).filter("d > 0").limit(1).first()
    return row.d if row else 1


def int_vectors(corpus: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return corpus.select(key, V.quantize_int8(vector).alias("v"))


def group_sums(records: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """(keys, n, sums): exact sums of the vectors of a group by component.

    Tasks add up their batches first, so a group is one row per batch in the shuffle,
    which adds them component by component.
    """
    types = {c: records.schema[c].dataType.simpleString() for c in keys}
    kind = ", ".join([*(f"{c} {t}" for c, t in types.items()), "n long, sums array<long>"])

    def add(frames):
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame[vector].to_numpy()).astype(np.int64)
            if not keys:
                yield pd.DataFrame({"n": [len(x)], "sums": [x.sum(0)]})
                continue
            groups = frame.groupby(keys, sort=True, dropna=False).ngroup().to_numpy()
            order = np.argsort(groups, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(groups[order]) > 0])
            out = frame[keys].iloc[order[starts]].reset_index(drop=True)
            out["n"] = np.diff(np.r_[starts, len(order)])
            out["sums"] = list(np.add.reduceat(x[order], starts, axis=0))
            yield out

    partial = records.select(*keys, vector).mapInPandas(add, kind)
    dims = partial.select(*keys, "n", F.posexplode("sums").alias("d", "s")).groupBy(*keys, "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return dims.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda t: t["s"]).alias("sums"))


def centre_of(vectors: DataFrame, dimension: int, vector: str = "v") -> np.ndarray:
    """The mean of integer vectors, rounded down by component; zeros without any."""
    row = group_sums(vectors, [], vector).first()
    if row is None or not row.n:
        return np.zeros(dimension, np.int64)
    return np.array([s // row.n for s in row.sums], np.int64)


def routed(corpus: DataFrame, planes: np.ndarray, config: Config, centre: np.ndarray | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, v, signature, segment_id): a narrow pass of batch multiplications of the vectors less the centre."""
    signed = int_vectors(corpus, key, vector).withColumn("signature", V.signature(planes, centre)("v"))
    return signed.withColumn("segment_id", F.col("signature").bitwiseAND(F.lit(config.segments - 1)).cast("int"))


def assign_extents(records: DataFrame, config: Config, key: str = "vec_id", base: Column | None = None) -> DataFrame:
    """extent_no by signature order inside a segment, ``extent_capacity`` records each.

    Records are numbered inside (segment, signature range) and moved up by the count
    of the ranges before, so a segment is not one task.
    """
    ranged = records.withColumn("range", F.shiftright("signature", max(0, config.planes - RANGE_BITS)))
    counts = ranged.groupBy("segment_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("segment_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("segment_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("segment_id", "range").orderBy("signature", key)) - 1
    numbered = ranged.withColumn("place", place).join(offsets, ["segment_id", "range"])
    number = F.floor((F.col("place") + F.col("before")) / config.extent_capacity).cast("int")
    return numbered.withColumn("extent_no", number if base is None else number + base).select(*records.columns, "extent_no")


def extent_directory(records: DataFrame) -> DataFrame:
    """(segment_id, extent_no, record_count, centroid, max_radius); sums are exact integers.

    Two passes: sums of an extent from partial sums of the batches, then radii from the
    join of the records with their own extent. Directories are some thousandth of the
    records.
    """
    centre = group_sums(records, ["segment_id", "extent_no"])
    centre = centre.select("segment_id", "extent_no", F.col("n").alias("record_count"), F.transform("sums", lambda s: s / F.col("n")).alias("centroid"))
    gap = F.sqrt(F.aggregate(F.zip_with("v", "centroid", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda s, x: s + x))
    radius = records.join(centre, ["segment_id", "extent_no"]).groupBy("segment_id", "extent_no").agg(F.max(gap).alias("max_radius"))
    return centre.join(radius, ["segment_id", "extent_no"])


def substrings(signatures: DataFrame, key: str, signature: str = "signature") -> DataFrame:
    """(key, table_no, sub_val): the four bytes of a signature, low first."""
    tables = F.array(*[F.struct(F.lit(m).alias("table_no"), F.shiftright(signature, 8 * m).bitwiseAND(F.lit(255)).cast("int").alias("sub_val")) for m in range(4)])
    return signatures.select(key, F.explode(tables).alias("t")).select(key, "t.table_no", "t.sub_val")


def substring_table(records: DataFrame) -> DataFrame:
    """Distinct (table_no, sub_val, segment_id)."""
    return substrings(records, "segment_id").distinct()


def write_planes(spark, planes: np.ndarray, centre: np.ndarray, path: str) -> None:
    """Planes and centre as one table of (plane, weights, centred); the centre is plane -1."""
    rows = [(-1, [int(x) for x in centre]), *((n, [int(x) for x in row]) for n, row in enumerate(planes))]
    spark.createDataFrame(rows, "plane int, weights array<long>").coalesce(1).write.mode("overwrite").parquet(path)


def read_planes(spark, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(planes, centre) as ``write_planes`` left them."""
    rows = {r.plane: r.weights for r in spark.read.parquet(path).collect()}
    return np.array([rows[n] for n in range(len(rows) - 1)], np.int64), np.array(rows[-1], np.int64)
