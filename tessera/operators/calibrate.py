"""Planes calibrated to a corpus: whitened principal directions, rotated to balance bits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import SCALE

#: Ways by which the tasks' sums of one component are dealt before they are added up.
SALTS = 32


def moments(records: DataFrame, dimension: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(count, sum, sum of outer products) of the integer vectors, exact, over all records.

    A task gives one row for every component: its sum and its products with all
    others. These are added in two steps, so no reducer holds the rows of all tasks;
    the driver gets one row a component.
    """
    schema = "d int, salt int, n long, row binary"

    def add(frames):
        n, s, g = 0, np.zeros(dimension, np.int64), np.zeros((dimension, dimension), np.int64)
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_numpy()).astype(np.float64)
                n, s, g = n + len(x), s + x.sum(0).astype(np.int64), g + (x.T @ x).astype(np.int64)
        if n:
            salt = int(s.sum()) % SALTS
            yield pd.DataFrame({"d": range(dimension), "salt": salt, "n": n, "row": [np.r_[s[d], g[d]].astype("<i8").tobytes() for d in range(dimension)]})

    def total(frame):
        rows = sum(np.frombuffer(b, "<i8") for b in frame["row"])
        return pd.DataFrame({"d": frame["d"].iloc[:1].to_numpy(), "salt": [0], "n": [int(frame["n"].sum())], "row": [rows.tobytes()]})

    some = records.select("v").mapInPandas(add, schema).groupBy("d", "salt").applyInPandas(total, schema)
    rows = sorted(some.groupBy("d").applyInPandas(total, schema).collect(), key=lambda r: r.d)
    if not rows:
        return 0, np.zeros(dimension, np.int64), np.zeros((dimension, dimension), np.int64)
    table = np.array([np.frombuffer(r.row, "<i8") for r in rows])
    return rows[0].n, table[:, 0], table[:, 1:]


def calibrated_planes(records: DataFrame, dimension: int, planes: int = 32, sample: int = 20_000, rounds: int = 50, seed: int = 42, key: str = "vec_id") -> tuple[np.ndarray, np.ndarray]:
    """(integer planes, integer centre of the vectors), for the ``planes`` and ``centre`` of routing and search.

    Centre and covariance use all records; the rotation alternates signs and
    orthogonal fits over at most some ``sample`` records, those whose key hash is
    least: a hash limit is set from the count, so nothing is sorted.
    """
    n, total, outer = moments(records, dimension)
    centre = total / max(1, n) / 127
    spread = (outer / 127**2 - n * np.outer(centre, centre)) / max(1, n - 1)
    values, vectors = np.linalg.eigh(spread)
    order = np.argsort(-values)[:planes]
    base = vectors[:, order] / np.sqrt(np.maximum(values[order], 0) + 1e-5)
    picked = records.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < max(1, min(1 << 20, (sample << 20) // max(1, n)))).select("v").toPandas()
    if len(picked):
        x = (np.stack(picked["v"].to_numpy()) / 127 - centre) @ base
        rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(order), len(order))))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(x @ rotation >= 0, 1.0, -1.0).T @ x)
            rotation = (left @ right).T
        base = base @ rotation
    found = base.T
    found = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    return np.round(found * SCALE).astype(np.int64), np.round(centre * 127).astype(np.int64)
