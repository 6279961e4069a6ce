"""Quality classifier by Bradley-Terry pairwise ranking.

Every document is described by shares and rates of its words, lines and bytes
(``features``). A pair of a good and a bad document is a preference; the model is
the direction in which the good one of a pair is further along, learned by
logistic loss on the difference of their features (no intercept, Newton steps).
The score of a document is its place along that direction. The quantile of the
training scores at the share of bad training documents is the threshold; scores
are mapped to 0..1 so that it lies at ``CUT``.

Learning uses every labelled row outside the held-out fold. Features are computed
on the executors and stay there: rows are dealt to blocks of some ``BLOCK`` by a hash
of the id, all pairs of a block are preferences, and a Newton step sums slope and
curvature of all blocks. Threshold and slope of the score are exact quantiles of all
training scores. ``fit`` is the same model of rows and random pairs in memory.
Scoring is one narrow pass over all whole texts.

Defined results: null text is empty text, whose features are all 0 and whose
score is that of these features; with labelled rows of one kind only every score
is 1 for label 1 and 0 for label 0, and 1 without any; repeated rows are scored
alike, each on its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.labelled import held_out, training_documents
from tessera.llm.quality_rules import repeat_words
from tessera.llm.rows import map_rows
from tessera.session import Scratch, table

#: Preference pairs that ``fit`` draws.
PAIRS = 60_000
#: Training rows of a block, and rows of either kind in it at least, on average; pairs looked at in one step.
BLOCK, LEAST, CHUNK = 128, 16, 1 << 15
#: Bins of a quantile's first pass.
BINS = 4096
#: Score at the threshold.
CUT = 0.3
DECAY, STEPS = 1e-3, 25

_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\"()-")
_MARKS = b".,;:!?"
_DIGITS = b"0123456789"
_UPPER = bytes(range(65, 91))
_RUN = re.compile(rb"(\S)\1{4,}")


def features(text: str | None) -> list[float]:
    """Shares and rates in about 0..1; all 0 for a text without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * N_BASE
    n, size = len(words), sum(map(len, words))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbols, marks, digits, upper = share(_SYMBOLS), share(_MARKS), share(_DIGITS), share(_UPPER)
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    distinct = set(words)
    letters = sum(w[:1].isalpha() or w[:1] >= b"\x80" for w in words) / n
    lone = sum(len(w) == 1 and not w.isalnum() for w in words) / n
    short = sum(len(w) <= 3 for w in words) / n
    ratio = len(raw) / len(zstandard.ZstdCompressor(level=3).compress(raw))
    prose = 1.0 + 0.115 * np.log2(max(2.0, len(raw) / 64))
    return [
        1.0,
        float(np.log1p(n)) / 8,
        min(1.0, size / n / 12),
        symbols * 4,
        min(1.0, symbols * 40),
        marks * 8,
        digits * 6,
        upper * 6,
        same,
        min(1.0, same * 20),
        repeat_words(words) / n,
        1 - len(distinct) / n,
        (len(lines) - len(set(lines))) / len(lines),
        min(1.0, n / len(lines) / 100),
        letters,
        lone,
        min(1.0, lone * 10),
        short,
        max(map(len, words)) / (max(map(len, words)) + 40),
        ratio / prose,
        min(2.0, max(0.0, ratio / prose - 1.0)),
        min(1.0, len(_RUN.findall(raw)) / n * 20),
    ]


N_BASE = 22


def expanded(base: np.ndarray) -> np.ndarray:
    """Base features and their squares."""
    return np.concatenate([base, base[:, 1:] ** 2], 1)


@dataclass
class Ranking:
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    threshold: float
    slope: float

    def place(self, base: np.ndarray) -> np.ndarray:
        return (expanded(base) - self.centre) / self.spread @ self.weights

    def score(self, base: np.ndarray) -> np.ndarray:
        raw = self.slope * (self.place(base) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def constant(score: float) -> Ranking:
    width = 2 * N_BASE - 1
    return Ranking(np.zeros(width), np.zeros(width), np.ones(width), -1.0 if score else 1.0, 100.0)


def fit(base: np.ndarray, labels: np.ndarray, pairs: int = PAIRS, decay: float = DECAY, steps: int = STEPS, seed: int = 11) -> Ranking:
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return constant(0.0 if len(bad) else 1.0)
    x = expanded(base)
    centre, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1.0
    x = (x - centre) / spread
    rng = np.random.default_rng(seed)
    gap = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        lost = 1 / (1 + np.exp(np.clip(gap @ w, -35, 35)))
        slope = -gap.T @ lost / pairs + decay * w
        bend = (gap * (lost * (1 - lost))[:, None]).T @ gap / pairs + decay * np.eye(len(w))
        move = np.linalg.solve(bend, slope)
        w -= move * min(1.0, 4 / max(1e-9, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-6:
            break
    place = x @ w
    low, high = np.sort(place[bad]), np.sort(place[good])
    threshold = float(np.quantile(place, len(bad) / len(labels)))
    width = max(1e-6, float(np.median(high) - np.median(low)))
    return Ranking(w, centre, spread, threshold, 8.0 / width)


def totals(frame: DataFrame, work) -> np.ndarray:
    """The sum of ``work(batch)``, an array of numbers, over all batches: a row for each task."""

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                total = work(batch) if total is None else total + work(batch)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    return np.sum([r.total for r in frame.mapInArrow(run, "total array<double>").collect()], axis=0)


def matrix(column) -> np.ndarray:
    """A list column of base features as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_BASE)


def quantile(values: DataFrame, share: float) -> float:
    """The exact quantile, between neighbours as numpy has it, of a frame of one column ``v`` without nulls."""
    n, least, most = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    at = share * (n - 1)
    low, high = int(np.floor(at)), int(np.ceil(at))
    step = (most - least) / BINS
    if not step:
        return least
    bin_of = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.lit(least)) / F.lit(step)))
    bins = sorted((r.bin, r["count"]) for r in values.groupBy(bin_of.alias("bin")).count().collect())
    ends = np.cumsum([c for _, c in bins])
    first, last = np.searchsorted(ends, [low, high], side="right")
    near = values.filter(bin_of.between(bins[first][0], bins[last][0])).groupBy("v").count().collect()
    near.sort()
    upto = np.cumsum([r["count"] for r in near]) + (ends[first - 1] if first else 0)
    x, y = (near[k].v for k in np.searchsorted(upto, [low, high], side="right"))
    return float(x + (y - x) * (at - low))


def block_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number, slope and curvature of the loss of all pairs of scaled rows."""
    out = np.zeros(1 + len(w) + len(w) ** 2)
    step = max(1, CHUNK // max(1, len(bad)))
    for at in range(0, len(good) if len(bad) else 0, step):
        gap = (good[at : at + step, None] - bad[None]).reshape(-1, len(w))
        lost = 1 / (1 + np.exp(np.clip(gap @ w, -35, 35)))
        bend = (gap * (lost * (1 - lost))[:, None]).T @ gap
        out += np.concatenate([[len(gap)], -gap.T @ lost, bend.ravel()])
    return out


def fit_rows(rows: DataFrame, scratch: Scratch, key: str, label: str, decay: float = DECAY, steps: int = STEPS) -> Ranking:
    """The ranking of all rows (key, x, label) of a saved frame."""
    import pyarrow as pa

    kinds = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    n_good, n_bad = kinds.get(1, 0), kinds.get(0, 0)
    if not n_good or not n_bad:
        return constant(0.0 if n_bad else 1.0)
    n, xs = sum(kinds.values()), rows.select("x")
    centre = totals(xs, lambda b: expanded(matrix(b.column(0))).sum(0)) / n
    spread = np.sqrt(totals(xs, lambda b: ((expanded(matrix(b.column(0))) - centre) ** 2).sum(0)) / n)
    spread[spread < 1e-9] = 1.0

    def deal(table):
        x, y = matrix(table["x"].combine_chunks()), table[label].to_numpy()
        by = np.lexsort(x.T[::-1])  # an order that does not depend on how the rows were dealt
        x, y = x[by], y[by]
        return pa.table({k: pa.array([x[y == v].tobytes()], pa.binary()) for k, v in (("good", 1), ("bad", 0))})

    blocks = max(1, min(n // BLOCK, min(n_good, n_bad) // LEAST))
    dealt = rows.select("x", label, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(blocks)).alias("block"))
    dealt = scratch.save(dealt.groupBy("block").applyInArrow(deal, "good binary, bad binary"), "blocks")

    w = np.zeros(2 * N_BASE - 1)
    for _ in range(steps):

        def sums(batch, w=w):
            scaled = lambda v: (expanded(np.frombuffer(v).reshape(-1, N_BASE)) - centre) / spread
            return sum(block_sums(scaled(good), scaled(bad), w) for good, bad in zip(*(c.to_pylist() for c in batch.columns)))

        found = totals(dealt, sums)
        pairs, slope, bend = found[0], found[1 : 1 + len(w)], found[1 + len(w) :].reshape(len(w), -1)
        move = np.linalg.solve(bend / max(1, pairs) + decay * np.eye(len(w)), slope / max(1, pairs) + decay * w)
        w = w - move * min(1.0, 4 / max(1e-9, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-6:
            break
    ranking = Ranking(w, centre, spread, 0.0, 1.0)
    places = scratch.save(map_rows(rows, ["x", label], f"v double, {label} int", lambda: lambda x, y: zip(ranking.place(np.array(x)).tolist(), y)), "places")
    bad, good = (quantile(places.filter(F.col(label) == k).select("v"), 0.5) for k in (0, 1))
    return Ranking(w, centre, spread, quantile(places.select("v"), n_bad / n), 8.0 / max(1e-6, good - bad))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int | None = None, key: str = "doc_id", text: str = "text") -> Ranking:
    """The ranking of all labelled rows outside the held-out fold, or of ``rows`` of them."""
    scratch = Scratch(docs.sparkSession, "quality")
    sample = training_documents(docs, labels, label, rows, key, text)
    ddl = f"{key} {docs.schema[key].dataType.simpleString()}, x array<double>, {label} int"
    found = map_rows(sample, [key, text, label], ddl, lambda: lambda ids, texts, ys: ((i, features(t), y) for i, t, y in zip(ids, texts, ys)))
    ranking = fit_rows(scratch.save(found, "features"), scratch, key, label)
    scratch.drop()
    return ranking


def rank_documents(docs: DataFrame, ranking: Ranking, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, the place along the ranking and the score 0..1 of every row."""
    ship = docs.sparkSession.sparkContext.broadcast(ranking)

    def make():
        def work(ids, texts):
            base = np.array([features(t) for t in texts])
            return zip(ids, ship.value.place(base).tolist(), ship.value.score(base).tolist())

        return work

    return map_rows(docs, [key, text], f"{key} {docs.schema[key].dataType.simpleString()}, place double, score double", make)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranked = rank_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
    return ranked.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "place")


QUERIES = {"op2_quality": op2_quality}
SQL: dict[str, str] = {}
