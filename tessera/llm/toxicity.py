"""Toxicity by a factorization machine over hashed terms.

A document is the set of hashes of its words and of their first four and five
characters (inflected forms of an insult share those). A linear model adds up
single terms; the factorization machine also learns a short vector for each term
whose inner products are the weights of pairs, so that an insult counts for more
beside a group mention than alone.

Learning: a bounded sample of labelled rows (``TRAIN_ROWS``) is hashed on the
executors; how often each hash occurs with either label is counted there, and the
``TERMS`` hashes most associated with the label by chi-square are kept. The first
``ANCHORS`` of them are looked at again in company: of the terms beside an anchor,
the ``PAIR_TERMS`` that move the share of toxic rows most away from the anchor's own
are kept too, so that a term that is neutral alone (a group mention) can take part
in pairs. These numbers bound the model, not the documents. Only the kept hashes of
the sampled rows reach the driver. Scoring is one narrow pass over all whole texts.

Defined results: null or empty text has no terms and gets the score of the
intercept; with fewer than one labelled row of either kind every score is the
constant 0 or 1 of the only label there is, or 0 without any; repeated rows are
scored alike, each on its own.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.labelled import held_out, training_documents
from tessera.llm.rows import map_rows, slices
from tessera.llm.textnorm import ALNUM_TABLE
from tessera.session import Scratch, table

#: Labelled rows learned from at most.
TRAIN_ROWS = 16_000
HASH_BITS = 22
#: Hashes kept, and the fewest training rows that hold one.
TERMS, LEAST_ROWS = 1024, 3
#: Terms whose company is looked at, and hashes kept for their effect beside one.
ANCHORS, PAIR_TERMS = 64, 512
FACTORS, EPOCHS, RATE, DECAY = 6, 15, 0.3, 1e-4
#: Weight of a toxic row in the loss.
POSITIVE = 1.0
PREFIXES = (4, 5)
MEMO_WORDS = 200_000


class Hasher:
    """Text -> sorted distinct hashes of its terms."""

    def __init__(self, bits: int = HASH_BITS, prefixes=PREFIXES, memo_words: int = MEMO_WORDS):
        self.mask, self.prefixes, self.limit = (1 << bits) - 1, prefixes, memo_words
        self.memo: dict[str, tuple[int, ...]] = {}

    def terms(self, word: str) -> tuple[int, ...]:
        got = self.memo.get(word)
        if got is None:
            names = [b"w:" + word.encode(), *(b"%d:" % n + word[:n].encode() for n in self.prefixes if len(word) > n)]
            got = tuple(zlib.crc32(x) & self.mask for x in names)
            if len(self.memo) >= self.limit:
                self.memo.clear()
            self.memo[word] = got
        return got

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        found: set[int] = set()
        for word in set(text.encode("utf-8", "replace").translate(ALNUM_TABLE).decode("utf-8", "replace").split()):
            found.update(self.terms(word))
        return sorted(found)


@dataclass
class Machine:
    """A fitted factorization machine over ``terms`` (sorted hashes)."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, index: np.ndarray) -> float:
        v = self.factors[index]
        total = v.sum(0)
        return self.bias + float(self.weights[index].sum()) + 0.5 * float((total * total).sum() - (v * v).sum())


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, x)))))


def fit(rows: list[tuple[np.ndarray, int]], terms: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, positive: float = POSITIVE, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad steps; rows are (indexes of kept terms, label)."""
    labels = [y for _, y in rows]
    if len(set(labels)) < 2:
        only = labels[0] if labels else 0
        return Machine(terms, 40.0 if only else -40.0, np.zeros(len(terms)), np.zeros((len(terms), factors)))
    rng = np.random.default_rng(seed)
    share = sum(labels) / len(labels)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), factors))
    gb, gw, gv = 1.0, np.ones(len(terms)), np.ones((len(terms), factors))
    for _ in range(epochs):
        for n in rng.permutation(len(rows)):
            index, y = rows[n]
            part = v[index]
            total = part.sum(0)
            raw = bias + w[index].sum() + 0.5 * ((total * total).sum() - (part * part).sum())
            slope = (sigmoid(raw) - y) * (positive if y else 1.0)
            gb += slope * slope
            bias -= rate * slope / np.sqrt(gb)
            if len(index):
                step = slope + decay * w[index]
                gw[index] += step * step
                w[index] -= rate * step / np.sqrt(gw[index])
                step = np.clip(slope * (total - part), -5, 5) + decay * part
                gv[index] += step * step
                v[index] -= rate * step / np.sqrt(gv[index])
    return Machine(terms, bias, w, v)


def associated_terms(hashed: DataFrame, label: str, terms: int = TERMS, pair_terms: int = PAIR_TERMS, anchors: int = ANCHORS, least_rows: int = LEAST_ROWS) -> np.ndarray:
    """The hashes most associated with the label, alone (chi-square) or beside an anchor, sorted."""
    sums = hashed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("y")).first()
    n, y = sums["n"], sums["y"]
    if not 0 < y < n:
        return np.zeros(0, np.int64)
    counted = hashed.select(F.explode("terms").alias("term"), label).groupBy("term").agg(F.count(F.lit(1)).alias("a"), F.sum(label).alias("b")).filter(F.col("a") >= least_rows)
    gap = F.col("b").cast("double") * n - F.col("a").cast("double") * y
    chi = gap * gap / (F.col("a").cast("double") * (n - F.col("a")) + 1)
    alone = counted.orderBy(chi.desc(), "term").limit(terms).collect()
    first = alone[:anchors]
    found = {r.term for r in alone}
    if first and pair_terms:
        rate = F.create_map(*[F.lit(x) for r in first for x in (r.term, r.b / r.a)])
        beside = hashed.select(label, "terms", F.explode(F.array_intersect("terms", F.lit([r.term for r in first]))).alias("anchor"))
        both = beside.select(label, "anchor", F.explode("terms").alias("term")).filter("term <> anchor").groupBy("anchor", "term").agg(F.count(F.lit(1)).alias("a"), F.sum(label).alias("b")).filter(F.col("a") >= least_rows)
        share = F.element_at(rate, F.col("anchor"))
        moved = (F.col("b") - F.col("a") * share) * (F.col("b") - F.col("a") * share) / (F.col("a") * share * (1 - share) + 1)
        best = both.groupBy("term").agg(F.max(moved).alias("moved")).orderBy(F.desc("moved"), "term").limit(pair_terms + len(found)).collect()
        found |= {r.term for r in [r for r in best if r.term not in found][:pair_terms]}
    return np.array(sorted(found), np.int64)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text", terms: int = TERMS, pair_terms: int = PAIR_TERMS, factors: int = FACTORS) -> Machine:
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = training_documents(docs, labels, label, rows, key, text)
    hashed = map_rows(sample, [text, label], f"terms array<int>, {label} int", lambda: lambda texts, ys, h=Hasher(): ((h(t), y) for t, y in zip(texts, ys)))
    hashed = scratch.save(hashed, "hashed")
    chosen = associated_terms(hashed, label, terms, pair_terms)

    def kept(found, ys):
        for t, y in zip(found, ys):
            yield np.intersect1d(np.array(t, np.int64), chosen).tolist(), y

    picked = map_rows(hashed, ["terms", label], f"terms array<int>, {label} int", lambda: kept).collect()
    scratch.drop()
    # an order that does not depend on how the rows were dealt
    ordered = sorted((tuple(r.terms), r[label]) for r in picked)
    return fit([(np.searchsorted(chosen, np.array(t, np.int64)), y) for t, y in ordered], chosen, factors)


class Scorer:
    def __init__(self, machine: Machine):
        self.machine, self.hash = machine, Hasher()
        self.at = {int(t): n for n, t in enumerate(machine.terms)}

    def __call__(self, text: str | None) -> float:
        at = self.at
        index = np.array([at[t] for t in self.hash(text) if t in at], np.int64)
        return sigmoid(self.machine.raw(index))


def score_documents(docs: DataFrame, machine: Machine, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and the toxicity of every row, 0 to 1."""
    ship = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        score = Scorer(ship.value)
        return lambda ids, texts: ((i, score(t)) for i, t in zip(ids, texts))

    return map_rows(docs, [key, text], f"{key} {docs.schema[key].dataType.simpleString()}, score double", make)


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``limit``; nothing is shuffled."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, text=text))
    schema, at = docs.schema, docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        score, arrow = Scorer(ship.value), to_arrow_schema(schema)
        for piece in slices(batches):
            keep = pa.array([score(t) < limit for t in piece.column(at).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays(piece.filter(keep).columns, schema=arrow)

    return docs.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
SQL: dict[str, str] = {}
