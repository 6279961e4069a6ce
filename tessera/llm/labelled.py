"""Folds and bounded samples of labelled documents, for the operators that learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
#: Labels that may be broadcast; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the id as text is divisible by FOLDS; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str, rows: int | None, key: str = "doc_id") -> DataFrame:
    """(key, label) of at most ``rows`` labelled ids outside the held-out fold, the least by hash; of all without ``rows``.

    Null ids and labels are left out; the largest label of a repeated id counts.
    A bound makes the frame safe to broadcast.
    """
    usable = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
    single = usable.groupBy(key).agg(F.max(F.col(label).cast("int")).alias(label))
    return single if rows is None else single.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(rows)


def training_documents(docs: DataFrame, labels: DataFrame, label: str, rows: int | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label) of the training rows, at most ``rows`` of them or all.

    Labels of bounded number are broadcast, so only the texts of the sample are shuffled,
    to one row an id: the least text of a repeated id counts, and null is empty text.
    """
    picked = training_labels(labels, label, rows, key)
    few = rows is not None or picked.count() <= BROADCAST_ROWS
    found = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)).join(F.broadcast(picked) if few else picked, key)
    return found.groupBy(key).agg(F.min(text).alias(text), F.first(label).alias(label))
