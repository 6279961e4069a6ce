"""Quality rules: compression bands.

A document is judged by how well zstandard squeezes it: text that shrinks far
more than prose of its length repeats itself, text that hardly shrinks is noise
(random strings, encoded blobs). The ratio of prose grows with the length of the
input, so every length band has its own pair of limits. The ratio is taken over
the whole document and, so that a long clean document cannot hide a block of
junk, over consecutive chunks of fixed size, of which none may lie outside its
limits. The last chunk ends with the document and may overlap the one before, so
every byte is judged. Junk that fills no chunk, less than two chunks long, can
still be covered up by the prose around it.

Defined results: a null text is an empty text; an empty text has ratio 0 and no
chunk, and is not rejected by the bands (``op8`` rejects it by its word count).
Repeated rows are judged alike, each on its own. No row is dropped by
``compression_bands``; ``keep_clean`` drops what is rejected.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.rows import map_rows
from tessera.llm.textnorm import BLANK_WORD, blank_words
from tessera.session import table

#: (bytes below, least ratio, greatest ratio) of a whole document at LEVEL.
BANDS = (
    (512, 1.05, 2.10),
    (1024, 1.15, 2.15),
    (2048, 1.25, 2.22),
    (4096, 1.32, 2.32),
    (8192, 1.35, 2.44),
    (16384, 1.35, 2.54),
    (65536, 1.35, 2.68),
    (1 << 62, 1.35, 2.85),
)
LEVEL = 3
#: Bytes of a chunk; a document shorter than one is judged as a whole only.
CHUNK = 2048
#: Least and greatest ratio of a chunk, and the share of chunks that may lie outside.
CHUNK_BAND = (1.30, 2.45)
CHUNK_SHARE = 0

VERDICT = "doc_bytes long, ratio double, n_chunks int, bad_chunks int, in_band boolean"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = b"#*$%&|<>"


def make_judge(bands=BANDS, level=LEVEL, chunk=CHUNK, chunk_band=CHUNK_BAND, chunk_share=CHUNK_SHARE):
    """text -> (bytes, ratio, chunks, bad chunks, verdict)."""
    squeeze = zstandard.ZstdCompressor(level=level).compress

    def judge(text: str | None) -> tuple[int, float, int, int, bool]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0, 0.0, 0, 0, True
        ratio = len(raw) / len(squeeze(raw))
        low, high = next((lo, hi) for below, lo, hi in bands if len(raw) < below)
        chunks = bad = 0
        if len(raw) >= chunk:
            for at in range(0, len(raw), chunk):
                at = min(at, len(raw) - chunk)
                chunks += 1
                bad += not chunk_band[0] <= chunk / len(squeeze(raw[at : at + chunk])) <= chunk_band[1]
        return len(raw), ratio, chunks, bad, low <= ratio <= high and bad <= chunk_share * chunks

    return judge


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(index) + ids[1:]
    if len(index) > 2_000_000:  # three ids no longer fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    _, where, counts = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[where] > 1
    hit = np.zeros(len(words), bool)
    for shift in range(3):
        hit[shift : shift + len(again)] |= again
    return int(hit.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    text = text or ""
    words = blank_words(text)
    raw_words = b"".join(words)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return (
        len(words),
        len(raw_words.decode("utf-8", "surrogatepass")),
        len(raw_words) - len(raw_words.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def compression_bands(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), **limits) -> DataFrame:
    """``keys`` and the verdict columns of VERDICT for every row; no shuffle."""
    ddl = ", ".join([*(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys), VERDICT])

    def make():
        judge = make_judge(**limits)
        return lambda *cols: ((*row[:-1], *judge(row[-1])) for row in zip(*cols))

    return map_rows(docs, [*keys, text], ddl, make)


def rule_report(docs: DataFrame, text: str = "text", key: str = "doc_id", **limits) -> DataFrame:
    """Base counts and band verdict of every row in one pass over the text."""

    def make():
        judge = make_judge(**limits)
        return lambda ids, texts: ((i, *base_counts(t), *judge(t)) for i, t in zip(ids, texts))

    report = map_rows(docs, [key, text], f"{key} {docs.schema[key].dataType.simpleString()}, {BASE}, {VERDICT}", make)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return report.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("in_band"))


def keep_clean(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows of ``docs``, all columns, that pass base rules and bands.

    The verdict is computed inside the row stream, so the table is neither
    shuffled nor joined with itself.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, at = docs.schema, docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        from tessera.llm.rows import slices

        arrow, judge = to_arrow_schema(schema), make_judge(**limits)

        def good(t):
            n, _, _, _, repeated = base_counts(t)
            return n >= 50 and 100 * repeated <= 50 * n and judge(t)[4]

        for piece in slices(batches):
            keep = pa.array([good(t) for t in piece.column(at).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays(piece.filter(keep).columns, schema=arrow)

    return docs.mapInArrow(run, schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = rule_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "doc_bytes", "ratio", "n_chunks", "bad_chunks")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op8_quality_rules``, which SQL can express."""
    return op8_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


SQL = {
    "quality_base_counts": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{BLANK_WORD}') AS w FROM documents),
d AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{BLANK_WORD}')) AS lines FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM again) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN hit USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c"""
}
QUERIES = {"op8_quality_rules": op8_quality_rules, "quality_base_counts": quality_base_counts}
