"""Text functions as columns: token windows, page carry-over, snippets, sentences, terms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

BLANK = r"[ \t\r\n\f]"
TOKEN = rf"{BLANK}*(?:[\p{{L}}\p{{N}}_]+|[^ \t\r\n\f\p{{L}}\p{{N}}_])"
WORD = r"[\p{L}\p{N}_]+"
#: Words that an embedding task holds as Python strings at a time.
EMBED_WORDS = 50_000
WINDOW, STEP, MIN_CHARS, MIN_TOKENS, MIN_TEXT, TAILS = 96, 64, 50, 20, 40, (33, 34)
# Words that a question's terms leave out.
STOP_WORDS = ("the", "a", "an", "in", "on", "of", "and", "or", "to", "for", "is", "are")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def tokens(c: Column) -> Column:
    """Tokens with the blanks before them: joined they give the text back."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def windows_of(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of (keys, text, is_last): windows of tokens; short last pages whole.

    On a page that is not the last one a tail window of 33 or 34 tokens is left to
    the next page.
    """
    cut = pages.withColumn("toks", tokens(F.col("text"))).withColumn("n", F.size("toks"))
    count = F.when(F.col("n") <= WINDOW, 1).otherwise(F.ceil((F.col("n") - WINDOW) / STEP).cast("int") + 1)
    tail = F.col("n") - STEP * (count - 1)
    count = F.when((count > 1) & ~F.col("is_last") & tail.isin(*TAILS), count - 1).otherwise(count)
    count = F.when(F.col("n") >= MIN_TOKENS, count).when(F.col("is_last"), 1).otherwise(0)
    each = cut.withColumn("count", count).filter("count > 0").withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    piece = strip(F.array_join(F.slice("toks", F.col("chunk_no") * STEP + 1, F.lit(WINDOW)), ""))
    is_window = F.col("n") >= MIN_TOKENS
    chunks = each.select(*keys, "chunk_no", is_window.alias("is_window"), F.when(is_window, piece).otherwise(F.col("text")).alias("chunk"))
    return chunks.filter(F.length("chunk") >= F.when(F.col("is_window"), MIN_CHARS).otherwise(MIN_TEXT)).drop("is_window")


def carried_pages(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, page, text, is_last) with short pages and short tails carried to the next page.

    An ordered fold over the pages of a document, in one aggregate expression.
    """
    stripped = pages.select(doc, page, strip(F.coalesce(F.col(text), F.lit(""))).alias("body")).filter("body <> ''")
    listed = stripped.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), "body"))).alias("pages"))
    last = F.element_at("pages", -1)["page"]

    def step(acc, p):
        body = F.when(acc["carry"] == "", p["body"]).otherwise(F.concat(acc["carry"], F.lit(" "), p["body"]))
        toks = tokens(body)
        n = F.size(toks)
        extra = F.ceil((n - WINDOW) / STEP).cast("int")
        tail = n - STEP * extra
        is_last = p["page"] == last
        carry = F.when(is_last, "").when(n < MIN_TOKENS, body).when((n > WINDOW) & tail.isin(*TAILS), strip(F.array_join(F.slice(toks, STEP * extra + 1, F.lit(WINDOW)), ""))).otherwise("")
        return F.struct(carry.alias("carry"), F.concat(acc["out"], F.array(F.struct(p["page"].alias("page"), body.alias("text"), is_last.alias("is_last")))).alias("out"))

    kind = stripped.schema[page].dataType.simpleString()
    start = F.struct(F.lit("").alias("carry"), F.expr(f"cast(array() as array<struct<page:{kind},text:string,is_last:boolean>>)").alias("out"))
    folded = listed.select(doc, F.explode(F.aggregate("pages", start, step, lambda acc: acc["out"])).alias("p"))
    return folded.select(doc, F.col("p.page").alias(page), "p.text", "p.is_last")


def snippet(c: Column, limit: int = 1000) -> Column:
    flat = F.translate(c, "\r\n", "  ")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def sentences(c: Column, least: int = 20) -> Column:
    """Sentences of at least ``least`` characters with their place."""
    split = F.split(F.regexp_replace(c, rf"([.!?]){BLANK}+", "$1\x01"), "\x01")
    return F.filter(F.transform(split, lambda s, i: F.struct(i.alias("pos"), strip(s).alias("sentence"))), lambda s: F.length(s["sentence"]) >= least)


def words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)))


def terms(c: Column) -> Column:
    return F.array_except(words(c), F.array(*[F.lit(w) for w in STOP_WORDS]))


def pieces(lists: pa.Array, words: int = EMBED_WORDS) -> Iterator[slice]:
    """Runs of rows that hold at most so many list elements together; a longer row is a run of its own."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    start = held = 0
    for row, n in enumerate(sizes):
        if row > start and held + n > words:
            yield slice(start, row)
            start, held = row, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def hash_embedding(dimension: int):
    """UDF: signed feature hashing of the words of a text, unit length, quantised to int8.

    Word hash: the first 32 bits of MD5; dimension is the hash modulo D, the sign the
    parity of the quotient, so the hash modulo 2 D tells both. Sums are whole numbers
    until the last step. Words become Python strings for some ``EMBED_WORDS`` at a time,
    however long a batch.
    """

    def embed(toks: list[str], memo: dict[str, int]) -> np.ndarray:
        places = []
        for t in toks:
            at = memo.get(t)
            if at is None:
                if len(memo) > 100_000:
                    memo.clear()
                at = memo[t] = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % (2 * dimension)
            places.append(at)
        counts = np.bincount(np.array(places, np.int64), minlength=2 * dimension)
        v = (counts[:dimension] - counts[dimension:]).astype(np.float64)
        size = np.sqrt((v * v).sum())
        return np.trunc(v / size * 127).astype(np.int32) if size else v.astype(np.int32)

    @arrow_udf("array<int>")
    def run(token_lists: pa.Array) -> pa.Array:
        memo: dict[str, int] = {}
        out = np.zeros((len(token_lists), dimension), np.int32)
        for piece in pieces(token_lists):
            for row, toks in enumerate(token_lists.slice(piece.start, piece.stop - piece.start).to_pylist(), piece.start):
                out[row] = embed(toks or [], memo)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dimension, dtype=np.int32)), pa.array(out.ravel()))

    return run


def embed_texts(frame: DataFrame, key: str, text: str, dimension: int) -> DataFrame:
    """(key, v) of every row."""
    listed = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    return frame.select(key, hash_embedding(dimension)(listed).alias("v"))
