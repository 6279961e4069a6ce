"""Benchmark decontamination with one Aho-Corasick automaton.

Every benchmark text is cut into windows of 13 consecutive words (a shorter one,
if it has words, is one window). The windows, as sequences of word numbers, go
into one automaton; each document is turned into word numbers once and scanned
once. Matches are word ranges; where a caller asks for spans they are mapped back
to character offsets of the original text, so text can be shown or cut exactly.

The automaton is shipped to the tasks behind a check of its size, and built once in
a Python worker, for all its tasks: the bytes of the benchmark are summed first, and
beyond ``SHARD_BYTES`` the items are dealt to several automata, each of which scans
the documents in a pass of its own, written to the shared scratch area. Driver and
tasks hold one automaton's items at a time. All passes are narrow; no document is
ever shuffled.

Defined results: null or empty document text has no words, no hits and is clean;
null item text has no windows; an item with a null id counts as the item with the
empty id; items that repeat an id are one item; repeated documents are judged
alike, each on its own; with an empty benchmark all documents are clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.rows import schema_of, slices
from tessera.llm.textnorm import ALNUM_WORD, alnum_spans, alnum_words
from tessera.session import Scratch, table

WINDOW = 13
#: Bytes of benchmark text in one automaton (some ten times that in memory).
SHARD_BYTES = 8 << 20

HITS = "leak_words long, leak_hits long, leak_items array<string>, leak_spans array<struct<first_word:long,last_word:long,start:long,stop:long>>"


class Scanner:
    """The automaton over the windows of some items."""

    def __init__(self, items: Iterable[tuple[str, str]], window: int = WINDOW):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in alnum_words(text))
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(ids[at : at + window], set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, who in owners.items():
            self.automaton.add_word(key, (len(key), frozenset(who)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(words, merged ranges of hit words with both ends included, items)."""
        words = alnum_words(text)
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        if words and not self.empty:
            number = self.numbers.get
            for end, (size, who) in self.automaton.iter(tuple([number(w, 0) for w in words])):
                items |= who
                ranges.append((end - size + 1, end))
        return len(words), merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


#: The automaton that this worker built last, by the digest of its items.
_BUILT: dict[str, Scanner] = {}


def built(shard: list[tuple[str, str]], name: str, window: int) -> Scanner:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Scanner(shard, window)
    return _BUILT[name]


def item_shards(items: DataFrame, item: str, text: str, shard_bytes: int = SHARD_BYTES):
    """(number of shards, the shards one by one as lists in driver memory, each of a checked size)."""
    items = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    count = max(1, -(-total // shard_bytes))
    shards = (items if count == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == shard) for shard in range(count))
    return count, ([(r.item, r.text) for r in shard.collect()] for shard in shards)


def scan_documents(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, spans: bool = True, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with the columns of HITS: words, hit words, items and hit spans of every row.

    ``leak_spans`` holds maximal runs of hit words, with the character range in the
    original text when ``spans`` (else -1). Columns of those names are replaced.
    """
    added = schema_of(HITS)
    docs = docs.drop(*added.names)
    schema, at, own = StructType([*docs.schema.fields, *added.fields]), docs.columns.index(text), len(docs.columns)
    count, shards = item_shards(items, item, item_text, shard_bytes)
    scratch = Scratch(docs.sparkSession, "decontaminate") if count > 1 else None
    for n, shard in enumerate(shards):
        name = f"{window} {hashlib.sha256(repr(sorted(shard)).encode('utf-8', 'surrogatepass')).hexdigest()}"
        ship = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches, ship=ship, n=n, name=name):
            import pyarrow as pa

            scanner, arrow = built(ship.value, name, window), to_arrow_schema(schema)
            for piece in slices(batches):
                kept, before = piece.columns[:own], piece.columns[own:]
                earlier = list(zip(*[c.to_pylist() for c in before])) if before else [None] * piece.num_rows
                rows = [scored(scanner, t, spans, e) for t, e in zip(piece.column(at).to_pylist(), earlier)]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(v, f.type) for v, f in zip(zip(*rows), list(arrow)[own:])]], schema=arrow)

        docs = docs.mapInArrow(run, schema)
        if scratch:
            docs = scratch.save(docs, str(n))
            ship.unpersist()
            if n:
                scratch.drop(str(n - 1))
    return docs


def scored(scanner: Scanner, text: str | None, spans: bool, earlier: tuple | None) -> tuple:
    words, ranges, items = scanner.scan(text)
    if earlier:
        ranges = merged([*ranges, *((s["first_word"], s["last_word"]) for s in earlier[3])])
        items = items | set(earlier[2])
    chars = alnum_spans(text) if spans and ranges else None
    return (
        words,
        sum(b - a + 1 for a, b in ranges),
        sorted(items),
        [{"first_word": a, "last_word": b, "start": chars[a][0] if chars else -1, "stop": chars[b][1] if chars else -1} for a, b in ranges],
    )


def contaminated(hits="leak_hits", words="leak_words"):
    """Hit words are at least a twentieth of the words."""
    return (F.col(hits) > 0) & (20 * F.col(hits) >= F.col(words))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", any_hit: bool = True, **options) -> DataFrame:
    """The rows of ``docs`` without a hit word, or else (``any_hit`` off) that are not contaminated, with their own columns only.

    Any place where a window of an item stands word for word lets a model learn that
    item, however long the document around it; ``contaminated`` weighs the hits
    against the length. Columns are renamed by position for the scan, so none of
    theirs can clash with ours.
    """
    names = [f"c{n}" for n in range(len(docs.columns))]
    found = scan_documents(docs.toDF(*names), items, text=names[docs.columns.index(text)], spans=False, **options)
    return found.filter(F.col("leak_hits") == 0 if any_hit else ~contaminated()).select(*names).toDF(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_documents(docs, table(spark, sf_dir, "benchmark"), spans=False)
    return found.select(
        "doc_id",
        F.col("leak_words").alias("n_words"),
        F.col("leak_hits").alias("n_hit"),
        F.size("leak_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak_items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op6_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{ALNUM_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{ALNUM_WORD}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT DISTINCT dw.doc_id, dw.i, dw.size, iw.item_id FROM dw JOIN iw ON dw.size = iw.size AND dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
QUERIES = {"op6_decontaminate": op6_decontaminate}
