"""N-gram Jaccard self-join with rare-first prefix filtering.

A document is the set of its distinct word 5-grams, as 64-bit hashes. Two sets
link when their Jaccard similarity reaches 3/4. All sets are put into one order:
rare grams first, by a count over all documents, then by hash. Two linked sets
then share a gram among the first ``n - ceil(3n/4) + 1`` of either (prefix
filter), so only those are shuffled.

1. Counts: a sketch of ``SKETCH`` to ``MOST_COUNTERS`` counters of hashed grams,
   as the size of the input asks for, summed over all documents. What a counter has
   from grams that merely share it so stays low, rare grams come first and few sets
   are compared; links do not depend on the order.
2. Postings: a task turns its documents into (gram, set, size, position) rows,
   once per distinct set, packed by bucket of the gram. Buckets follow from the
   summed counts, so a task holds a bounded number of rows; the posting list of a
   gram that alone exceeds that is dealt to several buckets. What a counter has
   from grams that merely share it, its level over all counters, is left out of that.
3. Candidates: the sets of a posting list of up to ``LIST`` are paired, through
   the length and positional filters. A longer list, of which only large groups of
   near copies are made once the order is rare-first, makes a star instead.
4. Verification. Candidates meet in cells of at most two blocks of ``BLOCK`` sets,
   to which whole sets are sent (hashed again, for candidates only). In a cell the
   sets are joined on their prefixes once more, and a pair that passes the length,
   positional and suffix filters is verified by exact intersection, once: a pair of
   sets has one cell. Pairs whose ends are known to be connected need no
   verification, as the result is the groups.
   First round: the cells hold the explicit pairs (a connected group of candidates
   that fits one block is one cell) and the blocks of every star, its hub with each.
   Second round: what a star has outside its largest connected part is compared with
   all of the star. A group of m near copies that hang together so costs m sets sent
   and about m verifications, not their square.
5. Components of the links, by stars over distributed edges.

Equal sets are one node throughout: copies meet in a pre-aggregated group-by.

Defined results: null or empty text has size 0 and is linked with nothing; fewer
than five words are one gram; repeated rows are copies of each other; different
texts under one id are different documents, each in the group of its own links;
rows with a null id get a null component; an empty table gives an empty result. Ids
may have any type that has an order. Hashes have 64 bits: two different sets are taken for equal with a chance of 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.rows import schema_of, slices
from tessera.llm.textnorm import blank_words
from tessera.session import Scratch, table

GRAM = 5
#: Least similarity as a fraction of whole numbers.
SHARE, WHOLE = 75, 100
SKETCH = 1 << 20
#: Counters of a large corpus, a byte each where they are broadcast, and bytes of its files for which there is one.
MOST_COUNTERS, COUNTER_BYTES = 1 << 24, 256
#: Longest posting list whose sets are paired directly.
LIST = 32
#: Sets of a block; a cell holds two at most.
BLOCK = 64
#: Posting rows of a bucket at most, on average.
BUCKET_ROWS = 1 << 20
#: Ids that may be broadcast; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
MEMO_WORDS = 200_000
#: Pairs of posting lists that are looked at in one step.
CHUNK = 1 << 18

_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_FINAL = np.uint64(0xFF51AFD7ED558CCD)
#: Bits of a gram that postings carry: two grams that agree in them give a candidate that fails verification.
KEY = np.uint64((1 << 48) - 1)
_S29, _S32 = np.uint64(29), np.uint64(32)
#: The sign bit is cleared: ids of sets and grams are non-negative Spark longs.
_POSITIVE = np.uint64(0x7FFFFFFFFFFFFFFF)

ROWS = "kind int, doc_id {0}, n long, node long, bucket int, blob binary"
FOUND = "kind int, doc_id {0}, n long, node long, other long"
DOCUMENT, POSTINGS, PAIR, STAR, HUB = range(5)


class Grams:
    """Text -> sorted distinct gram hashes."""

    def __init__(self, gram: int = GRAM, memo_words: int = MEMO_WORDS):
        import xxhash

        self.hash, self.gram, self.limit = xxhash.xxh3_64_intdigest, gram, memo_words
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = blank_words(text, lower=True)
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.gram:
            return np.array([self.hash(b" ".join(words), seed=len(words)) & int(_POSITIVE)], np.uint64)
        memo, get = self.memo, self.memo.get
        ids = [get(w) for w in words]
        if None in ids:
            if len(memo) > self.limit:
                memo.clear()
            for n, w in enumerate(words):
                if ids[n] is None:
                    ids[n] = memo[w] = self.hash(w)
        ids = np.array(ids, np.uint64)
        size = len(ids) - self.gram + 1
        mixed = np.zeros(size, np.uint64)
        for k in range(self.gram):
            mixed = (mixed ^ ids[k : k + size]) * _MULTIPLIERS[k % 5]
            mixed ^= mixed >> _S29
        mixed *= _FINAL
        mixed ^= mixed >> _S32
        return np.unique(mixed & _POSITIVE)

    def node(self, grams: np.ndarray) -> int:
        """Hash of a set, the same for equal sets."""
        return self.hash(grams.tobytes(), seed=len(grams)) & int(_POSITIVE)


def prefix_size(n: int, share: int = SHARE, whole: int = WHOLE) -> int:
    return n - -(-share * n // whole) + 1


def needed_overlap(n, m, share: int = SHARE, whole: int = WHOLE):
    """Least intersection of linked sets of n and m grams."""
    return -(-share * (n + m) // (whole + share))


def batches_of(rows: list[tuple], arrow, step: int = 4096) -> Iterator:
    import pyarrow as pa

    for at in range(0, len(rows), step):
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows[at : at + step]), arrow)], schema=arrow)


def tally(frame: DataFrame, slots: int, make) -> np.ndarray:
    """How often each of ``slots`` comes up: ``make()`` gives a task's function from the values of the column to slots.

    Tasks add up their rows; what they have is summed in 64 slices by key. The
    counters of a task are mostly small, so they travel byte by byte, compressed:
    some 2 bits a counter.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, parts = schema_of("slice int, counts binary"), 64 if slots >= 64 else slots
    width = slots // parts

    def count(batches):
        places, total = make(), np.zeros(slots, np.uint32)
        for piece in slices(batches):
            np.add.at(total, places(piece.column(0)), np.uint32(1))
        for n in range(parts if total.any() else 0):
            yield from batches_of([(n, squeeze(total[n * width : (n + 1) * width]))], to_arrow_schema(schema))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[n] = sums.get(n, 0) + stretch(counts.as_py())
        for n in list(sums):
            yield from batches_of([(n, squeeze(sums.pop(n)))], to_arrow_schema(schema))

    found = frame.mapInArrow(count, schema).repartition(parts, "slice").mapInArrow(add, schema).collect()
    large = any(stretch(r.counts).max() >= 1 << 32 for r in found)
    out = np.zeros(slots, np.int64 if large or slots <= SKETCH else np.uint32)
    for r in found:
        out[r.slice * width : (r.slice + 1) * width] = stretch(r.counts)
    return out


def count_sketch(docs: DataFrame, text: str, sketch: int = SKETCH, gram: int = GRAM) -> np.ndarray:
    """Counts of hashed grams over all documents: a fixed number of counters."""

    def make():
        grams = Grams(gram)

        def places(texts):
            return (np.concatenate([grams(t) for t in texts.to_pylist()]) & np.uint64(sketch - 1)).astype(np.int64)

        return places

    return tally(docs.select(text), sketch, make)


def squeeze(counts: np.ndarray) -> bytes:
    """64-bit counts byte by byte, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def stretch(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


POSTING = np.dtype([("gram", "<u8"), ("node", "<u8"), ("n", "<u4"), ("at", "<u4"), ("salted", "u1")])


def rare_first(grams: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The prefix of a set: its grams in the common order, as many as the prefix filter wants."""
    often = order[(grams & np.uint64(len(order) - 1)).astype(np.int64)]
    return grams[np.lexsort((grams, often))[: prefix_size(len(grams))]]


def counters_for(size: int) -> int:
    """Counters for so many bytes of files: a power of two; an unknown size (2^62 and more) counts as small."""
    wanted = size // COUNTER_BYTES if size < 1 << 62 else 0
    return min(MOST_COUNTERS, max(SKETCH, 1 << max(0, wanted - 1).bit_length()))


def size_of(docs: DataFrame) -> int:
    """Bytes of the files of a frame, as its plan has them."""
    return int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def ship_counts(docs: DataFrame, counts: np.ndarray):
    """The order of counts as a broadcast of bounded size: up to ``SKETCH`` numbers as they are, more of them in steps of a twelfth."""
    if len(counts) <= SKETCH:
        return docs.sparkSession.sparkContext.broadcast(counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64))
    steps = np.zeros(len(counts), np.uint8)
    for at in range(0, len(counts), SKETCH):
        steps[at : at + SKETCH] = np.minimum(255, 8 * np.log2(1.0 + counts[at : at + SKETCH]))
    return docs.sparkSession.sparkContext.broadcast(steps)


def deals(often: np.ndarray, level: int, bucket_rows: int) -> np.ndarray:
    """Buckets to which the posting list of a gram with these counts is dealt: 1 unless the gram alone exceeds a bucket.

    Grams that share a counter lift all counters alike, to ``level`` (the median),
    which grows with the corpus. Only what a counter has above that can be one gram,
    so that rare grams keep to one bucket at any corpus size.
    """
    above = np.maximum(0, often.astype(np.int64) - level)
    return np.maximum(1, -(-above // bucket_rows)).astype(np.uint64)


def make_postings(docs: DataFrame, key: str, text: str, counts: np.ndarray, ship, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """(rows of ROWS: every document, and packed postings by bucket; number of buckets)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    total = int(counts.sum())
    buckets = max(16, -(-total // (4 * bucket_rows)))
    level = int(np.median(counts))
    schema, mask = schema_of(ROWS.format(docs.schema[key].dataType.simpleString())), np.uint64(len(counts) - 1)
    crowded = np.flatnonzero(counts > level + bucket_rows)  # one for every bucket_rows grams at most
    times = deals(counts[crowded], level, bucket_rows)

    def salts_of(grams: np.ndarray) -> np.ndarray:
        """Buckets of each gram's list."""
        out = np.ones(len(grams), np.uint64)
        if len(crowded):
            slot = (grams & mask).astype(np.int64)
            at = np.minimum(np.searchsorted(crowded, slot), len(crowded) - 1)
            hit = crowded[at] == slot
            out[hit] = times[at[hit]]
        return out

    def run(batches):
        grams, order, arrow = Grams(gram), ship.value, to_arrow_schema(schema)
        seen, held, size, dealt = set(), [], 0, 0

        def flush():
            nonlocal held, size
            every = np.concatenate(held)
            held, size = [], 0
            salts = salts_of(every["gram"])
            bucket = (every["gram"] % np.uint64(buckets)).astype(np.int64) + (every["node"] % salts).astype(np.int64)
            bucket %= buckets
            by = np.lexsort((every["gram"], bucket))
            every, bucket = every[by], bucket[by]
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            rows = []
            for first, last in zip(starts, np.r_[starts[1:], len(bucket)]):
                rows.append((POSTINGS, None, None, None, int(bucket[first]), pack(every[first:last])))
            del every, bucket, by
            yield from batches_of(rows, arrow, 256)

        for piece in slices(batches):
            rows = []
            for doc, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                found = grams(t)
                n = len(found)
                node = grams.node(found) if n else None
                dealt += 1  # rows of documents only pass through: any bucket will do, and a hot set must not choose it
                rows.append((DOCUMENT, doc, n, node, dealt % buckets, None))
                if not n or doc is None or node in seen:
                    continue
                seen.add(node)
                first = rare_first(found, order)
                mine = np.zeros(len(first), POSTING)
                mine["gram"], mine["node"], mine["n"], mine["at"] = first & KEY, node, n, np.arange(len(first))
                mine["salted"] = salts_of(first) > 1
                held.append(mine)
                size += len(mine)
            yield from batches_of(rows, arrow)
            if size > bucket_rows:
                yield from flush()
        if held:
            yield from flush()

    return docs.select(key, text).mapInArrow(run, schema), buckets


def pack(part: np.ndarray) -> bytes:
    """Postings of a bucket, sorted by gram: gaps between grams and the other fields, byte by byte, compressed."""
    import zstandard

    gaps = np.diff(part["gram"], prepend=np.uint64(0))
    columns = [gaps, *(np.ascontiguousarray(part[f]) for f in POSTING.names[1:])]
    planes = [c.view(np.uint8).reshape(len(part), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    out = np.zeros(len(raw) // POSTING.itemsize, POSTING)
    at = 0
    for name in POSTING.names:
        width = POSTING[name].itemsize
        planes = raw[at : at + width * len(out)].reshape(width, len(out))
        out[name] = np.ascontiguousarray(planes.T).view(POSTING[name]).ravel()
        at += width * len(out)
    out["gram"] = np.cumsum(out["gram"], dtype=np.uint64)
    return out


def candidates(postings: np.ndarray, longest: int = LIST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, star edges, hubs of salted lists) of the posting lists of a bucket.

    Pairs went through the length filter and the positional filter: the shared gram
    stands at ``at``, so at most the rest of either set can be shared after it.
    """
    postings = postings[np.lexsort((postings["node"], postings["gram"]))]
    fresh = np.r_[True, (postings["gram"][1:] != postings["gram"][:-1]) | (postings["node"][1:] != postings["node"][:-1])] if len(postings) else np.zeros(0, bool)
    postings = postings[fresh]
    none = np.zeros((0, 2), np.uint64)
    if not len(postings):
        return none, none, none
    starts = np.flatnonzero(np.r_[True, postings["gram"][1:] != postings["gram"][:-1]])
    sizes = np.diff(np.r_[starts, len(postings)])
    salted = postings["salted"][starts] > 0
    pairs, stars, hubs = [none], [none], [none]
    for m in np.unique(sizes[(sizes > 1) & (sizes <= longest) & ~salted]):
        i, k = np.triu_indices(m, 1)
        same = starts[(sizes == m) & ~salted]
        for some in np.array_split(same, max(1, len(same) * len(i) // CHUNK)):
            x, y = postings[(some[:, None] + i).ravel()], postings[(some[:, None] + k).ravel()]
            nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
            rest = 1 + np.minimum(nx - x["at"] - 1, ny - y["at"] - 1)
            good = (WHOLE * np.minimum(nx, ny) >= SHARE * np.maximum(nx, ny)) & (rest >= needed_overlap(nx, ny))
            if good.any():
                pairs.append(np.unique(np.stack([x["node"][good], y["node"][good]], 1), axis=0))
    for first, size, salt in zip(starts, sizes, salted):
        if salt:
            hubs.append(np.array([[postings["gram"][first], postings["node"][first]]], np.uint64))
        if salt or size > longest:
            list_nodes = postings["node"][first : first + size]
            stars.append(np.stack([list_nodes[1:], np.full(size - 1, list_nodes[0])], 1))
    return tuple(np.unique(np.concatenate(x), axis=0) for x in (pairs, stars, hubs))


def find_candidates(rows: DataFrame, buckets: int, longest: int = LIST) -> DataFrame:
    """Rows of FOUND: documents as they are, candidate pairs, star edges and hubs."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = schema_of(FOUND.format(rows.schema["doc_id"].dataType.simpleString()))

    def run(batches):
        import pyarrow as pa

        arrow, held, now = to_arrow_schema(schema), [], None

        def edge_batches(kind: int, edges: np.ndarray):
            for at in range(0, len(edges), 65536):
                ends = edges[at : at + 65536].astype(np.int64)
                empty = [pa.nulls(len(ends), arrow.field(n).type) for n in ("doc_id", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), kind, np.int32)), *empty, *(pa.array(ends[:, k]) for k in (0, 1))], schema=arrow)

        def flush():
            if held:
                every = np.concatenate(held)
                held.clear()
                for kind, edges in zip((PAIR, STAR, HUB), candidates(every, longest)):
                    yield from edge_batches(kind, edges)

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in range(6)]
            documents = [(DOCUMENT, doc, n, node, None) for kind, doc, n, node, _, _ in zip(*columns) if kind == DOCUMENT]
            yield from batches_of(documents, arrow)
            for kind, bucket, blob in zip(columns[0], columns[4], columns[5]):
                if kind == POSTINGS:
                    if bucket != now:
                        yield from flush()
                        now = bucket
                    held.append(unpack(blob))
        yield from flush()

    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def suffix_apart(a: np.ndarray, b: np.ndarray, allowed: int, levels: int = 3) -> bool:
    """Suffix filter: whether the sizes between probe grams already differ too much.

    Probes split both sorted sets alike; the parts between two probes differ by the
    difference of their sizes at least.
    """
    probes = b[np.linspace(0, len(b) - 1, (1 << levels) + 1).astype(np.int64)[1:-1]]
    gaps = np.diff(np.r_[0, np.searchsorted(a, probes), len(a)]) - np.diff(np.r_[0, np.searchsorted(b, probes), len(b)])
    return int(np.abs(gaps).sum()) > allowed


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Verification of one pair of sorted sets, behind the length and suffix filters."""
    n, m = len(a), len(b)
    if not n or not m or WHOLE * min(n, m) < SHARE * max(n, m):
        return False
    need = needed_overlap(n, m)
    if suffix_apart(a, b, n + m - 2 * need):
        return False
    if n > m:
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) >= need


def fetch_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame, gram: int) -> DataFrame:
    """(node, cells, grams) of the wanted (node, rep, cells): the grams of one document of the node.

    Only candidate texts are hashed, and no text is shuffled. What is wanted is joined
    by broadcast while it is small enough. Beyond that, tables of a fixed size tell
    tasks which ids and sets may be wanted, and the sets of those are shuffled.
    Documents that repeat an id are counted first, and only where there are any the
    result is made distinct.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    few = (wanted.agg(F.sum(F.size("cells") + 1)).first()[0] or 0) <= BROADCAST_ROWS
    side = F.broadcast(wanted) if few else wanted
    ids = docs.select(F.col(key).alias("rep"))
    repeated = ids.join(side.select("rep"), "rep", "left_semi").groupBy("rep").count().filter("count > 1").limit(1).count()
    if not few:
        sets = sets_of(docs, key, text, wanted, gram).join(wanted, ["node", "rep"]).select("node", "cells", "grams")
        return sets.dropDuplicates(["node"]) if repeated else sets
    texts = docs.select(F.col(key).alias("rep"), F.col(text).alias("body")).join(side, "rep")
    schema = schema_of(f"node long, cells {wanted.schema['cells'].dataType.simpleString()}, grams array<long>")

    def run(batches):
        import pyarrow as pa

        grams, arrow = Grams(gram), to_arrow_schema(schema)
        for piece in slices(batches):
            found = [grams(t) for t in piece.column(2).to_pylist()]
            keep = [n for n, (x, node) in enumerate(zip(found, piece.column(0).to_pylist())) if grams.node(x) == node]
            for at in range(0, len(keep), 1024):
                some = keep[at : at + 1024]
                sets = pa.array([found[n].astype(np.int64) for n in some], arrow.field("grams").type)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(some), piece.column(1).take(some).cast(arrow.field("cells").type), sets], schema=arrow)

    found = texts.select("node", "cells", "body").mapInArrow(run, schema)
    return found.dropDuplicates(["node"]) if repeated else found


def sets_of(docs: DataFrame, key: str, text: str, wanted: DataFrame, gram: int, most: int = 1 << 24) -> DataFrame:
    """(node, rep, grams) of the documents that may be among the wanted (node, rep): all that are, and a few others.

    Two tables of 16 slots for each that is wanted, ``most`` at most, are broadcast as
    bits: the slots of wanted ids and those of wanted nodes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    slots = min(most, max(64, 1 << (16 * wanted.count()).bit_length()))
    place = lambda hashes: hashes.astype(np.uint64) * _MULTIPLIERS[0] >> np.uint64(64 - slots.bit_length() + 1)

    def bits(column):
        return np.packbits(tally(wanted.select(column), slots, lambda: lambda c: place(c.to_numpy()).astype(np.int64)) > 0)

    ship = docs.sparkSession.sparkContext.broadcast((bits(F.xxhash64("rep")), bits(F.col("node"))))
    schema = schema_of(f"node long, rep {docs.schema[key].dataType.simpleString()}, grams array<long>")

    def run(batches):
        import pyarrow as pa

        grams, arrow, (reps, nodes) = Grams(gram), to_arrow_schema(schema), ship.value

        def marked(table, hashes):
            at = place(hashes).astype(np.int64)
            return table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 > 0

        for piece in slices(batches):
            some = np.flatnonzero(marked(reps, piece.column(0).to_numpy()))
            if not len(some):
                continue
            found = [grams(t) for t in piece.column(2).take(pa.array(some)).to_pylist()]
            ids = np.array([grams.node(x) for x in found], np.int64)
            keep = np.flatnonzero(marked(nodes, ids))
            if len(keep):
                sets = pa.array([found[n].astype(np.int64) for n in keep], arrow.field("grams").type)
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), piece.column(1).take(pa.array(some[keep])).cast(arrow.field("rep").type), sets], schema=arrow)

    return docs.filter(F.col(key).isNotNull()).select(F.xxhash64(key), key, text).mapInArrow(run, schema)


def arrays_of(column) -> list[np.ndarray]:
    """The lists of an Arrow column as numpy views."""
    values, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), 0
    out = []
    for size in np.diff(column.offsets.to_numpy()):
        out.append(values[at : at + size])
        at += size
    return out


def verify_pairs(nodes: np.ndarray, side: np.ndarray, grams: list[np.ndarray], order: np.ndarray, diagonal: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between the two sides of a cell (or within one).

    Sets that share a gram of their prefixes are candidates; those that pass the
    length and positional filters and are not connected yet are verified, each pair
    once.
    """
    left = np.flatnonzero(side == 0)
    right = left if diagonal else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return []
    sizes = np.array([len(g) for g in grams], np.int64)
    prefixes = {i: rare_first(grams[i], order) for i in {*left.tolist(), *right.tolist()}}
    lengths = [len(prefixes[i]) for i in left.tolist()]
    flat, owner, place = np.concatenate([prefixes[i] for i in left.tolist()]), np.repeat(left, lengths), np.concatenate([np.arange(n) for n in lengths])
    by = np.argsort(flat, kind="stable")
    flat, owner, place = flat[by], owner[by], place[by]
    tree = np.arange(len(nodes))  # the number of a set's tree in the forest
    out = []
    for j in right.tolist():
        first, last = np.searchsorted(flat, prefixes[j]), np.searchsorted(flat, prefixes[j], side="right")
        spans = last - first
        where = np.repeat(first - np.r_[0, np.cumsum(spans)[:-1]], spans) + np.arange(spans.sum())
        mine = np.repeat(np.arange(len(spans)), spans)
        if diagonal:
            earlier = owner[where] < j
            where, mine = where[earlier], mine[earlier]
        met, at = np.unique(owner[where], return_index=True)  # the first gram that two sets share
        there, here = place[where[at]], mine[at]
        n, m = sizes[met], sizes[j]
        rest = 1 + np.minimum(n - there - 1, m - here - 1)
        good = (tree[met] != tree[j]) & (WHOLE * np.minimum(n, m) >= SHARE * np.maximum(n, m)) & (rest >= needed_overlap(n, m))
        for i in met[good].tolist():
            if tree[i] != tree[j] and linked(grams[i], grams[j]):
                tree[tree == tree[i]] = tree[j]
                out.append((int(nodes[i]), int(nodes[j])))
    return out


CELL = ("kind", "label", "i", "k")


def cells_of(frame: DataFrame, **columns) -> DataFrame:
    """(node, cell) rows: a cell is (kind, label, i, k), and the side of the node in it."""
    return frame.select("node", F.struct(*[F.lit(columns[c]).cast("int").alias(c) if isinstance(columns[c], int) else columns[c].cast("long").alias(c) for c in (*CELL, "side")]).alias("cell"))


def verify(docs: DataFrame, key: str, text: str, cells: DataFrame, reps: DataFrame, ship, gram: int, scratch: Scratch, name: str) -> DataFrame:
    """(a, b): links of the pairs that meet in the cells, from (node, cell) rows."""
    import pyarrow as pa

    wanted = cells.groupBy("node").agg(F.collect_set("cell").alias("cells")).join(reps, "node")
    wanted = scratch.save(wanted.select("node", "rep", "cells"), f"{name}-wanted")
    sets = fetch_sets(docs, key, text, wanted, gram).select("node", F.explode("cells").alias("cell"), "grams").select("cell.*", "node", "grams")

    def work(rows):
        rows = rows.combine_chunks()
        diagonal = rows["i"][0].as_py() == rows["k"][0].as_py() and not rows["kind"][0].as_py() == MIXED
        column = lambda c: rows[c].chunk(0) if rows[c].num_chunks else rows[c].combine_chunks()
        found = verify_pairs(column("node").to_numpy(), column("side").to_numpy(), arrays_of(column("grams")), ship.value, diagonal)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    links = scratch.save(sets.groupBy(*CELL).applyInArrow(work, "a long, b long"), f"{name}-links")
    scratch.settle()
    return links


#: Cells of explicit pairs, of the blocks of a star, and of a star's largest part against the rest.
PAIRED, STARRED, MIXED, APART = range(4)


def members(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) of all nodes of a graph of (node, other), the smallest ones included."""
    near = connected_components(edges, scratch, name, "node", "other")
    return scratch.save(near.unionByName(near.select(F.col("label").alias("node"), "label")).distinct(), f"{name}-members")


def in_blocks(groups: DataFrame, scratch: Scratch, name: str, block: int) -> DataFrame:
    """Groups (node, label) with the number of blocks of a group and the block of a node."""
    blocks = scratch.save(groups.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")), f"{name}-blocks")
    return groups.join(blocks, "label").select("node", "label", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))


def first_cells(pairs: DataFrame, stars: DataFrame, scratch: Scratch, block: int) -> tuple[DataFrame, DataFrame]:
    """(node, cell) rows of the first round, and the stars of groups larger than a block as (node, label, blocks, block)."""
    near = scratch.save(in_blocks(members(pairs.unionByName(stars), scratch, "near"), scratch, "near", block), "near-placed")
    large = near.filter("blocks > 1").select("node")
    close = scratch.save(in_blocks(members(stars.join(large, "node", "left_semi"), scratch, "close"), scratch, "close", block), "close-placed")
    zero = F.lit(0)
    cells = cells_of(near.filter("blocks = 1"), kind=PAIRED, label=F.col("label"), i=zero, k=zero, side=zero)
    cells = cells.unionByName(cells_of(close, kind=STARRED, label=F.col("label"), i=F.col("block"), k=F.col("block"), side=zero))
    hubs = close.filter("node = label").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.unionByName(cells_of(hubs, kind=STARRED, label=F.col("label"), i=F.col("at"), k=F.col("at"), side=zero))
    ends = near.filter("blocks > 1").select("node", "label", "block"), near.filter("blocks > 1").select(F.col("node").alias("other"), F.col("block").alias("far"))
    inside = close.select("node", F.col("label").alias("one")), close.select(F.col("node").alias("other"), F.col("label").alias("two"))
    loose = pairs.join(ends[0], "node").join(ends[1], "other").join(inside[0], "node", "left").join(inside[1], "other", "left").filter("one IS NULL OR two IS NULL OR one <> two")
    low, high = F.least("block", "far"), F.greatest("block", "far")
    for node, mine in (("node", "block"), ("other", "far")):
        one = loose.select(F.col(node).alias("node"), "label", low.alias("i"), high.alias("k"), (F.col(mine) > low).cast("int").alias("side"))
        cells = cells.unionByName(cells_of(one, kind=PAIRED, label=F.col("label"), i=F.col("i"), k=F.col("k"), side=F.col("side")))
    return cells, close


def second_cells(close: DataFrame, links: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """(node, cell) rows that compare what a star has outside its largest connected part with all of the star."""
    parts = members(links.withColumnsRenamed({"a": "node", "b": "other"}), scratch, "first").withColumnRenamed("label", "part")
    star = scratch.save(close.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "star-parts")
    sizes = star.groupBy("label", "part").agg(F.count(F.lit(1)).alias("size"))
    shape = sizes.groupBy("label").agg(F.max(F.struct("size", "part")).alias("most"), F.sum("size").alias("all"))
    shape = shape.filter("all > most.size").select("label", F.col("most.part").alias("main"), F.ceil((F.col("all") - F.col("most.size")) / block).alias("rests"))
    shape = scratch.save(shape, "star-shapes")
    star = star.join(shape, "label").withColumn("rest", F.pmod(F.xxhash64("node", F.lit(1)), F.col("rests")))
    count = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    main, rest = star.filter("part = main").withColumn("at", F.explode(count("rests"))), star.filter("part <> main")
    cells = cells_of(main, kind=MIXED, label=F.col("label"), i=F.col("block"), k=F.col("at"), side=F.lit(0))
    cells = cells.unionByName(cells_of(rest.withColumn("at", F.explode(count("blocks"))), kind=MIXED, label=F.col("label"), i=F.col("at"), k=F.col("rest"), side=F.lit(1)))
    apart = rest.withColumn("at", F.explode(count("rests")))
    return cells.unionByName(cells_of(apart, kind=APART, label=F.col("label"), i=F.least("rest", "at"), k=F.greatest("rest", "at"), side=F.when(F.col("rest") > F.col("at"), 1).otherwise(0)))


def grouped_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", gram: int = GRAM, longest: int = LIST, block: int = BLOCK, bucket_rows: int = BUCKET_ROWS, sketch: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n, node, component, first) of every row of ``docs``.

    ``component`` is the smallest id of the row's group and ``first`` the node of a
    text that has it: groups are of nodes, as an id may stand for several texts.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    counts = count_sketch(docs, text, sketch or counters_for(size_of(docs)), gram)
    ship = ship_counts(docs, counts)
    rows, buckets = make_postings(docs, key, text, counts, ship, gram, bucket_rows)
    found = scratch.save(find_candidates(rows, buckets, longest), "found")
    scratch.settle()
    documents = found.filter(F.col("kind") == DOCUMENT)
    classes = documents.filter("node IS NOT NULL").groupBy("node", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("rep IS NOT NULL")
    classes = scratch.save(classes, "classes")
    reps = classes.select("node", "rep")

    pairs = scratch.save(found.filter(F.col("kind") == PAIR).select(F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other")).distinct(), "pairs")
    hubs = found.filter(F.col("kind") == HUB).select(F.col("node").alias("gram"), F.col("other").alias("hub"))
    top = hubs.groupBy("gram").agg(F.min("hub").alias("top"))
    stars = found.filter(F.col("kind") == STAR).select("node", "other").unionByName(hubs.join(top, "gram").select(F.col("hub").alias("node"), F.col("top").alias("other")))
    stars = scratch.save(stars.distinct(), "stars")

    cells, close = first_cells(pairs, stars, scratch, block)
    links = verify(docs, key, text, cells, reps, ship, gram, scratch, "one")
    if close.limit(1).count():
        again = scratch.save(second_cells(close, links, scratch, block), "again")
        if again.limit(1).count():
            links = links.unionByName(verify(docs, key, text, again, reps, ship, gram, scratch, "two"))
    linked_nodes = members(links.withColumnsRenamed({"a": "node", "b": "other"}), scratch, "links")
    firsts = scratch.save(linked_nodes.join(reps, "node").groupBy("label").agg(F.min(F.struct("rep", "node")).alias("least")), "firsts")
    labels = linked_nodes.join(firsts, "label").select("node", F.col("least.rep").alias("component"), F.col("least.node").alias("first"))

    moved = classes.join(labels, "node", "left").select("node", "n", "rep", "copies", F.coalesce("component", "rep").alias("component"), F.coalesce("first", "node").alias("first"))
    moved = scratch.save(moved.filter("copies > 1 OR component <> rep OR first <> node").select("node", "n", "component", "first"), "moved")
    scratch.drop_but("found", "moved")
    joined = documents.select("doc_id", "n", "node").join(moved, ["node", "n"], "left")
    return joined.select("doc_id", "n", "node", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component"), F.coalesce("first", "node").alias("first"))


def jaccard_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``docs``; options of ``grouped_rows``."""
    return grouped_rows(docs, text, key, **options).select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def with_node(docs: DataFrame, text: str, name: str, gram: int = GRAM) -> DataFrame:
    """``docs`` and the node of every row's text in a last column; -1 where the set is empty."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    schema, at = StructType([*docs.schema.fields]).add(name, LongType()), docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        grams, arrow = Grams(gram), to_arrow_schema(schema)
        for piece in slices(batches):
            sets = [grams(t) for t in piece.column(at).to_pylist()]
            nodes = pa.array([grams.node(x) if len(x) else -1 for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*piece.columns, nodes], schema=arrow)

    return docs.mapInArrow(run, schema)


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their group; rows without id stay.

    Texts are not shuffled while the ids that go are few enough to broadcast. Rows
    that repeat an id are decided by their own texts, and of those with equal sets
    one stays.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    inner = Scratch(docs.sparkSession, "jaccard")
    groups = scratch.save(grouped_rows(docs, text, key, scratch=inner, **options), "groups")
    inner.drop()
    stays = (F.col("doc_id") == F.col("component")) & F.col("node").eqNullSafe(F.col("first"))
    gone = groups.filter(F.col("doc_id").isNotNull() & ~stays).select(F.col("doc_id").alias("id")).distinct()
    again = groups.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).count().filter("count > 1").select("id")
    again = scratch.save(again, "again")
    repeated = again.limit(1).count()
    gone = gone.unionByName(again).distinct() if repeated else gone
    few = gone.count() <= BROADCAST_ROWS
    gone = F.broadcast(gone) if few else gone
    kept = docs.join(gone, docs[key] == gone["id"], "left_anti")
    if not repeated:
        return kept
    name = f"{key} node"
    rows = with_node(docs.join(again, docs[key] == again["id"], "left_semi"), text, name, options.get("gram", GRAM))
    firsts = groups.filter(stays).select(F.col("doc_id").alias("id"), F.coalesce("node", F.lit(-1)).alias("set")).join(again, "id", "left_semi").distinct()
    rows = rows.join(firsts, (rows[key] == firsts["id"]) & (rows[name] == firsts["set"]), "left_semi")
    return kept.unionByName(rows.dropDuplicates([key, name]).drop(name))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


SQL = {
    "op10_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)"""
}
QUERIES = {"op10_jaccard_join": op10_jaccard_join}
