"""Sequence packing by Karmarkar-Karp multiway differencing.

A document becomes token ids plus one end id. Full sequences are cut off its
front; they need no packing. The rest is cut into pieces of at most ``piece``
ids, and the pieces of a block of documents are dealt to windows by multiway
differencing: every piece starts as a partial partition with one filled window;
the two partitions with the largest imbalance are merged, the fullest windows of
one onto the emptiest of the other, until one is left. Its windows are near-equal.
The number of windows starts at the least that could hold the block; whenever a
window exceeds the capacity it rises by one and the block is dealt anew.

Blocks are runs of rows inside a task, of ``BLOCK`` documents or ``BLOCK_IDS`` ids,
whichever comes first: nothing is shuffled, a task holds the ids of one block, and
a lost task is redone from its own input. A block's padding does not depend on the
size of the corpus; a partition of few documents pads its last window.

Defined results: null text is empty text, whose only id is the end id; repeated
rows are packed each on its own; an empty table gives no pieces; a text of any
length is cut into as many sequences as it fills.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.rows import schema_of, slices
from tessera.session import table

CAPACITY = 1024
#: Longest piece of a rest, in ids; smaller pieces give less padding and more cuts.
PIECE = 256
#: Documents dealt together, and ids after which a block ends early.
BLOCK, BLOCK_IDS = 512, 4 << 20
END_ID = 0
#: Blanks in a row that are encoded apart from the rest of their text.
LONG_BLANKS = 1 << 16
#: The blanks of the pattern that splits texts, which are fewer than Python's.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest is shifted up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Encoder:
    """Token ids of a byte-level BPE vocabulary, the same as ``tokenizers`` gives with the defaults of its file.

    A text is cut at the added tokens of the file, which are ids of their own. The
    vocabulary of the file is read into ``tiktoken``, whose ids of ordinary text are
    equal and which is several times faster. Its pattern keeps a place to come back
    to for every blank of a run and fails at a million of them, so a long run is cut
    out first: all of it but a last blank before other text is one word of the
    pattern, and is encoded as one.
    """

    def __init__(self, path: str, long_blanks: int = LONG_BLANKS):
        import json
        import re
        from functools import cache, partial

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_alphabet()
        added = model.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take in blanks or stand alone are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        self.marks = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")") if added else None
        ranks = {bytes(letters[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in self.added}
        load = partial(tiktoken.Encoding, "vocabulary", mergeable_ranks=ranks, special_tokens={})
        self.encode = load(pat_str=public_tokenizers.PATTERN).encode_ordinary
        self.blanks = cache(lambda: load(pat_str=r"\s+").encode_ordinary)  # few tasks need it
        self.long_blanks, self.runs = long_blanks, re.compile(f"(?<![{BLANK}])[{BLANK}]{{{long_blanks},}}")

    def ids(self, text: str) -> list[int]:
        if self.marks is None or not any(t in text for t in self.added):
            return self.plain(text)
        out = []
        for part in self.marks.split(text):
            out += [self.added[part]] if part in self.added else self.plain(part)
        return out

    def plain(self, text: str) -> list[int]:
        if len(text) < self.long_blanks:
            return self.encode(text)
        out, at = [], 0
        for run in self.runs.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self.encode(text[at : run.start()])
            out += self.blanks()(text[run.start() : end])
            at = end
        return out + self.encode(text[at:]) if at else self.encode(text)


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of every item by multiway differencing."""
    heap, merges = [], []
    for n, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        heap.append((-int(size), n, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        merges.append((i, j, order))
        heapq.heappush(heap, (-int(sums[0]), len(sizes) + len(merges) - 1, sums))
    where: dict[int, np.ndarray] = {heap[0][1]: np.arange(windows)} if heap else {}
    for n in range(len(merges) - 1, -1, -1):
        i, j, order = merges[n]
        mine = where.pop(len(sizes) + n)
        for child, slots in ((i, order), (j, windows - 1 - order)):
            where[child] = target = np.empty(windows, np.int64)
            target[slots] = mine
    return np.array([where[n][0] for n in range(len(sizes))], np.int64)


def balanced_windows(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(window of every item, number of windows), no window above ``capacity``."""
    if not len(sizes):
        return np.zeros(0, np.int64), 0
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        dealt = difference(sizes, windows)
        if np.bincount(dealt, sizes, windows).max() <= capacity:
            return dealt, windows
        windows += 1


def cut(total: int, capacity: int, piece: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, length) of a document's full sequences and of the pieces of its rest."""
    full = total // capacity
    rest = [(at, min(piece, total - at)) for at in range(full * capacity, total, piece)]
    return [(n * capacity, capacity) for n in range(full)], rest


def pack_block(block: list[tuple], capacity: int, piece: int, first_id: int) -> tuple[list[tuple], int]:
    """Rows of PIECES for [(key, ids)], and the number of sequences made."""
    rows, loose, made = [], [], 0
    for key, ids in block:
        full, rest = cut(len(ids), capacity, piece)
        for start, length in full:
            rows.append((key, start, length, len(ids), first_id + made, 0, ids[start : start + length].tobytes()))
            made += 1
        loose += ((key, ids, start, length) for start, length in rest)
    sizes = np.array([x[3] for x in loose], np.int64)
    dealt, windows = balanced_windows(sizes, capacity)
    filled = [0] * windows
    for (key, ids, start, length), window in zip(loose, dealt.tolist()):
        rows.append((key, start, length, len(ids), first_id + made + window, filled[window], ids[start : start + length].tobytes()))
        filled[window] += length
    return rows, made + windows


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, piece: int = PIECE, block: int = BLOCK, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``key`` and the columns of PIECES, a row for every piece; ``ids`` are little-endian unsigned 32-bit.

    ``sequence_id`` is the task's number in the upper bits and a count in the lower
    40, as ``monotonically_increasing_id`` does it.
    """
    schema = schema_of(f"{key} {docs.schema[key].dataType.simpleString()}, {PIECES}")

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, encoder = to_arrow_schema(schema), Encoder(tokenizer)
        next_id, held, size = TaskContext.get().partitionId() << 40, [], 0

        def flush():
            nonlocal next_id, held, size
            rows, made = pack_block(held, capacity, piece, next_id)
            next_id, held, size = next_id + made, [], 0
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*part), arrow)], schema=arrow)

        for batch in slices(batches):
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encoder.ids(t or ""), end_id], "<u4")
                held.append((k, ids))
                size += len(ids)
                if len(held) >= block or size > block_ids:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select(key, text).mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op1_packing": op1_packing}
SQL: dict[str, str] = {}
