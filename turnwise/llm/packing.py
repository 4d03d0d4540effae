"""Best-fit packing of tokenised documents into sequences of a fixed length.

Best-fit decreasing needs only how many pieces there are of each length, because equal lengths
are interchangeable. Spark tokenises, cuts and counts; the driver runs the placement over the
counts (at most one per length, so bounded by the capacity), with a segment tree over remaining
capacities that finds the tightest open bin in logarithmic time; Spark then gives every piece its
place by its number among the pieces of its length. The placement is the one that best fit
decreasing finds over the whole corpus, not per partition.

Null texts are empty and still hold the closing id. Repeated rows are packed each. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import bounded_batches, located, materialise, number_within

CAPACITY = 2048
END_ID = 0
#: Words a Python worker remembers with their ids; the memory is emptied when it is full.
REMEMBERED = 600_000
#: Rank bits below a length in the sorted key of a placement.
RANK_BITS = 44

_PLAIN = re.compile(r"([A-Za-z]+)([!#$%&*,.:;?|]*)")
#: White space that Python splits at and the tokenizer may not.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")
_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


class WordIds:
    """Token ids of whole texts, one white-space word at a time.

    The tokenizer's vocabulary joins no symbols across white space, so the ids of a text are those
    of its words in turn. Plain words go to the model directly, others through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}

    def _plain(self, piece: str) -> bytes:
        if piece not in self.known:
            self.known[piece] = array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()
        return self.known[piece]

    def word(self, word: str) -> bytes:
        parts = _PLAIN.fullmatch(word)
        if parts:
            letters, marks = parts.groups()
            return self._plain(letters.lower()) + (self._plain(marks) if marks else b"")
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def text(self, text: str) -> bytes:
        """Ids as native unsigned 32-bit integers."""
        words = _SPACE.split(text) if _ODD_SPACE.search(text) else text.split()
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= 64:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """piece, start, length and crc32 of the cuts of one document."""
    if not np.little_endian:
        ids = np.frombuffer(ids, "=u4").astype("<u4").tobytes()
    n = len(ids) // 4
    for piece, start in enumerate(range(0, n, capacity)):
        length = min(capacity, n - start)
        yield piece, start, length, zlib.crc32(memoryview(ids)[4 * start:4 * (start + length)])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the closing id, cut to the capacity."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer_path)
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in pieces_of(ids.text(text or "") + end, capacity):
                    for column, value in zip(columns, (doc_id, *piece), strict=True):
                        column.append(value)
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


class CapacityTree:
    """Segment tree over remaining capacities; a leaf counts the open runs of bins with that capacity."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.tree = [0] * (2 * self.size)

    def add(self, remaining: int, change: int) -> None:
        node = remaining + self.size
        while node:
            self.tree[node] += change
            node //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of an open bin that is at least ``least``."""
        node = least + self.size
        if self.tree[node]:
            return least
        while node > 1:  # up to the first right neighbour with an open bin, then down its left edge
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


@dataclass(frozen=True)
class Placement:
    """Pieces ``rank .. rank + count - 1`` of a length: ``per_bin`` each into bins from ``first_bin`` on."""

    length: int
    rank: int
    count: int
    per_bin: int
    first_bin: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[Placement]:
    """Places all pieces, longest first, each into the tightest open bin that holds it.

    Bins with equal remaining capacity are kept as runs of bin numbers; a run takes equal pieces at
    once, which is what best fit does with them one by one, as a bin that took a piece is tighter
    than its equals.
    """
    tree = CapacityTree(capacity)
    open_runs: dict[int, list[tuple[int, int]]] = {}
    out: list[Placement] = []
    bins = 0

    def push(remaining: int, first: int, count: int) -> None:
        if remaining > 0 and count > 0:
            open_runs.setdefault(remaining, []).append((first, count))
            tree.add(remaining, 1)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining = capacity
                first, count = bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = open_runs[remaining].pop()
                tree.add(remaining, -1)
            fits = remaining // length
            full = min(count, left // fits)
            if full:
                out.append(Placement(length, rank, full * fits, fits, first, capacity - remaining))
                push(remaining - fits * length, first, full)
                rank, left = rank + full * fits, left - full * fits
            first, count = first + full, count - full
            if left and count:
                out.append(Placement(length, rank, left, left, first, capacity - remaining))
                push(remaining - left * length, first, 1)
                first, count, left = first + 1, count - 1, 0
            push(remaining, first, count)
    return out


def placing(plan: list[Placement]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Looks up each piece's bin and offset by its length and its number in that length."""
    ordered = sorted(plan, key=lambda p: (p.length, p.rank))
    table = np.array(
        [(p.length << RANK_BITS | p.rank, p.rank, p.per_bin, p.first_bin, p.offset) for p in ordered], np.int64
    ).reshape(-1, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = table[np.searchsorted(table[:, 0], length << RANK_BITS | rank, side="right") - 1]
            within = rank - at[:, 1]
            found = {
                "sequence_id": at[:, 3] + within // at[:, 2],
                "offset": at[:, 4] + within % at[:, 2] * length,
            }
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in keep], *[pa.array(v) for v in found.values()]], [*keep, *found]
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with the sequence it lies in and its place there.

    The pieces (no ids) are written once; the counts by length are at most ``capacity`` rows.
    """
    pieces = materialise(token_pieces(docs, tokenizer_path, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = best_fit_decreasing(counts, capacity)
    ranked = number_within(located(pieces), ["length"], "rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*pieces.columns, "rank").mapInArrow(
        placing(plan), f"{schema}, sequence_id long, offset long"
    ).withColumn("offset", F.col("offset").cast("long"))
