"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 13 consecutive words of a benchmark item (all its words if it has
fewer). A matcher holds, for the windows of one length, a shift table of word pairs that lets the
scan jump over positions where no window can end, buckets by the last pair (and, within one, by
the first pair), and compares the words of a bucket's windows directly.

Items are cut into blocks of bounded size; every document passes through the matchers of all blocks
in one chain of narrow stages, so neither a join nor a shuffle is needed and no matcher is larger
than a block. Null and empty texts have no words and no hits; repeated rows are judged each alike;
an empty benchmark leaves every document clean. Items with a null id or no words are no patterns.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import LOWER_ALNUM, texts_of, unpacked, with_found

WINDOW = 13
#: Text bytes of the items of one block. An item longer than that makes a block of its own.
BLOCK_BYTES = 16 << 20
FOUND = "struct<n_words: bigint, spans: array<bigint>, items: array<string>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER_ALNUM).split()


@dataclass
class Matcher:
    """Wu-Manber tables for windows of one length, in words."""

    length: int
    shift: dict[tuple[bytes, ...], int] = field(default_factory=dict)
    buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[list[bytes], set[str]]]]] = field(
        default_factory=dict
    )

    @property
    def block(self) -> int:
        return min(2, self.length)

    def add(self, window: list[bytes], item: str) -> None:
        b = self.block
        for end in range(b, self.length + 1):
            part = tuple(window[end - b:end])
            self.shift[part] = min(self.shift.get(part, self.length), self.length - end)
        same = self.buckets.setdefault(tuple(window[-b:]), {}).setdefault(tuple(window[:b]), [])
        for other, items in same:
            if other == window:
                items.add(item)
                return
        same.append((window, {item}))

    def scan(self, words: Sequence[bytes], spans: list[tuple[int, int]], items: set[str]) -> None:
        """Adds the word ranges of all occurrences and the items they belong to."""
        m, b = self.length, self.block
        longest, shift, buckets = m - b + 1, self.shift, self.buckets
        end, n = m, len(words)
        while end <= n:
            part = tuple(words[end - b:end])
            step = shift.get(part, longest)
            if step == 0:
                start = end - m
                for window, owners in buckets[part].get(tuple(words[start:start + b]), ()):
                    if words[start:end] == window:
                        spans.append((start, end))
                        items |= owners
                step = 1
            end += step


def matchers(items: Iterable[tuple[str, bytes]], window: int = WINDOW) -> list[Matcher]:
    by_length: dict[int, Matcher] = {}
    for item, text in items:
        words = words_of(text)
        if not words:
            continue
        m = min(window, len(words))
        matcher = by_length.setdefault(m, Matcher(m))
        for start in range(len(words) - m + 1):
            matcher.add(words[start:start + m], item)
    return [by_length[m] for m in sorted(by_length)]


def search(words: Sequence[bytes], tables: Iterable[Matcher]) -> tuple[list[int], set[str]]:
    """Merged word ranges (start, end, start, end, ...) and the items that occur."""
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for table in tables:
        table.scan(words, spans, items)
    merged: list[int] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [start, end]
    return merged, items


def merge(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in hash-dealt blocks whose expected size stays under half of ``block_bytes``."""
    own = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("string").alias("item"), F.col("text")
    )
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    if blocks == 1:
        return [own]
    place = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    return [own.where(place == k) for k in range(blocks)]


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``row`` and ``found`` (n_words, spans, items) of every document."""
    spark: SparkSession = docs.sparkSession
    out = None
    for block in item_blocks(benchmark, block_bytes):
        items = [(r["item"], r["text"].encode()) for r in block.toLocalIterator()]
        sent = spark.sparkContext.broadcast(items)

        def make(sent=sent, first=out is None):
            tables = matchers(sent.value, window)

            def work(rows: pa.StructArray) -> pa.Array:
                before = None if first else rows.field(1).to_pylist()
                result = []
                for k, text in enumerate(texts_of(rows if first else rows.field(0))):
                    words = words_of(text)
                    spans, items = search(words, tables)
                    if before is not None:
                        spans, items = merge(spans, before[k]["spans"]), items | set(before[k]["items"])
                    result.append({"n_words": len(words), "spans": spans, "items": sorted(items)})
                return pa.array(result, pa.struct([
                    ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())),
                ]))

            return work

        if out is None:
            out = with_found(docs, make, FOUND)
        else:  # the row of a later block is the pair of the first row and what was found before
            out = with_found(out, make, FOUND).select(F.col("row.row").alias("row"), "found")
    return out


def n_hit(found: str = "found") -> Column:
    """Words inside the merged ranges."""
    spans = F.col(f"{found}.spans")
    odd = F.filter(spans, lambda _, i: i % 2 == 1)
    even = F.filter(spans, lambda _, i: i % 2 == 0)
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    return F.aggregate(odd, zero, add) - F.aggregate(even, zero, add)


def contaminated(found: str = "found") -> Column:
    return (n_hit(found) > 0) & (20 * n_hit(found) >= F.col(f"{found}.n_words"))


def digest(found: DataFrame) -> DataFrame:
    """One row per document with counts, the digest of its items, and the verdict."""
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.col("found.n_words").alias("n_words"), n_hit().alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("found.items"), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their columns."""
    return unpacked(find_benchmark(docs, benchmark).where(~contaminated()))
