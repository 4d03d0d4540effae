"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

A text's ids are those of the pattern's matches in turn, each merged by the ranks. A long text is encoded
in blocks cut where a match always starts, whatever stands around: between a symbol that is not white
space and one that is (only the first symbol of a match with other symbols may be white space), and
before the last symbol of a run of white space that others follow (the pattern leaves that symbol to the
next match). A very long run of white space, at which the library's pattern engine fails, is one match
up to there and goes to the merges directly. So blocks bound the library's work, and no id changes.

Ids are kept as little-endian unsigned 32-bit integers in a binary column, the form of token shards.
Decoding joins the ids' byte strings; nothing is read as text, so ids that end inside a symbol are fine.

Null texts are empty and have no ids. Repeated rows give equal ids. Very long texts need a task to hold
the text, its ids and one block. An empty table gives an empty result; extra columns pass untouched.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import texts_of, unpacked, with_found

#: Code points from which a text is cut into blocks, and of a run of white space that goes alone.
BLOCK, RUN = 1 << 16, 1 << 12

# fixed values: the code points with the Unicode property White_Space
_WHITE = "\t-\r \x85\xa0  -     　"


def blocks(text: str, block: int = BLOCK, run: int = RUN) -> Iterator[tuple[str, bool]]:
    """Parts of a text whose ids, one after the other, are the text's; True marks a part that is one match."""
    if len(text) <= min(block, run):
        yield text, False
        return
    edge, long_run = re.compile(f"[^{_WHITE}][{_WHITE}]"), re.compile(f"[{_WHITE}]{{{run},}}")
    at = 0
    while at < len(text):
        white = long_run.search(text, at)
        end = white.start() if white else len(text)
        while end - at > block:
            found = edge.search(text, at + block - 1, end)
            cut = found.start() + 1 if found else end
            yield text[at:cut], False
            at = cut
        if end > at:
            yield text[at:end], False
        at = end
        if white:
            at = white.end() - (white.end() < len(text))
            yield text[end:at], True


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, block: int = BLOCK, run: int = RUN) -> np.ndarray:
        parts = [
            np.array(self.encoding._encode_single_piece(part), "<u4") if single
            else np.array(self.encoding.encode_ordinary(part), "<u4")
            for part, single in blocks(text, block, run)
        ]
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.encoding.decode_bytes(ids[at:at + BLOCK].tolist()) for at in range(0, len(ids), BLOCK))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker and rank file."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """The rows with ``n_tokens`` and ``ids`` of a text column. Executors read the rank file at ``path``."""

    def make():
        known = codec(path, pattern)

        def work(row: pa.StructArray) -> pa.Array:
            ids = [known.encode(text.decode()) for text in texts_of(row, column)]
            return pa.StructArray.from_arrays(
                [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["n_tokens", "ids"],
            )

        return work

    found = with_found(docs, make, "n_tokens long, ids binary")
    return unpacked(found, n_tokens=F.col("found")["n_tokens"], ids=F.col("found")["ids"])


def decode(rows: DataFrame, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the bytes that a column of ids stands for; missing ids give no bytes."""

    def make():
        known = codec(path, pattern)

        def work(row: pa.StructArray) -> pa.Array:
            ids = row.field(row.type.get_field_index(column)).to_pylist()
            return pa.array([known.decode(np.frombuffer(x or b"", "<u4")) for x in ids], pa.binary())

        return work

    return unpacked(with_found(rows, make, "binary"), decoded=F.col("found"))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: number of ids, and hashes of the ids and of the bytes they decode to."""
    coded = encode(docs.select("doc_id", "text"), path, pattern).select("doc_id", "n_tokens", "ids")
    return decode(coded, path, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
