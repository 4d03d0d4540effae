"""Fill-in-middle transformation by block rotation in place.

A text's units are runs of ASCII letters and single other code points. Two cuts, drawn from a hash of
the document's id, part it into prefix, middle and suffix. A scan over the UTF-8 bytes finds the bytes
where the cut units start; the sentinels go into a bytearray in reading order, ``<P>prefix<M>middle<S>suffix``.
The two forms are rotations of neighbouring blocks of it, each done by three reversals in place:

* ``psm``: ``<M>middle`` and ``<S>suffix`` change places: ``<P>prefix<S>suffix<M>middle``;
* ``spm``: ``<P>prefix<M>middle`` and ``<S>suffix`` change places: ``<S>suffix<P>prefix<M>middle``.

``restored`` needs only output and form: it finds the sentinels (a text that holds one stays plain, so
each stands once), rotates back and takes the sentinels out, which gives the text's exact bytes.

Null texts are empty; empty texts, texts with a sentinel and a tenth of all others stay plain. A missing
id is hashed as empty text. Repeated rows give equal results; a cut may leave any part empty, also two
equal cuts. Very long texts are scanned in blocks, so a task holds a text, its output and one block. An
empty table gives an empty result. Extra columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import texts_of, unpacked, with_found

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
#: Of 100 texts, those that are transformed, and of 100 transformed ones, those with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Bytes that a scan or a reversal holds beside the text.
SCANNED = 1 << 20
REVERSED = 1 << 16

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FOLLOW = np.zeros(256, bool)
_FOLLOW[128:192] = True


def starts(text: bytes) -> Iterator[np.ndarray]:
    """Places of the bytes that start a unit, block by block."""
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw), SCANNED):
        block = raw[at:at + SCANNED]
        letter = _LETTER[block]
        before = np.r_[bool(at and _LETTER[raw[at - 1]]), letter[:-1]]
        yield at + np.flatnonzero(~_FOLLOW[block] & ~(letter & before))


def place_of(text: bytes, unit: int) -> int:
    """The byte where a unit starts; the text's end for the number after the last."""
    for found in starts(text):
        if unit < len(found):
            return int(found[unit])
        unit -= len(found)
    return len(text)


def reverse(data: np.ndarray, start: int, end: int) -> None:
    """Reverses a range in place, by pairs of small blocks from its two ends."""
    while end - start > 1:
        k = min(REVERSED, (end - start) // 2)
        left, right = data[start:start + k], data[end - k:end]
        held = left[::-1].copy()
        left[:] = right[::-1]
        right[:] = held
        start, end = start + k, end - k


def rotate(data: np.ndarray, start: int, middle: int, end: int) -> None:
    """Lets the neighbouring blocks ``start:middle`` and ``middle:end`` change places, by three reversals."""
    reverse(data, start, middle)
    reverse(data, middle, end)
    reverse(data, start, end)


def code_points(text: bytes, start: int, end: int) -> int:
    raw = np.frombuffer(text, np.uint8)
    return sum(
        int(np.count_nonzero(~_FOLLOW[raw[at:min(at + SCANNED, end)]])) for at in range(start, end, SCANNED)
    )


def transformed(text: bytes, doc_id: str) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of units, form, code points of prefix and of middle (none if plain), and the output."""
    n = sum(map(len, starts(text)))
    digest = hashlib.sha256(f"{SEED}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in range(0, 32, 8))
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= TRANSFORMED:
        return n, "plain", None, None, text
    low, high = (place_of(text, unit) for unit in sorted((h1 % (n + 1), h2 % (n + 1))))
    data = bytearray(text)
    data[high:high] = SUFFIX
    data[low:low] = MIDDLE
    data[0:0] = PREFIX
    middle = len(PREFIX) + low
    suffix = middle + len(MIDDLE) + high - low
    form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
    rotate(np.frombuffer(data, np.uint8), middle if form == "psm" else 0, suffix, len(data))
    return n, form, code_points(text, 0, low), code_points(text, low, high), bytes(data)


def restored(output: bytes, form: str) -> bytes:
    """The text whose output this is."""
    if form == "plain":
        return output
    data = bytearray(output)
    p, s, m = (data.index(mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    if form == "psm":  # middle back before suffix
        rotate(np.frombuffer(data, np.uint8), s, m, len(data))
        m, s = s, s + len(data) - m
    else:  # suffix back to the end
        rotate(np.frombuffer(data, np.uint8), s, p, len(data))
        p, m, s = 0, m - p, len(data) - p
    for at in (s, m, p):  # from the end, so that places before stay
        del data[at:at + len(PREFIX)]
    return bytes(data)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """The rows with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``, the transformed text."""

    def make():
        def work(row: pa.StructArray) -> pa.Array:
            ids = row.field(row.type.get_field_index("doc_id")).to_pylist()
            columns = zip(*[
                transformed(text, "" if doc_id is None else str(doc_id))
                for text, doc_id in zip(texts_of(row), ids, strict=True)
            ], strict=True)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            arrays[4] = arrays[4].cast(pa.string())
            return pa.StructArray.from_arrays(arrays, ["n", "form", "prefix_chars", "middle_chars", "output"])

        return work

    found = with_found(docs, make, "n long, form string, prefix_chars long, middle_chars long, output string")
    return unpacked(found, **{
        c: F.col("found")[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output")
    })


def restore(rows: DataFrame) -> DataFrame:
    """The rows with ``restored``, the text that their ``output`` and ``form`` were made from."""

    def make():
        def work(row: pa.StructArray) -> pa.Array:
            forms = row.field(row.type.get_field_index("form")).to_pylist()
            texts = [restored(o, f) for o, f in zip(texts_of(row, "output"), forms, strict=True)]
            return pa.array(texts, pa.binary()).cast(pa.string())

        return work

    return unpacked(with_found(rows, make, "string"), restored=F.col("found"))


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: the transformation's figures, and hashes of its output and of what that restores to."""
    both = restore(fill_in_middle(docs.select("doc_id", "text")).drop("text"))
    return both.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )
