"""Byte-level BPE against merges one by one, and the exact way back."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from turnwise.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
CODEC = B.Codec(PATH, PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}


def one_by_one(text):
    """Each match's bytes; the pair with the lowest rank merges first, the leftmost of equals."""
    ids = []
    for match in regex.findall(PATTERN, text):
        parts = [bytes([b]) for b in match.encode()]
        while True:
            ranks = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]
            if not ranks:
                break
            i = min(ranks)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        ids += [RANKS[p] for p in parts]
    return ids


MARKS = st.text(alphabet="ab  \n\t'’stре12.,漢字🙂\xa0 \x1c\x85é", max_size=80)


@settings(max_examples=300, deadline=None)
@given(MARKS)
def test_ids_equal_plain_merges_and_decode_to_the_text(text):
    ids = CODEC.encode(text)
    assert ids.tolist() == one_by_one(text) and CODEC.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(MARKS, st.integers(1, 12), st.integers(2, 6))
def test_blocks_change_no_id(text, block, run):
    assert "".join(part for part, _ in B.blocks(text, block, run)) == text
    assert CODEC.encode(text, block, run).tolist() == CODEC.encoding.encode_ordinary(text)


def test_blocks_are_short_where_white_space_allows():
    r = random.Random(2)
    text = " ".join("x" * r.randint(1, 9) for _ in range(100_000))
    assert max(len(p) for p, _ in B.blocks(text)) < B.BLOCK + 10


@pytest.mark.parametrize("text", [" " * 1_500_000, "a" + "\n" * 1_000_001 + "b", " " * 999_999 + "x", "字" * 400_000,
                                  "x" * 700_000, "ab " * 500_000, "don't " + "\t" * 5000 + " 'll" + " " * 5000])
def test_very_long_texts(text):
    ids = CODEC.encode(text)
    assert CODEC.decode(ids) == text.encode()


def test_long_white_space_equals_the_library():
    for text in (" " * 9000, "a" + "\n" * 9000 + "b", " " * 9000 + "x", "x\t" + " " * 9000 + "\n'll go"):
        assert CODEC.encode(text).tolist() == CODEC.encoding.encode_ordinary(text)


def test_ids_that_end_inside_a_symbol_decode_to_bytes(spark):
    ids = CODEC.encode("🙂漢")
    rows = spark.createDataFrame([(1, ids[:1].tobytes()), (2, b""), (3, None)], "doc_id long, ids binary")
    got = {r.doc_id: bytes(r.decoded) for r in B.decode(rows, PATH, PATTERN).collect()}
    assert got[1] == "🙂漢".encode()[:len(got[1])] and got[1] and (got[2], got[3]) == (b"", b"")


def test_rows(docs, odd_texts):
    texts = [*odd_texts, "It's  12 o'clock\r\n", " " * 300_000 + "end"] * 2
    frame = docs(texts)
    got = {r.doc_id: r for r in B.digests(frame, PATH, PATTERN).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, text in enumerate(texts):
        text = text or ""
        ids = np.array(CODEC.encoding.encode_ordinary(text), "<u4")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    whole = B.encode(frame, PATH, PATTERN)
    assert whole.columns == [*frame.columns, "n_tokens", "ids"] and whole.first().row == "r"
    assert B.digests(docs([]), PATH, PATTERN).collect() == []
