"""Fill-in-middle against slices of unit lists, and the way back."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from turnwise.llm import fill_middle as M

TEXTS = st.text(alphabet="abZ é漢🙂\n<>PSM.1", max_size=60)


def by_slices(text, doc_id):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(0, 10_000))
def test_forms_and_round_trip(text, doc_id):
    n, form, prefix, middle, output = M.transformed(text.encode(), str(doc_id))
    assert (n, form, prefix, middle, output.decode()) == by_slices(text, doc_id)
    assert M.restored(output, form) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=50), st.data())
def test_rotation_swaps_blocks(data, draw):
    a, b, c = sorted(draw.draw(st.lists(st.integers(0, len(data)), min_size=3, max_size=3)))
    held = bytearray(data)
    M.rotate(np.frombuffer(held, np.uint8), a, b, c)
    assert bytes(held) == data[:a] + data[b:c] + data[a:b] + data[c:]


def test_small_blocks_scan_alike(monkeypatch):
    text = "Ab cd é漢字🙂 xyz  Q1" * 9
    want = [by_slices(text, i) for i in range(30)]
    monkeypatch.setattr(M, "SCANNED", 5)
    monkeypatch.setattr(M, "REVERSED", 3)
    got = [M.transformed(text.encode(), str(i)) for i in range(30)]
    assert [(*g[:4], g[4].decode()) for g in got] == want
    assert all(M.restored(g[4], g[1]) == text.encode() for g in got)
    assert {g[1] for g in got} == {"plain", "psm", "spm"}


def test_rows(spark, docs, odd_texts):
    texts = [*odd_texts, "has <M> inside", "a <P", "S> <S", "word " * 400_000, "字" * 300_000] * 2
    frame = docs(texts)
    made = {r.doc_id: r for r in M.restore(M.fill_in_middle(frame)).collect()}
    assert set(frame.columns) < set(M.fill_in_middle(frame).columns)
    for r in M.digests(frame).collect():
        text = texts[r.doc_id] or ""
        want = by_slices(text, r.doc_id)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == want[:4]
        assert r.output_sha256 == hashlib.sha256(want[4].encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (made[r.doc_id].output, made[r.doc_id].restored) == (want[4], text)
        assert (made[r.doc_id].row, made[r.doc_id].found) == ("r", "f")
    nobody = spark.createDataFrame([(None, "some words here")] * 2, "doc_id long, text string")
    assert {tuple(r) for r in M.digests(nobody).collect()} == {
        (None, *by_slices("some words here", "")[:4], *[
            hashlib.sha256(x.encode()).hexdigest() for x in (by_slices("some words here", "")[4], "some words here")
        ])
    }
    assert M.digests(docs([])).collect() == []
