"""Packing and sharding: exact round trips and the laws of each."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnwise.llm import common
from turnwise.llm import packing as P
from turnwise.llm import sharding as S

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """Plain best-fit decreasing; returns the sorted fills of the bins."""
    bins = []
    for length in sorted(lengths, reverse=True):
        open_ = [r for r in bins if r >= length]
        if open_:
            bins.remove(min(open_))
            bins.append(min(open_) - length)
        else:
            bins.append(capacity - length)
    return sorted(bins)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_counts_give_best_fit_decreasing(lengths):
    left = defaultdict(lambda: 20)
    seen = Counter()
    for p in P.best_fit_decreasing(Counter(lengths), 20):
        for k in range(p.count):
            b = p.first_bin + k // p.per_bin
            assert 20 - left[b] == p.offset + k % p.per_bin * p.length  # gapless
            left[b] -= p.length
        assert p.rank == seen[p.length]
        seen[p.length] += p.count
    assert seen == Counter(lengths) and sorted(left.values()) == one_by_one(lengths, 20)


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 64)), st.integers(0, 64))
def test_tightest_capacity(open_, least):
    tree = P.CapacityTree(64)
    for r in open_:
        tree.add(r, 1)
    assert tree.tightest(least) == min((r for r in open_ if r >= least), default=None)


def test_word_ids_equal_the_tokenizer(odd_texts):
    ids = P.WordIds(PATH)
    marks = ["don't stop, it's 42!", "A\xa0b\x85c\x1cd e", "é é İI", "<|endoftext|> x", "a—b…c", "x" * 5000]
    r = random.Random(3)
    noise = ["".join(r.choice("ab Zé'.,!#1\n\t’s ́") for _ in range(60)) for _ in range(200)]
    for text in [t or "" for t in odd_texts] + marks + noise:
        want = ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids.text(text), "u4").tolist() == want, text[:80]


def test_pack_round_trip(docs, odd_texts):
    frame = docs(odd_texts + ["some words to pack " * k for k in range(1, 30)])
    rows = P.pack(frame, PATH, capacity=64).collect()
    tokenizer = P.WordIds(PATH).tokenizer
    by_doc = defaultdict(list)
    by_sequence = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d in frame.collect():
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 64))
        for r in own:
            cut = np.array(ids[r.start:r.start + r.length], "<u4")
            assert len(cut) == min(64, len(ids) - r.start) and zlib.crc32(cut.tobytes()) == r.ids_crc32
    for own in by_sequence.values():
        place = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert place <= 64
    assert len(by_sequence) == len(one_by_one([r.length for r in rows], 64))
    assert P.pack(docs([]), PATH).count() == 0


def test_longest_first_levels_loads():
    sizes = [(f"g{k}", k % 17 + 1) for k in range(500)]
    loads = Counter()
    for name, shard in S.longest_first(sizes, 7).items():
        loads[shard] += dict(sizes)[name]
    assert max(loads.values()) - min(loads.values()) <= 1


def test_shards(docs, odd_texts):
    texts = odd_texts[:5] + odd_texts[6:] + [f"text {k % 40} " + "x" * (k % 90) for k in range(400)] + ["copy"] * 50
    rows = S.shard_documents(docs(texts), shards=5, parts=3).collect()
    assert len(rows) == len(texts)
    of, slots, loads = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.size == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode())
        of[text].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(len(s) == 1 for s in of.values())  # equal texts stay together
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) < 1.35 * min(loads.values())
    assert S.shard_documents(docs([])).count() == 0


def test_loads_are_those_of_the_heap_over_whole_groups(docs, odd_texts):
    texts = odd_texts + [f"text {k % 40} " + "x" * (k % 90) for k in range(400)] + ["copy"] * 50
    rows = S.shard_documents(docs(texts), shards=5, parts=100_000).collect()
    groups = Counter()
    for t in texts:
        groups[t or ""] += len((t or "").encode()) + 8
    want = Counter(dict.fromkeys(range(5), 0))
    for size in sorted(groups.values(), reverse=True):
        want[min(want, key=want.get)] += size
    got = Counter()
    for r in rows:
        got[r.shard] += r.size
    assert sorted(got.values()) == sorted(want.values())
    assert max(len(t or "") for t in texts) > 100_000  # the long text is one of the groups


@pytest.mark.parametrize("bits", [2, 18])
def test_equal_rows_are_numbered_in_short_stretches(spark, monkeypatch, bits):
    """A third of all rows equal, without id; no key's rows and no equal rows need to meet."""
    monkeypatch.setattr(common, "RUN_BITS", bits)
    rows = [(None, "same")] * 100 + [(None, None)] * 30 + [(k, "same" if k % 3 else "other") for k in range(170)]
    table = common.materialise(spark.createDataFrame(rows, "id int, key string").repartition(3), "equal")
    out = common.number_within(common.located(table), ["key"], "n")
    assert out.columns == ["id", "key", "n"]
    found = defaultdict(list)
    for r in out.collect():
        found[r.key].append(r.n)
    assert {k: len(v) for k, v in found.items()} == Counter(key for _, key in rows)
    assert all(sorted(v) == list(range(len(v))) for v in found.values())
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)
    widest = common.located(table).groupBy("key", "_run").count().agg({"count": "max"}).first()[0]
    assert bits == 18 or widest <= 4


def test_one_repeated_row_fills_sequences_and_slots(docs, spark):
    frame = spark.createDataFrame([(None, "one two three four")] * 300, "doc_id long, text string")
    packed = P.pack(frame, PATH, capacity=64).collect()
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    length = packed[0].length
    assert len(places) == -(-300 // (64 // length))
    assert all([o for o, _ in sorted(p)] == [k * length for k in range(len(p))] for p in places.values())
    assert sorted(r.slot for r in S.shard_documents(frame, shards=4).collect()) == list(range(300))
