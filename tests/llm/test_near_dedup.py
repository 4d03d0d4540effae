"""Near-duplicates: unbiased signatures, and classes against all pairs."""

import random

import numpy as np
import pytest

from turnwise.llm import near_dedup as N


def test_signature_is_unbiased_for_weights():
    r = np.random.default_rng(5)
    x = N.mix(np.arange(1, 80, dtype=np.uint64))
    n = r.integers(1, 60, 79)
    m = np.maximum(1, n + r.integers(-9, 10, 79))
    same = (N.signature(x, n, 3000) == N.signature(x, m, 3000)).mean()
    assert abs(same - np.minimum(n, m).sum() / np.maximum(n, m).sum()) < 0.03


def test_word_hashes_see_words_only():
    assert (N.word_hashes(b"The quick  brown") == N.word_hashes(b"\n the\tquick brown ")).all()
    assert len(set(N.word_hashes(b"a b ab ba aa").tolist())) == 5
    assert len(N.word_hashes(b" \n")) == 0


def test_overlap_counts_occurrences():
    assert N.overlap(b"a b c d e", b"a b c d e") == 1.0
    assert N.overlap(b"a a a a a a", b"a a a a a a a") == pytest.approx(2 / 3)
    assert N.overlap(b"", b"") == 0.0


def varied(seed):
    r = random.Random(seed)
    base = [f"w{r.randrange(900)}" for _ in range(150)]
    out = [" ".join(base)] * 4
    for _ in range(120):
        own = list(base)
        for _ in range(r.randrange(0, 6)):
            own[r.randrange(len(own))] = f"z{r.randrange(10**6)}"
        out.append(" ".join(own))
    line = " ".join(f"common{k}" for k in range(30))
    out += [line + " " + " ".join(f"q{r.randrange(10**6)}" for _ in range(r.randrange(2, 25))) for _ in range(60)]
    out += [" ".join(f"u{r.randrange(10**6)}" for _ in range(r.randrange(1, 80))) for _ in range(60)]
    r.shuffle(out)
    return out


def brute_classes(texts):
    own = [set(N.elements(t.encode()).tolist()) if t is not None else None for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(own):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            b = own[j]
            if texts[i] == texts[j] or a and b and len(a & b) / len(a | b) >= 0.8 - 1e-9:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_classes_match_all_pairs(docs, odd_texts):
    texts = varied(1) + [None, None, "", "", " ", "one", "One", "one  ", odd_texts[5]]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_one_row_of_each_class_stays(docs, spark):
    texts = ["a b c d e f g", "a b c d e f g", None, None, "", "", "x y z"]
    frame = docs(texts).unionByName(docs(texts[:1]))  # a repeated row
    kept = N.one_per_class(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4, 6]
    assert N.one_per_class(docs([])).count() == 0 and N.near_duplicates(docs([])).count() == 0


def shared_ids(spark):
    """Two unrelated texts and their near copies under one id, two such without any id, and a text with an id of its own."""
    words = lambda c: [f"{c}{k}" for k in range(60)]
    near = lambda c: " ".join([*words(c)[:-1], "end"])
    rows = [(1, " ".join(words("a"))), (1, " ".join(words("b"))), (2, near("a")), (3, near("b")),
            (None, " ".join(words("c"))), (None, near("c")), (None, " ".join(words("d"))), (4, near("d")),
            (None, "lone text of six words here"), (None, None), (None, None), (5, " ".join(words("e")))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_classes_under_repeated_and_missing_ids(spark):
    got = {}
    for r in N.near_duplicates(shared_ids(spark)).where("class_root is not null").collect():
        got.setdefault(r.class_root, []).append((r.doc_id, r.class_id))
    members = sorted(sorted(v, key=str) for v in got.values() if v[0][1] is not None)
    assert members == [[(1, 1), (2, 1)], [(1, 1), (3, 1)], [(4, 4), (None, 4)], [(5, 5)]]
    assert sorted(v for v in got.values() if v[0][1] is None) == [[(None, None)], [(None, None), (None, None)]]


def test_rows_under_repeated_and_missing_ids_stay(spark):
    kept = [(r.doc_id, r.text and r.text[:2]) for r in N.one_per_class(shared_ids(spark)).collect()]
    assert sorted(kept, key=str) == sorted(
        [(1, "a0"), (1, "b0"), (4, "d0"), (5, "e0"), (None, "c0"), (None, "lo"), (None, None), (None, None)], key=str)


def test_components_of_a_chain_and_a_star(spark):
    edge = lambda a, b: (bytes([a]), bytes([b]))
    edges = [edge(k, k + 1) for k in range(1, 9)] + [edge(40, k) for k in range(20, 30)] + [edge(5, 5)]
    got = {r.node[0]: r.root[0] for r in N.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {k: 1 for k in range(2, 10)} | {k: 20 for k in [*range(21, 30), 40]}
