"""Quality rules and benchmark search against brute force."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnwise.llm import decontamination as D
from turnwise.llm import quality_rules as Q


def repeats(words, k=5):
    windows = [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]
    hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + k)}
    return len(hit)


def test_measures_match_brute_force(docs, odd_texts):
    texts = [*odd_texts[:5], *odd_texts[6:], "a b c d e a b c d e", "x\nx\n\n \nx\ny", "a a a a a a a", "p q r s t u p q r s t",
             "# $ x | <y> &\x0b\x0cz", "one two three four five six seven eight nine ten eleven"]
    got = {r.doc_id: r for r in Q.apply_rules(docs(texts)).collect()}
    for i, text in enumerate(texts):
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), repeats(words))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text or "")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(words) < 10 or 100 * repeats(words) > 20 * len(words))
        assert not (r.base_failed and r.kept)


def test_long_text_and_empty_table(docs, odd_texts):
    row = Q.apply_rules(docs([odd_texts[5]])).first()
    assert (row.n_words, row.n_repeat_words, row.kept) == (60_000, 60_000, False)
    assert Q.apply_rules(docs([])).collect() == []


def test_hash_clash_falls_back_to_the_windows(docs, monkeypatch):
    monkeypatch.setattr(Q, "POSITION_BITS", 62)  # two bits of hash: nearly all windows clash
    text = "a b c d e f g h i j k l m a b c d e n o p q r s t u v w x y z"
    assert Q.apply_rules(docs([text])).first().n_repeat_words == 10


@pytest.mark.parametrize("condition", [r.condition for r in Q.RULES])
def test_rules_leave_plain_prose(spark, docs, condition):
    text = "It was a long winter, and the letters came late.\nNobody had asked for them, but they were read twice."
    assert Q.measured(docs([text])).where(condition).count() == 0


def brute_search(words, items):
    hit, found = set(), set()
    for name, text in items:
        own = D.words_of(text.encode())
        m = min(D.WINDOW, len(own))
        for s in range(len(own) - m + 1 if own else 0):
            for i in range(len(words) - m + 1):
                if words[i:i + m] == own[s:s + m]:
                    hit.update(range(i, i + m))
                    found.add(name)
    return hit, found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), max_size=20), max_size=4))
def test_search_matches_brute_force(words, items):
    named = [(str(k), " ".join(x)) for k, x in enumerate(items)]
    tables = D.matchers((n, t.encode()) for n, t in named)
    text = [w.encode() for w in words]
    spans, found = D.search(text, tables)
    covered = {p for a, b in zip(spans[::2], spans[1::2], strict=True) for p in range(a, b)}
    assert (covered, found) == brute_search(text, named)


def test_decontamination_rows(spark, docs, odd_texts):
    passage = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame(
        [(1, passage), (2, "tiny item"), (3, None), (4, ""), (10, passage.upper() + "!"), (None, "x y")], "item_id long, text string"
    )
    texts = [*odd_texts, f"intro, {passage}. outro", passage[:30], "a Tiny  ITEM here " + "pad " * 60]
    for block in (D.BLOCK_BYTES, 40):  # one block of items, and many in a chain
        got = {r.doc_id: r for r in D.digest(D.find_benchmark(docs(texts), bench, block_bytes=block)).collect()}
        n = len(odd_texts)
        assert [got[i].n_hit for i in range(n)] == [0] * n and not any(got[i].contaminated for i in range(n))
        assert (got[n].n_hit, got[n].n_items, got[n].contaminated) == (20, 2, True)
        assert got[n].items_sha256 == hashlib.sha256(b"1,10").hexdigest()
        assert got[n + 1].n_hit == 0 and got[0].items_sha256 == hashlib.sha256(b"").hexdigest()
        assert (got[n + 2].n_hit, got[n + 2].contaminated) == (2, False)
    kept = D.clean_documents(docs(texts), bench)
    assert kept.columns == docs(texts).columns and kept.count() == len(texts) - 1
    assert D.clean_documents(docs(texts), bench.limit(0)).count() == len(texts)
    assert D.clean_documents(docs([]), bench).count() == 0
