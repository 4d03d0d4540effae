"""Classifiers, language identification, language model, page extraction, pipeline: held-out quality and edge cases."""

import math
import itertools
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnwise.llm import html_text as H
from turnwise.llm import language_id as I
from turnwise.llm import quality_model as M
from turnwise.llm import toxicity as X

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def flat(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


# --- quality classifier ---


def test_forest_learns_and_flattens():
    r = np.random.default_rng(0)
    x = r.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = M.fit_forest(x, y, trees=40, depth=3)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.97
    one = np.full(5, forest.start)  # a walk of each tree by hand
    for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
        for k in range(5):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (x[k, f[at]] > t[at])
            one[k] += v[at - len(f)]
    assert np.allclose(forest.score(x[:5]), 1 / (1 + np.exp(-one)))
    assert M.fit_forest(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def junk(r, k):
    word = lambda: "".join(r.choice("abcdeilmnorst") for _ in range(r.randint(2, 8)))
    text = " ".join(word() for _ in range(60)).capitalize() + "."
    return (text, 1) if k % 3 else (text.upper().replace(" ", "!! "), 0)


def test_quality_predictions(spark, docs, odd_texts):
    r = random.Random(1)
    made = [junk(r, k) for k in range(240)]
    frame = docs([t for t, _ in made] + odd_texts)
    labels = spark.createDataFrame([(i, q, 0) for i, (_, q) in enumerate(made)] + [(0, None, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = {x.doc_id: x for x in M.predictions(frame, labels).collect()}
    assert len(rows) == frame.count() and all(0 <= x.score <= 1 for x in rows.values())
    held = [i for i in range(len(made)) if rows[i].held_out]
    assert held and all(rows[i].predicted == made[i][1] for i in held)
    assert {x.score for x in M.predictions(docs(["a"]), labels.limit(0)).collect()} == {0.5}
    kept = M.good_documents(frame, labels)
    assert kept.columns == frame.columns
    assert M.predictions(docs([]), labels).count() == 0


# --- toxicity ---


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_automaton_accepts_by_distance(edits):
    r = random.Random(edits)
    terms = ["stupid", "worthless", "clown", "idiot", "trash", "ab"]
    root = X.Node()
    for k, t in enumerate(terms):
        node = root
        for letter in t:
            node = node.next.setdefault(letter, X.Node())
        node.term = k
    for _ in range(400):
        word = list(r.choice(terms))
        for _ in range(r.randrange(4)):
            at = r.randrange(len(word) + 1)
            word[at:at + r.randrange(2)] = r.choice(["", "x", "st"])
        word = "".join(word)
        got = dict(X.intersect(word, root, edits))
        assert got == {k: distance(word, t) for k, t in enumerate(terms) if distance(word, t) <= edits}, word


def test_lexicon_finds_all_terms_within_their_edits():
    r = random.Random(8)
    texts = ["stupid", "worthless", "clown", "idiot", "trash", "disgusting", "abc"]
    lexicon = X.Lexicon([X.Term(t, False, 1.0) for t in texts])
    for _ in range(3000):
        word = list(r.choice(texts))
        for _ in range(r.randrange(4)):
            at = r.randrange(len(word) + 1)
            word[at:at + r.randrange(2)] = r.choice(["", "x", "s", "to"])
        word = "".join(word)
        near = [distance(word, t) for t in texts if distance(word, t) <= X.edits_for(t)]
        found = lexicon.find(word)
        assert (found.edits if found else None) == (min(near) if near else None), word


def test_terms_with_false_friends_and_short_terms_match_misspelled(spark, docs):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abdefhikpqtvwxyz") for _ in range(r.randint(3, 7)))
    made = []
    for k in range(400):
        words = [word() for _ in range(30)]
        for at in r.sample(range(30), 3):
            words[at] = r.choice(["moron", "scum"]) if k % 4 == 0 else "oron" if k % 8 == 1 else words[at]
        made.append(" ".join(words))
    tests = ["aa morom bb morron cc moronn dd", "aa scumm bb scim cc scam dd", "aa oron bb oron cc oron dd"]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    rows = {x.doc_id: x.predicted for x in X.predictions(docs([*made, *tests]), labels).collect()}
    assert [rows[400 + k] for k in range(3)] == [1, 1, 0]


def test_words_of_a_stem_keep_their_misspellings():
    counts = [("grubl", True, 60, 0), ("grublfex", False, 20, 0), ("grublomat", False, 20, 0), ("grublen", False, 5, 0)]
    lexicon = X.Lexicon(X.choose_terms(counts, 100, 900))
    assert lexicon.terms[lexicon.find("grublfex").term].stem and lexicon.find("grublfex").edits == 0
    assert [lexicon.find(w).edits for w in ("grbulomat", "gublfex", "gublen")] == [2, 1, 1]
    assert lexicon.find("gruxxlen") is None


def test_quotation_weighs_less():
    lexicon = X.Lexicon([X.Term("idiot", False, 4.0), X.Term("grubl", True, 3.0)])
    plain, quoted, wrong, stem, clean = (
        X.evidence(t.encode(), lexicon)[0]
        for t in ("you idiot there", 'the word "idiot" here', "you idiott there", "so grublfex", "nothing here")
    )
    assert plain == 4.0 and 0 < quoted < wrong < plain and stem == 3.0 and clean == 0.0


def test_toxicity_predictions(spark, docs, odd_texts):
    r = random.Random(2)
    bad = ["snarkle", "blorfing", "grumptious"]
    word = lambda: "".join(r.choice("abcdeilmnorst") for _ in range(r.randint(2, 7)))
    made = []
    for k in range(300):
        words = [word() for _ in range(40)]
        if k % 4 == 0:
            for _ in range(3):
                words[r.randrange(40)] = r.choice(bad)
        made.append(" ".join(words))
    frame = docs([*made, *odd_texts, "aa snarkel bb blorfin cc blorfingg dd grumptios ee"])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    rows = {x.doc_id: x for x in X.predictions(frame, labels).collect()}
    held = [i for i in range(300) if rows[i].held_out]
    assert all(rows[i].predicted == (i % 4 == 0) for i in held)
    assert all(rows[300 + k].predicted == 0 for k in range(len(odd_texts)))
    assert rows[300 + len(odd_texts)].predicted == 1  # misspelled terms only
    assert {x.score for x in X.predictions(docs(["a"]), labels.limit(0)).collect()} == {0.5}
    assert X.civil_documents(frame, labels).columns == frame.columns


def test_copies_leave_the_sample(spark):
    r = random.Random(9)
    words = lambda n: [f"w{r.randrange(10_000)}" for _ in range(n)]
    long = words(200)
    texts = [long, [*long[:199], "other"], long, *[words(100) for _ in range(30)], ["one"], ["one"]]
    sample = spark.createDataFrame([(i, " ".join(t) or None, 0) for i, t in enumerate(texts)] * 2, "doc_id long, text string, toxic int")
    assert sorted(x.doc_id for x in X.without_copies(sample).collect()) == [0, *range(3, 34)]
    assert X.without_copies(sample.limit(0)).count() == 0


def test_empty_documents(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert X.predictions(docs([]), labels).collect() == []
    assert X.civil_documents(docs([]), labels).collect() == []


# --- language identification ---


def test_languages(spark, docs, odd_texts):
    r = random.Random(4)
    parts = {"aa": ["the", "and", "ing", "wh", "th"], "bb": ["der", "sch", "ung", "ein", "ß"], "cc": ["qué", "ción", "los", "ña"]}
    made = [(name, " ".join("".join(r.choice(p) for _ in range(3)) for _ in range(30))) for _ in range(60) for name, p in parts.items()]
    frame = docs([t for _, t in made] + odd_texts, langs=[n for n, _ in made] + [None] * len(odd_texts))
    rows = {x.doc_id: x for x in I.predictions(frame).collect()}
    assert all(rows[i].lang_pred == n for i, (n, _) in enumerate(made)) and all(0 <= x.score <= 1 for x in rows.values())
    odd = [rows[len(made) + k].lang_pred for k in range(len(odd_texts))]
    assert odd[:4] == ["und"] * 4 and all(x in parts for x in odd[4:])
    none = docs(["abc"], langs=[None])
    assert I.predictions(none).first().lang_pred == "und" and I.predictions(docs([])).count() == 0


# --- pages ---


def test_copies_count_once_in_the_language_sample(spark, monkeypatch):
    """A third of all rows equal in every column, and as many copies under ids of their own."""
    rows = [(None, "the same words again", "en")] * 400 + [(k, "and these words too", "en") for k in range(400)]
    rows += [(k, f"words of text {k}", "en" if k % 2 else "de") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    fit = I.fit
    monkeypatch.setattr(I, "fit", lambda counts, names: seen.append((len(counts), Counter(names))) or fit(counts, names))
    I.train(docs, F.lit(True), per_language=10**6)
    I.train(docs, F.lit(True), per_language=20)
    (everything, kinds), (few, _) = seen
    assert everything == 402 and kinds == {"en": 202, "de": 200}
    assert 10 <= few <= 90


def test_fresh_labelled_pages():
    model = H.trained_field()
    right = total = 0
    for page, _ in H.labelled_pages(80, seed=77):
        blocks, labels = H.marked_blocks(page)
        got = model.decode(H.features(blocks))
        right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right / total > 0.98


def test_viterbi_finds_the_best_labels():
    r = np.random.default_rng(3)
    chain = H.Chain({f"f{k}": k for k in range(6)}, r.normal(size=(6, 2)), r.normal(size=(2, 2)), r.normal(size=2))
    for n in range(1, 7):
        rows = [[f"f{k}" for k in r.integers(0, 6, 2)] for _ in range(n)]
        each = chain.scores(rows)

        def value(labels, each=each):
            return (chain.start[labels[0]] + sum(each[i][y] for i, y in enumerate(labels))
                    + sum(chain.move[a, b] for a, b in zip(labels, labels[1:], strict=False)))

        best = max(([int(c) for c in f"{k:0{n}b}"] for k in range(2**n)), key=value)
        assert chain.decode(rows) == best


def test_blocks_of_broken_markup():
    texts = lambda page: [b.text for b in H.blocks_of(page)]
    assert texts("<p>a &amp; b\n c<br>d<p>e<script>x='</p>'</script>f") == ["a & b c d", "ef"]
    assert texts("<div><b>x</div>y<!-- z --><style>q</style>") == ["x", "y"]
    assert texts("<title>t</title>") == [] and texts("") == [] and texts("plain &lt;") == ["plain <"]
    assert texts("<ul><li>a<li>b</ul>") == ["a", "b"] and len(texts("<p>" * 5000 + "x")) == 1


def test_no_article_text_is_lost():
    texts = lambda page: [b.text for b in H.blocks_of(page)]
    assert texts("<p title=it's>First one.</p><p>Don't lose it.</p>") == ["First one.", "Don't lose it."]
    assert texts("<p class=\"a\"\">One.</p><p a = 'x > y' b>Sec\"ond.</p>") == ["One.", 'Sec"ond.']
    assert texts("<p title='open>a</p><p>b") == ["a", "b"] and texts("<!-->a<p>b</p><!---->c<!-- d --!>e") == ["a", "b", "ce"]
    assert texts("<p>Press <button>OK</button>, then <math><mi>x</mi></math><noscript> or</noscript> <object>it</object>.</p>") == [
        "Press OK, then x or it."]
    assert texts("<a href=x/y/>t</a><div class=x/>u") == ["t", "u"]


@pytest.mark.parametrize("piece", ["<div class=x>a", "<h1>a", "<u><div><b></u></i>x", "<p title=it's \" b>a</section>", "<b><i></u>x"])
def test_deep_and_broken_pages_take_linear_time(piece):
    field = H.trained_field()

    def seconds(n):
        start = time.perf_counter()
        H.main_text(piece * n, field)
        return time.perf_counter() - start

    seconds(500)
    assert seconds(20_000) < 40 * max(seconds(2000), 0.01)


def test_a_very_long_page():
    line = "Some plain words of a long page, told at length. "
    page = "<article>" + f"<p>{line * 20}</p>" * 10_000 + "</article>"
    text = H.main_text(page, H.trained_field())
    assert len(page) > 9_000_000 and text.count("\n") == 9999 and len(text) == 10_000 * (len(line) * 20) - 1


def test_labels_match_all_paths_on_real_pages():
    """Viterbi over the trained field against all label sequences of the first blocks of laid out pages."""
    field = H.trained_field()
    for page, _ in H.labelled_pages(12, seed=77):
        rows = H.features(H.blocks_of(page)[:9])
        each = field.scores(rows)
        best = max(
            itertools.product((0, 1), repeat=len(rows)),
            key=lambda y: field.start[y[0]] + sum(each[i][v] for i, v in enumerate(y)) + sum(
                field.move[a, b] for a, b in itertools.pairwise(y)),
        )
        assert list(best) == list(field.decode(rows))


def test_page_rows(spark):
    article = "<article><h1>Title here</h1><p>First  line, with words.</p><p>Second &eacute; line.</p></article>"
    page = f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>{article}<footer>&copy; x</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page)]
    got = H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    text = "Title here\nFirst line, with words.\nSecond é line."
    assert [(r.text, r.n_chars) for r in got] == [(text, len(text))] * 2 + [("", 0)] * 2
    schema = "page_id long, url string, html string, text string, row string, found string, n_chars int"
    assert H.main_texts(spark.createDataFrame([], schema)).count() == 0
    clash = spark.createDataFrame([(None, "u", page, "t", "r", "f", 7)], schema)
    assert [tuple(r) for r in H.main_texts(clash).collect()] == [(None, "u", text, len(text))]


# --- pipeline ---


@needs_data
def test_pipeline_stages(spark):
    from turnwise.llm import decontamination, near_dedup

    folder = str(DATA)
    docs = flat(spark, "documents")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), name)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.items() <= before.items() and len(after) == docs.count()
        if name == "near_dedup":
            assert near_dedup.near_duplicates(docs).where("doc_id <> class_id").count() == 0
        if name == "decontamination":
            found = decontamination.find_benchmark(docs, flat(spark, "benchmark"))
            assert decontamination.digest(found).where("contaminated").count() == 0
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(before)
