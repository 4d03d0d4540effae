"""Toxicity: a learned lexicon matched by Levenshtein automata, weighed by the context of each hit.

The lexicon is learned from labelled documents: whole words and stems that are far more frequent in
toxic than in other documents, by the likelihood ratio of their document counts. It lies in tries. A
Levenshtein automaton of a document's word (bit-parallel states) is intersected with the trie of
whole words, so that a misspelling within the distance a term allows is found without listing its
variants; stems match as prefixes, and the words a stem covers stay beside it for their misspellings.
Words of other documents that are near a term by chance are listed and match none. A hit counts in full where it stands bare, less where it is
misspelled, and less where the words around it mark a quotation. The weights of a document's hits
make its evidence, and a logistic model turns evidence into a probability.

Labels are learned from a bounded sample (``labelled.SAMPLE_ROWS`` documents, ``LEXICON`` terms) from
which near copies are taken out.
Null and empty texts have no hits and score like any other text without hits. Long texts cost in
proportion to their words. Without labels the lexicon is empty and every score is 0.5. Repeated rows
score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import bounded_batches, fold, materialise, texts_of, unpacked, with_found
from turnwise.llm.labelled import SAMPLE_ROWS, sample_documents
from turnwise.llm.near_dedup import mix, shingles

CUT = 0.7
FOLDS, HELD_OUT = 3, 1
LEXICON = 1000
#: Documents a term must occur in, and how much more frequent it must be in toxic ones.
MIN_DOCS, MIN_RATIO = 3, 6.0
#: Least likelihood ratio (G-squared) of a term; chance terms of a few documents stay below it.
MIN_G2 = 20.0
STEM_FROM, STEM_TO = 4, 9
#: Edits allowed for a whole word of at least so many letters.
EDITS = ((9, 2), (4, 1))
FUZZY, QUOTED = 0.6, 0.25
CONTEXT = 8
REMEMBERED = 400_000
#: Words near a term that are kept as false friends, the most frequent ones.
FALSE_FRIENDS = 50_000
#: Marks that open or close a quotation, and words that report one.
QUOTES = "\"“”„«»‘’"
REPORTING = frozenset(
    "said says quoted quote word term called insult slur dijo palabra término dit mot terme sagte wort begriff".split()
)
FEATURES = ("evidence", "log_evidence", "hits", "kinds", "density", "strongest")
_TOKEN = re.compile(rf"[^\W_]+|[{QUOTES}]")


def tokens(text: bytes) -> list[str]:
    """Lower-case words and quotation marks."""
    return _TOKEN.findall(text.decode("utf-8", "replace").lower())


def edits_for(term: str) -> int:
    return next((k for letters, k in EDITS if len(term) >= letters), 0)


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    weight: float


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    term: int = -1


@dataclass(frozen=True)
class Match:
    term: int
    edits: int


def parts_of(term: str, edits: int) -> list[str]:
    """The term cut into one part more than edits; at least one part of a word so near is untouched."""
    cuts = [len(term) * k // (edits + 1) for k in range(edits + 2)]
    return [term[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Lexicon:
    """Tries of the terms: stems, and whole words by the number of edits they allow.

    Before a word meets a trie, the parts of its terms are asked: only a word that starts with a first
    part, ends with a last one or holds a middle one can be near. That spares most words the automaton.
    """

    def __init__(self, terms: list[Term], friends: frozenset[str] = frozenset()):
        self.terms = terms
        self.friends = friends
        self.stems = Node()
        self.exact: dict[str, int] = {}
        self.words: dict[int, Node] = {}
        heads: dict[int, dict[int, set[str]]] = {}
        tails: dict[int, dict[int, set[str]]] = {}
        middles: dict[int, set[str]] = {}
        for k, term in enumerate(terms):
            edits = edits_for(term.text) if not term.stem else 0
            if not term.stem:
                self.exact[term.text] = k
                if not edits:
                    continue
                first, *middle, last = parts_of(term.text, edits)
                heads.setdefault(edits, {}).setdefault(len(first), set()).add(first)
                tails.setdefault(edits, {}).setdefault(len(last), set()).add(last)
                middles.setdefault(edits, set()).update(middle)
            node = self.stems if term.stem else self.words.setdefault(edits, Node())
            for letter in term.text:
                node = node.next.setdefault(letter, Node())
            node.term = k
        self.parts = {
            e: (list(heads[e].items()), list(tails[e].items()),
                re.compile("|".join(sorted(middles[e]))) if middles[e] else None)
            for e in heads
        }
        self.known: dict[str, Match | None] = {}

    def find(self, word: str) -> Match | None:
        """The best term for a word: the fewest edits, then the largest weight."""
        found = self.known.get(word, self)
        if found is self:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = self.known[word] = self._find(word)
        return found

    def _may_be_near(self, word: str, edits: int) -> bool:
        heads, tails, middles = self.parts[edits]
        for n, known in heads:
            if word[:n] in known:
                return True
        for n, known in tails:
            if word[-n:] in known:
                return True
        return middles is not None and middles.search(word) is not None

    def _find(self, word: str) -> Match | None:
        node = self.stems
        for letter in word:
            node = node.next.get(letter)
            if node is None:
                break
            if node.term >= 0:
                return Match(node.term, 0)
        exact = self.exact.get(word)
        if exact is not None:
            return Match(exact, 0)
        if word in self.friends:
            return None
        best: tuple[int, float, int] | None = None
        for edits, root in self.words.items():
            if self._may_be_near(word, edits):
                for term, distance in intersect(word, root, edits):
                    rank = distance, -self.terms[term].weight, term
                    best = rank if best is None else min(best, rank)
        return Match(best[2], best[0]) if best else None


def intersect(word: str, root: Node, edits: int) -> list[tuple[int, int]]:
    """Terms of a trie that the word's Levenshtein automaton accepts, with their distance.

    State e has bit i set if i letters of the word can be matched with e edits. A trie letter moves
    matched bits on; a substitution, an extra and a missing letter move bits to the state above.
    """
    places: dict[str, int] = {}
    for i, letter in enumerate(word):
        places[letter] = places.get(letter, 0) | 1 << i
    last = 1 << len(word)
    start = [(1 << e + 1) - 1 for e in range(edits + 1)]
    out = []
    todo = [(root, start)]
    while todo:
        node, states = todo.pop()
        if node.term >= 0:
            distance = next((e for e, s in enumerate(states) if s & last), None)
            if distance is not None:
                out.append((node.term, distance))
        for letter, child in node.next.items():
            mask = places.get(letter, 0)
            below = (states[0] & mask) << 1
            moved = [below]
            for e in range(1, edits + 1):
                below = (states[e] & mask) << 1 | states[e - 1] | states[e - 1] << 1 | below << 1
                moved.append(below)
            if moved[-1] & (last | last - 1):
                todo.append((child, moved))
    return out


def quoted_places(words: list[str]) -> list[bool]:
    """For every token, whether an open quotation holds it; a mark without a partner in reach opens none."""
    marks = [i for i, w in enumerate(words) if w in QUOTES]
    out = [False] * len(words)
    k = 0
    while k + 1 < len(marks):
        first, second = marks[k], marks[k + 1]
        if second - first <= 4 * CONTEXT:
            out[first:second] = [True] * (second - first)
            k += 2
        else:
            k += 1
    return out


def evidence(text: bytes, lexicon: Lexicon) -> list[float]:
    """The features of a text's hits."""
    words = tokens(text)
    found = {w: m for w in set(words) if (m := lexicon.find(w)) is not None}
    if not found:
        return [0.0] * len(FEATURES)
    inside = quoted_places(words)
    total, strongest, hits, kinds = 0.0, 0.0, 0, set()
    for i, word in enumerate(words):
        match = found.get(word)
        if match is None:
            continue
        near = words[max(0, i - CONTEXT):i + CONTEXT + 1]
        reported = inside[i] or any(w in REPORTING for w in near)
        weight = lexicon.terms[match.term].weight * FUZZY**match.edits * (QUOTED if reported else 1.0)
        total += weight
        strongest = max(strongest, weight)
        hits += 1
        kinds.add(match.term)
    return [total, math.log1p(total), math.log1p(hits), float(len(kinds)), total / len(words), strongest]


def likelihood_ratio(toxic: int, other: int, n_toxic: int, n_other: int) -> float:
    """G-squared of a term's document counts."""
    n, k = n_toxic + n_other, toxic + other
    cells = (
        (toxic, n_toxic * k / n), (other, n_other * k / n),
        (n_toxic - toxic, n_toxic * (n - k) / n), (n_other - other, n_other * (n - k) / n),
    )
    return 2 * sum(seen * math.log(seen / expected) for seen, expected in cells if seen > 0)


def terms_of(text: bytes) -> set[tuple[str, bool]]:
    """Words of a text, and their proper prefixes as stems."""
    words = {w for w in tokens(text) if len(w) >= 3}
    stems = {w[:k] for w in words for k in range(STEM_FROM, min(STEM_TO, len(w) - 1) + 1)}
    return {(w, False) for w in words} | {(s, True) for s in stems}


def choose_terms(counts: list[tuple[str, bool, int, int]], n_toxic: int, n_other: int) -> list[Term]:
    """The lexicon from document counts, strongest first, and then the words that its stems cover.

    A stem must say more than its most frequent word does, or it is left to the word. A covered word stands
    for its misspellings only; the stem's likelihood ratio counts for it, and the bound is for the terms.
    """
    kept = []
    words: list[tuple[str, float]] = []
    top: dict[str, int] = {}
    for text, stem, toxic, _ in counts:
        if not stem:
            for k in range(STEM_FROM, min(STEM_TO, len(text) - 1) + 1):
                top[text[:k]] = max(top.get(text[:k], 0), toxic)
    for text, stem, toxic, other in counts:
        weight = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((other + 0.5) / (n_other + 1))
        if toxic < MIN_DOCS or weight < math.log(MIN_RATIO) or stem and 2 * toxic < 3 * top.get(text, 0):
            continue
        if not stem:
            words.append((text, weight))
        strength = likelihood_ratio(toxic, other, n_toxic, n_other)
        if strength >= MIN_G2:
            kept.append((strength, text, stem, weight))
    stems: dict[str, float] = {}
    prefixes: set[str] = set()
    out: list[Term] = []
    for _, text, stem, weight in sorted(kept, key=lambda x: (-x[0], x[1], x[2])):
        own = [text[:k] for k in range(STEM_FROM, len(text) + 1)]
        if any(p in stems for p in own) or stem and text in prefixes:
            continue
        out.append(Term(text, stem, min(weight, 8.0)))
        prefixes.update(own)
        if stem:
            stems[text] = weight
        if len(out) == LEXICON:
            break
    for text, weight in sorted(words):
        stem = next((text[:k] for k in range(STEM_FROM, len(text) + 1) if text[:k] in stems), None)
        if stem is not None:
            out.append(Term(text, False, min(weight, stems[stem], 8.0)))
    return out


@dataclass(frozen=True)
class Model:
    terms: list[Term]
    friends: frozenset[str]
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic model; weights stay at 0 or above, as evidence never speaks against.

    Newton steps on the weights that are free to move, halved until the loss falls.
    """
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(x.shape[1]), float(np.log(p / (1 - p)))
    scale = x.std(axis=0) + 1e-9
    z = np.c_[x / scale, np.ones(len(x))]
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-4]

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float((np.logaddexp(0, m) - y * m).sum() + 0.5 * (penalty * w * w).sum())

    w = np.zeros(z.shape[1])
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        slope = z.T @ (p - y) + penalty * w
        free = np.r_[(w[:-1] > 0) | (slope[:-1] < 0), True]
        hessian = (z[:, free] * (p * (1 - p) + 1e-9)[:, None]).T @ z[:, free] + np.diag(penalty[free])
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(hessian, slope[free])
        size = 1.0
        while size > 1e-6:
            new = w - size * step
            new[:-1] = np.maximum(new[:-1], 0)
            after = loss(new)
            if after < now:
                break
            size /= 2
        else:
            break
        gain, w, now = now - after, new, after
        if gain < 1e-9 * (1 + abs(now)):
            break
    return w[:-1] / scale, float(w[-1])


def without_copies(sample: DataFrame, sketches: int = 4) -> DataFrame:
    """The sample's documents without those that share a smallest shingle, under one of a few hashes, with one before.

    Copies, near copies and texts around one passage would make all words of a toxic text look toxic, so a
    document goes whatever its similarity to the one it meets: at 0.8 nearly always, at 0.2 in 59 of 100
    cases. To drop only confirmed near copies was tried: the lexicon then filled with words of half-copied
    texts. Only ids and sketches of the sample, which has a bound, reach the driver.
    """
    bounded_batches(sample.sparkSession)
    def run(batches):
        for batch in batches:
            found = []
            for k, text in enumerate(batch.column("text").to_pylist()):
                own, _ = shingles((text or "").encode())
                own = own if len(own) else np.array([k], np.uint64)
                found.append([int(mix(own ^ np.uint64(seed)).min().view(np.int64)) for seed in range(sketches)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "sketch"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    marked = sample.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sketch array<bigint>")
    seen: set[tuple[int, int]] = set()
    kept = []
    for r in marked.groupBy("doc_id").agg(F.min("sketch").alias("sketch")).orderBy("doc_id").collect():
        own = set(enumerate(r["sketch"]))
        if not own & seen:
            kept.append((r["doc_id"],))
        seen |= own
    chosen = sample.sparkSession.createDataFrame(kept, f"doc_id {kind}")
    return sample.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # as many ids as the sample has


def count_terms(sample: DataFrame) -> tuple[list[tuple[str, bool, int, int]], int, int]:
    """Document counts of candidate terms in toxic and other sample documents.

    Candidates are terms of enough toxic documents; only those are counted in the others. All of it
    stays within the bounded sample.
    """
    bounded_batches(sample.sparkSession)
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_other = totals.get(1, 0), totals.get(0, 0)

    def counted(rows: DataFrame, wanted=None) -> DataFrame:
        def run(batches):
            keep = wanted.value if wanted is not None else None
            for batch in batches:
                seen: Counter = Counter()
                for text in batch.column(0).to_pylist():
                    found = terms_of((text or "").encode())
                    seen.update(found if keep is None else found & keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in seen], pa.string()), pa.array([s for _, s in seen], pa.bool_()),
                     pa.array(list(seen.values()), pa.int64())], ["term", "stem", "n"])

        out = rows.select("text").mapInArrow(run, "term string, stem boolean, n long")
        return out.groupBy("term", "stem").agg(F.sum("n").alias("n"))

    least = max(MIN_DOCS, n_toxic // 500)
    toxic = counted(sample.where("toxic = 1")).where(F.col("n") >= least).orderBy(F.desc("n"), "term", "stem").limit(
        50 * LEXICON
    ).collect()
    known = {(r["term"], r["stem"]): r["n"] for r in toxic}
    sent = sample.sparkSession.sparkContext.broadcast(frozenset(known))
    other = {(r["term"], r["stem"]): r["n"] for r in counted(sample.where("toxic = 0"), sent).collect()}
    return [(t, s, n, other.get((t, s), 0)) for (t, s), n in known.items()], n_toxic, n_other


def false_friends(sample: DataFrame, terms: list[Term], n_toxic: int, n_other: int) -> frozenset[str]:
    """Words near a term that enough other documents hold and that aren't much more frequent in toxic ones.

    They match no term; all other misspellings of the terms still do.
    """
    sent = bounded_batches(sample.sparkSession).sparkContext.broadcast(terms)

    def run(batches):
        lexicon = Lexicon(sent.value)
        for batch in batches:
            seen: Counter = Counter()
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in set(tokens((text or "").encode())):
                    match = lexicon.find(word)
                    if match is not None and match.edits:
                        seen[word, toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.int32()),
                 pa.array(list(seen.values()), pa.int64())], ["word", "toxic", "n"])

    found = sample.select(F.col("toxic").cast("int"), "text").mapInArrow(run, "word string, toxic int, n long")
    split = lambda t: F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)).alias(f"n{t}")
    counts = found.groupBy("word").agg(split(0), split(1)).where(
        (F.col("n0") >= MIN_DOCS)
        & ((F.col("n1") + 0.5) / (n_toxic + 1) < MIN_RATIO * (F.col("n0") + 0.5) / (n_other + 1))
    )
    return frozenset(r["word"] for r in counts.orderBy(F.desc("n0"), "word").limit(FALSE_FRIENDS).collect())


def with_evidence(docs: DataFrame, terms: list[Term], friends: frozenset[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((terms, friends))

    def make():
        lexicon = Lexicon(*sent.value)

        def work(rows: pa.StructArray) -> pa.Array:
            return pa.array([evidence(t, lexicon) for t in texts_of(rows)], pa.list_(pa.float64()))

        return work

    return with_found(docs, make, "array<double>")


def train(docs: DataFrame, labels: DataFrame, training: Column, rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon and logistic model from the labelled documents where ``training`` holds."""
    bounded_batches(docs.sparkSession)
    drawn = materialise(sample_documents(docs, labels, "toxic", training, rows), "toxic-drawn")
    sample = materialise(without_copies(drawn), "toxic-sample")
    counts, n_toxic, n_other = count_terms(sample)
    terms = choose_terms(counts, n_toxic, n_other) if n_toxic and n_other else []
    friends = false_friends(sample, terms, n_toxic, n_other) if terms else frozenset()
    got = with_evidence(sample, terms, friends).select(
        F.col("row.doc_id").alias("i"), F.col("row.toxic").alias("y"), F.col("found").alias("x")
    ).groupBy("i", "y").agg(F.min("x").alias("x")).orderBy("i").collect()
    x = np.array([r["x"] for r in got], float).reshape(-1, len(FEATURES))
    weights, bias = fit_logistic(x, np.array([r["y"] for r in got], float))
    return Model(terms, friends, weights, bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` and the score as ``found``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value
        lexicon = Lexicon(own.terms, own.friends)

        def work(rows: pa.StructArray) -> pa.Array:
            x = np.array([evidence(t, lexicon) for t in texts_of(rows)], float).reshape(-1, len(FEATURES))
            return pa.array(own.score(x))

        return work

    return with_found(docs, make, "double")


def training_rows() -> Column:
    return fold("doc_id", FOLDS) != HELD_OUT


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels, training_rows()))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), (fold("row.doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        F.col("found").alias("score"), (F.col("found") >= CUT).cast("int").alias("predicted"),
    )


def civil_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns."""
    return unpacked(scored(docs, train(docs, labels, training_rows())).where(F.col("found") < CUT))
