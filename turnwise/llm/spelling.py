"""Spelling model: probabilities of unknown words from a 5-gram trie over byte classes.

32 symbol classes of bytes (each small letter, digits, other ASCII, lead bytes, continuation bytes,
separator, end), with interpolated Witten-Bell smoothing, and a byte's probability within its class given
the byte before. It learns from the different words of the training texts, each spelled once. 32 classes
bound the model whatever the corpus: at most 32**5 five-grams. Smoothing runs in Spark by the nearest context symbol; the tries, one
per leading symbol, are built in Spark too. A trie level holds symbols, probabilities and backoffs quantised
to 8 bits, and monotone pointers to the next level in Elias-Fano code. Workers keep the levels in mapped memory
and look up a gram by a successor search within the range that its context points to. A dense memory of
answers (one per gram) spares asking twice.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import LOWER, bounded_batches, materialise
from turnwise.llm.elias_fano import EliasFano, in_mapped_memory, quantise

ORDER, BITS = 5, 5
CLASSES = 1 << BITS
DIGIT, OTHER, LEAD, FOLLOW, SEPARATOR, END = 26, 27, 28, 29, 30, 31
#: Weight of the class-wide byte share in a byte's probability given the byte before.
PRIOR = 4.0

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[97:123] = np.arange(26)
_CLASS[48:58] = DIGIT
_CLASS[128:192], _CLASS[192:], _CLASS[32] = FOLLOW, LEAD, SEPARATOR
#: Classes of more than one byte.
_WIDE = np.isin(_CLASS, (DIGIT, OTHER, LEAD, FOLLOW))
_PAIRS = 1 << ORDER * BITS
_NO_PAIR = 1 << 16


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.translate(LOWER).split()


def grams(word_lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Five-gram and byte-pair numbers of the symbols of several texts, and where each text starts.

    A text is its words, each followed by a separator, and the end; before it stand separators. The
    pair number is 65536 where a symbol's class has one byte only.
    """
    pad = b" " * (ORDER - 1)
    parts = [b"".join((pad, b" ".join(w), b" " if w else b"", b"E")) for w in word_lists]
    sizes = np.array([len(p) for p in parts])
    raw = np.frombuffer(b"".join(parts), np.uint8)
    symbol = _CLASS[raw].astype(np.uint32)
    ends = sizes.cumsum()
    symbol[ends - 1] = END
    key = symbol.copy()
    for back in range(1, ORDER):
        key[back:] |= symbol[:-back] << np.uint32(BITS * back)
    pair = np.zeros(len(raw), np.uint32)
    pair[1:] = raw[:-1].astype(np.uint32) << np.uint32(8) | raw[1:]
    pair[~_WIDE[raw]] = _NO_PAIR
    pair[ends - 1] = _NO_PAIR
    real = np.ones(len(raw), bool)
    for back in range(ORDER - 1):
        real[ends - sizes + back] = False
    starts = np.r_[0, (sizes - (ORDER - 1)).cumsum()[:-1]]
    return key[real], pair[real], starts


def merge_counts(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def gram_counts(words: DataFrame) -> DataFrame:
    """gram and n over the different words, each spelled once; byte pairs are numbered from 32**5 on."""
    bounded_batches(words.sparkSession)

    def run(batches):
        held = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            lists = [[w] for w in batch.column(0).to_pylist()]
            if not lists:
                continue
            key, pair, _ = grams(lists)
            k, n = np.unique(key, return_counts=True)
            p = np.bincount(pair, minlength=_NO_PAIR + 1)[:_NO_PAIR]
            q = np.flatnonzero(p)
            held = merge_counts(
                np.concatenate([held[0], k.astype(np.int64), q + _PAIRS]), np.concatenate([held[1], n, p[q]])
            )
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["gram", "n"])

    return words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def byte_scores(pairs: dict[int, int]) -> np.ndarray:
    """log10 probability of a byte within its class given the byte before; 0 where the class has one byte, and for no pair."""
    n = np.zeros((256, 256))
    for pair, count in pairs.items():
        n[pair >> 8, pair & 255] = count
    share = np.ones(256)
    out = np.zeros((256, 256))
    for c in (DIGIT, OTHER, LEAD, FOLLOW):
        own = np.flatnonzero(_CLASS == c)
        total = n[:, own].sum(axis=0) + 1
        share[own] = total / total.sum()
        seen = n[:, own]
        out[:, own] = np.log10((seen + PRIOR * share[own]) / (seen.sum(axis=1, keepdims=True) + PRIOR))
    return np.r_[out.ravel(), 0.0]


# --- smoothing -------------------------------------------------------------------------------------------------------


def first_order(n: np.ndarray) -> np.ndarray:
    """Smoothed shares of the symbols themselves."""
    kinds = (n > 0).sum()
    return (n + max(kinds, 1) / CLASSES) / (n.sum() + max(kinds, 1))


def smoothed(keys: np.ndarray, n: np.ndarray, single: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order above 1: grams with log10 probability, contexts with log10 backoff.

    All five-grams with one nearest context symbol are given; a shorter context of theirs ends in
    that symbol too, so all counts that interpolation needs are here.
    """
    out = []
    lower_keys, lower_p = np.arange(CLASSES, dtype=np.int64), single
    for order in range(2, ORDER + 1):
        own, count = merge_counts(keys & ((1 << BITS * order) - 1), n)
        context, start = np.unique(own >> BITS, return_index=True)
        total, kinds = np.add.reduceat(count, start), np.diff(np.r_[start, len(own)])
        back = kinds / (total + kinds)
        of = np.repeat(np.arange(len(context)), kinds)
        below = lower_p[np.searchsorted(lower_keys, own & ((1 << BITS * (order - 1)) - 1))]
        p = count / (total + kinds)[of] + back[of] * below
        out.append((order, own, np.log10(p), context, np.log10(back)))
        lower_keys, lower_p = own, p
    return out


# --- the trie --------------------------------------------------------------------------------------------------------


def build_trie(order: np.ndarray, gram: np.ndarray, p: np.ndarray, back: np.ndarray) -> bytes:
    """Levels of the grams with one leading symbol, as bytes: a pickled index, then the arrays end to end."""
    parts: list[np.ndarray] = []
    index: list[dict] = []
    above = gram[order == 1]
    for level in range(1, ORDER + 1):
        here = order == level
        keys = gram[here]
        sort = np.argsort(keys)
        keys = keys[sort]
        codes, book = quantise(p[here][sort])
        backs, back_book = quantise(back[here][sort])
        entry = {"p": codes, "back": backs, "symbol": (keys & (CLASSES - 1)).astype(np.uint8)}
        extra = {"book": book, "back_book": back_book}
        if level > 1:
            pointers = EliasFano.of(np.r_[np.searchsorted(keys >> BITS, above, side="left"), len(keys)].astype(np.int64))
            entry |= {"low": pointers.low, "high": pointers.high, "before": pointers.before}
            extra["bits"] = pointers.bits
        where = {}
        for name, values in entry.items():
            where[name] = (sum(len(x) for x in parts), values.dtype.str, len(values))
            data = values.tobytes()
            parts.append(data + bytes(-len(data) % 8))
        index.append({"where": where} | extra)
        above = keys
    head = pickle.dumps(index)
    return len(head).to_bytes(8, "little") + head + bytes(-len(head) % 8) + b"".join(parts)


class Trie:
    """One leading symbol's levels over mapped memory."""

    def __init__(self, data: memoryview):
        size = int.from_bytes(data[:8], "little")
        base = 8 + size + -size % 8
        self.levels = []
        for entry in pickle.loads(data[8:8 + size]):
            level = {k: v for k, v in entry.items() if k != "where"}
            for name, (start, kind, n) in entry["where"].items():
                level[name] = np.frombuffer(data, np.dtype(kind), n, base + start)
            if "low" in level:
                level["pointers"] = EliasFano(level["low"], level["bits"], level["high"], level["before"])
            self.levels.append(level)

    def child(self, level: int, parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Places in ``level`` (from 1) of the parents' children with the symbol, or -1: the first child not
        below the symbol is searched by halving within the range that the parent points to."""
        here = self.levels[level]
        low, high = here["pointers"].at(parent), here["pointers"].at(parent + 1)
        end = high.copy()
        for _ in range(BITS + 1):
            open_ = low < high
            middle = low + high >> 1
            less = open_ & (here["symbol"][np.minimum(middle, len(here["symbol"]) - 1)] < symbol) if len(here["symbol"]) else open_ & False
            low = np.where(less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        hit = low < end
        hit[hit] = here["symbol"][low[hit]] == symbol[hit]
        return np.where(hit, low, -1)

    def lookup(self, gram: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability (nan if not stored) of grams of one order, and the backoff of their contexts (0 if none)."""
        place = np.zeros(len(gram), np.int64)
        back = np.zeros(len(gram))
        for level in range(1, order):
            symbol = gram >> BITS * (order - 1 - level) & (CLASSES - 1)
            if level == order - 1:
                known = place >= 0
                here = self.levels[level - 1]
                back[known] = here["back_book"][here["back"][place[known]]]
            known = place >= 0
            place[known] = self.child(level, place[known], symbol[known])
        p = np.full(len(gram), np.nan)
        known = place >= 0
        here = self.levels[order - 1]
        code = here["p"][place[known]]
        p[known] = np.where(code > 0, here["book"][code], np.nan)
        return p, back


@dataclass(frozen=True)
class Model:
    """What is sent to workers: a trie per leading symbol, single symbols, and bytes within classes."""

    tries: dict[int, bytes]
    single: np.ndarray
    pairs: np.ndarray


class Scorer:
    """A model over mapped memory, with the answers found so far."""

    def __init__(self, model: Model):
        self.single, self.pairs = np.log10(model.single), model.pairs
        self.tries: dict[int, Trie] = {}
        for lead, data in model.tries.items():
            self.tries[lead] = Trie(in_mapped_memory(data))
        self.memory = np.full(_PAIRS, np.nan, np.float32)

    def ask(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of five-grams, with backoff to shorter ones."""
        total = np.zeros(len(gram))
        open_ = np.ones(len(gram), bool)
        for order in range(ORDER, 1, -1):
            cut = gram & ((1 << BITS * order) - 1)
            lead = cut >> BITS * (order - 1)
            for symbol in np.unique(lead[open_]):
                own = np.flatnonzero(open_ & (lead == symbol))
                if int(symbol) not in self.tries:
                    continue
                p, back = self.tries[int(symbol)].lookup(cut[own], order)
                stored = ~np.isnan(p)
                total[own] += np.where(stored, np.nan_to_num(p), back)
                open_[own[stored]] = False
        total[open_] += self.single[gram[open_] & (CLASSES - 1)]
        return total

    def token_scores(self, word_lists: list[list[bytes]]) -> np.ndarray:
        """log10 probability of each token's symbols given those before: the texts' words and ends in turn."""
        key, pair, starts = grams(word_lists)
        found = self.memory[key]
        missing = np.unique(key[np.isnan(found)])
        if len(missing):
            self.memory[missing] = self.ask(missing.astype(np.int64))
            found = self.memory[key]
        first = np.zeros(len(key), bool)
        first[1:] = (key[:-1] & (CLASSES - 1)) == SEPARATOR
        first[starts] = True
        return np.add.reduceat(found.astype(np.float64) + self.pairs[pair], np.flatnonzero(first))


def train_spelling(words: DataFrame) -> Model:
    """Counts, smooths and builds in Spark; at most 32 tries, 32 symbols and 65536 byte pairs reach the driver."""
    gathered = materialise(gram_counts(words), "grams")
    of_grams = gathered.where(F.col("gram") < _PAIRS)
    single = np.zeros(CLASSES)
    for r in of_grams.groupBy(F.col("gram").bitwiseAND(CLASSES - 1).alias("s")).agg(F.sum("n").alias("n")).collect():
        single[r["s"]] = r["n"]
    share = first_order(single)
    pairs = {r["gram"] - _PAIRS: r["n"] for r in gathered.where(F.col("gram") >= _PAIRS).collect()}

    def smooth(table: pa.Table) -> pa.Table:
        keys, n = (table.column(c).to_numpy().astype(np.int64) for c in ("gram", "n"))
        sort = np.argsort(keys)
        rows = []
        for order, own, p, context, back in smoothed(keys[sort], n[sort], share):
            rows.append((np.full(len(own), order), own, p, np.full(len(own), np.nan)))
            rows.append((np.full(len(context), order - 1), context, np.full(len(context), np.nan), back))
        order, gram, p, back = (np.concatenate(x) for x in zip(*rows, strict=True))
        lead = gram >> BITS * (order - 1)
        return pa.table({"lead": lead, "level": order, "gram": gram, "p": p, "back": back})

    def build(table: pa.Table) -> pa.Table:
        level, gram, p, back = (table.column(c).to_numpy() for c in ("level", "gram", "p", "back"))
        lead = int(table.column("lead")[0].as_py())
        # a gram may come twice: with its probability, and as a context with its backoff
        code = level.astype(np.int64) << 40 | gram
        keys, place = np.unique(np.r_[code, 1 << 40 | lead], return_inverse=True)
        values = np.full((2, len(keys)), np.nan)
        for k, x in enumerate((p, back)):
            known = ~np.isnan(x)
            values[k, place[:-1][known]] = x[known]
        data = build_trie(keys >> 40, keys & ((1 << 40) - 1), *values)
        return pa.table({"lead": pa.array([lead], pa.int64()), "data": pa.array([data], pa.binary())})

    nearest = F.shiftright("gram", BITS).bitwiseAND(CLASSES - 1).alias("nearest")
    rows = of_grams.select(nearest, "gram", "n").groupBy("nearest").applyInArrow(
        smooth, "lead long, level long, gram long, p double, back double"
    )
    tries = rows.groupBy("lead").applyInArrow(build, "lead long, data binary").collect()
    return Model({r["lead"]: bytes(r["data"]) for r in tries}, share, byte_scores(pairs))


_SCORERS: dict[int, Scorer] = {}


def worker_scorer(model) -> Scorer:
    """One per Python worker and broadcast model."""
    if id(model.value) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(model.value)] = Scorer(model.value)
    return _SCORERS[id(model.value)]
