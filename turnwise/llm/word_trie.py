"""Tries of word pairs and triples, and the coded blocks in which grams and answers travel.

A gram is a word ``next`` after the words ``far`` and ``near`` before it. It travels as two numbers: ``near``, a
hash of the nearest word (shifted left by one; see below), and ``rest``, shorter hashes of ``far`` and
``next``. Sorted by both, blocks hold differences, byte plane by byte plane, compressed.

A trie holds all grams with some near words, so smoothing finds all it needs in one place: pairs are
marginal sums of triples. Levels, each sorted within the range its parent points to, with monotone pointers
in Elias-Fano code and 8-bit codes for numbers:

* near words, with the backoff of the pair level;
* next words under a near word, with the pair's probability;
* far words under a near word, with the backoff of the triple level;
* next words under near and far word, with the triple's probability.

Probabilities are those of interpolated Witten-Bell smoothing: n / (total + kinds) for what was seen after
a context, and the backoff kinds / (total + kinds) for the level below. A gram is looked up by successor
searches, each within the range of its context, and answered by two numbers (a, b): its probability is
a + b * p, where p is the probability of ``next`` by itself.

A near word with a great share of all tokens would gather too much in one place. Its grams then carry,
as ``near``, a hash of both words with the lowest bit set: its contexts spread over places, and a trie
answers with the triple level only; the pair level of such words is counted apart.
"""

from __future__ import annotations

import pickle

import numpy as np
import zstandard

from turnwise.llm.elias_fano import EliasFano, in_mapped_memory, quantise, successor

#: Codes of answers lie evenly on the logarithm, over so many decades.
DECADES, CODES = 10, 254


def pack(*columns: np.ndarray) -> bytes:
    """Columns of non-negative whole numbers as compressed byte planes."""
    parts, widths = [], []
    for values in columns:
        width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
        raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
        parts.append(np.ascontiguousarray(raw[:, :width].T).tobytes())
        widths.append((len(values), width))
    head = pickle.dumps(widths)
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    size = int.from_bytes(raw[:4], "little")
    at, out = 4 + size, []
    for n, width in pickle.loads(raw[4:at]):
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        values = np.zeros((n, 8), np.uint8)
        values[:, :width] = planes.T
        out.append(values.view("<u8").reshape(n))
        at += n * width
    return out


def group_starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Places where a new combination of values starts in sorted columns."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def pack_grams(near: np.ndarray, rest: np.ndarray, n: np.ndarray) -> bytes:
    """Different grams, sorted by ``near`` and ``rest``, with their counts."""
    start = group_starts(near)
    near_gap, rest_gap = near.copy(), rest.copy()
    near_gap[1:] -= near[:-1]
    rest_gap[1:] -= rest[:-1]
    rest_gap[start] = rest[start]
    return pack(near_gap, rest_gap, n)


def unpack_grams(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    near_gap, rest_gap, n = unpack(data)
    near = np.cumsum(near_gap, dtype=np.uint64)
    start = group_starts(near)
    running = np.cumsum(rest_gap, dtype=np.uint64)
    base = running[start] - rest_gap[start]
    return near, running - np.repeat(base, np.diff(np.r_[start, len(near)])), n


def pack_keys(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Different sorted keys with their counts."""
    gap = keys.copy()
    gap[1:] -= keys[:-1]
    return pack(gap, n)


def unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    gap, n = unpack(data)
    return np.cumsum(gap, dtype=np.uint64), n


def codes_of(p: np.ndarray) -> np.ndarray:
    """8-bit codes of probabilities: 0 for none, else steps of the logarithm."""
    with np.errstate(divide="ignore"):
        steps = np.round(-np.log10(p) * (CODES / DECADES))
    return np.where(p > 0, 1 + np.clip(steps, 0, CODES), 0).astype(np.uint8)


CODE_BOOK = np.r_[0.0, 10.0 ** (-np.arange(CODES + 1) * (DECADES / CODES))]


def build(near: np.ndarray, rest: np.ndarray, n: np.ndarray, width: int) -> bytes:
    """A trie of different grams, sorted by ``near`` and ``rest``, with counts above 0."""
    far, follower = rest >> np.uint64(width), rest & np.uint64((1 << width) - 1)
    n = n.astype(np.int64)
    nears, pairs_far = group_starts(near), group_starts(near, far)
    sizes = lambda start, size: np.diff(np.r_[start, size])
    triple_kinds = sizes(pairs_far, len(n))
    triple_total = np.add.reduceat(n, pairs_far) if len(n) else n
    split = (near & np.uint64(1)).astype(bool)
    # pairs of near and next: marginal sums over far
    own = np.flatnonzero(~split)
    order = own[np.lexsort((follower[own], near[own]))]
    pairs = group_starts(near[order], follower[order])
    pair_near, pair_n = near[order][pairs], np.add.reduceat(n[order], pairs) if len(order) else n[:0]
    key = near[nears]
    first, last = (np.searchsorted(pair_near, key, side=x) for x in ("left", "right"))
    running = np.r_[0, pair_n.cumsum()]
    total, kinds = running[last] - running[first], last - first
    pair_of = np.repeat(np.arange(len(key)), kinds)
    far_of = np.repeat(np.arange(len(pairs_far)), triple_kinds)
    with np.errstate(divide="ignore", invalid="ignore"):
        numbers = {
            "near_back": np.where(kinds > 0, np.log10(kinds / (total + kinds)), 0.0),
            "pair_p": np.log10(pair_n / (total + kinds)[pair_of]),
            "far_back": np.log10(triple_kinds / (triple_total + triple_kinds)),
            "triple_p": np.log10(n / (triple_total + triple_kinds)[far_of]),
        }
    levels: dict[str, np.ndarray] = {
        "near": key, "pair": follower[order][pairs].astype(np.uint32), "far": far[pairs_far].astype(np.uint32),
        "triple": follower.astype(np.uint32),
    }
    for name, values in numbers.items():
        levels[name], levels[name + "_book"] = quantise(values)
    for name, places in (
        ("to_pair", np.r_[first, len(pairs)]),
        ("to_far", np.r_[np.searchsorted(pairs_far, nears), len(pairs_far)]),
        ("to_triple", np.r_[pairs_far, len(n)]),
    ):
        coded = EliasFano.of(places.astype(np.int64))
        levels |= {name + "_low": coded.low, name + "_high": coded.high, name + "_before": coded.before,
                   name + "_bits": np.array([coded.bits])}
    parts, index, at = [], {}, 0
    for name, values in levels.items():
        data = values.tobytes()
        index[name] = (at, values.dtype.str, len(values))
        parts.append(data + bytes(-len(data) % 8))
        at += len(parts[-1])
    head = pickle.dumps(index)
    return b"".join((len(head).to_bytes(8, "little"), head, bytes(-len(head) % 8), *parts))


class WordTrie:
    """A trie over mapped memory."""

    def __init__(self, data: bytes, width: int):
        memory = in_mapped_memory(data)
        size = int.from_bytes(memory[:8], "little")
        base = 8 + size + -size % 8
        self.width = width
        self.level = {
            name: np.frombuffer(memory, np.dtype(kind), n, base + at)
            for name, (at, kind, n) in pickle.loads(memory[8:8 + size]).items()
        }
        self.pointers = {
            name: EliasFano(self.level[name + "_low"], int(self.level[name + "_bits"][0]), self.level[name + "_high"],
                            self.level[name + "_before"])
            for name in ("to_pair", "to_far", "to_triple")
        }

    def _children(self, name: str, parent: np.ndarray, pointers: str, wanted: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Places of the wanted children of ``parent[of]``; parents that aren't stored have none."""
        held = np.maximum(parent, 0)
        known = parent >= 0
        if not len(self.level["near"]):
            return np.full(len(wanted), -1)
        low, high = (np.where(known, self.pointers[pointers].at(held + k), 0) for k in (0, 1))
        return successor(self.level[name], low[of], high[of], wanted)

    def _number(self, name: str, place: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(place), missing)
        known = place >= 0
        out[known] = 10.0 ** self.level[name + "_book"][self.level[name][place[known]]]
        return out

    def ask(self, near: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) of different grams, sorted by ``near`` and ``rest``."""
        far = (rest >> np.uint64(self.width)).astype(np.uint32)
        follower = (rest & np.uint64((1 << self.width) - 1)).astype(np.uint32)
        nears, contexts = group_starts(near), group_starts(near, far)
        repeats = lambda start: np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(near)]))
        near_of, context_of = repeats(nears), repeats(contexts)
        wanted = near[nears]
        root = successor(self.level["near"], np.zeros(len(wanted)), np.full(len(wanted), len(self.level["near"])), wanted)
        pair = self._children("pair", root, "to_pair", follower, near_of)
        context = self._children("far", root, "to_far", far[contexts], near_of[contexts])
        triple = self._children("triple", context, "to_triple", follower, context_of)
        far_back = self._number("far_back", context, 1.0)[context_of]
        a = self._number("triple_p", triple, 0.0) + far_back * self._number("pair_p", pair, 0.0)
        return a, far_back * self._number("near_back", root, 1.0)[near_of]
