"""Language-model scores from word n-gram tries with Elias-Fano pointers.

Documents are packed into chunks of about 4 MB of text, each one row of a table in the shared folder, in the
order in which tasks read them; so copies of a document stay where they are, and chunks don't grow. A chunk
keeps its tokens as numbers of its different words. It sends to every part one coded block: its words that
aren't frequent, and its different triples of words (the word and the two before it), each with its count in training documents.
Parts are given by a hash of the word, or of the nearest word before. A part adds up all blocks, which gives
the corpus's counts, builds one trie (``word_trie``: pairs are marginal sums of triples, smoothed in place,
Elias-Fano pointers, 8-bit probabilities, mapped memory, context-relative successor search), and answers every
block in the block's own order: exact counts of words, and a byte or two for each gram. So a gram crosses the
network once, and its answer once. Answers meet their chunk, which finds its grams again and scores.

Counts grow with the corpus, without a bound: all words, pairs and triples of all training documents.

A word that precedes more than a part's share of all tokens is *split*: its triples spread by both words before,
and its pairs travel as blocks of their own, by a hash of the pair. Which words are split changes no model value
but one: the kinds of words after a split word are counted by a HyperLogLog++ sketch with 1 % error. What follows
one pair of words stays in one part; that is at most one row per different word and chunk.

The probability of a word by itself is its share of the training tokens; unknown words share the mass of words
seen once, half of it evenly over as many as are known and half by their spelling (``spelling``). Interpolated
Witten-Bell smoothing leads from there to the pair and to the triple; that is the score.

Grams travel as hashes whose widths grow with the corpus, so that an unseen gram is taken for another with a
chance of at most one in 1000 for the near word and one in 16 times the share of all words that stand there.

*Base*: exact counts of exact words. Words with at least 1/300000 of all tokens (so 300000 at most) are broadcast.

Null texts are empty: one end token. Empty training data gives the spelling model without words and c = 0 for all.
Repeated rows score alike; a missing id hashes as empty text. A very long text is a chunk of its own. An empty
table gives an empty result. Extra columns take no part.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import bounded_batches, fold, materialise
from turnwise.llm.near_dedup import mix, word_hashes
from turnwise.llm.spelling import train_spelling, words_of, worker_scorer
from turnwise.llm.word_trie import (
    CODE_BOOK,
    WordTrie,
    build,
    codes_of,
    group_starts,
    pack,
    pack_grams,
    pack_keys,
    unpack,
    unpack_grams,
    unpack_keys,
)

FOLDS, HELD_OUT = 7, 2
#: Text of a chunk and of a part; a task also holds a chunk's or a part's grams, several times its text.
CHUNK_BYTES, PART_BYTES = 4 << 20, 6 << 20
FREQUENT = 300_000
#: Distinct words a task counts before it hands them on.
COUNTED = 250_000
#: Words whose hashes are worked out at once.
HASHED = 50_000
#: Weight of the spelling in an unknown word's probability; an even share has the rest.
SPELLED = 0.5
#: Relative error of the kinds of words after a split word.
KINDS_ERROR = 0.01

#: Numbers of the start and the end of a text, and of a chunk's first word.
START, END, FIRST = 0, 1, 2
_MARKS, _PAIR, _SPLIT = (np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in (101, 103, 107))


@dataclass(frozen=True)
class Plan:
    """Totals of the training documents and the widths and places that follow from them."""

    tokens: int
    kinds: int
    single: int
    documents: int
    parts: int

    @property
    def near_bits(self) -> int:
        return min(44, self.kinds.bit_length() + 10)

    @property
    def word_bits(self) -> int:
        return min(31, max(16, self.kinds.bit_length() + 4))

    @property
    def pair_bits(self) -> int:
        return min(44, self.tokens.bit_length() + 10)

    def part_of(self, key: np.ndarray, bits: int) -> np.ndarray:
        """Ranges of a key of so many bits."""
        return (key * np.uint64(self.parts)) >> np.uint64(bits)


# --- chunks ----------------------------------------------------------------------------------------------------------


CHUNK = "chunk long, docs binary, words binary, tokens binary"


def numbered(docs: pa.Table) -> tuple[bytes, bytes, bytes]:
    """Documents (doc_id, held_out, text) as their ids and lengths, their different words, and the words' numbers in
    turn, each text closed by an end. The most frequent words have the smallest numbers, which pack best."""
    seen: defaultdict[bytes, int] = defaultdict(count().__next__)
    token, lengths = array("i"), []
    for text in docs.column("text"):
        words = words_of(text.as_buffer().to_pybytes() if text.is_valid else b"")
        token.extend(map(seen.__getitem__, words))
        lengths.append(len(words))
    raw = np.array(token, np.int64)
    found = list(seen)
    order = np.array(list(map(seen.__getitem__, sorted(found))), np.int64)
    order = order[np.argsort(-np.bincount(raw, minlength=len(found))[order], kind="stable")]
    number = np.empty(len(found), np.int64)
    number[order] = np.arange(FIRST, FIRST + len(found))
    tokens = np.insert(number[raw], np.cumsum(lengths, dtype=np.int64), END)
    head = docs.select(["doc_id", "held_out"]).append_column("length", pa.array(np.array(lengths, np.int64) + 1))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, head.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(head)
    return (sink.getvalue().to_pybytes(), zstandard.compress(b" ".join([found[k] for k in order]), 6), pack(tokens))


def chunk_table(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Consecutive documents, numbered; one row per chunk."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")

    def out(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        chunk = (TaskContext.get().partitionId() << 32) + number
        parts = numbered(pa.Table.from_batches(held))
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), *[pa.array([x], pa.binary()) for x in parts]], ["chunk", "docs", "words", "tokens"]
        )

    def run(batches):
        held, size, number = [], 0, 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy()
            total = lengths.cumsum()
            at = 0
            while at < batch.num_rows:
                base = total[at - 1] if at else 0
                end = max(at + (not held), int(np.searchsorted(total, base + chunk_bytes - size, side="right")))
                if end > at:
                    held.append(batch.slice(at, end - at))
                    size += int(total[end - 1] - base)
                if end < batch.num_rows:
                    yield out(held, number)
                    held, size, number = [], 0, number + 1
                at = end
        if held:
            yield out(held, number)

    return materialise(rows.mapInArrow(run, CHUNK), "chunks")


class Chunk:
    """A chunk's documents as numbers of its different words; all tokens in turn."""

    def __init__(self, docs: bytes, words: bytes, tokens: bytes):
        table = pa.ipc.open_stream(docs).read_all()
        self.doc_id, self.held_out = table.column("doc_id"), table.column("held_out").to_numpy()
        self.length = table.column("length").to_numpy()
        self.words = zstandard.decompress(words).split()
        self.token = unpack(tokens)[0].astype(np.int32)
        self.start = self.length.cumsum() - self.length
        parts = [word_hashes(b" ".join(self.words[at:at + HASHED])) for at in range(0, len(self.words), HASHED)]
        self.hash = np.concatenate([mix(np.arange(FIRST, dtype=np.uint64) + _MARKS), *parts])
        self.near, self.far = self._before(1), self._before(2)
        self.train = np.repeat(~self.held_out, self.length)

    def _before(self, back: int) -> np.ndarray:
        """The token so many places before each, in its text."""
        out = np.full(len(self.token), START, np.int32)
        if back < len(out):
            out[back:] = self.token[:-back]
        for k in range(back):
            at = self.start + k
            out[at[self.length > k]] = START
        return out

    def numbers_of(self, words: dict[bytes, int]) -> list[tuple[int, bytes]]:
        """Numbers of the given words in this chunk; the start has the name of the empty word."""
        return [(k, w) for k, w in enumerate((b"", None, *self.words)) if w in words]


def word_counts(chunks: DataFrame) -> DataFrame:
    """word (bytes) and n over all training documents, without the end token."""

    def out(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"]
        )

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for _, *data in zip(*batch.columns, strict=True):
                chunk = Chunk(*[x.as_py() for x in data])
                in_train = np.bincount(chunk.token[chunk.train], minlength=len(chunk.hash))[FIRST:]
                for word, n in zip(chunk.words, in_train.tolist(), strict=True):
                    if n:
                        seen[word] += n
                if len(seen) > COUNTED:
                    yield out(seen)
                    seen = Counter()
        yield out(seen)

    return chunks.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Asked:
    """What a chunk asks for: each kind sorted by part and then by its key."""

    words: np.ndarray
    word_n: np.ndarray
    word_part: np.ndarray
    near: np.ndarray
    rest: np.ndarray
    n: np.ndarray
    gram_part: np.ndarray
    of_gram: np.ndarray
    pair: np.ndarray
    pair_n: np.ndarray
    pair_part: np.ndarray
    of_pair: np.ndarray
    split_token: np.ndarray


def in_order(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Order by three columns of small numbers; one sort where they fit into one number."""
    low, high = (int(x.max(initial=0)).bit_length() for x in (third, second))
    if int(first.max(initial=0)).bit_length() + low + high > 63:
        return np.lexsort((third, second, first))
    return np.argsort(first << (low + high) | second << low | third)


def asked_by(chunk: Chunk, plan: Plan, frequent, split: dict[bytes, int]) -> Asked:
    h = chunk.hash
    is_split = np.zeros(len(h), bool)
    is_split[[k for k, _ in chunk.numbers_of(split)]] = True
    split_token = is_split[chunk.near]
    # near numbers: those of words, then those of both words before where the near one is split
    own = h[chunk.near[split_token]]
    both, both_at = np.unique(mix(mix(own + _SPLIT) + h[chunk.far[split_token]]), return_inverse=True)
    shift = np.uint64(64 - plan.near_bits)
    one = np.uint64(1)
    near_keys, near_rank = np.unique(
        np.concatenate([h >> shift << one, both >> shift << one | one]), return_inverse=True
    )
    near_number = chunk.near.astype(np.int64)
    near_number[split_token] = len(h) + both_at
    keys, rank = np.unique(h >> np.uint64(64 - plan.word_bits), return_inverse=True)
    # all keys are leading bits of hashes, so the order by ranks is that by keys, and parts are ranges of near
    columns = near_rank[near_number], rank[chunk.far], rank[chunk.token]
    del near_number
    order = in_order(*columns)
    first, second, third = (c[order] for c in columns)
    del columns
    start = group_starts(first, second, third)
    of_gram = np.empty(len(order), np.int64)
    of_gram[order] = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(order)]))
    near = near_keys[first[start]]
    rest = keys[second[start]] << np.uint64(plan.word_bits) | keys[third[start]]
    n = np.bincount(of_gram[chunk.train], minlength=len(start))
    pair = mix(mix(own + _PAIR) + h[chunk.token[split_token]]) >> np.uint64(64 - plan.pair_bits)
    pairs, of_pair = np.unique(pair, return_inverse=True)
    pair_n = np.bincount(of_pair[chunk.train[split_token]], minlength=len(pairs))
    in_train = np.bincount(chunk.token[chunk.train], minlength=len(h))
    rare = np.array([k for k, w in enumerate(chunk.words, FIRST) if w not in frequent], np.int64)
    word_part = plan.part_of(h[rare] >> np.uint64(32), 32)
    by_part = np.argsort(word_part, kind="stable")
    rare = rare[by_part]
    return Asked(
        rare, in_train[rare], word_part[by_part], near, rest, n, plan.part_of(near >> one, plan.near_bits), of_gram,
        pairs, pair_n, plan.part_of(pairs, plan.pair_bits), of_pair, split_token,
    )


def blocks_of(chunk: Chunk, asked: Asked, parts: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """Per part that a chunk asks anything of: words, their counts, pairs and grams."""
    bounds = np.arange(parts + 1)
    at = [np.searchsorted(x, bounds) for x in (asked.word_part, asked.pair_part, asked.gram_part)]
    for part in range(parts):
        w, p, g = (slice(x[part], x[part + 1]) for x in at)
        if any(x.start < x.stop for x in (w, p, g)):
            words = b" ".join([chunk.words[k - FIRST] for k in asked.words[w].tolist()])
            yield (part, zstandard.compress(words, 3), pack(asked.word_n[w]), pack_keys(asked.pair[p], asked.pair_n[p]),
                   pack_grams(asked.near[g], asked.rest[g], asked.n[g]))


BLOCK = "part int, chunk long, words binary, word_n binary, pairs binary, grams binary"
ANSWER = "chunk long, part int, word_n binary, pair_n binary, gram_codes binary"


def asks(chunks: DataFrame, plan: Plan, frequent, split: dict[bytes, int]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for number, *data in zip(*batch.columns, strict=True):
                chunk = Chunk(*[x.as_py() for x in data])
                asked = asked_by(chunk, plan, frequent.value, split)
                rows = [(row[0], number.as_py(), *row[1:]) for row in blocks_of(chunk, asked, plan.parts)]
                kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["part", "chunk", "words", "word_n", "pairs", "grams"],
                )

    return chunks.mapInArrow(run, BLOCK)


# --- parts -----------------------------------------------------------------------------------------------------------


def added_up(columns: list[tuple[np.ndarray, ...]], sizes: list[int], n: np.ndarray):
    """Different keys of all blocks in order, their counts over all blocks, and where each block's keys are."""
    keys = [np.concatenate(c) for c in zip(*columns, strict=True)]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    start = group_starts(*keys)
    total = np.add.reduceat(n[order], start) if len(order) else n
    place = np.empty(len(order), np.int64)
    place[order] = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(order)]))
    return [k[start] for k in keys], total, np.split(place, np.cumsum(sizes)[:-1])


def word_answers(texts: list[bytes], counts: list[bytes]) -> list[bytes]:
    """Exact counts over all blocks, for each block in its order."""
    blocks = [zstandard.decompress(t).split() for t in texts]
    total: Counter = Counter()
    for words, packed in zip(blocks, counts, strict=True):
        for word, n in zip(words, unpack(packed)[0].tolist(), strict=True):
            total[word] += n
    return [pack(np.array([total[w] for w in words], np.int64)) for words in blocks]


def pair_answers(packed: list[bytes]) -> list[bytes]:
    blocks = [unpack_keys(x) for x in packed]
    _, total, places = added_up([(k,) for k, _ in blocks], [len(k) for k, _ in blocks], np.concatenate([n for _, n in blocks]))
    return [pack(total[at]) for at in places]


def gram_answers(packed: list[bytes], width: int) -> list[bytes]:
    """Builds the part's trie from all blocks and answers each block's grams, two codes a gram."""
    blocks = [unpack_grams(x) for x in packed]
    sizes = [len(x[0]) for x in blocks]
    (near, rest), total, places = added_up([b[:2] for b in blocks], sizes, np.concatenate([b[2] for b in blocks]))
    del blocks
    seen = total > 0
    trie = WordTrie(build(near[seen], rest[seen], total[seen], width), width)
    a, b = (codes_of(x) for x in trie.ask(near, rest))
    return [zstandard.compress(a[at].tobytes() + b[at].tobytes(), 1) for at in places]


def answers(asked: DataFrame, plan: Plan) -> DataFrame:
    width = plan.word_bits

    def run(table: pa.Table) -> pa.Table:
        texts, counts, pairs, grams = (table.column(c).to_pylist() for c in ("words", "word_n", "pairs", "grams"))
        made = word_answers(texts, counts), pair_answers(pairs), gram_answers(grams, width)
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part")} | {
            name: pa.array(values, pa.binary()) for name, values in zip(("word_n", "pair_n", "gram_codes"), made, strict=True)
        })

    return asked.groupBy("part").applyInArrow(run, ANSWER)


# --- scoring ---------------------------------------------------------------------------------------------------------


def followers(chunks: DataFrame, split: dict[bytes, int]) -> dict[bytes, int]:
    """Kinds of words after each split word in training documents; one row per split word reaches the driver."""
    names = list(split)

    def run(batches):
        known = {w: k for k, w in enumerate(names)}
        for batch in batches:
            for _, *data in zip(*batch.columns, strict=True):
                chunk = Chunk(*[x.as_py() for x in data])
                place = np.full(len(chunk.hash), -1)
                for number, word in chunk.numbers_of(known):
                    place[number] = known[word]
                own = chunk.train & (place[chunk.near] >= 0)
                keys = np.unique(place[chunk.near[own]] << 32 | chunk.token[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys >> 32), pa.array(chunk.hash[keys & 0xFFFFFFFF].view(np.int64))], ["name", "follower"]
                )

    rows = chunks.mapInArrow(run, "name long, follower long").groupBy("name").agg(
        F.approx_count_distinct("follower", KINDS_ERROR).alias("kinds")
    )
    return {names[r["name"]]: r["kinds"] for r in rows.collect()}


def alone(chunk: Chunk, n: np.ndarray, plan: Plan, scorer) -> np.ndarray:
    """Probability of each different word by itself, from its training count; unknown words by spelling."""
    unknown = max(plan.single, 1) / (plan.tokens + 1)
    p = (1 - unknown) * n / max(plan.tokens, 1)
    missing = np.flatnonzero(n[FIRST:] == 0)
    for at in range(0, len(missing), HASHED):
        own = missing[at:at + HASHED]
        spelled = 10.0 ** scorer.token_scores([[chunk.words[k]] for k in own])[::2]
        p[own + FIRST] = unknown * (SPELLED * spelled + (1 - SPELLED) / max(plan.kinds, 1))
    if not n[END]:
        p[END] = 10.0 ** scorer.token_scores([[]])[0]
    return p


def scored(
    chunk: Chunk, replies: pa.Table, plan: Plan, frequent: dict[bytes, int], split: dict[bytes, int],
    kinds_after: dict[bytes, int], scorer,
) -> pa.Table:
    """A chunk's rows from the answers of all parts."""
    asked = asked_by(chunk, plan, frequent, split)
    replies = replies.sort_by("part")
    column = lambda name: replies.column(name).to_pylist()
    n = np.array([0, plan.documents, *[frequent.get(w, 0) for w in chunk.words]], np.float64)
    n[asked.words] = np.concatenate([unpack(x)[0] for x in column("word_n")])
    codes = [np.frombuffer(zstandard.decompress(x), np.uint8).reshape(2, -1) for x in column("gram_codes")]
    a, b = (CODE_BOOK[c] for c in np.concatenate(codes, axis=1))
    below = alone(chunk, n, plan, scorer)[chunk.token]
    pair_n = np.concatenate([unpack(x)[0] for x in column("pair_n")]).astype(np.float64)
    at = asked.split_token
    facts = np.zeros((len(chunk.hash), 2))
    for number, word in chunk.numbers_of(split):
        facts[number] = split[word], max(1, min(kinds_after.get(word, 1), split[word]))
    total, kinds = facts[chunk.near[at]].T
    below[at] = (pair_n[asked.of_pair] + kinds * below[at]) / np.maximum(total + kinds, 1)
    own = np.log10(np.minimum(a[asked.of_gram] + b[asked.of_gram] * below, 1.0))
    count_of = n[chunk.token]
    base = np.log10(count_of + 1) - np.log10(plan.tokens + plan.kinds + 1)
    sums = lambda x: np.add.reduceat(x, chunk.start)
    return pa.table({
        "doc_id": chunk.doc_id, "held_out": pa.array(chunk.held_out), "n_tokens": pa.array(chunk.length),
        "n_known": pa.array(sums((count_of > 0).astype(np.int64))), "base_score": pa.array(sums(base)),
        "score": pa.array(sums(own)),
    })


def score_documents(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Base and model scores of every document, both learned from the documents outside the held-out fold."""
    spark = bounded_batches(docs.sparkSession)
    own = docs.select("doc_id", "text")
    chunks = chunk_table(own, chunk_bytes)
    vocabulary = materialise(word_counts(chunks), "words")
    seen = vocabulary.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.col("n") == 1, 1))).first()
    in_train = (fold("doc_id", FOLDS) != HELD_OUT).cast("long")
    n_train, size = (x or 0 for x in own.agg(F.sum(in_train), F.sum(F.octet_length("text"))).first())
    plan = Plan((seen[0] or 0) + n_train, seen[1] + (1 if n_train else 0), seen[2] or 0, n_train, -(-size // part_bytes) or 1)
    model = spark.sparkContext.broadcast(train_spelling(vocabulary))
    # as counts sum to the number of tokens, at most FREQUENT words reach this share of it, and at most as many
    # words as there are parts more than a part's share
    often = vocabulary.where(F.col("n") * FREQUENT >= plan.tokens)
    frequent = spark.sparkContext.broadcast({bytes(r["word"]): r["n"] for r in often.toLocalIterator()})
    split = {bytes(r["word"]): r["n"] for r in vocabulary.where(F.col("n") * plan.parts > plan.tokens).collect()}
    if n_train * plan.parts > plan.tokens:
        split[b""] = n_train  # the start of a text
    kinds_after = followers(chunks, split) if split else {}
    kind = own.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def work(texts: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = Chunk(*[texts.column(c)[0].as_py() for c in ("docs", "words", "tokens")])
        return scored(chunk, replies, plan, frequent.value, split, kinds_after, worker_scorer(model))

    replied = answers(asks(chunks, plan, frequent, split), plan)
    rows = chunks.groupBy("chunk").cogroup(replied.groupBy("chunk")).applyInArrow(work, result)
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(plan.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
