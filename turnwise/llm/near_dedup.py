"""Near-duplicates by BagMinHash signatures, banding, and a check of the multiset overlap.

A text is the multiset of its five-word shingles (all its words if it has fewer). BagMinHash draws,
for every shingle, Poisson points over its weight: the weight axis is cut into dyadic cells
(0,1], (1,2], (2,4], (4,8], ..., each an independent process whose rate is the cell's width. A point
has a time, a register, and a unit inside its cell found by halving; it counts for a text if the
unit lies within the shingle's count. The first point of each register is the signature, so two
texts agree in a register with the probability of their weighted Jaccard similarity, and a count of
w costs only the few cells up to w. Points are drawn up to a time that fills all registers.

Equal texts collapse to one node first. Nodes that agree in a band share a bucket. All members of a
bucket are compared with its head, the member that meets the most others. Where a bucket then still
holds several components, its members outside the head's component look for texts of other
components among those that share one of their rarest shingles: two texts with so large an overlap
must share one (prefix filter). So no two near texts of a bucket stay in different classes, and a
group of near copies costs one comparison each. Links merge to classes by alternating star rounds.

Texts without words are near only to equal texts; null texts form a class each. Repeated rows and
equal texts share a class. A class is named by its root, the smallest node in it, whatever its ids:
different texts under one doc_id, or under none, keep apart unless they are near. The class id is the
smallest doc_id of the class, missing if all its rows lack one, so unrelated classes may have the same;
``class_root`` tells them apart. Empty tables give empty results; extra columns pass through
``one_per_class`` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import LOWER, bounded_batches, materialise

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 6
#: Slack for rounding in comparisons of distances.
EPS = 1e-9
#: Cells that count how common elements are; they steer an order, not a result.
CELLS = 1 << 20

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def _salt(k: int) -> np.uint64:
    return _U(k * int(_GOLD) & (1 << 64) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_BASE = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of them."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        bases = _BASE, pow(_BASE, -1, 1 << 64)
        _POWERS = tuple(np.cumprod(np.r_[_U(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in bases)
    return _POWERS


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word, A-Z lower-cased, by differences of a running polynomial."""
    raw = np.frombuffer(text.translate(LOWER), np.uint8)
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(raw) + 1)
    running = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:len(raw)], out=running[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((running[ends] - running[starts]) * inverse[starts] + lengths * _GOLD)


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and how often each occurs."""
    words = word_hashes(text)
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(SHINGLE, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out + words[i:len(words) - k + 1 + i] + _salt(i + 1))
    return np.unique(out, return_counts=True)


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two texts' shingle multisets."""
    (x, n), (y, m) = shingles(a), shingles(b)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    either = int(n.sum() + m.sum()) - common
    return common / either if either else 0.0


def signature(elements: np.ndarray, counts: np.ndarray, registers: int) -> np.ndarray:
    """First time of each register as 64-bit numbers; equal numbers mean the same point."""
    total = int(counts.sum())
    cells = [(elements, counts, 1, 0)]
    width, k = 1, 1
    while width < counts.max():
        reach = counts > width
        cells.append((elements[reach], counts[reach], width, k))
        width, k = 2 * width, k + 1
    seed = np.concatenate([mix(e + _salt(k + 1)) for e, _, _, k in cells])
    count = np.concatenate([c for _, c, _, _ in cells])
    rate = np.concatenate([np.full(len(e), w, np.int64) for e, _, w, _ in cells])
    low = np.concatenate([np.full(len(e), w if k else 0, np.int64) for e, _, w, k in cells])
    limit = (np.log(registers) + 4) / total
    while True:
        first = np.full(registers, np.inf)
        alive = np.arange(len(seed))
        time = np.zeros(len(seed))
        drawn = 0
        while len(alive):
            block = max(1, min(512, 4000 // len(alive)))
            step = np.arange(drawn + 1, drawn + block + 1, dtype=np.uint64) * _GOLD
            x = mix(seed[alive, None] + step)
            gap = -np.log1p(-(x >> _U(11)).astype(np.float64) * 2.0**-53) / (rate[alive, None] * registers)
            gap[:, 0] += time
            at = np.cumsum(gap, axis=1)
            y = mix(x ^ _GOLD)
            unit = low[alive, None] + 1 + ((y >> _U(32)).astype(np.int64) & (rate[alive, None] - 1))
            keep = (at <= limit) & (unit <= count[alive, None])
            np.minimum.at(first, ((y & _U(0xFFFFFFFF)) % _U(registers))[keep].astype(np.int64), at[keep])
            time = at[:, -1]
            going = time <= limit
            alive, time, drawn = alive[going], time[going], drawn + block
        if np.isfinite(first).all():
            return first.view(np.uint64)
        limit *= 2


def bands_of(text: bytes, bands: int = BANDS, rows: int = ROWS) -> tuple[list[int], int]:
    """Bucket keys of the bands, and the number of shingles; no keys for a text without words."""
    elements, counts = shingles(text)
    if not len(elements):
        return [], 0
    parts = signature(elements, counts, bands * rows).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
    for r in range(rows):
        key = mix(key + parts[:, r])
    return key.view(np.int64).tolist(), int(counts.sum())


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, node (digest of the text), bucket keys and weight of every row with a text."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column(2).cast(pa.binary()).to_pylist()]
            made = [bands_of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b for b, _ in made], pa.list_(pa.int64())),
                 pa.array([w for _, w in made], pa.int64())],
                ["doc_id", "node", "bands", "weight"],
            )

    rows = docs.where(F.col("text").isNotNull()).select("doc_id", node(), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, node binary, bands array<bigint>, weight bigint")


def node():
    return F.unhex(F.md5(F.col("text").cast("binary"))).alias("node")


def compared(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """a, b and the distance of their texts; both joins are sort-merge joins that can split a hot node."""
    one = sources.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = sources.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches):
        for batch in batches:
            texts = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            far = [1.0 - overlap(x, y) for x, y in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.float64())],
                                             ["a", "b", "far"])

    both = pairs.join(two, "b").join(one, "a")
    return both.select("a", "b", F.col("text_a").cast("binary"), F.col("text_b").cast("binary")).mapInArrow(
        run, "a binary, b binary, far double"
    )


def prefixes(nodes: DataFrame, sources: DataFrame, threshold: float) -> DataFrame:
    """The rarest elements of each node's text that a near text must share one of, with their places.

    A shingle's k-th occurrence is an element of its own, so the multiset overlap is a set overlap. All
    texts sort their elements alike: by how often they occur, then by hash. Occurrences are counted in a
    table of fixed size, which bounds what is sent; elements that share a cell only sort less sharply.
    """
    spark = sources.sparkSession
    texts = materialise(nodes.join(sources, "node"), "prefix-texts")

    def tally(batches):
        seen = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(seen, elements(text) % _U(CELLS), 1)
        cell = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(seen[cell])], ["cell", "n"])

    counted = texts.select(F.col("text").cast("binary")).mapInArrow(tally, "cell long, n long")
    common = np.zeros(CELLS, np.uint32)
    for r in counted.groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        common[r["cell"]] = min(r["n"], (1 << 32) - 1)
    sent = spark.sparkContext.broadcast(common)

    def run(batches):
        order = sent.value
        for batch in batches:
            keys, owners, places, sizes = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                own = elements(text)
                own = own[np.lexsort((own, order[own % _U(CELLS)]))]
                cut = len(own) - int(np.ceil(threshold * len(own) - EPS)) + 1
                keys.append(own[:cut].view(np.int64))
                owners.append(np.full(min(cut, len(own)), k))
                places.append(np.arange(1, len(own[:cut]) + 1))
                sizes.append(np.full(min(cut, len(own)), len(own)))
            at = pa.array(np.concatenate(owners) if owners else np.empty(0, np.int64), pa.int64())
            cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [cat(keys), cat(places), cat(sizes), *[batch.column(c).take(at) for c in ("node", "root", "odd")]],
                ["element", "place", "size", "node", "root", "odd"],
            )

    return texts.select("node", "root", "odd", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "element long, place long, size long, node binary, root binary, odd boolean"
    )


def elements(text: bytes) -> np.ndarray:
    """A hash for every shingle occurrence; the k-th occurrences of a shingle in two texts are equal."""
    own, counts = shingles(text)
    first = np.repeat(own, counts)
    nth = np.arange(len(first)) - np.repeat(counts.cumsum() - counts, counts)
    return mix(first + nth.astype(np.uint64) * _GOLD)


def near(pairs: DataFrame, sources: DataFrame, threshold: float) -> DataFrame:
    return compared(pairs, sources).where(F.col("far") <= 1.0 - threshold + EPS).select("a", "b")


def links(docs: DataFrame, marks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of nodes at least ``threshold`` alike, enough to connect every class."""
    nodes = marks.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("weight").alias("weight")
    )
    spread = nodes.select("node", "doc_id", "weight", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(spread.join(shared, "bucket"), "members")
    # the head of a bucket is its member that meets the most others over all buckets
    central = members.groupBy("node").agg(F.sum("n").alias("met"))
    heads = members.join(central, "node").groupBy("bucket").agg(F.max(F.struct("met", "node", "weight")).alias("head"))
    placed = members.join(heads, "bucket").select("bucket", "node", "weight", F.col("head.node").alias("head"),
                                                  F.col("head.weight").alias("head_weight"))
    placed = materialise(placed, "placed")
    fits = F.least("weight", "head_weight") >= threshold * F.greatest("weight", "head_weight") - EPS
    to_head = placed.where(fits & (F.col("node") != F.col("head"))).select(
        F.col("head").alias("a"), F.col("node").alias("b")
    ).distinct()
    wanted = members.select("node", "doc_id").distinct()
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", node(), "text")
    # with the id in the key, copies of a hot text don't meet in one task
    own = wanted.select(F.col("node").alias("_node"), F.col("doc_id").alias("_id"))
    same = texts.join(own, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sources = materialise(same.dropDuplicates(["node"]).select("node", "text"), "texts")
    first = materialise(near(to_head, sources, threshold), "near")

    # buckets that still hold several components: their members outside the head's component are odd
    roots = materialise(wanted.select("node").join(components(first), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")), "roots")
    rooted = placed.join(roots, "node").join(
        roots.select(F.col("node").alias("head"), F.col("root").alias("head_root")), "head"
    ).select("bucket", "node", "root", (F.col("root") != F.col("head_root")).alias("odd"))
    rooted = materialise(rooted, "rooted")
    unsettled = rooted.groupBy("bucket").agg(F.max("odd").alias("any")).where("any").select("bucket")
    open_ = rooted.join(unsettled, "bucket").groupBy("node").agg(F.max("root").alias("root"), F.max("odd").alias("odd"))
    marked = materialise(prefixes(open_, sources, threshold), "prefixes")
    one = marked.where("odd")
    two = marked.select(*[F.col(c).alias(f"{c}_2") for c in ("element", "place", "size", "node", "root")])
    least = F.ceil(threshold / (1 + threshold) * (F.col("size") + F.col("size_2")) - EPS)  # common elements of a near pair
    rest = one.join(two, F.col("element") == F.col("element_2")).where(
        (F.col("root") != F.col("root_2"))
        & (F.least("size", "size_2") >= threshold * F.greatest("size", "size_2") - EPS)
        & (F.col("place") <= F.col("size") - least + 1) & (F.col("place_2") <= F.col("size_2") - least + 1)
    ).select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")).distinct()
    return first.unionByName(near(rest, sources, threshold))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component), by alternating large and small stars."""
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(edges.where("a <> b").distinct(), "edges")
    before = None
    while True:
        pairs = both(edges)
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = pairs.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = materialise(small, "edges")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, its smallest doc_id, the root that names its class, and the class id, for every distinct text."""
    marks = materialise(signed(docs), "signed")
    roots = components(links(docs, marks, threshold))
    ids = marks.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    rooted = ids.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    best = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return materialise(rooted.join(best, "root").select("node", "doc_id", "root", "class_id"), "classes")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and class_root of every row; a row with null text has no root and is a class of its own."""
    own = docs.select("doc_id", "text")
    found = classes(own, threshold).select("node", "class_id", F.lower(F.hex("root")).alias("class_root"))
    rows = own.select("doc_id", F.when(F.col("text").isNotNull(), F.unhex(F.md5(F.col("text").cast("binary")))).alias("node"))
    return rows.join(found, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "class_root"
    )


def one_per_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that stay: of every class the row with the smallest doc_id, and all rows with null text.

    Of several rows with that doc_id and text one stays; of a class without any doc_id, a row of its smallest node.
    """
    own = docs.select("doc_id", "text")
    found = classes(own, threshold)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(
        F.min(F.struct("node", "doc_id")).alias("kept")
    )
    keep = keep.select(F.col("kept.doc_id").alias("_keep"), F.col("kept.node").alias("_node"))
    marked = docs.withColumn("_own", F.unhex(F.md5(F.col("text").cast("binary"))))
    kept = marked.join(keep, F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("_own") == F.col("_node")), "left_semi")
    first = kept.dropDuplicates(["doc_id", "_own"])
    return first.unionByName(marked.where(F.col("text").isNull())).select(*docs.columns)
