"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is the vector of its byte trigrams (lower-cased, everything but letters made a space), hashed
to a fixed number of dimensions, log-scaled, weighed by inverse document frequency and normalised.
Per language, spherical k-means over a bounded sample of labelled documents gives a few centroids. A
text takes the language of the centroid with the highest cosine; where that lies beyond the distance
that all but a hundredth of the centroid's own sample keep, ``rejected`` is true as well.

Null texts and texts without letters are ``und`` with score 0; so is every text where no language
can be learned. Very long texts cost in proportion to their length. Ties go to the first language in
order of name. Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import bounded_batches, fold, texts_of, with_found

FOLDS, HELD_OUT = 3, 1
DIMENSIONS = 4096
CENTROIDS = 3
#: Different labelled texts per language that centroids are fitted on, about; the hash threshold is set for it.
SAMPLE_PER_LANGUAGE = 400
UNKNOWN = "und"
_KEEP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_STEPS = 1 << 30


def counts(text: str) -> np.ndarray | None:
    """Hashed trigram counts; None for a text without letters."""
    if not any(map(str.isalpha, text)):
        return None
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_KEEP) + b" ", np.uint8)
    wide = raw.astype(np.uint32)
    code = wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]
    place = code * np.uint32(2654435761) >> np.uint32(20)
    blank = (raw[:-2] == 32) & (raw[1:-1] == 32) | (raw[1:-1] == 32) & (raw[2:] == 32)
    return np.bincount(place[~blank], minlength=DIMENSIONS)


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors of count rows."""
    x = np.log1p(rows) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine and rejection of every count row."""
        cosine = weighted(rows, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        top = cosine[np.arange(len(rows)), best]
        return self.owner[best], np.clip(top, 0.0, 1.0), top < self.least[best]


def clustered(x: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centroids and each row's centroid; starts from rows far from each other."""
    start = [0]
    far = np.full(len(x), np.inf)
    for _ in range(min(k, len(x)) - 1):
        far = np.minimum(far, 1 - x @ x[start[-1]])
        start.append(int(far.argmax()))
    centre = x[start].copy()
    own = np.zeros(len(x), int)
    for _ in range(rounds):
        own = (x @ centre.T).argmax(axis=1)
        for c in range(len(centre)):
            if (own == c).any():
                total = x[own == c].sum(axis=0)
                centre[c] = total / max(np.linalg.norm(total), 1e-12)
    return centre, (x @ centre.T).argmax(axis=1)


def fit(rows: np.ndarray, languages: list[str], k: int = CENTROIDS) -> Model:
    names = sorted(set(languages))
    idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1
    x = weighted(rows, idf)
    label = np.array([names.index(name) for name in languages])
    centroids, owner, least = [], [], []
    for number in range(len(names)):
        own = x[label == number]
        centre, place = clustered(own, k)
        for c, vector in enumerate(centre):
            near = own[place == c] @ vector
            centroids.append(vector)
            owner.append(number)
            least.append(float(np.quantile(near, 0.01)) if len(near) else 0.0)
    return Model(names, idf, np.array(centroids), np.array(owner), np.array(least))


def train(docs: DataFrame, training: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Centroids from a hash sample of the different training texts of each language; None without any.

    Copies of a text count once, so that no number of them makes the sample larger.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & training)
    kinds = F.approx_count_distinct(F.xxhash64("text")).alias("kinds")
    sizes = {r["lang"]: r["kinds"] for r in own.groupBy("lang").agg(kinds).collect()}
    if not sizes:
        return None
    cuts = docs.sparkSession.createDataFrame(
        [(name, int(_STEPS * min(1.0, per_language / n))) for name, n in sizes.items()], "lang string, cut long"
    )
    place = F.pmod(F.xxhash64(F.col("text"), F.lit("language")), F.lit(_STEPS))
    sample = own.select("lang", "text", place.alias("place")).join(F.broadcast(cuts), "lang").where("place < cut")
    sample = sample.dropDuplicates(["lang", "text"])
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            made = [(name, c) for name, t in zip(*map(pa.Array.to_pylist, batch.columns), strict=True)
                    if (c := counts(t)) is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in made], pa.string()),
                 pa.array([c.astype("<f4").tobytes() for _, c in made], pa.binary())], ["lang", "counts"])

    got = sorted(tuple(r) for r in sample.select("lang", "text").mapInArrow(run, "lang string, counts binary").collect())
    if not got:
        return None
    return fit(np.array([np.frombuffer(c, "<f4") for _, c in got], float), [name for name, _ in got])


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """``row`` and ``found`` (lang, score, rejected)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value

        def work(rows: pa.StructArray) -> pa.Array:
            made = [counts(t.decode("utf-8", "replace")) for t in texts_of(rows)]
            known = [i for i, c in enumerate(made) if c is not None and own is not None]
            out = [{"lang": UNKNOWN, "score": 0.0, "rejected": True} for _ in made]
            if known:
                found = own.predict(np.array([made[i] for i in known], float))
                for i, number, score, rejected in zip(known, *map(np.ndarray.tolist, found), strict=True):
                    out[i] = {"lang": own.languages[number], "score": score, "rejected": rejected}
            return pa.array(out, pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))

        return work

    return with_found(docs, make, "struct<lang: string, score: double, rejected: boolean>")


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    model = train(docs, fold("doc_id", FOLDS) != HELD_OUT)
    out = identified(docs.select("doc_id", "text"), model)
    return out.select(
        F.col("row.doc_id").alias("doc_id"), (fold("row.doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"),
        F.col("found.rejected").alias("rejected"),
    )
