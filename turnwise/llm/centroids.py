"""Centroid clustering in integers, with ns-bounds that spare distances and lose no exactness.

Vectors become integers ``floor(1024 * x)``; assignments, sums and distances are exact. A vector keeps an
upper bound of its distance to its own centroid and a lower bound to each other, each with the round in
which it was last evaluated. The centroids of all rounds are retained, so a bound of round T is
loosened in round t by the norm of the centroid's total displacement from T to t (its positions then and
now are subtracted), not by the sum of what it moved in each round between. Only where a loosened lower
bound does not stay above the upper bound are distances evaluated, exactly, and ties go to the smaller
number. Bounds are rounded outwards by far more than the error of doubles.

A round is one pass: tasks read vectors and bounds of the round before, assign, and write them anew
together with what each cluster's sum and count changed by, one row per task and cluster. Spark adds
those up; ``k`` rows of sums reach the driver. The generation before the last is deleted as soon as the
next is whole, so lost executors cost a round's tasks and the disk holds two generations.

Kept are vectors with as many components as asked for, none missing or non-finite. A missing id is hashed
as empty text in the choice of first centroids; ties there go by components. Repeated rows are vectors
each. With fewer than ``k`` vectors each starts a centroid; equal centroids leave the one with the larger
number empty, and empty ones stay where they are. An empty table gives an empty result. Extra columns
take no part. Integers beyond 2**27 in size, whose distances a long might not hold, raise an error.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import bounded_batches, materialise
from turnwise.session import scratch_folder

SCALE, LARGEST = 1024, 1 << 27
COMPONENTS, CENTROIDS, ROUNDS, SEED = 64, 8, 10, 3
#: Outward rounding of bounds, relative; doubles are off by less than a thousandth of it.
SLACK = 1e-12

STATE = "vec_id {id}, vector binary, cluster int, upper double, upper_round int, lower binary, lower_round binary, " \
        "delta_of int, delta_rows long, delta array<long>"


def integers(values: np.ndarray) -> np.ndarray:
    out = np.floor(values.astype(np.float64) * SCALE)
    if out.size and np.abs(out).max() > LARGEST:
        raise ValueError(f"a component is larger than {LARGEST // SCALE} in size")
    return out.astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def norms(gap: np.ndarray) -> np.ndarray:
    """Norms of the last axis, rounded up."""
    return np.sqrt((gap.astype(np.float64) ** 2).sum(axis=-1)) * (1 + SLACK)


@dataclass
class Bounds:
    """What a batch of vectors knows: own centroid and bounds, each with its round."""

    cluster: np.ndarray
    upper: np.ndarray
    upper_round: np.ndarray
    lower: np.ndarray
    lower_round: np.ndarray

    @classmethod
    def none(cls, rows: int, k: int) -> Bounds:
        """Nothing known: upper bounds without end, lower ones of zero, so the first round evaluates all."""
        return cls(np.zeros(rows, np.int64), np.full(rows, np.inf), np.zeros(rows, np.int64),
                   np.zeros((rows, k)), np.zeros((rows, k), np.int64))


def assign(vectors: np.ndarray, history: np.ndarray, known: Bounds) -> tuple[Bounds, int]:
    """Bounds after the round of the last centroids in ``history`` (rounds x k x components), and how many
    distances were evaluated. The result's cluster is the nearest centroid, by exact distances and smaller number."""
    now = len(history) - 1
    here = history[now]
    k = len(here)
    drift = norms(here - history)  # rounds x k: each centroid's displacement since each round
    rows = np.arange(len(vectors))
    cluster, upper, upper_round = known.cluster.copy(), known.upper.copy(), known.upper_round.copy()
    lower, lower_round = known.lower.copy(), known.lower_round.copy()
    high = upper + drift[upper_round, cluster]
    low = lower - drift[lower_round, np.arange(k)]
    low[rows, cluster] = np.inf
    failed = np.flatnonzero((low <= high[:, None]).any(axis=1))
    own = squared(vectors[failed], here[cluster[failed]])
    evaluated = len(failed)
    # tighten the upper bound first; what then still overlaps is evaluated
    high[failed] = np.sqrt(own) * (1 + SLACK)
    upper[failed], upper_round[failed] = high[failed], now
    best, winner = own.copy(), cluster[failed].copy()
    tight = np.sqrt(own) * (1 - SLACK)
    lower[failed, cluster[failed]], lower_round[failed, cluster[failed]] = tight, now
    for j in range(k):
        ask = np.flatnonzero((low[failed, j] <= high[failed]) & (cluster[failed] != j))
        if not len(ask):
            continue
        at = failed[ask]
        far = squared(vectors[at], here[j])
        evaluated += len(ask)
        lower[at, j], lower_round[at, j] = np.sqrt(far) * (1 - SLACK), now
        nearer = (far < best[ask]) | ((far == best[ask]) & (j < winner[ask]))
        best[ask[nearer]], winner[ask[nearer]] = far[nearer], j
    changed = winner != cluster[failed]
    at = failed[changed]
    cluster[at], upper[at] = winner[changed], np.sqrt(best[changed]) * (1 + SLACK)
    return Bounds(cluster, upper, upper_round, lower, lower_round), evaluated


def next_centroids(last: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Floors of the means; empty clusters keep their centroid."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], last)


def usable(column: str, components: int) -> Column:
    finite = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(column) == components) & finite, F.lit(False))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids; at most ``k`` rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "embedding").orderBy("key", "embedding").limit(k).collect()
    return integers(np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1 if rows else 0))


@dataclass
class Clusters:
    """Result of a run: the frame of assignments, and the last centroids."""

    rows: DataFrame
    centroids: np.ndarray


def cluster(
    embeddings: DataFrame, components: int = COMPONENTS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED
) -> Clusters:
    """``vec_id``, ``cluster`` and squared ``distance`` of every usable vector after the given rounds."""
    spark = bounded_batches(embeddings.sparkSession)
    vectors = embeddings.select("vec_id", "embedding").where(usable("embedding", components))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    history = first_centroids(vectors, k, seed)[None]
    if not history.size:
        return Clusters(spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), history[0])
    generation = vectors
    sums, counts = np.zeros(history.shape[1:], np.int64), np.zeros(history.shape[1], np.int64)
    folder = f"{scratch_folder(spark)}/centroids-{uuid.uuid4().hex}"
    for number in range(rounds):
        written = f"{folder}/{number}"
        stepped(generation, history, number == 0, kind).write.parquet(written)
        everything = spark.read.schema(STATE.format(id=kind)).parquet(written)
        for row in changes(everything):
            sums[row["delta_of"], row["place"]] += row["value"]
            if not row["place"]:
                counts[row["delta_of"]] += row["n"]
        history = np.concatenate([history, next_centroids(history[-1], sums, counts)[None]])
        generation = everything.where(F.col("vector").isNotNull())
        if number:
            deleted(spark, f"{folder}/{number - 1}")
    _path(spark, folder)[0].deleteOnExit(_path(spark, folder)[1])
    return Clusters(measured(generation, history, rounds == 0, kind), history[-1])


def _vectors(batch: pa.RecordBatch, first: bool) -> np.ndarray:
    if first:
        values = batch.column("embedding")
        return integers(values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1))
    return _packed(batch.column("vector"), "<i4").astype(np.int64)


def _packed(column: pa.Array, kind: str) -> np.ndarray:
    """A binary column of equally long values as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _known(batch: pa.RecordBatch, first: bool, k: int) -> Bounds:
    if first:
        return Bounds.none(batch.num_rows, k)
    number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    return Bounds(number("cluster").astype(np.int64), number("upper"), number("upper_round").astype(np.int64),
                  _packed(batch.column("lower"), "<f8").copy(), _packed(batch.column("lower_round"), "<i4").astype(np.int64))


def _binary(rows: np.ndarray, kind: str) -> pa.Array:
    """Rows of numbers as a binary column."""
    data = np.ascontiguousarray(rows, kind)
    places = np.arange(len(data) + 1, dtype=np.int32) * np.int32(data.itemsize * data.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(places), pa.py_buffer(data)])


def stepped(generation: DataFrame, history: np.ndarray, first: bool, kind: str) -> DataFrame:
    """Vectors with the bounds after a round, and rows that say by what each cluster's sum and count change."""
    k, components = history.shape[1:]
    schema = STATE.format(id=kind)

    def run(batches):
        names, id_type = None, None
        sums, rows = np.zeros((k, components), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, known = _vectors(batch, first), _known(batch, first, k)
            found, _ = assign(vectors, history, known)
            moved = np.flatnonzero(first | (known.cluster != found.cluster))
            np.add.at(sums, found.cluster[moved], vectors[moved])
            rows += np.bincount(found.cluster[moved], minlength=k)
            if not first:
                np.subtract.at(sums, known.cluster[moved], vectors[moved])
                rows -= np.bincount(known.cluster[moved], minlength=k)
            id_type, n = batch.column("vec_id").type, len(vectors)
            columns = {
                "vec_id": batch.column("vec_id"), "vector": _binary(vectors, "<i4"),
                "cluster": pa.array(found.cluster, pa.int32()), "upper": pa.array(found.upper),
                "upper_round": pa.array(found.upper_round, pa.int32()), "lower": _binary(found.lower, "<f8"),
                "lower_round": _binary(found.lower_round, "<i4"), "delta_of": pa.nulls(n, pa.int32()),
                "delta_rows": pa.nulls(n, pa.int64()), "delta": pa.nulls(n, pa.list_(pa.int64())),
            }
            names = list(columns)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)
        if names:
            kinds = [id_type, pa.binary(), pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([
                *[pa.nulls(k, t) for t in kinds], pa.array(range(k), pa.int32()), pa.array(rows),
                pa.array(sums.tolist(), pa.list_(pa.int64())),
            ], names)

    return generation.mapInArrow(run, schema)


def changes(everything: DataFrame) -> list:
    """What each cluster's sum and count change by in a round, added up in Spark; k rows for each component."""
    deltas = everything.where(F.col("delta_of").isNotNull())
    return deltas.select("delta_of", "delta_rows", F.posexplode("delta").alias("place", "value")).groupBy(
        "delta_of", "place"
    ).agg(F.sum("value").alias("value"), F.sum("delta_rows").alias("n")).collect()


def measured(generation: DataFrame, history: np.ndarray, first: bool, kind: str) -> DataFrame:
    """The last assignment, with the exact distance to the centroid."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                vectors = _vectors(batch, first)
                found, _ = assign(vectors, history, _known(batch, first, history.shape[1]))
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id"), pa.array(found.cluster, pa.int32()),
                    pa.array(squared(vectors, history[-1][found.cluster])),
                ], ["vec_id", "cluster", "distance"])

    return generation.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def _path(spark, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def deleted(spark, name: str) -> None:
    """Deletes a generation of this run that nothing reads any more."""
    system, path = _path(spark, name)
    system.delete(path, True)


def centroid_sha256(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustering(embeddings: DataFrame, **options: int) -> DataFrame:
    """One row per vector, with its cluster's and the whole inertia and the hash of its centroid."""
    found = cluster(embeddings, **options)
    found.rows = materialise(found.rows, "clustered")
    # one number per cluster reaches the driver
    inertia = {r["cluster"]: r["n"] for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    rows = [(j, n, sum(inertia.values()), centroid_sha256(found.centroids[j])) for j, n in inertia.items()]
    facts = embeddings.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return found.rows.join(F.broadcast(facts), "cluster").select(  # a row per centroid
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
