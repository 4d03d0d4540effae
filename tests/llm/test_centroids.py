"""Centroid clustering against plain exact rounds."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnwise.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, cluster int, upper double, lower string, label int"


def plain(rows, k, rounds, seed):
    """(id, cluster, distance) of every row by full evaluation in Python integers, and the centroids."""
    points = [[math.floor(1024 * float(np.float32(x))) for x in v] for _, v in rows]
    key = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i, _ in rows]
    order = sorted(range(len(rows)), key=lambda r: (key[r], rows[r][1]))
    centres = [points[r] for r in order[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        near = [nearest(p)[1] for p in points]
        groups = [[p for p, j in zip(points, near, strict=True) if j == c] for c in range(len(centres))]
        centres = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centres, strict=True)]
    return [(i, j, d) for (i, _), (d, j) in zip(rows, map(nearest, points), strict=True)], centres


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, 0.5, "x", 1) for i, v in rows], SCHEMA)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-6, 6)] * 3), min_size=4, max_size=40), st.integers(0, 99))
def test_bounds_lose_no_nearest_centroid(points, seed):
    """Small whole numbers give many ties; the centroids drift by whims of their own."""
    r = np.random.default_rng(seed)
    vectors = np.array(points, np.int64)
    history = vectors[:4][None]
    known = C.Bounds.none(len(vectors), 4)
    for _ in range(8):
        known, _ = C.assign(vectors, history, known)
        far = ((vectors[:, None] - history[-1][None]) ** 2).sum(axis=2)
        assert known.cluster.tolist() == far.argmin(axis=1).tolist()
        history = np.concatenate([history, (history[-1] + r.integers(-2, 3, history[-1].shape))[None]])


def test_bounds_use_total_displacement_and_spare_distances():
    r = np.random.default_rng(1)
    vectors = (r.normal(size=(2000, 16)) * 20 + r.integers(0, 4, 2000)[:, None] * 2000).astype(np.int64)
    start = np.array([[0] * 16, [2000] * 16, [4000] * 16, [6000] * 16])
    known, first = C.assign(vectors, start[None], C.Bounds.none(2000, 4))
    assert first == 4 * 2000
    # there and back: the total displacement is nothing, so nothing is evaluated although much was moved
    history = np.stack([start, start + 400, start])
    again, asked = C.assign(vectors, history, known)
    assert asked == 0 and (again.upper_round == 0).all()
    moved, asked = C.assign(vectors, np.concatenate([history, (start + 5)[None]]), again)
    assert asked < 2000 and (moved.cluster == known.cluster).all()


def test_next_centroids_floor_and_stay():
    last = np.array([[1, 1], [9, 9]])
    got = C.next_centroids(last, np.array([[-7, 7], [0, 0]]), np.array([2, 0]))
    assert got.tolist() == [[-4, 3], [9, 9]]


def test_clustering_matches_plain_rounds(spark):
    r = np.random.default_rng(5)
    spread = [(i, [float(x) for x in (r.normal(size=4) * 0.3 + i % 3)]) for i in range(60)]
    rows = spread + [(100, [0.5] * 4)] * 30 + [(None, [0.25] * 4), (None, [0.125] * 4), (101, [-0.0, 0.0, 1e-9, -1e-9])]
    odd = [(200, None), (201, []), (202, [1.0] * 3), (203, [1.0] * 5), (204, [1.0, None, 1.0, 1.0]),
           (205, [float("nan")] * 4), (206, [1.0, float("-inf"), 1.0, 1.0])]
    data = frame(spark, rows + odd).repartition(3)
    got = C.clustering(data, components=4, k=5, rounds=6, seed=3).collect()
    want, centres = plain(rows, 5, 6, 3)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in got) == sorted(
        (i is None, i or 0, j, d) for i, j, d in want
    )
    for row in got:
        assert row.cluster_inertia == sum(d for _, j, d in want if j == row.cluster)
        assert row.inertia == sum(d for _, _, d in want)
        assert row.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[row.cluster])).encode()).hexdigest()


def test_few_equal_and_no_vectors(spark):
    assert C.clustering(frame(spark, [])).collect() == []
    assert C.clustering(frame(spark, [(1, None)]), components=2).collect() == []
    same = C.clustering(frame(spark, [(1, [1.0, 2.0])] * 20), components=2).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in same] == [(0, 0, 0)] * 20
    two = C.clustering(frame(spark, [(1, [1.0, 2.0]), (2, [5.0, 5.0])]), components=2).collect()
    assert sorted(r.cluster for r in two) == [0, 1]
    none = C.clustering(frame(spark, [(1, [1.0, 2.0]), (2, [5.0, 5.0])]), components=2, rounds=0).collect()
    assert [r.distance for r in none] == [0, 0]


def test_generations_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "scratch_folder", lambda _: str(tmp_path))
    C.cluster(frame(spark, [(i, [float(i), 1.0]) for i in range(9)]), components=2, k=2, rounds=4).rows.collect()
    assert [p.name for p in next(tmp_path.glob("centroids-*")).iterdir()] == ["3"]


def test_too_large_components_are_an_error():
    with pytest.raises(ValueError):
        C.integers(np.array([[2.0**18]]))
