"""Ring functions name their input once, and rings are simplified batch by batch as plain loops would."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.functions import rings as R
from annulus.functions import simplify as S


@pytest.mark.parametrize("function", [R.ring_from_flat, R.close_ring, R.edges, R.rotated, R.orient_ring, R.resort_corners, R.ring_perimeter])
def test_input_is_evaluated_once(spark, function):
    assert str(function(F.col("own_input"))).count("own_input") == 1


def test_flat_rings_read_as_before(spark):
    flats = [[0.0, 0, 4, 0, 4, 4], [0.0, 0, 4, 0, 4, 4, 0, 0], [0.0, 0, 4, 0], [0.0, 0, 4, 0, 4], [0.0, 0, 4, 0, 0, 0], None]
    got = [x.r for x in spark.createDataFrame([(i, f and [float(v) for v in f]) for i, f in enumerate(flats)], "i int, f array<double>").select("i", R.ring_from_flat(F.col("f")).alias("r")).orderBy("i").collect()]
    assert [None if r is None else len(r) for r in got] == [3, 3, None, None, None, None]


def _chords(points: np.ndarray, tol: float) -> np.ndarray:
    if len(points) < 4:
        return points
    closed, keep, waiting = np.vstack([points, points[:1]]), {0, len(points)}, [(0, len(points))]
    while waiting:
        i, j = waiting.pop()
        far = []
        for k in range(i + 1, j):
            chord, own = closed[j] - closed[i], closed[k] - closed[i]
            t = min(max((own * chord).sum() / max((chord * chord).sum(), 1e-300), 0), 1)
            far.append(math.hypot(*(own - t * chord)))
        if far and max(far) > tol:
            at = i + 1 + far.index(max(far))
            keep.add(at)
            waiting += [(i, at), (at, j)]
    kept = points[sorted(keep - {len(points)})]
    return kept if len(kept) >= 3 else points


def _straightened(points: np.ndarray, degrees: float, passes: int) -> np.ndarray:
    for _ in range(passes):
        if len(points) <= 3:
            break
        n, stay = len(points), []
        for i in range(n):
            u, v = points[i] - points[i - 1], points[(i + 1) % n] - points[i]
            a, b = math.hypot(*u), math.hypot(*v)
            stay.append(a > 1e-9 and b > 1e-9 and max(-1, min(1, (u * v).sum() / (a * b))) < math.cos(math.radians(degrees)))
        if all(stay):
            break
        points = points[stay]
    return points


def test_rings_of_a_batch_as_one_by_one():
    rng = np.random.default_rng(5)
    rings = [np.zeros((0, 2)), np.zeros((1, 2)), np.zeros((6, 2)), *(np.round(rng.random((n, 2)) * 6, k) for n in (2, 3, 4, 5, 9, 30) for k in (0, 1, 3) for _ in range(20))]
    points, sizes = np.concatenate(rings), np.array([len(r) for r in rings])
    cuts = np.cumsum(sizes)[:-1]
    for tol in (0.0, 0.4, 2.0, 50.0):
        for own, stay, ring in zip(np.split(points, cuts), np.split(S.chords(points, sizes, tol), cuts), rings, strict=True):
            assert own[stay].tolist() == _chords(ring, tol).tolist()
    for degrees, passes in ((2.0, 10), (40.0, 1), (40.0, 10)):
        for own, stay, ring in zip(np.split(points, cuts), np.split(S.straightened(points, sizes, degrees, passes), cuts), rings, strict=True):
            assert own[stay].tolist() == _straightened(ring, degrees, passes).tolist()


def test_single_polis_against_loops(spark):
    rng = np.random.default_rng(3)
    rings = [[tuple(p) for p in rng.random((n, 2)).tolist()] for n in (3, 4, 7, 1)]
    pairs = [(i, a, b) for i, (a, b) in enumerate([(a, b) for a in rings for b in rings] + [([], rings[0]), (rings[0], None)])]

    def away(p, a, b):
        d = (b[0] - a[0], b[1] - a[1])
        square = d[0] ** 2 + d[1] ** 2
        t = min(max(((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / square, 0), 1) if square else 0
        return math.hypot(p[0] - a[0] - t * d[0], p[1] - a[1] - t * d[1])

    one = lambda p, q: sum(min(away(v, q[k], q[(k + 1) % len(q)]) for k in range(len(q))) for v in p) / (2 * (len(p) + 1))
    kind = "array<struct<x:double,y:double>>"
    got = spark.createDataFrame(pairs, f"i int, a {kind}, b {kind}").select("i", R.polis_single(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()
    for (_, a, b), row in zip(pairs[:16], got, strict=False):
        assert row.d == pytest.approx(one(a, b) + one(b, a), abs=1e-12)
    assert got[16].d is None and got[17].d is None
