"""The slab sweep on hand-made and random polygons, boundary masks cell by cell, and the totals of ring roles."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus import registry  # noqa: F401 - loads the plans in order
from annulus.operators import sweep
from annulus.plans import fusion

RING = "array<struct<x:double,y:double>>"


def edges(*rings):
    return np.array([(*a, *b) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)], dtype=float).reshape(-1, 4)


SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1)]
BIG, HOLE = [(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (8, 2), (8, 8), (2, 8)]


@pytest.mark.parametrize(
    "a, b, want",
    [
        (edges(SQUARE), edges(SQUARE), (1, 1, 1)),
        (edges(BIG, HOLE), edges(SQUARE), (64, 1, 1)),
        (edges(BIG, HOLE), edges([(3, 3), (5, 3), (5, 5), (3, 5)]), (64, 4, 0)),
        (edges([(0, 0), (4, 0), (0, 3)]), edges([(0, 0), (4, 0), (4, 3)]), (6, 6, 3)),
        (edges([(0, 0), (2, 0), (0, 2), (2, 2)]), edges(SQUARE), (2, 1, 0.5)),  # a bow-tie
        (edges([(0, 0), (1, 0)]), edges(SQUARE), (0, 1, 0)),
        (edges(), edges(), (0, 0, 0)),
    ],
)
def test_swept_areas(a, b, want):
    assert sweep.swept_areas(a, b) == pytest.approx(want, abs=1e-12)
    assert sweep.swept_areas(b, a) == pytest.approx((want[1], want[0], want[2]), abs=1e-12)


def test_sweep_in_blocks_and_against_samples(monkeypatch):
    r = np.random.default_rng(7)
    polygons = []
    for n in (5, 9, 30):
        turn, far = np.sort(r.uniform(0, 2 * np.pi, n)), r.uniform(2, 6, n)
        polygons.append([(float(x), float(y)) for x, y in zip(far * np.cos(turn), far * np.sin(turn) + 1, strict=True)])
    p = r.uniform(-8, 8, (200_000, 2))
    inside = lambda e: (((e[:, 1] > p[:, 1:]) != (e[:, 3] > p[:, 1:])) & (p[:, :1] < (e[:, 2] - e[:, 0]) * (p[:, 1:] - e[:, 1]) / np.where(e[:, 3] == e[:, 1], 1, e[:, 3] - e[:, 1]) + e[:, 0])).sum(1) % 2 == 1
    for a, b in itertools.combinations(map(edges, polygons), 2):
        whole = sweep.swept_areas(a, b)
        assert whole[2] == pytest.approx((inside(a) & inside(b)).mean() * 256, abs=1.0)
        with monkeypatch.context() as m:
            m.setattr(sweep, "CELLS", 50)
            assert sweep.swept_areas(a, b) == pytest.approx(whole, abs=1e-9)


def test_pairs_swept_together_equal_pairs_alone():
    r = np.random.default_rng(11)
    ring = lambda: [tuple(map(float, p)) for p in r.integers(0, 9, (r.integers(3, 9), 2))]
    tables = [edges(ring(), ring()) if r.random() < 0.5 else edges(ring()) for _ in range(400)]
    left, right = tables[:200], tables[200:]
    want = np.array([sweep.swept_areas(a, b) for a, b in zip(left, right, strict=True)])
    got = sweep.swept_batch([a.ravel() for a in left], [b.ravel() for b in right])
    assert np.abs(got - want).max() < 1e-9
    assert np.isnan(sweep.swept_batch([None, left[0].ravel()], [left[0].ravel(), None])).all()


def test_overlap_of_nulls_and_empty_rings(spark):
    rows = spark.createDataFrame([(None, None), ([], []), ([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)], None)], f"e {RING}, h array<{RING}>")
    got = [r.o for r in rows.select(sweep.overlap(F.col("e"), F.col("h"), F.col("e"), F.col("h")).alias("o")).collect()]
    assert [tuple(x) for x in got] == [(None,) * 3, (0.0,) * 3, (2.0,) * 3]


def test_pairs_and_crossings_of_empty_tables(spark):
    gt = spark.createDataFrame([], f"image_id long, ann_id long, exterior {RING}, holes array<{RING}>")
    pred = spark.createDataFrame([], f"image_id long, pred_id long, score double, exterior {RING}, holes array<{RING}>")
    assert sweep.polygon_pairs(gt, pred).count() == 0
    assert sweep.self_crossings(gt.withColumnRenamed("exterior", "ring"), "ann_id").count() == 0


def test_boundary_runs_cell_by_cell(spark):
    r, cells = np.random.default_rng(3), np.zeros((512, 512), bool)
    for _ in range(30):
        x, y = r.integers(0, 500, 2)
        cells[y : y + r.integers(1, 60), x : x + r.integers(1, 60)] = True
    rows = []
    for y in range(512):
        turns = np.flatnonzero(np.diff(np.concatenate([[0], cells[y].astype(int), [0]])))
        rows += [(1, y, int(a), int(b)) for a, b in turns.reshape(-1, 2)]
    mask = spark.createDataFrame(rows, "image_id long, y long, x_start long, x_end long")
    padded = np.pad(cells, 2)
    eroded = np.logical_and.reduce([padded[i : i + 512, j : j + 512] for i in range(5) for j in range(5)])
    got = np.zeros_like(cells)
    for q in fusion.boundary_runs(mask, 2).collect():
        assert not got[q.y, q.x_start : q.x_end].any()
        got[q.y, q.x_start : q.x_end] = True
    assert (got == (cells & ~eroded)).all()


def test_role_metrics_count_every_ring(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = {r.role: r for r in fusion.role_metrics(spark, sf_dir).collect()}
    gt, pred = fusion.gt_boxes(spark, sf_dir), fusion.pred_boxes(spark, sf_dir)
    for role, only in (("exterior", "true"), ("hole", "has_hole")):
        r = got[role]
        assert (r.tp + r.fn, r.tp + r.fp) == (gt.where(only).count(), pred.where(only).count())
        assert r.f1 == pytest.approx(2 * r.tp / (2 * r.tp + r.fp + r.fn)) and 0 < r.tp
