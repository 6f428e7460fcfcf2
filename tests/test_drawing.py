"""What is asked of drawn images: one shuffle of boxes, and the same rows as cell by cell."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import numpy as np
import pytest

from __spark_entry__ import queries
from annulus.operators import label_maps, tracing
from annulus.plans import contours

DRAWN = ["mask_boundary_iou", "heatmap_peaks", "label_segments"]


@pytest.mark.parametrize("name", DRAWN)
def test_boxes_are_shuffled_and_not_their_cells(spark, sf_dir, name):
    text = io.StringIO()
    with redirect_stdout(text):
        queries()[name](spark, sf_dir).explain()
    assert "Generate explode" not in text.getvalue() and "Window" not in text.getvalue()


def test_segments_of_images_cut_by_batches(spark):
    boxes = [(i // 7, i, i * 5 % 90, i * 11 % 80, i * 5 % 90 + 9 + i % 50, i * 11 % 80 + 12 + i % 40, i % 3 == 0) for i in range(60)]
    boxes = [(a, b, c, d, e, f, g and e - c > 20 and f - d > 20) for a, b, c, d, e, f, g in boxes]
    df = spark.createDataFrame(boxes, "image_id long, ann_id long, x0 long, y0 long, x1 long, y1 long, has_hole boolean")
    label = {}
    for x in contours.cell_labels(df, "ann_id").collect():
        label[x.image_id, x.cx, x.cy] = x.label
    want = {}
    for image in {k[0] for k in label}:
        segments, degree = 0, {}
        for x in range(64):
            for y in range(64):
                for way, (u, v) in (("v", (x + 1, y)), ("h", (x, y + 1))):
                    if max(u, v) < 64 and label.get((image, x, y)) != label.get((image, u, v)):
                        segments += 1
                        for end in ((u, v), (u, v + 1) if way == "v" else (u + 1, v)):
                            degree[end] = degree.get(end, 0) + 1
        want[image] = (segments, sum(n != 2 for n in degree.values()))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        from annulus.operators import drawing

        got = {x.image_id: (x.segments, x.corners) for x in drawing.segment_counts(df, 64, 8, 6).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == want


@pytest.mark.parametrize("name", ["mask_rings", "mask_round_trip", "cleaned_labels"])
def test_runs_of_masks_are_not_shuffled(spark, sf_dir, name):
    text = io.StringIO()
    with redirect_stdout(text):
        queries()[name](spark, sf_dir).explain()
    # the boxes' rows, the boxes by image, and sums by image
    assert text.getvalue().count("Exchange hashpartitioning") == 3 and "Window" not in text.getvalue()


def test_union_of_runs():
    rng = np.random.default_rng(1)
    y, a = rng.integers(0, 5, 60), rng.integers(0, 40, 60)
    b = a + rng.integers(1, 5, 60)
    cells = np.zeros((5, 50), bool)
    for v, u, w in zip(y, a, b, strict=True):
        cells[v, u:w] = True
    got = np.zeros((5, 50), int)
    for v, u, w in zip(*tracing.union(y, a, b), strict=True):
        got[v, u:w] += 1
        assert (u == 0 or not cells[v, u - 1]) and not cells[v, w]
    assert (got == cells).all()


def test_votes_at_some_cells():
    cells = np.random.default_rng(2).integers(-1, 3, (9, 11))
    y, x = (v.ravel() for v in np.indices(cells.shape))
    for size in (3, 7):
        assert (label_maps.votes_at(cells, y, x, 3, size) == [label_maps.votes(cells, k, size).ravel() for k in range(3)]).all()
