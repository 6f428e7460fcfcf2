"""Queries over cells shuffle boxes, not cells, and give what plain loops give."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus import registry
from annulus.operators import box_fusion, drawing, label_maps, tracing
from annulus.operators.shared import shared_folder
from annulus.plans import exports
from annulus.plans.masks import merged_runs
from annulus.plans.polygons import leaned
from annulus.sources.boxes import INSET, SIDE, gt_boxes, polygons, pred_boxes


@pytest.mark.parametrize("name", ["image_masks", "background_gaps", "vertex_heatmap", "junction_counts", "panoptic_quality", "cleaned_labels", "outline_mask_scores"])
def test_cells_stay_in_the_task_of_their_image(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "Join" not in plan


def test_corners_that_many_share(spark):
    """Corners of many boxes at few places, in more steps than one."""
    draw = random.Random(5)
    rows = [(image, i, (x := draw.randint(0, 9)), (y := draw.randint(0, 9)), x + draw.randint(1, 9), y + draw.randint(1, 9), draw.random() < 0.5) for image in range(3) for i in range(40)]
    rows += [(7, 1, 0, 0, 3, 3, True), (8, 1, 0, 0, 3, 3, False)]
    boxes = spark.createDataFrame(rows, "image_id long, id long, x0 long, y0 long, x1 long, y1 long, first boolean")
    step, drawing.STEP = drawing.STEP, 64
    try:
        got = {r["image_id"]: (r["n"], r["m"], r["tp"]) for r in drawing.corner_counts(boxes, 5).collect()}
    finally:
        drawing.STEP = step
    want = {}
    for image in {r[0] for r in rows}:
        gt, pred = ([(r[1], k, *xy) for r in rows if r[0] == image and r[6] == side for k, xy in enumerate([(r[2], r[3]), (r[4], r[3]), (r[4], r[5]), (r[2], r[5])])] for side in (True, False))
        hit = set()
        for _, _, x, y in pred:
            near = sorted(((x - a) ** 2 + (y - b) ** 2, i, k) for i, k, a, b in gt if (x - a) ** 2 + (y - b) ** 2 <= 25)
            hit |= {near[0][1:]} if near else set()
        want[image] = len(gt), len(pred), len(hit)
    assert got == want


def test_masks_without_a_cell_and_at_the_edge(spark):
    rows = [(1, -5, -5, 0, 9, False), (2, -3, 2, 4, 5, False), (2, 10, 2, 40, 5, False), (3, 0, 0, 16, 16, True), (4, 0, 0, 16, 16, False)]
    boxes = spark.createDataFrame(rows, "image_id long, x0 long, y0 long, x1 long, y1 long, has_hole boolean")
    assert sorted(map(tuple, drawing.mask_boxes(boxes, 16, 6).collect())) == [(2, 12 + 18, 0, 2, 16, 5), (3, 256 - 16, 0, 0, 16, 16), (4, 256, 0, 0, 16, 16)]
    assert sorted(map(tuple, drawing.gap_sums(boxes, 16, 6).collect())) == [(2, 3, 18), (3, 4, 16)]
    total = drawing.heat_sums(boxes.where(F.col("image_id") == 4), 16, 6, 1, [1.0, 0.5, 0.25]).collect()
    assert [tuple(r) for r in total] == [(4, 16, 4 * (1 + 0.5 + 0.5 + 0.25))]


def test_cleaned_sizes_are_those_of_the_cleaned_runs(spark, sf_dir):
    boxes = gt_boxes(spark, sf_dir)
    runs = label_maps.cleaned_maps(drawing.label_runs(boxes, SIDE, INSET), together=True)
    want = runs.groupBy("image_id", "label").agg(F.sum(F.col("x_end") - F.col("x_start")).alias("pixels"))
    got = label_maps.cleaned_sizes(boxes, SIDE, INSET).select("image_id", "label", "pixels")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    edge = spark.createDataFrame([(1, -9, -9, 0, 0, False), (2, 0, 0, 16, 16, False), (3, 3, 3, 4, 4, False)], "image_id long, x0 long, y0 long, x1 long, y1 long, has_hole boolean")
    assert sorted(map(tuple, label_maps.cleaned_sizes(edge, 16, 6).collect())) == [(2, 1, 256), (3, 0, 256)]


def test_outline_scores_are_those_of_merged_runs(spark, sf_dir):
    gt, pred = (leaned(polygons(b), 0.25) for b in (gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir).where("image_id % 9 <> 0")))
    masks = [merged_runs(tracing.outline_runs(df, 5.0, SIDE), "image_id", "y") for df in (gt, pred)]
    want = tracing.mask_scores(*masks, gt.select("image_id"), SIDE)
    step, tracing.DRAWN = tracing.DRAWN, SIDE * 3  # a few polygons at once
    try:
        got = sorted(map(tuple, tracing.outline_scores(gt, pred, 5.0, SIDE).collect()))
    finally:
        tracing.DRAWN = step
    assert got == sorted(map(tuple, want.collect()))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_round_trips_draw_in_the_image_and_modes_share_their_clusters(spark, sf_dir):
    assert "Generate" not in plan_of(registry.QUERIES["mask_round_trip"](spark, sf_dir))
    assert plan_of(registry.QUERIES["fused_model_boxes"](spark, sf_dir)).count("Relation") == 2  # boxes and their near copies


def test_points_are_made_behind_the_joins_of_their_boxes(spark, sf_dir):
    plan = plan_of(registry.QUERIES["hausdorff_of_matches"](spark, sf_dir))
    assert "flatten" not in plan[plan.index("Join") :]


def test_cycles_leave_only_their_last_labels(spark):
    folder = Path(shared_folder(spark))
    before = set(folder.glob("cycles-*"))
    found = exports.cycles_of(spark.createDataFrame([(i, i - i % 7 + (i + 3) % 7) for i in range(70)], "node long, next long"))
    assert sorted(map(tuple, found.collect())) == [(i, i - i % 7) for i in range(70)]
    (made,) = set(folder.glob("cycles-*")) - before
    assert len(list(made.iterdir())) == 1


def test_few_boxes_are_clustered_as_many(monkeypatch):
    draw = np.random.default_rng(7)
    for _ in range(200):
        low = draw.integers(0, 12, (draw.integers(1, 30), 2)).astype(float)
        boxes, score = np.concatenate([low, low + draw.integers(1, 9, low.shape)], axis=1), np.sort(draw.integers(0, 5, len(low)) / 5)[::-1]
        few = box_fusion.clusters(boxes, score, 0.4)
        monkeypatch.setattr(box_fusion, "FEW", 0)
        many = box_fusion.clusters(boxes, score, 0.4)
        monkeypatch.undo()
        assert np.array_equal(few[0], many[0]) and np.array_equal(few[1], many[1])
