"""Tracing masks, drawing rings, ring forests, faces of random graphs and fused boxes against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus import registry  # noqa: F401 - loads the plans in order
from annulus.operators import box_fusion, faces, forests, planar, sweep, tracing
from annulus.plans.exports import cycles_of
from tests.test_fusion import edges

RUNS = "image_id long, y long, x_start long, x_end long"
RING = "image_id long, id long, score double, exterior array<struct<x:double,y:double>>"


def rows_of(mask):
    out = []
    for y, row in enumerate(mask):
        d = np.diff(np.r_[0, row.astype(int), 0])
        out += [(y, int(a), int(b)) for a, b in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1), strict=True)]
    return out


def flood(mask, corners):
    """Components by flood fill."""
    label, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if label[start]:
            continue
        n, waiting = n + 1, [start]
        label[start] = n
        while waiting:
            i, j = waiting.pop()
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    u, v = i + a, j + b
                    if (a or b) and (corners or not (a and b)) and 0 <= u < len(mask) and 0 <= v < mask.shape[1] and mask[u, v] and not label[u, v]:
                        label[u, v] = n
                        waiting.append((u, v))
    return label, n


def enclosed(mask):
    """Parts of the background, by sides, that don't touch the border, and whose whole rim is one part of the mask (by sides)."""
    back, n = flood(~mask, False)
    return [back == k for k in range(1, n + 1) if not (back[[0, -1]] == k).any() and not (back[:, [0, -1]] == k).any()]


@pytest.mark.parametrize("corners", [False, True])
def test_traced_masks_come_back(corners):
    r = np.random.default_rng(1)
    for _ in range(150):
        mask = r.random((r.integers(1, 14), r.integers(1, 14))) < r.uniform(0.2, 0.9)
        runs = np.array(rows_of(mask)).reshape(-1, 3)
        parts = tracing.traced(*runs.T, corners)
        label, n = flood(mask, corners)
        assert len(parts) == n
        drawn = np.zeros(mask.shape, int)
        sizes = []
        for rings in parts:
            own = np.concatenate([np.concatenate([q, np.roll(q, -1, axis=0)], axis=1) for q in rings])
            cells = tracing.polygon_runs(own)
            sizes.append(int((cells[:, 2] - cells[:, 1]).sum()))
            for y, a, b in cells:
                drawn[y, a:b] += 1
            assert len({label[y, a] for y, a, _ in cells}) == 1
        assert (drawn == mask).all() and sorted(sizes) == sorted(np.bincount(label.ravel())[1:].tolist())
        if not corners:  # every hole is a part of the background
            back, _ = flood(~mask, False)
            for rings in parts:
                for hole in rings[1:]:
                    cells = tracing.polygon_runs(np.concatenate([hole, np.roll(hole, -1, axis=0)], axis=1))
                    inside = np.zeros(mask.shape, bool)
                    for y, a, b in cells:
                        inside[y, a:b] = True
                    assert any((region & ~mask == region).all() and (region & inside == region).all() for region in enclosed(mask))


def test_mask_polygons_and_scores(spark):
    r = np.random.default_rng(4)
    masks = {i: r.random((20, 30)) < 0.75 for i in range(12)}
    masks[5] = np.zeros((20, 30), bool)
    rows = [(i, *x) for i, m in masks.items() for x in rows_of(m)]
    random.Random(3).shuffle(rows)
    runs = spark.createDataFrame(rows, RUNS).repartition(4)
    found = tracing.mask_polygons(runs).cache()
    areas = {x.image_id: x.a for x in found.groupBy("image_id").agg(F.sum("area").alias("a")).collect()}
    assert areas == {i: float(m.sum()) for i, m in masks.items() if m.any()}
    back = sorted(tuple(x) for x in tracing.runs_of(found, "image_id").select("image_id", "y", "x_start", "x_end").collect())
    cells = {(i, y, x) for i, y, a, b in back for x in range(a, b)}
    assert cells == {(i, y, x) for i, m in masks.items() for y, x in zip(*(v.tolist() for v in np.nonzero(m)), strict=True)} and sum(b - a for _, _, a, b in back) == len(cells)
    large = tracing.kept_parts(found, 16.0, 2.0).collect()
    assert large and all(x.area >= 16 for x in large) and all(abs(planar.shoelace(np.array([tuple(p) for p in h]))) >= 2 for x in large for h in x.holes)
    some = tracing.as_instances(found.where("area >= 16")).collect()
    assert some and all(min(x.bbox[2:]) > 5 and 0.9 <= x.score <= 0.99 for x in some)
    values = {i: r.random((20, 30)).round(3) for i in masks}
    scores = spark.createDataFrame([(i, y, x, x + 1, float(v[y, x])) for i, v in values.items() for y in range(20) for x in range(28)], RUNS + ", p double")
    polygons = [(i, i, [(1.5, 2.5), (20.0, 4.0), (12.0, 17.5)], [[(9.0, 6.0), (12.0, 6.0), (11.0, 9.0)]] if i % 2 else []) for i in masks]
    polygons += [(0, 90, [(1.1, 1.1), (1.2, 1.1), (1.2, 1.2)], []), (77, 91, [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0)], [])]
    df = spark.createDataFrame(polygons, "image_id long, id long, exterior array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")
    for x in tracing.mean_scores(df, "id", scores).collect():
        i, _, ring, holes = next(p for p in polygons if p[1] == x.id)
        e = edges(ring, *holes)
        inside = [(y, c) for y in range(20) for c in range(30) if sum((a[1] > y + 0.5) != (a[3] > y + 0.5) and c + 0.5 < a[0] + (y + 0.5 - a[1]) / (a[3] - a[1]) * (a[2] - a[0]) for a in e) % 2]
        want = np.mean([values[i][y, c] if c < 28 else 0 for y, c in inside]) if inside and i in values else 0.0
        assert x.pixels == len(inside) and x.score == pytest.approx(want)
    assert tracing.mask_polygons(runs.limit(0)).count() == 0


def slow_forest(rings, iou=0.6, small=0.85, containment=0.98):
    """rings(id, score, ring) of one image: in order, then parents, depths and holes."""
    area = {i: abs(planar.shoelace(np.array(r))) for i, _, r in rings}
    e = {i: edges(r) for i, _, r in rings}
    both = lambda i, j: sweep.swept_areas(e[i], e[j])[2]
    inside = lambda i, j: both(i, j) / area[j] >= containment
    kept = []
    for i, _, _ in sorted(rings, key=lambda x: (-x[1], -area[x[0]], x[0])):
        bad = False
        for j in kept:
            b = both(i, j)
            large, little = (i, j) if area[i] > area[j] else (j, i)
            bad |= b / (area[i] + area[j] - b) >= iou or (b / area[little] >= small and not inside(large, little))
        if not bad:
            kept.append(i)
    parent = {i: min((j for j in kept if area[j] > area[i] and inside(j, i)), key=lambda j: (area[j], j), default=None) for i in kept}
    depth = lambda i: 0 if parent[i] is None else depth(parent[i]) + 1
    return {i: (depth(i), area[i] - sum(area[j] for j in kept if parent[j] == i), sum(parent[j] == i for j in kept)) for i in kept if depth(i) % 2 == 0}


def test_ring_forests(spark):
    r = np.random.default_rng(6)
    rings = []
    for image in range(4):
        def grow(x, y, size, deep, image=image):
            turn = np.linspace(0, 2 * np.pi, 9)[:-1]
            ring = np.stack([x + size * np.cos(turn), y + size * np.sin(turn)], axis=1).tolist()
            rings.append((image, len(rings), float(r.integers(3, 9)) / 10, [tuple(p) for p in ring]))
            if deep < 5:
                for move in ((-0.45, 0.4) if deep % 2 else (0,)):
                    if r.random() < 0.9:
                        grow(x + move * size, y, size * (0.38 if deep % 2 else 0.7), deep + 1)
        grow(0, 0, 100, 0)
        grow(160, 0, 50, 2)
        grow(3, 2, 99, 4)  # a near copy
    df = spark.createDataFrame(rings, RING).withColumn("depth", F.lit("x"))
    got = {x.id: x for x in forests.ring_polygons(df).collect()}
    want = {}
    for image in range(4):
        want |= slow_forest([x[1:] for x in rings if x[0] == image])
    assert {i: (x.depth, len(x.holes)) for i, x in got.items()} == {i: (d, n) for i, (d, _, n) in want.items()} and max(d for d, _, _ in want.values()) >= 4
    assert all(x.area == pytest.approx(want[i][1]) for i, x in got.items())
    assert forests.ring_polygons(df.limit(0)).count() == 0
    chain = [(i, i - 1 if i % 40 else None) for i in range(200)]
    assert {x.id: x.depth for x in forests.depths(spark.createDataFrame(chain, "id long, parent long")).collect()} == {i: i % 40 for i in range(200)}


def test_ring_predictions_from_file_to_polygons(spark, tmp_path):
    from annulus.sources import coco

    square = lambda a, b: [float(v) for p in ((a, a), (b, a), (b, b), (a, b), (a, a)) for v in p]
    rows = [(1, [square(0, 40)], 0.9), (1, [square(10, 30)], 0.8), (1, [square(15, 25)], 0.7), (1, [square(0, 41)], 0.5), (2, [square(0, 2)], 0.9), (2, [square(0, 9)], 0.05),
            (2, [[0.0, 0.0, 8.0, 0.0, 0.0, 8.0, 8.0, 8.0]], 0.6), (2, [[1.0, 2.0]], 0.6), (2, [], 0.6)]
    path = f"{tmp_path}/predictions.json"
    spark.createDataFrame([(i, s, p) for i, s, p in rows], "image_id long, segmentation array<array<double>>, score double").coalesce(1).write.json(path)
    polygons, counts = coco.read_ring_predictions(spark, path, min_score=0.1, lines=True)
    got = sorted((x.image_id, round(x.area, 6), len(x.holes), x.score) for x in polygons.collect())
    assert got == [(1, 100.0, 0, 0.7), (1, 1200.0, 1, 0.9), (2, 16.0, 0, 0.6)]
    assert counts.first().asDict() == {"num_predictions": 9, "num_kept_rings": 5, "num_skipped_low_score": 1, "num_skipped_invalid": 3, "num_grouped_buildings": 3}


def test_faces_of_random_graphs(spark):
    r = np.random.default_rng(8)
    rows = []
    for image in range(25):
        lines = r.uniform(0, 10, (r.integers(3, 14), 4)) if image % 2 else r.integers(0, 6, (r.integers(3, 14), 4)).astype(float)
        rows += [(image, *map(float, x)) for x in lines]
        found = faces.faces(lines)
        # Euler: faces = edges - vertices + parts, counted on what is left without open ends and bridges
        both, none = np.concatenate([lines, lines[:, [2, 3, 0, 1]]]), np.zeros(2 * len(lines), int)
        points, pieces, *_ = planar._pieces(both, none, none, 1)
        left = {tuple(p) for p in pieces.tolist()}
        def reach(links, start):
            seen, waiting = {start}, [start]
            while waiting:
                v = waiting.pop()
                for a, b in links:
                    for p, q in ((a, b), (b, a)):
                        if p == v and q not in seen:
                            seen.add(q)
                            waiting.append(q)
            return seen
        left = {(a, b) for a, b in left if b in reach(left - {(a, b)}, a)}  # no bridges
        nodes, parts = {v for p in left for v in p}, 0
        waiting = set(nodes)
        while waiting:
            waiting -= reach(left, next(iter(waiting)))
            parts += 1
        assert len(found) == len(left) - len(nodes) + parts
        outline = planar.region([np.concatenate([np.concatenate([q, np.roll(q, -1, axis=0)], axis=1) for q in [e, *h]]) for e, h, _ in found], lambda w: (w % 2 == 1).any(axis=1)) if found else []
        assert sum(x[2] for x in found) == pytest.approx(sum(x[2] for x in outline))
    df = spark.createDataFrame(rows, "image_id long, ax double, ay double, bx double, by double")
    got = faces.image_faces(df.repartition(3))
    assert got.count() == sum(len(faces.faces(np.array([x[1:] for x in rows if x[0] == i]))) for i in range(25))
    cross = [(0, 0.0, 0.0, 8.0, 0.0), (0, 8.0, 0.0, 8.0, 8.0), (0, 8.0, 8.0, 0.0, 8.0), (0, 0.0, 8.0, 0.0, 0.0), (0, 4.0, 0.0, 4.0, 8.0)]
    labels = spark.createDataFrame([(0, y, 0, 4, "left") for y in range(8)] + [(0, y, 4, 8, "right") for y in range(6)], "image_id long, y long, x_start long, x_end long, label string")
    named = faces.labelled(faces.image_faces(spark.createDataFrame(cross, df.schema)), labels).collect()
    assert sorted((min(p.x for p in x.exterior), x.label, x.area) for x in named) == [(0.0, "left", 32.0), (4.0, "right", 32.0)]
    assert faces.image_faces(df.limit(0)).count() == 0


def slow_fusion(rows, weights, iou, least, mode, overflow):
    out = []
    known = [(s * weights[m], m, (min(a, c), min(b, d), max(a, c), max(b, d))) for m, s, a, b, c, d in rows if s >= least]
    found = []
    for s, m, box in sorted((x for x in known if x[2][0] < x[2][2] and x[2][1] < x[2][3]), key=lambda x: (-x[0], x[1], x[2])):
        def overlap(h, box=box):
            w, t = min(h[2], box[2]) - max(h[0], box[0]), min(h[3], box[3]) - max(h[1], box[1])
            both = max(w, 0) * max(t, 0)
            return both / ((h[2] - h[0]) * (h[3] - h[1]) + (box[2] - box[0]) * (box[3] - box[1]) - both)
        best = max(found, key=lambda c: overlap(c["box"]), default=None)
        if best is None or overlap(best["box"]) <= iou:
            found.append({"rows": [(s, m, box)], "box": box})
        else:
            best["rows"].append((s, m, box))
            total = sum(x[0] for x in best["rows"])
            best["box"] = tuple(sum(x[0] * x[2][k] for x in best["rows"]) / total for k in range(4))
    for c in found:
        scores, models = [x[0] for x in c["rows"]], [x[1] for x in c["rows"]]
        n, mean, w, used = len(scores), sum(scores) / len(scores), sum(weights[m] for m in models), set(models)
        score = {"max": max(scores) / max(weights), "box_and_model_avg": mean * n / w * sum(weights[m] for m in used) / sum(weights),
                 "absent_model_aware_avg": mean * n / (w + sum(weights[m] for m in range(len(weights)) if m not in used)),
                 "avg": mean * (n if overflow else min(len(weights), n)) / sum(weights)}[mode]
        out.append((score, *c["box"], n))
    return sorted(out, key=lambda x: (-x[0], *x[1:]))


@pytest.mark.parametrize("mode", box_fusion.MODES)
def test_fused_boxes(spark, mode):
    r = random.Random(5)
    rows = []
    for image in range(6):
        for label in range(2):
            for _ in range(r.randint(0, 25)):
                x, y = 20 * r.randint(0, 2) + r.uniform(0, 5), 20 * r.randint(0, 2) + r.uniform(0, 5)
                rows.append((image, label, r.randint(0, 2), round(r.random(), 3), x, y, x + r.uniform(9, 14), y + r.uniform(9, 14)))
    rows += [(0, 0, 1, 0.9, 5.0, 5.0, 5.0, 9.0), (0, 0, 1, 0.9, 90.0, 99.0, 80.0, 85.0)]
    df = spark.createDataFrame(rows, "image_id long, label int, model int, score double, x0 double, y0 double, x1 double, y1 double")
    weights = [1.0, 2.0, 0.5]
    for overflow in (False, True):
        got = box_fusion.fused_boxes(df, weights, 0.4, 0.1, mode, overflow).collect()
        for key in {x[:2] for x in rows}:
            own = sorted((x for x in got if (x.image_id, x.label) == key), key=lambda x: x.place)
            want = slow_fusion([x[2:] for x in rows if x[:2] == key], weights, 0.4, 0.1, mode, overflow)
            assert len(own) == len(want)
            for x, w in zip(own, want, strict=True):
                assert [x.score, x.x0, x.y0, x.x1, x.y1, x.boxes] == pytest.approx(w)
    assert max(x.boxes for x in got) > 2 and box_fusion.fused_boxes(df.limit(0), weights).count() == 0
    with pytest.raises(ValueError):
        box_fusion.fused_boxes(df, weights, mode="median")


def test_cycles_of_any_length(spark):
    r = random.Random(2)
    want, links, at = {}, [], 0
    for n in (1, 2, 3, 6, 9, 17, 64, 100):
        nodes = list(range(at, at + n))
        r.shuffle(nodes)
        links += list(zip(nodes, nodes[1:] + nodes[:1], strict=True))
        want |= dict.fromkeys(nodes, at)
        at += n
    r.shuffle(links)
    got = cycles_of(spark.createDataFrame(links, "node long, next long")).collect()
    assert {x.node: x.cycle for x in got} == want and len(got) == len(want)


def test_points_inside(spark):
    rings = [(0, 0, 1.0, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), (0, 1, 1.0, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (8.0, 9.0), (8.0, 1.0), (1.0, 1.0), (1.0, 9.0), (0.0, 9.0)]), (0, 2, 1.0, [(0.0, 0.0), (5.0, 5.0), (9.0, 9.0)])]
    got = {x.id: x.inside for x in forests.prepared(spark.createDataFrame(rings, RING)).collect()}
    assert (got[0].x, got[0].y) == (2.0, 2.0) and planar.within(np.array(rings[1][3]), got[1].x, got[1].y) and not math.isnan(got[0].x)


def test_polygons_of_source_images(spark):
    square = lambda a, b, c, d: [[float(v) for v in (a, b, c, b, c, d, a, d)]]
    rows = [(1, 10, 0.9, square(90, 10, 130, 50)), (2, 11, 0.8, square(0, 10, 40, 50)), (1, 12, 0.7, square(0, 0, 30, 30)), (1, 13, 0.6, square(10, 10, 20, 20)),
            (1, 14, 0.05, square(50, 50, 60, 60)), (9, 15, 0.9, square(0, 0, 9, 9)), (3, 16, 0.9, [[0.0, 0.0]]), (3, 17, 0.4, square(0, 0, 30, 30))]
    predictions = spark.createDataFrame(rows, "image_id long, id long, score double, segmentation array<array<double>>")
    images = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "a", 90.0, 0.0), (3, "b", 500.0, 7.0)], "image_id long, source_image_name string, origin_x double, origin_y double")
    found, counts = forests.source_polygons(predictions, images, min_score=0.1)
    got = sorted((x.source_image_name, x.id, x.patch_id, x.area, len(x.holes), x.depth, min(p.x for p in x.exterior)) for x in found.collect())
    assert got == [("a", 10, 1, 1600.0, 0, 0, 90.0), ("a", 12, 1, 900.0, 0, 0, 0.0), ("b", 17, 3, 900.0, 0, 0, 500.0)]
    assert counts.first().asDict() == {"predictions": 8, "kept": 5, "low_score": 1, "invalid": 2}
    nested, _ = forests.source_polygons(predictions, images, min_score=0.1, nested=True)
    assert {x.id: (x.area, len(x.holes)) for x in nested.collect()} == {10: (1600.0, 0), 12: (800.0, 1), 17: (900.0, 0)}


def test_outline_masks(spark):
    from annulus.plans.masks import merged_runs

    r = np.random.default_rng(11)
    sides, masks = [], []
    for _ in range(2):
        rows, drawn = [], {}
        for image in range(5):
            for _ in range(int(r.integers(0, 3)) if image else 0):
                ring = [tuple(p) for p in (r.uniform(-5, 45, (4, 2)).round(1)).tolist()]
                hole = [(10.0, 10.0), (10.0, 20.0), (20.0, 20.0)]
                rows.append((image, ring, [hole] if image % 2 else []))
                for own in [ring, *rows[-1][2]]:
                    points = [tuple(np.rint(p)) for p in own]
                    for a, b in zip(points, points[1:] + points[:1], strict=True):
                        for y in range(40):
                            for x in range(40):
                                d = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
                                t = min(1, max(0, ((x - a[0]) * (b[0] - a[0]) + (y - a[1]) * (b[1] - a[1])) / d)) if d else 0
                                if math.hypot(x - a[0] - t * (b[0] - a[0]), y - a[1] - t * (b[1] - a[1])) <= 2.5 + 1e-9:
                                    drawn.setdefault(image, np.zeros((40, 40), bool))[y, x] = True
        sides.append(spark.createDataFrame(rows, "image_id long, exterior array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>"))
        masks.append(drawn)
    runs = [merged_runs(tracing.outline_runs(s, 5.0, 40), "image_id", "y") for s in sides]
    for df, drawn in zip(runs, masks, strict=True):
        got = {}
        for x in df.collect():
            got.setdefault(x.image_id, np.zeros((40, 40), bool))[x.y, x.x_start : x.x_end] = True
        assert got.keys() == drawn.keys() and all((got[i] == drawn[i]).all() for i in got)
    for x in tracing.mask_scores(*runs, spark.range(6).withColumnRenamed("id", "image_id"), 40).collect():
        a, b = (m.get(x.image_id, np.zeros((40, 40), bool)) for m in masks)
        want = (1, 1, 1) if not (a | b).any() else ((a == b).mean(), 2 * (a & b).sum() / (a.sum() + b.sum()), (a & b).sum() / (a | b).sum())
        assert (x.accuracy, x.f1, x.iou) == pytest.approx(want)


def test_runs_of_many_polygons_are_those_of_each():
    r = np.random.default_rng(9)
    for far in (1.0, 1e12):  # places that make one number, and such that don't
        own = [np.concatenate([np.concatenate([q, np.roll(q, -1, axis=0)], axis=1) for q in r.uniform(-9, 30, (r.integers(1, 3), 5, 2)) * [far, 1]]) for _ in range(40)]
        found = tracing.rows_of_runs(np.concatenate(own), np.repeat(np.arange(40) * (1 if far == 1 else 10**6), list(map(len, own))))
        for k, e in enumerate(own):
            assert found[found[:, 0] == k * (1 if far == 1 else 10**6), 1:].tolist() == tracing.polygon_runs(e).tolist()
    assert not len(tracing.polygon_runs(np.zeros((0, 4))))
