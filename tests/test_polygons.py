"""Planar subdivisions, bands and tangent angles on hand-made and random rings; metrics of polygons against plain loops."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus import registry  # noqa: F401 - loads the plans in order
from annulus.functions import rings as R
from annulus.operators import contours, evaluator, planar, sweep
from tests.test_fusion import edges

BOX, HOLE = [(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (8, 2), (8, 8), (2, 8)]
SCHEMA = "image_id long, {key} long, score double, exterior array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>"


@pytest.mark.parametrize(
    "rings, want",
    [
        ([BOX], [(100, 0)]),
        ([BOX, HOLE], [(64, 1)]),
        ([[(0, 0), (4, 0), (0, 4), (4, 4)]], [(4, 0), (4, 0)]),  # a bow-tie
        ([BOX, [(5, 2), (15, 2), (15, 8), (5, 8)]], [(70, 0), (30, 0)]),  # a hole that reaches outside
        ([BOX, [(2, 2), (6, 2), (6, 6), (2, 6)], [(4, 4), (8, 4), (8, 8), (4, 8)]], [(72, 1), (4, 0)]),  # holes that overlap
        ([BOX, [(0, 2), (5, 2), (5, 5), (0, 5)]], [(85, 0)]),  # a hole along a side
        ([BOX, [(0, 0), (5, 2), (5, 5)]], [(92.5, 1)]),  # a hole that touches a corner
        ([BOX, HOLE, [(4, 4), (6, 4), (6, 6), (4, 6)]], [(64, 1), (4, 0)]),  # an island in the hole
        ([[(0, 0), (10, 0), (5, 0), (5, 5)]], [(12.5, 0)]),  # an edge that runs back
        ([BOX, BOX], []),
        ([[(0, 0), (5, 5), (9, 9)]], []),
        ([[(0, 0), (4, 0), (4, 4), (8, 4), (8, 8), (4, 8), (4, 4), (0, 4)]], [(16, 0), (16, 0)]),  # a ring that meets itself
        ([[(0, 0), (3, 9), (6, 0), (-1, 6), (7, 6)]], None),  # a star
    ],
)
def test_parts(rings, want):
    found = planar.region([edges(*rings)], planar.odd)
    if want is not None:
        assert [(pytest.approx(a), h) for a, h in want] == [(x[2], len(x[1])) for x in found]
    assert sum(x[2] for x in found) == pytest.approx(sweep.swept_areas(edges(*rings), edges())[0])


def test_parts_of_random_rings():
    r = np.random.default_rng(0)
    tables = []
    for k in range(300):
        ring = r.integers(0, 7, (r.integers(3, 12), 2)) if k % 2 else r.uniform(0, 7, (r.integers(3, 12), 2))
        tables.append([edges([tuple(map(float, p)) for p in ring], [tuple(map(float, p)) for p in r.integers(0, 7, (4, 2))])])
    together = planar.regions(tables, planar.odd)
    for table, found in zip(tables, together, strict=True):
        assert sum(p[2] for p in found) == pytest.approx(sweep.swept_areas(table[0], table[0])[0], abs=1e-7)
        for exterior, holes, area in found:
            own = edges(*[[tuple(p) for p in q] for q in [exterior, *holes]])
            assert all(len({tuple(p) for p in q}) == len(q) >= 3 for q in [exterior, *holes]) and planar.shoelace(exterior) > 0
            again = planar.region([own], planar.odd)  # a part is valid: nothing falls off, and what lies around it is as large
            assert len(again) == 1 and again[0][2] == pytest.approx(area, abs=1e-7) and len(again[0][1]) == len(holes)
    alone = [planar.region(t, planar.odd) for t in tables[:40]]
    assert [[x[2] for x in p] for p in alone] == [[x[2] for x in p] for p in together[:40]]


def test_clips_of_all_patches_add_up(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(40):
        turn, far = np.sort(r.uniform(0, 2 * np.pi, 11)), r.uniform(20, 60, 11)
        ring = [(float(x), float(y)) for x, y in zip(80 + far * np.cos(turn), 80 + far * np.sin(turn), strict=True)]
        rows.append((0, i, 1.0, ring, [[(75.0, 75.0), (82.0, 76.0), (79.0, 84.0)]] if i % 2 else []))
    rows += [(0, 90, 1.0, None, []), (0, 91, 1.0, [(1.0, 1.0), (1.0, 1.0), (1.0, 1.0)], []), (0, 92, 1.0, [(0.0, 0.0), (64.0, 0.0), (64.0, 32.0), (0.0, 32.0)], [])]
    df = spark.createDataFrame(rows, SCHEMA.format(key="ann_id"))
    cut = planar.patch_parts(df, 32.0)
    assert {"patch_x", "patch_y", "area", "exterior", "holes", "score"} <= set(cut.columns)
    found = cut.collect()
    for i, ring, holes in ((x[1], x[3], x[4]) for x in rows[:40]):
        own = [x for x in found if x.ann_id == i]
        assert sum(x.area for x in own) == pytest.approx(sweep.swept_areas(edges(ring, *holes), edges())[0])
        for x in own:
            assert all(x.patch_x * 32 - 1e-9 <= p.x <= x.patch_x * 32 + 32 + 1e-9 and x.patch_y * 32 - 1e-9 <= p.y <= x.patch_y * 32 + 32 + 1e-9 for p in x.exterior)
            box = planar.box_edges(x.patch_x * 32, x.patch_y * 32, x.patch_x * 32 + 32, x.patch_y * 32 + 32)
            same = [y.area for y in own if (y.patch_x, y.patch_y) == (x.patch_x, x.patch_y)]
            assert sum(same) == pytest.approx(sweep.swept_areas(edges(ring, *holes), box)[2])
    assert sorted((x.patch_x, x.patch_y, x.area) for x in found if x.ann_id == 92) == [(0, 0, 1024.0), (1, 0, 1024.0)]
    assert not [x for x in found if x.ann_id in (90, 91) and x.area > 0]
    c = F.col
    wanted = df.select("ann_id", planar.parts(c("exterior"), c("holes")).alias("p"), planar.unioned(F.array(F.struct("exterior", "holes"))).alias("u"))
    both = {x.ann_id: x for x in wanted.collect()}
    assert both[90].p is None and both[91].p == [] and both[90].u == []
    assert all(sum(p.area for p in both[i].p) == pytest.approx(sum(p.area for p in both[i].u)) for i in range(40))
    least = df.select(planar.parts(c("exterior"), c("holes")).alias("p")).select(planar.largest(c("p"), 3000.0)["area"].alias("a")).collect()
    assert 0 < sum(x.a is not None for x in least) < 43 and all(x.a is None or x.a >= 3000 for x in least)


def slow_band(rings, radius):
    """Quads along all edges and kites at all corners, joined piece by piece."""
    layers = []
    for ring in rings:
        p = [np.array(v, float) for v in ring]
        unit = [(b - a) / np.hypot(*(b - a)) for a, b in zip(p, p[1:] + p[:1], strict=True)]
        left = [np.array([-u[1], u[0]]) for u in unit]
        for a, b, n in zip(p, p[1:] + p[:1], left, strict=True):
            layers.append([a - radius * n, b - radius * n, b + radius * n, a + radius * n])
        for k, v in enumerate(p):
            n0, n1 = left[k - 1], left[k]
            for way in (1, -1):  # the kite on the inner side lies within the quads
                tip = v + way * radius * (n0 + n1) / (1 + n0 @ n1)
                layers.append([v, v + way * radius * n0, tip, v + way * radius * n1])
    return [edges([tuple(q) for q in layer]) for layer in layers]


def test_band_iou(spark):
    r = np.random.default_rng(5)
    rows, want = [], []
    for i in range(30):
        sides = []
        for move in (0, r.uniform(-0.6, 0.6, 2)):
            turn = np.linspace(0, 2 * np.pi, 7)[:-1] + 0.2
            far = 8 + 3 * np.array([(-1) ** k for k in range(6)]) * (i % 3) / 2
            ring = np.stack([far * np.cos(turn), far * np.sin(turn)], axis=1) + move
            if i % 5 == 0:  # a step shorter than the radius
                ring = np.insert(ring, 1, ring[1] + [0.3, 0.4], axis=0)
            sides.append([ring.tolist(), (ring * 0.3).tolist()] if i % 2 else [ring.tolist()])
        a, b = (slow_band(x, 1.0) for x in sides)
        whole = planar.region([*a, *b], lambda w: (w % 2 == 1).any(axis=1))
        both = planar.region([*a, *b], lambda w, n=len(a): (w[:, :n] % 2 == 1).any(axis=1) & (w[:, n:] % 2 == 1).any(axis=1))
        want.append(sum(x[2] for x in both) / sum(x[2] for x in whole))
        rows.append((i, *[[np.ravel(x).tolist() for x in s] for s in sides]))
    rows += [(40, [[0.0, 0.0, 9.0, 0.0]], [[0.0, 0.0, 9.0, 0.0, 9.0, 9.0]]), (41, None, [[0.0, 0.0, 9.0, 0.0, 9.0, 9.0]])]
    df = spark.createDataFrame(rows, "i long, a array<array<double>>, b array<array<double>>")
    got = [x.v for x in df.select("i", contours.band_iou(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]
    assert got[:30] == pytest.approx(want, abs=1e-7) and got[30:] == [0.0, None]


def test_bands_cut_off_long_mitres():
    thorn = np.array([(0.0, 0.0), (40.0, 1.0), (0.0, 2.0)])
    e = contours.band_edges(thorn, 1.0)
    assert e[:, [0, 2]].max() < 40 + 5 + 1e-9  # a full mitre would reach 40 radii out
    assert e[:, [0, 2]].max() > 40 + 4.9
    square = contours.band_edges(np.array(BOX, float), 1.0)
    assert len(square) == 8 and sweep.swept_areas(square, np.zeros((0, 4)), True)[0] == pytest.approx(144 - 64)
    assert len(contours.band_edges(np.array([(1.0, 1.0)] * 4), 1.0)) == 0


def slow_tangent_angle(pred, gt, spacing=2.0, stretch=2.0):
    worst = None
    for ring in pred:
        points = []
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            steps = max(1, round(math.dist(a, b) / spacing))
            points += [(a[0] + k / steps * (b[0] - a[0]), a[1] + k / steps * (b[1] - a[1])) for k in range(steps)]
        points.append(ring[0])
        feet = []
        for p in points:
            best = None
            for other in gt:
                for a, b in zip(other, other[1:] + other[:1], strict=True):
                    d = (b[0] - a[0], b[1] - a[1])
                    t = min(1, max(0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / (d[0] ** 2 + d[1] ** 2)))
                    foot = (a[0] + t * d[0], a[1] + t * d[1])
                    if best is None or math.dist(p, foot) < best[0] - 1e-12:
                        best = (math.dist(p, foot), foot)
            feet.append(best[1])
        for p, q, u, v in zip(points, points[1:], feet, feet[1:], strict=False):
            m, n = math.dist(p, q), math.dist(u, v)
            if m > 0 and n > 0 and 1 / stretch < m / n < stretch:
                cosine = abs((q[0] - p[0]) * (v[0] - u[0]) + (q[1] - p[1]) * (v[1] - u[1])) / (m * n)
                worst = cosine if worst is None else min(worst, cosine)
    return math.nan if worst is None else math.degrees(math.acos(min(1, worst)))


def random_polygons(r, images=3, each=6):
    """Two sides of polygons that partly agree, some with holes."""
    sides = ([], [])
    for image, k in itertools.product(range(images), range(each)):
        turn = np.linspace(0, 2 * np.pi, 6)[:-1] + r.uniform(0, 1)
        ring = np.stack([12 * np.cos(turn), 9 * np.sin(turn)], axis=1) + [30 * (k % 3) + r.uniform(0, 4), 24 * (k // 3) + r.uniform(0, 3)]
        for side, own in zip(sides, (ring, ring + r.uniform(-1.2, 1.2, 2)), strict=True):
            if r.random() < 0.9:
                hole = (own - own.mean(0)) * 0.4 + own.mean(0) + r.uniform(-0.5, 0.5, 2)
                side.append((image, 100 * image + k, float(r.random()), [tuple(p) for p in own.tolist()], [[tuple(p) for p in hole.tolist()]] if k % 2 and r.random() < 0.8 else []))
    return sides


def greatest(gain):
    """Pairs of the assignment of greatest total, by trying all."""
    n, m = gain.shape
    if n > m:
        return [(j, i) for i, j in greatest(gain.T)]
    best = max(itertools.permutations(range(m), n), key=lambda p: sum(gain[i, j] for i, j in enumerate(p)), default=())
    return [(i, j) for i, j in enumerate(best) if gain[i, j] > 0]


def band(a, b):
    x, y = (np.concatenate([contours.band_edges(np.array(r, float)) for r in s]) for s in (a, b))
    p, q, both = sweep.swept_areas(x, y, True)
    return both / (p + q - both)


def nearest(p, rings):
    return min(math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)
               for t in [min(1, max(0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / math.dist(a, b) ** 2))])


def slow_distances(g, p):
    polis = (np.mean([nearest(v, p) for r in g for v in r]) + np.mean([nearest(v, g) for r in p for v in r])) / 2
    a, b = (np.concatenate([contours.sampled(np.array(r, float)) for r in s]) for s in (g, p))
    far = np.hypot(*(a[:, None] - b).transpose(2, 0, 1))
    _, size, both = sweep.swept_areas(edges(*g), edges(*p))
    return band(g, p), polis, max(np.quantile(far.min(0), 0.95), np.quantile(far.min(1), 0.95)), slow_tangent_angle(p, g) if both / size >= 0.5 else math.nan


def test_metrics_of_polygons(spark):
    gt, pred = random_polygons(np.random.default_rng(12))
    a, b = spark.createDataFrame(gt, SCHEMA.format(key="ann_id")), spark.createDataFrame(pred, SCHEMA.format(key="pred_id"))
    rings = lambda x: [x[3], *x[4]]
    matched, roles, exact, hits = [], {}, 0, {2.0: 0, 5.0: 0}
    for image in range(3):
        g, p = ([x for x in s if x[0] == image] for s in (gt, pred))
        areas = np.array([[sweep.swept_areas(edges(*rings(x)), edges(*rings(y))) for y in p] for x in g])
        iou = areas[..., 2] / (areas[..., 0] + areas[..., 1] - areas[..., 2])
        for i, j in greatest(iou):
            if iou[i, j] >= 0.5:
                matched.append(slow_distances(rings(g[i]), rings(p[j])))
                holes = [band([x], [y]) >= 0.5 for x in g[i][4] for y in p[j][4]]
                exact += band([g[i][3]], [p[j][3]]) >= 0.5 and len(g[i][4]) == len(p[j][4]) and sum(holes) == len(g[i][4])
        for role, own in (("exterior", lambda x: [x[3]]), ("hole", lambda x: x[4])):
            u, v = ([r for x in s for r in own(x)] for s in (g, p))
            gain = np.array([[band([x], [y]) for y in v] for x in u]).reshape(len(u), len(v))
            found = [(u[i], v[j]) for i, j in greatest(gain) if gain[i, j] >= 0.5] if gain.size else []
            n = roles.setdefault(role, [0, 0, 0, []])
            n[0], n[1], n[2] = n[0] + len(found), n[1] + len(v) - len(found), n[2] + len(u) - len(found)
            n[3] += [slow_distances([x], [y]) for x, y in found]
            if role == "exterior":
                for x, y in found:
                    far = np.array([[math.dist(s, t) for t in y] for s in x])
                    for i, j in greatest(far.max() + 1 - far):
                        for t in hits:
                            hits[t] += far[i, j] <= t
    mean = lambda rows: [pytest.approx(np.nanmean([x[k] for x in rows])) for k in range(4)]
    one = evaluator.overall(a, b).first()
    assert len(matched) > 5 and [one[k] for k in ("matched", *evaluator.DISTANCES)] == [len(matched), *mean(matched)]
    for role, (tp, fp, fn, rows) in roles.items():
        x = evaluator.role_metrics(a, b, role).first()
        assert rows and [x[k] for k in ("tp", "fp", "fn", *evaluator.DISTANCES)] == [tp, fp, fn, *mean(rows)]
        assert x.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn))
    x = evaluator.topology(a, b).first()
    assert 0 < exact < len(matched) and (x.exact, x.total) == (exact, len(gt) + len(pred) - len(matched))
    for x in evaluator.corners(a, b, [2.0, 5.0]).collect():
        assert (x.tp, x.tp + x.fp, x.tp + x.fn) == (hits[x.threshold], 5 * len(pred), 5 * len(gt))
    assert evaluator.overall(a.limit(0), b).first().matched == 0 and evaluator.topology(a, b.limit(0)).first().exact == 0


def test_tangent_angles():
    r = np.random.default_rng(2)
    for _ in range(20):
        turn = np.linspace(0, 2 * np.pi, 8)[:-1]
        gt = [np.stack([15 * np.cos(turn), 11 * np.sin(turn)], axis=1) + r.uniform(-1, 1, (7, 2))]
        gt.append(gt[0] * 0.4)
        pred = [x + r.uniform(-1.5, 1.5, x.shape) for x in gt]
        want = slow_tangent_angle(*[[[tuple(p) for p in x.tolist()] for x in s] for s in (pred, gt)])
        assert contours.tangent_angle(pred, gt) == pytest.approx(want, abs=1e-6)
    square = [np.array(BOX, float)]
    assert contours.tangent_angle(square, square) == pytest.approx(0, abs=1e-6)
    assert math.isnan(contours.tangent_angle([np.array([(0, 0), (0.1, 0), (0, 0.1)])], [np.array([(50, 0), (60, 5), (60, -5)], float)]))


def test_rings_of_flat_columns_match_structs(spark):
    df = spark.createDataFrame([(1, 1, 0.5, [(0.0, 0.0), (4.0, 0.0), (0.0, 3.0)], [])], SCHEMA.format(key="ann_id"))
    assert df.select(R.flat(F.col("exterior")).alias("f")).first().f == [0, 0, 4, 0, 0, 3]


def test_convex_rings_are_told_from_others():
    def told(*tables):
        e = np.concatenate(tables)
        return planar.convex_rings(e, np.repeat(np.arange(len(tables)), list(map(len, tables)))), tables

    star = [(math.cos(4 * math.pi * k / 5), math.sin(4 * math.pi * k / 5)) for k in range(5)]  # turns one way, twice around
    found, tables = told(edges(BOX[::-1]), edges(star), edges(BOX, HOLE), edges([(0, 0), (10, 0), (5, 1e-9)]), edges([(0, 0), (9, 0), (1, 1), (0, 9)]), edges([(0, 0), (4, 0), (0, 3)]))
    assert found.owner.tolist() == [0, 5] and found.area.tolist() == [100, 6] and found.size.tolist() == [4, 3]
    for own, area in zip(found.owner, found.area, strict=True):
        assert [p[2] for p in planar.region([tables[own]], planar.odd)] == [pytest.approx(area)]
    r = np.random.default_rng(5)
    for _ in range(200):
        own = edges([tuple(p) for p in r.uniform(0, 9, (4, 2))])
        found, _ = told(own)
        if len(found.size):
            (part,) = planar.region([own], planar.odd)
            assert len(part[0]) == 4 and part[2] == pytest.approx(found.area[0])


def test_bands_of_many_rings_are_those_of_each():
    r = np.random.default_rng(6)
    rings = [r.uniform(0, 40, (n, 2)) for n in r.integers(1, 9, 60)] + [np.array(BOX, float), np.array([*BOX, BOX[-1], BOX[0]], float), np.zeros((4, 2)), np.array([(0, 0), (9, 0), (0, 0.01)], float)]
    found = contours.bands(rings)
    assert len(found) == len(rings) and all(np.array_equal(a, contours.band_edges(b)) for a, b in zip(found, rings, strict=True))
    assert contours.bands([]) == []
