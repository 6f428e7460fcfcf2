"""Areas of any polygons with holes: pairs come from Spark's join of bounding boxes, each pair's area from a slab sweep.

A polygon is what an odd number of its rings' edges encloses, so rings that cross themselves have a defined area and
the order and direction of rings do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.functions import rings as R
from annulus.operators import detection as D

#: Cells of a numpy table at most, so that it stays in a core's cache; longer polygons are swept in blocks.
CELLS = 1 << 17


def edge_list(exterior: Column, holes: Column) -> Column:
    """array<double>: ax, ay, bx, by of each edge of all rings; null for a null exterior."""
    rings = F.concat(F.array(exterior), F.coalesce(holes, F.expr("array()")))
    edge = lambda a, b: F.array(a["x"], a["y"], b["x"], b["y"])
    own = lambda ring: R.bound(ring, lambda r: F.flatten(F.zip_with(r, R.rotated(r), edge)))
    # without the condition, Spark 4.1 doesn't take an Arrow function of an exterior from ring_from_flat out of its projection
    return F.when(exterior.isNotNull(), F.flatten(F.transform(rings, own)))


def _crossings(e: np.ndarray) -> np.ndarray:
    """The y at which two edges cross."""
    found, d = [], e[:, 2:] - e[:, :2]
    step = max(1, CELLS // len(e))
    for i in range(0, len(e), step):
        part, dp = e[i : i + step, None, :2], d[i : i + step, None]
        across = dp[..., 0] * d[:, 1] - dp[..., 1] * d[:, 0]
        away = e[:, :2] - part
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (away[..., 0] * d[:, 1] - away[..., 1] * d[:, 0]) / across
            u = (away[..., 0] * dp[..., 1] - away[..., 1] * dp[..., 0]) / across
        hit = (across != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        found.append((part[..., 1] + t * dp[..., 1])[hit])
    return np.concatenate(found)


def _slab_areas(e: np.ndarray, of_a: np.ndarray, below: np.ndarray, above: np.ndarray, covered: bool = False) -> np.ndarray:
    """(pairs, 3) areas of a, b and both from edges (pairs, edges, 4) between heights (pairs, slabs).

    With ``covered``, what edges wind around at all is inside, else what an odd number of them encloses.
    """
    mid = ((below + above) / 2)[:, :, None]
    lo, hi = np.minimum(e[..., 1], e[..., 3])[:, None], np.maximum(e[..., 1], e[..., 3])[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = ((e[..., 2] - e[..., 0]) / (e[..., 3] - e[..., 1]))[:, None]
        x = e[:, None, :, 0] + (mid - e[:, None, :, 1]) * slope
    # every end is a slab's bound, so this counts an even number of each polygon's edges, however thin the slab
    live = (lo <= below[:, :, None]) & (hi >= above[:, :, None]) & (below < above)[:, :, None]
    x = np.where(live, x, np.inf)
    order = np.argsort(x, axis=2, kind="stable")
    x, live = np.take_along_axis(x, order, 2), np.take_along_axis(live, order, 2)
    mine = np.take_along_axis(np.broadcast_to(of_a[:, None], x.shape), order, 2)
    if covered:
        way = np.take_along_axis(np.broadcast_to(np.sign(e[..., 3] - e[..., 1])[:, None], x.shape), order, 2)
        in_a, in_b = (np.cumsum(np.where(live & k, way, 0), axis=2) != 0 for k in (mine, ~mine))
    else:
        in_a, in_b = (np.cumsum(live & k, axis=2) % 2 == 1 for k in (mine, ~mine))
    with np.errstate(invalid="ignore"):
        width = x[:, :, 1:] - x[:, :, :-1]
    # no edges cross inside a slab, so the width half way up times its height is exact
    areas = [np.where(k[:, :, :-1], width, 0.0).sum(axis=2) * (above - below) for k in (in_a, in_b, in_a & in_b)]
    return np.stack([k.sum(axis=1) for k in areas], axis=1)


def swept_areas(a: np.ndarray, b: np.ndarray, covered: bool = False) -> tuple[float, float, float]:
    """Area of a, of b and of what both enclose; a and b are tables of edges (ax, ay, bx, by)."""
    e, of_a = np.concatenate([a, b]), np.arange(len(a) + len(b)) < len(a)
    level = e[:, 1] == e[:, 3]
    e, of_a = e[~level], of_a[~level]
    if not len(e):
        return 0.0, 0.0, 0.0
    ys = np.unique(np.concatenate([e[:, 1], e[:, 3], _crossings(e)]))[None]
    step = max(1, CELLS // len(e))
    blocks = [ys[:, i : i + step + 1] for i in range(0, ys.shape[1] - 1, step)]
    return tuple(sum(_slab_areas(e[None], of_a[None], y[:, :-1], y[:, 1:], covered)[0] for y in blocks).tolist())


def _swept_together(e: np.ndarray, of_a: np.ndarray, covered: bool = False) -> np.ndarray:
    """swept_areas of many pairs of as many edges each; (pairs, edges, 4), (pairs, edges) -> (pairs, 3)."""
    d, (i, j) = e[..., 2:] - e[..., :2], np.triu_indices(e.shape[1], 1)
    across, away = d[:, i, 0] * d[:, j, 1] - d[:, i, 1] * d[:, j, 0], e[:, j, :2] - e[:, i, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (away[..., 0] * d[:, j, 1] - away[..., 1] * d[:, j, 0]) / across
        u = (away[..., 0] * d[:, i, 1] - away[..., 1] * d[:, i, 0]) / across
        hit = (across != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        meet = np.where(hit, e[:, i, 1] + t * d[:, i, 1], e[:, i, 1])
    ys = np.sort(np.concatenate([e[..., 1], e[..., 3], meet], axis=1), axis=1)
    fresh = np.diff(ys, axis=1, prepend=-np.inf) > 0
    most = fresh.sum(axis=1).max(initial=1)  # heights that repeat bound no slab
    ys = np.sort(np.where(fresh, ys, ys[:, -1:]), axis=1)[:, :most]
    step = max(1, CELLS // max(1, e.shape[1] * most))
    return np.concatenate([_slab_areas(e[i : i + step], of_a[i : i + step], ys[i : i + step, :-1], ys[i : i + step, 1:], covered) for i in range(0, len(e), step)])


#: Pairs of so many edges at most are swept together, filled up to the next multiple of 4 with edges of no height.
FEW = 24


def swept_batch(left: list, right: list, covered: bool = False, few: int = FEW) -> np.ndarray:
    """swept_areas of each pair of edge lists, nan where one is null."""
    out, alike = np.full((len(left), 3), np.nan), {}
    for k, (a, b) in enumerate(zip(left, right, strict=True)):
        if a is None or b is None:
            continue
        n = len(a) // 4 + len(b) // 4
        if n > few:
            out[k] = swept_areas(*(np.asarray(v, dtype="float64").reshape(-1, 4) for v in (a, b)), covered)
        else:
            alike.setdefault(-(-n // 4) * 4, []).append((k, a, b))
    for n, pairs in alike.items():
        step = max(1, CELLS // max(1, n * n))
        for i in range(0, len(pairs) if n else 0, step):
            part = pairs[i : i + step]
            e, of_a = np.zeros((len(part), n * 4)), np.zeros((len(part), n), dtype=bool)
            for row, (_, a, b) in enumerate(part):
                e[row, : len(a)], e[row, len(a) : len(a) + len(b)], of_a[row, : len(a) // 4] = a, b, True
            out[[p[0] for p in part]] = _swept_together(e.reshape(-1, n, 4), of_a, covered)
        if not n:
            out[[p[0] for p in pairs]] = 0.0
    return out


def _areas(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for left, right in batches:
        yield pd.DataFrame(swept_batch(list(left), list(right)), columns=["a", "b", "both"])


def overlap(exterior_a: Column, holes_a: Column, exterior_b: Column, holes_b: Column) -> Column:
    """struct<a, b, both>: both areas and the shared one; nulls where an exterior is null, 0 for rings without area."""
    return edge_overlap(edge_list(exterior_a, holes_a), edge_list(exterior_b, holes_b))


def edge_overlap(a: Column, b: Column) -> Column:
    """The same from edge lists. Marked nondeterministic, so that a condition on it doesn't sweep every pair again."""
    return F.pandas_udf(_areas, "a double, b double, both double").asNondeterministic()(a, b)


def with_box(polygons: DataFrame) -> DataFrame:
    """polygons with x0, y0, x1, y1 of the exterior; rows without one go."""
    side = lambda f, k: f(F.transform("exterior", lambda p: p[k]))
    boxed = polygons.withColumns({"x0": side(F.array_min, "x"), "y0": side(F.array_min, "y"), "x1": side(F.array_max, "x"), "y1": side(F.array_max, "y")})
    return boxed.where("x0 is not null")


def polygon_pairs(gt: DataFrame, pred: DataFrame, least: float = 1e-9) -> DataFrame:
    """image_id, ann_id, pred_id, score, inter, g_area, p_area, iou of polygons of an image that share over ``least``."""
    c = F.col
    keep = ["image_id", "x0", "y0", "x1", "y1", edge_list(c("exterior"), c("holes")).alias("edges")]
    pairs = D.overlapping(with_box(gt).select("ann_id", *keep), with_box(pred).select("pred_id", "score", *keep))
    swept = pairs.withColumn("o", edge_overlap(c("g_edges"), c("p_edges")))
    out = swept.select("image_id", c("g_ann_id").alias("ann_id"), c("p_pred_id").alias("pred_id"), c("p_score").alias("score"), c("o.both").alias("inter"), c("o.a").alias("g_area"), c("o.b").alias("p_area"))
    return out.where(c("inter") > least).withColumn("iou", c("inter") / (c("g_area") + c("p_area") - c("inter")))


def self_crossings(rings: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """key, edges, crossings of every ring: pairs of its edges, not neighbours, that cross inside both."""
    e = rings.select(key, F.size(ring).alias("edges"), F.posexplode(R.edges(F.col(ring))).alias("i", "e"))
    c = F.col
    side = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    a, b, p, q = c("e.a"), c("e.b"), c("f.a"), c("f.b")
    apart = (c("j") > c("i") + 1) & ~((c("i") == 0) & (c("j") == c("edges") - 1))
    near = (F.least(a["x"], b["x"]) < F.greatest(p["x"], q["x"])) & (F.least(p["x"], q["x"]) < F.greatest(a["x"], b["x"]))
    meet = (side(a, b, p) * side(a, b, q) < 0) & (side(p, q, a) * side(p, q, b) < 0)
    found = e.join(e.select(key, c("i").alias("j"), c("e").alias("f")), key).where(apart & near & meet).groupBy(key).agg(F.count("*").alias("n"))
    sizes = rings.select(key, F.size(ring).alias("edges"))
    return sizes.join(found, key, "left").select(key, "edges", F.coalesce("n", F.lit(0)).cast("long").alias("crossings"))
