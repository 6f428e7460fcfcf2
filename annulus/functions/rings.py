"""Ring functions as column expressions. A ring is an open ``array<struct<x double, y double>>``."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def bound(value: Column, use) -> Column:
    """use(value), with value evaluated once: what array functions name several times, or inside a lambda, Spark evaluates each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rotated(ring: Column, by: int = 1) -> Column:
    """The ring begun ``by`` vertices later."""
    return bound(ring, lambda r: F.concat(F.slice(r, F.lit(by + 1), F.size(r)), F.slice(r, F.lit(1), F.lit(by))))


def edges(ring: Column) -> Column:
    """array<struct<a, b>>, the last edge closing the ring."""
    return bound(ring, lambda r: F.zip_with(r, rotated(r), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def is_closed(ring: Column, tol: float = 1e-6) -> Column:
    """First and last vertex are the same within ``tol`` and a relative 1e-5."""
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    near = lambda c: F.abs(first[c] - last[c]) <= tol + 1e-5 * F.abs(last[c])
    return near("x") & near("y")


def ring_from_flat(flat: Column) -> Column:
    """[x1, y1, x2, y2, ...] -> open ring; null for odd lengths, fewer than 6 numbers or fewer than 3 open vertices."""

    def read(f: Column) -> Column:
        n = F.size(f)
        points = F.transform(F.sequence(F.lit(0), (n / 2).cast("int") - 1), lambda i: point(f[2 * i], f[2 * i + 1]))
        opened = bound(points, lambda r: F.when(is_closed(r), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r))
        return F.when((n >= 6) & (n % 2 == 0), bound(opened, lambda r: F.when(F.size(r) >= 3, r)))

    return bound(flat, read)


def close_ring(ring: Column) -> Column:
    return bound(ring, lambda r: F.when(is_closed(r), r).otherwise(F.concat(r, F.slice(r, F.lit(1), F.lit(1)))))


def flat(ring: Column) -> Column:
    return F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["y"])))


def signed_area(ring: Column) -> Column:
    """Shoelace; positive for counter-clockwise with y up."""
    return total(F.transform(edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def polygon_area(exterior: Column, holes: Column) -> Column:
    return ring_area(exterior) - total(F.transform(holes, ring_area))


def ring_perimeter(ring: Column) -> Column:
    return total(F.transform(edges(ring), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))


def ring_bbox(ring: Column) -> Column:
    """struct<x0, y0, x1, y1>."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def turning(ring: Column) -> Column:
    """Sum of (x2 - x1)(y2 + y1); positive for a ring that is clockwise with y up."""
    return total(F.transform(edges(ring), lambda e: (e["b"]["x"] - e["a"]["x"]) * (e["b"]["y"] + e["a"]["y"])))


def orient_ring(ring: Column, clockwise: bool = True) -> Column:
    return bound(ring, lambda r: F.when((turning(r) > 0) == F.lit(clockwise), r).otherwise(F.reverse(r)))


def resort_corners(ring: Column) -> Column:
    """Clockwise, begun at the vertex nearest the origin (the first of these)."""

    def begun(r: Column) -> Column:
        nearest = bound(F.transform(r, lambda p: p["x"] * p["x"] + p["y"] * p["y"]), lambda far: F.array_position(far, F.array_min(far)).cast("int"))
        return bound(nearest, lambda at: F.concat(F.slice(r, at, F.size(r)), F.slice(r, F.lit(1), at - 1)))

    return bound(orient_ring(ring), begun)


def remove_redundant_vertices(ring: Column, eps: float = 0.1) -> Column:
    """Drops a vertex whose next one is within eps."""
    kept = F.filter(edges(ring), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]) > eps)
    return F.transform(kept, lambda e: e["a"])


def drop_repeats(ring: Column) -> Column:
    """Drops a vertex equal to the one before it, the first compared with the last."""
    kept = F.filter(F.zip_with(rotated(ring), ring, lambda b, a: F.struct(a.alias("a"), b.alias("b"))), lambda e: e["a"] != e["b"])
    return F.transform(kept, lambda e: e["a"])


def pad_ring(ring: Column, n: int) -> tuple[Column, Column]:
    """(n vertices, the last repeated or cut; labels 1 for own ones, 0 for padding)."""
    size = F.size(ring)
    more = F.greatest(F.lit(n) - size, F.lit(0))
    padded = F.slice(F.concat(ring, F.array_repeat(F.element_at(ring, -1), more)), F.lit(1), F.lit(n))
    labels = F.concat(F.array_repeat(F.lit(1), F.least(size, F.lit(n))), F.array_repeat(F.lit(0), more))
    return padded, labels


def mapped(ring: Column, x, y) -> Column:
    """Each vertex p replaced by (x(p), y(p))."""
    return F.transform(ring, lambda p: point(x(p), y(p)))


def clip_ring(ring: Column, width: float, height: float) -> Column:
    bound = lambda v, most: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), v))
    return mapped(ring, lambda p: bound(p["x"], width), lambda p: bound(p["y"], height))


def translate(ring: Column, dx: Column, dy: Column) -> Column:
    return mapped(ring, lambda p: p["x"] + dx, lambda p: p["y"] + dy)


def affine(ring: Column, a, b, c, d, e, f) -> Column:
    """x' = a x + b y + c, y' = d x + e y + f."""
    return mapped(ring, lambda p: p["x"] * a + p["y"] * b + c, lambda p: p["x"] * d + p["y"] * e + f)


def d4(ring: Column, mode: int, width: float, height: float) -> Column:
    """The eight symmetries of an image: bit 0 mirrors x, bit 1 mirrors y, bit 2 swaps the axes first."""
    swapped = mode & 4
    x = (lambda p: p["y"]) if swapped else (lambda p: p["x"])
    y = (lambda p: p["x"]) if swapped else (lambda p: p["y"])
    w, h = (height, width) if swapped else (width, height)
    return mapped(ring, lambda p: F.lit(float(w)) - x(p) if mode & 1 else x(p), lambda p: F.lit(float(h)) - y(p) if mode & 2 else y(p))


def ring_diameter(ring: Column) -> Column:
    return F.array_max(F.flatten(F.transform(ring, lambda p: F.transform(ring, lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])))))


def vertex_angles(ring: Column) -> Column:
    """Interior angle at each vertex, in degrees."""

    def angle(t):
        ax, ay = t["p"]["x"] - t["v"]["x"], t["p"]["y"] - t["v"]["y"]
        bx, by = t["n"]["x"] - t["v"]["x"], t["n"]["y"] - t["v"]["y"]
        cosine = (ax * bx + ay * by) / (F.hypot(ax, ay) * F.hypot(bx, by) + 1e-6)
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))

    before = F.concat(F.slice(ring, F.lit(-1), F.lit(1)), F.slice(ring, F.lit(1), F.size(ring) - 1))
    return F.transform(F.arrays_zip(before.alias("p"), ring.alias("v"), rotated(ring).alias("n")), angle)


def sample_ring(ring: Column, spacing: float) -> Column:
    """Points along the ring: each edge in max(1, round-half-even(length / spacing)) equal steps, joints once."""

    def along(e):
        steps = F.greatest(F.lit(1.0), F.bround(F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]) / spacing))
        return F.transform(F.sequence(F.lit(0), steps.cast("int") - 1), lambda i: point(e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * i / steps, e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * i / steps))

    return F.flatten(F.transform(edges(ring), along))


def sample_to_n(ring: Column, n: int) -> Column:
    """n vertices at indices floor(i * size / n); a ring of n or fewer stays."""
    size = F.size(ring)
    return F.when(size <= n, ring).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(ring, F.floor(i * size / n).cast("int"))))


def quantise(ring: Column, width: float, height: float, bins: int) -> Column:
    """Coordinates as whole numbers from 0 to bins - 1, rounded half to even, x before y."""
    q = lambda v, most: F.bround(v / most * (bins - 1)).cast("int")
    return F.flatten(F.transform(ring, lambda p: F.array(q(p["x"], width), q(p["y"], height))))


def tokenise(ring: Column, width: float, height: float, bins: int, max_len: int) -> Column:
    """BOS (bins), coordinates, EOS (bins + 1), padding (bins + 2) up to max_len."""
    body = F.slice(F.concat(F.array(F.lit(bins)), quantise(ring, width, height, bins), F.array(F.lit(bins + 1))), F.lit(1), F.lit(max_len))
    return F.concat(body, F.array_repeat(F.lit(bins + 2), F.greatest(F.lit(max_len) - F.size(body), F.lit(0))))


def detokenise(tokens: Column, width: float, height: float, bins: int) -> Column:
    """The ring of tokenise, on the grid of bins."""
    own = F.filter(tokens, lambda t: t < bins)
    return F.transform(F.sequence(F.lit(0), (F.size(own) / 2).cast("int") - 1), lambda i: point(own[2 * i] * F.lit(width / (bins - 1)), own[2 * i + 1] * F.lit(height / (bins - 1))))


def convex_hull_size(ring: Column) -> Column:
    """Vertices at which the ring turns the way it runs; all of them for a convex ring."""
    way = F.signum(signed_area(ring))
    before = F.concat(F.slice(ring, F.lit(-1), F.lit(1)), F.slice(ring, F.lit(1), F.size(ring) - 1))
    cross = lambda t: (t["v"]["x"] - t["p"]["x"]) * (t["n"]["y"] - t["v"]["y"]) - (t["v"]["y"] - t["p"]["y"]) * (t["n"]["x"] - t["v"]["x"])
    return F.size(F.filter(F.arrays_zip(before.alias("p"), ring.alias("v"), rotated(ring).alias("n")), lambda t: cross(t) * way > 0))


def convex_corners(ring: Column) -> Column:
    """Whether the ring turns the way it runs, for each vertex."""
    way = F.signum(signed_area(ring))
    before = F.concat(F.slice(ring, F.lit(-1), F.lit(1)), F.slice(ring, F.lit(1), F.size(ring) - 1))
    cross = lambda t: (t["v"]["x"] - t["p"]["x"]) * (t["n"]["y"] - t["v"]["y"]) - (t["v"]["y"] - t["p"]["y"]) * (t["n"]["x"] - t["v"]["x"])
    return F.transform(F.arrays_zip(before.alias("p"), ring.alias("v"), rotated(ring).alias("n")), lambda t: cross(t) * way > 0)


def edge_lengths(ring: Column) -> Column:
    return F.transform(edges(ring), lambda e: F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], 2) + F.pow(e["b"]["y"] - e["a"]["y"], 2)))


def edge_angles(ring: Column) -> Column:
    """Direction of each edge in radians, from 0 to a full turn."""
    return F.transform(edges(ring), lambda e: F.pmod(F.atan2(e["b"]["y"] - e["a"]["y"], e["b"]["x"] - e["a"]["x"]) + FULL_TURN, F.lit(FULL_TURN)))


def without_slight_turns(ring: Column, degrees: float = 10.0) -> Column:
    """The ring without vertices at which the heading changes by so many degrees or less, all judged on the ring as it is."""
    heading = edge_angles(ring)
    before = F.concat(F.slice(heading, F.size(heading), F.lit(1)), heading)
    change = F.zip_with(ring, F.zip_with(heading, F.slice(before, F.lit(1), F.size(heading)), lambda a, b: F.abs(a - b)), lambda p, d: F.struct(p.alias("p"), d.alias("d")))
    least = math.radians(degrees)
    return F.transform(F.filter(change, lambda v: (v["d"] > least) & (v["d"] < FULL_TURN - least)), lambda v: v["p"])


def densify(ring: Column, gap: float) -> Column:
    """The ring with points put in at equal steps, so that no two neighbours are more than ``gap`` apart."""

    def steps(e):
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        n = F.greatest(F.ceil(F.sqrt(dx * dx + dy * dy) / gap), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: point(e["a"]["x"] + dx * i / n, e["a"]["y"] + dy * i / n))

    return F.flatten(F.transform(edges(ring), steps))


def least_shift_distance(a: Column, b: Column) -> Column:
    """Least mean distance of vertices over all cyclic shifts of b; the shorter ring's last vertex is repeated. Null for none."""
    n = F.greatest(F.size(a), F.size(b))
    filled = lambda r: F.concat(r, F.array_repeat(F.element_at(r, -1), n - F.size(r)))
    away = lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))
    shifted = lambda k: F.zip_with(filled(a), rotated(filled(b), k), away)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.array_min(F.transform(F.sequence(F.lit(0), n - 1), lambda k: total(shifted(k)) / n)))


def city_of(name: Column) -> Column:
    """A tile's city: its stem without trailing digits."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"\d+$", "")


def point_segment(px: Column, py: Column, e: Column) -> Column:
    """Distance from a point to the segment e<a, b>."""
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - e["a"]["x"]) * dx + (py - e["a"]["y"]) * dy) / square)))
    return F.sqrt(F.pow(px - (e["a"]["x"] + t * dx), 2) + F.pow(py - (e["a"]["y"] + t * dy), 2))


COMBINATIONS = 1 << 21


def _nearest(px, py, counts, sx, sy, ex, ey, segments) -> np.ndarray:
    """Mean distance of each item's points to its nearest segment; items are runs of points and of segments."""
    out = np.zeros(len(counts))
    first_point, first_segment = np.cumsum(counts) - counts, np.cumsum(segments) - segments
    item = np.repeat(np.arange(len(counts)), counts)
    each = segments[item]
    done = np.cumsum(each)
    lo = 0
    while lo < len(item):  # as many points at a time as make COMBINATIONS with their segments, one at least
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + COMBINATIONS, side="right")))
        own = each[lo:hi]
        begin = np.cumsum(own) - own
        p = np.repeat(np.arange(lo, hi), own)
        s = first_segment[item[p]] + np.arange(len(p)) - np.repeat(begin, own)
        dx, dy, x, y = ex[s] - sx[s], ey[s] - sy[s], px[p] - sx[s], py[p] - sy[s]
        square = dx * dx + dy * dy
        t = np.clip((x * dx + y * dy) / np.where(square == 0, 1, square), 0, 1)
        far = np.sqrt(np.minimum.reduceat((x - t * dx) ** 2 + (y - t * dy) ** 2, begin))
        np.add.at(out, item[lo:hi], far)
        lo = hi
    return out / counts


def polis(rings_a: Column, rings_b: Column) -> Column:
    """Half the mean distance of A's vertices to B's boundary plus that of B's to A's; all rings pooled. Null for none.

    An Arrow-batched kernel over all pairs of a batch, in steps of COMBINATIONS distances.
    """

    @F.pandas_udf("double")
    def kernel(ax: pd.Series, ay: pd.Series, au: pd.Series, av: pd.Series, bx: pd.Series, by: pd.Series, bu: pd.Series, bv: pd.Series) -> pd.Series:
        n, m = (np.array([0 if v is None else len(v) for v in s], np.int64) for s in (ax, bx))
        ok = (n > 0) & (m > 0)
        if not ok.any():
            return pd.Series([None] * len(n), dtype="float64")
        a, b = ([np.concatenate(s[ok].to_list()) for s in side] for side in ((ax, ay, au, av), (bx, by, bu, bv)))
        found = np.full(len(n), np.nan)
        found[ok] = (_nearest(*a[:2], n[ok], *b, m[ok]) + _nearest(*b[:2], m[ok], *a, n[ok])) / 2
        return pd.Series(found).where(ok, None)

    def sides(rings: Column) -> list[Column]:
        every = F.flatten(F.transform(rings, edges))
        return [F.transform(every, lambda e: e[p][k]) for p, k in (("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"))]  # noqa: B023

    return kernel(*sides(rings_a), *sides(rings_b))


def hausdorff(a: Column, b: Column, share: float = 1.0) -> Column:
    """The greater of both directed distances between point arrays, each the quantile ``share`` of nearest ones. Null for none.

    An Arrow-batched kernel: nested array functions run interpreted, for each of the size(a) * size(b) distances.
    """

    @F.pandas_udf("double")
    def kernel(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
        def pair(px, py, qx, qy):
            if px is None or qx is None or not len(px) or not len(qx):
                return None
            d = np.hypot(np.subtract.outer(px, qx), np.subtract.outer(py, qy))
            return max(np.quantile(d.min(axis=1), share), np.quantile(d.min(axis=0), share))

        return pd.Series([pair(*v) for v in zip(ax, ay, bx, by, strict=True)], dtype="float64")

    side = lambda ring, k: F.transform(ring, lambda p: p[k])
    return kernel(side(a, "x"), side(a, "y"), side(b, "x"), side(b, "y"))


FULL_TURN = 2 * math.pi


def strip_closing_vertex(ring: Column, eps: float = 1.0) -> Column:
    """Without the last vertex where it is nearer than eps to the first, by the sum of both differences."""
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    near = F.abs(first["x"] - last["x"]) + F.abs(first["y"] - last["y"]) < eps
    return F.when((F.size(ring) > 1) & near, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def scale_to_window(ring: Column, width: float, height: float, window: int) -> Column:
    """Whole coordinates in a square window, half to even, clipped, without repeats; null for fewer than three vertices."""
    whole = lambda v, size: F.greatest(F.lit(0.0), F.least(F.lit(window - 1.0), F.bround(v * F.lit(window / size))))
    kept = drop_repeats(mapped(ring, lambda p: whole(p["x"], width), lambda p: whole(p["y"], height)))
    return F.when(F.size(kept) >= 3, kept)


def on_boundary(ring: Column, px: Column, py: Column) -> Column:
    def touches(e):
        a, b = e["a"], e["b"]
        level = (b["x"] - a["x"]) * (py - a["y"]) == (b["y"] - a["y"]) * (px - a["x"])
        return level & px.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & py.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return F.exists(edges(ring), touches)


def inside(ring: Column, px: Column, py: Column) -> Column:
    """By an odd number of edges that a ray to the right crosses; points of the boundary may count either way."""

    def crossed(e):
        a, b = e["a"], e["b"]
        return ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / F.when(a["y"] == b["y"], F.lit(1.0)).otherwise(b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(edges(ring), crossed)) % 2 == 1


def covers(exterior: Column, holes: Column, px: Column, py: Column) -> Column:
    """Whether the polygon holds the point, its boundary (of holes too) included."""
    bound = F.exists(F.concat(F.array(exterior), holes), lambda r: on_boundary(r, px, py))
    return bound | (inside(exterior, px, py) & ~F.exists(holes, lambda r: inside(r, px, py)))


def same_outline(a: Column, b: Column, tol: float = 0.02, vertices: int = 4) -> Column:
    """As many vertices, and the first ones nearer than tol in both directions."""
    near = lambda p, q: (F.abs(p["x"] - q["x"]) < tol) & (F.abs(p["y"] - q["y"]) < tol)
    first = F.zip_with(F.slice(a, F.lit(1), F.lit(vertices)), F.slice(b, F.lit(1), F.lit(vertices)), near)
    return (F.size(a) == F.size(b)) & F.forall(first, lambda x: F.coalesce(x, F.lit(False)))


def best_roll(a: Column, b: Column) -> Column:
    """struct<cost, shift>: the least sum of distances from a's vertices to those of b rolled by a shift, and the smallest shift whose sum is
    the same up to six digits.

    Rings of one size; of their shifts the last is not tried. Distances are added from b's last vertex to its first, whatever the shift.
    """
    n = F.size(b)
    apart = lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))
    cost = lambda s: total(F.reverse(F.zip_with(F.concat(F.slice(a, n - s + 1, s), F.slice(a, F.lit(1), n - s)), b, apart)))
    tried = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda s: F.struct(cost(s).alias("cost"), s.alias("shift")))
    least = lambda t: F.struct(F.array_min(F.transform(t, lambda r: r["cost"])).alias("cost"), F.array_min(F.transform(t, lambda r: F.struct(F.round(r["cost"], 6).alias("cost"), r["shift"].alias("shift"))))["shift"].alias("shift"))
    return F.get(F.transform(F.array(tried), least), F.lit(0))


def polis_single(a: Column, b: Column) -> Column:
    """Distances of each ring's vertices to the other's boundary, summed and divided by twice the closed ring's vertices.

    An Arrow-batched kernel over all pairs of a batch, as polis. Null where a ring is null or one alone has no vertices.
    """

    @F.pandas_udf("double")
    def kernel(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
        known = np.array([x is not None and y is not None for x, y in zip(ax, bx, strict=True)], bool)
        n, m = (np.array([0 if v is None else len(v) for v in s], np.int64) for s in (ax, bx))
        found = np.zeros(len(n))
        ok = known & (n > 0) & (m > 0)
        if ok.any():
            (px, py), (qx, qy) = ([np.concatenate(s[ok].to_list()) for s in side] for side in ((ax, ay), (bx, by)))
            k, j = n[ok], m[ok]
            p, q = _after(k), _after(j)
            found[ok] = _nearest(px, py, k, qx, qy, qx[q], qy[q], j) * k / (2 * (k + 1)) + _nearest(qx, qy, j, px, py, px[p], py[p], k) * j / (2 * (j + 1))
        return pd.Series(found).where(known & ((n > 0) == (m > 0)), None)

    side = lambda ring, k: F.transform(ring, lambda p: p[k])
    return kernel(side(a, "x"), side(a, "y"), side(b, "x"), side(b, "y"))


def _after(sizes: np.ndarray) -> np.ndarray:
    """For rings laid end to end, where each vertex's next one is."""
    at = np.arange(1, sizes.sum() + 1)
    ends = np.cumsum(sizes)
    at[ends - 1] = ends - sizes
    return at
