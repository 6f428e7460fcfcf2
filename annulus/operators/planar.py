"""Planar subdivisions: repair, clipping and union of any polygons with holes, as exact parts.

Edges are split where they meet. Each piece of an edge says what lies on both of its sides by how often the layers wind around
there; pieces with the asked region on one side only are its boundary. They are followed with the region on their left,
turning so that the same corner of the region is gone around, and rings that meet themselves are taken apart there, so that
parts touch in points at most, as do a part's rings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.functions import rings as R
from annulus.operators.sweep import edge_list, with_box

#: Pairs of edges in one step: what they take stays in a core's cache.
PAIRS = 1 << 16
#: Points nearer than this share of the extent are one.
NEAR = 1e-9
Part = tuple[np.ndarray, list[np.ndarray], float]


def _pairs(own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each i with each j of the same owner (owners are in order), as arrays of bounded length, whole runs of j for each i."""
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    sizes = np.diff(np.r_[starts, len(own)])
    first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    ends = np.cumsum(size)
    at = 0
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS)))
        n = size[at:to]
        i = np.repeat(np.arange(at, to), n)
        yield i, np.repeat(first[at:to], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = to


def _side(u: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    return u[:, 0] * py - u[:, 1] * px


def _meetings(e: np.ndarray, own: np.ndarray, tol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges, shares of them and points at which they meet others of their owner inside: ends of others, and crossings."""
    edge, share, point = [], [], []
    d, size = e[:, 2:] - e[:, :2], np.hypot(e[:, 2] - e[:, 0], e[:, 3] - e[:, 1])
    for i, j in _pairs(own):
        di, dj, near = d[i], d[j], tol[i]
        ax, ay = e[j, 0] - e[i, 0], e[j, 1] - e[i, 1]
        over, under = _side(di, ax, ay) / size[i], _side(di, e[j, 2] - e[i, 0], e[j, 3] - e[i, 1]) / size[i]
        along = (ax * di[:, 0] + ay * di[:, 1]) / size[i]
        on = (np.abs(over) <= near) & (along > near) & (along < size[i] - near)  # each corner begins one edge
        edge.append(i[on]), share.append(along[on] / size[i[on]]), point.append(e[j[on], :2])
        # an end that lies on the other edge is no crossing, and edges along one line have none
        hit = np.flatnonzero((i < j) & (over * under < 0) & (np.minimum(np.abs(over), np.abs(under)) > near))
        i, j, dj, near, over, under = i[hit], j[hit], dj[hit], near[hit], over[hit], under[hit]
        mine, other = (_side(dj, e[i, k] - e[j, 0], e[i, k + 1] - e[j, 1]) / size[j] for k in (0, 2))
        hit = (mine * other < 0) & (np.minimum(np.abs(mine), np.abs(other)) > near)
        i, j, t, u = i[hit], j[hit], (mine / np.where(hit, mine - other, 1))[hit], (over / (over - under))[hit]
        meet = e[i, :2] + t[:, None] * d[i]
        edge += [i, j]
        share += [t, u]
        point += [meet, meet]
    return np.concatenate(edge), np.concatenate(share), np.concatenate(point)


def _same_points(points: np.ndarray, own: np.ndarray, tol: np.ndarray) -> np.ndarray:
    """For each point the least index of its owner's points that it is one with: they share a cell of one of four shifted grids."""
    label = np.arange(len(points))
    cells = []
    for shift in ((0, 0), (0.5, 0), (0, 0.5), (0.5, 0.5)):
        x, y = np.floor(points / (2 * tol[:, None]) + shift).T
        order = np.lexsort((y, x, own))
        fresh = (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0) | (np.diff(own[order]) != 0)
        cell = np.empty(len(points), int)
        cell[order] = np.r_[0, np.cumsum(fresh)]
        cells.append(cell)
    while True:
        before = label
        for cell in cells:
            least = np.full(cell.max(initial=-1) + 1, len(points))
            np.minimum.at(least, cell, label)
            label = least[cell]
        if (label == before).all():
            return label


def _pieces(e: np.ndarray, own: np.ndarray, layer: np.ndarray, layers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points, the pieces of all edges (lower index first) in their owners' order, how often each layer runs along them in that
    direction, and their owners."""
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    spread = np.maximum.reduceat(np.abs(e - e[starts[np.cumsum(np.r_[True, own[1:] != own[:-1]]) - 1]][:, [0, 1, 0, 1]]).max(axis=1), starts)
    tol = np.repeat(NEAR * np.maximum(spread, 1e-300), np.diff(np.r_[starts, len(e)]))
    longer = np.hypot(e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]) > tol
    e, own, layer, tol = e[longer], own[longer], layer[longer], tol[longer]
    if not len(e):
        return np.zeros((0, 2)), np.zeros((0, 2), int), np.zeros((0, layers), int), own
    edge, share, point = _meetings(e, own, tol)
    n = np.arange(len(e))
    edge, share = np.concatenate([n, n, edge]), np.concatenate([0.0 * n, 0.0 * n + 1, share])
    points = np.concatenate([e[:, :2], e[:, 2:], point])
    node = _same_points(points, own[edge], tol[edge])
    order = np.lexsort((share, edge))
    edge, node = edge[order], node[order]
    on = (edge[1:] == edge[:-1]) & (node[1:] != node[:-1])
    a, b, of = node[:-1][on], node[1:][on], edge[:-1][on]
    keys, first, at = np.unique((own[of] * len(points) + np.minimum(a, b)) * len(points) + np.maximum(a, b), return_index=True, return_inverse=True)
    runs = np.zeros((len(keys), layers), int)
    np.add.at(runs, (at.ravel(), layer[of]), np.where(a < b, 1, -1))
    return points, np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[first], runs, own[of][first]


def _windings(a: np.ndarray, b: np.ndarray, runs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each layer winds around what lies left of and right of each piece, as its ends a, b are given, lower end first."""
    slope, middle = (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]), (a + b) / 2
    left = np.zeros_like(runs)
    for i, j in _pairs(own):
        x, y = middle[i].T
        west = (a[j, 1] <= y) & (b[j, 1] > y) & (a[j, 0] + (y - a[j, 1]) * slope[j] < x) & (i != j)
        np.subtract.at(left, i[west], runs[j[west]])
    return left, left - runs


def _turned(points: np.ndarray, pieces: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of each piece, turned for each owner so that none of its pieces is level, as far from it as can be had."""
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    size = np.diff(np.r_[starts, len(own)])
    a, b = points[pieces[:, 0]], points[pieces[:, 1]]
    d = (b - a) / np.hypot(*(b - a).T)[:, None]
    turns = np.array([0.3, 0.7, 1.1, 1.9, 2.3])
    steep = [np.minimum.reduceat(np.abs(d[:, 0] * np.sin(t) + d[:, 1] * np.cos(t)), starts) for t in turns]
    best = np.repeat(turns[np.argmax(steep, axis=0)], size)
    c, s = np.cos(best), np.sin(best)
    return tuple(np.stack([p[:, 0] * c - p[:, 1] * s, p[:, 0] * s + p[:, 1] * c], axis=1) for p in (a, b))


def _followed(points: np.ndarray, a: np.ndarray, b: np.ndarray, across: bool = False) -> list[list[int]]:
    """Closed walks along the directed pieces a, b that keep to one corner of what lies on their left; or, with ``across``, to one
    corner of what lies on their right, so that what meets in a point hangs together."""
    n = len(a)
    out = points[b] - points[a]
    turn = np.arctan2(np.r_[out[:, 1], -out[:, 1]] + 0.0, np.r_[out[:, 0], -out[:, 0]] + 0.0)  # -0.0 would turn the other way
    node = np.concatenate([a, b])
    order = np.lexsort((turn if across else -turn, node))  # clockwise around each point: the first n of these leave it, the others arrive
    leaves, at = order < n, np.arange(2 * n)
    following = np.minimum.accumulate(np.where(leaves, at, 2 * n)[::-1])[::-1]
    first = np.flatnonzero(np.r_[True, node[order][1:] != node[order][:-1]])
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, 2 * n]))
    chosen = np.where(following < np.r_[first[1:], 2 * n][group], following, following[first][group])
    next_of = np.zeros(n, int)
    next_of[order[~leaves] - n] = order[chosen[~leaves]]
    next_of, start_of = next_of.tolist(), a.tolist()
    seen, walks = bytearray(n), []
    for start in range(n):
        walk, k = [], start
        while not seen[k]:
            seen[k] = 1
            walk.append(start_of[k])
            k = next_of[k]
        if walk:
            walks.append(walk)
    return walks


def _simple(walk: list[int]) -> Iterator[list[int]]:
    """The walk taken apart where it comes to a point again."""
    if len(set(walk)) == len(walk):
        yield walk
        return
    place, stack = {}, []
    for v in [*walk, walk[0]]:
        if v in place:
            at = place[v]
            yield stack[at:]
            for u in stack[at + 1 :]:
                del place[u]
            del stack[at + 1 :]
        else:
            place[v] = len(stack)
            stack.append(v)


def shoelace(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T  # the first corner is the origin, so the last step to it adds nothing
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def within(ring: np.ndarray, x: float, y: float) -> bool:
    if len(ring) <= 32:  # a loop is quicker than arrays
        found, (px, py) = False, ring[-1].tolist()
        for qx, qy in ring.tolist():
            if (py > y) != (qy > y) and x < (qx - px) * (y - py) / (qy - py) + px:
                found = not found
            px, py = qx, qy
        return found
    a, b = ring, np.roll(ring, -1, axis=0)
    over = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return bool((over & (x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0])).sum() % 2)


class Rings:
    """Rings of parts: points, one ring after another, with each ring's size, area (negative for holes) and owner, an exterior before its holes,
    the largest part of an owner first."""

    def __init__(self, points: np.ndarray, size: np.ndarray, area: np.ndarray, owner: np.ndarray):
        self.points, self.size, self.area, self.owner = points, size, area, owner

    @staticmethod
    def joined(found: list[Rings]) -> Rings:
        some = Rings(*(np.concatenate([getattr(r, k) for r in found]) for k in ("points", "size", "area", "owner")))
        return some.taken(np.argsort(some.owner, kind="stable"))

    @staticmethod
    def none() -> Rings:
        return Rings(np.zeros((0, 2)), np.zeros(0, int), np.zeros(0), np.zeros(0, int))

    @staticmethod
    def of(points: np.ndarray, rings: list[list[int]], owner: np.ndarray) -> Rings:
        """Directed rings of points; owner is each point's."""
        if not rings:
            return Rings.none()
        at = np.fromiter((v for r in rings for v in r), int)
        size = np.fromiter(map(len, rings), int, len(rings))
        start = np.cumsum(size) - size
        found, own = points[at], owner[at[start]]
        return Rings(found, size, areas(found, size), own).assembled()

    def taken(self, which: np.ndarray) -> Rings:
        size = self.size[which]
        start = (np.cumsum(self.size) - self.size)[which]
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        return Rings(self.points[at], size, self.area[which], self.owner[which])

    def assembled(self) -> Rings:
        """The same rings, holes put behind the exteriors around them; those that none is around, and rings without area, go."""
        n = int(self.owner.max()) + 1
        outer, holes = (np.bincount(self.owner[k], minlength=n) for k in (self.area > 0, self.area < 0))
        plain = ((outer <= 1) | (holes == 0))[self.owner] & (self.area != 0)
        most = np.zeros(n)
        np.maximum.at(most, self.owner, self.area)
        # a hole lies in the only exterior; one that is no smaller has none around it
        plain_rings = np.flatnonzero(plain & (outer > 0)[self.owner] & (-self.area < most[self.owner]))
        start = np.cumsum(self.size) - self.size
        lows = np.minimum.reduceat(self.points, start, axis=0)
        low = lows[plain_rings]
        low[self.area[plain_rings] < 0] = 0  # holes of one size stay in order
        size = self.area[plain_rings]
        order = plain_rings[np.lexsort((low[:, 1], low[:, 0], -np.abs(size), size < 0, self.owner[plain_rings]))]
        mixed = np.flatnonzero(((outer > 1) & (holes > 0))[self.owner])
        if len(mixed):
            groups: dict[int, list[int]] = {}
            for i in mixed.tolist():
                groups.setdefault(int(self.owner[i]), []).append(i)
            more = []
            for own in groups.values():
                rings = [self.points[start[i] : start[i] + self.size[i]] for i in own]
                for k, inner in _placed(self.area[own].tolist(), rings, lows[own].tolist()):
                    more += [own[k], *(own[h] for h in inner)]
            order = np.concatenate([order, np.array(more, int)])
            order = order[np.argsort(self.owner[order], kind="stable")]
        return self.taken(order)

    def parts(self, n: int) -> list[list[Part]]:
        """The parts of each of n owners."""
        out: list[list[Part]] = [[] for _ in range(n)]
        rings = np.split(self.points, np.cumsum(self.size)[:-1]) if len(self.size) else []
        for ring, area, owner in zip(rings, self.area.tolist(), self.owner.tolist(), strict=True):
            if area > 0:
                out[owner].append((ring, [], area))
            else:
                exterior, holes, size = out[owner][-1]
                out[owner][-1] = (exterior, [*holes, ring], size + area)
        return out

    def polygons(self) -> pa.StructArray:
        """struct<exterior, holes, area> of each part."""
        points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(self.points[:, k])) for k in (0, 1)], ["x", "y"])
        rings = pa.ListArray.from_arrays(_offsets(self.size), points)
        outer = self.area > 0
        first = np.flatnonzero(outer)
        holes = pa.ListArray.from_arrays(_offsets(np.diff(np.r_[first, len(outer)]) - 1), rings.take(pa.array(np.flatnonzero(~outer))))
        area = np.add.reduceat(self.area, first) if len(first) else np.zeros(0)
        return pa.StructArray.from_arrays([rings.take(pa.array(first)), holes, pa.array(area)], ["exterior", "holes", "area"])

    def column(self, known: np.ndarray) -> pa.ListArray:
        """array<struct<exterior, holes, area>> of each owner, null for those not known."""
        each = np.bincount(self.owner[self.area > 0], minlength=len(known))
        return pa.ListArray.from_arrays(_offsets(each), self.polygons(), mask=pa.array(~known))


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))


def areas(points: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed areas of rings that lie one after another, none empty."""
    start = np.cumsum(size) - size
    after = np.arange(1, len(points) + 1)
    after[start + size - 1] = start
    x, y = (points - np.repeat(points[start], size, axis=0)).T
    return np.add.reduceat(x * y[after] - x[after] * y, start) / 2


def regions(tables: list[list[np.ndarray]], inside: Callable[[np.ndarray], np.ndarray]) -> list[list[Part]]:
    """For each list of layers the parts (exterior, holes, area) of what ``inside`` says yes to, the largest first; exteriors run
    counter-clockwise.

    A layer is a table of edges (ax, ay, bx, by) of closed rings; inside gets a row for each place and a column for each layer, with
    the number of times that it winds around there (odd: by the even-odd rule within). Lists are worked on together, in steps of
    bounded size.
    """
    sizes = np.array([(i, k, len(x)) for i, own in enumerate(tables) for k, x in enumerate(own)], int).reshape(-1, 3)
    if not sizes[:, 2].sum():
        return [[] for _ in tables]
    own, layer = (np.repeat(sizes[:, c], sizes[:, 2]) for c in (0, 1))
    return region_rings(np.concatenate([x for y in tables for x in y]), own, layer, max(map(len, tables)), inside).parts(len(tables))


def steps(own: np.ndarray) -> Iterator[slice]:
    """Stretches of whole owners (owners are in order) whose edges make ``PAIRS`` pairs, or of one owner."""
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    bounds = np.r_[starts, len(own)]
    cells = np.r_[0, np.cumsum(np.diff(bounds) ** 2)]
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(cells, cells[at] + PAIRS)))
        to = min(to, len(starts))
        yield slice(bounds[at], bounds[to])
        at = to


def region_rings(e: np.ndarray, own: np.ndarray, layer: np.ndarray, layers: int, inside: Callable[[np.ndarray], np.ndarray]) -> Rings:
    """``regions`` of edges with their owners, in order, and layers."""
    found = [_regions(e[k], own[k], layer[k], layers, inside) for k in steps(own)] if len(e) else []
    return Rings.joined(found) if found else Rings.none()


def _regions(e: np.ndarray, own: np.ndarray, layer: np.ndarray, layers: int, inside: Callable[[np.ndarray], np.ndarray]) -> Rings:
    ids, own = np.unique(own, return_inverse=True)
    points, pieces, runs, own = _pieces(e, own, layer, layers)
    if not len(pieces):
        return Rings.none()
    low, high = _turned(points, pieces, own)
    down = (low[:, 1] > high[:, 1])[:, None]
    low, high, pieces, runs = np.where(down, high, low), np.where(down, low, high), np.where(down, pieces[:, ::-1], pieces), np.where(down, -runs, runs)
    left, right = (inside(w) for w in _windings(low, high, runs, own))
    bound = left != right
    pieces, left = pieces[bound], left[bound][:, None]
    if not len(pieces):
        return Rings.none()
    owner = np.zeros(len(points), int)
    owner[pieces] = ids[own[bound]][:, None]
    a, b = np.where(left, pieces, pieces[:, ::-1]).T
    return Rings.of(points, [ring for walk in _followed(points, a, b) for ring in _simple(walk)], owner)


def _placed(sizes: list[float], rings: list[np.ndarray], lows: list[list[float]]) -> list[tuple[int, list[int]]]:
    """Places of the exteriors among rings of signed sizes and least coordinates, and of the holes in each, the largest part first."""
    parts = [(sizes[i], i, []) for i in sorted((i for i, s in enumerate(sizes) if s > 0), key=sizes.__getitem__)]
    for i, s in enumerate(sizes):
        if s < 0:
            x, y = (rings[i][0] + rings[i][1]) / 2
            around = next((holes for size, k, holes in parts if size > -s and within(rings[k], x, y)), None)
            if around is not None:
                around.append(i)
    found = [(k, sorted(holes, key=sizes.__getitem__), s + sum(sizes[h] for h in holes)) for s, k, holes in parts]
    return [(k, holes) for k, holes, _ in sorted(found, key=lambda p: (-p[2], lows[p[0]]))]


def _assembled(rings: list[tuple[float, np.ndarray]]) -> list[Part]:
    found = _placed([s for s, _ in rings], [r for _, r in rings], [r.min(axis=0).tolist() for _, r in rings])
    return [(rings[k][1], [rings[h][1] for h in holes], rings[k][0] + sum(rings[h][0] for h in holes)) for k, holes in found]


def region(layers: list[np.ndarray], inside: Callable[[np.ndarray], np.ndarray]) -> list[Part]:
    """``regions`` of one list of layers."""
    return regions([layers], inside)[0]


def odd(w: np.ndarray) -> np.ndarray:
    return w[:, 0] % 2 == 1


def box_edges(x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    return np.array([[x0, y0, x1, y0], [x1, y0, x1, y1], [x1, y1, x0, y1], [x0, y1, x0, y0]], dtype=float)


def _table(edges) -> np.ndarray:
    return np.asarray(edges, dtype=float).reshape(-1, 4)


def _as_polygons(parts: Column) -> Column:
    """array<struct<exterior, holes, area>> from flat rings."""
    ring = lambda flat: F.transform(F.sequence(F.lit(0), (F.size(flat) / 2).cast("int") - 1), lambda i: R.point(flat[2 * i], flat[2 * i + 1]))

    def polygon(rings: Column) -> Column:
        exterior, holes = ring(rings[0]), F.transform(F.slice(rings, F.lit(2), F.size(rings)), ring)
        return F.struct(exterior.alias("exterior"), holes.alias("holes"), R.polygon_area(exterior, holes).alias("area"))

    return F.transform(parts, polygon)


def edge_table(edges: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of all rows, the row of each, and which rows are known."""
    size = pc.list_value_length(edges).fill_null(0).to_numpy(zero_copy_only=False).astype(int) // 4
    e = edges.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 4)
    return e, np.repeat(np.arange(len(edges)), size), edges.is_valid().to_numpy(zero_copy_only=False)


def convex_rings(e: np.ndarray, own: np.ndarray) -> Rings:
    """The edges' owners of which it is plain that they are one convex ring, counter-clockwise.

    Corners turn one way, once around, by no less than a thousandth of a right angle or so, and edges are no shorter than a thousandth
    of the extent, so that no corner is near another edge.
    """
    if not len(e):
        return Rings.none()
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    size = np.diff(np.r_[start, len(own)])
    before = np.arange(-1, len(e) - 1)
    before[start] = start + size - 1
    d = e[:, 2:] - e[:, :2]
    length = np.hypot(*d.T)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = d / length[:, None]
        sine, cosine = u[before, 0] * u[:, 1] - u[before, 1] * u[:, 0], (u[before] * u).sum(axis=1)
        reach = np.maximum.reduceat(np.abs(e[:, :2] - np.repeat(e[start, :2], size, axis=0)).max(axis=1), start)
        turns = np.abs(np.add.reduceat(np.arctan2(sine, cosine), start))
        # one ring: each edge begins where the one before it ends
        closed = np.logical_and.reduceat((e[:, :2] == e[before, 2:]).all(axis=1), start)
        left, right = (np.logical_and.reduceat(way * sine > 1e-3, start) for way in (1, -1))
        wide = np.minimum.reduceat(length, start) > 1e-3 * reach
        plain = closed & (left | right) & wide & (np.abs(turns - 2 * np.pi) < 1e-6) & np.isfinite(reach)
    which = np.flatnonzero(plain)
    n, back = size[which], right[which]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(start[which], n) + np.where(np.repeat(back, n), np.repeat(n, n) - 1 - step, step)
    points = e[at, :2]
    return Rings(points, n, areas(points, n) if len(n) else np.zeros(0), own[start[which]])


POLYGONS = "array<struct<exterior:array<struct<x:double,y:double>>,holes:array<array<struct<x:double,y:double>>>,area:double>>"


def parts(exterior: Column, holes: Column) -> Column:
    """array<struct<exterior, holes, area>>: what an odd number of edges encloses, in valid parts, the largest first; null for null.

    Bow-ties fall into two parts, holes that reach over the exterior become parts outside, holes that overlap fill what both cover,
    edges that run back over themselves vanish. Rings without area give no part. Valid polygons come back as they are, but for where
    rings begin and how they run.
    """

    @F.arrow_udf(POLYGONS)
    def kernel(edges: pa.Array) -> pa.Array:
        e, own, known = edge_table(edges)
        whole = convex_rings(e, own)
        done = np.zeros(len(known), bool)
        done[whole.owner] = True
        e, own = e[~done[own]], own[~done[own]]
        found = region_rings(e, own, np.zeros(len(e), int), 1, odd)
        return Rings.joined([whole, found]).column(known)

    return kernel.asNondeterministic()(edge_list(exterior, holes))


def clipped(exterior: Column, holes: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """array<struct<exterior, holes, area>>: the parts of a polygon inside a box, the largest first; null for null."""

    @F.arrow_udf(POLYGONS)
    def kernel(edges: pa.Array, *sides: pa.Array) -> pa.Array:
        e, own, known = edge_table(edges)
        a, b, c, d = (v.to_numpy(zero_copy_only=False)[known] for v in sides)
        box = np.stack([a, b, c, b, c, b, c, d, c, d, a, d, a, d, a, b], axis=1).reshape(-1, 4)
        e, layer = np.concatenate([e, box]), np.repeat([0, 1], [len(e), len(box)])
        own = np.concatenate([own, np.repeat(np.flatnonzero(known), 4)])
        order = np.argsort(own, kind="stable")
        found = region_rings(e[order], own[order], layer[order], 2, lambda w: (w[:, 0] % 2 == 1) & (w[:, 1] != 0))
        return found.column(known)

    return kernel.asNondeterministic()(edge_list(exterior, holes), *[c.cast("double") for c in (x0, y0, x1, y1)])


def unioned(polygons: Column) -> Column:
    """array<struct<exterior, holes, area>>: the union of ``array<struct<exterior, holes>>``, each repaired first; null for null."""

    @F.arrow_udf(POLYGONS)
    def kernel(edges: pa.Array) -> pa.Array:
        tables = [None if own is None else [_table(e) for e in own if e is not None] for own in edges.to_pylist()]
        own, layer, size = np.array([(i, k, len(e)) for i, table in enumerate(tables) for k, e in enumerate(table or [])], int).reshape(-1, 3).T
        e = np.concatenate([e for table in tables for e in table or []] or [np.zeros((0, 4))])
        found = region_rings(e, np.repeat(own, size), np.repeat(layer, size), int(layer.max(initial=0)) + 1, lambda w: (w % 2 == 1).any(axis=1))
        return found.column(np.array([table is not None for table in tables], bool))

    return kernel.asNondeterministic()(F.transform(polygons, lambda p: edge_list(p["exterior"], p["holes"])))


def largest(found: Column, min_area: float = 0.0) -> Column:
    """The largest part with an area over 0 and not under min_area, null without one; found is a column, so that it is made once."""
    first = F.get(found, F.lit(0))
    return F.when((first["area"] > 0) & (first["area"] >= min_area), first)


def patch_parts(polygons: DataFrame, size: float) -> DataFrame:
    """A row for each part of each polygon in each patch of a grid: the polygon's columns, exterior and holes replaced by the part's, with
    patch_x, patch_y (numbers of the patch) and area; coordinates stay the image's. Only polygons that cross a patch's side are cut."""
    c = F.col
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(c(lo) / size), F.greatest(F.ceil(c(hi) / size) - 1, F.floor(c(lo) / size))))
    dealt = with_box(polygons).withColumn("patch_x", cells("x0", "x1")).withColumn("patch_y", cells("y0", "y1"))
    x, y = c("patch_x") * F.lit(float(size)), c("patch_y") * F.lit(float(size))
    whole = (c("x0") >= x) & (c("x1") <= x + size) & (c("y0") >= y) & (c("y1") <= y + size)
    cut = clipped(F.when(~whole, c("exterior")), c("holes"), x, y, x + size, y + size)
    same = F.array(F.struct("exterior", "holes", R.polygon_area(c("exterior"), c("holes")).alias("area")))
    rows = dealt.withColumn("cut", cut).withColumn("part", F.explode(F.when(whole, same).otherwise(c("cut"))))
    return rows.drop("x0", "y0", "x1", "y1", "exterior", "holes", "cut").select("*", "part.*").drop("part")
