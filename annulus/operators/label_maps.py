"""Label maps as runs: small parts of a label dissolve into what lies around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.operators import drawing

LABELLED = "image_id long, y long, x_start long, x_end long, label long"
SMALL, SIZES = 20, (3, 7)


def part_sizes(y: np.ndarray, a: np.ndarray, b: np.ndarray, label: np.ndarray, high: np.ndarray | int = 1) -> np.ndarray:
    """For runs sorted by (y, a) that cover their rows, the cells of the part that each belongs to: runs of one label that share a side.
    A run's row stands for ``high`` equal ones."""
    wide = int(b.max(initial=0)) + 1
    starts, ends = y * wide + a, y * wide + b
    lo, hi = np.searchsorted(ends, starts + wide, "right"), np.searchsorted(starts, ends + wide, "left")  # the next row's runs that meet it
    n = np.maximum(hi - lo, 0)
    i = np.repeat(np.arange(len(y)), n)
    j = np.repeat(lo, n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    same = (label[i] == label[j]) & (y[j] == y[i] + 1)
    i, j = i[same], j[same]
    part = np.arange(len(y))
    while len(i):
        least = np.minimum(part[i], part[j])
        np.minimum.at(part, part[i], least)
        np.minimum.at(part, part[j], least)
        part = part[part]
        open_ = part[i] != part[j]
        i, j = i[open_], j[open_]
    while (part[part] != part).any():
        part = part[part]
    return np.bincount(part, (b - a) * high, len(y))[part].astype(int)


def votes_at(cells: np.ndarray, y: np.ndarray, x: np.ndarray, labels: int, size: int) -> np.ndarray:
    """The same for each label (rows) at some cells (columns) alone."""
    r, (high, wide) = size // 2, cells.shape
    found = np.zeros((labels + 1, len(y)), np.int64)  # the last for cells without a label
    own = np.arange(len(y))
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            found[cells[np.clip(y + dy, 0, high - 1), np.clip(x + dx, 0, wide - 1)], own] += 1
    return found[:-1]


def votes(cells: np.ndarray, label: int, size: int) -> np.ndarray:
    """How many cells of the square of that size around each one have the label; the border's cells go on outside."""
    r = size // 2
    near = np.pad(cells == label, r, mode="edge").astype(np.int64).cumsum(0).cumsum(1)
    near = np.pad(near, ((1, 0), (1, 0)))
    return near[size:, size:] - near[:-size, size:] - near[size:, :-size] + near[:-size, :-size]


def cleaned_cells(cells: np.ndarray, labels: int, small: int = SMALL, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """The cells (labels from 0) of a map whose parts under ``small`` cells take the label that is most frequent around each of their cells.

    Of equally frequent ones the least; where no cell around has a label, the least. Parts are found on stretches of equal rows.
    """
    first = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(axis=1)))
    high = np.diff(np.append(first, len(cells)))
    rows = cells[first]
    fresh = np.ones(rows.shape, bool)
    fresh[:, 1:] = rows[:, 1:] != rows[:, :-1]
    y, a = np.nonzero(fresh)
    b = np.append(a[1:], 0)
    b[np.append(y[1:] != y[:-1], True)] = cells.shape[1]
    few = np.flatnonzero(part_sizes(y, a, b, rows[y, a], high[y]) < small)
    if not len(few):
        return cells
    cells = cells.astype(np.min_scalar_type(-labels - 1))  # a copy
    for k in few:
        cells[first[y[k]] : first[y[k]] + high[y[k]], a[k] : b[k]] = -1
    for size in sizes:
        open_ = cells < 0
        if not open_.any():
            break
        row, at = np.nonzero(open_)
        if len(row) * size * size < cells.size:  # else all cells at once
            cells[row, at] = np.argmax(votes_at(cells, row, at, labels, size), axis=0)
        else:
            best = np.argmax([votes(cells, k, size) for k in range(labels)], axis=0)
            cells = np.where(open_, best, cells)
    return cells


def cleaned(y: np.ndarray, a: np.ndarray, b: np.ndarray, label: np.ndarray, small: int = SMALL, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """The runs (y, a, b, label) of a map whose parts under ``small`` cells take the label that is most frequent around each of their cells.

    Of equally frequent ones the least; where no cell around has a label, the map's least. The runs cover a rectangle.
    """
    order = np.lexsort((a, y))
    y, a, b, label = y[order], a[order], b[order], label[order]
    top, left = y[0], a.min()
    known, kind = np.unique(label, return_inverse=True)
    cells = cleaned_cells(np.repeat(kind, b - a).reshape(-1, b.max() - left), len(known), small, sizes)
    fresh = np.ones(cells.shape, bool)
    fresh[:, 1:] = cells[:, 1:] != cells[:, :-1]
    row, start = np.nonzero(fresh)
    end = np.append(start[1:], 0)
    end[np.append(row[1:] != row[:-1], True)] = cells.shape[1]
    return np.stack([row + top, start + left, end + left, known[cells[row, start]]])


def cleaned_maps(runs: DataFrame, small: int = SMALL, sizes: tuple[int, ...] = SIZES, together: bool = False) -> DataFrame:
    """``runs(image_id, y, x_start, x_end, label)`` that cover a rectangle of each image -> the runs of its cleaned map.

    Runs are shuffled by image, but for those that lie ``together`` by image already; a task holds one image's map. An empty table gives an empty result.
    """
    names = [x.split()[0] for x in LABELLED.split(", ")]
    dealt = runs.select(*[F.col(c).cast("long").alias(c) for c in names])
    dealt = dealt if together else dealt.repartition("image_id").sortWithinPartitions("image_id")

    def rows(image: int, held: list[np.ndarray]) -> pa.RecordBatch:
        found = cleaned(*np.concatenate(held, axis=1), small, sizes)
        return pa.RecordBatch.from_arrays([pa.array(np.full(found.shape[1], image)), *map(pa.array, found)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, held = None, []
        for batch in batches:
            own, *cols = (batch.column(c).to_numpy() for c in names)
            for part in np.split(np.arange(len(own)), np.flatnonzero(own[1:] != own[:-1]) + 1) if len(own) else []:
                if held and own[part[0]] != image:
                    yield rows(image, held)
                    held = []
                image = int(own[part[0]])
                held.append(np.stack([x[part] for x in cols]))
        if held:
            yield rows(image, held)

    return dealt.mapInArrow(run, LABELLED)


def cleaned_sizes(boxes: DataFrame, side: int, inset: int, small: int = SMALL, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """``boxes(image_id, x0, y0, x1, y1, has_hole)`` -> image_id, label (1 in the union of an image's boxes, 0 outside) and pixels of each label
    of the cleaned map of side x side cells; images without a cell in the mask are left out. Boxes are drawn in their image's task."""

    def found(mask: np.ndarray) -> list[np.ndarray]:
        if not mask.any():
            return [np.zeros(0, np.int64)] * 2
        # a map of one label keeps it, whatever its size
        ones = mask.size if mask.all() else int(np.count_nonzero(cleaned_cells(mask.view(np.int8), 2, small, sizes)))
        pixels = np.array([mask.size - ones, ones])
        return [np.flatnonzero(pixels), pixels[pixels > 0]]

    return drawing.each_image(boxes, ["x0", "y0", "x1", "y1", "has_hole"], [], lambda: drawing._mask(side, inset, found), "image_id long, label long, pixels long")
