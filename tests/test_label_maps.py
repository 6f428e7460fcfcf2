"""Cleaned label maps against loops over cells."""

import numpy as np
from pyspark.sql import functions as F

from annulus.operators import label_maps


def slow(cells, small, sizes):
    seen, out = np.zeros(cells.shape, bool), cells.copy()
    for start in np.ndindex(cells.shape):
        if seen[start]:
            continue
        part, waiting = [], [start]
        seen[start] = True
        while waiting:
            i, j = waiting.pop()
            part.append((i, j))
            for u, v in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if 0 <= u < len(cells) and 0 <= v < cells.shape[1] and not seen[u, v] and cells[u, v] == cells[start]:
                    seen[u, v] = True
                    waiting.append((u, v))
        if len(part) < small:
            for p in part:
                out[p] = -1
    labels = np.unique(cells)
    for k in sizes:
        before, r = out.copy(), k // 2
        for i, j in zip(*np.nonzero(before == -1), strict=True):
            around = [before[min(max(i + a, 0), len(cells) - 1), min(max(j + b, 0), cells.shape[1] - 1)] for a in range(-r, r + 1) for b in range(-r, r + 1)]
            out[i, j] = labels[np.argmax([around.count(v) for v in labels])]
    return out


def as_runs(image, cells, top=0, left=0):
    out = []
    for y, row in enumerate(cells):
        cuts = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)]
        out += [(image, y + top, a + left, b + left, int(row[a])) for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def test_cleaned_maps(spark):
    r = np.random.default_rng(3)
    maps, rows = {}, []
    for image in range(30):
        coarse = r.integers(0, 4, (r.integers(1, 6), r.integers(1, 6))) * 7
        cells = np.kron(coarse, np.ones((5, 6), int))
        noise = r.random(cells.shape) < (0.15 if image % 3 else 0.6)
        cells[noise] = r.integers(0, 4, int(noise.sum())) * 7
        maps[image] = cells
        rows += as_runs(image, cells, image, 2 * image)
    r.shuffle(rows)
    df = spark.createDataFrame([tuple(map(int, x)) for x in rows], label_maps.LABELLED).withColumn("extra", F.lit("x")).repartition(4)
    for small, sizes in ((20, (3, 7)), (4, (5,)), (1000, (3,))):
        got = label_maps.cleaned_maps(df, small, sizes).collect()
        for image, cells in maps.items():
            want = sorted(as_runs(image, slow(cells, small, sizes), image, 2 * image))
            assert sorted(tuple(x) for x in got if x.image_id == image) == want
    assert label_maps.cleaned_maps(df.limit(0)).count() == 0
