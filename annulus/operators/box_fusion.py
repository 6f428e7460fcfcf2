"""Boxes of several models fused: clusters in the order of scores, whose representative moves as boxes join."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boxes of a group that are clustered without arrays.
FEW = 64
MODES = ("avg", "max", "box_and_model_avg", "absent_model_aware_avg")


def clusters(boxes: np.ndarray, score: np.ndarray, iou: float) -> tuple[np.ndarray, np.ndarray]:
    """The cluster of each box (x0, y0, x1, y1), in this order, and the clusters' boxes: means weighted by score.

    A box joins the cluster whose box at that time overlaps it most, by more than ``iou``; else it begins one.
    """
    if len(boxes) <= FEW:  # loops are quicker than small arrays
        return _few_clusters(boxes.tolist(), score.tolist(), iou)
    heads, weight, own = np.zeros((len(boxes), 4)), np.zeros(len(boxes)), np.zeros(len(boxes), int)
    area, n = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]), 0
    for i, (b, s) in enumerate(zip(boxes, score, strict=True)):
        h = heads[:n]
        both = np.maximum(np.minimum(h[:, 2], b[2]) - np.maximum(h[:, 0], b[0]), 0) * np.maximum(np.minimum(h[:, 3], b[3]) - np.maximum(h[:, 1], b[1]), 0)
        overlap = both / ((h[:, 2] - h[:, 0]) * (h[:, 3] - h[:, 1]) + area[i] - both)
        k = int(overlap.argmax()) if n and overlap.max() > iou else n
        n += k == n
        heads[k] = (heads[k] * weight[k] + b * s) / (weight[k] + s) if weight[k] + s > 0 else b
        weight[k] += s
        own[i] = k
    return own, heads[:n]


def _few_clusters(boxes: list[list[float]], score: list[float], iou: float) -> tuple[np.ndarray, np.ndarray]:
    """clusters without arrays; the same steps in the same order."""
    heads, weight, own = [], [], []
    for (x0, y0, x1, y1), s in zip(boxes, score, strict=True):
        area, most, k = (x1 - x0) * (y1 - y0), iou, len(heads)
        for i, (a, b, c, d) in enumerate(heads):
            w, h = min(c, x1) - max(a, x0), min(d, y1) - max(b, y0)
            if w > 0 and h > 0:
                both = w * h
                overlap = both / ((c - a) * (d - b) + area - both)
                if overlap > most:
                    most, k = overlap, i
        if k == len(heads):
            heads.append((x0, y0, x1, y1))
            weight.append(0.0)
        n = weight[k]
        if n + s > 0:
            heads[k] = tuple((old * n + new * s) / (n + s) for old, new in zip(heads[k] if n else (0.0,) * 4, (x0, y0, x1, y1), strict=True))
        else:
            heads[k] = (x0, y0, x1, y1)
        weight[k] = n + s
        own.append(k)
    return np.array(own, int), np.array(heads, float).reshape(-1, 4)


def confidence(score: np.ndarray, model: np.ndarray, weights: np.ndarray, mode: str, overflow: bool) -> float:
    """Of one cluster, from its boxes' weighted scores and their models."""
    n, used = len(score), np.unique(model)
    if mode == "max":
        return score.max() / weights.max()
    mean, w = score.mean(), weights[model].sum()
    if mode == "box_and_model_avg":
        return mean * n / w * weights[used].sum() / weights.sum()
    if mode == "absent_model_aware_avg":
        return mean * n / (w + np.delete(weights, used).sum())
    return mean * (n if overflow else min(len(weights), n)) / weights.sum()


def fused_boxes(boxes: DataFrame, weights: list[float], iou: float = 0.55, least: float = 0.0, mode: str = "avg", overflow: bool = False) -> DataFrame:
    """``boxes(image_id, label, model, score, x0, y0, x1, y1)`` -> image_id, label, place (by score), score, the fused box and boxes, how many
    went in; model is a place in weights.

    Boxes under the score ``least`` and those without area are left out, corners in the wrong order are swapped. Of one image and label, boxes
    are read by weighted score, then model and corners; a task holds one image's boxes of a label. An empty table gives an empty result.
    """
    return fused_by_modes(boxes, weights, (mode,), iou, least, overflow).drop("mode")


def fused_by_modes(boxes: DataFrame, weights: list[float], modes: Sequence[str], iou: float = 0.55, least: float = 0.0, overflow: bool = False) -> DataFrame:
    """``fused_boxes`` in several modes, with ``mode``: boxes are shuffled and clustered once, as no mode changes the clusters."""
    if not set(modes) <= set(MODES):
        raise ValueError(f"mode must be one of {MODES}")
    c = F.col
    sides = {x: f(c(x), c(y)).cast("double") for x, y, f in (("x0", "x1", F.least), ("x1", "x0", F.greatest), ("y0", "y1", F.least), ("y1", "y0", F.greatest))}
    known = boxes.where(c("score") >= least).withColumns(sides).where("x0 < x1 and y0 < y1")
    weighted = known.withColumn("weighted", c("score") * F.get(F.array(*[F.lit(float(w)) for w in weights]), c("model").cast("int")))
    order = ["image_id", "label", F.desc("weighted"), "model", "x0", "y0", "x1", "y1"]
    dealt = weighted.select("image_id", "label", "model", "weighted", "x0", "y0", "x1", "y1").repartition("image_id", "label").sortWithinPartitions(*order)
    w = np.array(weights, float)

    # of one box, what confidence gives for one of each model, to be scaled by its score in the same order
    total, top, others = w.sum(), w.max(), [np.delete(w, [m]).sum() for m in range(len(w))]
    alone = {
        "max": lambda s, m: s / top, "avg": lambda s, m: s * 1 / total, "box_and_model_avg": lambda s, m: s * 1 / w[m] * w[m] / total, "absent_model_aware_avg": lambda s, m: s * 1 / (w[m] + others[m]),
    }
    names = ["image_id", "label", "place", "score", "x0", "y0", "x1", "y1", "boxes", "mode"]

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        groups, out = [], []
        image, label = rows["image_id"].to_numpy(), rows["label"].to_numpy()
        model, score, sides = rows["model"].to_numpy().astype(int), rows["weighted"].to_numpy(), rows[["x0", "y0", "x1", "y1"]].to_numpy()
        cuts = np.flatnonzero((image[1:] != image[:-1]) | (label[1:] != label[:-1])) + 1
        for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
            own, heads = clusters(sides[first:end], score[first:end], iou)
            order = np.argsort(own, kind="stable") + first
            ends = np.cumsum(np.bincount(own, minlength=len(heads))).tolist()
            of = [order[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]
            boxes_of = heads.tolist()
            for mode in modes:
                found = [(alone[mode](score[k[0]], model[k[0]]) if len(k) == 1 else confidence(score[k], model[k], w, mode, overflow), *h, len(k)) for k, h in zip(of, boxes_of, strict=True)]
                out += [(i, *x, mode) for i, x in enumerate(sorted(found, key=lambda x: (-x[0], *x[1:])))]
            groups += [first] * len(of) * len(modes)
        made = pd.DataFrame(out, columns=names[2:])
        made.insert(0, "label", label[groups])
        made.insert(0, "image_id", image[groups])
        return made

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted; a group that a batch cuts waits for the next one."""
        waiting = None
        for rows in batches:
            rows = rows if waiting is None else pd.concat([waiting, rows], ignore_index=True)
            if len(rows):
                last = (rows["image_id"] == rows["image_id"].iloc[-1]) & (rows["label"] == rows["label"].iloc[-1])
                waiting = rows[last]
                if not last.all():
                    yield solved(rows[~last])
        if waiting is not None and len(waiting):
            yield solved(waiting)

    kinds = ", ".join(f"{x} {boxes.schema[x].dataType.simpleString()}" for x in ("image_id", "label"))
    return dealt.mapInPandas(run, f"{kinds}, place int, score double, x0 double, y0 double, x1 double, y1 double, boxes long, mode string")
