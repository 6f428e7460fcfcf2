"""Order-dependent selection as rounds of joins over a table of overlapping pairs.

Greedy rules read one record after another; here each round decides every record that nothing undecided before it can
still change, so no image is gathered in one task, however many records it holds. Rounds are as many as the longest
chain of records that wait for each other; the pairs left are checkpointed between rounds.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from annulus.operators.shared import Scratch, shared_folder


#: Pairs of an image that are assigned in its task.
HELD = 1 << 17


def cut(df: DataFrame) -> DataFrame:
    """df written to the cluster's checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def suppressed(edges: DataFrame) -> DataFrame:
    """edges(hi, lo): hi comes first, and removes lo unless something removes hi. Returns the ids removed, as ``lo``.

    Ids without an edge, and all that are not returned, stay. No edges: no rows. Repeated edges count once.
    """
    left, out = cut(edges.select("hi", "lo").distinct()), []
    while not left.isEmpty():
        first = left.select("hi").distinct().join(left.select(F.col("lo").alias("hi")), "hi", "left_anti")
        gone = cut(left.join(first, "hi", "left_semi").select("lo").distinct())
        out.append(gone)
        left = left.join(gone, "lo", "left_anti").join(gone.select(F.col("lo").alias("hi")), "hi", "left_anti")
        left = cut(left.join(first, "hi", "left_anti"))
    result = edges.select("lo").limit(0)
    for part in out:
        result = result.unionByName(part)
    return result


def in_order(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs(keys, pred_id, place, ann_id, iou, regular, reusable): each prediction by place takes its best free partner.

    Best: regular ones first, then greatest iou, then greatest ann_id. A reusable partner stays free. place orders
    predictions that share a partner and must differ among them. Returns keys, pred_id, ann_id, iou, regular.
    """
    left, out = cut(pairs.select(*keys, "pred_id", "place", "ann_id", "iou", "regular", "reusable")), []
    found = [*keys, "pred_id", "ann_id", "iou", "regular"]
    while not left.isEmpty():
        best = left.groupBy(*keys, "pred_id", "place").agg(F.max(F.struct("regular", "iou", "ann_id", "reusable")).alias("b")).select(*keys, "pred_id", "place", "b.*")
        first = left.groupBy(*keys, "ann_id").agg(F.min("place").alias("first"))
        now = cut(best.join(first, [*keys, "ann_id"]).where("reusable or place = first").select(*found, "reusable"))
        out.append(now.select(*found))
        left = left.join(now.select(*keys, "pred_id"), [*keys, "pred_id"], "left_anti")
        left = cut(left.join(now.where("not reusable").select(*keys, "ann_id"), [*keys, "ann_id"], "left_anti"))
    result = pairs.select(*found).limit(0)
    for part in out:
        result = result.unionByName(part)
    return result


def in_order_at_once(pairs: DataFrame, every: int) -> DataFrame:
    """in_order for each bit of every at once: pairs(image_id, pred_id, place, ann_id, iou, reach, regular, reusable).

    reach and regular have the bits for which the pair may be taken and is a regular one. Returns image_id, pred_id, and the bits for
    which the prediction takes a regular partner, ``first``, or another, ``second``; no row where neither has any. Predictions pass in
    order, image by image, through one task, which holds the bits of the partners taken in the image.
    """

    def run(batches):
        image, pred, mine, taken = None, None, [], {}

        def decided() -> tuple[int, int]:
            left, got = every, [0, 0]
            mine.sort(reverse=True)
            for kind in (0, 1):
                for _, ann, reach, regular, reusable in mine:
                    now = left & reach & (~regular if kind else regular)
                    if not reusable:
                        now &= ~taken.get(ann, 0)
                        taken[ann] = taken.get(ann, 0) | now
                    got[kind] |= now
                    left &= ~now
            return got[0], got[1]

        for batch in batches:
            out = []
            for key, p, *pair in zip(*(batch.column(c).to_pylist() for c in ("image_id", "pred_id", "iou", "ann_id", "reach", "regular", "reusable")), strict=True):
                if mine and (key, p) != (image, pred):
                    out.append((image, pred, *decided()))
                    mine = []
                if key != image:
                    taken = {}
                image, pred = key, p
                mine.append(tuple(pair))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], ["image_id", "pred_id", "first", "second"])
        if mine:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (image, pred, *decided())], ["image_id", "pred_id", "first", "second"])

    dealt = pairs.repartition("image_id").sortWithinPartitions("image_id", "place", "pred_id")
    return dealt.mapInArrow(run, "image_id long, pred_id long, first long, second long").where("first <> 0 or second <> 0")


def best_pairs_first(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs(keys, pred_id, place, ann_id, iou): the best pair of all, then the best of what is left, and so on.

    Ties go to the smaller ann_id, then the smaller place. A pair that is best for both its sides is taken at once.
    Returns keys, pred_id, ann_id, iou.
    """
    left, out = cut(pairs.select(*keys, "pred_id", "place", "ann_id", "iou")), []
    found = [*keys, "pred_id", "ann_id", "iou"]
    order = F.struct("iou", (-F.col("ann_id")).alias("a"), (-F.col("place")).alias("p"))
    while not left.isEmpty():
        mine = left.groupBy(*keys, "pred_id").agg(F.max(order).alias("m"))
        theirs = left.groupBy(*keys, "ann_id").agg(F.max(order).alias("t"))
        ranked = left.withColumn("o", order).join(mine, [*keys, "pred_id"]).join(theirs, [*keys, "ann_id"])
        now = cut(ranked.where("o = m and o = t").select(*found))
        out.append(now)
        left = cut(left.join(now.select(*keys, "pred_id"), [*keys, "pred_id"], "left_anti").join(now.select(*keys, "ann_id"), [*keys, "ann_id"], "left_anti"))
    result = pairs.select(*found).limit(0)
    for part in out:
        result = result.unionByName(part)
    return result


def groups_of(pairs: DataFrame) -> DataFrame:
    """pairs(ann_id, pred_id, ...) with ``group``: the smallest ann_id reachable over shared records.

    Labels are compressed in the shared folder, the last ones alone; a step's shuffle files go when it has ended.
    """
    scratch = Scratch(pairs.sparkSession, "groups")
    links = scratch.keep(pairs.select("ann_id", "pred_id"), "links")
    labels = scratch.keep(links.select("ann_id", F.col("ann_id").alias("group")).distinct(), "labels0")
    for i in count(1):
        sides = links.join(labels, "ann_id").groupBy("pred_id").agg(F.min("group").alias("group"))
        least = links.join(sides, "pred_id").groupBy("ann_id").agg(F.min("group").alias("near"))
        # a label is itself a record: its own label is taken as well, so that chains shorten by half
        ahead = labels.select(F.col("ann_id").alias("near"), F.col("group").alias("far"))
        new = scratch.keep(labels.join(least, "ann_id").join(ahead, "near", "left").select("ann_id", F.least("group", "near", "far").alias("group"), F.col("group").alias("old")), f"labels{i}")
        same = new.where("group <> old").isEmpty()
        scratch.drop(f"labels{i - 1}")
        labels = new.select("ann_id", "group")
        if same:
            scratch.drop("links")
            return pairs.join(labels, "ann_id")


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Row and column of each assigned pair of greatest total gain (shortest augmenting paths with potentials)."""
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        dist, via, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while owner[at]:
            done[at] = True
            slack = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            nearer = ~done[1:] & (slack < dist[1:])
            dist[1:][nearer], via[1:][nearer] = slack[nearer], at
            step = int(np.argmin(np.where(done[1:], np.inf, dist[1:]))) + 1
            by = dist[step]
            u[owner[done]] += by
            v[done] -= by
            dist[~done] -= by
            at = step
        while at:
            owner[at], at = owner[via[at]], via[at]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(b, a) for a, b in pairs] if turned else pairs


def optimal_match(pairs: DataFrame) -> DataFrame:
    """pairs(ann_id, pred_id, iou > 0) -> those of the assignment with the greatest total iou; ids are longs or strings.

    Only records that overlap directly or over others depend on each other, so each such group is assigned by itself; a
    group of one pair needs no search. A group's matrix is as large as the chain of overlaps, not as the image. With image_id,
    whose records have ids of their own, the groups of images of up to HELD pairs are found in the image's task; others, and all without
    image_id, by rounds of joins.
    """
    if "image_id" not in pairs.columns:
        return _optimal_by_rounds(pairs)
    kinds = [f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("ann_id", "pred_id")]
    most = HELD

    def shown(rows: pd.DataFrame, waits: bool) -> pd.DataFrame:
        return rows[["ann_id", "pred_id", "iou"]].assign(waits=waits)

    def run(batches):
        """Rows come sorted by image; one that a batch cuts waits for the next one, and goes on as it is if it has too many."""
        waiting, large = None, None
        for rows in batches:
            rows = rows if waiting is None else pd.concat([waiting, rows], ignore_index=True)
            waiting = None
            if large is not None and len(rows):
                own = rows["image_id"] == large
                if own.any():
                    yield shown(rows[own], True)
                rows = rows[~own]
                large = None if len(rows) else large
            if not len(rows):
                continue
            image = rows["image_id"].iloc[-1]
            last = rows["image_id"] == image
            waiting = rows[last]
            if not last.all():
                yield shown(_solved_images(rows[~last]), False)
            if len(waiting) > most:
                yield shown(waiting, True)
                waiting, large = None, image
        if waiting is not None:
            yield shown(_solved_images(waiting), False)

    dealt = pairs.select("image_id", "ann_id", "pred_id", "iou").repartition("image_id").sortWithinPartitions("image_id")
    found = Scratch(pairs.sparkSession, "assigned").keep(dealt.mapInPandas(run, ", ".join([*kinds, "iou double", "waits boolean"])), "pairs")
    done, rest = (found.where(w).select("ann_id", "pred_id", "iou") for w in ("not waits", "waits"))
    return done if rest.isEmpty() else done.unionByName(_optimal_by_rounds(rest))


def _solved_images(rows: pd.DataFrame) -> pd.DataFrame:
    """The assigned pairs of whole images, each group of records that hang together by itself."""
    code = lambda c, by=None: np.unique(rows[c].to_numpy() if by is None else by, return_inverse=True)[1]
    image = code("image_id")
    ann, pred = (code(None, image * len(rows) + code(c)) for c in ("ann_id", "pred_id"))
    label = np.arange(ann.max() + 1)
    while True:
        near, new = np.full(pred.max() + 1, len(label)), label.copy()
        np.minimum.at(near, pred, label[ann])
        np.minimum.at(new, ann, near[pred])
        new = new[new]
        if (new == label).all():
            break
        label = new
    group = label[ann]
    lone = np.bincount(group)[group] == 1
    rest = np.flatnonzero(~lone)
    rest = rest[np.argsort(group[rest], kind="stable")]
    keep = [np.flatnonzero(lone)]
    iou = rows["iou"].to_numpy()
    for part in np.split(rest, np.flatnonzero(np.diff(group[rest])) + 1) if len(rest) else []:
        a, row = np.unique(ann[part], return_inverse=True)
        p, col = np.unique(pred[part], return_inverse=True)
        gain, at = np.zeros((len(a), len(p))), np.full((len(a), len(p)), -1)
        gain[row, col], at[row, col] = iou[part], part
        if min(gain.shape) == 1:
            keep.append(at.ravel()[[gain.argmax()]])
        else:
            keep.append(np.array([at[i, j] for i, j in assign(gain) if gain[i, j] > 0], int))
    return rows.iloc[np.concatenate(keep)]


def _optimal_by_rounds(pairs: DataFrame) -> DataFrame:
    grouped = Scratch(pairs.sparkSession, "grouped").keep(groups_of(pairs.select("ann_id", "pred_id", "iou")), "pairs")
    size = grouped.withColumn("n", F.count("*").over(W.partitionBy("group")))
    lone, rest = size.where("n = 1").select("ann_id", "pred_id", "iou"), size.where("n > 1").select("group", "ann_id", "pred_id", "iou")

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        group, taken = rows["group"].to_numpy(), []
        ann, pred, iou = (rows[c].to_numpy() for c in ("ann_id", "pred_id", "iou"))
        for part in np.split(np.arange(len(group)), np.flatnonzero(group[1:] != group[:-1]) + 1):
            a, row = np.unique(ann[part], return_inverse=True)
            p, col = np.unique(pred[part], return_inverse=True)
            gain = np.zeros((len(a), len(p)))
            gain[row, col] = iou[part]
            taken += [(a[i], p[j], gain[i, j]) for i, j in assign(gain) if gain[i, j] > 0]
        return pd.DataFrame(taken, columns=["ann_id", "pred_id", "iou"])

    def best(batches):
        """Rows come sorted by group; a group that a batch cuts waits for the next one."""
        waiting = None
        for rows in batches:
            rows = rows if waiting is None else pd.concat([waiting, rows], ignore_index=True)
            if len(rows):
                last = rows["group"] == rows["group"].iloc[-1]
                waiting = rows[last]
                if not last.all():
                    yield solved(rows[~last])
        if waiting is not None:
            yield solved(waiting)

    dealt = rest.repartition("group").sortWithinPartitions("group")
    kinds = [f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("ann_id", "pred_id")]
    return lone.unionByName(dealt.mapInPandas(best, ", ".join([*kinds, "iou double"])))
