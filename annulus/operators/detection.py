"""Candidate pairs, matching and detection metrics as joins, windows and aggregates.

Records are boxes (image_id, x0, y0, x1, y1, ...). Pairs are made once for each image by an equi-join on the image
and an overlap condition, and everything else is derived from that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LEVELS = 100


def overlapping(a: DataFrame, b: DataFrame, on: str = "image_id") -> DataFrame:
    """Rows of a and b of one image whose boxes share area; b's columns get the prefix ``p_``, a's ``g_``."""
    left = a.select(on, *[F.col(c).alias(f"g_{c}") for c in a.columns if c != on])
    right = b.select(on, *[F.col(c).alias(f"p_{c}") for c in b.columns if c != on])
    meet = (left["g_x0"] < right["p_x1"]) & (right["p_x0"] < left["g_x1"]) & (left["g_y0"] < right["p_y1"]) & (right["p_y0"] < left["g_y1"])
    return left.join(right, on).where(meet)


def shared_area(a: str = "g_", b: str = "p_") -> Column:
    c = F.col
    return (F.least(c(f"{a}x1"), c(f"{b}x1")) - F.greatest(c(f"{a}x0"), c(f"{b}x0"))) * (F.least(c(f"{a}y1"), c(f"{b}y1")) - F.greatest(c(f"{a}y0"), c(f"{b}y0")))


def box_area(prefix: str) -> Column:
    c = F.col
    return (c(f"{prefix}x1") - c(f"{prefix}x0")) * (c(f"{prefix}y1") - c(f"{prefix}y0"))


def iou_pairs(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """image_id, ann_id, pred_id, score, inter, g_area, p_area, iou of pairs that overlap."""
    pairs = overlapping(gt, pred).withColumns({"inter": shared_area(), "g_area": box_area("g_"), "p_area": box_area("p_")})
    # a condition on iou may be evaluated before the overlap condition, on pairs whose divisor is 0
    iou = F.try_divide(F.col("inter").cast("double"), F.col("g_area") + F.col("p_area") - F.col("inter"))
    return pairs.withColumn("iou", iou).withColumnsRenamed({"g_ann_id": "ann_id", "p_pred_id": "pred_id", "p_score": "score", "g_has_hole": "g_hole", "p_has_hole": "p_hole"})


def best_gt(pairs: DataFrame) -> DataFrame:
    """Each prediction's ground truth of greatest IoU, taken or not; ties to the smaller ann_id."""
    best = pairs.groupBy("image_id", "pred_id", "score").agg(F.max(F.struct("iou", (-F.col("ann_id")).alias("n"))).alias("b"))
    return best.select("image_id", "pred_id", "score", (-F.col("b.n")).alias("ann_id"), F.col("b.iou").alias("iou"))


def greedy_match(pairs: DataFrame, pred: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, image_id, pred_id, score, ann_id, tp for every prediction and threshold.

    A prediction is true where its best ground truth reaches the threshold and no prediction before it (score
    descending, then image_id and pred_id) has that best one too. One whose best is taken is false.
    """
    each = F.explode(F.arrays_zip(F.array(*[F.lit(t) for t in thresholds]).alias("threshold"), F.array(*_hits(thresholds)).alias("tp")))
    return _with_rivals(pairs, pred).select("image_id", "pred_id", "score", "ann_id", each.alias("m")).select("m.threshold", "image_id", "pred_id", "score", "ann_id", "m.tp")


def _with_rivals(pairs: DataFrame, pred: DataFrame) -> DataFrame:
    """Each prediction with its best ground truth and ``rival``, the greatest IoU of those before it with the same best one."""
    every = pred.select("image_id", "pred_id", "score").join(best_gt(pairs).select("image_id", "pred_id", "ann_id", "iou"), ["image_id", "pred_id"], "left")
    before = W.partitionBy("image_id", F.coalesce("ann_id", -F.col("pred_id")), F.col("ann_id").isNull()).orderBy(F.desc("score"), "pred_id").rowsBetween(W.unboundedPreceding, -1)
    return every.withColumn("rival", F.max("iou").over(before))


def _hits(thresholds: list[float]) -> list[Column]:
    """True at a threshold that the own IoU reaches and no rival's does."""
    return [F.coalesce(F.col("iou") >= t, F.lit(False)) & ~F.coalesce(F.col("rival") >= t, F.lit(False)) for t in thresholds]


def average_precisions(pairs: DataFrame, pred: DataFrame, thresholds: list[float], gt: DataFrame) -> DataFrame:
    """threshold, ap of greedy matches: predictions are matched, numbered and summed up once for all thresholds."""
    names = [f"h{i}" for i in range(len(thresholds))]
    rows = _with_rivals(pairs, pred).select("image_id", "pred_id", "score", *[h.cast("long").alias(n) for h, n in zip(_hits(thresholds), names, strict=True)])
    order = [F.desc("score"), F.col("image_id"), F.col("pred_id")]
    counted = running_sums(rows, [], order, -F.floor(F.col("score") * 1000), names)
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"sum_{n}").alias("tps")) for t, n in zip(thresholds, names, strict=True)])
    curve = counted.select("n", F.explode(each).alias("c")).join(F.broadcast(gt.agg(F.count("*").alias("n_gt"))))  # a row
    ratios = {"precision": F.col("c.tps").cast("double") / F.col("n"), "recall": F.col("c.tps").cast("double") / F.col("n_gt")}
    return average_precision(curve.withColumns(ratios).select("c.threshold", "precision", "recall"), ["threshold"])


def running_counts(rows: DataFrame, groups: list[str], order: list[Column], bucket: Column, value: str) -> DataFrame:
    """rows with ``n`` and ``sum_value``: how many rows, and what sum, up to each in the given order. See running_sums."""
    return running_sums(rows, groups, order, bucket, [value]).withColumnRenamed(f"sum_{value}", "sum_value")


def running_sums(rows: DataFrame, groups: list[str], order: list[Column], bucket: Column, values: list[str]) -> DataFrame:
    """rows with ``n`` and a ``sum_`` of each value: how many rows, and what sums, up to each in the given order.

    bucket must rise with the order; rows are numbered inside a bucket, and bucket totals are summed up apart, so no
    window holds more than a bucket of a group.
    """
    dealt = rows.withColumn("_k", bucket)
    totals = dealt.groupBy(*groups, "_k").agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_s_{v}") for v in values])
    before = W.partitionBy(*groups).orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    above = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c)
    totals = totals.select(*groups, "_k", above("_n"), *[above(f"_s_{v}") for v in values])
    own = W.partitionBy(*groups, "_k").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = dealt.withColumns({"_r": F.count("*").over(own)} | {f"_v_{v}": F.sum(v).over(own) for v in values}).join(totals, [*groups, "_k"])
    sums = {"n": F.col("_n") + F.col("_r")} | {f"sum_{v}": F.col(f"_s_{v}") + F.col(f"_v_{v}") for v in values}
    return joined.withColumns(sums).drop("_k", "_n", "_r", *[f"_{k}_{v}" for k in "sv" for v in values])


def running_bits(rows: DataFrame, order: list[Column], bucket: Column, counts: str, hits: str, cases: list[Column]) -> DataFrame:
    """(case, n, hits) for each row and each of cases whose bit is set in hits: how many rows up to it in the given order have the bit
    of the case in counts, and how many in hits. See running_sums; rows are dealt with their bits and counted behind that.
    """
    bit = lambda c, i: F.getbit(F.col(c), F.lit(i)).cast("long")
    dealt = rows.withColumn("_k", bucket).repartition("_k")
    wide = dealt.select("*", *[bit(c, i).alias(f"_{m}{i}") for i in range(len(cases)) for m, c in (("n", counts), ("h", hits))])
    names = [f"_{m}{i}" for i in range(len(cases)) for m in "nh"]
    totals = wide.groupBy("_k").agg(*[F.sum(n).alias(n) for n in names])
    before = W.orderBy("_k").rowsBetween(W.unboundedPreceding, -1)  # a row for each bucket
    totals = totals.select("_k", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}t") for n in names])
    own = W.partitionBy("_k").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = wide.select("_k", hits, *[F.sum(n).over(own).alias(n) for n in names]).join(F.broadcast(totals), "_k")
    up_to = lambda m, i: F.col(f"_{m}{i}") + F.col(f"_{m}{i}t")
    each = F.array(*[F.when(bit(hits, i) == 1, F.struct(c.alias("case"), up_to("n", i).alias("n"), up_to("h", i).alias("hits"))) for i, c in enumerate(cases)])
    return counted.where(F.col(hits) != 0).select(F.explode(F.array_compact(each)).alias("c")).select("c.*")


def precision_recall(matches: DataFrame, groups: list[str], totals: DataFrame) -> DataFrame:
    """matches(groups, image_id, pred_id, score, tp) -> with precision and recall; totals(groups, n_gt)."""
    rows = matches.withColumn("hit", F.col("tp").cast("long"))
    order = [F.desc("score"), F.col("image_id"), F.col("pred_id")]
    counted = running_counts(rows, groups, order, -F.floor(F.col("score") * 1000), "hit")
    counted = counted.join(F.broadcast(totals), groups)  # a row for each group
    return counted.withColumns({"precision": F.col("sum_value").cast("double") / F.col("n"), "recall": F.col("sum_value").cast("double") / F.col("n_gt")})


def average_precision(curve: DataFrame, groups: list[str], levels: int = LEVELS) -> DataFrame:
    """Mean over the recalls 0, 1/levels, ..., 1 of the greatest precision at that recall or more (0 for none)."""
    step = 1.0 / levels
    near = F.floor(F.col("recall") * levels)
    level = F.when(F.col("recall") >= (near + 1) * F.lit(step), near + 1).when(F.col("recall") >= near * F.lit(step), near).otherwise(near - 1)
    tops = curve.withColumn("level", F.least(level, F.lit(levels))).groupBy(*groups, "level").agg(F.max("precision").alias("top"))
    above = W.partitionBy(*groups).orderBy("level").rowsBetween(W.currentRow, W.unboundedFollowing)
    below = W.partitionBy(*groups).orderBy("level")
    tops = tops.withColumns({"best": F.max("top").over(above), "low": F.coalesce(F.lag("level").over(below), F.lit(-1))})
    return tops.groupBy(*groups).agg((F.sum(F.col("best") * (F.col("level") - F.col("low"))) / (levels + 1)).alias("ap"))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))}
