"""Detection queries over the box fixtures: pairs, matching, average precision and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from annulus.operators import detection as D
from annulus.registry import query
from annulus.sources.boxes import INSET, SQL, gt_boxes, polygons, pred_boxes

THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
IN_SQL = ", ".join(map(str, THRESHOLDS))
MATCH_SQL = f"""{SQL}, best AS (
  SELECT image_id, pred_id, score, arg_max(ann_id, struct_pack(a := iou, b := -ann_id)) AS ann_id, max(iou) AS iou FROM ious GROUP BY image_id, pred_id, score),
matched AS (
  SELECT t.threshold, p.image_id, p.pred_id, p.score, b.ann_id, coalesce(b.iou >= t.threshold, false) AS reached
  FROM pred p CROSS JOIN (SELECT unnest([{IN_SQL}])::DOUBLE AS threshold) t LEFT JOIN best b USING (image_id, pred_id)),
m4 AS (
  SELECT threshold, image_id, pred_id, score, ann_id,
    reached AND row_number() OVER (PARTITION BY threshold, image_id, reached, CASE WHEN reached THEN ann_id ELSE -pred_id END ORDER BY score DESC, pred_id) = 1 AS tp
  FROM matched)"""
AP_SQL = """, curve AS (
  SELECT {g}, sum(tp::INT) OVER w AS tps, count(*) OVER w AS n, n_gt
  FROM {m} JOIN totals USING ({g}) WINDOW w AS (PARTITION BY {g} ORDER BY score DESC, image_id, pred_id ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT {g}, tps::DOUBLE / n AS p, tps::DOUBLE / n_gt AS r FROM curve),
levels AS (SELECT unnest(range(0, 101)) AS i),
tops AS (SELECT {g}, i, max(p) AS top FROM pr JOIN levels ON r >= i * 0.01::DOUBLE GROUP BY {g}, i)
SELECT {g}, round(sum(top) / 101, 9) AS ap FROM tops GROUP BY {g}"""


def matches(spark: SparkSession, sf_dir: str, thresholds: list[float] = THRESHOLDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    gt, pred = gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir)
    return D.greedy_match(D.iou_pairs(gt, pred), pred, thresholds), gt, pred


def each_threshold(df: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    return df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))


@query(f"{SQL} SELECT * FROM gt")
def gt_boxes_table(spark, sf_dir):
    return gt_boxes(spark, sf_dir)


@query(f"{SQL} SELECT * FROM pred")
def pred_boxes_table(spark, sf_dir):
    return pred_boxes(spark, sf_dir)


@query(f"{SQL} SELECT image_id, ann_id, pred_id, inter, iou FROM ious")
def iou_pairs(spark, sf_dir):
    return D.iou_pairs(gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir)).select("image_id", "ann_id", "pred_id", "inter", "iou")


@query(f"{SQL} SELECT ann_id, pred_id, inter::DOUBLE / greatest(least(g_area, p_area), 1e-8) AS overlap_small, inter::DOUBLE / g_area AS iof FROM ious")
def overlap_ratios(spark, sf_dir):
    pairs = D.iou_pairs(gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir))
    inter = F.col("inter").cast("double")
    return pairs.select("ann_id", "pred_id", (inter / F.greatest(F.least("g_area", "p_area"), F.lit(1e-8))).alias("overlap_small"), (inter / F.col("g_area")).alias("iof"))


@query(f"""{SQL}, h AS (SELECT ann_id, pred_id, (g.x1-g.x0)*(g.y1-g.y0) + (p.x1-p.x0)*(p.y1-p.y0) AS both_areas, (least(g.x1, p.x1) - greatest(g.x0, p.x0)) * (least(g.y1, p.y1) - greatest(g.y0, p.y0)) AS inter,
  (greatest(g.x1, p.x1) - least(g.x0, p.x0)) * (greatest(g.y1, p.y1) - least(g.y0, p.y0)) AS hull FROM gt g JOIN pred p ON g.image_id = p.image_id AND g.x0 < p.x1 AND p.x0 < g.x1 AND g.y0 < p.y1 AND p.y0 < g.y1)
SELECT ann_id, pred_id, inter::DOUBLE / (both_areas - inter) - (hull - (both_areas - inter))::DOUBLE / hull AS giou FROM h""")
def generalised_iou(spark, sf_dir):
    pairs = D.iou_pairs(gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir))
    c = F.col
    hull = (F.greatest("g_x1", "p_x1") - F.least("g_x0", "p_x0")) * (F.greatest("g_y1", "p_y1") - F.least("g_y0", "p_y0"))
    return pairs.withColumn("hull", hull).select("ann_id", "pred_id", (c("iou") - (c("hull") - (c("g_area") + c("p_area") - c("inter"))).cast("double") / c("hull")).alias("giou"))


def framed_overlap(a: int, b: int) -> Column:
    """Area shared by box a of a pair inset by a, and box b inset by b."""
    c = F.col
    w = F.least(c("g_x1") - a, c("p_x1") - b) - F.greatest(c("g_x0") + a, c("p_x0") + b)
    h = F.least(c("g_y1") - a, c("p_y1") - b) - F.greatest(c("g_y0") + a, c("p_y0") + b)
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def framed_sql(a: int, b: int) -> str:
    return f"greatest(least(g.x1-{a}, p.x1-{b}) - greatest(g.x0+{a}, p.x0+{b}), 0) * greatest(least(g.y1-{a}, p.y1-{b}) - greatest(g.y0+{a}, p.y0+{b}), 0)"


FRAMED_SQL = f"""{SQL}, framed AS (
  SELECT g.image_id, g.ann_id, p.pred_id, p.score, {framed_sql(0, 0)} - CASE WHEN p.has_hole THEN {framed_sql(0, INSET)} ELSE 0 END
    - CASE WHEN g.has_hole THEN {framed_sql(INSET, 0)} ELSE 0 END + CASE WHEN g.has_hole AND p.has_hole THEN {framed_sql(INSET, INSET)} ELSE 0 END AS inter,
    (g.x1-g.x0)*(g.y1-g.y0) - CASE WHEN g.has_hole THEN (g.x1-g.x0-12)*(g.y1-g.y0-12) ELSE 0 END AS g_area,
    (p.x1-p.x0)*(p.y1-p.y0) - CASE WHEN p.has_hole THEN (p.x1-p.x0-12)*(p.y1-p.y0-12) ELSE 0 END AS p_area
  FROM gt g JOIN pred p ON g.image_id = p.image_id AND g.x0 < p.x1 AND p.x0 < g.x1 AND g.y0 < p.y1 AND p.y0 < g.y1),
framed_ious AS (SELECT image_id, ann_id, pred_id, score, inter, inter::DOUBLE / (g_area + p_area - inter) AS iou FROM framed WHERE inter > 0)"""


def framed_pairs(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs of boxes with holes: shared area by inclusion and exclusion, IoU of what is not hole."""
    c, when = F.col, lambda k, v: F.when(F.col(k), v).otherwise(F.lit(0))
    area = lambda s: D.box_area(f"{s}_") - when(f"{s}_has_hole", (c(f"{s}_x1") - c(f"{s}_x0") - 2 * INSET) * (c(f"{s}_y1") - c(f"{s}_y0") - 2 * INSET))
    both = F.when(c("g_has_hole") & c("p_has_hole"), framed_overlap(INSET, INSET)).otherwise(F.lit(0))
    inter = framed_overlap(0, 0) - when("p_has_hole", framed_overlap(0, INSET)) - when("g_has_hole", framed_overlap(INSET, 0)) + both
    pairs = D.overlapping(gt, pred).withColumns({"inter": inter, "g_area": area("g"), "p_area": area("p")}).where("inter > 0")
    pairs = pairs.withColumnsRenamed({"g_ann_id": "ann_id", "p_pred_id": "pred_id", "p_score": "score"})
    return pairs.select("image_id", "ann_id", "pred_id", "score", "inter", (c("inter").cast("double") / (c("g_area") + c("p_area") - c("inter"))).alias("iou"), "g_has_hole", "p_has_hole")


@query(f"{FRAMED_SQL} SELECT image_id, ann_id, pred_id, inter, iou FROM framed_ious")
def polygon_iou_pairs(spark, sf_dir):
    return framed_pairs(gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir)).select("image_id", "ann_id", "pred_id", "inter", "iou")


@query(f"{MATCH_SQL} SELECT threshold, image_id, pred_id, tp, CASE WHEN tp THEN ann_id END AS ann_id FROM m4")
def greedy_matches(spark, sf_dir):
    found, _, _ = matches(spark, sf_dir)
    return found.select("threshold", "image_id", "pred_id", "tp", F.when(F.col("tp"), F.col("ann_id")).alias("ann_id"))


@query(f"{MATCH_SQL}, totals AS (SELECT threshold, n_gt FROM (SELECT unnest([{IN_SQL}])::DOUBLE AS threshold), (SELECT count(*) AS n_gt FROM gt))" + AP_SQL.format(g="threshold", m="m4"))
def poly_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred = gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir)
    return D.average_precisions(D.iou_pairs(gt, pred), pred, THRESHOLDS, gt).select("threshold", F.round("ap", 9).alias("ap"))


@query(f"""{MATCH_SQL.replace('ious GROUP', 'framed_ious GROUP').replace(SQL, FRAMED_SQL)},
totals AS (SELECT threshold, n_gt FROM (SELECT unnest([{IN_SQL}])::DOUBLE AS threshold), (SELECT count(*) AS n_gt FROM gt))""" + AP_SQL.format(g="threshold", m="m4"))
def poly_ap_with_holes(spark, sf_dir):
    gt, pred = gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir)
    return D.average_precisions(framed_pairs(gt, pred), pred, THRESHOLDS, gt).select("threshold", F.round("ap", 9).alias("ap"))


@query(f"""{MATCH_SQL}, s AS (SELECT threshold, sum(tp::INT)::BIGINT AS tp, sum((NOT tp)::INT)::BIGINT AS fp, (SELECT count(*) FROM gt) - sum(tp::INT)::BIGINT AS fn FROM m4 GROUP BY threshold)
SELECT threshold, tp, fp, fn, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall,
  2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / (tp + fn)) AS f1 FROM s""")
def precision_recall_summary(spark, sf_dir):
    found, gt, _ = matches(spark, sf_dir)
    totals = each_threshold(gt.agg(F.count("*").alias("n_gt")))
    sums = found.groupBy("threshold").agg(F.count_if("tp").alias("tp"), F.count_if(~F.col("tp")).alias("fp")).join(F.broadcast(totals), "threshold")
    sums = sums.select("threshold", "tp", "fp", (F.col("n_gt") - F.col("tp")).alias("fn"))
    return sums.withColumns(D.prf(F.col("tp"), F.col("fp"), F.col("fn")))


@query(f"{SQL}, best AS (SELECT ann_id, max(struct_pack(a := iou, b := -pred_id)) AS m FROM ious GROUP BY ann_id) SELECT ann_id, -m.b AS pred_id, m.a AS iou FROM best WHERE m.a > 0.5")
def best_box_match(spark, sf_dir):
    pairs = D.iou_pairs(gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir))
    best = pairs.groupBy("ann_id").agg(F.max(F.struct("iou", (-F.col("pred_id")).alias("n"))).alias("m")).where("m.iou > 0.5")
    return best.select("ann_id", (-F.col("m.n")).alias("pred_id"), F.col("m.iou").alias("iou"))


CLASS_SQL = f"""{SQL}, same AS (SELECT * FROM ious WHERE g_hole = p_hole),
best AS (SELECT image_id, pred_id, score, p_hole, arg_max(ann_id, struct_pack(a := iou, b := -ann_id)) AS ann_id, max(iou) AS iou FROM same GROUP BY ALL),
matched AS (SELECT p.has_hole, p.image_id, p.pred_id, p.score, b.ann_id, coalesce(b.iou >= 0.5, false) AS reached FROM pred p LEFT JOIN best b USING (image_id, pred_id)),
voc AS (SELECT has_hole, image_id, pred_id, score, reached AND row_number() OVER (PARTITION BY image_id, has_hole, reached, CASE WHEN reached THEN ann_id ELSE -pred_id END ORDER BY score DESC, pred_id) = 1 AS tp FROM matched),
totals AS (SELECT has_hole, count(*) AS n_gt FROM gt GROUP BY has_hole)"""


@query(CLASS_SQL + AP_SQL.format(g="has_hole", m="voc"))
def class_average_precision(spark, sf_dir):
    gt, pred = gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir)
    pairs = D.iou_pairs(gt, pred).where("g_hole = p_hole")
    found = D.greedy_match(pairs, pred, [0.5]).join(pred.select("image_id", "pred_id", "has_hole"), ["image_id", "pred_id"])
    totals = gt.groupBy("has_hole").agg(F.count("*").alias("n_gt"))
    return D.average_precision(D.precision_recall(found, ["has_hole"], totals), ["has_hole"]).select("has_hole", F.round("ap", 9).alias("ap"))


@query(f"""{MATCH_SQL}, m AS (SELECT m4.*, g.has_hole AS gh, p.has_hole AS ph FROM m4 JOIN gt g USING (ann_id) JOIN pred p USING (pred_id) WHERE tp)
SELECT threshold, round(avg(abs(gh::INT - ph::INT)), 9) AS hole_count_mae, sum((gh = ph)::INT)::BIGINT AS equal_counts,
  round(sum((gh = ph)::INT) / (count(*) + (SELECT count(*) FROM gt) - count(*) + (SELECT count(*) FROM pred) - count(*)), 9) AS same_topology_rate FROM m GROUP BY threshold""")
def hole_counts(spark, sf_dir):
    found, gt, pred = matches(spark, sf_dir)
    m = found.where("tp").join(gt.select("image_id", "ann_id", F.col("has_hole").cast("int").alias("gh")), ["image_id", "ann_id"]).join(pred.select("image_id", "pred_id", F.col("has_hole").cast("int").alias("ph")), ["image_id", "pred_id"])
    totals = each_threshold(gt.agg(F.count("*").alias("n_gt"))).join(each_threshold(pred.agg(F.count("*").alias("n_pred"))), "threshold")
    sums = m.groupBy("threshold").agg(F.avg(F.abs(F.col("gh") - F.col("ph"))).alias("mae"), F.count_if(F.col("gh") == F.col("ph")).alias("equal_counts"), F.count("*").alias("n"))
    rate = F.col("equal_counts") / (F.col("n_gt") + F.col("n_pred") - F.col("n"))  # matched, and unmatched of both sides
    return sums.join(F.broadcast(totals), "threshold").select("threshold", F.round("mae", 9).alias("hole_count_mae"), "equal_counts", F.round(rate, 9).alias("same_topology_rate"))


@query(f"""{SQL}, s AS (SELECT image_id, sum(inter)::BIGINT AS i FROM ious GROUP BY image_id), u AS (SELECT image_id, sum((x1-x0)*(y1-y0))::BIGINT AS a FROM gt GROUP BY image_id)
SELECT (sum(coalesce(i, 0))::DOUBLE / sum(a)) AS cumulative, round(avg(coalesce(i, 0)::DOUBLE / a), 9) AS mean FROM u LEFT JOIN s USING (image_id)""")
def cumulative_and_mean_overlap(spark, sf_dir):
    gt = gt_boxes(spark, sf_dir)
    inter = D.iou_pairs(gt, pred_boxes(spark, sf_dir)).groupBy("image_id").agg(F.sum("inter").alias("i"))
    area = gt.groupBy("image_id").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("a"))
    both = area.join(inter, "image_id", "left").withColumn("i", F.coalesce("i", F.lit(0)))
    return both.agg((F.sum("i").cast("double") / F.sum("a")).alias("cumulative"), F.round(F.avg(F.col("i").cast("double") / F.col("a")), 9).alias("mean"))


@query(f"""{SQL}, ranked AS (SELECT ann_id, iou, row_number() OVER (PARTITION BY image_id, ann_id ORDER BY score DESC, pred_id) AS r FROM ious),
hit AS (SELECT ann_id, k, max((iou >= 0.5)::INT) AS hit FROM ranked JOIN (SELECT unnest([1, 2, 5])::INT AS k) ON r <= k GROUP BY ann_id, k)
SELECT k, round(sum(hit) / (SELECT count(*) FROM gt), 9) AS precision_at_k FROM hit GROUP BY k""")
def precision_at_k(spark, sf_dir):
    gt = gt_boxes(spark, sf_dir)
    pairs = D.iou_pairs(gt, pred_boxes(spark, sf_dir))
    first = W.partitionBy("image_id", "ann_id").orderBy(F.desc("score"), "pred_id")
    ranked = pairs.withColumn("r", F.row_number().over(first)).where("r <= 5").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5)))).where("r <= k")
    hit = ranked.groupBy("ann_id", "k").agg(F.max((F.col("iou") >= 0.5).cast("int")).alias("hit")).groupBy("k").agg(F.sum("hit").alias("hits"))
    total = gt.agg(F.count("*").alias("n")).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))))
    return hit.join(F.broadcast(total), "k").select("k", F.round(F.col("hits") / F.col("n"), 9).alias("precision_at_k"))


@query(f"""{SQL}, inner_boxes AS (SELECT i.image_id, i.ann_id AS child, o.ann_id AS parent, (o.x1-o.x0)*(o.y1-o.y0) AS area FROM gt i JOIN gt o ON i.image_id = o.image_id AND i.ann_id <> o.ann_id
  AND o.x0 <= i.x0 AND o.y0 <= i.y0 AND o.x1 >= i.x1 AND o.y1 >= i.y1 AND (o.x1-o.x0)*(o.y1-o.y0) > (i.x1-i.x0)*(i.y1-i.y0)),
p AS (SELECT child, arg_min(parent, struct_pack(a := area, b := parent)) AS parent, count(*) AS depth FROM inner_boxes GROUP BY child)
SELECT g.ann_id, p.parent, coalesce(p.depth, 0) AS containers FROM gt g LEFT JOIN p ON g.ann_id = p.child""")
def box_hierarchy(spark, sf_dir):
    gt = gt_boxes(spark, sf_dir)
    pairs = D.overlapping(gt, gt.withColumnRenamed("ann_id", "pred_id")).where("g_x0 >= p_x0 and g_y0 >= p_y0 and g_x1 <= p_x1 and g_y1 <= p_y1 and g_ann_id <> p_pred_id")
    pairs = pairs.where(D.box_area("p_") > D.box_area("g_"))
    parents = pairs.groupBy("g_ann_id").agg(F.min(F.struct(D.box_area("p_").alias("a"), F.col("p_pred_id").alias("id"))).alias("m"), F.count("*").alias("containers"))
    return gt.join(parents, gt["ann_id"] == parents["g_ann_id"], "left").select("ann_id", F.col("m.id").alias("parent"), F.coalesce("containers", F.lit(0)).alias("containers"))


@query(f"""{SQL}, p AS (SELECT image_id, pred_id, score, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pred_id) AS r FROM pred WHERE score >= 0.5) SELECT image_id, pred_id, score, r AS rank FROM p WHERE r <= 5""")
def top_predictions(spark, sf_dir):
    best = W.partitionBy("image_id").orderBy(F.desc("score"), "pred_id")
    return pred_boxes(spark, sf_dir).where("score >= 0.5").withColumn("rank", F.row_number().over(best)).where("rank <= 5").select("image_id", "pred_id", "score", "rank")


@query(f"""{SQL}, n AS (SELECT coalesce(g.image_id, p.image_id) AS image_id, coalesce(g.n, 0) AS n_gt, coalesce(p.n, 0) AS n_pred
  FROM (SELECT image_id, count(*) AS n FROM gt GROUP BY image_id) g FULL JOIN (SELECT image_id, count(*) AS n FROM pred GROUP BY image_id) p ON g.image_id = p.image_id)
SELECT * FROM n ORDER BY n_gt DESC, image_id LIMIT 50""")
def images_by_count(spark, sf_dir):
    count = lambda df, name: df.groupBy("image_id").agg(F.count("*").alias(name))
    both = count(gt_boxes(spark, sf_dir), "n_gt").join(count(pred_boxes(spark, sf_dir), "n_pred"), "image_id", "full_outer").na.fill(0)
    return both.orderBy(F.desc("n_gt"), "image_id").limit(50)
