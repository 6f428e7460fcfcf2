"""Metrics beyond average precision: corners, topology, phrases, hard objects, groups, point tests and legacy distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from annulus.functions import rings as R
from annulus.functions import simplify as S
from annulus.operators import detection as D
from annulus.operators.evaluator import corner_hits
from annulus.plans.detection import MATCH_SQL, framed_overlap, framed_sql, matches
from annulus.plans.matching import image_f1
from annulus.registry import SQL as ORACLES
from annulus.registry import query
from annulus.sources.boxes import INSET, SQL, gt_boxes, polygons, pred_boxes

C = F.col


def true_pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matched pairs at 0.5 with both boxes (prefixes g_ and p_), and both sides."""
    found, gt, pred = matches(spark, sf_dir, [0.5])
    both = found.where("tp").select("image_id", "ann_id", "pred_id")
    for df, key, mark in ((gt, "ann_id", "g_"), (pred, "pred_id", "p_")):
        both = both.join(df.select("image_id", key, *[C(c).alias(mark + c) for c in ("x0", "y0", "x1", "y1", "has_hole")]), ["image_id", key])
    return both, gt, pred


PAIRED = f"""{MATCH_SQL}, mt AS (SELECT ann_id, pred_id FROM m4 WHERE tp AND threshold = 0.5)"""


def leaning(boxes: DataFrame) -> DataFrame:
    """polygons sheared by -1/2, 0 or 1/2 along x."""
    by, y0 = (C("ann_id") % 3 - 1) / F.lit(2.0), C("y0")
    shear = lambda ring: R.mapped(ring, lambda p: p["x"] + (p["y"] - y0) * by, lambda p: p["y"])
    return polygons(boxes).withColumns({"exterior": shear(C("exterior")), "holes": F.transform("holes", shear)})


@query(f"""{SQL}, c AS (SELECT ann_id, pred_id, p.x0 + 2 - (p.y0 + 3 - g.y0) * (ann_id % 3 - 1) / 2.0::DOUBLE AS u, p.y0 + 3 AS v, g.x0, g.y0, g.x1, g.y1, g.has_hole
  FROM gt g JOIN pred p ON g.image_id = p.image_id AND g.x0 < p.x1 AND p.x0 < g.x1 AND g.y0 < p.y1 AND p.y0 < g.y1)
SELECT ann_id, pred_id, v BETWEEN y0 AND y1 AND u BETWEEN x0 AND x1 AND NOT (has_hole AND v > y0 + 6 AND v < y1 - 6 AND u > x0 + 6 AND u < x1 - 6) AS covered FROM c""")
def covered_points(spark, sf_dir):
    """Whether leaning polygons with holes cover a point of each prediction that their box meets; boundaries count."""
    pairs = D.overlapping(gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir)).select(*[C(f"g_{c}").alias(c) for c in ("ann_id", "x0", "y0", "x1", "y1", "has_hole")], "p_pred_id", (C("p_x0") + 2).cast("double").alias("px"), (C("p_y0") + 3).cast("double").alias("py"))
    return leaning(pairs).select("ann_id", C("p_pred_id").alias("pred_id"), R.covers(C("exterior"), C("holes"), C("px"), C("py")).alias("covered"))


@query(f"""{SQL} SELECT ann_id, pred_id, greatest(abs(g.x0 - p.x0), abs(g.y0 - p.y0), abs(g.x1 - p.x1), abs(g.y1 - p.y1)) < 1.5 AS same FROM ious JOIN gt g USING (ann_id) JOIN pred p USING (pred_id)""")
def same_outlines(spark, sf_dir):
    """Pairs whose outlines agree vertex by vertex within 1.5."""
    ring = lambda df, key, name: polygons(df).select(key, C("exterior").alias(name))
    gt, pred = gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir)
    pairs = D.iou_pairs(gt, pred).select("ann_id", "pred_id").join(ring(gt, "ann_id", "a"), "ann_id").join(ring(pred, "pred_id", "b"), "pred_id")
    return pairs.select("ann_id", "pred_id", R.same_outline(C("a"), C("b"), 1.5).alias("same"))


@query(f"""{PAIRED}, v AS (SELECT ann_id, mt.pred_id, unnest([0, 1, 2, 3]) AS i, unnest([g.x0, g.x1, g.x1, g.x0]) AS ax, unnest([g.y0, g.y0, g.y1, g.y1]) AS ay FROM mt JOIN gt g USING (ann_id)),
w AS (SELECT pred_id, unnest([0, 1, 2, 3]) AS j, unnest([x0, x1, x1, x0]) AS bx, unnest([y0, y0, y1, y1]) AS b_y FROM pred WHERE pred_id IN (SELECT pred_id FROM mt)), s AS (SELECT unnest([0, 1, 2]) AS shift),
c AS (SELECT ann_id, v.pred_id, shift, sum(sqrt(((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y))::DOUBLE)) AS cost FROM v CROSS JOIN s JOIN w ON w.pred_id = v.pred_id AND w.j = (i + shift + ann_id % 4) % 4 GROUP BY ALL)
SELECT ann_id, pred_id, round(min(cost), 9) AS cost, arg_min(shift, round(cost, 6) + shift * 1e-7) AS shift FROM c GROUP BY ALL""")
def aligned_rings(spark, sf_dir):
    """Of each matched pair, how far to roll the prediction's ring, which begins 0 to 3 vertices late, so that it lies nearest."""
    both, _, _ = true_pairs(spark, sf_dir)
    ring = lambda m: F.array(*[R.point(C(m + a), C(m + b)) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    k = (C("ann_id") % 4).cast("int")
    # to begin the truth's ring as many vertices early gives the same pairs, and their distances are added in the SQL's order
    early = F.concat(F.slice(ring("g_"), 5 - k, k), F.slice(ring("g_"), F.lit(1), 4 - k))
    best = R.best_roll(early, ring("p_"))
    return both.select("ann_id", "pred_id", best.alias("b")).select("ann_id", "pred_id", F.round("b.cost", 9).alias("cost"), C("b.shift").alias("shift"))


@query(f"""{SQL}, g AS (SELECT *, ann_id % 5 AS phrase FROM gt), k AS (SELECT *, (abs(pred_id) + (abs(pred_id) % 11 < 4)::INT) % 5 AS phrase FROM pred WHERE score >= 0.4), q AS (SELECT *, row_number() OVER (PARTITION BY image_id, phrase ORDER BY score DESC, pred_id) AS place FROM k),
h AS (SELECT i.image_id, ann_id % 5 AS phrase, min(place) AS place FROM ious i JOIN q USING (pred_id) WHERE ann_id % 5 = q.phrase AND iou >= 0.5 GROUP BY ALL), a AS (SELECT DISTINCT image_id, phrase FROM g),
t AS (SELECT unnest([1, 5, 10, -1]) AS k) SELECT t.k, sum((coalesce(place <= CASE WHEN t.k < 0 THEN 1000000 ELSE t.k END, false))::INT)::BIGINT AS found, count(*) AS phrases FROM a CROSS JOIN t LEFT JOIN h USING (image_id, phrase) GROUP BY t.k""")
def phrase_recall(spark, sf_dir):
    """How many phrases have a box of theirs met by one of the first k boxes predicted for them; k -1: by any."""
    gt = gt_boxes(spark, sf_dir).withColumn("phrase", C("ann_id") % 5)
    pred = pred_boxes(spark, sf_dir).where("score >= 0.4").withColumn("phrase", (F.abs("pred_id") + (F.abs("pred_id") % 11 < 4).cast("int")) % 5)  # some under a wrong phrase
    pred = pred.withColumn("place", F.row_number().over(W.partitionBy("image_id", "phrase").orderBy(F.desc("score"), "pred_id")))
    hits = D.iou_pairs(gt, pred).where("g_phrase = p_phrase and iou >= 0.5").groupBy("image_id", C("g_phrase").alias("phrase")).agg(F.min("p_place").alias("place"))
    asked = gt.select("image_id", "phrase").distinct().join(hits, ["image_id", "phrase"], "left")
    each = asked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 5, 10, -1)])))
    within = C("place").isNotNull() & ((C("k") < 0) | (C("place") <= C("k")))
    return each.groupBy("k").agg(F.count_if(within).alias("found"), F.count("*").alias("phrases"))


@query(f"""{SQL}, h AS (SELECT DISTINCT ann_id FROM ious JOIN pred USING (pred_id) WHERE ann_id % 3 = abs(pred_id) % 3 AND ious.score >= 0.5 AND iou >= 0.75)
SELECT CASE WHEN ann_id % 7 = 0 THEN 'occluded' WHEN ann_id % 7 = 1 THEN 'separated' ELSE 'other' END AS kind, count(*) AS n, count(h.ann_id) AS recalled, round(count(h.ann_id) / count(*), 9) AS recall FROM gt LEFT JOIN h USING (ann_id) GROUP BY kind""")
def hard_object_recall(spark, sf_dir):
    """Recall of occluded and of separated objects: a detection of the class over the score and overlap is enough."""
    gt, pred = gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir)
    met = D.iou_pairs(gt, pred).where("ann_id % 3 = abs(pred_id) % 3 and score >= 0.5 and iou >= 0.75").select("ann_id", F.lit(1).alias("hit")).distinct()
    kind = F.when(C("ann_id") % 7 == 0, "occluded").when(C("ann_id") % 7 == 1, "separated").otherwise("other")
    rows = gt.join(met, "ann_id", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count("hit").alias("recalled"))
    return rows.select("kind", "n", "recalled", F.round(C("recalled") / C("n"), 9).alias("recall"))


@query(f"""{ORACLES['image_f1'].rsplit('SELECT image_id, coalesce(tp', 1)[0]}, f AS (SELECT image_id, image_id % 9 = 0 AS nt, coalesce(k, 0) AS k, CASE WHEN image_id % 9 = 0 THEN (coalesce(k, 0) = 0)::INT ELSE round(2 * coalesce(tp, 0) / (m + coalesce(k, 0)), 9) END AS f1
  FROM n LEFT JOIN q USING (image_id) LEFT JOIN tp USING (image_id))
SELECT round(avg((f1 >= 0.6)::INT), 9) AS f1_score, round(count(*) FILTER (NOT nt AND k >= 1) / count(*) FILTER (NOT nt), 9) AS t_acc, round(count(*) FILTER (nt AND k = 0) / count(*) FILTER (nt), 9) AS n_acc FROM f""")
def no_target_scores(spark, sf_dir, least: float = 0.6):
    """Share of images with an F1 of least or more, an image without target counting as one if nothing is predicted for it; and
    how often images with and without target are told."""
    k = pred_boxes(spark, sf_dir).where("score >= 0.5").groupBy("image_id").agg(F.count("*").alias("k"))
    rows = image_f1(spark, sf_dir).join(k, "image_id", "left").na.fill(0, ["k"]).withColumn("none", C("image_id") % 9 == 0)
    f1 = F.when(C("none"), (C("k") == 0).cast("double")).otherwise(C("f1"))
    ratio = lambda a, b: F.round(F.count_if(a) / F.count_if(b), 9)
    return rows.agg(F.round(F.avg((f1 >= least).cast("int")), 9).alias("f1_score"), ratio(~C("none") & (C("k") >= 1), ~C("none")).alias("t_acc"), ratio(C("none") & (C("k") == 0), C("none")).alias("n_acc"))


@query(f"""{SQL}, one AS (SELECT * FROM ious JOIN (SELECT ann_id FROM gt WHERE ann_id % 6 <> 0) USING (ann_id)), best AS (SELECT pred_id, arg_max(ann_id, struct_pack(a := iou, b := -ann_id)) AS ann_id, max(iou) AS iou FROM one GROUP BY pred_id),
m AS (SELECT p.image_id, p.pred_id, p.score, coalesce(iou >= 0.5, false) AS reached, ann_id FROM pred p LEFT JOIN best USING (pred_id)),
t AS (SELECT *, reached AND row_number() OVER (PARTITION BY image_id, reached, CASE WHEN reached THEN ann_id ELSE -pred_id END ORDER BY score DESC, pred_id) = 1 AS tp FROM m),
g AS (SELECT i.pred_id, arg_max(i.ann_id, struct_pack(a := inter::DOUBLE / p_area, b := -i.ann_id)) AS grp, max(inter::DOUBLE / p_area) AS iof FROM ious i JOIN t ON t.pred_id = i.pred_id AND NOT t.tp WHERE i.ann_id % 6 = 0 GROUP BY i.pred_id),
r AS (SELECT t.pred_id, t.tp, CASE WHEN NOT t.tp AND iof >= 0.5 THEN grp END AS grp, t.score FROM t LEFT JOIN g USING (pred_id))
SELECT pred_id, CASE WHEN tp THEN 'true' WHEN grp IS NULL THEN 'false' WHEN row_number() OVER (PARTITION BY grp ORDER BY score DESC, pred_id) = 1 THEN 'group' ELSE 'left out' END AS kind FROM r""")
def group_of_matches(spark, sf_dir):
    """Detections against single boxes, the rest against boxes that stand for groups: of those that lie by half or more in a
    group the best one counts as true, the others not at all."""
    gt, pred = gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir)
    pairs = D.iou_pairs(gt, pred)
    found = D.greedy_match(pairs.where("ann_id % 6 <> 0"), pred, [0.5]).select("image_id", "pred_id", "score", "tp")
    within = pairs.where("ann_id % 6 = 0").select("pred_id", "ann_id", (C("inter") / C("p_area")).alias("iof")).join(found.where("not tp").select("pred_id"), "pred_id", "left_semi")
    group = within.groupBy("pred_id").agg(F.max(F.struct("iof", (-C("ann_id")).alias("n"))).alias("g")).where("g.iof >= 0.5").select("pred_id", (-C("g.n")).alias("grp"))
    rows = found.join(group, "pred_id", "left")
    first = F.row_number().over(W.partitionBy(F.coalesce("grp", "pred_id"), C("grp").isNull()).orderBy(F.desc("score"), "pred_id")) == 1
    return rows.select("pred_id", F.when(C("tp"), "true").when(C("grp").isNull(), "false").when(first, "group").otherwise("left out").alias("kind"))


def _near_corners(square: int) -> str:
    return " + ".join(f"((g.{x}-p.{x})*(g.{x}-p.{x}) + (g.{y}-p.{y})*(g.{y}-p.{y}) <= {square})::INT" for x in ("x0", "x1") for y in ("y0", "y1"))


@query(f"""{PAIRED}, c AS (SELECT {_near_corners(4)} AS near, {_near_corners(25)} AS wide FROM mt JOIN gt g USING (ann_id) JOIN pred p USING (pred_id)),
s AS (SELECT unnest([2.0, 5.0])::DOUBLE AS threshold, unnest([sum(near), sum(wide)])::BIGINT AS tp, 4 * (SELECT count(*) FROM pred) AS np, 4 * (SELECT count(*) FROM gt) AS ng FROM c)
SELECT threshold, tp, np - tp AS fp, ng - tp AS fn, round(2 * tp / (np + ng), 9) AS f1 FROM s""")
def corner_f1(spark, sf_dir):
    """Corners of simplified outlines, densified first, paired within 2 and 5 units; those of unmatched rings are missed or false."""
    both, gt, pred = true_pairs(spark, sf_dir)
    outline = lambda m: R.densify(F.array(*[R.point(C(m + a), C(m + b)) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]), 12.0)
    corners = S.simplify_ring(S.simplify_ring(both, "a", outline("g_"), 1.0), "b", outline("p_"), 1.0)
    size = lambda df, name: df.agg((4 * F.count("*")).alias(name))
    sums = corners.select(corner_hits(C("a"), C("b"), [2.0, 5.0]).alias("hits")).agg(F.sum(C("hits")[0]).alias("h2"), F.sum(C("hits")[1]).alias("h5"))
    rows = sums.select(F.explode(F.array(F.struct(F.lit(2.0).alias("threshold"), C("h2").alias("tp")), F.struct(F.lit(5.0).alias("threshold"), C("h5").alias("tp")))).alias("s")).select("s.*")
    rows = rows.join(F.broadcast(size(pred, "np"))).join(F.broadcast(size(gt, "ng")))  # a row each
    return rows.select("threshold", "tp", (C("np") - C("tp")).alias("fp"), (C("ng") - C("tp")).alias("fn"), F.round(2 * C("tp") / (C("np") + C("ng")), 9).alias("f1"))


def _frame_sql(at: int) -> str:
    def area(a: int, b: int) -> str:
        return framed_sql(a, b).replace("--1", "+1").replace("+-1", "-1")

    inter = f"({area(at - 1, at - 1)} - {area(at - 1, at + 1)} - {area(at + 1, at - 1)} + {area(at + 1, at + 1)})"
    size = " + ".join(f"(({t}.x1-{t}.x0) + ({t}.y1-{t}.y0) - {4 * at}) * 4" for t in "gp")
    return f"{inter}::DOUBLE / ({size} - {inter})"


def frame_iou(at: int) -> Column:
    """IoU of bands of radius 1 along both boxes' outlines, inset by at."""
    inter = framed_overlap(at - 1, at - 1) - framed_overlap(at - 1, at + 1) - framed_overlap(at + 1, at - 1) + framed_overlap(at + 1, at + 1)
    size = lambda m: (C(m + "x1") - C(m + "x0") + C(m + "y1") - C(m + "y0") - 4 * at) * 4
    return F.try_divide(inter.cast("double"), size("g_") + size("p_") - inter)


@query(f"""{PAIRED}, t AS (SELECT {_frame_sql(0)} >= 0.5 AND g.has_hole = p.has_hole AND (NOT g.has_hole OR {_frame_sql(INSET)} >= 0.5) AS exact FROM mt JOIN gt g USING (ann_id) JOIN pred p USING (pred_id))
SELECT sum(exact::INT)::BIGINT AS exact, count(*) AS matched, round(sum(exact::INT) / ((SELECT count(*) FROM gt) + (SELECT count(*) FROM pred) - count(*)), 9) AS rate FROM t""")
def topology_exact_rate(spark, sf_dir, least: float = 0.5):
    """Share of pairs whose outlines' bands agree, with as many holes, each matched; unmatched polygons of both sides count against it."""
    both, gt, pred = true_pairs(spark, sf_dir)
    alike = (frame_iou(0) >= least) & (C("g_has_hole") == C("p_has_hole")) & (~C("g_has_hole") | (frame_iou(INSET) >= least))
    sums = both.agg(F.count_if(alike).alias("exact"), F.count("*").alias("matched"))
    for df, name in ((gt, "ng"), (pred, "np")):
        sums = sums.join(F.broadcast(df.agg(F.count("*").alias(name))))  # a row each
    return sums.select("exact", "matched", F.round(C("exact") / (C("ng") + C("np") - C("matched")), 9).alias("rate"))


def _to_box(x: str, y: str, t: str) -> str:
    inside = f"{x} BETWEEN {t}.x0 AND {t}.x1 AND {y} BETWEEN {t}.y0 AND {t}.y1"
    near = f"least({x} - {t}.x0, {t}.x1 - {x}, {y} - {t}.y0, {t}.y1 - {y})"
    gap = lambda v, k: f"greatest({t}.{k}0 - {v}, {v} - {t}.{k}1, 0)"
    return f"CASE WHEN {inside} THEN {near} ELSE sqrt(({gap(x, 'x')} * {gap(x, 'x')} + {gap(y, 'y')} * {gap(y, 'y')})::DOUBLE) END"


def _corners_to_box(a: str, b: str) -> str:
    return " + ".join(_to_box(f"{a}.{x}", f"{a}.{y}", b) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))


@query(f"""{PAIRED}, d AS (SELECT g.image_id, (({_corners_to_box('g', 'p')}) + ({_corners_to_box('p', 'g')}))::DOUBLE / 10 AS d FROM mt JOIN gt g USING (ann_id) JOIN pred p USING (pred_id)),
i AS (SELECT image_id, avg(d) AS d, count(*) AS n FROM d GROUP BY image_id) SELECT image_id, n, round(d, 9) AS polis, round((SELECT avg(d) FROM i WHERE d <> 0), 9) AS overall FROM i""")
def legacy_polis(spark, sf_dir):
    """The older form of the distance: outlines only, divided by twice the closed outlines' vertices; the mean of the images'
    means leaves out images of zero."""
    both, _, _ = true_pairs(spark, sf_dir)
    ring = lambda m: F.array(*[R.point(C(m + a), C(m + b)) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    rows = both.select("image_id", R.polis_single(ring("g_"), ring("p_")).alias("d")).groupBy("image_id").agg(F.avg("d").alias("d"), F.count("*").alias("n"))
    overall = rows.agg(F.round(F.avg(F.when(C("d") != 0, C("d"))), 9).alias("overall"))
    return rows.join(F.broadcast(overall)).select("image_id", "n", F.round("d", 9).alias("polis"), "overall")  # a row


@query(f"""{SQL} SELECT image_id // 4 AS tile, count(*) AS predictions, count(*) FILTER (score >= 0.5) AS kept, count(*) FILTER (score >= 0.5 AND has_hole) AS with_holes, count(DISTINCT image_id) FILTER (score >= 0.5) AS images FROM pred GROUP BY tile""")
def source_image_counts(spark, sf_dir):
    """For each source tile: predictions, those kept by score, those with holes, and images that have any."""
    kept = C("score") >= 0.5
    rows = pred_boxes(spark, sf_dir).groupBy(F.expr("image_id div 4").alias("tile"))
    return rows.agg(F.count("*").alias("predictions"), F.count_if(kept).alias("kept"), F.count_if(kept & C("has_hole")).alias("with_holes"), F.count_distinct(F.when(kept, C("image_id"))).alias("images"))


@query(f"""{SQL}, g AS (SELECT DISTINCT image_id FROM gt WHERE image_id % 37 <> 0) SELECT count(*) AS predictions, sum(p.has_hole::INT)::BIGINT AS holes, count(DISTINCT p.image_id) AS images, count(DISTINCT p.image_id) FILTER (g.image_id IS NULL) AS outside,
  count(*) FILTER (pred_id % 150 = 0) AS fallbacks, count(*) FILTER (pred_id % 150 = 0) > 0.01 * count(*) AS fails FROM pred p LEFT JOIN g ON g.image_id = p.image_id""")
def converter_summary(spark, sf_dir, most: float = 0.01):
    """What a converter reports: holes, images, ids outside the ground truth, and scores it had to make up, which may be 1 % at most."""
    known = gt_boxes(spark, sf_dir).where("image_id % 37 <> 0").select("image_id", F.lit(1).alias("known")).distinct()
    rows = pred_boxes(spark, sf_dir).join(known, "image_id", "left")
    made = F.count_if(C("pred_id") % 150 == 0)
    return rows.agg(
        F.count("*").alias("predictions"), F.count_if("has_hole").alias("holes"), F.count_distinct("image_id").alias("images"), F.count_distinct(F.when(C("known").isNull(), C("image_id"))).alias("outside"),
        made.alias("fallbacks"), (made > most * F.count("*")).alias("fails"),
    )
