"""Overlap of any polygons, votes of overlapping boxes, vertex heatmaps with their peaks, boundary masks, ring roles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from annulus.functions import rings as R
from annulus.operators import detection as D
from annulus.operators import drawing, rounds, sweep
from annulus.plans.detection import FRAMED_SQL, framed_overlap
from annulus.plans.masks import merged_runs, merged_sql
from annulus.plans.matching import KEEP_SQL, WALK, before
from annulus.registry import query
from annulus.sources.boxes import INSET, SIDE, SQL, gt_boxes, polygons, pred_boxes

C = F.col


def sheared(boxes: DataFrame) -> DataFrame:
    """The boxes' polygons leaning by their height: no edge but the level ones stays upright, every area stays."""
    lean = lambda ring: F.transform(ring, lambda p: R.point(p["x"] + p["y"], p["y"]))
    return polygons(boxes).withColumns({"exterior": lean(C("exterior")), "holes": F.transform("holes", lean)})


@query(f"{FRAMED_SQL} SELECT ann_id, pred_id, round(inter::DOUBLE, 6) AS inter, round(iou, 9) AS iou FROM framed_ious")
def leaning_polygon_pairs(spark, sf_dir):
    """Shared area of leaning polygons with holes, by the slab sweep; leaning leaves areas as they were."""
    pairs = sweep.polygon_pairs(sheared(gt_boxes(spark, sf_dir)), sheared(pred_boxes(spark, sf_dir)))
    return pairs.select("ann_id", "pred_id", F.round("inter", 6).alias("inter"), F.round("iou", 9).alias("iou"))


@query(f"{SQL} SELECT ann_id, 4 AS edges, (ann_id % 5 = 0)::BIGINT AS crossings, CASE WHEN ann_id % 5 = 0 THEN (x1 - x0) * (y1 - y0) / 2.0::DOUBLE ELSE ((x1 - x0) * (y1 - y0))::DOUBLE END AS area FROM gt")
def ring_validity(spark, sf_dir):
    """Self-crossings and enclosed area of rings, a fifth of which are twisted so that two edges cross."""
    x0, y0, x1, y1 = (C(c) for c in ("x0", "y0", "x1", "y1"))
    twisted = C("ann_id") % 5 == 0
    ring = F.array(R.point(x0, y0), R.point(x1, y0), R.point(F.when(twisted, x0).otherwise(x1), y1), R.point(F.when(twisted, x1).otherwise(x0), y1))
    rings = gt_boxes(spark, sf_dir).select("ann_id", ring.alias("ring"))
    none = F.expr("cast(array() as array<array<struct<x:double,y:double>>>)")
    areas = rings.select("ann_id", sweep.overlap(C("ring"), none, C("ring"), none)["a"].alias("area"))
    return sweep.self_crossings(rings, "ann_id").join(areas, "ann_id").select("ann_id", "edges", "crossings", "area")


def voted(boxes: DataFrame, on: str, least: float = 0.65, soft: bool = False, floor: float = 0.05, most: int = 100) -> DataFrame:
    """Boxes by score, area and id: each one left takes those after it with IoU ``least`` or more, and becomes their mean.

    The mean is weighted by score; the score is the greatest. With ``soft``, those taken stay too where their score
    times 1 - IoU is ``floor`` or more. The ``most`` best of each group are returned, with ``boxes``, how many went in.
    """
    pairs = D.overlapping(boxes, boxes, on).where(before("g_", "p_"))
    i, a, b = D.shared_area(), D.box_area("g_"), D.box_area("p_")
    edges = pairs.select(C("g_pred_id").alias("hi"), C("p_pred_id").alias("lo"), C("g_score").alias("score"), a.alias("area"), F.try_divide(i.cast("double"), a + b - i).alias("iou")).where(C("iou") >= least)
    edges = rounds.cut(edges)
    gone = rounds.suppressed(edges)
    heads = edges.join(gone.select(C("lo").alias("hi")), "hi", "left_anti")
    taken = heads.groupBy("lo").agg(F.max(F.struct("score", "area", (-C("hi")).alias("n"), "iou")).alias("m")).select(C("lo").alias("pred_id"), (-C("m.n")).alias("head"), C("m.iou").alias("iou"))
    rows = boxes.join(taken, "pred_id", "left").withColumn("head", F.coalesce("head", "pred_id"))
    mean = lambda c: (F.sum(C(c) * C("score")) / F.sum("score")).alias(c)
    out = rows.groupBy(on, C("head").alias("pred_id")).agg(F.max("score").alias("score"), *[mean(c) for c in ("x0", "y0", "x1", "y1")], F.count("*").alias("boxes"))
    if soft:
        less = rows.where("iou is not null").withColumn("score", C("score") * (1 - C("iou"))).where(C("score") >= floor)
        out = out.unionByName(less.select(on, "pred_id", "score", *[C(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], F.lit(1).cast("long").alias("boxes")))
    place = F.row_number().over(W.partitionBy(on).orderBy(F.desc("score"), "pred_id"))
    return out.withColumn("place", place).where(C("place") <= most).drop("place")


VOTE_SQL = KEEP_SQL.format(start=WALK, g="image_id", t="pred", rule="iou >= 0.65").rsplit("SELECT", 1)[0] + """, heads AS (SELECT pred_id FROM walk WHERE ok),
h AS (SELECT f.lo, f.iou, f.hi, row_number() OVER (PARTITION BY f.lo ORDER BY r.r) AS k FROM f JOIN heads ON heads.pred_id = f.hi JOIN ranked r ON r.pred_id = f.hi WHERE iou >= 0.65),
rs AS (SELECT p.*, h.iou, coalesce(h.hi, p.pred_id) AS head FROM pred p LEFT JOIN h ON h.lo = p.pred_id AND h.k = 1),
fused AS (SELECT image_id, head AS pred_id, max(score) AS score, sum(x0 * score) / sum(score) AS x0, sum(y0 * score) / sum(score) AS y0, sum(x1 * score) / sum(score) AS x1, sum(y1 * score) / sum(score) AS y1, count(*) AS boxes FROM rs GROUP BY ALL {more})
SELECT image_id, pred_id, round(score, 9) AS score, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, boxes FROM fused QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY fused.score DESC, pred_id) <= 100"""
SOFT_SQL = "UNION ALL SELECT image_id, pred_id, score * (1 - iou), x0, y0, x1, y1, 1 FROM rs WHERE iou IS NOT NULL AND score * (1 - iou) >= 0.05::DOUBLE"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"score": F.round("score", 9)} | {c: F.round(c, 6) for c in ("x0", "y0", "x1", "y1")})


@query(VOTE_SQL.replace("{more}", ""))
def voted_boxes(spark, sf_dir):
    """Predictions that overlap merged into their score-weighted mean."""
    return _rounded(voted(pred_boxes(spark, sf_dir).drop("has_hole"), "image_id"))


@query(VOTE_SQL.replace("{more}", SOFT_SQL))
def soft_voted_boxes(spark, sf_dir):
    """The same, keeping boxes that were taken, at a score that falls with the overlap."""
    return _rounded(voted(pred_boxes(spark, sf_dir).drop("has_hole"), "image_id", soft=True))


SIGMA, RADIUS = 1.0, 3


def vertex_distances(boxes: DataFrame) -> DataFrame:
    """image_id, y, x, d2: squared distance to the nearest vertex of cells within RADIUS of one on each axis.

    The greatest of several Gaussians of one sigma is that of the nearest vertex, so whole numbers are compared.
    """
    at = lambda ring: F.transform(ring, lambda p: F.struct(F.least(F.greatest(p["x"], F.lit(0.0)), F.lit(SIDE - 1.0)).cast("int").alias("x"), F.least(F.greatest(p["y"], F.lit(0.0)), F.lit(SIDE - 1.0)).cast("int").alias("y")))
    vertices = polygons(boxes).select("image_id", F.explode(F.flatten(F.transform(F.concat(F.array("exterior"), C("holes")), at))).alias("v")).distinct()
    span = lambda: F.explode(F.sequence(F.lit(-RADIUS), F.lit(RADIUS)))
    cells = vertices.withColumn("dx", span()).withColumn("dy", span()).select("image_id", (C("v.y") + C("dy")).alias("y"), (C("v.x") + C("dx")).alias("x"), (C("dx") * C("dx") + C("dy") * C("dy")).alias("d2"))
    return cells.where(C("x").between(0, SIDE - 1) & C("y").between(0, SIDE - 1)).groupBy("image_id", "y", "x").agg(F.min("d2").alias("d2"))


HEAT_SQL = f"""{SQL}, frames AS (SELECT image_id, x0, y0, x1, y1 FROM gt UNION ALL SELECT image_id, x0 + {INSET}, y0 + {INSET}, x1 - {INSET}, y1 - {INSET} FROM gt WHERE has_hole),
v AS (SELECT DISTINCT image_id, greatest(0, least(511, vx))::INT AS vx, greatest(0, least(511, vy))::INT AS vy FROM (SELECT image_id, unnest([x0, x1, x1, x0]) AS vx, unnest([y0, y0, y1, y1]) AS vy FROM frames)),
o AS (SELECT a.i AS dx, b.i AS dy, a.i * a.i + b.i * b.i AS d2 FROM (SELECT unnest(range(-3, 4))::INT AS i) a, (SELECT unnest(range(-3, 4))::INT AS i) b),
heat AS (SELECT image_id, vy + dy AS y, vx + dx AS x, min(d2)::INT AS d2 FROM v CROSS JOIN o WHERE vx + dx BETWEEN 0 AND 511 AND vy + dy BETWEEN 0 AND 511 GROUP BY ALL)"""


@query(f"{HEAT_SQL} SELECT image_id, count(*) AS cells, round(sum(exp(-d2 / 2.0::DOUBLE)), 6) AS heat FROM heat GROUP BY image_id")
def vertex_heatmap(spark, sf_dir):
    """Cells of an image's vertex heatmap and their sum; every vertex is 1."""
    heat = [math.exp(-d2 / (2 * SIGMA * SIGMA)) for d2 in range(2 * RADIUS * RADIUS + 1)]
    return drawing.heat_sums(gt_boxes(spark, sf_dir), SIDE, INSET, RADIUS, heat).withColumn("heat", F.round("heat", 6))


@query(f"""{HEAT_SQL}, p AS (SELECT h.image_id, h.y, h.x, h.d2, min(n.d2) AS near FROM heat h JOIN heat n ON n.image_id = h.image_id AND n.y BETWEEN h.y - 1 AND h.y + 1 AND n.x BETWEEN h.x - 1 AND h.x + 1 WHERE h.d2 = 0 GROUP BY ALL)
SELECT image_id, y, x, row_number() OVER (PARTITION BY image_id ORDER BY y, x) AS place FROM p WHERE near = d2 QUALIFY place <= 300""")
def heatmap_peaks(spark, sf_dir, least: float = 0.7, most: int = 300):
    """The 300 greatest peaks of each image over 0.7: cells that no neighbour exceeds; ties by y, then x."""
    over = [math.exp(-d2 / (2 * SIGMA * SIGMA)) > least for d2 in range(2 * RADIUS * RADIUS + 1)]
    return drawing.peaks(gt_boxes(spark, sf_dir), SIDE, INSET, RADIUS, over, most)


BAND = 2


def boundary_runs(mask: DataFrame, reach: int = BAND) -> DataFrame:
    """mask without its erosion: what lies within ``reach`` cells, on both axes, of background or the image's edge.

    mask holds merged runs (image_id, y, x_start, x_end). Gaps of each row are dealt to the rows around it; a row that
    has a neighbour without runs is boundary as a whole.
    """
    run = F.struct("x_start", "x_end")
    rows = mask.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(run)).alias("runs"))  # a row has half its cells in runs at most
    ends, starts = F.concat(F.array(F.lit(-1).cast("long")), C("runs.x_end")), F.concat(C("runs.x_start"), F.array(F.lit(SIDE + 1).cast("long")))
    gaps = F.zip_with(ends, starts, lambda a, b: F.struct((a - reach).alias("x_start"), (b + reach).alias("x_end")))
    dealt = rows.select("image_id", "y", gaps.alias("gaps")).withColumn("dy", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    dealt = dealt.groupBy("image_id", (C("y") + C("dy")).alias("y")).agg(F.count("*").alias("n"), F.flatten(F.collect_list("gaps")).alias("gaps"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("x_start"), F.lit(SIDE).cast("long").alias("x_end")))
    near = dealt.select("image_id", "y", F.explode(F.when(C("n") < 2 * reach + 1, whole).otherwise(C("gaps"))).alias("g")).select("image_id", "y", "g.*")
    near = merged_runs(near, "image_id", "y").withColumnsRenamed({"x_start": "u", "x_end": "v"})
    met = mask.join(near, ["image_id", "y"]).where("x_start < v and u < x_end")
    return met.select("image_id", "y", F.greatest("x_start", "u").alias("x_start"), F.least("x_end", "v").alias("x_end"))


def _boundary_sql(m: str, b: str, d: int = BAND) -> str:
    return f"""{b}_gap AS (SELECT image_id, y, coalesce(lag(x_end) OVER (PARTITION BY image_id, y ORDER BY x_start), -1) - {d} AS a, x_start + {d} AS b FROM {m} UNION ALL SELECT image_id, y, max(x_end) - {d}, 513 + {d} FROM {m} GROUP BY image_id, y),
{b}_n AS (SELECT image_id, y + j AS y, count(*) AS n FROM (SELECT DISTINCT image_id, y FROM {m}) CROSS JOIN (SELECT unnest(range(-{d}, {d + 1})) AS j) GROUP BY ALL),
{b}_near AS (SELECT DISTINCT image_id, g.y + j AS y, a, b FROM {b}_gap g CROSS JOIN (SELECT unnest(range(-{d}, {d + 1})) AS j) UNION ALL SELECT image_id, y, 0, 512 FROM {b}_n WHERE n < {2 * d + 1}),
{b}_k AS (SELECT *, sum(fresh) OVER (PARTITION BY image_id, y ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, coalesce((a > max(b) OVER (PARTITION BY image_id, y ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS fresh FROM {b}_near)),
{b}_u AS (SELECT image_id, y, min(a) AS a, max(b) AS b FROM {b}_k GROUP BY image_id, y, island),
{b} AS (SELECT image_id, y, greatest(x_start, a) AS x_start, least(x_end, b) AS x_end FROM {m} JOIN {b}_u USING (image_id, y) WHERE x_start < b AND a < x_end)"""


@query(f"""{SQL}, ma AS (SELECT * FROM {merged_sql('gt')}), mb AS (SELECT * FROM {merged_sql('pred')}), {_boundary_sql('ma', 'ba')}, {_boundary_sql('mb', 'bb')},
sa AS (SELECT image_id, sum(x_end - x_start)::BIGINT AS gt FROM ba GROUP BY image_id), sb AS (SELECT image_id, sum(x_end - x_start)::BIGINT AS pred FROM bb GROUP BY image_id),
sh AS (SELECT image_id, sum(least(a.x_end, b.x_end) - greatest(a.x_start, b.x_start))::BIGINT AS shared FROM ba a JOIN bb b USING (image_id, y) WHERE a.x_start < b.x_end AND b.x_start < a.x_end GROUP BY image_id)
SELECT image_id, coalesce(gt, 0) AS gt, coalesce(pred, 0) AS pred, coalesce(shared, 0) AS shared, coalesce(shared, 0)::DOUBLE / (coalesce(gt, 0) + coalesce(pred, 0) - coalesce(shared, 0)) AS iou FROM sa FULL JOIN sb USING (image_id) LEFT JOIN sh USING (image_id)""")
def mask_boundary_iou(spark, sf_dir):
    """IoU of both masks' boundaries in each image."""
    sides = ((gt_boxes(spark, sf_dir), True), (pred_boxes(spark, sf_dir), False))
    boxes = [df.select("image_id", "x0", "y0", "x1", "y1", "has_hole", F.lit(first).alias("first")) for df, first in sides]
    both = drawing.boundary_sizes(boxes[0].unionByName(boxes[1]), SIDE, INSET, BAND)
    return both.withColumn("iou", C("shared").cast("double") / (C("gt") + C("pred") - C("shared")))


def role_metrics(spark, sf_dir, least: float = 0.5):
    """Rings of each role assigned for the greatest total IoU of their bands, over all rings of the role in an image."""

    def rings(boxes: DataFrame) -> DataFrame:
        inner = boxes.where("has_hole").withColumns({c: C(c) + (INSET if c[1] == "0" else -INSET) for c in ("x0", "y0", "x1", "y1")})
        return boxes.withColumn("role", F.lit("exterior")).unionByName(inner.withColumn("role", F.lit("hole")))

    gt, pred = rings(gt_boxes(spark, sf_dir)), rings(pred_boxes(spark, sf_dir))
    pairs = D.overlapping(gt, pred).where("g_role = p_role")
    inter = framed_overlap(-1, -1) - framed_overlap(-1, 1) - framed_overlap(1, -1) + framed_overlap(1, 1)
    grown = lambda s, d: (C(f"{s}x1") - C(f"{s}x0") + 2 * d) * (C(f"{s}y1") - C(f"{s}y0") + 2 * d)
    band = lambda s: grown(s, 1) - grown(s, -1)
    # rings of both roles are assigned at once, under ids of their own
    own = lambda c: C(c) * 2 + (C("g_role") == "hole").cast("long")
    scored = pairs.select("image_id", own("g_ann_id").alias("ann_id"), own("p_pred_id").alias("pred_id"), F.try_divide(inter.cast("double"), band("g_") + band("p_") - inter).alias("iou")).where("iou > 0")
    count = lambda df, name: df.groupBy("role").agg(F.count("*").alias(name))
    tp = rounds.optimal_match(scored).where(C("iou") >= least).select(F.when(F.pmod("ann_id", F.lit(2)) == 1, "hole").otherwise("exterior").alias("role"))
    both = count(gt, "n").join(count(pred, "m"), "role", "full_outer").join(count(tp, "tp"), "role", "left").na.fill(0)
    return both.select("role", "tp", (C("m") - C("tp")).alias("fp"), (C("n") - C("tp")).alias("fn"), D.safe_ratio(2 * C("tp"), C("n") + C("m")).alias("f1"))


query()(role_metrics)
