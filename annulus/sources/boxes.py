"""Ground-truth and predicted boxes on 512 x 512 images, derived from lineitem; a box may have a hole inset by 6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INSET, SIDE = 6, 512

#: DuckDB CTEs of the same tables: gt, pred, and both with hole and area columns.
SQL = """
WITH base AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(min(l_quantity) AS BIGINT) AS q
  FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey),
raw AS (
  SELECT CAST(((l_orderkey*10 + l_linenumber)*100000 + l_partkey)*1000 + l_suppkey AS BIGINT) AS ann_id,
    CAST(l_orderkey // 4 AS BIGINT) AS image_id, CAST((l_partkey*37 + l_linenumber*11) % 448 AS BIGINT) AS x0,
    CAST((l_suppkey*91 + l_linenumber*53) % 448 AS BIGINT) AS y0, CAST(12 + (l_partkey*13 + l_linenumber*7) % 45 AS BIGINT) AS w,
    CAST(12 + q AS BIGINT) AS h, l_partkey % 4 = 0 AS quarter FROM base),
gt AS (SELECT ann_id, image_id, x0, y0, x0 + w AS x1, y0 + h AS y1, quarter AND w >= 20 AND h >= 20 AS has_hole FROM raw),
pred AS (
  SELECT ann_id AS pred_id, image_id, x0 + (ann_id % 5 - 2) AS x0, y0 + (ann_id % 3 - 1) AS y0,
    x1 + (ann_id % 5 - 2) + ann_id % 4 AS x1, y1 + (ann_id % 3 - 1) - ann_id % 2 AS y1, has_hole AND ann_id % 6 <> 0 AS has_hole,
    CAST(3000 + ((ann_id % 6971)*7919) % 6971 AS DOUBLE) / 10000.0 AS score FROM gt WHERE ann_id % 11 <> 0
  UNION ALL
  SELECT -ann_id, image_id, x0 + 1, y0, x1 + 2, y1 + 1, has_hole,
    CAST(3000 + ((ann_id % 6971)*104729) % 6971 AS DOUBLE) / 10000.0 FROM gt WHERE ann_id % 11 <> 0 AND ann_id % 13 = 0),
pairs AS (
  SELECT g.image_id, g.ann_id, p.pred_id, p.score, g.has_hole AS g_hole, p.has_hole AS p_hole,
    (least(g.x1, p.x1) - greatest(g.x0, p.x0)) * (least(g.y1, p.y1) - greatest(g.y0, p.y0)) AS inter,
    (g.x1-g.x0)*(g.y1-g.y0) AS g_area, (p.x1-p.x0)*(p.y1-p.y0) AS p_area
  FROM gt g JOIN pred p ON g.image_id = p.image_id AND g.x0 < p.x1 AND p.x0 < g.x1 AND g.y0 < p.y1 AND p.y0 < g.y1),
ious AS (SELECT *, CAST(inter AS DOUBLE) / (g_area + p_area - inter) AS iou FROM pairs)
"""


def gt_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ann_id, image_id, x0, y0, x1, y1, has_hole."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(*keys).agg(F.min("l_quantity").cast("long").alias("q"))
    o, n, p, s = (F.col(k).cast("long") for k in keys)
    raw = rows.select(
        (((o * 10 + n) * 100000 + p) * 1000 + s).alias("ann_id"),
        F.expr("l_orderkey div 4").cast("long").alias("image_id"),
        ((p * 37 + n * 11) % 448).alias("x0"),
        ((s * 91 + n * 53) % 448).alias("y0"),
        (12 + (p * 13 + n * 7) % 45).alias("w"),
        (12 + F.col("q")).alias("h"),
        (p % 4 == 0).alias("quarter"),
    )
    hole = F.col("quarter") & (F.col("w") >= 20) & (F.col("h") >= 20)
    return raw.select("ann_id", "image_id", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), hole.alias("has_hole"))


def pred_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pred_id, image_id, x0, y0, x1, y1, has_hole, score; some ground-truth boxes have two near copies, some none."""
    gt = gt_boxes(spark, sf_dir).where("ann_id % 11 <> 0")
    a, (x0, y0, x1, y1) = F.col("ann_id"), (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    dx, dy = a % 5 - 2, a % 3 - 1
    score = lambda k: ((3000 + ((a % 6971) * k) % 6971).cast("double") / 10000.0).alias("score")
    near = gt.select(a.alias("pred_id"), "image_id", (x0 + dx).alias("x0"), (y0 + dy).alias("y0"), (x1 + dx + a % 4).alias("x1"), (y1 + dy - a % 2).alias("y1"), (F.col("has_hole") & (a % 6 != 0)).alias("has_hole"), score(7919))
    again = gt.where(a % 13 == 0).select((-a).alias("pred_id"), "image_id", (x0 + 1).alias("x0"), "y0", (x1 + 2).alias("x1"), (y1 + 1).alias("y1"), "has_hole", score(104729))
    return near.unionByName(again)


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """An open ring of four corners."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))


def polygons(boxes: DataFrame) -> DataFrame:
    """boxes with ``exterior`` and ``holes`` (one inset ring, or none)."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    hole = box_ring(x0 + INSET, y0 + INSET, x1 - INSET, y1 - INSET)
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return boxes.withColumns({"exterior": box_ring(x0, y0, x1, y1), "holes": F.when(F.col("has_hole"), F.array(hole)).otherwise(none)})
