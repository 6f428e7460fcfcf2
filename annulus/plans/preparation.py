"""Training tables: ring split, window grids, encodings, filters, statistics and sampling plans."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from annulus.functions import rings as R
from annulus.operators import detection as D
from annulus.registry import query
from annulus.sources.boxes import INSET, SQL, gt_boxes, polygons, pred_boxes

C = F.col


@query(f"""{SQL} SELECT ann_id, 0 AS ring_index, 'exterior' AS ring_role, false AS is_hole, x0::DOUBLE AS bx, y0::DOUBLE AS by, (x1-x0)::DOUBLE AS bw, (y1-y0)::DOUBLE AS bh FROM gt
UNION ALL SELECT ann_id, 1, 'hole', true, x0 + {INSET}, y0 + {INSET}, x1 - x0 - {2 * INSET}, y1 - y0 - {2 * INSET} FROM gt WHERE has_hole""")
def ring_split_table(spark, sf_dir):
    rings = polygons(gt_boxes(spark, sf_dir)).select("ann_id", F.posexplode(F.concat(F.array("exterior"), C("holes"))).alias("ring_index", "ring"))
    b = R.ring_bbox(C("ring"))
    hole = C("ring_index") > 0
    return rings.select("ann_id", "ring_index", F.when(hole, "hole").otherwise("exterior").alias("ring_role"), hole.alias("is_hole"), b["x0"].alias("bx"), b["y0"].alias("by"), (b["x1"] - b["x0"]).alias("bw"), (b["y1"] - b["y0"]).alias("bh"))


@query(f"""{SQL}, h AS (SELECT ann_id AS hole_id, image_id, x0 + 6 AS x0, y0 + 6 AS y0, x1 - 6 AS x1, y1 - 6 AS y1 FROM gt WHERE has_hole)
SELECT hole_id, arg_min(g.ann_id, struct_pack(a := (g.x1-g.x0)*(g.y1-g.y0), b := g.ann_id)) AS exterior_id FROM h JOIN gt g ON g.image_id = h.image_id AND g.x0 <= h.x0 AND g.y0 <= h.y0 AND g.x1 >= h.x1 AND g.y1 >= h.y1 GROUP BY hole_id""")
def assigned_holes(spark, sf_dir):
    """Each hole's smallest exterior that holds it."""
    gt = gt_boxes(spark, sf_dir)
    holes = gt.where("has_hole").select("image_id", C("ann_id").alias("hole_id"), *[(C(c) + (INSET if c[1] == "0" else -INSET)).alias(f"h{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = holes.join(gt, "image_id").where("x0 <= hx0 and y0 <= hy0 and x1 >= hx1 and y1 >= hy1")
    area = (C("x1") - C("x0")) * (C("y1") - C("y0"))
    return inside.groupBy("hole_id").agg(F.min(F.struct(area.alias("a"), C("ann_id").alias("id"))).alias("m")).select("hole_id", C("m.id").alias("exterior_id"))


@query(f"""{SQL} SELECT count(DISTINCT image_id) AS images, count(*) AS instances, sum(has_hole::INT)::BIGINT AS instances_with_holes, sum(has_hole::INT)::BIGINT AS holes, sum((x1 <= x0)::INT)::BIGINT AS invalid FROM gt""")
def dataset_statistics(spark, sf_dir):
    p = polygons(gt_boxes(spark, sf_dir))
    return p.agg(F.count_distinct("image_id").alias("images"), F.count("*").alias("instances"), F.count_if(F.size("holes") > 0).alias("instances_with_holes"), F.sum(F.size("holes")).alias("holes"), F.count_if(R.ring_area(C("exterior")) <= 0).alias("invalid"))


@query(f"""{SQL} SELECT image_id // 4 AS tile, count(*) AS raw, sum((score >= 0.5)::INT)::BIGINT AS kept, sum((score < 0.5)::INT)::BIGINT AS skipped_low_score, sum((score >= 0.5 AND has_hole)::INT)::BIGINT AS holes FROM pred GROUP BY tile""")
def load_counters(spark, sf_dir):
    good = C("score") >= 0.5
    return pred_boxes(spark, sf_dir).groupBy(F.expr("image_id div 4").alias("tile")).agg(F.count("*").alias("raw"), F.count_if(good).alias("kept"), F.count_if(~good).alias("skipped_low_score"), F.count_if(good & C("has_hole")).alias("holes"))


@query(f"""{SQL}, h AS (SELECT ann_id, (x1-x0-12)*(y1-y0-12) AS area FROM gt WHERE has_hole) SELECT count(*) AS before, sum((area >= 256)::INT)::BIGINT AS after, sum((area < 256)::INT)::BIGINT AS changed FROM h""")
def hole_area_filter(spark, sf_dir):
    kept = F.filter("holes", lambda h: R.ring_area(h) >= 256)
    p = polygons(gt_boxes(spark, sf_dir)).withColumn("left", kept)
    return p.agg(F.sum(F.size("holes")).alias("before"), F.sum(F.size("left")).alias("after"), F.count_if(F.size("left") < F.size("holes")).alias("changed"))


@query(f"""{SQL}, d AS (SELECT unnest([1, 2, 4])::BIGINT AS d), i AS (SELECT DISTINCT image_id FROM gt)
SELECT image_id, d, c * least(128 * d, 384) AS wx, r * least(128 * d, 384) AS wy, 128 * d AS side FROM i CROSS JOIN d, LATERAL (SELECT unnest(range(0, 4 // d)) AS c), LATERAL (SELECT unnest(range(0, 4 // d)) AS r)""")
def window_grids(spark, sf_dir):
    """Windows of 128, 256 and 512 pixels that cover each image."""
    images = gt_boxes(spark, sf_dir).select("image_id").distinct()
    d = images.withColumn("d", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 2, 4)])))
    at = F.sequence(F.lit(0).cast("long"), F.expr("4 div d - 1"))
    step = F.least(128 * C("d"), F.lit(384))
    return d.withColumn("c", F.explode(at)).withColumn("r", F.explode(at)).select("image_id", "d", (C("c") * step).alias("wx"), (C("r") * step).alias("wy"), (128 * C("d")).alias("side"))


@query(f"""{SQL}, v AS (SELECT image_id, ann_id, unnest(range(0, 4)) AS idx FROM gt), n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ann_id, idx) - 1 AS i FROM v)
SELECT image_id, i, i - idx + (idx + 1) % 4 AS next FROM n WHERE i < 192""")
def next_vertex_encoding(spark, sf_dir):
    """An image's vertices in order, each with the index of the next of its ring; at most 192 of an image."""
    p = polygons(gt_boxes(spark, sf_dir)).select("image_id", "ann_id", F.posexplode("exterior").alias("idx", "p"), F.size("exterior").alias("n"))
    own = F.row_number().over(W.partitionBy("image_id").orderBy("ann_id", "idx")) - 1
    return p.withColumn("i", own).where("i < 192").select("image_id", "i", (C("i") - C("idx") + (C("idx") + 1) % C("n")).alias("next"))


@query(f"""{SQL}, k AS (SELECT ann_id, image_id FROM gt WHERE x1 - x0 >= 16 AND y1 - y0 >= 16 AND (x1-x0)*(y1-y0) <= 900 AND x0 < 512 AND y0 < 512 AND ann_id % 9 <> 0) SELECT image_id, count(*) AS kept FROM k GROUP BY image_id HAVING count(*) >= 2""")
def filtered_images(spark, sf_dir):
    """Images with at least two instances that are large, small, visible and not ignored as the filters ask."""
    w, h = C("x1") - C("x0"), C("y1") - C("y0")
    kept = gt_boxes(spark, sf_dir).where((w >= 16) & (h >= 16) & (w * h <= 900) & (C("x0") < 512) & (C("y0") < 512) & (C("ann_id") % 9 != 0))
    return kept.groupBy("image_id").agg(F.count("*").alias("kept")).where("kept >= 2")


@query(f"""{SQL}, c AS (SELECT DISTINCT ann_id % 17 AS class, image_id FROM gt), r AS (SELECT class, image_id, row_number() OVER (PARTITION BY class ORDER BY (image_id * 7919) % 10007, image_id) - 1 AS i, count(*) OVER (PARTITION BY class) AS own FROM c),
t AS (SELECT count(DISTINCT image_id) AS total, ceil(count(DISTINCT image_id) / 17.0)::BIGINT AS turns FROM gt), n AS (SELECT unnest(range(0, turns)) AS turn, total FROM t)
SELECT r.class, r.image_id, turn * 17 + r.class AS place FROM n JOIN r ON r.i = turn % r.own WHERE turn * 17 + r.class < total""")
def class_balanced_plan(spark, sf_dir, classes: int = 17):
    """As many places as there are images, classes in turn; each class goes through its images by the order of a fixed hash,
    and from the first again when they are used up."""
    c = gt_boxes(spark, sf_dir).select((C("ann_id") % classes).alias("class"), "image_id").distinct()
    ranked = D.running_counts(c.withColumn("_one", F.lit(1)), ["class"], [(C("image_id") * 7919) % 10007, C("image_id")], (C("image_id") * 7919) % 10007, "_one")
    sizes = c.groupBy("class").agg(F.count("*").alias("own")).join(F.broadcast(c.agg(F.count_distinct("image_id").alias("total"))))  # a row for each class, met by one row
    times = F.sequence(F.lit(0).cast("long"), F.ceil((F.ceil(C("total") / classes) - (C("n") - 1)) / C("own")) - 1)
    due = ranked.join(F.broadcast(sizes), "class").where(C("n") - 1 < F.ceil(C("total") / classes))
    turn = C("n") - 1 + C("again") * C("own")
    return due.withColumn("again", F.explode(times)).select("class", "image_id", (turn * classes + C("class")).alias("place"), "total").where("place < total").drop("total")


@query(f"""{SQL}, s AS (SELECT image_id % 3 AS source, image_id, row_number() OVER (PARTITION BY image_id % 3 ORDER BY image_id) - 1 AS i FROM (SELECT DISTINCT image_id FROM gt)) SELECT source, image_id, i // (source + 1) AS batch FROM s""")
def source_ratio_plan(spark, sf_dir):
    """Batches that take one, two and three images of the three sources."""
    s = gt_boxes(spark, sf_dir).select("image_id").distinct().withColumn("source", C("image_id") % 3)
    placed = D.running_counts(s.withColumn("_one", F.lit(1)), ["source"], [C("image_id")], F.expr("image_id div 4096"), "_one")  # no window over a whole source
    return placed.select("source", "image_id", F.expr("(n - 1) div (source + 1)").alias("batch"))


@query(f"""{SQL}, t AS (SELECT DISTINCT image_id // 4 AS tile FROM gt) SELECT tile, CASE WHEN tile % 10 < 7 THEN 'train' ELSE 'val' END AS fold, 'tile' || tile || '.tif' AS name FROM t""")
def split_folds(spark, sf_dir):
    """Folds of tiles; what was held for testing joins validation."""
    tiles = gt_boxes(spark, sf_dir).select(F.expr("image_id div 4").alias("tile")).distinct()
    split = F.when(C("tile") % 10 < 7, "train").when(C("tile") % 10 == 9, "test").otherwise("val")
    return tiles.select("tile", F.when(split == "test", "val").otherwise(split).alias("fold"), F.concat(F.lit("tile"), C("tile"), F.lit(".tif")).alias("name"))


@query(f"""{SQL}, p AS (SELECT ann_id, unnest(range(0, 4)) AS pos FROM gt), c AS (SELECT ann_id, pos, unnest(range(0, 2)) AS crop FROM p), v AS (SELECT ann_id, (crop * 2 + pos) % 4 AS place, (crop * 2 + pos) % 4 + crop * 0.5::DOUBLE AS value FROM c WHERE pos < 3)
SELECT ann_id, place, avg(value) AS value, count(*) AS times FROM v GROUP BY ann_id, place""")
def ring_crops(spark, sf_dir):
    """Windows of three vertices with stride two around each ring, put together again by averaging where they meet."""
    n = F.size("exterior")
    crops = polygons(gt_boxes(spark, sf_dir)).select("ann_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("crop")).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(2))))
    at = ((C("crop") * 2 + C("pos")) % C("n")).cast("long")
    return crops.select("ann_id", at.alias("place"), (at + C("crop") * F.lit(0.5)).alias("value")).groupBy("ann_id", "place").agg(F.avg("value").alias("value"), F.count("*").alias("times"))


@query(f"""{SQL}, t AS (SELECT image_id // 4 AS tile, image_id, avg(((x1-x0)*(y1-y0))::DOUBLE / 262144) AS f, count(*) AS n FROM gt GROUP BY image_id) SELECT tile, round(avg(f), 9) AS frequency, sum(n)::BIGINT AS instances FROM t GROUP BY tile""")
def class_frequency(spark, sf_dir):
    share = ((C("x1") - C("x0")) * (C("y1") - C("y0"))).cast("double") / 262144
    images = gt_boxes(spark, sf_dir).groupBy("image_id").agg(F.avg(share).alias("f"), F.count("*").alias("n"))
    return images.groupBy(F.expr("image_id div 4").alias("tile")).agg(F.round(F.avg("f"), 9).alias("frequency"), F.sum("n").alias("instances"))


@query(f"""{SQL} SELECT image_id // 4 AS tile, min(image_id) AS first_image, arg_min(ann_id % 3, struct_pack(a := image_id, b := ann_id)) AS first_class FROM gt GROUP BY tile""")
def first_value_per_tile(spark, sf_dir):
    first = F.min(F.struct("image_id", "ann_id")).alias("m")
    return gt_boxes(spark, sf_dir).groupBy(F.expr("image_id div 4").alias("tile")).agg(first).select("tile", C("m.image_id").alias("first_image"), (C("m.ann_id") % 3).alias("first_class"))


@query(f"""{SQL}, a AS (SELECT image_id FROM gt WHERE has_hole), b AS (SELECT image_id FROM pred WHERE score >= 0.8)
SELECT 'both' AS what, count(*) AS n FROM (SELECT image_id FROM a INTERSECT SELECT image_id FROM b) UNION ALL SELECT 'gt only', count(*) FROM (SELECT image_id FROM a EXCEPT SELECT image_id FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT image_id FROM a UNION SELECT image_id FROM b)""")
def image_sets(spark, sf_dir):
    a, b = gt_boxes(spark, sf_dir).where("has_hole").select("image_id"), pred_boxes(spark, sf_dir).where("score >= 0.8").select("image_id")
    out = [df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, df in (("both", a.intersect(b)), ("gt only", a.distinct().join(b, "image_id", "left_anti")), ("either", a.union(b).distinct()))]
    return out[0].unionByName(out[1]).unionByName(out[2])
