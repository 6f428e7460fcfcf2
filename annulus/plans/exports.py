"""Tables that are read from, prepared for or written to other tools: boxes, rings, splits, patches and their checks."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from annulus.functions import rings as R
from annulus.functions import simplify as S
from annulus.operators import detection as D
from annulus.operators.shared import Scratch
from annulus.registry import query
from annulus.sources.boxes import SQL, gt_boxes, polygons, pred_boxes

C = F.col


def numbered(rows: DataFrame, groups: list[str], order: list, bucket) -> DataFrame:
    """rows with ``n`` from 1 within each group; no window holds more than a bucket of one, bucket rises with the order."""
    return D.running_counts(rows.withColumn("_one", F.lit(1)), groups, order, bucket, "_one").drop("_one", "sum_value")


@query(f"""{SQL}, c AS (SELECT ann_id, x0, y0, x1, y1, round_even((x0 + x1) / 2.0, 0)::BIGINT AS cx, round_even((y0 + y1) / 2.0, 0)::BIGINT AS cy, ceil((x1 - x0) * 0.75)::BIGINT AS w, ceil((y1 - y0) * 0.75)::BIGINT AS h FROM gt)
SELECT ann_id, cx - w AS sx0, cy - h AS sy0, cx + w AS sx1, cy + h AS sy1, cx - greatest(w, h) - 2 AS qx0, cy + greatest(w, h) + 2 AS qy1, x0 + 3 AS px0, y1 - 3 AS py1,
  ceil((x0 + x1) / 2.0 - 32)::BIGINT AS fx0, ceil((y0 + y1) / 2.0 + 32)::BIGINT AS fy1 FROM c""")
def scaled_boxes(spark, sf_dir):
    """Whole boxes: scaled by 1.5 about the rounded centre, the same made square with a margin, padded inwards, of a fixed size."""
    mid, half = lambda a, b: F.bround((C(a) + C(b)) / 2).cast("long"), lambda a, b: F.ceil((C(b) - C(a)) * 0.75)
    c = gt_boxes(spark, sf_dir).withColumns({"cx": mid("x0", "x1"), "cy": mid("y0", "y1"), "w": half("x0", "x1"), "h": half("y0", "y1")})
    most = F.greatest("w", "h") + 2
    fixed = lambda a, b, by: F.ceil((C(a) + C(b)) / 2 + by)
    return c.select(
        "ann_id", (C("cx") - C("w")).alias("sx0"), (C("cy") - C("h")).alias("sy0"), (C("cx") + C("w")).alias("sx1"), (C("cy") + C("h")).alias("sy1"),
        (C("cx") - most).alias("qx0"), (C("cy") + most).alias("qy1"), (C("x0") + 3).alias("px0"), (C("y1") - 3).alias("py1"), fixed("x0", "x1", -32).alias("fx0"), fixed("y0", "y1", 32).alias("fy1"),
    )


@query(f"{SQL} SELECT ann_id, CASE WHEN ann_id % 8 < 4 THEN 4 ELSE 5 END::INT AS vertices FROM gt")
def stripped_rings(spark, sf_dir):
    """A last vertex 0 to 1.75 right of the first one is taken for the closing one where it is nearer than 1."""
    last = R.point(C("x0") + (C("ann_id") % 8) * 0.25, C("y0"))
    ring = R.strip_closing_vertex(F.concat("exterior", F.array(last)))
    return polygons(gt_boxes(spark, sf_dir)).select("ann_id", F.size(ring).alias("vertices"))


WINDOW_SQL = f"""{SQL}, s AS (SELECT ann_id, image_id, round_even(x0 / 16.0, 0)::DOUBLE AS ax, least(round_even(x1 / 16.0, 0), 31)::DOUBLE AS bx, round_even(y0 / 16.0, 0)::DOUBLE AS ay,
  least(round_even(y1 / 16.0, 0), 31)::DOUBLE AS b_y FROM gt), k AS (SELECT *, ax <> bx AND ay <> b_y AS kept FROM s)"""


def window_rings_of(spark, sf_dir):
    return polygons(gt_boxes(spark, sf_dir)).select("ann_id", "image_id", R.scale_to_window(C("exterior"), 512, 512, 32).alias("ring"))


@query(f"{WINDOW_SQL} SELECT ann_id, idx, x, y FROM (SELECT ann_id, unnest([0, 1, 2, 3])::INT AS idx, unnest([ax, bx, bx, ax]) AS x, unnest([ay, ay, b_y, b_y]) AS y FROM k WHERE kept)")
def window_rings(spark, sf_dir):
    """Rings on the whole coordinates of a window of 32; those that collapse are gone."""
    return window_rings_of(spark, sf_dir).select("ann_id", F.posexplode("ring").alias("idx", "p")).select("ann_id", "idx", C("p.x").alias("x"), C("p.y").alias("y"))


@query(f"""{WINDOW_SQL} SELECT image_id, count(*) AS rings, sum(kept::INT)::BIGINT AS kept_rings, sum((NOT kept)::INT)::BIGINT AS dropped_rings, 4 * count(*) AS vertices,
  4 * sum(kept::INT)::BIGINT AS kept_vertices FROM k GROUP BY image_id""")
def ring_encoding_statistics(spark, sf_dir):
    kept = F.count("ring")
    rows = window_rings_of(spark, sf_dir).groupBy("image_id")
    return rows.agg(F.count("*").alias("rings"), kept.alias("kept_rings"), (F.count("*") - kept).alias("dropped_rings"), (4 * F.count("*")).alias("vertices"), F.coalesce(F.sum(F.size("ring")).cast("long"), F.lit(0)).alias("kept_vertices"))


def vertex_budgets_of(rings: DataFrame, most: int = 64, least: int = 3) -> DataFrame:
    """``rings(image_id, ann_id, area, vertices)`` -> with ``budget``: the largest rings get ``least`` vertices each, what an
    image has left goes round by round to those that need most."""
    large = F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("area"), F.desc("vertices"), "ann_id"))
    kept = rings.withColumn("place", large).where(C("place") <= max(1, most // least)).withColumn("own", F.least("vertices", F.lit(least)))
    kept = kept.withColumn("need", C("vertices") - C("own")).withColumn("left", F.lit(most) - F.sum("own").over(W.partitionBy("image_id")))
    turn = kept.where("need > 0").select("image_id", "ann_id", "need", "area", "vertices", "place", "left", F.explode(F.sequence(F.lit(1).cast("long"), C("need"))).alias("round"))
    served = F.row_number().over(W.partitionBy("image_id").orderBy("round", F.desc("need"), F.desc("area"), F.desc("vertices"), "place"))
    more = turn.withColumn("served", served).where("served <= left").groupBy("image_id", "ann_id").agg(F.count("*").alias("more"))
    return kept.join(more, ["image_id", "ann_id"], "left").select("image_id", "ann_id", (C("own") + F.coalesce("more", F.lit(0))).alias("budget"))


@query(f"""{SQL}, r AS (SELECT image_id, ann_id, (x1-x0)*(y1-y0) AS area, 4 + ann_id % 9 AS v FROM gt), k AS (SELECT *, least(v, 3) AS own, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, v DESC, ann_id) AS place FROM r QUALIFY place <= 21),
t AS (SELECT *, v - own AS need, 64 - sum(own) OVER (PARTITION BY image_id) AS rest FROM k), q AS (SELECT *, unnest(range(1, need + 1)) AS turn FROM t),
s AS (SELECT image_id, ann_id, rest, row_number() OVER (PARTITION BY image_id ORDER BY turn, need DESC, area DESC, v DESC, place) AS served FROM q), m AS (SELECT image_id, ann_id, count(*) AS more FROM s WHERE served <= rest GROUP BY ALL)
SELECT image_id, ann_id, (own + coalesce(more, 0))::BIGINT AS budget FROM t LEFT JOIN m USING (image_id, ann_id)""")
def vertex_budgets(spark, sf_dir):
    rings = gt_boxes(spark, sf_dir).select("image_id", "ann_id", ((C("x1") - C("x0")) * (C("y1") - C("y0"))).alias("area"), (4 + C("ann_id") % 9).alias("vertices"))
    return vertex_budgets_of(rings).select("image_id", "ann_id", C("budget").cast("long").alias("budget"))


@query(f"""{SQL}, t AS (SELECT DISTINCT image_id // 4 AS tile FROM gt), s AS (SELECT tile, 400 + tile % 5 * 100 AS hh, 700 + tile % 3 * 64 AS ww FROM t), n AS (SELECT *, greatest(1, ceil((hh - 64) / 192.0))::BIGINT AS rs, greatest(1, ceil((ww - 64) / 192.0))::BIGINT AS cs FROM s),
g AS (SELECT *, unnest(range(0, rs)) AS i FROM n), h AS (SELECT *, unnest(range(0, cs)) AS j FROM g)
SELECT tile, i, j, CASE WHEN i < rs - 1 THEN i * 192 ELSE hh - 256 END AS row_start, CASE WHEN j < cs - 1 THEN j * 192 ELSE ww - 256 END AS col_start FROM h""")
def pulled_back_grid(spark, sf_dir, patch: int = 256, stride: int = 192):
    """Windows of 256 with stride 192 on images of several sizes; the last one of each axis ends at the image's edge."""
    t = gt_boxes(spark, sf_dir).select(F.expr("image_id div 4").alias("tile")).distinct().withColumns({"h": 400 + C("tile") % 5 * 100, "w": 700 + C("tile") % 3 * 64})
    count = lambda side: F.greatest(F.lit(1), F.ceil((C(side) - (patch - stride)) / stride))
    at = lambda k, n, side: F.when(C(k) < C(n) - 1, C(k) * stride).otherwise(C(side) - patch)
    t = t.withColumns({"rows": count("h"), "cols": count("w")})
    for k, n in (("i", "rows"), ("j", "cols")):
        t = t.withColumn(k, F.explode(F.sequence(F.lit(0).cast("long"), C(n) - 1)))
    return t.select("tile", "i", "j", at("i", "rows", "h").alias("row_start"), at("j", "cols", "w").alias("col_start"))


@query(f"""{SQL}, s AS (SELECT DISTINCT image_id, CASE WHEN image_id // 4 % 10 < 7 THEN 'train' ELSE 'val' END AS split FROM gt), n AS (SELECT *, row_number() OVER (ORDER BY split, image_id) AS new_id, split || '_tile' || (image_id // 4) || '_' || image_id || '.tif' AS name FROM s)
SELECT split, name, new_id, image_id AS source_image_id, row_number() OVER (PARTITION BY split ORDER BY image_id) <= CASE split WHEN 'train' THEN 8 ELSE 4 END AS smoke FROM n""")
def split_table(spark, sf_dir):
    """Images of both splits with new contiguous ids and flat names; the first eight and four are for smoke tests."""
    images = gt_boxes(spark, sf_dir).select("image_id").distinct()
    images = images.withColumn("split", F.when(F.expr("image_id div 4") % 10 < 7, "train").otherwise("val"))
    own = numbered(images, ["split"], [C("image_id")], F.expr("image_id div 4096"))
    before = images.where("split = 'train'").agg(F.count("*").alias("train"))
    new_id = C("n") + F.when(C("split") == "val", C("train")).otherwise(F.lit(0))
    name = F.concat(C("split"), F.lit("_tile"), F.expr("image_id div 4"), F.lit("_"), C("image_id"), F.lit(".tif"))
    smoke = C("n") <= F.when(C("split") == "train", 8).otherwise(4)
    return own.join(F.broadcast(before)).select("split", name.alias("name"), new_id.alias("new_id"), C("image_id").alias("source_image_id"), smoke.alias("smoke"))  # before: one row


@query(f"""{SQL}, e AS (SELECT ann_id, 0 AS ring, unnest([0, 1, 2, 3])::INT AS idx, unnest([x0, x1, x1, x0])::DOUBLE AS x, unnest([y0, y0, y1, y1])::DOUBLE AS y FROM gt
  UNION ALL SELECT ann_id, 1, unnest([0, 1, 2, 3])::INT, unnest([x0+6, x1-6, x1-6, x0+6])::DOUBLE, unnest([y0+6, y0+6, y1-6, y1-6])::DOUBLE FROM gt WHERE has_hole)
SELECT ann_id, ring, idx, x, y, CASE ring WHEN 0 THEN 2 ELSE 1 END AS tag, (idx + 3) % 4 AS linked FROM e""")
def junction_table(spark, sf_dir):
    """Vertices of all rings, tagged 2 at convex corners of the outline and 1 elsewhere, each linked with the one before it in its ring."""
    rings = polygons(gt_boxes(spark, sf_dir)).select("ann_id", F.posexplode(F.concat(F.array("exterior"), "holes")).alias("ring", "r"))
    clipped = R.clip_ring(C("r"), 512 - 1e-4, 512 - 1e-4)
    convex = R.convex_corners(clipped)
    v = rings.select("ann_id", "ring", F.size("r").alias("n"), F.posexplode(F.arrays_zip(clipped.alias("p"), convex.alias("c"))).alias("idx", "v"))
    tag = F.when((C("ring") == 0) & C("v.c"), 2).otherwise(1)
    return v.select("ann_id", "ring", "idx", C("v.p.x").alias("x"), C("v.p.y").alias("y"), tag.alias("tag"), ((C("idx") + C("n") - 1) % C("n")).alias("linked"))


@query(f"""{SQL}, a AS (SELECT DISTINCT image_id, 'i' || image_id AS name FROM gt WHERE NOT has_hole), b AS (SELECT DISTINCT image_id, CASE WHEN image_id % 50 = 0 THEN 'j' ELSE 'i' END || image_id AS name FROM gt WHERE has_hole)
SELECT coalesce(a.image_id, b.image_id) AS image_id, a.name AS left_name, b.name AS right_name, CASE WHEN a.name IS NULL THEN 'right only' WHEN b.name IS NULL THEN 'left only' ELSE 'names differ' END AS fault
FROM a FULL OUTER JOIN b ON a.image_id = b.image_id WHERE a.name IS DISTINCT FROM b.name""")
def category_consistency(spark, sf_dir):
    """Images that two categories of one release don't share by id and name."""
    gt = gt_boxes(spark, sf_dir)
    name = lambda other: F.concat(F.when((C("image_id") % 50 == 0) & F.lit(other), "j").otherwise("i"), C("image_id"))
    a = gt.where("not has_hole").select("image_id", name(False).alias("left_name")).distinct()
    b = gt.where("has_hole").select("image_id", name(True).alias("right_name")).distinct()
    fault = F.when(C("left_name").isNull(), "right only").when(C("right_name").isNull(), "left only").otherwise("names differ")
    return a.join(b, "image_id", "full_outer").where(~C("left_name").eqNullSafe(C("right_name"))).select("image_id", "left_name", "right_name", fault.alias("fault"))


@query(f"""{SQL}, i AS (SELECT DISTINCT image_id FROM gt WHERE image_id % 20 <> 0) SELECT p.image_id // 4 AS tile, count(i.image_id) AS found, count(*) - count(i.image_id) AS missing, sum(CASE WHEN i.image_id IS NOT NULL THEN p.x0 + p.image_id % 2 * 512 END)::BIGINT AS shifted
FROM pred p LEFT JOIN i ON i.image_id = p.image_id GROUP BY tile""")
def image_lookup(spark, sf_dir):
    """Predictions joined with their images' origins; those without an image are counted for each tile."""
    images = gt_boxes(spark, sf_dir).where("image_id % 20 <> 0").select("image_id", (C("image_id") % 2 * 512).alias("origin")).distinct()
    rows = pred_boxes(spark, sf_dir).join(images, "image_id", "left").groupBy(F.expr("image_id div 4").alias("tile"))
    return rows.agg(F.count("origin").alias("found"), F.count_if(C("origin").isNull()).alias("missing"), F.sum(C("x0") + C("origin")).alias("shifted"))


@query(f"""{SQL} SELECT ann_id, pred_id, g.x0 * ((p.x1 - p.x0) / 512::DOUBLE) + p.x0 AS x0, g.y1 * ((p.y1 - p.y0) / 512::DOUBLE) + p.y0 AS y1 FROM gt g JOIN pred p ON p.pred_id = g.ann_id""")
def pasted_rings(spark, sf_dir):
    """Rings of a crop of 512 put into the boxes they were cut from."""
    box = pred_boxes(spark, sf_dir).select("pred_id", *[C(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    both = polygons(gt_boxes(spark, sf_dir)).join(box, C("ann_id") == C("pred_id"))
    sx, sy = (C("b_x1") - C("b_x0")) / F.lit(512.0), (C("b_y1") - C("b_y0")) / F.lit(512.0)
    ring = R.mapped(C("exterior"), lambda p: p["x"] * sx + C("b_x0"), lambda p: p["y"] * sy + C("b_y0"))
    return both.select("ann_id", "pred_id", ring[0]["x"].alias("x0"), ring[2]["y"].alias("y1"))


@query(f"""{SQL} SELECT pred_id, round(x0 / 3.0::DOUBLE, 2) AS bx, round(y0 / 7.0::DOUBLE, 2) AS by, round((x1 - x0) / 3.0::DOUBLE, 2) AS bw, round((y1 - y0) / 7.0::DOUBLE, 2) AS bh,
  [round(x0/3.0::DOUBLE, 2), round(y0/7.0::DOUBLE, 2), round(x1/3.0::DOUBLE, 2), round(y0/7.0::DOUBLE, 2), round(x1/3.0::DOUBLE, 2), round(y1/7.0::DOUBLE, 2), round(x0/3.0::DOUBLE, 2), round(y1/7.0::DOUBLE, 2)]::VARCHAR AS outline, score FROM pred""".replace("::VARCHAR", ""))
def rounded_outlines(spark, sf_dir):
    """Boxes and outlines to two places, without holes."""
    p = R.mapped(C("exterior"), lambda v: v["x"] / 3.0, lambda v: v["y"] / 7.0)
    two = lambda v: F.round(v, 2)
    rows = polygons(pred_boxes(spark, sf_dir)).withColumn("p", p)
    w, h = (C("x1") - C("x0")) / F.lit(3.0), (C("y1") - C("y0")) / F.lit(7.0)
    return rows.select("pred_id", two(C("p")[0]["x"]).alias("bx"), two(C("p")[0]["y"]).alias("by"), two(w).alias("bw"), two(h).alias("bh"), F.transform(R.flat(C("p")), two).alias("outline"), "score")


@query(f"""{SQL}, k AS (SELECT *, (x1-x0)*(y1-y0) AS area FROM pred WHERE score >= 0.4 AND (x1-x0)*(y1-y0) < 1200), t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pred_id) AS place FROM k QUALIFY place <= 10)
SELECT row_number() OVER (ORDER BY image_id, place) - 1 AS id, image_id, pred_id, area FROM t""")
def small_proposals(spark, sf_dir, most: int = 10):
    """The ten best proposals of each image below an area, numbered through all images."""
    area = (C("x1") - C("x0")) * (C("y1") - C("y0"))
    kept = pred_boxes(spark, sf_dir).withColumn("area", area).where("score >= 0.4 and area < 1200")
    best = kept.withColumn("place", F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("score"), "pred_id"))).where(C("place") <= most)
    return numbered(best, [], [C("image_id"), C("place")], F.expr("image_id div 256")).select((C("n") - 1).alias("id"), "image_id", "pred_id", "area")


@query(f"{SQL} SELECT pred_id, abs(pred_id) % 3 AS part, (x1-x0)*(y1-y0) / 16.0::DOUBLE AS area, 5 AS vertices FROM pred WHERE (x1-x0)*(y1-y0) > 800")
def joined_parts(spark, sf_dir, least: float = 50.0):
    """Predictions of three part files at a quarter of the scale, closed; those of 50 or less are left out."""
    rows = polygons(pred_boxes(spark, sf_dir)).withColumn("ring", R.mapped(C("exterior"), lambda p: p["x"] / 4, lambda p: p["y"] / 4))
    parts = [rows.where(F.abs("pred_id") % 3 == i).select("pred_id", F.lit(i).cast("long").alias("part"), "ring") for i in range(3)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("area", R.ring_area(C("ring"))).where((F.size("ring") > 2) & (C("area") > least))
    return every.select("pred_id", "part", "area", F.size(R.close_ring(C("ring"))).alias("vertices"))


@query(f"""{SQL}, i AS (SELECT DISTINCT image_id, 'i' || image_id AS name FROM gt WHERE image_id % 41 <> 0), p AS (SELECT pred_id, image_id, CASE WHEN pred_id % 97 = 0 THEN 'x' ELSE 'i' END || image_id AS name FROM pred WHERE score >= 0.5)
SELECT p.image_id // 4 AS tile, count(*) FILTER (i.name = p.name) AS accepted, count(*) FILTER (i.name <> p.name) AS misnamed, count(*) FILTER (i.name IS NULL) AS unknown FROM p LEFT JOIN i ON i.image_id = p.image_id GROUP BY tile""")
def guarded_priors(spark, sf_dir):
    """Box priors over a score whose image is in the split under the same name, and those that a guard stops."""
    images = gt_boxes(spark, sf_dir).where("image_id % 41 <> 0").select("image_id", F.concat(F.lit("i"), C("image_id")).alias("known")).distinct()
    name = F.concat(F.when(C("pred_id") % 97 == 0, "x").otherwise("i"), C("image_id"))
    rows = pred_boxes(spark, sf_dir).where("score >= 0.5").withColumn("name", name).join(images, "image_id", "left").groupBy(F.expr("image_id div 4").alias("tile"))
    return rows.agg(F.count_if(C("known") == C("name")).alias("accepted"), F.count_if(C("known") != C("name")).alias("misnamed"), F.count_if(C("known").isNull()).alias("unknown"))


@query(f"""{SQL}, t AS (SELECT DISTINCT image_id // 4 AS tile FROM gt), k AS (SELECT tile, unnest([0, 200, 400, 600]) AS x FROM t), w AS (SELECT tile, x, y FROM k, (SELECT unnest([0, 200, 400, 600]) AS y) WHERE (tile + x // 200 + y // 100) % 7 <> 1),
e AS (SELECT tile, unnest([0, 200, 300, 400, 500, 600, 700, 900]) AS a, unnest([200, 300, 400, 500, 600, 700, 900, 1024]) AS b FROM t), c AS (SELECT p.tile, p.a AS xa, p.b AS xb, q.a AS ya, q.b AS yb FROM e p JOIN e q USING (tile))
SELECT tile, round(sum((xb - xa) * (yb - ya)) / 1048576.0, 9)::DOUBLE AS uncovered FROM c WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.tile = c.tile AND w.x <= xa AND w.x + 300 >= xb AND w.y <= ya AND w.y + 300 >= yb) GROUP BY tile""")
def uncovered_area(spark, sf_dir, side: int = 1024, window: int = 300):
    """Share of each tile that none of its windows covers, on the grid of the windows' own edges."""
    tiles = gt_boxes(spark, sf_dir).select(F.expr("image_id div 4").alias("tile")).distinct()
    axis = F.array(*[F.lit(v).cast("long") for v in (0, 200, 400, 600)])
    w = tiles.select("tile", F.explode(axis).alias("x")).select("tile", "x", F.explode(axis).alias("y")).where((C("tile") + F.expr("x div 200") + F.expr("y div 100")) % 7 != 1)
    return uncovered_share(w.withColumns({"x1": C("x") + window, "y1": C("y") + window}), side)


def uncovered_share(windows: DataFrame, side: int) -> DataFrame:
    """``windows(tile, x, y, x1, y1)`` -> (tile, uncovered). The work of a tile grows with the cube of its windows."""
    box = F.collect_list(F.struct("x", "y", "x1", "y1")).alias("w")
    ends = lambda a, b: F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long"), F.lit(side).cast("long")), F.transform("w", lambda v: v[a]), F.transform("w", lambda v: v[b]))))
    gaps = lambda k: F.explode(F.zip_with(F.slice(k, F.lit(1), F.size(k) - 1), F.slice(k, F.lit(2), F.size(k) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    cells = windows.groupBy("tile").agg(box).withColumns({"xs": ends("x", "x1"), "ys": ends("y", "y1")}).select("tile", "w", "ys", gaps("xs").alias("h")).select("tile", "w", "h", gaps("ys").alias("v"))
    held = F.exists("w", lambda b: (b["x"] <= C("h.a")) & (b["x1"] >= C("h.b")) & (b["y"] <= C("v.a")) & (b["y1"] >= C("v.b")))
    free = cells.where(~held & (C("h.b") <= side) & (C("v.b") <= side))
    return free.groupBy("tile").agg(F.round(F.sum((C("h.b") - C("h.a")) * (C("v.b") - C("v.a"))) / float(side * side), 9).alias("uncovered"))


@query(f"{SQL} SELECT ann_id, idx, x, y FROM (SELECT ann_id, unnest([0, 1, 2, 3])::INT AS idx, unnest([x0, x1, x1, x0])::DOUBLE AS x, unnest([y0, y0, y1, y1])::DOUBLE AS y FROM gt)")
def simplified_rings(spark, sf_dir):
    """Rings with a vertex put in every three units or less, simplified again: the corners are left."""
    dense = S.simplify_ring(polygons(gt_boxes(spark, sf_dir)), "ring", R.densify(C("exterior"), 3.0), 0.5)
    return dense.select("ann_id", F.posexplode("ring").alias("idx", "p")).select("ann_id", "idx", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"))


@query(f"{SQL} SELECT ann_id, idx, x, y FROM (SELECT ann_id, unnest([0, 1, 2, 3])::INT AS idx, unnest([x0, x1, x1, x0])::DOUBLE AS x, unnest([y0, y0, y1, y1])::DOUBLE AS y FROM gt)")
def straightened_rings(spark, sf_dir):
    """The same by the angle of neighbouring edges."""
    dense = S.simplify_by_angle(polygons(gt_boxes(spark, sf_dir)), "ring", R.densify(C("exterior"), 5.0))
    return dense.select("ann_id", F.posexplode("ring").alias("idx", "p")).select("ann_id", "idx", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"))


@query(f"{SQL} SELECT tolerance, image_id, count(*) AS kept FROM pred, (SELECT unnest([1.0, 3.0, 8.0])::DOUBLE AS tolerance) WHERE (x1-x0)*(y1-y0) >= 400 AND score >= 0.5 GROUP BY ALL")
def filtered_polygons(spark, sf_dir):
    """Predictions of enough area and score, one variant for each tolerance."""
    kept = polygons(pred_boxes(spark, sf_dir)).withColumn("area", R.ring_area(C("exterior"))).where(~(C("area") < 400) & ~(C("score") < 0.5))
    return kept.withColumn("tolerance", F.explode(F.array(*[F.lit(t) for t in (1.0, 3.0, 8.0)]))).groupBy("tolerance", "image_id").agg(F.count("*").alias("kept"))


@query(f"{SQL} SELECT ann_id, 2 * (x1-x0) + 2 * (y1-y0) AS length FROM gt WHERE 2 * (x1-x0) + 2 * (y1-y0) >= 100 AND (x1-x0)*(y1-y0) >= 500")
def filtered_contours(spark, sf_dir):
    """Contours of three vertices, a length of 100 and an area of 500 or more."""
    kept = polygons(gt_boxes(spark, sf_dir)).select("ann_id", F.size("exterior").alias("n"), R.ring_perimeter(C("exterior")).alias("length"), R.ring_area(C("exterior")).alias("area"))
    return kept.where("n >= 3 and length >= 100 and area >= 500").select("ann_id", C("length").cast("long").alias("length"))


def cycles_of(links: DataFrame) -> DataFrame:
    """``links(node, next)``, a permutation -> (node, cycle), the least node of its cycle; each round looks twice as far ahead.

    Labels are compressed in the shared folder, the last ones alone; a round's shuffle files go when it has ended.
    As nodes differ, no round leaves all labels as they were before every one has seen its whole cycle.
    """
    scratch = Scratch(links.sparkSession, "cycles")
    label = scratch.keep(links.select("node", "next", F.least("node", "next").alias("cycle")), "labels0")
    for i in count(1):
        ahead = label.select(C("node").alias("next"), C("next").alias("jump"), C("cycle").alias("other"))
        moved = label.join(ahead, "next").select("node", C("jump").alias("next"), F.least("cycle", "other").alias("cycle"), (C("other") < C("cycle")).alias("changed"))
        label = scratch.keep(moved, f"labels{i}")
        scratch.drop(f"labels{i - 1}")
        if label.where("changed").isEmpty():
            return label.select("node", "cycle")
        label = label.drop("changed")


@query(f"{SQL} SELECT ann_id * 8 AS cycle, 4 AS vertices, ann_id * 8 + 3 AS last FROM gt UNION ALL SELECT ann_id * 8 + 4, 4, ann_id * 8 + 7 FROM gt WHERE has_hole")
def decoded_permutation(spark, sf_dir):
    """Rings read back from each vertex's next one; padding, whose next one is itself, makes none."""
    rings = polygons(gt_boxes(spark, sf_dir)).select("ann_id", F.posexplode(F.concat(F.array("exterior"), "holes")).alias("ring", "r")).select("ann_id", "ring", F.explode(F.sequence(F.lit(0), F.size("r") + 1)).alias("i"), F.size("r").alias("n"))
    at = C("ann_id") * 8 + C("ring") * 4
    node = F.when(C("i") < C("n"), at + C("i")).otherwise(-at - C("i"))  # two self-linked vertices pad each ring
    links = rings.select(node.alias("node"), F.when(C("i") < C("n"), at + (C("i") + 1) % C("n")).otherwise(node).alias("next"))
    found = cycles_of(links.where("node <> next"))
    return found.groupBy("cycle").agg(F.count("*").cast("int").alias("vertices"), F.max("node").alias("last"))


@query(f"{SQL}, m AS (SELECT image_id, avg(CASE WHEN ann_id % 3 <> 0 THEN (x1 - x0)::DOUBLE END) AS m FROM gt WHERE has_hole GROUP BY image_id) SELECT image_id, round(m, 9) AS mean FROM m")
def finite_means(spark, sf_dir):
    """Means over what is a number; null, as metric documents write it, where nothing is."""
    value = F.when(C("ann_id") % 3 == 0, F.lit(float("nan"))).otherwise((C("x1") - C("x0")).cast("double"))
    means = gt_boxes(spark, sf_dir).where("has_hole").withColumn("v", value).groupBy("image_id").agg(F.coalesce(F.avg(F.when(~F.isnan("v"), C("v"))), F.lit(float("nan"))).alias("m"))
    return means.select("image_id", F.when(~F.isnan("m"), F.round("m", 9)).alias("mean"))


@query(f"{SQL} SELECT ann_id, idx, x, y FROM (SELECT ann_id, unnest([0, 1, 2, 3])::INT AS idx, unnest([x0, x0, x1, x1])::DOUBLE AS x, unnest([y0, y1, y1, y0])::DOUBLE AS y FROM gt)")
def training_rings(spark, sf_dir):
    """Clipped to 511, without repeats, of an area of 4 or more, simplified by 0.01, clockwise from the corner nearest the origin."""
    rings = polygons(gt_boxes(spark, sf_dir)).select("ann_id", R.remove_redundant_vertices(R.clip_ring(C("exterior"), 511, 511)).alias("r")).where(R.ring_area(C("r")) >= 4)
    rings = S.simplify_ring(rings, "r", C("r"), 0.01).where(R.ring_area(C("r")) >= 4)
    return rings.select("ann_id", F.posexplode(R.resort_corners(C("r"))).alias("idx", "p")).select("ann_id", "idx", C("p.x").alias("x"), C("p.y").alias("y"))
