"""Ring functions applied to the rings of the box fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from annulus.functions import rings as R
from annulus.operators import detection as D
from annulus.plans.detection import MATCH_SQL, matches
from annulus.registry import query
from annulus.sources.boxes import INSET, SQL, gt_boxes, polygons, pred_boxes

C = F.col


def gt_rings(spark, sf_dir):
    return polygons(gt_boxes(spark, sf_dir))


def vertices(df, ring, *keys):
    """A row for each vertex."""
    return df.select(*keys, F.posexplode(ring).alias("idx", "p")).select(*keys, "idx", C("p.x").alias("x"), C("p.y").alias("y"))


CORNERS = "(SELECT ann_id, image_id, unnest([0, 1, 2, 3])::INT AS idx, unnest([x0, x1, x1, x0])::DOUBLE AS x, unnest([y0, y0, y1, y1])::DOUBLE AS y FROM gt)"


@query(f"""{SQL} SELECT ann_id, ((x1-x0)*(y1-y0))::DOUBLE AS ring_area, ((x1-x0)*(y1-y0) - CASE WHEN has_hole THEN (x1-x0-12)*(y1-y0-12) ELSE 0 END)::DOUBLE AS polygon_area,
  (2*(x1-x0) + 2*(y1-y0))::DOUBLE AS perimeter, sqrt(((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0))::DOUBLE) AS diameter, x0::DOUBLE AS bx, y0::DOUBLE AS by, (x1-x0)::DOUBLE AS bw, (y1-y0)::DOUBLE AS bh FROM gt""")
def ring_measures(spark, sf_dir):
    b = R.ring_bbox(C("exterior"))
    return gt_rings(spark, sf_dir).select(
        "ann_id", R.ring_area(C("exterior")).alias("ring_area"), R.polygon_area(C("exterior"), C("holes")).alias("polygon_area"), R.ring_perimeter(C("exterior")).alias("perimeter"), R.ring_diameter(C("exterior")).alias("diameter"),
        b["x0"].alias("bx"), b["y0"].alias("by"), (b["x1"] - b["x0"]).alias("bw"), (b["y1"] - b["y0"]).alias("bh"),
    )


@query(f"{SQL} SELECT ann_id, idx, x, y FROM {CORNERS}")
def flat_round_trip(spark, sf_dir):
    ring = R.ring_from_flat(R.flat(R.close_ring(C("exterior"))))
    return vertices(gt_rings(spark, sf_dir), ring, "ann_id")


@query(f"""{SQL} SELECT ann_id, greatest(x0 - (x1-x0)*0.1, 0)::DOUBLE AS ex0, greatest(y0 - (y1-y0)*0.1, 0)::DOUBLE AS ey0,
  least(x1 + (x1-x0)*0.1, 512 - 1e-4)::DOUBLE AS ex1, least(y1 + (y1-y0)*0.1, 512 - 1e-4)::DOUBLE AS ey1 FROM gt""")
def enlarged_boxes(spark, sf_dir):
    c = lambda k: C(k).cast("double")
    w, h = (c("x1") - c("x0")) * 0.1, (c("y1") - c("y0")) * 0.1
    most = F.lit(512 - 1e-4)
    return gt_boxes(spark, sf_dir).select(
        "ann_id", F.greatest(c("x0") - w, F.lit(0.0)).alias("ex0"), F.greatest(c("y0") - h, F.lit(0.0)).alias("ey0"), F.least(c("x1") + w, most).alias("ex1"), F.least(c("y1") + h, most).alias("ey1")
    )


@query(f"""{SQL} SELECT ann_id, greatest((x0+x1)/2.0 - (x1-x0)*0.75, 0)::DOUBLE AS ex0, greatest((y0+y1)/2.0 - (y1-y0)*0.75, 0)::DOUBLE AS ey0,
  least((x0+x1)/2.0 + (x1-x0)*0.75, 512)::DOUBLE AS ex1, least((y0+y1)/2.0 + (y1-y0)*0.75, 512)::DOUBLE AS ey1 FROM gt""")
def expanded_boxes(spark, sf_dir):
    def side(a, b, sign):
        v = (C(a) + C(b)) / 2 + sign * 0.75 * (C(b) - C(a))
        return F.greatest(v, F.lit(0.0)) if sign < 0 else F.least(v, F.lit(512.0))

    return gt_boxes(spark, sf_dir).select("ann_id", side("x0", "x1", -1).alias("ex0"), side("y0", "y1", -1).alias("ey0"), side("x0", "x1", 1).alias("ex1"), side("y0", "y1", 1).alias("ey1"))


@query(f"""{SQL} SELECT ann_id, (x0+x1)/2.0 AS cx, (y0+y1)/2.0 AS cy, (x1-x0)::DOUBLE AS w, (y1-y0)::DOUBLE AS h, (512-x1)::DOUBLE AS flip_x0, (512-x0)::DOUBLE AS flip_x1 FROM gt""")
def box_forms(spark, sf_dir):
    d = lambda v: v.cast("double")
    return gt_boxes(spark, sf_dir).select(
        "ann_id", ((C("x0") + C("x1")) / 2).alias("cx"), ((C("y0") + C("y1")) / 2).alias("cy"), d(C("x1") - C("x0")).alias("w"), d(C("y1") - C("y0")).alias("h"), d(512 - C("x1")).alias("flip_x0"), d(512 - C("x0")).alias("flip_x1")
    )


@query(f"""{SQL}, p AS {CORNERS}, m AS (SELECT unnest(range(0, 8))::INT AS mode),
t AS (SELECT ann_id, idx, mode, CASE WHEN mode & 4 > 0 THEN y ELSE x END AS x, CASE WHEN mode & 4 > 0 THEN x ELSE y END AS y FROM p CROSS JOIN m)
SELECT ann_id, mode, idx, CASE WHEN mode & 1 > 0 THEN 512 - x ELSE x END AS x, CASE WHEN mode & 2 > 0 THEN 512 - y ELSE y END AS y FROM t""")
def d4_symmetries(spark, sf_dir):
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), R.d4(C("exterior"), m, 512, 512).alias("ring")) for m in range(8)])
    return vertices(gt_rings(spark, sf_dir).select("ann_id", F.explode(modes).alias("t")).select("ann_id", "t.*"), C("ring"), "ann_id", "mode")


@query(f"""{SQL}, p AS {CORNERS} SELECT ann_id, idx, least(greatest(x * 2 - 100, 0), 511)::DOUBLE AS x, least(greatest(y * 2 - 100, 0), 511)::DOUBLE AS y FROM p""")
def affine_and_clip(spark, sf_dir):
    return vertices(gt_rings(spark, sf_dir), R.clip_ring(R.affine(C("exterior"), 2.0, 0.0, -100.0, 0.0, 2.0, -100.0), 511, 511), "ann_id")


@query(f"""{SQL}, p AS {CORNERS} SELECT ann_id, CASE idx WHEN 0 THEN 0 WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 3 END::INT AS idx, x, y FROM p""")
def clockwise_corners(spark, sf_dir):
    return vertices(gt_rings(spark, sf_dir), R.resort_corners(C("exterior")), "ann_id")


@query(f"""{SQL}, p AS {CORNERS}, n AS (SELECT ann_id, unnest(range(0, 6))::INT AS idx FROM gt)
SELECT n.ann_id, n.idx, p.x, p.y, (n.idx < 4)::INT AS label FROM n JOIN p ON n.ann_id = p.ann_id AND p.idx = least(n.idx, 3)""")
def padded_rings(spark, sf_dir):
    ring, labels = R.pad_ring(C("exterior"), 6)
    return gt_rings(spark, sf_dir).select("ann_id", F.posexplode(F.arrays_zip(ring.alias("r"), labels.alias("l"))).alias("idx", "t")).select("ann_id", "idx", C("t.r.x").alias("x"), C("t.r.y").alias("y"), C("t.l").alias("label"))


@query(f"""{SQL}, e AS (SELECT ann_id, unnest([x1-x0, y1-y0, x1-x0, y1-y0])::DOUBLE AS n FROM gt) SELECT ann_id, sum(greatest(1, round_even(n / 5, 0)))::BIGINT AS samples FROM e GROUP BY ann_id""")
def ring_samples(spark, sf_dir):
    return gt_rings(spark, sf_dir).select("ann_id", F.size(R.sample_ring(C("exterior"), 5.0)).cast("long").alias("samples"))


TOKENS = "[128] || list_transform([x0, y0, x1, y0, x1, y1, x0, y1], lambda v: round_even(v / 512.0 * 127, 0)::INT) || [129, 130, 130]"


@query(f"""{SQL}, inside AS (SELECT * FROM gt), t AS (SELECT ann_id, {TOKENS} AS tokens FROM inside) SELECT ann_id, unnest(range(0, 12))::INT AS pos, unnest(tokens)::INT AS token FROM t""")
def ring_tokens(spark, sf_dir):
    return gt_rings(spark, sf_dir).select("ann_id", F.posexplode(R.tokenise(C("exterior"), 512, 512, 128, 12)).alias("pos", "token"))


@query(f"""{SQL}, p AS {CORNERS} SELECT a.ann_id, a.idx, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb, atan2(b.y - a.y, b.x - a.x) AS angle FROM p a JOIN p b ON a.ann_id = b.ann_id AND b.idx = (a.idx + 1) % 4""")
def ring_edges(spark, sf_dir):
    e = gt_rings(spark, sf_dir).select("ann_id", F.posexplode(R.edges(C("exterior"))).alias("idx", "e"))
    return e.select("ann_id", "idx", C("e.a.x").alias("xa"), C("e.a.y").alias("ya"), C("e.b.x").alias("xb"), C("e.b.y").alias("yb"), F.atan2(C("e.b.y") - C("e.a.y"), C("e.b.x") - C("e.a.x")).alias("angle"))


@query(f"""{SQL}, p AS {CORNERS} SELECT ann_id, count(*)::INT AS convex, 90.0::DOUBLE AS angle FROM p GROUP BY ann_id""")
def convex_corners(spark, sf_dir):
    return gt_rings(spark, sf_dir).select("ann_id", R.convex_hull_size(C("exterior")).alias("convex"), F.round(R.vertex_angles(C("exterior"))[0], 3).alias("angle"))


@query(f"""{SQL}, t AS (SELECT ann_id, 'tile' || (image_id // 4) || '.png' AS name FROM gt) SELECT 'tile' AS city, count(*) AS n FROM t""")
def cities(spark, sf_dir):
    named = gt_boxes(spark, sf_dir).select(R.city_of(F.concat(F.lit("tile"), F.expr("image_id div 4"), F.lit(".png"))).alias("city"))
    return named.groupBy("city").agg(F.count("*").alias("n"))


@query(f"""{SQL}, gc AS {CORNERS}, pc AS (SELECT pred_id, unnest([0, 1, 2, 3])::INT AS j, unnest([x0, x1, x1, x0])::DOUBLE AS u, unnest([y0, y0, y1, y1])::DOUBLE AS v FROM pred),
d AS (SELECT ann_id, (j - idx + 4) % 4 AS s, avg(sqrt((x-u)*(x-u) + (y-v)*(y-v))) AS d FROM gc JOIN pc ON pred_id = ann_id GROUP BY ALL), m AS (SELECT ann_id, min(d) AS d FROM d GROUP BY ann_id)
SELECT ann_id, (x1 - x0)::DOUBLE AS first_edge, round(1.5::DOUBLE * pi(), 9) AS last_angle, (2 * ceil((x1 - x0) / 5.0::DOUBLE) + 2 * ceil((y1 - y0) / 5.0::DOUBLE))::INT AS points, round(d, 9) AS shifted FROM gt JOIN m USING (ann_id)""")
def edge_geometry(spark, sf_dir):
    """Edges of rings, points that leave no gap over 5, and the distance to the prediction's ring, begun anywhere."""
    pred = polygons(pred_boxes(spark, sf_dir)).select(C("pred_id").alias("ann_id"), R.rotated(C("exterior"), 3).alias("other"))
    ring = C("exterior")
    return gt_rings(spark, sf_dir).join(pred, "ann_id").select(
        "ann_id", F.element_at(R.edge_lengths(ring), 1).alias("first_edge"), F.round(F.element_at(R.edge_angles(ring), -1), 9).alias("last_angle"),
        F.size(R.densify(ring, 5.0)).alias("points"), F.round(R.least_shift_distance(ring, C("other")), 9).alias("shifted"),
    )


def _ring_points(alias: str, hole: str) -> str:
    outer = f"SELECT {alias}.id, unnest([x0, x1, x1, x0])::DOUBLE AS x, unnest([y0, y0, y1, y1])::DOUBLE AS y, unnest([x1, x1, x0, x0])::DOUBLE AS nx, unnest([y0, y1, y1, y0])::DOUBLE AS ny FROM {alias}"
    i = INSET
    inner = f"SELECT {alias}.id, unnest([x0+{i}, x1-{i}, x1-{i}, x0+{i}])::DOUBLE, unnest([y0+{i}, y0+{i}, y1-{i}, y1-{i}])::DOUBLE, unnest([x1-{i}, x1-{i}, x0+{i}, x0+{i}])::DOUBLE, unnest([y0+{i}, y1-{i}, y1-{i}, y0+{i}])::DOUBLE FROM {alias} WHERE {hole}"
    return f"({outer} UNION ALL {inner})"


def _one_way(a: str, b: str) -> str:
    t = f"greatest(0, least(1, (({a}.x-{b}.x)*({b}.nx-{b}.x) + ({a}.y-{b}.y)*({b}.ny-{b}.y)) / (({b}.nx-{b}.x)*({b}.nx-{b}.x) + ({b}.ny-{b}.y)*({b}.ny-{b}.y))))"
    return f"min(sqrt(pow({a}.x - ({b}.x + {t}*({b}.nx-{b}.x)), 2) + pow({a}.y - ({b}.y + {t}*({b}.ny-{b}.y)), 2)))"


@query(f"""{MATCH_SQL}, mt AS (SELECT ann_id, pred_id FROM m4 WHERE tp AND threshold = 0.5),
ga AS (SELECT ann_id AS id, * FROM gt WHERE ann_id IN (SELECT ann_id FROM mt)), pa AS (SELECT pred_id AS id, * FROM pred WHERE pred_id IN (SELECT pred_id FROM mt)),
a AS (SELECT *, row_number() OVER () AS v FROM {_ring_points('ga', 'has_hole')}), b AS (SELECT *, row_number() OVER () AS v FROM {_ring_points('pa', 'has_hole')}),
ab AS (SELECT mt.ann_id, mt.pred_id, a.v, {_one_way('a', 'b')} AS d FROM mt JOIN a ON a.id = mt.ann_id JOIN b ON b.id = mt.pred_id GROUP BY ALL),
ba AS (SELECT mt.ann_id, mt.pred_id, b.v, {_one_way('b', 'a')} AS d FROM mt JOIN a ON a.id = mt.ann_id JOIN b ON b.id = mt.pred_id GROUP BY ALL)
SELECT x.ann_id, x.pred_id, round((x.d + y.d) / 2, 9) AS polis FROM (SELECT ann_id, pred_id, avg(d) AS d FROM ab GROUP BY ALL) x JOIN (SELECT ann_id, pred_id, avg(d) AS d FROM ba GROUP BY ALL) y USING (ann_id, pred_id)""")
def polis_of_matches(spark, sf_dir):
    found, gt, pred = matches(spark, sf_dir, [0.5])
    rings = lambda df, key, name: polygons(df).select("image_id", key, F.concat(F.array(C("exterior")), C("holes")).alias(name))
    both = found.where("tp").select("image_id", "ann_id", "pred_id").join(rings(gt, "ann_id", "a"), ["image_id", "ann_id"]).join(rings(pred, "pred_id", "b"), ["image_id", "pred_id"])
    return both.select("ann_id", "pred_id", F.round(R.polis(C("a"), C("b")), 9).alias("polis"))
