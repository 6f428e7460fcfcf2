import json

from annulus.functions import rings as R
from annulus.sources import coco
from pyspark.sql import functions as F

SQUARE, HOLE = [0, 0, 4, 0, 4, 4, 0, 4, 0, 0], [1, 1, 2, 1, 2, 2, 1, 2]


def test_documents(spark, tmp_path):
    anns = [
        {"id": 1, "image_id": 7, "segmentation": [SQUARE, HOLE], "bbox": [0, 0, 4, 4], "area": 15},
        {"id": 2, "image_id": 7, "segmentation": [[0, 0, 1, 1]], "bbox": [0, 0, 1, 1]},
        {"id": 3, "image_id": 8, "segmentation": [[0, 0, 4, 0, 0]], "bbox": [0, 0, 4, 1]},
        {"id": 4, "image_id": 8, "segmentation": [[0, 0, 4, 0, 0, 3]], "bbox": [0, 0, 4, 3], "score": 0.5},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"images": [{"id": 7, "file_name": "x1.png"}, {"id": 8, "file_name": "y.png"}], "annotations": anns, "categories": [{"id": 1, "name": "c"}]}))
    images, rows, cats = coco.read_coco(spark, str(tmp_path / "a.json"))
    assert images.count() == 2 and cats.count() == 1 and coco.schema_kind(rows) == "nested"
    polygons = coco.as_polygons(rows)
    assert {x.id: x.area for x in polygons.collect()} == {1: 15.0, 4: 6.0}
    assert coco.as_polygons(rows, min_score=0.5).count() == 1
    parts = coco.split_rings(polygons.withColumn("source_geojson", F.lit("s")).withColumn("source_geometry_index", F.col("id")))
    assert parts.count() == 3
    back = coco.ring_rows_to_polygons(parts.withColumn("ring_role", F.lit(None).cast("string")))
    assert sorted(x.a for x in back.select(R.polygon_area(F.col("exterior"), F.col("holes")).alias("a")).collect()) == [6.0, 15.0]
    coco.write_predictions(polygons, str(tmp_path / "p"))
    assert coco.as_polygons(coco.read_predictions(spark, str(tmp_path / "p"), lines=True)).count() == 2
    coco.write_geojson(polygons, str(tmp_path / "g"))
    texts = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "g")).collect()]
    assert len(texts) == 2 and all(t["type"] == "GeometryCollection" for t in texts)


def test_ring_functions(spark):
    df = spark.range(1).select(R.ring_from_flat(F.array(*[F.lit(float(v)) for v in SQUARE])).alias("r"))
    out = df.select(
        F.size("r").alias("n"), R.signed_area(F.col("r")).alias("a"), R.ring_perimeter(F.col("r")).alias("p"), F.size(R.remove_redundant_vertices(R.close_ring(F.col("r")))).alias("k"),
        F.size(R.sample_to_n(F.col("r"), 2)).alias("two"), R.detokenise(R.tokenise(F.col("r"), 4, 4, 5, 12), 4, 4, 5).alias("back"), F.col("r").alias("r"), R.is_closed(R.close_ring(F.col("r"))).alias("c"),
    ).first()
    assert (out.n, out.a, out.p, out.k, out.two, out.c) == (4, 16.0, 16.0, 4, 2, True) and out.back == out.r


def test_edge_functions_of_odd_rings(spark):
    from pyspark.sql import functions as F

    from annulus.functions import rings as R

    kind = "array<struct<x:double,y:double>>"
    rows = [(1, None, None), (2, [], [(0.0, 0.0)]), (3, [(0.0, 0.0), (4.0, 0.0), (0.0, 3.0)], [(4.0, 0.0), (0.0, 3.0), (0.0, 0.0)]), (4, [(0.0, 0.0), (2.0, 0.0)], [(0.0, 0.0), (2.0, 0.0), (2.0, 0.0)])]
    df = spark.createDataFrame(rows, f"id int, a {kind}, b {kind}")
    a, b = F.col("a"), F.col("b")
    got = {r.id: r for r in df.select("id", R.edge_lengths(a).alias("n"), F.size(R.densify(a, 2.0)).alias("k"), R.least_shift_distance(a, b).alias("d")).collect()}
    assert (got[1].n, got[1].d) == (None, None) and (got[2].n, got[2].d) == ([], None)
    assert got[3].n == [4.0, 5.0, 3.0] and got[3].k == 2 + 3 + 2 and got[3].d == 0
    assert got[4].d == 0
