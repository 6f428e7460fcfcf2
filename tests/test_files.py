"""Files of windows, splits, features, metrics and GeoParquet: what is written comes back, what is wrong is counted."""

import hashlib
import json
import struct
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from annulus import registry  # noqa: F401 - loads the plans in order
from annulus.sources import geoparquet, windows

SCHEMA = "annotation_id long, image_id long, file_name string, area double, exterior array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>"
BOX, HOLE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)]
ROWS = [(1, 1, "a.png", 96.0, BOX, [HOLE]), (2, 1, "a.png", 100.0, BOX, []), (3, 2, "b.png", 50.0, [BOX[0], BOX[1], BOX[3], BOX[2]], []), (4, 2, "b.png", 0.0, None, [])]


def test_geoparquet(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = spark.createDataFrame(ROWS, SCHEMA)
    for _ in range(2):  # again over what is there
        assert geoparquet.write_geoparquet(df.repartition(3), path, "building") == 1
    files = sorted(Path(path).glob("*.parquet"))
    assert files and not list(Path(path).glob("_temporary*")) and (Path(path) / "_SUCCESS").exists()
    for f in files:
        assert json.loads(pq.read_schema(f).metadata[b"geo"]) == geoparquet.GEO
    back = {x.annotation_id: x for x in geoparquet.read_geoparquet(spark, path).collect()}
    assert sorted(back) == [1, 2, 3] and [(back[1].hole_count, back[1].category, back[1].area), (back[2].hole_count, back[3].file_name)] == [(1, "building", 96.0), (0, "b.png")]
    for i, _, _, _, exterior, holes in ROWS[:3]:
        assert [tuple(p) for p in back[i].exterior] == exterior and [[tuple(p) for p in h] for h in back[i].holes] == holes
    assert geoparquet.write_geoparquet(df.limit(0), f"{tmp_path}/none", "x") == 0
    big = struct.pack(">BIII", 0, 3, 1, 4) + struct.pack(">8d", 0, 0, 1, 0, 1, 1, 0, 0)
    assert geoparquet.decoded(big) == [[0, 0, 1, 0, 1, 1, 0, 0]]
    with pytest.raises(ValueError):
        geoparquet.decoded(struct.pack("<BII", 1, 1, 0))


def test_geoparquet_leaves_nothing_of_a_job_that_fails(spark, tmp_path):
    path = f"{tmp_path}/out"
    spark.dataSource.register(geoparquet.GeoParquetSource)
    bad = spark.range(40).repartition(4).select(F.when(F.col("id") == 17, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("a"))
    with pytest.raises(Exception):  # noqa: B017 - the class depends on where Spark notices
        bad.write.format("geoparquet").option("path", path).mode("overwrite").save()
    assert not list(Path(tmp_path).rglob("*.parquet")) and not list(Path(tmp_path).rglob("_SUCCESS"))


def test_window_files(spark, tmp_path):
    closed = lambda r: [list(p) for p in [*r, r[0]]]
    polygon = {"type": "Polygon", "coordinates": [closed(BOX), closed(HOLE)]}
    bow = {"type": "Polygon", "coordinates": [closed([(0, 0), (4, 0), (0, 4), (4, 4)])]}
    multi = {"type": "MultiPolygon", "coordinates": [[closed(BOX)], [closed(HOLE)]]}
    name = "{}.rowmin_{}_colmin_{}_rowmax_{}_colmax_{}.poly_geojson.seg.geojson".format
    bodies = {
        name("tile.1", 0, 512, 300, 812): {"type": "GeometryCollection", "geometries": [polygon, bow, {"type": "Point", "coordinates": [1, 2]}]},
        name("tile.2", -5, 0, 7, 8): {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": multi}, {"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [bow]}}]},
        name("tile.3", 0, 0, 1, 1): {"type": "Feature", "geometry": polygon},
        name("tile.4", 0, 0, 1, 1): {"geometries": []},
        "tile.5.rowmin_x.poly_geojson.seg.geojson": polygon,
        name("tile.6", 0, 0, 1, 1).replace("seg", "other"): polygon,
    }
    for n, body in bodies.items():
        (tmp_path / n).write_text(json.dumps(body))
    (tmp_path / name("tile.7", 0, 0, 1, 1)).write_text("no json")
    found, counts = windows.read_window_geojson(spark, str(tmp_path), "seg")
    got = sorted((x.tile, x.row_min, x.col_min, x.row_max, x.col_max, x.place, x.area, len(x.holes)) for x in found.collect())
    assert got == [
        ("tile.1", 0, 512, 300, 812, 0, 96.0, 1), ("tile.1", 0, 512, 300, 812, 1, 4.0, 0), ("tile.1", 0, 512, 300, 812, 1, 4.0, 0),
        ("tile.2", -5, 0, 7, 8, 0, 100.0, 0), ("tile.2", -5, 0, 7, 8, 1, 4.0, 0), ("tile.2", -5, 0, 7, 8, 2, 4.0, 0), ("tile.2", -5, 0, 7, 8, 2, 4.0, 0),
        ("tile.3", 0, 0, 1, 1, 0, 96.0, 1),
    ]
    assert counts.first().asDict() == {"files": 6, "unparsed": 1, "polygons": 6, "invalid": 2}


def test_scores_and_splits(spark, tmp_path):
    flat = [v for p in BOX for v in p]
    (tmp_path / "side.json").write_text(json.dumps([{"image_id": 3, "segmentation": [flat], "score": 0.5}, {"image_id": 3, "segmentation": [[1, 2]], "score": 0.25}, {"image_id": 1, "segmentation": []}]))
    got = windows.read_scores_by_image(spark, f"{tmp_path}/side.json").orderBy("place").collect()
    assert [(x.image_id, x.score, x.exterior is None) for x in got] == [(3, 0.5, False), (3, 0.25, True), (1, None, True)]
    (tmp_path / "split.csv").write_text("image_name,split,image_id,source_image_name\nx/a.b.png,train, 7 ,src/one.tif\nc.png,val,,\n")
    rows = windows.read_split_csv(spark, f"{tmp_path}/split.csv").orderBy("split").collect()
    assert [(x.stem, x.alias, x.sample_id) for x in rows] == [("a.b", "one", 7), ("c", None, None)]
    with pytest.raises(ValueError, match="fold"):
        windows.read_split_csv(spark, f"{tmp_path}/split.csv", ("image_name", "fold"))
    windows.write_split_csv(spark.range(50).select(F.col("id"), (-F.col("id")).alias("key")), f"{tmp_path}/ordered", ["id"], ["key"])
    lines = [x for f in sorted((tmp_path / "ordered").glob("part-*.csv")) for x in f.read_text().split()[1:]]
    assert list(map(int, lines)) == list(range(49, -1, -1))


def test_documents(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:3], SCHEMA)
    counts = {x.file_name: x.features for x in windows.write_feature_collections(df, f"{tmp_path}/f", "file_name", "annotation_id").collect()}
    assert counts == {"a.png": 2, "b.png": 1}
    (one,) = (tmp_path / "f/collections/file_name=a.png").glob("part-*")
    doc = json.loads(one.read_text())
    assert doc["type"] == "FeatureCollection" and sorted(f["properties"]["annotation_id"] for f in doc["features"]) == [1, 2]
    assert [list(p) for p in BOX + BOX[:1]] == doc["features"][0]["geometry"]["coordinates"][0]
    assert sum(len(f.read_text().splitlines()) for f in (tmp_path / "f/all").glob("part-*")) == 3
    made = spark.sql("select named_struct('ap', double('nan'), 'n', 3, 'each', array(1.5d, double('inf'))) as metrics, double(0.25) as x, cast(null as double) as y")
    windows.save_metrics(made, f"{tmp_path}/m")
    (one,) = (tmp_path / "m").glob("part-*")
    assert json.loads(one.read_text()) == {"metrics": {"ap": None, "n": 3, "each": [1.5, None]}, "x": 0.25, "y": None}
    root = tmp_path / "release"
    (root / "sub").mkdir(parents=True)
    (root / "sub/a").write_bytes(b"one")
    (root / "b").write_bytes(b"two")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame([("sub/a", sha(b"one")), ("b", sha(b"other")), ("c", sha(b""))], "path string, sha256 string")
    assert {x.path: x.status for x in windows.check_files(spark, str(root), manifest).collect()} == {"sub/a": "ok", "b": "differs", "c": "missing"}
