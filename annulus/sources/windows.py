"""Predictions of windows, a GeoJSON file each, named by their place; their scores; tables of splits; documents of metrics and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

from annulus.functions import rings as R
from annulus.operators import planar
from annulus.sources.coco import read_predictions

WINDOW = r"^(.+)\.rowmin_(-?\d+)_colmin_(-?\d+)_rowmax_(-?\d+)_colmax_(-?\d+)\.poly_geojson\."
GEOMETRY = "type string, coordinates string"
BODY = f"{GEOMETRY}, geometry struct<{GEOMETRY}>, geometries array<struct<{GEOMETRY}>>, features array<struct<geometry:struct<{GEOMETRY}, geometries array<struct<{GEOMETRY}>>>>>"
POLYGON = "array<array<array<double>>>"


def geometries(body: Column) -> Column:
    """array<struct<type, coordinates>> of a GeoJSON text: a geometry, a feature, or a collection of either; empty for anything else."""
    doc = F.from_json(body, BODY)
    none = F.expr("cast(array() as array<struct<type:string,coordinates:string>>)")
    inner = F.flatten(F.transform(doc["features"], lambda f: F.coalesce(f["geometry"]["geometries"], F.array(F.struct(f["geometry"]["type"].alias("type"), f["geometry"]["coordinates"].alias("coordinates"))))))
    own = F.when(doc["coordinates"].isNotNull(), F.array(F.struct(doc["type"].alias("type"), doc["coordinates"].alias("coordinates"))))
    single = F.when(doc["geometry"].isNotNull(), F.array(doc["geometry"]))
    return F.coalesce(doc["geometries"], inner, own, single, none)


def polygons_of(geometry: Column) -> Column:
    """array of polygons, each an array of rings of coordinates: of a Polygon one, of a MultiPolygon its own, of others none."""
    one = F.from_json(geometry["coordinates"], POLYGON)
    many = F.from_json(geometry["coordinates"], f"array<{POLYGON}>")
    none = F.expr(f"cast(array() as array<{POLYGON}>)")
    return F.coalesce(F.when(geometry["type"] == "Polygon", F.array(one)).when(geometry["type"] == "MultiPolygon", many), none)


def read_window_geojson(spark: SparkSession, folder: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Polygons of ``<tile>.rowmin_R_colmin_C_rowmax_R2_colmax_C2.poly_geojson.<key>.geojson`` files, and one row of counts.

    Polygons: tile, row_min, col_min, row_max, col_max, place (in the file), exterior, holes and area of each valid part, in the file's
    coordinates. Counts: files, unparsed (names that say no window), polygons (as they stand in the files), invalid (of these, those of
    which nothing or several parts are left).
    """
    files = spark.read.text(f"{folder}/*.poly_geojson.{key}.geojson", wholetext=True).withColumn("name", F.col("_metadata.file_name"))
    part = lambda i: F.regexp_extract("name", WINDOW, i)
    named = files.withColumn("tile", part(1)).withColumns({c: F.expr(f"try_cast(regexp_extract(name, r'{WINDOW}', {i}) as int)") for i, c in enumerate(("row_min", "col_min", "row_max", "col_max"), 2)})
    found = named.where("tile <> ''").select("tile", "row_min", "col_min", "row_max", "col_max", F.posexplode(F.flatten(F.transform(geometries(F.col("value")), polygons_of))).alias("place", "rings"))
    ring = lambda r: R.ring_from_flat(F.flatten(F.transform(r, lambda p: F.slice(p, 1, 2))))
    rings = F.transform("rings", ring)
    shaped = found.withColumns({"exterior": F.get(rings, F.lit(0)), "holes": F.filter(F.slice(rings, 2, F.greatest(F.size("rings") - 1, F.lit(0))), lambda r: r.isNotNull())}).drop("rings")
    cut = shaped.withColumn("parts", planar.parts(F.col("exterior"), F.col("holes"))).drop("exterior", "holes")
    polygons = cut.select("*", F.explode("parts").alias("part")).drop("parts").select("*", "part.*").drop("part").where("area > 0")
    counts = named.agg(F.count("*").alias("files"), F.count_if(F.col("tile") == "").alias("unparsed"))
    return polygons, counts.join(F.broadcast(cut.agg(F.count("*").alias("polygons"), F.count_if(F.coalesce(F.size("parts"), F.lit(0)) != 1).alias("invalid"))))


def read_scores_by_image(spark: SparkSession, path: str) -> DataFrame:
    """image_id, place (in the file's order), score and the exterior of each prediction of a side file."""
    rows = read_predictions(spark, path).withColumn("place", F.monotonically_increasing_id())
    return rows.select("image_id", "place", "score", R.ring_from_flat(F.get("segmentation", F.lit(0))).alias("exterior"))


def read_split_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ("image_name", "split")) -> DataFrame:
    """The rows of a table with a header, with stem (of image_name), alias (of source_image_name, if any) and sample_id (image_id, if any).

    Raises where a required column is missing.
    """
    rows = spark.read.option("header", True).csv(path)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    stem = lambda c: F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"(.)\.[^.]*$", "$1")
    alias = F.when(F.length("source_image_name") > 0, stem(F.col("source_image_name"))) if "source_image_name" in rows.columns else F.lit(None).cast("string")
    sample = F.expr("try_cast(trim(image_id) as bigint)") if "image_id" in rows.columns else F.lit(None).cast("long")
    return rows.withColumns({"stem": stem(F.col("image_name")), "alias": alias, "sample_id": sample})


def write_split_csv(rows: DataFrame, path: str, fields: list[str], order: list[str]) -> None:
    """The named columns with a header, in order over all files."""
    rows.select(*fields, *[c for c in order if c not in fields]).orderBy(*order).select(*fields).write.mode("overwrite").option("header", True).csv(path)


def features(polygons: DataFrame, *properties: str) -> Column:
    """The GeoJSON text of each polygon as a feature with the named columns as properties."""
    coordinates = F.transform(F.concat(F.array("exterior"), "holes"), lambda r: F.transform(R.close_ring(r), lambda p: F.array(p["x"], p["y"])))
    return F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"))


def write_feature_collections(polygons: DataFrame, path: str, by: str, *properties: str) -> DataFrame:
    """A FeatureCollection for each value of ``by``, in folders by value, all features as lines below ``path/all``; returns the number of each.

    A collection is one document, so one task writes it; the lines split over tasks.
    """
    made = polygons.select(by, features(polygons, by, *properties).alias("f"))
    made.select(F.to_json("f").alias("value")).write.mode("overwrite").text(f"{path}/all")
    whole = made.groupBy(by).agg(F.collect_list("f").alias("features"))
    text = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features"))
    whole.select(by, text.alias("value")).write.mode("overwrite").partitionBy(by).text(f"{path}/collections")
    return made.groupBy(by).agg(F.count("*").alias("features"))


def finite(value: Column, kind) -> Column:
    """value with null for each number in it that is not finite."""
    if isinstance(kind, DoubleType | FloatType):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if isinstance(kind, StructType):
        return F.struct(*[finite(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: finite(x, kind.elementType))
    return value


def save_metrics(metrics: DataFrame, path: str) -> None:
    """A one-row table as one JSON document; what is no finite number is null, and stands there."""
    row = F.struct(*[finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in metrics.schema.fields])
    metrics.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def check_files(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """``manifest(path, sha256)`` -> path and status: ok, missing or differs; paths below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    own = found.select(F.substring_index("path", f"{root.rstrip('/').rsplit('/', 1)[-1]}/", -1).alias("path"), F.sha2("content", 256).alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha256"), "ok").otherwise("differs")
    return manifest.join(own, "path", "left").select("path", status.alias("status"))
