"""Annotation documents: reading them as tables of images and polygons, and writing polygons back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.functions import rings as R
from annulus.operators import forests, rounds

IMAGES = "array<struct<id:bigint,file_name:string,width:int,height:int,source_image_name:string,patch_origin:array<int>>>"
ANNOTATIONS = (
    "array<struct<id:bigint,image_id:bigint,category_id:int,area:double,bbox:array<double>,iscrowd:int,segmentation:array<array<double>>,"
    "has_hole:boolean,hole_count:int,is_hole:boolean,ring_role:string,source_geojson:string,source_geometry_index:bigint,score:double>>"
)
DOCUMENT = f"images {IMAGES}, annotations {ANNOTATIONS}, categories array<struct<id:bigint,name:string,supercategory:string>>"
PREDICTION = "image_id bigint, segmentation array<array<double>>, score double, bbox array<double>, area double, id bigint, category_id int"


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations and categories of one document or of a folder of them (a document is one task's work)."""
    doc = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    part = lambda name: doc.select(F.explode(name).alias("r")).select("r.*")
    return part("images"), part("annotations"), part("categories")


def read_predictions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rows of an array document, or of JSON lines, which split over tasks."""
    return spark.read.schema(PREDICTION).option("multiLine", not lines).json(path)


def schema_kind(annotations: DataFrame) -> str:
    """``ring`` where rows are single rings with a role, else ``nested``. Raises on an empty table."""
    row = annotations.select([c for c in ("ring_role", "is_hole", "has_hole", "hole_count", "segmentation", "bbox") if c in annotations.columns]).first()
    if row is None:
        raise ValueError("no annotations")
    have = {k for k, v in row.asDict().items() if v is not None}
    if have & {"ring_role", "is_hole"}:
        return "ring"
    if have & {"has_hole", "hole_count"} or {"segmentation", "bbox"} <= have:
        return "nested"
    raise ValueError("neither ring rows nor nested polygons")


def as_polygons(rows: DataFrame, default_score: float = 0.0, min_score: float | None = None) -> DataFrame:
    """Rows with ``segmentation`` -> with exterior, holes, area and score; rows without a usable exterior are dropped.

    The first ring is the exterior, the others are holes; holes with fewer than three vertices are left out. A missing
    score is default_score; min_score keeps rows of that score or more.
    """
    rings = F.transform("segmentation", R.ring_from_flat)
    score = F.coalesce(F.col("score"), F.lit(default_score)) if "score" in rows.columns else F.lit(default_score)
    out = rows.withColumns({"exterior": F.get(rings, F.lit(0)), "holes": F.filter(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: r.isNotNull()), "score": score})
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    out = out.where("exterior is not null").withColumn("area", R.polygon_area(F.col("exterior"), F.col("holes")))
    return out.where("area > 0")


def ring_rows_to_polygons(rings: DataFrame) -> DataFrame:
    """Ring rows (one ring each, keyed by image, source file and geometry index) -> one polygon for each key."""
    ring = R.ring_from_flat(F.get(F.col("segmentation"), F.lit(0)))
    hole = F.coalesce(F.col("is_hole"), F.col("ring_role") == "hole", F.lit(False))
    own = rings.select("image_id", "source_geojson", "source_geometry_index", "id", ring.alias("ring"), hole.alias("hole")).where("ring is not null")
    grouped = own.groupBy("image_id", "source_geojson", "source_geometry_index").agg(
        F.min(F.when(~F.col("hole"), F.struct("id", "ring"))).alias("first"), F.array_sort(F.collect_list(F.when(F.col("hole"), F.struct("id", "ring")))).alias("inner")
    )
    return grouped.where("first is not null").select("image_id", "source_geojson", "source_geometry_index", F.col("first.ring").alias("exterior"), F.transform("inner", lambda r: r["ring"]).alias("holes"))


def read_ring_predictions(spark: SparkSession, path: str, min_score: float = 0.0, min_area: float = 10.0, lines: bool = False, **options: float) -> tuple[DataFrame, DataFrame]:
    """Polygons with holes from a file of single rings, and one row of counts of what was read, left out and made.

    Rings are repaired, rings under min_score or min_area and those that are none are left out, near copies go, and rings in others become
    their holes (``forests.ring_polygons``, which takes the options).
    """
    rows = read_predictions(spark, path, lines).withColumn("id", F.monotonically_increasing_id())
    found = rounds.cut(forests.usable_rings(rows, min_score, min_area))
    polygons = rounds.cut(forests.ring_polygons(found.where("status = 'kept'"), **options))
    count = lambda status: F.count_if(F.col("status") == status)
    counts = found.agg(F.count("*").alias("num_predictions"), count("kept").alias("num_kept_rings"), count("low_score").alias("num_skipped_low_score"), count("invalid").alias("num_skipped_invalid"))
    return polygons, counts.join(F.broadcast(polygons.agg(F.count("*").alias("num_grouped_buildings"))))


def split_rings(polygons: DataFrame) -> DataFrame:
    """One row for each ring, in the shape that ring_rows_to_polygons reads."""
    rings = polygons.select("*", F.posexplode(F.concat(F.array("exterior"), "holes")).alias("ring_index", "ring")).drop("exterior", "holes", "segmentation", "is_hole")
    return rings.select("*", (F.col("ring_index") > 0).alias("is_hole"), F.array(R.flat(F.col("ring"))).alias("segmentation")).drop("ring")


def write_predictions(polygons: DataFrame, path: str) -> None:
    """JSON lines of image_id, segmentation (closed rings), score and area."""
    rings = F.transform(F.concat(F.array("exterior"), "holes"), lambda r: R.flat(R.close_ring(r)))
    polygons.select("image_id", rings.alias("segmentation"), "score", "area").write.mode("overwrite").json(path)


def write_geojson(polygons: DataFrame, path: str) -> None:
    """A GeometryCollection for each image, in folders by image."""
    coordinates = F.transform(F.concat(F.array("exterior"), "holes"), lambda r: F.transform(R.close_ring(r), lambda p: F.array(p["x"], p["y"])))
    geometry = polygons.select("image_id", F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("g"))
    whole = geometry.groupBy("image_id").agg(F.collect_list("g").alias("geometries"))
    text = F.to_json(F.struct(F.lit("GeometryCollection").alias("type"), "geometries"))
    whole.select("image_id", text.alias("value")).write.mode("overwrite").partitionBy("image_id").text(path)
