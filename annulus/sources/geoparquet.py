"""GeoParquet: polygons with holes as well-known binary, the ``geo`` document in every file's footer, and files that appear on commit alone."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from annulus.functions import rings as R
from annulus.operators import planar

#: Fixed values of the format.
GEO = {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["Polygon"], "crs": None}}}
POLYGON = 3
RINGS = "array<array<double>>"


def encoded(rings: list) -> bytes:
    """Well-known binary of flat closed rings, little-endian."""
    out = [struct.pack("<BII", 1, POLYGON, len(rings))]
    for ring in rings:
        out += [struct.pack("<I", len(ring) // 2), np.asarray(ring, "<f8").tobytes()]
    return b"".join(out)


def decoded(data: bytes) -> list[list[float]]:
    """Flat closed rings of a polygon's well-known binary of either byte order."""
    order = "<" if data[0] == 1 else ">"
    kind, n = struct.unpack_from(order + "II", data, 1)
    if kind != POLYGON:
        raise ValueError(f"geometry type {kind} is no polygon")
    rings, at = [], 9
    for _ in range(n):
        (size,) = struct.unpack_from(order + "I", data, at)
        rings.append(np.frombuffer(data, order + "f8", 2 * size, at + 4).astype(float).tolist())
        at += 4 + 16 * size
    return rings


def as_wkb(exterior: Column, holes: Column) -> Column:
    @F.pandas_udf("binary")
    def kernel(rings: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else encoded(r) for r in rings], dtype=object)

    closed = F.transform(F.concat(F.array(exterior), F.coalesce(holes, F.expr("array()"))), lambda r: R.flat(R.close_ring(r)))
    return kernel(F.when(exterior.isNotNull(), closed))


def from_wkb(geometry: Column) -> Column:
    """array of open rings, the exterior first; null for null."""

    @F.pandas_udf(RINGS)
    def kernel(data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else decoded(bytes(d)) for d in data], dtype=object)

    return F.transform(kernel(geometry), R.ring_from_flat)


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    """Each task writes one file into a folder of the job's own; commit moves those of the tasks that counted, so that what a lost or
    repeated task has left never shows."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = self._place()
        name, rows, writer = f"part-{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if writer is None:
                folder = f"{root}/_temporary-{self.job}"
                system.create_dir(folder, recursive=True)
                schema = batch.schema.with_metadata({b"geo": json.dumps(GEO).encode()})
                writer = pq.ParquetWriter(system.open_output_stream(f"{folder}/{name}"), schema, compression="zstd")
            writer.write_batch(pa.RecordBatch.from_arrays(batch.columns, schema=writer.schema))
            rows += batch.num_rows
        if writer is None:
            return Written(None, 0)
        writer.close()
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self._place()
        if self.overwrite and system.get_file_info(root).type != fs.FileType.NotFound:
            for info in system.get_file_info(fs.FileSelector(root)):
                if info.base_name.startswith("part-") or info.base_name == "_SUCCESS":
                    system.delete_file(info.path)
        system.create_dir(root, recursive=True)
        for m in messages:
            if m and m.name:
                system.move(f"{root}/_temporary-{self.job}/{m.name}", f"{root}/{m.name}")
        system.open_output_stream(f"{root}/_SUCCESS").close()
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = self._place()
        folder = f"{root}/_temporary-{self.job}"
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class GeoParquetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geoparquet"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def write_geoparquet(polygons: DataFrame, path: str, category: str) -> int:
    """``polygons(annotation_id, image_id, file_name, area, exterior, holes)`` -> files below path; returns how many geometries are invalid.

    Those are written as they are. A geometry is valid where repair leaves one part of as many rings and the same area. Rows without an
    exterior are left out. The path must be one that driver and executors share, of a file system that pyarrow opens.
    """
    spark = polygons.sparkSession
    known = polygons.where("exterior is not null")
    checked = known.select("exterior", "holes", planar.parts(F.col("exterior"), F.col("holes")).alias("parts"))
    only = F.get("parts", F.lit(0))
    same = (F.size("parts") == 1) & (F.size(only["holes"]) == F.size("holes")) & (F.abs(only["area"] - R.polygon_area(F.col("exterior"), F.col("holes"))) <= 1e-6 * F.greatest(only["area"], F.lit(1.0)))
    invalid = checked.where(~F.coalesce(same, F.lit(False))).count()
    rows = known.select(
        F.col("annotation_id").cast("long"), F.col("image_id").cast("long"), F.col("file_name").cast("string"), F.lit(category).alias("category"),
        F.col("area").cast("double"), F.size("holes").alias("hole_count"), as_wkb(F.col("exterior"), F.col("holes")).alias("geometry"),
    )
    spark.dataSource.register(GeoParquetSource)
    rows.write.format("geoparquet").option("path", path).mode("overwrite").save()
    return invalid


def read_geoparquet(spark: SparkSession, path: str) -> DataFrame:
    """The table with exterior and holes in place of geometry; Spark reads the files, so filters and columns are pushed down."""
    rows = spark.read.parquet(path).withColumn("rings", from_wkb(F.col("geometry")))
    return rows.withColumns({"exterior": F.get("rings", F.lit(0)), "holes": F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0)))}).drop("rings", "geometry")
