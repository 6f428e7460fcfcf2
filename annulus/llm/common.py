"""What the operators share: the shared scratch folder, reading tables and row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from annulus.operators.shared import Scratch, batches_of, shared_folder, shuffles_freed  # noqa: F401 - the operators take them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of docs has, whatever the case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_hash(id_column: str = "doc_id") -> Column:
    """crc32 of the id written as text; -1 where the id is null."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(-1).cast("long"))


def text_key(text_column: str = "text") -> Column:
    """Tells apart rows that carry one id but different texts."""
    return F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))


def first_by_hash(rows: DataFrame, key: str, n: int, id_column: str = "doc_id", buckets: int = 64, before: tuple[str, ...] = (), after: tuple[str, ...] = ()) -> DataFrame:
    """n rows at most for each value of key, with ``r`` from 1: the first by the columns of before, a hash of the id, the id and
    the columns of after.

    Buckets of the hash are cut to n first, so the last window gets buckets * n rows of a value at most.
    """
    order = [*before, F.xxhash64(id_column), F.col(id_column), *after]
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(id_column, F.lit(1)), F.lit(buckets)))
    few = dealt.withColumn("r", F.row_number().over(W.partitionBy(key, "_b").orderBy(*order))).where(F.col("r") <= n).drop("r", "_b")
    return few.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("r") <= n)


def first_rows(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows of docs named by ``firsts(doc_id, text_key)``, one for each, and those of a null doc_id."""
    (own,) = free_names(docs, "_text_key")
    known = docs.where("doc_id is not null").withColumn(own, text_key())
    kept = known.join(firsts, (known["doc_id"] == firsts["doc_id"]) & (known[own] == firsts["text_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).drop(own).unionByName(docs.where("doc_id is null"))
