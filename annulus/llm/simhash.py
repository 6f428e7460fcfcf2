"""SimHash near-duplicates: fingerprints in Arrow batches, candidates by shared pigeonhole blocks, in SQL.

A 64-bit fingerprint is split into ``blocks`` blocks. Two fingerprints that differ in at most ``max_bits`` bits
agree in at least ``blocks - max_bits`` of them, so each choice of that many blocks is a table of buckets, and a
close pair shares a bucket of some table. Distinct fingerprints are joined on their buckets and verified by
Hamming distance. A bucket of more than ``small_bucket`` fingerprints is not paired up: there, every member is
dealt to all values at ``max_bits // 2`` bits or fewer from it and linked with the smallest fingerprint dealt to
the same value. Members of one value are within ``max_bits`` of each other, and any two members within an even
``max_bits`` share a value, so no link is lost or made up, and the rows stay in proportion to the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.llm.common import Scratch, first_rows, text_key
from annulus.llm.components import connected_components

SHINGLE_WORDS, MAX_BITS, BLOCKS, SMALL_BUCKET = 3, 2, 4, 64
STEP = 65_536


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The signed 64-bit fingerprint of a whole text; no words (or null): 0."""
    found = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and white space is 0x20, 0x09-0x0D
    if not found:
        return 0
    grams = [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    count = max(1, len(found) - words + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, STEP):  # bounded memory for very long texts
        part = hashes[at : at + STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp long)`` and the columns of keep, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x, words) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64()), *map(batch.column, keep)], ["doc_id", "fp", *keep])

    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) if keep else ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep).mapInArrow(run, "doc_id long, fp long" + kept)


def _masks(blocks: int, max_bits: int) -> list[int]:
    """One signed 64-bit mask for each choice of blocks that a close pair must share."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    chosen = [sum(x) for x in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def _near_values(fp: Column, mask: Column, bits: int) -> Column:
    """The values at ``bits`` bits or fewer from fp that differ from it only outside the mask."""
    singles = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)), lambda x: x.bitwiseAND(mask) == 0)
    flips = F.array(F.lit(0).cast("long"))
    for _ in range(bits):
        old = flips
        flips = F.array_distinct(F.concat(old, F.flatten(F.transform(old, lambda y: F.transform(singles, lambda x: x.bitwiseXOR(y))))))  # noqa: B023
    return F.transform(flips, lambda x: fp.bitwiseXOR(x))


def close_fingerprints(spark: SparkSession, fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Distinct ``fps(fp long)`` -> links ``(a long, b long)`` whose components are those of all pairs within max_bits."""
    if max_bits % 2 or not 0 <= max_bits < blocks:
        raise ValueError("max_bits must be even and smaller than the number of blocks")
    scratch = Scratch(spark, "simhash")
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(blocks, max_bits)])
    dealt = fps.select("fp", F.posexplode(masks).alias("t", "mask")).select("fp", "t", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"))
    sizes = scratch.keep(dealt.groupBy("t", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = scratch.keep(dealt.join(sizes, ["t", "bucket"]), "shared")
    few = shared.where(F.col("n") <= small_bucket).select("t", "bucket", "fp")
    pairs = (
        few.withColumnRenamed("fp", "a")
        .join(few.withColumnRenamed("fp", "b"), ["t", "bucket"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
        .select("a", "b")
    )
    many = shared.where(F.col("n") > small_bucket)
    values = many.select("fp", "t", F.explode(_near_values(F.col("fp"), F.col("mask"), max_bits // 2)).alias("value"))
    centres = scratch.keep(values.groupBy("t", "value").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("t", "value", "a"), "centres")
    stars = values.join(centres, ["t", "value"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    links = scratch.keep(pairs.unionByName(stars).distinct(), "links")
    scratch.drop("buckets", "shared", "centres")
    return links


def simhash_components(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, blocks: int = BLOCKS, small_bucket: int = SMALL_BUCKET, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fingerprint and group of every document: ``(doc_id long, fp long, component_id long)``; with columns to keep, these and
    ``root long``, one value for each group.

    Null and empty texts and texts of white space have fingerprint 0 and link like any other. A row whose doc_id
    is null has a fingerprint, but no component (null), and links nothing. Repeated rows each give a row. An empty
    table gives an empty result. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    rows = scratch.keep(with_fingerprints(docs, words, keep), "rows")
    firsts = scratch.keep(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id")), "firsts")
    comps = connected_components(spark, close_fingerprints(spark, firsts.select("fp"), max_bits, blocks, small_bucket))
    named = firsts.join(comps.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = scratch.keep(named, "named")
    least = scratch.keep(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    by_fp = scratch.keep(named.join(least, "root").select("fp", "root", "component_id"), "by_fp")
    joined = rows.join(by_fp, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), *(("root", *keep) if keep else ()))


def drop_near_copies(docs: DataFrame, **options: int) -> DataFrame:
    """One row of each group of close fingerprints: that of smallest doc_id (of several with it, that of the least text hash).

    Rows of one doc_id are compared like any others, so of a repeated row one stays, and of two different texts under one
    doc_id both. Rows whose doc_id is null are kept: nothing can be said of them. The columns of docs come back unchanged.
    """
    keyed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    found = simhash_components(keyed, keep=("text_key",), **options)
    firsts = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.doc_id", "first.text_key")
    return first_rows(docs, firsts)


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")

