"""Embedding near-dedup by int8 tile products.

Equal vectors are one class, so a class of many copies is compared once. Classes are dealt into blocks of about
two million components (or ``block`` rows), and every two blocks meet in one task. There, unit vectors are quantised to int8 with a scale each;
with x = s q + e, the product of two differs from s s' q q' by at most |e'| + |e| (1 + |e'|). Only pairs that could
reach the threshold under this bound are recomputed in double precision from the original components. A tile returns
each vector's number of links and one link to its group within the tile, not the pairs; groups of tiles are then
joined by connected components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.llm.common import Scratch
from annulus.llm.components import connected_components
from annulus.llm.vectors import block_count, matrix, prepared, product, quantised, scaled

THRESHOLD, ROWS, PAIRS = 0.95, 256, 1 << 16
SLACK = 1e-5  # more than float32 products of scales and double rounding can be off
LINKED = pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])


def links_between(x: np.ndarray, y: np.ndarray, threshold: float, same: bool):
    """Yields arrays (i, j) of the rows with cosine >= threshold; of one set with itself i < j only."""
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    (qx, sx, ex), (qy, sy, ey) = quantised(x / nx[:, None]), quantised(y / ny[:, None])
    sy32, most = sy.astype(np.float32), ey.max(initial=0.0)
    for at in range(0, len(x), ROWS):
        part = slice(at, at + ROWS)
        near = product(qx[part], qy) * sy32
        floor = (threshold - most - ex[part] * (1 + most) - SLACK) / sx[part]
        i, j = np.nonzero(near >= floor[:, None].astype(np.float32))
        i = i + at
        if same:
            i, j = i[j > i], j[j > i]
        for lo in range(0, len(i), PAIRS):
            a, b = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
            cosine = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b])
            found = cosine >= threshold
            if found.any():
                yield a[found], b[found]


def local_groups(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1, the least node of the group that links i, j put each into."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        label = np.minimum(label, label[label])
        label = label[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label


def _tile(threshold: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return LINKED.empty_table()
        same = left.column("bi")[0].as_py() == left.column("bj")[0].as_py()
        x, y = scaled(matrix(left)), scaled(matrix(right))
        ids = [t.column("vec_id").to_numpy() for t in (left, right)]
        weight = [t.column("size").to_numpy() for t in (left, right)]
        if same:
            order = np.argsort(ids[0])
            x, ids, weight = x[order], [ids[0][order]] * 2, [weight[0][order]] * 2
            y = x
        every = ids[0] if same else np.concatenate(ids)
        shift, counts = 0 if same else len(x), np.zeros(len(every), np.int64)
        label = np.arange(len(every))
        for a, b in links_between(x, y, threshold, same):
            np.add.at(counts, a, weight[1][b])
            np.add.at(counts, b + shift, weight[0][a])
            again = local_groups(label[a], label[b + shift], len(every))
            label = again[label]
        linked = np.flatnonzero(counts)
        return pa.table([every[linked], counts[linked], every[label[linked]]], schema=LINKED)

    return run


def embedding_components(vectors: DataFrame, threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> vec_id, n_links, component_id and kept, a row for each row.

    n_links counts the other vectors at cosine >= threshold, copies included. Vectors that are null, zero or hold null
    or non-finite components, and rows of a null vec_id, link with nothing: n_links 0, component_id their own vec_id.
    Vectors of different lengths don't link. A row that is repeated whole counts once. kept is vec_id = component_id
    (false for a null vec_id). Finite vectors of any magnitude are compared alike: each is divided by a power of two
    first. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = scratch.keep(prepared(vectors).dropDuplicates(["vec_id", "k1", "k2"]), "rows")
    classes = rows.groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("size"))
    firsts = rows.join(classes.select("k1", "k2", "vec_id", "size"), ["k1", "k2", "vec_id"])
    size, dim = classes.count(), rows.agg(F.max("dim")).first()[0] or 1
    number = max(1, -(-size // block)) if block else block_count(size, dim, math.isqrt(2 * spark.sparkContext.defaultParallelism) + 1)
    firsts = scratch.keep(firsts.select("vec_id", "size", "v", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(number)).cast("int").alias("b")), "firsts")
    sides = [
        firsts.withColumn("bi", F.col("b")).withColumn("bj", F.explode(F.sequence(F.col("b"), F.lit(number - 1)))),
        firsts.withColumn("bj", F.col("b")).withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("b")))),
    ]
    left, right = (s.select("dim", "bi", "bj", "vec_id", "size", "v").groupBy("dim", "bi", "bj") for s in sides)
    found = scratch.keep(left.cogroup(right).applyInArrow(_tile(threshold), "vec_id long, n long, to long"), "found")
    groups = connected_components(spark, found.select(F.col("vec_id").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    by_first = firsts.select("vec_id", "size").join(counts, "vec_id", "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    by_first = by_first.select(F.col("vec_id").alias("first"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    keyed = classes.select("k1", "k2", F.col("vec_id").alias("first"))
    by_class = scratch.keep(keyed.join(by_first, "first").select("k1", "k2", "n_links", "component_id"), "by_class")
    scratch.drop("found")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    ok = prepared(own).select("vec_id", "k1", "k2").join(by_class, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    bad = own.where(~usable_row()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return ok.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def usable_row():
    from annulus.llm.vectors import usable

    return F.col("vec_id").isNotNull() & usable(F.col("embedding"))
