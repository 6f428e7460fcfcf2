"""Nearest neighbours by block matrix join.

Candidates and queries are dealt into blocks of about two million components (or ``block`` and ``query_block`` rows);
every two meet in one task. int8 products with their error bounds give each distance a lower and an upper bound. A candidate survives where
its lower bound is at most the query's k-th least upper bound; survivors are recomputed in double precision, a heap
keeps each query's k nearest of the tile, and the tiles' short lists are merged by Spark's top-k in each group,
which drops rows beyond k before and after the shuffle. The result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from annulus.llm.vectors import block_count, exponents, matrix, prepared, product, quantised

K, ROWS, FAR = 10, 64, 400
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; infinite only where the distance itself exceeds the largest double."""
    with np.errstate(over="ignore"):
        off = rows - query
        power = np.where(np.isfinite(off).all(axis=1), exponents(off), 0)
        off = np.ldexp(off, -power[:, None])
        return np.ldexp(np.sqrt((off**2).sum(axis=1)), power)


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, float, int]]:
    """(query id, distance, row id) of each query's k nearest rows of another id, ties to the smaller id.

    Bounds are of squares divided by the query's power of two; a row larger than the query by ``FAR`` powers or more has a
    lower bound alone.
    """
    px, py = exponents(queries), exponents(rows)
    x, y = np.ldexp(queries, -px[:, None]), np.ldexp(rows, -py[:, None])
    (qx, sx, ex), (qy, sy, ey) = quantised(x), quantised(y)
    nx, ny = np.sqrt((x**2).sum(axis=1)), np.sqrt((y**2).sum(axis=1))
    out = []
    for at in range(0, len(queries), ROWS):
        part = slice(at, at + ROWS)
        times = np.ldexp(1.0, np.clip(py - px[part, None], -FAR, FAR))
        dot = product(qx[part], qy).astype(np.float64) * sx[part, None] * (sy * times)
        squares = nx[part, None] ** 2 + (ny * times) ** 2
        off = 2 * (nx[part, None] * ey + ex[part, None] * (ny + ey)) * times + 1e-9 * squares
        own = query_ids[part, None] == ids
        middle = squares - 2 * dot
        high = np.where(own | (py - px[part, None] >= FAR), np.inf, middle + off)
        limit = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] > k else np.full(len(high), np.inf)
        for r, most in enumerate(limit):
            alive = np.flatnonzero((middle[r] - off[r] <= most) & ~own[r])
            exact = distances(rows[alive], queries[at + r])
            out += [(int(query_ids[at + r]), d, i) for d, i in heapq.nsmallest(k, zip(exact.tolist(), ids[alive].tolist(), strict=True))]
    return out


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = K, block: int | None = None, query_block: int | None = None) -> DataFrame:
    """For each row of ``vectors(vec_id, embedding)`` where ``queries`` holds: query_id, rank (from 1), vec_id, score.

    score is the Euclidean distance in double precision; candidates are all rows of another vec_id, of which the k
    nearest (all, if fewer) are returned, ties to the smaller vec_id. Rows whose vec_id or vector is null, and vectors
    that are zero or hold null or non-finite components, take no part; vectors of different lengths don't meet. A row
    repeated whole counts once. Finite vectors of any magnitude are searched alike; a distance beyond the largest double
    is infinite. An empty table gives an empty result.
    """
    rows = prepared(vectors).dropDuplicates(["vec_id", "k1", "k2"]).select("vec_id", "v", "dim")
    asked = prepared(vectors.where(queries)).dropDuplicates(["vec_id", "k1", "k2"]).select("vec_id", "v", "dim")
    (n, dim), asked_n = rows.agg(F.count("*"), F.max("dim")).first(), asked.count()
    blocks = max(1, -(-n // block)) if block else block_count(n, dim or 1, vectors.sparkSession.sparkContext.defaultParallelism)
    query_blocks = max(1, -(-asked_n // query_block)) if query_block else block_count(asked_n, dim or 1, 1)
    right = rows.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    left = asked.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return FOUND.empty_table()
        found = nearest(matrix(a), a.column("vec_id").to_numpy(), matrix(b), b.column("vec_id").to_numpy(), k)
        q, d, i = zip(*found, strict=True) if found else [()] * 3
        return pa.table([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], schema=FOUND)

    keys = ["dim", "b", "q"]
    found = left.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "v").groupBy(*keys)).applyInArrow(tile, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
