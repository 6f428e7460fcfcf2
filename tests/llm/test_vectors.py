import heapq
import math

import numpy as np
from pyspark.sql import functions as F

from annulus.llm.ann import nearest_neighbours
from annulus.llm.embedding_dedup import embedding_components
from annulus.llm.vectors import block_count, product, quantised
from tests.llm.test_dedup_texts import rooted

SCHEMA = "vec_id long, embedding array<float>, label int, v string, k1 int"


def rows(seed=1, n=300, d=16):
    r = np.random.default_rng(seed)
    centre = r.normal(size=d)
    x = r.normal(size=(n, d)).astype(np.float32)
    x[::3] = (centre + 0.18 * r.normal(size=(len(x[::3]), d))).astype(np.float32)
    x[10:20] = x[9]
    out = [(i * 4, v.tolist(), 1, "x", 1) for i, v in enumerate(x)]
    return out + [(9001, None, 1, None, 1), (9002, [0.0] * d, 1, "", None), (9003, [float("nan")] * d, 1, "", 1), (9004, [None] + [1.0] * (d - 1), 1, "", 1),
                  (None, x[9].tolist(), 1, "", 1), (9006, [1.0, 2.0], 1, "", 1), (9008, (2 * x[9]).tolist(), 1, "", 1), (9100, [float("inf")] * d, 1, "", 1), (9200, [], 1, "", 1), out[40]]


def usable(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)


def test_bounds():
    r = np.random.default_rng(2)
    x = r.normal(size=(50, 64)) * r.uniform(0.01, 100, size=(50, 1))
    q, s, e = quantised(x)
    n = np.sqrt((x**2).sum(1))
    off = np.abs(product(q, q) * s[:, None] * s - x @ x.T)
    assert (off <= n[:, None] * e + e[:, None] * (n + e) + 1e-9).all()


def test_embedding_components(spark):
    data = rows()
    good = {i: np.array(v, float) for i, v, *_ in data if i is not None and usable(v)}
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b)) if len(a) == len(b) else -1.0
    links = [(a, b) for a in good for b in good if a < b and cos(good[a], good[b]) >= 0.95]
    want = rooted(links, good)
    for block in (40, 8192, None):
        got = embedding_components(spark.createDataFrame(data, SCHEMA), block=block).collect()
        assert len(got) == len(data)
        for x in got:
            assert x.n_links == sum(x.vec_id in e for e in links)
            assert x.component_id == (want.get(x.vec_id, x.vec_id)) and x.kept == (x.vec_id is not None and x.vec_id == x.component_id)
    assert len(links) > 500 and embedding_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nearest(spark):
    data = rows(3)
    good = {i: np.array(v, float) for i, v, *_ in data if i is not None and usable(v)}
    for block, queries, k in ((50, 7, 10), (8192, 1024, 3), (None, None, 1000)):
        got = nearest_neighbours(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 100 == 0, k, block, queries).collect()
        want = {}
        for q in good:
            if q % 100 == 0:
                near = [(float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q])]
                for rank, (d, i) in enumerate(heapq.nsmallest(k, near), 1):
                    want[q, rank] = (i, d)
        assert {(x.query_id, x.rank): x.vec_id for x in got} == {key: i for key, (i, _) in want.items()}
        assert all(abs(x.score - want[x.query_id, x.rank][1]) < 1e-12 for x in got)
    assert nearest_neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_vectors_of_doubles_keep_their_precision(spark):
    near = [[1.0, 0.0], [1.0, 1e-12], [1.0, 3e-12], [0.0, 1.0]]
    got = nearest_neighbours(spark.createDataFrame(list(enumerate(near)), "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [(x.rank, x.vec_id) for x in got] == [(1, 1), (2, 2), (3, 3)] and got[1].score == 3e-12


def test_blocks_are_bounded_by_components():
    assert block_count(0, 1, 8) == 1 and block_count(500, 64, 8) == 1 and block_count(10_000, 64, 8) == 8
    assert block_count(5_000_000, 64, 8) == 153 and block_count(5_000_000, 1024, 8) == 2442
