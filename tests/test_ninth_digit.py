"""Sums whose last rounded digit depends on their order, shifts that are alike, and frames that one side lacks."""

import duckdb
from pyspark.sql import functions as F

from annulus import registry
from annulus.functions import rings as R

POINTS = "array<struct<x:double,y:double>>"


def lines(folder, rows):
    """A lineitem table of (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity)."""
    with duckdb.connect() as con:
        con.execute("CREATE TABLE t (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", rows)
        con.execute(f"COPY t TO '{folder}/lineitem.parquet' (FORMAT parquet)")


def by_sql(folder, name):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
        con.execute("SET threads=1")
        return sorted(con.execute(registry.SQL[name]).fetchall())


def test_shifts_alike_up_to_six_digits_go_to_the_smallest(spark):
    a = [(0.0, 0.0), (56.0, 0.0), (56.0, 35.0), (0.0, 35.0)]
    near = [(28 + 1e-8, 17.5), (28.0, 17.5), (28.0, 17.5), (28.0, 17.5)]
    rows = spark.createDataFrame([(1, a, a[2:] + a[:2]), (2, a, near), (3, a, near[::-1])], f"id int, a {POINTS}, b {POINTS}")
    got = {r["id"]: r["m"] for r in rows.select("id", R.best_roll(F.col("a"), F.col("b")).alias("m")).collect()}
    assert (got[1]["cost"], got[1]["shift"]) == (0.0, 2)
    assert got[2]["shift"] == got[3]["shift"] == 0


def test_costs_near_half_a_ninth_digit_are_those_of_the_sql(spark, tmp_path):
    lines(tmp_path, [(63780, 2089, 121, 3, 24.0), (74886, 14497, 517, 6, 24.0), (36322, 5872, 997, 1, 44.0), (40352, 8933, 997, 2, 24.0), (5603, 11895, 617, 4, 24.0)])
    got = registry.QUERIES["aligned_rings"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("ann_id", "pred_id", "cost", "shift").collect()) == by_sql(tmp_path, "aligned_rings")


def test_a_frame_that_one_side_lacks_adds_to_the_union_alone(spark, tmp_path):
    # the second image's box has no prediction (its id is divisible by 11)
    lines(tmp_path, [(0, 0, 3, 1, 20.0), (5, 0, 4, 1, 20.0)])
    boxes = {t: registry.QUERIES[f"{t}_boxes_table"](spark, str(tmp_path)).collect() for t in ("gt", "pred")}
    hulls = {t: {} for t in boxes}
    for t, rows in boxes.items():
        for r in rows:
            if t == "gt" or r["pred_id"] % 7:
                a, b, c, d = hulls[t].get(r["image_id"], (r["x0"], r["y0"], r["x1"], r["y1"]))
                hulls[t][r["image_id"]] = (min(a, r["x0"]), min(b, r["y0"]), max(c, r["x1"]), max(d, r["y1"]))
    assert set(hulls["gt"]) != set(hulls["pred"])
    both, union = {}, {}
    for image in set(hulls["gt"]) | set(hulls["pred"]):
        g, p = (hulls[t].get(image) for t in ("gt", "pred"))
        shared = max(min(g[2], p[2]) - max(g[0], p[0]), 0) * max(min(g[3], p[3]) - max(g[1], p[1]), 0) if g and p else 0
        sizes = sum((h[2] - h[0]) * (h[3] - h[1]) for h in (g, p) if h)
        both[image // 4], union[image // 4] = both.get(image // 4, 0) + shared, union.get(image // 4, 0) + sizes - shared
    got = {r["track"]: r["sequence_iou"] for r in registry.QUERIES["sequence_iou"](spark, str(tmp_path)).collect()}
    assert got == {t: both[t] / union[t] for t in union}
    assert all(0 <= v <= 1 for v in got.values())
    assert any(v > 1 for _, v in by_sql(tmp_path, "sequence_iou"))  # DuckDB's least and greatest pass over nulls
