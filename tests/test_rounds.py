"""Selection by rounds against the same rules read one record after another."""

import itertools
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from annulus.operators import rounds

PAIRS = "image_id long, pred_id long, place long, ann_id long, iou double, regular boolean, reusable boolean"


def some_pairs(seed, images=12, share=0.4, size=5):
    r, rows = random.Random(seed), []
    for image in range(images):
        crowd = {a for a in range(size) if r.random() < 0.2}
        for p, a in itertools.product(range(size), range(size)):
            if r.random() < share:
                rows.append((image, image * 100 + p, p, image * 100 + a, r.randint(1, 6) / 6, a not in crowd, a in crowd))
    return rows


def test_suppressed_equals_reading_in_order(spark):
    r = random.Random(3)
    edges = sorted({tuple(sorted((r.randrange(60), r.randrange(60)))) for _ in range(160)})
    edges = [(a, b) for a, b in edges if a != b] + [(100 + i, 101 + i) for i in range(7)]
    gone = set()
    for hi, lo in sorted(edges):
        if hi not in gone:
            gone.add(lo)
    got = [x.lo for x in rounds.suppressed(spark.createDataFrame(edges + edges[:5], "hi long, lo long")).collect()]
    assert sorted(got) == sorted(gone)
    assert rounds.suppressed(spark.createDataFrame([], "hi long, lo long")).count() == 0


def test_in_order_equals_reading_in_order(spark):
    rows, taken, want = some_pairs(5), set(), {}
    for image, place in sorted({(x[0], x[2]) for x in rows}):
        free = [x for x in rows if x[0] == image and x[2] == place and (x[6] or x[3] not in taken)]
        if free:
            best = max(free, key=lambda x: (x[5], x[4], x[3]))
            want[best[1]] = best[3]
            taken |= set() if best[6] else {best[3]}
    got = rounds.in_order(spark.createDataFrame(rows, PAIRS), ["image_id"]).collect()
    assert {x.pred_id: x.ann_id for x in got} == want and len(got) == len(want)
    assert rounds.in_order(spark.createDataFrame([], PAIRS), ["image_id"]).count() == 0


def test_best_pairs_first_equals_sorting(spark):
    rows, gts, preds, want = some_pairs(8), set(), set(), set()
    for x in sorted(rows, key=lambda x: (-x[4], x[3], x[2])):
        if x[3] not in gts and x[1] not in preds:
            gts.add(x[3])
            preds.add(x[1])
            want.add((x[1], x[3]))
    got = rounds.best_pairs_first(spark.createDataFrame(rows, PAIRS), ["image_id"]).collect()
    assert {(x.pred_id, x.ann_id) for x in got} == want and len(got) == len(want)


@pytest.mark.parametrize("shape", [(1, 1), (2, 4), (4, 2), (5, 5), (1, 6)])
def test_assign_has_the_greatest_total(shape):
    for seed in range(20):
        gain = np.random.default_rng(seed).integers(0, 5, shape) / 4
        got = rounds.assign(gain)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) == min(shape)
        wide = gain if shape[0] <= shape[1] else gain.T
        best = max(sum(wide[i, j] for i, j in enumerate(c)) for c in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert abs(sum(gain[i, j] for i, j in got) - best) < 1e-9


def test_optimal_match_has_the_greatest_total_of_each_image(spark):
    rows = some_pairs(11, images=8, share=0.3)
    got = rounds.optimal_match(spark.createDataFrame(rows, PAIRS)).collect()
    assert len({x.ann_id for x in got}) == len({x.pred_id for x in got}) == len(got)
    gain = np.zeros((8, 5, 5))
    for image, p, place, a, iou, *_ in rows:
        gain[image, a % 100, place] = iou
    best = sum(max(sum(g[i, j] for i, j in enumerate(c)) for c in itertools.permutations(range(5))) for g in gain)
    assert abs(sum(x.iou for x in got) - best) < 1e-9
    chain = [(0, i + d, 0, i, 0.5, True, False) for i in range(40) for d in (0, 1)]
    assert rounds.optimal_match(spark.createDataFrame(chain, PAIRS)).count() == 40


def test_in_order_at_once_equals_rounds_for_each_bit(spark):
    r = random.Random(21)
    rows = [(i, 10 * i + p, p, a, r.choice([0.5, 0.6, 0.7]), r.getrandbits(3), r.getrandbits(3), a == 3) for i in range(30) for p in range(6) for a in range(4) if r.random() < 0.7]
    pairs = spark.createDataFrame(rows, "image_id long, pred_id long, place long, ann_id long, iou double, reach long, regular long, reusable boolean")
    got = {(x.image_id, x.pred_id): (x.first, x.second) for x in rounds.in_order_at_once(pairs, 7).collect()}
    for bit in range(3):
        own = pairs.where(F.getbit("reach", F.lit(bit)) == 1).withColumn("regular", F.getbit("regular", F.lit(bit)) == 1)
        want = {(x.image_id, x.pred_id): x.regular for x in rounds.in_order(own, ["image_id"]).collect()}
        assert want == {k: bool(v[0] >> bit & 1) for k, v in got.items() if (v[0] | v[1]) >> bit & 1}
    assert rounds.in_order_at_once(pairs.limit(0), 7).count() == 0


def test_groups_keep_their_last_labels_alone(spark):
    from pathlib import Path

    from annulus.operators.shared import shared_folder

    tables = lambda: {p.parent for p in Path(shared_folder(spark)).rglob("part-*")}
    before = tables()
    chain = [(i, i) for i in range(60)] + [(i + 1, i) for i in range(59)] + [(100, 100)]
    found = rounds.groups_of(spark.createDataFrame(chain, "ann_id long, pred_id long")).collect()
    assert {(x.ann_id, x.group) for x in found} == {(i, 0) for i in range(60)} | {(100, 100)} and len(found) == len(chain)
    assert len(tables() - before) == 1


def test_assignment_in_the_image_is_that_by_rounds(spark, monkeypatch):
    draw = random.Random(11)
    ids = {(image, a, p): draw.choice([0.25, 0.5, 0.75, draw.random()]) + 0.01 for image in range(40) for a in range(9) for p in range(9) if draw.random() < 0.15}
    pairs = spark.createDataFrame([(image, image * 100 + a, image * 100 + p, iou) for (image, a, p), iou in ids.items()], "image_id long, ann_id long, pred_id long, iou double")
    want = sorted(map(tuple, rounds.optimal_match(pairs.drop("image_id")).collect()))
    assert "waits" in rounds.optimal_match(pairs)._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, rounds.optimal_match(pairs).collect())) == want
    monkeypatch.setattr(rounds, "HELD", 10)  # images of more pairs go through rounds
    assert sorted(map(tuple, rounds.optimal_match(pairs).collect())) == want
