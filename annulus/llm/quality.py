"""Quality by Bradley-Terry ranking: documents are scored so that preferred ones beat others in pairs.

A preference pair is a labelled good and a labelled bad document. The weights of a document's features are fitted by
logistic loss on the differences of the pairs' features, with a ridge term. The weights are fitted on a sample: features
of at most ``rows`` labelled rows for each label come to the driver, by the order of a hash of the id. The threshold is
the exact quantile of the scores of all labelled training documents at the share of bad ones among all of them, at
every size; a score is the logistic of the distance to it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.llm.common import Scratch, first_by_hash

ROWS, PAIRS, RIDGE, SEED, BUCKETS = 3000, 30_000, 1e-3, 9, 4096
SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()-]")
CAPITALS = bytes(range(65, 91))
FEATURES = 20


def capitals(text: str, data: bytes) -> int:
    """How many characters of a whole text, whose UTF-8 is data, are upper case."""
    others = () if text.isascii() else [c for c in set(text) if c > "\x7f" and c.isupper()]
    return len(data) - len(data.translate(None, CAPITALS)) + sum(map(text.count, others))


def features(text: str | None) -> list[float]:
    """Numbers that say how a whole text is written; all zero for no words."""
    words = (text or "").split()
    if not words:
        return [0.0] * FEATURES
    n, chars = len(words), len(text)
    distinct = len(set(words))
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(map(str.__eq__, words, words[1:]))
    marks = len(SYMBOLS.findall(text))
    bars, stops, commas = text.count("|"), text.count("."), text.count(",")
    digits = sum(text.count(d) for d in "0123456789")
    data = text.encode("utf-8", "replace")
    upper = capitals(text, data)
    packed = len(zlib.compress(data, 1)) / len(data)
    per = 1.0 / n
    return [
        min(1.0, 10 * bars * per), bars * per, min(1.0, 10 * marks * per), marks * per, stops * per, commas * per,
        (chars - n) * per / 10, distinct * per, min(1.0, 20 * same * per), same * per,
        len(set(lines)) / len(lines) if lines else 1.0, len(lines) * per, packed, min(2.0, packed * np.log1p(n)),
        upper / chars, digits / chars, np.log1p(n) / 10, 1.0 if n < 5 else 0.0, float(words[-1][-1] in ".!?"), text.count("\n") * per,
    ]


def with_features(docs: DataFrame, *keep: str) -> DataFrame:
    """The named columns of docs and ``features array<double>``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], [*keep, "features"])

    return docs.select(*keep, "text").mapInArrow(run, f"{schema}, features array<double>")


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE) -> dict[str, np.ndarray | float]:
    """Weights, means and scales from the features of good and bad documents."""
    both = np.concatenate([good, bad])
    mean, scale = both.mean(0), both.std(0)
    scale[scale < 1e-9] = 1.0
    random = np.random.default_rng(SEED)
    g, b = ((x - mean) / scale for x in (good, bad))
    diff = g[random.integers(len(g), size=pairs)] - b[random.integers(len(b), size=pairs)]
    w = np.zeros(both.shape[1])
    for _ in range(30):  # Newton steps on the mean logistic loss of the differences
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))  # chance that the preferred one loses
        gradient = -(diff * p[:, None]).mean(0) + ridge * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + (ridge + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return {"w": w, "mean": mean, "scale": scale}


def raw_scores(x: np.ndarray, model: dict) -> np.ndarray:
    """A row of features a document -> what its score is before the threshold; row by row, so that batches don't matter."""
    return ((x - model["mean"]) / model["scale"] * model["w"]).sum(axis=1)


def ranked_value(values: DataFrame, rank: int) -> float:
    """The value of that rank (from 0) of ``values(raw double)``: the bucket that holds it is cut up until one value is left."""
    lo, hi = values.agg(F.min("raw"), F.max("raw")).first()
    while lo < hi:
        at = F.least(F.floor((F.col("raw") - lo) / ((hi - lo) / BUCKETS)), F.lit(BUCKETS - 1))
        own = values.where(F.col("raw").between(lo, hi)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("raw").alias("lo"), F.max("raw").alias("hi"))
        for x in sorted(own.collect()):  # BUCKETS rows at most
            if rank < x.n:
                lo, hi = x.lo, x.hi
                break
            rank -= x.n
    return lo


def threshold(found: DataFrame, model: dict, bad: int, total: int) -> float:
    """The quantile of the scores of ``found(features)`` at bad / total, between two ranks as numpy's."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("features").to_pylist()).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(raw_scores(x, shared.value))], ["raw"])

    values = Scratch(found.sparkSession, "quality").keep(found.select("features").mapInArrow(run, "raw double"), "raw")
    place = (total - 1) * bad / total
    low = int(place)
    a, b = ranked_value(values, low), ranked_value(values, min(low + 1, total - 1))
    return a + (b - a) * (place - low)


def fit(docs: DataFrame, labels: DataFrame, training: Column, rows: int = ROWS, made: DataFrame | None = None) -> dict | None:
    """Model from the training rows of docs with a label; None where one of the labels has no row.

    A doc_id with several labels counts as its least, one with several texts as the least of their features. Texts are
    not shuffled: features are made where the texts are, then joined with the labels. made: ``(doc_id, features)`` of docs, if at hand.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & training).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    made = (with_features(docs, "doc_id") if made is None else made).join(known, "doc_id")
    scratch = Scratch(docs.sparkSession, "quality")
    found = scratch.keep(made.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("features").alias("features")), "features")
    counts = {x.quality: x.n for x in found.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    picked = first_by_hash(found.select("doc_id", "quality"), "quality", rows).select("doc_id")  # 2 * rows at most
    chosen = found.join(F.broadcast(picked), "doc_id").orderBy("doc_id").collect()
    model = fit_pairs(*[np.array([x.features for x in chosen if x.quality == q]) for q in (1, 0)])
    model["threshold"] = threshold(found, model, counts[0], sum(counts.values()))
    scratch.drop("features")
    return model


def scores(docs: DataFrame, model: dict | None) -> DataFrame:
    """``(doc_id, score, predicted)`` for each row of docs, from its text alone.

    Null and empty texts are scored as texts without words. Without a model every score is 0.5. Rows are scored one by one, so
    repeated rows and null ids change nothing; other columns are ignored, an empty table gives an empty result. Features are
    counted over the whole text, which one task holds.
    """
    return scores_of(with_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"), model)


def scores_of(made: DataFrame, model: dict | None) -> DataFrame:
    """The same from ``made(doc_id, features)``."""
    shared = made.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, FEATURES)
            far = raw_scores(x, m) - m["threshold"] if m else np.zeros(len(x))
            s = 1 / (1 + np.exp(-np.clip(far, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return made.select(F.col("doc_id").cast("long").alias("doc_id"), "features").mapInArrow(run, "doc_id long, score double, predicted int")


def fitted_scores(docs: DataFrame, labels: DataFrame, training: Column, rows: int = ROWS) -> DataFrame:
    """``scores`` of docs by the model that ``fit`` makes of them; features are made once and kept in the shared folder."""
    made = Scratch(docs.sparkSession, "features").keep(with_features(docs, "doc_id"), "all")
    return scores_of(made, fit(docs, labels, training, rows, made))
