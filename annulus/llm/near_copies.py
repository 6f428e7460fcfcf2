"""Near copies by SimHash fingerprints, then by the similarity of word shingles: MinHash buckets and exact Jaccard of each pair.

Texts of one shingle set are one node. Nodes whose fingerprints differ in two bits or fewer (``simhash.close_fingerprints``) are
measured first and linked where their sets are as similar as asked; what such links join is not paired again. Less similar texts
differ in more bits, so buckets find the rest: a node's ``BANDS`` buckets are hashes of ``DEPTH`` minima each; a pair of the
least similarity 0.8 shares none of them in 5 of 100,000 cases, a more similar one more seldom. Pairs of a bucket are
linked where their sets are as similar as asked. A bucket of more than ``small_bucket`` nodes is not paired up at once:
all are measured against one centre, and those similar to it leave, already linked. Jaccard distance is a metric, so a
leaving node can only be similar to one that stays at up to twice the limit from the centre, and only where their
distances from it differ by no more than the limit; these pairs are measured too, or, where they would be many, those that
share one of the rarest shingles of both at places that leave room for the overlap asked (prefix and positional filter,
exact). What is left goes on with another
centre, and after ``ROUNDS`` of them is paired up, so that no pair of a bucket is left out. Only groups are asked for:
once the centres' links are known, no pair of texts that these already join, however indirectly, is made or measured.
Nor are all others measured at once: ``TURNS`` times, each text's ``LIKELIEST`` pairs by what their heads share come
first, and pairs of texts that are joined by then go unmeasured; what is left after that is measured whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from annulus.llm.common import Scratch, first_rows, text_key
from annulus.llm.components import connected_components
from annulus.llm.simhash import close_fingerprints, fingerprint

WORDS, SIMILARITY, BANDS, DEPTH, SMALL_BUCKET, ROUNDS, STEP, BATCH, SEED, PART, CELLS, HEAD = 5, 0.8, 25, 5, 64, 4, 1024, 64, 11, 1 << 20, 1 << 20, 32
LIKELIEST, TURNS = 3, 4
MULTIPLIERS, OFFSETS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * DEPTH), np.uint64) | np.uint64(1)


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each one, memory that held it and what was made of it goes back to the system."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of so many words; a text of fewer words is one run."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64))


def buckets(own: np.ndarray) -> list[int]:
    """A signed 64-bit bucket for each band; none for no shingles."""
    if not len(own):
        return []
    least = np.full(BANDS * DEPTH, (1 << 64) - 1, np.uint64)
    for at in range(0, len(own), STEP):  # bounded memory for very long texts
        least = np.minimum(least, (own[at : at + STEP, None] * MULTIPLIERS + OFFSETS).min(axis=0))
    data = least.tobytes()
    size = 8 * DEPTH
    return [xxhash.xxh64_intdigest(data[i * size : (i + 1) * size], i) - (1 << 63) for i in range(BANDS)]


def _rows(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given_back(batches):
            keys, sizes, dealt, fps = [], [], [], []
            for text in batch.column("text"):
                own = shingles(text.as_py(), words)
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                dealt.append(buckets(own))
                fps.append(fingerprint(text.as_py()))
            cols = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(dealt, pa.list_(pa.int64())), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *cols], ["doc_id", "text_key", "key", "n", "buckets", "fp"])

    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return named.mapInArrow(run, "doc_id long, text_key long, key binary, n long, buckets array<long>, fp long")


def _sets(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """``asked(uid, doc_id, text_key)`` -> ``(uid, own binary)``, the shingles of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given_back(batches):
            own = [shingles(text.as_py(), words) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array([x.tobytes() for x in own], pa.binary())], ["uid", "own"])

    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return named.join(asked, ["doc_id", "text_key"]).select("uid", "text").mapInArrow(run, "uid long, own binary").dropDuplicates(["uid"])


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b, m)``, m being the number of b's shingles -> ``(a, b, far double)``, once each, the Jaccard distance of their sets.

    The sets of all b travel to their a, that of a once for each ``PART`` shingles of them, so that a centre of many texts neither
    travels with each of them nor waits for all in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given_back(batches):
            far = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                far.append((len(x) + len(y) - 2 * both) / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(far, pa.float64())], ["a", "b", "far"])

    pairs = pairs.dropDuplicates(["a", "b"])
    sizes = pairs.groupBy("a").agg(F.greatest(F.ceil(F.sum("m") / PART), F.lit(1)).cast("int").alias("parts"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    others = dealt.join(sets.select(F.col("uid").alias("b"), F.col("own").alias("y")), "b")
    own = sets.select(F.col("uid").alias("a"), F.col("own").alias("x")).join(sizes, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "x")
    return others.join(own, ["a", "part"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long, far double")


def _may_link(similarity: float) -> Column:
    """Of ``(a, n, root)`` and ``(b, m, other)``: each pair once, none joined already, sizes that allow the similarity."""
    sizes = F.least("n", "m") >= F.greatest("n", "m") * similarity - 1e-6
    return (F.col("a") < F.col("b")) & (F.col("root") != F.col("other")) & sizes


def _all_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, m, root, other)``: pairs of each bucket of ``rows(bucket, uid, n, root)`` that may be similar and whose roots differ,
    each in the first bucket that both are in."""
    rows = rows.join(rows.groupBy("uid").agg(F.collect_list("bucket").alias("own")), "uid")
    other = rows.select("bucket", F.col("uid").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("own").alias("theirs"))
    once = F.array_min(F.array_intersect("own", "theirs")) == F.col("bucket")
    return rows.withColumnRenamed("uid", "a").join(other, "bucket").where(_may_link(similarity) & once).select("a", "b", "m", "root", "other")


def _times(sets: DataFrame) -> np.ndarray:
    """How often shingles of ``sets(own)`` fall into each of ``CELLS`` cells, as a power of two; what is sent has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(CELLS, np.int64)
        for batch in given_back(batches):
            for own in batch.column("own"):
                np.add.at(times, _cells(np.frombuffer(own.as_buffer(), np.uint64)), 1)
        found = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times[found])], ["cell", "times"])

    often = sets.select("own").mapInArrow(run, "cell long, times long").groupBy("cell").agg(F.sum("times").alias("times")).where("times > 1").toPandas()
    out = np.zeros(CELLS, np.uint8)
    out[often["cell"].to_numpy(int)] = np.log2(often["times"].to_numpy(float)).astype(np.uint8)
    return out


def _cells(own: np.ndarray) -> np.ndarray:
    return (own % np.uint64(CELLS)).astype(np.int64)


def _rare_pairs(scratch: Scratch, rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The same of distinct ``rows(uid, n, root)``, whatever their buckets, and ``like``, the share of the shorter head that both have:
    pairs that share one of the rarest shingles of both, where what comes behind it in both suffices for the overlap.

    Any order of shingles that is one for all texts leaves out no pair: the first shingle that a similar pair shares has so many
    behind it on both sides. Theirs is how often shingles of their cell occur in these texts, then the shingle itself. The ``HEAD``
    rarest of each text come along: what two texts share is no more than what their heads share and all behind one head. A pair
    whose heads share any is made at the first of these alone, where most is behind it.
    """
    opened = scratch.keep(rows.join(sets, "uid").select("uid", "n", "root", "own"), "each", BATCH)
    times, named = _times(opened), ["uid", "n", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *own, shingle in zip(*(batch.column(c) for c in (*named, "own")), strict=True):
                found = np.frombuffer(shingle.as_buffer(), np.uint64)
                count = len(found) - int(np.ceil(len(found) * similarity - 1e-6)) + 1
                rarest = found[np.lexsort((found, times[_cells(found)]))[:count]].view(np.int64)
                place, head = np.arange(1, len(rarest) + 1), rarest[:HEAD]
                heads = pa.ListArray.from_arrays(np.arange(len(rarest) + 1, dtype=np.int32) * len(head), np.tile(head, len(rarest)))
                yield pa.RecordBatch.from_arrays([*(pa.repeat(x, len(rarest)) for x in own), pa.array(rarest), pa.array(place), heads], [*named, "shingle", "place", "head"])

    first = scratch.keep(opened.mapInArrow(run, "uid long, n long, root long, shingle long, place long, head array<long>"), "first", BATCH)
    other = first.select("shingle", F.col("uid").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("place").alias("at"), F.col("head").alias("top"))
    least = (F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - 1e-6
    room = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")) + 1 >= least
    both = F.array_intersect("head", "top")
    heads = F.size(both) + F.greatest(F.col("n") - F.size("head"), F.col("m") - F.size("top")) >= least
    once = F.coalesce(F.get(both, F.lit(0)) == F.col("shingle"), F.lit(True))
    met = first.withColumnRenamed("uid", "a").join(other, "shingle").where(_may_link(similarity) & room & heads & once)
    return met.select("a", "b", "m", "root", "other", (F.size(both) / F.least(F.size("head"), F.size("top"))).alias("like")).distinct()


def _fingerprint_pairs(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """``nodes(uid, n, fp)`` -> ``(a, b, m)``: nodes of one fingerprint with the least of them, and these least ones whose
    fingerprints ``close_fingerprints`` links."""
    least = nodes.groupBy("fp").agg(F.min(F.struct("uid", "n")).alias("x")).select("fp", F.col("x.uid").alias("a"), F.col("x.n").alias("k"))
    least = scratch.keep(least, "least")
    same = nodes.join(least, "fp").where("uid <> a").select("a", F.col("uid").alias("b"), F.col("n").alias("m"))
    close = close_fingerprints(scratch.spark, least.select("fp")).withColumnsRenamed({"a": "x", "b": "y"})
    ends = close.join(least.select(F.col("fp").alias("x"), "a"), "x").join(least.select(F.col("fp").alias("y"), F.col("a").alias("b"), F.col("k").alias("m")), "y")
    return scratch.keep(same.unionByName(ends.select("a", "b", "m")), "close")


def _with_root(rows: DataFrame, joined: DataFrame, node: str, root: str) -> DataFrame:
    """rows and the component of their node in ``joined(node, component)``, as root: the node itself where it has none."""
    of = joined.select(F.col("node").alias(node), F.col("component").alias(root))
    return rows.join(of, node, "left").withColumn(root, F.coalesce(root, node))


def _in_turns(scratch: Scratch, pairs: DataFrame, joined: DataFrame, sets: DataFrame, near: Column) -> DataFrame:
    """``pairs(a, b, m, root, other, like)``, roots by ``joined(node, component)`` -> links ``(a, b)`` that join what all similar ones of
    them join: pairs whose ends are joined when their turn comes are not measured, all others are."""
    found, names = [], ["a", "b", "m", "like"]
    for i in range(TURNS):
        place = lambda end: F.row_number().over(W.partitionBy(end).orderBy(F.desc("like"), "a", "b"))
        likely = pairs.where("like > 0").withColumn("now", (place("a") <= LIKELIEST) | (place("b") <= LIKELIEST))
        likely = scratch.keep(likely, f"likely{i}")
        chosen = likely.where("now")
        if chosen.isEmpty():
            break
        found.append(scratch.keep(_measured(chosen.select("a", "b", "m"), sets).where(near).select("a", "b"), f"found{i}", BATCH))
        ends = _with_root(_with_root(found[-1], joined, "a", "x"), joined, "b", "y")
        moved = connected_components(scratch.spark, ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
        rest = likely.where("not now").drop("now").unionByName(pairs.where("like = 0"))
        rest = _with_root(_with_root(rest.withColumnsRenamed({"root": "u", "other": "v"}), moved, "u", "root"), moved, "v", "other")
        pairs = scratch.keep(rest.where("root <> other").select(*names, "root", "other"), f"rest{i}")
        if i + 1 < TURNS:
            joined = scratch.keep(_with_root(joined.withColumnRenamed("component", "u"), moved, "u", "component").select("node", "component").unionByName(moved).distinct(), f"joined{i}")
    return reduce(DataFrame.unionByName, found, _measured(pairs.select("a", "b", "m"), sets).where(near).select("a", "b"))


def similar_pairs(scratch: Scratch, shared: DataFrame, close: DataFrame, sets: DataFrame, similarity: float, small_bucket: int) -> DataFrame:
    """``shared(bucket, uid, n, size)`` and ``close(a, b, m)`` -> links ``(a, b)`` whose components are those of all pairs of a bucket
    or of close that are similar."""
    limit, slack = 1 - similarity, 1e-9
    near, around = F.col("far") <= limit + slack, F.col("far") <= 2 * limit + slack
    measured, active = [], shared.where(F.col("size") > small_bucket).select("bucket", "uid", "n")
    for i in range(ROUNDS):
        if active.isEmpty():
            break
        centres = active.groupBy("bucket").agg(F.min("uid").alias("a"))
        to = active.withColumnsRenamed({"uid": "b", "n": "m"}).join(centres, "bucket").where("a <> b")
        far = scratch.keep(_measured(to.select("a", "b", "m"), sets), f"far{i}", BATCH)
        measured.append(scratch.keep(to.join(far, ["a", "b"]).select("bucket", "a", "b", F.col("m").alias("n"), "far"), f"at{i}"))
        active = measured[-1].where(~near).select("bucket", F.col("b").alias("uid"), "n")
    known = _measured(close, sets).where(near).select("a", "b")
    stars = scratch.keep(reduce(DataFrame.unionByName, [at.where(near).select("a", "b") for at in measured], known).distinct(), "stars", BATCH)
    joined = connected_components(scratch.spark, stars)
    with_root = lambda rows, node, root: _with_root(rows, joined, node, root)
    pairs = _all_pairs(with_root(shared.where(F.col("size") <= small_bucket), "uid", "root"), similarity)
    if not measured:
        return scratch.keep(stars.unionByName(_measured(pairs.select("a", "b", "m"), sets).where(near).select("a", "b")), "links", BATCH)
    every = reduce(DataFrame.unionByName, [at.withColumn("round", F.lit(i)) for i, at in enumerate(measured)])
    keys = ["round", "bucket"]
    ring = with_root(with_root(every.where(~near & around), "a", "centre"), "b", "root").where("root <> centre")
    ring = scratch.keep(ring.select(*keys, "b", "n", "root", "far"), "ring")
    inner = with_root(every.where(near), "a", "centre").select(*keys, F.col("b").alias("c"), F.col("n").alias("m"), "centre", F.col("far").alias("own"))
    count = lambda rows, name: rows.groupBy(*keys).agg(F.count("*").alias(name))
    wide = F.col("r") * F.col("i") > small_bucket * (F.col("r") + F.col("i"))
    sizes = scratch.keep(count(ring, "r").join(count(inner, "i"), keys).select(*keys, wide.alias("wide")), "wide")
    few, many = (sizes.where(x).select(*keys) for x in ("not wide", "wide"))
    met = ring.join(few, keys).join(inner, keys).where(F.col("own") >= F.col("far") - limit - slack)
    met = met.select(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b"), F.when(F.col("b") > F.col("c"), F.col("n")).otherwise(F.col("m")).alias("m"), "root", F.col("centre").alias("other"))
    # what is open in large buckets, each text once however many buckets it shares with others
    left = with_root(active, "uid", "root")
    mixed = left.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket")
    open_ = left.join(mixed, "bucket", "left_semi").select("uid", "n", "root")
    open_ = open_.unionByName(ring.join(many, keys, "left_semi").select(F.col("b").alias("uid"), "n", "root"))
    open_ = open_.unionByName(inner.join(many, keys, "left_semi").select(F.col("c").alias("uid"), F.col("m").alias("n"), F.col("centre").alias("root")))
    rare = scratch.keep(_rare_pairs(scratch, open_.distinct(), sets, similarity), "rare")
    pairs = rare.unionByName(pairs.unionByName(met).withColumn("like", F.lit(0.0)))
    return scratch.keep(stars.unionByName(_in_turns(scratch, pairs, joined, sets, near)).distinct(), "links", BATCH)


def drop_near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """One row of each group of near copies: that of smallest doc_id (of several with it, that of the least text hash).

    Texts without words, null ones included, are copies of each other. Rows of one doc_id are compared like any others, so
    of a repeated row one stays, and of two different texts under one doc_id both. Rows whose doc_id is null are kept. An
    empty table gives an empty result. The columns of docs come back unchanged, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near_copies")
    rows = scratch.keep(_rows(docs, words), "rows", BATCH)
    nodes = rows.groupBy("key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.min("fp").alias("fp"))
    nodes = scratch.keep(nodes.withColumn("uid", F.monotonically_increasing_id()), "nodes")
    dealt = nodes.select("uid", "n", F.explode("buckets").alias("bucket"))
    sizes = scratch.keep(dealt.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = scratch.keep(dealt.join(sizes, "bucket").select("bucket", "uid", "n", "size"), "shared")
    close = _fingerprint_pairs(scratch, nodes.select("uid", "n", "fp"))
    ends = shared.select("uid").unionByName(close.select(F.col("a").alias("uid"))).unionByName(close.select(F.col("b").alias("uid")))
    asked = nodes.join(ends.distinct(), "uid").select("uid", "first.doc_id", "first.text_key")
    sets = scratch.keep(_sets(docs, asked, words), "sets", BATCH)
    scratch.drop("rows", "sizes", "least")
    links = similar_pairs(scratch, shared, close, sets, similarity, small_bucket)
    scratch.drop("shared", "close", "sets", "each", "first", "rare", "stars", "ring", "wide", *[f"{x}{i}" for x in ("far", "at") for i in range(ROUNDS)])
    scratch.drop(*[f"{x}{i}" for x in ("likely", "found", "rest", "joined") for i in range(TURNS)])
    comps = connected_components(spark, links).select(F.col("node").alias("uid"), F.col("component").alias("root"))
    named = nodes.join(comps, "uid", "left").groupBy(F.coalesce("root", "uid").alias("root")).agg(F.min("first").alias("first"))
    firsts = scratch.keep(named.select("first.doc_id", "first.text_key"), "firsts")
    scratch.drop("nodes", "links")
    return first_rows(docs, firsts)
