"""Ranked lexical search for many items at once, by evaluating what items share only once.

Items are taken in blocks of bounded text. For each block, sets of terms that several of its items hold are mined: pairs
of terms, then pairs of such pairs, and so on, which gives a graph of nodes, each the sum of two others, in which an
item is the sum of few nodes. One pass over the texts keeps of each document its length and the counts of the block's
terms; document frequencies are summed from these. A second pass, over the counts, adds up the accumulators of each node
once for a batch of documents, then those of the items along the graph, and keeps each item's best of a task. The tasks'
short lists are merged by Spark, first within parts of the documents, then among these.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from annulus.llm.common import Scratch

K, BLOCK_BYTES, WINDOW, VALUES, PARTS = 50, 1 << 19, 48, 1 << 22, 64
#: Bytes that part terms become spaces, A-Z lower case; all others stay.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
COUNTED = "doc_id long, n long, terms array<int>, counts array<int>"
RANKED = "item_id long, doc_id long, score long"


def terms(data: bytes | None) -> list[bytes]:
    """The terms of a whole UTF-8 text, in order, repeats included; null has none."""
    return data.translate(PLAIN).split() if data else []


def shared_sets(items: list[list[int]], size: int, window: int = WINDOW) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Nodes (pairs of terms below ``size`` or of earlier nodes, the k-th numbered size + k), and for each item its nodes.

    An item's terms are each once in its nodes. Every node is in two items or more when it is made. Nodes that many items
    hold stand first in an item, and only those within ``window`` places of each other are paired, so that the work grows
    with the items' length.
    """
    nodes: list[tuple[int, int]] = []
    held = [set(x) for x in items]
    while True:
        times = Counter(v for own in held for v in own)
        pairs: Counter[tuple[int, int]] = Counter()
        for own in held:
            order = sorted((v for v in own if times[v] > 1), key=lambda v: (-times[v], v))
            for i, a in enumerate(order):
                pairs.update((min(a, b), max(a, b)) for b in order[i + 1 : i + 1 + window])
        found = sorted(((n, p) for p, n in pairs.items() if n > 1), key=lambda x: (-x[0], x[1]))
        if not found:
            return nodes, [sorted(own) for own in held]
        of: dict[int, set[int]] = {}
        for i, own in enumerate(held):
            for v in own:
                of.setdefault(v, set()).add(i)
        for _, (a, b) in found:
            both = of[a] & of[b]  # pairs made before in this round have taken some of them
            if len(both) > 1:
                for i in both:
                    held[i] = held[i] - {a, b} | {size + len(nodes)}
                of[a] -= both
                of[b] -= both
                nodes.append((a, b))


def _text_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def item_terms(items: DataFrame) -> DataFrame:
    """``items(item_id, text)`` -> ``(item_id, term binary)``, each term of an item once; rows of a null item_id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t) for i, text in zip(batch.column("item_id").to_pylist(), _text_bytes(batch.column("text")), strict=True) for t in set(terms(text))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["item_id", "term"])

    named = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return named.mapInArrow(run, "item_id long, term binary").distinct()


def term_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, the number n of all its terms, and places in the vocabulary with their counts; a row a row."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})  # of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch in batches:
            lengths, ids, counts = [], [], []
            for text in _text_bytes(batch.column("text")):
                found = terms(text)
                own = {place[t]: n for t, n in Counter(found).items() if t in place}
                lengths.append(len(found))
                ids.append(list(own))
                counts.append(list(own.values()))
            cols = [pa.array(lengths, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTED)


def document_frequencies(counted: DataFrame, size: int) -> tuple[int, int, list[int]]:
    """Documents with a term, the terms of all, and for each place of the vocabulary the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size + 2, np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            held[:size] += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
            held[size:] += (np.count_nonzero(n), n.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2)), pa.array(held)], ["term", "n"])

    sums = counted.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {x.term: x.n for x in sums.collect()}  # a row for each term of the block
    return found.get(size, 0), found.get(size + 1, 0), [found.get(t, 0) for t in range(size)]


def weights(documents: int, frequencies: list[int]) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequencies], np.int64)


class Accumulators:
    """Scores of a batch of documents for all items of a block."""

    def __init__(self, plan: dict):
        self.nodes, self.tops, self.weight, self.documents, self.total = (plan[x] for x in ("nodes", "tops", "weight", "documents", "total"))

    def scores(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """A row for each item and a column for each document; doc, term and tf are the counts, n the documents' lengths."""
        size = len(self.weight)
        m = 50 + 50 * n * self.documents // max(self.total, 1)
        sums = np.zeros((size + len(self.nodes), len(n)), np.int64)
        sums[term, doc] = self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        for k, (a, b) in enumerate(self.nodes, size):
            np.add(sums[a], sums[b], out=sums[k])
        return np.stack([sums[own].sum(axis=0) for own in self.tops]) if self.tops else np.zeros((0, len(n)), np.int64)


def _best_of_task(counted: DataFrame, plan: dict, item_ids: list[int], k: int) -> DataFrame:
    shared = counted.sparkSession.sparkContext.broadcast(plan)  # of one block of items
    rows = max(1, VALUES // (len(plan["weight"]) + len(plan["nodes"]) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Accumulators(shared.value)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(item_ids)  # scores, doc_ids
        least = np.ones(len(item_ids), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                ids, n = batch.column("doc_id").to_numpy(), batch.column("n").to_numpy()
                tf, of = batch.column("counts").flatten().to_numpy().astype(np.int64), batch.column("terms").flatten().to_numpy()
                doc = np.repeat(np.arange(len(n)), batch.column("terms").value_lengths().to_numpy())
                found = made.scores(n, doc, of, tf)
                enough = found >= least[:, None]
                for i in np.flatnonzero(enough.any(axis=1)):
                    score, own = (np.concatenate([x, y[enough[i]]]) for x, y in zip(best[i], (found[i], ids), strict=True))
                    order = np.lexsort((own, -score))[:k]
                    best[i] = score[order], own[order]
                    if len(order) == k:
                        least[i] = score[order[-1]]
        score, own = (np.concatenate([x[c] for x in best]) if best else np.zeros(0, np.int64) for c in (0, 1))
        of = np.repeat(np.array(item_ids, np.int64), [len(x[0]) for x in best])
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(own), pa.array(score)], ["item_id", "doc_id", "score"])

    return counted.where("doc_id is not null and n > 0").mapInArrow(run, RANKED)


def best_documents(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each item of ``items(item_id, text)`` the k documents of ``docs(doc_id, text)`` of highest score above 0: item_id, rank
    (from 1), doc_id, score; equal scores by doc_id.

    Null and empty texts have no terms. Every row of docs is a document, a repeated one too; those of a null doc_id count in
    all statistics, but take no rank. Rows of one item_id are one item, which holds the terms of all of them; rows of a null
    item_id are left out, as are items without terms. A text of any length is split whole by one task, and repeats of a term in it
    count. Other columns are ignored; an empty table on either side gives an empty result. About ``block_bytes`` bytes of the items' texts are
    searched for at once, so that what is broadcast is bounded by them; each block reads the texts once.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    held = scratch.keep(item_terms(items), "items")
    blocks = max(1, -(-(held.agg(F.sum(F.length("term") + 8)).first()[0] or 0) // block_bytes))
    parts = []
    for b in range(blocks):
        own: dict[int, list[bytes]] = {}
        for x in held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect():  # about block_bytes
            own.setdefault(x.item_id, []).append(bytes(x.term))
        vocabulary = sorted({t for found in own.values() for t in found})
        place = {t: i for i, t in enumerate(vocabulary)}
        item_ids = sorted(own)
        counted = scratch.keep(term_counts(docs, vocabulary), f"counted{b}")
        documents, total, frequencies = document_frequencies(counted, len(vocabulary))
        nodes, tops = shared_sets([[place[t] for t in own[i]] for i in item_ids], len(vocabulary))
        plan = {"nodes": nodes, "tops": tops, "weight": weights(documents, frequencies), "documents": documents, "total": total}
        parts.append(scratch.keep(_best_of_task(counted, plan, item_ids, k), f"best{b}"))
        scratch.drop(f"counted{b}")
    scratch.drop("items")
    return _ranked(reduce(DataFrame.unionByName, parts), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    def first(rows: DataFrame, *keys: str | Column) -> DataFrame:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))
        return rows.withColumn("rank", place).where(F.col("rank") <= k)

    within = first(found, "item_id", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).drop("rank")
    return first(within, "item_id").select("item_id", "rank", "doc_id", "score")
