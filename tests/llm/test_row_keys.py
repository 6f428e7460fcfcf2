"""Rows of one doc_id whose texts' hashes agree in the bits that tell rows apart."""

import hashlib

import xxhash
from pyspark.sql import functions as F

from annulus.llm import spans, suffix_dedup


def low_bits(text, bits=19):
    return xxhash.xxh64_intdigest(text.encode(), 42) & ((1 << bits) - 1)


def agreeing(lead, bits=19):
    """Two texts whose keys agree, and which begin with lead."""
    seen = {}
    for i in range(1 << 20):
        text = f"{lead} {i}"
        key = low_bits(text, bits)
        if key in seen:
            return seen[key], text
        seen[key] = text
    raise AssertionError


def test_texts_that_agree_in_19_bits(spark):
    passage = "a passage of more than fifty bytes that a document of a smaller id has as well, word by word"
    a, b = agreeing("")
    lead, plain = passage + a, "x" * 10 + b
    pair = agreeing(passage)
    rows = [(1, passage), (7, pair[0]), (7, pair[1]), (8, lead), (8, plain)]
    rows += [(9, f"{passage if i % 2 else ''} number {i}") for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    keyed = spans.with_keys(docs, "key", 19)
    assert keyed.groupBy("doc_id", "key").agg(F.count_distinct("text").alias("n")).where("n > 1").count() == 0
    assert keyed.groupBy("doc_id", "text").agg(F.count_distinct("key").alias("n")).where("n > 1").count() == 0
    plain_keys = docs.where("doc_id < 9 and doc_id <> 7").select("doc_id", spans.row_key(19).alias("k")).distinct().count()
    assert spans.with_keys(docs.where("doc_id < 9 and doc_id <> 7"), "key", 19).select("doc_id", "key").distinct().count() == plain_keys
    first = {}
    for i, t in rows:
        for at in range(len(t) - 49):
            first[t[at : at + 50]] = min(i, first.get(t[at : at + 50], i))
    want = []
    for i, t in rows:
        covered = {at + k for at in range(len(t) - 49) if first[t[at : at + 50]] < i for k in range(50)}
        kept = "".join(c for k, c in enumerate(t) if k not in covered)
        want.append((i, len(t), len(covered), hashlib.sha256(kept.encode()).hexdigest()))
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.kept_sha256) for x in suffix_dedup.suffix_report(docs).collect())
    assert got == sorted(want) and {x[2] > 90 for x in want if x[0] in (7, 8)} == {True, False}
