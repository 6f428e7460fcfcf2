"""Cutting byte spans out of texts: the last step of both substring operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from annulus.llm.common import free_names, text_key

CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def merged(spans: list[int] | None, least: int = 0) -> list[tuple[int, int]]:
    """Maximal runs, of least bytes or more, of ``start << 32 | end`` spans."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((x >> 32, x & 0xFFFFFFFF) for x in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return [x for x in out if x[1] - x[0] >= least] if least else out


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in runs)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(s for s, _ in runs), len(data)], strict=True))


def with_spans(docs: DataFrame, spans: DataFrame, name: str = "__spans", bits: int = 19, key: str | None = None) -> DataFrame:
    """Each row of docs with ``name array<long>`` (docs has none of that name), from ``spans(doc_id, key, spans)``; null where it has none.

    key: the column of docs that tells apart rows of one doc_id; without one, bits of the text's hash do.
    """
    made, doc, of = free_names(docs.withColumn(name, F.lit(0)), "__key", "__doc", "__of")
    own = docs.withColumn(made, F.col(key) if key else row_key(bits))
    found = spans.select(F.col("doc_id").alias(doc), F.col("key").alias(of), F.col("spans").alias(name))
    return own.join(found, (own["doc_id"] == found[doc]) & (own[made] == found[of]), "left").drop(doc, of, made)


def with_keys(docs: DataFrame, name: str, bits: int) -> DataFrame:
    """``docs(doc_id, text)`` with ``name``, a number of so many bits that different texts of one doc_id don't share.

    It is bits of the text's 64-bit hash. Where two texts of an id share these, all of that id's texts are numbered instead, by their
    hashes; only then is the table shuffled. An id with more different texts than there are numbers raises.
    """
    whole = text_key()
    slim = docs.where("doc_id is not null").select("doc_id", row_key(bits).alias("k"), whole.alias("h"))
    bad = slim.groupBy("doc_id", "k").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a < z").select("doc_id").distinct()
    plain = docs.withColumn(name, row_key(bits))
    if bad.isEmpty():
        return plain
    texts = slim.join(bad, "doc_id", "left_semi").select("doc_id", "h").distinct()
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("h")) - 1
    checked = F.when(place < 1 << bits, place.cast("long")).otherwise(F.raise_error(F.lit(f"a doc_id has more than {1 << bits} different texts")).cast("long"))
    numbered = texts.select(F.col("doc_id").alias("__doc"), F.col("h").alias("__h"), checked.alias("__n"))
    met = plain.join(numbered, (plain["doc_id"] == numbered["__doc"]) & (whole == numbered["__h"]), "left")
    return met.withColumn(name, F.coalesce("__n", name)).drop("__doc", "__h", "__n")


def row_key(bits: int = 19) -> Column:
    """So many bits of the text's hash, to tell apart rows that carry one id but different texts."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def digests(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, __spans)`` -> a row of counts and the digest of what is kept for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "replace")
                runs = merged(spans)
                rows.append((len(data), sum(e - s for s, e in runs), len(runs), hashlib.sha256(without(data, runs)).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "__spans").mapInArrow(run, CUT)


def cut_text(docs: DataFrame, name: str) -> DataFrame:
    """docs without the spans of that name, its texts cut; a text that had no span (null included) stays as it was."""
    out = docs.drop(name).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column(name).to_pylist()
            cut = [without(t.encode("utf-8", "replace"), merged(s)).decode("utf-8", "ignore") if s and t is not None else t for t, s in zip(texts, spans, strict=True)]
            cols = {n: batch.column(n) for n in out.names} | {"text": pa.array(cut, pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.select(*out.names, name).mapInArrow(run, out)
