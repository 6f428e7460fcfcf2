"""Substring dedup by content-defined chunks.

A gear rolling hash runs over the UTF-8 bytes; a chunk ends where bits 11 to 15 of the hash, which depend on the
last 16 bytes only, are zero. Chunk ends thus follow the content: after an insertion the same ends come back.
Chunks are at least ``min_bytes`` long and are cut at ``max_bytes``; ends lie between code points. A chunk is
repeated where a document with a smaller doc_id has a chunk of the same 128-bit digest. Runs of such chunks of
``min_run`` bytes or more are removed; the document of smallest doc_id keeps its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.llm.common import Scratch, free_names
from annulus.llm.spans import cut_text, digests, merged, row_key, with_spans

MIN_BYTES, MAX_BYTES, MIN_RUN, KEY_BITS = 32, 512, 50, 31
MASK = np.uint16(0b1111_1000_0000_0000)
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) & 0xFFFF for b in range(256)], np.uint16)
CHUNKS = "h1 long, h2 long, doc_id long, at long, length int"


def chunk_ends(data: bytes, min_bytes: int = MIN_BYTES, max_bytes: int = MAX_BYTES) -> list[int]:
    """Where the chunks of data end, the last at its length; none for no data."""
    n = len(data)
    if not n:
        return []
    raw = np.frombuffer(data, np.uint8)
    h = GEAR[raw]
    for step in (1, 2, 4, 8):
        older = h[:-step] << np.uint16(step) if step < n else h[:0]
        h = h.copy()
        h[step:] += older
    found = np.flatnonzero((h & MASK) == 0) + 1
    found = found[found < n]
    found = found[(raw[found] & 0xC0) != 0x80]
    ends, last = [], 0
    for end in [*found.tolist(), n]:
        while end - last > max_bytes:
            cut = last + max_bytes
            while cut > last + 1 and data[cut] & 0xC0 == 0x80:
                cut -= 1
            ends.append(cut)
            last = cut
        if end - last >= min_bytes:
            ends.append(end)
            last = end
    if last < n:
        ends.append(n)
    return ends


def chunks(docs: DataFrame, min_bytes: int = MIN_BYTES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` -> a row per chunk: digest, doc_id, ``row key << 32 | start`` and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, lengths, counts, hashed = [], [], [], [], []
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "replace")
                ends = chunk_ends(data, min_bytes, max_bytes)
                begin = [0, *ends[:-1]] if ends else []
                hashed += [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(begin, ends, strict=True)]
                starts.append(np.array(begin, np.int64) + (key << 32))
                lengths.append(np.array(ends, np.int64) - np.array(begin, np.int64))
                counts.append(len(ends))
            both = np.frombuffer(b"".join(hashed), np.int64).reshape(-1, 2)
            cols = [both[:, 0].copy(), both[:, 1].copy(), np.repeat(ids, counts) if counts else np.zeros(0, np.int64), np.concatenate(starts or [np.zeros(0, np.int64)])]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in cols), pa.array(np.concatenate(lengths or [np.zeros(0)]).astype(np.int32))], ["h1", "h2", "doc_id", "at", "length"]
            )

    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row_key(KEY_BITS).alias("key"), "text")
    return named.mapInArrow(run, CHUNKS)


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, max_bytes: int = MAX_BYTES, min_run: int = MIN_RUN) -> DataFrame:
    """``(doc_id, key, spans array<long>)`` of the documents with repeated chunks, written to the shared folder.

    Rows with a null doc_id neither lose nor lend chunks. Rows of one doc_id don't affect each other.
    """
    scratch = Scratch(docs.sparkSession, "chunks")
    all_chunks = chunks(docs, min_bytes, max_bytes)
    shared = all_chunks.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2", "lo")
    shared = scratch.keep(shared, "shared")
    again = all_chunks.join(shared.hint("shuffle_hash"), ["h1", "h2"]).where("doc_id > lo")
    start = F.col("at").bitwiseAND(0xFFFFFFFF)
    again = again.select("doc_id", F.shiftright("at", 32).alias("key"), (F.shiftleft(start, 32) + start + F.col("length")).alias("span"))
    spans = scratch.keep(again.groupBy("doc_id", "key").agg(F.collect_list("span").alias("spans")), "spans")
    scratch.drop("shared")
    return long_runs(spans, min_run)


def long_runs(spans: DataFrame, min_run: int) -> DataFrame:
    """``(doc_id, key, spans)`` with spans that touch joined, runs of min_run bytes or more alone, and no row without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = [[a << 32 | b for a, b in merged(x, min_run)] for x in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(joined, pa.list_(pa.int64()))], ["doc_id", "key", "spans"])

    return spans.select("doc_id", "key", "spans").mapInArrow(run, "doc_id long, key long, spans array<long>").where(F.size("spans") > 0)


def substring_dedup(docs: DataFrame, **options: int) -> DataFrame:
    """docs with repeated passages cut out of ``text``; its rows and columns stay.

    Null and empty texts stay as they are. Rows with a null doc_id are returned whole. Of a repeated row (same
    doc_id and text) every copy is cut alike. n_chars, where docs has it, is set to the new length.
    """
    (name,) = free_names(docs, "spans")
    cut = cut_text(with_spans(docs, repeated_spans(docs.select("doc_id", "text"), **options), name, KEY_BITS), name)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def substring_report(docs: DataFrame, **options: int) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans and kept_sha256 (null text: no bytes)."""
    slim = docs.select("doc_id", "text")
    return digests(with_spans(slim, repeated_spans(slim, **options), bits=KEY_BITS))
