"""Best-fit packing of token pieces into sequences by linear grouping.

Pieces longer than ``small`` tokens are large. Sorted by length, they are dealt into ``groups`` groups of equal
cardinality, and each length is rounded up to its group's greatest. For these few sizes, configurations (what one
sequence holds) are chosen on the driver, from counts alone: the greatest size left, then the sizes left whose sum
fills the sequence best, used as often as counts allow. Actual pieces then take the places of their group's size.
What that leaves free is counted, and small pieces are dealt best-fit, longest first, again from counts alone.
The driver sees histograms over at most ``capacity`` lengths; pieces are matched with places by their rank among
the pieces of their group or length, counted in buckets of bounded size.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from annulus.llm.common import Scratch
from annulus.llm.pretokens import split

CAPACITY, SMALL, GROUPS, BUCKET, CACHE = 2048, 256, 1024, 250, 700_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_characters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


class Ids(dict):
    """Little-endian 32-bit ids of pieces of the pattern, by the tokenizers library; at most CACHE are kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.letters = self.whole.model, byte_characters()
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        found = self.model.tokenize(piece.encode("utf-8", "replace").decode("latin-1").translate(self.letters))
        ids = b"".join([t.id.to_bytes(4, "little") for t in found])
        if len(piece) < 200:
            self[piece] = ids
        return ids


@lru_cache(2)
def _ids(path: str) -> Ids:
    return Ids(path)


def token_ids(text: str | None, path: str, pattern: str, added: bool = False) -> bytes:
    """The document's ids and a closing 0, as little-endian 32-bit numbers.

    With ``added``, the file's added tokens in a text are one id each, as the tokenizers library encodes by default;
    else they are text like any other (its ``encode_special_tokens``).
    """
    if added and text and any(t in text for t in _ids(path).added):
        ids = _ids(path).whole.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids
        return np.array([*ids, 0], "<u4").tobytes()
    return b"".join(map(_ids(path).__getitem__, split(text or "", pattern))) + b"\0\0\0\0"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one, or pieces of capacity of which the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False, added: bool = False) -> DataFrame:
    """A row per piece of each row of docs; with_ids adds ``ids array<int>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = token_ids(text, path, pattern, added)
                for k, (start, length) in enumerate(cuts(len(data) // 4, capacity)):
                    part = data[4 * start : 4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            out = [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def grouped(histogram: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Linear grouping: (length, count) lists of equal cardinality, from the greatest length on."""
    total = sum(histogram.values())
    each, out, room = max(1, -(-total // groups)), [], 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not room:
                out.append([])
                room = each
            take = min(left, room)
            out[-1].append((length, take))
            left, room = left - take, room - take
    return out


def _best_fill(sizes: list[int], counts: list[int], room: int) -> dict[int, int]:
    """Which sizes (index -> times, within counts) fill room best; greater ones first where sums are equal."""
    full = (1 << (room + 1)) - 1
    reach, stages = 1, []
    for i, size in enumerate(sizes):
        times = min(counts[i], room // size)
        step = 1
        while times > 0:  # binary splitting of the count
            step = min(step, times)
            grown = (reach | reach << (size * step)) & full
            if grown != reach:
                stages.append((i, step, reach))
                reach = grown
            times -= step
            step *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for i, step, before in reversed(stages):
        if not before >> at & 1:
            used[i] = used.get(i, 0) + step
            at -= sizes[i] * step
    return used


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, size index -> times in each) until counts are used up. sizes: descending."""
    left, out = list(counts), []
    while True:
        first = next((i for i, c in enumerate(left) if c), None)
        if first is None:
            return out
        left[first] -= 1
        used = _best_fill(sizes, left, capacity - sizes[first])
        left[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(left[i] // k for i, k in used.items())
        for i, k in used.items():
            left[i] -= k * times
        out.append((times, used))


def best_fit(room: dict[int, int], items: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Deals items (length -> count) to sequences (free room -> count), longest first, each to the least room it fits.

    Returns (length, first item, end item, room class, first sequence of that class, items in each) and how many
    new sequences were opened; these are class capacity + 1. Items and sequences are ranks within their class.
    """
    bins = sorted((free, r, 0, n) for r, n in room.items() for free in [r] if n)  # (free now, class, from, to)
    opened, plan = 0, []
    for length in sorted(items, reverse=True):
        left, at = items[length], 0
        kept, made = [], []
        start = bisect.bisect_left(bins, (length,))
        kept, usable = bins[:start], bins[start:]
        for free, cls, lo, hi in usable:
            if not left:
                kept.append((free, cls, lo, hi))
                continue
            each = free // length
            whole = min(hi - lo, left // each)
            if whole:
                plan.append((length, at, at + whole * each, cls, lo, each))
                made.append((free - each * length, cls, lo, lo + whole))
                left, at, lo = left - whole * each, at + whole * each, lo + whole
            if left and lo < hi and left < each:
                plan.append((length, at, at + left, cls, lo, left))
                made.append((free - left * length, cls, lo, lo + 1))
                at, lo, left = at + left, lo + 1, 0
            if lo < hi:
                kept.append((free, cls, lo, hi))
        if left:
            each = capacity // length
            whole, rest = divmod(left, each)
            if whole:
                plan.append((length, at, at + whole * each, capacity + 1, opened, each))
                made.append((capacity - each * length, capacity + 1, opened, opened + whole))
            if rest:
                plan.append((length, at + whole * each, at + left, capacity + 1, opened + whole, rest))
                made.append((capacity - rest * length, capacity + 1, opened + whole, opened + whole + 1))
            opened += whole + bool(rest)
        bins = sorted(kept + made)
    return plan, opened


def _ranked(scratch: Scratch, rows: DataFrame, key: str, counts: dict[int, int], name: str) -> DataFrame:
    """rows with ``rank`` from 0 within each value of key; rows has ``uid``. Buckets of about BUCKET rows are numbered apart."""
    buckets = {k: -(-n // BUCKET) for k, n in counts.items() if n > BUCKET}
    number = F.coalesce(F.create_map(*[F.lit(x) for kv in buckets.items() for x in kv])[F.col(key)], F.lit(1)) if buckets else F.lit(1)
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64("uid"), number))
    each = dealt.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    before = each.withColumn("_at", F.sum("_n").over(W.partitionBy(key).orderBy("_b")) - F.col("_n")).drop("_n")
    before = scratch.keep(before, f"before_{name}")
    own = dealt.withColumn("_r", F.row_number().over(W.partitionBy(key, "_b").orderBy("uid")) - 1)
    return own.join(before, [key, "_b"]).withColumn("rank", F.col("_at") + F.col("_r")).drop("_b", "_at", "_r")


def _placed(rows: DataFrame, places: dict[int, list[tuple[int, int, int, int]]]) -> DataFrame:
    """rows(uid, length, rank) -> (uid, length, cls, bin), by runs (first rank, class, first place, places in each bin)."""
    arrays = {k: np.array(sorted(v), np.int64) for k, v in places.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, r = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            cls, into = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
            for value in np.unique(k):
                own = np.flatnonzero(k == value)
                table = arrays[int(value)]
                at = table[np.searchsorted(table[:, 0], r[own], side="right") - 1]
                cls[own], into[own] = at[:, 1], (at[:, 2] + r[own] - at[:, 0]) // at[:, 3]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("length"), pa.array(cls), pa.array(into)], ["uid", "length", "cls", "bin"])

    return rows.select("uid", "length", "rank").mapInArrow(run, "uid long, length long, cls long, bin long")


def _counts(rows: DataFrame, key: str) -> dict[int, int]:
    return {x[0]: x[1] for x in rows.groupBy(key).agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows


def sequences(scratch: Scratch, items: DataFrame, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> DataFrame:
    """``items(uid long, length long)``, uid unique, 1 <= length <= capacity -> ``(uid, length, sequence_id, offset)``."""
    histogram = _counts(items, "length")
    large = {k: n for k, n in histogram.items() if small < k < capacity}
    by_group = grouped(large, groups)
    rounded = [g[0][0] for g in by_group]
    plan = configurations(rounded, [sum(n for _, n in g) for g in by_group], capacity)

    slots: dict[int, list[tuple[int, int, int, int]]] = {}  # by group: (first rank, 0, first sequence, places in each)
    filled, used = 0, [0] * len(by_group)
    for times, pattern in plan:
        for g, k in pattern.items():
            slots.setdefault(g, []).append((used[g], 0, filled, k))
            used[g] += times * k
        filled += times
    # ranks within a length -> ranks within a group: a group is a run of ranks of each of its lengths
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    met: dict[int, int] = {}
    for g, parts in enumerate(by_group):
        first = 0
        for length, n in parts:
            for lo, _, base, k in slots[g]:
                hi = next((x[0] for x in slots[g] if x[0] > lo), used[g])
                a, b = max(lo, first), min(hi, first + n)
                if a < b:  # these ranks of the group take places in sequences base, base + 1, ...
                    by_length.setdefault(length, []).append((met.get(length, 0) + a - first, g, base * k + (a - lo), k))
            met[length] = met.get(length, 0) + n
            first += n

    whole = items.where(F.col("length") == capacity).select("uid", "length", (-F.col("uid") - 1).alias("sequence_id"))
    big = _ranked(scratch, items.where((F.col("length") > small) & (F.col("length") < capacity)), "length", large, "large")
    big = scratch.keep(_placed(big, by_length).select("uid", "length", F.col("bin").alias("sequence_id")), "large")

    free = big.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room")).where("room > 0").select(F.col("sequence_id").alias("uid"), "room")
    free = scratch.keep(free, "free")
    room = _counts(free, "room")
    few = {k: n for k, n in histogram.items() if k <= small and k < capacity}
    dealing, _ = best_fit(room, few, capacity)
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, lo, _, cls, first, k in dealing:
        places.setdefault(length, []).append((lo, cls, first * k, k))
    little = _placed(_ranked(scratch, items.where(F.col("length") <= min(small, capacity - 1)), "length", few, "small"), places)
    little = scratch.keep(little, "small")
    numbered = _ranked(scratch, free, "room", room, "room").select(F.col("room").alias("cls"), F.col("rank").alias("bin"), F.col("uid").alias("sequence_id"))
    added = little.where(F.col("cls") <= capacity).join(numbered, ["cls", "bin"]).select("uid", "length", "sequence_id")
    opened = little.where(F.col("cls") > capacity).select("uid", "length", (F.col("bin") + filled).alias("sequence_id"))
    every = big.unionByName(added).unionByName(opened)
    run = W.partitionBy("sequence_id").orderBy(F.desc("length"), "uid").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = every.withColumn("offset", F.sum("length").over(run) - F.col("length"))
    return every.unionByName(whole.withColumn("offset", F.lit(0).cast("long")))


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS, with_ids: bool = False, added: bool = False) -> DataFrame:
    """Packs every row of docs: doc_id, piece, start, length, ids_crc32, sequence_id and offset (and ids) per piece.

    A null or empty text is the single token 0. Repeated rows are packed each for itself, also rows with a null
    doc_id. An empty table gives an empty result. Other columns of docs are ignored. For ``added`` see token_ids. A text of
    any length is held by one task with its ids, 4 bytes each, and cut into pieces there.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = pieces(docs, path, pattern, capacity, with_ids, added)
    cut = scratch.keep(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    dealt = scratch.keep(sequences(scratch, cut.select("uid", "length"), capacity, small, groups), "sequences")
    scratch.drop("large", "free", "small", "before_large", "before_small", "before_room")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    return cut.drop("length").join(dealt, "uid").select(*names)
