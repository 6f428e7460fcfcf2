"""Suffix-array dedup: removes each byte covered by a ``width``-byte string that also starts in an earlier document.

Suffixes are ordered to a depth of ``width`` bytes only, by most-significant-digit passes: each pass deals the suffixes
that are still open by one longer digit of their own bytes, and drops those whose group holds one document only. After
the last digit, groups of equal strings are exactly the repeated windows; those outside the group's first document go.

Not every suffix has to be dealt. Each string of ``width`` bytes owns the gram of 24 bytes in it whose first 16 have
the least hash (its anchor). Which gram that is depends on the string's bytes alone, so equal strings own equal grams at equal
distances from their starts; a string can repeat only if its anchor's gram does, and then every equal string lies at
the same distance before such a gram. So suffixes are dealt in bundles, one for each anchor (one byte in fourteen),
each bundle standing for the strings that own it: those that start ``near`` to ``far`` bytes before it.

1. First digit, the anchor's gram: bundles whose gram occurs in one document only drop out.
2. Second digit, all bytes that the bundle's strings cover (a 128-bit digest together with the gram): where an earlier
   document has the same, all strings of the bundle repeat; the first document's bundle stays open if its gram has others.
3. Last digits, for the open bundles of a gram: each string's own bytes, eight at a time, the most significant first, in Arrow
   batches of whole grams; after each of these passes, groups of one document drop out. A gram with more than ``GROUP`` bundles is not put into one batch:
   its strings are dealt by ever longer digits first (the bytes that neighbouring strings share), and what stays
   large is grouped by the strings' bytes in Spark.

Bundles travel as packed arrays, a row for each bucket of grams and block of about ``BLOCK`` bytes of text, reduced to
one entry for each gram (digit one) or part (digit two) before they meet, so that a gram or a passage in a third of all
documents is as small there as any other. Anchors are computed twice, which is cheaper than keeping them on disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.llm.common import Scratch
from annulus.llm.spans import digests, with_keys, with_spans

GRAM, WIDTH, KEY_BITS = 24, 50, 19
SEGMENT, BLOCK = 1 << 18, 4 << 20
BUNDLES, GROUP = 1 << 20, 4096  # anchors to a bucket; bundles of one gram to a batch
#: How a place is packed: 19 bits of the row's key, 32 of the anchor's byte, 6 each of far and near.
PLACE = {"key": (44, 0x7FFFF), "byte": (12, 0xFFFFFFFF), "far": (6, 63), "near": (0, 63)}
#: Multipliers of the order hash and of the digits' hashes, and a number for each byte value.
STEPS = np.random.default_rng(50).integers(1 << 20, 1 << 32, 5, np.uint32) | np.uint32(1)
FIRST, SECOND, LAST = np.random.default_rng(51).integers(1 << 60, 1 << 64, 3, np.uint64) | np.uint64(1)
VALUES = np.random.default_rng(52).integers(0, 1 << 32, 256, np.uint32)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each window of width values."""
    size, out = 1, values
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(out) - (width - size)], out[width - size :]) if width > size else out


def _hash(words: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """64-bit hashes of rows of 64-bit words: multiply, rotate and add for each, then a finishing mix."""
    h = np.zeros(len(words), np.uint64) + np.uint64(seed) if np.isscalar(seed) else seed.astype(np.uint64)
    for i in range(words.shape[1]):
        k = words[:, i] * FIRST
        k = (k << np.uint64(31) | k >> np.uint64(33)) * SECOND
        h = h ^ k
        h = (h << np.uint64(27) | h >> np.uint64(37)) * np.uint64(5) + LAST
    h ^= h >> np.uint64(33)
    h *= FIRST
    h ^= h >> np.uint64(29)
    h *= SECOND
    return h ^ h >> np.uint64(32)


def _words(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The size bytes from each place on, as rows of 64-bit words."""
    return sliding_window_view(data, size)[at].view("<u8") if len(at) else np.zeros((0, size // 8), np.uint64)


def anchors(data: np.ndarray, ends: np.ndarray, width: int = WIDTH, surroundings: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """Of texts laid end to end (``ends``: where each one ends), per anchor, a segment of data at a time: the text's
    index, the anchor's place in data, the gram's hash, and if asked for the digest of what its strings cover, and how
    far before the anchor the first and the last of its strings start (a range without gaps)."""
    grams, n = width - GRAM + 1, len(data)  # grams in a string
    halo = grams - 1
    begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
    for a in range(0, n - width + 1, SEGMENT):
        b = min(a + SEGMENT, n)
        lo, hi = max(0, a - halo), min(n, b + halo + width)
        h = VALUES[data[lo:hi]]
        for m, step in zip((1, 2, 4, 8), STEPS, strict=False):  # 16 bytes
            h = h[:-m] * step + h[m:]
        h ^= h >> np.uint32(15)
        h *= STEPS[4]
        h ^= h >> np.uint32(14)
        order = h | np.uint32(1)
        if len(order) < grams:
            continue
        least = _sliding(order, grams, np.minimum)
        first, last = np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, hi, side="left")
        for begin, end in zip(begins[first : last + 1].tolist(), ends[first : last + 1].tolist(), strict=True):
            least[max(begin, end - width + 1, lo) - lo : max(0, end - lo)] = 0  # strings don't run over a text's end
        padded = np.zeros(len(least) + 2 * halo, np.uint32)
        padded[halo : halo + len(least)] = least
        chosen = _sliding(padded, grams, np.maximum)
        pos = np.flatnonzero(order == chosen)
        pos = pos[(pos >= a - lo) & (pos < b - lo)]
        at = pos + lo
        doc = np.searchsorted(ends, at, side="right")
        gram = _hash(_words(data, at, GRAM), 1)
        if not surroundings:
            yield doc, at, gram
            continue
        owned = sliding_window_view(padded, grams)[pos] == order[pos][:, None]  # column j: the string that starts halo - j before
        far = halo - owned.argmax(axis=1)
        near = far - owned.sum(axis=1) + 1
        size = width + far - near
        around = far.astype(np.uint64) << np.uint64(8) | size.astype(np.uint64)
        for off in (np.zeros_like(size), (size - 32) // 2, size - 32):  # three parts of 32 bytes cover up to 96
            around = _hash(_words(data, at - far + off, 32), around)
        yield doc, at, gram, around, far, near


def _packed(*arrays: np.ndarray) -> bytes:
    """64-bit arrays of one length, byte plane by byte plane, so that what their numbers have alike takes little room."""
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(data: bytes, count: int) -> np.ndarray:
    """What _packed took, as rows of unsigned numbers."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(count, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint64).reshape(count, -1)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, keys, bytes and ends of each batch's texts."""
    for batch in batches:
        column = batch.column("text")
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
        yield batch.column("doc_id").to_numpy(), batch.column("key").to_numpy(), data, offsets[1:].astype(np.int64) - offsets[0]


def _by_bucket(gram: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of sorted grams, and where each begins and ends."""
    own = (gram >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]]))
    return own[begin].astype(np.int64), np.append(begin, len(own))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where the groups of equal sorted keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _named(docs: DataFrame, width: int) -> DataFrame:
    """Rows that can lose or lend bytes: doc_id, key and the text's bytes."""
    rows = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("key"), F.col("text").cast("binary").alias("text"))


def grams_of_blocks(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Digit one, dealt: for each block of text and bucket the grams with their least and greatest doc_id, packed, and in
    how many parts a bucket must be taken so that a gram of very many anchors does not fill one."""

    def dealt(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        gram, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(gram)
        gram, doc = gram[order], doc[order]
        begin = _starts(gram)
        names, cut = _by_bucket(gram, buckets)
        parts = -(-np.diff(cut) // (4 * (len(gram) // buckets + 1024)))
        gram, lo, hi = gram[begin], np.minimum.reduceat(doc, begin), np.maximum.reduceat(doc, begin)
        _, cut = _by_bucket(gram, buckets)
        data = [_packed(gram[i:j], lo[i:j], hi[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(parts, pa.int64()), pa.array(data, pa.binary())], ["bucket", "parts", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for ids, _, data, ends in _texts(batches):
            for doc, _, gram in anchors(data, ends, width, False):
                found.append((gram, ids[doc]))
                size += SEGMENT
                if size >= BLOCK:
                    yield dealt(found)
                    found, size = [], 0
        if found:
            yield dealt(found)

    return _named(docs, width).mapInArrow(run, "bucket long, parts long, data binary")


def repeated_grams(blocks: DataFrame) -> DataFrame:
    """(bucket, parts, grams binary): each bucket's grams that occur in several documents, packed, in order."""

    def run(group: pa.Table) -> pa.Table:
        gram, lo, hi = np.concatenate([_unpacked(x.as_py(), 3) for x in group.column("data")], axis=1)
        order = np.argsort(gram)
        gram, lo, hi = gram[order], lo[order].view(np.int64), hi[order].view(np.int64)
        begin = _starts(gram)
        again = np.minimum.reduceat(lo, begin) < np.maximum.reduceat(hi, begin)
        parts = max(group.column("parts").to_pylist())
        return pa.table([[group.column("bucket")[0].as_py()], [parts], pa.array([_packed(gram[begin][again])], pa.binary())], ["bucket", "parts", "grams"])

    return blocks.groupBy("bucket").applyInArrow(run, "bucket long, parts long, grams binary")


def bundles_of_blocks(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """The bundles of each block of text by bucket: gram, digest of the surroundings, doc_id and place, packed."""

    def dealt(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*found, strict=True)]
        order = np.argsort(cols[0])
        cols = [c[order] for c in cols]
        names, cut = _by_bucket(cols[0], buckets)
        parts = -(-np.diff(cut) // (4 * (len(order) // buckets + 1024)))
        data = [_packed(*(c[i:j] for c in cols)) for i, j in zip(cut, cut[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(parts, pa.int64()), pa.array(data, pa.binary())], ["bucket", "parts", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for ids, keys, data, ends in _texts(batches):
            begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
            for doc, at, gram, around, far, near in anchors(data, ends, width):
                place = (keys[doc] << 44) + (at - begins[doc] << 12) + (far << 6) + near
                found.append((gram, around, ids[doc].view(np.uint64), place.view(np.uint64)))
                size += SEGMENT
                if size >= BLOCK:
                    yield dealt(found)
                    found, size = [], 0
        if found:
            yield dealt(found)

    dealt_rows = _named(docs, width).mapInArrow(run, "bucket long, parts long, data binary")
    # a block with so many of a bucket's bundles is dealt to any of as many parts
    return dealt_rows.withColumn("part", F.pmod(F.xxhash64("data"), F.col("parts"))).drop("parts")


def first_in_parts(bundles: DataFrame, grams: DataFrame) -> DataFrame:
    """Digit two in the parts of each bucket: ``(gram, around, doc_id, at, lost)`` of bundles with a repeated gram; lost
    (gram and around are null then) where an earlier document of the part has the same surroundings, else open: the part's first document."""
    schema = "gram long, around long, doc_id long, at long, lost boolean"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kept = [np.zeros((4, 0), np.uint64)]
        if right.num_rows:
            wanted = _unpacked(right.column("grams")[0].as_py(), 1)[0]
            for x in left.column("data") if len(wanted) else ():
                cols = _unpacked(x.as_py(), 4)
                i = np.minimum(np.searchsorted(wanted, cols[0]), len(wanted) - 1)
                kept.append(cols[:, wanted[i] == cols[0]])
        gram, around, doc, at = np.concatenate(kept, axis=1).view(np.int64)
        order = np.lexsort((doc, around, gram))
        gram, around, doc, at = (x[order] for x in (gram, around, doc, at))
        begin = _starts(gram, around)
        least = np.repeat(doc[begin], np.diff(np.append(begin, len(doc))))
        lost = doc > least
        return pa.table([pa.array(gram, mask=lost), pa.array(around, mask=lost), doc, at, lost], ["gram", "around", "doc_id", "at", "lost"])

    right = grams.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("bucket", "part", "grams")
    return bundles.groupBy("bucket", "part").cogroup(right.groupBy("bucket", "part")).applyInArrow(run, schema)


def _contexts(docs: DataFrame, width: int) -> DataFrame:
    """``docs(doc_id, key, text binary, open)`` -> a row for each open bundle with ``context``, the bytes from width - GRAM before
    its anchor to width after it (what lies beyond the text belongs to no string of the bundle)."""
    halo = width - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            open_ = batch.column("open")
            gram, at = (open_.flatten().field(c).to_numpy() for c in ("gram", "at"))
            ids, keys, data, ends = next(_texts(iter([batch])))
            data = np.concatenate([np.zeros(halo, np.uint8), data, np.zeros(width, np.uint8)])
            begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
            doc = np.repeat(np.arange(len(ids)), np.asarray(open_.value_lengths()))
            place = begins[doc] + (at >> 12 & 0xFFFFFFFF)
            for lo in range(0, len(gram), 20_000):
                part = slice(lo, lo + 20_000)
                rows = sliding_window_view(data, halo + width)[place[part]]
                context = pa.FixedSizeBinaryArray.from_buffers(pa.binary(halo + width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
                columns = [pa.array(x[part]) for x in (gram, ids[doc], keys[doc], at)]
                yield pa.RecordBatch.from_arrays([*columns, context], ["gram", "doc_id", "key", "at", "context"])

    return docs.mapInArrow(run, "gram long, doc_id long, key long, at long, context binary")


def _repeated_strings(deal: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, context: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bundle the nearest and farthest of its strings, by how far before the anchor they start, that an earlier
    document of its deal has; where there is none, the nearest is greater than the farthest.

    Strings are ordered by their bytes, eight at a time, the first ones first; after each pass, groups of one document drop out.
    """
    halo = width - GRAM
    words = np.ascontiguousarray(sliding_window_view(context, 8, axis=1)).view(">u8")[:, :, 0]
    back = np.arange(halo, -1, -1)  # column j: the string that starts at byte j of the context
    row, column = np.nonzero((back >= first[:, None]) & (back <= last[:, None]))
    group = np.unique(deal, return_inverse=True)[1][row] * (halo + 1) + column  # equal strings lie as far before their anchors
    for offset in (*range(0, width - 7, 8), width - 8):
        digit = words[row, column + offset].astype(np.uint64)
        order = np.lexsort((digit, group))
        row, column, group, digit = row[order], column[order], group[order], digit[order]
        begin = _starts(group, digit)
        if not len(begin):
            break
        size, own = np.diff(np.append(begin, len(row))), doc[row]
        open_ = np.repeat(np.minimum.reduceat(own, begin) < np.maximum.reduceat(own, begin), size)
        group, row, column = np.repeat(np.arange(len(begin)), size)[open_], row[open_], column[open_]
    near, far = np.full(len(deal), 63), np.full(len(deal), -1)
    if len(row):
        begin = _starts(group)
        lost = doc[row] > np.repeat(np.minimum.reduceat(doc[row], begin), np.diff(np.append(begin, len(row))))
        np.minimum.at(near, row[lost], halo - column[lost])
        np.maximum.at(far, row[lost], halo - column[lost])
    return near, far


def _solved(rows: DataFrame, width: int) -> DataFrame:
    """``rows(deal, doc_id, key, at, first, last, context)``, no deal of more than GROUP rows -> ``(doc_id, key, span)`` of lost bytes."""
    limit = 4 * GROUP

    def found(table: pa.Table) -> pa.RecordBatch:
        deal, doc, key, at, first, last = (table.column(c).to_numpy() for c in ("deal", "doc_id", "key", "at", "first", "last"))
        context = np.frombuffer(b"".join(table.column("context").to_pylist()), np.uint8).reshape(len(deal), -1)
        near, far = _repeated_strings(deal, doc, first, last, context, width)
        lost = far >= near
        place = at[lost] >> 12 & 0xFFFFFFFF
        span = (place - far[lost] << 32) + place - near[lost] + width
        return pa.RecordBatch.from_arrays([pa.array(doc[lost]), pa.array(key[lost]), pa.array(span)], ["doc_id", "key", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < limit:
                continue
            table = pa.Table.from_batches(held)
            deal = table.column("deal").to_numpy()
            whole = int(np.searchsorted(deal, deal[-1]))  # the last deal may go on
            if whole:
                yield found(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                size = table.num_rows - whole
        if held and size:
            yield found(pa.Table.from_batches(held))

    return rows.repartition("deal").sortWithinPartitions("deal").mapInArrow(run, "doc_id long, key long, span long")


def _third_digit(scratch: Scratch, rows: DataFrame, width: int) -> DataFrame:
    """``rows(gram, doc_id, key, at, context)``, one or more of a (gram, context) -> ``(doc_id, key, span)`` of lost bytes."""
    halo, out = width - GRAM, []
    place = {n: F.shiftright("at", PLACE[n][0]).bitwiseAND(F.lit(PLACE[n][1]).cast("long")) for n in ("near", "far")}
    rows = rows.select(F.col("gram").alias("deal"), "doc_id", "key", "at", place["near"].alias("first"), place["far"].alias("last"), "context")
    reach = halo + 1
    for level in range(3):  # the strings of a deal start at reach places before its anchor
        sizes = rows.groupBy("deal").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
        sizes = scratch.keep(sizes.select("deal", (F.col("n") > GROUP).alias("large")), f"deals{level}")
        known = rows.join(sizes, "deal")
        out.append(scratch.keep(_solved(known.where("not large").drop("large"), width), f"found{level}"))
        if sizes.where("large").isEmpty():
            return _union(out)
        reach = -(-reach // 2)
        ranges = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(min(i + reach - 1, halo)).alias("j")) for i in range(0, halo + 1, reach)]))
        parts = known.where("large").select("deal", "doc_id", "key", "at", "first", "last", "context", ranges.alias("r")).where("first <= r.j and last >= r.i")
        shared = F.expr(f"substring(context, {halo + 1} - r.i, {width} - (r.j - r.i))")  # what all strings of the range hold
        parts = parts.select(F.xxhash64("deal", "r.i", shared).alias("deal"), "doc_id", "key", "at", F.greatest("first", F.col("r.i").cast("long")).alias("first"), F.least("last", F.col("r.j").cast("long")).alias("last"), "context")
        rows = scratch.keep(parts, f"rows{level}")
    strings = rows.select("deal", "doc_id", "key", "at", F.explode(F.sequence("first", "last")).alias("back"), "context")
    strings = strings.select("doc_id", "key", "at", "back", F.expr(f"substring(context, {halo + 1} - cast(back as int), {width})").alias("string"))
    firsts = strings.groupBy("back", "string").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    begin = F.shiftright("at", 12).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")) - F.col("back")
    out.append(strings.join(firsts, ["back", "string"]).where("doc_id > lo").select("doc_id", "key", (F.shiftleft(begin, 32) + begin + width).alias("span")))
    return _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    first, *others = parts
    for x in others:
        first = first.unionByName(x)
    return first


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs(doc_id, key, text)`` -> ``(doc_id, key, spans array<long>)`` of the documents that lose bytes, written to the shared folder."""
    if not 48 <= width <= 64:
        raise ValueError("width must be from 48 to 64 bytes")
    scratch = Scratch(docs.sparkSession, "suffixes")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(total) * 2 // (width - GRAM + 2) // BUNDLES + 8
    grams = scratch.keep(repeated_grams(grams_of_blocks(docs, width, buckets)), "grams")
    found = scratch.keep(first_in_parts(bundles_of_blocks(docs, width, buckets), grams), "bundles")
    scratch.drop("grams")
    place = {n: F.shiftright("at", shift).bitwiseAND(F.lit(mask).cast("long")) for n, (shift, mask) in PLACE.items()}
    span = (F.shiftleft(place["byte"] - place["far"], 32) + place["byte"] - place["near"] + width).alias("span")
    open_ = found.where("not lost")
    firsts = scratch.keep(open_.groupBy("gram", "around").agg(F.min("doc_id").alias("lo")), "firsts")
    several = firsts.groupBy("gram").agg(F.count("*").alias("n"), F.min("lo").alias("a"), F.max("lo").alias("z")).where("n > 1 and a < z").select("gram", F.lit(True).alias("several"))
    marked = firsts.join(several, "gram", "left")
    judged = open_.join(marked, ["gram", "around"]).select("gram", "doc_id", "at", (F.col("doc_id") > F.col("lo")).alias("lost"), "several")
    judged = scratch.keep(judged.where("lost or several"), "judged")
    scratch.drop("firsts")
    whole = found.where("lost").select("doc_id", "at").unionByName(judged.where("lost").select("doc_id", "at"))
    whole = whole.select("doc_id", place["key"].alias("key"), span)

    by_doc = judged.where("not lost").groupBy("doc_id", place["key"].alias("key")).agg(F.collect_list(F.struct("gram", "at")).alias("open"))
    contexts = _contexts(_named(docs, width).join(by_doc, ["doc_id", "key"]).select("doc_id", "key", "text", "open"), width)
    parts = _third_digit(scratch, scratch.keep(contexts, "contexts"), width)
    spans = scratch.keep(whole.unionByName(parts).groupBy("doc_id", "key").agg(F.collect_set("span").alias("spans")), "spans")
    scratch.drop("bundles", "judged", "contexts", *[f"{x}{i}" for x in ("deals", "found", "rows") for i in range(3)])
    return spans


def suffix_report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256.

    A null text has no bytes. A row with a null doc_id keeps all and takes nothing from others. Rows of one doc_id
    don't affect each other; each is judged by its own text (524,288 different ones of an id at most, else an error). Texts shorter than width lose nothing, an empty table gives
    an empty result, other columns are ignored. A text is held whole by one task, its anchors a segment at a time.
    """
    slim = with_keys(docs.select("doc_id", "text"), "key", KEY_BITS)
    return digests(with_spans(slim, repeated_spans(slim, width), key="key"))
