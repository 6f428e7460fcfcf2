"""Spelling variants by pivotal grams: words one edit apart meet on a rare bigram, then are verified.

Bigrams are ordered by their number in all words, rarest first. A word's prefix is its first three bigrams in this order (and
what ties with the third); of these, two that don't overlap are its pivots, those of the least total number, chosen by dynamic
programming. One edit destroys one of two pivots at most. So of two words one edit apart, the one whose prefix ends first has
a pivot that the other holds in its prefix, and as there is but one edit, it lies wholly before or wholly behind it: either what is left
of the gram is the same in both, place included, or what is right of it is. Pivots are indexed by gram, side and what is on that side,
the other words' prefixes are looked up there, and lengths and edit distance are checked. Where that side has few letters, many words
share it; there the key also holds a half of the other side, which holds the edit: one of its halves is without.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.llm.common import Scratch

LEAST_LENGTH, LEAST_TIMES, FLUSH, SHORT = 5, 3, 200_000, 4
EDITS, GRAM = 1, 2
#: Latin-1 bytes outside A-Z, a-z and C0 to FF become spaces, A-Z lower case; what Latin-1 lacks is encoded as a question mark.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
ENTRIES = "word string, length int, ends_n long, ends_gram string, is_pivot boolean, key long"


def document_words(doc_id: int | None, text: str | None, every: int = 97) -> Counter[str]:
    """The runs of letters of a whole text with their numbers; a run is lower-cased, and where its checksum with the
    doc_id says so, one code point is left out. A null doc_id is written as nothing."""
    lead = f"{'' if doc_id is None else doc_id}:".encode()
    out: Counter[str] = Counter()
    for raw, n in Counter((text or "").encode("latin-1", "replace").translate(PLAIN).split()).items():
        word = raw.decode("latin-1")
        h = zlib.crc32(lead + word.encode())
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def vocabulary(docs: DataFrame, length: int = LEAST_LENGTH, times: int = LEAST_TIMES) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(word, n)``: words of so many code points and occurrences, at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: Counter[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word, n in document_words(doc_id, text).items():
                    if len(word) >= length:
                        held[word] += n
                if len(held) > FLUSH:
                    yield out(held)
                    held.clear()
        yield out(held)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def pivots(grams: list[tuple[int, int]], count: int = EDITS + 1) -> list[int]:
    """Of ``grams(place, number)``, by place, the places of ``count`` that don't overlap and whose numbers add up to the least."""
    best: list[list[tuple[int, list[int]] | None]] = [[(0, [])] + [None] * count]
    for i, (place, number) in enumerate(grams):
        row = list(best[-1])
        before = best[max((j + 1 for j in range(i) if grams[j][0] + GRAM <= place), default=0)]
        for c in range(1, count + 1):
            if before[c - 1] is not None and (row[c] is None or before[c - 1][0] + number < row[c][0]):
                row[c] = before[c - 1][0] + number, [*before[c - 1][1], place]
        best.append(row)
    return best[-1][count][1] if best[-1][count] else []


def _halves(rest: str, length: int) -> list[str]:
    """Of what is one edit from a string of that length: its share of that string's first half, and of the second."""
    first, second = length // 2, length - length // 2
    return [f"a{length}:{rest[:first]}", *([f"b{length}:{rest[len(rest) - second :]}"] if second <= len(rest) else [])]


def entries(word: str, number: dict[str, int]) -> tuple[tuple[int, str], list[tuple[bool, int]]]:
    """Where the word's prefix ends, and the keys of its grams, as a prefix gram (False) and, where it is one, as a pivot (True)."""
    ordered = sorted((number[word[i : i + GRAM]], word[i : i + GRAM], i) for i in range(len(word) - GRAM + 1))
    last = ordered[min(GRAM * EDITS, len(ordered) - 1)][:2]
    prefix = [x for x in ordered if x[:2] <= last]
    chosen = set(pivots(sorted((i, n) for n, _, i in prefix)))
    keys = []
    for *_, i in prefix:
        for side, same, rest in (("<", word[: i + GRAM], word[i + GRAM :]), (">", word[i:], word[:i])):
            n = len(rest)
            lengths = (n - 1, n, n + 1) if n else (0, 1)  # that the other word may have there
            keys += [(False, f"{side}{same}{half}") for half in (_halves(rest, n) if len(same) <= SHORT else [""])]
            if i in chosen:
                keys += [(True, f"{side}{same}{half}") for half in ([h for k in lengths for h in _halves(rest, k)] if len(same) <= SHORT else [""])]
    return last, [(pivot, xxhash.xxh64_intdigest(key.encode()) - (1 << 63)) for pivot, key in keys]


def near_pairs(words: DataFrame) -> DataFrame:
    """``words(word)``, distinct, all of three bigrams or more -> ``(a, b)`` with a < b: all pairs one edit apart, each once."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1), lambda i: F.substr("word", i, F.lit(GRAM)))
    counted = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    number = {x.gram: x.n for x in counted.collect()}  # pairs of letters: 90 * 90 at most for this alphabet
    shared = words.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word in batch.column("word").to_pylist():
                (n, gram), found = entries(word, shared.value)
                rows += [(word, len(word), n, gram, pivot, key) for pivot, key in found]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in ENTRIES.split(", ")])

    scratch = Scratch(words.sparkSession, "pivots")
    dealt = scratch.keep(words.select("word").mapInArrow(run, ENTRIES), "entries")
    p = dealt.where("is_pivot").select(F.col("word").alias("p"), F.col("length").alias("p_length"), F.struct("ends_n", "ends_gram").alias("p_ends"), "key")
    q = dealt.where("not is_pivot").select(F.col("word").alias("q"), F.col("length").alias("q_length"), F.struct("ends_n", "ends_gram").alias("q_ends"), "key")
    met = p.join(q, "key").where((F.abs(F.col("p_length") - F.col("q_length")) <= EDITS) & (F.col("p_ends") <= F.col("q_ends")) & (F.col("p") != F.col("q")))
    near = met.where(F.levenshtein("p", "q", EDITS) == EDITS)
    return near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """``forms(word, form)`` -> ``(word, root)`` of those with a form; each round jumps twice as far along the forms."""
    up, done = scratch.keep(forms.where("form is not null").select("word", F.col("form").alias("root")), "root0"), 0
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch.keep(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), f"root{done + 1}")
        scratch.drop(f"root{done}")
        done += 1
        if moved.where("open").isEmpty():
            return moved.select("word", "root")
        up = moved.select("word", "root")


def spelling_variants(docs: DataFrame, length: int = LEAST_LENGTH, times: int = LEAST_TIMES) -> DataFrame:
    """The words of ``docs(doc_id, text)`` with the more usual word each may be a variant of: word, form, root, n, n_near, form_n.

    form: of the words one inserted, deleted or replaced code point away, the one of largest n (ties: the first in code-point order), if
    that n is twice the word's n or more; else null. root: the last word that forms lead to, the word itself without any. n_near: how many
    words are one edit away. Null and empty texts have no words; texts of any length are split whole by one task; repeated rows count each;
    a null doc_id is taken as empty in the checksum. Other columns are ignored; an empty table gives an empty result. ``length`` must be 4 or more.
    """
    if length < GRAM * EDITS + GRAM:
        raise ValueError("words must have three bigrams")
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(vocabulary(docs, length, times), "words")
    pairs = scratch.keep(near_pairs(words), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    best = F.min(F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("word")))
    near = both.join(other, "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    form = F.when(-F.col("best.n") >= 2 * F.col("n"), F.col("best.word"))
    named = words.join(near, "word", "left").select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), -F.col("best.n")).alias("form_n"))
    named = scratch.keep(named, "named")
    roots = _roots(scratch, named)
    scratch.drop("words", "pairs")
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
