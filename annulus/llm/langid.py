"""Language by compression: a text belongs to the language whose zstandard dictionary makes it smallest.

Each language's dictionary is raw content: letters of labelled training rows, a bounded sample (``rows`` rows of
``row_bytes`` bytes at most for each language: texts of ``LONG`` characters first, then shorter ones, each by the order
of a hash of the id, so that every language with a labelled text that has a letter is learned). A whole text is compressed in parts
of about ``PART`` bytes, each with every language's dictionary. The smallest size wins a part; how far the others are behind, on a
scale of ``SCALE`` bytes, divides its vote. The score is the winner's share of votes, the margin its lead.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.llm.common import first_by_hash, free_names, id_hash, text_key

ROWS, ROW_BYTES, PART, LEVEL = 512, 512, 512, 3
SCALE, MARGIN, UNKNOWN, LONG = 6.0, 0.02, "und", 200
LETTER, OTHER = regex.compile(r"\p{L}"), regex.compile(r"\P{L}+")
OTHER_LATIN = re.compile(r"[\W\d_²³¹¼-¾]+")  # the same for texts without characters beyond U+00FF, faster
NAMES = ("lang_pred", "score", "margin", "rejected")


def letters(text: str) -> bytes:
    """The text in lower case, with a space for each run of anything but letters."""
    return (OTHER_LATIN if max(text, default="") <= "ÿ" else OTHER).sub(" ", text.lower()).encode("utf-8", "replace")


def fit(docs: DataFrame, training: Column, rows: int = ROWS, row_bytes: int = ROW_BYTES) -> dict[str, bytes]:
    """Dictionary content by language, from the training rows of ``docs(doc_id, text, lang)`` with text and lang.

    At most ``rows`` rows for each language and ``row_bytes`` bytes of each come to the driver; ids are picked first,
    without texts. Repeated rows count once; rows of one doc_id with other texts are rows like any others, those of a null
    doc_id are not learned from.
    """
    known = docs.where(training & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("own", text_key())
    each = known.select("doc_id", "lang", "own", (F.length("text") < LONG).alias("brief")).dropDuplicates(["doc_id", "lang", "own"])
    picked = first_by_hash(each, "lang", rows, before=("brief",), after=("own",))
    ids = F.broadcast(picked.select("doc_id", "lang", "own", "r"))  # rows for each language, at most
    found = known.join(ids, ["doc_id", "lang", "own"]).select("doc_id", "lang", "own", "r", F.substring("text", 1, row_bytes).alias("text"))
    out: dict[str, list[tuple]] = {}
    for x in found.dropDuplicates(["doc_id", "lang", "own"]).collect():  # as many as ids
        out.setdefault(x.lang, []).append((x.r, x.text))
    return {lang: b" ".join(letters(t)[:row_bytes] for _, t in sorted(texts)[:rows]) for lang, texts in sorted(out.items())}


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    book = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    book.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False)


class Classifier:
    def __init__(self, books: dict[str, bytes], margin: float = MARGIN):
        self.langs, self.margin = sorted(books), margin
        self.books = [_compressor(books[x]) for x in self.langs]

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin and whether it is rejected."""
        if not text or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        data = letters(text)
        if len(self.langs) == 1:
            return self.langs[0], 1.0, 1.0, False
        votes, n = [0.0] * len(self.langs), len(data)
        count = max(1, round(n / PART))  # parts of nearly equal length
        for i in range(count):
            part = data[n * i // count : n * (i + 1) // count]
            sizes = [len(own.compress(part)) for own in self.books]
            least = min(sizes)
            shares = [math.exp((least - s) / SCALE) for s in sizes]
            whole = sum(shares) * count
            votes = [v + s / whole for v, s in zip(votes, shares, strict=True)]
        best = max(range(len(votes)), key=votes.__getitem__)
        margin = votes[best] - max(v for i, v in enumerate(votes) if i != best)
        return self.langs[best], votes[best], margin, margin < self.margin


def predict(docs: DataFrame, books: dict[str, bytes], margin: float = MARGIN, names: tuple[str, ...] = NAMES) -> DataFrame:
    """docs with lang_pred, score, margin and rejected (or four other names); nothing but ``text`` is looked at.

    Null texts and texts without a letter are ``und`` and rejected, as is everything where nothing was learned. Where
    margins are below ``margin``, the best language is still named, and rejected is true. Sizes that tie: the first
    language by name. Columns of docs with one of the four names are replaced, all others come back as they were.
    Rows are judged one by one, so repeated rows and null ids change nothing; an empty table gives an empty result. A
    text of any length is held whole by one task and compressed part by part.
    """
    kept = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(books)  # bounded by fit
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(shared.value, margin)
        for batch in batches:
            found = [own.classify(t) for t in batch.column("text").to_pylist()]
            lang, score, gap, no = zip(*found, strict=True) if found else [()] * 4
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()), pa.array(no, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*kept, *names])

    new = ", ".join(f"`{n}` {t}" for n, t in zip(names, ("string", "double", "double", "boolean"), strict=True))
    return docs.select(*kept).mapInArrow(run, f"{schema}, {new}")


def held_out(parts: int, part: int) -> Column:
    """The rows that are not learned from: crc32 of the id as text, modulo parts, is part."""
    return F.pmod(id_hash(), F.lit(parts)) == part


def keep_known(docs: DataFrame, training: Column | None = None, margin: float = MARGIN) -> DataFrame:
    """The rows of docs whose language is told with enough margin; columns as they were. Learns from docs' own lang.

    Null texts and texts without a letter go; of repeated rows all stay or go. An empty table gives an empty result.
    """
    training = ~held_out(4, 2) if training is None else training
    names = free_names(docs, *NAMES)
    found = predict(docs, fit(docs.select("doc_id", "text", "lang"), training), margin, tuple(names))
    return found.where(~F.col(names[3])).select(*docs.columns)
