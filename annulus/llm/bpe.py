"""Byte-level BPE by backtracking, with exact merges in linear time.

The vocabulary's byte strings, written as Latin-1, form an Aho-Corasick automaton that finds the longest token at
every place of a piece in one pass. The encoder takes the longest token that may stand next to the last one,
shortens it while it may not, and steps back where none may. Two adjacent tokens may stand where merging would not
have joined bytes across their border earlier than inside them; this is decided by undoing merges, and memoised.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.llm.pretokens import split

CACHE, PAIRS = 600_000, 1_000_000


class Bpe:
    """Encoder of a rank file's text: a line per token, base64 bytes and rank. Ranks follow the order of merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.word = {v: k for k, v in self.rank.items()}
        self.prefix: dict[int, int | None] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.may: dict[tuple[int, int], bool] = {}
        for rank in sorted(self.word):
            w = self.word[rank]
            self.prefix[rank] = next((self.rank[w[:i]] for i in range(len(w) - 1, 0, -1) if w[:i] in self.rank), None)
        for rank in sorted(self.word):
            w, left = self.word[rank], self.prefix[rank]
            self.parts[rank] = (rank, rank)
            while left is not None:
                right = self.rank.get(w[len(self.word[left]) :])
                if right is not None and left < rank and right < rank and self._may(left, right):
                    self.joined[left, right] = rank
                    self.parts[rank] = (left, right)
                    break
                left = self.prefix[left]
        self.may.clear()
        self.automaton = ahocorasick.Automaton()
        for w, rank in self.rank.items():
            self.automaton.add_word(w, rank)
        self.automaton.make_automaton()

    def _may(self, a: int, b: int) -> bool:
        """Whether b may follow a: undo the later merge of the two, again and again, watching the border."""
        limit = 1 << 60
        while True:
            if self.joined.get((a, b), limit) < limit:
                return False
            for undo_left in (True, False) if a > b else (False, True):
                if undo_left and self.parts[a][1] != a:
                    limit, a = a, self.parts[a][1]
                    break
                if not undo_left and self.parts[b][0] != b:
                    limit, b = b + 1, self.parts[b][0]
                    break
            else:
                return True

    def allowed(self, a: int, b: int) -> bool:
        known = self.may.get((a, b))
        if known is None:
            if len(self.may) >= PAIRS:
                self.may.clear()
            known = self.may[a, b] = self._may(a, b)
        return known

    def encode(self, piece: str) -> list[int]:
        """The ids of one match of the pattern, given as Latin-1 characters of its bytes."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        greedy = [rank for _, rank in self.automaton.iter_long(piece)]  # where all may stand so, no step back is needed
        if all(map(self.allowed, greedy, greedy[1:])) and sum(map(len, map(self.word.__getitem__, greedy))) == len(piece):
            return greedy
        n = len(piece)
        longest: list[int | None] = [None] * (n + 1)
        width = [0] * (n + 1)
        for end, rank in self.automaton.iter(piece):
            size = len(self.word[rank])
            start = end + 1 - size
            if size > width[start]:
                longest[start], width[start] = rank, size
        open_ends = bytearray(b"\1" * (n + 1))
        out: list[int] = []
        at, token = 0, longest[0]
        while token is not None:
            last = out[-1] if out else None
            while True:
                end = at + len(self.word[token])
                if open_ends[end] and (last is None or self.allowed(last, token)):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                token = self.prefix[token]
                if token is None:
                    open_ends[at] = 0
                    if last is None:
                        raise ValueError("the vocabulary lacks a byte")
                    out.pop()
                    at, token = at - len(self.word[last]), last
                    break
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(2)
def load(path: str) -> Bpe:
    """One for each worker process."""
    return Bpe(read_ranks(path))


class Ids(dict):
    """Decimal ids of pieces, each followed by a space; at most CACHE are kept."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> str:
        if len(self) >= CACHE:
            self.clear()
        ids = "".join(f"{i} " for i in self.bpe.encode(piece.encode("utf-8", "replace").decode("latin-1")))
        if len(piece) < 200:
            self[piece] = ids
        return ids


@lru_cache(2)
def _ids(path: str) -> Ids:
    return Ids(load(path))


@lru_cache(2)
def _bytes(path: str) -> dict[str, bytes]:
    return {str(rank): w.encode("latin-1") for rank, w in load(path).word.items()}


def encode_text(text: str | None, path: str, pattern: str) -> str:
    """The decimal ids of a whole text, joined by single spaces."""
    return "".join(map(_ids(path).__getitem__, split(text or "", pattern)))[:-1]


def decode_ids(ids: str, path: str) -> bytes:
    return b"".join(map(_bytes(path).__getitem__, ids.split()))


def token_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """For each row of docs: doc_id, n_tokens, ids_sha256 and decoded_sha256. A null text is empty: no tokens.

    Rows are taken one by one, so repeated rows, null ids and other columns change nothing. An empty table gives an empty
    result. A text of any length is encoded piece by piece, its ids held by one task as one string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                ids = encode_text(text, path, pattern)
                rows.append((ids.count(" ") + 1 if ids else 0, sha(ids.encode()), sha(decode_ids(ids, path))))
            n, a, b = zip(*rows, strict=True) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [list(map(int, encode_text(t, path, pattern).split())) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` -> ``(doc_id, bytes binary)``; a null list gives no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [decode_ids(" ".join(map(str, x or ())), path) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")
