"""Texts of over a megabyte in the operators that hold a text whole."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from annulus.llm import bpe, near_copies, packing, simhash, substring_dedup
from tests.llm.test_second_chunker import slow_report
from tests.llm.test_texts import ENCODING, RANKS, VOCAB, P

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def long_texts():
    r = random.Random(31)
    words = ["alpha", "Beta", "gamma,", "ünï", "日本", "12", "don't", "\n", "x" * 30]
    base = r.choices(words, k=220_000)
    near = list(base)
    for i in range(0, len(near), 997):
        near[i] = "other"
    return [" ".join(base), " ".join(near), "ab" * 600_000, " ".join(f"w{r.randrange(5000)}" for _ in range(220_000))]


def test_long_texts(spark, long_texts):
    assert all(len(t.encode()) > 1_000_000 for t in long_texts)
    docs = spark.createDataFrame([*enumerate(long_texts), (9, "short")], SCHEMA).repartition(5, "doc_id")
    rows = [*enumerate(long_texts), (9, "short")]
    few = docs.where("doc_id in (0, 1, 9)")
    assert sorted(tuple(x) for x in substring_dedup.substring_report(few).collect()) == sorted(slow_report([*rows[:2], rows[4]]))
    assert sorted(x.doc_id for x in near_copies.drop_near_copies(docs).collect()) == [0, 2, 3, 9]
    for x in simhash.with_fingerprints(docs).collect():
        found = rows[x.doc_id if x.doc_id < 4 else 4][1].encode().lower().split()
        grams = [b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
        bits = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64)
        want = sum(1 << k for k in range(64) if 2 * int((bits >> np.uint64(k) & np.uint64(1)).sum()) > len(grams))
        assert x.fp & ((1 << 64) - 1) == want
    for x in bpe.token_report(docs, RANKS, P.PATTERN).collect():
        text = rows[x.doc_id if x.doc_id < 4 else 4][1]
        if "ab" * 1000 not in text:  # the reference library takes very long for one piece of a megabyte
            ids = ENCODING.encode_ordinary(text)
            assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_long_texts_are_packed_whole(spark, long_texts):
    texts = [long_texts[0], long_texts[3]]
    tok = Tokenizer.from_file(VOCAB)
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), SCHEMA), VOCAB, P.PATTERN, added=True).collect()
    for i, text in enumerate(texts):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        own = sorted((x.start, x.length, x.ids_crc32) for x in rows if x.doc_id == i)
        assert sum(x[1] for x in own) == len(ids) and own[0][0] == 0
        for start, length, crc in own:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
