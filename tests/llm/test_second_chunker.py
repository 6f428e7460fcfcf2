"""Substring dedup against a second chunker, which reads byte by byte, and a plain table of chunks."""

import hashlib
import random

from pyspark.sql import functions as F

from annulus.llm import substring_dedup as S


def slow_chunks(data, least=S.MIN_BYTES, most=S.MAX_BYTES):
    """(start, end) of each chunk: the hash of the last 16 bytes, newest lowest, ends one where its five upper bits are zero."""
    ends, n = [], len(data)
    for end in range(1, n):
        h = 0
        for b in data[max(0, end - 16) : end]:
            h = (h * 2 + int(S.GEAR[b])) & 0xFFFF
        if h < 1 << 11 and data[end] & 0xC0 != 0x80:
            ends.append(end)
    out, last = [], 0
    for end in [*ends, n]:
        while end - last > most:
            cut = last + most
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append((last, cut))
            last = cut
        if end - last >= least:
            out.append((last, end))
            last = end
    return out + ([(last, n)] if last < n else [])


def slow_report(docs, run=S.MIN_RUN):
    first = {}
    for i, text in docs:
        data = (text or "").encode()
        for a, b in slow_chunks(data) if i is not None else ():
            first[data[a:b]] = min(i, first.get(data[a:b], i))
    out = []
    for i, text in docs:
        data = (text or "").encode()
        runs = []
        for a, b in slow_chunks(data) if i is not None else ():
            if first[data[a:b]] < i:
                if runs and runs[-1][1] == a:
                    runs[-1] = (runs[-1][0], b)
                else:
                    runs.append((a, b))
        runs = [r for r in runs if r[1] - r[0] >= run]
        kept = b"".join(data[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(data)], strict=True))
        out.append((i, len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def test_report_equals_a_second_chunker(spark):
    r = random.Random(8)
    words = ["the", "quick", "ünï", "日本語", "brown", "x", "over", "lazy", "0123456789", "\n", "😀"]
    passage = lambda n: " ".join(r.choices(words, k=n))
    shared = [passage(60) for _ in range(6)]
    docs = [(i, passage(r.randint(0, 30)) + "".join(r.choice(shared) + passage(r.randint(0, 9)) for _ in range(r.randint(0, 4)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "a" * 5000), (103, "a" * 5000 + "b"), (104, "é" * 1500), (105, "日" * 1500), (3, docs[3][1]), (None, docs[5][1]), (106, shared[0] * 40), (2, "another text of one id " + shared[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("x")).repartition(5)
    got = [tuple(x) for x in S.substring_report(df).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(got, key=key) == sorted(slow_report(docs), key=key) and sum(x[2] > 0 for x in got) > 20
    for _, text in docs:
        data = (text or "").encode()
        assert S.chunk_ends(data) == [b for _, b in slow_chunks(data)]
