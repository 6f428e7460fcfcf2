"""SimHash, chunk and suffix dedup against brute force on small tables."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from annulus.llm.components import connected_components
from annulus.llm.simhash import close_fingerprints, drop_near_copies, fingerprint, hex_fingerprint, simhash_components
from annulus.llm.substring_dedup import chunk_ends, substring_dedup, substring_report
from annulus.llm.suffix_dedup import suffix_report

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rooted(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def sample_texts(seed=1, n=60):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeéß", k=r.randint(2, 9))) for _ in range(300)]
    passage = " ".join(r.choices(words, k=60))
    texts = [None, "", " \n\t", "one", "ONE", "two words", "a" * 3000, "a" * 2500]
    for i in range(n):
        t = " ".join(r.choices(words, k=r.choice([3, 20, 120])))
        if i % 3 == 0:
            t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        texts.append(t)
    texts += [texts[-1], texts[-1].upper(), texts[-2] + " more", texts[-5]]
    texts.append(" ".join(r.choices(words, k=9000)) + passage)
    return texts


def as_docs(spark, texts):
    rows = [(i * 3 + 1, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, texts[-1], None, None, None), rows[-1], rows[min(9, len(rows) - 1)]], DOCS)


def slow_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(100, 400)] + [(7, x) for x in range(1000, 1300)] + [(r.randint(2000, 2400), r.randint(2000, 2400)) for _ in range(300)] + [(5, 5)]
    got = {x.node: x.component for x in connected_components(spark, spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    want = rooted(links, {x for e in links for x in e})
    assert got == {k: v for k, v in want.items() if k in got} and set(want) - set(got) <= {k for k in want if want[k] == k}
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(spark):
    texts = sample_texts()
    docs = as_docs(spark, texts)
    rows = simhash_components(docs.withColumn("component_id", docs.doc_id).withColumn("fp", docs.text)).withColumn("hex", hex_fingerprint(F.col("fp"))).collect()
    fps = {i * 3 + 1: slow_fingerprint(t) for i, t in enumerate(texts)}
    want = rooted([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2], fps)
    assert len(rows) == len(texts) + 3
    for x in rows:
        assert x.component_id == want.get(x.doc_id)
        assert x.doc_id is None or x.fp & (1 << 64) - 1 == fps[x.doc_id] == int(x.hex, 16)
    assert fingerprint(None) == fingerprint(" \n") == 0
    kept = drop_near_copies(docs)
    assert sorted(x.doc_id for x in kept.where("doc_id is not null").collect()) == sorted(k for k, v in want.items() if k == v)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert simhash_components(docs.limit(0)).count() == 0 and drop_near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("small", [1, 3, 64])
def test_close_fingerprints_in_hot_buckets(spark, small):
    r = random.Random(small)
    fps = {0, 1, 3, 7, 15}
    base = r.getrandbits(63)
    for _ in range(40):
        fps.add(base ^ sum(1 << r.randrange(62) for _ in range(r.randint(0, 2))))
        fps.add(r.getrandbits(63))
    got = close_fingerprints(spark, spark.createDataFrame([(x,) for x in fps], "fp long"), small_bucket=small).collect()
    assert all((x.a ^ x.b).bit_count() <= 2 for x in got)
    assert rooted([(x.a, x.b) for x in got], fps) == rooted([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2], fps)


def cut_slowly(texts, width):
    datas = {i * 3 + 1: (t or "").encode() for i, t in enumerate(texts)}
    first = {}
    for i in sorted(datas):
        for s in range(len(datas[i]) - width + 1):
            first.setdefault(datas[i][s : s + width], i)
    out = {}
    for i, data in datas.items():
        gone = bytearray(len(data))
        for s in range(len(data) - width + 1):
            if first[data[s : s + width]] < i:
                gone[s : s + width] = b"\1" * width
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), len([1 for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("width", [50, 64])
def test_suffix_report(spark, width):
    texts = sample_texts(width)
    want = cut_slowly(texts, width)
    rows = suffix_report(as_docs(spark, texts).withColumn("key", F.lit("x")).withColumn("spans", F.lit(1)), width).collect()
    assert len(rows) == len(texts) + 3
    for x in rows:
        if x.doc_id is None:
            assert x.n_removed == 0 and x.n_bytes > 0
        else:
            assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want[x.doc_id]
    assert sum(v[1] for v in want.values()) > 5000
    assert suffix_report(as_docs(spark, texts).limit(0), width).count() == 0


def test_chunks_follow_the_content():
    r = random.Random(5)
    data = " ".join("".join(r.choices("abcdefgé", k=5)) for _ in range(4000)).encode()
    ends = chunk_ends(data)
    assert ends[-1] == len(data) and all(b > a for a, b in zip(ends, ends[1:], strict=False))
    pieces = {data[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    for p in pieces:
        p.decode()
    moved = b"inserted here " + data
    again = chunk_ends(moved)
    assert len(pieces & {moved[a:b] for a, b in zip([0, *again], again, strict=False)}) > 0.98 * len(pieces)
    assert chunk_ends(b"") == [] and chunk_ends(b"x") == [1] and max(b - a for a, b in zip([0, *chunk_ends(b"a" * 5000)], chunk_ends(b"a" * 5000), strict=False)) <= 512


def test_substring_dedup(spark):
    texts = sample_texts(9)
    docs = as_docs(spark, texts)
    out = {x.doc_id: x for x in substring_report(docs).collect()}
    with_passage = [i * 3 + 1 for i in range(8, 68) if (i - 8) % 3 == 0]
    assert all(out[i].n_removed > 100 for i in with_passage[1:]) and out[with_passage[0]].n_removed == 0
    exact = {i: v[1] for i, v in cut_slowly(texts, 50).items()}
    assert all(out[i].n_removed <= exact[i] + 100 for i in exact if out[i].n_removed)  # only what repeats goes
    assert all(out[i].n_removed == 0 for i in exact if exact[i] == 0)
    cut = substring_dedup(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    for x in cut.where("doc_id is not null").collect():
        assert hashlib.sha256((x.text or "").encode()).hexdigest() == out[x.doc_id].kept_sha256 and (x.text is None or x.n_chars == len(x.text))
    assert substring_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("small", [2, 64])
def test_pipeline_drops_near_copies_of_similarity_08(spark, sf_dir, small, monkeypatch):
    import corpus_pipeline
    from annulus.llm import near_copies

    monkeypatch.setattr(near_copies.drop_near_copies, "__defaults__", (near_copies.WORDS, near_copies.SIMILARITY, small))
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    texts = [None, "", "one two", "ONE  two", "one two three"]
    for group in range(12):
        base = [word() for _ in range(200)]
        texts.append(" ".join(base))
        for changes in (0, 1, 2, 4, 5, 7, 12, 25):
            own = list(base)
            for at in r.sample(range(200), changes):
                own[at] = word()
            texts.append(" ".join(own))
    for _ in range(40):  # a large group: each shares all but its last words with the first
        texts.append(" ".join([*base[:190], *[word() for _ in range(r.choice([2, 9, 20, 45]))]]))
    r.shuffle(texts)

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for t in texts]
    close = [(a * 3 + 1, b * 3 + 1) for b in range(len(texts)) for a in range(b) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = rooted(close, [i * 3 + 1 for i in range(len(texts))])
    kept = corpus_pipeline.near_dedup(spark, as_docs(spark, texts), sf_dir)
    got = [x.doc_id for x in kept.select("doc_id").collect()]
    assert sorted(x for x in got if x is not None) == sorted(k for k, v in want.items() if k == v)
    assert got.count(None) == 1 and kept.columns == as_docs(spark, texts).columns
    assert corpus_pipeline.near_dedup(spark, kept.limit(0), sf_dir).count() == 0


def test_suffix_report_of_hot_grams_and_a_long_text(spark, monkeypatch):
    from annulus.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "GROUP", 8)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 997)
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(3, 7)))
    phrase = "a common phrase of more than thirty bytes that is everywhere"
    texts = [" ".join([word(), word(), phrase[: r.randint(26, 60)], word(), word(), word(), word()]) for _ in range(150)]
    texts += [" ".join(word() for _ in range(6)) + phrase + " ".join(word() for _ in range(3)) for _ in range(40)]
    texts += ["x" * 49, "x" * 50, "x" * 200, "ab" * 300, "ä" * 60]
    want = cut_slowly(texts, 50)
    rows = suffix_report(as_docs(spark, texts), 50).where("doc_id is not null").collect()
    assert all((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want[x.doc_id] for x in rows)
    assert sum(v[1] > 0 for v in want.values()) > 20


def test_anchors_of_segments_are_those_of_the_whole():
    import numpy as np

    from annulus.llm import suffix_dedup

    r = random.Random(4)
    texts = ["".join(r.choices("abcd ", k=n)).encode() for n in (12_000_000, 50, 70, 3, 0, 400_000)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    got = list(suffix_dedup.anchors(data, ends, 50))
    assert len(got) > 40
    doc, at, gram, around, far, near = (np.concatenate(x) for x in zip(*got, strict=True))
    begins = ends - [len(t) for t in texts]
    first, last = at - begins[doc] - far, at - begins[doc] - near
    assert (first >= 0).all() and (last + 50 <= np.diff(np.append(0, ends))[doc]).all() and (far < 27).all()
    held = np.zeros(len(data) + 1, np.int64)  # every string of 50 bytes is owned
    np.add.at(held, at - far, 1)
    np.add.at(held, at - near + 1, -1)
    held = np.cumsum(held)
    for begin, t in zip(begins, texts, strict=True):
        assert (held[begin : begin + max(0, len(t) - 49)] > 0).all()


@pytest.mark.parametrize("rounds", [0, 1])
def test_near_copies_among_texts_with_a_common_passage(spark, rounds, monkeypatch):
    from annulus.llm import near_copies

    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    r = random.Random(rounds)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(40):
        own = [word() for _ in range(r.choice([10, 30, 60]))]
        texts.append(" ".join(passage + own))
        if r.random() < 0.5:
            texts.append(" ".join([*passage, *own, *[word() for _ in range(r.randint(1, 20))]]))
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = [i for i, root in rooted(links, range(len(texts))).items() if i == root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_copies.drop_near_copies(docs, small_bucket=2).collect()
    assert sorted(x.doc_id for x in got) == want and 10 < len(links) < 400 and len(want) > 20


def test_near_dedup_links_close_fingerprints(spark, sf_dir, monkeypatch):
    import corpus_pipeline
    from annulus.llm import near_copies

    monkeypatch.setattr(near_copies, "_all_pairs", lambda rows, similarity: rows.select(F.col("uid").alias("a"), F.col("uid").alias("b"), F.col("n").alias("m")).limit(0))
    r = random.Random(5)
    base = ["".join(r.choices("abcdefgh", k=6)) for _ in range(3000)]
    texts = [" ".join(base), " ".join([*base, "more"]), " ".join(reversed(base))]
    assert (fingerprint(texts[0]) ^ fingerprint(texts[1])).bit_count() <= 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == [0, 2]


def test_rare_pairs_of_loosely_similar_texts(spark):
    from annulus.llm import near_copies
    from annulus.llm.common import Scratch

    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    base, texts = [word() for _ in range(150)], []
    for _ in range(80):
        own = list(base)
        for at in r.sample(range(150), r.choice([1, 2, 4, 5, 6])):
            own[at] = word()
        texts.append(" ".join(own))
    sets = [near_copies.shingles(t) for t in texts]
    alike = lambda x, y: len(set(x.tolist()) & set(y.tolist())) / len(set(x.tolist()) | set(y.tolist()))
    close = {(i, j) for i in range(80) for j in range(i + 1, 80) if alike(sets[i], sets[j]) >= 0.8}
    rows = spark.createDataFrame([(i, len(x), i) for i, x in enumerate(sets)], "uid long, n long, root long")
    own = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "uid long, own binary")
    pairs = near_copies._rare_pairs(Scratch(spark, "test"), rows, own, 0.8).collect()
    assert close <= {(x.a, x.b) for x in pairs} and 100 < len(close)
    assert len(pairs) < len(close) + 300  # all pairs are 3160


def test_near_dedup_measures_no_pairs_of_texts_joined_meanwhile(spark, monkeypatch):
    from annulus.llm import near_copies
    from annulus.llm.common import Scratch

    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    texts = []
    for _ in range(3):  # each text a few words off an earlier one of its group: few pairs are similar, most are joined
        group = [[word() for _ in range(150)]]
        for _ in range(59):
            own = list(r.choice(group[-8:]))
            for at in r.sample(range(150), 2):
                own[at] = word()
            group.append(own)
        texts += [" ".join(x) for x in group]
    sets = [near_copies.shingles(t) for t in texts]
    alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    every = [(i, j, alike(i, j)) for i in range(180) for j in range(i + 1, 180) if i // 60 == j // 60]

    def groups(links):
        root = list(range(180))
        while any(root[i] != root[j] for i, j in links):
            for i, j in links:
                root[i] = root[j] = min(root[i], root[j])
        return root

    asked, measured = [], near_copies._measured

    def counted(pairs, sets):
        asked.append(pairs.count())
        return measured(pairs, sets)

    monkeypatch.setattr(near_copies, "_measured", counted)
    rows = [(i, j, len(sets[j]), i, j, 0.0 if (i + j) % 9 == 0 else round(a, 1)) for i, j, a in every]  # coarse, some not told at all
    pairs = spark.createDataFrame(rows, "a long, b long, m long, root long, other long, like double")
    own = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "uid long, own binary")
    start = spark.createDataFrame([(0, 0), (1, 0)], "node long, component long")
    told = pairs.replace(1, 0, ["root", "other"]).where("root <> other")
    got = near_copies._in_turns(Scratch(spark, "test"), told, start, own, F.col("far") <= 0.2 + 1e-9).collect()
    want = [(i, j) for i, j, a in every if a >= 0.8]
    assert {(x.a, x.b) for x in got} <= set(want)
    assert groups([(0, 1), *((x.a, x.b) for x in got)]) == groups([(0, 1), *want])
    assert len(set(groups(want))) < 120 and sum(asked) < len(every) / 2
