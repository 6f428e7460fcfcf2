"""Ranked search, chat formatting and spelling variants against plain versions of their contracts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annulus.llm import chat_format, lexical_search, queries, spelling_variants
from annulus.llm.common import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aB1_é \x1c\x85\xa0\n.日", max_size=60))
def test_terms(text):
    assert [t.decode("utf-8", "replace") for t in lexical_search.terms(text.encode("utf-8", "replace"))] == plain_terms(text.encode("utf-8", "replace").decode())


def slow_search(docs, items, k=50):
    found = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in found), sum(c.total() for _, c in found)
    held = {}
    for i, t in items:
        if i is not None:
            held.setdefault(i, set()).update(plain_terms(t))
    df = Counter(t for _, c in found for t in c)
    out = {}
    for i, own in held.items():
        ranked = []
        for doc_id, c in found:
            if doc_id is None or not c:
                continue
            m = 50 + (50 * c.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                ranked.append((-score, doc_id))
        out |= {(i, r): (d, -s) for r, (s, d) in enumerate(sorted(ranked)[:k], 1)}
    return out


def test_ranked_search(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Über", "日本", "THE", "the", "naïve", "x_y"]
    weighted = [w for i, w in enumerate(words) for _ in range(1 + 40 // (i + 1))]
    text = lambda most: " ".join(r.choices(weighted, k=r.randint(0, most)))
    docs = [(i * 2, text(60)) for i in range(200)] + [(1, None), (3, ""), (5, " .,"), (7, "the " * 300_000), (None, text(50)), (900, "copy of w1 w2")] + [(901 + i // 2, "copy of w1 w2") for i in range(160)]
    shared = " ".join(words[5:20])
    items = [(i, f"{shared if i % 2 else ''} {text(30)}") for i in range(30)] + [(40, None), (41, "..."), (42, "nowhere"), (None, "w1"), (43, "w1"), (43, "w2 copy"), (44, "the THE the")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "score": F.lit("x"), "terms": F.lit(0)}).repartition(7)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(9))
    want = slow_search(docs, items)
    for block in (lexical_search.BLOCK_BYTES, 900):
        got = lexical_search.best_documents(d, q, block_bytes=block).collect()
        assert len(got) == len(want) and {(x.item_id, x.rank): (x.doc_id, x.score) for x in got} == want
    few = lexical_search.best_documents(d, q, k=3).collect()
    assert {(x.item_id, x.rank): (x.doc_id, x.score) for x in few} == {k: v for k, v in want.items() if k[1] <= 3}
    assert lexical_search.best_documents(d.limit(0), q).count() == 0 and lexical_search.best_documents(d, q.limit(0)).count() == 0


def test_shared_sets_are_sums_of_their_terms():
    r = random.Random(8)
    for _ in range(20):
        size = r.randint(1, 40)
        items = [sorted(r.sample(range(size), r.randint(0, size))) for _ in range(r.randint(0, 12))]
        nodes, tops = lexical_search.shared_sets(items, size, window=r.choice([1, 3, 48]))
        own = [[t] for t in range(size)]
        for a, b in nodes:
            own.append(own[a] + own[b])
        assert [sorted(t for v in top for t in own[v]) for top in tops] == items
        uses = Counter(v for a, b in nodes for v in (a, b)) + Counter(v for top in tops for v in top)
        assert all(uses[size + k] >= 1 for k in range(len(nodes)))
    nodes, tops = lexical_search.shared_sets([list(range(16))] * 5 + [[*range(8), 20]], 21)
    adds = len(nodes) + sum(len(t) - 1 for t in tops)
    assert adds < 30 < 5 * 15 + 8  # plain evaluation


def test_accumulators_equal_plain_sums():
    r = np.random.default_rng(5)
    nodes, tops = lexical_search.shared_sets([[0, 1, 2, 3], [1, 2, 3], [0, 2, 3], []], 4)
    plan = {"nodes": nodes, "tops": tops, "weight": np.array([5, 0, 7, 11]), "documents": 9, "total": 100}
    tf = r.integers(1, 9, (4, 6))
    doc, term = np.tile(np.arange(6), 4), np.repeat(np.arange(4), 6)
    n = r.integers(1, 30, 6)
    got = lexical_search.Accumulators(plan).scores(n, doc, term, tf.ravel())
    each = plan["weight"][:, None] * (10**9 * tf // (1000 * tf + 20 * (50 + 50 * n * 9 // 100)))
    assert (got == np.stack([each[[0, 1, 2, 3]].sum(0), each[1:].sum(0), each[[0, 2, 3]].sum(0), 0 * n])).all()


PIECES = ["</s>", "[INST]", "[/INST]", "[REPLY]", "[ROLE]", "[NAME]", "<s>", "\\", "[", "<", "/", " ", "a", "é", "\n", "", "[/ROLE]"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[NAME]", "a [NAME"]), TEXT), min_size=1, max_size=8))
def test_turns_read_back(turns):
    state = chat_format.Conversation(chat_format.instruction_template)
    output, at, learned = "", 0, []
    for role, text in turns:
        start, piece, rewritten, loss_start, loss_length = state.add(role, text)
        assert (start, rewritten) == (at, 0) and chat_format.read_turn(piece) == (role, text)
        output, at = output + piece, at + len(piece)
        if role == "assistant":
            learned.append(chat_format.unescaped(piece[loss_start : loss_start + loss_length]))
        else:
            assert loss_start is None
    assert output == chat_format.instruction_template(turns)
    assert learned == [t for r, t in turns if r == "assistant"]
    for control in chat_format.CONTROLS:
        assert control not in chat_format.escaped("".join(t for _, t in turns))


def closing(turns):
    return chat_format.instruction_template(turns) + "<end>"


def forgetful(turns):
    return "".join(f"{r}: {t if i >= len(turns) - 2 else '...'}\n" for i, (r, t) in enumerate(turns))


def numbered(turns):
    return "".join(f"{i} {r}: {t}\n" for i, (r, t) in enumerate(turns))


def stripped(turns):
    return "".join(f"{r}: {t.strip()}\n" for r, t in turns)


def rebuilt(state, turns):
    output = ""
    for role, text in turns:
        start, piece, rewritten, *_ = state.add(role, text)
        assert len(output) - start == rewritten
        output = output[:start] + piece
    return output


@pytest.mark.parametrize("template", [chat_format.instruction_template, closing, forgetful, numbered, stripped])
def test_templates_as_black_boxes(template):
    turns = [("user" if i % 2 == 0 else "assistant", f" turn {i} ") for i in range(200)]
    state = chat_format.Conversation(template)
    assert rebuilt(state, turns) == template(turns)
    assert state.whole == (template in (closing, forgetful, numbered))
    assert len(state.window) == 200 if state.whole else len(state.window) <= chat_format.WINDOW
    state = chat_format.Conversation(template)
    found = [state.add(*t) for t in turns[:6]]
    assert [bool(x[2]) for x in found] == {closing: [False] + [True] * 5, forgetful: [False, False] + [True] * 4}.get(template, [False] * 6)
    loss = [x[3] is not None for x in found]
    assert loss == {closing: [False] * 6, forgetful: [False, True] + [False] * 4, stripped: [False, True] * 3}.get(template, [False, True] * 3)


def slow_chats(rows):
    out = {}
    for conv, own in rows.items():
        own = sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))
        turns = [(r or "", t or "") for _, r, t in own]
        learned = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(turns), sha(said), len(learned), sha(learned), len(chat_format.instruction_template(turns)))
    return out


def test_conversations(spark, tmp_path):
    r = random.Random(4)
    rows = {i: [(t, r.choice(["user", "assistant", "system", None, "tool [/ROLE]"]), r.choice(["", None, "a", "</s>[INST]", "\\", "x" * 3000])) for t in range(r.randint(1, 9))] for i in range(60)}
    rows[7] = [(i, "assistant" if i % 2 else "user", f"turn {i} \\ </s>") for i in range(3000)]
    rows[None] = [(None, "user", "no conversation"), (3, "assistant", "same"), (3, "assistant", "same"), (3, None, None)]
    rows[99] = [(0, "assistant", "[INST] y" * 200_000), (1, "user", "z" * 1_000_000)]
    flat = [(c, *x) for c, own in rows.items() for x in own]
    r.shuffle(flat)
    made = spark.createDataFrame(flat, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit("x"), "piece": F.lit(1)})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")  # conversations go on over batches
    try:
        formatted = chat_format.format_conversations(made)
        got = {x.conv_id: tuple(x)[1:] for x in chat_format.read_back(formatted).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == slow_chats(rows)
    one = formatted.where("conv_id = 99").orderBy("place").collect()
    assert "".join(x.piece for x in one) == chat_format.instruction_template([x[1:] for x in rows[99]])
    again = chat_format.format_conversations(made.where("conv_id = 7"), forgetful).where("rewritten > 0 and loss_start is null").count()
    assert again == 2998
    empty = made.limit(0)
    assert chat_format.read_back(chat_format.format_conversations(empty)).count() == 0
    empty.select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    own = queries.op12_chat_format(spark, str(tmp_path)).collect()
    said = "</s>[INST] ok [/INST]"
    assert len(own) == 1 and tuple(own[0])[:4] == (-1, 2, hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest(), len(said))


def late(turns):
    return ("long: " if len(turns) >= 100 else "") + "".join(f"{r}: {t}\n" for r, t in turns)


def test_templates_that_change_after_many_turns(spark):
    turns = [("user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(130)]
    made = spark.createDataFrame([(1, i, *x) for i, x in enumerate(turns)], "conv_id long, turn long, role string, text string")
    output = ""
    for i, x in enumerate(chat_format.format_conversations(made, late).orderBy("place").collect()):
        output = output[: x.start] + x.piece
        assert output == late(turns[: i + 1])
        assert (x.rewritten > 0) == (i == 99)
    assert chat_format.instruction_template.local


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def slow_words(docs, length=5, times=3):
    n = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            n[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word] += 1
    return {w: k for w, k in n.items() if len(w) >= length and k >= times}


def slow_near(words):
    found = set(words)
    letters = {c for w in words for c in w}
    near = {}
    for w in words:
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        others = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
        near[w] = (others - {w}) & found
    return near


def slow_variants(docs, **options):
    words = slow_words(docs, **options)
    near = slow_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def test_spelling_variants(spark):
    r = random.Random(6)
    words = ["".join(r.choices("abé", k=r.randint(4, 7))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaab", "aaaaaaa", "ÉTUDE", "étude", "Étude", "strasse", "straße", "naïve", "naive"]
    weights = [r.choice([1, 1, 2, 5, 30, 200]) for _ in words]
    docs = [(i, " ".join(r.choices(words, weights, k=r.randint(0, 120))) + r.choice(["", ".", " 日本aaaaa", "×÷"])) for i in range(120)]
    docs += [(None, "abéab " * 5), (500, None), (501, ""), (502, "abéab," * 200_000), docs[3], (503, "l" * 300_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("x"), "word": F.lit(1)}).repartition(5)
    want = slow_variants(docs)
    got = sorted(tuple(x) for x in spelling_variants.spelling_variants(d).collect())
    assert sorted(got, key=lambda x: x[0]) == want and len({x[2] for x in want}) < len(want)
    assert max(x[4] for x in want) >= 5 and any(x[2] != (x[1] or x[0]) for x in want)  # forms of forms
    assert spelling_variants.spelling_variants(d.limit(0)).count() == 0


def test_spelling_variants_of_documents(spark, sf_dir):
    docs = [(x.doc_id, x.text) for x in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = sorted((tuple(x) for x in queries.op13_spelling_variants(spark, sf_dir).collect()), key=lambda x: x[0])
    assert got == slow_variants(docs)


def test_pivots_are_the_least():
    r = random.Random(9)
    for _ in range(200):
        grams = [(i, r.randint(1, 9)) for i in sorted(r.sample(range(9), r.randint(1, 6)))]
        for count in (1, 2, 3):
            chosen = spelling_variants.pivots(grams, count)
            number = dict(grams)

            def sums(left, k, after):
                return [0] if k == 0 else [number[i] + s for i in left if i >= after for s in sums(left, k - 1, i + 2)]

            every = sums(sorted(number), count, 0)
            assert (chosen == []) == (not every)
            if chosen:
                assert sum(number[i] for i in chosen) == min(every) and all(b - a >= 2 for a, b in zip(chosen, chosen[1:], strict=False))
