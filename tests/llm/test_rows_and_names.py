"""Repeated ids, clashing column names and empty tables: what stages and operators that return documents do with them."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from annulus.llm import langid, near_copies, secret_scan, simhash, substring_dedup
from annulus.llm.common import free_names, table

CLASHING = ["_id", "_key", "_kinds", "_text_key", "_doc", "_of", "__key", "__doc", "__of", "__spans", "spans", "score", "margin", "lang_pred", "rejected", "root", "key", "uid", "first"]


@pytest.mark.parametrize("operator", [near_copies.drop_near_copies, simhash.drop_near_copies])
def test_one_id_with_two_texts(spark, operator):
    a, b = (" ".join(f"{w}{i}" for i in range(40)) for w in ("alpha", "beta"))
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (5, b)], "doc_id long, text string")
    assert sorted((x.doc_id, x.text) for x in operator(docs).collect()) == [(1, a), (5, b)]


def test_columns_come_back_whatever_their_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHING})
    for operator in (langid.keep_known, near_copies.drop_near_copies, simhash.drop_near_copies, substring_dedup.substring_dedup, secret_scan.redact_secrets):
        found = operator(docs)
        assert found.columns == docs.columns
        assert found.count() > 0 and found.where(" or ".join(f"`{c}` is null or `{c}` <> concat('{c}', doc_id)" for c in CLASHING)).count() == 0
        assert operator(docs.limit(0)).count() == 0
    assert secret_scan.find_secrets(docs).columns == [*docs.columns, "secrets"]
    assert free_names(docs, "SPANS", "spans", "text", "fine") == ["SPANS_", "spans__", "text_", "fine"]


def test_stages_of_no_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_keys_are_masked_with_their_bodies(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIEow\nIBAAKC/+=\n-----END RSA PRIVATE KEY-----"
    texts = [f"before {key} after", "open -----BEGIN PRIVATE KEY-----\nMIIE", "no key -----BEGIN CERTIFICATE-----"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.text for x in secret_scan.redact_secrets(docs).orderBy("doc_id").collect()] == ["before [SECRET] after", "open [SECRET]", texts[2]]


def test_languages_of_short_texts_and_number_signs(spark):
    docs = spark.createDataFrame([(i, f"kata {i} satu dua", "aa") for i in range(9)] + [(i, f"слово {i} день", "bb") for i in range(9, 18)], "doc_id long, text string, lang string")
    books = langid.fit(docs, F.lit(True))
    assert sorted(books) == ["aa", "bb"]
    asked = spark.createDataFrame([(1, "½ ² Ⅷ ①"), (2, "день слово"), (3, "satu kata"), (3, "satu kata"), (4, None), (5, "satu kata dua " * 100_000)], "doc_id long, text string")
    got = [x.lang_pred for x in langid.predict(asked, books).orderBy("doc_id").collect()]
    assert got == ["und", "bb", "aa", "aa", "und", "aa"]
    assert langid.letters("a½b²c Ⅷ") == langid.letters("a½b²c") + b" " and langid.letters("ªß x_1y") == "ªß x y".encode()
