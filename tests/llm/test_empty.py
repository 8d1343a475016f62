"""Empty tables give empty results, whatever the operator."""

import pytest

from epochlake.llm import bpe, decontaminate, license_scan, line_dedup, ngram_lm, quality, simhash, url_filters
from epochlake.llm.queries import tokenizer_path


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, score double")


def test_texts(spark, none):
    assert bpe.encode(none, tokenizer_path()).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_texts(none).count() == 0
    assert ngram_lm.score(none, ngram_lm.train(none)).count() == 0
    assert line_dedup.dedup_lines(none).columns == ["doc_id", "text", "score", "n_deleted"]
    assert decontaminate.clean(none, spark.createDataFrame([(1, "some benchmark item text")], "item_id bigint, text string")).count() == 0


def test_labels_without_toxic_documents(spark, none):
    labels = spark.createDataFrame([(1, None), (2, 0)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([(1, "a few words"), (2, "more words here")], "doc_id bigint, text string")
    assert quality.judge(docs, quality.train(docs, labels=labels)).count() == 2


def test_files_and_urls(spark):
    files = spark.createDataFrame([], "path string, text string, is_license_file boolean")
    assert license_scan.inherit(license_scan.own_licenses(files)).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, block boolean")
    mined = url_filters.mine_rules(pages, "url", pages.block)
    assert mined.count() == 0
    assert url_filters.judge(pages, mined, url_filters.written_rules(spark, []), keep=["page_id"]).count() == 0
