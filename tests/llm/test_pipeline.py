"""The pipeline's stages on planted cases, each judged on its own input."""

import random

import pytest

import corpus_pipeline
from epochlake.llm import decontaminate

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF).cache()
        out.append((name, docs))
    return out


def test_stages_keep_the_columns_and_shrink(spark, stages):
    assert [len(corpus_pipeline.STAGES), len(stages)] == [5, 6]
    for (_, a), (_, b) in zip(stages[:-2], stages[1:-1]):
        assert b.columns == stages[0][1].columns and b.count() <= a.count()
    assert stages[-1][1].count() == stages[-2][1].count()


def test_quality_stage_drops_poor_and_toxic_documents(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r[0] for r in stages[1][1].select("doc_id").collect()}
    rows = labels.collect()
    clean = [r["doc_id"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)
    assert sum(r["doc_id"] in kept for r in rows if r["quality"] == 0) <= 0.07 * sum(r["quality"] == 0 for r in rows)


def test_benchmark_stage_drops_exactly_the_matches(spark, stages):
    before, after = stages[3][1], stages[4][1]
    hits = {r["id"] for r in decontaminate.matches(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r[0] for r in before.select("doc_id").collect()} - hits == {r[0] for r in after.select("doc_id").collect()}


def test_planted_copies_lines_and_leaks(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = ". ".join(text(12) for _ in range(6)) + ". "
    texts = [text(200) for _ in range(20)]
    near = texts[0].split()
    for p in (10, 60, 110):
        near[p] = word()
    texts += [texts[1], " ".join(near), f"{text(60)}. {passage}{text(30)}", f"{text(60)}. {passage}{text(30)}"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    lines = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, df, SF).collect()}
    assert passage.strip() in lines[22] and passage.split(". ")[2] not in lines[23] and lines[23] != ""
    kept = {r["doc_id"] for r in corpus_pipeline.near_copy_stage(spark, df, SF).collect()}
    assert kept == set(range(24)) - {20, 21}


def test_run_equals_the_stages(spark, stages):
    a = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert a == sorted(map(tuple, stages[-1][1].collect()))
