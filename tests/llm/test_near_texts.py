"""Near copies by fingerprints first: what the grid links, what is left to the prefix join, and both together."""

import itertools
import random

import pytest

import corpus_pipeline
from epochlake.llm import shingle_sets, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = ["", " ", None, "one", "One", "one two three"]
    for _ in range(10):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 80, 300, 1200]))]
        for k in range(12):
            t = list(base)
            for p in rng.sample(range(len(t)), rng.randint(0, max(1, len(t) // (22 if k % 2 else 200)))):
                t[p] = f"w{rng.randrange(3000)}"
            out.append(" ".join(t))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def judged(texts):
    """For each pair: (i, j, differing bits of the sets' fingerprints, similar)."""
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    prints = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in s) > len(s)) for s in sets]
    return [(i, j, (prints[i] ^ prints[j]).bit_count(), 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for i, j in itertools.combinations(range(len(texts)), 2)]


def least(n, pairs):
    own = list(range(n))
    for i, j in pairs:
        a, b = sorted((own[i], own[j]))
        own = [a if x == b else x for x in own]
    return own


def no_links(classes, *_):
    return classes.sparkSession.createDataFrame([], "a bigint, b bigint")


def test_stage_links_by_fingerprints_within_the_radius(spark, texts, monkeypatch):
    monkeypatch.setattr(shingle_sets, "far_links", no_links)
    want = least(len(texts), [(i, j) for i, j, bits, similar in judged(texts) if similar and bits <= 4])
    kept = {r[0] for r in corpus_pipeline.near_copy_stage(spark, frame(spark, texts), "").select("doc_id").collect()}
    assert kept == set(want) and len(kept) < len(texts) - 30


def test_prefix_join_has_only_pairs_beyond_the_radius(spark, texts, monkeypatch):
    monkeypatch.setattr(shingle_sets, "close_links", no_links)
    pairs = judged(texts)
    equal = [(i, j) for i, j, bits, similar in pairs if similar and bits == 0 and set(simhash.shingle_hashes(texts[i], 5).tolist()) == set(simhash.shingle_hashes(texts[j], 5).tolist())]
    want = least(len(texts), equal + [(i, j) for i, j, bits, similar in pairs if similar and bits > 4])
    got = {r["id"]: r["component_id"] for r in simhash.near_texts(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want != least(len(texts), [(i, j) for i, j, _, similar in pairs if similar])


@pytest.mark.parametrize(("radius", "cell_rows"), [(0, 4096), (4, 8), (9, 4096)])
def test_links_are_the_similar_pairs_at_any_radius(spark, texts, monkeypatch, radius, cell_rows):
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    pairs = judged(texts)
    assert any(not similar and bits <= 9 for _, _, bits, similar in pairs)
    want = least(len(texts), [(i, j) for i, j, _, similar in pairs if similar])
    got = {r["id"]: r["component_id"] for r in simhash.near_texts(frame(spark, texts), radius=radius).collect()}
    assert [got[i] for i in range(len(texts))] == want
