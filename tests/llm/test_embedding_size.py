"""Large groups of near copies, and buckets and tiles of few rows, for the embedding operator."""

import os

import numpy as np
import pytest

from epochlake.llm import embedding_dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(seed=3, base=300, copies=200):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(base, 64))
    v = np.concatenate([v, v[:40] + rng.normal(size=(40, 64)) * 0.15, v[0] + rng.normal(size=(copies, 64)) * np.linspace(0.05, 0.25, copies)[:, None]])
    return [(i, [float(x) for x in a], int(i % 7 == 3)) for i, a in enumerate(v.astype(np.float32))]


def wanted(rows):
    v = embedding_dedup.unit(np.array([r[1] for r in rows]))
    label = np.array([r[2] for r in rows])
    link = ((v @ v.T) >= 0.98) & (label[:, None] == label)
    least = np.arange(len(rows))
    while True:
        new = np.where(link, least, len(rows)).min(axis=1)
        if (new == least).all():
            return [(r[0], int(n), int(c), bool(c == r[0])) for r, n, c in zip(rows, link.sum(axis=1) - 1, least, strict=True)]
        least = new


def result(spark, rows):
    return sorted(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("id", "n_links", "component_id", "kept").collect())


@pytest.mark.parametrize(("bucket_rows", "tile"), [(16, 1 << 13), (1 << 18, 24), (100, 50)])
def test_small_buckets_and_tiles_lose_nothing(spark, monkeypatch, bucket_rows, tile):
    monkeypatch.setattr(embedding_dedup, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rows = vectors()
    want = wanted(rows)
    assert result(spark, rows) == want and sum(r[1] for r in want) > 5000


def test_links_of_a_group_are_never_rows(spark):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=64) + rng.normal(size=(1500, 64)) * 0.05).astype(np.float32)
    rows = [(i, [float(x) for x in a], 1) for i, a in enumerate(v)]
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    stored = lambda: sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(folder) for x in names)
    before = stored()
    assert result(spark, rows) == [(i, 1499, 0, i == 0) for i in range(1500)]
    assert stored() - before < 12 * v.nbytes  # 36 MB with a row per link


def test_two_vectors_of_one_number_get_others(spark, monkeypatch):
    real = embedding_dedup.node_of
    monkeypatch.setattr(embedding_dedup, "node_of", lambda seed: real(seed) if seed else real(seed) * 0 + 5)
    rows = vectors(base=50, copies=10)
    assert result(spark, rows) == wanted(rows)
