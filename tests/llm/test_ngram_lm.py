import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from epochlake.llm import hash_arrays, ngram_lm
from epochlake.llm.language_id import discounts


def tokens(text):
    raw = (text or "").encode().lower().split()
    return [*raw, b"\n"]


def brute(train, texts):
    """Interpolated modified Kneser-Ney over words by dictionaries."""
    words, pairs = Counter(), Counter()
    for t in train:
        own = tokens(t)
        words.update(own)
        pairs.update(zip([b"^", *own[:-1]], own))
    n, v = sum(words.values()), len(words)
    before, total, n123 = Counter(), Counter(), defaultdict(lambda: [0, 0, 0])
    for (c, w), k in pairs.items():
        before[w] += 1
        total[c] += k
        n123[c][min(k, 3) - 1] += 1
    few = lambda x: discounts(*[sum(k == j for k in x.values()) for j in (1, 2, 3, 4)])
    d2, d1 = few(pairs), few(before)
    cut = lambda k, d: max(k - ([0.0, *d][min(k, 3)]), 0.0)
    all_before = sum(before.values())
    mass = sum(min(k, [0.0, *d1][min(k, 3)]) for k in before.values()) / all_before if before else 0
    out = []
    for t in texts:
        own, base, score = tokens(t), 0.0, 0.0
        for c, w in zip([b"^", *own[:-1]], own):
            base += math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1)))
            p1 = cut(before[w], d1) / all_before + mass / (v + 1)
            if total[c]:
                gamma = sum(x * d for x, d in zip(n123[c], d2)) / total[c]
                p = cut(pairs[c, w], d2) / total[c] + gamma * p1
            else:
                p = p1
            score += math.log10(p)
        out.append((len(own), sum(words[w] > 0 for w in own), n, base, score))
    return out


def check(spark, train, texts):
    frame = lambda rows: spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")
    model = ngram_lm.train(frame(train))
    got = sorted(ngram_lm.score(frame(texts), model).collect())
    for row, want in zip(got, brute(train, texts), strict=True):
        assert tuple(row)[1:4] == want[:3]
        assert row["base_score"] == pytest.approx(want[3], rel=1e-9)
        assert row["score"] == pytest.approx(want[4], rel=1e-6)


def test_against_dictionaries(spark, sf):
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("text").collect()]
    check(spark, texts[:150], texts[100:])


def test_many_buckets_and_edge_texts(spark, monkeypatch, sf):
    monkeypatch.setattr(ngram_lm, "BUCKET_TOKENS", 500)
    monkeypatch.setattr(ngram_lm, "FLUSH_TOKENS", 700)
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("text").limit(40).collect()]
    odd = ["", None, " \t\n", "A a\x0bÉ é\x1ca", "x " * 5000, "same text", "same text", "w" * 3000]
    check(spark, texts + odd, odd + texts[:5] + ["never seen words"])


def test_wide_counts_and_many_shards(spark, monkeypatch, sf):
    monkeypatch.setattr(ngram_lm, "WIDE", 10)
    monkeypatch.setattr(ngram_lm, "BUCKET_TOKENS", 900)
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("text").limit(30).collect()]
    check(spark, texts, texts[:5])
    assert ngram_lm.count_kind(1 << 40) == "<u8"
    key = np.array([7, 7, 9], np.uint64)
    assert ngram_lm.summed(key, np.array([3 << 31, 1 << 32, 5], np.int64))[1].tolist() == [(3 << 31) + (1 << 32), 5]
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    for shards in (1, 3, 65_536, 70_000, 1 << 22):
        number = hash_arrays.shard_of(keys, shards)
        assert (np.diff(number) >= 0).all() and number.min() >= 0 and number.max() < shards
    context, word = keys[:100], keys[100:200]
    pairs = np.array([ngram_lm.pair_key(np.full(100, c), word, np.array([0], np.uint64), 1 << 20) for c in context])
    assert all(len(set(hash_arrays.shard_of(row, 1 << 20).tolist())) == 1 for row in pairs)


def test_files_of_a_store_are_copied_once_and_dropped(tmp_path, monkeypatch):
    monkeypatch.setattr(hash_arrays.tempfile, "tempdir", str(tmp_path / "own"))
    (tmp_path / "own").mkdir()
    uris = [f"file://{tmp_path}/epochlake-app/model-{k}/pair/000000.key" for k in (1, 2)]
    for k, uri in enumerate(uris):
        hash_arrays.put_file(uri, np.arange(5, dtype="<u8") + k)
    monkeypatch.setattr(hash_arrays, "_mounted", lambda uri: None)
    for k, uri in enumerate(uris):
        for _ in range(2):
            found = hash_arrays.worker_cache(uri.rpartition("/pair")[0], lambda uri=uri: hash_arrays.map_file(uri, "<u8"))
            assert found.tolist() == [k, k + 1, k + 2, k + 3, k + 4]
        assert len(list((tmp_path / "own").glob("epochlake-copies/*/*"))) == 1


def test_nothing_to_train_on(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    model = ngram_lm.train(docs.filter("false"))
    rows = ngram_lm.score(docs, model).orderBy("id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in rows] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
