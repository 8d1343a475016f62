"""Periodic runs against a plain search for every period, and the query against its contract word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from epochlake.llm import periodic_runs
from epochlake.llm.queries import op11_periodic_runs


def plain_runs(words, least=24, times=3):
    """For every period: maximal stretches of it; those that a smaller period has are left out."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)  # periods come in order, so the first one is the smallest
            i = j
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", text or "")


def made(rng):
    """Texts of few words, with repeated phrases, nested runs, runs that touch and runs that overlap."""
    out = []
    for _ in range(70):
        words = []
        for _ in range(rng.randrange(1, 6)):
            phrase = [rng.choice("abcd") for _ in range(rng.randrange(1, 12))]
            phrase = phrase * rng.randrange(1, 4) + [rng.choice("ab")] * rng.randrange(0, 3)
            words += (phrase * rng.randrange(1, 9))[: rng.randrange(1, 120)]
        out.append(" ".join(words))
    return out


ODD = [None, "", " \n\t ", "word", "x " * 3000, "w" * 5000, "A a " * 40, "same " * 30, "same " * 30, "é\u00a0ü \x1c " * 30, "n\x0bt\x0cu\r" * 20]


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 3), (1, 4)])
def test_equals_every_period(spark, least, times):
    texts = [*made(random.Random(least)), *ODD]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a " * 50, "x")], "doc_id bigint, text string, runs string")
    rows = periodic_runs.find_runs(docs, least=least, times=times).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        words = split("a " * 50 if r["id"] is None else texts[r["id"]])
        runs = plain_runs(words, least, times)
        assert r["n_words"] == len(words)
        assert [tuple(x) for x in r["runs"]] == runs
        assert r["collapsed"] == plain_collapsed(words, runs)


def test_pieces_and_groups_of_texts(monkeypatch):
    text = b" ".join(random.Random(2).choice([b"ab", b"c", b"def"]) for _ in range(4000)) + b"   " + b"z" * 300
    whole = periodic_runs.word_numbers(text)
    monkeypatch.setattr(periodic_runs, "PIECE", 50)
    pieces = periodic_runs.word_numbers(text)
    assert whole[1] == pieces[1] and np.array_equal(whole[0], pieces[0]) and len(whole[0]) == 4001


def test_large_periods():
    """A text of 200,000 words whose tail has a period of 30,000; all else stands once."""
    own = np.arange(200_000)
    own[50_000:] = 50_000 + np.arange(150_000) % 30_000
    assert periodic_runs.runs_of(own, np.array([200_000])).tolist() == [[50_000, 150_000, 30_000]]
    assert periodic_runs.runs_of(np.zeros(300_000, np.int64), np.array([300_000])).tolist() == [[0, 300_000, 1]]


def test_refuses_what_it_cannot_find(spark):
    with pytest.raises(ValueError):
        periodic_runs.find_runs(spark.createDataFrame([], "doc_id bigint, text string"), times=2)


def test_query(spark, tmp_path):
    rng = random.Random(4)
    texts = {i: t for i, t in enumerate([*made(rng), *made(rng), *ODD])}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = op11_periodic_runs(spark, str(tmp_path)).collect()
    altered = 0
    assert len(rows) == len(texts)
    for r in rows:
        words, h = split(texts[r["doc_id"]]), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
            altered += 1
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
    assert altered > 5


def test_empty(spark):
    assert periodic_runs.find_runs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
