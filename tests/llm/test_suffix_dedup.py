"""Suffix-array dedup against counting every window of every text, and its groups against all maximal repeats."""

import hashlib
import random
from collections import defaultdict

import pytest

from epochlake.llm import suffix_dedup
from epochlake.llm.queries import op13_suffix_dedup


def plain(texts, length):
    """Kept bytes and number of runs per text, from the places of all windows."""
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for t in data:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += 1
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((bytes(b for b, g in zip(t, gone, strict=True) if not g), runs))
    return out


def mixed(rng, n, letters):
    """Random texts with shared passages, near copies and copies."""
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages, texts = [word(rng.randrange(8, 60)) for _ in range(5)], []
    for _ in range(n):
        parts = [word(rng.randrange(0, 40)) + (rng.choice(passages) if rng.random() < 0.6 else "") for _ in range(rng.randrange(0, 4))]
        texts.append("".join(parts))
    base = word(80)
    for _ in range(n // 2):
        k = rng.randrange(len(base))
        texts.append(base[:k] + rng.choice(letters) + base[k + 1 :])
    return texts + texts[: n // 6] + [None, "", "a" * 300, "a" * 40, "ab" * 30, "é" * 25]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, d string, start double")


@pytest.mark.parametrize(("length", "letters", "group_rows"), [(12, "abc", 10_000), (12, "ab", 3), (25, "abcd", 4), (3, "abcdefgh", 2)])
def test_equals_window_counts(spark, length, letters, group_rows):
    texts = mixed(random.Random(length * group_rows), 60, letters)
    rows = suffix_dedup.remove_repeats(frame(spark, texts), length=length, group_rows=group_rows).collect()
    got = {r["id"]: (bytes(r["kept"]), len(r["spans"])) for r in rows}
    want = plain(texts, length)
    assert len(rows) == len(texts)
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("group_rows", [10_000, 3])
def test_groups_hold_all_occurrences(spark, group_rows):
    """Each group's occurrences are all places of its string whose anchor reaches that far, and every repeat lies in groups."""
    length, texts = 12, mixed(random.Random(5), 40, "abc")
    rows = suffix_dedup.repeat_groups(frame(spark, texts), length=length, group_rows=group_rows).collect()
    groups, data = defaultdict(set), [(t or "").encode() for t in texts]
    for r in rows:
        string = data[r["id"]][r["start"] : r["start"] + r["n_bytes"]]
        assert hashlib.sha256(string).digest()[:16] == bytes(r["name"]) and len(string) >= length
        groups[string].add((r["id"], r["start"]))
    distinct = {t: i for i, t in enumerate(data)}
    for string, places in groups.items():
        assert len({(distinct[data[i]], s) for i, s in places}) > 1
    found = defaultdict(set)
    for string, places in groups.items():
        for i, s in places:
            for k in range(len(string) - length + 1):
                found[string[k : k + length]].add((i, s + k))
    where = defaultdict(set)
    for i, t in enumerate(data):
        for k in range(len(t) - length + 1):
            where[t[k : k + length]].add((i, k))
    for window, places in where.items():
        if len({(distinct[data[i]], k) for i, k in places}) > 1:
            assert found[window] == places  # all occurrences, not just neighbours
        else:
            assert window not in found


def test_long_texts_and_block_borders(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghij klm") for _ in range(150_000))
    passage = base[65_400:65_700]
    texts = [base, "x" + passage + "y", passage[:199], "short", base[:199] + "é" + passage[10:210]]
    rows = {r["id"]: r for r in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    want = plain(texts, 200)
    assert [(bytes(rows[i]["kept"]), len(rows[i]["spans"])) for i in range(len(texts))] == want
    assert [(s["start"], s["upto"]) for s in rows[0]["spans"]] == [(65_400, 65_700)]


def test_query(spark, tmp_path):
    rng = random.Random(1)
    passage = " ".join(f"w{rng.randrange(900)}" for _ in range(60))
    texts = [f"one {rng.random()} {passage} end", f"{passage} two {rng.random()}", "clean " * 3, "copy " * 60, "copy " * 60, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in op13_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, (t, (kept, runs)) in enumerate(zip(texts, plain(texts, 200), strict=True)):
        n = len((t or "").encode())
        assert tuple(rows[i]) == (i, n, n - len(kept), runs, hashlib.sha256(kept).hexdigest())


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.repeat_groups(none).count() == 0
