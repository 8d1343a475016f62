"""Cases that once went wrong: characters beyond the first plane, columns with the operators' own names, long words, newer Unicode."""

import random

import pytest

from epochlake.llm import bpe, decontaminate, language_id, license_scan, url_filters
from epochlake.llm.queries import tokenizer_path


def test_characters_beyond_the_first_plane_stay_apart(spark):
    item = "".join(chr(0x20000 + 7 * k) for k in range(12))
    other = "".join(chr(ord(c) + 0x1800) for c in item)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    df = spark.createDataFrame([(1, "x " + item + " y"), (2, "x " + other + " y"), (3, other)], "doc_id bigint, text string")
    assert [(r["id"], r["item_id"], r["edits"]) for r in decontaminate.matches(df, bench).collect()] == [(1, 1, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(df, bench).collect()) == [2, 3]


def test_inherit_keeps_columns_of_any_name(spark):
    rows = [("a/b/x.txt", False, None, "mine1", "n1", "s1", "d"), ("a/LICENSE", True, "MIT", "mine2", "n2", "s2", "d")]
    files = spark.createDataFrame(rows, "path string, is_license_file boolean, own_license string, home string, near string, salt string, dir string").selectExpr("*", "cast(0.9 AS double) AS cosine")
    got = {r["path"]: r for r in license_scan.inherit(files).collect()}
    assert [(got[p]["home"], got[p]["near"], got[p]["salt"], got[p]["license"], got[p]["inherited_from"]) for p in ("a/b/x.txt", "a/LICENSE")] == [("mine1", "n1", "s1", "MIT", "a"), ("mine2", "n2", "s2", "MIT", None)]
    for name in ("license", "inherited_from", "__home"):
        with pytest.raises(ValueError, match="rename"):
            license_scan.inherit(files.withColumnRenamed("home", name))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_every_code_point_is_split_as_by_the_library(library):
    """Each between letters, after a mark and twice in a row: letter, digit, white space or other, its lower case and its normal form."""
    codec = bpe.BpeCodec(tokenizer_path())
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for i in range(0, len(points), 50_000):
        texts = ["a{0}b!{0}{0}!".format(chr(c)) for c in points[i : i + 50_000]]
        codec.learn(set().union(*map(codec.split, texts)))
        wrong = [hex(c) for c, t, e in zip(points[i:], texts, library.encode_batch(texts, add_special_tokens=False), strict=False) if codec.ids(t) != e.ids]
        assert not wrong


@pytest.mark.parametrize(("n", "letters"), [(5_000, "abcdefghijklmnopqrstuvwxyz"), (20_000, "ab"), (9_999, "a"), (700, "the"), (40_000, "日本語漢字かなカナ"), (1_000_000, "etaoinshrdlu")])
def test_long_words(library, n, letters):
    rng = random.Random(n)
    word = "".join(rng.choice(letters) for _ in range(n))
    assert bpe.BpeCodec(tokenizer_path()).encode_words(["short", word, "words"])[1] == library.encode(word, add_special_tokens=False).ids


def test_words_merged_alone_equal_words_merged_together(library, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 40))) for _ in range(2_000)]
    codec = bpe.BpeCodec(tokenizer_path())
    together = codec.encode_words(words)
    monkeypatch.setattr(bpe, "LONG", 1)
    assert codec.later and codec.encode_words(words) == together == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


@pytest.mark.parametrize("n", [1_000, 6_000])
def test_chance_gives_no_url_rules_and_planted_ones_stay(spark, n):
    """Labels drawn by lot over a site's many words; then the same with one word that means block in nine of ten."""
    rng = random.Random(n)
    rows = [(i, f"http://h{rng.randrange(20)}.org/{rng.choice(['en', 'de', 'fr'])}/w{rng.randrange(n // 8)}/p{rng.randrange(40)}", rng.random() < 0.15) for i in range(n)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, bad boolean")
    assert url_filters.mine_rules(df, "url", df.bad).count() == 0
    bad = [(i, u.replace("/en/", "/casino/"), rng.random() < 0.9 if "/en/" in u and i % 4 == 0 else b) if "/en/" in u and i % 4 == 0 else (i, u, b) for i, u, b in rows]
    df = spark.createDataFrame(bad, "page_id bigint, url string, bad boolean")
    rules = [(r["tokens"], r["confidence"]) for r in url_filters.mine_rules(df, "url", df.bad).collect()]
    assert (["p:casino"] in [t for t, _ in rules]) and all("p:casino" in t for t, _ in rules)


def test_small_languages_are_calibrated_like_large_ones(spark):
    """A limit comes from documents that weren't counted, be they few or many: it lies above what counted ones reach."""
    rng = random.Random(11)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(400)] for lang, letters in (("aa", "abcdefgh"), ("bb", "klmnopqr"))}
    rows = [(i, lang, " ".join(rng.choice(words[lang]) for _ in range(30))) for lang, n in (("aa", 600), ("bb", 60)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    model = language_id.train(df)
    limits = dict(zip(model.langs, model.limit.tolist(), strict=True))
    assert all(limit < float("inf") for limit in limits.values()) and abs(limits["aa"] - limits["bb"]) < 1.0
    alone = language_id.train(spark.createDataFrame([(1, "cc", "only one text"), *rows[:50]], "doc_id bigint, lang string, text string"))
    assert "cc" in alone.langs
    assert {r["lang_pred"] for r in language_id.identify(df.filter("lang = 'bb'"), model).collect()} == {"bb"}
