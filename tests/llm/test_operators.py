"""Each corpus operator against brute force, another library or held-out labels, and on edge inputs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from epochlake.llm import bpe, decontaminate, embedding_dedup, language_id, license_scan, line_dedup, quality, shingle_sets, simhash, url_filters
from epochlake.llm.components import components
from epochlake.llm.queries import URL_RULES, op5_quality, op7_language_id, op8_url_filters, tokenizer_path
from epochlake.llm.word_hashes import END, token_chunks

SF = "/root/testdata/sf0.01"
ODD = [None, "", "  \n\t", "word", "A a A", "x " * 3000, "w" * 5000, "same text twice", "same text twice", "naïve Ünïcode 日本語 \x00 \x01 end."]


def docs(spark, texts, extra=True):
    rows = [(i, t, "clash", 0.5) for i, t in enumerate(texts)] + [(None, "no id", "clash", 0.5)]
    out = spark.createDataFrame(rows, "doc_id bigint, text string, key string, n double")
    return out if extra else out.filter("doc_id is not null").select("doc_id", "text")


def sample(spark, n=150):
    return [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n).select("text").collect()]


# ---- 10


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(3)
    letters = "aAbB'sStT'eé́ İΣſK\n\t!.,;12٣​ 日<|>endoftxt\x00\x1c"
    texts = [*ODD, "don't <|endoftext|>I'LL <|startoftext|>", *sample(spark), *("".join(rng.choice(letters) for _ in range(30)) for _ in range(400))]
    rows = {r["doc_id"]: r for r in bpe.encode(docs(spark, texts), tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == ids and rows[i]["n_tokens"] == len(ids)
        assert rows[i]["decoded"] == lib.decode(ids, skip_special_tokens=False)
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert rows[None]["key"] == "clash"
    with pytest.raises(ValueError, match="n_tokens"):
        bpe.encode(docs(spark, ODD).withColumnRenamed("key", "N_tokens"), tokenizer_path())


# ---- 6


def groups(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("cell_rows", [4096, 8])
def test_simhash_finds_every_link(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(6)]
    texts = [*ODD, *base]
    for _ in range(90):
        t = rng.choice(base).split()
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    prints = [np.uint64(simhash.fingerprint(t, 4)[0] % (1 << 64)) for t in texts]
    want = groups(len(texts), lambda i, j: np.bitwise_count(prints[i] ^ prints[j]) <= 4)
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_simhash_bits_follow_the_definition():
    import xxhash

    text = "One two\tthree four  five\nsix A"
    w = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(len(w) - 3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(text, 4)[0] % (1 << 64) == want and simhash.fingerprint(" ", 4) == [0]


def test_near_texts_keep_one_of_each_group(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    base = [[rng.choice(words) for _ in range(250)] for _ in range(20)]
    texts, group = [], []
    for g, b in enumerate(base):
        for k in range(5):
            t = list(b)
            for p in rng.sample(range(250), 3 * (k > 0)):
                t[p] = rng.choice(words)
            texts.append(" ".join(t))
            group.append(g)
    kept = [r["doc_id"] for r in simhash.drop_near_texts(docs(spark, texts)).collect()]
    assert None in kept
    assert sorted(i for i in kept if i is not None) == [5 * g for g in range(20)]


def test_near_texts_with_repeated_ids_lose_no_text(spark):
    text = lambda k: " ".join(f"w{k * 1000 + j}" for j in range(100))
    a, b, c = text(1), text(2), text(3)
    rows = [(0, a, 1), (5, a + " tail", 2), (5, b, 3), (1, c, 4), (1, text(4), 5), (2, c, 6), (1, c, 7), (None, a, 8), (7, None, 9), (7, "", 10)]
    kept = simhash.drop_near_texts(spark.createDataFrame(rows, "doc_id bigint, text string, key int")).collect()
    assert sorted(r["key"] for r in kept) == [1, 3, 4, 5, 8, 9] or sorted(r["key"] for r in kept) == [1, 3, 4, 5, 8, 10]


@pytest.mark.parametrize(("cell_rows", "frequent"), [(4096, 100), (8, 100), (4096, 3)])
def test_near_texts_equal_exact_similarity(spark, monkeypatch, cell_rows, frequent):
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(shingle_sets, "FREQUENT", frequent)
    rng = random.Random(7)
    texts = list(ODD)
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 200, 900]))]
        for _ in range(14):
            t = list(base)
            for p in rng.sample(range(len(t)), rng.randint(0, max(1, len(t) // 25))):
                t[p] = f"w{rng.randrange(3000)}"
            texts.append(" ".join(t))

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    want = groups(len(texts), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    got = {r["id"]: r["component_id"] for r in simhash.near_texts(docs(spark, texts, extra=False)).collect()}
    assert [got[i] for i in range(len(texts))] == want and 40 < len(set(want)) < len(texts)


def test_components_of_paths_and_stars(spark):
    edges = [(k + 1, k) for k in range(100, 140)] + [(900, k) for k in range(901, 930)] + [(7, 3), (3, 7), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[k] == 100 for k in range(100, 141)) and all(got[k] == 900 for k in range(900, 930)) and got[7] == got[3] == 3 and 5 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- 9


def plain_line_dedup(texts, words):
    """Delete every line inside a run of ``words`` words that stood earlier, by dictionaries of tuples."""
    seen, out = set(), []
    for t in texts:
        if t is None:
            out.append((None, 0))
            continue
        marked = t
        for e in line_dedup.ENDS:
            marked = marked.replace(e, e + "\x01")
        lines, gone = marked.split("\x01"), set()
        own = [(k, x.strip(" \n")) for k, x in enumerate(lines)]
        own = [(k, x, x.count(" ") + 1) for k, x in own if x]
        for a in range(len(own)):
            n, b = 0, a
            while b < len(own) and n < words:
                n += own[b][2]
                b += 1
            if n >= words:
                run = tuple(x for _, x, _ in own[a:b])
                if run in seen:
                    gone.update(range(own[a][0], own[b - 1][0] + 1))
                seen.add(run)
        out.append(("".join(x for k, x in enumerate(lines) if k not in gone) if gone else t, len(gone)))
    return out


def test_line_dedup_equals_plain_python(spark):
    rng = random.Random(5)
    lines = [" ".join(f"v{rng.randrange(50)}" for _ in range(rng.randint(1, 12))) + rng.choice([".", "", "!"]) for _ in range(60)]
    passage = " ".join(lines[k] for k in range(12))
    texts = [*ODD[:6], *(rng.choice(["\n", " "]).join(rng.choice(lines) for _ in range(rng.randint(1, 40))) for _ in range(60))]
    texts += [f"Alone here. {passage}\nand on", f"Quite other words. {passage}", texts[20], texts[21], "y. " * 200]
    df = docs(spark, texts)
    got = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in line_dedup.dedup_lines(df.withColumn("lines", df.n), run_words=15, both_ways=False).filter("doc_id is not null").collect()}
    assert [got[i] for i in range(len(texts))] == plain_line_dedup(texts, 15)


def plain_stretch_dedup(texts, words):
    """Delete every line inside a match of at least ``words`` words with an earlier place, grown line by line to both sides."""
    docs = []
    for t in texts:
        marked = t or ""
        for e in line_dedup.ENDS:
            marked = marked.replace(e, e + "\x01")
        lines = marked.split("\x01")
        docs.append((lines, [(k, x.strip(" \n")) for k, x in enumerate(lines) if x.strip(" \n")]))
    places = {}
    for d, (_, own) in enumerate(docs):
        for p, (_, x) in enumerate(own):
            places.setdefault(x, []).append((d, p))
    out = []
    for d, (lines, own) in enumerate(docs):
        gone = set()
        for p, (_, x) in enumerate(own):
            for e, q in places[x]:
                if (e, q) >= (d, p):
                    break
                other, a, b = docs[e][1], 0, 1
                while min(p, q) - a > 0 and own[p - a - 1][1] == other[q - a - 1][1]:
                    a += 1
                while p + b < len(own) and q + b < len(other) and own[p + b][1] == other[q + b][1]:
                    b += 1
                match = own[p - a : p + b]
                if sum(y.count(" ") + 1 for _, y in match) >= words:
                    gone.update(range(match[0][0], match[-1][0] + 1))
        out.append(("".join(x for k, x in enumerate(lines) if k not in gone) if gone else texts[d], len(gone)))
    return out


def test_line_dedup_extends_matches_both_ways(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    passage = f"{text(25)}. {text(25)}. {text(10)}. "
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, [f"{text(50)}. {passage}{text(50)}", f"Go. {passage}On {text(50)}"], extra=False), both_ways=True).collect()}
    assert passage in got[0] and got[1].startswith("Go. On u")
    lines = [" ".join(f"v{rng.randrange(50)}" for _ in range(rng.randint(1, 12))) + rng.choice([".", "", "!"]) for _ in range(60)]
    texts = [*ODD[:6], *(rng.choice(["\n", " "]).join(rng.choice(lines) for _ in range(rng.randint(1, 40))) for _ in range(40))]
    for _ in range(40):
        a = rng.randrange(50)
        texts.append(rng.choice(["\n", " \n\n", "\n"]).join([rng.choice(lines), *lines[a : a + rng.randint(2, 9)], rng.choice(lines)]))
    texts += [texts[20], "y. " * 200, "y. " * 90]
    got = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in line_dedup.dedup_lines(docs(spark, texts, extra=False), run_words=15, both_ways=True).collect()}
    want = plain_stretch_dedup(texts, 15)
    assert [got[i] for i in range(len(texts))] == want and want != plain_line_dedup(texts, 15)


def test_line_dedup_keeps_repeated_ids_and_refuses_its_names(spark):
    text = lambda k: ". ".join(f"line number {k} {j} has a few words of its own" for j in range(8)) + ". "
    df = spark.createDataFrame([(1, text(1)), (1, text(2)), (2, text(1)), (2, text(3)), (1, text(1))], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["text"], r["n_deleted"]) for r in line_dedup.dedup_lines(df).collect())
    assert got == sorted([(1, text(1), 0), (1, text(1), 0), (1, text(2), 0), (2, "", 8), (2, text(3), 0)])
    far = df.selectExpr("if(doc_id = 2, 9000000000000000000, doc_id) as doc_id", "text")
    assert sorted(r["n_deleted"] for r in line_dedup.dedup_lines(far).collect()) == [0, 0, 0, 0, 8]
    with pytest.raises(ValueError, match="n_deleted"):
        line_dedup.dedup_lines(df.selectExpr("*", "1 as n_deleted"))


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(docs(spark, [], extra=False)).count() == 0


# ---- 2


def best_distance(item, text):
    """Least edits of the item against any stretch of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def norm(t):
    code, _, _ = decontaminate.normalised([t])
    return "".join(map(chr, code[1:])).strip()


def test_decontamination_equals_the_plain_recurrence(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(rng.randint(8, 25))) for _ in range(8)] + ["tiny", "seventeen letters", "ten letter", "!?", ""]
    texts = list(ODD)
    for _ in range(60):
        t, edits = rng.choice(items[:8] + items[9:11]), rng.randint(0, 12)
        t = list(t)
        for _ in range(edits):
            p = rng.randrange(len(t))
            t[p : p + 1] = rng.choice([[], [rng.choice("abcxyz")], [t[p], "q"]])
        texts.append(" ".join(word() for _ in range(9)) + " " + "".join(t).upper() + ",  " + word())
    texts += ["tiny things", " Tiny.\n"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r["id"], r["item_id"]): r["edits"] for r in decontaminate.matches(docs(spark, texts, extra=False), bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(map(norm, items)):
            n = best_distance(item, norm(t)) if t and len(t) < 2000 else 99
            if item and n <= int(len(item) * decontaminate.EDIT_RATE) and (len(item) >= decontaminate.Q or item == norm(t)):
                want[d, i] = n
    assert got == want and len(want) > 20 and (len(texts) - 1, 8) in want
    kept = {r["doc_id"] for r in decontaminate.clean(docs(spark, texts), bench).collect()}
    assert kept == {None, *range(len(texts))} - {d for d, _ in want}


def test_decontamination_does_not_depend_on_neighbours(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(rng.randint(4, 25))) for _ in range(6)] + ["tiny"]
    texts = []
    for _ in range(80):
        t = f"{word()} {rng.choice(items)} {word()}"
        p = rng.randrange(len(t) + 1)
        texts += [t[:p], t[p:], rng.choice(["", None, "tiny", t])]
    indexes = [decontaminate.Index(q, a) for q, a in decontaminate.indexes_of(list(enumerate(items)), decontaminate.Q, decontaminate.EDIT_RATE).items()]
    alone = [(r, *x[1:]) for r, t in enumerate(texts) for x in decontaminate.find([t], indexes)]
    assert sorted(decontaminate.find(texts, indexes)) == sorted(alone) and 40 < len(alone)
    monkeypatch.setattr(decontaminate, "HITS", 50)
    monkeypatch.setattr(decontaminate, "CELLS", 100)
    assert sorted(decontaminate.find(texts, indexes)) == sorted(alone)


def test_decontamination_by_items_with_one_opening():
    rng = random.Random(3)
    opening = "answer the following question about the passage above in one short sentence only "
    items = [opening + "".join(rng.choice("abcdefgh ") for _ in range(40)) for _ in range(600)]
    indexes = [decontaminate.Index(q, a) for q, a in decontaminate.indexes_of(list(enumerate(items)), decontaminate.Q, decontaminate.EDIT_RATE).items()]
    text = " ".join([opening] * 20 + [items[7], items[599]])
    assert {7, 599} <= {k for _, k, *_ in decontaminate.find([text], indexes)}


def test_decontamination_by_items_without_id(spark):
    items = ["the quick brown fox jumps over the lazy dog at noon", "seventeen small boats lay in the harbour that night"]
    bench = spark.createDataFrame([(None, items[0]), (5, items[1]), (None, None)], "item_id bigint, text string")
    df = docs(spark, [f"before {items[0]} after", f"x {items[1]} y {items[0]} z", "nothing of them"], extra=False)
    got = {(r["id"], r["item_id"], r["edits"]) for r in decontaminate.matches(df, bench).collect()}
    assert got == {(0, None, 0), (1, 5, 0), (1, None, 0)}
    assert [r["doc_id"] for r in decontaminate.clean(df, bench).collect()] == [2]


def test_decontamination_without_items(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.matches(docs(spark, ODD), none).count() == 0 and decontaminate.clean(docs(spark, ODD), none).count() == len(ODD) + 1


# ---- 4


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(25, 24))
    v = [(b + rng.normal(size=24) * s).astype(np.float32) for b in base for s in (0, 0.05, 0.1, 0.18, 0.2, 0.22)]
    v += [v[0], v[0] * 3, np.zeros(24, np.float32), np.full(24, np.nan, np.float32)]
    rows = [(i, [float(x) for x in a], int(i % 2 == 0 or i > 140)) for i, a in enumerate(v)] + [(900, None, 1), (901, [1.0, None], 1), (902, [1.0, 2.0], None), (903, [2.0, 4.0], 1), (904, [1.0, 2.0], 1)]
    got = {r["id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}

    def cosine(i, j):
        a, b = (np.array(rows[k][1], np.float64) if rows[k][1] and None not in rows[k][1] else None for k in (i, j))
        if a is None or b is None or len(a) != len(b) or rows[i][2] != rows[j][2] or rows[i][2] is None or not (np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any()):
            return -1
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    link = [[i != j and cosine(i, j) >= 0.98 for j in range(len(rows))] for i in range(len(rows))]
    want = groups(len(rows), lambda i, j: link[i][j])
    for k, r in enumerate(rows):
        assert got[r[0]]["n_links"] == sum(link[k])
        assert got[r[0]]["component_id"] == rows[want[k]][0]
        assert got[r[0]]["kept"] == (want[k] == k)


@pytest.mark.parametrize("size", [64, 768])
def test_probes_of_any_dimension_are_few_and_lose_nothing(spark, size):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, size))
    v = np.concatenate([base, *(base + rng.normal(size=(40, size)) * s for s in (0.1, 0.17, 0.2))])
    rows = [(i, [float(x) for x in a], 1) for i, a in enumerate(v)]
    got = {r["id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    u = embedding_dedup.unit(v)
    want = ((u @ u.T) >= 0.98).sum(axis=1) - 1
    assert [got[i] for i in range(len(v))] == want.tolist() and want.sum() > 40
    owner, level, _ = embedding_dedup.probes(u[:, :16], 0.005)
    assert np.bincount(owner).max() <= embedding_dedup.PROBES and set(owner) == set(range(len(v))) and level.min() >= embedding_dedup.STEP


def test_embeddings_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [0.0, 1.0], 1), (2, [1.0, 0.02], 1), (3, [0.0, 1.0], 1), (4, [-1.0, 0.0], 1)]
    got = sorted((r["id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 1, 2), (2, 2, 1), (3, 1, 2), (4, 0, 4)]


def test_embeddings_of_nothing(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


# ---- 7, 5


def test_language_id_on_held_out_documents(spark):
    got = op7_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_edges(spark):
    df = docs(spark, [*ODD, "12 34 !!"]).withColumnRenamed("key", "lang")
    model = language_id.train(df)
    got = {r["id"]: r for r in language_id.identify(df, model).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[len(ODD)]["lang_pred"] == "und" and got[3]["lang_pred"] == "clash"
    assert language_id.train(df.filter("false")) is None
    assert {r["lang_pred"] for r in language_id.identify(df, None).collect()} == {"und"}


def plain_cross_entropies(train, texts, order=4):
    """Nats per character of each text in each language, by dictionaries."""

    def codes(t):
        out = []
        for c in t:
            c = c.lower() if c.isalpha() else " "
            if c != " " or (out and out[-1] != " "):
                out.append(c)
        return ["^"] * (order - 1) + out

    langs = sorted({x for x, _ in train})
    counts = {lang: [Counter() for _ in range(order)] for lang in langs}
    for lang, t in train:
        c = codes(t)
        counts[lang][-1].update(tuple(c[k - order + 1 : k + 1]) for k in range(order - 1, len(c)))
    for lang in langs:
        for k in range(order - 2, -1, -1):
            counts[lang][k] = Counter(g[1:] for g in counts[lang][k + 1])
    alphabet = len({g for lang in langs for g in counts[lang][0]}) + 1

    def p(lang, g):
        if not g:
            return 1 / alphabet
        level = counts[lang][len(g) - 1]
        d = [0, *language_id.discounts(*[sum(n == j for n in level.values()) for j in (1, 2, 3, 4)])]
        same = [(n, d[min(n, 3)]) for x, n in level.items() if x[:-1] == g[:-1]]
        total = sum(n for n, _ in same)
        if not total:
            return p(lang, g[1:])
        n = level[g]
        return max(n - d[min(n, 3)], 0) / total + sum(x for _, x in same) / total * p(lang, g[1:])

    out = []
    for t in texts:
        c = codes(t)
        grams = [tuple(c[k - order + 1 : k + 1]) for k in range(order - 1, len(c))]
        out.append({lang: -sum(np.log(p(lang, g)) for g in grams) / len(grams) for lang in langs})
    return out


def test_language_id_equals_plain_kneser_ney(spark):
    train = [("aa", "the cat sat on the mat, the hat!"), ("bb", "le chat est sur la table et le chien"), ("aa", "a cat and a hat"), ("bb", "la table, le chat.")]
    texts = ["the hat", "le chien  sur", "Zebra qu", "a", "la cat: table"]
    model = language_id.train(spark.createDataFrame([(i, *x) for i, x in enumerate(train)], "doc_id bigint, lang string, text string"))
    got, size, _ = language_id.Scorer(model).cross_entropies(texts)
    for row, want, n in zip(got, plain_cross_entropies(train, texts), size, strict=True):
        assert dict(zip(model.langs, row)) == pytest.approx(want, rel=1e-4) and n > 0
    rows = language_id.identify(spark.createDataFrame(list(enumerate([*texts, "z"])), "doc_id bigint, text string"), model).orderBy("id").collect()
    assert [r["lang_pred"] for r in rows[:5]] == [min(x, key=x.get) for x in plain_cross_entropies(train, texts)]


def test_language_id_ties_and_rejection(spark):
    same = spark.createDataFrame([(1, "b", "one two three"), (2, "a", "one two three")], "doc_id bigint, lang string, text string")
    assert language_id.identify(same, language_id.train(same)).first()["lang_pred"] == "a"
    rng = random.Random(6)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(150)] for lang, letters in (("a", "aeioutrnsl"), ("b", "aouäkptvlim"))}
    rows = [(i, lang, " ".join(rng.choice(words[lang]) for _ in range(30))) for i, lang in enumerate(["a", "b"] * 700)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))
    new = [" ".join(rng.choice(words["b"]) for _ in range(30)), "".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(300)), "это другой язык и другие буквы здесь"]
    got = language_id.identify(spark.createDataFrame(list(enumerate(new)), "doc_id bigint, text string"), model).orderBy("id").collect()
    assert [r["rejected"] for r in got] == [False, True, True] and got[0]["lang_pred"] == "b" and got[0]["score"] > 0.99


def test_quality_agrees_with_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op5_quality(spark, SF).join(labels.withColumnRenamed("toxic", "is_toxic"), "doc_id").collect()
    poor = [r for r in got if r["quality"] == 0]
    clean = [r for r in got if r["quality"] == 1 and r["is_toxic"] == 0]
    assert sum(not r["kept"] for r in poor) >= 0.93 * len(poor) and sum(r["kept"] for r in clean) >= 0.98 * len(clean)


def test_quality_edges(spark):
    df = docs(spark, ODD)
    rows = {r["doc_id"]: r for r in quality.judge(df, quality.train(df), prefix="q_").collect()}
    assert len(rows) == len(ODD) + 1 and rows[0]["q_poor"] >= 0 and rows[7]["q_poor"] == rows[8]["q_poor"]
    none = docs(spark, [], extra=False)
    assert quality.judge(none, quality.train(none)).count() == 0


def test_quality_score_equals_plain_sums(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    vocabulary, bad = [word() for _ in range(200)], ["grobble", "snark", "yuckfest"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(40)) + (f" {rng.choice(bad)} {rng.choice(bad)}" if i % 4 == 0 else "") + (" ###|| " * 8 if i % 5 == 0 else "") for i in range(400)]
    df = docs(spark, texts, extra=False)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400, 2)], "doc_id bigint, toxic int")
    model = quality.train(df, labels=labels)
    rows = {r["doc_id"]: r for r in quality.judge(df, model).collect()}
    assert all((rows[i]["toxic"] >= 0.5) == (i % 4 == 0) for i in range(400))  # also where no label was given
    size = 1 << quality.HASH_BITS
    for i in (0, 1, 4, 5, 399):
        _, _, q, t, _, _ = next(quality.votes(pa.array([texts[i]]), model.lists))
        tokens = [int(next(token_chunks(pa.array([w])))[2][0]) for w in texts[i].split()] + [int(END)]
        for name, target, v in (("poor", model.quality, q[0]), ("toxic", model.toxic, t[0])):
            plain = target.bias + sum(target.weights[x >> (64 - quality.HASH_BITS)] for x in tokens) / len(tokens) + sum(target.weights[size + 3 * k + int(x)] for k, x in enumerate(v))
            assert rows[i][name] == pytest.approx(1 / (1 + np.exp(-plain)), rel=1e-9)
            assert rows[i][f"{name}_label"] == target.posterior[sum(int(x) * 3**k for k, x in enumerate(v))]
    with pytest.raises(ValueError, match="toxic"):
        quality.judge(df.selectExpr("*", "1 as toxic"), model)


def test_quality_without_labels_uses_seed_words(spark):
    texts = ["You worthless idiot, you are scum.", "A quiet evening by the sea with friends."] * 30
    rows = quality.judge(docs(spark, texts, extra=False), quality.train(docs(spark, texts, extra=False))).collect()
    assert all((r["toxic"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in rows)


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.3
    votes = np.stack([np.where(rng.random(20_000) < a, truth, ~truth).astype(int) for a in (0.95, 0.85, 0.75, 0.9)], axis=1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    _, vote, prior = quality.expectation_maximisation(patterns, n.astype(float), 200)
    assert abs(prior - 0.3) < 0.03 and np.allclose([vote[1, j, 1] for j in range(4)], (0.95, 0.85, 0.75, 0.9), atol=0.03)


# ---- 8


def test_written_url_rules(spark):
    urls = ["http://Example.ORG/es/x", "http://a.example.org/en/1?x=/", "http://example.org/en/2", "https://x.com/fr/", "https://com/de/", "https://x.com", "http://xcom/de/", None, "no scheme/org/", "ftp://u@h:1/p#://z", "http://b.org?q"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id bigint, url string, rule string")
    mined = spark.createDataFrame([], "items array<array<string>>, tokens array<string>, key string, confidence double, lift double, support double")
    got = {r["page_id"]: r for r in url_filters.judge(pages, mined, url_filters.written_rules(spark, URL_RULES), keep=["page_id"]).collect()}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert (got[9]["host"], got[9]["path"], got[7]["host"]) == ("u@h:1", "/p", "")


@pytest.mark.parametrize("limit", [20_000, 0])
def test_mined_url_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", limit)
    rng = random.Random(6)
    rows = []
    for i in range(600):
        host, word, key = rng.choice(["a", "b", "spam"]), rng.choice(["news", "win", "home"]), rng.choice(["ref", "page"])
        bad = host == "spam" or (word == "win" and key == "ref")
        rows.append((i, f"http://{host}.net/{word}/{i}?{key}=1", bad if rng.random() < 0.97 else not bad))
    df = spark.createDataFrame(rows, "page_id bigint, url string, bad boolean")
    mined = url_filters.mine_rules(df, "url", df.bad, 0.02, 0.8)
    rules = [(set(r["tokens"]), r["confidence"]) for r in mined.collect()]
    assert {"h:spam"} in [t for t, _ in rules] and {"p:win", "q:ref"} in [t for t, _ in rules]
    tokens = {r[0]: set(r[1]) for r in df.select("page_id", url_filters.url_tokens(df.url)).collect()}
    for t, c in rules:
        hit = [r[2] for r in rows if t <= tokens[r[0]]]
        assert c == pytest.approx(sum(hit) / len(hit))
    # Plain counting over all sets of up to three tokens finds no rule that these don't imply.
    import itertools

    common = sorted({t for own in tokens.values() for t in own if sum(t in tokens[r[0]] and r[2] for r in rows) >= 12})
    for size in (1, 2, 3):
        for some in itertools.combinations(common, size):
            hit = [r[2] for r in rows if set(some) <= tokens[r[0]]]
            if sum(hit) >= 12 and sum(hit) / len(hit) >= 0.8:
                assert any(t <= set(some) and c >= sum(hit) / len(hit) - 1e-9 for t, c in rules)
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(df, mined, url_filters.written_rules(spark, []), keep=["page_id"]).collect()}
    assert got == {i: "block" if any(t <= tokens[i] for t, _ in rules) else "allow" for i in tokens}


def test_many_shared_url_words_are_one_item(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    urls = [(i, f"http://shop.net/{'/'.join(words)}/{i}", i % 10 != 0) for i in range(60)] + [(100 + i, f"http://a.net/page{i}", False) for i in range(300)]
    df = spark.createDataFrame([(i, u, b, "x") for i, u, b in urls], "page_id bigint, url string, bad boolean, host string")
    mined = url_filters.mine_rules(df, "url", df.bad)
    rules = {tuple(r["tokens"]): (r["confidence"], [len(x) for x in r["items"]]) for r in mined.collect()}
    assert len(rules) == 1 and next(iter(rules.values())) == (pytest.approx(0.9), [42])
    new = spark.createDataFrame([(1, f"http://other.net/{words[7]}"), (2, "http://a.net/page3")], "page_id bigint, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.judge(new, mined, url_filters.written_rules(spark, []), keep=["page_id"]).collect()} == {1: "block", 2: "allow"}
    with pytest.raises(ValueError, match="host"):
        url_filters.judge(df, mined, url_filters.written_rules(spark, []))


def test_url_tokens_are_whole(spark):
    slug = "a" * 64
    df = spark.createDataFrame([(f"http://h.net/{slug}x",), (f"http://h.net/{slug}y",)], "url string")
    assert [set(r[0]) for r in df.select(url_filters.url_tokens(df.url)).collect()] == [{"h:h", "h:net", f"p:{slug}{c}"} for c in "xy"]


def test_url_query_keeps_every_row(spark):
    assert op8_url_filters(spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()


# ---- 3


def test_license_scan_and_inheritance(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License.\n", True), ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0.", True),
        ("a/x.py", "code. more code", False), ("a/b/c/y.py", "text", False), ("a/b/z.py", "top\nThis work is licensed under the GNU General Public License, version 3. tail", False),
        ("q/n.py", None, False), ("r.py", "", False), (None, "Licensed under CC BY-NC 4.0.", False), ("a/x.py", "code. more code", False), ("a/long.py", "plain words here. " * 2000, False),
    ]
    df = spark.createDataFrame([(*f, "clash") for f in files], "path string, text string, is_license_file boolean, dir string")
    with pytest.raises(ValueError, match="cosine"):
        license_scan.own_licenses(df.withColumnRenamed("dir", "Cosine"))
    got = license_scan.inherit(license_scan.own_licenses(df)).collect()
    by = {r["path"]: (r["own_license"], r["license"], r["inherited_from"]) for r in got}
    assert len(got) == len(files)
    assert by["a/LICENSE"][:2] == ("MIT", "MIT") and by["a/b/LICENSE"][0] == "Apache-2.0" and by["a/b/z.py"] == ("GPL-3.0", "GPL-3.0", None)
    assert by["a/x.py"] == (None, "MIT", "a") and by["a/b/c/y.py"] == (None, "Apache-2.0", "a/b") and by["q/n.py"] == (None, None, None) == by["r.py"] and by[None][0] == "CC-BY-NC-4.0" and by["a/long.py"][1] == "MIT"


def plain_cosines(texts, templates):
    """The best cosine of each text, by dictionaries over every start of a line and every template."""
    import math
    import re

    lines = lambda t: [re.findall(r"[^\W_]+", x.lower()) for x in re.split(r"[.!?][ \t]+|\n", t or "")]
    words = [{w for line in lines(t) for w in line} for t in texts]
    idf = lambda w: 1 - math.log(sum(w in s for s in words) / len(texts) + license_scan.SMOOTH)
    vector = lambda ws: {w: n * idf(w) for w, n in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for t in texts:
        own, best = lines(t), 0.0
        for k, line in enumerate(own):
            rest = [w for x in own[k:] for w in x]
            for _, template in templates:
                ws = [w for x in lines(template) for w in x]
                if line and (len(ws) > license_scan.SHORT or len(line) == len(ws)):
                    a, b = vector(rest[: len(ws)]), vector(ws)
                    best = max(best, sum(x * b.get(w, 0) for w, x in a.items()) / norm(a) / norm(b))
        out.append(best)
    return out


def test_license_cosine_equals_dictionaries(spark):
    texts = ["Licensed under the MIT License, Version 2.0.", "under the General Public License version 9", "nothing here", "# Released under\n# the Apache License.", "MIT License\n\nmore", "The MIT License is short", None, ""]
    texts += ["x = 1\n" + license_scan.TEMPLATES[-6][1].replace(", ", ",\n// ") + "\ny = 2"]
    got = {r["doc_id"]: r["cosine"] for r in license_scan.own_licenses(docs(spark, texts, extra=False), min_cosine=0.05).collect()}
    for i, want in enumerate(plain_cosines(texts, license_scan.TEMPLATES)):
        assert (got[i] or 0) == pytest.approx(want if want >= 0.05 else 0, abs=1e-6)


@pytest.mark.parametrize("size", [0, 400, 4000])
def test_wrapped_and_commented_notices_at_any_size(spark, size):
    import textwrap

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    code = lambda n: "\n".join(f"{word()} = {word()}({word()}, {rng.randrange(99)})" for _ in range(n))
    texts, want = [], []
    for name, notice in license_scan.TEMPLATES:
        mark = rng.choice(["# ", "// ", " * ", ";; "])
        body = "\n".join(mark + line for line in textwrap.wrap(notice, 70))
        texts.append(f"{code(3)}\n{mark}Copyright (c) 2021 {word()} {word()}\n{mark}\n{body}\n{code(4)}")
        want.append(name)
    clean = ["The museum renewed its license to serve food. The terms of the permit were published in version two.", "Anyone is free to use, copy or sell this recipe without any warranty of taste.", code(30), "Permission was granted to the school to use the field, subject to conditions."]
    filler = [" ".join(word() for _ in range(30)) for _ in range(size)]
    got = {r["doc_id"]: r["own_license"] for r in license_scan.own_licenses(docs(spark, [*texts, *clean, *filler], extra=False)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert all(got[i] is None for i in range(len(texts), len(got)))
