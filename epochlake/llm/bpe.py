"""BPE encoding and decoding (operator 10): batched numpy merge rounds.

``BpeCodec`` reads the vocabulary and the merges of a tokenizer file whose words end in ``</w>``. The distinct
words of a batch become one flat array of symbol ids with a word number each. A round looks up every neighbouring
pair in the sorted array of pair keys (binary search), finds the lowest rank in each word, merges all its
occurrences from left to right, and compacts the array; words without a known pair leave. A word of more than ``LONG``
bytes goes through the same rounds alone, by lists of places per rank, so its time is n log n. Spark deals out the
documents; a task holds one Arrow batch and a bounded cache of encoded words. Letters, digits and lower case are those of the
Unicode version that the library knows.

Defined results: a null or empty text, or one of white space alone, has no ids, and decodes to the empty text.
The strings of special tokens in a text become their ids, as in the library. Rows are kept one for one,
repeated rows included; other columns are carried along. Names that the result adds are refused among those kept. A
text is taken whole: n bytes take some 40 n in its task.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import refuse_columns, small_batches

#: Fixed value: how the tokenizer file splits normalised text into words.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Ranges of characters that Unicode has gained as letters or digits since the version of the library's splitter; there they are neither.
NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x1C89, 0x1C89), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CB, 0xA7CC), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DA, 0xA7DA), (0xA7DC, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10D50, 0x10D65), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x16FF4, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: Lower case of characters that Python's tables don't know yet: (first, last, step to the lower form).
NEWER_LOWER = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]
LOWER = {c: chr(c + step) for a, b, step in NEWER_LOWER for c in range(a, b + 1)}
_NEW = "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in NEWER) + "]"
IS_NEWER = regex.compile(_NEW)
#: Any character from the first of those on: one range, so that most texts are told apart quickly.
MAY_BE_NEWER = re.compile(f"[{chr(NEWER[0][0])}-\U0010ffff]")
WORD_OLDER = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--{_NEW}]+|[\p{{N}}--{_NEW}]|[[^\s\p{{L}}\p{{N}}]||{_NEW}]+")
#: Fixed value: white space as the file's normaliser means it.
SPACES = regex.compile(r"\s+")
END = "</w>"
SIGMA = "\u03a3"
#: Bytes of a word from which it is merged on its own.
LONG = 512
#: Words kept per Python worker; beyond it the cache starts anew.
CACHE_WORDS = 120_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stays, the others follow from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class BpeCodec:
    """Encodes words in batches. ``path`` is the tokenizer file; it is read where the codec is used."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        symbols = byte_symbols()
        inner = np.array([vocab[s] for s in symbols], np.int64)
        last = np.array([vocab[s + END] for s in symbols], np.int64)
        self.byte_ids = np.stack([inner, last])
        self.width = np.int64(len(vocab) + 1)
        first: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            first.setdefault(vocab[a] * int(self.width) + vocab[b], (rank, vocab[a + b]))
        self.keys = np.array(sorted(first), np.int64)
        self.ranks = np.array([first[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([first[k][1] for k in self.keys.tolist()], np.int64)
        # With each merge's products in later ranks alone, all pairs of the lowest rank may be merged at once.
        least: dict[int, int] = {}
        for key, (rank, _) in first.items():
            for symbol in divmod(key, int(self.width)):
                least[symbol] = min(rank, least.get(symbol, rank))
        self.later = all(least.get(made, rank + 1) > rank for rank, made in first.values())
        self.cache: dict[str, tuple[int, str, str]] = {}

    def rank_of(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pair keys; the rank is the number of keys where there is none."""
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        known = self.keys[at] == pair
        return np.where(known, self.ranks[at], len(self.keys)), self.merged[at]

    def encode_long(self, raw: bytes) -> list[int]:
        """Token ids of one long word: a round merges all pairs of the lowest rank, found by rank in lists of places.

        Symbols are linked, so a round touches only its pairs and their neighbours: n log n steps in all, where rounds over the whole
        word would take as many passes as it has ranks.
        """
        n, none = len(raw), len(self.keys)
        ids = self.byte_ids[0, np.frombuffer(raw, np.uint8)]
        ids[-1] = self.byte_ids[1, raw[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, none)  # of the pair that begins at each place
        rank[:-1], _ = self.rank_of(ids[:-1] * self.width + ids[1:])
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[rank[at] < none]
            at = at[np.argsort(rank[at], kind="stable")]
            edges = np.flatnonzero(np.diff(rank[at], prepend=-1))
            for part, r in zip(np.split(at, edges[1:]), rank[at[edges]].tolist(), strict=True) if len(at) else ():
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(part)

        add(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]  # what has been merged since is gone
            touching = np.append(False, after[at[:-1]] == at[1:])
            if touching.any():  # of a a a every other pair from the left
                first = np.flatnonzero(~touching)
                nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                at = at[nth % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            ids[at] = self.rank_of(ids[at] * self.width + ids[gone])[1]
            rank[gone] = none
            ids[gone] = -1
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            changed = np.unique(np.concatenate([at, before[at]]))
            changed = changed[changed >= 0]
            ends = after[changed] >= n
            rank[changed[ends]] = none
            changed = changed[~ends]
            rank[changed], _ = self.rank_of(ids[changed] * self.width + ids[after[changed]])
            add(changed)
        return ids[ids >= 0].tolist()

    def encode_words(self, batch: list[str]) -> list[list[int]]:
        """Token ids of each word, by merge rounds over all words at once; long words go alone."""
        raw = [w.encode() for w in batch]
        if self.later and any(len(r) > LONG for r in raw):
            short = iter(self.encode_words([w for w, r in zip(batch, raw, strict=True) if len(r) <= LONG]))
            return [self.encode_long(r) if len(r) > LONG else next(short) for r in raw]
        if not raw:
            return []
        sizes = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        is_last = np.zeros(len(flat), np.int64)
        is_last[ends - 1] = 1
        ids, owner = self.byte_ids[is_last, flat], np.repeat(np.arange(len(raw)), sizes)
        done_ids, done_owner = [], []
        none = np.int64(len(self.keys))
        while len(ids):
            pair = ids[:-1] * self.width + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lengths = np.diff(np.append(heads, len(ids)))
            best = np.repeat(np.minimum.reduceat(np.append(rank, none), heads), lengths)
            over = best == none
            done_ids.append(ids[over])
            done_owner.append(owner[over])
            hit = np.append(rank, none) == best
            hit &= ~over
            hit = self._left_first(hit)
            where = np.flatnonzero(hit)
            ids[where] = self.merged[at[where]]
            keep = ~over
            keep[where + 1] = False
            ids, owner = ids[keep], owner[keep]
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(raw))
        bounds, ids = np.concatenate([[0], np.cumsum(counts)]).tolist(), ids[order].tolist()
        return [ids[bounds[k] : bounds[k + 1]] for k in range(len(raw))]

    @staticmethod
    def _left_first(hit: np.ndarray) -> np.ndarray:
        """Of touching occurrences (a a a), keep every other one from the left."""
        where = np.flatnonzero(hit)
        if len(where) < 2 or not (np.diff(where) == 1).any():
            return hit
        run = np.flatnonzero(np.concatenate([[True], np.diff(where) != 1]))
        nth = np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where))))
        out = np.zeros_like(hit)
        out[where[nth % 2 == 0]] = True
        return out

    def split(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        if not self.special_pattern or "<|" not in text:
            return self._plain(text)
        out, start = [], 0
        for m in self.special_pattern.finditer(text):
            out += self._plain(text[start : m.start()])
            out.append(" " + m[0])  # no word holds a space
            start = m.end()
        return out + self._plain(text[start:])

    @staticmethod
    def _plain(text: str) -> list[str]:
        if text.isascii():
            return WORD.findall(text.lower())
        text = SPACES.sub(" ", unicodedata.normalize("NFC", text))
        if MAY_BE_NEWER.search(text) and IS_NEWER.search(text):
            return WORD_OLDER.findall("".join(LOWER.get(ord(c)) or c.lower() for c in text))
        # Python lowers a text as it does its characters, but for the capital sigma, whose form depends on its neighbours.
        return WORD.findall("".join(c.lower() for c in text) if SIGMA in text else text.lower())

    def learn(self, found: set[str]) -> None:
        """Put what is new among the words into the cache: (tokens, ids text, decoded text)."""
        if len(self.cache) + len(found) > CACHE_WORDS:
            self.cache.clear()
        new = [w for w in found if w not in self.cache]
        plain = [w for w in new if w[0] != " "]
        for w in new:
            if w[0] == " ":
                i = self.special[w[1:]]
                self.cache[w] = (1, str(i), self.token[i])
        if plain:
            for w, ids in zip(plain, self.encode_words(plain), strict=True):
                self.cache[w] = (len(ids), " ".join(map(str, ids)), self.decode(ids))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as the library does for a file without a decoder."""
        return " ".join(self.token[i] for i in ids)

    def ids(self, text: str) -> list[int]:
        found = self.split(text)
        self.learn(set(found))
        return [int(i) for w in found for i in self.cache[w][1].split(" ")]


def _codec(path: str) -> BpeCodec:
    """One codec per Python worker and file."""
    global _LOADED  # noqa: PLW0603
    if _LOADED is None or _LOADED[0] != path:
        _LOADED = (path, BpeCodec(path))
    return _LOADED[1]


_LOADED: tuple[str, BpeCodec] | None = None
#: Characters of text looked at together; one longer text is still taken whole.
CHUNK = 500_000


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > CHUNK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Encode and decode a text column.

    Returns the columns ``keep`` (default: all but the text) and ``ids`` (array, if ``with_ids``), ``n_tokens``,
    ``decoded``, ``ids_sha256`` and ``decoded_sha256``; the two texts of digests are hashed where they are made, so
    they need not travel. With ``with_ids=False`` ``ids`` and ``decoded`` are left out.
    """
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != text] if keep is None else keep
    refuse_columns(keep, ["ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256", "__text"])
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    extra = ([pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())] if with_ids else []) + [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    kinds = ("ids array<int>, decoded string, " if with_ids else "") + "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("__text").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            n_tokens, id_sha, text_sha, all_ids, decoded = [], [], [], [], []
            for part in _chunks([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]):
                split = [codec.split(t) for t in part]
                codec.learn(set().union(*split))
                for found in split:
                    got = [codec.cache[w] for w in found]
                    id_text, plain = " ".join([g[1] for g in got]), " ".join([g[2] for g in got])
                    n_tokens.append(sum([g[0] for g in got]))
                    id_sha.append(hashlib.sha256(id_text.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(plain.encode()).hexdigest())
                    if with_ids:
                        all_ids.append([int(i) for i in id_text.split(" ")] if id_text else [])
                        decoded.append(plain)
            made = ([pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if with_ids else []) + [pa.array(n_tokens, pa.int64()), pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string())]
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(kept + made, names=[*batch.schema.names[:-1], *(f.name for f in extra)])

    return source.mapInArrow(run, f"{schema}, {kinds}" if schema else kinds)
