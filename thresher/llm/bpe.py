"""Byte-pair encoding whose merge order comes from a segment tree over pair ranks.

For one word the leaves hold the rank of each adjacent pair, the inner nodes
the least (rank, position) below them. The root is the leftmost pair of lowest
rank; merging it changes three leaves, each put right in logarithmic time.
The distinct words of a batch are merged together, a tree for each, one merge
of every unfinished word at a time. Words repeat, so a bounded per-worker
cache keeps what each chunk between white space encodes to.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher.llm._common import claim, table, text_or_empty, worker_cache

#: Chunks in a generation of a worker's memory; the last one is kept beside it.
CACHE_CHUNKS = 150_000
#: Characters of text that are encoded at a time, and words whose trees are.
LETTERS, TREES = 2_000_000, 8192
#: Symbols in a word from which it gets its tree alone.
LONG = 64

#: Unicode White_Space, as the inside of a character class.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTROLS = re.compile("[\x1c-\x1f]")

_NONE = 1 << 62


def merge_word(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """Merge `symbols` until no pair is left. `pairs`: (left << 32 | right) to (rank, merged)."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * size)
    sym = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    get = pairs.get
    for i in range(n - 1):
        hit = get(sym[i] << 32 | sym[i + 1])
        if hit is not None:
            tree[size + i] = hit[0] * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        if tree[i] == value:
            return
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1

    while tree[1] != _NONE:
        i = tree[1] % size
        j = after[i]
        k = after[j]
        sym[i] = get(sym[i] << 32 | sym[j])[1]
        sym[j] = -1
        after[i] = k
        if j < size:
            put(j, _NONE)
        if k < n:
            before[k] = i
            hit = get(sym[i] << 32 | sym[k])
            put(i, _NONE if hit is None else hit[0] * size + i)
        else:
            put(i, _NONE)
        h = before[i]
        if h >= 0:
            hit = get(sym[h] << 32 | sym[i])
            put(h, _NONE if hit is None else hit[0] * size + h)
    return [s for s in sym if s >= 0]


class Pairs:
    """Ranks of pairs of symbols and what they merge to, for whole arrays."""

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.merged = np.full(int(self.ranks.max(initial=-1)) + 1, -1, dtype=np.int64)
        self.merged[self.ranks] = [pairs[k][1] for k in self.keys.tolist()]
        self.seen = np.zeros(1 << 18, dtype=bool)
        self.seen[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1; negative symbols are none."""
        out = np.full(left.shape, -1, dtype=np.int64)
        keys = left << 32 | right
        at = np.flatnonzero((left >= 0) & (right >= 0) & self.seen[self._slot(keys)])
        if len(at):
            own = keys[at]
            place = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            out[at] = np.where(self.keys[place] == own, self.ranks[place], -1)
        return out


def merge_words(words: list[list[int]], pairs: Pairs) -> list[np.ndarray]:
    """What `merge_word` gives, for many words of between 2 and LONG symbols."""
    out: list[np.ndarray] = [np.zeros(0)] * len(words)
    classes: dict[int, list[int]] = {}
    for at, word in enumerate(words):
        classes.setdefault(1 << (len(word) - 2).bit_length(), []).append(at)
    for size, members in classes.items():
        for start in range(0, len(members), TREES):
            part = members[start : start + TREES]
            sym = np.full((len(part), size + 2), -1, dtype=np.int64)
            lengths = np.array([len(words[at]) for at in part])
            sym[np.arange(size + 2) < lengths[:, None]] = np.concatenate([words[at] for at in part])
            _merge(sym, size, pairs)
            kept = sym >= 0
            found = sym[kept].astype(np.int32)
            ends = np.cumsum(kept.sum(axis=1)).tolist()
            for at, start, end in zip(part, [0, *ends], ends):
                out[at] = found[start:end]
    return out


def _merge(sym: np.ndarray, size: int, pairs: Pairs) -> None:
    """Merges the words in the rows of `sym` in place; -1 stands where a symbol is gone or none was."""
    n, width = sym.shape
    after = np.tile(np.arange(1, width + 1), (n, 1))
    before = np.tile(np.arange(-1, width - 1), (n, 1))
    tree = np.full((n, 2 * size), _NONE, dtype=np.int64)

    def leaves(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        rank = pairs.rank(left, right)
        return np.where(rank < 0, _NONE, rank * size + at)

    tree[:, size:] = leaves(sym[:, :size].reshape(-1), sym[:, 1 : size + 1].reshape(-1), np.tile(np.arange(size), n)).reshape(n, size)
    half = size // 2
    while half:
        tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        half //= 2
    rows = np.arange(n)
    while True:
        rows = rows[tree[rows, 1] != _NONE]
        if not len(rows):
            return
        root = tree[rows, 1]
        i = root % size
        j = after[rows, i]
        k = np.minimum(after[rows, j], width - 1)
        h = before[rows, i]
        sym[rows, i] = made = pairs.merged[root // size]
        sym[rows, j] = -1
        after[rows, i] = k
        before[rows, k] = i
        first = np.flatnonzero(h >= 0)
        gone = np.flatnonzero(j < size)
        touched = np.concatenate([rows, rows[first], rows[gone]])
        place = np.concatenate([i, h[first], j[gone]])
        left = np.concatenate([made, sym[rows[first], h[first]]])
        right = np.concatenate([sym[rows, k], made[first]])
        values = leaves(left, right, place[: len(left)])
        place = place + size
        tree[touched, place] = np.concatenate([values, np.full(len(gone), _NONE)])
        while place[0] > 1:
            place = place >> 1
            tree[touched, place] = np.minimum(tree[touched, 2 * place], tree[touched, 2 * place + 1])


@functools.cache
def _later() -> frozenset[str]:
    """Characters that Python's own tables do not know yet, and those of `regex` do: the library's lie between."""
    unknown = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    return frozenset(regex.findall(r"\P{Cn}", unknown))


def _byte_alphabet() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    names = {b: chr(b) for b in shown}
    spare = 256
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


class WordBPE:
    """The tokenizer of a word-level BPE file: NFC, lower case, white space dropped, word ends marked."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the library's \\s is the Unicode property, Python's also has the separators 1C to 1F
        self._split = regex.compile(split.replace("\\s", SPACE))
        self._space = re.compile(f"[{SPACE}]+")
        self._path, self._library, self._later = path, None, _later()
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self._arrays = Pairs(self.pairs)
        alphabet = _byte_alphabet()
        self._byte = [vocab[c] for c in alphabet]
        self._last = [vocab[c + self.end] for c in alphabet]
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = np.array([tokens.get(i, "") for i in range(max(tokens) + 1)], dtype=object)
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _words(self, chunk: str) -> list[str]:
        """The words of a stretch of text without white space to split at."""
        if chunk.isascii():
            return self._split.findall(chunk.lower())
        if not self._later.isdisjoint(chunk):
            return self._asked(chunk)
        chunk = unicodedata.normalize("NFC", chunk)
        # one character at a time, so that a final sigma is lowered as any other
        low = "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()
        return self._split.findall(low)

    def _asked(self, chunk: str) -> list[str]:
        """The words as the library cuts them, for characters of which only it can tell what it takes them for."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        low = self._library.normalizer.normalize_str(chunk)
        return [low[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(low)]

    def _symbols(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        return [*map(self._byte.__getitem__, raw[:-1]), self._last[raw[-1]]]

    def _chunks(self, chunks: list[str]) -> None:
        """Puts the ids of chunks into the memory, as native 32-bit integers."""
        split = [self._words(chunk) for chunk in chunks]
        found: dict[str, bytes] = {}
        several: dict[str, list[int]] = {}
        for word in set().union(*split):
            symbols = self._symbols(word)
            if 2 <= len(symbols) <= LONG:
                several[word] = symbols
            else:
                found[word] = array("i", merge_word(symbols, self.pairs)).tobytes()
        found.update(zip(several, [ids.tobytes() for ids in merge_words(list(several.values()), self._arrays)]))
        for chunk, words in zip(chunks, split):
            self._new[chunk] = b"".join(map(found.__getitem__, words))

    def _parts(self, text: str) -> list[str | bytes]:
        """The chunks of a text, and ids where the string of an added token stands."""
        if self._special is None or not self._special.search(text):
            return self._space.split(text) if _CONTROLS.search(text) else text.split()
        out: list[str | bytes] = []
        for k, part in enumerate(self._special.split(text)):
            out += [np.int32(self.special[part]).tobytes()] if k % 2 else self._space.split(part)
        return out

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as native 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, letters = at + 1, len(texts[at])
            while end < len(texts) and letters + len(texts[end]) <= LETTERS:
                letters += len(texts[end])
                end += 1
            parts = [self._parts(t) for t in texts[at:end]]
            needed = {c for c in set().union(*parts) if type(c) is str}
            if len(self._new) + len(needed) > CACHE_CHUNKS:
                self._new, self._old = {}, self._new
            missing = [c for c in needed if c not in self._new]
            self._new.update((c, self._old[c]) for c in missing if c in self._old)
            self._chunks([c for c in missing if c not in self._new])
            get = self._new.get
            out += [b"".join([get(c, c) for c in part]) for part in parts]
            at = end
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes([text])[0], dtype=np.int32).tolist()

    def decode(self, ids) -> str:
        """Token texts joined by one space: the file names no decoder."""
        return " ".join(self.tokens[np.asarray(ids, dtype=np.int64)].tolist())


_LOADED: dict[str, WordBPE] = worker_cache("bpe", {})


def load(path: str) -> WordBPE:
    """The tokenizer of a file, kept by each worker."""
    claim("bpe")
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def _columns(path: str):
    def encode_decode(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        parts = bpe.encode_bytes([t or "" for t in texts.to_pylist()])
        ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
        values = np.frombuffer(b"".join(parts), dtype=np.int32)
        names = bpe.tokens[values]
        decoded = [" ".join(names[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        return pa.StructArray.from_arrays([ids, pa.array(decoded, pa.string())], ["ids", "decoded"])

    return F.arrow_udf(encode_decode, "struct<ids:array<int>,decoded:string>")


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` with the token ids of each text and what they decode to.

    Null text counts as empty: no ids, an empty string. Columns already named
    `ids` or `decoded` are replaced, all others stay. Texts of any length are
    encoded whole; equal texts give equal rows; an empty table stays empty.
    Strings of added tokens become their ids, as the library does by default.
    """
    coded = _columns(path)(text_or_empty(text))
    return df.withColumns({ids: coded["ids"], decoded: coded["decoded"]})


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document; null text counts as empty, rows that repeat an id are encoded each."""
    out = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
