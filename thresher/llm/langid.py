"""Language identification with segmentation-marginalised unigram models.

Every language has a probability for each piece of one fixed public
vocabulary. The probability of a word is the sum over all ways to cut it into
pieces, which the forward algorithm finds in one pass; the piece
probabilities are learned by expectation maximisation with forward and
backward sums over the words of a bounded training sample. All words of a
batch go forward together, character by character; each distinct one is summed
once, and nothing is kept between batches.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thresher.llm._common import claim, held_out, table, text_or_empty

#: Training documents for each language: the bound of the sample that the model is fitted on.
DOCS_PER_LANGUAGE = 500
#: Rounds of expectation maximisation.
ROUNDS = 3
#: Pseudo-counts that each language gets from the pieces of all languages together.
SMOOTHING = 2000.0
#: Texts whose words are summed together.
TEXTS = 1536
#: Sums that are held at a time, in letters by languages.
CELLS = 1_000_000
#: Confidence under which the pipeline's stage rejects a document.
MIN_SCORE = 0.5
#: The prediction for text that is null or has no letter.
UNDETERMINED = "und"

_START = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Leading bits of a hash that say whether a look at the vocabulary pays.
_BITS = 18
_SHIFT = np.uint64(64 - _BITS)
#: What stands between words: all but letters and the marks that go with them.
_BETWEEN = r"[^\p{L}\p{M}]+"


class Pieces:
    """The vocabulary: piece texts to rows; the last row stands for a character in no piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.index(kept)

    def index(self, texts: list[str]) -> None:
        """Sorted hashes and rows of the pieces of each length, and which leading bits occur among them."""
        self.rows = {p: i for i, p in enumerate(dict.fromkeys(p.lower() for p in texts if p))}
        self.unknown = len(self.rows)
        self.tables = {}
        for size in sorted(set(map(len, self.rows))):
            own = [p for p in self.rows if len(p) == size]
            codes = _codes("".join(own)).reshape(len(own), size)
            hashes = np.zeros(len(own), dtype=np.uint64)
            for k in range(size):
                hashes = hashes * _BASE + codes[:, k]
            order = np.argsort(hashes)
            seen = np.zeros(1 << _BITS, dtype=bool)
            seen[hashes >> _SHIFT] = True
            self.tables[size] = hashes[order], np.array([self.rows[p] for p in own], dtype=np.int32)[order], seen
        self.longest = max(self.tables, default=1)

    def find(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which strings of a length are pieces, and their rows; for one character the others are unknown."""
        sorted_, rows, seen = self.tables.get(size, (None, None, None))
        if sorted_ is None:
            at, found = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        else:
            at = np.flatnonzero(seen[hashes >> _SHIFT])
            place = np.minimum(np.searchsorted(sorted_, hashes[at]), len(sorted_) - 1)
            good = sorted_[place] == hashes[at]
            at, found = at[good], rows[place[good]]
        if size > 1:
            return at, found
        every = np.full(len(hashes), self.unknown, dtype=np.int32)
        every[at] = found
        return np.arange(len(hashes)), every


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)


class Lattice:
    """Every place of every piece in many words.

    The words stand in order of length, longest first, so those that have a
    k-th character come before those that have none. `steps[k]` holds the
    pieces that end after k characters, for each size which words have one and
    its row; `alive[k]` is how many words have more than k characters.
    Polynomial hashes of 64 bits stand for strings.
    """

    def __init__(self, pieces: Pieces, words: list[str]):
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.longest = int(lengths.max(initial=0))
        self.wide = pieces.longest
        self.alive = np.searchsorted(-self.lengths, -np.arange(self.longest + 1), side="left")
        codes = _codes("".join(words))
        starts = (np.cumsum(lengths) - lengths)[self.order]
        self.steps: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[]]
        hashes: list[np.ndarray] = []  # of what ends here, by size less one
        for k in range(1, self.longest + 1):
            n = self.alive[k - 1]
            here = codes[starts[:n] + k - 1]
            hashes = [here, *(h[:n] * _BASE + here for h in hashes[: self.wide - 1])]
            found = [(size, *pieces.find(size, h)) for size, h in enumerate(hashes, 1) if size == 1 or size in pieces.tables]
            self.steps.append([(size, at, rows) for size, at, rows in found if len(at)])


def split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of a batch of texts, each with the mark of a word's start; the
    words of all texts end to end, as places among them; and the bounds of each text's words.

    A word is a run of letters, with the marks that go with them, in lower case.
    """
    lists = pc.split_pattern_regex(pc.fill_null(texts, "").cast(pa.large_string()), _BETWEEN)
    coded = pc.dictionary_encode(lists.flatten())
    number: dict[str, int] = {}
    place = np.array([number.setdefault(_START + p.lower(), len(number)) if any(map(str.isalpha, p)) else -1 for p in coded.dictionary.to_pylist()], dtype=np.int64)
    at = place[coded.indices.to_numpy(zero_copy_only=False)] if len(place) else np.zeros(0, dtype=np.int64)
    bounds = np.append(0, np.cumsum(at >= 0))[np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))]
    return list(number), at[at >= 0], bounds


def _next(lattice: Lattice, sums: list[np.ndarray], probability: np.ndarray, k: int) -> np.ndarray:
    """The sums after `k` characters, from those before."""
    out = np.zeros((lattice.alive[k - 1], probability.shape[1]))
    for size, at, rows in lattice.steps[k]:
        out[at] += sums[k - size][at] * probability[rows]
    return out


def forward(lattice: Lattice, probability: np.ndarray) -> np.ndarray:
    """Log probability of each word under each language, summed over all segmentations.

    `probability`: [piece, language]. Sums are rescaled every few characters,
    so long words don't underflow.
    """
    sums: list[np.ndarray | None] = [np.ones((len(lattice.lengths), probability.shape[1]))]
    log = np.zeros_like(sums[0])
    out = np.zeros_like(sums[0])
    for k in range(1, lattice.longest + 1):
        sums.append(_next(lattice, sums, probability, k))
        if k >= lattice.wide:
            sums[k - lattice.wide] = None
        going, end = lattice.alive[k], lattice.alive[k - 1]
        out[lattice.order[going:end]] = log[going:end] + np.log(sums[k][going:])
        if k % 8 == 0 and going:
            recent = [s for s in sums[max(0, k - lattice.wide + 1) :]]
            scale = np.max([s[:going] for s in recent], axis=0)
            for s in recent:
                s[:going] /= scale
            log[:going] += np.log(scale)
    return out


def _expected(lattice: Lattice, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece under one language's probabilities `p`."""
    alpha = [np.ones((len(lattice.lengths), 1))]
    for k in range(1, lattice.longest + 1):
        alpha.append(_next(lattice, alpha, p[:, None], k))
    beta = [np.zeros(len(a)) for a in alpha]
    weight = np.zeros(len(lattice.lengths))
    out = np.zeros(len(p))
    for k in range(lattice.longest, 0, -1):
        going = lattice.alive[k]
        beta[k][going:] = 1.0
        weight[going : len(alpha[k])] = counts[lattice.order[going : len(alpha[k])]] / np.maximum(alpha[k][going:, 0], 1e-300)
        for size, at, rows in lattice.steps[k]:
            through = p[rows] * beta[k][at]
            beta[k - size][at] += through
            out += np.bincount(rows, weights=alpha[k - size][at, 0] * through * weight[at], minlength=len(p))
    return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _parts(words: list[str], letters: int):
    """The words in parts of so many letters, or one word, each."""
    ends = np.cumsum([len(w) for w in words])
    at = 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + letters, side="right")))
        yield slice(at, end)
        at = end


class LanguageModel:
    """Piece probabilities for each language; `languages` is in sorted order."""

    def __init__(self, path: str, languages: list[str], probability: np.ndarray):
        self.path, self.languages, self.probability = path, languages, probability

    def log_words(self, words: list[str]) -> np.ndarray:
        vocab = pieces(self.path)
        out = np.zeros((len(words), len(self.languages)))
        for at in _parts(words, max(1000, CELLS // max(1, len(self.languages)))):
            out[at] = forward(Lattice(vocab, words[at]), self.probability)
        return out

    def predict(self, texts: pa.Array | list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its posterior under a uniform prior. No letter, or nothing learned: `und`, 0."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if len(texts) > TEXTS:
            parts = [self.predict(texts.slice(at, TEXTS)) for at in range(0, len(texts), TEXTS)]
            return [n for p in parts for n in p[0]], [s for p in parts for s in p[1]]
        words, at, bounds = split(texts)
        logs = self.log_words(words)
        names, scores = [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = logs.take(at[a:b], axis=0).sum(axis=0)
            posterior = np.exp(total - total.max())
            best = int(total.argmax())
            names.append(self.languages[best])
            scores.append(float(posterior[best] / posterior.sum()))
        return names, scores


def learn(path: str, counts: pd.DataFrame) -> LanguageModel:
    """Fit piece probabilities from word counts with the columns lang, word and n."""
    vocab = pieces(path)
    languages = sorted(counts["lang"].unique()) if len(counts) else []
    size = vocab.unknown + 1
    columns = []
    for lang in languages:
        mine = counts[counts["lang"] == lang]
        words, n = mine["word"].tolist(), mine["n"].to_numpy(dtype=float)
        groups = [(Lattice(vocab, words[at]), n[at]) for at in _parts(words, CELLS)]
        p = np.full(size, 1.0 / size)
        for _ in range(ROUNDS):
            used = sum((_expected(lattice, p, c) for lattice, c in groups), np.zeros(size))
            p = (used + 1e-3) / (used.sum() + 1e-3 * size)
        columns.append(used)
    used = np.array(columns).reshape(len(languages), size).T
    pooled = used.sum(axis=1, keepdims=True)
    pooled = (pooled + 0.1) / (pooled.sum() + 0.1 * size)
    probability = (used + SMOOTHING * pooled) / (used.sum(axis=0, keepdims=True) + SMOOTHING)
    return LanguageModel(path, [str(x) for x in languages], probability)


def fit(docs: DataFrame, path: str, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = DOCS_PER_LANGUAGE) -> LanguageModel:
    """Fit on `per_language` documents of each language that has one.

    Takes rows with a language; the sample is the rows of least key hash, so
    it is the same whatever the partitioning. Only word counts of the sample
    come to the driver. Null or empty text adds no word; of rows that repeat
    a key one counts; no labelled row at all gives a model without languages.
    """
    known = docs.where(F.col(lang).isNotNull())
    # a language's count says under which hash lie about four samples; only those rows are put in order
    hashed = known.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.xxhash64(key).alias("hash"))
    sizes = hashed.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("n"))
    # one number for each language, where the model has one for each of its pieces
    likely = hashed.join(F.broadcast(sizes), "lang").where(F.col("hash").cast("double") <= F.lit(-(2.0**63)) + F.lit(2.0**64) * share).select("key", "lang", "hash").distinct()
    order = Window.partitionBy("lang").orderBy("hash", "key")
    sample = likely.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language).select("key", "lang")
    # at most per_language rows for each language, so the side that is broadcast is bounded
    texts = known.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    chosen = texts.join(F.broadcast(sample), ["key", "lang"]).groupBy("key", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches):
        for batch in batches:
            words, at, bounds = split(batch.column("text"))
            of = pc.dictionary_encode(batch.column("lang"))
            langs = np.repeat(of.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(bounds))
            pairs, n = np.unique(langs * max(1, len(words)) + at, return_counts=True)
            lang_, word = np.divmod(pairs, max(1, len(words)))
            yield pa.RecordBatch.from_arrays([of.dictionary.take(pa.array(lang_)), pa.array([words[k] for k in word], pa.string()), pa.array(n.astype(np.int64))], names=["lang", "word", "n"])

    counts = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    return learn(path, counts.sort_values(["lang", "word"], ignore_index=True))


def prediction(df: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """struct<lang, score> of each text of `df`, as a column, by the rules of `detect`: null and empty texts and those without a letter are `und` with 0."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> pa.Array:
        claim("language")
        names, scores = shared.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return F.arrow_udf(predict, "struct<lang:string,score:double>")(text_or_empty(text))


def detect(df: DataFrame, model: LanguageModel, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """`df` with the language of each text and its posterior probability.

    Text that is null or has no letter: `und` and 0. Ties go to the language
    first in sorted order; repeated rows get equal results; an empty table
    stays empty. Columns of the output names are replaced, all others stay.
    """
    out = prediction(df, model, text)
    return df.withColumns({lang_pred: out["lang"], score: out["score"]})


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; `und` without a letter, rows that repeat an id are scored each, no documents give no row."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))), default_path())
    return detect(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with the columns they came with.

    Null and empty texts go, as those without a letter do; where nothing can
    be learned, all go. Repeated rows share their fate; an empty table stays
    empty.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))), default_path())
    found = prediction(docs, model)
    return docs.where((found["lang"] != UNDETERMINED) & (found["score"] >= MIN_SCORE))
