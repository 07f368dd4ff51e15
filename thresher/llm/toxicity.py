"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned: words and open stems that stand in labelled toxic
documents far more often than in clean ones. To find misspelled terms the
automaton of a word (its states are bit sets of positions, one set for each
number of errors: a letter more, less, another, or two swapped) runs down the
trie, and branches where no state is left are cut. What a hit counts depends on the words around it: quotation lowers it,
direct address raises it.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher.llm._common import claim, discard, held_out, pieces_of, stored, table, worker_cache, written
from thresher.llm.quality import labelled

#: Labelled documents the lexicon is learned from: the bound of the sample.
TRAIN_DOCS = 10_000
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
#: Shortest term, and least number of unlike toxic documents that hold it.
LEAST_LENGTH, LEAST_SUPPORT = 4, 2
LONGEST_STEM = 12
#: Least word hashes that like documents share.
ALIKE = 3
#: Chance under which a near word of clean text is in too many toxic documents to be ordinary.
CHANCE = 0.01
#: Words before and after a hit that its score depends on.
WINDOW = 4
#: Marks of a quoted and of an addressed hit, and what they may count as; the marks themselves unless labels say otherwise.
QUOTED, ADDRESSED = 0.3, 1.3
CONTEXTS = [(q, a) for q in (0.3, 0.1, 0.6, 1.0) for a in (1.3, 1.0, 2.0)]
#: Words whose matches a worker remembers.
CACHE_WORDS = 400_000

_QUOTING = frozenset("said says say quote quoted quotes called calls wrote writes word words term terms sagte sagt zitat wort dit disait mot citation dijo dice palabra cita".split())
_ADDRESS = frozenset("you your youre u ur du dich dein ihr sie euch tu toi ton vous votre te tú usted ustedes vosotros".split())
#: A word may hold marks inside, as in `id!ot`; its parts are words too.
_PARTS = re.compile(r"[\w@$*]+")
_TOKENS = re.compile(r"[\w@$*]+(?:[!.]+[\w@$*]+)*")
_MARKS = re.compile(r'["“”„«»]')
#: What a hit counts as a share of an exact one, unless labels say otherwise, and what else it may count: one error, two, one in a short term.
ERRORS = [(1.0,), (0.6, 0.3, 0.8), (0.4, 0.1, 0.7), (0.25, 0.0, 0.5, 0.7)]
SHORT = 3
#: Log likelihood by which another choice must be better than the first.
CLEARLY = 1.0


def tokens_of(text: str | None) -> list[str]:
    return _TOKENS.findall((text or "").lower())


def errors_allowed(length: int, open_end: bool) -> int:
    if open_end:
        return 1 if length >= 5 else 0
    return 0 if length < 4 else 1 if length < 9 else 2


def is_short(length: int, open_end: bool) -> bool:
    """Ordinary words lie so near such a term that an error in it counts for less."""
    return length < 6 if open_end else length < 5


class _Node:
    __slots__ = ("next", "errors", "term")

    def __init__(self):
        self.next: dict[str, _Node] = {}
        self.errors = 0  # most errors that any term below allows
        self.term: tuple[int, int, bool] | None = None  # index, errors allowed, open end


class Lexicon:
    """Terms as (text, open_end, weight): a term with an open end stands for every word it begins."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.terms = terms
        self.root = _Node()
        for k, (text, open_end, _) in enumerate(terms):
            allowed = errors_allowed(len(text), open_end)
            node = self.root
            node.errors = max(node.errors, allowed)
            for c in text:
                node = node.next.setdefault(c, _Node())
                node.errors = max(node.errors, allowed)
            if node.term is None or open_end:
                node.term = (k, allowed, open_end)

    def __reduce__(self):
        return Lexicon, (self.terms,)  # a worker builds its own trie, however deep

    def match(self, word: str) -> tuple[int, int] | None:
        """The term nearest to `word` and the number of errors; ties go to the longer term, then the first.

        Two letters that have changed places are one error, if neither of them is changed again.
        """
        n = len(word)
        if n < LEAST_LENGTH - 1 or not self.terms:
            return None
        full, last = (1 << (n + 1)) - 1, 1 << n
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        best: tuple[int, int, int] | None = None
        # the states of each number of errors, and, for swapped letters, those before the last letter and where that stands in the word
        stack = [(self.root, 1, 3 & full, 7 & full, 0, 0, 0)]
        while stack:
            node, r0, r1, r2, p0, p1, last_m = stack.pop()
            if node.term is not None:
                k, allowed, open_end = node.term
                want = full if open_end else last
                e = 0 if r0 & want else 1 if r1 & want else 2
                if e <= allowed and (e < 2 or r2 & want):
                    found = (e, -len(self.terms[k][0]), k)
                    if best is None or found < best:
                        best = found
            for c, child in node.next.items():
                m = masks.get(c, 0)
                n0 = (r0 & m) << 1
                most = child.errors
                if most == 0:
                    if n0:
                        stack.append((child, n0, 0, 0, 0, 0, 0))
                    continue
                n1 = ((r1 & m) << 1 | r0 | r0 << 1 | n0 << 1 | ((p0 & m) << 1 & last_m) << 1) & full
                n2 = ((r2 & m) << 1 | r1 | r1 << 1 | n1 << 1 | ((p1 & m) << 1 & last_m) << 1) & full if most > 1 else 0
                if n1 or n2:
                    stack.append((child, n0, n1, n2, r0, r1, m))
        return None if best is None else (best[2], best[0])


class _Matches(dict):
    """Word to match, found when first asked for; holds a bounded number of words."""

    def __init__(self, lexicon: Lexicon, known: frozenset[str] = frozenset()):
        super().__init__()
        self.lexicon, self.known = lexicon, known

    def __missing__(self, word: str):
        bare = word.strip("*@$_")
        found = self.lexicon.match(bare) if len(word) <= 64 or "." not in bare and "!" not in bare else None
        if found and found[1] == 1:
            text, open_end, _ = self.lexicon.terms[found[0]]
            found = (found[0], SHORT) if is_short(len(text), open_end) else found
        if found and found[1] and bare in self.known:
            found = None
        if found is None or found[1]:
            parts = _PARTS.findall(bare)
            if len(parts) > 1:  # a part may be a term by itself
                own = [m for m in map(self.__getitem__, parts) if m is not None]
                found = min([*own, *([found] if found else [])], key=lambda m: m[1], default=None)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def hits(text: str | None, matches: _Matches) -> list[tuple[int, int, float, str]]:
    """Each hit as (term, errors, context factor, word). Inside quotation marks or by a
    reporting word a hit counts less, by a word of direct address more."""
    tokens = tokens_of(text)
    found = [(at, m) for at, m in enumerate(map(matches.__getitem__, tokens)) if m is not None]
    if not found:
        return []
    text = text.lower()
    quoted: set[int] = set()
    if _MARKS.search(text):
        at = 0
        for line in text.split("\n"):
            # marks pair up within a line; one left over opens nothing
            parts = _MARKS.split(line)
            for k, part in enumerate(parts):
                n = len(_TOKENS.findall(part))
                if k % 2 and k < len(parts) - 1:
                    quoted.update(range(at, at + n))
                at += n
    out = []
    for at, (term, errors) in found:
        near = _PARTS.findall(" ".join(tokens[max(0, at - WINDOW) : at] + tokens[at + 1 : at + 1 + WINDOW]))
        factor = 1.0
        if at in quoted or not _QUOTING.isdisjoint(near):
            factor = QUOTED
        elif not _ADDRESS.isdisjoint(near):
            factor = ADDRESSED
        out.append((term, errors, factor, tokens[at].strip("*@$_")))
    return out


class ToxicityModel:
    """The lexicon, what hits count, and the logistic that turns evidence into a probability.

    `known`: ordinary words of clean text that are near a term and no misspelling.
    """

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.slope, self.offset = lexicon, 1.0, -3.0
        self.context = {1.0: 1.0, QUOTED: QUOTED, ADDRESSED: ADDRESSED}
        self.errors = [choices[0] for choices in ERRORS]
        self.known: frozenset[str] = frozenset()
        self.uid = uuid.uuid4().hex

    def hits(self, text: str | None) -> list[tuple[int, int, float, str]]:
        matches = _MEMORY.get(self.uid)
        if matches is None:
            _MEMORY.clear()
            matches = _MEMORY[self.uid] = _Matches(self.lexicon, self.known)
        return hits(text, matches)

    def evidence(self, found: list[tuple[int, int, float, str]]) -> float:
        return math.log1p(sum(self.lexicon.terms[k][2] * self.errors[e] * self.context[factor] for k, e, factor, _ in found))

    def score(self, text: str | None) -> float:
        z = self.slope * self.evidence(self.hits(text)) + self.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def calibrate(self, found: list[list[tuple[int, int, float, str]]], labels: np.ndarray) -> ToxicityModel:
        """Set which near words are ordinary, what contexts and errors count, and the logistic, from the hits in labelled documents.

        A near word is ordinary if clean documents hold it unquoted and chance
        explains its share of toxic ones. Each word is judged alone: other
        misspellings of the same term still count. With no documents all stays
        as it is by default.
        """
        seen: dict[str, list[int]] = {}
        for doc, label in zip(found, labels):
            for word in {word for _, e, factor, word in doc if e and (label or factor >= 1)}:
                seen.setdefault(word, [0, 0])[int(label)] += 1
        rate = float(np.mean(labels)) if len(labels) else 0.0
        known = {word for word, (clean, toxic) in seen.items() if clean and (toxic <= rate * (clean + toxic) or log_chance(toxic, clean + toxic, rate) >= math.log(CHANCE))}
        self.known = frozenset(known)
        self.uid = uuid.uuid4().hex
        kept = [[h for h in doc if not (h[1] and h[3] in known)] for doc in found]
        y = np.asarray(labels, dtype=float)

        # an ordinary word that was not met yet is like those that were, each of which counts once where errors are judged
        met: set[str] = set()
        first = [[h for h in doc if not (h[1] and h[3] in known) or not (h[3] in met or met.add(h[3]))] for doc in found]

        def loss(docs: list) -> float:
            x = np.array([self.evidence(doc) for doc in docs])
            self.slope, self.offset = logistic(x, y)
            return float(np.logaddexp(0, np.where(y > 0.5, -1, 1) * (self.slope * x + self.offset)).sum()) if len(x) else 0.0

        def choose(docs: list, choices, put) -> None:
            """The first of the choices, unless another explains the labels clearly better."""
            least, best = math.inf, choices[0]
            for choice in choices:
                put(choice)
                now = loss(docs)
                if now < least - max(CLEARLY, 0.02 * least) or least == math.inf:
                    least, best = now, choice
            put(best)

        for e in range(1, len(ERRORS)):
            choose(first, ERRORS[e], lambda share, e=e: self.errors.__setitem__(e, share))
        choose(kept, CONTEXTS, lambda c: self.context.update({QUOTED: c[0], ADDRESSED: c[1]}))
        loss(kept)
        return self


_MEMORY: dict[str, _Matches] = worker_cache("toxicity", {})


def _stems(token: str):
    """The token as a whole word, and its beginnings as stems."""
    yield token + "$"
    for n in range(LEAST_LENGTH, min(LONGEST_STEM, len(token) - 1) + 1):
        yield token[:n]


def log_chance(toxic: int, n: int, rate: float) -> float:
    """Chernoff's bound on so many of `n` documents being toxic by chance, where that is more than `rate` of them."""
    share = toxic / n
    return -n * (share * math.log(share / rate) + ((1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0))


def choose_terms(stems: dict[str, tuple[int, int, int]], n_toxic: int, n_clean: int, tried: int) -> list[tuple[str, bool, float]]:
    """Terms whose share of toxic documents no chance explains.

    For each stem, or word with a `$`: in how many unlike toxic documents it
    is, how many different words it begins in each, summed, and in how many
    unlike clean ones it is; `tried`: how many stems there were to choose
    from. A stem stands in for a longer one where it is in clearly more toxic
    documents.
    """
    rate = n_toxic / (n_toxic + n_clean)
    bar = -math.log(max(1, tried))  # one term by chance among all that are tried
    toxic = {k: v[0] for k, v in stems.items()}
    clean = {k: v[2] for k, v in stems.items()}

    def good(stem: str) -> bool:
        t, words, c = stems[stem]
        if t < LEAST_SUPPORT or (t / n_toxic) < 20 * ((c + 0.5) / n_clean):
            return False
        # several words of a stem in a document count double
        return log_chance(t, t + c, rate) * (2 if words >= 2 * t else 1) < bar

    fits = {k for k in toxic if good(k)}
    chosen: dict[str, tuple[str, bool, float]] = {}
    for key in sorted(toxic):
        if key not in fits:
            continue
        best = key
        for n in range(min(LONGEST_STEM, len(key.rstrip("$"))), LEAST_LENGTH - 1, -1):
            stem = key[:n]
            if stem != best and stem in fits and toxic[stem] >= 1.3 * toxic[best]:
                best = stem
        chosen[best] = (best.rstrip("$"), not best.endswith("$"), 0.0)
    # a stem in hardly more documents than one chosen word or stem that it begins adds nothing
    ends: dict[str, int] = {}
    for key in chosen:
        for n in range(LEAST_LENGTH, len(key)):
            ends[key[:n]] = max(ends.get(key[:n], 0), toxic[key])
    chosen = {k: v for k, v in chosen.items() if k.endswith("$") or toxic[k] >= 1.3 * ends.get(k, 0)}
    kept = {}
    for key in chosen:
        if not any(key[:n] in chosen for n in range(LEAST_LENGTH, len(key))):
            odds = ((toxic[key] + 0.5) / (n_toxic + 1)) / ((clean.get(key, 0) + 0.5) / (n_clean + 1))
            kept[key] = (chosen[key][0], chosen[key][1], min(8.0, max(0.5, math.log(odds))))
    return [kept[k] for k in sorted(kept, key=lambda k: (-toxic[k], k))]


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", key: str = "doc_id", rows: int = TRAIN_DOCS) -> ToxicityModel:
    """Learn the lexicon and the logistic from at most `rows` labelled documents.

    Like documents, which share their least word hashes, count and support a
    term once. Stems are counted and tried in the cluster; only those that may
    become terms come to the driver. With no toxic or no clean document there
    is no lexicon and every score is low. Null text holds no word; of rows
    that repeat a key one counts, so repeats don't add to the sample.
    """
    sample = docs.select(key, "text").join(F.broadcast(labelled(labels, column, key, rows)), key).groupBy(key, "label").agg(F.min("text").alias("text"))

    def begin(batches):
        for pdf in pieces_of(batches):
            found: dict[tuple[float, str, int], int] = {}
            for label, text in zip(pdf["label"], pdf["text"]):
                like, begun = beginnings(text)
                found[label, "", like] = 1  # the document itself
                for stem, words in begun.items():
                    found[label, stem, like] = max(words, found.get((label, stem, like), 0))
            yield pd.DataFrame([(a, b, c, n) for (a, b, c), n in found.items()], columns=["label", "stem", "like", "words"])

    each = sample.mapInPandas(begin, "label double, stem string, like long, words long")
    each = each.groupBy("stem", "label", "like").agg(F.max("words").alias("words"))
    toxic = F.col("label") == 1
    counted = each.groupBy("stem").agg(
        F.count(F.when(toxic, 1)).alias("toxic"), F.sum(F.when(toxic, F.col("words")).otherwise(0)).alias("words"), F.count(F.when(~toxic, 1)).alias("clean")
    )
    spark, before = docs.sparkSession, written()
    counted = stored(counted.where(F.col("toxic") >= LEAST_SUPPORT), "stems")
    n_toxic, n_clean = 0, 0
    for r in each.where("stem = ''").groupBy("label").count().collect():
        n_toxic, n_clean = (r["count"], n_clean) if r["label"] == 1 else (n_toxic, r["count"])
    terms: list[tuple[str, bool, float]] = []
    if n_toxic and n_clean:
        words = counted.where("stem <> ''")
        tried = words.where("toxic >= 3").count()
        may = words.where(F.col("toxic") / n_toxic >= 20 * (F.col("clean") + 0.5) / n_clean)
        terms = choose_terms({r["stem"]: (r["toxic"], r["words"], r["clean"]) for r in may.toLocalIterator()}, n_toxic, n_clean, tried)
    discard(spark, before)
    model = ToxicityModel(Lexicon(terms))
    shared = spark.sparkContext.broadcast(model)

    def find(batches):
        claim("toxicity")
        for pdf in pieces_of(batches):
            found = [shared.value.hits(t) for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf[key], "label": pdf["label"], "hits": [[{"term": k, "errors": e, "factor": f, "word": w} for k, e, f, w in doc] for doc in found]})

    got = sample.mapInPandas(find, "key long, label double, hits array<struct<term:int,errors:int,factor:double,word:string>>").toPandas().sort_values("key", kind="stable")
    return model.calibrate([[(h["term"], h["errors"], h["factor"], h["word"]) for h in doc] for doc in got["hits"]], got["label"].to_numpy())


def beginnings(text: str | None) -> tuple[int, dict[str, int]]:
    """A number made of a text's least word hashes, which like texts share, and how many of its words each stem begins."""
    distinct = {p.strip("*@$_") for t in tokens_of(text) for p in _PARTS.findall(t)}
    found: dict[str, int] = {}
    for token in distinct:
        if len(token) >= LEAST_LENGTH:
            for stem in _stems(token):
                found[stem] = found.get(stem, 0) + 1
    least = heapq.nsmallest(ALIKE, (zlib.crc32(t.encode()) for t in distinct))
    return zlib.crc32(np.array(least, dtype="<u4").tobytes()), found


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a ridge so that separable data stay finite."""
    if not len(x) or y.min() == y.max():
        return 1.0, -3.0
    slope, offset = 0.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        g = np.array([((p - y) * x).sum() + ridge * slope, (p - y).sum() + 0.01 * ridge * offset])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01 * ridge]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(slope), float(offset)


def rate(df: DataFrame, model: ToxicityModel, score: str = "score") -> DataFrame:
    """`df` with the probability that each text is toxic.

    Null and empty text hold no term and get the score of no evidence, texts
    of any length are read whole, and repeated rows get equal scores. An empty
    table stays empty. A column named `score` is replaced, all others stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def probability(texts: pa.Array) -> pa.Array:
        claim("toxicity")
        model = shared.value
        return pa.array([model.score(t) for t in texts.to_pylist()], pa.float64())

    return df.withColumn(score, F.arrow_udf(probability, "double")(F.col("text")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; null text holds no term, rows that repeat an id are scored each, no documents give no row."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return rate(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
