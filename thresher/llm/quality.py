"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

The score of a feature vector x is the logistic of

    b + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

whose last term is the sum over all pairs <v_i, v_j> x_i x_j in time linear in
the features. Words are hashed; structure statistics and the length come as
one feature for each of a few intervals.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher.llm._common import claim, held_out, pieces_of, table

#: Labelled documents the machine is fitted on: the bound of the sample.
TRAIN_DOCS = 6000
WORD_BITS = 15
FACTORS = 8
#: Passes over the sample, more where it is so small that there would be fewer steps than this.
EPOCHS, LEAST_STEPS = 6, 400
#: Documents that are scored at a time.
SCORED = 128
#: Score from which a document counts as good.
THRESHOLD = 0.7

#: Interval bounds of each structure statistic.
_EDGES = {
    "upper": (0.01, 0.03, 0.06, 0.12, 0.25, 0.5),
    "digit": (0.002, 0.01, 0.03, 0.1, 0.3),
    "symbol": (0.002, 0.01, 0.02, 0.05, 0.1, 0.2),
    "bang": (0.001, 0.005, 0.02, 0.06),
    "stop": (0.002, 0.005, 0.01, 0.02, 0.05, 0.1),
    "bar": (0.001, 0.005, 0.02, 0.05),
    "newline": (0.0005, 0.002, 0.005, 0.01, 0.03),
    "word_length": (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0),
    "distinct": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "top_word": (0.02, 0.04, 0.06, 0.1, 0.2, 0.4),
    "doubled": (0.005, 0.01, 0.02, 0.05, 0.1, 0.3, 0.6),
    "same_lines": (0.01, 0.1, 0.3, 0.6),
    "line_words": (2.0, 5.0, 10.0, 20.0, 40.0, 80.0),
    "words": (1.0, 5.0, 10.0, 20.0, 50.0, 100.0, 300.0, 1000.0, 3000.0),
    "n_chars": (1.0, 16.0, 64.0, 256.0, 1024.0, 4096.0, 16384.0, 65536.0),
}
_WIDEST = max(map(len, _EDGES.values())) + 1
WORD_FEATURES = 1 << WORD_BITS
FEATURES = WORD_FEATURES + _WIDEST * len(_EDGES)

#: Class of each byte: 1 capital, 2 digit, 3 symbol, 4 exclamation, 5 full stop, 6 bar, 7 line end.
_CLASS = np.zeros(256, dtype=np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+/<=>@[]^_`{}~\\", b"!?", b".", b"|", b"\n"), start=1):
    _CLASS[list(_chars)] = _k

def features(text: str | None, n_chars: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of a text's features. `n_chars` defaults to the text's own length."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    kinds = np.bincount(_CLASS[raw], minlength=8) / max(1, len(raw))
    words = text.split()
    counts = Counter(words)
    n = max(1, len(words))
    lines = text.split("\n")
    stats = (
        kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7],
        len(text) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        float(len(words)),
        float(len(text) if n_chars is None or n_chars != n_chars else n_chars),
    )
    rows = [zlib.crc32(w.encode("utf-8")) & (WORD_FEATURES - 1) for w in counts]
    values = [1.0 / (1.0 + len(counts)) ** 0.5] * len(rows)
    for k, (edges, value) in enumerate(zip(_EDGES.values(), stats)):
        rows.append(WORD_FEATURES + k * _WIDEST + int(np.searchsorted(edges, value, side="right")))
        values.append(1.0)
    return np.array(rows, dtype=np.int32), np.array(values, dtype=np.float32)


class FactorisationMachine:
    """Logistic factorisation machine with Adagrad steps over small batches."""

    def __init__(self, size: int = FEATURES, factors: int = FACTORS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(size, dtype=np.float32)
        self.v = rng.normal(0, 0.02, (size, factors)).astype(np.float32)

    def raw(self, rows: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic and the factor sums, for documents laid end to end."""
        vx = self.v[rows] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        linear = np.add.reduceat(self.w[rows] * values, starts)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def score(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        rows = np.concatenate([d[0] for d in docs])
        values = np.concatenate([d[1] for d in docs])
        starts = np.cumsum([0, *(len(d[0]) for d in docs[:-1])])
        return 1 / (1 + np.exp(-np.clip(self.raw(rows, values, starts)[0].astype(np.float64), -30, 30)))

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
        """With labels of one kind only, or none, the score is that kind's share, or a half."""
        share = float(labels.mean()) if len(labels) else 0.5
        self.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        if share in (0.0, 1.0) or not len(labels):
            self.v[:] = 0
            return self
        rng = np.random.default_rng(seed)
        gw = np.full_like(self.w, 1e-2)
        gv = np.full_like(self.v, 1e-2)
        gb = 1e-2
        for _ in range(max(epochs, min(80, LEAST_STEPS * batch // len(docs)))):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), batch):
                picked = order[at : at + batch]
                rows = np.concatenate([docs[i][0] for i in picked])
                values = np.concatenate([docs[i][1] for i in picked])
                sizes = np.array([len(docs[i][0]) for i in picked])
                z, sums = self.raw(rows, values, np.cumsum(sizes) - sizes)
                error = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - labels[picked]).astype(np.float32) / len(picked)
                each = np.repeat(error, sizes) * values
                grad_v = each[:, None] * (np.repeat(sums, sizes, axis=0) - self.v[rows] * values[:, None])
                used, where = np.unique(rows, return_inverse=True)
                dw = np.bincount(where, weights=each, minlength=len(used)).astype(np.float32) + decay * self.w[used]
                dv = np.stack([np.bincount(where, weights=grad_v[:, f], minlength=len(used)) for f in range(self.v.shape[1])], axis=1).astype(np.float32) + decay * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
                gb += float(error.sum()) ** 2
                self.bias -= rate * float(error.sum()) / gb**0.5
        return self


def labelled(labels: DataFrame, column: str, key: str = "doc_id", rows: int = TRAIN_DOCS) -> DataFrame:
    """A bounded sample of label rows that may be learned from: columns `key` and `label`.

    Rows of the held-out fold or with a null label are left out; several rows
    of one document count as their majority. The sample is the rows of least
    key hash, so it is the same whatever the partitioning.
    """
    usable = labels.where(~held_out(F.col(key)) & F.col(column).isNotNull() & F.col(key).isNotNull())
    return usable.groupBy(key).agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("double").alias("label")).orderBy(F.xxhash64(key), key).limit(rows)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", key: str = "doc_id", rows: int = TRAIN_DOCS) -> FactorisationMachine:
    """Fit on at most `rows` labelled documents; only their features come to the driver.

    Of rows that repeat a key one counts, so repeats don't add to the sample.
    """
    sample = docs.select(key, "text", _length(docs)).join(F.broadcast(labelled(labels, column, key, rows)), key)
    sample = sample.groupBy(key, "label").agg(F.min(F.struct("text", "_n_chars")).alias("_d")).select(key, "label", "_d.text", "_d._n_chars")

    def extract(batches):
        for pdf in pieces_of(batches):
            found = [features(t, n) for t, n in zip(pdf["text"], pdf["_n_chars"])]
            yield pd.DataFrame({"key": pdf[key], "rows": [f[0] for f in found], "values": [f[1] for f in found], "label": pdf["label"]})

    got = sample.mapInPandas(extract, "key long, rows array<int>, values array<float>, label double").toPandas()
    got = got.sort_values("key", kind="stable", ignore_index=True)
    pairs = [(np.asarray(a, dtype=np.int32), np.asarray(b, dtype=np.float32)) for a, b in zip(got["rows"], got["values"])]
    return FactorisationMachine().fit(pairs, got["label"].to_numpy(dtype=np.float32))


def _length(docs: DataFrame) -> Column:
    """The length as the table has it, or else none: then the text's own counts."""
    return (F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")).alias("_n_chars")


def probability(df: DataFrame, model: FactorisationMachine) -> Column:
    """The probability that each text of `df` is good, as a column, by the rules of `classify`: null text counts as empty and has a score too."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array, lengths: pa.Array) -> pa.Array:
        claim("quality")
        found = []
        for at in range(0, len(texts), SCORED):
            part = zip(texts.slice(at, SCORED).to_pylist(), lengths.slice(at, SCORED).to_pylist())
            found.append(shared.value.score([features(t, n) for t, n in part]))
        return pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())

    return F.arrow_udf(score, "double")(F.col("text"), _length(df))


def classify(df: DataFrame, model: FactorisationMachine, score: str = "score") -> DataFrame:
    """`df` with the probability that each text is good.

    Null text counts as empty and is scored like any other, texts of any
    length are read whole, and repeated rows get equal scores. A null
    `n_chars` is taken from the text. An empty table stays empty. A column
    named `score` is replaced, all others stay.
    """
    return df.withColumn(score, probability(df, model))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; null text counts as empty, rows that repeat an id are scored each, no documents give no row."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = classify(docs.select("doc_id", "text", "n_chars"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good, with the columns they came with.

    Null text is scored as an empty one; a null id is no label's, but scored
    like any other; repeated rows share their fate; an empty table stays empty.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(probability(docs, model) >= THRESHOLD)
