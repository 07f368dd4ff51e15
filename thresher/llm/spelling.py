"""Spelling variants grouped without pairs.

Words are near if one code point inserted, deleted or replaced leads from one
to the other. For replacements a word goes into one group for each position,
of all words with the same prefix before it and suffix after it; a group keeps
its size and its two most frequent words, and what a word is told is the sizes
and the best other word of its groups, never the members. For insertions and
deletions what is left of a word without one code point is looked up in the
vocabulary. Both lookups share one shuffle of 128-bit keys: a key is a sum of
random numbers, one for each code point and position, so the keys of all
variants of a word are made in time of its length, however long it is. Words
stand under their rank, most frequent first, in which the least is the best.
A word's form is its best near word, if that is frequent enough by comparison;
chains of forms are followed by pointers that double their reach in each round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thresher.llm._common import claim, discard, stored, table, written
from thresher.llm.jaccard import mix

#: What a word is made of, code points that it has at least, and how often it occurs at least.
LETTERS, LENGTH, COUNT = "A-Za-zÀ-ÿ", 7, 2
#: A form is at least so many times as frequent.
RATIO = 10
#: One occurrence in so many loses a code point.
NOISE = 31

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of words whose keys are made at a time.
_CELLS = 1 << 20
_WILD = 0x110000
_U = np.uint64

WORD, SHORTER, HOLE = 0, 1, 2


def noisy(key: Column, run: Column) -> Column:
    """The run without one code point, where a checksum of key and run says so; a null key counts as empty."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    return F.when(h % NOISE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n of all runs of letters in the texts, after `noisy`, of the least length and count.

    Shorter runs can't become words, so the pattern passes them over. Null
    texts have none; repeated rows count each; an empty table gives no row.
    Counting starts before the shuffle.
    """
    runs = docs.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}]{{{LENGTH},}})"), F.lit(1))).alias("run"))
    words = runs.select(noisy(F.col("key"), F.translate("run", _UPPER, _LOWER)).alias("word")).where(F.length("word") >= LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= COUNT)


def _numbers(at: np.ndarray, letters: np.ndarray, seed: int) -> np.ndarray:
    """A random number for each position and code point."""
    return mix(mix(at.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)) ^ (letters.astype(np.uint64) * _U(0xD1B54A32D192ED03)))


def variants(words: list[str], least: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys (two halves), index of the word, and kind, of each word, of it with a hole at each position, and of it without a code point.

    Deletions that give the same string count once, and those shorter than `least` are left out.
    """
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    of = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(len(letters)) - starts[of]
    again = (at > 0) & (letters == np.concatenate([[-1], letters[:-1]]))
    shorter = ~again & (sizes[of] > least)
    keys = []
    for seed in (1, 2):
        own, moved, hole = _numbers(at, letters, seed), _numbers(at - 1, letters, seed), _numbers(at, np.full(len(at), _WILD), seed)
        before, after = np.concatenate([[_U(0)], np.cumsum(own)]), np.concatenate([[_U(0)], np.cumsum(moved)])
        whole = before[starts + sizes] - before[starts]
        cell = np.arange(len(letters))
        without = before[cell] - before[starts[of]] + after[(starts + sizes)[of]] - after[cell + 1]
        keys.append(np.concatenate([whole, without[shorter], whole[of] - own + hole]).view(np.int64))
    kinds = np.repeat(np.array([WORD, SHORTER, HOLE], dtype=np.int8), [len(words), int(shorter.sum()), len(letters)])
    return keys[0], keys[1], np.concatenate([np.arange(len(words)), of[shorter], of]), kinds


def _keys(words: DataFrame) -> DataFrame:
    """a, b, rank and kind of all variants of all words."""

    def run(batches):
        claim("spelling")
        for batch in batches:
            ranks, found = batch.column("rank").to_numpy(), batch.column("word").to_pylist()
            ends = np.cumsum([len(w) for w in found])
            at = 0
            while at < len(found):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CELLS, side="right")))
                a, b, of, kinds = variants(found[at:end])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(ranks[at:end][of]), pa.array(kinds)], names=["a", "b", "rank", "kind"])
                at = end

    return words.select("rank", "word").mapInArrow(run, "a long, b long, rank long, kind byte")


def near_words(words: DataFrame) -> DataFrame:
    """rank, n_near (near words) and best (the least rank among them) of the words that have any.

    `words` has rank and word, each once. A group has at most as many words as
    there are letters, and a string comes from at most so many for each of its
    places, so no key is hot.
    """
    same = Window.partitionBy("a", "b").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind = F.col("kind")
    told = _keys(words).select(
        "rank",
        kind,
        F.count("*").over(same).alias("size"),
        F.first("rank").over(same).alias("top"),
        F.nth_value("rank", 2).over(same).alias("second"),
        F.max(F.when(kind == WORD, F.col("rank"))).over(same).alias("word"),
        F.min(F.when(kind == SHORTER, F.col("rank"))).over(same).alias("longer"),
    )
    near = F.when(kind == SHORTER, F.col("word").isNotNull().cast("long")).otherwise(F.col("size") - 1)
    best = F.when(kind == HOLE, F.when(F.col("rank") == F.col("top"), F.col("second")).otherwise(F.col("top"))).when(kind == SHORTER, F.col("word")).otherwise(F.col("longer"))
    return told.select("rank", near.alias("near"), best.alias("best")).where("near > 0").groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def last_of(links: DataFrame) -> DataFrame:
    """rank and root: where the links (rank, to) lead in the end. Links must not run in circles; each round doubles their reach."""
    links = stored(links.select("rank", "to"), "links")
    while True:
        beyond = links.select(F.col("rank").alias("_at"), F.col("to").alias("_beyond"))
        further = stored(links.join(beyond, F.col("to") == F.col("_at"), "left").select("rank", F.coalesce("_beyond", "to").alias("to"), F.col("_beyond").isNotNull().alias("moved")), "links")
        if not further.where("moved").head(1):
            return links.withColumnRenamed("to", "root")
        links = further.drop("moved")


def variant_groups(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n for a table of words with their counts n.

    A word's form is its near word of largest n, ties by code-point order, if
    it is at least `ratio` (over 1) times as frequent, else null. Its root is
    where forms lead in the end, itself if it has none. Words must be distinct
    and not null; other columns take no part; an empty table gives no row. Two
    variants are taken for one if 128-bit keys agree, of which no chance is seen.
    """
    spark, before = words.sparkSession, written()
    # ids in sorted order: the least is the most frequent word, the first of those alike
    ranked = stored(words.select("word", "n").orderBy(F.desc("n"), "word").withColumn("rank", F.monotonically_increasing_id()), "vocabulary")
    near = stored(near_words(ranked), "near")
    named = ranked.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = ranked.join(near, "rank", "left").join(named, "best", "left")
    frequent = F.col("form_n") >= ratio * F.col("n")
    found = found.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(frequent, F.col(c)).alias(c) for c in ("form", "form_n", "best")])
    found = stored(found, "forms")
    roots = last_of(found.where("best is not null").select("rank", F.col("best").alias("to")))
    root = ranked.select(F.col("rank").alias("root"), F.col("word").alias("root_word"))
    out = stored(found.join(roots, "rank", "left").join(root, "root", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    discard(spark, before, out)
    return out


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of `documents`; odd rows as `vocabulary` says."""
    return variant_groups(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))


OP11_SQL = rf"""
WITH RECURSIVE bits(i, k, c) AS (
    SELECT i, 0, i FROM range(256) AS t(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8
), runs AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS raw FROM documents
), counted AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(raw, '{_UPPER}', '{_LOWER}') AS run, count(*) AS n FROM runs WHERE length(raw) >= {LENGTH} GROUP BY ALL
), hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(octet_length(b) AS BIGINT)), lambda i: CAST('0x' || substr(hex(b), 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, tab[xor(c, x) % 256 + 1])), 4294967295) AS h
    FROM (SELECT run, n, encode(doc || ':' || run) AS b FROM counted), crc
), changed AS (
    SELECT CASE WHEN h % {NOISE} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS MATERIALIZED (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(n) >= {COUNT}
), holes AS MATERIALIZED (
    SELECT DISTINCT word, n, i, left(word, i) AS prefix, substr(word, i + 2) AS suffix FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)
), near AS (
    SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.i = b.i AND a.prefix = b.prefix AND a.suffix = b.suffix AND a.word <> b.word
    UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.prefix || h.suffix
    UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.prefix || h.suffix
), best AS (
    SELECT word, count(*) AS n_near, list(other ORDER BY n DESC, other)[1] AS other, max(n) AS most FROM near GROUP BY word
), forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {RATIO} * w.n THEN other END AS form, CASE WHEN most >= {RATIO} * w.n THEN most END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word
), chain(word, root) AS (
    SELECT word, word FROM forms UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms l ON l.word = c.root AND l.form IS NULL
"""
