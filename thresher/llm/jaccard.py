"""N-gram Jaccard join by chosen paths.

A document is its set of word shingles. In each run a set picks each of its
shingles with a probability of about one in its size, by a hash that all sets
share, and goes into the bucket of each shingle it picked. Buckets that are
small are compared by brute force; larger ones are split again by further
picks, along paths of up to three shingles. Independent runs are repeated
until a pair at the threshold is found with the target recall.

What shares the longest paths and is large even then is a group of near
copies. Its sets are compared with a few leaders each, not with one another:
a set near a leader is done with, and whatever may be linked to it hangs on
the same leader by the triangle inequality. Leaders are drawn anew among the
sets that have none until the bucket is small.

Comparing in buckets uses small sketches with a generous margin and only asks
which sets hang together; what hangs together is then checked exactly, once.
In a large group a set is known by its difference from the group's centre. A
pair is linked if both differences are small enough together, which is counted
over sorted sizes without comparing anything; else only if they have enough
shingles in common. Rings of like sizes of difference in which that may be
meet block by block, with the differences in the place of the sets. Equal sets
are one node with a weight throughout. Keys that many rows share are dealt to
many tasks.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thresher.llm._common import claim, discard, pieces_of, stored, table, worker_cache, written
from thresher.scratch import spread_join

#: Words in a shingle, and the least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Recall of a pair just at the threshold whose buckets all need the longest paths.
TARGET_RECALL = 0.99
#: Shingles on the longest path.
DEPTH = 3
#: Sets of a bucket or group that are compared by brute force.
BUCKET = 256
#: Sets in a block of a larger one.
BLOCK = 1024
#: Leaders drawn at a time in a large bucket, and the similarity to one that a set is done with.
LEADERS, LED = 16, 0.7
#: Sets that a large group's centre is made of, and rings by size of difference from it.
CENTRE, RINGS = 64, 8
#: Rows in a batch of texts or sets.
ROWS = 512
#: Bins of a sketch.
BINS = 128
#: Words whose hashes a worker remembers.
CACHE_WORDS = 150_000

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def runs_for(recall: float = TARGET_RECALL, depth: int = DEPTH) -> int:
    """Independent runs until a pair at the threshold has been in one bucket with this probability.

    Along a path such a pair shares one pick a level on average, so it
    survives k levels with q_k = 1 - exp(-q_(k-1)), q_0 = 1.
    """
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, for each element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        found = xxhash.xxh64_intdigest(word.encode("utf-8"))
        if len(word) <= 64:
            self[word] = found
        return found


_HASHES = worker_cache("jaccard", _Hashes())


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles of `words` lower-case words.

    A word is a run of letters, digits and underscores. A text of fewer words
    is one shingle of all it has; one without a word has none.
    """
    found = _WORD.findall((text or "").lower())
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), dtype=np.uint64, count=len(found))
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = mix(out * _MIX + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def sketch(tokens: np.ndarray) -> bytes:
    """For each of BINS ranges of hashes eight bits of the least one in it; 0 if there is none."""
    edges = np.searchsorted(tokens, np.arange(BINS, dtype=np.uint64) << _U(64 - BINS.bit_length() + 1))
    ends = np.append(edges[1:], len(tokens))
    filled = edges < ends
    out = np.zeros(BINS, dtype=np.uint8)
    out[filled] = tokens[edges[filled]] % _U(255) + _U(1)
    return out.tobytes()


def picks(parents: np.ndarray, tokens: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the buckets below `parents` that a set goes into, and how many there are below each."""
    bar = _U(min(2**64 - 1, int(share * 2**64)))
    seeds = mix(parents)[:, None]
    rows, keys = [], []
    for at in range(0, len(tokens), 1 << 16):  # long texts part by part
        drawn = mix(seeds ^ tokens[None, at : at + (1 << 16)])
        row, col = np.nonzero(drawn <= bar)
        rows.append(row)
        keys.append(mix(drawn[row, col] + _MIX))
    row, key = np.concatenate(rows), np.concatenate(keys)
    return (key if len(rows) == 1 else key[np.argsort(row, kind="stable")]), np.bincount(row, minlength=len(parents))


def describe(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, words: int = WORDS, runs: int | None = None) -> DataFrame:
    """`docs` without the text, with set_hash, n (shingles), sketch and paths (the buckets of all levels).

    Null texts, empty ones and those without a word have n = 0 and no path;
    equal texts get equal values, rows that repeat stay rows; an empty table
    stays empty. Columns of `docs` must not have these names.
    """
    runs = runs or runs_for()

    def run(texts: pa.Array) -> pa.Array:
        claim("jaccard")
        return pa.concat_arrays([some(texts.slice(at, ROWS)) for at in range(0, len(texts), ROWS)] or [some(texts)])

    def some(texts: pa.Array) -> pa.Array:
        roots = mix(np.arange(1, runs + 1, dtype=np.uint64) * _MIX)
        hashes, sizes, sketches = [], [], []
        n1, k1, n2, k2, n3, k3 = [], [], [], [], [], []
        for t in texts.to_pylist():
            tokens = shingles(t, words)
            hashes.append(xxhash.xxh3_128_digest(tokens.tobytes()))
            sizes.append(len(tokens))
            sketches.append(sketch(tokens))
            if not len(tokens):
                n1.append(0)
                continue
            share = 1 / (similarity * len(tokens))
            first, _ = picks(roots, tokens, share)
            second, below = picks(first, tokens, share)
            third, under = picks(second, tokens, share)
            n1.append(len(first))
            k1.append(first)
            n2.append(below)
            k2.append(second)
            n3.append(under)
            k3.append(third)

        def joined(parts):
            return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)

        def ends(parts):
            return pa.array(np.cumsum(np.concatenate([[0], *parts])).astype(np.int32))

        third_ = pa.ListArray.from_arrays(ends(n3), pa.array(joined(k3).astype(np.uint64).view(np.int64)))
        second_ = pa.ListArray.from_arrays(ends(n2), pa.StructArray.from_arrays([pa.array(joined(k2).astype(np.uint64).view(np.int64)), third_], ["k", "below"]))
        first_ = pa.ListArray.from_arrays(ends([n1]), pa.StructArray.from_arrays([pa.array(joined(k1).astype(np.uint64).view(np.int64)), second_], ["k", "below"]))
        return pa.StructArray.from_arrays([pa.array(hashes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), first_], ["set_hash", "n", "sketch", "paths"])

    kind = "struct<set_hash:binary,n:int,sketch:binary,paths:array<struct<k:bigint,below:array<struct<k:bigint,below:array<bigint>>>>>>"
    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, F.arrow_udf(run, kind)(text).alias("_d")).select(*kept, "_d.*")


def _grouped(batches, key: str):
    """Lists of rows with equal keys, from batches sorted by key."""
    group: list[dict] = []
    for batch in pieces_of(batches, ROWS):
        for row in batch.to_pylist():
            if group and row[key] != group[0][key]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def link(sketches: np.ndarray, sizes: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Edges that join the sets which may be similar: a spanning forest, not all pairs.

    A pair is passed over only if it hangs together already. The margin is four
    standard deviations of the sketch's estimate.
    """
    m = len(sizes)
    label = np.arange(m)
    edges = []
    filled = sketches != 0
    for i in range(m - 1):
        later = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(later):
            continue
        small, big = np.minimum(sizes[later], sizes[i]), np.maximum(sizes[later], sizes[i])
        later = later[small >= similarity * big - 1e-9]
        if not len(later):
            continue
        either = (filled[later] | filled[i]).sum(axis=1)
        same = ((sketches[later] == sketches[i]) & filled[i]).sum(axis=1)
        least = similarity - 4 * np.sqrt(similarity * (1 - similarity) / np.maximum(either, 1))
        for j in later[same >= least * either]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                edges.append((i, int(j)))
    return edges


def overlaps(sets: list[np.ndarray], cells: int = 8_000_000) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets)
    ids = np.repeat(np.arange(m), [len(s) for s in sets])
    tokens = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[column]
    number = np.cumsum(shared) - 1
    rows, columns = ids[keep], number[column[keep]]
    width = int(shared.sum())
    out = np.zeros((m, m), dtype=np.float32)
    step = max(1, cells // max(1, m))
    for at in range(0, width, step):
        part = (columns >= at) & (columns < at + step)
        x = np.zeros((m, min(step, width - at)), dtype=np.float32)
        x[rows[part], columns[part] - at] = 1
        out += x @ x.T
    out = out.astype(np.int64)
    out[np.arange(m), np.arange(m)] = [len(s) for s in sets]
    return out


def similar(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Which pairs of sets have at least this Jaccard similarity; no set with itself."""
    both = overlaps(sets)
    n = np.array([len(s) for s in sets])
    linked = both >= similarity * (n[:, None] + n[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _labels(linked: np.ndarray) -> np.ndarray:
    label = np.arange(len(linked))
    for i in range(len(linked)):
        for j in np.flatnonzero(linked[i, i + 1 :]) + i + 1:
            if label[j] != label[i]:
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
    return label


def _blocks(members: DataFrame, node: str, size: str) -> DataFrame:
    """Deals the members of large buckets to pairs of blocks, so that any two meet in one task.

    Adds `low` and `high`, both 0 where one block holds all.
    """
    count = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    dealt = members.withColumn("blocks", count).withColumn("block", F.pmod(F.xxhash64(node), count).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return dealt.withColumn("_o", other).withColumn("low", F.least("block", "_o")).withColumn("high", F.greatest("block", "_o")).drop("_o", "block", "blocks")


def _levels(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Members (bucket, node, size of the bucket) of small buckets on any level, and of large ones on the last."""
    found, large = None, None
    here = nodes.select("set_hash", F.explode("paths").alias("_p")).select("set_hash", F.col("_p.k").alias("bucket"), F.col("_p.below").alias("below"))
    for level in range(1, DEPTH + 1):
        sizes = here.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        small = here.select("bucket", "set_hash").join(sizes.where(F.col("size") <= BUCKET), "bucket")
        found = small if found is None else found.unionByName(small)
        crowded = stored(sizes.where(F.col("size") > BUCKET), f"large{level}")
        if crowded.isEmpty():
            return found, None
        if level == DEPTH:
            large = stored(here.select("bucket", "set_hash").join(crowded, "bucket"), "crowded")
            break
        deeper = here.join(crowded.select("bucket"), "bucket", "left_semi").select("set_hash", F.explode("below").alias("_p"))
        if level + 1 < DEPTH:
            deeper = deeper.select("set_hash", F.col("_p.k").alias("bucket"), F.col("_p.below").alias("below"))
        else:
            deeper = deeper.select("set_hash", F.col("_p").alias("bucket"))
        here = stored(deeper, f"paths{level + 1}")
    return found, large


def follow(sketches: np.ndarray, lead: np.ndarray, similarity: float = SIMILARITY) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges that join to each leader whatever may be linked to a set near it, as a spanning forest; and which sets are near one."""
    label = np.arange(len(sketches))
    led = lead.copy()
    edges = []
    filled = sketches != 0
    ring = similarity + LED - 1  # the least similarity to a leader that a link to one of its sets leaves
    for i in np.flatnonzero(lead):
        either = np.maximum((filled | filled[i]).sum(axis=1), 1)
        share = ((sketches == sketches[i]) & filled[i]).sum(axis=1) / either
        led |= share >= LED
        for j in np.flatnonzero(share >= ring - 4 * np.sqrt(ring * (1 - ring) / either)):
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                edges.append((int(i), int(j)))
    return edges, led


def _led(large: DataFrame, nodes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Candidate edges of large buckets, and the members (bucket, node, size) that no leader is near to.

    Each round costs as much as the buckets hold: leaders go to all blocks of
    their bucket, other members to one. What has no leader goes on while that
    takes a fifth off the bucket; it is compared by blocks where it does not.
    """
    edges, rest, turn = None, None, 0
    while True:
        turn += 1
        count = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
        draw = F.pmod(F.xxhash64("set_hash", F.lit(turn)), F.lit(1 << 31))  # one for all buckets of a set, so that they draw the same leaders
        lead = draw * F.col("size") < LEADERS << 31
        own = F.pmod(F.xxhash64("set_hash", F.lit(turn)), count).cast("int")
        dealt = large.withColumn("lead", lead).withColumn("block", F.explode(F.when(F.col("lead"), F.sequence(F.lit(0), count - 1)).otherwise(F.array(own))))
        dealt = dealt.join(nodes.select("set_hash", "sketch"), "set_hash").select(F.concat_ws(":", "bucket", "block").alias("task"), "bucket", "size", "set_hash", "lead", draw.alias("draw"), "sketch")
        dealt = dealt.repartition("task").sortWithinPartitions("task", "draw", "set_hash")

        def gather(batches):
            claim("jaccard")
            for rows in _grouped(batches, "task"):
                sketches = np.frombuffer(b"".join([r["sketch"] for r in rows]), dtype=np.uint8).reshape(len(rows), BINS)
                found, led = follow(sketches, np.array([r["lead"] for r in rows]), similarity)
                pairs = [(rows[i], rows[j]["set_hash"]) for i, j in found] + [(rows[i], None) for i in np.flatnonzero(~led)]
                columns = [[r["bucket"] for r, _ in pairs], [r["size"] for r, _ in pairs], [r["set_hash"] for r, _ in pairs], [b for _, b in pairs]]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "was", "a", "b"])

        out = stored(dealt.mapInArrow(gather, "bucket long, was long, a binary, b binary"), f"led{turn}")
        joined = out.where("b is not null").select("a", "b").distinct()
        edges = joined if edges is None else edges.unionByName(joined)
        left = out.where("b is null").select("bucket", "was", F.col("a").alias("set_hash"))
        sizes = left.groupBy("bucket", "was").agg(F.count("*").alias("size")).where("size > 1")
        left = stored(left.drop("was").join(sizes, "bucket"), f"unled{turn}")
        again = (F.col("size") > BUCKET) & (F.col("size") <= 0.8 * F.col("was"))
        done = left.where(~again).drop("was")
        rest = done if rest is None else rest.unionByName(done)
        large = left.where(again).drop("was")
        if large.isEmpty():
            return edges, rest


def components(edges: DataFrame) -> DataFrame:
    """Least node of each node's component, from edges (a, b): columns node and root.

    Labels spread along edges and then jump to their label's label, so few
    rounds are needed; each is written to the shared folder. A node with very
    many edges, or a label of very many nodes, is dealt to several tasks.
    Edges may repeat, and those with both ends in one node or a null end say
    nothing; without edges there is no row.
    """
    both = stored(edges.union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "labels")
    while True:
        near = spread_join(both, labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("_n")).agg(F.min("root").alias("_near"))
        spread = labels.join(near, F.col("node") == F.col("_n")).select("node", F.least("root", "_near").alias("root"), (F.col("_near") < F.col("root")).alias("moved"))
        spread = stored(spread, "spread")
        if not spread.where("moved").head(1):
            return labels
        # a label is a node and so has a label of its own
        jump = spread.select(F.col("node").alias("root"), F.col("root").alias("_far"))
        labels = stored(spread_join(spread.select("node", "root"), jump, "root").select("node", F.least("root", "_far").alias("root")), "labels")


def _candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """Groups (node, root) of the sets that may be similar, directly or over others."""
    members, large = _levels(nodes)
    led = None
    if large is not None:
        led, rest = _led(large, nodes, similarity)
        members = members.unionByName(rest)
    compared = _blocks(members, "set_hash", "size").join(nodes.select("set_hash", "n", "sketch"), "set_hash")
    compared = compared.select(F.concat_ws(":", "bucket", "low", "high").alias("task"), "set_hash", "n", "sketch")
    compared = compared.repartition("task").sortWithinPartitions("task", "set_hash")

    def may_link(batches):
        claim("jaccard")
        for rows in _grouped(batches, "task"):
            rows = list({r["set_hash"]: r for r in rows}.values())
            if len(rows) < 2:
                continue
            sketches = np.frombuffer(b"".join([r["sketch"] for r in rows]), dtype=np.uint8).reshape(len(rows), BINS)
            edges = link(sketches, np.array([r["n"] for r in rows]), similarity)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([rows[i]["set_hash"] for i, _ in edges], pa.binary()), pa.array([rows[j]["set_hash"] for _, j in edges], pa.binary())], names=["a", "b"])

    edges = compared.mapInArrow(may_link, "a binary, b binary")
    return components(edges if led is None else edges.unionByName(led))


_CHECKED = "node binary, root binary, links long, texts long, parted boolean"


def _checked(rows: list[dict], similarity: float) -> pa.RecordBatch:
    """Links of the sets of one task that holds a whole group."""
    rows = list({r["node"]: r for r in rows}.values())
    linked = similar([np.frombuffer(r["tokens"], dtype=np.uint64) for r in rows], similarity)
    label = _labels(linked)
    weights = np.array([r["weight"] for r in rows], dtype=np.int64)
    columns = [
        pa.array([r["node"] for r in rows], pa.binary()),
        pa.array([rows[k]["node"] for k in label], pa.binary()),
        pa.array(linked.astype(np.int64) @ weights),
        pa.array(linked.sum(axis=1).astype(np.int64)),
        pa.array([False] * len(rows)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["node", "root", "links", "texts", "parted"])


def _checked_small(read: DataFrame, similarity: float) -> DataFrame:
    """Roots and links of groups that one task compares."""

    def check(batches):
        claim("jaccard")
        for rows in _grouped(batches, "root"):
            yield _checked(rows, similarity)

    rows = read.select("root", "node", "weight", "tokens").repartition("root").sortWithinPartitions("root", "node")
    return rows.mapInArrow(check, _CHECKED)


def ratio(similarity: float) -> tuple[int, int]:
    """p and q such that two sets are as similar just if their symmetric difference is at most p / q of their sizes' sum."""
    s = Fraction(similarity).limit_denominator(10_000)
    k = (1 - s) / (1 + s)
    return k.numerator, k.denominator


def difference(tokens: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """What a set has more and less than the centre, sorted: what it has more, which is rare, comes first."""
    more, less = np.setdiff1d(tokens, centre, assume_unique=True), np.setdiff1d(centre, tokens, assume_unique=True)
    return np.sort(np.concatenate([more >> _U(1), less >> _U(1) | _U(1 << 63)]))


def _centres(large: DataFrame) -> DataFrame:
    """root and centre: the shingles that at least half of about CENTRE sets of the group hold."""
    drawn = large.where(F.pmod(F.xxhash64("node"), F.col("size")) < CENTRE).select("root", "tokens")
    taken = drawn.groupBy("root").agg(F.count("*").alias("sets"))

    def each(batches):
        for batch in batches:
            sets = [np.frombuffer(t, dtype=np.int64) for t in batch.column("tokens").to_pylist()]
            of = np.repeat(np.arange(len(sets)), [len(t) for t in sets])
            yield pa.RecordBatch.from_arrays([batch.column("root").take(pa.array(of)), pa.array(np.concatenate(sets))], names=["root", "token"])

    held = drawn.mapInArrow(each, "root binary, token long").groupBy("root", "token").agg(F.count("*").alias("n"))
    return held.join(taken, "root").where(2 * F.col("n") >= F.col("sets")).groupBy("root").agg(F.collect_list("token").alias("centre"))


def _compared(rows: list[dict], q: int) -> pa.RecordBatch:
    """Links, among those not certain, of the sets of one task, by their differences; of two blocks, only links between them."""
    rows = list({r["node"]: r for r in rows}.values())
    sets = [np.frombuffer(r["tokens"], dtype=np.uint64) for r in rows]
    slack = np.array([r["slack"] for r in rows], dtype=np.int64)
    both = slack[:, None] + slack[None, :]
    linked = (both < 0) & (2 * q * overlaps(sets) >= -both)
    np.fill_diagonal(linked, False)
    if rows[0]["low"] != rows[0]["high"]:
        block = np.array([r["block"] for r in rows])
        linked &= block[:, None] != block[None, :]
    label = _labels(linked)
    weights = np.array([r["weight"] for r in rows], dtype=np.int64)
    kept = np.flatnonzero(linked.any(axis=1))
    columns = [
        pa.array([rows[k]["node"] for k in kept], pa.binary()),
        pa.array([rows[label[k]]["node"] for k in kept], pa.binary()),
        pa.array((linked.astype(np.int64) @ weights)[kept]),
        pa.array(linked.sum(axis=1).astype(np.int64)[kept]),
        pa.array([True] * len(kept), pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["node", "root", "links", "texts", "parted"])


def _known(large: DataFrame, similarity: float) -> DataFrame:
    """Sets of large groups with their difference (tokens), its size (deep), their slack and ring, all rings of the group, and how many sets they are linked to for certain.

    With n shingles and d in its difference, a set has the slack p n - q d. By
    counting, two sets are linked just if q times twice what their differences
    share is at least what both slacks together lack; so they are for certain
    if these lack nothing, which needs no more than how many sets of each
    slack there are, and all such sets are linked to the one of most slack.
    """
    p, q = ratio(similarity)
    salts = F.ceil(F.col("size") / F.lit(BLOCK * 16)).cast("int")
    made = _centres(large).join(large.select("root", salts.alias("salts")).distinct(), "root").select("root", "centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salt = F.pmod(F.xxhash64("node"), salts).cast("int")

    def measure(tokens: pa.Array, centre: pa.Array) -> pa.Array:
        claim("jaccard")
        out, slack, deep = [], [], []
        for t, c in zip(tokens.to_pylist(), centre.to_pylist()):
            own = np.frombuffer(t, dtype=np.uint64)
            d = difference(own, np.sort(np.array(c or [], dtype=np.int64).view(np.uint64)))
            out.append(d.tobytes())
            deep.append(len(d))
            slack.append(p * len(own) - q * len(d))
        return pa.StructArray.from_arrays([pa.array(slack, pa.int64()), pa.array(deep, pa.int64()), pa.array(out, pa.binary())], ["slack", "deep", "tokens"])

    placed = large.withColumn("salt", salt).join(stored(made, "centres"), ["root", "salt"], "left")
    measured = F.arrow_udf(measure, "struct<slack:bigint,deep:bigint,tokens:binary>").asNondeterministic()("tokens", "centre")
    placed = stored(placed.select("root", "node", "weight", "size", measured.alias("m")).select("root", "node", "weight", "size", "m.*"), "placed")

    # how many sets have each slack: as many rows as there are different slacks, which the longest text bounds
    each = stored(placed.groupBy("root", "size", "slack").agg(F.count("*").alias("sets"), F.sum("weight").alias("weights"), F.min("node").alias("head"), F.max("deep").alias("deep")), "slacks")
    zero = F.lit(0).cast("long")
    given = each.select("root", F.col("slack").alias("at"), F.lit(0).alias("asks"), "sets", "weights", zero.alias("slack"))
    asked = each.select("root", (-F.col("slack")).alias("at"), F.lit(1).alias("asks"), zero.alias("sets"), zero.alias("weights"), "slack")
    above = Window.partitionBy("root").orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sure = given.unionByName(asked).select("root", "slack", "asks", F.sum("sets").over(above).alias("sure_sets"), F.sum("weights").over(above).alias("sure_weights")).where("asks = 1").drop("asks")
    span = each.groupBy("root", "size").agg(F.min("slack").alias("least"), F.max("slack").alias("most"), F.max_by("head", "slack").alias("head"))
    width = F.ceil((F.col("most") - F.col("least") + 1) / RINGS).cast("long")
    ring_of = F.floor((F.col("slack") - F.col("least")) / width).cast("long")
    rings = each.join(span.drop("size", "head"), "root").withColumn("ring", ring_of).groupBy("root", "ring").agg(F.sum("sets").alias("sets"), F.min("slack").alias("low"), F.max("slack").alias("high"), F.max("deep").alias("deep"))
    rings = rings.groupBy("root").agg(F.collect_list(F.struct("ring", "sets", "low", "high", "deep")).alias("all"))  # RINGS at most
    told = sure.join(span, "root").join(rings, "root").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return stored(placed.withColumn("salt", salt).join(told.drop("size"), ["root", "slack", "salt"]).withColumn("ring", ring_of).drop("salt", "least"), "known")


def _certain(known: DataFrame) -> DataFrame:
    """Links that slacks alone make certain, and to which set of the group they lead."""
    own = F.when(F.col("slack") >= 0, 1).otherwise(0).cast("long")
    near = F.col("slack") + F.col("most") >= 0
    return known.select("node", F.when(near, F.col("head")).otherwise(F.col("node")).alias("root"), (F.col("sure_weights") - own * F.col("weight")).alias("links"), (F.col("sure_sets") - own).alias("texts"), F.lit(True).alias("parted"))


def _meetings(known: DataFrame, q: int) -> DataFrame:
    """The sets that meet in each task, since rings of theirs may be linked without being so for certain: enough of their differences must be shared."""
    lacks = lambda r: -(F.col("slack") + r["high"])
    open_ = F.filter("all", lambda r: (F.col("slack") + r["low"] < 0) & (F.col("deep") > 0) & (lacks(r) <= 2 * q * F.least(F.col("deep"), r["deep"])))
    mine = F.filter("all", lambda r: r["ring"] == F.col("ring"))[0]["sets"]
    met = known.select("root", "node", "weight", "slack", "tokens", "ring", mine.alias("mine"), F.explode(open_).alias("r"))
    blocks = F.ceil(F.col("mine") / BLOCK).cast("long")
    block = F.col("ring") * (1 << 32) + F.pmod(F.xxhash64("node", F.lit(1)), blocks)
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("r.sets") / BLOCK).cast("long") - 1), lambda b: F.col("r.ring") * (1 << 32) + b)
    met = met.withColumn("block", block).withColumn("other", F.explode(others))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return met.select(F.concat_ws(":", F.hex("root"), low, high).alias("task"), low.alias("low"), high.alias("high"), "block", "node", "weight", "slack", "tokens")


def _checked_large(large: DataFrame, similarity: float) -> list[DataFrame]:
    """Edges and links of groups that are too large for one task."""
    known, q = _known(large, similarity), ratio(similarity)[1]

    def check(batches):
        claim("jaccard")
        for rows in _grouped(batches, "task"):
            yield _compared(rows, q)

    return [_certain(known), _meetings(known, q).repartition("task").sortWithinPartitions("task", "node").mapInArrow(check, _CHECKED)]


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS, runs: int | None = None) -> DataFrame:
    """For each document its class and how many others it is linked to.

    Returns key, class_id (least key of the documents that links join,
    directly or over others), n_links (other documents of at least the
    similarity, copies included) and n_texts (linked shingle sets that differ
    from its own). Documents with equal shingle sets are copies. A document
    without a word is linked to none. A null key gives a null class and no
    link, since no link could name it; rows that repeat a key each count. An
    empty table gives no row. Other columns of `docs`, whatever their names,
    take no part.
    """
    spark, before = docs.sparkSession, written()
    sets = stored(describe(docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("text")), "text", similarity, words, runs), "sets")
    nodes = sets.where("n > 0").groupBy("set_hash").agg(
        F.min("_key").alias("rep"), F.count("*").alias("weight"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")
    )
    nodes = stored(nodes, "nodes")

    groups = _candidates(nodes, similarity)
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    grouped = spread_join(groups, sizes, "root").join(nodes.select(F.col("set_hash").alias("node"), "rep", "weight"), "node")
    again = docs.select(F.col(key).alias("rep"), F.col(text).alias("text"))

    def tokens(batches):
        """The shingles of each text, where they are those of the node it stands for."""
        claim("jaccard")
        for batch in pieces_of(batches, ROWS):
            found = [shingles(t, words).tobytes() for t in batch.column("text").to_pylist()]
            mine = [xxhash.xxh3_128_digest(f) == node for f, node in zip(found, batch.column("node").to_pylist())]
            out = pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, pa.array(found, pa.binary())], names=[*(n for n in batch.schema.names if n != "text"), "tokens"])
            yield out.filter(pa.array(mine, pa.bool_()))

    # as a map over the joined rows, so that only texts of candidate groups are read for shingles, once each
    read = again.join(grouped, "rep").select("root", "node", "weight", "size", "text").mapInArrow(tokens, "root binary, node binary, weight long, size long, tokens binary")
    read = stored(read, "tokens")
    checked = [_checked_small(read.where(F.col("size") <= BUCKET), similarity)]
    large = read.where(F.col("size") > BUCKET)
    if not large.isEmpty():
        checked += _checked_large(large.dropDuplicates(["node"]), similarity)
    checked = stored(functools.reduce(DataFrame.unionByName, checked), "checked")
    parted = checked.where("parted").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = checked.where("not parted").select("node", "root")
    if not parted.isEmpty():
        roots = roots.unionByName(components(parted).select("node", "root"))
    counts = checked.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))

    # classes of nodes, then of documents
    placed = nodes.select(F.col("set_hash").alias("node"), "rep", "weight").join(roots, "node", "left").join(counts, "node", "left")
    placed = placed.select("node", F.coalesce("root", "node").alias("root"), "rep", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"))
    placed = stored(placed, "placed")
    discard(spark, before, sets, placed)
    classes = placed.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = spread_join(placed, classes, "root").select("node", "class_id", (F.col("links") + F.col("weight") - 1).alias("n_links"), F.col("texts").alias("n_texts"))
    zero = F.lit(0).cast("long")
    worded = spread_join(sets.where("n > 0").select("_key", "set_hash"), named.withColumnRenamed("node", "set_hash"), "set_hash").select(F.col("_key").alias(key), "class_id", "n_links", "n_texts")
    bare = sets.where("n = 0").select(F.col("_key").alias(key), F.col("_key").alias("class_id"), zero.alias("n_links"), zero.alias("n_texts"))
    nameless = docs.where(F.col(key).isNull()).select(key, F.col(key).alias("class_id"), zero.alias("n_links"), zero.alias("n_texts"))
    return worded.unionByName(bare).unionByName(nameless)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document, by the contract's five words and 0.8; odd rows as `jaccard_join` says."""
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one of least id, with the columns it came with.

    Documents with a null id stay, null and empty texts are alike to none, and
    an empty table stays empty. Rows that repeat an id count as one document.
    """
    classes = jaccard_join(docs.select("doc_id", "text"))
    gone = classes.where("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeats = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeats.isEmpty():
        return kept
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns)))
    nth = f"nth_{uuid.uuid4().hex}"
    named = kept.where("doc_id is not null").withColumn(nth, again).where(F.col(nth) == 1).drop(nth)
    return named.unionByName(kept.where("doc_id is null"))


OP2_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE doc_id IS NOT NULL
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words
), sets AS (
    SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS h FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y, p.h <> q.h AS differs FROM shared JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y
    WHERE common >= 0.8 * (p.n + q.n - common) - 1e-9
), reach(x, y) AS (
    SELECT doc_id, doc_id FROM words UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), others AS (
    SELECT x, count(*) AS n_links, count(DISTINCT q.h) FILTER (differs) AS n_texts FROM links JOIN sets q ON q.doc_id = y GROUP BY x
)
SELECT d.doc_id, r.class_id, coalesce(o.n_links, 0) AS n_links, coalesce(o.n_texts, 0) AS n_texts
FROM documents d
LEFT JOIN (SELECT x, min(y) AS class_id FROM reach GROUP BY x) r ON r.x = d.doc_id
LEFT JOIN others o ON o.x = d.doc_id
"""
