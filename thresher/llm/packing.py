"""Best-fit decreasing packing of token sequences, with a segment tree over remaining capacities.

Pieces of one length are alike to the packer, so it works on how many there
are of each length: at most `capacity` numbers, whatever the size of the
corpus. A segment tree over remaining capacities finds the tightest open bin
in logarithmic time, and bins alike are filled together. The outcome is the
one that placing the pieces one by one gives. Its runs say where the n-th
piece of a length goes; pieces get their n by a two-level count, so no length
is gathered into one task.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thresher.llm._common import claim, fresh, stored, table, text_or_empty, worker_cache
from thresher.llm.bpe import SPACE

CAPACITY = 2048
#: Id after the last token of each document.
END_ID = 0

#: How byte-level vocabularies split text before the merges; a fixed value.
_PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: White space as that pattern means it, in runs from which on they are cut out.
_LONG_SPACE = re.compile(f"[{SPACE}]{{4096,}}")


def _pattern_of(path: str) -> str | None:
    """The pattern by which a byte-level file splits text; files that only say `ByteLevel` mean the usual one."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)["pre_tokenizer"]
    parts = spec.get("pretokenizers", [spec])
    named = [p["pattern"]["Regex"] for p in parts if p["type"] == "Split"]
    usual = any(p["type"] == "ByteLevel" and p.get("use_regex", True) and not p.get("add_prefix_space") for p in parts)
    return named[0] if named else _PRETOKENS if usual else None


class ByteBPE:
    """Ids as the `tokenizers` library gives them for a byte-level BPE file.

    `tiktoken` gives them, with the file's own vocabulary as ranks, in a sixth
    of the library's time; only texts with the string of an added token go to
    the library. Tests hold both against each other on every code point.

    Long runs of white space are cut out first, since `tiktoken` looks for
    their end by recursion. A run before another character is one word but for
    its last character, which begins the next; a run at the end is one word.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        byte = {chr(b) if b in shown else chr(next(spare)): b for b in range(256)}
        vocab = self.library.get_vocab(with_added_tokens=False)
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if t not in self._added}
        if _PRETOKENS != _pattern_of(path):
            raise ValueError(f"{path} splits text in another way")
        self._coder = tiktoken.Encoding("file", pat_str=_PRETOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as 32-bit integers."""
        if any(t in text for t in self._added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if not _LONG_SPACE.search(text):
            return np.array(array("I", self._coder.encode_ordinary(text)), dtype="<u4")
        out, at = array("I"), 0
        for run in _LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out.extend(self._coder.encode_ordinary(text[at : run.start()]))
            out.extend(self._coder._encode_single_piece(text[run.start() : end]))
            at = end
        out.extend(self._coder.encode_ordinary(text[at:]))
        return np.array(out, dtype="<u4")


_LOADED: dict[str, ByteBPE] = worker_cache("packing", {})


def load(path: str) -> ByteBPE:
    """The tokenizer of a file, kept by each worker."""
    claim("packing")
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def cut(df: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document, with all other columns but the text.

    Adds piece (from 0), start, length and ids (little-endian 32-bit). A
    document is its token ids and then id 0; only one longer than `capacity`
    is cut, the first piece taking what whole pieces leave. Null text counts
    as empty and gives one piece of one id. Repeated rows are cut each. An
    empty table gives no row. Columns of the added names are replaced.
    """

    def pieces(texts: pa.Array) -> pa.Array:
        rows: list[dict] = []
        ends = [0]
        bpe = load(path)
        for text in texts.to_pylist():
            ids = np.append(bpe.encode(text or ""), np.uint32(END_ID)).astype("<u4", copy=False)
            raw, n = ids.tobytes(), len(ids)
            at = 0
            size = n % capacity or min(n, capacity)
            while at < n:
                rows.append({"piece": len(rows) - ends[-1], "start": at, "length": size, "ids": raw[4 * at : 4 * (at + size)]})
                at += size
                size = capacity
            ends.append(len(rows))
        kind = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows, kind))

    kind = "array<struct<piece:int,start:bigint,length:bigint,ids:binary>>"
    kept = [c for c in df.columns if c not in (text, "piece", "start", "length", "ids")]
    coded = df.select(*kept, F.explode(F.arrow_udf(pieces, kind)(text_or_empty(text))).alias("_p"))
    return coded.select(*kept, "_p.piece", "_p.start", "_p.length", "_p.ids")


class _Capacities:
    """Segment tree over remaining capacities: a leaf counts the groups of open bins that have it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        i = self.size + remaining
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity from `least` on that some open bin has."""
        i = self.size + least
        if self.tree[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first, count, bin, per_bin, offset) of best-fit decreasing.

    The pieces first, first + 1, ... of a length go to bins from `bin` on,
    `per_bin` in a row into each, the first of them at `offset`.
    """
    tree = _Capacities(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}
    runs = []
    bins = 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_bins.setdefault(remaining, []).append((first, n))
            tree.add(remaining, 1)

    for length in sorted(counts, reverse=True):
        left, nth = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, bins
                each = capacity // length
                n = -(-left // each)
                bins += n
            else:
                first, n = open_bins[room].pop()
                tree.add(room, -1)
                each = room // length
            # a bin that still has room for another is tighter than any, so it is filled first
            full = min(n, left // each)
            if not full:
                each, full = left, 1
            runs.append((length, nth, full * each, first, each, capacity - room))
            nth += full * each
            left -= full * each
            put(room - each * length, first, full)
            if room < capacity:
                put(room, first + full, n - full)
            elif n > full:
                # the last new bin takes what is left over
                runs.append((length, nth, left, first + full, left, 0))
                put(capacity - left * length, first + full, 1)
                left = 0
    return runs


def numbered(df: DataFrame, length: str, capacity: int, task_: str = "_task", nth_: str = "_nth") -> DataFrame:
    """`df` with its task, and how many rows of the same length the task had before: -1 if it can't be packed."""
    schema = T.StructType([*df.schema.fields, T.StructField(task_, T.IntegerType()), T.StructField(nth_, T.LongType())])

    def number(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            at = batch.column(batch.schema.get_field_index(length)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.where((at < 1) | (at > capacity), 0, at)
            order = np.argsort(at, kind="stable")
            ranked = at[order]
            starts = np.flatnonzero(np.diff(ranked, prepend=-1))
            sizes = np.diff(np.r_[starts, len(at)])
            nth = np.empty(len(at), dtype=np.int64)
            nth[order] = np.arange(len(at)) - np.repeat(starts, sizes) + seen[np.repeat(ranked[starts], sizes)]
            nth[at == 0] = -1
            seen[ranked[starts]] += sizes
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), task, dtype=np.int32)), pa.array(nth)], names=[*batch.schema.names, task_, nth_])

    return df.mapInArrow(number, schema)


def pack(df: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """`df` with sequence_id and offset for each row, packed by best-fit decreasing.

    Equal rows are packed each, an empty table stays empty. Lengths must lie
    between 1 and `capacity`; other rows and null lengths belong to no sequence and get nulls. Which of several rows of one length
    comes first is fixed by where they are stored. Columns named sequence_id
    or offset are replaced, all others stay.
    """
    spark = df.sparkSession
    df = df.select(*[c for c in df.columns if c not in ("sequence_id", "offset")])
    task_, nth_, before_, length_, of_, at_ = fresh(df, "_task", "_nth", "_before", "_length", "_of", "_at")
    rows = stored(numbered(df, length, capacity, task_, nth_), "pieces")
    fits = F.col(nth_) >= 0
    per_task = rows.where(fits).groupBy(F.col(length).alias(length_), F.col(task_).alias(of_)).agg(F.count("*").alias("n"))
    order = Window.partitionBy(length_).orderBy(of_).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = per_task.select(length_, of_, (F.sum("n").over(order) - F.col("n")).alias(before_))
    counts = {r[0]: r[1] for r in rows.where(fits).groupBy(length).count().collect()}  # one number for each length
    runs = best_fit_decreasing({int(k): int(n) for k, n in counts.items()}, capacity)
    runs.sort()
    plan = spark.sparkContext.broadcast(np.array(runs, dtype=np.int64).reshape(-1, 6))

    def place(lengths: pa.Array, nths: pa.Array) -> pa.Array:
        plan_ = plan.value
        keys = plan_[:, 0] << 44 | plan_[:, 1]
        n = nths.to_numpy(zero_copy_only=False).astype(np.int64)
        size = lengths.to_numpy(zero_copy_only=False).astype(np.int64)
        run = plan_[np.searchsorted(keys, size << 44 | n, side="right") - 1]
        at = n - run[:, 1]
        return pa.StructArray.from_arrays([pa.array(run[:, 3] + at // run[:, 4]), pa.array(run[:, 5] + at % run[:, 4] * size)], ["sequence_id", "offset"])

    joined = rows.where(fits).join(before, (F.col(length) == F.col(length_)) & (F.col(task_) == F.col(of_)))
    found = F.arrow_udf(place, "struct<sequence_id:bigint,offset:bigint>")(F.col(length).cast("long"), F.col(nth_) + F.col(before_))
    packed = joined.select(*df.columns, found.alias(at_)).select(*df.columns, f"{at_}.sequence_id", f"{at_}.offset")
    missed = rows.where(~fits).select(*df.columns, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    return packed.unionByName(missed)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of all documents, a checksum in the place of their ids, and where each is packed.

    Null text counts as empty, which is a piece of one id; texts of any length
    are cut whole; rows that repeat an id, null ids among them, are packed
    each; an empty table gives no row; other columns of `docs` take no part.
    """
    pieces = cut(docs.select("doc_id", "text"), default_path())
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(slim)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048; null text counts as empty, rows that repeat an id are packed each, no documents give no row."""
    return packed_documents(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the pieces of the documents that are left go; null and empty texts are pieces of one id."""
    return packed_documents(docs)
