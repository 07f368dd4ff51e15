"""Byte-level BPE by a global shuffle of distinct words.

Texts fall into words, the matches of a pattern. Documents are dealt to blocks
of bounded size; in its block a document is the sequence of its words' slots,
and the block lists its distinct words once, with their slots. The words of
all blocks meet in one shuffle by their hash, where each distinct word is
encoded once; its ids go back to the slots, and documents are put together by position
from what their blocks were given, where they lie. So what is shuffled is a
dictionary for each block and not every occurrence, and a word that all
documents hold is one row for each block. Decoding joins the table of token
bytes, which is as long as the vocabulary, to the ids.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thresher.llm._common import claim, fresh, stored_by, table, worker_cache
from thresher.llm.bpe import SPACE

#: Characters and different pieces of text in a block, about.
LETTERS, PIECES = 24_000_000, 450_000
#: Rows of a batch that are Python objects at a time.
ROWS = 1024

#: A space between two other characters, where no match of the pattern goes on but the one that the space begins.
_SINGLE = re.compile(f" (?<![{SPACE}] )(?![{SPACE}])")


class Coder:
    """The ids of single words, by the ranks of a vocabulary file, and how texts fall into words."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        self.words = regex.compile(spelt(pattern)).findall

    def encode(self, word: str | bytes) -> list[int]:
        return self.encoding._encode_single_piece(word)


def spelt(pattern: str) -> str:
    """The pattern with white space spelt out as the Unicode property, since not all engines mean that by it."""
    inside = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\s", SPACE), pattern)
    return inside.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a file of lines with base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


_LOADED: dict[tuple[str, str], Coder] = worker_cache("bytebpe", {})


def load(path: str, pattern: str) -> Coder:
    """The coder of a file and pattern, kept by each worker."""
    claim("bytebpe")
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Coder(path, pattern)
    return _LOADED[path, pattern]


class _Slots(dict):
    """Slots of the words of a piece of text, as native 32-bit integers, for one block; `lead` stands before each piece."""

    def __init__(self, words, numbers: dict[str, int], lead: str):
        super().__init__()
        self.words, self.numbers, self.lead = words, numbers, lead

    def __missing__(self, piece: str) -> bytes:
        number = self.numbers
        found = [number.setdefault(w, len(number)) for w in self.words(self.lead + piece)]
        slots = np.array(found, dtype=np.int32).tobytes()
        if len(piece) <= 64:  # longer ones hardly come again
            self[piece] = slots
        return slots


class _Block:
    """The words of one block and what its texts are in terms of them."""

    def __init__(self, words):
        self.numbers: dict[str, int] = {}
        self.first, self.spaced = _Slots(words, self.numbers, ""), _Slots(words, self.numbers, " ")
        self.letters = 0

    def slots(self, text: str) -> bytes:
        self.letters += len(text)
        first, *rest = _SINGLE.split(text)
        return b"".join([self.first[first], *map(self.spaced.__getitem__, rest)])

    def full(self) -> bool:
        return self.letters >= LETTERS or len(self.spaced) >= PIECES


def _planes(slots: bytes) -> bytes:
    """32-bit integers by significance of their bytes, since high ones are mostly zero and then cost nothing when compressed."""
    return np.frombuffer(slots, dtype=np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1)


def _cut(raw: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


class _Names:
    """Names of helper columns that clash with none of a table's."""

    def __init__(self, df: DataFrame):
        self.text, self.block, self.slots, self.part, *self.packed = fresh(df, "_text", "_block", "_slots", "_part", "_places", "_sizes", "_values")

    def schema(self, kept: list[T.StructField]) -> T.StructType:
        kinds = [(self.block, T.LongType()), (self.slots, T.BinaryType()), (self.part, T.IntegerType()), *((c, T.BinaryType()) for c in self.packed)]
        return T.StructType([*kept, *(T.StructField(c, k) for c, k in kinds)])


def _packed(places: np.ndarray, values: list[bytes]) -> list[bytes]:
    """Values of any size and the slots they belong to, in three columns."""
    sizes = np.array([len(v) for v in values], dtype=np.int32)
    return [_planes(places.astype(np.int32).tobytes()), _planes(sizes.tobytes()), b"".join(values)]


def _unpacked(places: bytes, sizes: bytes, values: bytes) -> tuple[np.ndarray, list[bytes]]:
    return _from_planes(places), _cut(values, _from_planes(sizes))


def _split(rows: DataFrame, path: str, pattern: str, names: _Names, parts: int) -> DataFrame:
    """Rows of two kinds: each of `rows` with its block and slots in the place of its text, and each block's words.

    Words are dealt to `parts` by a hash, and a block has one row for those of
    each part.
    """
    kept = [f for f in rows.schema.fields if f.name != names.text]
    schema = names.schema(kept)

    def split(batches):
        words = load(path, pattern).words
        number, block = TaskContext.get().partitionId() << 32, _Block(words)
        kinds = None

        def dictionary():
            found = [w.encode() for w in block.numbers]
            part = np.fromiter(map(zlib.crc32, found), dtype=np.int64, count=len(found)) % parts
            order = np.argsort(part, kind="stable")
            rows_ = [(p, *_packed(at, [found[i] for i in at.tolist()])) for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) for p in part[at[:1]].tolist()]
            n, columns = len(rows_), list(zip(*rows_))
            new = [pa.array(np.full(n, number)), pa.nulls(n, pa.binary()), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])]
            return pa.RecordBatch.from_arrays([*(pa.nulls(n, k) for k in kinds), *new], names=schema.names)

        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            kinds = [c.type for c in own]
            blocks, slots, full = [], [], []
            for t in batch.column(batch.schema.get_field_index(names.text)).to_pylist():
                slots.append(_planes(block.slots(t or "")))
                blocks.append(number)
                if block.full():
                    full += [dictionary()] if block.numbers else []
                    number, block = number + 1, _Block(words)
            n = batch.num_rows
            new = [pa.array(blocks, pa.int64()), pa.array(slots, pa.binary()), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 3]
            yield pa.RecordBatch.from_arrays([*own, *new], names=schema.names)
            yield from full
        if block.numbers:
            yield dictionary()

    return rows.mapInArrow(split, schema)


def _encoded(dictionary: DataFrame, path: str, pattern: str, names: _Names, parts: int) -> DataFrame:
    """The ids of each block's words, by slot. All that equal words have in common is their part, where each is encoded once."""
    schema = T.StructType([T.StructField(names.block, T.LongType()), *(T.StructField(c, T.BinaryType()) for c in names.packed)])

    def encode(batches):
        coder = load(path, pattern)
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for row in batch.select(names.packed).to_pylist():
                places, words = _unpacked(*row.values())
                for w in words:
                    if w not in known:
                        known[w] = np.array(coder.encode(w), dtype="<u4").tobytes()
                ids = [known[w] for w in words]
                places, sizes, values = _packed(places, ids)
                out.append((places, sizes, _planes(values)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(names.block)), *(pa.array(c, pa.binary()) for c in zip(*out))], names=schema.names)

    return dictionary.repartitionById(parts, F.col(names.part)).mapInArrow(encode, schema)


def encode(df: DataFrame, path: str, pattern: str | None = None, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """`df` with, in the place of each text, its ids, little-endian 32-bit, and what `decode` makes of them, if `decoded` names a column for it.

    Null text counts as empty and has no ids. Texts of any length are encoded
    whole; equal texts give equal values, rows that repeat stay rows; an empty
    table stays empty. Columns already named `ids` or `decoded` are replaced,
    all others but the text stay. Decoding along the way spares a second
    worker for each task.
    """
    pattern = pattern or default_pattern()
    order = [c for c in df.columns if c not in (text, ids, decoded)]
    names = _Names(df)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = stored_by(_split(df.select(*order, F.col(text).alias(names.text)), path, pattern, names, parts), "words", names.block)
    found = _encoded(split.where(F.col(names.part).isNotNull()).select(names.block, names.part, *names.packed), path, pattern, names, parts)
    docs = split.where(F.col(names.part).isNull()).select(*order, names.block, names.slots)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name in order), *(T.StructField(c, T.BinaryType()) for c in (ids, decoded) if c)])
    tokens = _shared_tokens(df.sparkSession, path) if decoded else None

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        claim("bytebpe")
        rows = [_unpacked(r[0], r[1], _from_planes(r[2]).tobytes()) for r in zip(*(right.column(c).to_pylist() for c in names.packed))]
        of = np.empty(sum(len(places) for places, _ in rows), dtype=object)
        for places, values in rows:
            of[places] = values
        slots, whole, back = left.column(names.slots), [], []
        for at in range(0, len(slots), ROWS):
            found = [b"".join(of[_from_planes(raw)].tolist()) for raw in slots.slice(at, ROWS).to_pylist()]
            whole.append(pa.array(found, pa.binary()))
            if tokens:
                back.append(pa.array([_bytes_of(raw, tokens.value) for raw in found], pa.binary()))
        out = left.select(order).append_column(ids, pa.chunked_array(whole, pa.binary()))
        return out.append_column(decoded, pa.chunked_array(back, pa.binary())) if tokens else out

    return docs.groupBy(names.block).cogroup(found.groupBy(names.block)).applyInArrow(assemble, schema)


def _shared_tokens(spark: SparkSession, path: str):
    """The bytes of each token by its id, for the workers."""
    ranks = read_ranks(path)
    tokens = np.full(max(ranks.values(), default=-1) + 1, None, dtype=object)
    tokens[list(ranks.values())] = list(ranks)
    return spark.sparkContext.broadcast(tokens)


def _bytes_of(raw: bytes | None, tokens: np.ndarray) -> bytes | None:
    at = np.frombuffer(raw or b"", dtype="<u4")
    if raw is None or (len(at) and at.max() >= len(tokens)):
        return None
    found = tokens[at].tolist()
    return None if None in found else b"".join(found)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` with the bytes that each row's ids, little-endian 32-bit, decode to.

    Null ids give null, as does an id that the vocabulary lacks; no ids give no
    bytes; rows that repeat stay rows; an empty table stays empty. A column
    already named `decoded` is replaced, all others stay. The table of token
    bytes is joined on the side of the rows: its length is the vocabulary's.
    """
    shared = _shared_tokens(df.sparkSession, path)

    def run(column: pa.Array) -> pa.Array:
        return pa.array([_bytes_of(raw, shared.value) for raw in column.to_pylist()], pa.binary())

    return df.withColumn(decoded, F.arrow_udf(run, "binary")(ids))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests; null text counts as empty, rows that repeat an id are encoded each."""
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path(), decoded="decoded")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
