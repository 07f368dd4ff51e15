import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from thresher.llm import bytebpe


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("test", pat_str=bytebpe.default_pattern(), mergeable_ranks=bytebpe.read_ranks(bytebpe.default_path()), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bytebpe.load(bytebpe.default_path(), bytebpe.default_pattern())


def split(coder, text):
    block = bytebpe._Block(coder.words)
    slots = np.frombuffer(block.slots(text), dtype=np.int32)
    words = list(block.numbers)
    return [words[s] for s in slots]


def encode(coder, text):
    return [i for w in split(coder, text) for i in coder.encode(w)]


def test_every_code_point_matches_the_library(library, coder):
    texts = [f"x{chr(c)}y 1{chr(c)}2 {chr(c)}  {chr(c)}." for c in [*range(0xD800), *range(0xE000, 0x32400), *range(0xE0000, 0xE0200), 0x10FFFF]]
    for at in range(0, len(texts), 2000):
        part = texts[at : at + 2000]
        block, known = bytebpe._Block(coder.words), []
        for text, ids in zip(part, library.encode_ordinary_batch(part)):
            slots = np.frombuffer(block.slots(text), dtype=np.int32).tolist()
            known += [coder.encode(w) for w in list(block.numbers)[len(known) :]] if len(block.numbers) > len(known) else []
            assert [i for s in slots for i in known[s]] == ids, repr(text)


def test_words_are_those_of_the_whole_text(library, coder):
    rng = random.Random(11)
    bits = list("abcdeth  'sÉé\n\t\r\x1c\x85　 12!?.,<|>日😀ª²") + ["<|endoftext|>", "'ll", " the ", " of", "\n", " ", " ", "  ", "it's", "é", "\0"]
    for _ in range(6000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 25)))
        assert "".join(split(coder, text)) == text
        assert encode(coder, text) == library.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "a" * 1_000_000, "ab1 " * 250_000, "\n \t\u3000" * 250_000 + "x"])
def test_very_long_texts(coder, text):
    words = split(coder, text)
    assert "".join(words) == text
    ids = [i for w in dict.fromkeys(words) for i in coder.encode(w)]
    assert coder.encoding.decode_bytes(ids) == "".join(dict.fromkeys(words)).encode()


def check(library, rows, docs):
    texts = sorted((str(d.doc_id), d.text or "") for d in docs)
    rows = sorted(rows, key=lambda r: str(r.doc_id))
    assert [str(r.doc_id) for r in rows] == [k for k, _ in texts]
    for r, (_, text) in zip(rows, texts):
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_query_on_odd_documents(spark, odd_docs, write_tables, library):
    check(library, bytebpe.op12_byte_bpe(spark, write_tables(documents=odd_docs.repartition(3))).collect(), odd_docs.collect())


def test_query_on_a_table(spark, sf_small, library):
    check(library, bytebpe.op12_byte_bpe(spark, sf_small).collect(), spark.read.parquet(f"{sf_small}/documents.parquet").collect())


def test_a_block_is_full_by_letters_or_pieces(monkeypatch):
    block = bytebpe._Block(bytebpe.load(bytebpe.default_path(), bytebpe.default_pattern()).words)
    monkeypatch.setattr(bytebpe, "PIECES", 3)
    block.slots("a b c d e")
    assert block.full()
    monkeypatch.setattr(bytebpe, "PIECES", 1000)
    monkeypatch.setattr(bytebpe, "LETTERS", 9)
    assert block.full()


def test_decoding_of_any_ids(spark, library):
    some = library.encode_ordinary("hello wörld 日本")
    rows = [(1, bytearray(np.array(some, "<u4").tobytes()), "x"), (1, bytearray(np.array(some[::-1], "<u4").tobytes()), None), (2, None, "y"), (3, bytearray(), "z"), (4, bytearray(np.array([5, 60_000], "<u4").tobytes()), None)]
    df = spark.createDataFrame(rows, "k long, ids binary, _block string").withColumn("decoded", F.lit(7))
    out = bytebpe.decode(df, bytebpe.default_path())
    assert out.columns == df.columns
    got = sorted(((r.k, None if r.decoded is None else bytes(r.decoded)) for r in out.collect()), key=str)
    assert got == sorted([(1, library.decode_bytes(some)), (1, library.decode_bytes(some[::-1])), (2, None), (3, b""), (4, None)], key=str)
    assert bytebpe.decode(df.limit(0), bytebpe.default_path()).collect() == []


def test_clashing_columns_and_empty_table(spark, odd_docs, no_docs, library):
    clash = odd_docs.withColumnsRenamed({"lang": "ids", "source": "_block", "n_chars": "_text"})
    out = bytebpe.decode(bytebpe.encode(clash, bytebpe.default_path()), bytebpe.default_path())
    assert sorted(out.columns) == ["_block", "_text", "decoded", "doc_id", "ids"]
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in out.collect()) == sorted((str(r.doc_id), r.text or "") for r in odd_docs.collect())
    both = bytebpe.encode(clash.withColumn("decoded", F.lit(1)), bytebpe.default_path(), decoded="decoded")
    assert sorted(map(str, both.select(sorted(both.columns)).collect())) == sorted(map(str, out.select(sorted(out.columns)).collect()))
    assert bytebpe.encode(no_docs, bytebpe.default_path(), decoded="decoded").collect() == []


def test_documents_are_not_moved(spark, sf_small):
    """What is put together by block lies bucketed by it, so only dictionaries are shuffled."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    plan = bytebpe.encode(docs, bytebpe.default_path())._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 2 and not any("_slots" in line for line in exchanges)
