import hashlib
import random
import signal
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from thresher.llm import media


def test_segments_in_order():
    html = "<head><title>no</title></head><h1>Top</h1><p>One <b>bold</b>\n word<br>next</p><figure><img src='a' alt='x'><figcaption>Cap &amp; tion</figcaption></figure><script>var a='<p>';</script>tail<img alt='none'><audio src=b title=t></audio><object data=c></object>"
    got = [(s["position"], s["kind"], s["text"], s["ref"], s["caption"]) for s in media.segments_of(html)]
    assert got == [
        (0, "text", "Top", None, None),
        (1, "text", "One bold word", None, None),
        (2, "text", "next", None, None),
        (3, "image", None, "a", "Cap & tion"),
        (4, "text", "tail", None, None),
        (5, "audio", None, "b", "t"),
        (6, "document", None, "c", None),
    ]


@pytest.mark.parametrize("html", [None, "", "<", "<p", "<figure><img src=a><figcaption>c", "</p></figure>", "<figcaption>x</figcaption>", "<script>", "<![ x", "<![", "<!", "<!-", "<?", "<![CDATA[x", "<!doctype", "</", "<a b='"])
def test_broken_markup(html):
    assert isinstance(media.segments_of(html), list)


def test_marked_sections_are_comments():
    assert [s["text"] for s in media.segments_of("<![foo[x]]><p>hi</p>")] == ["hi"]
    assert [s["text"] for s in media.segments_of("<![if IE]>a<![endif]><p>b")] == ["a", "b"]


def _too_long(*_):
    raise TimeoutError("a page of a few characters takes seconds")


@pytest.mark.parametrize(
    "html, want",
    [
        ("<figure><title>", []),
        ("<figure><script>x", []),
        ("<figure><img src=a><noscript>b", ["a", "b"]),
        ("<figure><style>p{}</figure><p>hi</p>", []),
        ("<figure><figcaption>c<template>", ["c"]),
        ("<title>x<p>hello</p><img src=a>", ["x", "hello", "a"]),
        ("<title>t</title><title>x<p>hello</p>", ["x", "hello"]),
        ("<template><p>no</p></template><noscript/>yes", ["yes"]),
    ],
)
def test_what_is_left_open_ends_with_the_page(html, want):
    assert [s["text"] or s["ref"] for s in media.segments_of(html)] == want


def test_any_characters_are_read():
    rng = random.Random(3)
    signal.signal(signal.SIGALRM, _too_long)
    bits = ["<", "!", "[", "-", "?", ">", "]", "--", "CDATA", "p", "</", "/", "'", '"', "=", " ", "a", "&", "&#", ";", "<img src=x>", "<figure>", "</figure>", "<head>", "<title>", "<script", "<!DOCTYPE", "<!ENTITY", "<!ATTLIST", "\0", "%"]
    for _ in range(5000):
        signal.alarm(5)
        found = media.segments_of("".join(rng.choices(bits, k=rng.randint(1, 14))))
        signal.alarm(0)
        assert [s["position"] for s in found] == list(range(len(found)))


@pytest.mark.parametrize("rest", ["<body><p>hi</p><img src='a.png'></body></html>", "<p>hi</p><img src='a.png'>", "<body>hi<img src='a.png'>", "\nhi<img src=a.png>"])
def test_a_head_may_end_by_itself(rest):
    got = [(s["kind"], s["text"], s["ref"]) for s in media.segments_of("<html><head><title>t</title> <meta charset=x><style>p{}</style>" + rest)]
    assert got == [("text", "hi", None), ("image", None, "a.png")]


def test_caption_without_media_is_text():
    assert [s["text"] for s in media.segments_of("<figure><figcaption>alone</figcaption></figure>")] == ["alone"]


@pytest.mark.parametrize("text", [None, "", "a", "b" * 63, "c" * 64, "d" * 65, "é" * 32, "x\0" * 500])
def test_stored_form_is_lossless(text):
    payload, n = media.payload_of(text)
    raw = (text or "").encode()
    assert n == len(raw) and payload[:n] == raw and not any(payload[n:]) and len(payload) % 64 == 0 and payload
    image = media.to_png(payload)
    assert media.from_png(image).tobytes() == payload
    with pytest.raises(ValueError):
        media.from_png(image[:60] + bytes([image[60] ^ 1]) + image[61:])


def test_query_on_odd_documents(spark, odd_docs, write_tables):
    rows = media.op1_media(spark, write_tables(documents=odd_docs)).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd_docs.collect())
    by_text = {}
    for r in rows:
        payload, n = media.payload_of(texts[r.doc_id])
        image = media.to_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        lines = [x for x in (texts[r.doc_id] or "").split("\n") if x.strip()]
        assert r.n_texts == len(lines) and r.position == (len(lines) + 1) // 2
        assert r.caption == f"after {r.position} of {len(lines)} lines"
        assert r.text_chars == sum(len(" ".join(x.split())) for x in lines)
        assert by_text.setdefault(payload, r.feature) == r.feature
    flat = media.features(np.zeros((1, 64), dtype=np.uint8))
    assert flat == "64x1;0.000000;0.000000;0.000000;0000000000000000"


def test_missing_media_keep_their_place(spark):
    pages = spark.createDataFrame([(1, "<p>a</p><img src='sha256:" + "0" * 64 + "'><img src='http://x/y.png'>"), (2, None)], "page_id long, html string").withColumn("segments", F.lit(1))
    store = spark.createDataFrame([("0" * 64, 7)], "digest string, payload_bytes long")
    got = sorted(tuple(r) for r in media.resolve(media.references(media.interleave(pages), "page_id"), store).select("page_id", "position", "payload_bytes").collect())
    assert got == [(1, 1, 7), (1, 2, None)]


def test_many_media_in_order_and_a_hot_digest(spark, monkeypatch):
    monkeypatch.setattr(media, "HOT_ROWS", 5)
    digests = ["%064x" % k for k in range(4)]
    pages = []
    for i in range(60):
        body = "".join(f"<p>text {i} {k}</p><figure><img src='sha256:{digests[0 if k % 2 else (i + k) % 4]}'><figcaption>c{k}</figcaption></figure>" for k in range(i % 5))
        pages.append((i, body))
    refs = media.references(media.interleave(spark.createDataFrame(pages, "page_id long, html string")), "page_id")
    store = spark.createDataFrame([(d, k) for k, d in enumerate(digests)], "digest string, number int")
    got = sorted(tuple(r) for r in media.resolve(refs, store).select("page_id", "position", "caption", "number").collect())
    assert got == sorted((i, 2 * k + 1, f"c{k}", 0 if k % 2 else (i + k) % 4) for i in range(60) for k in range(i % 5))


def test_equal_texts_are_stored_once_a_batch(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(50)] + [(50, None), (51, "")], "doc_id long, text string").coalesce(1)
    rows = media.store_documents(docs).collect()
    assert sum(r.media is not None for r in rows) == 2 and len({r.digest for r in rows}) == 2


def test_pages_table(spark, sf_small):
    pages = media.interleave(spark.read.parquet(f"{sf_small}/pages.parquet"))
    for r in pages.select("segments").collect():
        assert [s.position for s in r.segments] == list(range(len(r.segments)))


def test_empty_table(spark, no_docs, write_tables):
    assert media.op1_media(spark, write_tables(documents=no_docs)).collect() == []
