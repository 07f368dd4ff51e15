"""Interleaved document sequences: HTML to ordered text and media structs, resolved by digest.

A parser turns each page into a sequence of text and media segments in reading
order, a media segment with its reference and caption. References are digests
into a content-addressed store; the join that resolves them moves digests and
what was computed from the stored bytes, or the bytes where they are wanted.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher.llm._common import stored, table, text_or_empty

#: Samples in a row of a stored image, and the unit that payloads are filled up to.
WIDTH = 64
#: A digest is hot from this part of all references on, and from so many; tasks that it is dealt to.
HOT_PART, HOT_ROWS, SALTS = 64, 2000, 64

#: Rows of a batch whose pages and images are Python objects at a time.
ROWS = 256

SEGMENTS = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
_MEDIA = {"img": "image", "audio": "audio", "video": "video", "object": "document", "embed": "document"}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset("script style template noscript title".split())
#: What may stand in a page's head; anything else ends it.
_IN_HEAD = frozenset("html head base link meta title script style template noscript".split())
_BLOCK = frozenset("address article aside blockquote body div dl dd dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul br".split())


class _Sequence(HTMLParser):
    """Collects segments; a figure's caption belongs to the media inside the figure."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.segments: list[dict] = []
        #: End tags still to come of each element that hides what it holds.
        self._ends = {tag: len(re.findall(f"</{tag}\\b", html, re.I)) for tag in _HIDDEN} if "<" in html else {}
        self._text: list[str] = []
        self._hidden = 0
        self._head = False
        self._figures: list[tuple[list[dict], list[str]]] = []
        self._caption = 0

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self._text)).strip()
        self._text = []
        if text:
            self._add("text", text=text)

    def _add(self, kind: str, text: str | None = None, ref: str | None = None, caption: str | None = None) -> dict:
        self.segments.append({"position": len(self.segments), "kind": kind, "text": text, "ref": ref, "caption": caption})
        return self.segments[-1]

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        if not self._hidden:
            self._head = tag == "head" or (self._head and tag in _IN_HEAD)
        if tag in _HIDDEN:
            # without an end to come an element holds nothing, but for code, which takes what is left
            if self._ends.get(tag) or tag in self.CDATA_CONTENT_ELEMENTS:
                self._hidden += 1
            return
        if self._hidden:
            return
        if tag in _BLOCK or tag in _MEDIA or tag == "figcaption":
            self.flush()
        if tag == "figure":
            self._figures.append(([], []))
        elif tag == "figcaption":
            self._caption += 1
        elif tag in _MEDIA:
            given = dict(attrs)
            ref = given.get("src") or given.get("data")
            if ref:
                made = self._add(_MEDIA[tag], ref=ref, caption=given.get("alt") or given.get("title"))
                if self._figures:
                    self._figures[-1][0].append(made)

    def handle_startendtag(self, tag, attrs):
        if tag in _HIDDEN:
            return
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "head":
            self._head = False
        if tag in _HIDDEN:
            self._hidden = max(0, self._hidden - 1)
            self._ends[tag] = max(0, self._ends.get(tag, 0) - 1)
            return
        if self._hidden:
            return
        if tag == "figcaption":
            self._caption = max(0, self._caption - 1)
        if tag == "figure" and self._figures:
            self._end_figure()
        elif tag in _BLOCK:
            self.flush()

    def _end_figure(self) -> None:
        self.flush()
        media, words = self._figures.pop()
        caption = re.sub(r"\s+", " ", "".join(words)).strip()
        if caption and media:
            for m in media:
                m["caption"] = caption
        elif caption:
            self._add("text", text=caption)

    def finish(self) -> list[dict]:
        """The segments, once the page is at its end: whatever is open ends here."""
        self.close()
        while self._figures:
            self._end_figure()
        self.flush()
        return self.segments

    def handle_data(self, data):
        if self._hidden or (self._head and data.isspace()):
            return
        self._head = False
        if self._caption and self._figures:
            self._figures[-1][1].append(data)
        else:
            self._text.append(data)


def segments_of(html: str | None) -> list[dict]:
    """Segments of one page in reading order. Null or empty: none.

    Broken markup is read as far as it goes: an end tag that is left out ends
    where an element that can't be inside begins, marked sections and unknown
    declarations count as comments, and captions without media are text. A
    title, template or noscript without an end tag to come holds nothing; a
    script or style without one takes the rest of the page. All else that is
    open ends with the page.
    """
    parser = _Sequence(html or "")
    parser.feed(html or "")
    return parser.finish()


def interleave(df: DataFrame, html: str = "html", segments: str = "segments") -> DataFrame:
    """`df` with the sequence of each page. A column named `segments` is replaced, all others stay.

    Null and empty pages have an empty sequence; an empty table stays empty.
    """

    def parse(pages: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        parts = [pa.array([segments_of(p) for p in pages.slice(at, ROWS).to_pylist()], kind) for at in range(0, len(pages), ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    # non-deterministic, or the optimizer parses once more for a filter that it infers from an explode
    return df.withColumn(segments, F.arrow_udf(parse, SEGMENTS).asNondeterministic()(F.col(html)))


def references(df: DataFrame, *kept: str, segments: str = "segments") -> DataFrame:
    """One row for each media segment, with the columns `kept`, position, kind, caption and ref.

    Null and empty sequences, and those of text alone, give no row; nor does
    an empty table. Repeated rows give theirs each.
    """
    media = df.select(*kept, F.explode(segments).alias("_s")).where("_s.kind <> 'text'")
    return media.select(*kept, "_s.position", "_s.kind", "_s.caption", F.col("_s.ref").alias("ref"))


def resolve(refs: DataFrame, store: DataFrame, digest: str = "digest", ref: str = "ref") -> DataFrame:
    """`refs` with the store's columns for the digest that each refers to.

    `store` has one row for each digest. A reference without one there keeps
    nulls, so positions stay aligned. A digest with more than a few hundredths
    of all references, of which there can be few, is dealt to many tasks;
    `refs` should be stored, since it is read twice.
    """
    named = refs.withColumn("_digest", F.regexp_extract(ref, r"^sha256:([0-9a-f]{64})$", 1))
    total = refs.count()
    counts = named.where("_digest <> ''").groupBy("_digest").count()
    hot = F.broadcast(counts.where(F.col("count") > max(HOT_ROWS, total // HOT_PART)).select("_digest", F.lit(True).alias("_hot")))  # at most HOT_PART rows
    salted = named.join(hot, "_digest", "left").withColumn("_salt", F.when(F.col("_hot"), F.floor(F.rand(7) * SALTS)).otherwise(0).cast("int")).drop("_hot")
    many = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = store.withColumnRenamed(digest, "_digest").join(hot, "_digest", "left").withColumn("_salt", F.explode(many)).drop("_hot")
    return salted.join(dealt, ["_digest", "_salt"], "left").drop("_digest", "_salt")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes filled up with zeros to a positive multiple of WIDTH, and their number before."""
    raw = (text or "").encode("utf-8")
    return raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0"), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


def to_png(payload: bytes) -> bytes:
    """A greyscale image of 8-bit samples, WIDTH to a row, that holds the payload."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    head = WIDTH.to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples of an image that `to_png` made, [row, column]; checksums are verified."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not an image of the store")
    at, width, height, data = 8, 0, 0, b""
    while at < len(media):
        size = int.from_bytes(media[at : at + 4], "big")
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != int.from_bytes(media[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a chunk of a stored image is damaged")
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a row filter that the store does not write")
    return rows[:, 1:]


def features(samples: np.ndarray) -> str:
    """Size, mean and spread of the samples, mean step between neighbours, and a 64-bit average hash."""
    x = samples.astype(np.int64)
    n = x.size
    mean = int(x.sum()) / n
    spread = max(0.0, int((x * x).sum()) / n - mean * mean) ** 0.5
    step = int(np.abs(np.diff(x.reshape(-1))).sum()) / max(1, n - 1)
    cells = np.array_split(x.reshape(-1), 64)
    bits = sum(1 << k for k, c in enumerate(cells) if int(c.sum()) > mean * len(c))
    return f"{samples.shape[1]}x{samples.shape[0]};{mean:.6f};{spread:.6f};{step:.6f};{bits:016x}"


def page_of(text: str, digest: str) -> str:
    """The text as a page: its lines as paragraphs, and the figure with its payload between the halves of them.

    The caption tells how many lines come before the figure.
    """
    lines = [line for line in text.split("\n") if line.strip()]
    half = (len(lines) + 1) // 2
    parts = [f"<p>{escape(line, quote=False)}</p>" for line in lines]
    figure = f'<figure><img src="sha256:{digest}"><figcaption>after {half} of {len(lines)} lines</figcaption></figure>'
    return "".join(["<article>", *parts[:half], figure, *parts[half:], "</article>"])


def store_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as a page that refers to its payload by digest, with the stored form beside it.

    Returns key, n_bytes, html, digest and media. Null text counts as empty,
    and gives a page of a figure alone. Rows with equal texts get equal pages
    and digests; the first of a batch alone has the media, the others null. An
    empty table gives no row.
    """

    def write(texts: pa.Array) -> pa.Array:
        made: dict[bytes, str] = {}
        parts = [write_some(texts.slice(at, ROWS), made) for at in range(0, len(texts), ROWS)]
        return pa.concat_arrays(parts or [write_some(texts, made)])

    def write_some(texts: pa.Array, made: dict[bytes, str]) -> pa.Array:
        n, html, digests, media = [], [], [], []
        for t in texts.to_pylist():
            payload, size = payload_of(t)
            sha = hashlib.sha256(payload).digest()
            image = None
            if sha not in made:
                image = to_png(payload)
                made[sha] = hashlib.sha256(image).hexdigest()
            n.append(size)
            digests.append(made[sha])
            media.append(image)
            html.append(page_of(t or "", made[sha]))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(html, pa.string()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["n_bytes", "html", "digest", "media"])

    # non-deterministic, so that it is computed once for all its fields
    made = F.arrow_udf(write, "struct<n_bytes:bigint,html:string,digest:string,media:binary>").asNondeterministic()(text_or_empty(text))
    return docs.select(key, made.alias("_m")).select(key, "_m.n_bytes", "_m.html", "_m.digest", "_m.media")


def read_back(store: DataFrame, digest: str = "digest", media: str = "media") -> DataFrame:
    """What the stored bytes hold, one row for each digest: payload sizes, checksums and features.

    Rows without bytes are passed over; copies of a digest are decoded once a
    batch and give one row. Damaged bytes raise. An empty table gives no row.
    """

    def read(batches):
        for pdf in batches:
            rows = []
            for d, image in dict(zip(pdf[digest], pdf[media])).items():
                image = bytes(image)
                samples = from_png(image)
                payload = samples.tobytes()
                rows.append((d, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), features(samples)))
            yield pd.DataFrame(rows, columns=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    out = store.where(F.col(media).isNotNull()).select(digest, media).mapInPandas(read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.dropDuplicates(["digest"])


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with their payloads as images: parsed, stored, resolved and read back.

    Null text counts as empty; equal texts give equal values; rows that
    repeat an id each give a row; no documents give no row.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pages = interleave(store_documents(docs))
    texts = F.filter("segments", lambda s: s["kind"] == "text")
    written = pages.select("doc_id", "n_bytes", "digest", "media", "segments", F.size(texts).alias("n_texts"), F.aggregate(texts, F.lit(0).cast("long"), lambda n, s: n + F.length(s["text"])).alias("text_chars"))
    # one row for each media segment, of which each page has one; stored, so that texts are parsed and images made once
    written = stored(references(written, "doc_id", "n_bytes", "digest", "media", "n_texts", "text_chars"), "media")
    found = resolve(written.drop("digest", "media"), stored(read_back(written), "features"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_texts", "text_chars")
