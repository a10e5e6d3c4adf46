"""Media columns as interleaved document sequences.

HTML is parsed into an ordered array of items: runs of text, and references to media with their
captions. A reference names its payload by digest. Payloads lie once each in a media table, stored
losslessly as PNG images of 8-bit RGB samples, 64 pixels a row; a join by digest resolves the
references, and positions and captions stay with them. Features come from the stored bytes, read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut

WIDTH = 64
ROW = 3 * WIDTH
PAD = b" "
ITEMS = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
_PNG = b"\x89PNG\r\n\x1a\n"


# -- payloads ----------------------------------------------------------------------------------


def padded(raw: bytes) -> bytes:
    """The payload of raw bytes: blanks appended up to a positive multiple of one row."""
    return raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), PAD)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """A PNG image whose samples are the payload: 8-bit RGB, one unfiltered row for each 192 bytes."""
    if not payload or len(payload) % ROW:
        raise ValueError(f"a payload has a positive multiple of {ROW} bytes")
    rows = len(payload) // ROW
    lines = np.zeros((rows, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 2, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of an image that encode_png() made; checksums are verified."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, data, rows = 8, [], 0
    while at < len(media):
        size, kind = struct.unpack(">I", media[at : at + 4])[0], media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            wide, rows, *rest = struct.unpack(">IIBBBBB", body)
            if wide != WIDTH or rest != [8, 2, 0, 0, 0]:
                raise ValueError("not an image of 8-bit RGB rows of 64 pixels")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("a row is filtered")
    return lines[:, 1:].tobytes()


def payload_feature(payload: bytes) -> str:
    """Height, mean of each channel, and an 8-bin histogram of the samples' upper bits, in thousandths."""
    x = np.frombuffer(payload, np.uint8)
    channels = x.reshape(-1, 3).mean(axis=0)
    bins = np.bincount(x >> 5, minlength=8) / len(x)
    return f"{WIDTH}x{len(payload) // ROW};" + ",".join(f"{v:.3f}" for v in channels) + ";" + ",".join(str(int(1000 * v)) for v in bins)


# -- interleaved documents -----------------------------------------------------------------------


class _Items(HTMLParser):
    """Text runs and media references in document order. A figure's caption goes to its media; else alt text does."""

    BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 article section table tr td th figure blockquote pre hr title".split())
    HIDDEN = frozenset(("script", "style", "template", "noscript"))
    MEDIA = frozenset(("img", "video", "audio", "source", "embed"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden = 0
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self.flush()
            self.figure = []
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in self.MEDIA and named.get("src"):
            self.flush()
            item = {"kind": "media", "text": None, "ref": named["src"].strip(), "caption": " ".join((named.get("alt") or "").split()) or None}
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)
        elif tag in self.BREAKS:
            self.flush()

    def handle_startendtag(self, tag, attrs):
        if tag not in self.HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split()) or None
            for item in self.figure or ():
                item["caption"] = said or item["caption"]
            if said and not self.figure:
                self.items.append({"kind": "text", "text": said, "ref": None, "caption": None})
            self.caption = None
        elif tag == "figure":
            self.flush()
            self.figure = None
        elif tag in self.BREAKS:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def parse_items(page: str | None) -> list[dict]:
    """The ordered items of one page; position counts from 0."""
    parser = _Items()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return [{"position": k, **item} for k, item in enumerate(parser.items)]


_ITEM = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))


def _parse_batches(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse_items(x.as_py()) for x in batch.column(1)], _ITEM)], names=["doc_id", "items"])


def interleaved(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """doc_id and items, the ordered text and media structs of each page. A null or empty page has none."""
    two = pages.select(F.col(id_col).alias("doc_id"), F.col(html_col).cast("string").alias("html"))
    return two.mapInArrow(_parse_batches, f"doc_id {two.schema['doc_id'].dataType.simpleString()}, items {ITEMS}")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """A row for each media item: doc_id, position, caption, digest, and the media table's other columns.

    References of the form ``media:<sha256>`` resolve by digest against a table with one row for each
    digest; others, and digests it doesn't have, keep null columns. The digest of a payload that very
    many pages show is split by adaptive execution, for both sides come straight from files.
    """
    items = sequences.select("doc_id", F.explode("items").alias("item")).where("item.kind = 'media'")
    refs = items.select("doc_id", F.col("item.position").alias("position"), F.col("item.caption").alias("caption"), F.regexp_extract(F.col("item.ref"), r"^media:([0-9a-f]{64})$", 1).alias("digest"))
    return refs.join(media, "digest", "left")


# -- the query's documents -------------------------------------------------------------------------

_FEATURES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
#: Digests that a task remembers, so that copies which lie together are stored once.
SEEN = 100_000


def _store_batches(batches):
    seen: set[bytes] = set()
    for batch in batches:
        raw = batch.column(0)
        for lo in range(0, batch.num_rows, 256):
            digests, stored = [], []
            for x in raw.slice(lo, 256):
                payload = x.as_py()
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    digests.append(digest)
                    stored.append(encode_png(padded(payload)))
                    if len(seen) < SEEN:
                        seen.add(digest)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(stored, pa.binary())], names=["digest", "media"])


def _raw(text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def stored_payloads(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """digest (of the unpadded bytes) and media of a table's texts, without a shuffle: a payload that tasks share is there for each task."""
    return docs.select(_raw(text_col).alias("raw")).mapInArrow(_store_batches, "digest binary, media binary")


def stored_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The media table of a table of texts: each different payload once, by the digest (hex digits) of its unpadded bytes."""
    once = stored_payloads(docs, text_col).groupBy("digest").agg(F.first("media").alias("media"))
    return once.select(F.lower(F.hex("digest")).alias("digest"), "media")


def document_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and html: a page for each text, whose figure shows its payload by digest; the caption tells its bytes."""
    raw = _raw(text_col)
    page = F.concat(F.lit('<article><p>document</p><figure><img src="media:'), F.sha2(raw, 256), F.lit('"><figcaption>'), F.octet_length(raw).cast("string"), F.lit("</figcaption></figure></article>"))
    return docs.select(F.col(id_col).alias("doc_id"), page.alias("html"))


def _feature_batches(batches):
    for batch in batches:
        rows = []
        for digest, media in zip(batch.column(0).to_pylist(), batch.column(1)):
            stored = media.as_py()
            payload = decode_png(stored)
            rows.append((digest, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).digest(), payload_feature(payload)))
        kinds = [batch.schema.field(0).type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["digest", *_FEATURES])


def media_features(media: DataFrame) -> DataFrame:
    """The features of a table (digest, media), from the stored bytes read back; checksums as bytes."""
    kind = media.schema["digest"].dataType.simpleString()
    return media.select("digest", "media").mapInArrow(_feature_batches, f"digest {kind}, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string")


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document.

    Each text becomes a page that shows its payload; payloads are stored and read back where their texts
    lie, and only their features are shuffled, one row a digest; the page is parsed again, and the digest
    join brings the features of what is stored. n_bytes is the caption. Null counts as empty (one row of
    blanks). Repeated rows stay; an empty table gives an empty table; no other column is read.
    """
    told = media_features(stored_payloads(docs, text_col))
    features = cut(told.dropDuplicates(["digest"]).select(F.lower(F.hex("digest")).alias("digest"), *_FEATURES))
    shown = cut(interleaved(document_pages(docs, id_col, text_col), "doc_id", "html"))
    hexed = {c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")}
    return resolve(shown, features).withColumns(hexed).select("doc_id", F.col("caption").cast("long").alias("n_bytes"), *_FEATURES)
