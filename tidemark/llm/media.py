"""Interleaved document sequences: HTML to ordered text and media references, payloads joined by digest.

``sequences`` parses pages into one ordered array of items a document: texts, and references to media by digest with
their captions. ``resolve`` joins the references, and only these, to a media table by digest and puts what it finds back at
its position, so positions and captions stay aligned; a reference without a payload stays with nulls. Payloads need not
travel: ``resolve`` takes whichever columns of the media table are wanted.

``store_payloads`` keeps payloads as 8-bit gray images (binary PGM, 192 samples a row), named by the SHA-256 digest of the
stored form; ``describe`` reads stored media back and gives sizes, digests and features of their samples.

Defined results: a null text is an empty payload of one padded row; a null page is an empty sequence; payloads of any
length are stored whole; equal payloads have one digest and equal values, repeated rows keep a row each; an empty table
gives an empty result; further columns of documents are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import staged

ROW, TAIL = 192, 16
_ITEMS = "array<struct<kind:string,text:string,digest:string,caption:string>>"
_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!?(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
_SILENT = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style")}
_REF = re.compile(r"""(?<![\w-])src\s*=\s*["']?media:([0-9a-f]{64})""", re.IGNORECASE)
_ALT = re.compile(r"""(?<![\w-])alt\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.IGNORECASE)
_MEDIA = frozenset("img video audio source".split())
_INLINE = frozenset("a b i em strong span u small sub sup code".split())


def parse(html: str | None) -> list[dict]:
    """Items of a page in order, in one pass over its tags.

    A reference is a media item; those in a figure have the figure's caption, others, and those of a figure without one, their
    own ``alt``. All text is a text item at its place, also in a figure; a caption is one only where its figure shows no media.
    """
    items: list[dict] = []
    run: list[str] = []
    figure: list[dict] | None = None  # media items of the open figure
    caption: str | None = None
    place = 0  # where the caption stands
    captioning = False

    def text_item(text: str) -> dict:
        return {"kind": "text", "text": text, "digest": None, "caption": None}

    def flush() -> None:
        nonlocal caption, place, captioning
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if captioning and figure is not None:
            if text:
                caption, place = f"{caption} {text}" if caption else text, len(items)
            elif caption is None:
                caption, place = "", len(items)
        elif text:
            items.append(text_item(text))

    def close() -> None:
        nonlocal figure, caption, captioning
        flush()
        if figure:
            for x in figure:
                x["caption"] = x["caption"] if caption is None else caption
        elif figure is not None and caption:
            items.insert(place, text_item(caption))
        figure, caption, captioning = None, None, False

    html, at = html or "", 0
    while m := _MARK.search(html, at):
        run.append(html[at : m.start()])
        at = m.end()
        closing, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in _INLINE:
            continue
        if name in _SILENT and not closing:
            end = _SILENT[name].search(html, at)
            at = end.end() if end else len(html)
            continue
        if name == "figure":
            close()
            figure = None if closing else []
            continue
        flush()
        if name == "figcaption":
            captioning = not closing
        elif name in _MEDIA and not closing and (ref := _REF.search(attrs)):
            alt = _ALT.search(attrs)
            said = unescape(alt[1] or alt[2] or "") if alt else None
            items.append({"kind": "media", "text": None, "digest": ref[1].lower(), "caption": said})
            if figure is not None:
                figure.append(items[-1])
    run.append(html[at:])
    close()
    return items


def sequences(pages: DataFrame, keep: tuple[str, ...], html: str = "html") -> DataFrame:
    """``keep`` columns and ``items`` of every page, with a ``seq_id`` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(k, pa.string()) for k in ("kind", "text", "digest", "caption")]))
        for b in batches:
            items = pa.array([parse(x.as_py()) for x in b.column(b.num_columns - 1)], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], items], [*b.schema.names[:-1], "items"])

    rows = pages.select(*keep, F.col(html).cast("string").alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    parsed = rows.mapInArrow(run, f"{schema}, items {_ITEMS}")
    return staged(parsed.withColumn("seq_id", F.monotonically_increasing_id()), "sequences")


def resolve(seqs: DataFrame, media: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``seqs`` with ``payload`` in every item: ``columns`` of the media row of its digest, null for texts and unknown digests.

    ``media`` has one row a digest.
    """
    refs = seqs.select("seq_id", F.posexplode("items").alias("pos", "item")).where("item.kind = 'media'")
    found = refs.select("seq_id", "pos", F.col("item.digest").alias("digest")).join(
        media.select("digest", F.struct(*columns).alias("payload")), "digest"
    )
    found = found.groupBy("seq_id").agg(F.collect_list(F.struct("pos", "payload")).alias("_found"))
    joined = seqs.join(found, "seq_id", "left").withColumn("_found", F.map_from_entries("_found"))
    items = F.transform(
        "items", lambda x, i: x.withField("payload", F.when(F.col("_found").isNotNull(), F.try_element_at("_found", i)))
    )
    return joined.withColumn("items", items).drop("_found")


def _payload(text: Column) -> Column:
    """UTF-8 with spaces up to a positive multiple of a row."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(raw)
    pad = F.greatest(F.ceil(size / ROW), F.lit(1)) * ROW - size
    return F.concat(raw, F.repeat(F.lit(" "), pad.cast("int")).cast("binary"))


def store_payloads(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(refs, store): doc_id, n_bytes and digest of every row; digest and media of every payload, in the shared folder."""
    payload = _payload(F.col(text).cast("string"))
    head = F.concat(F.lit(f"P5\n{ROW} "), (F.octet_length("_p") / ROW).cast("long").cast("string"), F.lit("\n255\n"))
    stored = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), payload.alias("_p"))
    stored = stored.select("doc_id", "n_bytes", F.concat(head.cast("binary"), "_p").alias("media"))
    stored = staged(stored.withColumn("digest", F.sha2("media", 256)), "media")
    return stored.select("doc_id", "n_bytes", "digest"), stored.select("digest", "media")


def describe(store: DataFrame) -> DataFrame:
    """What the stored media hold, one row a digest: sizes, digests, the tail's CRC and a feature string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        done: set[str] = set()
        for b in batches:
            rows = []
            for digest, media in zip(b.column("digest").to_pylist(), b.column("media")):
                if digest in done:  # described by this task
                    continue
                if len(done) < 500_000:
                    done.add(digest)
                raw = media.as_py()
                kind, size, top, samples = raw.split(b"\n", 3)
                width, height = map(int, size.split())
                if kind != b"P5" or top != b"255" or len(samples) != width * height:
                    raise ValueError(f"{digest} is not the image it should be")
                v = np.frombuffer(samples, np.uint8)
                bins = np.bincount(v >> 4, minlength=16)
                feature = f"{width}x{height};sum={int(v.sum(dtype=np.int64))};hist={'-'.join(map(str, bins.tolist()))}"
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-TAIL:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    form = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store.mapInArrow(run, form).dropDuplicates(["digest"])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: each document is a page that shows its stored text as a figure between two paragraphs."""
    refs, store = store_payloads(docs)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("without a number"))
    html = F.concat(
        F.lit("<html><body><p>Document "), name, F.lit('</p><figure><img src="media:'), F.col("digest"),
        F.lit('"><figcaption>Text of document '), name, F.lit("</figcaption></figure><p>End</p></body></html>"),
    )
    seqs = sequences(refs.withColumn("html", html), ("doc_id", "n_bytes"))
    columns = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    described = staged(describe(store), "media-described")  # apart from the join, which may be skewed by a digest
    shown = resolve(seqs, described, columns).select(
        "doc_id", "n_bytes", F.get(F.filter("items", lambda x: x.kind == "media"), F.lit(0)).alias("m")
    )
    return shown.select("doc_id", "n_bytes", "m.payload.*", F.col("m.caption").alias("caption"))
