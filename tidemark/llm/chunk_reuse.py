"""BPE encoding and decoding with content-defined chunk reuse.

1. Equal texts are one text: each task passes on a text once, compressed, under its 128-bit digest.
2. A rolling hash over the last 32 bytes cuts texts into chunks of about 1 KB at places that depend on content alone, so
   that passages shared by documents give the same chunks. A chunk is known by a 128-bit digest.
3. Digests that occur more than once get an owner, the first text that holds them. Owners' tasks encode these chunks
   once; the ids travel to every other place of the chunk. All other chunks are encoded where they are.
4. Chunk joins fall anywhere, also inside a word, so the ids of neighbours need not be those of the whole text. Each join
   is repaired: the stretch between the nearest places where the tokenizer surely cuts (a single space between other
   characters) is encoded anew in place of what the chunks have for it. The ends that are replaced are compared
   with the chunks' ids; where they disagree the stretch grows, up to the whole text, until all agrees.

Defined results: null and empty texts have no ids; texts without any space are one stretch and encoded whole; repeated
rows and ties each keep their row; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import default_path, encoder, slices
from tidemark.session import staged

WINDOW = 32
LEAST, MASK, MOST = 256, 1023, 8192
_GEAR = np.random.default_rng(7).integers(1, 2**32, 256, np.uint32)
#: Texts that a task remembers to have passed on already.
SEEN = 500_000


def cut_points(texts: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each text, the last one its length."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    h, power, width = _GEAR[data], np.uint32(0x9E3779B1), 1
    while width < WINDOW:  # h covers the last `width` bytes; doubling gives twice as many
        more = h.copy()
        more[width:] += h[:-width] * power if len(h) > width else 0
        h, power, width = more, np.uint32(int(power) ** 2 & 0xFFFFFFFF), 2 * width
    ends = np.flatnonzero(((h >> np.uint32(11)) & np.uint32(MASK)) == 0) + 1
    out, base = [], 0
    for t in texts:
        n, cuts, last = len(t), [], 0
        near = ends[np.searchsorted(ends, base + LEAST) : np.searchsorted(ends, base + n)] - base
        for c in [*near.tolist(), n]:
            while c - last > MOST:
                last = _char_start(t, last + MOST)
                cuts.append(last)
            if c - last >= LEAST and c < n:
                last = _char_start(t, c)
                cuts.append(last)
        if not cuts or cuts[-1] < n:
            cuts.append(n)
        out.append(cuts)
        base += n
    return out


def _char_start(t: bytes, i: int) -> int:
    while i < len(t) and t[i] & 0xC0 == 0x80:
        i += 1
    return i


def _name(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once a task: key, z (compressed), cuts (chunk ends in bytes), names (chunk digests)."""
    squeeze, seen = zstandard.ZstdCompressor(level=3), set()
    for b in batches:
        for texts in ([t.encode() for t in x.column("text").to_pylist()] for x in slices(b, "text", 2_000_000)):
            new = {}
            for t in texts:
                key = _name(t)
                if key not in seen:
                    new[key] = t
            if len(seen) > SEEN:
                seen.clear()
            seen.update(new)
            raw = list(new.values())
            cuts = cut_points(raw)
            names = [[_name(t[a:b]) for a, b in zip([0, *c], c)] for t, c in zip(raw, cuts)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(new), pa.binary()),
                    pa.array([squeeze.compress(t) for t in raw], pa.binary()),
                    pa.array(cuts, pa.list_(pa.int32())),
                    pa.array(names, pa.list_(pa.binary())),
                ],
                ["key", "z", "cuts", "names"],
            )


def _blank(c: str) -> bool:
    return c.isspace() or c in "᠎​﻿"


def _certain(t: str, i: int, way: int) -> int:
    """The nearest place from i on (way 1) or before i (way -1) where the tokenizer surely cuts, or the text's end."""
    while True:
        i = t.find(" ", i) if way > 0 else t.rfind(" ", 0, max(i, 0))
        if i < 0:
            return len(t) if way > 0 else 0
        if 0 < i < len(t) - 1 and not _blank(t[i - 1]) and not _blank(t[i + 1]):
            return i
        i += way > 0


def assemble(text: str, cuts: list[int], have: dict[int, bytes], encode) -> bytes:
    """Ids of ``text`` from those of its chunks: ``have`` by chunk number, the rest encoded here, joins repaired.

    ``cuts`` are the chunk ends in code points.
    """
    spans = list(zip([0, *cuts], cuts))
    ids = [have[i] if i in have else encode(text[a:b]) for i, (a, b) in enumerate(spans)]
    repairs: list[list[int]] = []
    for j in cuts[:-1]:
        a, b = _certain(text, j + 1, -1), _certain(text, j, 1)
        if a < b:
            repairs.append([a, b])
    while True:
        repairs = _merged(repairs)
        out, agreed = [], True
        edges = [x for r in repairs for x in r]
        todo = iter(repairs)
        nxt = next(todo, None)
        for (a, b), e in zip(spans, ids):
            lo, hi = a, b
            for r, s in _touching(repairs, edges, a, b):
                if r <= a:
                    lo = min(b, max(lo, s))
                else:
                    hi = min(hi, r)
            while nxt and nxt[0] < lo and nxt[0] < b and nxt[0] <= a:
                out.append(encode(text[nxt[0] : nxt[1]]))
                nxt = next(todo, None)
            if lo < hi:
                head, tail = encode(text[a:lo]), encode(text[hi:b])
                if not (e.startswith(head) and e.endswith(tail) and len(head) + len(tail) <= len(e)):
                    agreed = False  # grow the neighbouring stretches past what disagrees
                    repairs += [[a, _certain(text, lo + 1, 1)], [_certain(text, hi, -1), b]]
                    break
                out.append(e[len(head) : len(e) - len(tail)])
            while nxt and nxt[0] < b:
                out.append(encode(text[nxt[0] : nxt[1]]))
                nxt = next(todo, None)
        if agreed:
            return b"".join(out)


def _merged(repairs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(repairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _touching(repairs, edges, a, b):
    """Repairs that overlap [a, b): those are the ones around its two ends."""
    import bisect

    first = bisect.bisect_right(edges, a) // 2
    while first < len(repairs) and repairs[first][0] < b:
        if repairs[first][1] > a:
            yield repairs[first]
        first += 1


def _points(text: str, raw: bytes, cuts: list[int]) -> list[int]:
    """Byte positions as code points."""
    if len(text) == len(raw):
        return cuts
    out, at, last = [], 0, 0
    for c in cuts:
        at += len(raw[last:c].decode())
        out.append(at)
        last = c
    return out


def encode_texts(docs: DataFrame, path: str | None = None, digest: bool = False) -> DataFrame:
    """key, n_tokens and ids of every different text.

    With ``digest`` they have ids_sha256 (ids as little-endian 32-bit) and decoded_sha256 in place of the ids, so that
    neither is shuffled.
    """
    path = path or default_path()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, open_z = encoder(path), zstandard.ZstdDecompressor()
        for b in batches:
            for z, cuts, own in zip(*[b.column(c).to_pylist() for c in ("z", "cuts", "own")]):
                raw = open_z.decompress(z)
                found = {names: enc.encode(raw[(cuts[i - 1] if i else 0) : cuts[i]].decode()) for i, names in
                         ((o["i"], o["name"]) for o in own)}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["name", "ids"]
                )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, open_z = encoder(path), zstandard.ZstdDecompressor()
        for b in batches:
            for run in (list(zip(*[x.column(c).to_pylist() for c in ("key", "z", "cuts", "parts")])) for x in slices(b, "z", 500_000)):
                n, ids, back = [], [], []
                for _, z, cuts, got in run:
                    raw = open_z.decompress(z)
                    text = raw.decode()
                    e = assemble(text, _points(text, raw, cuts), {g["i"]: g["ids"] for g in got or ()}, enc.encode)
                    wide = np.frombuffer(e, enc.dtype).astype("<u4").tobytes()
                    n.append(len(wide) // 4)
                    ids.append(hashlib.sha256(wide).hexdigest() if digest else wide)
                    back.append(hashlib.sha256(enc.decode(e)).hexdigest() if digest else "")
                kinds = [pa.array([r[0] for r in run], pa.binary()), pa.array(n, pa.int64())]
                if digest:
                    yield pa.RecordBatch.from_arrays([*kinds, pa.array(ids), pa.array(back)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([*kinds, pa.array(ids, pa.binary())], ["key", "n_tokens", "ids"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sealed = docs.select(text.alias("text")).mapInArrow(_seal, "key binary, z binary, cuts array<int>, names array<binary>")
    # one row a text; used three times below, shuffled once, for which the plan below the shuffle has to be the same
    texts = sealed.where("key is not null").groupBy("key").agg(F.first(F.struct("z", "cuts", "names")).alias("t")).select("key", "t.*")
    places = texts.select("key", F.posexplode("names").alias("i", "name"))
    owners = places.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("key", "i")).alias("o")).where("n > 1")
    own = owners.groupBy("o.key").agg(F.collect_list(F.struct("o.i", "name")).alias("own"))  # at most a text's chunks
    encoded = texts.join(own, "key").select("z", "cuts", "own").mapInArrow(fetch, "name binary, ids binary")
    routed = places.join(encoded, "name").groupBy("key").agg(F.collect_list(F.struct("i", "ids")).alias("parts"))
    form = "key binary, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids binary")
    return texts.join(routed, "key", "left").select("key", "z", "cuts", "parts").mapInArrow(join, form)


def digest(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    done = staged(encode_texts(docs, path, digest=True), "chunk-ids")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")
    keyed = docs.select(text, "doc_id", *keep)
    form = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields[1:])
    rows = keyed.mapInArrow(_keys, f"{form}, key binary")
    return rows.join(done, "key").select("doc_id", *keep, "n_tokens", "ids_sha256", "decoded_sha256")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [_name(t.as_py().encode()) for t in b.column("_text")]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(keys, pa.binary())], [*b.schema.names[1:], "key"])


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """key and text of each row's ids (little-endian 32-bit), special tokens included."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype(enc.dtype).tobytes() for x in b.column("ids").to_pylist()]
            text = [enc.decode(x).decode() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(text, pa.string())], ["key", "text"])

    return encoded.select("key", "ids").mapInArrow(run, "key binary, text string")
