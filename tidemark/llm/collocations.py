"""Phrase collocations from compressed position bitmaps.

1. ``bitmaps`` deals the words of each language to shards of about ``SHARD`` bytes of text. In a shard each word has a bitmap of its
   positions, kept as those bytes that have a bit set (place and eight positions), and one bitmap marks where pieces start.
2. ``extensions`` grows phrases by a word: their bitmap is shifted by a position, bits at the start of a piece are cleared,
   and the rest is ANDed with the bitmap of every word that has a bit in the same byte; set bits are counted. It runs
   depth-first: the phrases of a batch of first words are grown to their full length before the next batch.
3. Counts are summed over shards, in parts whose number grows with the words: first of words and pairs, then of longer phrases, which only grow from pairs that are
   frequent over all shards. Shards know these from a bit table of fixed size (``FILTER`` bits), which can only let
   more through; exact counts decide.

Scores are whole numbers of up to 38 digits. Defined results: a null text has no words; a null language is ``und``; a text longer
than ``SEGMENT`` is dealt in parts that end where a piece does; repeated rows count each; ties are ranked by phrase; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.sealed import names_in, names_out, narrow, opened, seal
from tidemark.llm.tokens import forget_encoders, slices, trim
from tidemark.session import dealt, small_batches, staged

SHARD, SEGMENT, HELD = 8_000_000, 1_000_000, 16_000_000
#: Bits of the table of frequent pairs, a power of two.
FILTER = 1 << 26
LEAST, COVERED, BEST = 10, 50, 2000
#: Bytes of bitmaps of first words that are grown at a time.
BATCH = 100_000
#: Words that count as a row in ``dealt``: a part sums the phrases of about 2,000,000 words.
WORDS_A_ROW = 10

_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(10 if b in _ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = re.compile(rb"[.,;:!?\n-\r]")
_FORM = "lang string, n long, words binary, bitmaps binary"


def _segments(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``SEGMENT`` bytes that end where a piece does."""
    at = 0
    while len(text) - at > SEGMENT and (m := _END.search(text, at + SEGMENT)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The words, ends of pieces and gaps of texts by number, and what the numbers stand for."""
    flat = pa.array([b"\n".join(texts).translate(_FOLD).replace(b"\n", b" \n ")], pa.large_binary())
    found = pc.split_pattern(flat, " ").flatten().dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def _shard(lang: str, texts: list[bytes]) -> pa.RecordBatch | None:
    """The bitmaps of one shard."""
    ids, names = _numbered(texts)
    end, gap = (pc.index(names, pa.scalar(x, pa.large_binary())).as_py() for x in (b"\n", b""))
    real = (ids != end) & (ids != gap)
    piece = np.cumsum(ids == end, dtype=np.int32)[real]
    ids = ids[real]
    used = np.flatnonzero(np.bincount(ids, minlength=1))
    if not len(used):
        return None
    number = np.zeros(len(names), np.int32)
    number[used] = np.arange(len(used))
    word = number[ids]
    start = np.ones(len(word), bool)
    start[1:] = piece[1:] != piece[:-1]
    del ids, real, piece
    position = np.argsort(word, kind="stable").astype(np.int32)
    word, place = word[position], position >> 3
    first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (place[1:] != place[:-1])])).astype(np.int32)
    bits = np.bitwise_or.reduceat(np.left_shift(np.uint8(1), (position & 7).astype(np.uint8)), first)
    starts = np.append(np.packbits(start, bitorder="little"), np.uint8(0))
    if len(word) % 8:
        starts[-2] |= (0xFF << len(word) % 8) & 0xFF
    starts[-1] = 0xFF  # nothing follows the last word
    words, each = names.take(pa.array(used)), np.bincount(word[first], minlength=len(used))
    row = [lang, len(word), seal(*names_out(words)), seal(narrow(each), narrow(place[first]), bits, starts)]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [c.split()[0] for c in _FORM.split(", ")])


def bitmaps(docs: DataFrame, shard: int = SHARD, held: int = HELD) -> DataFrame:
    """The shards of all documents, a row each, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            size.pop(lang)
            made = _shard(lang, kept.pop(lang))
            trim()
            if made is not None:
                yield made

        forget_encoders()
        for b in batches:
            for rows in slices(b, "text"):
                for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist()):
                    for part in _segments(text.encode()):
                        kept.setdefault(lang, []).append(part)
                        size[lang] = size.get(lang, 0) + len(part) + 1
                        if size[lang] >= shard:
                            yield from flush(lang)
                        elif sum(size.values()) > held:  # many languages in a task
                            yield from flush(max(size, key=size.__getitem__))
        for lang in list(kept):
            yield from flush(lang)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    rows = docs.select(lang, F.col("text").cast("string").alias("text")).where("text is not null")
    with small_batches(docs.sparkSession):
        return staged(rows.mapInArrow(run, _FORM), "position-bitmaps", "uncompressed")


class _Shard:
    """A shard's bitmaps by word and by place."""

    def __init__(self, lang: str, words: bytes, packed: bytes):
        self.lang, self.names = lang, names_in(*opened(words), pa.large_string()).cast(pa.string())
        each, place, self.bits, self.starts = opened(packed)
        self.place = place.astype(np.int32)
        self.word = np.repeat(np.arange(len(each), dtype=np.int32), each)
        self.first = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        self.by_place = np.argsort(self.place, kind="stable").astype(np.int32)
        self.begin = np.searchsorted(self.place[self.by_place], np.arange(len(self.starts) + 1)).astype(np.int32)

    def batches(self) -> Iterator[slice]:
        """Bitmaps of successive words, about ``BATCH`` bytes at a time."""
        at = 0
        while at < len(self.names):
            to = max(at + 1, int(np.searchsorted(self.first, self.first[at] + BATCH, "right")) - 1)
            yield slice(int(self.first[at]), int(self.first[to]))
            at = to

    def extensions(self, phrase: np.ndarray, place: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """phrase, word, place and bits of all phrases one word longer."""
        moved = bits.astype(np.uint16) << 1
        over = np.flatnonzero(moved >> 8)
        phrase, place = np.concatenate([phrase, phrase[over]]), np.concatenate([place, place[over] + 1])
        bits = np.concatenate([moved & 0xFF, moved[over] >> 8]).astype(np.uint8) & ~self.starts[place]
        some = np.flatnonzero(bits)
        phrase, place, bits = phrase[some], place[some], bits[some]
        each = self.begin[place + 1] - self.begin[place]
        mine = np.repeat(np.arange(len(place), dtype=np.int32), each)
        other = self.by_place[np.repeat(self.begin[place] - np.cumsum(each) + each, each) + np.arange(len(mine))]
        both = bits[mine] & self.bits[other]
        hit = np.flatnonzero(both)
        mine = mine[hit]
        return phrase[mine], self.word[other[hit]], place[mine], both[hit]

    def hashes(self) -> np.ndarray:
        return np.array([_hash(self.lang, w) for w in self.names.to_pylist()], np.uint64)


def _hash(lang: str, word: str) -> int:
    return xxhash.xxh64_intdigest(f"{lang} {word}")


def _bit(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The place of a pair of words in the bit table."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x165667B19E3779F9)
    return (x >> np.uint64(33)).astype(np.int64) & (size - 1)


def _grouped(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, the number of set bits of each, and each row's key by number."""
    keys, which = np.unique(key, return_inverse=True)
    return keys, np.bincount(which, np.bitwise_count(bits), len(keys)).astype(np.int64), which


def phrase_counts(shards: DataFrame, size: int, table: bytes | None = None) -> DataFrame:
    """lang, phrase and f of phrases of up to two words (``size`` 2), or of ``size`` words that grow from pairs in ``table``."""
    shared = shards.sparkSession.sparkContext.broadcast(table) if table is not None else None

    def rows(s: _Shard, words: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        columns = [s.names.take(pa.array(w)) for w in words]
        phrase = pc.binary_join_element_wise(*columns, " ") if len(words) > 1 else columns[0]
        return pa.RecordBatch.from_arrays([pa.array([s.lang] * len(n), pa.string()), phrase, pa.array(n)], ["lang", "phrase", "f"])

    def grow(s: _Shard) -> Iterator[pa.RecordBatch]:
        v = len(s.names)
        if shared is not None:
            known, hashes = np.frombuffer(shared.value, np.uint8), s.hashes()
            frequent = lambda a, b: (known[(at := _bit(hashes[a], hashes[b], 8 * len(known))) >> 3] >> (at & 7)) & 1
        for part in s.batches():
            word, place, bits = s.word[part], s.place[part], s.bits[part]
            if shared is None:
                keys, n, _ = _grouped(word, bits)
                yield rows(s, [keys], n)
            first, second, place, bits = s.extensions(word, place, bits)
            if shared is None:
                keys, n, _ = _grouped(first.astype(np.int64) * v + second, bits)
                yield rows(s, [keys // v, keys % v], n)
                continue
            held = np.flatnonzero(frequent(first, second))
            path, last, place, bits = [first[held], second[held]], second[held], place[held], bits[held]
            while len(path) < size and len(last):
                phrase, word, place, bits = s.extensions(np.arange(len(last)), place, bits)
                held = np.flatnonzero(frequent(last[phrase], word))
                path, last, place, bits = [*[p[phrase[held]] for p in path], word[held]], word[held], place[held], bits[held]
            if len(last):
                key = path[0].astype(np.int64)
                for p in path[1:]:  # number phrases word by word, so that keys stay small
                    key = np.unique(key, return_inverse=True)[1] * v + p
                keys, n, which = _grouped(key, bits)
                one = np.zeros(len(keys), np.int64)
                one[which] = np.arange(len(which))
                yield rows(s, [p[one] for p in path], n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for b in batches:
            for lang, words, packed in zip(b.column("lang"), b.column("words"), b.column("bitmaps")):
                yield from grow(_Shard(lang.as_py(), words.as_py(), packed.as_py()))
                trim()

    made = shards.drop("n").mapInArrow(run, "lang string, phrase string, f long")
    words = shards.agg(F.sum("n")).first()[0] or 0
    # A shard has each phrase once, so summing before the shuffle would hold a task's phrases in memory and merge few of them.
    return dealt(made, words // WORDS_A_ROW, "lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def pair_table(pairs: DataFrame, bits: int = FILTER) -> bytes:
    """A bit for each pair of words; ``bits`` / 8 bytes reach the driver, however many pairs there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [(lang, *p.split(" ")) for lang, p in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist())]
            a, z = (np.array([_hash(x[0], x[k]) for x in split], np.uint64) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(_bit(a, z, bits))], ["bit"])

    placed = pairs.select("lang", "phrase").mapInArrow(run, "bit long")
    part = F.shiftright("bit", 15).alias("part")
    parts = placed.groupBy(part).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("bits"))
    out = bytearray(bits // 8)
    for r in parts.collect():
        out[r.part * 4096 : r.part * 4096 + 4096] = bytes(r.bits)[: bits // 8]
    return bytes(out)


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of two and three words."""
    shards = bitmaps(docs)
    frequent = F.col("f") >= least
    with small_batches(docs.sparkSession):  # a shard at a time
        short = staged(phrase_counts(shards, 2).where(frequent), "phrase-counts")
        pairs = short.where("phrase like '% %'")  # words have no space
        triples = staged(phrase_counts(shards, 3, pair_table(pairs)).where(frequent), "phrase-counts")
    found = pairs.unionByName(triples)

    parts = F.split("phrase", " ")
    halves = lambda k: [F.array_join(F.slice(parts, 1, k), " ").alias("left"), F.array_join(F.slice(parts, k + 1, 3), " ").alias("right")]
    cut = lambda df, k: df.select("lang", "phrase", F.col("f").alias("a"), F.lit(k).alias("k"), *halves(k))
    cuts = cut(found, 1).unionByName(cut(triples, 2))
    counts = short.select("lang", "phrase", "f")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr("(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    scored = lowest.select("lang", "phrase", "a", "s.score", "s.l", "s.r")

    inside = triples.select("lang", F.col("f").alias("longer"), F.explode(F.array(*[F.array_join(F.slice(parts, i, 2), " ") for i in (1, 2)])).alias("phrase"))
    cover = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(cover, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    sizes = shards.groupBy("lang").agg(F.sum("n").alias("n"))  # one row a language
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def digest(docs: DataFrame) -> DataFrame:
    """The first 2,000 phrases of each language."""
    return collocations(docs)


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\n-\r]')) AS piece FROM documents WHERE text IS NOT NULL),
  w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
  g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM w, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k),
  f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
  n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
  c AS (SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
  h AS (SELECT c.lang, phrase, words, a, cut, array_to_string(w[:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y FROM c, (VALUES (1), (2)) AS s(cut) WHERE cut < words),
  s AS (SELECT h.lang, h.phrase, words, a, cut, fx.f AS l, fy.f AS r, CAST((1000000::HUGEINT * a * a) // (fx.f::HUGEINT * fy.f) AS BIGINT) AS score
    FROM h JOIN f fx ON fx.lang = h.lang AND fx.phrase = x JOIN f fy ON fy.lang = h.lang AND fy.phrase = y),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
  o AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE words = 3),
  m AS (SELECT lang, phrase, max(a) AS longer FROM o GROUP BY ALL),
  k AS (SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
    FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM k JOIN n USING (lang) WHERE rank <= 2000
"""
