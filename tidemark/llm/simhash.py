"""SimHash near-duplicates by segment popcounts: an embedding, a grid range-join under Manhattan distance, exact checks.

A fingerprint of 64 bits is cut into 32 segments of two bits; its embedding is the bit count (0 to 2) of each segment.
Flipping one bit moves one coordinate by at most one, so the Manhattan distance of two embeddings is a lower bound of
the Hamming distance. Fingerprints within 2 bits are within distance 2, hence within distance 1 on the first or the last
16 coordinates. For either half, every fingerprint has the grid cell of its 16 coordinates and probes the 16 cells that
lie one step up; a pair within distance 1 meets in a cell, and is then checked with the exact Hamming distance.

Only different fingerprints are joined, so exact copies cost nothing. A cell of many fingerprints isn't expanded into pairs
but gridded again, finer. First by the counts of the other half: all 32 coordinates, where every fingerprint
lists its own cell and those one step away from it, since two within distance 2 have a cell between them. Random
fingerprints share such a cell once in 10^13, so billions stay few in a cell. Thousands of near copies do not; a cell of
many of these is gridded by segments of one bit: the coordinates are then the bits, a cell is one value, and all that
list it are within 2 bits of each other, so that one link to the smallest of them connects them. Each grid is exact, for a
pair that a cell would have found has both its fingerprints in the finer one.

Links become groups by alternating large-star and small-star steps over written tables.

With a ``similarity``, texts are linked where their sets of shingles have that Jaccard similarity or more. Fingerprints, embeddings, grid
and bit check come first as above, and whole sets confirm what they link: one class from there on. Two bits
catch near-identical texts only, and a grid wide enough for ordinary near copies prunes next to nothing and still misses
some, so what is missing then is found exactly: sets as similar as t share one of the first n - ceil(t n) + 1 shingles in any common
order (n the size of a set). The order puts shingles that are frequent in a sample last, which saves pairs and changes no result.
Sets that list the same shingle form a group. First every set of a group meets the group's smallest alone, if it is of another class. Then
only sets of different classes in a group need to meet, and only where their sizes and the parities of their parts allow the similarity. In a group
of more than a few this is decided in cells: a large group is cut into bands of sizes and these into blocks, so that any two of its sets
that may be similar are in one cell, and a cell of two blocks fits a task. A cell first gives no more pairs than connect what may
belong together, fewer than its rows; when these are checked, it gives the pairs that are still of different classes.
All links are checked by whole sets of 64-bit shingle hashes, made where the
texts of a pair meet; texts travel compressed.

Defined results: a text without a word, or a null text, has fingerprint zero and links like any other; with fewer words
than a shingle the whole sequence is the one shingle; texts of any length are hashed whole; repeated rows and ties share
a fingerprint and a group; an empty table gives an empty result; further columns are ignored by ``fingerprints`` and
kept by ``keep_one``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.mixing import row_key
from tidemark.llm.tokens import forget_encoders
from tidemark.session import release, small_batches, staged, staged_so_far

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: A cell with more possible pairs is gridded again, finer.
PAIRS = 50_000
#: Words of a shingle and Jaccard similarity of near copies in a corpus.
COPY_SHINGLE, COPY_SIMILARITY = 5, 0.8
#: Texts of the sample that orders shingles; sets of a group that meet as a list; rows of a block of a larger group.
SAMPLE, FEW, BLOCK = 20_000, 16, 4_096
#: Parts of a set whose parities are kept.
PARTS = 2048
_WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_EVEN = 0x55555555


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits that are set in more than half of the hashes of the shingles of a lower-cased text."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(" ".join(words), seed)
    digest, rows = xxhash.xxh64_intdigest, len(words) - shingle + 1
    shifted = [words[i : i + rows] for i in range(shingle)]
    total = np.zeros(64, np.int64)
    every = map(" ".join, zip(*shifted))
    for first in range(0, rows, 20_000):
        n = min(20_000, rows - first)
        h = np.fromiter((digest(s, seed) for s, _ in zip(every, range(n))), np.uint64, n)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > rows, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """The ``ids`` columns and fp (the 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("_text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp.view(np.int64))], [*b.schema.names[1:], "fp"])

    rows = docs.select(F.col(text).cast("string").alias("_text"), *ids)
    form = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{form}, fp long")


def _counts(half: int) -> str:
    """The 16 bit counts of a half as a long of two bits each."""
    return f"((shiftrightunsigned(fp, {32 * half}) & {_EVEN}L) + (shiftrightunsigned(fp, {32 * half + 1}) & {_EVEN}L))"


def _steps(part: str, ways: tuple[int, ...]) -> str:
    """Array of the cells one step from ``part`` along each of its 16 coordinates, null where there is none."""
    one = {1: "IF((shiftrightunsigned({0}, {1}) & 3L) < 2, {0} + {2}L, NULL)", -1: "IF((shiftrightunsigned({0}, {1}) & 3L) > 0, {0} - {2}L, NULL)"}
    return "array_compact(array(" + ", ".join(one[w].format(part, 2 * i, 1 << 2 * i) for i in range(16) for w in ways) + "))"


def links(fps: DataFrame, most: int = PAIRS) -> DataFrame:
    """a and b (a < b): links among the different values of ``fp``, enough to connect all within 2 bits of each other."""
    spread = fps.select("fp", *[F.expr(_counts(h)).alias(f"v{h}") for h in (0, 1)])
    cells = []
    for half in (0, 1):
        cells.append(f"array(named_struct('half', {half}, 'cell', v{half}, 'probe', false))")
        cells.append(f"transform({_steps(f'v{half}', (1,))}, c -> named_struct('half', {half}, 'cell', c, 'probe', true))")
    placed = spread.select("fp", F.explode(F.expr(f"concat({', '.join(cells)})")).alias("x")).select("fp", "x.*")
    by_cell = placed.groupBy("half", "cell").agg(
        F.count_if(~F.col("probe")).alias("n"), F.count_if("probe").alias("p")
    )
    by_cell = by_cell.where("n > 0 and n + p > 1").withColumn("large", F.expr(f"cast(n as double) * (n + p) > {most}"))
    met = placed.join(by_cell.select("half", "cell", "large"), ["half", "cell"])
    met = staged(met, "simhash-cells")
    cold = met.where("not large")
    base = cold.where("not probe").select("half", "cell", F.col("fp").alias("a"))
    near = base.join(cold.select("half", "cell", "probe", F.col("fp").alias("b")), ["half", "cell"])
    near = near.where(f"(probe or a < b) and bit_count(a ^ b) <= {DISTANCE} and a != b")
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.unionByName(_finer_links(met.where("large").select("fp").distinct(), most)).distinct()


def _finer_links(fps: DataFrame, most: int) -> DataFrame:
    """Links by the grid over all 32 coordinates; its large cells by the grid over single bits."""
    spread = fps.select("fp", *[F.expr(_counts(h)).alias(f"v{h}") for h in (0, 1)])
    own = "array(named_struct('v0', v0, 'v1', v1))"
    first = f"transform({_steps('v0', (1, -1))}, c -> named_struct('v0', c, 'v1', v1))"
    last = f"transform({_steps('v1', (1, -1))}, c -> named_struct('v0', v0, 'v1', c))"
    placed = spread.select("fp", F.explode(F.expr(f"concat({own}, {first}, {last})")).alias("x")).select("fp", "x.*")
    by_cell = placed.groupBy("v0", "v1").agg(F.count("*").alias("n")).where("n > 1")
    by_cell = by_cell.withColumn("large", F.expr(f"cast(n as double) * n > {most}"))
    met = staged(placed.join(by_cell, ["v0", "v1"]), "simhash-finer")
    cold = met.where("not large").select("v0", "v1", F.col("fp").alias("a"))
    pairs = cold.join(cold.withColumnRenamed("a", "b"), ["v0", "v1"]).where(f"a < b and bit_count(a ^ b) <= {DISTANCE}").select("a", "b")
    bits = met.where("large").select("fp").distinct()
    listed = bits.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("cell"))
    centre = listed.groupBy("cell").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    star = listed.join(centre, "cell").where("fp != a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(star)


def shingle_set(text: str | None, shingle: int = COPY_SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the different shingles of a lower-cased text, ascending; of fewer words, of the whole sequence."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    shingle = min(shingle, len(words))
    known = {w: xxhash.xxh64_intdigest(w, seed) for w in set(words)}
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    rows = len(words) - shingle + 1
    out = np.full(rows, shingle, np.uint64)
    for i in range(shingle):
        out = (out ^ h[i : i + rows]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _hash(shingles: np.ndarray) -> int:
    """A name of a set of shingles; zero of an empty one."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) if len(shingles) else 0


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """fp and shingles of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 500):
                sets = [shingle_set(t.as_py(), shingle) for t in b.column("text").slice(first, 500)]
                fp = np.array([_hash(s) for s in sets], np.uint64)
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                held = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), held], ["fp", "shingles"])

    return texts.select("text").mapInArrow(run, "fp long, shingles array<long>")


def frequent_shingles(texts: DataFrame, shingle: int, sample: int = SAMPLE, most: int = 500_000) -> np.ndarray:
    """Shingles that three or more different sets of a sample of about ``sample`` texts (tid, text) hold, the most frequent last."""
    part = min(1.0, sample / max(1, texts.count()))
    some = shingle_sets(texts.where(f"pmod(tid, 1000000) < {part * 1e6}"), shingle).dropDuplicates(["fp"])
    often = some.select("fp", F.explode("shingles").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 2")
    return often.orderBy(F.desc("n"), "key").limit(most).select("key").toArrow().column("key").to_numpy()[::-1].copy()


def listed_sets(docs: DataFrame, ids: tuple[str, ...], shingle: int, similarity: float, last: np.ndarray) -> DataFrame:
    """The ``ids`` columns, fp (a hash of the set of shingles), sim (the text's fingerprint), n (the set's size), bits (parities of its
    ``PARTS`` parts) and keys of every row.

    keys are the shingles by which a set is found; the shingles ``last`` come last, in their order. ``docs`` has _text.
    """
    place = np.argsort(last, kind="stable")
    names = last[place]

    def first_keys(found: np.ndarray) -> np.ndarray:
        s = found.view(np.int64)
        if len(names) and len(s):
            at = np.minimum(np.searchsorted(names, s), len(names) - 1)
            known = names[at] == s
            s = np.concatenate([s[~known], s[known][np.argsort(place[at[known]])]])
        return s[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for b in (x.slice(first, 1_000) for x in batches for first in range(0, x.num_rows, 1_000)):
            fp, sim, sizes = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int32)
            odd, keys = np.zeros((b.num_rows, PARTS), np.uint8), [np.zeros(0, np.int64)]
            for i, t in enumerate(b.column("_text")):
                t = t.as_py()
                s = shingle_set(t, shingle)
                fp[i], sim[i], sizes[i] = _hash(s), fingerprint(t), len(s)
                odd[i] = np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS) & 1
                keys.append(first_keys(s))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * (PARTS // 64), pa.int32()), pa.array(np.packbits(odd, axis=1).view(np.int64).reshape(-1)))
            held = pa.ListArray.from_arrays(pa.array(np.cumsum([len(k) for k in keys]), pa.int32()), pa.array(np.concatenate(keys)))
            arrays = [*b.columns[1:], pa.array(fp.view(np.int64)), pa.array(sim.view(np.int64)), pa.array(sizes), bits, held]
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names[1:], "fp", "sim", "n", "bits", "keys"])

    rows = docs.select("_text", *ids)
    form = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{form}, fp long, sim long, n int, bits array<long>, keys array<long>")


def packed(texts: DataFrame) -> DataFrame:
    """fp and z, the compressed text of one row of each fp; ``texts`` has fp and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, seen = zstandard.ZstdCompressor(level=3), set()
        for b in batches:
            new = [(f, t) for f, t in zip(b.column("fp").to_pylist(), b.column("text")) if not (f in seen or seen.add(f))]
            for first in range(0, len(new), 500):
                part = new[first : first + 500]
                z = [squeeze.compress((t.as_py() or "").encode()) for _, t in part]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in part], pa.int64()), pa.array(z, pa.binary())], ["fp", "z"])
            if len(seen) > 500_000:
                seen.clear()

    return texts.select("fp", "text").mapInArrow(run, "fp long, z binary").dropDuplicates(["fp"])


def _compared(least: float, shingle: int):
    """For rows of a pair's hub, then of its partners: a, b and j of the pairs as similar as ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_z, hub, own = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            found = []
            for a, b, z in zip(*[batch.column(c) for c in ("a", "b", "z")]):
                a, b = a.as_py(), b.as_py()
                s = shingle_set(open_z.decompress(z.as_py()).decode(), shingle)
                if a == b:
                    hub, own = a, s
                elif hub == a:
                    common = len(np.intersect1d(own, s, assume_unique=True))
                    j = common / (len(own) + len(s) - common)
                    if j >= least:
                        found.append((a, b, j))
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["a", "b", "j"])

    return run


def similar(pairs: DataFrame, texts: DataFrame, marks: DataFrame, shingle: int, least: float, spread: int = 500) -> DataFrame:
    """a, b and j, the Jaccard similarity of their sets, of every pair as similar as ``least``.

    Parities differ in no more places than sets do, so they spare most pairs the comparison of whole sets. The pairs of one a
    meet in parts of about ``spread``.
    """
    odd = " + ".join(f"bit_count(x[{i}] ^ y[{i}])" for i in range(PARTS // 64))
    may = pairs.join(marks.select(F.col("fp").alias("a"), F.col("n").alias("k"), F.col("bits").alias("x")), "a")
    may = may.join(marks.select(F.col("fp").alias("b"), F.col("n").alias("l"), F.col("bits").alias("y")), "b")
    may = staged(may.where(f"{odd} <= {(1 - least) / (1 + least)} * (k + l) + 1e-6").select("a", "b"), "simhash-may")
    ends = may.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(marks, "fp").select("tid", "fp")
    ends = staged(ends, "simhash-ends")
    if ends.count() <= 100_000:
        ends = F.broadcast(ends)
    held = staged(packed(texts.join(ends, "tid")), "simhash-texts", "uncompressed")
    parts = may.groupBy("a").agg(F.ceil(F.count("*") / spread).alias("p"))
    dealt = may.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), "p"))
    hubs = parts.select("a", F.col("a").alias("b"), F.explode(F.expr("sequence(0L, p - 1)")).alias("part"))
    both = dealt.select("a", "b", "part").unionByName(hubs).join(held.withColumnRenamed("fp", "b"), "b")
    met = both.repartition("a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("b")).select("a", "b", "z")
    return met.mapInArrow(_compared(least, shingle), "a long, b long, j double")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns fp, n, root, block, own and bits of each cell; rows come sorted by their first four columns, which name a cell."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        flat = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(9)]
        flat.append(batch.column(9).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1))
        held = flat if held is None else [np.concatenate(x) for x in zip(held, flat)]
        ends = np.flatnonzero(np.any([x[1:] != x[:-1] for x in held[:4]], axis=0)) + 1
        for first, end in zip([0, *ends], ends):
            yield [x[first:end] for x in held[4:]]
        held = [x[ends[-1] :] for x in held] if len(ends) else held
    if held is not None and len(held[0]):
        yield [x for x in held[4:]]


def _met(similarity: float, every: bool):
    """For the rows of cells: a and b of the pairs of different classes that sizes and parities allow.

    With ``every`` all of them, else only as many as connect the classes that they connect: fewer than a cell has rows.
    """
    share = (1 - similarity) / (1 + similarity)

    def met(fp, n, root, block, own, bits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(n, kind="stable")
        fp, n, block, own, bits = (x[order] for x in (fp, n, block, own, bits))
        label = np.unique(root[order], return_inverse=True)[1]
        across, stops = block.min() != block.max(), np.searchsorted(n, n / similarity + 1e-6, side="right")
        for i in range(len(n) - 1):
            rest = slice(i + 1, stops[i])
            may = label[rest] != label[i]
            if across:
                may &= block[rest] != block[i]
            if not own[i]:
                may &= own[rest]
            at = np.flatnonzero(may) + i + 1
            if not len(at):
                continue
            d = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
            near = d <= share * (n[at] + n[i]) + 1e-6
            at, d = at[near], d[near]
            if len(at) and not every:
                at = at[np.argsort(d, kind="stable")]
                at = at[np.unique(label[at], return_index=True)[1]]  # the nearest of each class
                label[np.isin(label, label[at])] = label[i]
            if len(at):
                yield np.minimum(fp[at], fp[i]), np.maximum(fp[at], fp[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = [], 0
        for cell in _cells(batches):
            for pair in met(*cell):
                found.append(pair)
                rows += len(pair[0])
                if rows >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b"])
                    found, rows = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b"])

    return run


def met_in_cells(groups: DataFrame, marks: DataFrame, similarity: float, every: bool, block: int = BLOCK) -> DataFrame:
    """a and b (a < b): pairs of ``groups`` (key, fp, n, root, c: the group's rows) that meet in cells of at most about two blocks.

    A group of more than a ``block`` is cut into bands of sizes: sets as similar as asked are in one band or in two neighbours.
    Each band is dealt to blocks, and each pair of blocks is a cell.
    """
    band = F.expr(f"cast(floor(ln(n) / {-math.log(similarity) * (1 + 1e-9)}) as int)")
    cut = F.col("c") > block
    placed = groups.join(marks.select("fp", "bits"), "fp").withColumn("_b", band)
    placed = placed.withColumn("band", F.explode(F.when(cut, F.array("_b", F.col("_b") + 1)).otherwise(F.array(F.lit(0)))))
    placed = placed.withColumn("own", ~cut | (F.col("band") == F.col("_b"))).withColumn("parts", F.ceil(F.col("c") / block))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("fp"), "parts")).withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    cell = ["key", "band", "i", "j"]
    placed = placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    placed = placed.select(*cell, "fp", "n", "root", "block", "own", "bits").repartition(*cell).sortWithinPartitions(*cell)
    return placed.mapInArrow(_met(similarity, every), "a long, b long")


def similar_links(
    rows: DataFrame, texts: DataFrame, shingle: int, similarity: float, few: int = FEW, block: int = BLOCK
) -> DataFrame:
    """a and b (a < b): links among the different ``fp`` of ``rows`` (tid, fp, sim, n, bits, keys), enough to connect all as similar as
    ``similarity``; ``texts`` are the rows' tid and text.

    What the grid of fingerprints brings together is checked first; only sets of different classes after that meet by shingles.
    Groups are rows, so that none has to fit a task; those of at most ``few`` sets are also lists.
    """
    spark, since = rows.sparkSession, staged_so_far()
    firsts = [F.first(c).alias(c) for c in ("n", "bits", "keys")] + [F.min("sim").alias("sim")]
    marks = staged(rows.groupBy("fp").agg(*firsts, F.min("tid").alias("tid")), "simhash-marks")
    found = marks.select(F.explode("keys").alias("key"), "fp", "n")
    shared = staged(found.join(found.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key"), "simhash-shared")
    sims = marks.select("fp", "sim")
    marks = marks.drop("keys", "sim")
    alike = lambda k, l: f"least({k}, {l}) >= {similarity} * greatest({k}, {l})"
    kept = []

    def checked(pairs: DataFrame) -> None:
        before = staged_so_far()
        kept.append(staged(similar(pairs, texts, marks, shingle, similarity).select("a", "b"), "simhash-links"))
        release(spark, before, kept[-1])

    def apart(groups: DataFrame) -> DataFrame:
        """Rows of the ``groups`` whose sets are of more than one class yet, with their root."""
        roots = components(reduce(DataFrame.union, kept)).withColumnRenamed("node", "fp")
        rooted = groups.select("key", "fp", "n", "c").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        open_keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        return staged(rooted.join(open_keys, "key"), "simhash-mixed")

    hubs = staged(sims.groupBy("sim").agg(F.min("fp").alias("hub")), "simhash-hubs")
    close = links(hubs.select(F.col("sim").alias("fp")))
    for c in ("a", "b"):
        close = close.join(hubs.select(F.col("sim").alias(c), F.col("hub").alias(f"_{c}")), c)
    close = close.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    equal = sims.join(hubs, "sim").where("fp != hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    checked(close.union(equal).distinct())
    mixed = apart(shared)
    centre = mixed.groupBy("key").agg(F.min(F.struct("fp", "n", "root")).alias("p"))
    met = mixed.join(centre, "key").where("p.root != root and " + alike("p.n", "n"))
    checked(met.select(F.col("p.fp").alias("a"), F.col("fp").alias("b")).distinct())
    mixed = apart(mixed)
    # small groups that many shingles have in common count once
    lists = mixed.where(f"c <= {few}").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("fp", "n", "root"))).alias("m"))
    small = lists.select("m").distinct().select("m", F.explode("m").alias("p"))
    small = small.select("p", F.explode(F.expr("filter(m, q -> p.fp < q.fp and p.root != q.root and " + alike("p.n", "q.n") + ")")).alias("q"))
    small = small.select(F.col("p.fp").alias("a"), F.col("q.fp").alias("b"))
    large = mixed.where(f"c > {few}")
    first = staged(small.union(met_in_cells(large, marks, similarity, False, block)).distinct(), "simhash-pairs")
    checked(first)
    # what is still of different classes, most of it nothing: parities may agree where sets don't
    rest = met_in_cells(apart(large), marks, similarity, True, block).distinct().join(first, ["a", "b"], "left_anti")
    rest = staged(rest, "simhash-pairs")
    if not rest.isEmpty():
        checked(rest)
    every = reduce(DataFrame.union, kept)
    every = staged(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-links")
    release(spark, since, every)
    return every


def _both_ways(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse, from one reading: a union would double the plan of whatever builds on it."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select(F.inline(ways))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root, the smallest node that links reach, for every node of ``edges`` (a, b).

    The rounds grow with the logarithm of the longest path; RuntimeError if ``rounds`` do not suffice.
    """
    spark, since = edges.sparkSession, staged_so_far()
    edges = staged(edges.select("a", "b"), "links")
    before = None
    for _ in range(rounds):
        both = _both_ways(edges)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a node is linked to the node's least
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        # small star: a node's smaller neighbours, and itself, are linked to the least of them
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("c"), F.explode(F.array("b", "a")).alias("b")).withColumnRenamed("c", "a")
        edges = staged(small.where("a != b").distinct(), "links")
        release(spark, since, edges)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def near_duplicates(
    docs: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE, similarity: float | None = None
) -> DataFrame:
    """``ids``, fp, root (a fingerprint that names the group) and component_id (smallest doc_id in the group) of every row.

    Links are fingerprints within 2 bits or, with ``similarity``, sets of shingles of that Jaccard similarity or more, those of
    fingerprints within 2 bits first; fp is then a hash of the set.
    """
    spark, since = docs.sparkSession, staged_so_far()
    if similarity is None:
        rows = staged(fingerprints(docs, text, ids, shingle), "fingerprints")
        nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
        roots = components(links(nodes.select("fp")))
    else:
        known = docs.select(*ids, F.col(text).cast("string").alias("_text")).withColumn("tid", F.xxhash64("_text"))
        texts = known.select("tid", F.col("_text").alias("text"))
        with small_batches(spark):
            rows = staged(listed_sets(known, (*ids, "tid"), shingle, similarity, frequent_shingles(texts, shingle)), "fingerprints")
            nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
            roots = components(similar_links(rows, texts, shingle, similarity))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    low = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(named.join(low, "root").select("fp", "root", "component_id"), "groups")  # one row a fingerprint
    release(spark, since, rows, named)
    return rows.join(named, "fp").select(*ids, "fp", "root", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id, nulls last; of repeated rows of it, the first by its other columns."""
    key = row_key(F.col("doc_id"), F.col("text"))
    keyed = docs.select(key.alias("_key"), "doc_id", "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("w")
    chosen = near_duplicates(keyed, ids=("doc_id", "_key"), shingle=shingle, similarity=similarity).groupBy("root").agg(first).select("w._key")
    rows = docs.select(key.alias("_key"), F.struct(*docs.columns).alias("_row"))  # whatever the columns are called
    kept = rows.join(chosen, "_key", "left_semi")
    others = [F.col("_row")[c] for c in docs.columns if c not in ("doc_id", "text")]
    row = F.row_number().over(Window.partitionBy("_key").orderBy(*others, F.lit(0)))
    return kept.withColumn("_n", row).where("_n = 1").select("_row.*")
