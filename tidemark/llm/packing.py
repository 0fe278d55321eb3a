"""Packing along a space-filling curve.

1. Every text is encoded once. Its ids are hashed to signed buckets, and seeded directions project the vector of damped
   counts to ``DIMS`` coordinates; ids, coordinates' place on the Hilbert curve and length are written to the shared folder.
2. Only (place on the curve, doc_id, row, length) are sorted, by ranges of the curve; running sums over ranges give each
   document's place in the stream of all ids along the curve. Equal texts have one place on it, and are told apart by doc_id
   and row, so that a third of all rows may be copies.
3. The stream is cut every ``LENGTH`` ids: neighbours on the curve share sequences, and only the last one is padded.

Projections are sums of integers, so places don't depend on how rows are batched.

Defined results: a null or empty text is the end id alone; texts of any length are encoded whole and cut into as many
pieces as they need; repeated rows are packed each on their own; null doc_ids are kept; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import default_path, encoder, slices
from tidemark.operators.ranking import prefix_sums
from tidemark.session import staged

LENGTH, END_ID = 1024, 0
BUCKETS, DIMS, BITS = 1024, 3, 10
_SEED = np.random.default_rng(20)
#: Directions of the projection, whole numbers.
_WAYS = np.rint(_SEED.standard_normal((BUCKETS, DIMS)) * 256)
_MIX, _SIGN = 0x9E3779B1, 0x85EBCA6B


def hashed_vectors(ids: np.ndarray, each: np.ndarray) -> np.ndarray:
    """A row of damped, signed bucket counts for each document; ``ids`` of all, ``each`` ids a document."""
    x = ids.astype(np.uint32)
    bucket = (x * np.uint32(_MIX)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    sign = 1.0 - 2.0 * ((x * np.uint32(_SIGN)) >> np.uint32(31))
    place = np.repeat(np.arange(len(each)) * BUCKETS, each) + bucket
    counts = np.bincount(place, sign, len(each) * BUCKETS).reshape(-1, BUCKETS)
    return np.rint(np.sign(counts) * np.log1p(np.abs(counts)) * 16)


def coordinates(vectors: np.ndarray) -> np.ndarray:
    """``DIMS`` whole numbers of ``BITS`` bits for each vector: its direction, spread evenly."""
    size = np.sqrt((vectors * vectors).sum(1, keepdims=True)) * 256
    x = (vectors @ _WAYS) / np.where(size > 0, size, 1)
    even = 1 / (1 + np.exp(-1.702 * x))  # close to the normal distribution's
    return np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each point (rows of coordinates below 2**bits) on the Hilbert curve."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns of each cell, from the largest
        q, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):  # Gray code across the axes
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip = np.where(x[-1] & (1 << level), flip ^ ((1 << level) - 1), flip)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def encode_placed(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """row, doc_id, n_tokens, key (place on the curve) and ids of each document, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end, row = np.array([end_id], enc.dtype).tobytes(), 0
        for b in batches:
            part = b.column("part")[0].as_py() if b.num_rows else 0
            for rows in slices(b, "text"):
                ids = [x + end for x in enc.encode_many(rows.column("text").to_pylist())]
                each = np.array([len(x) for x in ids], np.int64) // enc.dtype.itemsize
                key = hilbert_key(coordinates(hashed_vectors(np.frombuffer(b"".join(ids), enc.dtype), each)))
                number = (part << 33) + row + np.arange(rows.num_rows)
                row += rows.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number), rows.column("doc_id"), pa.array(each), pa.array(key), pa.array(ids, pa.binary())],
                    ["row", "doc_id", "n_tokens", "key", "ids"],
                )

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long"), text).withColumn("part", F.spark_partition_id().cast("long"))
    return staged(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, key long, ids binary"), "packing-ids")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, digest: bool = False) -> DataFrame:
    """doc_id, start, length, ids (little-endian 32-bit; with ``digest`` ids_crc32), doc_tokens, sequence_id and offset of each piece."""
    path = path or default_path()
    dtype = encoder(path).dtype
    rows = encode_placed(docs, path, end_id)
    light = rows.select("row", F.struct("key", "doc_id", "row").alias("place"), F.col("n_tokens").alias("n"))
    placed = prefix_sums(light, "place", ["n"]).select("row", (F.col("run_n") - F.col("n")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "ids"):
                each = part.column("n_tokens").to_numpy()
                at = part.column("at").to_numpy()
                pieces = (at + each - 1) // length - at // length + 1
                doc = np.repeat(np.arange(len(each)), pieces)
                sequence = at[doc] // length + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.maximum(sequence * length - at[doc], 0)
                stop = np.minimum((sequence + 1) * length - at[doc], each[doc])
                wide = [np.frombuffer(x, dtype).astype("<u4").tobytes() for x in part.column("ids").to_pylist()]
                cuts = [wide[d][4 * a : 4 * z] for d, a, z in zip(doc.tolist(), start.tolist(), stop.tolist())]
                ids = pa.array([zlib.crc32(x) for x in cuts], pa.int64()) if digest else pa.array(cuts, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), *[pa.array(x) for x in (start, stop - start)], ids]
                    + [pa.array(x) for x in (each[doc], sequence, at[doc] + start - sequence * length)],
                    ["doc_id", "start", "length", named, "doc_tokens", "sequence_id", "offset"],
                )

    named = "ids_crc32" if digest else "ids"
    form = f"doc_id long, start long, length long, {named} {'long' if digest else 'binary'}, doc_tokens long, sequence_id long, offset long"
    return rows.drop("key").join(placed, "row").drop("row").mapInArrow(cut, form)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = END_ID) -> DataFrame:
    """sequence_id, n_tokens, ids (little-endian 32-bit) of whole sequences, padded to ``length`` unless their size is a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = np.array([pad_id], "<u4").tobytes()
        for b in batches:
            ids = [b"".join(p["ids"] for p in x) for x in b.column("pieces").to_pylist()]
            n = [len(x) // 4 for x in ids]
            full = [x if k & (k - 1) == 0 else x + pad * (length - k) for x, k in zip(ids, n)]
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), pa.array(n), pa.array(full, pa.binary())], ["sequence_id", "n_tokens", "ids"])

    held = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))  # length ids at most
    return held.mapInArrow(run, "sequence_id long, n_tokens long, ids binary")


def digest(docs: DataFrame) -> DataFrame:
    """The pieces of all documents, their ids as crc32."""
    return pack(docs, digest=True)
