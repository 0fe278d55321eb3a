"""Token-id output: canonical length-limited Huffman coding of ids from global counts, in independent blocks.

1. Texts are dealt by range of doc_id and sorted. Each range is encoded in order; its ids are kept
   in the shared folder with their offsets in the range.
2. Counts of all ids over the corpus give one table of code lengths (at most one number an id of the vocabulary).
3. Every block holds whole documents, about ``BLOCK`` ids, as one bit string with a checkpoint (bit offset) every 64
   ids, and is decoded on its own from the table.

A file is a folder: ``codes`` (Parquet: vocabulary, end_id, id, length) and ``blocks`` (Parquet: part, block, doc_ids, starts,
lengths, bits, checkpoints). ``read_token_file`` needs nothing else.

Defined results: a null or empty text is the end id alone; texts of any length are encoded whole and may make a block
larger; repeated rows are kept as rows of their own, next to each other; an empty table gives an empty file and result;
null doc_ids come first; further columns of the input are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import huffman
from tidemark.llm.tokens import default_path, encoder, groups, slices
from tidemark.session import shared_dir, staged

BLOCK = 65_536
END_ID = 0


def encode_sorted(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, start (ids before it in the part), n_tokens and ids of each row, by part in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        at, part = 0, None
        for b in batches:
            part = b.column("part")[0].as_py() if part is None and b.num_rows else part
            for rows in slices(b, "text"):
                ids = [x + end for x in enc.encode_many(rows.column("text").to_pylist())]
                n = np.array([len(x) for x in ids], np.int64) // enc.dtype.itemsize
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array([part] * rows.num_rows, pa.int64()),
                        pa.array(starts),
                        pa.array(n),
                        pa.array(ids, pa.binary()),
                    ],
                    ["doc_id", "part", "start", "n_tokens", "ids"],
                )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    dealt = dealt.withColumn("part", F.spark_partition_id().cast("long"))
    return staged(dealt.mapInArrow(run, "doc_id long, part long, start long, n_tokens long, ids binary"), "token-ids")


def id_counts(encoded: DataFrame, size: int, itemsize: int) -> np.ndarray:
    """Occurrences of every id over all rows; at most one row an id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for rows in slices(b, "ids"):
                ids = b"".join(rows.column("ids").to_pylist())
                total += np.bincount(np.frombuffer(ids, f"<u{itemsize}"), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["id", "n"])

    rows = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


_FILE = (
    "part long, block long, doc_ids array<long>, starts array<long>, lengths array<long>, bits binary, checkpoints binary"
)


def huffman_blocks(encoded: DataFrame, lengths: np.ndarray, itemsize: int, block: int = BLOCK) -> DataFrame:
    """All rows as Huffman blocks."""
    codes = huffman.canonical_codes(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part, due = [], 0, None, None

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([np.frombuffer(r[3], f"<u{itemsize}") for r in held])
            bits, marks = huffman.encode(ids, lengths, codes)
            row = [held[0][1], held[0][2], [r[0] for r in held], [r[2] for r in held], [r[4] for r in held], bits, marks]
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.binary()]
            names = ["part", "block", "doc_ids", "starts", "lengths", "bits", "checkpoints"]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

        for b in (x for batch in batches for x in slices(batch, "ids")):
            for row in zip(*[b.column(c).to_pylist() for c in ("doc_id", "part", "start", "ids", "n_tokens")]):
                if held and (size >= block or (row[1], row[2]) != (part, due)):
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += row[4]
                part, due = row[1], row[2] + row[4]
        if held:
            yield flush()

    return encoded.mapInArrow(run, _FILE)


def decode_blocks(blocks: DataFrame, lengths: np.ndarray, digest: bool = False) -> DataFrame:
    """doc_id, part, start, n_tokens and ids (little-endian 32-bit), decoded from the blocks; crc32 of the ids if ``digest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = huffman.Decoder(lengths)
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("part", "doc_ids", "starts", "lengths", "bits", "checkpoints")]
            for rows in groups(list(zip(*cols)), lambda r: sum(r[3]), 8 * BLOCK):
                out = decoder.decode([(r[4], r[5], sum(r[3])) for r in rows])
                each = [np.split(ids, np.cumsum(r[3])[:-1]) for r, ids in zip(rows, out)]
                raw = [x.astype("<u4").tobytes() for doc in each for x in doc]
                last = pa.array([zlib.crc32(x) for x in raw], pa.int64()) if digest else pa.array(raw, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d for r in rows for d in r[1]], pa.int64()),
                        pa.array([r[0] for r in rows for _ in r[1]], pa.int64()),
                        pa.array([s for r in rows for s in r[2]], pa.int64()),
                        pa.array([n for r in rows for n in r[3]], pa.int64()),
                        last,
                    ],
                    ["doc_id", "part", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    return blocks.mapInArrow(
        run, f"doc_id long, part long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}"
    )


def write_token_file(docs: DataFrame, where: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Encode all texts with the tokenizer file ``path`` and write the folder ``where``."""
    path = path or default_path()
    enc = encoder(path)
    encoded = encode_sorted(docs, path, end_id)
    lengths = huffman.code_lengths(id_counts(encoded, enc.size, enc.dtype.itemsize))
    used = [(os.path.basename(path), end_id, int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    codes = docs.sparkSession.createDataFrame(used, "vocabulary string, end_id int, id int, length int")
    codes.coalesce(1).write.parquet(f"{where}/codes")
    blocks = huffman_blocks(encoded, lengths, enc.dtype.itemsize)
    blocks.write.option("compression", "uncompressed").parquet(f"{where}/blocks")


def read_token_file(spark: SparkSession, where: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all rows before it), n_tokens and ids, or with ``digest`` ids_crc32, of every row of a file."""
    codes = spark.read.parquet(f"{where}/codes").select("id", "length").collect()  # at most one row an id
    lengths = np.zeros(max((r.id for r in codes), default=0) + 1, np.uint8)
    for r in codes:
        lengths[r.id] = r.length
    blocks = spark.read.schema(_FILE).parquet(f"{where}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))  # one row a range
    read = decode_blocks(blocks, lengths, digest).join(F.broadcast(offsets), "part")
    start = (F.col("_offset") + F.col("start")).alias("start")
    return read.select("doc_id", start, "n_tokens", "ids_crc32" if digest else "ids")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, from the file as read back."""
    where = f"{shared_dir(docs.sparkSession).rstrip('/')}/token-file-{uuid.uuid4().hex}"
    write_token_file(docs, where, path)
    return read_token_file(docs.sparkSession, where, digest=True)
