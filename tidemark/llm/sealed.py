"""Arrays of a row as one compressed value, so that only the task that uses them holds them at full size."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import zstandard


def seal(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes."""
    head = json.dumps([(x.dtype.str, len(x)) for x in arrays]).encode()
    return zstandard.ZstdCompressor(level=3).compress(b"".join([len(head).to_bytes(4, "little"), head, *[x.tobytes() for x in arrays]]))


def opened(value: bytes) -> list[np.ndarray]:
    """The arrays again."""
    raw = zstandard.ZstdDecompressor().decompress(value)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n in json.loads(raw[4:at]):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in as few bytes as they need."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def names_out(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary or string array as ends and bytes."""
    flat = names.cast(pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    return narrow(ends - ends[0]), np.frombuffer(flat.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def names_in(ends: np.ndarray, data: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The array again, as large_binary or large_string."""
    return pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
