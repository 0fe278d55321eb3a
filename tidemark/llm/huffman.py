"""Canonical length-limited Huffman coding of integer ids, in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np

#: Longest code of an alphabet that fits it, and ids between two checkpoints.
LIMIT, STRIDE = 18, 64


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for an id that never occurs.

    More ids than ``limit`` bits can tell apart raise the limit to the bits that they need.
    """
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, (len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    leaves = []  # for each level, which of its items in ascending order are ids
    items, is_leaf = weights, np.ones(len(weights), bool)
    for _ in range(limit - 1):
        leaves.append(is_leaf)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        items = np.concatenate([weights, pairs])
        rank = np.argsort(items, kind="stable")
        items, is_leaf = items[rank], rank < len(weights)
    leaves.append(is_leaf)
    depth, take = np.zeros(len(order), np.int64), 2 * (len(order) - 1)
    for is_leaf in reversed(leaves):
        n = int(is_leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        top = int(lengths[order].max())
        room = np.uint64(1) << (top - lengths[order].astype(np.uint64))
        left = np.concatenate([[np.uint64(0)], np.cumsum(room)[:-1]]).astype(np.uint64)
        codes[order] = left >> (top - lengths[order].astype(np.uint64))
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """The bit string of a block (big-endian 32-bit words) and the bits of each stride as 16-bit numbers."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    if not len(ids):
        return b"", b""
    start = ends - n
    at, shift = start >> 5, (64 - (start & 31) - n).astype(np.uint64)
    value = codes[ids] << shift
    size = int(ends[-1] + 31 >> 5) + 2
    words = np.bincount(at, (value >> np.uint64(32)).astype(np.float64), size)
    words += np.bincount(at + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    marks = ends[np.minimum(np.arange(STRIDE - 1, len(ids) + STRIDE - 1, STRIDE), len(ids) - 1)]
    strides = np.diff(marks, prepend=0).astype("<u2")
    return words[:-1].astype(np.uint64).astype(">u4").tobytes(), strides.tobytes()


class Decoder:
    """Table-driven decoding; the strides of a block are decoded side by side from their checkpoints."""

    def __init__(self, lengths: np.ndarray):
        self.top = max(1, int(lengths.max(initial=1)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        each = 1 << (self.top - lengths[order].astype(np.int64))
        self.symbol = np.repeat(order, each).astype(np.uint32)
        self.length = np.repeat(lengths[order], each).astype(np.uint8)
        rest = (1 << self.top) - len(self.symbol)  # a lone id leaves half of the table free
        self.symbol = np.concatenate([self.symbol, np.zeros(rest, np.uint32)])
        self.length = np.concatenate([self.length, np.ones(rest, np.uint8)])

    def decode(self, blocks: list[tuple[bytes, bytes, int]]) -> list[np.ndarray]:
        """The ids of (bits, strides, number of ids) blocks."""
        lanes, sizes, base = [], [], 0
        words = []
        for bits, strides, n in blocks:
            w = np.frombuffer(bits, ">u4")
            s = np.frombuffer(strides, "<u2").astype(np.int64)
            lanes.append(base * 32 + np.cumsum(s) - s)
            left = np.full(len(s), STRIDE, np.int64)
            if n:
                left[-1] = n - STRIDE * (len(s) - 1)
            sizes.append(left)
            words.append(w)
            base += len(w)
        w = np.concatenate([*words, np.zeros(2, ">u4")]).astype(np.uint64)
        at, left = np.concatenate(lanes), np.concatenate(sizes)
        out = np.zeros((len(at), STRIDE), np.uint32)
        mask, whole = np.uint64((1 << self.top) - 1), 64 - self.top
        short = np.flatnonzero(left < STRIDE)
        for j in range(STRIDE):
            k = at >> 5
            look = ((w[k] << np.uint64(32)) | w[k + 1]) >> (whole - (at & 31)).astype(np.uint64) & mask
            out[:, j] = self.symbol[look]
            step = self.length[look].astype(np.int64)
            if len(short):  # a lane that has ended stays where it is
                step[short[left[short] <= j + 1]] = 0
            at += step
        got, first = [], 0
        for (_, strides, n), _ in zip(blocks, lanes):
            rows = len(strides) // 2
            got.append(out[first : first + rows].reshape(-1)[:n])
            first += rows
        return got
