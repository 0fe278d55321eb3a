"""Exact encoding of whole texts with a tokenizers file, inside tasks.

A byte-level pre-tokenizer always starts a new pre-token at a single space or line end between two other characters, and
where letters end. A text may be cut there and its parts be encoded apart. Parts repeat a lot; each Python worker keeps a
bounded table of those it has encoded, in two generations. Texts with other characters than ASCII and Latin-1 letters, or
with runs of white space, are cut only at single spaces between other characters; a tokenizer of another kind encodes
whole texts. Hence ids always equal the library's.
"""

from __future__ import annotations

import array
import ctypes
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Parts in a generation of a worker's table, and the longest that it remembers.
KEEP, LONGEST = 500_000, 48
#: White space, a superset of what the pre-tokenizer takes as such.
_SAFE = re.compile(r"(?<=[^\s\u180e\u200b\ufeff])(?= [^\s\u180e\u200b\ufeff])")
_L = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_WORD = re.compile(f" ?[{_L}]+")
#: Where letters end in other characters, but for apostrophes.
_TAIL = f"([{_L}])([!-&(-/:-@\\[-`{{-~])"
#: Words; line ends; what follows an apostrophe stays with it, since some endings belong to it; other characters; a space.
_PARTS = re.compile(f" ?[{_L}]+|\n| ?[^{_L} \n']*'[^ \n]*| ?[^{_L} \n]+| ")
#: ASCII and Latin-1 letters, without white space but space and line end.
_KNOWN = bytes(b for b in range(256) if (b < 128 and b not in (0, 1, 9, 11, 12, 13, 28, 29, 30, 31)) or b >= 192 and b not in (215, 247))


def _is_plain(text: str, special: list[str] = ()) -> bool:
    """Known characters only, and no white space next to another."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    if raw.translate(None, _KNOWN) or b"  " in raw or b" \n" in raw or b"\n " in raw or b"\n\n" in raw:
        return False
    return not any(s in text for s in special)


def parts(text: str) -> list[str]:
    """Substrings whose encodings, joined, are the text's encoding."""
    return _PARTS.findall(text) if _is_plain(text) else _SAFE.split(text)


def default_path() -> str:
    """The public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _spelling() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """A tokenizer with its table of known parts. Ids travel as little-endian bytes of ``dtype``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        kind = json.loads(self.tokenizer.to_str())
        self.by_parts = (
            kind["normalizer"] is None
            and kind["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            and kind["post_processor"] is None
            and kind["model"]["type"] == "BPE"
            and not kind["model"]["dropout"]
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or " " in t["content"] for t in kind["added_tokens"])
        )
        self.special = [t["content"] for t in kind["added_tokens"]]
        self.spelling = _spelling()
        self.size = self.tokenizer.get_vocab_size()
        self.code = "H" if self.size <= 65_536 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; a null text counts as empty."""
        if not text:
            return b""
        if not self.by_parts:
            return self._library([text])[0]
        cut = self._cut(text)
        got = list(map(self.known.get, cut))
        if None in got:
            learnt = self._learn({p for p, g in zip(cut, got) if g is None})
            got = [g if g is not None else learnt[p] for p, g in zip(cut, got)]
        return b"".join(got)

    def encode_many(self, texts: list[str | None], most: int = 8_000_000) -> Iterator[bytes]:
        """The ids of each text; the work is shared by the different words of a run of texts.

        Words are split, and their equals found, by Arrow; Python sees each different word of a run once.
        """
        for run in groups(texts, lambda t: len(t or "") + 1, most):
            plain = [self.by_parts and _is_plain(t or "", self.special) for t in run]
            many = iter(self._by_words([t or "" for t, ok in zip(run, plain) if ok]))
            for t, ok in zip(run, plain):
                yield next(many) if ok else self.encode(t)

    def _by_words(self, texts: list[str]) -> Iterator[bytes]:
        if not texts:
            return
        joined = pa.array([t.replace("\n", " \n ") for t in texts], pa.large_string())
        lists = pc.split_pattern(pc.replace_substring_regex(joined, _TAIL, "\\1 \x01\\2"), " ")
        first = lists.offsets.to_numpy()
        words = lists.values.dictionary_encode()
        at, names = words.indices.to_numpy(), words.dictionary.to_pylist()
        line_end = np.array([w == "\n" for w in names])[at]
        spaced = ~np.array([w == "\n" or w[:1] == "\x01" for w in names])[at]  # a space comes before it in the text:
        spaced[1:] &= ~line_end[:-1]  # not at the start, nor after a line end, nor where letters end
        spaced[first[:-1]] = False
        key = at.astype(np.int64) * 2 + spaced
        used = np.zeros(2 * len(names), bool)
        used[key] = True
        keys = np.flatnonzero(used)
        pieces = [" " + names[k >> 1] if k & 1 else names[k >> 1].removeprefix("\x01") for k in keys.tolist()]
        got = list(map(self.known.get, pieces))
        if None in got:
            learnt = self._learn({p for p, g in zip(pieces, got) if g is None})
            got = [g if g is not None else learnt[p] for p, g in zip(pieces, got)]
        ids = np.frombuffer(b"".join(got), self.dtype)
        n = np.zeros(len(used), np.int64)
        n[keys] = [len(g) for g in got]
        n //= self.dtype.itemsize
        start = np.cumsum(n) - n
        each = n[key]
        ends = np.cumsum(each)
        out = ids[np.repeat(start[key] - ends + each, each) + np.arange(int(ends[-1]) if len(ends) else 0)]
        ends = np.concatenate([[0], ends])[first] * self.dtype.itemsize
        raw = out.tobytes()
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield raw[a:b]

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of new parts: from the older table, or from their own parts, or from the tokenizer."""
        learnt, ask, inner = {}, [], {}
        for p in new:
            b = self.older.get(p)
            if b is not None:
                learnt[p] = b
            elif _WORD.fullmatch(p):  # one pre-token: the model's own input
                learnt[p] = self._word(p)
            elif len(cut := self._cut(p)) > 1:
                inner[p] = cut
            else:
                ask.append(p)
        if inner:  # a word with what stands before and after it
            have = {x: learnt.get(x) or self.known.get(x) for cut in inner.values() for x in cut}
            have |= self._learn({x for x, b in have.items() if b is None})
            for p, cut in inner.items():
                learnt[p] = b"".join(map(have.__getitem__, cut))
        learnt.update(zip(ask, self._library(ask)))
        if len(self.known) + len(learnt) > KEEP:
            self.older, self.known = self.known, {}
        self.known.update((p, b) for p, b in learnt.items() if len(p) <= LONGEST)
        return learnt

    def _cut(self, text: str) -> list[str]:
        return _SAFE.split(text) if any(t in text for t in self.special) else parts(text)

    def _word(self, p: str) -> bytes:
        if p.isascii():
            spelt = self.spelling[32] + p[1:] if p[0] == " " else p
        else:
            spelt = p.encode().decode("latin-1").translate(self.spelling)
        return array.array(self.code, [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array.array(self.code, e.ids).tobytes() for e in found]

    @cached_property
    def pieces(self) -> list[bytes]:
        """The bytes of each id: a vocabulary entry spells bytes with one printable character each."""
        spelt = {c: b for b, c in self.spelling.items()}
        out = [b""] * self.size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            out[i] = bytes(spelt[c] for c in token) if all(c in spelt for c in token) else token.encode()
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that the ids spell, special tokens included."""
        whole = b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, self.dtype).tolist()))
        return whole.decode("utf-8", errors="replace").encode("utf-8")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    return Encoder(path)


def trim() -> None:
    """Return what is free to the system."""
    pa.default_memory_pool().release_unused()
    if given := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        given(0)


def forget_encoders() -> None:
    """Drop the encoders that earlier tasks left in this Python worker, with all they have learnt, and return what is free to the system.

    Workers outlive their tasks; a task of another kind that needs its memory begins with this.
    """
    encoder.cache_clear()
    trim()


def slices(batch: pa.RecordBatch, column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Successive parts of a batch with about ``most`` bytes of a column, one row at least: what Python holds at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def groups(items: list, size, most: int = 2_000_000) -> Iterator[list]:
    """Successive runs of items whose sizes add up to about ``most``, one item at least."""
    run, total = [], 0
    for x in items:
        n = size(x)
        if run and total + n > most:
            yield run
            run, total = [], 0
        run.append(x)
        total += n
    if run:
        yield run
