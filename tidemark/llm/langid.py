"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

1. Features are counts of 1- to 3-character sequences of the lower-cased text (other ASCII than letters as spaces), hashed
   to ``DIMS`` numbers. Document frequencies are counted over all training documents.
2. Weights are learnt by follow-the-regularised-leader with an elastic net (L1 for sparsity, L2). The fit uses a bounded
   sample of the training rows: about ``ROWS`` rows (at most twice as many a pass), equal shares of the languages, drawn
   by a hash of doc_id. Fitted rows count with all their sequences. They stay in a table; every pass reads them in a
   seeded order, a partition at a time, so the driver holds the weights and a few rows.
3. A fifth of the sample isn't fitted but sets one temperature by its likelihood, so that scores are probabilities.
4. Every whole text is scored in its task with the weights (at most DIMS numbers a language).

Training sees text and lang of rows whose crc32(doc_id) mod 3 is not 1 and whose lang isn't null; lang, source and doc_id
are no inputs of a prediction.

Defined results: ``und`` with score 0 for a null text, one without a letter, and where there is nothing to learn from;
texts of any length are read whole, in stretches; repeated rows get equal results; an empty table gives an empty result;
further columns are kept, but for those named like an output.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.tokens import forget_encoders
from tidemark.session import release, staged, staged_so_far

DIMS, ROWS, EPOCHS, SEED = 1 << 15, 3000, 3, 42
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.004, 0.01
UNDEFINED = "und"
STRETCH = 1 << 20
_SPACED = np.where([chr(c).isalpha() for c in range(128)], np.arange(128), 32).astype(np.uint32)
_LETTER = regex.compile(r"\p{L}")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text and how often each occurs."""
    total, whole = np.zeros(DIMS, np.int64), f" {text.lower()} "
    for i in range(0, len(whole), STRETCH):  # sequences that start in the stretch; they may end in the next one
        c = np.frombuffer(whole[i : i + STRETCH + 2].encode("utf-32-le"), np.uint32)
        c = np.where(c < 128, _SPACED[np.minimum(c, 127)], c)
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        three = (two[:-1] * np.uint32(0x27D4EB2F) + c[2:]) * np.uint32(0x165667B1)
        for g in (c[:STRETCH] * np.uint32(0x85EBCA6B), two[:STRETCH] * np.uint32(0xC2B2AE35), three[:STRETCH]):
            total += np.bincount((g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17), minlength=DIMS)
    used = np.flatnonzero(total)
    return used.astype(np.int32), total[used]


def weighted(used: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length."""
    x = (1.0 + np.log(counts)) * idf[used]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


class Model:
    """Languages, idf, weights (DIMS by languages) and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNDEFINED, 0.0
        used, counts = features(text)
        p = _softmax(weighted(used, counts, self.idf) @ self.weights[used] / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def packed(used: np.ndarray, counts: np.ndarray) -> bytes:
    """Features of a text as bytes: numbers below DIMS in two, counts in four."""
    return used.astype("<u2").tobytes() + counts.astype("<u4").tobytes()


def unpacked(row: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The features that ``packed`` wrote."""
    n = len(row) // 6
    return np.frombuffer(row, "<u2", n).astype(np.int32), np.frombuffer(row, "<u4", n, 2 * n).astype(np.int64)


def fit(passes: Iterable[Iterable[tuple[np.ndarray, np.ndarray, int]]], n_langs: int) -> np.ndarray:
    """Weights by FTRL-proximal after all passes; rows are (features, values, language)."""
    z, n = np.zeros((DIMS, n_langs)), np.zeros((DIMS, n_langs))

    def solve(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for rows in passes:
        for used, x, y in rows:
            zu, nu = z[used], n[used]
            w = solve(zu, nu)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            root = np.sqrt(nu)
            z[used] = zu + g - (np.sqrt(nu + g * g) - root) / ALPHA * w
            n[used] = nu + g * g
    return solve(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the largest likelihood; one row's worth of the labels counts as noise, lest it goes to zero."""
    if not len(y):
        return 1.0
    noise = 1 / (len(y) + 2)
    goal = np.full(logits.shape, noise / logits.shape[1])
    goal[np.arange(len(y)), y] += 1 - noise
    tries = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [-(goal * np.log(np.maximum(_softmax(logits / t), 1e-12))).sum() for t in tries]
    return float(tries[int(np.argmin(loss))])


def held_out() -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, rows: int = ROWS, seed: int = SEED) -> Model:
    """A model from the training rows of ``docs``."""
    seen = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r.lang: r.n for r in seen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(DIMS), np.zeros((DIMS, 0)), 1.0)
    rate = {k: rows / len(langs) / n for k, n in sizes.items()}
    since = staged_so_far()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        df, n = np.zeros(DIMS, np.int64), 0
        names = ["lang", "doc_id", "used", "counts", "row"]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
        for b in batches:
            for doc_id, text, lang in zip(*[b.column(c) for c in ("doc_id", "text", "lang")]):
                used, counts = features(text.as_py())
                df[used] += 1
                n += 1
                doc_id, lang = doc_id.as_py(), lang.as_py()
                if zlib.crc32(f"{seed}|{doc_id}".encode()) < rate[lang] * 2**32:
                    row = [[lang], [doc_id], [None], [None], [packed(used, counts)]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names)
        used = np.flatnonzero(df)
        row = [[None], [n], [used.astype(np.int32)], [df[used]], [None]]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names)

    form = "lang string, doc_id long, used array<int>, counts array<long>, row binary"
    found = staged(
        seen.select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(run, form), "language-features"
    )
    parts = found.where("lang is null")
    total = parts.agg(F.sum("doc_id")).first()[0]
    df = parts.select(F.explode(F.arrays_zip("used", "counts")).alias("x")).groupBy("x.used").agg(F.sum("x.counts").alias("n"))
    idf = np.full(DIMS, np.log1p(total))
    for r in df.collect():  # at most DIMS rows
        idf[r.used] = np.log((1 + total) / (1 + r.n)) + 0.05
    sample = found.where("lang is not null").select("doc_id", "lang", "row")
    spare = F.crc32(F.concat(F.lit("spare|"), F.col("doc_id")).cast("binary")) % 5 == 0

    def read(part: DataFrame, turn: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        place = F.crc32(F.concat(F.lit(f"{seed}|{turn}|"), F.col("doc_id")).cast("binary"))
        for r in islice(part.orderBy(place, "doc_id", "lang", "row").toLocalIterator(), 2 * rows):
            used, counts = unpacked(r.row)
            yield used, weighted(used, counts, idf), langs.index(r.lang)

    weights = fit((read(sample.where(~spare), turn) for turn in range(EPOCHS)), len(langs))
    checked = [(x @ weights[used], y) for used, x, y in read(sample.where(spare), EPOCHS)]
    logits = np.array([x for x, _ in checked]).reshape(-1, len(langs))
    release(docs.sparkSession, since)
    return Model(langs, idf, weights.astype(np.float32), temperature(logits, np.array([y for _, y in checked], int)))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with lang_pred and score; trains on ``docs`` unless a model is given."""
    model = model or train(docs)
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(at)]
            cols = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    model = train(docs)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return identify(rows, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """``docs`` without rows that have no language or none with a probability of ``least``."""
    model = train(docs)
    rows = docs.select(F.struct(*docs.columns).alias("_row"))  # whatever its columns are called
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for b in batches:
            texts = pc.cast(pc.struct_field(b.column(0), [at]), pa.string())
            found = [model.predict(t.as_py()) for t in texts]
            keep = pa.array([lang != UNDEFINED and score >= least for lang, score in found], pa.bool_())
            yield b.filter(keep)

    return rows.mapInArrow(run, rows.schema).select("_row.*")
