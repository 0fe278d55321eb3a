"""Quality rules with an isolation forest on rule statistics.

1. One pass over the texts gives each document's rule statistics: words, characters in words, symbols, repeated lines and
   words in repeated 3-word windows. Only these numbers are kept.
2. Two base rules fail a document: fewer than ``LEAST_WORDS`` words, or more than half of its words repeated.
3. Of the rest, bounded shares (symbols a word, repeated lines a line and so on) go into an isolation forest: trees over random
   subsamples of good labelled rows split a random share at a random place of the whole corpus's exact range; a document that
   few splits isolate, one with a short mean path, is anomalous. Each tree sees ``SUBSAMPLE`` rows, as the method has it.
   Ranges are taken over all documents, and every document is scored. Subsamples of all rows, and splits over a node's own
   rows, hold junk often enough to take it for ordinary: with 1 % of good rows to spare they find a tenth of it.
4. All labelled rows set the threshold: of the scores that reject at most ``SPARE`` of the good labelled rows, the one with
   the best balance of bad rows found and good rows spared, from exact counts by score. Without good and bad labels all that the
   base rules pass stay. The driver gets no more rows than the trees' subsamples hold, drawn from all good labelled rows.

Defined results: a null or empty text has no words and fails; texts of any length are read whole; repeated rows and ties
get equal scores; an empty table gives an empty result; labels of unknown documents and null labels have no effect;
further columns are ignored by ``statistics``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import prefix_sums
from tidemark.session import staged

LEAST_WORDS = 50
TREES, SUBSAMPLE, DEPTH, SEED = 100, 256, 16, 42
#: Share of good labelled rows that a threshold may reject.
SPARE = 0.01
SYMBOLS = "#*$%&|<>"
_WORD = re.compile("[^\x20\x09-\x0d]+")
_NO_SYMBOLS = str.maketrans("", "", SYMBOLS)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FORM = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeat_words(words: list[str], n: int = 3) -> int:
    """Words that stand in a window of ``n`` words found twice or more."""
    rows = len(words) - n + 1
    if rows < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = h[:rows].copy()
    for i in range(1, n):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[i : i + rows]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    seen: dict[tuple, int] = {}
    twin = np.zeros(rows, bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    hit = np.zeros(rows, bool)
    for i in np.flatnonzero(twin).tolist():  # equal hashes are compared as words
        w = tuple(words[i : i + n])
        if w in seen:
            hit[i] = hit[seen[w]] = True
        else:
            seen[w] = i
    cover = np.zeros(len(words), bool)
    for i in range(n):
        cover[i : i + rows] |= hit
    return int(cover.sum())


def text_statistics(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word) of a text."""
    text = text or ""
    words = _WORD.findall(text)
    full = [x for x in text.split("\n") if _WORD.search(x)]
    symbols = len(text) - len(text.translate(_NO_SYMBOLS))
    return len(words), sum(map(len, words)), symbols, len(full) - len(set(full)), repeat_words(words), len(full)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the rule statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_statistics(t.as_py()) for t in b.column("text")]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", *STATS, "n_lines"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, _FORM)


def failed() -> F.Column:
    """The base rules."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def shares(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Features of the forest between 0 and 1, one row a document; none depends on the length alone."""
    words = np.maximum(stats["n_words"], 1)
    return np.column_stack(
        [
            stats["word_chars"] / (stats["word_chars"] + 8 * words),
            np.sqrt(stats["n_symbols"] / (stats["n_symbols"] + words)),  # the root spreads small shares
            np.sqrt(stats["n_dup_lines"] / np.maximum(stats["n_lines"], 1)),
            np.sqrt(stats["n_repeat_words"] / words),
        ]
    )


def _shares() -> list[F.Column]:
    """The same as columns."""
    words, of = F.greatest("n_words", F.lit(1)), lambda c, n: F.sqrt(F.col(c) / n)
    return [
        F.col("word_chars") / (F.col("word_chars") + 8 * words),
        of("n_symbols", F.col("n_symbols") + words),
        of("n_dup_lines", F.greatest("n_lines", F.lit(1))),
        of("n_repeat_words", words),
    ]


def _normal(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of a search that fails in a tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


class Forest:
    """Trees as arrays: split feature (-1 for a leaf), place, left child (the right one follows), path length at leaves.

    A split is drawn over the part of the corpus's range (``low`` to ``high``) that is left at its node, not over the range
    of the rows seen there: the rows are good ones, and what lies beyond all of them has to be cut off early too.
    """

    def __init__(self, x, low, high, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED, depth: int = DEPTH):
        rng = np.random.default_rng(seed)
        self.sample = max(2, min(subsample, len(x)))
        self.trees = []
        for _ in range(trees):
            rows = x[rng.permutation(len(x))[: self.sample]]
            feature, place, left, path = [-1], [0.0], [0], [0.0]
            todo = [(0, rows, 0, np.array(low, float), np.array(high, float))]
            while todo:
                k, own, deep, lo, hi = todo.pop()
                usable = np.flatnonzero(hi > lo)
                if deep >= depth or len(own) <= 1 or not len(usable):
                    path[k] = deep + float(_normal(len(own)))
                    continue
                f = int(rng.choice(usable))
                at = float(rng.uniform(lo[f], hi[f]))
                feature[k], place[k], left[k] = f, at, len(feature)
                below, above = hi.copy(), lo.copy()
                below[f] = above[f] = at
                for part in ((own[own[:, f] <= at], lo, below), (own[own[:, f] > at], above, hi)):
                    todo.append((len(feature), part[0], deep + 1, part[1], part[2]))
                    feature.append(-1)
                    place.append(0.0)
                    left.append(0)
                    path.append(0.0)
            self.trees.append((np.array(feature), np.array(place), np.array(left), np.array(path)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row: near 1 for short paths, about 0.5 for ordinary ones."""
        total = np.zeros(len(x))
        for feature, place, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                open_ = np.flatnonzero(f >= 0)
                if not len(open_):
                    break
                k = at[open_]
                at[open_] = left[k] + (x[open_, f[open_]] > place[k])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(float(_normal(self.sample)), 1e-9))


def calibrate(marked: DataFrame, spare: float = SPARE) -> float:
    """Scores above this are rejected: the best balance of bad found and good spared that rejects few good rows.

    ``marked`` has score and quality of all labelled rows; they are counted by score and summed by ranges, and one row reaches the driver.
    """
    good = (F.col("quality") > 0).cast("long")
    by = marked.groupBy("score").agg(F.sum(good).alias("good"), F.sum(1 - good).alias("bad"))
    summed = staged(prefix_sums(by, "score", ["good", "bad"], descending=True), "rule-balance")
    all_good, all_bad = summed.agg(F.sum("good"), F.sum("bad")).first()
    if not all_good or not all_bad:
        return np.inf
    lost, found = ((F.col(f"run_{c}") - F.col(c)) / F.lit(n).cast("double") for c, n in (("good", all_good), ("bad", all_bad)))
    best = summed.where(lost <= spare).select("score", (found - lost).alias("gain")).orderBy(F.desc("gain"), "score").first()
    return best.score if best.gain > 0 else np.inf


def _numpy(rows: DataFrame) -> dict[str, np.ndarray]:
    t = rows.toArrow()
    return {c: t.column(c).to_numpy() for c in t.column_names}


def judge(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    trees: int = TREES,
    subsample: int = SUBSAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, statistics, base_failed, score and kept of every row."""
    stats = staged(statistics(docs, text), "rule-statistics")
    form = f"{_FORM}, base_failed boolean, score double"
    passed = stats.where(~failed())
    marks = labels.where("quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")

    def drawn(rows: DataFrame) -> np.ndarray:
        """What the trees' subsamples may hold, from all rows: the first in seeded order."""
        first = rows.orderBy(F.xxhash64(F.lit(seed), "doc_id", *STATS), "doc_id").limit(trees * subsample)
        return shares(_numpy(first.select(*STATS, "n_lines")))

    fit = drawn(passed.join(marks.where("quality > 0"), "doc_id"))
    if not len(fit):  # nothing is known to be good: any rows show what is ordinary
        fit = drawn(passed)
    if not len(fit):
        return stats.withColumns({"base_failed": failed(), "score": F.lit(0.0), "kept": ~failed()})
    ranges = passed.agg(*[f(c).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i, c in enumerate(_shares())]).first()
    low, high = np.array(ranges).reshape(2, -1)
    forest = Forest(fit, low, high, trees, subsample, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = forest.score(shares({c: b.column(c).to_numpy() for c in (*STATS, "n_lines")}))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, "score"])

    scored = staged(stats.withColumn("base_failed", failed()).mapInArrow(run, form), "rule-scores")
    limit = calibrate(scored.where("not base_failed").join(marks, "doc_id").select("score", "quality"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") <= limit))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns and the score."""
    return judge(docs, labels).select("doc_id", *STATS, "base_failed", "kept", "score")

