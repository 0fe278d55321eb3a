"""Ranked lexical search with block-max pruning.

``build`` cuts documents into blocks, runs of at most ``DOCUMENTS`` documents or ``BYTES`` of text in table order. A row of the
index is a block: its forward part (documents, terms and occurrences) and, for each of its terms, the number of documents
and the largest share that the term adds to any of them.

``search`` takes queries in blocks of about ``QUERY_TERMS`` terms, the only part that is broadcast:

1. Document frequencies of the query's terms are summed over blocks.
2. A query's bound on a block is the sum of its terms' weights times their maxima. The ``SEEDS`` blocks of the highest bounds
   are scored first; the k-th best score found there is the query's threshold.
3. Blocks are then sorted by what their bounds leave above the thresholds, and forward parts are scored until a bound drops
   below the threshold, which rises on the way. Equal scores can still enter, so ties are exact.

Sums are 64-bit integers. Defined results: documents whose text is null or has no term aren't counted and never found; queries
without a term, and terms that no document holds, give no rows; rows of one item_id are one query; repeated documents are
documents of their own; among equal scores null doc_ids come last; texts of any length are read whole; empty tables give an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.sealed import names_in, names_out, narrow, opened, seal
from tidemark.llm.tokens import slices
from tidemark.operators.ranking import prefix_sums
from tidemark.session import staged

DOCUMENTS, BYTES = 128, 1_000_000
QUERY_TERMS, SEEDS = 200_000, 4

#: A-Z in lower case; bytes of terms stay, all others become a space. Bytes from 128 on are parts of characters of terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_IN_TERM = np.array([_FOLD[b] != 32 for b in range(256)])
_LAST = np.iinfo(np.int64).max

_FORM = "block long, doc_ids array<long>, forward binary, terms binary, dfs binary, tops binary"


class Index(NamedTuple):
    """Blocks, documents with a term, and occurrences of all terms."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, repeats included."""
    return (text or "").encode().translate(_FOLD).split()


def _texts(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and occurrences of all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for rows in slices(b, "text"):
                column = rows.column("text").cast(pa.large_binary())
                ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
                inside = np.append(_IN_TERM[data], False)
                first = inside.copy()
                first[1:] &= ~inside[:-1]
                begins = ends[:-1] - ends[0]
                first[begins] = inside[begins] & (ends[1:] > ends[:-1])  # a text doesn't continue the one before it
                sums = np.concatenate([[0], np.cumsum(first)])
                each = sums[ends[1:] - ends[0]] - sums[begins]
                n += int((each > 0).sum())
                total += int(each.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    row = _texts(docs, "doc_id").select("text").mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def build(docs: DataFrame, documents: int = DOCUMENTS, most: int = BYTES) -> Index:
    """The index of all documents, written to the shared folder."""
    n_docs, n_terms = totals(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = made = part = 0

        def flush() -> pa.RecordBatch:
            names: dict[bytes, int] = {}
            ords = np.array([names.setdefault(t, len(names)) for _, counts in held for t in counts], np.int64)
            tfs = np.array([n for _, counts in held for n in counts.values()], np.int64)
            scales = [10 + 90 * sum(counts.values()) * n_docs // n_terms for _, counts in held]
            each = np.array([len(counts) for _, counts in held])
            share = 10**9 * tfs // (1000 * tfs + 8 * np.repeat(np.array(scales, np.int64), each))
            tops = np.zeros(len(names), np.int64)
            np.maximum.at(tops, ords, share)
            values = (seal(np.array(scales, np.int64), narrow(each), narrow(ords), narrow(tfs)), seal(*names_out(pa.array(list(names), pa.large_binary()))))
            values += (seal(narrow(np.bincount(ords, minlength=len(names)))), seal(narrow(tops)))
            row = [(part << 32) + made, [i for i, _ in held], *values]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [c.split()[0] for c in _FORM.split(", ")])

        for b in batches:
            part = b.column("part")[0].as_py() if b.num_rows else part
            for rows in slices(b, "text"):
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                    counts = Counter(terms(text))
                    if not counts:
                        continue
                    held.append((doc_id, counts))
                    size += len(text)
                    if len(held) >= documents or size >= most:
                        yield flush()
                        held, size, made = [], 0, made + 1
        if held:
            yield flush()

    rows = _texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").withColumn("part", F.spark_partition_id().cast("long"))
    return Index(staged(rows.mapInArrow(run, _FORM), "search-blocks", "uncompressed"), n_docs, n_terms)


class _Queries:
    """A block of queries as arrays: pairs of query and term by query."""

    def __init__(self, lists: list[list[bytes]]):
        names = sorted({t for x in lists for t in x})
        place = {t: k for k, t in enumerate(names)}
        self.names = pa.array(names, pa.large_binary())
        self.query = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.term = np.array([place[t] for x in lists for t in x], np.int64)
        self.first = np.searchsorted(self.query, np.arange(len(lists)))
        self.n = len(lists)
        self.weight = np.zeros(len(names), np.int64)
        self.order = np.argsort(self.term, kind="stable")  # the pairs by term

    def places(self, terms: bytes) -> np.ndarray:
        """The number of each of a block's terms among the queries', or -1."""
        found = pc.index_in(names_in(*opened(terms), pa.large_binary()), value_set=self.names)
        return pc.fill_null(found, -1).to_numpy(zero_copy_only=False)

    def bounds(self, at: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """What a document of a block can score at most, query by query."""
        value = np.zeros(len(self.weight), np.int64)
        value[at[at >= 0]] = tops[at >= 0]
        return np.add.reduceat((value * self.weight)[self.term], self.first)

    def scores(self, forward: bytes, at: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Scores of a block's documents (rows) for the active queries (columns; the others stay 0)."""
        scales, each, ords, tfs = opened(forward)
        term = at[ords]
        doc = np.repeat(np.arange(len(scales)), each)
        known = term >= 0
        term, doc, tf = term[known], doc[known], tfs[known].astype(np.int64)
        add = 10**9 * tf // (1000 * tf + 8 * scales[doc]) * self.weight[term]
        pairs = self.order[active[self.query[self.order]]]  # of active queries, by term
        begin = np.searchsorted(self.term[pairs], np.arange(len(self.weight) + 1))
        each = np.diff(begin)[term]
        entry = np.repeat(np.arange(len(term)), each)
        pair = pairs[np.repeat(begin[term] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))]
        out = np.zeros((len(scales), self.n), np.int64)
        np.add.at(out, (doc[entry], self.query[pair]), add[entry])
        return out


class _Best:
    """The k best (score, doc_id) of each query so far, and each query's threshold."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, np.maximum(floor, 1)
        self.rows = np.zeros((4, 0), np.int64)  # query, score, doc_id, whether it is null
        self.new: list[np.ndarray] = []
        self.size = 0

    def add(self, scores: np.ndarray, doc_ids: list) -> None:
        doc, query = np.nonzero(scores >= self.floor)
        if len(doc):
            ids = np.array([_LAST if i is None else i for i in doc_ids], np.int64)
            null = np.array([i is None for i in doc_ids], np.int64)
            self.new.append(np.array([query, scores[doc, query], ids[doc], null[doc]]))
            self.size += len(doc)
            if self.size > 4 * self.k * len(self.floor):
                self.settle()

    def settle(self) -> np.ndarray:
        rows = np.concatenate([self.rows, *self.new], 1)
        rows = rows[:, np.lexsort((rows[2], rows[3], -rows[1], rows[0]))]
        rank = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        self.rows, self.new, self.size = rows[:, rank < self.k], [], 0
        last = rows[:, rank == self.k - 1]
        self.floor[last[0]] = np.maximum(self.floor[last[0]], last[1])
        return self.rows


def _found(rows: np.ndarray) -> pa.RecordBatch:
    ids = pa.array(rows[2], mask=rows[3].astype(bool))
    return pa.RecordBatch.from_arrays([pa.array(rows[0]), ids, pa.array(rows[1])], ["query", "doc_id", "score"])


_FOUND = "query long, doc_id long, score long"


def _best_of(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search_block(index: Index, queries: list, k: int, seeds: int) -> DataFrame:
    """item_id, rank, doc_id and score of one block of queries, rows of item_id and terms."""
    spark = index.blocks.sparkSession
    q = _Queries([r.terms for r in queries])
    shared = spark.sparkContext.broadcast(q)  # about QUERY_TERMS terms

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.weight), np.int64)
        for b in batches:
            for names, dfs in zip(b.column("terms"), b.column("dfs")):
                at = shared.value.places(names.as_py())
                total[at[at >= 0]] += opened(dfs.as_py())[0][at >= 0]  # a term is in a block once
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["term", "df"])

    df = np.zeros(len(q.weight), np.int64)
    for r in index.blocks.select("terms", "dfs").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    q.weight[:] = [math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()]
    weighted = spark.sparkContext.broadcast(q)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = weighted.value
        best = np.zeros((3, 0), np.int64)  # query, bound, block
        for b in batches:
            new = [best]
            for block, names, tops in zip(b.column("block").to_pylist(), b.column("terms"), b.column("tops")):
                bound = q.bounds(q.places(names.as_py()), opened(tops.as_py())[0])
                some = np.flatnonzero(bound)
                new.append(np.array([some, bound[some], np.full(len(some), block)]))
            best = np.concatenate(new, 1)
            best = best[:, np.lexsort((best[2], -best[1], best[0]))]
            best = best[:, np.arange(best.shape[1]) - np.searchsorted(best[0], best[0]) < seeds]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["query", "bound", "block"])

    highest = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    bounded = index.blocks.select("block", "terms", "tops").mapInArrow(bounds, "query long, bound long, block long")
    first = bounded.withColumn("r", F.row_number().over(highest)).where(F.col("r") <= seeds)
    chosen = first.groupBy("block").agg(F.collect_list("query").alias("queries"))  # SEEDS rows a query at most, so it may be broadcast

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = weighted.value
        best = _Best(np.zeros(q.n, np.int64), k)
        for b in batches:
            for forward, names, ids, chosen in zip(*[b.column(c) for c in ("forward", "terms", "doc_ids", "queries")]):
                active = np.zeros(q.n, bool)
                active[chosen.as_py()] = True
                best.add(q.scores(forward.as_py(), q.places(names.as_py()), active), ids.as_py())
        yield _found(best.settle())

    floor = np.zeros(q.n, np.int64)
    start = index.blocks.join(F.broadcast(chosen), "block").mapInArrow(seeded, _FOUND)
    for r in _best_of(start, k).where(F.col("rank") == k).select("query", "score").collect():  # one row a query at most
        floor[r["query"]] = r.score
    floors = spark.sparkContext.broadcast(floor)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, best = weighted.value, _Best(floors.value.copy(), k)
        for b in batches:
            forward, names, tops, ids = (b.column(c) for c in ("forward", "terms", "tops", "doc_ids"))
            bound = [q.bounds(q.places(n.as_py()), opened(t.as_py())[0]) for n, t in zip(names, tops)]
            above = np.array([(x - best.floor).max() for x in bound])
            for i in np.argsort(-above, kind="stable").tolist():
                if above[i] < 0:
                    break  # sorted: no later block reaches a threshold
                active = bound[i] >= best.floor
                if active.any():
                    best.add(q.scores(forward[i].as_py(), q.places(names[i].as_py()), active), ids[i].as_py())
            best.settle()
        yield _found(best.settle())

    items = spark.createDataFrame([(n, r.item_id) for n, r in enumerate(queries)], "query long, item_id long")
    ranked = _best_of(index.blocks.mapInArrow(score, _FOUND), k).join(F.broadcast(items), "query")
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(index: Index, items: DataFrame, k: int = 10, seeds: int = SEEDS, query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in slices(b, "text"):
                found = [list(dict.fromkeys(terms(t))) for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("item_id"), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    read = _texts(items.withColumn("item_id", F.col("item_id").cast("long")), "item_id").mapInArrow(run, "item_id long, terms array<binary>")
    lists = read.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
    sized = lists.withColumn("n", F.size("terms").cast("long")).where("n > 0")
    dealt = prefix_sums(sized, "item_id", ["n"]).withColumn("_q", F.expr(f"(run_n - n) div {query_terms}"))
    spark, found = items.sparkSession, []
    for (number,) in sorted(dealt.select("_q").distinct().collect()):
        queries = dealt.where(F.col("_q") == number).select("item_id", "terms").collect()  # query_terms and one item at most
        found.append(_search_block(index, queries, k, seeds))
    if not found or not index.n_terms:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if len(found) == 1:
        return found[0]
    done = [staged(x, "search-results") for x in found]
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ten best documents of each item."""
    return search(build(docs), items)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
  o AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
  f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM o GROUP BY ALL),
  c AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
  w AS (SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term),
  i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
  s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
    FROM i JOIN f USING (term) JOIN w USING (term), c GROUP BY item_id, r, doc_id),
  k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""
