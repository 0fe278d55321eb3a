"""Similarity memory: keys and values, scores, top-k read-out, usage, eviction, prototypes.

A stated query set is scored against all keys block by block: queries and keys are dealt to a grid of blocks, each pair of
blocks is a group of matrix products, and only the best k of a pair leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import half_up
from tidemark.operators.ranking import values_at


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def l2_normal(v: Column) -> Column:
    """A vector of unit length."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def top_k(queries: DataFrame, keys: DataFrame, k: int, query_block: int = 2_000, key_block: int = 20_000, step: int = 250) -> DataFrame:
    """query_id, key_id, score (dot product) and rank of the k best keys of each query; ties by key.

    ``queries`` and ``keys`` have id and vector. Both are dealt by id to blocks of about the given sizes, whose number grows with
    the data; each pair of blocks is a group that holds its queries and k candidates each, while its keys stream by,
    ``step`` at a time: a task holds scores of query_block x step.
    """
    n_q = max(1, -(-queries.count() // query_block))
    n_k = max(1, -(-keys.count() // key_block))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    spread = queries.select("id", "vector", F.lit(True).alias("is_query"), block(n_q).alias("q"), every(n_k).alias("k"))
    held = keys.select("id", "vector", F.lit(False).alias("is_query"), block(n_k).alias("k"), every(n_q).alias("q"))
    both = spread.unionByName(held).select("id", "vector", "is_query", (F.col("q") * n_k + F.col("k")).alias("pair"))
    both = both.repartition("pair").sortWithinPartitions("pair", F.desc("is_query"), "id")

    def best(scores: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best columns of each row, by score, then name; columns come in the order of names within ties."""
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, asked, ids, top, names = None, [], None, None, None

        def result() -> Iterator[pa.RecordBatch]:
            if top is not None:
                arrays = [np.repeat(ids, top.shape[1]), names.ravel(), top.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["query_id", "key_id", "score"])

        for b in batches:
            pairs, is_query = b.column("pair").to_numpy(), b.column("is_query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(pairs) != 0) | (np.diff(is_query.astype(int)) != 0)) + 1
            for first, last in zip([0, *cuts], [*cuts, b.num_rows]):
                if first == last:
                    continue
                if pairs[first] != pair:
                    yield from result()
                    pair, asked, ids, top, names = pairs[first], [], None, None, None
                part = b.slice(first, last - first)
                own = part.column("id").to_numpy()
                vectors = part.column("vector").flatten().to_numpy().astype(float).reshape(len(own), -1)
                if is_query[first]:
                    asked.append(vectors)
                    ids = own if ids is None else np.concatenate([ids, own])
                    continue
                if ids is None:
                    continue
                if len(asked) > 1:
                    asked = [np.vstack(asked)]
                for at in range(0, len(own), step):
                    scores = asked[0] @ vectors[at : at + step].T
                    cols = np.broadcast_to(own[at : at + step], scores.shape)
                    if top is not None:
                        scores, cols = np.hstack([top, scores]), np.hstack([names, cols])
                    top, names = best(scores, cols)
        yield from result()

    found = both.mapInArrow(run, "query_id long, key_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def selective_top_k(queries: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """query_id, key_id, score and rank of the k keys most alike: the negative squared distance, weighted by each query's ``selection``
    and times each key's ``shrinkage``, over the root of the vectors' length.

    The weighted distance is one product of longer vectors, so that ``top_k`` does the rest: -e, 2eq and -eqq on the query's side
    meet kk, k and 1 on the key's.
    """
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    q, e, v = double("vector"), double("selection"), double("vector")
    weighted = F.zip_with(q, e, lambda x, w: x * w)
    asked = F.concat(F.transform(e, lambda w: -w), F.transform(weighted, lambda x: x * 2), F.array(-dot(weighted, q)))
    factor = F.col("shrinkage").cast("double") / F.sqrt(F.size("vector").cast("double"))
    held = F.transform(F.concat(F.transform(v, lambda x: x * x), v, F.array(F.lit(1.0))), lambda x: x * factor)
    return top_k(queries.select("id", asked.alias("vector")), keys.select("id", held.alias("vector")), k)


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and products of all pairs of components: partial sums a task, d * d numbers to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = b.column(vector).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                one = np.column_stack([np.ones(len(x)), x])
                total = one.T @ one if total is None else total + one.T @ one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "s"])

    rows = df.where(F.col(vector).isNotNull()).select(vector).mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    size = int(np.sqrt(len(rows)) + 0.5)
    whole = np.zeros(len(rows))
    whole[[r.i for r in rows]] = [r.s for r in rows]
    whole = whole.reshape(size, size)
    return int(whole[0, 0]), whole[0, 1:], whole[1:, 1:]


def principal_components(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the k components (rows) of the largest variances and these; a component's largest part is positive."""
    n, sums, products = moments(df, vector)
    if n < 2:
        return sums, np.zeros((0, len(sums))), np.zeros(0)
    mean = sums / n
    values, ways = np.linalg.eigh((products - n * np.outer(mean, mean)) / (n - 1))
    ways = ways.T[::-1][:k]
    ways = ways * np.sign(ways[np.arange(len(ways)), np.abs(ways).argmax(1)])[:, None]
    return mean, ways, values[::-1][:k]


def project(df: DataFrame, vector: str, mean: np.ndarray, ways: np.ndarray) -> DataFrame:
    """``df`` with ``projected``, a vector's places along the components."""
    number = lambda x: F.array(*[F.lit(float(v)) for v in x])
    centred = F.zip_with(vector, number(mean), lambda x, m: x.cast("double") - m)
    return df.withColumn("projected", F.array(*[dot(centred, number(w)) for w in ways]))


def softmax_weights(found: DataFrame, scale: float = 1.0) -> DataFrame:
    """``found`` with ``weight``: exponentials of the scores, normalised a query."""
    e = F.exp(F.col("score") * scale)
    return found.withColumn("weight", e / F.sum(e).over(Window.partitionBy("query_id")))


def read_out(weights: DataFrame, values: DataFrame) -> DataFrame:
    """query_id, label and share: values summed by weight; ``values`` has key_id and label."""
    joined = weights.join(values, "key_id")
    return joined.groupBy("query_id", "label").agg(F.sum("weight").alias("share"))


def usage(weights: DataFrame, keys: DataFrame, n_queries: int) -> DataFrame:
    """key_id and usage (mean weight over the queries) of every key."""
    sums = weights.groupBy("key_id").agg(F.sum("weight").alias("_u"))
    return keys.join(sums, "key_id", "left").select("key_id", (F.coalesce("_u", F.lit(0.0)) / (n_queries + 1e-7)).alias("usage"))


def evict(used: DataFrame, size: int) -> DataFrame:
    """Keys above the usage of the last that has to go; ties go too."""
    n = used.count()
    if n <= size:
        return used
    edge = values_at(used, "usage", [n - size - 1])[0]
    return used.where(F.col("usage") > edge)


def prototypes(used: DataFrame, n: int) -> DataFrame:
    """The n most used keys."""
    return used.orderBy(F.desc("usage"), "key_id").limit(n)


def neighbour_similarity(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Cosine of each vector with that of the next key."""
    other = df.select((F.col(key) - 1).alias(key), F.col(vector).alias("_v"))
    a, b = F.col(vector), F.col("_v")
    cosine = dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return df.join(other, key).select(key, half_up(cosine, 3).alias("cosine"))
