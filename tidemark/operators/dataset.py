"""Dataset verbs: filters, splits, labels, samples, padding. Random verbs draw by a seeded hash, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import group_ranks, prefix_sums


def draw(seed: int, *cols: str) -> Column:
    """32 bits of an MD5 digest of a seed and a key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def cut_point(df: DataFrame, n: int, seed: int, key: str) -> tuple[int, object] | None:
    """The draw and key of the n-th row in seeded order.

    Draws are even, so counts of their upper 16 bits (at most 65,536 rows to the driver) name the bucket that holds the n-th
    row, and only its keys are ordered.
    """
    if n <= 0:
        return None
    drawn = df.select(draw(seed, key).alias("d"), F.col(key).alias("k")).withColumn("b", F.shiftright("d", 16))
    for bucket, size in sorted((r.b, r.n) for r in drawn.groupBy("b").agg(F.count("*").alias("n")).collect()):
        if n <= size:
            break
        n -= size
    else:
        return None
    inside = drawn.where(F.col("b") == bucket).groupBy("d", "k").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.orderBy("d", "k"))  # one of 65,536 buckets
    top = inside.withColumn("run", so_far).where(F.col("run") >= n).orderBy("run").first()
    return top.d, top.k


def first_in_order(df: DataFrame, n: int, seed: int, key: str) -> Column:
    """Whether a row is among the first n in seeded order."""
    at = cut_point(df, n, seed, key)
    if at is None:
        return F.lit(n > 0)
    d = draw(seed, key)
    return (d < at[0]) | ((d == at[0]) & (F.col(key) <= at[1]))


def split_by_rand_pct(df: DataFrame, pct: float, seed: int, key: str) -> DataFrame:
    """``df`` with ``split``: the first int(pct * n) rows in seeded order are ``valid``."""
    valid = first_in_order(df, int(pct * df.count()), seed, key)
    return df.withColumn("split", F.when(valid, "valid").otherwise("train"))


def split_subsets(df: DataFrame, train: float, valid: float, seed: int, key: str) -> DataFrame:
    """The first int(train * n) rows in seeded order, and the last int(valid * n); the others go."""
    n = df.count()
    head, rest = first_in_order(df, int(train * n), seed, key), first_in_order(df, n - int(valid * n), seed, key)
    split = F.when(head, "train").when(~rest, "valid")
    return df.withColumn("split", split).where("split is not null")


def split_by_list(df: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """``valid`` for the keys of a table."""
    marked = valid.select(key).distinct().withColumn("_v", F.lit(True))
    return df.join(marked, key, "left").withColumn("split", F.when(F.col("_v"), "valid").otherwise("train")).drop("_v")


def split_from_column(df: DataFrame, column: Column) -> DataFrame:
    """``valid`` where a column is true."""
    return df.withColumn("split", F.when(column, "valid").otherwise("train"))


def use_partial(df: DataFrame, pct: float, seed: int, key: str) -> DataFrame:
    """Exactly int(pct * n) rows."""
    return df.where(first_in_order(df, int(pct * df.count()), seed, key))


def filter_folder(df: DataFrame, path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows by the first part of a relative path."""
    top = F.get(F.split(path, "/"), F.lit(0))
    keep = F.lit(True)
    if include:
        keep = keep & top.isin(*include)
    if exclude:
        keep = keep & ~top.isin(*exclude)
    return df.where(keep)


def filter_rand(df: DataFrame, p: float, seed: int, key: str) -> DataFrame:
    """Each row with probability p."""
    return df.where(draw(seed, key) < int(p * 2**32))


def sieve(df: DataFrame, n: str, start: int, end: int, key: str | None = None, min_size: int = 0) -> DataFrame:
    """Rows outside [start, end), ``n`` from 0; with a ``key``, an end of 0 or below counts from each key's last row, and keys of at most
    ``min_size`` rows stay whole."""
    if key is None:
        if end <= 0 or min_size:
            raise ValueError("an end of 0 or below and min_size need a key")
        return df.where((F.col(n) < start) | (F.col(n) >= end))
    sizes = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_size"))  # a hot key is counted before rows move
    stop = F.col("_size") + end if end <= 0 else F.lit(end)
    held = df.join(sizes, df[key].eqNullSafe(sizes["_key"]))
    return held.where((F.col("_size") <= min_size) | (F.col(n) < start) | (F.col(n) >= stop)).drop("_key", "_size")


def drop_if(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition isn't true."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def label_from_re(text: Column, pattern: str) -> Column:
    """Group 1 of a pattern; a row without a match is an error when it is read."""
    ok = F.assert_true(text.rlike(pattern), F.concat(F.lit(f"no match of {pattern} in "), text))
    return F.when(ok.isNull(), F.regexp_extract(text, pattern, 1))


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``code``: the label's rank among all labels, from 0."""
    classes = prefix_sums(df.where(F.col(label).isNotNull()).select(label).distinct(), label)
    return df.join(classes.select(label, (F.col("rank") - 1).alias("code")), label, "left")


def drop_unknown(df: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    """Rows whose label is among the classes."""
    return df.join(classes.select(label).distinct(), label, "left_semi")


def multi_labels(df: DataFrame, labels: Column, classes: list[str]) -> DataFrame:
    """``codes`` (sorted places in ``classes``, unknown labels dropped) and ``hot`` (a 0/1 vector)."""
    known = F.array(*[F.lit(c) for c in classes])
    codes = F.array_sort(F.array_distinct(F.filter(F.transform(labels, lambda x: F.array_position(known, x) - 1), lambda i: i >= 0)))
    hot = F.transform(F.sequence(F.lit(0), F.lit(len(classes) - 1)), lambda i: F.array_contains("codes", i.cast("long")).cast("long"))
    return df.withColumn("codes", codes).withColumn("hot", hot)


def decode_hot(hot: Column) -> Column:
    """The places of a 0/1 vector that are 1."""
    places = F.transform(hot, lambda x, i: F.when(x == 1, i.cast("long")))
    return F.filter(places, lambda i: i.isNotNull())


def by_length(df: DataFrame, size: Column, batch: int, seed: int, key: str, chunk: int = 50) -> DataFrame:
    """``df`` with ``batch``: rows in seeded order, sorted by size within chunks of ``chunk`` batches.

    Rows are dealt to chunks by hash, so no task orders more than a chunk's rows.
    """
    n_chunks = max(1, round(df.count() / (batch * chunk)))
    dealt = df.withColumn("_chunk", draw(seed, key) % n_chunks)
    w = Window.partitionBy("_chunk").orderBy(size.desc(), key)
    place = F.floor((F.row_number().over(w) - 1) / batch).cast("long")
    return dealt.withColumn("batch", F.concat_ws("-", F.col("_chunk").cast("string"), place.cast("string"))).drop("_chunk")


def batch_turns(df: DataFrame, size: str, seed: int, key: str) -> DataFrame:
    """Batched ``df`` with ``turn`` (from 0), the order of its batches: that of the longest row first, so that a batch too
    large for memory fails at once, then the others in seeded order.

    Of equally long rows that with the smallest key counts. Only batches are ranked, by ranges.
    """
    first = df.orderBy(F.col(size).desc(), key).select(F.col("batch").alias("_first")).limit(1)
    turns = df.select("batch").distinct().join(F.broadcast(first), F.col("batch") == F.col("_first"), "left")  # one row
    place = F.concat_ws("|", F.when(F.col("_first").isNotNull(), "0").otherwise("1"), F.md5(F.concat_ws("|", F.lit(str(seed)), "batch")), "batch")
    ranked = prefix_sums(turns.select("batch", place.alias("_place")), "_place").select("batch", (F.col("rank") - 1).alias("turn"))
    return df.join(ranked, "batch")


def pad(df: DataFrame, ids: str, batch: str, pad_id: int = 1, first: bool = True) -> DataFrame:
    """``df`` with ``padded``: ids filled to the longest of their batch."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    fill = F.array_repeat(F.lit(pad_id).cast("long"), (longest - F.size(ids)).cast("int"))
    return df.withColumn("padded", F.concat(fill, F.col(ids)) if first else F.concat(F.col(ids), fill))


def split_by_folder(df: DataFrame, path: Column, train: str = "train", valid: str = "valid") -> DataFrame:
    """``split`` by the first of a path's folders that is one of the two names; rows with neither go."""
    part = F.get(F.filter(F.split(path, "/"), lambda x: x.isin(train, valid)), F.lit(0))
    return df.withColumn("split", F.when(part == train, "train").when(part == valid, "valid")).where("split is not null")


def split_by_files(df: DataFrame, path: Column, names: DataFrame, name: str) -> DataFrame:
    """``valid`` where the last part of a path is among the names of a table."""
    held = names.select(F.col(name).alias("_name"), F.lit(True).alias("_v")).distinct()
    marked = df.withColumn("_name", F.element_at(F.split(path, "/"), -1)).join(held, "_name", "left")
    return marked.withColumn("split", F.when(F.col("_v"), "valid").otherwise("train")).drop("_name", "_v")


def mask_split(df: DataFrame, mask: Column) -> tuple[DataFrame, DataFrame]:
    """Rows under a mask, and all others."""
    inside = F.coalesce(mask, F.lit(False))
    return df.where(inside), df.where(~inside)


def random_split(df: DataFrame, pct: float, seed: int, key: str) -> tuple[DataFrame, DataFrame]:
    """Each row goes to the second part with probability ``pct``."""
    return mask_split(df, draw(seed, key) >= int(pct * 2**32))


def label_from_folder(path: Column) -> Column:
    """The folder that a file lies in; null where there is none."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def added(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items of both, columns by name; what one side lacks is null."""
    return a.unionByName(b, allowMissingColumns=True)


def uniqued(df: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """Different values and their ``place`` from 0: by first appearance in an order, or sorted."""
    first = df.groupBy(column).agg(F.min(order if order else column).alias("_first"))
    ranked = prefix_sums(first, "_first" if order else column)
    return ranked.select(column, (F.col("rank") - 1).alias("place"))


def remapped(df: DataFrame, label: str, classes: int) -> DataFrame:
    """``df`` with ``dense`` (labels numbered from 1 in order, 0 for the background label 0) and ``planes``, one 0/1 for each class."""
    known = prefix_sums(df.where(F.col(label) > 0).select(label).distinct(), label).select(label, F.col("rank").alias("_d"))
    dense = df.join(known, label, "left").withColumn("dense", F.coalesce("_d", F.lit(0)).cast("long")).drop("_d")
    return dense.withColumn("planes", F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda k: (F.col("dense") == k).cast("long")))


def keep_if(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition is true."""
    return df.where(condition)


def longest_first(df: DataFrame, size: str, key: str) -> DataFrame:
    """``df`` with ``place`` from 0: rows by falling size, then key, numbered by ranges."""
    ranked = group_ranks(df.withColumn("_all", F.lit(0)), ["_all"], [F.col(size).desc(), F.col(key)])
    return ranked.withColumn("place", F.col("rank") - 1).drop("_all", "rank")


def weighted_draws(df: DataFrame, weight: str, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows drawn with replacement, each as likely as its whole ``weight`` is large, with ``draw`` (from 0).

    Rows lie one after another on a line, by ``key``, each as long as its weight; draws are places on it by seeded hash. Rows and
    draws meet in cells of the line of about a row each, so that neither a heavy row nor many draws gather in one task.
    """
    rows = df.where(F.col(weight) > 0).select(F.struct(key).alias("_order"), F.struct(*df.columns).alias("_row"), F.col(weight).cast("long").alias("_w"))
    placed = prefix_sums(rows, "_order", ["_w"])
    total, count = placed.agg(F.max("run__w"), F.count("*")).first()
    if not count or n <= 0:
        return df.limit(0).withColumn("draw", F.lit(0).cast("long"))
    step, block = max(1, total // count), 1 << 16
    cell = lambda c: F.expr(f"({c}) div {step}")
    spans = placed.select("_row", (F.col("run__w") - F.col("_w")).alias("lo"), F.col("run__w").alias("hi"))
    spans = spans.withColumns({"first": cell("lo"), "last": cell("hi - 1")})
    spans = spans.select("*", F.explode(F.expr(f"sequence(first div {block}, last div {block})")).alias("b"))  # a heavy row, block by block
    inside = F.expr(f"sequence(greatest(first, b * {block}), least(last, b * {block} + {block} - 1))")
    spans = spans.select("_row", "lo", "hi", F.explode(inside).alias("cell"))
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")))
    at = F.conv(F.substring(text, 1, 15), 16, 10).cast("long") % total
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), at.alias("at")).withColumn("cell", cell("at"))
    hit = draws.join(spans, "cell").where("at >= lo and at < hi")
    return hit.select("_row.*", "draw")
