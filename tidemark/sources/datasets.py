"""Labelled datasets: a source, a split, labels and processors, put together as one DataFrame.

Each function takes rows that have a ``split`` (train or valid, see ``operators.dataset``), learns from the training rows
alone and gives all rows in the form that a learner reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from tidemark.operators import dataset, tabular, text as words
from tidemark.operators.ranking import prefix_sums


def training(df: DataFrame) -> DataFrame:
    """The training rows."""
    return df.where("split = 'train'")


def label_kind(df: DataFrame, label: str, delimiter: str | None = None) -> str:
    """``multi`` for lists and delimited labels, ``float`` for floating numbers, else ``category``."""
    kind = df.schema[label].dataType
    if delimiter or isinstance(kind, ArrayType):
        return "multi"
    return "float" if isinstance(kind, (FloatType, DoubleType)) else "category"


def labelled(df: DataFrame, label: str, delimiter: str | None = None, log: bool = False) -> DataFrame:
    """``df`` with ``y``: a number (its logarithm with ``log``), a class number from 0, or a sorted list of class numbers.

    Classes are those of the training rows, in order. Rows with an unknown class go; unknown labels of a list go.
    """
    kind = label_kind(df, label, delimiter)
    if kind == "float":
        return df.withColumn("y", F.log(label) if log else F.col(label).cast("double"))
    if kind == "category":
        seen = training(df).where(F.col(label).isNotNull()).select(label).distinct()
        classes = prefix_sums(seen, label).select(label, (F.col("rank") - 1).alias("y"))
        return df.join(classes, label)
    items = F.split(label, delimiter) if delimiter else F.col(label)
    one = training(df).select(F.explode(items).alias("_c")).distinct()
    classes = prefix_sums(one, "_c").select("_c", (F.col("rank") - 1).alias("_k"))
    seen = df.select(label).where(F.col(label).isNotNull()).distinct()  # rows of one label have one y
    found = seen.select(label, F.explode(items).alias("_c")).join(classes, "_c").groupBy(label).agg(F.sort_array(F.collect_set("_k")).alias("y"))
    joined = df.join(found, label, "left").select(*df.columns, "y")
    return joined.withColumn("y", F.coalesce("y", F.array().cast("array<long>")))


def tabular_data(df: DataFrame, key: str, target: str, cats: list[str], conts: list[str] | None = None, procs: tuple = ()) -> DataFrame:
    """key, split, a code for each of ``cats``, ``conts`` and y; all other columns are continuous unless named.

    ``procs`` are stage classes for the continuous columns, fitted one after another on the training rows.
    """
    conts = [c for c in df.columns if c not in (key, target, "split", *cats)] if conts is None else conts
    chain = tabular.Chain([tabular.Categorify(list(cats)), *[p(list(conts)) for p in procs]]).fit(training(df))
    out = labelled(chain.apply(df), target)
    return out.select(key, "split", *[f"{c}_code" for c in cats], *conts, "y")


def text_data(
    df: DataFrame, key: str, label: str, text: str | None = None, tokens: str | None = None, ids: str | None = None, most: int = 60_000, least: int = 2
) -> tuple[DataFrame, DataFrame | None]:
    """(rows, vocabulary): key, split, ids and y, from raw texts, from tokens, or from ids that are there already."""
    rows = labelled(df, label)
    if ids:
        return rows.select(key, "split", F.col(ids).alias("ids"), "y"), None
    cut = F.col(tokens) if tokens else words.mark_caps(words.word_tokens(F.col(text)))
    vocab = words.vocabulary(words.token_counts(training(df), cut), most, least)
    found = words.numericalize(rows, key, cut, vocab)
    return rows.select(key, "split", "y").join(found, key).select(key, "split", "ids", "y"), vocab


def ratings_data(df: DataFrame, key: str, user: str, item: str, rating: str) -> DataFrame:
    """key, split, codes of user and item (0 for those that training hasn't seen) and y."""
    chain = tabular.Categorify([user, item]).fit(training(df))
    out = chain.apply(df)
    return out.select(key, "split", F.col(f"{user}_code").alias("user"), F.col(f"{item}_code").alias("item"), F.col(rating).cast("double").alias("y"))


def image_data(files: DataFrame, path: str, label: Column | None = None) -> DataFrame:
    """path, split and y of image files: the label is the parent folder, or what ``label`` says."""
    rows = files.withColumn("_label", dataset.label_from_folder(F.col(path)) if label is None else label)
    return labelled(rows, "_label").select(path, "split", F.col("_label").alias("label"), "y")


def shuffled_holdout(df: DataFrame, pct: float, seed: int, key: str) -> DataFrame:
    """``df`` with ``split``: int(pct * n) + 1 rows in seeded order are ``valid``."""
    valid = dataset.first_in_order(df, int(pct * df.count()) + 1, seed, key)
    return df.withColumn("split", F.when(valid, "valid").otherwise("train"))
