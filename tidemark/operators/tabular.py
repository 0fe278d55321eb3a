"""Feature engineering with fit and apply: date parts, cyclic dates, categories, fills, scaling, sizes, sampling weights.

``fit`` runs one aggregation over the training rows and returns a small model; ``apply`` is a projection, or a join with a
dimension table that Catalyst sizes on its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, ShortType

from tidemark.operators.ranking import prefix_sums, values_at


def add_datepart(df: DataFrame, date: str, prefix: str | None = None, time: bool = False) -> DataFrame:
    """``df`` with the parts of a date, boundary flags and epoch seconds, in place of nothing: the date stays."""
    p = prefix if prefix is not None else date.removesuffix("date").removesuffix("_") or date
    d = F.col(date)
    month_end, q = F.last_day(d), F.trunc(d, "quarter")
    day = F.to_date(d)
    parts: dict[str, Column] = {
        "Year": F.year(d), "Month": F.month(d), "Week": F.weekofyear(d), "Day": F.dayofmonth(d),
        "Dayofweek": F.weekday(d), "Dayofyear": F.dayofyear(d),
        "Is_month_end": day == month_end, "Is_month_start": F.dayofmonth(d) == 1,
        "Is_quarter_end": day == F.last_day(F.add_months(q, 2)), "Is_quarter_start": day == q,
        "Is_year_end": (F.month(d) == 12) & (F.dayofmonth(d) == 31), "Is_year_start": F.dayofyear(d) == 1,
    }
    if time:
        parts |= {"Hour": F.hour(d), "Minute": F.minute(d), "Second": F.second(d)}
    parts["Elapsed"] = F.unix_seconds(d.cast("timestamp"))
    plain = lambda c, e: e if c.startswith("Is_") else e.cast("long")
    return df.withColumns({f"{p}_{c}": plain(c, e) for c, e in parts.items()})


def add_cyclic_datepart(df: DataFrame, date: str, time: bool = False) -> DataFrame:
    """``df`` with cosine and sine of the place in the week, month, year and day."""
    d = F.col(date)
    days = F.when(F.dayofmonth(F.last_day(F.make_date(F.year(d), F.lit(2), F.lit(1)))) == 29, 366).otherwise(365)
    turns = {
        "weekday": F.weekday(d) / 7,
        "day_month": (F.dayofmonth(d) - 1) / F.dayofmonth(F.last_day(d)),
        "month_year": (F.month(d) - 1) / 12,
        "day_year": (F.dayofyear(d) - 1) / days,
    }
    if time:
        turns |= {"hour": F.hour(d) / 24, "clock": (F.hour(d) % 12) / 12, "min": F.minute(d) / 60, "sec": F.second(d) / 60}
    return df.withColumns({f"{n}_{k}": f(e * 2 * math.pi) for n, e in turns.items() for k, f in (("cos", F.cos), ("sin", F.sin))})


def cont_cat_split(df: DataFrame, max_card: int = 20, dep_var: str | None = None) -> tuple[list[str], list[str]]:
    """(continuous, categorical): floats and integers of more than ``max_card`` values are continuous; one pass."""
    whole = (IntegerType, LongType, ShortType)
    fields = [f for f in df.schema.fields if f.name != dep_var]
    ints = [f.name for f in fields if isinstance(f.dataType, whole)]
    many = set()
    if ints:
        counts = df.agg(*[F.count_distinct(c).alias(c) for c in ints]).first()
        many = {c for c in ints if counts[c] > max_card}
    cont = [f.name for f in fields if f.name in many or isinstance(f.dataType, (FloatType, DoubleType))]
    return cont, [f.name for f in fields if f.name not in cont]


@dataclass
class Categorify:
    """Codes from 1 by the order of the training values; 0 for null and unseen."""

    columns: list[str]
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Categorify:
        """Learn the values of each column."""
        for c in self.columns:
            values = df.where(F.col(c).isNotNull()).select(c).distinct()
            self.tables[c] = prefix_sums(values, c).withColumnRenamed("rank", f"{c}_code")
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with a code a column."""
        for c in self.columns:
            df = df.join(self.tables[c], c, "left").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(0).cast("long")))
        return df


@dataclass
class FillMissing:
    """Nulls of continuous columns filled by median, mode or a constant; ``<c>_na`` marks them where training had some."""

    columns: list[str]
    strategy: str = "median"
    constant: float = 0.0
    fills: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> FillMissing:
        """One pass for counts; medians by ranges of values; modes take the smallest of the most frequent values."""
        counts = [f(F.col(c)).alias(f"{c}_{k}") for c in self.columns for k, f in (("n", F.count), ("z", lambda x: F.count_if(x.isNull())))]
        row = df.agg(*counts).first()
        for c in self.columns:
            if not row[f"{c}_z"]:
                continue
            if self.strategy == "median":
                n = row[f"{c}_n"]
                self.fills[c] = sum(values_at(df, c, [(n - 1) // 2, n // 2])) / 2 if n else None
            elif self.strategy == "constant":
                self.fills[c] = self.constant
            else:
                top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
                self.fills[c] = top[c] if top else None
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` filled. Nulls in a column that had none in training are an error when the rows are read."""
        out = {}
        for c in self.columns:
            if c in self.fills:
                out[f"{c}_na"] = F.col(c).isNull()
                out[c] = F.coalesce(F.col(c), F.lit(self.fills[c]))
            else:
                ok = F.assert_true(F.col(c).isNotNull(), f"{c} has nulls, but had none in training")
                out[c] = F.when(ok.isNull(), F.col(c))
        return df.withColumns(out)


@dataclass
class Normalize:
    """(x - mean) / (1e-7 + sample deviation) with the training rows' figures."""

    columns: list[str]
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Normalize:
        """One pass."""
        row = df.agg(*[f(c).alias(f"{c}_{k}") for c in self.columns for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
        for c in self.columns:
            self.means[c], self.stds[c] = row[f"{c}_m"] or 0.0, row[f"{c}_s"] or 0.0
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` scaled."""
        return df.withColumns({c: (F.col(c) - self.means[c]) / (1e-7 + self.stds[c]) for c in self.columns})


@dataclass
class Chain:
    """Stages fitted one after another on the training rows, then applied in order."""

    stages: list

    def fit(self, df: DataFrame) -> Chain:
        """Fit each stage on what the ones before it give."""
        for stage in self.stages:
            df = stage.fit(df).apply(df)
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        """Apply all stages."""
        for stage in self.stages:
            df = stage.apply(df)
        return df


def embedding_size(n: Column) -> Column:
    """Vector size for a category of n values."""
    return F.least(F.lit(600), F.floor(F.pow(n, F.lit(0.56)) * 1.6 + 0.5)).cast("long")


def cardinalities(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n (values and one for unknown) and size of each column; one pass."""
    row = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c) + 1).alias("n")) for c in columns])
    return row.select(F.explode(pairs).alias("x")).select("x.*").withColumn("size", embedding_size(F.col("n")))


def oversample_weights(df: DataFrame, label: str) -> DataFrame:
    """n and weight (1 / n) of each label and the draws that make all labels equal."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row a label
    draws = (F.max("n").over(every) * F.count("*").over(every)).alias("draws")
    return counts.select(label, "n", (F.lit(1.0) / F.col("n")).alias("weight"), draws)


def schedule(kind: str, start: float, end: float, share: Column) -> Column:
    """Value of an annealing schedule at a share of its way."""
    if kind == "no":
        return F.lit(start) + share * 0
    if kind == "linear":
        return F.lit(start) + share * (end - start)
    if kind == "exp":
        return F.pow(F.lit(end / start), share) * start
    if kind == "cos":
        return (F.cos(share * math.pi) + 1) * ((start - end) / 2) + end
    if kind.startswith("poly"):
        return F.pow(1 - share, F.lit(float(kind[4:] or 1))) * (start - end) + end
    raise ValueError(f"{kind!r} is no schedule")


def phases(parts: list[tuple[float, str, float, float]], share: Column) -> Column:
    """Schedules one after another: each part has its share of the way, kind, start and end. A cycle is a rise and a fall."""
    out, begun = None, 0.0
    for k, (length, kind, start, end) in enumerate(parts):
        value = schedule(kind, start, end, (share - begun) / length)
        begun += length
        inside = share < begun if k < len(parts) - 1 else F.lit(True)
        out = F.when(inside, value) if out is None else out.when(inside, value)
    return out



def dot_bias(u: Column, v: Column, bu: Column, bi: Column, low: float | None = None, high: float | None = None) -> Column:
    """Dot product of two vectors with biases, squeezed into a range if one is given."""
    s = F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x) + bu + bi
    return s if low is None else F.lit(low) + (high - low) / (1 + F.exp(-s))


#: Layouts of dates, in the order of trial.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy")


def make_date(df: DataFrame, column: str, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """``df`` with a text column read as timestamps, null where no layout fits; a column of dates stays as it is."""
    if df.schema[column].dataType.simpleString() != "string":
        return df
    return df.withColumn(column, F.coalesce(*[F.try_to_timestamp(column, F.lit(f)) for f in formats]))
