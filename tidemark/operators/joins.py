"""Joins of ordered series and their re-indexing: equi-joins on (clip_id, n) that Catalyst plans by size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import prefix_sums

KEY = ["clip_id", "n"]


def zip_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both series at the same place; ``b``'s columns must not clash."""
    return a.join(b, KEY)


def copy_properties(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """``a`` with the named columns of ``b`` where it has the row and a value."""
    other = b.select(*KEY, *[F.col(c).alias(f"_{c}") for c in names])
    joined = a.join(other, KEY, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in names}).drop(*[f"_{c}" for c in names])


def flag_references(df: DataFrame, refs: DataFrame, merge: bool, external: bool) -> DataFrame:
    """``df`` with prev_change (1 at a reference, else the old flag if ``merge``) and next_change (1 at an external one)."""
    joined = df.join(refs.select(*KEY).distinct().withColumn("_hit", F.lit(True)), KEY, "left")
    old = F.col("flag").cast("long") if merge else F.lit(0).cast("long")
    return joined.withColumns(
        {
            "prev_change": F.when(F.col("_hit"), F.lit(1).cast("long")).otherwise(old),
            "next_change": F.when(F.col("_hit") & F.lit(external), 1).otherwise(0).cast("long"),
        }
    ).drop("_hit")


def replace_payload(df: DataFrame, files: DataFrame, payload: str, path: str = "path") -> DataFrame:
    """Flagged rows take the payload of the file whose name holds ``ref_`` and their number; their flag goes.

    ``files`` with a clip_id serve their own clip, others every clip; of files of one number the first by path counts.
    """
    key = [c for c in ("clip_id", "n") if c == "n" or c in files.columns]
    n = F.regexp_extract(path, r"ref_(\d+)", 1).cast("long").alias("n")
    found = files.where(F.col(path).rlike(r"ref_\d+")).select(*key[:-1], n, F.col(path).alias("_path"), F.col(payload).alias("_new"))
    found = found.groupBy(*key).agg(F.min_by("_new", "_path").alias("_new"))
    joined = df.join(found, key, "left")
    hit = F.col("flag") & F.col("_new").isNotNull()
    return joined.withColumn(payload, F.when(hit, F.col("_new")).otherwise(F.col(payload))).withColumn(
        "flag", F.when(hit, F.lit(False)).otherwise(F.col("flag"))
    ).drop("_new")


def trim(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows start..end-1, numbered from 0."""
    return df.where((F.col("n") >= start) & (F.col("n") < end)).withColumn("n", F.col("n") - start)


def renumber(df: DataFrame) -> DataFrame:
    """``df`` with n dense from 0 again."""
    w = Window.partitionBy("clip_id").orderBy("n")
    return df.withColumn("n", (F.row_number().over(w) - 1).cast("long"))


def splice(a: DataFrame, b: DataFrame) -> DataFrame:
    """``b`` behind ``a`` in each clip, numbered through."""
    both = a.withColumn("_part", F.lit(0)).unionByName(b.withColumn("_part", F.lit(1)))
    w = Window.partitionBy("clip_id").orderBy("_part", "n")
    return both.withColumn("n", (F.row_number().over(w) - 1).cast("long")).drop("_part")


def gather(df: DataFrame, places: list[int]) -> DataFrame:
    """The rows at ``places``, in their order and as often as they are named; ``at`` is the old place."""
    if not places or min(places) < 0:
        raise ValueError("places must be a list of row numbers")
    places_of = F.array(*[F.struct(F.lit(i).cast("long").alias("pos"), F.lit(p).cast("long").alias("at")) for i, p in enumerate(places)])
    named = F.filter(places_of, lambda x: x.at == F.col("n"))
    rows = df.where(F.col("n").isin(*set(places))).withColumn("_x", F.explode(named))
    return rows.withColumn("at", F.col("n")).withColumn("n", F.col("_x.pos")).drop("_x")


def exported(df: DataFrame, places: list[int], offset: int = 0, suffix: str = "png") -> DataFrame:
    """Rows to export with their names: every k-th for a list of one k, else those listed."""
    keep = F.col("n") % places[0] == 0 if len(places) == 1 else F.col("n").isin(*sorted(set(places)))
    return df.where(keep).withColumn("name", F.format_string(f"ref_%06d.{suffix}", F.col("n") + offset))


def numbered(df: DataFrame, suffix: str = "png") -> DataFrame:
    """Rows with names of running numbers."""
    w = Window.partitionBy("clip_id").orderBy("n")
    return df.withColumn("name", F.format_string(f"ref_%06d.{suffix}", (F.row_number().over(w) - 1).cast("long")))


def zip_lists(a: DataFrame, order_a: str, b: DataFrame, order_b: str) -> DataFrame:
    """Rows of two ordered tables at the same place, as far as the shorter one goes, with their ``place`` from 0."""
    left, right = prefix_sums(a, order_a), prefix_sums(b, order_b)
    return left.join(right, "rank").withColumn("place", F.col("rank") - 1).drop("rank")


def blank(df: DataFrame, properties: list[str]) -> DataFrame:
    """The places of a series with some of its properties and no payload."""
    return df.select(*KEY, *properties)


def sampled_frames(df: DataFrame, n: int, jump: int, seed: int) -> DataFrame:
    """clip_id, place and n: ``n`` frames of every clip that has as many, for training.

    Frames lie at most ``jump`` apart: from a seeded start, each step ahead is seeded, too. Half of the clips run backwards.
    """
    sizes = df.groupBy("clip_id").agg(F.count("*").alias("_size")).where(F.col("_size") >= n)
    roll = lambda k: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("clip_id").cast("string"), F.lit(str(k)))), 1, 8), 16, 10).cast("long")
    most = F.greatest(F.lit(1), F.least(F.lit(jump), F.floor((F.col("_size") - 1) / max(1, n - 1))))
    steps = F.array(F.lit(0).cast("long"), *[roll(k) % most + 1 for k in range(1, n)])
    offsets = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.aggregate(F.slice(steps, 1, i), F.lit(0).cast("long"), lambda s, x: s + x))
    chosen = sizes.withColumn("_o", offsets).withColumn("_start", roll("start") % (F.col("_size") - F.element_at("_o", -1)))
    listed = F.transform("_o", lambda x: x + F.col("_start"))
    turned = F.when(roll("turn") % 2 == 1, F.reverse(listed)).otherwise(listed)
    return chosen.select("clip_id", F.posexplode(turned).alias("place", "n")).withColumn("place", F.col("place").cast("long"))
