"""Mixing sources to target weights by Sainte-Lague apportionment, with built-in expressions only.

1. Sizes are words. Targets share all words by weight; a source stops at ``repeats`` times its size and what it cannot
   take is shared again by weight. The closed form needs one pass in order of ceiling to weight, over one row a source.
2. Words come in equal blocks of ``block`` words. Sources get whole blocks by highest quotients
   target / (2 * seats + 1). The divisor that fits a group's sums is known within its parties over twice its seats, so
   only quotients in that stretch, about three a party, are ranked, by ranges; all larger ones are seats already.
3. A source's documents are dealt by hash to shards of about ``shard`` words, so that a source with a third of all rows
   is many shards. Its blocks are apportioned to its shards in the same way. Rows of a doc_id that repeats more than
   ``SAME`` times are dealt by their number, so that one doc_id with a third of all rows is many shards, too.
4. In a shard the documents lie on a line in seeded hash order, cut into blocks. A quota takes every block
   ``quota // blocks`` times and, from a seeded block on and around the end, the next ``quota % blocks`` once more. A
   document takes what the chosen blocks cover of it. The line's order is seeded already, and successive blocks leave
   all but two documents of a shard whole.

Only counts by source and by shard are gathered; documents are shuffled once, without their texts.

Defined results: a null text has size 0; null sources form one source, last in order; sources without a word have
target 0; a text of any length is one document on the line, and may make its shard larger; equal quotients go by order
of source or shard; repeated rows are rows of their own; an empty table gives an empty result; a further column stays out
of the result of ``mix``, whatever its name, and is kept by ``apply_mix``. Reruns agree, since every choice is a function
of the seed, the doc_id and the sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import group_ranks
from tidemark.session import staged

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK = 16
SHARD = 1_000_000
REPEATS = 3
SEED = 42
#: Rows of one source and doc_id that are dealt together.
SAME = 10_000


def apportion(parties: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``parties`` with ``seats``: whole numbers by Sainte-Lague that sum to ``total`` within each group ``by``.

    ``parties`` has ``claim`` (positive weights; those of zero get no seat) and ``total`` (the group's seats). Ties go
    by ``order``. Exact: a party's quotient times 1 +- n / (2 total), rounded, is more (less) than its seats in sum over the n
    parties of a group, so seats below that stretch are certain and those above it out of reach.
    """
    by = by or ["_all"]
    parties = parties.withColumn("_all", F.lit(0)) if by == ["_all"] else parties
    sums = parties.groupBy(*by).agg(F.sum("claim").alias("_sum"), F.count_if(F.col("claim") > 0).alias("_n"))
    quota = F.when(F.col("claim") > 0, F.col("claim") * F.col("total") / F.col("_sum")).otherwise(0.0)
    width = F.when(F.col("total") > 0, F.col("_n") / (2 * F.col("total"))).otherwise(0.0)
    known = parties.join(sums, by).select(
        *parties.columns,
        F.greatest(F.lit(0), F.floor(quota * (1 - width) - 0.5)).cast("long").alias("_low"),
        F.when((F.col("claim") > 0) & (F.col("total") > 0), F.floor(quota * (1 + width) + 1.5)).otherwise(0).cast("long").alias("_high"),
    )
    known = staged(known, "parties")
    left = known.groupBy(*by).agg((F.first("total") - F.sum("_low")).alias("_left"))
    reach = known.where("_high > _low").select(*by, *order, "claim", F.explode(F.expr("sequence(_low, _high - 1)")).alias("_k"))
    quotient = reach.select(*by, *order, (F.col("claim") / (2 * F.col("_k") + 1)).alias("_q"))
    ranked = group_ranks(quotient, by, [F.col("_q").desc(), *map(F.col, order)])
    won = ranked.join(left, by).where("rank <= _left").groupBy(*by, *order).agg(F.count("*").alias("_won"))
    names = [c for c in parties.columns if c != "_all"]
    return known.join(won, [*by, *order], "left").select(
        *names, (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long").alias("seats")
    )


def _hashed(seed: int, *cols: Column) -> Column:
    """32 bits of an MD5 digest: a draw that other engines can repeat."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``sources`` (source, none, source_size) with ``target``; one row a source, so the windows are small."""
    by_name = Window.partitionBy(F.lit(0)).orderBy("none", "source")
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("_ratio", "none", "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    through = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights))
    shared = (
        sources.withColumn("_w", weight.cast("double"))
        .withColumn("_cap", (F.col("source_size") * repeats).cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                    / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
        .withColumn("_level", F.first(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), ignorenulls=True).over(through))
    )
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return shared.select("none", "source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    block: int = BLOCK,
    shard: int = SHARD,
    repeats: int = REPEATS,
    seed: int = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source_size, target (the source's) and taken (words the mix takes, repeats counted) of each row.

    ``keep`` names further columns of ``docs`` to carry along.
    """
    sized = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.col("source").isNull().alias("none"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _hashed(seed, F.col("doc_id")).alias("draw"),
        F.struct(F.lit(0).alias("_"), *keep).alias("_kept"),  # names of columns to carry may clash with those above
    )
    return _mix_sized(sized, weights, block, shard, repeats, seed, keep)


def apply_mix(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a row for each time a document is taken, to the nearest whole number.

    Rows of one doc_id, source and text stand for each other; together they get the times of all of them.
    """
    key = row_key(*map(F.col, ("doc_id", "source", "text")))
    keyed = docs.select(key.alias("_key"), "doc_id", "source", "text")
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    wanted = mix(keyed, keep=("_key",)).groupBy("_key").agg(F.sum(times).alias("_t"), F.count("*").alias("_n"))
    wanted = staged(wanted, "mix-wanted")  # read twice below, so the mix is neither planned nor made twice
    rows = docs.select(key.alias("_key"), F.struct(*docs.columns).alias("_row"))  # whatever the columns are called
    taken = rows.join(wanted.where("_t > 0"), "_key")
    even = taken.where("_t % _n = 0").select("_row", F.expr("_t div _n").alias("_e"))
    odd = staged(taken.where("_t % _n != 0").withColumn("_id", F.monotonically_increasing_id()), "mix-repeated")
    ranked = group_ranks(odd.select("_key", "_id", "_t", "_n"), ["_key"], [F.col("_id")])
    more = odd.select("_id", "_row").join(ranked, "_id").select("_row", F.expr("_t div _n + IF(rank <= _t % _n, 1, 0)").alias("_e"))
    each = F.explode(F.array_repeat(F.lit(0), F.col("_e").cast("int")))
    return even.unionByName(more).select("_row", each).select("_row.*")


def row_key(*columns: Column) -> Column:
    """A digest that tells values apart: lengths come first, so neither nulls nor separators can be mistaken."""
    texts = [c.cast("string") for c in columns]
    return F.md5(F.concat_ws("|", *[F.coalesce(F.octet_length(t), F.lit(-1)) for t in texts], *[F.coalesce(t, F.lit("")) for t in texts]))


def _dealt_apart(sized: DataFrame, seed: int, same: int = SAME) -> DataFrame:
    """``sized`` with draws by number for the rows of a source and doc_id that repeat more than ``same`` times."""
    key = ["none", "source", "doc_id"]
    many = sized.groupBy(*key).agg(F.count("*").alias("_n")).where(f"_n > {same}").select(*key, F.lit(True).alias("_many"))
    many = staged(many, "mix-repeats")
    if many.isEmpty():
        return sized
    fits = [sized[c].eqNullSafe(many[c]) for c in key]
    marked = sized.join(many, fits, "left").select(*[sized[c] for c in sized.columns], "_many")
    marked = staged(marked.withColumn("_id", F.monotonically_increasing_id()), "mix-marked")
    names = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_name"), F.col("doc_id").isNull().alias("_null")]
    rows = marked.where("_many").select("none", "source", *names, "size", "_id")
    ranked = group_ranks(rows, ["none", "source", "_name", "_null"], [F.col("size"), F.col("_id")])
    drawn = ranked.select("_id", _hashed(seed, F.col("_name"), F.col("rank")).alias("_draw"))
    placed = marked.join(drawn, "_id", "left")
    return placed.withColumn("draw", F.coalesce("_draw", "draw")).select(*sized.columns)


def _mix_sized(sized: DataFrame, weights, block, shard, repeats, seed, keep) -> DataFrame:
    sized = _dealt_apart(staged(sized, "mix-sizes"), seed)  # the texts are read once
    per_source = sized.groupBy("none", "source").agg(F.sum("size").alias("source_size"))
    per_source = staged(per_source, "mix-sources")
    aimed = targets(per_source, weights, repeats)
    words = per_source.agg(F.sum("source_size")).first()[0] or 0
    seats = apportion(
        aimed.select("none", "source", "source_size", "target", F.col("target").alias("claim"), F.lit(int(words / block + 0.5)).alias("total")),
        [],
        ["none", "source"],
    ).select(
        "none",
        "source",
        "source_size",
        "target",
        F.col("seats").alias("total"),
        F.greatest(F.ceil(F.col("source_size") / shard), F.lit(1)).alias("n_shards"),
    )
    seats = staged(seats, "mix-seats")  # one row a source
    dealt = _with_source(sized, seats.select("none", "source", "n_shards")).withColumn(
        "shard", F.expr("draw % n_shards")
    )
    per_shard = dealt.groupBy("none", "source", "shard").agg(F.sum("size").alias("claim"))
    quotas = apportion(
        per_shard.join(seats.select("none", "source", "total"), ["none", "source"]), ["none", "source"], ["shard"]
    )
    blocks = F.greatest(F.ceil(F.col("claim") / block), F.lit(1))
    quotas = quotas.select(
        "none",
        "source",
        "shard",
        blocks.cast("long").alias("blocks"),
        F.least("seats", blocks * repeats).cast("long").alias("quota"),
        _hashed(seed, F.col("none"), F.col("source"), F.col("shard")).alias("shift"),
    ).join(seats.select("none", "source", "source_size", "target"), ["none", "source"])
    quotas = staged(quotas, "mix-quotas")  # one row a shard
    line = Window.partitionBy("none", "source", "shard").orderBy("draw", "doc_id", "size")
    placed = dealt.drop("n_shards").withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(quotas, ["none", "source", "shard"])
    taken = F.expr(
        f"""CASE WHEN size = 0 THEN 0L ELSE aggregate(
              sequence((end - size) div {block}, (end - 1) div {block}), 0L,
              (a, j) -> a + (least(end, (j + 1) * {block}) - greatest(end - size, j * {block}))
                        * (quota div blocks + IF((j + shift) % blocks < quota % blocks, 1, 0))) END"""
    )
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *[F.col("_kept")[c].alias(c) for c in keep])


def _with_source(rows: DataFrame, seats: DataFrame) -> DataFrame:
    """Each row with its source's columns: broadcast while the sources are few, else a shuffled join that Spark splits."""
    few = seats.count() <= 10_000
    return rows.join(F.broadcast(seats) if few else seats, ["none", "source"])


_W = ", ".join(map(str, WEIGHTS))


def _apportioned(name: str, src: str, by: str, order: str) -> str:
    """CTEs that give ``name``: ``src`` with seats; the quotients are ranked among each party's neighbours of its share."""
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, {order}" if by else order
    down = ", ".join(f"{c} DESC" for c in order.split(", "))
    return f"""
{name}_r AS (SELECT *, sum(claim) OVER ({part}) AS s_,
    CAST(floor(CASE WHEN sum(claim) OVER ({part}) > 0 THEN claim * total / sum(claim) OVER ({part}) ELSE 0 END + 0.5) AS BIGINT) AS b_
  FROM {src}),
{name}_l AS (SELECT *, CAST(CASE WHEN s_ > 0 THEN total ELSE 0 END - sum(b_) OVER ({part}) AS BIGINT) AS l_ FROM {name}_r),
{name}_m AS (SELECT *, row_number() OVER ({part} ORDER BY claim / (2 * k_ + 1) DESC, {order}) AS r_
  FROM (SELECT *, unnest(range(b_, b_ + l_)) AS k_ FROM {name}_l WHERE l_ > 0 AND claim > 0)),
{name}_f AS (SELECT *, row_number() OVER ({part} ORDER BY claim / (2 * k_ + 1), {down}) AS r_
  FROM (SELECT *, unnest(range(greatest(0, b_ + l_), b_)) AS k_ FROM {name}_l WHERE l_ < 0 AND b_ > 0)),
{name}_d AS (SELECT {keys}, sum(d) AS d_ FROM (SELECT {keys}, 1 AS d FROM {name}_m WHERE r_ <= l_
  UNION ALL SELECT {keys}, -1 AS d FROM {name}_f WHERE r_ <= -l_) GROUP BY {keys}),
{name} AS (SELECT l.*, CAST(b_ + coalesce(d_, 0) AS BIGINT) AS seats FROM {name}_l l LEFT JOIN {name}_d USING ({keys}))"""


ORACLE = f"""
WITH sized AS (SELECT doc_id, coalesce(source, '') AS source, source IS NULL AS none,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS draw
  FROM documents),
per AS (SELECT none, source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY none, source),
w AS (SELECT *, CAST([{_W}][(row_number() OVER (ORDER BY none, source) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS w_,
    CAST(source_size * {REPEATS} AS DOUBLE) AS cap FROM per),
lv AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0.0))
    / (sum(w_) OVER () - coalesce(sum(w_) OVER b, 0.0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / w_, none, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ft AS (SELECT *, first_value(CASE WHEN level <= cap / w_ THEN level END IGNORE NULLS) OVER (ORDER BY cap / w_, none, source
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fair FROM lv),
aimed AS (SELECT none, source, source_size, least(cap, coalesce(fair * w_, cap)) AS target,
    least(cap, coalesce(fair * w_, cap)) AS claim,
    CAST(floor(CAST(sum(source_size) OVER () AS DOUBLE) / {BLOCK} + 0.5) AS BIGINT) AS total FROM ft),
{_apportioned("a", "aimed", "", "none, source")},
seat AS (SELECT none, source, source_size, target, seats AS total,
    CAST(greatest(ceil(source_size / {SHARD}), 1) AS BIGINT) AS n_shards FROM a),
dealt AS (SELECT sized.*, draw % n_shards AS shard FROM sized JOIN seat USING (none, source)),
ps AS (SELECT none, source, shard, CAST(sum(size) AS BIGINT) AS claim, any_value(total) AS total
  FROM dealt JOIN seat USING (none, source) GROUP BY none, source, shard),
{_apportioned("q", "ps", "none, source", "shard")},
quotas AS (SELECT none, source, shard, CAST(greatest(ceil(claim / {BLOCK}), 1) AS BIGINT) AS blocks,
    least(seats, {REPEATS} * CAST(greatest(ceil(claim / {BLOCK}), 1) AS BIGINT)) AS quota,
    CAST('0x' || substr(md5('{SEED}|' || none || '|' || source || '|' || shard), 1, 8) AS BIGINT) AS shift FROM q),
placed AS (SELECT *, row_number() OVER () AS rid, CAST(sum(size) OVER (PARTITION BY none, source, shard
    ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM dealt),
cut AS (SELECT p.*, source_size, target, blocks, quota, shift,
    unnest(CASE WHEN size = 0 THEN [NULL] ELSE range((e - size) // {BLOCK}, (e - 1) // {BLOCK} + 1) END) AS j
  FROM placed p JOIN quotas USING (none, source, shard) JOIN (SELECT none, source, source_size, target FROM seat) USING (none, source))
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size,
    any_value(target) AS target, CAST(coalesce(sum((least(e, (j + 1) * {BLOCK}) - greatest(e - size, j * {BLOCK}))
      * (quota // blocks + CASE WHEN (j + shift) % blocks < quota % blocks THEN 1 ELSE 0 END)), 0) AS BIGINT) AS taken
FROM cut GROUP BY rid"""
