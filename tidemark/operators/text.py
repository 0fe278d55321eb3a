"""Text cleaning, tokens and vocabularies as column expressions.

Rules are functions from column to column, so a chain of them is one projection; runs of equal characters or words are
found by pattern back-references in the JVM and counted there.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from html.entities import html5

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import prefix_sums

#: Special tokens in the order of their ids.
SPECIAL = ("xxunk", "xxpad", "xxbos", "xxeos", "xxfld", "xxmaj", "xxup", "xxrep", "xxwrep")
#: Markup leftovers and what they stand for, applied in this order.
FIXES = (
    ("#39;", "'"),
    ("amp;", "&"),
    ("#146;", "'"),
    ("nbsp;", " "),
    ("#36;", "$"),
    ("\\n", "\n"),
    ("quot;", "'"),
    ("<br />", "\n"),
    ('\\"', '"'),
    ("<unk>", "xxunk"),
    (" @.@ ", "."),
    (" @-@ ", "-"),
    (" @,@ ", ","),
    ("\\", " \\ "),
)
#: The patterns of the cleaning rules.
SPACES, MARKS, REPEATED, REPEATED_WORD = " {2,}", "([/#\n])", r"(\S)\1{3,}", r"(?U)(\b\w+\W+)\1{3,}"
#: The patterns of a name's humps.
HUMPS = ("(.)([A-Z][a-z]+)", "([a-z0-9])([A-Z])")
#: A word with its marks of accents, digits and apostrophes, or any other character that isn't white space.
WORD = r"[\p{L}\p{M}\p{N}_']+|[^\s\p{L}\p{M}\p{N}_']"
#: A character reference with its semicolon.
CLOSED = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z0-9]+);")
#: Ids of a vocabulary that tasks hold; beyond them it is joined.
HELD = 1_000_000

Rule = Callable[[Column], Column]


def collapse_spaces(x: Column) -> Column:
    """Two spaces or more become one."""
    return F.regexp_replace(x, SPACES, " ")


def fix_html(x: Column, closed: bool = False) -> Column:
    """Leftovers of markup and character references undone; with ``closed`` only references that end in a semicolon."""
    return collapse_spaces(unescaped(undo_leftovers(x), closed))


def undo_leftovers(x: Column) -> Column:
    """Leftovers of markup undone, without character references."""
    for old, new in FIXES:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def unescaped(x: Column, closed: bool = False) -> Column:
    """All character references, named and numbered, as the characters they stand for; only texts with an ampersand reach Python.

    Some names count without a semicolon too (``&amp``, and the start of ``&ampx``), unless they have to be ``closed``.
    """

    def one(found: re.Match) -> str:
        name = found[0][1:]
        return html.unescape(found[0]) if name[0] == "#" or name in html5 else found[0]

    def closed_ones(t: str) -> str:
        return CLOSED.sub(one, t)

    undo = closed_ones if closed else html.unescape

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(undo, na_action="ignore")

    return F.coalesce(run(F.when(F.contains(x, F.lit("&")), x)), x)


def space_marks(x: Column) -> Column:
    """Spaces around slashes, hashes and line ends."""
    return F.regexp_replace(x, MARKS, " $1 ")


def _marked_runs(x: Column, pattern: str, mark: str, count: Callable[[Column], Column], item: Callable[[Column], Column]) -> Column:
    """``x`` with each match of a run pattern replaced by its mark, count and item: pieces and matches zipped."""
    pieces, runs = F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    both = F.zip_with(
        pieces, runs,
        lambda p, r: F.when(r.isNull(), p).otherwise(F.concat(p, F.lit(f" {mark} "), count(r).cast("string"), F.lit(" "), item(r), F.lit(" "))),
    )
    return F.when(x.rlike(pattern), F.array_join(both, "")).otherwise(x)


def mark_repeats(x: Column) -> Column:
    """A character four times or more becomes `` xxrep n c ``."""
    return _marked_runs(x, REPEATED, "xxrep", F.length, lambda r: F.substring(r, 1, 1))


def mark_word_repeats(x: Column) -> Column:
    """A word with what stands behind it, four times or more, becomes `` xxwrep n w ``; w keeps what stands behind it.

    n counts what lies between white space in the repetitions, and the first.
    """
    first = lambda r: F.regexp_extract(r, REPEATED_WORD, 1)
    rest = lambda r: r.substr(F.length(first(r)) + 1, F.length(r))
    words = lambda r: F.regexp_count(rest(r), F.lit(r"(?U)\S+")) + 1
    return _marked_runs(x, REPEATED_WORD, "xxwrep", words, first)


PRE_RULES: tuple[Rule, ...] = (fix_html, mark_repeats, mark_word_repeats, space_marks, collapse_spaces)


def clean(x: Column, rules: tuple[Rule, ...] = PRE_RULES) -> Column:
    """All rules in order."""
    for rule in rules:
        x = rule(x)
    return x


#: The steps that rules consist of, where a rule has several.
STEPS: dict[Rule, tuple[Rule, ...]] = {fix_html: (undo_leftovers, unescaped, collapse_spaces)}


def cleaned(df: DataFrame, column: str, rules: tuple[Rule, ...] = PRE_RULES) -> DataFrame:
    """``df`` with all rules applied to a column in order, as ``clean`` does, each step a column of its own.

    A rule reads its text several times, so within one expression each rule repeats all that come before it; a column is made once.
    """
    for rule in rules:
        for step in STEPS.get(rule, (rule,)):
            df = df.withColumn(column, step(F.col(column)))
    return df


def split_tokens(x: Column) -> Column:
    """Tokens between single spaces."""
    return F.split(x, " ", -1)


def word_tokens(x: Column) -> Column:
    """Words, and marks one by one, of the whole Unicode text."""
    return F.regexp_extract_all(x, F.lit(WORD), F.lit(0))


def mark_caps(tokens: Column) -> Column:
    """``xxup`` before words in capitals, ``xxmaj`` before capitalised ones, everything lower-cased, empty tokens dropped."""

    def marked(t: Column) -> Column:
        up = (F.upper(t) == t) & (F.length(t) > 1)
        major = (F.substring(t, 1, 1) != F.lower(F.substring(t, 1, 1))) & (F.lower(t.substr(F.lit(2), F.length(t))) == t.substr(F.lit(2), F.length(t)))
        small = F.when(F.lower(t) == t, F.array(t))  # most tokens end here
        return small.when(up, F.array(F.lit("xxup"), F.lower(t))).when(major, F.array(F.lit("xxmaj"), F.lower(t))).otherwise(F.array(F.lower(t)))

    return F.flatten(F.transform(F.filter(tokens, lambda t: t != ""), marked))


def join_fields(*fields: Column, mark: bool = True, bos: bool = True, eos: bool = False) -> Column:
    """``xxbos [xxfld 1] a [xxfld 2] b [xxeos]``."""
    parts: list[Column] = [F.lit("xxbos")] if bos else []
    for i, f in enumerate(fields, 1):
        parts += [F.lit(f"xxfld {i}"), f] if mark and len(fields) > 1 else [f]
    return F.concat_ws(" ", *parts, *([F.lit("xxeos")] if eos else []))


#: Fixed value: the token that fills a vocabulary up.
FILLER = "xxfake"


def token_counts(df: DataFrame, tokens: Column) -> DataFrame:
    """n of each token."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame, most: int = 60_000, least: int = 2, multiple: int = 1) -> DataFrame:
    """id and token: special tokens first, then the most frequent ones; ties by token. Fillers (``FILLER``) bring the size to a ``multiple``.

    ``most`` bounds the table, so the window that numbers it is as small.
    """
    kept = counts.where((F.col("n") >= least) & ~F.col("token").isin(*SPECIAL)).orderBy(F.desc("n"), "token").limit(most)
    ids = (F.row_number().over(Window.orderBy(F.desc("n"), "token")) + len(SPECIAL) - 1).cast("long")
    first = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(t).alias("token")) for i, t in enumerate(SPECIAL)])
    special = counts.sparkSession.range(1).select(F.explode(first).alias("x")).select("x.*")
    whole = kept.select(ids.alias("id"), "token").unionByName(special)
    if multiple == 1:
        return whole
    n = F.max("id") + 1
    fill = whole.agg(n.alias("n")).select(F.explode(F.expr(f"sequence(n, n + pmod(-n, {multiple}))")).alias("id"), "n").where(f"id < n + pmod(-n, {multiple})")
    return whole.unionByName(fill.select("id", F.lit(FILLER).alias("token")))


def default_size(counts: DataFrame, most: int = 60_000) -> int:
    """Tokens of a vocabulary that fits a corpus: a quarter of its different tokens, up to a multiple of 8, ``most`` at most."""
    return min(most, -(-(counts.count() // 4) // 8) * 8)


def _mapped(df: DataFrame, key: str, values: str, kind: str, f: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """key and ``out``: ``f`` of the items of a list column, list by list, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(first, 250) for x in batches for first in range(0, x.num_rows, 250)):  # a few rows' items at once
            lists = b.column(1)
            ends = pc.cast(pc.subtract(lists.offsets, lists.offsets[0]), pa.int32())
            made = pa.ListArray.from_arrays(ends, f(lists.flatten()), mask=lists.is_null() if lists.null_count else None)
            yield pa.RecordBatch.from_arrays([b.column(0), made], [b.schema.names[0], "out"])

    rows = df.select(key, values)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, out array<{kind}>")


def numericalize(df: DataFrame, key: str, tokens: Column, vocab: DataFrame, held: int = HELD) -> DataFrame:
    """key and ids of each row's tokens in order, 0 for unknown ones; null tokens have null ids.

    A vocabulary of at most ``held`` tokens goes to every task, and ids are looked up in place; a larger one is joined.
    """
    known = vocab.orderBy("id").limit(held + 1).toArrow()
    if known.num_rows <= held:
        names, ids = known.column("token").combine_chunks(), known.column("id").combine_chunks()
        look_up = lambda x: pc.fill_null(ids.take(pc.index_in(x, value_set=names)), 0)
        return _mapped(df.select(key, tokens.alias("_t")), key, "_t", "long", look_up).withColumnRenamed("out", "ids")
    places = df.select(key, F.posexplode(tokens).alias("pos", "token")).join(vocab, "token", "left")
    item = F.struct("pos", F.coalesce("id", F.lit(0).cast("long")).alias("id"))
    grouped = places.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("x"))
    ids = grouped.select(key, F.col("x.id").alias("ids"))
    empty = F.when(tokens.isNotNull(), F.array().cast("array<long>")).alias("_none")
    return df.select(key, empty).join(ids, key, "left").select(key, F.coalesce("ids", "_none").alias("ids"))


def textify(df: DataFrame, key: str, ids: str, vocab: DataFrame, held: int = HELD) -> DataFrame:
    """key and text of ids."""
    known = vocab.orderBy("id").limit(held + 1).toArrow()
    if known.num_rows <= held:
        names, own = known.column("token").combine_chunks(), known.column("id").combine_chunks()
        look_up = lambda x: names.take(pc.index_in(x, value_set=own))
        return _mapped(df, key, ids, "string", look_up).select(key, F.array_join("out", " ").alias("text"))
    places = df.select(key, F.posexplode(ids).alias("pos", "id")).join(vocab, "id")
    grouped = places.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x"))
    return grouped.select(key, F.array_join("x.token", " ").alias("text"))


def lm_windows(df: DataFrame, key: str, ids: str, lanes: int, width: int) -> DataFrame:
    """lane, window, x and y: all ids in key order as one stream, cut into equal lanes, each into windows of ``width``.

    y is x one id further on. A lane has total // lanes ids, of which its last only ends a y; what is left over goes. Documents
    know their place by sums of ranges and send each window the slice of ids that falls into it, a few rows a document.
    """
    rows = prefix_sums(df.select(key, ids, F.size(ids).cast("long").alias("_n")), key, ["_n"])
    total = rows.agg(F.sum("_n")).first()[0] or 0
    lane = total // lanes
    if lane < 2:
        return df.sparkSession.createDataFrame([], "lane long, window long, x array<long>, y array<long>")
    windows = -(-(lane - 1) // width)  # of a lane
    start, end = F.col("_s"), F.col("_s") + F.col("_n")
    docs = rows.select((F.col("run__n") - F.col("_n")).alias("_s"), ids, "_n").where(f"_n > 0 and _s < {lane * lanes}")
    # the first item of a window is also the last of the y before it
    first = F.expr(f"(_s div {lane}) * {windows} + greatest(_s % {lane} - 1, 0L) div {width}")
    last = F.least(F.expr(f"((_s + _n - 1) div {lane}) * {windows} + least((_s + _n - 1) % {lane} div {width}, {windows - 1}L)"), F.lit(windows * lanes - 1))

    def piece(g: Column) -> Column:
        lane_at, place = F.floor(g / windows) * lane, (g % windows) * width
        low = F.greatest(lane_at + place, start)
        high = F.least(lane_at + F.least(place + width, F.lit(lane - 1)) + 1, end)
        return F.struct(g.alias("g"), low.alias("at"), F.slice(ids, (low - start + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")).alias("ids"))

    pieces = docs.select(F.explode(F.transform(F.sequence(first, last), piece)).alias("p")).select("p.*").where(F.size("ids") > 0)
    whole = pieces.groupBy("g").agg(F.flatten(F.array_sort(F.collect_list(F.struct("at", "ids"))).getField("ids")).alias("all"))  # width + 1 ids at most
    n = F.size("all") - 1
    numbers = [F.floor(F.col("g") / windows).alias("lane"), (F.col("g") % windows).alias("window")]
    return whole.select(*numbers, F.slice("all", F.lit(1), n).alias("x"), F.slice("all", F.lit(2), n).alias("y"))


def lm_chunks(df: DataFrame, key: str, size: str, lanes: int, width: int) -> DataFrame:
    """Where each document lies in ``lanes`` equal lanes of all tokens, cut into windows of ``width``.

    Offsets come from sums by group of documents, so no task but the one over groups sees the whole order; one row a
    document: start, end, and the first and last window its tokens fall into.
    """
    group = F.floor(F.col(key) / 1000)
    in_group = Window.partitionBy("_g").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select(key, F.col(size).alias("_n"), group.alias("_g"))
    sums = rows.groupBy("_g").agg(F.sum("_n").alias("_s"))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_g", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"), F.sum("_s").over(Window.partitionBy(F.lit(0))).alias("_all"))
    placed = rows.withColumn("_i", F.coalesce(F.sum("_n").over(in_group), F.lit(0))).join(sums, "_g")
    start = F.col("_o") + F.col("_i")
    lane = F.floor(F.col("_all") / lanes)
    at = lambda x: F.floor(x / lane) * 1_000_000 + F.floor((x % lane) / width)
    return placed.select(
        key, start.alias("start"), (start + F.col("_n")).alias("end"), at(start).cast("long").alias("first_window"),
        at(F.greatest(start, start + F.col("_n") - 1)).cast("long").alias("last_window"),
    )


def camel_to_snake(x: Column) -> Column:
    """``CamelCase`` as ``camel_case``."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, HUMPS[0], "$1_$2"), HUMPS[1], "$1_$2"))
