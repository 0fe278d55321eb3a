"""Secret scans with built-in expressions only.

Two layers find spans in a text. Fixed patterns give the *base* spans (kinds ``assign``, ``access``, ``hex``). The
entropy layer slides a window over every candidate string and keeps those whose best window is too random for its
character class (kinds ``entropy_hex``, ``entropy_base64``); an allow-list of patterns suppresses words, numbers, slugs,
UUIDs and placeholders. Window entropy comes from incremental counts: a step changes the counts of the character
that enters and the one that leaves, and with them the running sum of c*log2(c).

Defined results: a null text counts as empty (no span); very long texts are scanned whole; repeated rows each get their
own result; an empty table gives an empty result; columns of the input other than the text are kept, and a column
that bears the name of an output column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in the order that breaks ties, with the shortest length that counts.
ASSIGN = (
    "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{16,}"  # a run of AKIA[A-Z0-9]+ with 20 characters or more
HEX = "[0-9a-f]{24,}"  # a run of [0-9a-f]+ with 24 characters or more
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

#: Strings that the entropy layer looks at; they are split by class into pure hexadecimal digits and the rest.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a window must exceed, by class. No count vector of 20 characters has exactly these entropies.
THRESHOLDS = {"entropy_hex": 2.9, "entropy_base64": 3.63}
#: A candidate that one of these matches is not a secret.
ALLOW = (
    "^[A-Za-z]+$",
    "^[0-9]+$",
    "^[A-Za-z]+(?:[-_/=+]+[A-Za-z]+)*[-_/=+]*$",
    "^[0-9_/=+-]+$",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Xx]{6,}",
)
#: Matches whose places are added up in one go.
_CHUNK = 256
_SPAN = "array<struct<start:bigint,k:int,end:bigint>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _found(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points; those whose group is shorter than ``least`` go.

    The pieces between matches and the matches alternate, so running lengths give every position: within chunks of matches
    from the chunk's start, and from the sums of the chunks before it.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(
        F.split(text, pattern, -1),
        hits,
        lambda p, h: F.struct(F.length(p).cast("long").alias("p"), F.length(h).cast("long").alias("h")),
    )
    if group:
        parts = F.zip_with(
            parts,
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
            lambda x, g: F.struct(x.p.alias("p"), x.h.alias("h"), F.length(g).alias("g")),
        )
    none = F.expr(f"cast(array() as {_SPAN})")

    def step(a: Column, x: Column) -> Column:
        span = F.struct((a.at + x.p).alias("start"), F.lit(kind).alias("k"), (a.at + x.p + x.h).alias("end"))
        good = x.h.isNotNull() if not group else x.g >= least
        out = F.when(good, F.concat(a.out, F.array(span).cast(_SPAN))).otherwise(a.out)
        return F.struct((a.at + x.p + F.coalesce(x.h, F.lit(0))).alias("at"), out.alias("out"))

    def spans(xs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(xs), F.lit(_CHUNK))
        zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
        return _let(F.transform(starts, lambda i: F.aggregate(F.slice(xs, i, _CHUNK), zero, step)), joined)

    def joined(chunks: Column) -> Column:
        zero = F.array(F.lit(0).cast("long"))
        before = F.aggregate(chunks, zero, lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + c.at)))
        moved = lambda s, at: F.struct((s.start + at).alias("start"), s.k.alias("k"), (s.end + at).alias("end"))
        shift = lambda c, at: F.transform(c.out, lambda s: moved(s, at))
        return F.flatten(F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), shift))

    return F.when(text.rlike(pattern), _let(parts, spans)).otherwise(none)


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits) of any ``window`` successive characters of a string; 0 if it is shorter.

    Counts are kept for the different characters of the string.
    """
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])

    def best(size: Column, codes: Column) -> Column:
        zero = F.struct(F.array_repeat(F.lit(0), size).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
        moves = F.transform(
            codes, lambda c, i: F.struct(c.alias("into"), F.when(i >= window, F.get(codes, i - window)).alias("gone"), i.alias("i"))
        )

        def step(a: Column, m: Column) -> Column:
            gone = F.coalesce(F.get(a.n, m.gone), F.lit(0))  # count of the character that leaves
            into = F.get(a.n, m.into) - F.when(m.gone == m.into, 1).otherwise(0)
            less = F.when(m.gone.isNull(), 0.0).otherwise(F.get(table, gone - 1) - F.get(table, gone))
            s = a.s + less + F.get(table, into + 1) - F.get(table, into)
            n = F.transform(
                a.n,
                lambda c, j: c + F.when(j == m.into, 1).otherwise(0) - F.when(j == F.coalesce(m.gone, F.lit(-1)), 1).otherwise(0),
            )
            h = F.when(m.i >= window - 1, F.lit(math.log2(window)) - s / window).otherwise(0.0)
            return F.struct(n.alias("n"), s.alias("s"), F.greatest(a.best, h).alias("best"))

        return F.aggregate(moves, zero, step, lambda a: a.best)

    def coded(chars: Column) -> Column:
        codes = lambda kinds: F.transform(chars, lambda ch: (F.array_position(kinds, ch) - 1).cast("int"))
        return _let(F.array_distinct(chars), lambda kinds: _let(codes(kinds), lambda xs: best(F.size(kinds), xs)))

    return _let(F.split(value, ""), coded)


def find_secrets(
    docs: DataFrame,
    text: str = "text",
    window: int = WINDOW,
    thresholds: dict[str, float] = THRESHOLDS,
    allow: tuple[str, ...] = ALLOW,
) -> DataFrame:
    """``docs`` with ``base`` and ``secrets``: spans (start, k, end) by start, then kind ``KINDS[k]``; ``secrets`` has all.

    Positions are code points, the end exclusive. A candidate that overlaps a base span is not added again.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(_found(t, ASSIGN, 0, 1, ASSIGN_LEAST), _found(t, ACCESS, 1), _found(t, HEX, 2)))
    spans = docs.withColumn("base", base).withColumn("_c", _found(t, CANDIDATE, 3))

    def suspect(c: Column) -> Column:
        value = t.substr((c.start + 1).cast("int"), (c.end - c.start).cast("int"))
        allowed = F.lit(False)
        for p in allow:
            allowed = allowed | value.rlike(p)
        return F.when(allowed, F.lit(None)).otherwise(value)

    clear = F.filter(
        F.col("_c"), lambda c: ~F.exists(F.col("base"), lambda b: (b.start < c.end) & (c.start < b.end))
    )
    judged = F.transform(clear, lambda c: F.struct(c.start.alias("start"), c.end.alias("end"), suspect(c).alias("v")))
    spans = spans.withColumn("_c", F.when(F.size("_c") > 0, F.filter(judged, lambda c: c.v.isNotNull())))
    scored = F.transform(
        F.col("_c"),
        lambda c: F.struct(
            c.start.alias("start"),
            F.when(c.v.rlike("^[0-9a-fA-F]+$"), 3).otherwise(4).alias("k"),
            c.end.alias("end"),
            window_entropy(c.v, window).alias("h"),
        ),
    )
    kept = F.transform(
        F.filter(
            scored,
            lambda c: c.h > F.when(c.k == 3, thresholds["entropy_hex"]).otherwise(thresholds["entropy_base64"]),
        ),
        lambda c: F.struct(c.start.alias("start"), c.k.alias("k"), c.end.alias("end")),
    )
    spans = spans.withColumn("_c", F.when(F.size("_c") > 0, kept))
    added = F.coalesce(F.col("_c").cast(_SPAN), F.expr(f"cast(array() as {_SPAN})"))
    return spans.withColumn("secrets", F.array_sort(F.concat(F.col("base"), added))).drop("_c")


def spelled(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s.k), s.start.cast("string"), s.end.cast("string")))
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "<secret>", length: str | None = None) -> DataFrame:
    """``docs`` with each maximal run of overlapping spans replaced by ``mark``; texts without a span stay as they are.

    A column ``length`` follows the text. All other columns stay, whatever their names.
    """
    found = find_secrets(docs.select(F.col(text).alias("_text"), F.struct(*docs.columns).alias("_row")), "_text")
    t = F.coalesce(F.col("_text"), F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = t.substr((a.at + 1).cast("int"), (s.start - a.at).cast("int"))
        out = F.when(s.start < a.at, a.out).otherwise(F.concat(a.out, gap, F.lit(mark)))
        return F.struct(F.greatest(a.at, s.end).alias("at"), out.alias("out"))

    rest = lambda a: F.concat(a.out, t.substr((a.at + 1).cast("int"), F.length(t)))
    clean = F.when(F.size("secrets") > 0, F.aggregate(F.col("secrets"), start, step, rest)).otherwise(F.col("_text"))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    new = {text: F.col("_clean")} | ({length: F.length("_clean").cast(kinds[length])} if length else {})
    return found.withColumn("_clean", clean).select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = find_secrets(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    count = lambda k: F.size(F.filter("base", lambda s: s.k == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spelled(F.col("secrets")).alias("spans"),
    )


def _sql() -> str:
    quote = lambda s: s.replace("'", "''")
    allowed = " OR ".join(f"regexp_matches(v, '{quote(p)}')" for p in ALLOW)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
kinds(kind, k, p, g, least) AS (VALUES ('assign', 0, '{quote(ASSIGN)}', 1, {ASSIGN_LEAST}), ('access', 1, '{ACCESS}', 0, 20),
  ('hex', 2, '{HEX}', 0, 24), ('candidate', 3, '{CANDIDATE}', 0, 20)),
parts AS (SELECT rid, k, least, regexp_split_to_array(t, p) AS pieces, regexp_extract_all(t, p) AS hits,
                 CASE WHEN g = 1 THEN regexp_extract_all(t, '{quote(ASSIGN)}', 1) ELSE regexp_extract_all(t, p) END AS vals
          FROM d, kinds WHERE regexp_matches(t, p)),
each AS (SELECT rid, k, least, i, length(pieces[i]) AS a, length(hits[i]) AS b, vals[i] AS v
         FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM parts)),
placed AS (SELECT rid, k, v, least, CAST(sum(a + b) OVER w - b AS BIGINT) AS s, CAST(sum(a + b) OVER w AS BIGINT) AS e
           FROM each WINDOW w AS (PARTITION BY rid, k ORDER BY i)),
base AS (SELECT rid, k, s, e FROM placed WHERE k < 3 AND length(v) >= least),
cand AS (SELECT DISTINCT p.rid, p.s, p.e, p.v FROM placed p
         WHERE k = 3 AND NOT ({allowed})
           AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = p.rid AND b.s < p.e AND p.s < b.e)),
wins AS (SELECT rid, s, e, v, unnest(range(1, length(v) - {WINDOW} + 2)) AS o FROM cand),
chars AS (SELECT rid, s, e, v, o, substr(v, o + j, 1) AS ch FROM wins, range({WINDOW}) r(j)),
tally AS (SELECT rid, s, e, v, o, ch, count(*) AS c FROM chars GROUP BY ALL),
bits AS (SELECT rid, s, e, v, o, -sum(c / {WINDOW}.0 * log2(c / {WINDOW}.0)) AS h FROM tally GROUP BY ALL),
best AS (SELECT rid, s, e, CASE WHEN regexp_matches(v, '^[0-9a-fA-F]+$') THEN 3 ELSE 4 END AS k, max(h) AS h
         FROM bits GROUP BY rid, s, e, v),
spans AS (SELECT * FROM base UNION ALL SELECT rid, k, s, e FROM best
          WHERE h > CASE WHEN k = 3 THEN {THRESHOLDS["entropy_hex"]} ELSE {THRESHOLDS["entropy_base64"]} END),
told AS (SELECT rid, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
                string_agg([{", ".join(f"'{k}'" for k in KINDS)}][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k)
                  FILTER (k < 3) AS b,
                string_agg([{", ".join(f"'{k}'" for k in KINDS)}][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS a
         FROM spans GROUP BY rid)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN told USING (rid)"""


ORACLE = _sql()
