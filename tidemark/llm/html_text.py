"""Main text of HTML pages by line-block distribution.

A page is stripped of markup into lines, one for each block of text. Every line weighs its characters, less those inside
links; a line of which links are half weighs nothing. Inside an article container links count as text. What elements, roles, classes and ids say can only lower a weight: a
line in a menu, header, footer, sidebar, notice, advert, form or reader comments, or a notice of rights, weighs its length below
zero, or is taken out where it stands inside an article container. Where article containers hold ``SHARE`` of the text
that isn't boilerplate, lines outside them, and in those much smaller than the largest, weigh ``ASIDE`` characters less, but
for a headline directly before the first.

Weights are summed over a window of ``WINDOW`` lines from each line on, as far as the first line below zero. The text surges
where a sum rises above ``SURGE``, or is the page's largest, and does not fall back to nothing at once, and dives where a sum
isn't above zero. All lines from a surge to its dive are kept, whatever they weigh by themselves, with a headline right
before the first surge, and no others.

Defined results: a null or empty page has an empty text; a page whose lines all weigh nothing has an empty text; pages of
any length are read whole; broken or unclosed markup is read as far as it goes; repeated rows have equal results; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE, ASIDE = 3, 60, 120
#: Share of the text that isn't boilerplate from which article containers speak for the page.
SHARE = 0.25
#: Elements whose content is never text.
SILENT = frozenset("script style noscript template svg math canvas iframe object head title textarea select".split())
#: Elements that are boilerplate as a whole.
OUTSIDE = frozenset("nav footer aside form button dialog menu".split())
#: Elements within a line; all others begin a new one.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter nobr output picture "
    "progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that mark boilerplate.
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|popup|modal|newsletter|subscribe|"
    r"nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer\w*|foot|masthead|header|toolbar|pagination|pager|share|sharing|"
    r"social\w*|related|recommend\w*|widget\w*|comments?|commentlist|comment-\w+|disqus\w*|respond|replies|reply|login|"
    r"signup|search|skip|copyright|legal|disclaimer|tags|contentinfo|navigation|complementary|alert|gdpr)(?=$|[\s_-])",
    re.IGNORECASE,
)
ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:article|post|entry|story|content|main)[_-]?(?:body|content|text|main)?(?:$|\s)", re.IGNORECASE
)
#: Inside an article, or in its name, a header is the article's own.
_OWN_HEAD = re.compile(r"header|masthead", re.IGNORECASE)
#: Attributes of what a reader doesn't see.
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|/|$)", re.IGNORECASE)
#: Inside an article, a whole class or role: a word that marks boilerplate, with what often stands around it.
_BOILER_WORD = BOILER.pattern[len(r"(?:^|[\s_-])") : -len(r"(?=$|[\s_-])")]
_PART = re.compile(
    rf"(?:(?:post|entry|article|story|site|page|inline|wp)[_-])?{_BOILER_WORD}(?:[_-](?:{_BOILER_WORD}|posts?|articles?|stories|links?|buttons?|"
    r"box|bar|lists?|items?|container|wrapper|block|section|area|form|unit|slot|message|media|nav|icons?|title|widget))?",
    re.IGNORECASE,
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>",  # a tag with an open quote
    re.DOTALL,
)
_ATTR = re.compile(r"([A-Za-z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_SPACE = re.compile(r"\s+")
_RIGHTS = re.compile("©.{0,100}$")
_P_ENDS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section "
    "table ul".split()
)


def _hidden(attrs: str, values: list[tuple[str, str]]) -> bool:
    """Whether parsed attributes say that a reader doesn't see the element."""
    for name, value in values:
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _NO_DISPLAY.search(value)):
            return True
    return bool(_BARE_HIDDEN.search(_ATTR.sub(" ", attrs)))


def lines(html: str) -> list[tuple[str, int, bool, int, bool]]:
    """(text, characters outside links, boilerplate, article number or -1, first headline) of each line of a page."""
    out: list[tuple[str, int, bool, int, bool]] = []
    text: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # element, boilerplate, article
    boiler, article, articles, in_link = False, -1, 0, 0
    open_: dict[str, int] = {}  # how many of each element are open
    lists: list[int] = []  # places of open lists and their items

    def leave(k: int) -> tuple[bool, int]:
        """Close all elements from place k on."""
        for name, *_ in stack[k:]:
            open_[name] -= 1
        del stack[k:]
        while lists and lists[-1] >= k:
            lists.pop()
        return (stack[-1][1], stack[-1][2]) if stack else (False, -1)

    def flush() -> None:
        if text:
            line = _SPACE.sub(" ", unescape("".join(text))).strip()
            if line:
                linked = len(_SPACE.sub(" ", unescape("".join(links))).strip())
                out.append((line, max(0, len(line) - linked), boiler, article, any(s[0] == "h1" for s in stack[-3:])))
            text.clear()
            links.clear()

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        chunk = html[at : m.start()] if m else html[at:]
        if chunk:
            text.append(chunk)
            if in_link:
                links.append(chunk)
        if not m:
            break
        at = m.end()
        closing, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name == "br":
            text.append(" ")
            continue
        if name not in INLINE:
            flush()
        if closing:
            if open_.get(name):  # else there is nothing to look for
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                boiler, article = leave(k)
            if name == "a":
                in_link = 0
            continue
        if name in SILENT:
            if attrs.rstrip().endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(html, at)
            if name == "head" and not end:
                end = re.compile(r"(?=<body)", re.IGNORECASE).search(html, at)
            at = end.end() if end else n
            continue
        if name in VOID or attrs.endswith("/"):
            continue
        if name in _P_ENDS:
            k = next((k for k in range(len(stack) - 1, max(len(stack) - 4, -1), -1) if stack[k][0] == "p"), None)
            if k is not None:  # an open paragraph ends here
                boiler, article = leave(k)
        elif name == "li" and lists and stack[lists[-1]][0] == "li":
            boiler, article = leave(lists[-1])
        values = _ATTR.findall(attrs)
        named = " ".join(v.strip("\"'") for a, v in values if a.lower() in ("class", "id", "role"))
        said = _OWN_HEAD.sub(" ", named) if article >= 0 or ARTICLE.search(named) else named
        bad = boiler or name in OUTSIDE or (name == "header" and article < 0)
        if article >= 0:
            own = " ".join(v.strip("\"'") for a, v in values if a.lower() in ("class", "role"))
            bad = bad or any(_PART.fullmatch(x) for x in _OWN_HEAD.sub(" ", own).split())
        else:
            bad = bad or bool(said and BOILER.search(said))
        bad = bad or _hidden(attrs, values)
        if name in ("body", "html", "article", "main"):
            bad = boiler
        if not boiler and article < 0 and (name in ("article", "main") or (named and name in ("div", "section", "main") and not bad and ARTICLE.search(named))):
            article, articles = articles, articles + 1
        if name in ("li", "ul", "ol"):
            lists.append(len(stack))
        stack.append((name, bad, article))
        open_[name] = open_.get(name, 0) + 1
        boiler = bad
        if name == "a":
            in_link = 1
    flush()
    return out


def weights(found: list[tuple[str, int, bool, int, bool]]) -> list[int | None]:
    """What each line adds to the sums over windows; None takes it out."""
    size: dict[int, int] = {}
    outside = 0
    for text, plain, bad, article, _ in found:
        if not bad and article >= 0:
            size[article] = size.get(article, 0) + len(text)
        elif not bad:
            outside += plain
    inside, most = sum(size.values()), max(size.values(), default=0)
    chosen = inside > 0 and inside >= SHARE * (inside + outside)
    own = {k for k, n in size.items() if n >= SHARE * most}
    first = next((k for k, line in enumerate(found) if not line[2] and line[3] in own), 0)
    out: list[int | None] = []
    for k, (text, plain, bad, article, headline) in enumerate(found):
        if bad or _RIGHTS.match(text):
            out.append(None if article >= 0 else -len(text))
            continue
        weight = len(text) if article >= 0 else plain if 2 * plain > len(text) else 0
        if chosen and article not in own and not (headline and k == first - 1):
            weight -= ASIDE
        out.append(weight)
    return out


def window_sums(weight: list[int], window: int = WINDOW) -> list[int]:
    """Sums over ``window`` lines from each line on, as far as the first line below zero."""
    out = []
    for i in range(len(weight)):
        total = 0
        for w in weight[i : i + window]:
            if w < 0 and total:
                break
            total += w
            if w < 0:
                break
        out.append(total)
    return out


def between(weight: list[int], window: int = WINDOW, surge: int = SURGE) -> list[bool]:
    """Which lines lie between a surge and a dive."""
    sums = window_sums(weight, window)
    rise = min(surge, max(sums, default=0) - 1)
    n, inside, kept = len(weight), False, [False] * len(weight)
    for i in range(n):
        if inside:
            inside = sums[i] > 0
        elif weight[i] > 0 and sums[i] > rise:  # and not back to nothing at once
            inside = weight[i] > rise or sums[i] > weight[i]
        kept[i] = inside
    return kept


def extract(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """Main text of a page, one line a block."""
    found = lines(html or "")
    kept = [(line[0], w) for line, w in zip(found, weights(found)) if w is not None]
    text, weight = [t for t, _ in kept], [w for _, w in kept]
    marks = between(weight, window, surge)
    first = next((i for i, k in enumerate(marks) if k), 0)
    while first and weight[first - 1] > 0:  # a headline before the surge
        first -= 1
        marks[first] = True
    return "\n".join(t for t, k in zip(text, marks) if k)


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
