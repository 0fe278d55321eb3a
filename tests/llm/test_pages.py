"""Main text of pages: a plain version with a parser of its own, pages marked by hand, awkward tables."""

import os
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pyarrow.parquet as pq

from tidemark.llm import html_text, media

DATA = os.environ.get("TIDEMARK_DATA", "/root/testdata/sf0.001")
A = "The harbour opened again on Monday after two weeks of repairs, and the first boats left before dawn."
B = "Fishers said that the new lights along the pier had made the narrow channel much easier to follow."
C = "Short but mine."
D = "The council will decide in spring whether the old crane is to be moved or scrapped for good."

#: (page, its main text as marked by hand)
MARKED = [
    (f"<body><nav><a href=1>Home</a><a href=2>News</a></nav><article><h1>Harbour</h1><p>{A}</p><p>{C}</p><aside>{D}</aside><p>{B}</p></article><footer>{D}</footer></body>", ["Harbour", A, C, B]),
    (f"<body><div class='menu'><a href=1>Home</a></div><div class='post-content'><h2>Harbour</h2><p>{A}<br>{B}</p></div><div id='comments'><p>{D} {D}</p></div></body>", ["Harbour", f"{A} {B}"]),
    (f"<body><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>Sport</a></li></ul><h1>Harbour</h1><p>{A}</p><p>{B}</p><p>See <a href=9>more about this harbour here</a></p><p>{D}</p><ul><li><a href=4>Imprint</a></li><li><a href=5>Terms</a></li><li><a href=6>Help</a></li></ul></body>",
     ["Harbour", A, B, "See more about this harbour here", D]),
    (f"<body><div><a href=1>One</a></div><div><a href=2>Two</a></div><div>{A}</div><div>{B}</div><div><a href=3>Three</a></div><div>© 2020 someone</div></body>", [A, B]),
    (f"<main><header><h1>Harbour</h1><p>By a writer</p></header><p>{A}</p><div class='newsletter-signup'>{B}</div><p>{D}</p></main><p>{B}</p>", ["Harbour", "By a writer", A, D]),
    (f"<body><header><p>{D}</p></header><article><p>{A}</p><form><p>{B}</p><input></form><div class='share-buttons'>Share</div><blockquote>{C}</blockquote></article><article><h3>Teaser</h3></article></body>", [A, C]),
    (f"<body><div role='dialog' aria-hidden='true'>{D}</div><div class='cookie-consent'>{D}</div><h1>Harbour</h1><article><table><tr><td>{C}</td><td>1&nbsp;&lt;&nbsp;2</td></tr></table><pre>a   b</pre></article><section class='related'><p>{A}</p></section></body>", ["Harbour", C, "1 < 2", "a b"]),
]


class Plain(HTMLParser):
    """Lines of a well-formed page by the standard library's parser: (text, characters outside links, boilerplate, in an article, headline)."""

    def __init__(self, page):
        super().__init__()
        self.open, self.parts, self.found, self.articles = [], [], [], 0
        self.feed(page)
        self.end()

    def end(self):
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            linked = len(" ".join("".join(t for t, a in self.parts if a).split()))
            self.found.append((text, max(0, len(text) - linked), any(b for _, b, _ in self.open), max((c for _, _, c in self.open), default=0), any(n == "h1" for n, *_ in self.open[-3:])))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append((" ", False))
        if tag in html_text.VOID:
            return
        if tag not in html_text.INLINE:
            self.end()
        if tag in ("p", "li") and self.open and self.open[-1][0] == tag:
            self.open.pop()
        attrs = {k: v or "" for k, v in attrs}
        named = " ".join(attrs.get(k, "") for k in ("class", "id", "role"))
        article = any(c for *_, c in self.open)
        said = re.sub("header|masthead", " ", named) if article or html_text.ARTICLE.search(named) else named
        bad = tag in html_text.OUTSIDE or (tag == "header" and not article) or bool(html_text.BOILER.search(said)) or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
        bad = bad and tag not in ("body", "html", "article", "main")
        own = not any(b for _, b, _ in self.open) and not bad and (tag in ("article", "main") or tag in ("div", "section") and bool(html_text.ARTICLE.search(named)))
        own = own and not article
        self.articles += own
        self.open.append((tag, bad, self.articles if own else 0))

    def handle_endtag(self, tag):
        if tag not in html_text.INLINE:
            self.end()
        if tag in [n for n, *_ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(n in html_text.SILENT for n, *_ in self.open):
            self.parts.append((data, any(n == "a" for n, *_ in self.open)))


def plain_text(page):
    """The main text by the module's description, line by line."""
    found = Plain(page).found
    size = Counter()
    for t, _, bad, article, _ in found:
        size[article] += len(t) if article and not bad else 0
    inside, around = sum(size.values()), sum(n for _, n, bad, article, _ in found if not bad and not article)
    own = {k for k, n in size.items() if n and n >= html_text.SHARE * max(size.values())}
    first = min((k for k, line in enumerate(found) if line[3] in own and not line[2]), default=None)
    rows = []
    for k, (text, n, bad, article, headline) in enumerate(found):
        bad = bad or (text[0] == "©" and len(text) <= 101)
        if bad and article:
            continue
        weight = -len(text) if bad else len(text) if article else n if 2 * n > len(text) else 0
        if not bad and article not in own and inside and inside >= html_text.SHARE * (inside + around) and not (headline and k + 1 == first):
            weight -= html_text.ASIDE
        rows.append((text, weight))

    def total(i):
        got = 0
        for _, w in rows[i : i + html_text.WINDOW]:
            if w < 0 and got:
                return got
            got += w
            if w < 0:
                return got
        return got

    sums = [total(i) for i in range(len(rows))]
    rise = min(html_text.SURGE, max(sums, default=0) - 1)
    kept, i = [], 0
    while i < len(rows):
        if rows[i][1] > 0 and sums[i] > rise and (rows[i][1] > rise or sums[i] != rows[i][1]):
            while not kept and i and rows[i - 1][1] > 0:
                i -= 1
            while i < len(rows) and (sums[i] > 0 or not kept):
                kept.append(rows[i][0])
                i += 1
        else:
            i += 1
    return "\n".join(kept)


def test_marked_pages():
    found = wanted = common = 0
    for page, want in MARKED:
        got = html_text.extract(page).split("\n")
        assert got == want
        found, wanted, common = found + len(got), wanted + len(want), common + len(set(got) & set(want))
    assert common == found == wanted  # precision and recall by line


def test_every_page_by_a_plain_version():
    pages = pq.read_table(f"{DATA}/pages.parquet").column("html").to_pylist()
    assert [html_text.extract(p) for p in pages] == [plain_text(p) for p in pages]


def test_marks_never_lift_a_line():
    pages = pq.read_table(f"{DATA}/pages.parquet").column("html").to_pylist() + [p for p, _ in MARKED]
    for page in pages:
        lines = html_text.lines(page)
        assert all(w is None or w <= len(text) for w, (text, *_) in zip(html_text.weights(lines), lines))


def test_the_distribution_decides_without_marks():
    items = "".join(f"<div>{w}</div>" for w in ("Home", "News", "Sport"))
    page = f"<body>{items}<div><a href=1>{A}</a></div><div><a href=2>{C}</a></div><div><a href=3>{C}</a></div><p>{A}</p><p>{C}</p><p>{B}</p><div><a href=1>Imprint</a></div>" + "<div><a href=4>x</a></div>" * 3 + f"{items}</body>"
    assert html_text.extract(page).split("\n")[:3] != ["Home", "News", "Sport"]
    assert html_text.extract(page).split("\n")[-4:-1] == [A, C, B] or html_text.extract(page).split("\n")[:3] == [A, C, B]
    assert "Sport" not in html_text.extract(page)  # short lines after the dive don't surge again


def test_a_second_story_stays():
    story = "".join(f"<p>{A} {B} {k}</p>" for k in range(2))
    page = f"<body><article><p>{A}</p><p>{B}</p></article><nav>menu</nav><div>{story}</div><p>{C}</p></body>"
    assert html_text.extract(page).split("\n") == [A, B, *[f"{A} {B} {k}" for k in range(2)]]
    assert html_text.extract(f"<article><p>{A}</p><p>© 2020 someone</p><p>{B}</p></article>").split("\n") == [A, B]


def test_broken_markup_takes_linear_time():
    def seconds(page):
        began = time.process_time()
        html_text.extract(page)
        return time.process_time() - began

    for one in (lambda n: "<div>" * n + "</span>" * n, lambda n: "<div>" * n + "<li></li>" * n, lambda n: "<div>" * n + "<p>x" * n, lambda n: "<li><ul>" + "<div>" * n + "<li></li>" * n, lambda n: "<svg/>" * n):
        assert seconds(one(40_000)) < 16 * max(seconds(one(5_000)), 0.02)  # eight times as long, not 64


def test_a_very_long_page_and_no_pages(spark):
    page = "<body><nav><p>menu</p></nav><article>" + "".join(f"<p>{A} {i}</p>" for i in range(30_000)) + f"</article><footer>{D}</footer></body>"
    rows = spark.createDataFrame([(1, "u", page)] * 2, "page_id long, url string, html string")
    assert [r.text for r in html_text.main_text(rows).collect()] == ["\n".join(f"{A} {i}" for i in range(30_000))] * 2
    assert html_text.main_text(rows.limit(0)).count() == 0


def test_only_whole_attributes_are_references():
    other, own = "0" * 64, "1" * 64
    page = f"<p>a</p><img data-src='media:{other}'><img data-src='media:{other}' src='media:{own}' data-alt='no' alt='yes'>"
    assert [(i["digest"], i["caption"]) for i in media.parse(page) if i["digest"]] == [(own, "yes")]
