"""Column expressions against plain-Python models."""

import html as stdlib_html
import random
import re
import time
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from linkloom.functions import html, text, urls
from linkloom.operators import extract


def evaluate(spark, rows, names, *columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *names])
    return [tuple(r)[1:] for r in sorted(df.select("i", *columns).collect())]


class Walker(HTMLParser):
    """Text nodes and hrefs by the standard library parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.hrefs, self.raw = [""], [], False

    def handle_starttag(self, tag, attrs):
        self.nodes.append("")
        self.raw = tag in ("script", "style")
        found = [value or "" for name, value in attrs if name == "href"]
        if tag == "a" and found:
            self.hrefs.append(found[-1])

    def handle_endtag(self, tag):
        self.nodes.append("")
        self.raw = False

    def handle_comment(self, data):
        self.nodes.append("")

    handle_pi = handle_decl = unknown_decl = handle_comment

    def handle_data(self, data):
        if not self.raw:
            self.nodes[-1] += data

    @classmethod
    def run(cls, page):
        walker = cls()
        walker.feed(page)
        walker.close()
        return " ".join(n.strip() for n in walker.nodes if n.strip()), walker.hrefs


GOLDEN = """<!DOCTYPE html><html><head><title>Test | Test</title><style>p{}</style></head><body>
<h1>Test</h1><!-- hidden --><p>Mayonaka no Door</p><p>Hype Boy</p><p>Neon Genesis Evangelion</p>
<ul><li>test</li><li>test</li><li>test</li><li>test</li><li>test</li></ul>
<a href="https://www.google.com/">Google</a> <a href="https://www.wikipedia.org/">Wikipedia</a></body></html>"""

PAGES = [
    GOLDEN,
    "<p>a<!-- c --><b>b</b>c &amp; d &lt;x&gt; &#169; &#xe9; &nbsp; &hellip;&copy;2020",
    '<A HREF="/up">Up</A><a href=\'/single?a=1&amp;b=2\'>s</a><a href=/bare>b</a><a name=x>no</a><a href>e</a>',
    '<img alt="a > b"><a title="x > y" href="/q">q</a><a data-href="/no">n</a><abbr href="/no2">z</abbr>',
    '<script>var s = "<a href=\'/js\'>x</a>";</script><!-- <a href="/comment">c</a> --><a href = "/sp" >sp</a>',
    "1 < 2 and 3 > 2 <b>bold</b> <br/> <p>open<p>next",
    "<STYLE>p{}</STYLE>x<SCRIPT type='a'>if (a<b) {}</SCRIPT>y",
    "plain words only",
    "",
    "<p>don't <i title=it's>stop</i> now",
    "<a\nhref='/nl'\n>multi\nline</a><a href='/1' href='/2'>two</a>",
]


def test_page_text_and_links_match_parser(spark):
    got = evaluate(spark, [(p,) for p in PAGES], ["html"], html.page_text(F.col("html")), html.page_hrefs(F.col("html")))
    for page, (shown, hrefs) in zip(PAGES, got):
        want_text, want_hrefs = Walker.run(page)
        assert shown == want_text, page
        # The parser keeps the first of repeated attributes' values differently from a browser tree.
        assert hrefs == want_hrefs, page


def test_golden_page(spark):
    [(shown, body, hrefs)] = evaluate(
        spark, [(GOLDEN,)], ["html"],
        html.page_text(F.col("html")), html.page_body_text(F.col("html")), html.page_hrefs(F.col("html")),
    )
    tail = ("Test Mayonaka no Door Hype Boy Neon Genesis Evangelion"
            " test test test test test Google Wikipedia")
    assert shown == "Test | Test " + tail
    assert body == tail
    assert hrefs[0] == "https://www.google.com/"


def test_body_text_edges(spark):
    pages = [
        "<title>t</title><p>no body tag</p>",
        "<head><title>t</title></head><p>x",
        "<!-- <body>fake --><head><title>t</title></head><body class='a>b'>real</body>",
        "<script>'<body>'</script><title>t</title><BODY>real",
    ]
    got = evaluate(spark, [(p,) for p in pages], ["html"], html.page_body_text(F.col("html")))
    assert [g[0] for g in got] == ["no body tag", "x", "real", "real"]


def test_hidden_elements(spark):
    page = "<ruby>kan<rp>(</rp><rt>reading</rt><rp>)</rp></ruby><template><p>later</p></template>end"
    assert evaluate(spark, [(page,)], ["html"], html.page_text(F.col("html"))) == [("kan end",)]


def test_unescape_matches_standard_library(spark):
    rng = random.Random(7)
    names = sorted(stdlib_html.entities.html5)
    cases = ["&amp;lt;", "&&amp;", "&", "& b", "&bogus;", "&#0;", "&#128;", "&#x1F600;", "&#xD800;", "&#99999999999;",
             "&copyleft", "&notit;", "&ampx", "&lt&gt", "&#65", "&#x41;&#66;z"]
    cases += ["x&" + rng.choice(names) + rng.choice(["", ";", "tail", " ", "=1"]) for _ in range(400)]
    got = evaluate(spark, [(c,) for c in cases], ["t"], html.unescape(F.col("t")))
    for case, (shown,) in zip(cases, got):
        assert shown == stdlib_html.unescape(case), case


def test_long_page_needs_no_stack(spark):
    page = "<p " + "x='1' " * 50_000 + ">" + "<b>w</b>" * 50_000 + "<a href='" + "u" * 500_000 + "'>z</a>"
    [(shown, hrefs)] = evaluate(spark, [(page,)], ["html"], html.page_text(F.col("html")), html.page_hrefs(F.col("html")))
    assert len(shown.split()) == 50_001 and len(hrefs[0]) == 500_000


BASES = ["http://o.example/d/e/f.html?k=v#top", "https://o.example", "https://o.example/", "http://o.example/a//b/", "HTTP://O.example:80/x;p?q"]
HREFS = [
    "", "a", "./a", "../a", "../../a", "../../../a", "a/", "a/.", "a/..", "a//b", "/a//b", "/a/../b", "/..", "/.", "..", ".",
    "?q", "#t", "?q#t", "?", "#", "a?", "a#", "//h/x", "//h", "//h/a/../b", "http://h/x", "https://h/x/../y", "HTTPS://H/x", "mailto:me@x",
    "javascript:void(0)", "https:foo", "http:foo", "http:/foo", "  /sp", "/t\tab\n", "tel:1", "a;p", "a;", ";x", "a/b;c/d", "é/ü", "a b",
    "a/./b", "a/../b/../c", "/a/./", "data:text/plain,x", "x:y", "1:2", "a:b/c", "/a/...", ".../a", "?a=/../b", "#/../b", "http://h?x", "http://h#",
]


def test_links_match_urljoin(spark):
    cases = [(b, h) for b in BASES for h in HREFS]
    rng = random.Random(11)
    alphabet = ["a", "b", "/", "/", ".", "..", "./", "../", "?", "#", ";", "x=1", "//"]
    cases += [(rng.choice(BASES), "".join(rng.choices(alphabet, k=rng.randint(1, 8)))) for _ in range(600)]
    got = evaluate(
        spark, cases, ["b", "h"],
        urls.page_origin(F.col("b")), urls.resolve_on_origin(F.col("b"), F.col("h")), urls.resolve_on_page(F.col("b"), F.col("h")),
    )
    for (base, href), (origin, on_origin, on_page) in zip(cases, got):
        parsed = urlparse(base)
        want = f"{parsed.scheme}://{parsed.netloc}"
        assert origin == want
        if re.search(r"(^|/)\.\.?;", href):
            continue  # dot segments with parameters: no two resolvers agree
        assert on_origin == urljoin(want, href), (base, href)
        assert on_page == (urljoin(base, href) if href else base.split("#")[0].replace("HTTP:", "http:")), (base, href)


TEXTS = [
    "The cat, the DOG and I — i am\tnot here .", "", "   ", "the of and", ". , ...", "a b c\x1cd\x85e", "Straße ÉCOLE İx",
    "x\n\ny\r\nz", " lead and trail ",
]


def test_tokens(spark):
    got = evaluate(spark, [(t,) for t in TEXTS], ["t"],
                   text.tokens(F.col("t")), text.clean_tokens(F.col("t")), text.is_blank(F.col("t")), text.strip(F.col("t")))
    drop = {*text.STOP_WORDS, *text.PUNCTUATION}
    for raw, (words, kept, blank, stripped) in zip(TEXTS, got):
        assert words == raw.lower().split()
        assert kept == [w for w in raw.lower().split() if w not in drop]
        assert blank == (not raw.strip())
        assert stripped == raw.strip()
    assert len(set(text.STOP_WORDS)) == 102 and len(set(text.PUNCTUATION)) == 49


def test_round_half_even(spark):
    values = [0.125, 0.375, 2.5, 1.005, -0.125, 7.0]
    got = evaluate(spark, [(v,) for v in values], ["v"], text.round_half_even(F.col("v"), 2))
    assert [g[0] for g in got] == [round(v * 100) / 100 for v in values]


def test_given_pages_match_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.select("html", html.page_text(F.col("html")).alias("shown"), html.page_hrefs(F.col("html")).alias("hrefs"))
    for row in rows.collect():
        assert (row.shown, row.hrefs) == Walker.run(row.html)


PIECES = [
    "<p>", "</p>", "<b>", "text", "a < b", " & ", "&amp;", "<a href='x'>", '<a href="y">', "</a>", "<a href=z>", "<a>",
    "<!-- c -->", "<br/>", "<script>v='<p>'</script>", "<style>s</style>", "<div class='a>b'>", "\n", " ",
    '<a title="q>r" href=/s>', "<a href>", "<A HREF = /u>", "it's", '"q"', "<!DOCTYPE html>", "<?pi x?>", "</ x>", "<1>",
    "<>", "='", "<img src=a'b>", "<a\thref=t\n>", "&#65;", "&bogus", "<a/href=v>", "<p a=b=c>", "<td x = 'y' z>", "1>2",
]


def test_random_markup_matches_parser(spark):
    rng = random.Random(12)
    pages = ["".join(rng.choices(PIECES, k=rng.randint(1, 9))) for _ in range(2000)]
    got = evaluate(spark, [(p,) for p in pages], ["html"], html.page_text(F.col("html")), html.page_hrefs(F.col("html")))
    for page_html, row in zip(pages, got):
        assert row == Walker.run(page_html), page_html


class Follower(HTMLParser):
    """Text outside of hiding elements, with a stack of open elements; an end tag closes all opened since its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.nodes = [], [""]

    def handle_starttag(self, tag, attrs):
        self.nodes.append("")
        if tag not in html.VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.nodes.append("")

    def handle_endtag(self, tag):
        self.nodes.append("")
        while tag in self.stack and self.stack.pop() != tag:
            pass

    def handle_comment(self, data):
        self.nodes.append("")

    def handle_data(self, data):
        if not {*html.HIDING, "script", "style"} & {*self.stack}:
            self.nodes[-1] += data

    @classmethod
    def run(cls, page):
        walker = cls()
        walker.feed(page)
        walker.close()
        return " ".join(n.strip() for n in walker.nodes if n.strip())


HIDING_PIECES = [
    "<template>", "</template>", "<rt>", "</rt>", "<rp>", "</rp>", "<p>", "</p>", "<b>", "</b>", "<ruby>", "</ruby>", "<br>",
    "<template/>", "<div class='x'>", "</div>", "</body>", "<img src=x>", " a ", " b ", " c ", " &amp; ", "<!-- <rt> -->",
    "<script>'<rt>'</script>", "<RT lang=ja>", "</Rt >", "<template id='a/'>",
]


def test_nested_and_unclosed_hidden_elements_match_parser(spark):
    rng = random.Random(14)
    pages = [
        "<template>a<template>b</template>c</template>d", "<ruby>k<rt>a<rt>b</rt></ruby>e", "<p>x<template>never closed</p>z",
        "<template><div>in</div></template>out", "<div><rt>a<div>b</div>c</div>d", "</template>a<rt>b",
    ]
    pages += ["".join(rng.choices(HIDING_PIECES, k=rng.randint(1, 40))) for _ in range(1500)]
    got = evaluate(spark, [(p,) for p in pages], ["html"], html.page_text(F.col("html")))
    for page, (shown,) in zip(pages, got):
        assert shown == Follower.run(page), page


@pytest.mark.parametrize("tag, shown", [("<rt>x", 0), ("<template>x", 0), ("<rp><b>x", 0), ("<rt>a</rt>b", 399_999)])
def test_hidden_elements_cost_no_more_than_the_page(spark, tag, shown):
    start = time.time()
    pages = spark.range(1).select(F.repeat(F.lit(tag), 200_000).alias("html"))
    length = pages.select(F.length(html.page_text(F.col("html"))).alias("n")).first()["n"]
    assert length == shown and time.time() - start < 60


def test_links_resolve_on_the_base_that_a_page_names(spark):
    url = "http://s.org/x/y.html"
    anchors = '<a href="p">1</a><a href="/q">2</a><a href="">3</a><a href="//t/z">4</a>'
    heads = {
        '<base href="/docs/v2/">': "http://s.org/docs/v2/",
        "<BASE target=_top><base HREF='http://other.org/a/b'>": "http://other.org/a/b",
        '<base href="sub/"><base href="/late/">': "http://s.org/x/sub/",
        '<!-- <base href="/no/"> --><script>"<base href=/no/>"</script><basefont href="/no/">': url,
        '<base href="javascript:void(0)">': url,
        '<base href="https://u.org/k/">': "https://u.org/k/",
        "": url,
    }
    rows = [(i, url, f"<head>{head}</head><body>{anchors}</body>") for i, head in enumerate(heads)]
    pages = spark.createDataFrame([*rows, (99, url, None)], "page_id bigint, url string, html string")
    found = {}
    for row in extract.page_links(pages, on_page=True).orderBy("page_id", "pos").collect():
        found.setdefault(row.page_id, []).append(row.url)
    assert found == {i: [urljoin(base, h) if h else base for h in ("p", "/q", "", "//t/z")] for i, base in enumerate(heads.values())}
    assert extract.page_links(pages).columns == extract.page_links(pages, on_page=True).columns
