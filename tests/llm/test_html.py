"""Main text of pages: the density against a naive version, broken and hostile markup, and odd rows."""

import html as entities
import re
import time
from html.parser import HTMLParser
from math import e, log

import pytest

from mwspark.llm.html_text import Page, extract, main_text, op11_composite_text_density

DIR = "/root/testdata/sf0.001"
WORDS = "the quick brown fox jumps over a lazy dog while everybody watches from the garden fence and wonders why"


class Tree(HTMLParser):
    """Nested lists [name, child or text ..] of well-formed markup."""

    def __init__(self, source):
        super().__init__()
        self.stack = [["#page"]]
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        self.stack[-1].append([tag])
        self.stack.append(self.stack[-1][-1])

    def handle_endtag(self, tag):
        assert self.stack.pop()[0] == tag

    def handle_data(self, data):
        self.stack[-1].append(data)


def naive(node, share, in_link=False):
    """(characters, tags, link characters, link tags) and [(density, density sum)] in document order, by the formula as written."""
    in_link |= node[0] == "a"
    c = t = lc = lt = own = 0
    s, out = 0.0, []
    for x in node[1:]:
        if isinstance(x, str):
            own += len(" ".join(x.split()))
        else:
            (c1, t1, lc1, lt1), below = naive(x, share, in_link)
            c, t, lc, lt, s, out = c + c1, t + t1 + 1, lc + lc1, lt + lt1 + (x[0] == "a"), s + below[0][0], out + below
    c, lc = c + own, lc + (own if in_link else 0)

    def density(c, t, lc, lt):
        if not c:
            return 0.0
        t1, lc1, lt1 = t or 1, lc or 1, lt or 1
        return c / t1 * max(0, log(c / lc1 * t1 / lt1)) / log(log(c / ((c - lc) or 1) * lc1 + share * c + e))

    return (c, t, lc, lt), [(density(c, t, lc, lt), s + density(own, 0, 0, 0)), *out]


def test_densities_are_those_of_the_formula():
    source = (
        f"<html><body><div><a>one two</a><a>three</a></div><div><h1>Title</h1><p>{WORDS}<a>link</a>{WORDS}</p><p>{WORDS * 3}</p>"
        f"<table><tr><td>cell</td><td><b>{WORDS}</b></td></tr></table></div><div><a>{WORDS}</a></div></body></html>"
    )
    page = Page(source)
    share = page.all_links / page.all_chars
    got = page.densities()
    _, want = naive(Tree(source).stack[0], share)
    assert len(want) == len(page.names) > 15
    assert list(zip(*got, strict=True)) == [pytest.approx(x) for x in want]
    assert main_text(source).split("\n")[0] == "Title" and main_text(source).count("\n") == 4


def test_boilerplate_goes_and_the_article_stays():
    article = f"<h1>A title</h1><header><p>By someone</p></header><section><p>{WORDS} <a href=x>a link</a></p><ul><li>one<li>two</ul></section><section><h2>Sub</h2><p>Short.</p><aside>no</aside><div class=ad>no</div></section>"
    want = ["A title", "By someone", f"{WORDS} a link", "one", "two", "Sub", "Short."]
    around = f"""<head><title>no</title></head><body class=has-sidebar><header>no</header><nav>no</nav><div id=cookie-notice>no {WORDS}</div><div role=navigation>no</div>
      %s<div class="sidebar">no {WORDS * 9}</div><section id=comments><article class=comment><p>no {WORDS * 9}</p></article></section><form><p>no</p></form><footer>no</footer></body>"""
    for inner in (f"<article class='post comments-open'>{article}</article>", f"<main>{article}</main>", f"<div role=main>{article}</div>", f"<div class=content>{article.replace('header>', 'div>')}</div>", f"<div><div>{article.replace('header>', 'div>')}</div></div>"):
        assert main_text(around % inner).split("\n") == want
    assert main_text(f"<body><div>(c) us</div><h1>Head</h1><div><div><p>{WORDS}<p>{WORDS}</div><p>Small</p><div><p>{WORDS * 2}<p>{WORDS}</div></div><ul><li><a>More</a><li><a>Even more</a></ul></body>").split("\n") == ["Head", WORDS, WORDS, "Small", WORDS * 2, WORDS]
    two = f"<article><p>{WORDS}</p></article><article><p>{WORDS} again</p></article><article>no</article>"
    assert main_text(two).split("\n")[:2] == [WORDS, WORDS + " again"]


def test_markup_as_browsers_read_it():
    cases = {
        "": "", "plain &lt;b&gt; &amp t": "plain <b> & t", "a < b and c > d": "a < b and c > d", "<nav>menu</nav>": "", "<p>x<!-- y": "x", "<p>x<!-- > -->y<!-->z": "xyz", "x<p>a</i>b</p>c": "x\nab\nc",
        "<div><p>A<p>B</div>": "A\nB", "<table><tr><td>1<td>2<tr><td>3</table>": "1\n2\n3", "<pre>a\n  b</pre>": "a b", "a<br>b<br/>c": "a b c", "a&nbsp; b": "a b", "<b>b</b>old": "bold",
        "<p title='a>b' x=\"<p>\">t</p>": "t", "<script>if (a<b) x='<p>no</p>'</scripty></script>t": "t", "<p>a<foo": "a", "<P>A<SCRIPT>no</Script>B": "AB", "a</p>b": "a\nb", "&#8212;&#x41;&notin;": "—A∉", "<textarea><p>no": "",
        "<dl><dt>a<dd>b<dt>c</dl>": "a\nb\nc", "<p>a<b>b<p>c</b>d": "ab\ncd", "<p hidden>no</p><p style='display: none'>no</p><p>t": "t", "<head><meta><p>t": "t", "<title>no</title>t": "t",
    }
    for source, want in cases.items():
        assert main_text(source) == want, source
    assert main_text(None) == ""


def test_hostile_pages_take_linear_time():
    n = 30_000
    began = time.time()
    assert main_text("<div>" * n + "text") == "text"
    for bad in ('<a "', '<a x="', "<!-", "<", "&am", "<p><b>", "<h1>", "<ul><li>x", "<a>y</a>", "<table>"):
        main_text(bad * n)
    assert main_text("<h2>x</h2>" * n + f"<div><p>{WORDS}</div>").count("\n") == n
    assert main_text(f"<article><p>{'word ' * 1_000_000}</p></article>") == ("word " * 1_000_000).strip()
    assert time.time() - began < 30


def test_whole_table(spark):
    got = op11_composite_text_density(spark, DIR).toPandas().set_index("page_id")
    pages = spark.read.parquet(f"{DIR}/pages.parquet").toPandas()
    assert len(got) == len(pages) > 0
    for page_id, source in zip(pages.page_id, pages.html, strict=True):
        inner = re.search(r"<article>(.*?)(?:</article>|$)", source, re.S)[1]  # the only boxes in these articles are h1 and p
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got.text[page_id] == "\n".join(b for b in blocks if b) and got.n_chars[page_id] == len(got.text[page_id])


def test_odd_rows(spark):
    rows = [(1, "u", None, "t"), (1, "u", "", "t"), (None, None, "<p>x", "t"), (1, "u", "<p>x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(df)
    assert got.columns == ["page_id", "url", "html", "text"] and sorted(r.text for r in got.collect()) == ["", "", "x", "x"]
    assert extract(df.where("false")).count() == 0
