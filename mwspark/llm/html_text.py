"""Main text of web pages by composite text density.

A page becomes a tree of elements, as browsers build it from broken markup too: omitted end tags, stray end tags, unclosed comments and
elements. Elements that hold no article text whatever their density are left out: scripts, styles, forms, menus, page headers
and footers, sidebars, and what its class, id or role calls an advert, a notice, a menu or reader comments.

For every other element, C characters under T tags, of which LC characters under LT tags are links, have the composite density
    C / T * log(C / LC * T / LT)  to the base  ln(C / (C - LC) * LC + body's LC / C * C + e),
counts of zero taken as one. A node's density sum adds those of its children and of its own text. The node with the
largest sum is the core of the article; the least density on its path from the body is the threshold, and whatever else under
the body reaches it adds its own largest sum. Where a page marks articles, its main part or (by class or id) its content, the core is
sought there and the whole of the marked part is taken; elsewhere the box around the core and everything between the first and
the last node found, with the headings before them, but no boxes of links.

Blocks are joined by a newline; white space inside a block, `<br>` included, is one space. A null or empty page, and one without article
text, gives the empty string. Every step is linear in the length of the page and none recurses, so long and deep pages are whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from mwspark.llm.common import table

# Element names of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OF_HEAD = set("head title meta link script style base noscript template html".split())
RAW = set("script style title textarea iframe noembed noframes xmp".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
BOXES = {"div", "td", "center"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NEVER_TEXT = set("head script style title textarea iframe noembed noframes noscript template xmp form nav aside button select datalist svg math canvas object audio video dialog menu search input label".split())
ENDS_P = BLOCKS - set("html body head td th tr tbody tfoot thead caption legend option optgroup title".split())
CLOSES = {  # a start tag ends an open element of these names, up to the nearest of the bounds
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
P_BOUNDS = ("td", "th", "table", "button", "caption", "object", "html")

# Words of class names, ids and roles for what isn't article text
BOILER = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsors sponsored promo promos promotion promoted sidebar sidebars"
    " nav navbar navigation navigations menu menus menubar breadcrumb breadcrumbs footer footers comment comments commentlist replies disqus respond cookie cookies consent gdpr notice notices notification"
    " newsletter subscribe subscription signup login share sharing social related recommended recommendations popup modal overlay toolbar pagination pager skiplink"
    " complementary contentinfo search alert alerts paywall trending outbrain taboola widget widgets".split()
)
HEADER = set("header masthead topbar".split())
OF_ARTICLE = set("article post entry story content".split())
KEEPS = ("has-", "no-", "with-", "without-", "is-", "not-")

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # comment
    r"|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</>"  # doctype, bogus comment
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+|=++)*+)(?P<close>>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?+)?+")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def is_content(source: str) -> bool:
    """Whether class or id call an element the page's content."""
    low = source.lower()
    if not any(x in low for x in OF_ARTICLE):
        return False
    a = attributes(source)
    return any({w.lower() for w in WORDS.findall(a.get(key, ""))} & OF_ARTICLE for key in ("class", "id"))


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), entities.unescape(double or single or bare))
    return found


def is_boiler(name: str, source: str, in_article: bool) -> bool:
    """Whether an element holds no article text, by its name, class, id, role and other attributes."""
    if name in NEVER_TEXT or (name == "footer") or (name == "header" and not in_article):
        return True
    if not source or name in ("html", "body"):
        return False
    low = source.lower()
    if not any(x in low for x in ("class", "id", "role", "hidden", "style")):
        return False
    a = attributes(source)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    names = [x for key in ("class", "id", "role") for x in a.get(key, "").split() if not x.lower().startswith(KEEPS)]
    for one in names:
        words = {w.lower() for w in WORDS.findall(one)}
        if name in ("article", "main") or a.get("role") in ("article", "main"):
            if words & {"comment", "comments", "ad", "advert", "advertisement", "sponsored", "promo", "related", "reply"} and not words & {"open", "closed"}:
                return True
        elif words & BOILER or (words & HEADER and not in_article and not words & OF_ARTICLE):
            return True
    return False


class Page:
    """Elements in document order with their parents, and pieces of text with the element that holds each."""

    def __init__(self, source: str) -> None:
        self.names, self.parents, self.marks = ["#page"], [-1], [0]  # marks: 3 for an article, 2 for a main part, 1 for a box called content
        self.pieces: list[tuple[int, str | None]] = []  # (element, text); text of None: a block begins or ends
        self.all_chars = self.all_links = 0
        stack = [0]  # open elements
        open_at: dict[str, list[int]] = {}  # name -> places on the stack
        hidden: list[str] = []  # names of open elements that are left out
        blocks: list[int] = []  # places of open blocks
        skipped = links = articles = 0  # place on the stack of the element left out, open links, open articles
        at, size = 0, len(source)

        def pop_to(place: int) -> None:
            nonlocal skipped, links, articles
            while len(stack) > place:
                element = stack.pop()
                name = self.names[element] if element >= 0 else hidden.pop()
                open_at[name].pop()
                links -= name == "a"
                articles -= element >= 0 and self.marks[element] > 1
                if name in BLOCKS:
                    blocks.pop()
                if skipped == len(stack):
                    skipped = 0
                if name in BLOCKS and not skipped:
                    self.pieces.append((stack[-1], None))

        def last(names: tuple[str, ...]) -> int:
            return max((open_at[x][-1] for x in names if open_at.get(x)), default=0)

        while at < size:
            m = TOKEN.search(source, at)
            text = source[at : m.start() if m else size]
            if text:
                if open_at.get("head") and len(stack) - 1 == open_at["head"][-1] and not text.isspace():
                    pop_to(open_at["head"][-1])
                if "&" in text:
                    text = entities.unescape(text)
                n = len(text) if not open_at.get("head") else 0
                self.all_chars += n
                self.all_links += n if links else 0
                if not skipped:
                    self.pieces.append((stack[-1], text))
            if not m:
                break
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            if not m["close"]:  # a tag that the page's end cuts
                break
            name = name.lower()
            if m["end"]:
                places = open_at.get(name)
                if places and (name in BLOCKS or not blocks or blocks[-1] < places[-1]):
                    pop_to(places[-1])
                elif name == "p" and not skipped:
                    self.pieces.append((stack[-1], None))
                continue
            if name in ENDS_P and last(("p",)) > last(P_BOUNDS):
                pop_to(last(("p",)))
            if name in CLOSES:
                ends, bounds = CLOSES[name]
                while (place := min((open_at[x][-1] for x in ends if open_at.get(x) and open_at[x][-1] > last(bounds)), default=0)):
                    pop_to(place)
            if open_at.get("head") and name not in OF_HEAD:
                pop_to(open_at["head"][-1])
            if name == "a" and open_at.get("a") and (not blocks or blocks[-1] < open_at["a"][-1]):
                pop_to(open_at["a"][-1])
            if name in ("html", "body") and open_at.get(name):
                continue
            in_article = articles > 0
            attrs = m["attrs"]
            if skipped or is_boiler(name, attrs, in_article):
                element = -1
            else:
                element = len(self.names)
                self.names.append(name)
                self.parents.append(stack[-1])
                role = attributes(attrs).get("role") if "role" in attrs else None
                self.marks.append(3 if "article" in (name, role) else 2 if "main" in (name, role) else 1 if name in BOXES and is_content(attrs) else 0)
                if name in BLOCKS:
                    self.pieces.append((element, None))
                elif name == "br":
                    self.pieces.append((element, " "))
            if name in VOID or (attrs.endswith("/") and name in ("path", "circle", "rect", "use")):
                continue
            if element < 0:
                hidden.append(name)
                skipped = skipped or len(stack)
            open_at.setdefault(name, []).append(len(stack))
            stack.append(element)
            links += name == "a"
            articles += element >= 0 and self.marks[element] > 1
            if name in BLOCKS:
                blocks.append(len(stack) - 1)
            if name in RAW:  # up to its end tag nothing is markup
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else size

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite density and density sum of every element; chars and link_chars are kept."""
        n, parents = len(self.names), self.parents
        chars, tags, link_chars, link_tags, own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        linked = [False] * n
        for i in range(1, n):
            linked[i] = self.names[i] == "a" or linked[parents[i]]
        for element, text in self.pieces:
            if text is not None and (size := len(" ".join(text.split()))):
                own[element] += size
                link_chars[element] += size if linked[element] else 0
        for i in range(n - 1, -1, -1):
            chars[i] += own[i]
            if i:
                p = parents[i]
                chars[p] += chars[i]
                link_chars[p] += link_chars[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (self.names[i] == "a")
        of_links = max(1, self.all_links) / max(1, self.all_chars)
        density = [composite(*x, of_links) for x in zip(chars, tags, link_chars, link_tags, strict=True)]
        sums = [composite(c, 0, 0, 0, of_links) for c in own]
        for i in range(1, n):
            sums[parents[i]] += density[i]
        self.chars, self.link_chars, self.link_tags = chars, link_chars, link_tags
        return density, sums

    def chosen(self) -> list[bool]:
        """Whether the text that stands directly in an element is article text."""
        density, sums = self.densities()
        n, parents = len(self.names), self.parents
        region = [0] * n
        for mark in (3, 2, 1, 0):  # articles; else main parts; else boxes called content, if they hold half of the text
            for i in range(1, n):  # the outermost region that holds an element
                region[i] = region[parents[i]] or (i if mark and self.marks[i] == mark else 0)
            inside = sum(c for i, c in enumerate(self.chars) if i and region[i] == i)
            if inside > (0 if mark > 1 else self.chars[0] / 2):
                break
        worth = [-1.0 if mark and not r else s for s, r in zip(sums, region, strict=True)]
        best = list(range(n))  # of each subtree, the element with the largest sum; the outermost, then the first of equal ones
        for i in range(n - 1, 0, -1):
            p = parents[i]
            if worth[best[i]] > worth[best[p]] or (worth[best[i]] == worth[best[p]] and best[p] != p):
                best[p] = best[i]
        core = best[0]
        if not self.chars[core]:
            return [False] * n
        path = [core]
        while path[-1] and self.names[path[-1]] != "body":
            path.append(parents[path[-1]])
        threshold = min(density[i] for i in path)
        found = {core} | {best[i] for i in range(1, n) if density[i] >= threshold and (region[i] or not mark) and self.chars[best[i]]}
        if mark:
            return self.under({region[i] for i in found})
        while core and self.names[core] not in (*BOXES, "body", "html") and self.names[parents[core]] not in ("body", "html", "#page"):
            core = parents[core]  # a paragraph, list or section stands for the box around it
        found.add(core)
        return self.without_links(self.under(found | self.between(found)))

    def between(self, found: set[int]) -> set[int]:
        """What stands between the first and the last of the elements found, below their common ancestor, and a heading right before them."""
        holds = [0] * len(self.names)  # elements found in each subtree
        for i in range(len(holds) - 1, -1, -1):
            holds[i] += i in found
            if i:
                holds[self.parents[i]] += holds[i]
        common = max(i for i in range(len(holds)) if holds[i] == len(found))
        if common in found:
            common = self.parents[common]
        plain = [False] * len(holds)  # holds text outside of headings
        for i, text in self.pieces:
            plain[i] |= bool(text and not text.isspace() and self.names[i] not in HEADINGS)
        children: dict[int, list[int]] = {}
        for i in range(len(holds) - 1, 0, -1):
            plain[self.parents[i]] |= plain[i] and self.names[self.parents[i]] not in HEADINGS
            if self.chars[i]:
                children.setdefault(self.parents[i], []).append(i)  # the last comes first
        headed = any(a and name in HEADINGS for a, name in zip(self.under(found), self.names, strict=True))
        out: set[int] = set()
        while common >= 0:
            row = children.get(common, [])[::-1]
            holding = [k for k, i in enumerate(row) if holds[i]]
            if holding:
                first = holding[0]
                while first and not plain[row[first - 1]]:
                    first -= 1
                    headed = True
                out |= {row[k] for k in range(first, holding[-1] + 1) if not holds[row[k]]}
            if headed:
                break
            common = self.parents[common]  # up to the nearest heading
        return out

    def without_links(self, taken: list[bool]) -> list[bool]:
        """Leaves out lists and boxes of links."""
        tops = {i for i, name in enumerate(self.names) if taken[i] and name in BLOCKS and name not in HEADINGS and self.link_tags[i] > 1 and 2 * self.link_chars[i] > self.chars[i]}
        return [a and not b for a, b in zip(taken, self.under(tops), strict=True)]

    def under(self, tops: set[int]) -> list[bool]:
        out = [0 in tops] + [False] * (len(self.names) - 1)
        for i in range(1, len(out)):
            out[i] = i in tops or out[self.parents[i]]
        return out

    def text(self) -> str:
        taken, lines, block = self.chosen(), [], []
        for element, text in [*self.pieces, (0, None)]:
            if text is None:
                if line := " ".join("".join(block).split()):
                    lines.append(line)
                block = []
            elif taken[element]:
                block.append(text)
        return "\n".join(lines)


def composite(chars: int, tags: int, link_chars: int, link_tags: int, of_links: float) -> float:
    """Characters per tag, adjusted by links; of_links: the share of links in the page's characters."""
    if not chars:
        return 0.0
    c, t, lc, lt = chars, max(1, tags), max(1, link_chars), max(1, link_tags)
    base = log(c / max(1, c - link_chars) * lc + of_links * c + e)
    return c / t * max(0.0, log(c / lc * t / lt)) / log(base)


def main_text(source: str | None) -> str:
    """Article text of one page."""
    return Page(source).text() if source else ""


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All rows and columns of pages, and their article text as a column text; a column of that name is replaced."""

    @pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield sources.map(main_text, na_action=None)

    return pages.withColumn("text", texts(F.col(html_col)))


def op11_composite_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
