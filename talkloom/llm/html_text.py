"""Main text of web pages from text-to-tag ratios.

After Weninger, Hsu and Han, "CETR", WWW 2010. The standard library's parser
streams tags and text; each block element makes a line with its characters and
tags. The ratios of characters outside links to tags, times the line's weight,
are smoothed by a Gaussian over neighbouring lines and split at a threshold by
two-means clustering: the lines above it are the content cluster. The region is
the smallest container (never a paragraph or heading) that holds all of the
cluster's lines, widened to an article or main element around it, or, where
there is none, by the headings and sentences next to it and all from the page's
h1 on. All lines of the region with a weight are kept, however short (without an
article or main, but for those that are mostly links).

Tags and the words of class, id and role only weigh: lines inside an article or
main ``INSIDE``, others 1, and lines of parts that are never article text 0
(menus, asides, footers, form controls, adverts, notices, sidebars, comments,
hidden ones). Headings are never marked by a word. A class or role of ambiguous
words only (notice, related, site-notice, commentlist) marks a box; an ambiguous
word among others, or in an id, which may name a section, needs links
or the lack of sentences as a second witness. A form, a word in a longer name or an ambiguous
one never takes the weight of what holds most of the content cluster. Articles
inside main whose heading is a link are teasers of others.

Markup that the library's parser stumbles over or needs quadratic time for is
repaired first: a tag that another tag begins in is closed there, CDATA is text,
comments and declarations go, as does a tag cut off at the page's end; a comment
that never ends hides nothing. Time grows in proportion to the page. Character references are decoded, white space inside a
line becomes one space, lines are joined in page order by a newline. Each page is
handled whole and by itself; nothing is shuffled.

Defined cases: null, empty and textless html give an empty text; unclosed and
stray tags are tolerated; repeated rows return as often as they come; kept
columns named text or n_chars give way to the results.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: HTML's element names by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("aside button canvas datalist dialog footer form head iframe input label legend math menu nav noscript object option script select style svg template textarea title audio video".split())
CONTROLS = frozenset("button datalist input label legend option select textarea".split())
REGION = frozenset(("article", "main"))
HOLDERS = frozenset("html body div section table tbody tr td th center form dl ul ol blockquote details fieldset".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that a new one closes, up to the nearest of the elements after the bar.
CLOSES = {"p": ({"p"}, {"td", "th", "table", "button"}), "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class, id or role that mark what isn't article text.
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner
    nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toolbar tabs toc
    sidebar aside widget related recommended recommendations trending popular teaser
    footer foot colophon copyright masthead topbar contentinfo complementary
    cookie cookies consent gdpr notice notices alert popup modal overlay disclaimer
    newsletter subscribe subscription signup login register search form
    comment comments discussion disqus respond replies reply feedback
    share sharing social follow print skip hidden""".split()
)
TITLES = frozenset(("header", "head", "banner"))  # kept inside the article: they hold its title
#: Of these the ones that titles and section names hold too; one of them alone needs a second witness.
AMBIGUOUS = frozenset(
    """related recommended popular trending register search form follow print feedback copyright disclaimer notice notices alert
    comment comments discussion respond reply replies share sharing social tabs toc promotion banner menu skip complementary""".split()
)
REMARKS = frozenset("comment comments disqus respond replies".split())  # as a class or role, they are readers' words: one is enough
#: Words that say of whom or in what shape; with them a name still says of marking words only.
NEUTRAL = frozenset("site page user users reader readers visitor top bottom left right box bar list area section block wrap wrapper container holder panel unit slot group item items link links post posts article articles story stories thread".split())
FURNITURE = frozenset("copyright disclaimer print search register feedback form menu skip complementary".split())  # ambiguous inside a region only
_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_sentence = re.compile(r"[.!?…。！？][\"'”’»)\]]*\Z")
SIGMA, SENTENCE = 1.0, 40  # a line of so many characters counts as a sentence
#: What a line inside an article or main element weighs against one outside.
INSIDE = 8.0
#: A tag up to its end or to where another begins; quotes count behind an equals sign only.
_tag = re.compile(r"""</?([A-Za-z][^\s/<>=]*)(?:[^<>=]|=\s*(?:"[^"]*"|'[^']*')?)*+""")
_raw_end = {t: re.compile(f"</{t}", re.I) for t in ("script", "style", "textarea", "title")}


def repaired(page: str) -> str:
    """Markup that the parser takes in one pass: see the module's text."""
    out, at, ends = [], 0, dict.fromkeys(["-->", "]]>", *_raw_end], True)  # what is once not found ahead is not looked for again

    def find(mark: str, i: int) -> int:
        j = page.find(mark, i) if ends[mark] else -1
        ends[mark] = j >= 0
        return j

    while (i := page.find("<", at)) >= 0:
        out.append(page[at:i])
        if page.startswith("<!--", i):
            j = find("-->", i + 2)
            at = j + 3 if j >= 0 else i + 4  # a comment that never ends hides nothing
        elif page.startswith("<![CDATA[", i):
            j = find("]]>", i)
            out.append(html.escape(page[i + 9 : j]) if j >= 0 else "")
            at = j + 3 if j >= 0 else i + 9
        elif page.startswith(("<!", "<?"), i):
            j = page.find(">", i)
            inner = page.find("[", i, j) if j >= 0 and page[i + 2 : i + 9].lower() == "doctype" else -1
            if inner >= 0 and (k := page.find("]", inner)) >= 0:
                j = page.find(">", k)
            at = j + 1 if j >= 0 else len(page)
        elif m := _tag.match(page, i):
            at, name = m.end(), m[1].lower()
            if at == len(page):  # cut off
                break
            out.append(m[0] + ">")
            at += page[at] == ">"
            if ends.get(name) and m[0][1] != "/":
                end = _raw_end[name].search(page, at)
                ends[name] = end is not None
                out.append(page[at : end.start()] if end else "")
                at = end.start() if end else at
        else:
            out.append("&lt;")
            at = i + 1
    return "".join([*out, page[at:]])


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(n == "hidden" or (n == "aria-hidden" and v == "true") or (n == "style" and v and re.search(r"display\s*:\s*none", v, re.I)) for n, v in attrs)


@functools.lru_cache(4096)
def _split(word: str) -> tuple[str, ...]:
    """A word written together with a shape or owner, such as commentlist, in two."""
    if word not in MARKS and word not in NEUTRAL:
        for k in range(2, len(word) - 1):
            head, tail = word[:k], word[k:]
            if (head in MARKS and tail in NEUTRAL) or (head in NEUTRAL and tail in MARKS):
                return head, tail
    return (word,)


def _mark(attrs: list[tuple[str, str | None]], inside: bool) -> str:
    """What class, id or role say of the element.

    "sure": a name of marking words only, or readers' remarks. "mark": such a word
    in a longer name, or a class or role of ambiguous words only, which is said of
    boxes; an id may be a section's. "maybe": one ambiguous word. Or nothing.
    """
    said = ""
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for one in value.split():
                words = [x for w in _words.findall(one) for x in _split(w.lower())]
                if words and words[0] in ("has", "with", "no", "without"):
                    continue
                found = {w for w in words if w in MARKS and not (inside and w in TITLES)} | ({"header"} & set(words) if not inside else set())
                only = found >= set(words) - NEUTRAL
                if found & REMARKS and (name != "id" or only):
                    return "sure"
                if name != "id" and only and "discussion" in found:
                    return "sure"
                vague = {w for w in found if w in AMBIGUOUS and (inside or w not in FURNITURE)}
                if found - vague and found == set(words):
                    return "sure"
                if found - vague or len(vague) > 1 or (vague and only and name != "id"):
                    said = "mark"
                elif vague:
                    said = said or "maybe"
    return said


class Element(NamedTuple):
    """An open element, with what holds for all inside it."""

    tag: str
    number: int  # elements are numbered as they open, 1 on
    dropped: bool
    doubt: int  # the nearest doubtful element around, itself included; 0: none
    region: int  # the outermost article or main around, itself included; 0: none
    barred: bool  # inside an element in which no article begins
    silent: bool  # scripts and styles, and controls inside a form
    form: bool
    link: bool


OUTSIDE = Element("", 0, False, 0, 0, False, False, False, False)


class Line(NamedTuple):
    text: str
    tags: int
    links: int  # characters in links
    element: int
    dropped: bool
    doubt: int
    region: int


class Lines(HTMLParser):
    """The page as lines, and the tree of its elements as each one's parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Element] = [OUTSIDE]
        self.open: Counter[str] = Counter()
        self.parent = [0]
        self.text: list[str] = []
        self.tags = self.links = 0
        self.lines: list[Line] = []
        self.doubts: dict[int, tuple[str, int]] = {}  # what is doubted of an element, and the next doubtful one around it
        self.holders: set[int] = set()
        self.headings: dict[int, str] = {}

    def flush(self) -> None:
        """Ends the line."""
        if self.text:
            t = " ".join("".join(self.text).split())
            if t:
                e = self.stack[-1]
                self.lines.append(Line(t, self.tags + 1, self.links, e.number, e.dropped, e.doubt, e.region))
        self.text, self.tags, self.links = [], 0, 0

    def _pop_to(self, n: int) -> None:
        while len(self.stack) > n:
            self.open[self.stack.pop().tag] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append("\n")
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES:
                self._close(*CLOSES[tag])
            elif tag != "hr":
                self._close({"p"}, BLOCK)
        self.tags += 1
        if tag in VOID:
            return
        self.parent.append(self.stack[-1].number)
        up, number = self.stack[-1], len(self.parent) - 1
        dropped, doubt, region = up.dropped, up.doubt, up.region
        if tag in REGION and not region and not up.barred:
            dropped, doubt, region = False, 0, number
        elif tag not in ("html", "body") and not dropped:
            dropped = (tag in NEVER and tag != "form") or _hidden(attrs)
            said = "form" if tag == "form" else "mark" if tag == "header" and not region else "" if tag in HEADINGS else _mark(attrs, bool(region)) or ("teaser" if tag == "article" else "")
            if said:
                self.doubts[number] = said, doubt
                doubt = number
        if tag in HOLDERS or tag in REGION:
            self.holders.add(number)
        elif tag in HEADINGS:
            self.headings[number] = tag
        form = up.form or tag == "form"
        self.stack.append(Element(tag, number, dropped, doubt, region, up.barred or (tag in NEVER and tag != "form"), up.silent or tag in ("script", "style") or (form and tag in CONTROLS), form, up.link or tag == "a"))
        self.open[tag] += 1

    def _close(self, closed: set[str], until: set[str] | frozenset[str]) -> None:
        """Ends the nearest open element of ``closed``, unless one of ``until`` or an article is nearer."""
        if not any(self.open[t] for t in closed):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in closed:
                self._pop_to(i)
                return
            if self.stack[i].tag in until or self.stack[i].tag in REGION:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag and tag in ("script", "style", "svg", "path"):
            self._pop_to(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._pop_to(i)
                return
            if self.stack[i].tag in REGION and tag not in ("html", "body"):
                return

    def handle_data(self, data: str) -> None:
        e = self.stack[-1]
        if not e.silent:
            self.text.append(data)
            self.links += len(data) if e.link else 0


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the edges repeat."""
    r = max(1, math.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="edge"), k / k.sum(), mode="valid")


def threshold(x: np.ndarray) -> float:
    """Between the two clusters of ``x`` that two-means finds from its extremes."""
    low, high = float(x.min()), float(x.max())
    for _ in range(50):
        cut = (low + high) / 2
        a, b = x[x < cut], x[x >= cut]
        new = (float(a.mean()) if len(a) else low, float(b.mean()) if len(b) else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content_cluster(lines: list[Line], weights: np.ndarray) -> np.ndarray:
    """Which lines are in the content cluster; all that weigh, if there are links only."""
    ratio = np.array([max(len(x.text) - x.links, 0) / x.tags for x in lines]) * weights
    score = np.where(weights > 0, smoothed(ratio), 0.0)
    return score >= threshold(score) if score.any() else weights > 0


def _mass(parent: list[int], lines: list[Line], amount: Iterable[float]) -> np.ndarray:
    """For each element, the sum of what its lines have."""
    out = np.zeros(len(parent))
    for x, n in zip(lines, amount, strict=True):
        out[x.element] += n
    for e in range(len(parent) - 1, 0, -1):  # parents open before their children
        out[parent[e]] += out[e]
    return out


def _is_sentence(text: str) -> bool:
    return len(text) >= SENTENCE or bool(_sentence.search(text))


def _article(p: Lines, line: Line) -> int | None:
    """The innermost article around a heading's line that is in another one's or in main."""
    e = line.element
    while e and e not in p.headings and e not in p.holders:
        e = p.parent[e]
    if e not in p.headings:
        return None
    while e:
        if p.doubts.get(e, ("",))[0] == "teaser":
            return e
        e = p.parent[e]
    return None


def _weights(p: Lines) -> np.ndarray:
    """What each line weighs: nothing if it is no article text, more inside an article.

    An element with one ambiguous word counts if it holds a sentence and is not
    mostly links; an article inside another or main whose heading is a link only
    if it has most of the sentences or nothing else has any. A marked element or a form counts if it holds most of the
    content cluster of all but the surely marked (an advert may be longer than a
    short article), which count only where nothing else is left.
    """
    lines = p.lines
    weights = np.array([0.0 if x.dropped else INSIDE if x.region else 1.0 for x in lines])
    if not p.doubts or not weights.any():
        return weights
    size, links = np.array([len(x.text) for x in lines]), np.array([x.links for x in lines])
    there = weights > 0
    told = there & (2 * links < size) & np.array([_is_sentence(x.text) for x in lines])
    in_all, in_links, in_told = (_mass(p.parent, lines, n * there) for n in (size, links, told))
    out = {e for e, (doubt, _) in p.doubts.items() if doubt not in ("maybe", "teaser") or (doubt == "maybe" and (2 * in_links[e] >= in_all[e] or not in_told[e]))}
    teasers = {e for x in lines if 5 * x.links >= 4 * len(x.text) and (e := _article(p, x)) is not None and 2 * in_told[e] <= in_told[0]}
    sure = {e for e, (doubt, _) in p.doubts.items() if doubt == "sure"}

    def without(bad: set[int]) -> np.ndarray:
        gone = {0: False}
        for e, (_, around) in sorted(p.doubts.items()):
            gone[e] = e in bad or gone[around]
        return np.where([gone[x.doubt] for x in lines], 0.0, weights)

    ours = without(sure)
    if ours.any():
        content = content_cluster(lines, np.minimum(ours, 1.0))
        mass = _mass(p.parent, lines, size * content)
        out -= {e for e in out if 2 * mass[e] > (size * content).sum()}
    if (told & (without(out | teasers) > 0)).any():  # else the page is a list of them
        out |= teasers
    for chosen in (without(out), ours):
        if chosen.any():
            return chosen
    return weights


def parsed(page: str) -> Lines:
    p = Lines()
    try:
        p.feed(repaired(page))
        p.close()
    except (AssertionError, ValueError, RecursionError):  # the library gave up: the lines up to there, and the rest as text
        p.text.append(re.sub(r"<[^<>]*>?", " ", p.rawdata))
    p.flush()
    return p


def main_text(page: str | None) -> str:
    """The article's lines, joined by newlines."""
    if not page:
        return ""
    p = parsed(page)
    if not p.lines:
        return ""
    weights = _weights(p)
    content = content_cluster(p.lines, weights)
    if not content.any():
        return ""
    lines, held = p.lines, _mass(p.parent, p.lines, content)
    home = max((e for e in p.holders if held[e] == content.sum()), default=0)  # the innermost opens last
    region = _region_of(p, home)
    inside = np.zeros(len(p.parent), bool)
    inside[region] = True
    for e in range(1, len(p.parent)):
        inside[e] |= inside[p.parent[e]]
    at = np.flatnonzero([inside[x.element] for x in lines])
    if home != region or any(lines[k].region == region for k in at):
        return "\n".join(lines[k].text for k in at if content[k] or weights[k] > 0)
    prose = [bool(ok) or (w > 0 and 2 * x.links < len(x.text)) for x, ok, w in zip(lines, content, weights, strict=True)]
    first, last = _reach(p, prose, int(at[0]), int(at[-1]))
    return "\n".join(x.text for x, ok in zip(lines[first : last + 1], prose[first : last + 1], strict=True) if ok)


def _region_of(p: Lines, home: int) -> int:
    """The outermost article or main around an element, or the element."""
    e, out = home, home
    named = {x.region for x in p.lines}
    while e:
        if e in named:
            out = e
        e = p.parent[e]
    return out


def _reach(p: Lines, prose: list[bool], first: int, last: int) -> tuple[int, int]:
    """The region's first and last line with the text that adjoins it: headings and sentences, and all from the page's h1 on."""
    lines = p.lines

    def heading(k: int) -> str | None:
        e = lines[k].element
        while e and e not in p.headings and e not in p.holders:
            e = p.parent[e]
        return p.headings.get(e)

    def joins(k: int) -> bool:
        return prose[k] and (heading(k) is not None or _is_sentence(lines[k].text))

    while first and joins(first - 1):
        first -= 1
    title = next((k for k in range(first - 1, -1, -1) if prose[k] and heading(k) == "h1"), first)
    first = title
    while first and joins(first - 1):
        first -= 1
    while last + 1 < len(lines) and joins(last + 1):
        last += 1
    return first, last


def extracted(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns with text and n_chars."""
    keep = [c for c in keep or pages.columns if c not in ("text", "n_chars")]
    columns = [*keep, *([] if html_col in keep else [html_col])]
    place = columns.index(html_col)
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                texts = pa.array([main_text(x.as_py()) for x in part.column(place)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], texts], schema=kinds)

    return pages.select(*columns).mapInArrow(run, schema).withColumn("n_chars", F.char_length("text").cast("long"))


#: For pages like the given ones, whose whole text is that of one article: its blocks are lines, other tags go.
ORACLE = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's'), '<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'gs') AS x FROM pages
), b AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '<br ?/?>', ' ', 'g'), '</?(p|h[1-6]|div|ul|ol|li|section|blockquote|table|tr|td|th|article)( [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) AS ls FROM a
), c AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(ls, lambda l: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(l, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), ' +', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS text FROM b
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""
