"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events. Block boundaries cut the
text into lines; each line has the ratio of its characters to its tags, the
ratios are smoothed with a Gaussian over the neighbouring lines, and two-means
clustering of the smoothed ratios gives the threshold. A region (an article, or
else the nearest division) is content when one of its lines reaches the
threshold before and after smoothing, and then all of its lines are taken, so that short paragraphs stay.
Inside it, a part (a division, list or table) without such a line is left out if most of its text is links.
Elements that are never article text (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) are left out with all
they hold; outside an article, names of classes and ids tell them, too. Inside one such
names only raise a doubt, as sections and paragraphs of an article have names like them:
a doubtful part stays if one of its lines is content by its ratio, or if it is a
paragraph or heading, unless most of its text is links; only names that say nothing but
"comments", "advert" or "newsletter" decide alone. If the page marks an article, only
articles are regions, and a later article named a comment is one. An article
is not noise for standing in a form; in a menu, sidebar or footer it is read only
if the page has no other text, and among reader comments never.

A page is worked on alone, in the task that reads it, and whole. Null or empty
html gives an empty text; unclosed and misplaced tags are closed by their
surroundings; repeated rows give repeated results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from talelake.llm.common import table

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: Never article text, with all they hold.
_NOISE = frozenset(
    "head script style noscript template nav footer aside form button select textarea iframe object svg canvas audio video menu dialog".split()
)
_ARTICLE = frozenset(("article", "main"))
_REGION = frozenset("article main section div td body".split())
#: What divides an article into parts.
_PART = frozenset("article section div ul ol dl table".split())
#: A start tag that ends an open element of the second kind.
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr",)), "th": ("td", ("tr",)), "option": ("option", ("select",))}
#: Words of class, id and role that mark an element as noise.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login "
    "sidebar sidebars rail widget widgets related recommended recommendations share sharing social comment comments commentlist "
    "disqus discussion replies reply respond menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager masthead "
    "header footer search searchbox skip toolbar complementary contentinfo dialog".split()
)
#: Of these, the words of reader comments, and words beside them that tell of a page's settings.
_COMMENTS = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
_SETTINGS = frozenset("no has with without open closed enabled disabled allow count".split())
#: Names that decide inside an article, too, if they are a whole class or id, or its first part.
_SURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo newsletter subscribe subscription signup login cookie cookies consent gdpr popup "
    "comments commentlist disqus respond sidebar navbar breadcrumb breadcrumbs pagination pager sharing complementary contentinfo".split()
)
#: Names that articles give to parts of their own: no doubt inside one.
_OWN = frozenset("header masthead notice notices discussion".split())
#: Blocks that are a paragraph or a heading.
_LINE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figcaption pre dt dd".split())
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
#: Standard deviation of the smoothing, in lines, and its weights.
SIGMA = 1.0
_WEIGHTS = [math.exp(-0.5 * (k / SIGMA) ** 2) for k in range(-3, 4)]


def _marked(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if value and name in ("class", "id", "role"):
            for word in value.split():
                parts = [p.lower() for p in _WORD.findall(word)]
                if parts and (parts[0] in _MARKS or parts[-1] in _MARKS or word.lower() in _MARKS):
                    return True
        elif name in ("hidden",) or name == "aria-hidden" and value == "true":
            return True
    return False


def _doubt(attrs: list[tuple[str, str | None]]) -> int:
    """What names say of an element inside an article: 2 noise, 1 maybe, 0 nothing."""
    found = 0
    for name, value in attrs:
        if value and name in ("class", "id", "role"):
            for word in value.split():
                parts = [p.lower() for p in _WORD.findall(word)]
                if parts and (parts[0] in _SURE or word.lower() in _SURE) and not _SETTINGS.intersection(parts):
                    return 2
                if parts and any(p in _MARKS and p not in _OWN for p in (parts[0], parts[-1])):
                    found = 1
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return 2
    return found


def _comments(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if value and name in ("class", "id"):
            for word in value.split():
                parts = [p.lower() for p in _WORD.findall(word)]
                if parts and (parts[0] in _COMMENTS or parts[-1] in _COMMENTS) and not _SETTINGS.intersection(parts):
                    return True
    return False


class LineReader(HTMLParser):
    """Collects lines: text, number of tags, region, whether it is noise, part, characters but blanks, those in links.

    lenient: articles are read in menus, sidebars and footers, too.
    """

    def __init__(self, lenient: bool = False):
        super().__init__(convert_charrefs=True)
        self.holders = ("template", "noscript") if lenient else ("nav", "footer", "aside", "template", "noscript")
        self.comments_at = self.link_at = -1  # depths of the outermost element of comments and of an open link
        self.doubt_at, self.doubt = -1, 0  # depth and number of the outermost doubtful part
        self.doubts: dict[int, bool] = {}  # number → whether it is a paragraph or heading
        self.parts: list[tuple[int, int]] = [(-1, 0)]  # (depth, number)
        self.n_parts = self.chars = self.linked = 0
        self.open: list[str] = []
        self.noise_at = -1  # depth of the outermost noise element
        self.regions: list[tuple[int, int]] = [(-1, 0)]  # (depth, number)
        self.article_at = -1
        self.made = 0
        self.articles: set[int] = set()
        self.lines: list[tuple[str, int, int, bool, int, int, int, int]] = []
        self.pieces: list[str] = []
        self.tags = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.pieces).split()) if self.pieces else ""
        if text:
            self.lines.append((text, self.tags, self.regions[-1][1], self.noise_at >= 0, self.parts[-1][1], self.chars, self.linked, self.doubt if self.doubt_at >= 0 else 0))
            self.tags = 0
        self.chars = self.linked = 0
        self.pieces.clear()

    def pop_to(self, depth: int) -> None:
        del self.open[depth:]
        if self.noise_at >= depth:
            self.noise_at = -1
        if self.article_at >= depth:
            self.article_at = -1
        if self.comments_at >= depth:
            self.comments_at = -1
        if self.doubt_at >= depth:
            self.doubt_at = -1
        if self.link_at >= depth:
            self.link_at = -1
        for inside in (self.regions, self.parts):
            while inside[-1][0] >= depth:
                inside.pop()

    def close_open(self, tag: str, stops: tuple[str, ...]) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth] == tag:
                self.pop_to(depth)
                return
            if self.open[depth] in stops:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.pieces.append(" ")
        self.tags += 1
        block = tag in _BLOCK
        if block:
            self.end_line()
            if "p" in self.open:
                self.close_open("p", ("td", "th", "table", "button", "object"))
            if tag in _CLOSES:
                self.close_open(*_CLOSES[tag])
        if tag in _VOID:
            return
        if tag in _ARTICLE and self.noise_at >= 0 and self.comments_at < 0 and not any(t in self.holders for t in self.open[self.noise_at :]):
            self.noise_at = -1  # what held it was never closed, or is a form around the page
        whole = tag in ("html", "body", "main") or tag == "article" and not self.articles
        inside = self.article_at >= 0 and tag != "article"
        doubt = _doubt(attrs) if inside and attrs else 0
        if self.comments_at < 0 and attrs and not whole and (doubt == 2 or not inside) and _comments(attrs):
            self.comments_at = len(self.open)
        if tag == "a" and self.link_at < 0:
            self.link_at = len(self.open)
        if tag in _PART:
            self.n_parts += 1
            self.parts.append((len(self.open), self.n_parts))
        if self.noise_at < 0:
            if inside:
                noise = tag in _NOISE or doubt == 2
            elif tag == "article":  # a later one may be a comment
                noise = not whole and self.comments_at == len(self.open)
            else:
                noise = tag in _NOISE or tag == "header" or not whole and bool(attrs) and _marked(attrs)
            if noise:
                self.noise_at = len(self.open)
            elif doubt and self.doubt_at < 0:
                self.doubt_at, self.doubt = len(self.open), len(self.doubts) + 1
                self.doubts[self.doubt] = tag in _LINE
        if tag in _REGION and self.article_at < 0 and self.noise_at < 0:
            self.made += 1
            self.regions.append((len(self.open), self.made))
            if tag in _ARTICLE:
                self.article_at = len(self.open)
                self.articles.add(self.made)
        self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag in ("svg", "iframe", "script", "template"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _BLOCK:
            self.end_line()
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth] == tag:
                self.pop_to(depth)
                return

    def handle_data(self, data: str) -> None:
        n = sum(map(len, data.split()))
        self.chars += n
        self.linked += n if self.link_at >= 0 else 0
        self.pieces.append(data if self.noise_at < 0 or self.open[self.noise_at] not in ("head", "script", "style") else "")

    def unknown_decl(self, data: str) -> None:
        """CDATA and other declarations hold no text."""


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian smoothing; the weights are those of the lines that exist."""
    n, found = len(ratios), []
    for i in range(n):
        total = weight = 0.0
        for k, w in enumerate(_WEIGHTS, i - 3):
            if 0 <= k < n:
                total += w * ratios[k]
                weight += w
        found.append(total / weight)
    return found


def threshold(values: list[float]) -> float:
    """Boundary of the two clusters of one-dimensional two-means."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not below or not above:
            break
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def extract(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    for lenient in (False, True):
        reader = LineReader(lenient)
        reader.feed(html)
        reader.close()
        reader.end_line()
        lines = reader.lines
        own = [i for i, line in enumerate(lines) if not line[3] and (line[2] in reader.articles or not reader.articles)]
        if own:
            break
    else:
        return ""
    ratios = [len(line[0]) / max(1, line[1]) for line in lines]
    score = smoothed(ratios)
    cut = threshold(score)
    # a line with a low ratio of its own is not lifted into content by its neighbours alone
    high = [i for i in own if score[i] >= cut and ratios[i] >= cut]
    content = {lines[i][2] for i in high} or {lines[max(own, key=score.__getitem__)][2]}
    own = [i for i in own if lines[i][2] in content]
    if reader.articles:
        kept, chars, linked = {lines[i][4] for i in high}, Counter(), Counter()
        for i in own:
            chars[lines[i][4]] += lines[i][5]
            linked[lines[i][4]] += lines[i][6]
        own = [i for i in own if lines[i][4] in kept or 2 * linked[lines[i][4]] < chars[lines[i][4]]] or own
        own = _sure(own, lines, reader.doubts, set(high)) or own
    return " ".join(lines[i][0] for i in own)


def _sure(own: list[int], lines: list[tuple], doubts: dict[int, bool], high: set[int]) -> list[int]:
    """The lines without those of doubtful parts that are not content."""
    content, chars, linked = {d for d, line in doubts.items() if line}, Counter(), Counter()
    for i in own:
        d = lines[i][7]
        chars[d] += lines[i][5]
        linked[d] += lines[i][6]
        if i in high:
            content.add(d)
    return [i for i in own if not lines[i][7] or lines[i][7] in content and 2 * linked[lines[i][7]] < chars[lines[i][7]]]


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(html.as_py()) for html in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select(pages.page_id.cast("long"), pages.url, pages[html_col]).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
