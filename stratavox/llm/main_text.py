"""Main text of web pages from parser events, text-to-tag ratios and smoothing.

The standard library's streaming parser turns a page into lines (blocks) with their text, the tags they took and the text
inside links. Characters per tag, smoothed over neighbouring lines by a Gaussian, are split into two clusters by a threshold
between their means; the upper one marks content, and lines that lie close together on one level are all content. If marked elements
(article, main, classes of that meaning) hold most of it, every line of all marked elements that are mostly content is kept.
Otherwise the threshold selects over the whole page: content lines, and what stands between content lines of one container.
Nothing inside an element that is never article text is kept (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments). Inside marked elements names of headings, paragraphs and sections' ids exclude nothing, and a
class or role that also occurs in articles (alert, related, search) excludes a container only if the smoothed ratio agrees.

A name counts only as a whole: its parts must all speak of such boxes. The threshold selects nothing inside marked elements.

A page is cut into text and complete tags once and parsed once, in time and memory proportional to its length; no byte string stops it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from string import ascii_letters

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm.common import table
from stratavox.llm.registry import query

SIGMA = 1.5
#: Clusters whose means are closer than a factor of e in characters per tag are one cluster.
APART = 1.0

#: Elements of the HTML standard, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset(
    "nav footer aside form script style noscript template title head button select textarea iframe object svg canvas audio video dialog menu".split()
)
CONTAINERS = frozenset("article main section div td body html center blockquote".split())
BOXES = CONTAINERS - {"html", "body", "blockquote"} | frozenset("section ul ol dl table details figure header".split())
CLOSES_P = BLOCK - {"br", "option", "legend", "title", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "summary", "figcaption"}
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}

#: Parts of class, id and role names that mark what is not article text.
_OTHER_PARTS = re.compile(
    r"ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|"
    r"nav|navbar|navigation|menus?|menubar|breadcrumbs?|sidebar\w*|side|aside|rail|widgets?|footer|foot|masthead|topbar|toolbar|"
    r"siteheader|pageheader|comments?|commentlist|disqus|respond|reply|replies|discussion|share|sharing|social|newsletters?|subscribe\w*|"
    r"subscription|signup|login|search|searchbox|related|recommend\w*|pagination|pager|contentinfo|complementary|dialog|hidden|sronly|skiplink"
)
#: Inside a marked element only these exclude a box by its name alone; the other parts also occur in articles.
_CERTAIN_PARTS = re.compile(
    r"ads?|advert\w*|adsense|adbox|sponsor\w*|cookies?|gdpr|popups?|modal|nav|navbar|navigation|breadcrumbs?|sidebar\w*|footer|masthead|"
    r"topbar|toolbar|siteheader|pageheader|comments?|commentlist|disqus|share|sharing|newsletters?|signup|login|pagination|pager|"
    r"contentinfo|complementary"
)
_HIDDEN_PARTS = re.compile(r"hidden|sronly|skiplink")
#: Parts that only name the kind of box: a name counts if it consists of the parts above and these.
_BOX_PARTS = frozenset(
    "a area bar block body bottom box boxes btn btns bubble button buttons card center col column container content contents count counter "
    "cta element footer form frame global group head header holder icon icons inline inner item items js label large layer left line link links "
    "list lists main media mobile module more mpu new outer page panel placeholder posts primary rectangle right root row secondary section site "
    "skyscraper slot small space sticky stories strip tab tabs thread title tool tools top unit ul wrap wrapper zone reader readers user users article".split()
)
_PAIRS = re.compile(r"\b(site|page)[-_](header)\b|\b(sr)[-_](only)\b|\b(skip)[-_](link)\b")
_TEXT = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adbox|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|"
    r"nav|navbar|navigation|menu\w*|breadcrumb\w*|sidebar\w*|side|aside|rail|widget\w*|footer|foot|masthead|topbar|toolbar|site-?header|page-?header|"
    r"comment|comments|commentlist|comment-?list|disqus|respond|reply|replies|reader-?comments|discussion|"
    r"share|sharing|social\w*|newsletter|subscribe\w*|subscription|signup|login|search\w*|related\w*|recommend\w*|more-?stories|pagination|pager|"
    r"contentinfo|complementary|search|dialog|hidden|sr-only|skip-?link)(?=$|[\s_-])",
    re.I,
)
#: Inside a marked element only these exclude a box by their name alone; the other words of the list also occur in articles.
_NEVER_TEXT = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adbox|sponsor\w*|cookie\w*|gdpr|popup|modal|nav|navbar|navigation|breadcrumb\w*|sidebar\w*|"
    r"footer|masthead|topbar|toolbar|site-?header|page-?header|comment|comments|commentlist|comment-?list|disqus|reader-?comments|share|sharing|"
    r"newsletter|signup|login|more-?stories|pagination|pager|contentinfo|complementary)(?=$|[\s_-])",
    re.I,
)
_HIDDEN = re.compile(r"(?:^|[\s_-])(?:hidden|sr-only|skip-?link)(?=$|[\s_-])", re.I)
_TEXT = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|post|entry|story|main|maincontent|body-?text|text)(?=$|[\s_-])", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(4096)
def named_as(value: str, parts: re.Pattern) -> bool:
    """Whether a whole name in ``value`` is made of ``parts`` and words for boxes: "share-bar" is, "share-price" is not."""
    joined = _PAIRS.sub(lambda m: "".join(x for x in m.groups() if x), value.lower())
    for name in joined.split():
        own = [p.rstrip("0123456789") for p in re.split(r"[-_]+", name) if p.strip("0123456789")]
        hits = [bool(parts.fullmatch(p)) for p in own]
        if any(hits) and all(hit or p in _BOX_PARTS for hit, p in zip(hits, own)):
            return True
    return False


_EVENT = re.compile(r"<(?=[a-zA-Z/!?])")
_TAG_STOP = re.compile(r"[>=]")
_QUOTE = re.compile(r"\s*([\"'])")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>\x00]*")
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_USED = frozenset("class id role style hidden itemprop".split())
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style")}


def repaired(html: str) -> Iterator[str]:
    """The page as text runs and complete tags with the attributes that matter, in one pass.

    Comments, declarations (of any form), processing instructions, and what scripts and styles hold are left out. As the HTML
    standard says, a comment, a tag or a script that never ends reaches to the end of the page. A quotation mark that is never
    closed counts as an ordinary character. What cannot be found once is not searched again, so time is linear.
    """
    n, at = len(html), 0
    last = {q: html.rfind(q) for q in ("\"", "'", ">", "-->", "--!>")}
    while at < n:
        found = _EVENT.search(html, at)
        begin = found.start() if found else n
        if begin > at:
            yield html[at:begin].replace("<", "&lt;") if "<" in html[at:begin] else html[at:begin]
        if not found:
            return
        sign = html[begin + 1]
        if html.startswith("<!--", begin):
            if html.startswith((">", "->"), begin + 4):
                at = html.index(">", begin) + 1
                continue
            ends = [(end, html.find(end, begin + 4)) for end in ("-->", "--!>") if last[end] >= begin + 4]
            if not ends:
                return
            at = min(place + len(end) for end, place in ends)
            continue
        if begin >= last[">"]:
            return
        if sign in "!?" or (sign == "/" and html[begin + 2] not in ascii_letters):
            at = html.index(">", begin) + 1
            continue
        name = _TAG_NAME.match(html, begin + (2 if sign == "/" else 1)).group()
        at = begin + 1
        while True:
            stop = _TAG_STOP.search(html, at)
            if stop is None:
                return
            at = stop.end()
            if stop.group() == ">":
                break
            quote = _QUOTE.match(html, at)
            if quote and last[quote.group(1)] >= quote.end():
                at = html.index(quote.group(1), quote.end()) + 1
        tag = name.lower()
        if not _PLAIN.fullmatch(tag):
            tag = "span"  # an unknown inline element
        if sign == "/":
            yield f"</{tag}>"
            continue
        kept = []
        for attribute in _ATTRIBUTE.finditer(html, begin + 1 + len(name), at - 1):
            key, value = attribute.group(1).lower(), attribute.group(2) or ""
            if key in _USED:
                value = value[1:-1] if value[:1] in ("\"", "'") and value[:1] == value[-1:] and len(value) > 1 else value
                kept.append(f' {key}="{value.replace(chr(34), "&quot;")}"')
        yield f"<{tag}{''.join(kept)}>"
        if tag in _RAW:
            close = _RAW[tag].search(html, at)
            if close is None:
                return
            at = close.start()


_PLAIN = re.compile(r"[a-z][-a-z0-9_.:]*")


class Lines(HTMLParser):
    """Collects elements (parent, end, excluded, meaning, doubt) and lines (element, text, tags, characters in links).

    doubt: the outermost element around whose name speaks against article text but does not settle it, 0 without one.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parent, self.last, self.excluded, self.meaning = ["html"], [-1], [-1], [False], [0]
        self.doubt = [0]
        self.stack = [0]
        self.open: dict[str, list[int]] = {}  # places in the stack, by tag
        self.lines: list[tuple[int, str, int, int]] = []
        self.buffer: list[str] = []
        self.used = self.linked = self.anchors = 0

    def cut(self) -> None:
        """End the line at hand."""
        text = " ".join("".join(self.buffer).split()) if self.buffer else ""
        if text:
            self.lines.append((self.stack[-1], text, self.used, min(self.linked, len(text))))
            self.used = 0
        self.buffer.clear()
        self.linked = 0

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            element = self.stack.pop()
            self.last[element] = len(self.tags)
            tag = self.tags[element]
            self.open[tag].pop()
            if tag == "a":
                self.anchors -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCK
        if block:
            self.cut()
        self.used += 1
        if tag in VOID:
            return
        if tag in CLOSES_P and self.open.get("p"):
            self.close_tag("p", CONTAINERS)
        if tag in SELF_CLOSING:
            for other in SELF_CLOSING[tag]:
                if self.open.get(other):
                    self.close_tag(other, {"ul", "ol", "dl", "table", "select"} if tag != "p" else CONTAINERS)
        if tag in ("main", "article"):
            for outer in ("nav", "header"):
                if self.open.get(outer):  # left open
                    self.pop_to(self.open[outer][0])
        above = self.stack[-1]
        values = dict(attrs)
        named = self.names(values, "class", "id", "role")
        inside = self.meaning[above]
        never = tag in NEVER or (tag == "header" and not inside)
        doubtful = False
        if not never and tag not in ("html", "body"):
            never = "hidden" in values or bool(_UNSEEN.search(values.get("style") or ""))
            if not never and named:
                if inside or tag in ("article", "main"):
                    never, doubtful = self.inner_name(tag, values)
                else:
                    never = named_as(named, _OTHER_PARTS)
        meant = 2 if tag in ("article", "main") or values.get("itemprop") == "articleBody" or values.get("role") == "main" else 0
        if not meant and tag in CONTAINERS and named and _TEXT.search(named):
            meant = 1
        self.tags.append(tag)
        self.parent.append(above)
        self.last.append(-1)
        self.excluded.append(self.excluded[above] or never)
        self.meaning.append(meant or (inside and -1))
        self.doubt.append(self.doubt[above] or (len(self.tags) - 1 if doubtful else 0))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.tags) - 1)
        if tag == "a":
            self.anchors += 1

    @staticmethod
    def names(values: dict[str, str | None], *kinds: str) -> str:
        return " ".join(_CAMEL.sub("-", v) for k in kinds if (v := values.get(k)))

    def inner_name(self, tag: str, values: dict[str, str | None]) -> tuple[bool, bool]:
        """Whether the name of a marked element, or of one inside, excludes it, or else makes it doubtful.

        Headings and paragraphs are boxes of neither kind; a section's id names its subject once an article is open.
        """
        own = self.names(values, "class", "role")
        if own and named_as(own, _HIDDEN_PARTS):
            return True, False
        if tag not in BOXES:
            return False, False
        full = own if tag == "section" and self.open.get("article") else self.names(values, "class", "id", "role")
        if named_as(full, _CERTAIN_PARTS):
            return True, False
        return False, bool(own and named_as(own, _OTHER_PARTS))

    def close_tag(self, tag: str, fence=frozenset()) -> None:
        """Close the innermost ``tag`` unless an element of ``fence`` was opened inside it."""
        place = self.open[tag][-1]
        if not any(self.open.get(f) and self.open[f][-1] > place for f in fence):
            self.pop_to(place)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.cut()
        self.used += 1
        if self.open.get(tag):
            self.pop_to(self.open[tag][-1])

    def handle_data(self, data: str) -> None:
        if self.excluded[self.stack[-1]]:
            return
        self.buffer.append(data)
        if self.anchors:
            self.linked += len(data)

    def end(self) -> None:
        self.close()
        self.cut()
        self.pop_to(1)
        self.last[0] = len(self.tags)


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over neighbours, weights renormalised at both ends."""
    reach = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(values, kernel, "full")[reach : reach + len(values)]
    return total / np.convolve(np.ones(len(values)), kernel, "full")[reach : reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """Midpoint between the means of two clusters on a line; below all values if there is one cluster."""
    at = values.mean()
    for _ in range(50):
        low, high = values[values <= at], values[values > at]
        if not len(low) or not len(high):
            return -np.inf
        new = (low.mean() + high.mean()) / 2
        if new == at:
            break
        at = new
    return at if high.mean() - low.mean() >= APART else -np.inf


def measured(lines: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Length of each line, and whether its smoothed text-to-tag ratio marks content."""
    size = np.array([len(x[1]) for x in lines], float)
    ratio = np.log1p((size - np.array([x[3] for x in lines])) / np.maximum([x[2] for x in lines], 1))
    level = smoothed(ratio)
    return size, level > threshold(level)


def doubtful_parts(page: Lines, content: np.ndarray) -> set[int]:
    """Doubtful elements that the ratio speaks against too: less than half content, or more than half inside links."""
    seen: dict[int, list[int]] = {}
    for (element, text, _, linked), good in zip(page.lines, content):
        if page.doubt[element]:
            sums = seen.setdefault(page.doubt[element], [0, 0, 0])
            sums[0] += len(text)
            sums[1] += len(text) if good else 0
            sums[2] += linked
    return {e for e, (size, good, linked) in seen.items() if 2 * good < size or 2 * linked > size}


def main_text(html: str | None) -> str:
    """Text of the content region; empty for a page without text."""
    if not html:
        return ""
    page = Lines()
    for part in repaired(html):
        page.feed(part)
    page.end()
    if not page.lines:
        return ""
    size, content = measured(page.lines)
    refused = doubtful_parts(page, content)
    if refused:
        page.lines = [x for x in page.lines if page.doubt[x[0]] not in refused]
        if not page.lines:
            return ""
        size, content = measured(page.lines)
    lines = page.lines
    mass = np.zeros(len(page.tags))
    np.add.at(mass, [x[0] for x in lines], np.where(content, size, 0.0))
    for element in range(len(page.tags) - 1, 0, -1):
        mass[page.parent[element]] += mass[element]
    regions = content_regions(page, mass, lines)
    if not regions:
        return " ".join(text for (_, text, _, _), good in zip(lines, content_lines(page, content)) if good)
    ends = [(e, page.last[e]) for e in regions]
    kept, k = [], 0
    for element, text, _, _ in lines:
        while k < len(ends) and ends[k][1] <= element:
            k += 1
        if k < len(ends) and ends[k][0] <= element:
            kept.append(text)
    return " ".join(kept)


def content_regions(page: Lines, mass: np.ndarray, lines: list[tuple]) -> list[int]:
    """Marked elements that are mostly content, none inside another, if they hold half of the page's content; else none."""
    size = np.zeros(len(page.tags))
    np.add.at(size, [x[0] for x in lines], [len(x[1]) for x in lines])
    for element in range(len(page.tags) - 1, 0, -1):
        size[page.parent[element]] += size[element]
    for least in (2, 1):
        meant = [e for e, m in enumerate(page.meaning) if m >= least and not page.excluded[e]]
        if not meant:
            continue
        best = max(meant, key=lambda e: (mass[e], page.meaning[e] if least == 2 else e))
        chosen, end = [], -1
        for e in meant:  # outer elements come first
            inside = e <= best < page.last[e]
            if e < end or (inside and e != best):
                continue
            if e == best or (mass[e] > 0 and mass[e] >= 0.5 * size[e]):
                chosen.append(e)
                end = page.last[e]
        if sum(mass[e] for e in chosen) >= 0.5 * mass[0]:
            return chosen
    return []


def content_lines(page: Lines, content: np.ndarray) -> list[bool]:
    """Content lines, and unlinked lines between content lines of the same container."""
    home = list(range(len(page.tags)))
    for e in range(1, len(home)):
        if page.tags[e] not in CONTAINERS:
            home[e] = home[page.parent[e]]
    first, last = {}, {}
    for i, ((element, *_), good) in enumerate(zip(page.lines, content)):
        if good:
            first.setdefault(home[element], i)
            last[home[element]] = i
    return [
        bool(good) or (first.get(home[element], i) < i < last.get(home[element], i) and linked <= len(text) / 2)
        for i, ((element, text, _, linked), good) in enumerate(zip(page.lines, content))
    ]


def extracted(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for html in pages:
        yield html.map(lambda x: main_text(x) if isinstance(x, str) else "")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars (code points).

    Null and empty pages, and pages without text outside the excluded elements, give an empty text. Null ids and urls stay
    null; repeated rows repeat; an empty table gives an empty result.
    """
    text_of = F.pandas_udf(extracted, "string")
    return pages.select(F.col(id_col), F.col(url_col), text_of(F.col(html_col)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


@query("op3_main_text")
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
