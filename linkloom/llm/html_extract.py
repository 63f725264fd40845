"""HTML extraction: text-to-tag ratios over the events of the standard parser."""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.base import annotate, register, table

#: Never shown as text, wherever they stand.
SILENT = {"script", "style", "noscript", "template", "head", "title", "select", "textarea", "button", "iframe", "object", "svg", "canvas", "audio", "video"}
#: Elements whose name says that they are no part of the article (``header``: outside one).
ASIDE = {"nav", "footer", "aside", "form", "dialog", "menu"}
#: Words of class, id or role that say the same.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "contentinfo", "complementary", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "login", "signup", "search", "comment", "comments", "commentlist", "disqus", "respond", "share", "sharing", "social", "related", "recommended", "widget", "pagination", "pager", "skip", "hidden"}
#: Words that may stand beside them in one name (``site-footer``, ``comment-list``).
BESIDE = {"site", "page", "top", "bottom", "left", "right", "list", "box", "bar", "wrap", "wrapper", "container", "area", "block", "inner", "outer", "link", "links", "button", "buttons", "posts", "articles", "section", "global", "primary", "secondary", "form", "slot", "unit", "message", "text", "reader", "user", "to", "us"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Elements that begin and end a block of text.
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "header", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | SILENT | ASIDE | HEADINGS
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An open element of the value ends when the key starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An end tag or an implied end doesn't reach beyond these.
FENCES = {"article", "main", "body", "table", "td", "th", "div", "section", "ul", "ol", "dl", "blockquote", "html"}
BODIES = {"article", "main"}
#: Elements that make a region of the lines inside them.
REGIONS = {"div", "section", "article", "main", "header", "table", "ul", "ol", "dl", "details", "center", "fieldset", "figure"} | ASIDE
SIGMA = 1.5
#: An ``article`` or ``main`` counts as so many times as dense as it is, a doubted region as so much less.
BODY_WEIGHT = 2
DOUBT_WEIGHT = 1 / 8
#: Clusters of regions whose (geometric) means lie closer than this are one cluster;
#: among the parts of a chosen region they must lie farther apart.
APART = 4
APART_INSIDE = 64


def _named_so(name: str) -> bool:
    """Whether a class, id or role is made of marks (and words beside them) alone."""
    words = re.findall("[a-z]+", name.lower())
    return not MARKS.isdisjoint(words) and MARKS.union(BESIDE).issuperset(words)


def _doubted(tag: str, attrs: list, inside: bool) -> bool:
    """Whether an element's name or marks say that it isn't part of the article.

    Only whole names count: ``search-engines`` or ``entry-header`` are no marks.
    Headings and an outermost ``article`` or ``main`` are never doubted for a mark.
    """
    if tag in ASIDE or (tag == "header" and not inside):
        return True
    spared = tag in ("html", "body", "main", "header") or tag in HEADINGS or (tag == "article" and not inside)
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if not spared and name in ("class", "id", "role") and value and any(_named_so(v) for v in value.split()):
            return True
    return False


class _Lines(HTMLParser):
    """Lines of a page: text of one block, share of it inside links, the tags it took, its region.

    Regions are the tree of the elements in ``REGIONS``, numbered from 1 so that a
    region comes after its parent; 0 is the page. A doubted element is a region
    too, whatever its name; what is inside it makes no further regions.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # name, left out, region
        self.at: dict[str, list[int]] = {}  # places of a name in open
        self.fences: list[int] = []  # places of fences in open
        self.lines: list[tuple[str, float, int, int]] = []
        self.parent = [0]
        self.bodies: list[bool] = [False]  # in an article or main
        self.doubted: list[bool] = [False]
        self.text: list[str] = []
        self.linked = 0
        self.tags = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            region = self.open[-1][2] if self.open else 0
            self.lines.append((text, self.linked / (len(text) - text.count(" ")), self.tags, region))
            self.tags = 0
        self.text = []
        self.linked = 0

    def _push(self, tag: str, out: bool, region: int) -> None:
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in FENCES:
            self.fences.append(len(self.open))
        self.open.append((tag, out, region))

    def _close(self, names: set[str], fenced: bool) -> None:
        """Close the nearest open element of ``names``, unless a fence is nearer."""
        k = max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)
        if k < 0 or (fenced and self.fences and self.fences[-1] > k):
            return
        while len(self.open) > k:
            name = self.open.pop()[0]
            self.at[name].pop()
            if name in FENCES:
                self.fences.pop()

    def _region(self, parent: int, tag: str, doubted: bool) -> int:
        self.parent.append(parent)
        self.bodies.append(self.bodies[parent] or (tag in BODIES and not doubted))
        self.doubted.append(doubted)
        return len(self.parent) - 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if not (self.open and self.open[-1][1]):
            self.tags += 1
        if tag in BLOCKS:
            self.flush()
            self._close({"p"}, True)
            if tag in ENDS:
                self._close(ENDS[tag], True)
        _, out, region = self.open[-1] if self.open else ("", False, 0)
        if tag in VOID:
            if tag == "br":
                self.text.append(" " if not out else "")
            return
        out = out or tag in SILENT
        if not out and not self.doubted[region]:
            doubted = _doubted(tag, attrs, self.bodies[region])
            if doubted and tag not in BLOCKS:
                out = True
            elif doubted or tag in REGIONS:
                region = self._region(region, tag, doubted)
        self._push(tag, out, region)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if not (self.open and self.open[-1][1]):
            self.tags += 1
        self._close({tag}, tag not in FENCES)

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.text.append(data)
            if self.at.get("a"):
                self.linked += len("".join(data.split()))


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian average over neighbours, three deviations to each side."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(len(ratios), i + reach + 1)):
            w = kernel[abs(i - j)]
            total += w * ratios[j]
            weight += w
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """The value that parts two clusters (two means on a line, from the ends)."""
    low, high = min(values), max(values)
    cut = (low + high) / 2
    for _ in range(50):
        under = [v for v in values if v < cut]
        over = [v for v in values if v >= cut]
        if not under or not over:
            break
        new = (sum(under) / len(under) + sum(over) / len(over)) / 2
        if new == cut:
            break
        cut = new
    return cut


def upper(scores: dict[int, float], apart: float = APART) -> set[int]:
    """The keys of the upper cluster; all when the clusters are not clearly apart."""
    cut = threshold(list(scores.values()))
    over = [v for v in scores.values() if v >= cut]
    under = [v for v in scores.values() if v < cut]
    if not over or not under or sum(over) / len(over) - sum(under) / len(under) < math.log(apart):
        return set(scores)
    return {r for r, v in scores.items() if v >= cut}


def densities(lines: list[tuple[str, float, int, int]]) -> list[float]:
    """Each line's ratio of text outside links to tags, smoothed over the page.

    A neighbour's density counts for a line only as far as its text is no link.
    """
    values = smoothed([len(t) * (1 - linked) / max(1, tags) for t, linked, tags, _ in lines])
    return [v * (1 - linked) for v, (_, linked, _, _) in zip(values, lines, strict=True)]


class _Choice:
    """The regions of one page, measured, and the choice among them."""

    def __init__(self, page: _Lines) -> None:
        self.page = page
        n = len(page.parent)
        self.chars = [0] * n  # of a region and all below it that isn't doubted
        self.dense = [0.0] * n
        self.body = [0] * n  # characters in an article or main
        self.below: list[list[int]] = [[] for _ in range(n)]
        self.own = [(0, 0.0)] * n  # characters and density of the lines right in a region
        self.dropped = 0  # regions that clusters left out
        for (text, _, _, r), value in zip(page.lines, densities(page.lines), strict=True):
            chars, dense = self.own[r]
            self.own[r] = (chars + len(text), dense + len(text) * value)
        for r in range(n - 1, -1, -1):
            chars, dense = self.own[r]
            self.chars[r] += chars
            self.dense[r] += dense
            self.body[r] += chars if page.bodies[r] else 0
            if r and self.chars[r]:
                up = page.parent[r]
                self.below[up].append(r)
                if not page.doubted[r]:
                    self.chars[up] += self.chars[r]
                    self.dense[up] += self.dense[r]
                    self.body[up] += self.body[r]

    def score(self, chars: int, dense: float, weight: float, apart: float) -> float:
        """Logarithm of the weighted mean ratio over the text; times the root of its
        length, except inside a chosen region, where short parts belong to long ones."""
        size = math.sqrt(chars) if apart == APART else 1
        return math.log(weight * size * max(dense / chars, 0.01))

    def regions(self) -> set[int]:
        """The regions whose own lines are the article."""
        page, kept = self.page, set()
        todo = [(0, APART)]
        while todo:
            r, apart = todo.pop()
            sure = [c for c in self.below[r] if not page.doubted[c]]
            if page.bodies[r]:
                kept.add(r)
                todo += [(c, apart) for c in sure]
                continue
            scores = {}
            own, dense = self.own[r]
            if own and 2 * own >= self.chars[r]:
                apart = APART_INSIDE
            if own:
                scores[r] = self.score(own, dense, 1, apart)
            for c in self.below[r]:
                weight = DOUBT_WEIGHT if page.doubted[c] else BODY_WEIGHT if 2 * self.body[c] >= self.chars[c] else 1
                scores[c] = self.score(self.chars[c], self.dense[c], weight, apart)
            some = [c for c in scores if not page.doubted[c]]
            if not some:
                continue
            chosen = upper(scores, apart)
            self.dropped += len(scores) - len(chosen)
            if chosen.isdisjoint(some):  # doubted regions alone: the others decide among themselves
                chosen = upper({c: scores[c] for c in some}, apart)
            chosen &= set(some)
            kept |= chosen & {r}
            todo += [(c, APART_INSIDE if len(some) > 1 else apart) for c in chosen if c != r]
        return kept


def _parsed(html: str) -> _Lines:
    if "<![" in html:  # the parser raises on unknown sections; in HTML they are comments
        html = re.sub(r"<!\[[^>]*>?", "", html)
    last = html.rfind("<")
    if last > html.rfind(">") and re.match("[A-Za-z/!?]", html[last + 1 :]):
        html = html[:last]  # a page cut inside a tag
    page = _Lines()
    page.feed(html)
    page.close()
    page.flush()
    return page


def main_text(html: str | None) -> str:
    """The article of a page as blocks joined by an empty line.

    Every line that can be seen, those of menus and footers too, has its ratio of
    text to tags, smoothed over the page. From the page downwards, the regions
    inside a region are scored: the mean ratio over their text times the root of
    its length (inside a chosen region the ratio alone), more for ``article`` and
    ``main``, less for regions that their name or marks put in doubt. The logarithms of the scores are parted into two
    clusters, and those of the upper one go on, so a wrapper around the whole page
    is looked into. An ``article`` or ``main`` is kept with all its lines, and short
    paragraphs stay with the lines beside them. Where the clusters are not clearly
    apart, only the doubted regions are left out. A page of doubted regions alone
    has no text.
    """
    if not html:
        return ""
    page = _parsed(html)
    if not page.lines:
        return ""
    kept = _Choice(page).regions()
    return "\n\n".join(text for text, _, _, r in page.lines if r in kept)


def cluster_drops(html: str | None) -> int:
    """How many regions of a page the clusters left out."""
    choice = _Choice(_parsed(html or ""))
    choice.regions()
    return choice.dropped


def extracted(pages: DataFrame, carry: list[str]) -> DataFrame:
    """``row`` (the carried columns) and ``text`` for every row of ``pages``.

    Each page is parsed by itself in one pass over its whole html; null and empty
    html give an empty text. Ids, repeats and other columns don't matter.
    """
    return annotate(pages, "html", carry, lambda texts: [[main_text(t) for t in texts]], "text string")


ORACLE = """
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)', 1) AS rest FROM pages),
b AS (
  SELECT page_id, url, regexp_replace(split_part(rest, '</article>', 1), '</?(p|h1)>', chr(1), 'g') AS marked FROM a),
c AS (
  SELECT page_id, url, list_transform(string_split(marked, chr(1)), lambda x:
    trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br ?/?>', ' ', 'g'), '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))) AS parts FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""


@register("op4_html_extraction", ORACLE)
def extraction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extracted(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
