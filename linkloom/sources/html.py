"""Per-page HTML and Markdown extraction, the only part of parsing that needs Python.

``extract`` is a small helper called once per row inside an Arrow UDF; all
that follows from it (counts, hashes, warnings, link filters) is done with
Spark expressions in :mod:`linkloom.sources.pages`.
"""

from __future__ import annotations

import re
from html import escape, unescape
from html.entities import html5

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")
# Blank characters of the browser platform.
_BLANKS = re.compile(r"[ \t-\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
_ATTR = re.compile(
    r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S
)

# --- fixed values: element classes of the HTML standard ----------------------
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_RAW = frozenset("script style iframe noembed noframes xmp".split())
_RCDATA = frozenset(("title", "textarea"))
_HIDDEN = frozenset(("script", "style", "noscript"))
_HEAD_ONLY = frozenset(
    "html head title meta link base style script noscript template".split()
)
_FORMATTING = frozenset(
    "b big code em font i nobr s small strike strong tt u".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset "
    "figcaption figure footer header hgroup main menu nav ol p search section "
    "summary ul h1 h2 h3 h4 h5 h6 pre listing form table hr li dd dt".split()
)
_BARRIER = frozenset("td th caption table template applet object marquee html".split())
_SPECIAL = _CLOSES_P | _BARRIER | frozenset(
    "body tbody tfoot thead tr colgroup button select iframe".split()
)
# ----------------------------------------------------------------------------


def unescape_closed(text: str) -> str:
    """Only references that end in a semicolon are decoded."""
    return _CLOSED.sub(
        lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text
    )


def _attrs(text: str) -> dict:
    found: dict = {}
    for m in _ATTR.finditer(text):
        name = m.group(1).lower()
        if name not in found:
            value = next((g for g in m.groups()[1:] if g is not None), "")
            found[name] = unescape(value) if "&" in value else value
    return found


class _Page:
    """Open elements and the text seen so far; spans are text-piece ranges."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.stack: list[tuple[str, int]] = []
        self.spans: dict[str, list[list[int]]] = {}
        self.in_body = False
        self.body_from = 0
        self.links: list[list] = []
        self.anchor: list | None = None
        self.anchor_depth = 0
        self.reopen: str | None = None
        self.meta: list[dict] = []
        self.rel: list[dict] = []
        self.hidden = 0

    # -- text ---------------------------------------------------------------
    def text(self, value: str) -> None:
        if not value or self.hidden:
            return
        if not self.in_body:
            if value.isspace():
                return
            self.start_body()
        if self.reopen is not None:
            self.open_anchor(self.reopen)
        self.pieces.append(value)

    def start_body(self) -> None:
        if not self.in_body:
            self.in_body = True
            self.body_from = len(self.pieces)

    # -- anchors ------------------------------------------------------------
    def open_anchor(self, href: str) -> None:
        self.anchor = [href, len(self.pieces), None]
        self.anchor_depth = len(self.stack)
        self.links.append(self.anchor)
        self.reopen = None

    def close_anchor(self) -> None:
        if self.anchor is not None:
            self.anchor[2] = len(self.pieces)
        self.anchor = None
        self.reopen = None

    # -- elements -----------------------------------------------------------
    def push(self, name: str) -> None:
        slot = -1
        if name in ("h1", "h2", "main", "article", "title"):
            ranges = self.spans.setdefault(name, [])
            slot = len(ranges)
            ranges.append([len(self.pieces), -1])
        self.stack.append((name, slot))

    def pop_to(self, index: int) -> None:
        while len(self.stack) > index:
            name, slot = self.stack.pop()
            if slot >= 0:
                self.spans[name][slot][1] = len(self.pieces)
            if name == "noscript":
                self.hidden -= 1
            if self.anchor is not None and len(self.stack) < self.anchor_depth:
                href = self.anchor[0]
                self.close_anchor()
                if name not in ("td", "th", "caption", "object", "marquee", "applet"):
                    self.reopen = href

    def find(self, names, barrier=_BARRIER) -> int:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                return i
            if self.stack[i][0] in barrier:
                return -1
        return -1

    def close(self, names, barrier=_BARRIER) -> None:
        at = self.find(names, barrier)
        if at >= 0:
            self.pop_to(at)

    def start(self, name: str, attr_text: str) -> None:
        if name == "html" or name == "head":
            return
        if name == "body":
            self.start_body()
            return
        if name not in _HEAD_ONLY:
            self.start_body()
        if name == "meta":
            self.meta.append(_attrs(attr_text))
        elif name == "link":
            self.rel.append(_attrs(attr_text))
        if name in _CLOSES_P:
            self.close(("p",), _BARRIER | {"button"})
        if name in _HEADINGS and self.stack and self.stack[-1][0] in _HEADINGS:
            self.pop_to(len(self.stack) - 1)
        if name == "li":
            self.close(("li",), _SPECIAL - {"li", "address", "div", "p"})
        elif name in ("dd", "dt"):
            self.close(("dd", "dt"), _SPECIAL - {"dd", "dt", "address", "div", "p"})
        elif name in ("td", "th"):
            self.close(("td", "th"), ("table", "tr"))
        elif name == "tr":
            self.close(("tr",), ("table",))
        elif name in ("tbody", "thead", "tfoot"):
            self.close(("tbody", "thead", "tfoot"), ("table",))
        elif name in ("option", "button"):
            self.close((name,))
        elif name == "a":
            self.close_anchor()
            href = _attrs(attr_text).get("href")
            if href is not None:
                self.open_anchor(href)
            return
        if name in _VOID or name in _FORMATTING:
            return
        if attr_text.endswith("/") and self.find(("svg", "math")) >= 0:
            return
        if name == "noscript":
            self.hidden += 1
        self.push(name)

    def end(self, name: str) -> None:
        if name in ("html", "head", "body") or name in _VOID or name in _FORMATTING:
            return
        if name == "a":
            self.close_anchor()
        elif name in _HEADINGS:
            self.close(_HEADINGS)
        elif name in ("td", "th", "caption"):
            self.close((name,), ("table",))
        elif name in ("tr", "tbody", "thead", "tfoot"):
            self.close((name,), ("table",))
        elif name in ("table", "template", "object", "applet", "marquee"):
            self.close((name,), ())
        elif name == "li":
            self.close(("li",), _BARRIER | {"ol", "ul"})
        elif name == "noscript":
            self.close(("noscript",), ())
        elif name in _SPECIAL:
            self.close((name,))
        else:
            self.close((name,), _SPECIAL)

    # -- results ------------------------------------------------------------
    def range_text(self, span: list[int]) -> str:
        return "".join(self.pieces[span[0] : span[1] if span[1] >= 0 else None])


def extract(html: str, bare_references: bool = True) -> dict:
    """Title, body text, links and metadata of one page.

    Body text concatenates text nodes without separators, as the DOM does,
    and then squeezes blanks. ``bare_references``: text such as ``&amp`` without a
    semicolon is decoded too, as the HTML standard does.
    """
    decode = unescape if bare_references else unescape_closed
    page = _Page()
    pos, size = 0, len(html)
    lowered = None
    while pos < size:
        m = _TOKEN.search(html, pos)
        chunk = html[pos : m.start()] if m else html[pos:]
        if chunk:
            if not page.in_body and not page.hidden:
                # Blanks before the body belong to no element.
                chunk = chunk.lstrip(" \t\n\f\r")
            page.text(decode(chunk) if "&" in chunk else chunk)
        if not m:
            break
        pos = m.end()
        name = m.group(2)
        if not name:
            continue
        name = name.lower()
        if m.group(1):
            page.end(name)
            continue
        if name in _RAW or name in _RCDATA:
            if lowered is None:
                lowered = html.lower()
                if len(lowered) != size:
                    # A few letters change length when lower-cased.
                    lowered = "".join(c.lower() if c.isascii() else c for c in html)
            stop = lowered.find("</" + name, pos)
            while stop >= 0 and stop + len(name) + 2 < size and not (
                lowered[stop + len(name) + 2] in " \t\n\f\r/>"
            ):
                stop = lowered.find("</" + name, stop + 2)
            if stop < 0:
                stop = size
            inner = html[pos:stop]
            close = html.find(">", stop)
            pos = size if close < 0 else close + 1
            if name in _HIDDEN:
                if name not in _HEAD_ONLY:
                    page.start_body()
                continue
            if page.hidden:
                continue
            if name in _RCDATA:
                inner = decode(inner)
            if name not in _HEAD_ONLY:
                page.start_body()
            if name == "title":
                page.spans.setdefault("title", []).append(
                    [len(page.pieces), len(page.pieces) + 1]
                )
                page.pieces.append(inner)
                if not page.in_body:
                    page.body_from = len(page.pieces)
            else:
                page.text(inner)
            continue
        page.start(name, m.group(3))
    page.pop_to(0)
    page.close_anchor()

    def first(name: str) -> str | None:
        spans = page.spans.get(name)
        return page.range_text(spans[0]) if spans else None

    body = first("main")
    if body is None:
        body = first("article")
    if body is None:
        body = "".join(page.pieces[page.body_from :]) if page.in_body else ""

    def meta(name: str) -> str | None:
        return next((a.get("content") for a in page.meta if a.get("name") == name), None)

    return {
        "title": first("title"),
        "h1": first("h1"),
        "h2s": [page.range_text(s) for s in page.spans.get("h2", ())],
        "body": _BLANKS.sub(" ", body).strip(" "),
        "links": [
            {"href": href, "anchor_text": "".join(page.pieces[lo:hi])}
            for href, lo, hi in page.links
            if href and hi is not None and hi > lo
        ],
        "canonical": next(
            (a.get("href") for a in page.rel if a.get("rel", "").lower() == "canonical"), None
        ),
        "description": meta("description"),
        "robots": meta("robots"),
    }


# --- Markdown ------------------------------------------------------------------

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_ITEM = re.compile(r" {0,3}(?:[-*+]|\d{1,9}[.)])[ \t]+(.*)$")
_FENCE = re.compile(r" {0,3}(```+|~~~+)")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_INLINE = (
    (re.compile(r"!\[([^\]]*)\]\(([^()\s]*)(?:\s+\"[^\"]*\")?\)"), r'<img src="\2" alt="\1">'),
    (re.compile(r"\[([^\]]+)\]\(([^()\s]*)(?:\s+\"[^\"]*\")?\)"), r'<a href="\2">\1</a>'),
    (re.compile(r"<(https?://[^\s<>]+)>"), r'<a href="\1">\1</a>'),
    (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"), r"<strong>\2</strong>"),
    (re.compile(r"\*(?=\S)(.+?)(?<=\S)\*"), r"<em>\1</em>"),
    (re.compile(r"(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)"), r"<em>\1</em>"),
)


def _inline(text: str) -> str:
    parts = re.split(r"(`+)(.+?)\1", text)
    out = []
    for i in range(0, len(parts), 3):
        plain = parts[i]
        for pattern, repl in _INLINE:
            plain = pattern.sub(repl, plain)
        out.append(plain)
        if i + 2 < len(parts):
            out.append(f"<code>{escape(parts[i + 2])}</code>")
    return "".join(out)


def markdown_to_html(md: str) -> str:
    """A documented Markdown subset: ATX and underlined headings, paragraphs,
    flat lists, quotes, fenced code, rules, links, images, emphasis and code."""
    out: list[str] = []
    para: list[str] = []
    items: list[str] = []

    def flush() -> None:
        if para:
            out.append(f"<p>{_inline(chr(10).join(para))}</p>\n")
            para.clear()
        if items:
            out.append("<ul>\n" + "".join(f"<li>{_inline(i)}</li>\n" for i in items) + "</ul>\n")
            items.clear()

    fence: str | None = None
    code: list[str] = []
    for line in md.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        mark = _FENCE.match(line)
        if fence is not None:
            if mark and mark.group(1)[0] == fence[0] and len(mark.group(1)) >= len(fence):
                out.append("<pre><code>" + escape("\n".join(code)) + "\n</code></pre>\n")
                fence = None
            else:
                code.append(line)
            continue
        head, item = _HEADING.match(line), _ITEM.match(line)
        if mark:
            flush()
            fence, code = mark.group(1), []
        elif head:
            flush()
            level = len(head.group(1))
            out.append(f"<h{level}>{_inline(head.group(2) or '')}</h{level}>\n")
        elif para and re.match(r" {0,3}(=+|-+)[ \t]*$", line):
            level = 1 if "=" in line else 2
            text = "\n".join(para)
            para.clear()
            out.append(f"<h{level}>{_inline(text)}</h{level}>\n")
        elif _RULE.match(line):
            flush()
            out.append("<hr>\n")
        elif item:
            if para:
                flush()
            items.append(item.group(1))
        elif not line.strip():
            flush()
        elif items:
            items[-1] += "\n" + line.strip()
        else:
            para.append(re.sub(r"^ {0,3}>[ ]?", "", line).strip())
    if fence is not None:
        out.append("<pre><code>" + escape("\n".join(code)) + "\n</code></pre>\n")
    flush()
    return "".join(out)


def extract_markdown(md: str) -> dict:
    return extract(f"<html><body><article>{markdown_to_html(md)}</article></body></html>")
