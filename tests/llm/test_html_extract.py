"""Main texts against pages whose article is known."""

import pytest

from linkloom.llm import html_extract as h

BODY = "<h1>A  title</h1><p>First &amp; foremost&nbsp;it<br>goes on.<p>Second <b>bold</b> <a href=x>link</a>.</p>"
TEXT = "A title\n\nFirst & foremost it goes on.\n\nSecond bold link."
JUNK = """<nav><ul><li><a href=/>Home</a></ul></nav><header><h2>Site</h2></header><div class="ad top">Buy now</div>
<aside>Side</aside><form>Name <input><select><option>a<option>b</select></form><div id="cookie-notice">We use cookies</div>
<script>var t="</p><article>no</article>";</script><style>p{}</style><!-- <article>no</article> -->"""


def test_article_among_junk():
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{JUNK}<article>{BODY}<div class='share'>Share</div></article><section class=comments><article>No!</article></section><footer>F</footer></body></html>"
    assert h.main_text(page) == TEXT
    assert h.main_text(page.replace("</body></html>", "")) == TEXT
    assert h.main_text(page.replace("article>", "main>")) == TEXT


def test_without_article_element():
    long = "word " * 60
    links = "".join(f"<li><a href={k}>l{k}</a></li>" for k in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><p>{long}</p><p>short one</p><p>{long}</p></div><div><ul>{links}</ul></div></body>"
    assert h.main_text(page) == "\n\n".join([long.strip(), "short one", long.strip()])


@pytest.mark.parametrize("html", [None, "", "   ", "<p", "<![x", "<![CDATA[a]]>", "<script>never closed", "</p></div>", "<article></article>"])
def test_empty(html):
    assert h.main_text(html) == ""


def test_odd_pages():
    assert h.main_text("just text") == "just text"
    assert h.main_text("<article>1 < 2 &lt; 3</article>") == "1 < 2 < 3"
    assert h.main_text("<article>" + "<div>" * 3000 + "deep" + "</article>") == "deep"
    assert h.main_text("<article><p>a <nav>x</nav> b</article>") == "a\n\nb"
    assert h.main_text("<article><![if x]><p>a<table><tr><td>1<td>2</table>c</article>") == "a\n\n1\n\n2\n\nc"
    long = "<article>" + "<p>x y</p>" * 20000 + "</article>"
    assert h.main_text(long).count("x y") == 20000


def test_smoothing_and_threshold():
    assert h.smoothed([3.0, 3.0, 3.0]) == pytest.approx([3, 3, 3])
    assert 2 < h.threshold([1.0, 2.0, 1.5, 50.0, 60.0]) < 50
    assert h.threshold([4.0, 4.0]) == 4


def test_rows(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", 9), (1, "u", None, 9), (None, None, "", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = h.extracted(pages, ["page_id", "text"]).collect()
    assert [(r.row.text, r.text) for r in got] == [(9, TEXT), (9, ""), (9, "")]
    assert h.extracted(pages.limit(0), ["page_id"]).count() == 0


LONG = "a sentence of the article that is long enough to matter here, " * 5
LINKS = "<div><ul>" + "".join(f"<li><a href={k}>link {k}</a></li>" for k in range(15)) + "</ul></div>"


def test_flat_page_keeps_all_paragraphs():
    """Paragraphs right below body are one region, with or without junk beside it."""
    parts = ["A short title", LONG.strip(), "Short one.", LONG.strip(), "End."]
    flat = f"<h1>{parts[0]}</h1><p>{parts[1]}</p><p>{parts[2]}</p><aside>x</aside>{parts[3]}<p>{parts[4]}</p>"
    assert h.main_text(f"<html><body>{flat}</body></html>") == "\n\n".join(parts)
    assert h.main_text(f"<body>{LINKS}{flat}{LINKS}</body>") == "\n\n".join(parts)
    assert h.main_text("<body><h1>thirteen long</h1><p>" + "x" * 300 + "</p></body>") == "thirteen long\n\n" + "x" * 300


def test_teaser_articles_do_not_replace_the_text():
    teaser = "<article><h3><a href=x>More news</a></h3><p><a href=x>Read on</a></p></article>"
    page = f"<body><div><h1>Title</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><div>{teaser * 4}</div></body>"
    assert h.main_text(page) == "\n\n".join(["Title", LONG.strip(), "Short one.", LONG.strip()])


def test_article_beside_unmarked_junk_and_several_posts():
    article = f"<article><h1>Title</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></article>"
    want = "\n\n".join(["Title", LONG.strip(), "Short one.", LONG.strip()])
    assert h.main_text(f"<body>{LINKS}{article}{LINKS}</body>") == want
    post = f"<article><h2>Next</h2><p>{LONG}</p></article>"
    assert h.main_text(f"<body>{article}{LINKS}{post}</body>") == f"{want}\n\nNext\n\n{LONG.strip()}"


def test_clusters_that_are_not_apart():
    assert h.main_text(f"<body><div><p>{LONG}</p></div><div><p>{LONG[:200]}</p></div></body>") == f"{LONG.strip()}\n\n{LONG[:200].strip()}"
    assert h.upper({1: 5.0}) == {1} and h.upper({1: 5.0, 2: 1.0}) == {1} and h.upper({1: 5.0, 2: 4.0}) == {1, 2}


def test_words_inside_names_are_no_marks():
    """Whole names count, and never on an article or a heading."""
    text = LONG.strip()
    assert h.main_text(f"<article class='search-engines'><p>{LONG}</p></article>") == text
    assert h.main_text(f"<article class='comment'><p>{LONG}</p></article>") == text
    assert h.main_text(f"<div class='related-work content'><p>{LONG}</p></div>") == text
    assert h.main_text(f"<article><p>a</p><p class='alert-free'>{LONG}</p></article>") == f"a\n\n{text}"
    head = "<div class='entry-header'><h1 class='header'>Title</h1></div>"
    assert h.main_text(f"<article>{head}<p>{LONG}</p></article>") == f"Title\n\n{text}"
    for name in ("site-footer", "comment-list", "x sidebar-left", "newsletter_signup", "Ad"):
        assert h.main_text(f"<article><p>{LONG}</p><div class='{name}'>{LONG}</div></article>") == text, name
    assert h.main_text(f"<article><p>{LONG}<span class=share>Share</span></p></article>") == text
    assert h.main_text(f"<article><p>{LONG}</p><article class=comment><p>{LONG}</p></article></article>") == text


def test_wrappers_are_looked_into():
    menu = "<div><a href=/>Home</a> <a href=/n>News</a></div>"
    want = f"Title\n\n{LONG.strip()}\n\nShort one."
    for body in (f"<div><h1>Title</h1><p>{LONG}</p><p>Short one.</p></div>", f"<article><h1>Title</h1><p>{LONG}</p><p>Short one.</p></article>"):
        for page in (f"<div id=page>{menu}{body}{LINKS}</div>", f"<div><div id=x><nav>{LINKS}</nav>{menu}{body}</div></div><footer>{LONG}</footer>"):
            assert h.main_text(f"<body>{page}</body>") == want


def test_parts_of_a_chosen_region_stay():
    """Short sections, tables and lists of an article without ``article`` are not parted from it."""
    parts = f"<section><p>{LONG * 4}</p></section><section><p>A short section.</p></section><ul><li>one</li><li>two</li></ul>"
    got = h.main_text(f"<body>{LINKS}<div>{parts}</div><div class=sidebar>{LONG}</div></body>")
    assert got == "\n\n".join([(LONG * 4).strip(), "A short section.", "one", "two"])


def test_doubted_regions_alone():
    assert h.main_text(f"<body><nav>{LONG}</nav><div class=ad>{LONG}</div></body>") == ""
    page = f"<body><footer>{LONG * 50}</footer><article><p>Tiny.</p></article></body>"
    assert h.main_text(page) == "Tiny."


def test_deep_unclosed_markup_takes_linear_time():
    import time

    begin = time.monotonic()
    assert h.main_text("<article>" + "<i>" * 32000 + "</b>" * 32000 + "x</article>") == "x"
    assert h.main_text("<b><div>" + "<i>" * 32000 + "</b>" * 32000 + "x") == "x"
    assert len(h.main_text("<article>" + "<div>x " * 20000).split()) == 20000
    assert time.monotonic() - begin < 10


def plain(html):
    """The choice among the elements below ``body``, for pages of flat markup, by numpy."""
    import html as entities
    import re

    import numpy as np

    body = re.sub(r"(?s)<!--.*?-->|<(script|style)>.*?</\1>|<head>.*?</head>", "", html)
    body = body[body.index("<body>") + 6 :].removesuffix("</body></html>")
    regions, lines, tags = [], [], 0
    for name, inner in re.findall(r"(?s)<(nav|div|article|footer)\b[^>]*>(.*?)</\1>", body):
        regions.append(name)
        tags += 1
        for piece in re.split(r"(</?(?:ul|li|p|h1)\b[^>]*>)", inner):
            if re.fullmatch(r"</?(?:ul|li|p|h1)\b[^>]*>", piece):
                tags += 1
                continue
            inline = re.findall("<[^>]*>", piece)
            text = " ".join(entities.unescape(re.sub("<[^>]*>", "", piece.replace("<br>", " "))).split())
            if text:
                linked = "<a " in piece
                lines.append((len(regions) - 1, text, linked, max(1, tags + len(inline))))
                tags = 0
            else:
                tags += len(inline)
        tags += 1
    ratio = np.array([0 if linked else len(t) / n for _, t, linked, n in lines])
    d = np.subtract.outer(np.arange(len(lines)), np.arange(len(lines)))
    kernel = np.where(abs(d) <= 5, np.exp(-(d**2) / (2 * 1.5**2)), 0)
    value = kernel @ ratio / kernel.sum(axis=1)
    score = {}
    for k, name in enumerate(regions):
        own = [(len(t), 0 if linked else v) for (r, t, linked, _), v in zip(lines, value, strict=True) if r == k]
        n = sum(m for m, _ in own)
        if n:
            dense = max(sum(m * v for m, v in own), n / 100)
            score[k] = np.log({"article": 2}.get(name, 1 / 8) * dense / np.sqrt(n))
    parts = sorted(score.values())
    splits = [(np.var(parts[:j]) * j + np.var(parts[j:]) * (len(parts) - j), j) for j in range(1, len(parts))]
    low = set(parts[: min(splits)[1]]) if splits else set()
    kept = [k for k in score if regions[k] == "article"]
    return "\n\n".join(t for r, t, _, _ in lines if r in kept), {k for k in score if score[k] in low}, regions


def test_given_pages_against_a_plain_version(spark, data_dir):
    """Whole pages: the same text, and the clusters leave out regions of every page.

    The best split into two clusters (by squares, over all splits) always drops a
    menu and never an article.
    """
    rows = spark.read.parquet(f"{data_dir}/pages.parquet").select("html").where("html is not null").collect()
    assert rows
    for (html,) in rows:
        text, low, regions = plain(html)
        assert h.main_text(html) == text
        assert h.cluster_drops(html) > 0
        assert "nav" in {regions[k] for k in low} and "article" not in {regions[k] for k in low}
