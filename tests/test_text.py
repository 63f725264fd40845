import pytest
from pyspark.sql import functions as F

from linkloom.functions import scoring, urls
from linkloom.functions import text as tx
from linkloom.operators.export import plain_number
from linkloom.plans.crosslink import two_decimals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "title,want",
    [
        ("How to Use TypeScript Generics", "Use TypeScript Generics"),
        ("A Guide To the best React", "the best React"),
        ("Plain title", "Plain title"),
        ("the best", "the best"),
    ],
)
def test_strip_title_prefix(spark, title, want):
    assert one(spark, tx.strip_title_prefix(F.lit(title))) == want


def test_distinctive_words(spark):
    got = one(spark, tx.distinctive_words(F.lit("The  Café of React-Hooks, hooks! and 42")))
    assert got == ["caf", "reacthooks", "hooks", "42"]
    assert one(spark, tx.distinctive_words(F.lit(" the of "))) == []


@pytest.mark.parametrize(
    "raw,want",
    [
        ("<b>Bold</b> text ", "Bold text"),
        ("&#106;avascript: x", ""),
        ("&#x6a;avascript:x", ""),
        ("onclick = boom", ""),
        ("a < b", ""),
        ("&#60;i", ""),
        ("&#65;&#x42;C", "ABC"),
        (" x﻿", "x"),
        ("sign &#55357; end", "sign � end"),
        ("&#99999999999999999999999999999999999999999999;ok", "ok"),
    ],
)
def test_sanitize_anchor(spark, raw, want):
    assert one(spark, tx.sanitize_anchor(F.lit(raw))) == want


def test_dice(spark):
    value = one(spark, tx.dice(F.lit("React Hooks Pattern"), F.lit("React Hook Patterns")))
    assert round(value, 3) == 0.889
    assert one(spark, tx.dice(F.lit("a"), F.lit(""))) == 1.0
    assert one(spark, tx.dice(F.lit("ab"), F.lit("x"))) == 0.0
    assert one(spark, tx.bigram_overlap(F.lit("aaaa"), F.lit("AA"))) == 1


def test_find_in_body(spark):
    body = "x" * 60 + "Needle" + "y" * 60
    hit = one(spark, tx.find_in_body(F.lit(body), F.lit("NEEDLE")))
    assert (hit.offset, hit.context) == (60, "x" * 50 + "Needle" + "y" * 50)
    assert one(spark, tx.find_in_body(F.lit(body), F.lit("absent"))) is None
    hit = one(spark, tx.find_in_body(F.lit("😀 needle"), F.lit("needle")))
    assert (hit.offset, hit.context) == (2, "😀 needle")


@pytest.mark.parametrize(
    "title,want",
    [
        ("React Guide - My Site", "React Guide"),
        ("React | Site", "React"),
        ("send e-mail", "send e"),
        ("- x", "- x"),
        ("Plain", "Plain"),
    ],
)
def test_display_title(spark, title, want):
    assert one(spark, tx.display_title(F.lit(title))) == want


@pytest.mark.parametrize(
    "title,body,want",
    [
        ("React Hooks Guide", "Nothing here. We use react hooks daily! Bye.", "We use react hooks daily"),
        ("React Hooks Guide", "Nothing to see.", "react hooks guide"),
        (
            "React Hooks Guide",
            "one two three four five six seven react hooks in a guide for all of us here",
            "three four five six seven react hooks in",
        ),
        ("The of", "react", ""),
        ("How to Tune Spark Joins - Blog", "x.", "tune spark joins"),
        ("Spark Joins", "Spark first joins. Spark second joins.", "Spark first joins"),
    ],
)
def test_semantic_anchor(spark, title, body, want):
    if want.startswith("three"):
        # Densest eight-word frame, the first one on ties.
        words = body.split()
        hits = [w in ("react", "hooks", "guide") for w in words]
        best = max(range(len(words) - 2), key=lambda s: (sum(hits[s : s + 8]), -s))
        want = " ".join(words[best : best + 8])
    assert one(spark, tx.semantic_anchor(F.lit(title), F.lit(body))) == want


def test_counts_and_cells(spark):
    assert one(spark, tx.word_count(F.lit(" a b\n c "))) == 3
    assert one(spark, tx.word_count(F.lit("  "))) == 0
    assert one(spark, tx.word_count_untrimmed(F.lit(" a b"))) == 3
    for raw, want in (("=1", "'=1"), ("+1", "'+1"), ("-1", "'-1"), ("@x", "'@x"), ("a=1", "a=1"), ("", "")):
        assert one(spark, tx.sanitize_cell(F.lit(raw))) == want
    snippet = one(spark, tx.html_snippet(F.lit("a<'b'>"), F.lit('u?a=1&b="')))
    assert snippet == '<a href="u?a=1&amp;b=&quot;">a&lt;&#39;b&#39;&gt;</a>'
    assert one(spark, tx.file_extension(F.lit("a.b.HTML"))) == ".html"
    assert one(spark, tx.file_extension(F.lit("none"))) == ""


PAGE = "https://example.com/blog/post"


@pytest.mark.parametrize(
    "href,want",
    [
        ("https://example.com/academy/x/", "https://example.com/academy/x"),
        ("/academy/x", "https://example.com/academy/x"),
        ("/de/academy/x", "https://example.com/academy/x"),
        ("/de", "https://example.com/de"),
        ("/academy/x?q=1#top", "https://example.com/academy/x"),
        ("other", "https://example.com/blog/other"),
        ("../upper/./x", "https://example.com/upper/x"),
        ("//CDN.example.org:443/a", "https://cdn.example.org/a"),
        ("?q", "https://example.com/blog/post"),
        ("#f", "https://example.com/blog/post"),
        ("/a b/ü", "https://example.com/a%20b/%C3%BC"),
        ("mailto:a@b?x", "nulla@b"),
        ("http://", "http://"),
        ("http://user:pw@H.com:8080", "http://h.com:8080/"),
    ],
)
def test_normalize_link_url(spark, href, want):
    assert one(spark, urls.normalize_link_url(F.lit(href), F.lit(PAGE))) == want


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTPS://EXAMPLE.com/Page/", "https://example.com/Page"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com/a/?q=1/#x", "https://example.com/a?q=1/#x"),
        ("http://example.com:80/a", "http://example.com/a"),
        ("not a url", "not a url"),
    ],
)
def test_normalize_crawl_url(spark, url, want):
    assert one(spark, urls.normalize_crawl_url(F.lit(url))) == want


def test_is_url(spark):
    for text, want in (
        ("https://a.b/c", True), ("upload://x", True), ("/x", False), ("", False),
        ("http:///", False), ("http://a b/", False), ("http://[::1]/", True), ("http://a:99999x/", False),
    ):
        assert one(spark, urls.is_url(F.lit(text))) is want, text


def test_numbers(spark):
    for ip, want in (
        ("10.0.0.1", True), ("172.16.0.1", True), ("172.32.0.1", False), ("192.168.1.1", True),
        ("127.0.0.1", True), ("169.254.1.1", True), ("0.0.0.0", True), ("8.8.8.8", False),
        ("::1", True), ("1.2.3", True), ("1.2.3.x", True),
    ):
        assert one(spark, scoring.is_private_ip(F.lit(ip))) is want, ip
    for x, want in ((0.285, "0.28"), (0.615, "0.61"), (0.625, "0.63"), (0.85, "0.85"), (1.0, "1.00")):
        assert one(spark, two_decimals(F.lit(x))) == want
    for x, want in ((1.0, "1"), (0.85, "0.85"), (0.00012, "0.00012"), (0.0, "0")):
        assert one(spark, plain_number(F.lit(x))) == want
    for x, want in ((0.85, "critical"), (0.8499, "warning"), (0.6, "warning"), (0.59, "info")):
        assert one(spark, scoring.severity_of(F.lit(x))) == want
    padded = one(spark, scoring.zero_pad(F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>"), 4))
    assert padded == [1.0, 2.0, 0.0, 0.0]
    assert len(one(spark, scoring.zero_pad(F.array_repeat(F.lit(1.0), 9).cast("array<float>"), 4))) == 9
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, scoring.cosine_similarity(zero, zero)) is None
    for status, error, want in ((503, None, "transient"), (404, None, "permanent"), (0, "ECONNRESET", "transient")):
        got = one(spark, scoring.http_failure_class(F.lit(status), F.lit(error).cast("string")))
        assert got == want


@pytest.mark.parametrize("name", ["best_sentence", "best_phrase"])
def test_sentences_are_scored_once(spark, name):
    """Neither the join's condition nor a filter scores them too."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, entry.SAMPLE_DIR)._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("array_max(transform(array(filter(split(") <= 1
    assert "Join Inner, ((array_max" not in plan.toString()


def test_title_is_split_once(spark):
    df = spark.createDataFrame([("a b. c d", "c - site")], "body string, title string")
    best = tx.best_sentence(
        tx.scored_sentences(F.col("body")), tx.distinctive_words(tx.display_title(F.col("title")))
    )
    plan = df.select(best.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    # Bound outside the sentences: the title comes before what reads the body.
    assert plan.index("title#") < plan.index("body#")
    assert df.select(best["sentence"]).first()[0] == "c d"


def test_distinctive_words_drop_every_other_character(spark):
    text = "Über-Maß x1 İy\x0bz　K9 中文w\U0001f600v ÿ\u0085u _ ﻿the÷k"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.distinctive_words(F.col("t"))).first()[0] == [
        "berma", "x1", "iy", "z", "k9", "wv", "u", "thek"
    ]


def test_anchor_is_computed_once(spark):
    """The filter on the anchor is no part of a join's condition."""
    from linkloom.operators import semantic

    similar = spark.createDataFrame(
        [("p", "1", "2", 0.9, 1)],
        "project_id string, source_id string, target_id string, similarity double, rank int",
    )
    articles = spark.createDataFrame(
        [("p", "1", "https://a.b/1", "x", "Red apples fall."), ("p", "2", "https://a.b/2", "Red apples", "y")],
        "project_id string, article_id string, url string, title string, body string",
    ).withColumn("existing_links", F.array().cast("array<struct<href:string,anchor_text:string>>"))
    found = semantic.semantic_targets(similar, articles, articles, similar.limit(0))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_max(") == 2  # one anchor: its sentence and its phrase
    assert found.first().anchor_text == "Red apples fall"


def test_plain_links_as_step_by_step(spark):
    """Links of plain segments take a short way to the same key."""
    bases = ("https://E.com/en/a/b", "https://e.com", "http://e.com:80/x/../y/z", "ftp://e.com/a", "https://e.com//a/b")
    links = ("../c/3/?r=o#x", "../../x", "../x", "..", "x//", "/en/x/", "/", "", "?a", "x#?y", "x/../y", ".x", "a.b/c", "a:b", "x y")
    rows = spark.createDataFrame([(b, h) for b in bases for h in links], "base string, href string")
    base = urls.base_parts(F.col("base"))
    long_way = base.withField("plain", F.lit(False))
    keys = rows.select(urls.link_key(F.col("href"), base).alias("a"), urls.link_key(F.col("href"), long_way).alias("b"))
    assert rows.filter(base["plain"]).count() and keys.filter(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()
