import pytest
from pyspark.sql import functions as F

from linkloom.sources import feeds
from linkloom.sources.html import extract, extract_markdown, markdown_to_html
from linkloom.sources.pages import normalize_articles, parse_pages, scoped, scoped_write


def parse(spark, html, url="https://example.com/p", status=None, kind="html"):
    df = spark.createDataFrame(
        [(url, html, status, kind)], "url string, html string, http_status int, format string"
    )
    return parse_pages(df).first()


def test_title_article_and_fallback(spark):
    page = parse(
        spark,
        "<html><head><title> Test Article </title></head><body><nav>menu</nav><article><h1>H</h1>"
        "<p>one two three</p></article><footer>foot</footer></body></html>",
    )
    assert (page.title, page.body, page.word_count) == ("Test Article", "Hone two three", 3)
    assert page.parse_warning is None
    assert parse(spark, "<body><h1> From H1 </h1><p>x</p></body>").title == "From H1"
    assert parse(spark, "<p>x").title == ""


def test_body_choice():
    assert extract("<article>a</article><main>m</main><main>n</main>")["body"] == "m"
    assert extract("<p>a</p><p>b</p>")["body"] == "ab"
    assert extract("<head><title>t</title></head>text")["body"] == "text"
    assert extract("<article>one<article>two</article>three</article>")["body"] == "onetwothree"
    assert extract("<article>x &amp; y&nbsp;z\n\n w</article>")["body"] == "x & y z w"
    assert extract("<article><p>a<div>b</article>c")["body"] == "ab"
    assert extract("<body>a<script>var x='</p>';</script><style>b{}</style><noscript>n</noscript>c")["body"] == "ac"
    assert extract("a<!-- <p>no</p> -->b<!doctype html>c")["body"] == "abc"
    assert extract("<textarea><b>raw</b></textarea>")["body"] == "<b>raw</b>"
    assert extract("")["body"] == ""


def test_broken_markup():
    assert extract('<a title="x>y" href=/a>t</a>')["links"] == [{"href": "/a", "anchor_text": "t"}]
    assert extract("<a href='/a'>x<a href='/b'>y</a>")["links"] == [
        {"href": "/a", "anchor_text": "x"},
        {"href": "/b", "anchor_text": "y"},
    ]
    # An unclosed link goes on in the next paragraph.
    assert [x["anchor_text"] for x in extract("<p><a href=/a>one<p>two</a>")["links"]] == ["one", "two"]
    assert extract("<h1>a<h2>b</h2>")["h1"] == "a"
    big = "<div " + "=" * 50_000
    assert isinstance(extract(big)["body"], str)


def test_links(spark):
    page = parse(
        spark,
        '<a href="/a">A</a><a href="https://EXAMPLE.com/b"> B </a><a href="https://other.com/c">C</a>'
        '<a href="d?x">D<b>!</b></a><a href="#f">F</a><a href="mailto:x@example.com">m</a><a href="/e"> </a>'
        '<a href="">G</a><a>H</a><a href="//example.com/i">I</a><a href="//o.com/j">J</a>',
    )
    assert [(x.href, x.anchor_text) for x in page.existing_links] == [
        ("/a", "A"), ("https://EXAMPLE.com/b", "B"), ("d?x", "D!"), ("#f", "F"), ("//example.com/i", "I"),
    ]


def test_metadata(spark):
    page = parse(
        spark,
        '<head><title>T</title><link rel="canonical" href="https://example.com/c"><meta name="description" content="D">'
        '<meta name="robots" content="NoIndex, follow"></head><body><h1>H</h1><h2> a </h2><h2>b</h2></body>',
        status=200,
    )
    m = page.metadata
    assert (m.canonical, m.meta_title, m.meta_description, m.h1) == ("https://example.com/c", "T", "D", "H")
    assert (m.h2s, m.noindex, m.nofollow, m.http_status) == (["a", "b"], True, False, 200)
    empty = parse(spark, "<p>x").metadata
    assert (empty.canonical, empty.meta_title, empty.h1, empty.h2s, empty.noindex) == (None, None, None, [], False)


def test_near_empty(spark):
    assert parse(spark, "<p>short", status=200).parse_warning == "near-empty-body"
    assert parse(spark, "<p>short", status=301).parse_warning is None
    assert parse(spark, "<p>short").parse_warning is None
    assert parse(spark, "<script>x</script>", status=200).word_count == 0
    assert parse(spark, "<p>" + "w " * 50, status=200).parse_warning is None


def test_markdown(spark):
    md = "# Title *here*\n\nText with [link](/x) and `code <b>`.\n\n- one\n- two\n\n```\n# no\n```\n"
    page = parse(spark, md, kind="markdown", status=200)
    assert page.title == "Title here"
    assert [(x.href, x.anchor_text) for x in page.existing_links] == [("/x", "link")]
    assert page.body == "Title here Text with link and code <b>. one two # no"
    assert markdown_to_html("a\n===\n\nb\n---") == "<h1>a</h1>\n<h2>b</h2>\n"
    assert extract_markdown("> quote **x**")["body"] == "quote x"


def test_normalize_and_scope(spark):
    page = spark.createDataFrame([("https://e.com/a", "<title>t</title><body>b")], "url string, html string")
    row = normalize_articles(parse_pages(page), F.lit("p"), "crawl").first()
    assert row.title_hash == "e3b98a4da31a127d4bde6e43033f66ba274cab0eb7eb1c70ec41402bf6273dd8"
    assert (row.project_id, row.source_type, len(row.article_id)) == ("p", "crawl", 64)
    df = spark.createDataFrame([("p", 1), ("q", 2)], "project_id string, x int")
    assert [r.x for r in scoped(df, "q").collect()] == [2]
    assert {r.project_id for r in scoped_write(df, "z").collect()} == {"z"}


def test_uploads(spark, tmp_path):
    (tmp_path / "a.html").write_text("<title>A</title><body>one two")
    (tmp_path / "b.md").write_text("# B\n\nthree")
    manifest = '[{"url":"https://e.com/m","title":"M","body":" x y"}]'
    (tmp_path / "m.json").write_text(manifest)
    (tmp_path / "bad.json").write_text('[{"url":"https://e.com/1","title":"ok","body":"ok"},{"url":"no","title":"t","body":"b"}]')
    (tmp_path / "broken.json").write_text("{oops")
    files = feeds.scan_upload_dir(spark, str(tmp_path)).cache()
    pages = {r.name: (r.title, r.body, r.url) for r in feeds.upload_pages(files).collect()}
    assert pages == {"a.html": ("A", "one two", "upload://a.html"), "b.md": ("B", "B three", "upload://b.md")}
    json_files = files.filter("extension = '.json'")
    rows = feeds.scan_json_manifest(json_files).collect()
    assert [(r.name, r.title, r.word_count, r.metadata.meta_title) for r in rows] == [("m.json", "M", 3, "M")]
    warned = {r.name: r.warning for r in feeds.manifest_files(json_files).collect()}
    assert warned["m.json"] is None and "schema" in warned["bad.json"] and "JSON" in warned["broken.json"]
    with pytest.raises(ValueError, match="50MB"):
        feeds.scan_upload_dir(spark, str(tmp_path), max_total=3)
    (tmp_path / "c.txt").write_text("x")
    with pytest.raises(ValueError, match="unsupported"):
        feeds.scan_upload_dir(spark, str(tmp_path))
    (tmp_path / "c.txt").unlink()
    (tmp_path / "e.html").write_text("")
    with pytest.raises(ValueError, match="empty"):
        feeds.scan_upload_dir(spark, str(tmp_path))


def test_push(spark):
    feed = spark.createDataFrame(
        [
            ("https://e.com/1", "Mine", "<title>theirs</title><body><a href='/x'>x</a> y", "html"),
            ("https://e.com/2", "Text", "  a  b ", "text"),
            ("https://e.com/3", "", "b", "text"),
            ("nope", "t", "b", "text"),
            ("https://e.com/5", "t", "b", "pdf"),
        ],
        "url string, title string, body string, format string",
    )
    rows = {r.url[-1]: r for r in feeds.scan_push_feed(feed).collect()}
    assert set(rows) == {"1", "2"}
    assert (rows["1"].title, rows["1"].metadata.meta_title, len(rows["1"].existing_links)) == ("Mine", "theirs", 1)
    assert (rows["2"].body, rows["2"].word_count, rows["2"].existing_links) == ("  a  b ", 2, [])
    errors = {r.url: r.errors for r in feeds.push_errors(feed).collect()}
    assert errors["nope"] == ["url"] and errors["https://e.com/5"] == ["format"]


def test_references_without_semicolon(spark):
    """F5, F7 to F11, F13 to F16: the page queries' SQL decodes closed references only."""
    html = "<title>a &lt;b&gt; &copy; &notit; &#65;&#x42; c&amp</title><article>x&amp;y &copy z</article>"
    rows = spark.createDataFrame([("https://example.com/p", html)], "url string, html string")
    strict = parse_pages(rows, bare_references=False).first()
    assert (strict.title, strict.body) == ("a <b> © &notit; AB c&amp", "x&y &copy z")
    # As the HTML standard does, which stays the parser's default.
    usual = parse_pages(rows).first()
    assert (usual.title, usual.body) == ("a <b> © ¬it; AB c&", "x&y © z")


def test_page_query_keeps_a_cut_reference(spark, tmp_path):
    import __spark_entry__ as entry
    from tests.oracle import canonical

    import duckdb

    html = "<html><head><title>One two three four &amp</title></head><body><h1>H</h1><article><p>x y</p></article></body></html>"
    rows = [(1, "https://example.com/en/1", html)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("parse_pages", "page_metadata", "normalize_articles", "title_guards", "scan_upload_dir", "incremental_ingest", "ingest"):
        df = entry.queries()[name](spark, str(tmp_path))
        cur = con.execute(entry.oracle_sql()[name])
        want = canonical([d[0] for d in cur.description], cur.fetchall())
        assert canonical(df.columns, [tuple(r) for r in df.collect()]) == want, name


@pytest.mark.parametrize("name", ["tenant_join", "analyze"])
def test_a_cut_reference_is_no_phrase(spark, tmp_path, monkeypatch, name):
    """a title that ends in ``&amp`` is not found where a body says ``&amp;``."""
    import duckdb

    import __spark_entry__ as entry
    from linkloom.plans import inputs
    from tests.oracle import canonical

    def page(title, body):
        return f"<html><head><title>{title}</title></head><body><article><p>{body}</p></article></body></html>"

    filler = " word" * 60
    rows = [
        (1, "https://example.com/en/1", page("Red green blue yellow &amp", "short")),
        (2, "https://example.com/en/2", page("Some other long title", f"red green blue yellow &amp; more{filler}")),
        (3, "https://example.com/en/3", page("Third page title here", f"some other long title{filler}")),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    cur = con.execute(entry.oracle_sql()[name])
    want = canonical([d[0] for d in cur.description], cur.fetchall())

    def got():
        df = entry.queries()[name](spark, str(tmp_path))
        return canonical(df.columns, [tuple(r) for r in df.collect()])

    assert got() == want and len(want) == 1
    monkeypatch.setattr(inputs, "BARE_REFERENCES", True)
    assert got() != want


def test_python_takes_few_pages_at_once(spark):
    """a batch is bounded by bytes, not only by 10,000 rows."""
    import pyarrow as pa

    from linkloom.session import pin_utc

    @F.arrow_udf("int")
    def batch_rows(x: pa.Array) -> pa.Array:
        return pa.array([len(x)] * len(x), pa.int32())

    pages = pin_utc(spark).range(0, 6000, 1, 1).select(F.repeat(F.lit("<p>x</p>"), 500).alias("html"))
    assert pages.select(batch_rows("html").alias("n")).agg(F.max("n")).first()[0] * 4000 < 8_000_000
