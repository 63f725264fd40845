"""URL parts, rules and templates on small cases; SQL covers the given pages."""

from pyspark.sql import functions as F

from linkloom.llm import url_filter as u

PARTS = [
    (None, "", ""), ("", "", ""), ("no scheme/x", "", ""), ("http://A.Org", "a.org", ""), ("x://É.org/a/b?c://d/e#f", "É.org", "/a/b"),
    ("http://h#/p", "h", ""), ("http://h?q/p", "h", ""), ("://", "", ""), ("http://h/p#x?y", "h", "/p"), ("a://b://c/d", "b:", "//c/d"),
]
RULED = [
    ("example.org", "/es/1", "example.org/es/", "block"), ("m.example.org", "/es/", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"),
    ("example.org", "/en/2", "org/", "allow"), ("notexample.org", "/es/1", "org/", "allow"), ("org", "/x", "org/", "allow"), ("a.org", "", None, None),
    ("x.com", "/fr/1", "com/fr/", "allow"), ("x.com", "/de/", "com/de/", "block"), ("x.com", "/de", None, None), ("xcom", "/de/", None, None), ("com.net", "/fr/", None, None),
]


def test_parts(spark):
    host, path = u.split_url(F.col("url"))
    got = spark.createDataFrame(PARTS, "url string, h string, p string").select("url", host.alias("host"), path.alias("path")).collect()
    assert [tuple(r) for r in got] == PARTS


def test_rules(spark):
    rule, verdict = u.longest_rule(F.col("host"), F.col("path"))
    got = spark.createDataFrame(RULED, "host string, path string, r string, v string").select("host", "path", rule, verdict).collect()
    assert [tuple(r) for r in got] == RULED


def case():
    """One host: /shop/<n> is bad, /news/<n> good, /help/<word> unknown but like the host."""
    rows, bad = [], []
    for k in range(60):
        rows.append((k, f"http://h.net/shop/{k}.html"))
        rows.append((100 + k, f"http://h.net/news/{100 + k}/"))
        bad += [(k, 1 if k % 10 else 0), (100 + k, 0)]
    rows += [(200 + k, f"http://h.net/help/{chr(97 + k)}") for k in range(20)]
    return rows, bad


def test_templates_and_verdicts(spark):
    rows, bad = case()
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS template", "2 AS n")
    labels = spark.createDataFrame(bad[:80], "page_key long, bad int")
    got = {r.page_id: r for r in u.judge(pages, labels).collect()}
    assert len(got) == len(rows)
    assert got[5].template == "/shop/#.html" and got[5].verdict == "block"
    assert got[55].verdict == "block"  # unlabelled, but of the same template
    assert got[130].template == "/news/#/" and got[130].verdict == "allow"
    assert got[203].template == "/help/*" or got[203].template.startswith("/help/")
    assert got[203].host == "h.net" and got[203].rule is None


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "http://h/1"), (2, "http://h/" + "a/" * 300), (3, "nothing"), (4, "http://x.com/de/5")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 1), (1, 0), (5, 0)], "page_key long, bad int")
    got = sorted((r.page_id or 0, r.host, r.verdict) for r in u.judge(pages, labels).collect())
    assert got == [(0, "h", "block"), (1, "", "allow"), (1, "", "allow"), (2, "h", "block"), (3, "", "allow"), (4, "x.com", "block")]
    assert u.judge(pages.limit(0), labels).count() == 0
    assert u.judge(pages, labels.limit(0)).count() == len(rows)


def test_very_deep_paths(spark):
    """Thousands of segments are judged by hashes of their beginnings, not by texts."""
    import time

    deep = "https://a.com/" + "/".join(f"s{k}" for k in range(6000))
    pages = spark.createDataFrame([(k, f"{deep}/{k}") for k in range(3)] + [(9, "https://a.com/x")], "page_id long, url string")
    bad = spark.createDataFrame([(0, 1), (1, 0)], "page_key long, bad int")
    start = time.time()
    rows = u.judge(pages, bad).collect()
    assert len(rows) == 4 and all(r.host == "a.com" for r in rows) and time.time() - start < 60
