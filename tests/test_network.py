import pytest

from linkloom.sources import network, sitemaps


def urlset(urls):
    return "<urlset xmlns='http://x/y'>" + "".join(f"<url><loc> {u} </loc></url>" for u in urls) + "</urlset>"


def index(urls):
    return "<?xml version='1.0'?><sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"


def crawl(spark, docs, roots):
    """docs: url -> text or (status, text, error, safe)."""
    rows = []
    for url, d in docs.items():
        status, text, error, safe = d if isinstance(d, tuple) else (200, d, None, True)
        rows.append((url, status, None, text, error, safe, None if safe else "private"))
    df = spark.createDataFrame(rows, "doc_url string, status int, content_type string, text string, error string, safe boolean, reason string")
    visited = sitemaps.sitemap_index_expand(df, spark.createDataFrame([(r,) for r in roots], "url string")).cache()
    found = sitemaps.sitemap_urls(visited).orderBy("root", "pos").collect()
    lists = {r: [x.url for x in found if x.root == r] for r in roots}
    warned = [x for r in sitemaps.fetch_warnings(visited).collect() for x in r.warnings]
    return lists, warned


def test_sitemaps(spark):
    docs = {
        "two": urlset(["https://e.com/1?a=1&amp;b=2", "https://e.com/2"]),
        "idx": index(["two", "list"]),
        "list": "https://e.com/3\n\n  http://e.com/4 \nnope\nhttps://e.com/2/\n",
        "deep0": index(["deep1"]), "deep1": index(["deep2"]), "deep2": index(["two"]),
        "same": urlset(["https://E.com/A/", "https://e.com/A", "https://e.com/a"]),
        "bad": "<urlset><url><loc>https://e.com/x</loc>",
        "html": "<html></html>", "text": "hello", "404": (404, "x", None, True), "err": (0, None, "boom", True),
        "priv": (200, urlset(["https://e.com/p"]), None, False),
    }
    lists, warned = crawl(spark, docs, list(docs) + ["missing"])
    assert lists["two"] == ["https://e.com/1?a=1&b=2", "https://e.com/2"]
    assert lists["idx"] == ["https://e.com/1?a=1&b=2", "https://e.com/2", "https://e.com/3", "http://e.com/4"]
    assert lists["deep0"] == [] and lists["deep1"] == ["https://e.com/1?a=1&b=2", "https://e.com/2"]
    assert lists["same"] == ["https://E.com/A/", "https://e.com/a"]
    assert lists["bad"] == [] and lists["priv"] == []
    text = "\n".join(warned)
    for part in ("depth 2 exceeds", "Unrecognized sitemap format at html", "No URLs found in response from text",
                 "Non-200 HTTP status 404 fetching 404", "Failed to fetch err: boom", "blocked URL (skipped): priv — private"):
        assert part in text, part


def test_sitemap_cap(spark):
    lists, _ = crawl(spark, {"big": urlset([f"https://e.com/{k}" for k in range(10_500)])}, ["big"])
    assert len(lists["big"]) == 10_000 and lists["big"][-1] == "https://e.com/9999"
    found = spark.createDataFrame([("big", "u", 0, 10_500), ("ok", "u", 0, 3)], "root string, url string, pos int, total bigint")
    assert [r.root for r in sitemaps.cap_warnings(found).collect()] == ["big"]


def test_url_list_rows(spark):
    df = spark.createDataFrame([("https://e.com/",)], "url string")
    assert sitemaps.url_list_rows(df).count() == 1
    for bad in ([], [("nope",)]):
        with pytest.raises(ValueError):
            sitemaps.url_list_rows(spark.createDataFrame(bad, "url string"))


@pytest.mark.parametrize(
    "text,agent,path,allowed,delay",
    [
        ("User-agent: *\nDisallow: /private", "bot", "/private/x", False, None),
        ("User-agent: *\nDisallow: /private", "bot", "/public", True, None),
        ("User-agent: *\nDisallow: /\n\nUser-agent: Bot\nAllow: /", "bot", "/x", True, None),
        ("User-agent: *\nCrawl-delay: 5s\nDisallow: /a", "bot", "/b", True, 5.0),
        ("User-agent: other\nDisallow: /", "bot", "/x", True, None),
        ("", "bot", "/x", True, None),
        ("garbage\n: : :\nDisallow /", "bot", "/x", True, None),
        ("User-agent: *\nDisallow: /a\nAllow: /a/b # why", "bot", "/a/b/c", True, None),
        ("User-agent: *\nAllow: /a\nDisallow: /a", "bot", "/a", True, None),
        ("User-agent: x\nUser-agent: bot\nDisallow: /q\nUser-agent: *\nDisallow: /", "BOT", "/z", True, None),
        ("User-agent: *\nDisallow:\nCrawl-delay: 0", "bot", "/x", True, None),
    ],
)
def test_robots(spark, text, agent, path, allowed, delay):
    rules = network.robots_rules(spark.createDataFrame([("e.com", text)], "domain string, robots_txt string"))
    urls = spark.createDataFrame([(f"https://E.com{path}?q",), ("https://unknown.com/",)], "url string")
    got = {r.url: r for r in network.robots_allowed(urls, rules, agent).collect()}
    hit = got[f"https://E.com{path}?q"]
    assert (hit.allowed, hit.crawl_delay) == (allowed, delay)
    assert got["https://unknown.com/"].allowed


def test_url_safety(spark):
    dns = spark.createDataFrame([("ok.com", "8.8.8.8", 0), ("mix.com", "8.8.8.8", 0), ("mix.com", "192.168.0.1", 1)], "host string, ip string, ord int")
    urls = ["https://OK.com/x", "http://mix.com/", "ftp://ok.com/", "https://none.com/", "nope"]
    got = {r.url: (r.safe, r.resolved_ip, r.reason) for r in network.url_safety(spark.createDataFrame([(u,) for u in urls], "url string"), dns).collect()}
    assert got["https://OK.com/x"] == (True, "8.8.8.8", None)
    assert got["http://mix.com/"][2] == "Resolved to private IP: 192.168.0.1"
    assert got["ftp://ok.com/"][2] == "Unsupported scheme: ftp:" and got["nope"][2] == "Invalid URL"
    assert not got["https://none.com/"][0]


def test_cut_sitemap_keeps_its_leading_urls(spark, monkeypatch):
    entries = "".join(f"<sm:url><sm:loc>https://e.com/{k}</sm:loc></sm:url>" for k in range(100))
    text = f'<?xml version="1.0"?><sm:urlset xmlns:sm="x">{entries}</sm:urlset>'
    docs = spark.createDataFrame([("https://e.com/s.xml", 200, text)], "doc_url string, status int, text string")
    roots = spark.createDataFrame([("https://e.com/s.xml",)], "url string")
    monkeypatch.setattr(sitemaps, "MAX_CHARS", len(text) // 2)
    got = [r.url for r in sitemaps.sitemap_urls(sitemaps.sitemap_index_expand(docs, roots)).orderBy("pos").collect()]
    assert 40 < len(got) < 50 and got == [f"https://e.com/{k}" for k in range(len(got))]


def test_a_domain_of_many_rules(spark):
    """The index answers as a walk over all rules does."""
    import random

    rng = random.Random(5)
    paths = list({"/" + "/".join(rng.choices(["a", "b", "cc", "d1"], k=rng.randint(1, 9))) for _ in range(4000)})
    lines = ["User-agent: *", "Crawl-delay: 2"] + [f"{rng.choice(['Allow', 'Disallow'])}: {p}" for p in paths + paths[:50]]
    rules = network.robots_rules(
        spark.createDataFrame([("e.com", "\n".join(lines)), ("f.com", "User-agent: other\nDisallow: /")], "domain string, robots_txt string")
    )
    asked = ["/" + "/".join(rng.choices(["a", "b", "cc", "d1", "x"], k=rng.randint(1, 12))) for _ in range(300)]
    rows = [(f"https://e.com{p}", k) for k, p in enumerate(asked + asked[:20])] + [("https://f.com/a", 1), ("https://none.com/a", 2), (None, 3)]
    got = network.robots_allowed(spark.createDataFrame(rows, "url string, n int"), rules, "bot").collect()

    def allowed(path):
        best = None
        for k, line in enumerate(lines[2:]):
            kind, rule = line.split(": ")
            if path.startswith(rule) and (best is None or (len(rule), -k) > best[:2]):
                best = (len(rule), -k, kind == "Allow")
        return best is None or best[2]

    want = [(u, n, allowed(u[13:]) if u and u.startswith("https://e.com") else True, 2.0 if u and u.startswith("https://e.com") else None) for u, n in rows]
    assert sorted(((r.url or "", r.n, r.allowed, r.crawl_delay) for r in got), key=repr) == sorted(((u or "", *w) for u, *w in want), key=repr)
