"""Line dedup against a plain count of pages, and odd rows."""

from collections import defaultdict

from linkloom.llm import line_dedup

BLANKS = " \t\x0b\x0c\r"


def brute(rows):
    """Cleaned texts of ``(source, text)``."""
    pages, holders = defaultdict(set), defaultdict(set)
    for s, t in rows:
        pages[s].add(t or "")
        for x in (t or "").split("\n"):
            if x.strip(BLANKS):
                holders[s, x.strip(BLANKS)].add(t or "")
    bad = {k for k, v in holders.items() if len(v) >= line_dedup.MIN_PAGES and len(v) * 100 > len(pages[k[0]]) * line_dedup.MAX_SHARE_PERCENT}
    out = []
    for s, t in rows:
        own = [x for x in (t or "").split("\n") if (s, x.strip(BLANKS)) not in bad]
        out.append(t if len(own) == len((t or "").split("\n")) else "\n".join(own))
    return out


def test_rows(spark):
    rows = []
    for k in range(30):
        rows.append(("a", f"Home\nown {k}\n \n  Home  \nrare {k % 15}"))
        rows.append((None, f"text {k}\nShared\r"))
        rows.append(("big", f"line {k}" + ("\nAd" if k < 3 else "")))
    rows += [("a", "copied page\nsecond line")] * 40 + [("b", None), ("b", ""), ("b", "\n\n"), ("solo", "Home")]
    rows += [("all", "Only")] * 2 + [("all", f"Only\n{k}") for k in range(9)]
    rows += [("a", "long\n" * 5000 + "Home")]
    docs = spark.createDataFrame([(k, s, t, 7, "x", "y") for k, (s, t) in enumerate(rows)], "doc_id long, source string, text string, n_chars long, _drop string, row string")
    got = sorted(line_dedup.dedup_lines(docs).collect())
    assert [r.text for r in got] == brute(rows)
    assert docs.columns == line_dedup.dedup_lines(docs).columns
    for r, (_, before) in zip(got, rows, strict=True):
        assert (r._drop, r.row) == ("x", "y")
        assert r.n_chars == (7 if r.text == before else len(r.text))
    assert got[0].text.startswith("own 0") and got[1].text == "text 0"
    assert any(t == "copied page\nsecond line" for t in (r.text for r in got))
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "s", f"Top\n{k}") for k in range(8)] + [(1, "s", "Top\n0")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert sorted(r.text for r in line_dedup.dedup_lines(docs).collect()) == sorted([str(k) for k in range(8)] + ["0"] * 3)
