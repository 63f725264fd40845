import random

import pytest
from brute import best_window, keyword
from pyspark.sql import functions as F

from linkloom.functions import text as tx
from linkloom.functions.text import content_hash
from linkloom.operators import fuzzy, matching
from linkloom.plans import crosslink as cl
from linkloom.plans.registry import Context, Strategy, StrategyRegistry

FILL = "word " * 60
LINKS = "array<struct<href:string,anchor_text:string>>"


def articles(spark, rows):
    """rows: (id, title, body) with optional dict of other columns."""
    full = []
    for r in rows:
        extra = r[3] if len(r) > 3 else {}
        full.append(
            (
                extra.get("project", "p"), r[0], extra.get("url", f"https://example.com/{r[0]}"), r[1], r[2],
                extra.get("links", []), extra.get("noindex", False), extra.get("status", 200),
                extra.get("embedding"),
            )
        )
    df = spark.createDataFrame(
        full,
        f"project_id string, article_id string, url string, title string, body string, existing_links {LINKS}, "
        "noindex boolean, http_status int, embedding array<float>",
    )
    return df.withColumns(
        {
            "body_hash": content_hash(F.col("body")),
            "title_hash": content_hash(F.col("title")),
            "word_count": tx.word_count(F.col("body")),
        }
    )


def run(spark, rows, **settings):
    out = cl.crosslink(Context(articles(spark, rows)), settings)
    return {(r.source_id, r.target_id): r for r in out.collect()}


def test_cases(spark):
    rows = [
        ("a01", "Source", "We like the React Hooks Guide here. " + FILL),
        ("a02", "React Hooks Guide", FILL),
        ("a03", "Fuzzy Source", "See React Hook Patterns now. " + FILL),
        ("a04", "React Hooks Pattern", FILL),
        ("a05", "Vue Router Deep Dive", "Vue Router Deep Dive " + FILL),
        ("a06", "Short one", "React Hooks Guide"),
        ("a07", "The Best", FILL),
        ("a08", "Click Here", "the best click here " + FILL),
        ("a09", "Hidden Noindex Target Page", FILL, {"noindex": True}),
        ("a10", "Broken Error Target Page", FILL, {"status": 500}),
        ("a11", "mentions", "hidden noindex target page, broken error target page. " + FILL),
        ("a12", "linker", "react hooks guide. " + FILL, {"links": [("/de/a02/?x=1", "t")]}),
        ("a13", "How to Use TypeScript Generics", FILL),
        ("a14", "ts", "TypeScript Generics are nice. " + FILL),
        ("a15", "gone", "react hooks guide " + FILL, {"status": 404}),
        ("a16", "null links", "react hooks guide " + FILL, {"links": None}),
    ]
    got = run(spark, rows)
    hit = got[("a01", "a02")]
    assert (hit.confidence, hit.severity, hit.matching_approach) == (1.0, "critical", "keyword")
    assert (hit.char_start, hit.char_end, hit.anchor_text) == (12, 29, "React Hooks Guide")
    assert hit.title == 'Link to "React Hooks Guide"' and "React Hooks Guide" in hit.source_context
    assert hit.suggestion.target_url == "https://example.com/a02"
    near = got[("a03", "a04")]
    assert near.confidence < 1 and near.matching_approach == "keyword"
    want = best_window(rows[2][2], "React Hooks Pattern", 0.8)
    assert (near.char_start, round(near.confidence, 9)) == (want[0], round(want[1], 9))
    assert ("a14", "a13") in got and round(got[("a14", "a13")].confidence, 4) == 0.8095
    assert ("a16", "a02") in got
    for absent in (("a05", "a05"), ("a06", "a02"), ("a08", "a07"), ("a08", "a08"), ("a11", "a09"),
                   ("a11", "a10"), ("a12", "a02"), ("a15", "a02")):
        assert absent not in got, absent


def test_small_index_and_markup(spark):
    assert run(spark, [("a", "React Hooks Guide", "react hooks guide " + FILL)]) == {}
    got = run(
        spark,
        [
            ("a", "x", "<script>bad</script>React Hooks Advanced Guide " + FILL),
            ("b", "<script>bad</script>React Hooks Advanced Guide", FILL),
        ],
    )
    # The raw title is searched, the clean one shown.
    assert got[("a", "b")].anchor_text == "badReact Hooks Advanced Guide"
    assert got[("a", "b")].char_end - got[("a", "b")].char_start == 46


def test_budget_in_id_order(spark):
    titles = [f"Topic number{k} special subject" for k in range(20)]
    rows = [("zz", "Source", " ".join(titles) + " " + FILL)]
    rows += [(f"t{k:02}", t, FILL) for k, t in enumerate(titles)]
    got = run(spark, rows, max_links_per_page=3, fuzzy_plan="none")
    assert sorted(k[1] for k in got if k[0] == "zz") == ["t00", "t01", "t02"]
    assert len([k for k in run(spark, rows) if k[0] == "zz"]) == 10


def _random_corpus(seed, n=40):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "rho", "sigma", "taus", "x1"]
    titles = [" ".join(rng.choices(words, k=rng.randint(3, 6))) for _ in range(8)]
    rows = []
    for k in range(n):
        parts = rng.choices(words, k=60)
        for t in rng.sample(titles, 2):
            t = list(t)
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = rng.choice("abxyz ")
            parts.insert(rng.randrange(60), "".join(t))
        body = rng.choice([" ", "\n", "  "]).join(parts)
        links = [(f"https://example.com/r{rng.randrange(n)}", "t") for _ in range(rng.randint(0, 3))]
        rows.append((f"r{k}", rng.choice(titles), body, {"project": rng.choice("pq"), "links": links}))
    # A third of all rows share body, title and address variants.
    for k in range(n // 2):
        rows.append((f"c{k:02}", titles[0], rows[0][2],
                     {"project": "p", "url": f"https://example.com/copy?v={k}", "links": []}))
    return rows


@pytest.mark.parametrize("seed,plan", [(1, "broadcast"), (2, "prefix"), (3, "auto")])
def test_against_brute_force(spark, seed, plan):
    rows = _random_corpus(seed)
    df = articles(spark, rows).cache()
    sources, targets = matching.source_guards(df), cl.phrase_targets(df)
    got = cl.keyword_pairs(sources, targets, 0.8, 4, plan)
    got = {(r.source_id, r.target_id, r.offset, round(r.confidence, 9)) for r in got.collect()}
    keyed = {r.target_id: r for r in targets.withColumn("k", matching.link_key(F.col("target_url"))).collect()}
    t = {k: (r.project_id, r.k, r.phrase) for k, r in keyed.items()}
    s = {r[0]: (r[3]["project"], r[2], {x[0] for x in r[3]["links"]}) for r in rows}
    assert got == keyword(s, t, 0.8, 4)


def test_exact_blocking_is_lossless(spark):
    bodies = ["xalpha beta gammay", "alpha  beta gamma", "ALPHA BETA GAMMA", "beta gamma", "q alpha\tbeta gamma",
              "alpha beta gamma delta", "zalpha beta gamma delta"]
    phrases = ["alpha beta gamma", " alpha beta gamma", "alpha beta gamma ", "beta gamma delta", "alpha\tbeta gamma"]
    b = spark.createDataFrame([("p", str(k), x) for k, x in enumerate(bodies)], "project_id string, body_id string, body string")
    p = spark.createDataFrame([("p", x) for x in phrases], "project_id string, phrase string")
    got = {(r.body_id, r.phrase, r.offset) for r in matching.phrase_hits(b, p).collect()}
    want = {(str(k), x, y.lower().find(x)) for k, y in enumerate(bodies) for x in phrases if x in y.lower()}
    assert got == want


def test_windows_against_brute_force(monkeypatch):
    """The prefix index finds the window that comparing every window finds."""
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "of", "aa", "aaa", "x1", "\u00e9t\u00e9", "\U0001f600b"]
    for seed in range(60):
        monkeypatch.setattr(fuzzy, "_CELLS", rng.choice([40, 2_000_000]))
        threshold = rng.choice([0.5, 0.7, 0.8, 1.0])
        phrases = list({" ".join(rng.choices(words, k=rng.randint(2, 5))) for _ in range(6)})
        body = rng.choice([" ", "\n"]).join(
            "".join(c if rng.random() < 0.9 else rng.choice("abx ") for c in rng.choice([*phrases, *words])) for _ in range(30)
        )
        index = fuzzy.PhraseIndex(phrases, threshold, fuzzy._codes(rng.choice(["ab", body])))
        got = {p: (t, round(d, 9)) for p, t, d in index.best_windows(body)}
        want = {p: best_window(body, p, threshold) for p in phrases if p not in body}
        assert got == {p: (w[0], round(w[1], 9)) for p, w in want.items() if w}, seed
    assert not list(fuzzy.PhraseIndex([], 0.8, fuzzy._codes("ab")).best_windows("some text"))
    assert not list(fuzzy.PhraseIndex(["some text"], 0.8, fuzzy._codes("ab")).best_windows("s"))


def test_slices_and_parts_change_no_row(spark, data_dir, monkeypatch):
    from linkloom.plans.queries_links import _page_sides

    b = spark.createDataFrame([("p", "1", "one two three"), ("p", "2", ""), ("q", "3", "one two three")], "project_id string, body_id string, body string")
    p = spark.createDataFrame([("p", "one two thres"), ("p", "one twx three"), ("r", "one two thres")], "project_id string, phrase string")
    got = fuzzy.fuzzy_hits(b, p, None, 0.7).collect()
    assert sorted((r.body_id, r.phrase, r.offset, r.context) for r in got) == [
        ("1", "one two thres", 0, "one two three"), ("1", "one twx three", 0, "one two three")
    ]
    sources, targets = _page_sides(spark, data_dir)
    bodies, phrases = matching.distinct_bodies(sources), matching.distinct_phrases(targets)
    whole = sorted(fuzzy.fuzzy_hits(bodies, phrases, None, 0.5).collect())
    monkeypatch.setattr(fuzzy, "SLICE_CHARS", 5_000)
    monkeypatch.setattr(fuzzy, "PART_PHRASES", 3)
    assert sorted(fuzzy.fuzzy_hits(bodies, phrases, None, 0.5).collect()) == whole and whole


def test_few_pairs_are_compared(spark, data_dir):
    from linkloom.plans.queries_links import _page_sides

    sources, targets = _page_sides(spark, data_dir)
    rows = fuzzy.fuzzy_work(matching.distinct_bodies(sources), matching.distinct_phrases(targets)).collect()
    pairs, compared = sum(r.pairs for r in rows), sum(r.compared for r in rows)
    assert pairs > 10_000 and compared < 0.05 * pairs


def test_limit_per_key_two_passes(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), "id").repartition(4)
    one = matching.limit_per_key(df, ["k"], [F.col("id")], 900)
    two = matching.limit_per_key(df, ["k"], [F.col("id")], 1200)
    assert one.agg(F.max("id")).first()[0] == 1799 and two.agg(F.max("id")).first()[0] == 2399
    assert two.count() == 2400


def test_already_linked(spark):
    df = articles(spark, [
        ("a", "t", "b", {"links": [("/academy/x", "l"), ("https://example.com/fr/y/", "l")]}),
        ("x", "t", "b", {"url": "https://example.com/academy/x"}),
        ("y", "t", "b", {"url": "https://example.com/en/y?z=1"}),
        ("z", "t", "b"),
    ])
    pairs = spark.createDataFrame([("p", "a", t) for t in "xyza"], "project_id string, source_id string, target_id string")
    assert {r.target_id for r in matching.already_linked(pairs, df).collect()} == {"z", "a"}
    assert {r.target_id for r in matching.target_guards(pairs, df).collect()} == {"z"}


def test_semantic(spark):
    a, b, c = [1.0, 0.0], [0.9, 0.1], [0.0, 1.0]
    rows = [
        ("a1", "Nothing alike", "Our spark joins guide text. " + FILL, {"embedding": a}),
        ("a2", "Guide to Joins in Spark | Site", FILL, {"embedding": b}),
        ("a3", "Unrelated Vector Title", FILL, {"embedding": c}),
        ("a4", "No Vector Title", "spark joins guide " + FILL),
    ]
    got = run(spark, rows)
    hit = got[("a1", "a2")]
    assert (hit.matching_approach, hit.severity) == ("semantic", "critical")
    assert hit.title == 'Link to "Guide to Joins in Spark"' and hit.anchor_text == "Our spark joins guide text"
    assert hit.description == "Found semantically similar article (similarity: 0.99)."
    assert (hit.char_start, hit.char_end) == (0, 26)
    assert not [k for k in got if "a4" == k[0] and got[k].matching_approach == "semantic"]
    assert run(spark, rows, approaches=("keyword",), fuzzy_plan="none").get(("a1", "a2")) is None
    # A link that exists in another spelling blocks the semantic row too.
    rows[0][3]["links"] = [("/de/a2#x", "t")]
    assert ("a1", "a2") not in run(spark, rows)


def test_registry(spark):
    def rows(n):
        return lambda ctx, settings: ctx.articles.select(F.col("article_id").alias("source_id"), F.lit(n).alias("target_id"))

    def fails(ctx, settings):
        return ctx.articles.select(F.raise_error(F.lit("late failure")).alias("source_id"))

    registry = StrategyRegistry()
    registry.register(Strategy("a", "A", "", rows("one")))
    registry.register(Strategy("b", "B", "", fails))
    registry.register(Strategy("c", "C", "", rows("two")))
    registry.register(Strategy("a", "A2", "", rows("three")))
    registry.unregister("missing")
    assert [s.id for s in registry.list()] == ["a", "b", "c"] and registry.get("a").name == "A2"
    assert registry.get("none") is None
    found, errors = registry.analyze_with_all(Context(articles(spark, [("x", "t", "b")])))
    assert sorted(r.target_id for r in found.collect()) == ["three", "two"]
    assert list(errors) == ["b"] and "late failure" in errors["b"]


def test_fuzzy_compares_few_windows():
    """F1 to F4: a long phrase holds the frequent bigrams, so rare ones alone left a seventh
    of all windows to be compared; texts of a slice are read together."""
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(1500)) for _ in range(4)]
    phrases = [" ".join(rng.choice(words) for _ in range(n)) for n in (4, 8, 16, 32, 48) for _ in range(8)]
    texts[2] += " " + phrases[-1][:-4] + "etao"
    work = [0, 0]
    got = list(fuzzy.PhraseIndex(phrases, 0.8).best_of(texts, work))
    assert (2, phrases[-1]) in [(t, p) for t, p, _, d in got if d > 0.9]
    for t, p, at, dice in got:
        assert (at, dice) == pytest.approx(best_window(texts[t], p, 0.8))
    assert work[1] * 50 < work[0]


def test_links_are_normalised_once(spark):
    """Neither the generator's filter nor the join's normalises all links again."""
    rows = [("p", "1", "https://e.com/en/a", [("b", "x"), (None, "x")]), ("p", "2", "https://e.com/en/b", None), ("p", "3", None, [("", "x")])]
    stored = spark.createDataFrame(rows, f"project_id string, article_id string, url string, existing_links {LINKS}")
    pairs = stored.alias("s").join(stored.alias("t"), F.expr("s.article_id <> t.article_id")).select(
        "s.project_id", F.col("s.article_id").alias("source_id"), F.col("t.article_id").alias("target_id")
    )
    left = matching.already_linked(pairs, stored)
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(null, ") == 2  # links and targets, once each
    assert ("1", "2") not in {(r.source_id, r.target_id) for r in left.collect()} and left.count() == 5


@pytest.mark.parametrize("marks", [64, 1024])
def test_windows_are_sifted_before_they_are_compared(monkeypatch, marks):
    """F1 to F4: a stretch of few letters holds the bigrams of many phrases (one window in
    60 was compared); the windows' own sets of bigrams tell them apart, without loss,
    also where bigrams share a bit."""
    monkeypatch.setattr(fuzzy, "MAX_MARKS", marks)
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(2)] + ["", "e", "été 中文 " * 9]
    phrases = [" ".join(rng.choice(words) for _ in range(n)) for n in (4, 8, 16) for _ in range(12)]
    phrases += ["été 中文 x", "zzzz", "qqq xxx"]
    texts[1] += " " + phrases[3][:-4] + "etao"
    work = [0, 0]
    got = {(t, p): (at, round(d, 9)) for t, p, at, d in fuzzy.PhraseIndex(phrases, 0.8).best_of(texts, work)}
    want = {(t, p): best_window(x, p, 0.8) for t, x in enumerate(texts) for p in phrases if p not in x}
    assert got == {k: (w[0], round(w[1], 9)) for k, w in want.items() if w}
    assert marks == 64 or work[1] * 500 < work[0]
