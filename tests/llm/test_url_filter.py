from attestor.llm import url_filter as U

PAGES = [
    (1, "https://a.b.net/x", None),
    (2, "https://www.example.net/en/1", ""),
    (3, "http://EXAMPLE.com/de/x?q#f", "x"),
    (4, "http://example.com/en/1", '<link rel="canonical" href="http://example.com/de/2">'),
    (5, "http://other.com/a", '<LINK href=http://mid.com/b rel=canonical>'),
    (6, "http://mid.com/b#frag", '<meta http-equiv="refresh" content="0; url=http://k.net/z">'),
    (7, "http://good.com/p", '<link rel="canonical" href="http://site.org/fr/1"><meta http-equiv="refresh" content="0;url=http://k.net/q">'),
    (8, "http://plain.com/", "<p>canonical</p>"),
    (9, None, None),
    (10, "no scheme.net/en", None),
    (11, "http://example.org/fr", None),
    (12, "http://rel.com/a/b", '<link rel="canonical" href="/c">'),
    (13, "https://x.example.net", None),
    (None, "http://y.net/", None),
    (1, "https://a.b.net/x", None),
]


def verdicts(spark, rows, **how):
    df = spark.createDataFrame([(i, u, h, "c", "v") for i, u, h in rows], "page_id long, url string, html string, component string, verdict string")
    return sorted((tuple(r) for r in U.filter_urls(df, **how).collect()), key=str)


def test_rules_and_aliases(spark):
    got = {r[0]: r[1:] for r in verdicts(spark, PAGES)}
    assert got[1] == ("a.b.net", "/x", "net/", "block", "rule")
    assert got[2][2:] == ("example.net/en/", "allow", "rule")
    assert got[3] == ("example.com", "/de/x", "example.com/de/", "block", "rule")
    assert got[4][2:] == (None, "block", "alias")  # its canonical address is blocked
    assert got[5][2:] == (None, "block", "alias") and got[6][2:] == (None, "block", "alias")  # through two steps
    assert got[7][2:] == (None, "allow", "alias")  # an allowed alias wins over a blocked one
    assert got[8][2:] == (None, "allow", "default")
    assert got[9] == ("", "", None, "allow", "default") and got[10] == got[9]
    assert got[11][2:] == (None, "allow", "default")  # the path does not start with /fr/
    assert got[13] == ("x.example.net", "", None, "allow", "default")
    assert got[None][3] == "block"


def test_redirect_table_and_repeated_rows(spark):
    moves = spark.createDataFrame([("http://plain.com/", "http://z.net/"), (None, "http://a.com/")], "from_url string, to_url string")
    got = verdicts(spark, PAGES, redirects=moves)
    assert len(got) == len(PAGES)
    assert [r[4] for r in got if r[0] == 8] == ["block"]


def test_rule_table_gives_the_same(spark):
    from pyspark.sql import functions as F

    df = U.split_url(spark.createDataFrame([(i, u) for i, u, _ in PAGES[:13]], "page_id long, url string"), F.col("url"))
    rules = spark.createDataFrame(list(U.DEFAULT_RULES), "verdict string, rule string")
    inline = df.withColumn("m", U.match_rules(U.DEFAULT_RULES, F.col("host"), F.col("path")))
    table = U.match_rules_table(df, rules, "page_id")
    assert {r.page_id: r.m for r in inline.collect()} == {r.page_id: r["__m"] for r in table.collect()}


def test_empty_table(spark):
    assert verdicts(spark, []) == []


def test_targets_are_resolved_against_the_page(spark):
    link = lambda t: f'<link rel="canonical" href="{t}">'
    cases = [
        ("http://h.com/a/b?x#f", "next.html", "h.com/a/next.html"), ("http://h.com/a/b", "../c/./d", "h.com/c/d"), ("http://h.com/a/b/", "..", "h.com/a/"),
        ("http://h.com/a/b?x", "?p=2", "h.com/a/b?p=2"), ("http://h.com", "n", "h.com/n"), ("http://h.com/a", "/go?u=http://x.net/", "h.com/go?u=http://x.net/"),
        ("http://h.com/a", "/q?a=1&amp;b=2&#38;c&copy=3", "h.com/q?a=1&b=2&c&copy=3"), ("http://h.com/a", "go?u=http://x.net/", "h.com/go?u=http://x.net/"),
        ("http://h.com/a", "//i.com/z", "i.com/z"), ("http://h.com/a", "HTTPS://i.com/z", "i.com/z"), ("http://h.com/a", "mailto:x@i.com", None), ("http://h.com/a?q", "#top", None),
    ]
    for k, (url, target, want) in enumerate(cases):
        cases[k] = (url, link(target), want)
    df = spark.createDataFrame([(u.replace("h.com", f"h{k}.com"), h) for k, (u, h, _) in enumerate(cases)], "url string, html string")
    got = {r.a.split("/")[0]: r.b for r in U.alias_edges(df, "url", "html").collect()}
    assert got == {f"h{k}.com": w.replace("h.com", f"h{k}.com") for k, (_, _, w) in enumerate(cases) if w}
    rows = [(1, "http://a.com/x/y", link("one") + link("../two")), (2, "http://a.com/two", '<meta http-equiv=refresh content="0;url=three"><meta http-equiv=refresh content="0;url=http://k.net/">')]
    assert [r[4:] for r in verdicts(spark, rows)] == [("block", "alias")] * 2
