from opinaria.llm.url_rules import judge, page_links

CANON = '<html><head><link rel="canonical" href="{}"></head>'
REFRESH = "<meta http-equiv='refresh' content='0; url={}'>"
PAGES = [
    (1, "https://Sub.Example.NET/en/1?x#y", ""),                    # allowed by the longer rule
    (2, "http://a.net", ""),                                        # no path: no rule
    (3, "http://a.net/", ""),                                       # blocked
    (4, "https://x.org/de/4", CANON.format("http://A.net/")),       # alias of a blocked page
    (5, "https://x.org/fr/5", CANON.format("https://x.org/de/4")),  # allowed by a rule although its alias is blocked
    (6, "https://y.org/de/6", REFRESH.format("/de/7")),             # relative target
    (7, "https://y.org/de/7", ""),
    (8, "https://y.org/de/7", ""),                                  # repeated url
    (9, None, CANON.format("http://a.net/")),
    (10, "no scheme", None),
    (11, "https://notexample.com/de/", ""),
    (12, "https://z.org/de/12", "<LINK href=//example.com/de/q rel=canonical>"),  # blocked target that is no page
    (13, "https://w.org/x/13", ""),
    (None, "https://w.net/q", "x"),
]
EXPECTED = {1: ("example.net/en/", "allow"), 2: (None, "allow"), 3: ("net/", "block"), 4: (None, "block"), 5: ("org/fr/", "allow"), 6: (None, "allow"),
            7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "allow"), 12: (None, "block"),
            13: (None, "allow"), None: ("net/", "block")}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, verdict string")


def test_rules_and_aliases(spark):
    got = {r.page_id: r for r in judge(frame(spark, PAGES)).collect()}
    assert {k: (r.rule, r.verdict) for k, r in got.items()} == EXPECTED
    assert got[6].component == got[7].component == got[8].component and got[13].component is None
    assert (got[1].host, got[1].path) == ("sub.example.net", "/en/1") and (got[10].host, got[10].path) == ("", "")


def test_redirect_tables_pass_blocks_on(spark):
    redirects = spark.createDataFrame([(f"https://hop.org/{k}", f"https://hop.org/{k + 1}") for k in range(12)] +
                                      [("https://hop.org/12", "https://w.org/x/13"), ("http://bad.net/z", "https://hop.org/0"), (None, "x")],
                                      "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in judge(frame(spark, PAGES), redirects=redirects).collect()}
    assert got == {k: v for k, (_, v) in EXPECTED.items()} | {13: "block"}


def test_links_without_pages_and_empty_tables(spark):
    assert judge(frame(spark, []).limit(0)).collect() == []
    assert page_links(frame(spark, PAGES)).count() == 4
    assert {r.verdict for r in judge(frame(spark, PAGES), rules=[]).collect()} == {"allow"}
