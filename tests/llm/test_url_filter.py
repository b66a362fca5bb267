from hardwood.llm.url_filter import judge_urls, keep_allowed


def test_rules_aliases_and_edges(spark):
    canon = '<head><LINK href="https://other.test/b?x" rel=canonical></head>'
    hop = "<meta http-equiv='refresh' content='0; url=http://hop.test/c'>"
    rows = [(1, "http://a.com/en/1", ""), (2, "HTTP://Example.COM/en/7x?q#f", ""), (3, "x://sub.example.com/en/8", None), (4, None, None), (5, "no scheme", ""),
            (6, "http://a.org/es/1", canon), (7, "http://www.other.test/b/", hop), (8, "https://hop.test/c.html#z", ""), (9, "http://com/en/", ""), (10, "http://xcom/en/", ""),
            (11, "http://example.com/en/71", '<link rel="canonical" href="http://late.test/q">'), (12, "http://late.test/q", ""), (13, "http://z.net/de/1", '<link rel="canonical" href="http://late.test/q">'), (8, "http://e.test?x://", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as rule", "2 as node")
    got = {(r.page_id, r.host): r for r in judge_urls(df).collect()}
    v = {k[0]: (r.rule, r.verdict) for k, r in got.items() if k[1] != "e.test"}
    assert v[1] == ("com/en/", "block") and v[2] == ("example.com/en/7", "allow") and v[3] == ("com/en/", "block")
    assert got[(2, "example.com")].path == "/en/7x" and v[4] == v[5] == (None, "allow") and got[(4, "")].path == ""
    assert v[6] == ("org/es/", "block") and v[7] == v[8] == (None, "block")  # through two hops
    assert v[9] == ("com/en/", "block") and v[10] == (None, "allow")
    assert v[12] == (None, "allow") and v[13] == ("net/de/", "block")  # allow first
    assert got[(8, "e.test")].verdict == "allow" and len(got) == len(rows)
    more = spark.createDataFrame([("http://e.test", "http://gone.org/es/x"), (None, "x")], "source string, target string")
    assert {r.verdict for r in judge_urls(df, more).collect() if r.host == "e.test"} == {"block"}
    assert {r.page_id for r in keep_allowed(df).collect()} == {2, 4, 5, 10, 11, 12}
    assert judge_urls(df.where("false")).collect() == []


def test_relative_targets(spark):
    link = lambda t: f'<link rel="canonical" href="{t}">'
    hop = lambda t: f"<meta http-equiv=refresh content='0; url={t}'>"
    bad = "http://a.org/es/"  # blocked; the others take their decision from the page that they name
    rows = [(1, bad + "1", ""), (2, bad + "x", link("/p/1?q")), (3, "http://a.org/p/1", ""), (4, bad + "y", link("//Q.test/b/c")), (5, "https://q.test/b/c.html", ""), (6, bad + "dir/z", link("../../p/./2/")),
            (7, "http://a.org/p/2", ""), (8, "http://r.test/d/e", hop("f?url=g")), (9, "http://r.test/d/f", link("mailto:x@y")), (10, "http://r.test/g", link(" //a.org/es/k")), (11, "http://r.test", link("#top") + hop("g")),
            (12, "http://s.test/u/v", "<base href='//a.org/es/w/'>" + link("x")), (13, "http://s.test/x", ""), (14, "http://t.test/a", link("b?u=http://a.org/es/1")), (15, "http://t.test/b", ""), (16, "no scheme", link("/es/1"))]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k for k, r in got.items() if r.verdict == "block"} == {1, 2, 3, 4, 5, 6, 7, 10, 11, 12}
    same = lambda *k: len({got[x].alias for x in k}) == 1
    assert same(2, 3) and same(4, 5) and same(6, 7) and same(8, 9) and same(10, 11) and same(14, 15) and not same(12, 13) and not same(14, 1)


def test_rules_are_the_contract_s(spark):
    urls = {"com/en/": "http://a.com/en/1", "example.com/en/7": "http://x.example.com/en/70", "net/de/": "http://a.net/de/8", "example.net/de/8": "http://example.net/de/81", "org/es/": "http://a.org/es/"}
    got = judge_urls(spark.createDataFrame(list(enumerate(urls.values())), "page_id long, url string").selectExpr("*", "null as html")).collect()
    assert {r.rule: r.verdict for r in got} == {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
