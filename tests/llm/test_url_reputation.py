from threatloom.llm import url_reputation as U


def test_rules_and_parsing(spark):
    urls = {1: "http://WWW.Example.com/en/x", 2: "https://a.example.com/en/", 3: "http://example.com/de", 4: "http://x.net/es/1", 5: "http://x.net/de",
            6: "http://example.com", 7: "no scheme", 8: None, 9: "http://notexample.com/en/", 10: "ftp://h.net/fr/a://b?x#y", 11: "http:///path", 12: "http://net/fr/"}
    pages = spark.createDataFrame([(i, u, "x") for i, u in urls.items()], "page_id long, url string, verdict string")
    none = spark.createDataFrame([], "page_id long, bad int")
    rows = {r["page_id"]: r for r in U.judge(pages, none).collect()}
    got = {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in rows.items()}
    assert got == {1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/", "example.com/en/", "block"),
                   3: ("example.com", "/de", "com/", "allow"), 4: ("x.net", "/es/1", "net/es/", "block"), 5: ("x.net", "/de", None, "allow"),
                   6: ("example.com", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
                   9: ("notexample.com", "/en/", "com/", "allow"), 10: ("h.net", "/fr/a://b", "net/fr/", "block"), 11: ("", "/path", None, "allow"),
                   12: ("net", "/fr/", "net/fr/", "block")}
    assert U.judge(pages.limit(0), none).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    pages = [(i, f"http://bad.one.org/{i}") for i in range(40)] + [(100 + i, f"http://good.two.org/{i}") for i in range(40)]
    pages += [(200, "http://new.one.org/1"), (201, "http://new.two.org/1"), (202, "http://few.two.org/1"), (0, "http://bad.one.org/0")]
    labels = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(202, 1), (0, 0), (None, 1), (77, None)]
    rows = {r["page_id"]: r for r in U.judge(spark.createDataFrame(pages, "page_id long, url string"),
                                            spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert rows[0]["verdict"] == "block" and rows[100]["verdict"] == "allow"
    assert rows[201]["verdict"] == "allow" and rows[200]["bad_mean"] > rows[201]["bad_mean"]
    assert rows[202]["bad_mean"] < 1 and rows[202]["bad_low"] < rows[202]["bad_mean"]
