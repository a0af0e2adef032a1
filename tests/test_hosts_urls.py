"""Literal cases for hosts and URLs."""

import pytest
from pyspark.sql import functions as F

from threatloom.functions import hosts as HO
from threatloom.functions import urls as U
from threatloom.functions.hosts import host_dimension
from threatloom.operators import links


def host_rows(spark, hosts):
    df = host_dimension(spark.createDataFrame([(h,) for h in hosts], "host string"))
    return {r["host"]: r for r in df.collect()}


LOOKALIKES = [
    ("micr0soft.com", "Microsoft", "character_substitution"), ("paypa1.com", "PayPal", "character_substitution"),
    ("arnazon.com", "Amazon", "character_substitution"), ("g00gle.com", "Google", "character_substitution"),
    ("gooogle.com", "Google", "typosquat"), ("paypal-resolution-center.xyz", "PayPal", "brand_embedded"),
    ("paypal.com.secure-login.top", "PayPal", "brand_in_subdomain"),
    ("login.micr0soft-accountprotection.com", "Microsoft", "character_substitution"),
    ("xn--microsft-sbh.com", "Microsoft", "homoglyph"),
]
INNOCENT = ["www.paypal.com", "accounts.google.com", "github.com", "amazon.in", "purchase-orders.com", "zoominfo.com", "example.org"]


def test_lookalikes(spark):
    rows = host_rows(spark, [h for h, _, _ in LOOKALIKES] + INNOCENT)
    for host, brand, technique in LOOKALIKES:
        assert (rows[host]["lookalike"]["brand"], rows[host]["lookalike"]["technique"]) == (brand, technique), host
    for host in INNOCENT:
        assert rows[host]["lookalike"] is None, host


def test_homoglyphs(spark):
    rows = host_rows(spark, ["xn--microsft-sbh.com", "xn--e1afmkfd.xn--p1ai", "example.com"])
    assert rows["xn--microsft-sbh.com"]["mixed_script"] and rows["xn--microsft-sbh.com"]["idn_skeleton"] == "microsoft.com"
    assert not rows["xn--e1afmkfd.xn--p1ai"]["mixed_script"] and rows["xn--e1afmkfd.xn--p1ai"]["is_idn"]
    assert not rows["example.com"]["is_idn"]


def test_registrable_and_suffix(spark):
    df = spark.createDataFrame([("a.b.example.co.uk", "example.co.uk"), ("example.com", "example.com"), ("co.uk", "co.uk"),
                                ("10.0.0.1", "10.0.0.1"), ("x.y.foo.ck", "y.foo.ck"), ("a.www.ck", "www.ck"),
                                ("deep.a.example.org", "example.org")], "h string, want string")
    for r in df.selectExpr("h", "want", f"{HO.registrable('h')} AS got").collect():
        assert r["got"] == r["want"], r


def test_skeleton(spark):
    df = spark.createDataFrame([("рaypa1", "paypal"), ("rnicrosoft", "microsoft")], "x string, want string")
    for r in df.selectExpr("want", f"{HO.substitute(HO.latin_skeleton('x'))} AS got").collect():
        assert r["got"] == r["want"]


def test_private_addresses(spark):
    cases = [("10.1.2.3", True), ("172.16.0.1", True), ("172.32.0.1", False), ("192.168.1.1", True), ("169.254.0.1", True),
             ("8.8.8.8", False), ("::1", True), ("fe80::1", True), ("2001:db8::1", False), ("127.0.0.1", True)]
    df = spark.createDataFrame(cases, "ip string, want boolean")
    for r in df.selectExpr("ip", "want", f"{HO.is_private_ip('ip')} AS got").collect():
        assert r["got"] == r["want"], r


def ids_of(spark, cases):
    rows = [(i, 0, "anchor" if a else "text", u, a) for i, (u, a) in enumerate(cases)]
    df = spark.createDataFrame(rows, "msg_id long, pos int, source string, url string, anchor_text string")
    got = links.analyse(df).select("msg_id", "host", F.expr("transform(indicators, i -> i.id)").alias("ids")).collect()
    return {cases[r["msg_id"]][0]: (r["host"], r["ids"]) for r in got}


@pytest.mark.parametrize("url,anchor,want", [
    ("https://google.com@evil.example/login", None, "userinfo"), ("http://203.0.113.5/a", None, "ip_host"),
    ("http://3232235777/x", None, "obfuscated_ip"), ("http://0x7f000001/x", None, "obfuscated_ip"),
    ("http://0300.0250.1.1/x", None, "obfuscated_ip"), ("https://bit.ly/abc", None, "shortener"),
    ("https://pay-now.top/x", None, "suspicious_tld"),
    ("https://www.google.com/url?q=x&url=https://evil.example/p", None, "redirect"),
    ("https://cdn.example.net/files/invoice.exe", None, "download"), ("javascript:alert(1)", "x", "dangerous_scheme"),
    ("https://evil.example/login", "https://account.microsoft.com/security", "anchor_mismatch"),
    ("https://login.secure-example.top/verify", None, "credential_path"), ("https://example.com:8443/", None, "port"),
    ("https://a.b.c.d.example.com/", None, "deep_subdomains"), ("https://example.com/" + "a" * 200, None, "long_url"),
    ("https://xn--microsft-sbh.com/", None, "idn"), ("www.paypa1.com/x", None, "lookalike")])
def test_indicator(spark, url, anchor, want):
    assert want in ids_of(spark, [(url, anchor)])[url][1]


def test_not_indicated(spark):
    got = ids_of(spark, [("https://github.com/settings", "github.com/settings"), ("https://github.com/password_reset/abc", None)])
    assert "anchor_mismatch" not in got["https://github.com/settings"][1]
    assert "credential_path" not in got["https://github.com/password_reset/abc"][1]


def test_hosts_as_a_browser_reads_them(spark):
    got = ids_of(spark, [("https://google.com@evil.example/login", None), ("http://3232235777/x", None), ("http://0x7f000001/", None),
                         ("http://0300.0250.1.1/x", None), ("http://10.1/x", None), ("http://por%74al.co.uk/", None)])
    assert [h for h, _ in got.values()] == ["evil.example", "192.168.1.1", "127.0.0.1", "192.168.1.1", "10.0.0.1", "portal.co.uk"]


def test_malformed_urls_are_dropped(spark):
    assert ids_of(spark, [("http://[::1", None), ("http://%%%%", None), ("https://", None), ("http://a b/", None),
                          ("http://x%20y.example/", None), ("ftp://example.com/", None)]) == {}


def test_text_links_and_order(spark):
    text = spark.createDataFrame([(1, "See https://example.org/a. Also (https://example.org/a), www.b.example!")], "msg_id long, text string")
    assert [r["url"] for r in U.extract_from_text(text).orderBy("pos").collect()] == ["https://example.org/a", "https://example.org/a", "www.b.example"]
    rows = [(1, 0, "text", "https://example.org/a", None), (1, 0, "anchor", "https://example.org/a", "Example"),
            (1, 0, "form", "https://collect.example.net/post", None), (1, 0, "image", "https://tracker.example.net/p.gif", None),
            (1, 1, "image", "cid:1", None), (1, 1, "anchor", "mailto:x@y.z", None)]
    df = spark.createDataFrame(rows, "msg_id long, pos int, source string, url string, anchor_text string")
    got = links.dedup(df).orderBy("src_rank", "pos").select("source", "url").collect()
    assert [tuple(r) for r in got] == [("anchor", "https://example.org/a"), ("form", "https://collect.example.net/post"),
                                       ("image", "https://tracker.example.net/p.gif")]


def test_skewed_lookup_keeps_every_row(spark):
    from threatloom.operators.joins import lookup
    facts = spark.range(20000).selectExpr("id", "IF(id % 3 = 0, 'hot', concat('k', id % 50)) AS key")
    dim = facts.select("key").distinct().selectExpr("key AS d_key", "length(key) AS n")
    out = lookup(facts, dim, "key", "d_key", ["id"])
    assert out.count() == 20000 and out.where("n IS NULL").count() == 0
