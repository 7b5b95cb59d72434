from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from auditlake.functions import domains, urls as U
from auditlake.operators.links import url_allowed
from helpers import one, values

BASES = ["https://example.com/a/b/c.html?x=1", "https://example.com", "http://www.example.com/a/", "https://example.com/a//b/"]
HREFS = [
    "", "x", "/x", "./x", "../x", "../../x", "../../../../x", "x/../y", "/a/../b", "/a/./b", "..", ".", "a/..", "?q=1", "?", "#top", "x#f", "//cdn.example.com/y",
    "https://other.org/z?k#v", "mailto:a@b.c", "a b/ü,c", "/a//b", "a//b", "x?y=../z", "/", "/x/.", "/x/..",
]


def test_resolution_agrees_with_the_standard_library(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(rows, "base string, href string").select("base", "href", U.resolve(F.col("href"), F.col("base")).alias("got"))
    wrong = [(r.base, r.href, r.got, urldefrag(urljoin(r.base, r.href))[0]) for r in df.collect() if r.got != urldefrag(urljoin(r.base, r.href))[0]]
    assert wrong == []


def test_parts_and_variants(spark):
    url = "https://WWW.Example.com/Foo_Bar//baz;p?a=1&a=2&b=&c=3#f"
    assert one(spark, U.host, url) == "www.example.com"
    assert one(spark, U.path, url) == "/Foo_Bar//baz"
    assert one(spark, U.query_param_count, url) == 2
    assert one(spark, lambda u: U.is_same_site(u, F.lit("http://example.com/")), url)
    assert not one(spark, lambda u: U.is_same_site(u, F.lit("http://sub.example.com/")), url)
    assert one(spark, lambda u: U.is_same_site(u, F.lit("http://sub.example.com/"), True), url)
    flags = spark.range(1).select(*[c.alias(n) for n, c in U.convention_flags(F.lit(url)).items()]).collect()[0]
    assert all(flags[n] for n in ("url_uppercase", "url_underscore", "url_multi_slash"))
    assert one(spark, U.toggle_trailing_slash, "https://a.com/x?y") == "https://a.com/x/?y"
    assert one(spark, U.toggle_trailing_slash, "https://a.com/x/") == "https://a.com/x"
    assert one(spark, U.toggle_trailing_slash, "https://a.com") == "https://a.com/"
    assert one(spark, lambda u: U.swap_www(u, True), "http://a.com/") == "http://www.a.com/"
    assert one(spark, U.start_folder, "https://x.com/blog/post") == "/blog/"


DOMAINS = {
    "https://a.b.example.co.uk/x": "example.co.uk", "http://example.com:8080/": "example.com", "http://10.0.0.1/": "10.0.0.1", "http://localhost/": "localhost",
    "https://www.city.kawasaki.jp/": "city.kawasaki.jp", "https://a.b.kawasaki.jp/": "a.b.kawasaki.jp", "https://x.a.b.kawasaki.jp/": "a.b.kawasaki.jp", "http://kawasaki.jp": "kawasaki.jp",
    "https://www.school.k12.ca.us/x": "school.k12.ca.us", "http://town.ca.us/": "town.ca.us", "http://k12.ca.us/": "k12.ca.us",
    "http://www.ck/": "www.ck", "http://a.www.ck/": "www.ck", "http://x.y.z.ck/": "y.z.ck", "http://z.ck/": "z.ck", "https://user@Shop.Example.COM.:443/": "example.com", "http://co.uk/": "co.uk", "": "",
}


def test_registrable_domain(spark):
    table = spark.createDataFrame(list(DOMAINS.items()), "url string, want string")
    for url, got, want in values(table.withColumn("got", U.registrable_domain(F.col("url"))), "url", "got", "want"):
        assert got == want, url


def test_suffix_table_as_a_parameter(spark):
    rules = ["// a comment", "com", "uk", "co.uk", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "jp", "us", "ca.us", "k12.ca.us", "", "a.b.c.d.e  trailing words"]
    suffixes = domains.Suffixes.parse(rules)
    table = spark.createDataFrame([*DOMAINS.items(), ("http://w.x.a.b.c.d.e/", "x.a.b.c.d.e")], "url string, want string")
    joined = domains.with_registrable_domain(table.withColumn("got", U.registrable_domain(F.col("url"), suffixes)), U.authority(F.col("url")), spark.createDataFrame([(r.split("  ")[0],) for r in rules], "rule string"))
    for url, got, want, by_join in values(joined, "url", "got", "want", "registrable"):
        assert (got, by_join) == (want, want), url
    with pytest.raises(ValueError, match="too many"):
        domains.Suffixes.parse(f"x{i}.com" for i in range(domains.MOST + 1))


def test_admission_limits(spark):
    allow = lambda url, **k: one(spark, lambda u: url_allowed(u, **k), url)
    assert allow("https://x.com/blog/a", max_length=100, exclude_patterns=("/tag/",), max_query_params=1)
    assert not allow("https://x.com/tag/a", exclude_patterns=("/tag/",))
    assert not allow("https://x.com/a?b=1&c=2", max_query_params=1)
    assert not allow("https://x.com/" + "a" * 90, max_length=50)
    assert not allow("https://x.com/other", start_folder=F.lit("/blog/"))
