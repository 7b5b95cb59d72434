"""Nothing is cut by default; entities, accents, suffixes and bad patterns by literal cases."""

import pytest
from pyspark.sql import functions as F

from auditlake.functions import html as H, text as X, urls as U
from auditlake.operators import broken_assets, keywords, links, shuffle, sitemaps
from helpers import one


@pytest.mark.parametrize(("raw", "want"), [
    ("&#x27;a&#39;", "'a'"), ("&rsquo;&Ntilde;&ntilde;", "’Ññ"), ("&amp;lt;", "&lt;"), ("&nope; & &;", "&nope; & &;"), ("&#150;&#x80;", "–€"),
    ("&#xD800;&#0;&#9999999;", "���"), ("&#128512;&semi;&equals;", "😀;="), ("plain", "plain"), ("&CounterClockwiseContourIntegral;", "∳"),
])
def test_entities(spark, raw, want):
    assert one(spark, H.decode_entities, raw) == want


def test_json_ld_inside_a_comment_is_no_json_ld(spark):
    block = '<script type="application/ld+json">{"@type":"A"}</script>'
    assert one(spark, H.json_ld_types, f"<!-- {block} --><p>{block.replace('A', 'B')}") == ["B"]


def test_accents_and_suffixes(spark):
    assert one(spark, X.fold, "Gdańsk Şişli Ťok Ñandú Ơ é") == "gdansk sisli tok nandu o e"
    for url, want in [("https://a.shop.co.ke/", "shop.co.ke"), ("http://x.foo.com.vn", "foo.com.vn"), ("http://www.example.de", "example.de"), ("http://co.uk", "co.uk"), ("http://a.b.gouv.fr", "b.gouv.fr")]:
        assert one(spark, U.registrable_domain, url) == want


def test_a_pattern_that_is_no_expression_excludes_nothing(spark):
    assert one(spark, lambda u: links.url_allowed(u, exclude_patterns=("[bad", "/private/")), "http://a/x") is True
    assert one(spark, lambda u: links.url_allowed(u, exclude_patterns=("[bad", "/private/")), "http://a/private/x") is False


def test_all_files_of_a_large_sitemap_index(spark):
    children = [f"https://s/sitemap-{i}.xml" for i in range(30)]
    files = [("s", "https://s/index.xml", True, "", children)] + [("s", c, False, "", [f"{c}/p"]) for c in children]
    parsed = spark.createDataFrame(files, "site string, sitemap_url string, is_index boolean, parse_error string, locs array<string>")
    starts = spark.createDataFrame([("s", 0, "https://s/index.xml")], "site string, pos int, sitemap_url string")
    visited = sitemaps.expand_sitemaps(parsed, starts)
    assert visited.count() == 31 and sorted(r["visit_no"] for r in visited.collect()) == list(range(1, 32))
    assert sitemaps.sitemap_urls(parsed, visited).count() == 30
    assert sitemaps.expand_sitemaps(parsed, starts, max_documents=20).count() == 20


def test_all_images_and_the_whole_text(spark):
    sources = [f"http://a/{i}.png" for i in range(40)]
    pages = spark.createDataFrame([(1, sources)], "page_id long, image_srcs array<string>")
    assets = spark.createDataFrame([(s, 404) for s in sources], "src string, status int")
    assert broken_assets.broken_images(pages, assets).first()["broken_images"] == sources
    assert broken_assets.broken_images(pages, assets, per_page=25).first()["broken_images"] == sources[:25]
    page = spark.createDataFrame([("t", ["h"], "d", "filler " * 1500 + "zebra " * 5000)], "title string, h1 array<string>, meta_description string, text string")
    assert "zebra zebra" in keywords.top_keywords(page).first()["keywords"]
    assert one(spark, lambda t: H.soft_404(F.lit(200), F.lit(""), t, F.lit(10)), "x" * 10_000 + " page not found") is True


def test_a_key_of_a_third_of_a_percent_is_split_when_partitions_are_many(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.range(3000).select(F.when(F.col("id") < 10, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        assert [r["k"] for r in shuffle.heavy_keys(rows, ["k"]).collect()] == [-1]
        joined = shuffle.salted_join(rows, spark.createDataFrame([(-1, "x")], "k long, w string"), ["k"], F.col("v"), "inner")
        assert joined.count() == 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_unknown_codes_keep_their_own_message_and_known_ones_all_steps(spark):
    from auditlake.operators.advice import ADVICE, DEFAULT_STEP, with_advice

    code, title, _, steps = next(a for a in ADVICE if len(a[3]) > 1)
    rows = spark.createDataFrame([(code, "m1"), ("own_code", "m2")], "code string, message string")
    out = {r["code"]: r for r in with_advice(rows, "message").collect()}
    assert out[code]["title"] == title and out[code]["fix_plan"] == "\n".join(steps) and out[code]["fix_step"] == steps[0]
    assert out["own_code"]["title"] == "m2" and out["own_code"]["fix_plan"] == DEFAULT_STEP
