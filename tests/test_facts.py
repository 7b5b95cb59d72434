from pyspark.sql import functions as F

from auditlake.functions import html as H
from auditlake.operators import facts, keywords, rules
from helpers import fetch, fetches, one, values

PAGE = """<!doctype html><html><head><title> Un   t&iacute;tulo &amp; m&#225;s </title>
<META CONTENT='Una descripción' NAME="Description"><link href="/canon" rel="canonical"><meta name=robots content=noindex>
<link rel="alternate" hreflang="es" href="/es/"><script type="application/ld+json">{"@context":"x","@type":["Article","NewsArticle"]}</script>
<script>var a = "<h1>no</h1>";</script><style>h1{}</style></head>
<body><!-- <h1>tampoco</h1> --><h1>Hola <b>mundo</b></h1><h2>Uno</h2><h2>Dos</h2>
<a href="/interno" rel="nofollow">Int</a><a href="https://otro.org/">Ext</a><a href="javascript:x()">js</a><a href="#f">f</a><a href="">vacio</a>
<img src="a.png"><img src="a.png" alt="x"><img src="data:image/png;base64,x" alt=""><noscript>oculto <a href="/n">n</a></noscript> fin final</body></html>"""


def test_facts_of_a_page(spark):
    row = facts.page_facts(fetches(spark, [fetch(1, "https://example.com/a/b", PAGE)]), keep_text=True).collect()[0]
    assert row.title == "Un   título & más"
    assert row.meta_description == "Una descripción" and row.meta_robots == "noindex"
    assert row.canonical == "https://example.com/canon"
    assert [tuple(h) for h in row.hreflang] == [("es", "https://example.com/es/")]
    assert row.json_ld_types == ["Article", "NewsArticle"]
    assert row.h1 == ["Holamundo"] and row.h2 == ["Uno", "Dos"]
    assert [l.target for l in row.outlinks] == ["https://example.com/interno", "https://otro.org/"]
    assert row.images_without_alt == 2 and row.image_srcs == ["https://example.com/a/a.png"]
    assert row.empty_anchors == 1
    assert row.text.endswith("fin final") and "oculto" not in row.text and "no</h1>" not in row.text
    assert row.text.startswith("Un   título & más Hola mundo Uno")
    assert row.word_count == len(row.text.split())
    links = facts.page_links(facts.page_facts(fetches(spark, [fetch(1, "https://example.com/a/b", PAGE)])))
    assert values(links.orderBy("link_pos"), "is_internal") == [(True,), (False,)]


def test_only_html_with_status_200_is_parsed(spark):
    rows = facts.page_facts(fetches(spark, [fetch(1, "https://e.com/", PAGE, status=404)])).collect()
    assert rows[0].title == "" and rows[0].outlinks == [] and rows[0].content_hash == ""


def test_json_ld_graph_and_bad_json(spark):
    html = ('<script type="application/ld+json">{"@graph":[{"@type":"WebSite"},{"@type":["x"]},{"@type":"Person"}]}</script>'
            '<script type="application/ld+json">{oops</script><script type="application/ld+json">[{"@type":"A"},3]</script>')
    assert one(spark, H.json_ld_types, html) == ["WebSite", "Person", "A"]


def test_soft_404(spark):
    flag = lambda s, t, x, w: one(spark, H.soft_404, s, t, x, w)
    assert flag(200, "Página no encontrada", "x", 500)
    assert flag(200, "Tienda", "PAGE NOT FOUND", 10)
    assert not flag(200, "Tienda", "page not found", 500)
    assert not flag(404, "Page not found", "", 3)


def test_redirect_and_tech_detection(spark):
    assert one(spark, H.meta_refresh_target, '<meta http-equiv="refresh" content="0; url=https://x.com/n">') == "https://x.com/n"
    assert one(spark, H.js_redirect, "<script>window.location.href = 'x'</script>")
    html = '<link href="/wp-content/x.css"><meta name="generator" content="WordPress 6.4">'
    found = facts.page_facts(fetches(spark, [fetch(1, "https://e.com/", html, headers={"Server": "nginx", "CF-RAY": "1"})])).collect()[0].tech
    assert found == ["WordPress", "Cloudflare", "Nginx", "WordPress 6.4"]


def codes(spark, rows, **extra):
    pages = facts.page_facts(fetches(spark, rows))
    for name, column in extra.items():
        pages = pages.withColumn(name, column)
    return [{i.code for i in r.issues} for r in rules.collect_page_issues(pages).orderBy("page_id").collect()]


def test_page_rules(spark):
    good = f"<title>{'t' * 30}</title><meta name='description' content='{'d' * 80}'><h1>a</h1><h2>b</h2>" + "palabra " * 200
    hop = lambda u, s: (u, s)
    got = codes(spark, [
        fetch(1, "https://example.com/buena", good),
        fetch(2, "https://example.com/Mala_1//x", "<h1>a</h1><h1>b</h1>"),
        fetch(3, "https://example.com/c", status=None, final_url="", error="Name or service not known"),
        fetch(4, "https://example.com/d", status=503),
        fetch(5, "https://example.com/e", good, chain=[hop("a", 301), hop("b", 302), hop("a", 301)]),
        fetch(6, "https://example.com/f", good.replace("<h1>", "<link rel=canonical href=/otra><h1>"), x_robots_tag="NoIndex, nofollow"),
    ])
    assert got[0] == set()
    assert got[1] == {"url_uppercase", "url_underscore", "url_multi_slash", "url_numeric_or_special", "title_missing", "meta_description_missing", "h1_multiple", "h2_missing", "thin_content"}
    assert got[2] == {"dns_not_found"}
    assert got[3] == {"error_5xx"}
    assert got[4] == {"temporary_redirect_should_be_permanent", "redirect_chain_too_long", "redirect_loop"}
    assert got[5] == {"noindex", "nofollow_page", "canonical_points_elsewhere"}


def test_blocked_pages_carry_one_finding_and_users_can_add_rules(spark):
    blocked = codes(spark, [fetch(1, "https://e.com/A", "")], is_blocked=F.lit(True))
    assert blocked == [{"blocked_by_robots"}]
    mine = rules.Rule("tech", "info", "slow_page", rules.sql("fetch_ms > 0.5"), rules.say("lenta"))
    pages = rules.collect_page_issues(facts.page_facts(fetches(spark, [fetch(1, "https://e.com/a", "")])), [mine])
    assert "slow_page" in {i.code for i in pages.collect()[0].issues}


def test_catalogue_is_complete():
    from auditlake.operators.advice import ADVICE

    known = {a[0] for a in ADVICE}
    assert {r.code for r in rules.PAGE_RULES if isinstance(r.code, str)} <= known
    assert all(r.category in rules.CATEGORIES for r in rules.PAGE_RULES)


def _keywords(title, h1, description, body, top_n=5):
    """Plain-Python restatement of the score, for comparison."""
    import re
    import unicodedata
    from collections import Counter

    from auditlake.functions.text import STOPWORDS

    plain = lambda w: "".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn")
    counts = Counter()
    for text, w in [(title, 4), *[(h, 3) for h in h1], (description, 2), (body[:4000], 1)]:
        words = [x for x in re.findall("[a-záéíóúüñàèìòù0-9]{3,}", text.lower()) if x not in STOPWORDS and plain(x) not in STOPWORDS and not x.isdigit()]
        counts.update({}) or [counts.update({x: w}) for x in words]
        [counts.update({f"{a} {b}": w + 1}) for a, b in zip(words, words[1:])]
    chosen = []
    for term in [t for t, _ in counts.most_common(top_n * 3)]:
        if " " in term or not any(term in c.split() for c in chosen if " " in c):
            chosen.append(term)
        if len(chosen) == top_n:
            break
    return chosen


def test_keywords_agree_with_a_plain_restatement(spark):
    pages = [
        (1, "Zapatos rojos baratos", ["Zapatos rojos"], "Compra zapatos rojos online", "zapatos rojos para correr y más zapatos azules " * 300),
        (2, "", [], "", ""),
        (3, "123 456", ["Ñandú veloz", "veloz Ñandú"], "el ñandú", "Ñandú veloz corre veloz. " * 5),
        (4, "uno dos tres cuatro cinco seis siete", [], "", "alfa beta alfa beta gamma"),
    ]
    df = spark.createDataFrame(pages, "page_id long, title string, h1 array<string>, meta_description string, text string")
    got = {r.page_id: r.keywords for r in keywords.top_keywords(df).collect()}
    assert got == {p[0]: _keywords(*p[1:]) for p in pages}
    whole = keywords.scored_terms(df.where("page_id = 1"), body_chars=None).collect()[0].scored
    assert max(t.score for t in whole if t.term == "zapatos") > 600


def test_site_keywords_fall_back_to_the_home_page(spark):
    rows = [("a", 1, 1, "x", [], "", []), ("a", 2, 0, "Cafetera italiana", [], "", []), ("b", 3, 0, "t", [], "", ["té verde", "té"]), ("b", 4, 1, "t", [], "", ["té"])]
    df = spark.createDataFrame(rows, "site string, page_id long, depth int, title string, h1 array<string>, meta_description string, keywords array<string>")
    got = {(r.site, r["rank"]): r.keyword for r in keywords.site_keywords(df).collect()}
    assert got[("a", 1)] == "cafetera italiana" and got[("b", 1)] == "té" and got[("b", 2)] == "té verde"
