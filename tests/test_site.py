import urllib.robotparser

from pyspark.sql import functions as F

from auditlake.operators import aggregates as A, duplicates, links, robots, rules, sitemaps
from auditlake.operators.shuffle import BucketedTables, number_within, salted_join
from helpers import values

ROBOTS = {
    "plain": "User-agent: *\nDisallow: /admin/\nAllow: /\n\nSitemap: https://x.com/s.xml\n",
    "named": "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: *\nDisallow: /fr/ # nota\nCrawl-delay: 5\n",
    "all": "User-agent: *\nDisallow: /",
    "lost": "Disallow: /a\nUser-agent: *\n\nDisallow: /b\nUser-agent: SiteAuditBot\nDisallow: /c\nAllow: /\n",
    "empty": "User-agent: *\nDisallow:\n",
    "twice": "User-agent: *\nDisallow: /x\n\nUser-agent: *\nDisallow: /y\n\nUser-agent: audit\nDisallow: /z\nCrawl-delay: 2\nCrawl-delay: 1.5\n",
}
PATHS = ["/", "/admin/x", "/fr/a", "/a", "/b", "/c", "/x", "/y", "/z?q=1", ""]


def test_robots_agree_with_the_standard_parser(spark):
    docs = spark.createDataFrame(list(ROBOTS.items()), "site string, text string")
    pages = spark.createDataFrame([(i, s, f"https://x.com{p}") for i, (s, p) in enumerate((s, p) for s in [*ROBOTS, "none"] for p in PATHS)], "page_id long, site string, url string")
    for agent in ("SiteAuditBot/0.1", "GPTBot", "*"):
        got = {(r.site, r.url): r.is_allowed for r in robots.robots_allowed(pages, docs, agent).collect()}
        for site in ROBOTS:
            parser = urllib.robotparser.RobotFileParser()
            parser.parse(ROBOTS[site].splitlines())
            for p in PATHS:
                assert got[(site, f"https://x.com{p}")] == parser.can_fetch(agent, f"https://x.com{p}"), (agent, site, p)
        assert all(v for (s, _), v in got.items() if s == "none")
        delays = dict(values(robots.crawl_delays(docs, agent), "site", "crawl_delay"))
        for site in ROBOTS:
            parser = urllib.robotparser.RobotFileParser()
            parser.parse(ROBOTS[site].splitlines())
            want = parser.crawl_delay(agent)
            assert delays.get(site) == (float(want) if want is not None else None), (agent, site)
    access = robots.bot_access(docs.select("site"), docs)
    assert {r.bot for r in access.where("site = 'named' AND NOT allowed").collect()} == {"GPTBot", "CCBot"}


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = lambda *c: f"<?xml version='1.0'?><sitemapindex {ns}>" + "".join(f"<sitemap><loc> {x} </loc></sitemap>" for x in c) + "</sitemapindex>"
    urlset = lambda *c: f"<urlset {ns}>" + "".join(f"<url><loc>{x}</loc><lastmod>1</lastmod></url>" for x in c) + "</urlset>"
    docs = spark.createDataFrame([
        ("a", "i", 200, index("s1", "i", "s2", "gone")), ("a", "s1", 200, urlset("u1", "u2&amp;x")), ("a", "s2", 200, urlset("u3")), ("a", "bad", 200, "<urlset><url>"),
        ("a", "other", 200, "<feed><x/></feed>"), ("b", "s", 200, urlset(*[f"u{i}" for i in range(5)])),
    ], "site string, sitemap_url string, status int, xml string")
    parsed = sitemaps.parse_sitemaps(docs)
    errors = dict(values(parsed, "sitemap_url", "parse_error"))
    assert errors["bad"] != "" and "feed" in errors["other"] and errors["s1"] == ""
    starts = spark.createDataFrame([("a", 0, "i"), ("b", 0, "s")], "site string, pos int, sitemap_url string")
    visited = sitemaps.expand_sitemaps(parsed, starts)
    assert sorted(values(visited.where("site = 'a'"), "visit_no", "sitemap_url")) == [(1, "i"), (2, "s1"), (3, "s2"), (4, "gone")]
    got = sitemaps.sitemap_urls(parsed, visited).where("site = 'a'").orderBy("visit_no", "loc_pos")
    assert [r.loc for r in got.collect()] == ["u1", "u2&x", "u3"]
    few = sitemaps.expand_sitemaps(parsed, starts, max_documents=2)
    assert few.where("site = 'a'").count() == 2


def test_bfs_matches_a_queue(spark):
    edges = [("a", f"n{i}", f"n{(i * k + 1) % 40}", k) for i in range(40) for k in range(1, 4)]

    def crawl(max_depth, max_pages=None):
        frontier, seen, fetched, depths = [("n0", 0)], {"n0"}, [], {"n0": 0}
        while frontier:
            node, depth = frontier.pop(0)
            if depth > max_depth or (max_pages and len(fetched) >= max_pages):
                continue
            fetched.append(node)
            for d in [e[2] for e in sorted((e for e in edges if e[1] == node), key=lambda e: e[3])]:
                if d not in seen:
                    seen.add(d)
                    depths[d] = depth + 1
                    frontier.append((d, depth + 1))
        return fetched, depths

    table = spark.createDataFrame(edges, "site string, src string, dst string, link_pos int")
    seed = spark.createDataFrame([("a", "n0", 0, 0)], "site string, node string, depth int, pos int")
    for max_depth in (1, 2, 6):
        fetched, depths = crawl(max_depth)
        got = links.bfs(table, seed, max_depth)
        assert {r.node: r.depth for r in got.collect()} == depths
        assert {r.node for r in got.where("fetched").collect()} == set(fetched)
    assert {r.node for r in links.bfs(table, seed, 6, max_pages=9).collect()} == set(crawl(6, 9)[0])


def test_a_round_moves_the_frontier_only(spark):
    tables, keys = BucketedTables(spark, "round"), ["site", "node"]
    edges = spark.createDataFrame([("a", f"n{i}", f"n{i * k % 50}", k) for i in range(50) for k in range(3)] + [("a", "hub", f"n{i}", i) for i in range(400)], "site string, node string, dst string, link_pos int")
    hubs = spark.createDataFrame([("a", "hub", True)], "site string, node string, _hub boolean")
    stored = tables.put(links.salted_edges(edges, hubs, keys), [*keys, "_salt"])
    settled = [tables.put(spark.createDataFrame([("a", f"n{i}")], "site string, node string"), keys) for i in (1, 2)]
    level = tables.put(spark.createDataFrame([("a", "hub", 3, [0]), ("a", "n7", 3, [1])], "site string, node string, depth int, place array<long>"), keys)
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = links.expanded(stored, level, hubs, settled, keys)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r["node"]: r["depth"] for r in out.collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert plan.count("Exchange hashpartitioning") == 2, plan  # the open nodes, and what they reach
    assert plan.count("Bucketed: true") >= 3, plan
    assert got == {f"n{i}": 4 for i in range(400) if i not in (1, 2)}
    tables.drop()


def test_bfs_of_a_long_chain_leaves_no_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    chain = spark.createDataFrame([("a", f"n{i}", f"n{i + 1}", 0) for i in range(14)], "site string, src string, dst string, link_pos int")
    seed = spark.createDataFrame([("a", "n0", 0, 0)], "site string, node string, depth int, pos int")
    visited = spark.createDataFrame([("a", "n12")], "site string, node string")
    assert {r["node"]: r["depth"] for r in links.bfs(chain, seed, 50, visited=visited).collect()} == {f"n{i}": i for i in range(12)}
    assert {t.name for t in spark.catalog.listTables()} == before


def test_redirect_chains(spark):
    hops = [("a", 301, "b"), ("b", 302, "c"), ("l1", 301, "l2"), ("l2", 301, "l1")] + [(f"s{i}", 301, f"s{i + 1}") for i in range(12)]
    table = spark.createDataFrame(hops, "from_url string, status int, to_url string")
    starts = spark.createDataFrame([("a",), ("z",), ("l1",), ("s0",), ("s3",)], "from_url string")

    def walk(u):
        step = {f: (s, t) for f, s, t in hops}
        chain = []
        for _ in range(10):
            if u not in step:
                return chain, u, False
            chain.append((u, step[u][0]))
            u = step[u][1]
        return chain, None, True

    for r in links.redirect_chains(starts, table).collect():
        assert ([(h.url, h.status) for h in r.chain], r.final_url, r.too_many) == walk(r.start_url)
        assert r.has_loop == (len({h.url for h in r.chain}) < len(r.chain))


def test_skewed_join_and_numbering_give_plain_results(spark):
    # one key holds most rows
    big = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"))
    small = big.groupBy("k").agg(F.count("*").alias("n")).where("n <> 10")
    plain = big.join(small, "k", "left").select("id", "k", "n")
    salted = salted_join(big, small, ["k"], F.col("id")).select("id", "k", "n")
    assert salted.count() == 5000 and salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()
    inner = salted_join(big, small, ["k"], F.col("id"), "inner")
    assert inner.count() == big.join(small, "k").count()
    numbered = number_within(big, "k", ["id"], F.floor(F.col("id") / 100))
    hot = [r.rn for r in numbered.where("k = 'hot'").orderBy("id").collect()]
    assert hot == list(range(1, len(hot) + 1))


def test_duplicates(spark):
    rows = [(1, "s", "/a", 200, "h1", "t", "d"), (2, "s", "/b", 200, "h1", "t", ""), (3, "s", "/c", 200, "h2", "t", ""), (4, "s", "/d", 404, "h1", "t", "d"), (5, "o", "/e", 200, "h1", "x", "d")]
    df = spark.createDataFrame(rows, "page_id long, site string, url string, status int, content_hash string, title string, meta_description string")
    got = {r.page_id: (r.same_content, r.same_title, r.same_meta) for r in duplicates.with_duplicate_counts(df).collect()}
    assert got == {1: (2, 3, 1), 2: (2, 3, 1), 3: (1, 3, 1), 4: (1, 1, 1), 5: (1, 1, 1)}
    members = duplicates.duplicate_groups(df, "content_hash")
    assert sorted(values(members, "url", "group_size")) == [("/a", 2), ("/b", 2)]


PAGES = "page_id long, site string, url string, status int, is_priority boolean, is_orphan boolean, error string, fetch_ms double, issues array<struct<category:string,severity:string,code:string,message:string>>"


def _page(i, *codes, status=200, site="s", priority=False, orphan=False, error=""):
    return (i, site, f"/{i}", status, priority, orphan, error, 1.0, [(c, s, k, "") for c, s, k in codes])


def test_site_aggregates(spark):
    bad, warn, info = ("titles", "critical", "title_missing"), ("meta", "warning", "h1_missing"), ("meta", "info", "h2_missing")
    df = spark.createDataFrame([
        _page(1, bad, warn), _page(2, warn, warn), _page(3, status=None, error="boom"), _page(4, ("sitemap_robots", "info", "blocked_by_robots"), status=None),
        _page(5, info, orphan=True), _page(6, ("response_codes", "critical", "error_404"), status=404), _page(7, site="clean"), _page(8, site="down", status=None),
    ], PAGES)
    scores = dict(values(A.health_score(A.page_states(df)), "site", "score"))
    # (13 + 6 + 1 + 10) / 4 pages with a response, times 6
    assert scores == {"s": 55, "clean": 100, "down": 100}
    budget = A.crawl_budget(A.page_states(df)).where("site = 's'").collect()[0]
    assert (budget.total_pages, budget.blocked_by_robots, budget.error_pages, budget.ok_pages, budget.orphan_pages) == (6, 1, 2, 3, 1)
    issues = rules.issue_rows(df)
    ranked = A.opportunities(A.code_states(df)).where("site = 's'").orderBy("rank").collect()
    assert [(o.code, o.affected_pages) for o in ranked] == [("title_missing", 1), ("error_404", 1), ("h1_missing", 2), ("blocked_by_robots", 1), ("h2_missing", 1)]
    failed = A.error_pages(df.where("site = 's'")).collect()
    assert [(r.page_id, r.label) for r in failed] == [(6, "HTTP 404"), (3, "boom")]
    assert [r.page_id for r in A.top_offenders(df, 2).where("site = 's'").orderBy("rank").collect()] == [1, 6]
    listing = A.truncated(issues, ["site", "code"], ["page_id", "issue_seq"], 1).where("code = 'h1_missing'").collect()[0]
    assert (listing.group_rows, listing.overflow) == (3, 2)
    side = A.sidebar_counts(df).where("site = 's'").collect()[0]
    assert (side.all_pages, side.with_issues, side.meta_warning) == (6, 5, 3)


def test_budget_classes_cover_every_page(spark):
    df = spark.createDataFrame([_page(i, status=[200, 301, 404, 500, None][i % 5]) for i in range(50)], PAGES)
    b = A.crawl_budget(A.page_states(df)).collect()[0]
    assert b.blocked_by_robots + b.error_pages + b.ok_pages == b.total_pages == 50


def test_orphans_within_limits_and_without_seeds(spark):
    listed = spark.createDataFrame([("a.com", 1, i, f"https://a.com/{p}") for i, p in enumerate(["", "x", "y#f", "long-address-of-a-page", "z?q=1"])] + [("a.com", 1, 9, "https://b.com/x")], "site string, visit_no int, loc_pos int, loc string")
    reached = spark.createDataFrame([("a.com", "https://a.com/x")], "site string, url string")
    seeds = spark.createDataFrame([("a.com", "https://a.com/")], "site string, url string")
    urls = lambda **k: sorted(r["url"] for r in links.orphan_candidates(listed, reached, **k).collect())
    assert urls() == ["https://a.com/", "https://a.com/long-address-of-a-page", "https://a.com/y", "https://a.com/z?q=1"]
    assert urls(seeds=seeds, max_length=20, exclude_patterns=(r"\?", "(", "(?P<n>x)")) == ["https://a.com/y"]
    assert urls(seeds=seeds, budget=1) == ["https://a.com/y"]
    assert links._compiles("(?<n>x)") and not links._compiles("(?P<n>x)") and not links._compiles("[")
