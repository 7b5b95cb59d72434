"""Link-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import urls as U
from auditlake.operators import facts as page_facts, links as L
from auditlake.plans import duck as D, inputs as I
from auditlake.plans.registry import query
from auditlake.sources.tables import table

u = F.col


@query("inlinks", "SELECT f.page_id, e.source AS inlink FROM crawl f JOIN inlink_pairs e ON e.target = f.address")
def inlinks(spark, sf):
    return L.page_inlinks(I.crawled(spark, sf), I.crawl(spark, sf).edges).select("page_id", u("source").alias("inlink"))


@query("link_degree", "SELECT f.page_id, coalesce(c.n, 0) AS inlinks, least(13.0, 5.0 + coalesce(c.n, 0)::double * 1.1::double)::double AS radius FROM crawl f LEFT JOIN (SELECT target, count(*) AS n FROM inlink_pairs GROUP BY 1) c ON c.target = f.address")
def link_degree(spark, sf):
    counted = L.inlink_counts(I.crawled(spark, sf), I.crawl(spark, sf).edges)
    return counted.select("page_id", "inlinks", L.node_radius(u("inlinks")).alias("radius"))


@query("tree_parents", """
SELECT f.page_id, f.url, f.depth, CASE WHEN f.depth > 0 THEN coalesce(b.level_up, CASE WHEN b.first_known THEN b.first END) END AS parent_url FROM crawl f LEFT JOIN (
  SELECT f.page_id, min(CASE WHEN p.depth = f.depth - 1 THEN e.source END) AS level_up, min(e.source) AS first, arg_min(p.depth IS NOT NULL, e.source) AS first_known
  FROM crawl f JOIN inlink_pairs e ON e.target = f.address LEFT JOIN (SELECT url, arg_max(depth, page_id) AS depth FROM crawl GROUP BY url) p ON p.url = e.source GROUP BY f.page_id) b ON b.page_id = f.page_id""")
def tree_parents(spark, sf):
    return L.tree_parents(I.crawled(spark, sf), I.crawl(spark, sf).edges)


def _edges(spark, sf):
    graph = table(spark, sf, "links_graph")
    return graph.select(F.lit("g").alias("site"), "src", "dst", F.regexp_extract("dst", "([0-9]+)", 1).cast("long").alias("link_pos"))


def _seed(spark, sf):
    part = table(spark, sf, "part").where("p_partkey = 1")
    return part.select(F.lit("g").alias("site"), F.lit("/p1").alias("node"), F.lit(0).alias("depth"), F.lit(0).alias("pos"))


_BFS = """
SELECT node, min(depth)::bigint AS depth FROM reach GROUP BY node"""
D.CTES["reach"] = """
SELECT '/p1' AS node, 0 AS depth UNION SELECT g.dst, r.depth + 1 FROM reach r JOIN links_graph g ON g.src = r.node WHERE r.depth < 9
"""


@query("bfs_depth", _BFS)
def bfs_depth(spark, sf):
    return L.bfs(_edges(spark, sf), _seed(spark, sf), max_depth=8).select("node", "depth")


D.CTES["reach2"] = """
SELECT node, 2 AS depth FROM (SELECT node, min(depth) AS d FROM reach GROUP BY node) WHERE d = 2
UNION SELECT g.dst, r.depth + 1 FROM reach2 r JOIN links_graph g ON g.src = r.node WHERE r.depth < 9
"""


@query("bfs_resume", """
SELECT node, min(depth)::bigint AS depth FROM reach2 WHERE node NOT IN (SELECT node FROM reach GROUP BY node HAVING min(depth) < 2) GROUP BY node""")
def bfs_resume(spark, sf):
    """An interrupted crawl: levels 0 and 1 are stored as visited, level 2 as the pending frontier."""
    with L.StoredLinks(_edges(spark, sf)) as links:
        first = L.bfs(links, _seed(spark, sf), max_depth=1)
        pending = first.where("depth = 2").select("site", "node", "depth", F.element_at("place", -1).alias("pos"))
        return L.bfs(links, pending, max_depth=8, visited=first.where("depth < 2")).select("node", "depth")


@query("orphan_pages", "SELECT site, url FROM orphans WHERE length(url) <= 60 AND NOT contains(url, '?')")
def orphan_pages(spark, sf):
    """Listed but never linked and no start address, within the crawl's limits on addresses."""
    admitted = I.discovered(I.crawled(spark, sf)).select(U.site_key(u("target")).alias("site"), u("target").alias("url"))
    return L.orphan_candidates(I.listed(spark, sf), admitted, I.seeds(spark, sf), max_length=60, exclude_patterns=("[?]",)).select("site", "url")


@query("redirect_hops", f"SELECT from_url, status::bigint AS status, {D.resolve('location', 'from_url')} AS to_url FROM redirect_log WHERE status IN (301, 302, 303, 307, 308)")
def redirect_hops(spark, sf):
    return L.redirect_hops(table(spark, sf, "redirect_log"))


D.CTES["hop_rows"] = f"SELECT from_url, min(status) AS status, arg_min(to_url, (status, to_url)) AS to_url FROM (SELECT from_url, status, {D.resolve('location', 'from_url')} AS to_url FROM redirect_log WHERE status IN (301, 302, 303, 307, 308)) GROUP BY from_url"
D.CTES["walk"] = """
SELECT url AS start_url, url AS cur, 0 AS n, []::varchar[] AS chain FROM (SELECT DISTINCT url FROM fetch_rows)
UNION ALL SELECT w.start_url, h.to_url, w.n + 1, list_append(w.chain, w.cur || ' ' || h.status) FROM walk w JOIN hop_rows h ON h.from_url = w.cur WHERE w.n < 10
"""


@query("redirect_chains", """
SELECT start_url, max(n)::bigint AS n_hops, array_to_string(arg_max(chain, n), ' > ') AS chain, CASE WHEN max(n) < 10 THEN arg_max(cur, n) END AS final_url, max(n) = 10 AS too_many, len(list_distinct(arg_max(chain, n))) < max(n) AS has_loop FROM walk GROUP BY start_url""")
def redirect_chains(spark, sf):
    starts = table(spark, sf, "fetch_rows").select(u("url").alias("from_url")).distinct()
    done = L.redirect_chains(starts, L.redirect_hops(table(spark, sf, "redirect_log")))
    shown = F.array_join(F.transform("chain", lambda h: F.concat(h.url, F.lit(" "), h.status.cast("string"))), " > ")
    return done.select("start_url", "n_hops", shown.alias("chain"), "final_url", "too_many", "has_loop")


D.CTES["tree_rows"] = f"""
SELECT root_domain, [{D.host('address')}] || [s FOR s IN string_split({D.path('address')}, '/') IF s <> ''] AS steps, page_id, pos, address FROM (
  SELECT page_id, -1 AS pos, address, {D.domain('url')} AS root_domain FROM crawl UNION ALL SELECT page_id, link_pos, target, {D.domain('source')} FROM crawl_links WHERE is_internal)
WHERE {D.domain('address')} = root_domain AND {D.host('address')} <> ''
"""
D.CTES["tree_all"] = """
SELECT root_domain, array_to_string(steps[1:k], '/') AS node_path, CASE WHEN k = 1 THEN root_domain ELSE array_to_string(steps[1:k - 1], '/') END AS parent_path, k AS depth, steps[k] AS label,
  coalesce(arg_min(address, (page_id, pos)) FILTER (WHERE k = len(steps)), '') AS url, coalesce(bool_or(pos < 0) FILTER (WHERE k = len(steps)), false) AS has_page
FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS k FROM tree_rows) GROUP BY ALL
"""


@query("site_tree", "SELECT root_domain, node_path, parent_path, depth, label, url, has_page FROM tree_all")
def site_tree(spark, sf):
    pages = I.crawled(spark, sf)
    return L.tree_nodes(L.tree_addresses(pages, page_facts.page_links(pages))).drop("node")


@query("tree_descendants", """
SELECT a.root_domain, a.node_path, a.depth, count(b.node_path) AS descendants FROM (SELECT root_domain, node_path, depth FROM tree_all UNION SELECT DISTINCT root_domain, root_domain, 0 FROM tree_all) a
LEFT JOIN tree_all b ON b.root_domain = a.root_domain AND (a.depth = 0 OR starts_with(b.node_path, a.node_path || '/')) AND b.depth > a.depth GROUP BY ALL""")
def tree_descendants(spark, sf):
    pages = I.crawled(spark, sf)
    return L.tree_descendants(I.stage(L.tree_nodes(L.tree_addresses(pages, page_facts.page_links(pages))), "tree"))
