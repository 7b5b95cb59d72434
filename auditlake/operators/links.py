"""Link graph: admission, inlinks, reachability, redirect chains and the site tree."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from auditlake.functions import urls as U
from auditlake.operators.shuffle import SALTS, BucketedTables, cut_lineage, heavy_keys, salted_join, stage

MAX_HOPS = 10  # fixed value: redirects followed before giving up


def _compiles(pattern: str) -> bool:
    """A pattern that is no regular expression excludes nothing.  The dialect that runs it decides: that of the JVM."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def url_allowed(
    url: Column,
    max_length: int = 0,
    exclude_patterns: tuple[str, ...] = (),
    max_query_params: int = 0,
    start_folder: Column | None = None,
) -> Column:
    """Crawl limits on an address; zero or empty switches a limit off."""
    ok = F.lit(True)
    if max_length:
        ok = ok & (F.length(url) <= max_length)
    for pattern in filter(_compiles, exclude_patterns):
        ok = ok & ~url.rlike(pattern)
    if max_query_params:
        ok = ok & (U.query_param_count(url) <= max_query_params)
    if start_folder is not None:
        ok = ok & U.path(url).startswith(start_folder)
    return ok


def link_allowed(rel: Column, follow_nofollow: bool = True) -> Column:
    return F.lit(True) if follow_nofollow else ~F.lower(rel).contains("nofollow")


def discovered_links(
    links: DataFrame, include_subdomains: bool = False, follow_nofollow: bool = True, max_links_per_page: int = 0, **limits
) -> DataFrame:
    """Links that enter the crawl: internal, in scope, allowed, and the first ``max_links_per_page`` of a page."""
    scope = F.col("is_internal")
    if not include_subdomains:
        scope = scope & U.is_same_site(F.col("source"), F.col("target"))
    kept = links.where(scope & link_allowed(F.col("rel"), follow_nofollow) & url_allowed(F.col("target"), **limits))
    if max_links_per_page:
        in_page = W.partitionBy("page_id").orderBy("link_pos")  # one page's links: bounded by the document
        kept = kept.withColumn("_n", F.row_number().over(in_page)).where(F.col("_n") <= max_links_per_page).drop("_n")
    return kept


def inlink_edges(discovered: DataFrame) -> DataFrame:
    """Distinct (target, source) pairs.  A hub's sources stay rows; they are never gathered into one value."""
    return discovered.select("target", "source").distinct()


def page_inlinks(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Inlinks of each page, looked up under its final address as written (a redirecting target gets no credit)."""
    address = F.when(F.col("final_url") == "", F.col("url")).otherwise(F.col("final_url"))
    targets = pages.select("page_id", "url", "depth", address.alias("target"))
    # pages sharing an address each get the sources; the edge side is the skewed one
    return salted_join(edges, targets, ["target"], F.col("source"), "inner")


def inlink_counts(pages: DataFrame, edges: DataFrame) -> DataFrame:
    address = F.when(F.col("final_url") == "", F.col("url")).otherwise(F.col("final_url"))
    counts = edges.groupBy("target").agg(F.count("*").alias("inlinks"))
    out = pages.withColumn("target", address).join(counts, "target", "left").drop("target")
    return out.withColumn("inlinks", F.coalesce("inlinks", F.lit(0)).cast("long"))


def tree_parents(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Parent of each page in the crawl tree: the first inlink one level up, else the first inlink, else none."""
    known = pages.groupBy("url").agg(F.max_by("depth", "page_id").alias("parent_depth"))
    inlinks = page_inlinks(pages, edges).withColumnRenamed("source", "parent")
    seen = inlinks.join(known.withColumnRenamed("url", "parent"), "parent", "left")
    best = seen.groupBy("page_id").agg(
        F.min(F.when(F.col("parent_depth") == F.col("depth") - 1, F.col("parent"))).alias("level_up"),
        F.min(F.struct("parent", F.col("parent_depth").isNotNull().alias("known"))).alias("first"),
    )
    fallback = F.when(F.col("first.known"), F.col("first.parent"))
    parent = F.when(F.col("depth") > 0, F.coalesce("level_up", fallback))
    return pages.select("page_id", "url", "depth").join(best, "page_id", "left").select("page_id", "url", "depth", parent.alias("parent_url"))


MOST_LEVELS = 8  # settled tables before they are merged into one
LINKS_A_BUCKET = 250_000  # more links take more buckets, so that a task keeps its size


class StoredLinks:
    """Links of a crawl in buckets by their source, for any number of walks over them.

    The links are worked out once and counted where they are stored.  Only if some source is a hub are they salted.
    """

    def __init__(self, edges: DataFrame, key: str = "site"):
        spark, self.key, self.keys = edges.sparkSession, key, [key, "node"]
        raw = stage(edges.select(key, F.col("src").alias("node"), "dst", "link_pos"), "links")
        total = raw.count()
        hubs = cut_lineage(heavy_keys(raw, self.keys, total).withColumn("_hub", F.lit(True)))
        self.hubs = None if hubs.isEmpty() else hubs
        self.buckets = max(spark.sparkContext.defaultParallelism, -(-total // LINKS_A_BUCKET))
        self.tables = BucketedTables(spark, "links", self.buckets)
        if self.hubs is None:
            self.table = self.tables.put(raw, self.keys)
        else:
            self.table = self.tables.put(salted_edges(raw, hubs, self.keys), [*self.keys, "_salt"])

    def __enter__(self) -> StoredLinks:
        return self

    def __exit__(self, *_) -> None:
        self.tables.drop()


def _with_salts(nodes: DataFrame, hubs: DataFrame, keys: list[str]) -> DataFrame:
    """Open nodes with a row for every part of their out-links: one, or ``SALTS`` for a hub."""
    parts = F.when(F.col("_hub"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return nodes.join(F.broadcast(hubs), keys, "left").withColumn("_salt", F.explode(parts)).drop("_hub")


def salted_edges(edges: DataFrame, hubs: DataFrame, keys: list[str]) -> DataFrame:
    """Out-links with ``_salt``: those of a hub (a node with a large share of all links) are dealt to ``SALTS`` parts."""
    salt = F.when(F.col("_hub"), F.pmod(F.xxhash64("dst"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    return edges.join(F.broadcast(hubs), keys, "left").withColumn("_salt", salt).drop("_hub")


def expanded(edges: DataFrame, open_nodes: DataFrame, hubs: DataFrame | None, settled: list[DataFrame], keys: list[str]) -> DataFrame:
    """One round: targets of the open nodes' links that no settled table has, each with its first place in the queue.

    ``edges`` is bucketed by ``keys`` and ``_salt``, the settled tables by ``keys``: only the open nodes and what they reach
    are exchanged.  Without hubs ``edges`` is bucketed by ``keys`` as the open nodes are, and only what they reach is exchanged.
    A popular target is reduced by the partial minimum.  Settled nodes are dropped after it by outer joins: Spark would push
    anti joins below it, where every link of the crawl meets every settled table in every round.
    """
    key = keys[0]
    best = F.min(F.struct((F.col("depth") + 1).alias("depth"), F.concat("place", F.array(F.col("link_pos").cast("long"))).alias("place")))
    joined = edges.join(open_nodes, keys) if hubs is None else edges.join(_with_salts(open_nodes, hubs, keys), [*keys, "_salt"])
    reached = joined.groupBy(key, F.col("dst").alias("node")).agg(best.alias("best"))
    for table in settled:
        reached = reached.join(table.withColumn("_settled", F.lit(True)), keys, "left").where("_settled IS NULL").drop("_settled")
    return reached.select(key, "node", "best.depth", "best.place")


def bfs(
    edges: DataFrame | StoredLinks,
    frontier: DataFrame,
    max_depth: int = 10,
    max_pages: int | None = None,
    visited: DataFrame | None = None,
    key: str = "site",
) -> DataFrame:
    """Breadth-first discovery from ``frontier`` (key, node, depth), all sites at once.

    ``edges``: key, src, dst, link_pos, or the same stored by an earlier walk.  Nodes beyond ``max_depth`` are discovered but
    not expanded (``fetched`` is false).
    ``visited`` (key, node) resumes an earlier crawl.  ``place`` is the chain of link positions from the seed, which orders a
    level exactly as a queue would; ``max_pages`` keeps the first pages of each site in that order.

    Links are shuffled once, into buckets by their source; every level found is stored in buckets by node.  A round scans the
    links where they lie and moves the frontier only; there is none without a node to expand.  Stored tables cut the lineage
    and go when the result is written.
    """
    if isinstance(edges, DataFrame):
        with StoredLinks(edges, key) as links:
            return bfs(links, frontier, max_depth, max_pages, visited, key)
    tables, keys = BucketedTables(edges.table.sparkSession, "bfs", edges.buckets), edges.keys
    level = tables.put(frontier.select(key, "node", "depth", F.array(F.coalesce("pos", F.lit(0)).cast("long")).alias("place")), keys)
    done, settled = [level], [level.select(*keys)]
    if visited is not None:
        settled.append(tables.put(visited.select(*keys), keys))
    while not (open_nodes := level.where(F.col("depth") <= max_depth)).isEmpty():
        level = tables.put(expanded(edges.table, open_nodes, edges.hubs, settled, keys), keys)
        done.append(level)
        settled.append(level.select(*keys))
        if len(settled) > MOST_LEVELS:
            settled = [tables.put(reduce(DataFrame.unionByName, settled), keys)]
    out = stage(reduce(DataFrame.unionByName, done).withColumn("fetched", F.col("depth") <= max_depth), "reached")
    tables.drop()
    if max_pages is not None:
        rank = F.row_number().over(W.partitionBy(key).orderBy("depth", "place"))
        out = out.where("fetched").withColumn("_n", rank).where(F.col("_n") <= max_pages).drop("_n")
    return out


def orphan_candidates(listed: DataFrame, reached: DataFrame, seeds: DataFrame | None = None, budget: int | None = None, **limits) -> DataFrame:
    """Listed addresses of the site that no link led to, first listed first.

    A start address (``seeds``: site, url) was visited without a link.  ``limits`` are those of ``url_allowed``; ``budget`` is
    what a site's page limit leaves.
    """
    own = listed.select("site", "visit_no", "loc_pos", U.strip_fragment(F.col("loc")).alias("url")).where(
        (U.site_key(F.col("url")) == F.col("site")) & url_allowed(F.col("url"), **limits)
    )
    if seeds is not None:
        reached = reached.select("site", "url").unionByName(seeds.select("site", "url"))
    first = own.groupBy("site", "url").agg(F.min(F.struct("visit_no", "loc_pos")).alias("place"))
    lost = first.join(reached.select("site", "url").distinct(), ["site", "url"], "left_anti")
    if budget is None:
        return lost
    rank = F.row_number().over(W.partitionBy("site").orderBy("place"))
    return lost.withColumn("_n", rank).where(F.col("_n") <= budget).drop("_n")


def redirect_hops(log: DataFrame) -> DataFrame:
    """Usable hops of a fetch log: a redirect status with a location, resolved against the address."""
    return log.where(F.col("status").isin(301, 302, 303, 307, 308) & F.col("location").isNotNull()).select(
        F.col("from_url"), "status", U.resolve(F.col("location"), F.col("from_url")).alias("to_url")
    )


def redirect_chains(starts: DataFrame, hops: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Follows every start through the hop table: chain, terminal address, loop and overflow flags.

    Many starts may meet at one address (a login page), so each round's join spreads hot addresses.
    """
    one_hop = hops.groupBy(F.col("from_url").alias("current")).agg(F.min(F.struct("status", "to_url")).alias("hop"))
    active = starts.select(
        F.col("from_url").alias("start_url"), F.col("from_url").alias("current"),
        F.array().cast("array<struct<url:string,status:int>>").alias("chain"),
    )
    finished = []
    # a walk that returns to an address it has left repeats that cycle until the limit: unrolled in place, so the
    # number of rounds is the longest chain without a repetition
    back = F.array_position(F.transform("chain", lambda h: h.url), F.col("current"))
    unrolled = F.transform(
        F.sequence(F.lit(0), F.lit(max_hops - 1)),
        lambda k: F.when(k < F.size("chain"), F.get("chain", k)).otherwise(
            F.get("chain", (F.col("back") - 1 + (k - F.col("back") + 1) % (F.size("chain") - F.col("back") + 1)).cast("int"))
        ),
    )
    for round_no in range(max_hops + 1):
        stepped = cut_lineage(salted_join(active, one_hop, ["current"], F.col("start_url")))
        finished.append(
            stepped.where("hop IS NULL").select("start_url", F.col("current").alias("final_url"), "chain", F.lit(False).alias("too_many"))
        )
        moved = stepped.where("hop IS NOT NULL").select(
            "start_url",
            F.col("hop.to_url").alias("current"),
            F.concat("chain", F.array(F.struct(F.col("current").alias("url"), F.col("hop.status").cast("int").alias("status")))).alias("chain"),
        ).withColumn("back", back)
        stuck = (F.col("back") > 0) | (F.size("chain") >= max_hops)
        full = F.when(F.size("chain") >= max_hops, F.col("chain")).otherwise(unrolled)
        finished.append(
            moved.where(stuck).select("start_url", F.lit(None).cast("string").alias("final_url"), full.alias("chain"), F.lit(True).alias("too_many"))
        )
        active = moved.where(~stuck).drop("back")
        if active.isEmpty():
            break
    finished = reduce(DataFrame.unionByName, finished)
    urls = F.transform("chain", lambda h: h.url)
    return finished.withColumns(
        {
            "n_hops": F.size("chain"),
            "has_loop": F.size("chain") > F.size(F.array_distinct(urls)),
        }
    )


def tree_addresses(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Addresses that make up the site tree: every page, then internal link targets of the same domain."""
    address = F.when(F.col("final_url") == "", F.col("url")).otherwise(F.col("final_url"))
    own = pages.select("page_id", F.lit(-1).alias("pos"), address.alias("address"), U.registrable_domain(F.col("url")).alias("root_domain"))
    linked = links.where("is_internal").select(
        "page_id", F.col("link_pos").alias("pos"), F.col("target").alias("address"), U.registrable_domain(F.col("source")).alias("root_domain")
    )
    return own.unionByName(linked).where((U.authority(F.col("address")) != "") & (U.registrable_domain(F.col("address")) == F.col("root_domain")))


def tree_nodes(addresses: DataFrame) -> DataFrame:
    """Nodes of the host / path-segment tree with their parent, depth and first address seen at the node itself."""
    steps = F.concat(
        F.array(U.host(F.col("address"))), F.filter(F.split(U.path(F.col("address")), "/"), lambda s: s != "")
    )
    leaf = addresses.select("root_domain", "page_id", "pos", "address", steps.alias("steps"))
    # collapse repeated addresses before the prefixes multiply them
    leaf = leaf.groupBy("root_domain", "steps").agg(
        F.min(F.struct("page_id", "pos", "address")).alias("first"), F.max(F.col("pos") < 0).alias("has_page")
    )
    prefixes = leaf.select(
        "root_domain", "steps", "first", "has_page", F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("depth")
    ).select(
        "root_domain",
        F.slice("steps", F.lit(1), F.col("depth")).alias("node"),
        "depth",
        F.when(F.col("depth") == F.size("steps"), F.col("first")).alias("first"),
        (F.col("has_page") & (F.col("depth") == F.size("steps"))).alias("has_page"),
    )
    nodes = prefixes.groupBy("root_domain", "node", "depth").agg(F.min("first").alias("first"), F.max("has_page").alias("has_page"))
    return nodes.select(
        "root_domain",
        F.array_join("node", "/").alias("node_path"),
        F.when(F.col("depth") == 1, F.col("root_domain")).otherwise(F.array_join(F.slice("node", F.lit(1), F.col("depth") - 1), "/")).alias("parent_path"),
        "depth",
        F.element_at("node", -1).alias("label"),
        F.coalesce(F.col("first.address"), F.lit("")).alias("url"),
        "has_page",
        "node",
    )


def tree_descendants(nodes: DataFrame) -> DataFrame:
    """Number of nodes below each node; the root domain is the parent of its hosts.  Counts combine map-side."""
    below = nodes.select(
        "root_domain", "node", F.explode(F.sequence(F.lit(0), F.size("node") - 1)).alias("level")
    ).select(
        "root_domain",
        F.when(F.col("level") == 0, F.col("root_domain")).otherwise(F.array_join(F.slice("node", F.lit(1), F.col("level")), "/")).alias("node_path"),
        F.col("level").alias("depth"),
    )
    counts = below.groupBy("root_domain", "node_path", "depth").agg(F.count("*").alias("descendants"))
    every = nodes.select("root_domain", "node_path", "depth").unionByName(
        nodes.select("root_domain", F.col("root_domain").alias("node_path"), F.lit(0).alias("depth")).distinct()
    )
    return every.join(counts, ["root_domain", "node_path", "depth"], "left").withColumn("descendants", F.coalesce("descendants", F.lit(0)))


def node_radius(inlinks: Column) -> Column:
    return F.least(F.lit(13.0), F.lit(5.0) + inlinks * F.lit(1.1))
