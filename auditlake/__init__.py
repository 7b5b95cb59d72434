"""Site-audit analytics on Spark: page facts, rule findings, link graphs, crawl diffs and rankings."""
