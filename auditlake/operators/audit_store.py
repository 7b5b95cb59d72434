"""The audit kept between crawls: a page is parsed again only if what was fetched has changed.

A store holds four versioned tables, bucketed by site: page facts with a fingerprint of the fetched page, audited pages, and
two partial states per site from which every aggregate is finished.  A crawl replaces the buckets of its own sites and
leaves the files of all others alone.  One record names the versions that belong together, so readers always see a
complete crawl.

Within a crawl, pages whose (site, address, fingerprint) is known take their facts from the store; only the others' HTML
reaches the parser.  Signals that depend on other pages (duplicates, orphans, sitemap membership) are worked out anew for
the crawled sites, on narrow rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditlake.operators import aggregates as A, facts as page_facts
from auditlake.operators.shuffle import stage
from auditlake.sources.versions import VersionedTable

#: What the facts of a page depend on, beside its address.
READ = ["status", "final_url", "content_type", "x_robots_tag", "error", "headers", "redirect_chain", "html"]
#: What a crawl says about a page without looking at it.
CRAWL = ["page_id", "depth", "fetch_ms"]
BUCKETS = 64


def fingerprint() -> Column:
    """128 bits over everything that was fetched."""
    parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.to_json(F.map_entries(c)) if c == "headers" else F.to_json(c) if c == "redirect_chain" else F.col(c).cast("string"))) for c in READ]
    return F.md5(F.concat_ws("\u0001", *[F.concat(F.char_length(p).cast("string"), p) for p in parts]))


class AuditStore:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self._crawls = VersionedTable(spark, f"{folder}/crawls")
        self._tables = {name: VersionedTable(spark, f"{folder}/{name}") for name in ("facts", "audited", "page_states", "code_states")}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("site"), F.lit(self.buckets)).cast("int")

    def crawls(self) -> list[dict]:
        """Records of all complete crawls, oldest first: versions, pages, parsed, reused."""
        return self._crawls.versions()

    def _read(self, name: str, crawl: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        record = self._crawls.record(crawl)
        if record is None:
            raise LookupError("no complete crawl is stored")
        return self._tables[name].read(record["tables"][name], buckets)

    def facts(self, crawl: int | None = None) -> DataFrame:
        return self._read("facts", crawl).drop("print", "parsed_in")

    def audited(self, crawl: int | None = None) -> DataFrame:
        return self._read("audited", crawl)

    def page_states(self, crawl: int | None = None) -> DataFrame:
        return self._read("page_states", crawl)

    def code_states(self, crawl: int | None = None) -> DataFrame:
        return self._read("code_states", crawl)

    def crawl(self, fetches: DataFrame, audit: Callable[[DataFrame], DataFrame]) -> dict:
        """Stores a crawl of one or many whole sites; ``audit`` adds signals and ``issues`` to the facts of their pages."""
        return self.finish(self.parse(fetches), audit)

    def parse(self, fetches: DataFrame) -> dict:
        """Writes the facts of a crawl's pages.  They belong to no crawl until ``finish``; returns what that needs."""
        before = self._crawls.record()
        number = (before["version"] if before else 0) + 1
        printed = fetches.withColumn("print", fingerprint())
        sites = buckets = None
        if before is None:
            rows = page_facts.page_facts(printed, carry=["print"]).withColumn("parsed_in", F.lit(number))
        else:
            narrow = stage(printed.select(*CRAWL, "site", "url", "print"), "prints")
            sites = stage(narrow.select("site").distinct(), "sites")
            buckets = [r[0] for r in sites.select(self._bucket()).distinct().collect()]  # at most ``self.buckets`` numbers
            stored = self._read("facts", buckets=buckets)
            known = stored.drop(*CRAWL).dropDuplicates(["site", "url", "print"])
            kept = narrow.join(known, ["site", "url", "print"])
            changed = stage(narrow.join(known.select("site", "url", "print"), ["site", "url", "print"], "left_anti").select("page_id", "print"), "changed")
            fresh = page_facts.page_facts(printed.join(changed, ["page_id", "print"], "left_semi"), carry=["print"])
            others = stored.join(sites, "site", "left_anti")
            rows = kept.unionByName(fresh.withColumn("parsed_in", F.lit(number))).unionByName(others)
        version = self._tables["facts"].write(rows.withColumn("bucket", self._bucket()), "bucket")
        return {"number": number, "facts": version, "sites": sites, "buckets": buckets}

    def parsed(self, crawl: dict) -> DataFrame:
        """Facts of the pages of a crawl that ``parse`` has written."""
        stored = self._tables["facts"].read(crawl["facts"], crawl["buckets"])
        return stored if crawl["sites"] is None else stored.join(crawl["sites"], "site", "left_semi")

    def finish(self, crawl: dict, audit: Callable[[DataFrame], DataFrame]) -> dict:
        """Audits a parsed crawl and makes it the newest."""
        sites, buckets, own = crawl["sites"], crawl["buckets"], self.parsed(crawl)
        counts = own.agg(F.count("*"), F.count_if(F.col("parsed_in") == crawl["number"])).first()

        def replace(name: str, rows: DataFrame) -> int:
            """The crawled sites' rows, beside those of other sites in the same buckets."""
            if sites is not None:
                rows = rows.unionByName(self._read(name, buckets=buckets).join(sites, "site", "left_anti"))
            return self._tables[name].write(rows.withColumn("bucket", self._bucket()), "bucket")

        versions = {"facts": crawl["facts"], "audited": replace("audited", audit(own.drop("print", "parsed_in")))}
        audited = self._tables["audited"].read(versions["audited"], buckets)
        audited = audited if sites is None else audited.join(sites, "site", "left_semi")
        versions["page_states"] = replace("page_states", A.page_states(audited))
        versions["code_states"] = replace("code_states", A.code_states(audited))
        record = {"tables": versions, "pages": counts[0], "parsed": counts[1], "reused": counts[0] - counts[1]}
        return {**record, "version": self._crawls.commit(record)}
