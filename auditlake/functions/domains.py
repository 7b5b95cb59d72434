"""Registrable domains by a table of public suffixes: plain rules, wildcards (``*.ck``) and exceptions (``!www.ck``).

A host's suffix is that of its exception, else its longest matching rule, else its last label; one more label makes the
registrable domain.  A host that is itself a suffix, has a single label or is an IPv4 address stands for itself.

``registrable_domain`` holds the table in the expression (hash sets, no join) and takes tables of up to ``MOST`` rules;
``with_registrable_domain`` joins a table of any size to the distinct hosts.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from auditlake.functions.binding import let

MOST = 20_000  # rules that an expression may hold; also the largest table that is broadcast
LABELS = 6  # of the longest suffix


@dataclass(frozen=True)
class Suffixes:
    """Rules without their marks, and patterns for families of rules."""

    plain: frozenset[str]
    wildcards: frozenset[str] = frozenset()
    exceptions: frozenset[str] = frozenset()
    patterns: tuple[str, ...] = ()

    @classmethod
    def parse(cls, lines: Iterable[str], patterns: tuple[str, ...] = ()) -> Suffixes:
        """From the lines of a suffix list: one rule a line, ``//`` begins a comment, white space ends a rule."""
        rules = {line.split()[0].lower().strip(".") for line in lines if line.strip() and not line.strip().startswith("//")}
        if len(rules) > MOST:
            raise ValueError(f"{len(rules)} rules are too many for an expression; join them with with_registrable_domain")
        marked = lambda mark: frozenset(r[len(mark) :] for r in rules if r.startswith(mark))
        return cls(frozenset(r for r in rules if r[0] not in "*!"), marked("*."), marked("!"), patterns)


# Registry suffixes of two labels and more, wildcards and their exceptions.
_LISTED = (
    "co.uk org.uk ac.uk gov.uk com.au net.au org.au edu.au co.nz com.br net.br org.br gov.br com.ar com.mx "
    "org.mx com.co com.pe com.ve com.ec com.uy com.bo com.py com.gt com.do com.pa gob.cl gob.mx gob.ar co.jp "
    "ne.jp or.jp ac.jp co.kr or.kr com.cn net.cn org.cn com.tw com.hk com.sg com.my co.id co.th co.in net.in "
    "org.in co.za org.za com.tr com.ua com.pl co.il com.sa com.eg com.ng com.es nom.es org.es gob.es "
    "*.bd *.ck *.er *.fk *.jm *.kh *.mm *.np *.pg !www.ck "
    "*.kawasaki.jp *.kitakyushu.jp *.kobe.jp *.nagoya.jp *.sapporo.jp *.sendai.jp *.yokohama.jp "
    "!city.kawasaki.jp !city.kitakyushu.jp !city.kobe.jp !city.nagoya.jp !city.sapporo.jp !city.sendai.jp !city.yokohama.jp"
).split()
#: A country's second level for companies, networks, schools, government and the like, and schools of the states.
_FAMILIES = (r"^(ac|co|com|edu|go|gob|gouv|gov|govt|mil|ne|net|nom|or|org|sch)\.[a-z][a-z]$", r"^((k12|cc|lib)\.)?[a-z][a-z]\.us$")
COMMON = Suffixes.parse(_LISTED, _FAMILIES)
_IPV4 = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"


def bare_host(host: Column) -> Column:
    """Lower case, without user, port and final dot."""
    return F.regexp_replace(F.lower(host), r"^.*@|\.?(:[0-9]*)?$", "")


def registrable_domain(host: Column, suffixes: Suffixes = COMMON) -> Column:
    def found(h: Column) -> Column:
        last = lambda n: F.substring_index(h, ".", -n)
        labels = F.regexp_count(h, F.lit(r"\.")) + 1
        member = lambda c, names: c.isin(*sorted(names)) if names else F.lit(False)
        depth = min(LABELS, max([2, *(r.count(".") + 1 for r in suffixes.plain | suffixes.exceptions), *(r.count(".") + 2 for r in suffixes.wildcards), *(3 for _ in suffixes.patterns)]))
        size = F.lit(None).cast("int")
        for n in range(depth, 1, -1):
            rule = member(last(n), suffixes.plain) | member(last(n - 1), suffixes.wildcards)
            for pattern in suffixes.patterns:
                rule = rule | last(n).rlike(pattern)
            size = F.coalesce(size, F.when((labels >= n) & rule, n))
        size = F.coalesce(size, F.lit(1))
        for n in range(2, depth + 1):
            size = F.when((labels >= n) & member(last(n), suffixes.exceptions), F.lit(n - 1)).otherwise(size)
        return F.when(h.rlike(_IPV4) | (size >= labels), h).otherwise(F.call_function("substring_index", h, F.lit("."), -(size + 1)))

    return let(bare_host(host), found)


def with_registrable_domain(df: DataFrame, host: Column, rules: DataFrame, name: str = "registrable") -> DataFrame:
    """``df`` with ``name``, by a table of suffix rules (``rule``, as in a suffix list) of any size.

    Distinct hosts are cut into their suffixes and joined with the rules; hosts and rules are narrow, ``df`` is joined once.
    """
    marked = rules.select(F.lower(F.trim("rule")).alias("rule")).where("rule <> '' AND rule NOT LIKE '//%'").distinct()
    table = marked.select(
        F.regexp_replace("rule", r"^(\*\.|!)", "").alias("suffix"), F.col("rule").startswith("*.").alias("wild"), F.col("rule").startswith("!").alias("not_one")
    )
    if table.limit(MOST + 1).count() <= MOST:
        table = F.broadcast(table)
    keyed = df.withColumn("_host", bare_host(host))
    hosts = keyed.select("_host").where("_host IS NOT NULL").distinct().withColumn("_labels", F.split("_host", r"\."))
    cuts = hosts.select("_host", F.size("_labels").alias("_n"), F.explode(F.sequence(F.lit(1), F.size("_labels"))).alias("size"), "_labels")
    cuts = cuts.withColumn("suffix", F.array_join(F.slice("_labels", F.col("_n") - F.col("size") + 1, F.col("size")), ".")).drop("_labels")
    hits = cuts.join(table, "suffix").select("_host", F.when(F.col("wild"), F.col("size") + 1).when(F.col("not_one"), F.col("size") - 1).otherwise(F.col("size")).alias("size"), "_n", "not_one")
    best = hits.where("size <= _n").groupBy("_host").agg(F.max(F.struct("not_one", "size")).alias("best")).select("_host", F.col("best.size").alias("_size"))
    sized = hosts.join(best, "_host", "left").withColumn("_size", F.coalesce("_size", F.lit(1)))
    whole = F.col("_host").rlike(_IPV4) | (F.col("_size") >= F.size("_labels"))
    domain = F.when(whole, F.col("_host")).otherwise(F.array_join(F.slice("_labels", F.size("_labels") - F.col("_size"), F.col("_size") + 1), "."))
    return keyed.join(sized.select("_host", domain.alias(name)), "_host", "left").drop("_host")
