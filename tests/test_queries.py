"""Every registered query against its SQL, on the smallest tables or those of AUDIT_SF_DIR."""

import os

import duckdb
import pytest

from auditlake.plans import ORACLE, QUERIES

SF = os.environ.get("AUDIT_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(ORACLE)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=_key)
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=_key)
    assert got == want


def test_every_query_is_registered_once():
    from auditlake.plans.registry import query

    assert set(ORACLE) <= set(QUERIES)
    with pytest.raises(ValueError, match="twice"):
        query("page_facts")


BIGGER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(BIGGER), reason="no test data")
def test_every_finding_occurs(spark):
    """The fixtures make every code of the catalogue fire, but for the fetch error that has no class."""
    from auditlake.functions import text as X
    from auditlake.operators import rules
    from auditlake.plans.site import _SITE_RULES

    codes = lambda name: {r["code"] for r in QUERIES[name](spark, BIGGER).select("code").distinct().collect()}
    page = {r.code for r in rules.PAGE_RULES if isinstance(r.code, str)} | set(X.ERROR_LABELS) | {"blocked_by_robots"}
    assert page - codes("page_issues") <= {"fetch_error"}
    assert codes("site_issues") == {code for _, _, code, _, _ in _SITE_RULES}
