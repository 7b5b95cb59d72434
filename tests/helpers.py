"""Small builders for literal inputs."""

from pyspark.sql import functions as F

FETCH_SCHEMA = (
    "page_id long, site string, url string, status int, final_url string, content_type string, x_robots_tag string, error string, "
    "depth int, fetch_ms double, headers map<string,string>, redirect_chain array<struct<url:string,status:int>>, html string"
)


def fetch(page_id, url, html="", status=200, final_url=None, headers=None, chain=(), error="", depth=0, x_robots_tag="", site="example.com"):
    return (page_id, site, url, status, url if final_url is None else final_url, "text/html" if status == 200 else "", x_robots_tag, error,
            depth, 1.0, headers or {}, list(chain), html)


def fetches(spark, rows):
    return spark.createDataFrame(rows, FETCH_SCHEMA)


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, column_of, *args):
    """Evaluates a column function on literals."""
    return spark.range(1).select(column_of(*[F.lit(a) for a in args]).alias("x")).collect()[0][0]
