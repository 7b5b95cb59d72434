"""Images of a page that do not load."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from auditlake.functions.binding import unpack
from auditlake.operators.shuffle import salted_join


def broken_images(pages: DataFrame, assets: DataFrame, per_page: int | None = None) -> DataFrame:
    """Per page: the images whose request failed or answered 400 and up, in page order; all of them, or those among
    the first ``per_page`` images.

    ``assets``: src, status (NULL when there was no response).  A logo may be on every page, so the asset join
    spreads hot addresses; an image without a log row was not requested and is not broken.
    """
    looked_at = F.col("image_srcs") if per_page is None else F.slice("image_srcs", 1, per_page)
    images = unpack(pages.select("page_id", "image_srcs"), looked_at, "src", "pos").drop("image_srcs")
    bad = assets.where("status IS NULL OR status >= 400").select("src", F.lit(True).alias("bad"))
    hits = salted_join(images, bad, ["src"], F.col("page_id"), "inner")
    # never more than one page's images
    return hits.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "src"))).getField("src").alias("broken_images"))
