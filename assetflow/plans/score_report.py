"""Scoring report for an image folder: cached detections, scores, labels, pages.

listing -> allowlist -> (optional first N by path) -> split against the
prediction cache -> caller's detector on the misses only (``mapInPandas``)
-> new cache version written (the detector never runs twice: scoring reads
the written table) -> weighted scores and labels -> report rows and pages
-> HTML lines per page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assetflow.operators import filters, paging, scoring
from assetflow.plans import cache, reports
from assetflow.sources import files

DETECTION_SCHEMA = StructType.fromDDL(
    "path string, size long, detections array<struct<class:string,score:double,box:array<int>>>")


def refresh_predictions(spark: SparkSession, root: str, detector, cache_in: str | None, cache_out: str,
                        first_n: int | None = None) -> DataFrame:
    """Current images with detections; only cache misses go to ``detector``.

    ``detector(pandas.DataFrame[path, size]) -> pandas.DataFrame[path, size, detections]``.
    """
    listing = filters.allow_filter(files.list_files(spark, root)).select("path", "size")
    if first_n is not None:
        listing = listing.orderBy("path").limit(first_n)
    old = cache.load_or_empty(spark, cache_in, DETECTION_SCHEMA) if cache_in else \
        spark.createDataFrame([], DETECTION_SCHEMA)
    new = cache.refresh(listing, old, lambda misses: scoring.predict_missing(
        misses.select("path", "size"), detector, DETECTION_SCHEMA.simpleString()))
    new.write.mode("overwrite").parquet(cache_out)
    return spark.read.schema(DETECTION_SCHEMA).parquet(cache_out)


def score_report(predictions: DataFrame, dim: scoring.ClassDimension, imgs_per_row: int = paging.IMGS_PER_ROW,
                 cell_width: int = 200) -> DataFrame:
    """HTML report lines ``page, page_name, label, row_idx, line`` from cached predictions."""
    assets = predictions.select("path", "size")
    det = predictions.select("path", F.explode("detections").alias("d")).select(
        "path", F.col("d.class").alias("class"), F.col("d.score").alias("score"))
    labeled = scoring.label_assets(scoring.score_assets(assets, det, dim, key="path"), dim)
    rows = paging.report_rows(labeled, "label", ("score", "size", "path"), imgs_per_row)
    pages = paging.report_pages(rows, "label", imgs_per_row)
    return reports.paged_report_rows(pages, cell_width).select("page", "page_name", "label", "row_idx", "line")
