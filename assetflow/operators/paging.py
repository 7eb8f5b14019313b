"""Sorted report rows, pages and grid positions.

Rows are numbered with the skew-safe ranking helper, so one label holding
most assets (``00-neutral``) is spread over many tasks.  Page offsets come
from a per-label summary whose size is bounded by the number of labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetflow.operators.ranking import rank_within_groups

IMGS_PER_ROW = 10       # fixed value: images per report row
ROWS_PER_PAGE = 100     # fixed value: report rows per page
GRID_COLUMNS = 5        # fixed value: default viewer columns


def report_rows(df: DataFrame, label: str = "label", order=("score", "size", "path"),
                imgs_per_row: int = IMGS_PER_ROW, **rank_opts) -> DataFrame:
    """Number members inside each label and chunk them into rows of ``imgs_per_row``.

    Adds ``pos`` (1-based within label), ``row_idx`` (0-based within label)
    and ``col_idx``.
    """
    ranked = rank_within_groups(df, [label], list(order), "pos", **rank_opts)
    return (ranked
            .withColumn("row_idx", F.floor((F.col("pos") - 1) / imgs_per_row).cast("long"))
            .withColumn("col_idx", ((F.col("pos") - 1) % imgs_per_row).cast("long")))


def report_pages(rows: DataFrame, label: str = "label", imgs_per_row: int = IMGS_PER_ROW,
                 rows_per_page: int = ROWS_PER_PAGE) -> DataFrame:
    """Assign pages of at most ``rows_per_page`` report rows, never crossing a label.

    Page numbers run globally across labels in label order; the page name is
    ``<label>-<page:03>``.  The per-label summary has one row per label;
    Spark broadcasts it or not by its size.
    """
    # a plain count (not max(pos)) lets Catalyst drop the ranking window here
    per_label = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    per_label = per_label.withColumn(
        "_pages", F.ceil(F.ceil(F.col("_n") / imgs_per_row) / rows_per_page).cast("long"))
    before = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_label.select(label, F.coalesce(F.sum("_pages").over(before), F.lit(0)).alias("_first_page"))
    out = rows.join(offsets, label, "left")
    page = (F.col("_first_page") + F.floor(F.col("row_idx") / rows_per_page)).cast("long")
    return (out.withColumn("page", page)
            .withColumn("page_name", F.format_string("%s-%03d", F.col(label), page))
            .drop("_first_page"))


def grid_layout(df: DataFrame, order=("path",), cols: int = GRID_COLUMNS, **rank_opts) -> DataFrame:
    """Viewer grid position for ``cols`` columns over the globally sorted rows."""
    if not 1 <= cols <= 10:
        raise ValueError("cols must be 1..10")
    ranked = rank_within_groups(df, [], list(order), "_rn", **rank_opts)
    return (ranked.withColumn("grid_row", F.floor((F.col("_rn") - 1) / cols).cast("long"))
            .withColumn("grid_col", ((F.col("_rn") - 1) % cols).cast("long"))
            .drop("_rn"))
