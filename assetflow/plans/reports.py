"""HTML reports as DataFrame rows, and as documents a browser can open.

A report is a set of lines with a sort key; ``write_lines`` writes them as text
per folder, ``write_group_documents`` and ``write_paged_documents`` as one
document per hash type or page, with head and foot.  Cells are one row per asset,
so a huge group never becomes one string; a scoring-report row has at most
``imgs_per_row`` cells and is assembled with a bounded ``collect_list``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.functions.paths import quote_path
from assetflow.operators.dedup import HashFamily
from assetflow.operators.ranking import rank_within_groups
from assetflow.sources import named_files


def _escape(c):
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def img_cell(path, width, meta=None):
    """``<img src="<quoted path>" width="<w>px" data-meta="<escaped meta>" />``."""
    meta = _escape(meta) if meta is not None else F.lit("{}")
    return F.concat(F.lit('<img src="'), quote_path(path), F.lit('" width="'), width.cast("string"),
                    F.lit('px" data-meta="'), meta, F.lit('" /> '))


def group_report_lines(plan: DataFrame, cell_width: int = 100, scale_by_width: bool = True,
                       min_group: int = 2, family: HashFamily | None = None, **rank_opts) -> DataFrame:
    """Duplicate-group report: header, one cell per member in keeper order, footer.

    Output ``hash_type, hash, seq, line``; sort by (hash, seq) and write one
    file per ``hash_type`` (``partitionBy``).  Members follow the keeper in the
    plan's order (``member_key``), or that of ``family``, or by path.  The keeper (seq 1) must have
    a relative path.
    """
    members = plan.filter(F.col("n_members") >= min_group).drop("keep_w")
    order = family.order() if family else ["member_key"] if "member_key" in plan.columns else ["path"]
    ranked = rank_within_groups(members, ["hash_type", "hash"],
                                [F.col("action") != "keep", *order], "seq", **rank_opts)
    keepers = ranked.filter(F.col("seq") == 1).select(
        "hash_type", "hash", F.col("w").alias("keep_w"), F.col("path").alias("keep_path"), "n_members")
    # the keeper must have a relative path; the check is part of the emitted
    # header line so that it is evaluated (a separate column would be pruned)
    check = F.coalesce(F.assert_true(~F.col("keep_path").startswith("/"),
                                     "first member must be relative").cast("string"), F.lit(""))
    cells = ranked.join(keepers.drop("n_members"), ["hash_type", "hash"])
    width = (F.floor(F.lit(cell_width) * F.col("w") / F.col("keep_w")) if scale_by_width
             else F.lit(cell_width)).cast("long")
    body = cells.select("hash_type", "hash", "seq",
                        img_cell(F.col("dst"), width).alias("line"))
    head = keepers.select("hash_type", "hash", F.lit(0).cast("long").alias("seq"),
                          F.concat(F.lit("<tr><td>"), F.col("hash"), F.lit("</td><td>"), check).alias("line"))
    tail = keepers.select("hash_type", "hash", (F.col("n_members") + 1).cast("long").alias("seq"),
                          F.lit("</td></tr>").alias("line"))
    return head.unionByName(body).unionByName(tail)


# What stands around the rows of a document.
DOCUMENT_TITLE = "File Group Mappings"
DOCUMENT_COLUMNS = ("Group Name", "Files")
PAGED_FOLDER = "score_html-"


def document_head(title: str = DOCUMENT_TITLE, columns=DOCUMENT_COLUMNS) -> str:
    cells = "".join(f"<th>{c}</th>" for c in columns)
    return "\n".join(["<!DOCTYPE html>", "<html>", "<head>", '<meta charset="utf-8">', f"<title>{title}</title>", "</head>", "<body>",
                      f"<h1>{title}</h1>", "<table>", "<thead>", f"<tr>{cells}</tr>", "</thead>", "<tbody>"])


DOCUMENT_FOOT = "\n".join(["</tbody>", "</table>", "</body>", "</html>"])


def write_group_documents(lines: DataFrame, folder: str, title: str = DOCUMENT_TITLE, **opts) -> None:
    """``group_report_lines`` as ``<folder>/<hash_type>.html``."""
    named_files.write_documents(lines, folder, F.concat("hash_type", F.lit(".html")), ["hash", "seq"],
                                F.lit(document_head(title)), F.lit(DOCUMENT_FOOT), **opts)


def write_paged_documents(rows: DataFrame, folder: str, predictor: str, title: str = DOCUMENT_TITLE, **opts) -> None:
    """``paged_report_rows`` as ``<folder>/score_html-<predictor>/<page_name>.html``."""
    file = F.concat(F.lit(f"{PAGED_FOLDER}{predictor}/"), "page_name", F.lit(".html"))
    named_files.write_documents(rows, folder, file, ["label", "row_idx"], F.lit(document_head(title)), F.lit(DOCUMENT_FOOT), **opts)


def paged_report_rows(paged: DataFrame, cell_width: int = 200, label: str = "label") -> DataFrame:
    """One HTML table row per report row (<= imgs_per_row cells, bounded collect)."""
    cell = F.struct(F.col("col_idx"), img_cell(F.col("path"), F.lit(cell_width),
                                               F.format_string("%.6f", F.col("score"))).alias("html"))
    rows = paged.groupBy("page", "page_name", label, "row_idx").agg(
        F.array_sort(F.collect_list(cell)).alias("cells"),
        F.count(F.lit(1)).alias("n_cells"))
    return rows.select(
        "page", "page_name", label, "row_idx", "n_cells",
        F.concat(F.lit("<tr><td>"), F.format_string("%s-%d", F.col(label), F.col("row_idx")),
                 F.lit("</td><td>"), F.array_join(F.transform("cells", lambda c: c["html"]), ""),
                 F.lit("</td></tr>")).alias("line"))


def write_lines(lines: DataFrame, out_dir: str, partition_cols, order_cols,
                num_partitions: int | None = None) -> None:
    """Write report lines as text, one folder per partition value, in order.

    Range partitioning on (partition, order) keys spreads a big report over
    many tasks; part files of a folder concatenated in name order are sorted.
    """
    n = num_partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = [*partition_cols, *order_cols]
    (lines.repartitionByRange(n, *keys)
     .sortWithinPartitions(*keys)
     .select(*partition_cols, "line")
     .write.mode("overwrite").partitionBy(*partition_cols).text(out_dir))
