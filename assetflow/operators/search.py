"""Name and content search, line slices, positional diffs and hex dumps.

Per-file caps use ``row_number() <= n``; Spark plans this as a
WindowGroupLimit, so each map task keeps at most ``n`` rows per file before
the shuffle and one huge file cannot flood a task.  Diffs pair rows by
(file, position); the keys are unique, so they do not skew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetflow.functions.arrays import let

MATCH_CAP = 10000     # fixed value: default number of matches to report
SHORT_MATCH_CAP = 1   # fixed value: the short form stops after one match
HEX_ROW_BYTES = 16    # fixed value: bytes per hex-dump row


def name_grep(files: DataFrame, pattern: str, cap: int = MATCH_CAP, path: str = "path") -> DataFrame:
    """Files whose path matches ``pattern``; the first ``cap`` by path (the cap is the feature)."""
    return files.filter(F.col(path).rlike(pattern)).orderBy(path).limit(cap)


def content_grep(lines: DataFrame, pattern: str, cap_per_file: int = MATCH_CAP,
                 file: str = "file", line_no: str = "line_no", value: str = "value") -> DataFrame:
    """Matching lines with their file, at most ``cap_per_file`` per file (first by line)."""
    hits = lines.filter(F.col(value).rlike(pattern))
    w = Window.partitionBy(file).orderBy(line_no)
    return hits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap_per_file).drop("_rn")


def name_content_grep(lines: DataFrame, name_patterns, content_pattern: str,
                      cap_per_file: int = MATCH_CAP, file: str = "file") -> DataFrame:
    """All name patterns must match the file (checked before lines are scanned),
    then the content pattern selects lines."""
    cond = reduce(lambda a, b: a & b, [F.col(file).rlike(p) for p in name_patterns])
    return content_grep(lines.filter(cond), content_pattern, cap_per_file, file)


def multi_source_grep(sources, pattern: str, cap_per_file: int = MATCH_CAP) -> DataFrame:
    """One pattern over several line sources (files or folders) at once."""
    unioned = reduce(lambda a, b: a.unionByName(b), sources)
    return content_grep(unioned, pattern, cap_per_file)


def line_slice(lines: DataFrame, start: int, end: int, line_no: str = "line_no") -> DataFrame:
    """Lines ``start..end`` inclusive (1-based) of every file."""
    return lines.filter(F.col(line_no).between(start, end))


def line_range_diff(left: DataFrame, right: DataFrame, key: str = "file",
                    line_no: str = "line_no", value: str = "value") -> DataFrame:
    """Positional diff of two line ranges: full outer join on (key, offset in range).

    Inputs carry ``range_start``; rows with equal text are dropped.
    """
    a = left.select(key, (F.col(line_no) - F.col("range_start")).alias("rel"), F.col(value).alias("left_value"))
    b = right.select(key, (F.col(line_no) - F.col("range_start")).alias("rel"), F.col(value).alias("right_value"))
    return a.join(b, [key, "rel"], "full_outer").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def _hex_text(chunk):
    return F.regexp_replace(F.lower(F.hex(chunk)), "(.{4})(?!$)", "$1 ")


def hex_rows(df: DataFrame, content: str = "content", key: str = "path", width: int = HEX_ROW_BYTES,
             base: str | None = None, chunk: bool = False) -> DataFrame:
    """Hex dump: one row per ``width`` bytes with the offset, 2-byte groups and text.

    ``hex`` reads like ``xxd``: lower-case, groups of four hex digits;
    ``text`` shows printable ASCII bytes and ``.`` for the others.  ``base`` names
    the offset of a content that is a range of a file.  The content is cut
    into an array first, so the generator does not carry it to every row.  ``chunk``
    adds the bytes themselves, which ``hex_diff`` compares.
    """
    cut = let(F.col(content).cast("binary"), lambda b: F.when(F.length(b) > 0, F.transform(
        F.sequence(F.lit(0), F.length(b) - 1, F.lit(width)), lambda at: F.substring(b, at + 1, width))))
    first = F.lit(0) if base is None else F.col(base)
    rows = (df.select(key, first.cast("long").alias("_base"), F.posexplode_outer(cut).alias("_nth", "_chunk"))
            .filter(F.col("_chunk").isNotNull()))
    # ISO-8859-1 maps every byte to the character of the same code, so one
    # regex turns the non-printable ones into dots (no per-byte lambdas)
    text = F.regexp_replace(F.decode("_chunk", "ISO-8859-1"), "[^\\x20-\\x7e]", ".")
    raw = [F.col("_chunk").alias("chunk")] if chunk else []
    return rows.select(key, (F.col("_base") + F.col("_nth") * width).alias("offset"), _hex_text("_chunk").alias("hex"), text.alias("text"), *raw)


def hex_diff(rows: DataFrame, key: str = "pair", right: str = "is_right") -> DataFrame:
    """Rows of two hex dumps that differ at the same offset.

    ``rows`` holds both dumps of every ``key``; the boolean ``right`` tells them
    apart.  One pass: (key, side, offset) is unique, so a pair is one aggregate; of
    repeated ones the greatest row counts.  With a column ``chunk`` the bytes travel
    instead of their hex text, which sorts alike, and only rows that differ are formatted.
    """
    raw = "chunk" in rows.columns
    value = "chunk" if raw else "hex"
    both = rows.groupBy(key, "offset").agg(F.max(F.when(~F.col(right), F.col(value))).alias("left_hex"),
                                           F.max(F.when(F.col(right), F.col(value))).alias("right_hex"))
    differ = both.filter(~F.col("left_hex").eqNullSafe(F.col("right_hex")))
    return differ.select(key, "offset", *[_hex_text(F.col(c)).alias(c) for c in ("left_hex", "right_hex")]) if raw else differ
