"""Command-history operators: recent unique commands, timestamp pairing, tail.

The previous line of a history file is found with an equi-join on
(file, line_no - 1) rather than ``lag`` over the file: a single history file
would otherwise be one window partition, i.e. one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetflow.operators.ranking import rank_within_groups

RECENT_N = 20   # fixed value: default rows of the recent-commands view
TAIL_N = 10     # fixed value: default rows of the history tail
TS_LINE = "^#[0-9]+$"


def _placed(last: DataFrame, line_no: str) -> DataFrame:
    """``position`` 1..n in history order, newest last; ``last`` has at most n rows."""
    order = Window.orderBy(line_no)
    return last.withColumn("position", F.row_number().over(order).cast("long")).orderBy("position")


def recent_unique(cmds: DataFrame, pattern: str | None = None, n: int = RECENT_N,
                  cmd: str = "cmd", line_no: str = "line_no") -> DataFrame:
    """Latest occurrence of each distinct command (trailing spaces trimmed),
    the last ``n`` of those in history order.  Exact dedup over all matching
    lines, then top-n (no pre-trimming)."""
    c = cmds.filter(~F.col(cmd).rlike("^#")) if pattern is None else cmds.filter(F.col(cmd).rlike(pattern))
    c = c.filter(~F.col(cmd).rlike(TS_LINE)).withColumn(cmd, F.rtrim(F.col(cmd)))
    latest = c.groupBy(cmd).agg(F.max(line_no).alias(line_no))
    return _placed(latest.orderBy(F.col(line_no).desc()).limit(n), line_no)


def pair_timestamps(lines: DataFrame, file: str = "file", line_no: str = "line_no",
                    value: str = "value") -> DataFrame:
    """Each command with the epoch of the timestamp line right before it, else 0.

    A timestamp line followed by another timestamp line is dropped, so only
    a directly preceding timestamp pairs.  Blank lines are ignored.
    """
    ln = lines.filter(F.col(value) != "")
    cmds = ln.filter(~F.col(value).rlike(TS_LINE))
    stamps = ln.filter(F.col(value).rlike(TS_LINE)).select(
        F.col(file).alias("_f"), (F.col(line_no) + 1).alias("_next"),
        F.substring(F.col(value), 2, 1 << 20).cast("long").alias("_ts"))
    j = cmds.join(stamps, (cmds[file] == stamps["_f"]) & (cmds[line_no] == stamps["_next"]), "left")
    return j.select(file, line_no, F.coalesce(F.col("_ts"), F.lit(0)).cast("long").alias("ts"),
                    F.col(value).alias("cmd"))


def unique_history(lines: DataFrame, **kw) -> DataFrame:
    """One row per distinct command with its latest timestamp (numeric compare)."""
    paired = pair_timestamps(lines, **kw)
    return paired.groupBy("cmd").agg(F.max("ts").alias("ts"))


def unique_history_lines(lines: DataFrame) -> DataFrame:
    """The rewritten file, ``line_no`` and ``line``: ``#<ts>``, then the command, by timestamp, then command.

    Lines are numbered over the whole file without sorting it in one task.
    """
    ranked = rank_within_groups(unique_history(lines), [], ["ts", "cmd"], "nth")
    return ranked.select((2 * F.col("nth") - 1).alias("first"), F.posexplode(F.array(
        F.concat(F.lit("#"), F.col("ts").cast("string")), F.col("cmd"))).alias("k", "line")).select(
        (F.col("first") + F.col("k")).cast("long").alias("line_no"), "line")


def tail(cmds: DataFrame, pattern: str | None = None, n: int = TAIL_N,
         cmd: str = "cmd", line_no: str = "line_no") -> DataFrame:
    """Last ``n`` (matching) history entries, newest last."""
    c = cmds if pattern is None else cmds.filter(F.col(cmd).rlike(pattern))
    return _placed(c.orderBy(F.col(line_no).desc()).limit(n), line_no)
