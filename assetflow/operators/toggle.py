"""Move toggles: which items are currently moved, and the session counter.

A toggle moves an item to the destination when it is the item's odd-th
toggle and back otherwise.  The counter starts at 0 after the last reset
(opening a folder) and adds +1 / -1 per toggle; items stay moved across
resets.  Everything reduces to per-item counts (partial aggregation), so a
hot item is one row per map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def toggle_state(log: DataFrame, seq: str = "seq", kind: str = "kind", item: str = "item") -> DataFrame:
    """Per item: toggles overall, before/after the last reset, moved flag and
    its contribution to the counter since the last reset."""
    last_reset = log.filter(F.col(kind) == "reset").select(
        F.coalesce(F.max(seq), F.lit(-1)).alias("r")).scalar()
    t = log.filter(F.col(kind) == "toggle")
    per = t.groupBy(item).agg(
        F.count(F.lit(1)).alias("n_toggles"),
        F.count(F.when(F.col(seq) <= last_reset, 1)).alias("n_before"))
    n_after = F.col("n_toggles") - F.col("n_before")
    contribution = F.when(n_after % 2 == 0, F.lit(0)).when(F.col("n_before") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    return per.select(item, F.col("n_toggles").cast("long").alias("n_toggles"),
                      (F.col("n_toggles") % 2 == 1).alias("moved"),
                      contribution.cast("long").alias("delta"))


def moved_count(state: DataFrame) -> DataFrame:
    """The displayed counter and the number of items currently moved."""
    return state.agg(F.coalesce(F.sum("delta"), F.lit(0)).cast("long").alias("counter"),
                     F.count(F.when(F.col("moved"), 1)).alias("n_moved"))
