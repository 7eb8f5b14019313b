"""Progress and totals of a running job without a second pass (``observe``).

``Progress`` adds observed aggregates to a frame: Spark computes them in the pass that the
action makes anyway, and hands them over when it ends, for streams after every
micro-batch.  ``rows_seen`` gives the running numbers: an accumulator that tasks
add to every ``EVERY`` rows, readable on the driver while the job runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

EVERY = 1000      # fixed value: rows between two progress messages


class Progress:
    """Named aggregates of frames, collected while their actions run."""

    def __init__(self):
        self._seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, name: str, **totals: Column) -> DataFrame:
        """``df`` with the row count and ``totals`` observed under ``name``; use the result in one action."""
        if name in self._seen:
            raise ValueError(f"{name} is watched already")
        self._seen[name] = Observation(name)
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in totals.items()])

    def totals(self, name: str) -> dict:
        """The observed values; waits for the action to end."""
        return dict(self._seen[name].get)


class StreamProgress(StreamingQueryListener):
    """Collects the metrics observed under ``name`` per micro-batch: add it with ``spark.streams.addListener``."""

    def __init__(self, name: str):
        super().__init__()
        self.name, self.batches = name, []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches.append((event.progress.batchId, row.asDict()))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def total(self, field: str = "rows") -> int:
        return sum(m[field] or 0 for _, m in self.batches)


def rows_seen(df: DataFrame, every: int = EVERY):
    """``(df, accumulator)``: the same rows, and how many have passed so far, in steps of ``every`` per task.

    A task that runs twice counts twice, as with any accumulator in a transformation: this is
    for showing progress, ``Progress`` is for exact totals.
    """
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        waiting = 0
        for b in batches:
            waiting += b.num_rows
            if waiting >= every:
                seen.add(waiting // every * every)
                waiting %= every
            yield b
        seen.add(waiting)

    return df.mapInArrow(run, df.schema), seen
