"""Aligned diff of two versions of files, as ``diff`` does it: lines to delete and lines to insert.

A diff keeps a longest common subsequence of the lines.  Files are cut before they
are compared, so that a task compares a stretch and not a file:

* a line that is unique on both sides and crossed by no other pair of equal lines
  is in every longest common subsequence.  It is found with running extremes of
  the positions at which lines occur (``running``), and cuts both files there;
* a line whose text is missing on the other side of its stretch cannot be kept;
* stretches that are equal line by line, or empty on one side, are done;
* what is left of a stretch is compared by Myers' O(ND) method in linear space.

With ``minimal=False`` the files are also cut at the longest increasing sequence of
the lines unique on both sides (patience diff): shorter stretches in files with many
frequent lines, at the price of a script that need not be the shortest.  Moved blocks
only cost their own stretch: pairs that nothing crosses need no sorting out.

Lines travel as digests and positions; running values are computed in blocks of
BLOCK lines and carried over them, so a single huge file is spread too.  Where no
file is longer than a block there is nothing to carry and no need to join.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetflow.session import scratch_table

BLOCK = 1 << 16


def running(df: DataFrame, keys: list[str], pos: str, values: dict[str, tuple], block: int | None = None, spread: bool = True) -> DataFrame:
    """``df`` with running aggregates over the rows of ``keys`` with a smaller ``pos`` (a larger one if descending).

    ``values``: name -> (kind, column, descending) with kind ``max``, ``min`` or ``sum``; null
    (0 for sums) where no row comes before.  Rows with equal ``pos`` do not see each other.
    Without ``spread`` the rows of ``keys`` are few enough (see ``_long``) to be one block: nothing is carried.
    """
    size = block or BLOCK
    agg = {"max": F.max, "min": F.min, "sum": F.sum}
    if not spread:
        out = df
        for name, (kind, c, down) in values.items():
            here = Window.partitionBy(*keys).orderBy(F.col(pos) * (-1 if down else 1)).rangeBetween(Window.unboundedPreceding, -1)
            got = agg[kind](c).over(here)
            out = out.withColumn(name, F.coalesce(got, F.lit(0)) if kind == "sum" else got)
        return out.select(*df.columns, *values)
    part = F.floor(F.col(pos) / size)
    cut = df.withColumn("__block", part)
    totals = cut.groupBy(*keys, "__block").agg(*[agg[kind](c).alias(f"__{name}") for name, (kind, c, _) in values.items()])
    out, carried = cut, totals
    names = []
    for name, (kind, c, down) in values.items():
        order = F.desc if down else F.asc
        whole = Window.partitionBy(*keys).orderBy(order("__block")).rowsBetween(Window.unboundedPreceding, -1)
        near = Window.partitionBy(*keys, "__block").orderBy(F.col(pos) * (-1 if down else 1)).rangeBetween(Window.unboundedPreceding, -1)
        carried = carried.withColumn(f"__c_{name}", agg[kind](f"__{name}").over(whole))
        out = out.withColumn(f"__n_{name}", agg[kind](c).over(near))
        names.append(name)
    carried = carried.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__kb"), *[f"__c_{n}" for n in names])
    same = F.col("__block") == F.col("__kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    met = out.join(carried, same)
    both = []
    for name, (kind, _, _) in values.items():
        a, b = F.col(f"__n_{name}"), F.col(f"__c_{name}")
        both.append((F.greatest(a, b) if kind == "max" else F.least(a, b) if kind == "min" else F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).alias(name))
    return met.select(*df.columns, *both)


def _long(lines: DataFrame) -> bool:
    """Whether a line's place is outside the first block; positions are unique, so else no file has more lines than a block."""
    return not lines.filter((F.col("pos") < 0) | (F.col("pos") >= BLOCK)).isEmpty()


# --- small helpers inside tasks -------------------------------------------------


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect.bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
        back[i] = at[k - 1] if k else -1
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _middle(a, a0: int, a1: int, b, b0: int, b1: int) -> tuple[int, int, int, int]:
    """Start and end of a snake in the middle of a shortest edit path."""
    n, m = a1 - a0, b1 - b0
    delta = n - m
    ahead, behind = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        ks = range(-(d - 2 * max(0, d - m)), d - 2 * max(0, d - n) + 1, 2)
        for k in ks:
            up, left = ahead.get(k + 1, -1), ahead.get(k - 1, -1)
            x = up if k == -d or (k != d and left < up) else left + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and a[a0 + x] == b[b0 + y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if delta & 1 and -d < delta - k < d and x + behind.get(delta - k, -1) >= n:
                return a0 + x0, b0 + y0, a0 + x, b0 + y
        for k in ks:
            up, left = behind.get(k + 1, -1), behind.get(k - 1, -1)
            x = up if k == -d or (k != d and left < up) else left + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and a[a1 - 1 - x] == b[b1 - 1 - y]:
                x, y = x + 1, y + 1
            behind[k] = x
            if not delta & 1 and -d <= delta - k <= d and x + ahead.get(delta - k, -1) >= n:
                return a1 - x, b1 - y, a1 - x0, b1 - y0
    raise AssertionError("paths always meet")


def common_lines(a, b) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence (Myers 1986, linear space)."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 < a1 and b0 < b1:
            x, y, u, v = _middle(a, a0, a1, b, b0, b1)
            out += zip(range(x, u), range(y, v))
            work += [(a0, x, b0, y), (u, a1, v, b1)]
    return sorted(out)


# --- cutting ----------------------------------------------------------------------


def _digest(value: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(value, F.lit("")).cast("binary")))


def _uncrossed(pairs: DataFrame, keys: list[str], spread: bool) -> DataFrame:
    """``pairs (keys, i, j, lo_i, hi_i, lo_j, hi_j, single)`` with ``free``: single pairs that no other row's positions cross."""
    # a text that begins before i on the left must end before j on the right, and so on backwards
    before = running(pairs, keys, "lo_i", {"reach": ("max", F.col("hi_j"), False)}, spread=spread)
    after = running(before, keys, "hi_i", {"from": ("min", F.col("lo_j"), True)}, spread=spread)
    free = (F.col("single") & F.coalesce(F.col("reach") < F.col("j"), F.lit(True)) & F.coalesce(F.col("from") > F.col("j"), F.lit(True)))
    return after.withColumn("free", free).drop("reach", "from")


def _increasing(free: DataFrame, keys: list[str], spread: bool) -> DataFrame:
    """The pairs of a longest increasing sequence among unique lines; uncrossed ones cut the rest into short lists."""
    counted = running(free, keys, "i", {"part": ("sum", F.col("free").cast("long"), False)}, spread=spread)
    lists = (counted.filter(~F.col("free")).groupBy(*keys, "part")
             .agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("ij")))

    def run(batches):
        for b in batches:
            ij = b.column(b.num_columns - 1).to_pylist()
            kept = [[row[k] for k in longest_increasing([p["j"] for p in row])] for row in ij]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(kept, b.column(b.num_columns - 1).type)], names=b.schema.names)

    chosen = lists.mapInArrow(run, lists.schema).select(*keys, F.explode("ij").alias("p")).select(*keys, "p.i", "p.j")
    return free.filter("free").select(*keys, "i", "j").unionByName(chosen)


def anchors(lines: DataFrame, keys: list[str], minimal: bool, spread: bool = True) -> DataFrame:
    """``(keys, i, j)`` at which both files are cut; ``lines``: ``(keys, left, pos, digest)``."""
    left, right = F.when(F.col("left"), F.col("pos")), F.when(~F.col("left"), F.col("pos"))
    texts = lines.groupBy(*keys, "digest").agg(
        F.min(left).alias("lo_i"), F.max(left).alias("hi_i"), F.min(right).alias("lo_j"), F.max(right).alias("hi_j"),
        F.count_if("left").alias("nl"), F.count_if(~F.col("left")).alias("nr")).filter("nl > 0 and nr > 0")
    single = (F.col("nl") == 1) & (F.col("nr") == 1)
    pairs = texts.select(*keys, F.col("lo_i").alias("i"), F.col("lo_j").alias("j"), "lo_i", "hi_i", "lo_j", "hi_j", single.alias("single"))
    if minimal:
        return _uncrossed(scratch_table(pairs, "align-pairs"), keys, spread).filter("free").select(*keys, "i", "j")
    return _increasing(scratch_table(_uncrossed(scratch_table(pairs.filter("single"), "align-pairs"), keys, spread), "align-unique"), keys, spread)


# --- the diff ---------------------------------------------------------------------


def kept_lines(lines: DataFrame, keys: list[str], minimal: bool = True, spread: bool = True) -> DataFrame:
    """``(keys, i, j)``: left line i stays as right line j; ``lines``: ``(keys, left, pos, digest)``, positions unique per side."""
    cut = scratch_table(anchors(lines, keys, minimal, spread), "align-anchors")
    sides = (cut.select(*keys, F.lit(True).alias("left"), F.col("i").alias("pos"), F.lit(1).alias("anchor"))
             .unionByName(cut.select(*keys, F.lit(False).alias("left"), F.col("j").alias("pos"), F.lit(1).alias("anchor"))))
    marked = lines.join(sides, [*keys, "left", "pos"], "left").withColumn("anchor", F.coalesce("anchor", F.lit(0)))
    placed = running(marked, [*keys, "left"], "pos", {
        "part": ("sum", F.col("anchor"), False), "since": ("max", F.when(F.col("anchor") == 1, F.col("pos")), False)}, spread=spread)
    # parts are numbered by the anchors before them: alike on both sides, as anchors never cross
    loose = placed.filter("anchor = 0").select(*keys, "part", "left", "pos", "digest", (F.col("pos") - F.coalesce("since", F.lit(-1))).alias("nth"))
    loose = scratch_table(loose, "align-loose")

    mark = F.xxhash64("nth", "digest").cast("decimal(38,0)")
    stretch = loose.groupBy(*keys, "part").agg(
        F.count_if("left").alias("nl"), F.count_if(~F.col("left")).alias("nr"), F.max(F.when(F.col("left"), F.col("pos") - F.col("nth"))).alias("at_i"),
        F.max(F.when(~F.col("left"), F.col("pos") - F.col("nth"))).alias("at_j"),
        F.sum(F.when(F.col("left"), mark)).alias("hl"), F.sum(F.when(~F.col("left"), mark)).alias("hr")).filter("nl > 0 and nr > 0")
    stretch = scratch_table(stretch.withColumn("same", (F.col("nl") == F.col("nr")) & (F.col("hl") == F.col("hr"))).select(*keys, "part", "same", "at_i", "at_j"), "align-stretches")
    on = [*keys, "part"]
    equal = (loose.filter("left").join(stretch.filter("same"), on).select(*keys, F.col("pos").alias("i"), (F.col("at_j") + F.col("nth")).alias("j")))

    rest = loose.join(stretch.filter("not same").select(*on), on)
    shared = rest.groupBy(*on, "digest").agg(F.count_if("left").alias("nl"), F.count_if(~F.col("left")).alias("nr")).filter("nl > 0 and nr > 0").select(*on, "digest")
    rest = rest.join(shared, [*on, "digest"])
    line = F.struct("pos", "digest")
    lists = rest.groupBy(*on).agg(F.sort_array(F.collect_list(F.when(F.col("left"), line))).alias("l"),
                                  F.sort_array(F.collect_list(F.when(~F.col("left"), line))).alias("r"))
    many = len(keys)

    def run(batches):
        for b in batches:
            kept = []
            for l, r in zip(b.column(many + 1).to_pylist(), b.column(many + 2).to_pylist()):
                pairs = common_lines([x["digest"] for x in l], [x["digest"] for x in r])
                kept.append([{"i": l[x]["pos"], "j": r[y]["pos"]} for x, y in pairs])
            kind = pa.list_(pa.struct([("i", pa.int64()), ("j", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:many], pa.array(kept, kind)], names=[*b.schema.names[:many], "kept"])

    fields = ", ".join(f"`{k}` {lists.schema[k].dataType.simpleString()}" for k in keys)
    compared = lists.mapInArrow(run, f"{fields}, kept array<struct<i:bigint,j:bigint>>").select(*keys, F.explode("kept").alias("p")).select(*keys, "p.i", "p.j")
    return cut.unionByName(equal).unionByName(compared)


def aligned_diff(left: DataFrame, right: DataFrame, keys="file", line_no: str = "line_no", value: str = "value", minimal: bool = True) -> DataFrame:
    """``(keys, op, line_no, other_no, value)``: the lines that differ between two versions of each file.

    ``op`` is ``-`` for a line of ``left`` to delete and ``+`` for a line of ``right`` to insert;
    ``other_no`` is the line of the other version after which it belongs (null: before the first).
    With ``minimal`` the number of rows is the least possible.  Line numbers are unique per file and
    side; a null value is an empty line; a file missing on one side is deleted or inserted whole.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    tagged = [df.select(*keys, F.lit(side).alias("left"), F.col(line_no).cast("long").alias("pos"), F.col(value).cast("string").alias("value"))
              for df, side in ((left, True), (right, False))]
    every = tagged[0].unionByName(tagged[1])
    lines = scratch_table(every.select(*keys, "left", "pos", _digest(F.col("value")).alias("digest")), "align-lines")
    spread = _long(lines)
    kept = scratch_table(kept_lines(lines, keys, minimal, spread), "align-kept")
    mates = (kept.select(*keys, F.lit(True).alias("left"), F.col("i").alias("pos"), F.col("j").alias("mate"))
             .unionByName(kept.select(*keys, F.lit(False).alias("left"), F.col("j").alias("pos"), F.col("i").alias("mate"))))
    met = lines.drop("digest").join(mates, [*keys, "left", "pos"], "left")
    placed = running(met, [*keys, "left"], "pos", {"other_no": ("max", F.col("mate"), False)}, spread=spread).filter("mate is null").drop("mate")
    own = F.col("l.left") == F.col("r.left")
    for k in keys:
        own = own & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    met = placed.alias("l").join(every.alias("r"), own & (F.col("l.pos") == F.col("r.pos")))
    return met.select(*[F.col(f"l.{k}").alias(k) for k in keys], F.when(F.col("l.left"), "-").otherwise("+").alias("op"),
                      F.col("l.pos").alias("line_no"), "other_no", "value")


def apply_script(left: DataFrame, script: DataFrame, keys="file", line_no: str = "line_no", value: str = "value") -> DataFrame:
    """``(keys, line_no, value)``: the right version, from the left one and its ``aligned_diff``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    gone = script.filter("op = '-'").select(*keys, F.col("line_no").alias(line_no))
    stay = left.join(gone, [*keys, line_no], "left_anti").select(*keys, F.col(line_no).cast("long").alias("after"), F.lit(0).cast("long").alias("nth"), F.col(value).alias("value"))
    new = script.filter("op = '+'").select(*keys, F.coalesce("other_no", F.lit(-1)).cast("long").alias("after"), F.col("line_no").alias("nth"), "value")
    every = stay.unionByName(new).withColumn("place", F.struct("after", "nth"))
    counted = Window.partitionBy(*keys).orderBy("place")
    return every.select(*keys, F.row_number().over(counted).cast("long").alias("line_no"), "value")
