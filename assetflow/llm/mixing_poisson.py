"""Mixing sources to target weights by Poisson replication (operator 8).

Source ``s`` with weight ``w_s`` has the target repetition rate
``r_s = w_s * budget / size_s`` (sizes in characters).  Each row's number of copies
is the quantile of a Poisson distribution with that mean at a uniform number
seeded by the hash of the row's id: rows are replicated and dropped so that every
source's expected share is its weight, with no coordination between rows and the
same copies on every retry.  Copies are then dealt out and sorted by a hash key.

``max_rate=None`` takes the target rates as they are.  Under a cap, what capped
sources cannot give goes to the others in proportion to their weights, and
``rates`` tells each source's target and realised share.  A rate above ``PART`` is
the sum of equal parts, each with its own uniform number: a sum of independent
Poisson numbers is Poisson, so no rate is too large for the table of quantiles.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.functions.arrays import let
from assetflow.llm.common import materialise, text_of

TEMPERATURE = 0.5        # without explicit weights: weight = size ** TEMPERATURE
MAX_RATE = 4.0           # default cap: a source is repeated at most so often on average; None is no cap
PART = 512.0             # exp(-PART) is far from underflow
COPIES = 1024            # copies of a row that one task makes at once
SEED = 17


def uniform(key: Column) -> Column:
    """52 bits of md5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _level(sized: DataFrame, max_rate: float) -> tuple[float, float] | None:
    """Characters per unit of weight for the sources below the cap, and characters in all; None if no source reaches the cap."""
    level, capped = None, 0
    while True:
        over = F.lit(False) if level is None else F.col("w") * level >= F.col("size") * max_rate
        t = sized.agg(F.sum("size").alias("size"), F.sum(F.when(over, F.col("size")).otherwise(0.0)).alias("full"),
                      F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("w"),
                      F.sum((over & (F.col("size") > 0)).cast("int")).alias("n")).first()
        if level is not None and t["n"] == capped:       # no source more than in the round before
            return (level, t["full"] * max_rate + t["w"] * level) if capped else None
        if not t["w"]:
            return (level, t["full"] * max_rate) if level is not None else None
        level, capped = (t["size"] - t["full"] * max_rate) / t["w"], t["n"]


def rates(docs: DataFrame, weights: dict[str, float] | None = None, text_col: str = "text", source_col: str = "source",
          temperature: float = TEMPERATURE, max_rate: float | None = MAX_RATE) -> DataFrame:
    """``(rsource, size, rate, target, realised, parts, cdf)`` per source; an unknown (null) source is the source ``''``.

    ``target`` and ``realised`` are shares of the characters, by the weights and by
    the rates; ``cdf`` belongs to ``rate / parts``.
    """
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    size = docs.groupBy(source.alias("rsource")).agg(F.sum(F.length(text_of(text_col))).cast("double").alias("size"))
    if weights is None:
        w = F.pow(F.col("size"), F.lit(temperature))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("rsource") == name, float(value)).otherwise(w)
    sized = size.withColumn("w", F.when(F.col("size") > 0, w).otherwise(0.0))      # no characters, no share
    target = F.col("w") / F.col("all_w")
    rate, total = target * F.col("all_size") / F.col("size"), F.col("all_size")
    if max_rate is not None:
        sized = materialise(sized, "mixing-sizes")
        found = _level(sized, float(max_rate))
        if found is not None:
            rate, total = F.least(F.lit(float(max_rate)), F.col("w") * found[0] / F.col("size")), F.lit(found[1])
    whole = sized.agg(F.sum("size").alias("all_size"), F.sum("w").alias("all_w"))
    met = (F.col("size") > 0) & (F.col("all_w") > 0)
    part = F.col("rate") / F.col("parts")
    terms = F.aggregate(
        F.sequence(F.lit(1), (F.ceil(part + 12 * F.sqrt(part)) + 64).cast("int")),      # beyond: probability below 2 ** -52
        F.struct(F.exp(-part).alias("p"), F.array(F.exp(-part)).alias("cdf")),
        lambda acc, k: F.struct((acc["p"] * part / k).alias("p"),
                                F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * part / k)).alias("cdf")))
    return (sized.crossJoin(F.broadcast(whole))       # a single row of totals
            .withColumn("rate", F.when(met, rate).otherwise(1.0))
            .withColumn("target", F.when(met, target).otherwise(0.0))
            .withColumn("realised", F.when(met, F.col("rate") * F.col("size") / total).otherwise(0.0))
            .withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
            .withColumn("cdf", terms["cdf"]).select("rsource", "size", "rate", "target", "realised", "parts", "cdf"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source", seed: int = SEED, shuffle: bool = True, **rate_args) -> DataFrame:
    """The columns of ``docs``, plus ``copy`` (from 1) and ``shuffle_key``; one row per copy.

    Input columns named ``copy`` or ``shuffle_key`` are replaced.  A null id counts
    as empty text in the hash, a null source as source ``''``; rows that repeat an
    id draw the same count.  Sources of no characters keep rate 1; with weights
    given, a source without one has weight 0 and rate 0.
    """
    table = materialise(rates(docs, weights, text_col, source_col, **rate_args), "mixing-rates")
    docs = docs.drop("copy", "shuffle_key")
    names = docs.columns
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s"), key.alias("key"))
    met = work.join(table.select("rsource", "parts", "cdf"), F.col("s") == F.col("rsource"))

    def quantile(name: Column) -> Column:
        return let(uniform(F.concat_ws(":", name, "key")), lambda u: F.size(F.filter("cdf", lambda c: c <= u)))
    more = F.aggregate(F.sequence(F.lit(2), F.col("parts")), F.lit(0), lambda n, j: n + quantile(F.concat(F.lit(f"draw{seed}."), j.cast("string"))))
    drawn = met.withColumn("count", quantile(F.lit(f"draw{seed}")) + F.when(F.col("parts") > 1, more).otherwise(0)).filter("count > 0")
    first = F.lit(0)
    if (table.agg(F.max("rate")).first()[0] or 0) > PART:      # a row may have very many copies: they are dealt out in blocks
        drawn = drawn.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / COPIES).cast("int")))) \
            .repartition("key", "block")
        first = F.col("block") * COPIES
        drawn = drawn.withColumn("count", F.least(F.col("count") - first, F.lit(COPIES)))
    copies = drawn.withColumn("copy", F.explode(F.sequence(first + 1, first + F.col("count")))) \
        .withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"deal{seed}"), "key", "copy").cast("binary")))
    out = copies.select(*[F.col("row")[c].alias(c) for c in names], "copy", "shuffle_key")
    if not shuffle:
        return out
    return out.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
