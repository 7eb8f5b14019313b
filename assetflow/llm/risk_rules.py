"""Quality rules with risk-controlled thresholds (operator 2), DataFrame functions only.

Rules compare a statistic of a whole text with a cutoff.  Cutoffs are chosen on
labelled holdouts: for every stratum (language) and rule, candidate cutoffs run
from lenient to strict; each is tested with the exact binomial tail, i.e. whether
``k`` false rejections among ``n`` good documents rule out a false-rejection rate
above ``alpha / rules``.  Testing stops at the first cutoff that fails (fixed
sequence), and the level is divided by the number of strata times rules
(Bonferroni), so with probability ``1 - delta`` no stratum of its own loses more
than ``alpha`` of its good documents.  Among certified cutoffs the one that best
separates bad from good is used, the most lenient on ties.

The tail counts independent trials.  A labelled id is one trial however many rows
it has, and so is a text however many ids share it; near copies still count each.

Strata with too few good labels to certify anything are pooled in the stratum
``other``.  There the bound holds for the pool as a whole: a small language in it can
lose more than ``alpha``, as long as all of them together do not; the column
``pool`` tells which rows were judged so.  Without any certified cutoff only the
base rules reject.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.functions.arrays import let
from assetflow.llm.common import materialise, text_of

ALPHA = 0.08
DELTA = 0.05
WINDOW = 5                  # words in a window of the repeated-words statistic
TAIL_TERMS = 4096           # exact terms of a binomial tail; the rest is bounded by a geometric series
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# candidate cutoffs per rule, lenient to strict; a document is rejected above the cutoff
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.5, 0.35, 0.25, 0.2, 0.16, 0.13, 0.1, 0.08, 0.06, 0.045, 0.03, 0.02, 0.01]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "shouting": ("n_upper / greatest(word_chars, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
}


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows that occur at least twice in the array ``words``."""
    def covered(h: Column) -> Column:
        def of(s: Column) -> Column:
            twin = F.filter(s, lambda e, i: (e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"]))
            at = F.array_sort(F.transform(twin, lambda e: e["at"]))
            return let(at, lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))),
                F.lit(0), lambda a, x: a + x))
        return let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), of)

    def windows(w: Column) -> Column:
        marks = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(
            F.slice(h, F.lit(window), F.greatest(F.size(h) - (window - 1), F.lit(0))),
            lambda x, i: F.xxhash64(*[F.get(h, i + k) for k in range(window - 1)], x)))
        return let(marks, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return let(words, lambda w: F.when(F.size(w) < window + 1, F.lit(0)).otherwise(windows(w)))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Counts and the text's ``digest`` per row over whole texts; a null text has none of anything, a null stratum is ``''``."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"), F.unhex(F.md5(text_of(text_col).cast("binary"))).alias("digest"),
                        F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"))
    t = F.col("t")
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.ltrim(F.translate(x, SPACE, " ")) != "")
    both = F.array(F.struct(let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r"))).alias("w"),
                            let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("x")))
    return plain.select(
        "doc_id", "stratum", "digest", F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        _count(t, SYMBOLS).cast("long").alias("n_symbols"), _count(t, UPPER).cast("long").alias("n_upper"),
        F.inline_outer(both)).select(
        "doc_id", "stratum", "digest", F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.col("x.n") - F.col("x.d")).cast("long").alias("n_dup_lines"), F.col("w.r").cast("long").alias("n_repeat_words"),
        F.col("x.n").cast("long").alias("n_lines"), "n_upper")


def _lgamma(x: Column) -> Column:
    """log gamma for x >= 1: eight recurrence steps, then Stirling's series."""
    z = x + 8
    steps = x
    for k in range(1, 8):
        steps = steps * (x + k)
    return ((z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z)
            + 1 / (1260 * F.pow(z, F.lit(5.0))) - F.log(steps))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k): terms from ``k`` down, never below the exact value; 1 where ``k`` exceeds the mean."""
    k, n = k.cast("double"), n.cast("double")
    top = _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio = lambda i: i * (1 - p) / ((n - i + 1) * p)      # noqa: E731  term(i - 1) / term(i)
    summed = F.aggregate(
        F.sequence(F.lit(0), F.least(k.cast("int"), F.lit(TAIL_TERMS)) - 1 + F.when(k < 1, 1).otherwise(0)),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, j: F.struct((a["term"] * ratio(k - j)).alias("term"), (a["sum"] + a["term"] * ratio(k - j)).alias("sum")))
    rest = F.when(k > TAIL_TERMS, let(ratio(k - TAIL_TERMS), lambda r: summed["term"] * r / (1 - r))).otherwise(0.0)
    return F.when(k >= n * p, F.lit(1.0)).when(k < 1, F.exp(top)).otherwise(F.least(F.lit(1.0), F.exp(top) * (summed["sum"] + rest)))


def cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
            id_col: str = "doc_id", label_col: str = "quality") -> tuple[DataFrame, DataFrame]:
    """``(pooled, chosen)``: stratum -> pool, and one row per pool with a cutoff per rule (null: rule unused)."""
    risk = alpha / len(RULES)
    y = (labels.select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("int").alias("good"))
         .filter("lid is not null and good in (0, 1)").groupBy("lid").agg(F.max("good").alias("good")))
    held = stats.join(y, stats["doc_id"] == y["lid"])
    trial = F.struct("doc_id", "digest", "stratum", "good", *[F.expr(e).alias(r) for r, (e, _) in RULES.items()])
    once = held.groupBy("doc_id").agg(F.min(trial).alias("t")).groupBy("t.digest").agg(F.min("t").alias("t"))
    held = materialise(once.select("t.*").drop("doc_id", "digest"), "rules-holdout")
    size = held.groupBy("stratum").agg(F.sum("good").alias("n_good"))
    tests = size.agg(F.greatest(F.count("*"), F.lit(1)).alias("strata"))
    level = F.lit(delta) / (F.col("strata") * len(RULES))
    need = F.ceil(F.log(level) / math.log1p(-risk))      # good labels without which nothing can be certified
    pooled = materialise(size.crossJoin(F.broadcast(tests)).select(      # one row of totals
        F.col("stratum").alias("of"), F.when(F.col("n_good") >= need, F.col("stratum")).otherwise(F.lit("other")).alias("pool")), "rules-pools")
    grid = F.explode(F.concat(*[F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cut"), (F.col(r) > c).cast("int").alias("hit"))
                                          for i, c in enumerate(cuts)]) for r, (_, cuts) in RULES.items()]))
    tally = (held.join(pooled, held["stratum"] == pooled["of"]).select("pool", "good", grid.alias("g"))
             .groupBy("pool", F.col("g.rule").alias("rule"), F.col("g.step").alias("step"), F.col("g.cut").alias("cut"))
             .agg(F.sum("good").alias("n"), F.sum(F.col("good") * F.col("g.hit")).alias("k"),
                  F.sum(1 - F.col("good")).alias("bad"), F.sum((1 - F.col("good")) * F.col("g.hit")).alias("caught")))
    passed = (tally.crossJoin(F.broadcast(tests)).withColumn("ok", binomial_tail(F.col("k"), F.col("n"), risk) <= level)
              .withColumn("gain", F.round(F.col("caught") / F.greatest(F.col("bad"), F.lit(1)) - F.col("k") / F.greatest(F.col("n"), F.lit(1)), 9)))
    stop = F.coalesce(F.min(F.when(~F.col("ok"), F.col("step"))), F.lit(1 << 20))
    seq = passed.groupBy("pool", "rule").agg(stop.alias("stop"), F.collect_list(F.struct("step", "cut", "gain")).alias("steps"))
    best = F.array_max(F.transform(F.filter("steps", lambda s: (s["step"] < F.col("stop")) & (s["gain"] > 0)),
                                   lambda s: F.struct(s["gain"].alias("gain"), (-s["step"]).alias("lenient"), s["cut"].alias("cut"))))
    chosen = seq.withColumn("best", best["cut"]).groupBy("pool").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("best"))).alias(f"cut_{r}") for r in RULES])
    return pooled, chosen


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id",
          text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` per row, with the pool and the rules that fired.

    Null and empty texts have no words, so they fail the base rules.  Unlabelled
    strata are judged by the pool ``other`` if it exists.  Labels other than 0 and
    1 are ignored; an id labelled twice counts by its largest label; of the rows that
    repeat a labelled id, and of the labelled ids that share a text, one is a trial.
    """
    stats = materialise(statistics(docs, id_col, text_col, stratum_col), "rules-statistics")
    pooled, chosen = cutoffs(stats, labels, alpha, delta, "doc_id", label_col)
    chosen = materialise(chosen, "rules-cutoffs")
    by_stratum = materialise(pooled.join(chosen, "pool"), "rules-by-stratum")      # one row per labelled stratum
    other = chosen.filter("pool = 'other'").select(*[F.col(f"cut_{r}").alias(f"other_{r}") for r in RULES]).agg(
        *[F.first(f"other_{r}").alias(f"other_{r}") for r in RULES])
    met = stats.join(by_stratum, stats["stratum"] == by_stratum["of"], "left").crossJoin(F.broadcast(other))      # one row
    fired = [F.when(F.expr(e) > F.when(F.col("of").isNull(), F.col(f"other_{r}")).otherwise(F.col(f"cut_{r}")), F.lit(r)) for r, (e, _) in RULES.items()]
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (met.withColumn("base_failed", base).withColumn("rules", F.concat_ws(",", *fired))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~base & (F.col("rules") == "")).alias("kept"), "rules", F.coalesce("pool", F.lit("other")).alias("pool")))
