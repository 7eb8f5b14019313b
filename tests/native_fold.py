"""The interlinear fold as column expressions, the reference form of ``gloss.interlinear_udf``."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetflow.functions.arrays import let
from assetflow.functions.text import display_width, is_han, pad_center


def interlinear(tokens: Column, width: int = 60, char_class: str = "\\p{IsHan}") -> Column:
    """Fold ``ARRAY<STRUCT<text, gloss>>`` into wrapped (text, gloss) segments.

    Tokens are first centre-aligned pairwise.  Gloss and text accumulate; as
    soon as the gloss line exceeds ``width`` both are ended with a newline
    (unless already ending in one) and emitted.  Otherwise a separating
    space is added between two class tokens when neither gloss already has a
    space at the seam.  Sequential within a line; lines run in parallel.
    """
    def measure(t):
        han = is_han(t["text"], char_class)
        return F.struct(t["text"].alias("text"), t["gloss"].alias("gloss"), han.alias("han"),
                        (F.length(t["text"]) * F.when(han, 2).otherwise(1)).alias("wa"),
                        display_width(t["gloss"], char_class).alias("wb"))

    def pair(t):
        target = F.greatest(t["wa"], t["wb"])
        return F.struct(pad_center(t["text"], t["wa"], target).alias("h"),
                        pad_center(t["gloss"], t["wb"], target).alias("p"), t["han"].alias("han"))

    def with_next(aligned):
        return F.transform(aligned, lambda t, i: F.struct(
            t["h"].alias("h"), t["p"].alias("p"), t["han"].alias("han"),
            F.coalesce(F.get(aligned, i + 1)["han"], F.lit(False)).alias("next_han"),
            F.coalesce(F.get(aligned, i + 1)["p"].startswith(" "), F.lit(False)).alias("next_sp")))

    items = let(F.transform(F.transform(tokens, measure), pair), with_next)
    seg_t = "array<struct<h:string,p:string>>"
    init = F.struct(F.lit("").alias("h"), F.lit("").alias("p"), F.array().cast(seg_t).alias("out"))

    def step(s, x):
        def body(n):
            nh, np_ = n["h"], n["p"]
            nl = np_.endswith("\n")
            fh = F.when(nl, nh).otherwise(F.concat(nh, F.lit("\n")))
            fp = F.when(nl, np_).otherwise(F.concat(np_, F.lit("\n")))
            sep = x["han"] & x["next_han"] & ~x["p"].endswith(" ") & ~x["next_sp"]
            pad = F.when(sep, F.lit(" ")).otherwise(F.lit(""))
            flushed = F.struct(F.lit("").alias("h"), F.lit("").alias("p"),
                               F.array_append(s["out"], F.struct(fh.alias("h"), fp.alias("p"))).alias("out"))
            kept = F.struct(F.concat(nh, pad).alias("h"), F.concat(np_, pad).alias("p"), s["out"].alias("out"))
            return F.when(F.length(np_) > width, flushed).otherwise(kept)
        return let(F.struct(F.concat(s["h"], x["h"]).alias("h"), F.concat(s["p"], x["p"]).alias("p")), body)

    def finish(s):
        return F.when(F.length(s["p"]) > 0, F.array_append(s["out"], F.struct(s["h"].alias("h"), s["p"].alias("p")))) \
            .otherwise(s["out"])

    return F.aggregate(items, init, step, finish)
