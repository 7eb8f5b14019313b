"""Text measurement and alignment expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetflow.functions.arrays import let

HAN_RE = "^\\p{IsHan}+$"


def is_han(s: Column, char_class: str = "\\p{IsHan}") -> Column:
    """True when the whole (non-empty) string is made of the character class."""
    return s.rlike(f"^{char_class}+$")


def display_width(s: Column, char_class: str = "\\p{IsHan}") -> Column:
    """Length where an all-Han token counts two columns per character."""
    return (F.length(s) * F.when(is_han(s, char_class), 2).otherwise(1)).cast("long")


def pad_center(s: Column, width: Column, target: Column) -> Column:
    """Pad ``s`` (of display width ``width``) to ``target``; odd extra goes right."""
    d = F.greatest(target - width, F.lit(0))
    left = F.floor(d / 2).cast("int")
    right = (d - left).cast("int")
    return F.concat(F.repeat(F.lit(" "), left), s, F.repeat(F.lit(" "), right))


def align_pair(a: Column, b: Column, char_class: str = "\\p{IsHan}") -> Column:
    """Centre the narrower of two tokens under the wider one.

    Returns ``struct(a, b)`` padded to the same display width.  Both widths
    are computed once (``let``) and shared by the padding arithmetic.
    """
    widths = F.struct(display_width(a, char_class).alias("wa"), display_width(b, char_class).alias("wb"))

    def body(w):
        target = F.greatest(w["wa"], w["wb"])
        return F.struct(pad_center(a, w["wa"], target).alias("a"), pad_center(b, w["wb"], target).alias("b"))
    return let(widths, body)
