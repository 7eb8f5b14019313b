"""Equi-join whose hot keys are dealt over several tasks, whatever AQE can split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = 16       # tasks that share one key


def salted_join(many: DataFrame, few: DataFrame, keys, by, salt: int = SALT) -> DataFrame:
    """Inner join on ``keys``: rows of ``many`` are dealt by the hash of ``by``, ``few`` is copied ``salt`` times.

    ``few`` should have one row per key; it is the side that grows.
    """
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salt)).cast("int"))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return dealt.join(copies, [*keys, "_salt"], "inner").drop("_salt")
