"""Helpers shared by the training-data operators: table access, scratch tables, folds.

Conventions of every operator in this package:

* an operator reads only the columns named in its arguments and renames them
  first, so extra input columns, whatever their names, cannot clash;
* a null text is the empty text; a null label, language or source is "unknown"
  and described where it matters; an empty table gives an empty result;
* repeated rows are separate documents unless the operator says otherwise.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Catalyst prunes its columns."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a fresh folder below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage like ``checkpoint()`` (a lost executor re-reads files
    that every executor shares) but stays columnar, so later passes prune
    columns, and Spark knows the size when it plans joins.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def pieces(batches, rows: int = 512):
    """Arrow batches cut to ``rows`` rows, so that what a worker makes of one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
