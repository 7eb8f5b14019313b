"""Hard-negative mining with Kronecker-packed products (operator 11).

Components become integers, ``floor(scale * x)``, so scores are exact.  Several
candidates are scored at once: their components, biased to be non-negative, are
put into separated fields of one wide integer; an anchor component, biased too,
is multiplied once with it.  The sums over the components never spill into the next
field, whose width is the bit length of the largest possible sum, and unpacking
and removing the biases gives every candidate's exact inner product.  The wide
integers are the 53 bits of a double where two fields fit (their products are
matrix products), else 64-bit words, else Python integers.

All rows are candidates.  Anchors travel in blocks to blocks of candidates: first
to those of their own label, for the positives, then with the positives' score
windows to all blocks, for the negatives.  A task holds one block of each and
returns a few rows per anchor; a hot label is many blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetflow.llm.common import materialise

SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 50, 5, 3, 50, 95      # LOW, HIGH: percent of the positive score
BLOCK, ANCHOR_BLOCK = 8192, 2048
_STEP = 256                      # anchors scored at a time
_LONG = (1 << 63) - 1
# Larger components take no part: their scores could not be told in 38 digits.
MAX_BITS = 58


def integers(v: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``: float64 where exact, else Python integers."""
    big = np.abs(v).max(initial=0) * scale
    if big < 2.0**52:
        return np.floor(v * float(scale))
    return np.array([[math.floor(x * float(scale)) for x in row] for row in v.tolist()], object).reshape(v.shape)


def packed_scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors, candidates) of integer matrices; int64, or Python integers where needed."""
    many, dim = x.shape
    top_a, top_x = (int(max(abs(m.min(initial=0)), abs(m.max(initial=0)))) for m in (a, x))
    width = max((4 * dim * top_a * top_x).bit_length(), 1)
    if 2 * width <= 53:
        kind, fields = np.float64, 53 // width
    elif 2 * width <= 64:
        kind, fields = np.uint64, 64 // width
    else:
        kind, fields = object, 8
    whole = (lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)) if kind is object else (
        lambda m: m.astype(np.int64))
    ai, xi = whole(a), whole(x)
    groups = -(-many // fields)
    biased = np.zeros((groups * fields, dim), ai.dtype)
    biased[:many] = xi + top_x
    biased = biased.reshape(groups, fields, dim).astype(kind)
    wide = biased[:, 0]
    for j in range(1, fields):
        wide = wide + biased[:, j] * (kind(1 << j * width) if kind is not object else 1 << j * width)
    product = (ai + top_a).astype(kind) @ wide.T
    product = product.astype(np.uint64) if kind is np.float64 else product
    mask = (1 << width) - 1
    mask, shifts = (mask, [j * width for j in range(fields)]) if kind is object else (
        np.uint64(mask), [np.uint64(j * width) for j in range(fields)])
    parts = np.stack([(product >> s) & mask for s in shifts], axis=2).reshape(len(a), groups * fields)[:, :many]
    parts = parts if kind is object else parts.astype(np.int64)
    return parts - top_x * ai.sum(axis=1)[:, None] - top_a * xi.sum(axis=1)[None, :] - dim * top_a * top_x


def best(scores: np.ndarray, where: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores among ``where``, ties to the smaller position."""
    at = np.flatnonzero(where)
    s = scores[at]
    if s.dtype == object:
        return at[sorted(range(len(at)), key=lambda i: (-s[i], at[i]))[:k]]
    if len(at) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        keep = s >= least
        at, s = at[keep], s[keep]
    return at[np.lexsort((at, -s))[:k]]


def _steps(anchors: pd.DataFrame, x: np.ndarray, scale: int):
    """``(anchor row numbers, scores)``; anchors of like size are scored together, so a huge one does not widen all fields."""
    v = np.stack(anchors["v"].to_numpy()).reshape(len(anchors), -1).astype(np.float64)
    bits = np.ceil(np.log2(np.abs(v).max(axis=1, initial=0) + 1)) // 4
    for size in np.unique(bits):
        rows = np.flatnonzero(bits == size)
        for part in np.array_split(rows, -(-len(rows) // _STEP)):
            yield part, packed_scores(integers(v[part], scale), x)


def usable(vectors: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(id, key, label, dim, v)`` of the rows that take part, each once."""
    limit = float(1 << MAX_BITS) / scale
    v = F.col("v")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= limit))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
            .withColumn("key", F.xxhash64("id", "label", "v")).withColumn("dim", F.size("v"))
            .dropDuplicates(["id", "label", "v"]))


def _paired(anchors: DataFrame, rows: DataFrame, sizes: DataFrame, on: list[str], run, schema: str) -> DataFrame:
    """``run`` over all pairs of an anchor block and a candidate block that agree in ``on``."""
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")      # noqa: E731
    every = lambda c: F.explode(F.sequence(F.lit(0), (F.col(c) - 1).cast("int")))      # noqa: E731
    counted = sizes.select(*on, F.ceil(F.col("n_rows") / BLOCK).alias("row_blocks"),
                           F.ceil(F.col("n_anchors") / ANCHOR_BLOCK).alias("anchor_blocks")).filter("anchor_blocks > 0")
    asked = anchors.join(counted, on).withColumn("ab", part("anchor_blocks")).withColumn("rb", every("row_blocks"))
    lent = rows.join(counted, on).withColumn("rb", part("row_blocks")).withColumn("ab", every("anchor_blocks"))
    keys = [*on, "ab", "rb"]
    drop = ["row_blocks", "anchor_blocks"]
    return asked.drop(*drop).groupBy(*keys).cogroup(lent.drop(*drop).groupBy(*keys)).applyInPandas(run, schema)


def mine(vectors: DataFrame, scale: int = SCALE, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose id is divisible by ``every``.  An anchor's positives are its first
    ``positives`` other rows of the same label, its negatives the first ``negatives`` rows of other labels
    with ``low * positive_score <= 100 * negative_score <= high * positive_score``; first means larger
    score, then smaller id.  Rows with a null id, label or vector, or a null, non-finite or enormous
    (``2**MAX_BITS`` after scaling) component take no part; zero vectors do.  Rows that repeat id, label
    and vector are one row.  Vectors of different lengths are never compared.  Scores beyond 64 bits rank
    exactly and are returned as the nearest long.  No candidates: no rows; an empty table gives an empty result.
    """
    rows = materialise(usable(vectors, scale, id_col, vec_col, label_col), "negatives-rows")
    is_anchor = F.col("id") % every == 0
    anchors = materialise(rows.filter(is_anchor), "negatives-anchors")
    count = lambda on: materialise(rows.groupBy(*on).agg(F.count("*").alias("n_rows"), F.count_if(is_anchor).alias("n_anchors")), "negatives-sizes")      # noqa: E731

    def nearest(asked: pd.DataFrame, lent: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(lent):
            lent = lent.sort_values(["id", "key"], ignore_index=True)
            ids, own = lent["id"].to_numpy(), lent["key"].to_numpy()
            x = integers(np.stack(lent["v"].to_numpy()).reshape(len(lent), -1).astype(np.float64), scale)
            who, key = asked["id"].to_numpy(), asked["key"].to_numpy()
            for part, scores in _steps(asked, x, scale):
                for a, s in zip(part, scores):
                    out += [(who[a], key[a], ids[c], own[c], str(s[c])) for c in best(s, own != key[a], positives)]
        return pd.DataFrame(out, columns=["id", "key", "positive_id", "pkey", "score"])

    found = _paired(anchors.select("id", "key", "v", "dim", "label"), rows, count(["dim", "label"]), ["dim", "label"], nearest,
                    "id long, key long, positive_id long, pkey long, score string")
    found = found.withColumn("score", F.col("score").cast("decimal(38,0)"))
    order = Window.partitionBy("id", "key").orderBy(F.desc("score"), "positive_id", "pkey")
    chosen = found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= positives)
    windows = chosen.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct(
        "nth", "positive_id", F.col("score").cast("string").alias("score")))).alias("positives"))      # at most ``positives`` each
    asked = materialise(anchors.join(windows, ["id", "key"]), "negatives-windows")

    def between(asked: pd.DataFrame, lent: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(lent):
            lent = lent.sort_values(["id", "key"], ignore_index=True)
            ids, labels = lent["id"].to_numpy(), lent["label"].to_numpy()
            x = integers(np.stack(lent["v"].to_numpy()).reshape(len(lent), -1).astype(np.float64), scale)
            who, key, label, wanted = (asked[c].to_numpy() for c in ("id", "key", "label", "positives"))
            for part, scores in _steps(asked, x, scale):
                for a, s in zip(part, scores):
                    other = labels != label[a]
                    for p in wanted[a]:
                        score = int(p["score"])
                        least, most = -(-low * score // 100), high * score // 100
                        if s.dtype != object:
                            if least > _LONG or most < -_LONG:
                                continue
                            least, most = max(least, -_LONG), min(most, _LONG)
                        out += [(who[a], key[a], p["nth"], p["positive_id"], p["score"], ids[c], str(s[c]))
                                for c in best(s, other & (s >= least) & (s <= most), negatives)]
        return pd.DataFrame(out, columns=["anchor_id", "key", "nth", "positive_id", "ps", "negative_id", "ns"])

    parts = _paired(asked, rows, count(["dim"]), ["dim"], between,
                    "anchor_id long, key long, nth int, positive_id long, ps string, negative_id long, ns string")
    parts = parts.withColumns({"ps": F.col("ps").cast("decimal(38,0)"), "ns": F.col("ns").cast("decimal(38,0)")})
    order = Window.partitionBy("anchor_id", "key", "nth").orderBy(F.desc("ns"), "negative_id")
    exact = lambda c: F.greatest(F.least(F.col(c), F.lit(_LONG)), F.lit(-_LONG)).cast("long")      # noqa: E731
    return (parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", exact("ps").alias("positive_score"), exact("ns").alias("negative_score")))
