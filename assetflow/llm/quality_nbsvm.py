"""Quality classifier: naive Bayes support vectors (operator 5).

Texts become sets of hashed n-gram indicators: lower-cased word unigrams and
bigrams, and 1- to 4-grams of word shapes (letter case, digits, symbols; a word
equal to the one before it has the shape ``=``), so that layout junk is seen even
when every word is new.  Each indicator is scaled by its class log-count ratio and
a linear hinge-loss model is fitted by dual coordinate descent (Wang & Manning
2012; Hsieh et al. 2008).

The model is fitted on a bounded sample: at most ``SAMPLE_PER_CLASS`` labelled rows
of either class, the smallest by a hash of the id, then of the features; rows that
repeat an id and its features count once.  Features are extracted where the
rows lie (the sample's ids, bounded, are broadcast); the fit is one task over the
bounded sample; every document of the table is scored over its whole text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetflow.llm.common import fold

BITS = 18                    # hashed feature space: 2**18 indicators
SAMPLE_PER_CLASS = 6_000     # documented bound of the training sample
EPOCHS = 12
COST = 1.0
THRESHOLD = 0.3
_CHUNK = 1 << 16             # words handled at a time
_CACHE = 300_000             # words remembered by a worker


def shape(word: str) -> str:
    """Letters become x or X, digits 9, other characters stay; runs are cut to two."""
    out = ""
    for ch in word:
        c = ("X" if ch.isupper() else "x") if ch.isalpha() else "9" if ch.isdigit() else ch
        if out[-2:] != c * 2:
            out += c
    return out


class _Words(dict):
    """word -> word hash (upper 32 bits) and shape hash (lower 32 bits); bounded, long words are hashed whole but not kept."""

    def __missing__(self, word: str) -> int:
        got = xxhash.xxh32_intdigest(word.lower()) << 32 | xxhash.xxh32_intdigest(shape(word))
        if len(word) <= 64:
            if len(self) >= _CACHE:
                self.clear()
            self[word] = got
        return got


_WORDS = _Words()
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SAME = np.uint64(0x51ED270B)


def _mark(words: list[str], mark: np.ndarray) -> None:
    both = np.array([_WORDS[w] for w in words], np.uint64)
    word, kind = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    kind[1:][both[1:] == both[:-1]] = _SAME
    down = np.uint64(64 - BITS)

    def put(x: np.ndarray, salt: int) -> None:
        x = (x + np.uint64(salt)) * _MIX
        mark[((x ^ (x >> np.uint64(29))) * _MIX) >> down] = True

    put(word, 1)
    put(word[:-1] * np.uint64(1_000_003) + word[1:], 2 << 40)
    run = kind
    for order in range(1, 5):
        put(run, (2 + order) << 40)
        if len(run) < 2:
            break
        run = run[:-1] * np.uint64(0x100000001B3) + kind[order:]


def indicators(text: str, mark: np.ndarray) -> np.ndarray:
    """Sorted indices of the n-grams that occur in ``text``; ``mark`` is an all-false work array."""
    words = text.split()
    for at in range(0, len(words), _CHUNK):
        _mark(words[max(0, at - 3):at + _CHUNK], mark)
    found = np.flatnonzero(mark)
    mark[found] = False
    return found


def _descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for hinge loss over indicators scaled by ``r``; bias is one more feature."""
    w, bias, rng = np.zeros(len(r)), 0.0, np.random.default_rng(5)
    value = [r[x] for x in rows]
    norm = np.array([v @ v + 1.0 for v in value])
    dual = np.zeros(len(rows))
    for _ in range(EPOCHS):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], value[i]
            slack = y[i] * (w[x] @ v + bias) - 1.0
            new = min(max(dual[i] - slack / norm[i], 0.0), cost[i])
            step = (new - dual[i]) * y[i]
            if step:
                dual[i] = new
                w[x] += step * v
                bias += step
                worst = max(worst, abs(step) * norm[i])
        if worst < 1e-3:
            break
    return w * r, bias


def _calibrate(margin: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Sigmoid slope and offset by weighted Newton steps (Platt scaling with a small ridge)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - good), weight * p * (1 - p)
        grad = np.array([g @ margin + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
        hess = np.array([[h @ margin**2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    return float(max(a, 1e-3)), float(b)


def fit_rows(rows: list[np.ndarray], good: np.ndarray, prior: float) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias, sigmoid slope and offset.  Without both classes: constant score ``prior``."""
    size = 1 << BITS
    if len(rows) < 2 or good.min() == good.max():
        odds = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return np.zeros(size, np.float32), 0.0, 1.0, float(odds)
    count = [np.ones(size), np.ones(size)]
    for x, g in zip(rows, good):
        count[int(g)][x] += 1
    r = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    held = np.arange(len(rows)) % 5 == 0
    if len(set(good[held])) < 2 or len(set(good[~held])) < 2:
        held[:] = False
    share = np.where(good == 1, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    y = np.where(good == 1, 1.0, -1.0)
    pick = np.flatnonzero(~held)
    w, bias = _descend([rows[i] for i in pick], y[pick], r, COST * share[pick])
    test = np.flatnonzero(held) if held.any() else pick
    margin = np.array([w[rows[i]].sum() + bias for i in test])
    of = np.where(good[test] == 1, prior / max(good[test].mean(), 1e-9), (1 - prior) / max(1 - good[test].mean(), 1e-9))
    return (w.astype(np.float32), bias, *_calibrate(margin, good[test], of))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        per_class: int = SAMPLE_PER_CLASS, folds: int = 5):
    """Fit on labelled rows outside fold 0; returns ``(weights, bias, slope, offset)`` (1 MB, fixed).

    Null or other labels are ignored; an id labelled twice counts by its largest label.
    """
    y = (labels.select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("int").alias("y"))
         .filter("lid is not null and y in (0, 1)").groupBy("lid").agg(F.max("y").alias("y"))
         .filter(fold(F.col("lid"), folds) != 0))
    good, total = y.agg(F.sum("y"), F.count("*")).first()
    prior = (good or 0) / total if total else 0.5
    # a hash prefilter leaves about twice the sample per class, so the ranking below is as bounded as the sample
    share = {c: 2 * per_class / max(n or 0, 1) for c, n in ((1, good), (0, (total or 0) - (good or 0)))}
    spot = F.pmod(F.xxhash64("lid"), F.lit(1 << 30)) / float(1 << 30)
    order = Window.partitionBy("y").orderBy(F.xxhash64("lid"), "lid")
    sample = y.filter(spot < F.when(F.col("y") == 1, min(share[1], 1.0)).otherwise(min(share[0], 1.0)))
    sample = sample.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_class).drop("nth")

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    train = plain.join(F.broadcast(sample), plain["id"] == sample["lid"])     # at most 2 * per_class ids

    def extract(batches):
        mark = np.zeros(1 << BITS, bool)
        for b in batches:
            got = [indicators(t, mark).astype(np.uint32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(got, pa.binary()), b.column(2), pa.array(np.zeros(len(got), np.int32))], names=["id", "x", "y", "all"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", key=lambda s: s.map(lambda v: xxhash.xxh64_intdigest(str(v))), kind="stable")
        rows = [np.frombuffer(x, np.uint32) for x in pdf["x"]]
        w, bias, slope, offset = fit_rows(rows, pdf["y"].to_numpy(), prior)
        return pd.DataFrame({"w": [w.tobytes()], "bias": [bias], "slope": [slope], "offset": [offset]})

    rows = train.select("id", "t", "y").mapInArrow(extract, "id long, x binary, y int, all int").dropDuplicates(["id", "y", "x"])
    first = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id", F.xxhash64("x"), "x")      # an id may have many texts
    rows = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= per_class).drop("nth")
    got = rows.groupBy("all").applyInPandas(solve, "w binary, bias double, slope double, offset double").first()
    if got is None:
        return fit_rows([], np.zeros(0), prior)
    return np.frombuffer(got["w"], np.float32), got["bias"], got["slope"], got["offset"]


def score(docs: DataFrame, model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the double column ``out`` (0 to 1; empty and null texts too) added, by one map over whole texts.

    An input column named ``out`` is replaced.  Repeated rows score alike.
    """
    w, bias, slope, offset = model
    docs = docs.drop(out)
    names = docs.columns

    def run(batches):
        mark = np.zeros(1 << BITS, bool)
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            m = np.array([float(w[indicators(t, mark)].sum(dtype=np.float64)) for t in texts]) + bias
            p = 1 / (1 + np.exp(-np.clip(slope * m + offset, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), pa.array(p)], names=[*names, out])

    field = docs.schema.add(out, "double")
    work = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    return work.mapInArrow(run, field)
