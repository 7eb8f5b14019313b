"""Language identification with error-correcting output codes (operator 9).

Every language gets a binary codeword.  For each bit, a naive Bayes classifier
over hashed byte n-grams (2 to 4 bytes of the lower-cased text) predicts it.
Decoding sums a logistic loss per bit, weighted by how often that bit was right
for that language in training (loss-weighted decoding, Escalera et al. 2010), and
takes the codeword with the least loss; a small margin flags ambiguity.

N-gram counts cover every training document.  What reaches the driver is bounded:
the language names and row counts, one row per (bit, bucket), and per-language bit
accuracies.  A hash prefilter leaves about twice the ids that weigh the bits, so
their ranking stays as small at every size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetflow.llm.common import fold, materialise

BUCKETS = 1 << 14
CODE_BITS = 15
CHECK_PER_LANGUAGE = 400       # documented bound: training ids per language that weigh the bits
AMBIGUOUS = 0.6                # a score below this is flagged
ROWS = -1                      # in place of a bucket: the language's training rows
_LETTER = regex.compile(r"\p{L}")
_SPACE = bytes(32 if not (97 <= c <= 122 or c >= 128) else c for c in range(256))
_CHUNK = 1 << 20               # bytes handled at a time


def buckets(text: str):
    """Bucket numbers of the 2-, 3- and 4-byte n-grams, one array per piece of a long text."""
    raw = b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACE).split())
    raw = b" " + raw + b" "
    for at in range(0, len(raw) - 1, _CHUNK):
        a = np.frombuffer(raw[at:at + _CHUNK + 3], np.uint8).astype(np.uint32)
        g, out = a, []
        for order in (2, 3, 4):
            if len(g) < 2:
                break
            g = (g[:-1] << np.uint32(8)) | a[order - 1:]
            out.append(((g ^ np.uint32(order * 0x3D4D51CB)) * np.uint32(0x9E3779B1)) >> np.uint32(18))
        yield np.concatenate(out)


def codewords(langs: list[str], bits: int = CODE_BITS) -> np.ndarray:
    """(languages, bits) of -1 and 1: seeded words, each as far as possible from those before it; no constant bit."""
    words: list[np.ndarray] = []
    for lang in langs:
        tries = [np.unpackbits(np.frombuffer(xxhash.xxh128_digest(f"{lang}/{k}"), np.uint8))[:bits] for k in range(64)]
        far = [min([int((t != w).sum()) for w in words], default=0) for t in tries]
        words.append(tries[int(np.argmax(far))])
    code = np.array(words, np.int8).reshape(len(langs), bits) * 2 - 1
    if len(langs) > 1:
        for b in np.flatnonzero(abs(code.sum(axis=0)) == len(langs)):
            code[b % len(langs), b] *= -1
    return code


def _activations(text: str, odds: np.ndarray) -> np.ndarray:
    total, n = np.zeros(odds.shape[1]), 0
    for x in buckets(text):
        if len(x) < 3000:
            total += odds[x].sum(axis=0)
        else:
            total += np.bincount(x, minlength=len(odds)).astype(np.float32) @ odds
        n += len(x)
    return total * (6.0 / (n + 50))       # mean evidence, shrunk on short texts


def decode(f: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[int, float]:
    loss = (weight * np.logaddexp(0, -code * f)).sum(axis=1)
    p = np.exp(loss.min() - loss)
    best = int(np.argmin(loss))
    return best, float(p[best] / p.sum())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> dict:
    """Fit on rows outside fold 0 with a language and a letter; returns the bounded model."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    train = plain.filter((fold(F.col("id"), folds) != 0) & F.col("l").isNotNull() & F.col("t").isNotNull())

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}

        def flush():
            for lang, n in seen.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["l", "k", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array([ROWS] * len(rows), pa.int32()), pa.array(list(rows.values()), pa.int64())], names=["l", "k", "n"])
            seen.clear(), rows.clear()

        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang not in seen:
                    if len(seen) >= 256:
                        yield from flush()
                    seen[lang], rows[lang] = np.zeros(BUCKETS, np.int64), 0
                rows[lang] += 1
                if _LETTER.search(t):
                    for x in buckets(t):
                        seen[lang] += np.bincount(x, minlength=BUCKETS)
        yield from flush()

    tally = materialise(train.select("t", "l").mapInArrow(count, "l string, k int, n long")
                        .groupBy("l", "k").agg(F.sum("n").alias("n")), "langid-counts")
    counts = tally.filter(F.col("k") != ROWS)
    langs = sorted(r[0] for r in counts.select("l").distinct().collect())      # label names only
    if not langs:
        return {"langs": []}
    code = codewords(langs)
    spark = docs.sparkSession
    bits = spark.createDataFrame([(lang, b, int(code[i, b])) for i, lang in enumerate(langs) for b in range(code.shape[1])], "cl string, b int, sign int")
    totals = counts.groupBy("l").agg(F.sum("n").alias("total")).withColumnRenamed("l", "tl")
    rate = counts.join(totals, F.col("l") == F.col("tl")).select("l", "k", (F.col("n") / F.col("total")).alias("p"))
    sides = (rate.join(bits, F.col("l") == F.col("cl")).groupBy("b", "k")
             .agg(F.sum(F.when(F.col("sign") > 0, F.col("p"))).alias("up"), F.sum(F.when(F.col("sign") < 0, F.col("p"))).alias("down")))
    got = sides.toPandas().fillna(0.0)         # at most CODE_BITS * BUCKETS rows
    odds = np.zeros((2, BUCKETS, code.shape[1]))
    odds[0, got["k"], got["b"]], odds[1, got["k"], got["b"]] = got["up"], got["down"]
    many = np.maximum(np.stack([(code > 0).sum(axis=0), (code < 0).sum(axis=0)]), 1)[:, None, :]
    odds = np.log(odds / many + 0.05 / BUCKETS)
    odds = (odds[0] - odds[1]).astype(np.float32)
    if len(langs) == 1:
        return {"langs": langs, "code": code, "odds": odds * 0, "weight": np.ones(code.shape)}

    share = tally.filter(F.col("k") == ROWS).select(F.col("l").alias("rl"), (2 * CHECK_PER_LANGUAGE / F.col("n")).alias("share"))
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    order = Window.partitionBy("l").orderBy(F.xxhash64("id"), "id")
    near = train.join(F.broadcast(share), F.col("l") == F.col("rl")).filter(spot < F.col("share"))      # one row per language name
    some = materialise(near.select("id", "l").distinct().withColumn("nth", F.row_number().over(order))
                       .filter(F.col("nth") <= CHECK_PER_LANGUAGE).select(F.col("id").alias("sid"), F.col("l").alias("sl")), "langid-check")
    checked = train.join(some, (F.col("id") == F.col("sid")) & (F.col("l") == F.col("sl"))).select("t", "l")
    place = {lang: i for i, lang in enumerate(langs)}

    def right(batches):
        for b in batches:
            rows = []
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang not in place or not _LETTER.search(t):      # a language none of whose texts has a letter is not learned
                    continue
                ok = _activations(t, odds) * code[place[lang]] > 0
                rows.append((lang, ok.astype(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["l", "ok"])

    ok = (checked.mapInArrow(right, "l string, ok array<long>").select("l", F.posexplode("ok").alias("b", "v"))
          .groupBy("l", "b").agg(F.avg("v").alias("v")))
    weight = np.full(code.shape, 0.5)
    for r in ok.collect():                     # languages * CODE_BITS rows
        weight[place[r["l"]], r["b"]] = max(r["v"], 0.01)
    weight *= code.shape[1] / weight.sum(axis=1, keepdims=True) / 2
    return {"langs": langs, "code": code, "odds": odds, "weight": weight}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` per row, over whole texts.

    A null text, a text without a letter, or a model without languages gives
    ``und`` with score 0; equal losses go to the first language by name.
    """
    langs = model["langs"]

    def run(batches):
        for b in batches:
            lang, score = [], []
            for t in b.column(1).to_pylist():
                if t is None or not langs or not _LETTER.search(t):
                    lang.append("und"), score.append(0.0)
                    continue
                best, p = decode(_activations(t, model["odds"]), model["code"], model["weight"])
                lang.append(langs[best]), score.append(p)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return (plain.mapInArrow(run, "doc_id long, lang_pred string, score double")
            .withColumn("ambiguous", (F.col("lang_pred") == "und") | (F.col("score") < AMBIGUOUS)))
