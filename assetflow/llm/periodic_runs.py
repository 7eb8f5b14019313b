"""Periodic runs of words by scale-tiled Z-functions (operator 13).

A run is a maximal stretch of consecutive words with smallest period ``q`` and at
least ``max(MIN_WORDS, 2q)`` words.  Periods are handled by octave [P, 2P).  For
each octave a document has boundaries every ``max(P, GRAM)`` words, and is exploded
into tiles of ``BLOCK`` boundaries that overlap by all the words a boundary can
need.  Tiles are solved independently: at a boundary, one Z-function forwards and
one backwards tell for every distance ``d`` how far the words stay equal to those
``d`` later.  The stretch of equality around a boundary, clipped to the tile, is a
fragment; fragments are shuffled by (document, period) and overlapping ones are
stitched.

Nothing is lost by the clipping: a run of period p has at least max(p, 12 - p)
equalities in a row, hence contains a boundary of its octave, and a fragment cut
off by its tile is longer than any period of the octave.  A fragment that also has
a period dividing its own belongs to that smaller period and is left out; as it
spans two periods, this holds for the whole run.

A boundary is only solved if GRAM words near it occur again less than 2P later,
which every run of the octave implies; documents without such a boundary are done
in the first pass.  Tiles of short documents are solved where they arise, those of
documents above ``LONG_CHARS`` are dealt over all tasks, so no task solves a whole
long document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetflow.functions.arrays import let
from assetflow.llm.common import materialise, text_of

MIN_WORDS = 12           # least words of a run
GRAM = MIN_WORDS // 2    # equalities in a row that every run has
BLOCK = 8                # boundaries in a tile
LONG_CHARS = 1 << 20
_FAR = np.iinfo(np.int64).max
_SEND_BYTES = 8 << 20


def row_key(id_col: str, text_col: str) -> Column:
    """md5 of (id, text): rows that repeat both are one document."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text_of(text_col)).cast("binary")))


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def _again(x: np.ndarray) -> np.ndarray:
    """Distance from each position to the next one with the same GRAM words (by hash: never too large)."""
    many = len(x) - GRAM + 1
    h = np.zeros(many, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[k:k + many].astype(np.uint64) + np.uint64(1)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    out = np.full(many, _FAR)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def active(x: np.ndarray):
    """``(P, step, boundaries)`` per octave with boundaries to solve."""
    n = len(x)
    if n < MIN_WORDS:
        return
    again = _again(x)
    if not (again < _FAR).any():
        return
    padded = np.concatenate([np.full(GRAM - 1, _FAR), again, np.full(GRAM - 1, _FAR)])     # padded[c:c + GRAM]: positions c - GRAM + 1 .. c
    low = 1
    while 2 * low <= n:
        step = max(low, GRAM)
        at = np.arange(0, n, step)
        near = np.minimum.reduce([padded[at + k] for k in range(GRAM)])
        hit = at[near < 2 * low]
        if len(hit):
            yield low, step, hit
        low *= 2


def tiles(x: np.ndarray):
    """``(P, first boundary, words before it, boundary mask, words)`` of the tiles of one document."""
    n = len(x)
    for low, step, hit in active(x):
        which, first = np.unique(hit // step // BLOCK, return_index=True)
        for block, of in zip(which.tolist(), np.split(hit, first[1:])):
            start = block * BLOCK * step
            left = max(0, start - 2 * step)
            last = start + (BLOCK - 1) * step
            mask = int(sum(1 << int(j) for j in (of - start) // step))
            yield low, start, start - left, mask, x[left:min(n, last + 2 * step + 2 * low)]


def z_function(x: list, limit: int) -> list:
    """Length of the longest common prefix of ``x`` and ``x[i:]`` for i below ``limit``."""
    n = len(x)
    limit = min(limit, n)
    z = [0] * limit
    if limit:
        z[0] = n
    lo = hi = 0
    for i in range(1, limit):
        k = 0
        if i < hi:
            k = z[i - lo]
            if k < hi - i:
                z[i] = k
                continue
            k = hi - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def _primes(limit: int) -> list[int]:
    """The smallest prime factor of every number below ``limit``."""
    least = list(range(limit))
    for a in range(2, int(limit ** 0.5) + 1):
        if least[a] == a:
            for b in range(a * a, limit, a):
                if least[b] == b:
                    least[b] = a
    return least


def solve(low: int, start: int, lead: int, mask: int, x: list, least: list[int]):
    """``(period, lo, hi)`` of a tile: for lo <= i < hi word i equals word i + period; clipped to the tile."""
    step = max(low, GRAM)
    reach, top = 2 * step, 2 * low
    for j in range(BLOCK):
        if not mask >> j & 1:
            continue
        c = lead + j * step
        ahead = x[c:c + reach + top]
        fore = z_function(ahead, top)
        back_words = x[max(0, c - reach):c][::-1]
        past = x[max(0, c - reach):c + top][::-1]
        z = z_function([*back_words, -1, *past], len(back_words) + 1 + len(past))
        right = len(past) - len(back_words)                      # words of the tile at and after c, top at most
        base = len(back_words) + 1 + right
        for p in range(low, min(top, len(fore), right + 1)):
            f = min(fore[p], reach)
            b = z[base - p] if p <= right and back_words else 0
            if f + b < p or f + b + p < MIN_WORDS:
                continue
            rest, whole = p, True
            while rest > 1:
                r = least[rest]
                q = p // r
                if fore[q] >= f + p - q and (not b or z[base - q] >= b):
                    whole = False
                    break
                while rest % r == 0:
                    rest //= r
            if whole:
                yield p, start + j * step - b, start + j * step + f


def _scan(batches):
    """Rows without a boundary to solve get their digest; the others keep their text."""
    for b in batches:
        text, digest = [], []
        for raw in b.column(2).to_pylist():
            words = (raw or b"").split()
            busy = next(active(numbered(words)), None) is not None
            text.append(raw if busy else None)
            digest.append(None if busy else hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.binary()), pa.array(digest, pa.string())],
                                         names=["doc_id", "key", "text", "plain"])


def _explode(batches):
    names = ["key", "octave", "start", "lead", "mask", "words"]
    types = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    for b in batches:
        rows, size = [], 0
        for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for low, start, lead, mask, x in tiles(numbered(raw.split())):
                rows.append((key, low, start, lead, mask, x.tobytes()))
                size += x.nbytes + 64
                if size > _SEND_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _solve(batches):
    least = [0, 1]
    for b in batches:
        keys, found = [], []
        for key, low, start, lead, mask, words in zip(*(c.to_pylist() for c in b.columns)):
            if len(least) < 2 * low:
                least = _primes(4 * low)
            here = list(solve(low, start, lead, mask, np.frombuffer(words, np.int32).tolist(), least))
            keys += [key] * len(here)
            found += here
        cols = np.array(found, np.int32).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array(cols[:, k]) for k in range(3))],
                                         names=["key", "period", "lo", "hi"])


def _finish(batches):
    for b in batches:
        out = []
        for doc_id, raw, runs in zip(*(c.to_pylist() for c in b.columns)):
            words = raw.split()
            drop = np.zeros(len(words) + 1, np.int32)
            runs = [(r["start"], r["length"], r["period"]) for r in runs or []]
            for start, length, period in runs:
                drop[start + period] += 1
                drop[start + length] -= 1
            gone = np.cumsum(drop)[:-1] > 0
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
            start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
            text = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            out.append((doc_id, len(runs), start, length, period, hashlib.sha256(text.encode()).hexdigest(),
                        hashlib.sha256(kept).hexdigest(), kept))
        types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.binary()]
        names = ["doc_id", "n_runs", "start", "length", "period", "runs_sha256", "collapsed_sha256", "collapsed"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*out)) or [()] * 8, types)], names=names)


def fragments(busy: DataFrame) -> DataFrame:
    """``(key, period, lo, hi)`` of all tiles of ``busy (key, text)``.

    Solving takes far longer than reading, so the rows are dealt over all shuffle partitions first.
    """
    tile = "key binary, octave int, start int, lead int, mask int, words binary"
    found = "key binary, period int, lo int, hi int"
    whole = busy.select("key", "text")
    size = F.octet_length("text")
    tasks = int(busy.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = whole.filter(size <= LONG_CHARS).repartition(tasks).mapInArrow(_explode, tile)
    dealt = whole.filter(size > LONG_CHARS).mapInArrow(_explode, tile).repartition("key", "octave", "start")
    return short.mapInArrow(_solve, found).union(dealt.mapInArrow(_solve, found))


def stitch(found: DataFrame) -> DataFrame:
    """``(key, runs)``: overlapping fragments of a (document, period) joined, runs sorted by start, then period."""
    order = Window.partitionBy("key", "period").orderBy("lo", "hi")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.distinct().withColumn("new", F.coalesce(F.col("lo") > reached, F.lit(True)).cast("int"))
    joined = (parts.withColumn("island", F.sum("new").over(order)).groupBy("key", "period", "island")
              .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    run = F.struct(F.col("lo").alias("start"), (F.col("hi") - F.col("lo") + F.col("period")).alias("length"), "period")
    return joined.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("lo"), "period", run.alias("run")))).alias("s")).select(
        "key", F.transform("s", lambda s: s["run"]).alias("runs"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Per row: ``n_runs``, the longest run and digests of all runs and of the text without the repeats.

    Columns ``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256``, and with ``texts`` the ``collapsed`` text itself, null where
    the text has no run and so stays as it is.  Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0; a word
    is dropped if any run holds it after the run's first period.  The longest run
    is given with ties going to the smallest start, then period; without a run the
    four columns are null.  A null or empty text has no words; ids may be null or
    repeat, every row is answered.  An empty table gives an empty result.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"),
                        F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = materialise(plain.mapInArrow(_scan, "doc_id long, key binary, text binary, plain string"), "runs-rows")
    busy = rows.filter("text is not null")
    runs = stitch(fragments(busy))
    met = busy.join(runs.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left").select("doc_id", "text", "runs")
    cols = ["doc_id", "n_runs", "start", "length", "period", "runs_sha256", "collapsed_sha256"]
    schema = "doc_id long, n_runs long, start long, length long, period long, runs_sha256 string, collapsed_sha256 string, collapsed binary"
    done = met.mapInArrow(_finish, schema).select(*cols, F.when(F.col("n_runs") > 0, F.col("collapsed").cast("string")).alias("collapsed"))
    none = F.lit(None).cast("long")
    quiet = rows.filter("text is null").select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), none.alias("start"), none.alias("length"), none.alias("period"),
        F.sha2(F.lit("").cast("binary"), 256).alias("runs_sha256"), F.col("plain").alias("collapsed_sha256"), F.lit(None).cast("string").alias("collapsed"))
    milli = F.expr("cast(1000 * length div period as long)")
    out = done.unionByName(quiet)
    return out.select(*cols[:5], milli.alias("exponent_milli"), *cols[5:], *(["collapsed"] if texts else []))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)`` with a periodic end put into every document whose crc32(id as text) is divisible by ten.

    With ``n`` words, ``g = floor(crc32 / 10)``, ``a = g % n`` and ``p = 1 + floor((n - a) / (3 + g % 8))``
    each word i >= a becomes word ``a + (i - a) % p``.  A null id counts as the empty text.
    """
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(text_of(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def turned(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10).cast("long")
        return let(F.struct(n.alias("n"), (g % n).alias("a"), g.alias("g")), lambda s: let(
            F.struct(s["n"].alias("n"), s["a"].alias("a"), (1 + F.floor((s["n"] - s["a"]) / (3 + s["g"] % 8))).alias("p")),
            lambda s: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), lambda i: F.get(
                w, F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int"))), " ")))

    return docs.select(F.col(id_col).alias("doc_id"), F.when(
        h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, turned(w)).otherwise(F.lit("")))).otherwise(F.col(text_col)).alias("text"))
