"""Substring deduplication by content-defined chunking (operator 3).

A chunk ends where the gear rolling hash of the last ``REACH`` bytes is the largest
within ``SPREAD`` bytes on either side, so cuts depend on content only: inside an
inserted or shared passage they fall into step after ``SPREAD`` bytes.  Chunks are
deduplicated by a 128-bit digest: the first occurrence by (doc_id, row key, start) is
kept, later ones are repeats.  The row key names equal (id, text) rows alike, so texts
that share an id, or have none, stay apart.

Adjacent repeats form a group, and a group grows on both sides for as long as the
text equals the text beside one of its kept copies, so spans end where the passage
ends and not where a chunk does.  Spans of at least ``min_chars`` characters are
reported or removed, so short common phrases stay.  What is removed always has an
equal copy earlier in the order above.

Only 64-bit halves are counted first; full chunk rows travel only if their half
occurs twice.  A hot chunk is pre-aggregated, and its join partition can be split.
Text is shuffled once, to cut out what lies beside the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetflow.llm.common import materialise, pieces, text_of

# Chunks of about 44 bytes: 51 words of four letters (255 characters) hold a whole one even if badly placed.
SPREAD, MAX_BYTES, REACH = 24, 256, 8
MIN_CHARS = 100                                             # about 16 words
BESIDE = 256                                                # characters compared at once beside a group
_BLOCK = 1 << 20
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


def _rolled(a: np.ndarray) -> np.ndarray:
    """Gear hash of the last REACH bytes at every position, by doubling."""
    h = GEAR[a]
    step = 1
    while step < REACH:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def _candidates(a: np.ndarray) -> np.ndarray:
    """Positions after a hash larger than the SPREAD before it and no smaller than the SPREAD behind it."""
    edge = np.zeros(SPREAD, np.uint32)
    h = np.concatenate([edge, _rolled(a), edge])
    most, width = h, 1
    while 2 * width <= SPREAD:
        most = np.maximum(most[:-width], most[width:])
        width *= 2
    most = np.maximum(most[:len(most) - (SPREAD - width)], most[SPREAD - width:])      # most[i]: of h[i:i + SPREAD]
    here = h[SPREAD:SPREAD + len(a)]
    return np.flatnonzero((here > most[:len(a)]) & (here >= most[SPREAD + 1:SPREAD + 1 + len(a)])) + 1


def cuts(raw: bytes) -> list[int]:
    """Chunk ends of a UTF-8 text; never inside a character."""
    a = np.frombuffer(raw, np.uint8)
    out, last, n = [], 0, len(a)

    def whole(at: int) -> int:
        while at < n and raw[at] & 0xC0 == 0x80:
            at += 1
        return at

    for at in range(0, n, _BLOCK):
        lead = min(at, REACH - 1 + SPREAD)
        c = _candidates(a[at - lead:at + _BLOCK + SPREAD]) + at - lead
        for cut in c[(c > at) & (c <= at + _BLOCK)].tolist():
            cut = whole(cut)
            while cut - last > MAX_BYTES:
                last = whole(last + MAX_BYTES)
                out.append(min(last, cut))
                last = out[-1]
            if last < cut < n:
                out.append(cut)
                last = cut
    while n > last:
        last = whole(min(last + MAX_BYTES, n))
        out.append(last)
    return out


def row_key(id_col: str, text_col: str) -> Column:
    """md5 of (id, text)."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text_of(text_col)).cast("binary")))


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, key, lo, hi, start, size, last)``, arrays but for the first two, per row: digest halves, first
    character and characters of each chunk, and whether the text ends with it."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())

    def run(batches):
        for b in pieces(batches):
            cols = [[] for _ in kinds]
            for raw in b.column(2).to_pylist():
                ends = cuts(raw or b"")
                begins = [0, *ends[:-1]] if ends else []
                d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(begins, ends)]), "<i8").reshape(-1, 2)
                chars = np.r_[0, np.cumsum((np.frombuffer(raw or b"", np.uint8) & 0xC0) != 0x80)]
                row = d[:, 0], d[:, 1], chars[begins].astype(np.int32), (chars[ends] - chars[begins]).astype(np.int32), np.arange(len(ends)) == len(ends) - 1
                for c, v in zip(cols, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, pa.list_(k)) for v, k in zip(cols, kinds))],
                                             names=["doc_id", "key", "lo", "hi", "start", "size", "last"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return plain.mapInArrow(run, "doc_id long, key binary, lo array<long>, hi array<long>, start array<int>, size array<int>, last array<boolean>")


def groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(key, lo, doc_id, hi, n, first_id, last, sources)`` of adjacent repeated chunks.

    ``sources`` has the ``(key, shift)`` of the kept copies: character i equals character ``i - shift`` of that row's text.
    """
    table = chunk(docs, id_col, text_col)      # cut twice: digests of small chunks take more room than the texts
    twice = table.select(F.explode("lo").alias("half")).groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    twice = materialise(twice, "cdc-twice")
    rows = (table.select("doc_id", "key", F.explode(F.arrays_zip("lo", "hi", "start", "size", "last")).alias("c"))
            .select("doc_id", "key", *[F.col(f"c.{x}").alias(x) for x in ("lo", "hi", "start", "size", "last")]))
    cand = materialise(rows.join(twice, rows["lo"] == twice["half"]).drop("half"), "cdc-candidates")
    here = F.struct("doc_id", "key", "start")
    first = (cand.groupBy("lo", "hi").agg(F.min(here).alias("first"), F.count("*").alias("n")).filter("n > 1")
             .select(F.col("lo").alias("flo"), F.col("hi").alias("fhi"), "first"))
    first = materialise(first, "cdc-first")
    again = (cand.join(first, (F.col("lo") == F.col("flo")) & (F.col("hi") == F.col("fhi")))
             .filter(~here.eqNullSafe(F.col("first")))
             .select("doc_id", "key", "start", (F.col("start") + F.col("size")).alias("end"), "last", F.col("first.doc_id").alias("from_id"),
                     F.struct(F.col("first.key").alias("key"), (F.col("start") - F.col("first.start")).alias("shift")).alias("source"))
             .distinct())      # rows that repeat an id and a text
    order = Window.partitionBy("key").orderBy("start")
    broken = F.coalesce(F.lag("end").over(order) != F.col("start"), F.lit(True)).cast("int")
    runs = again.withColumn("new", broken).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("key", "run").agg(
        F.min("start").alias("lo"), F.min("doc_id").alias("doc_id"), F.max("end").alias("hi"), F.count("*").alias("n"),
        F.min_by("from_id", "start").alias("first_id"), F.max("last").alias("last"), F.collect_set("source").alias("sources")).drop("run")


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _beside(docs: DataFrame, spots: DataFrame, id_col: str, text_col: str, reach: int) -> DataFrame:
    """``(key, pos, fore, words)``: up to ``reach`` characters from ``pos`` on, or before it and reversed, per row of ``spots (key, pos, fore)``."""
    asked = spots.groupBy("key").agg(F.collect_set(F.struct("pos", "fore")).alias("asked")).withColumnRenamed("key", "of")
    plain = docs.select(row_key(id_col, text_col).alias("key"), text_of(text_col).alias("t"))

    def run(batches):
        for b in pieces(batches):
            out = []
            for key, t, asked in zip(*(c.to_pylist() for c in b.columns)):
                for at in asked:
                    pos = at["pos"]
                    out.append((key, pos, at["fore"], t[pos:pos + reach] if at["fore"] else t[max(0, pos - reach):pos][::-1]))
            types = (pa.binary(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*out)) or [()] * 4, types)], names=["key", "pos", "fore", "words"])

    found = plain.join(asked, F.col("key") == F.col("of")).select("key", "t", "asked").mapInArrow(run, "key binary, pos int, fore boolean, words string")
    return found.groupBy("key", "pos", "fore").agg(F.first("words").alias("words"))      # rows that repeat an id and a text


def grown(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, beside: int = BESIDE) -> DataFrame:
    """``found`` with ``lo`` and ``hi`` moved outwards as far as the text equals that beside a kept copy.

    Sides that are equal over all compared characters go to another round with longer pieces; few rows do.
    """
    source = found.select("key", "lo", "hi", "last", F.explode("sources").alias("s"))
    left = source.filter("lo > 0 and lo > s.shift").select("key", "lo", F.lit(False).alias("fore"), F.col("lo").alias("pos"), "s")
    right = source.filter("not last").select("key", "lo", F.lit(True).alias("fore"), F.col("hi").alias("pos"), "s")
    ends = materialise(left.union(right).select("key", "lo", "fore", "pos", F.col("s.key").alias("from_key"), (F.col("pos") - F.col("s.shift")).alias("from_pos")), "cdc-ends")
    done, reach = None, beside
    while True:
        spots = ends.select("key", "pos", "fore").union(ends.select("from_key", "from_pos", "fore")).distinct()
        words = materialise(_beside(docs, spots, id_col, text_col, reach), "cdc-beside")
        own = words.select(F.col("key").alias("k1"), F.col("pos").alias("p1"), F.col("fore").alias("f1"), F.col("words").alias("mine"))
        other = words.select(F.col("key").alias("k2"), F.col("pos").alias("p2"), F.col("fore").alias("f2"), F.col("words").alias("kept"))
        met = (ends.join(own, (F.col("key") == F.col("k1")) & (F.col("pos") == F.col("p1")) & (F.col("fore") == F.col("f1")))
               .join(other, (F.col("from_key") == F.col("k2")) & (F.col("from_pos") == F.col("p2")) & (F.col("fore") == F.col("f2"))))

        def run(batches):
            for b in pieces(batches):
                same = [common(x, y) for x, y in zip(b.column(6).to_pylist(), b.column(7).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(same, pa.int32())], names=[*b.schema.names[:6], "same"])

        names = ["key", "lo", "fore", "pos", "from_key", "from_pos"]
        got = materialise(met.select(*names, "mine", "kept").mapInArrow(
            run, "key binary, lo int, fore boolean, pos int, from_key binary, from_pos int, same int"), "cdc-grown")
        reached = F.when(F.col("fore"), F.col("pos") + F.col("same")).otherwise(F.col("pos") - F.col("same"))
        here = got.select("key", "lo", "fore", reached.alias("to"))
        done = here if done is None else done.union(here)
        step = F.when(F.col("fore"), F.lit(reach)).otherwise(F.lit(-reach))
        rest = got.filter(F.col("same") == reach).select("key", "lo", "fore", (F.col("pos") + step).alias("pos"), "from_key", (F.col("from_pos") + step).alias("from_pos"))
        if rest.isEmpty():
            break
        ends, reach = rest, min(reach * 32, 1 << 26)
    far = done.groupBy(F.col("key").alias("k"), F.col("lo").alias("l")).agg(
        F.min(F.when(~F.col("fore"), F.col("to"))).alias("left"), F.max(F.when(F.col("fore"), F.col("to"))).alias("right"))
    return (found.join(far, (F.col("key") == F.col("k")) & (F.col("lo") == F.col("l")), "left")
            .select("key", "doc_id", F.coalesce("left", "lo").alias("lo"), F.coalesce("right", "hi").alias("hi"), "n", "first_id"))


def _spans(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``repeated_spans`` with the row's ``key``."""
    found = materialise(groups(docs, id_col, text_col), "cdc-groups")
    wide = grown(docs, found, id_col, text_col)
    order = Window.partitionBy("key").orderBy("lo", "hi")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = wide.withColumn("new", F.coalesce(F.col("lo") >= reached, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(order))
    return (parts.groupBy("key", "span").agg(
        F.min("doc_id").alias("doc_id"), F.min("lo").alias("span_start"), F.max("hi").alias("span_end"), F.sum("n").alias("n_chunks"),
        F.min_by("first_id", "lo").alias("first_doc_id"))
        .filter(F.col("span_end") - F.col("span_start") >= min_chars).drop("span"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, span_start, span_end, n_chunks, first_doc_id)``: spans that occurred before, in characters, end exclusive.

    ``first_doc_id`` holds the kept copy of the span's first chunk, ``n_chunks`` counts whole repeated chunks.
    Null and empty texts have no chunks.  Rows that repeat an id and a text are one
    document; different texts are different documents, also under one id or none.
    A null id is smaller than the rest.
    """
    return _spans(docs, id_col, text_col, min_chars).drop("key")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text_col``; other columns and null texts stay as they are."""
    spans = _spans(docs, id_col, text_col, min_chars)
    cut = spans.groupBy(F.col("key").alias("__id")).agg(F.sort_array(F.collect_list(F.struct("span_start", "span_end"))).alias("__cut"))
    kept = F.concat(
        F.array_join(F.transform("__cut", lambda s, i: F.substring(
            F.col(text_col), F.when(i == 0, 0).otherwise(F.get(F.col("__cut"), i - 1)["span_end"]) + 1,
            s["span_start"] - F.when(i == 0, 0).otherwise(F.get(F.col("__cut"), i - 1)["span_end"]))), ""),
        F.substring(F.col(text_col), F.element_at("__cut", -1)["span_end"] + 1, F.length(text_col)))
    met = docs.withColumn("__own", row_key(id_col, text_col)).join(cut, F.col("__own") == F.col("__id"), "left")
    return met.withColumn(text_col, F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)
