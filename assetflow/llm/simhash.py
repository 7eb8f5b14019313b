"""SimHash near-duplicates with a bit-sliced comparison (operator 10).

1. Every whole text gets a 64-bit fingerprint over word shingles.
2. Equal fingerprints collapse; only distinct fingerprints are compared.
3. The 64 bits are cut into ``radius + 2`` blocks.  Two fingerprints at most
   ``radius`` bits apart agree on at least two whole blocks, so they meet in a
   bucket keyed by a pair of blocks: no link can be missed.
4. Inside buckets fingerprints lie vertically, one bit plane per position.
   For each shift, one XOR per plane yields 64 pairs per machine word; a
   carry-save counter with an overflow plane sums the differing bits, and
   blocks of pairs are abandoned once all of them exceed the radius.
5. A bucket reports a spanning star of its linked fingerprints, never all pairs.
   Buckets larger than ``TILE`` are dealt as pairs of hash tiles, so no task
   holds a whole hot bucket, and every pair still meets in one tile pair.
6. Star contractions give the components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.llm.common import materialise, text_of
from assetflow.llm.components import components

BITS = 64
SEED = 42
TILE = 2048            # fingerprints in one hash tile of a hot bucket
_CHUNK = 1 << 15       # shingles hashed at a time: memory stays flat on very long texts
_BLOCK = 16            # words (of 64 pairs) that are abandoned together
_PACKED = 1 << 17      # fingerprints compared at a time: a batch of many hot buckets stays within memory


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit fingerprint of a UTF-8 text; 0 when it has no word."""
    words = text.lower().split()      # bytes: A-Z only, and exactly the white space \\x20 \\x09-\\x0D
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at:at + _CHUNK + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle))))
        h = np.array([digest(g, SEED) for g in grams], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 mark: Column | None = None) -> DataFrame:
    """``(id, fp)`` for every row; null texts have no words (fingerprint 0).  ``mark``, binary, is carried along."""
    def run(batches):
        for b in batches:
            got = [fingerprint(t or b"", shingle) for t in b.column(1).to_pylist()]
            fp = pa.array(np.array(got, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), fp, *b.columns[2:]], names=["id", "fp", "mark"][:b.num_columns])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"),
                        *([] if mark is None else [mark.alias("mark")]))
    return plain.mapInArrow(run, "id long, fp long" + ("" if mark is None else ", mark binary"))


def _block_keys(fp: Column, radius: int) -> list[Column]:
    """One long per pair of blocks: the pair's number above its bits."""
    n = radius + 2
    edges = [BITS * k // n for k in range(n + 1)]
    part = [F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) for k in range(n)]
    width = [edges[k + 1] - edges[k] for k in range(n)]
    return [F.lit(no << 48 if width[i] + width[j] <= 48 else no).bitwiseXOR(
        F.shiftleft(part[i], width[j]).bitwiseOR(part[j])) for no, (i, j) in enumerate(combinations(range(n), 2))]


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) uint64: bit ``r`` of word ``w`` in plane ``p`` is bit ``p`` of fingerprint ``64 w + r``."""
    n = len(fps)
    bits = np.zeros((-(-n // 64) * 64 + 64, BITS), np.uint8)
    bits[:n] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _within(x: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """Bit mask of the pairs in ``valid`` whose planes ``x`` (64, words) hold at most ``radius`` ones."""
    depth = max(1, int(radius).bit_length())
    words = x.shape[1]
    out = np.zeros(words, np.uint64)
    live = np.flatnonzero(valid.reshape(-1, _BLOCK).any(axis=1))
    pick = (live[:, None] * _BLOCK + np.arange(_BLOCK)).ravel()
    x, ok = x[:, pick], valid[pick]
    count = [np.zeros(len(pick), np.uint64) for _ in range(depth)]
    over = np.zeros(len(pick), np.uint64)
    for p in range(BITS):
        carry = x[p]
        for k in range(depth):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if p % 8 == 7 and p < BITS - 1:
            keep = (ok & ~over).reshape(-1, _BLOCK).any(axis=1)
            if not keep.any():
                return out
            if not keep.all():
                sel = np.repeat(keep, _BLOCK)
                x, ok, over, pick = x[:, sel], ok[sel], over[sel], pick[sel]
                count = [c[sel] for c in count]
    above = np.zeros(len(pick), np.uint64)      # count > radius, from the highest counter plane down
    equal = ~above
    for k in reversed(range(depth)):
        if radius >> k & 1:
            equal = equal & count[k]
        else:
            above, equal = above | (equal & count[k]), equal & ~count[k]
    out[pick] = ok & ~over & ~above
    return out


def linked(fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars ``(member, head)`` over rows that share a bucket and lie within ``radius``.

    Rows of a bucket must be adjacent.  Returns row positions.
    """
    n = len(fps)
    planes = _planes(fps)
    words = planes.shape[1]
    head = np.arange(n)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    longest = int(np.diff(np.r_[starts, n]).max(initial=0))
    pad = -words % _BLOCK
    for d in range(1, longest):
        same = bucket[:n - d] == bucket[d:]
        valid = np.zeros((words + pad) * 64, np.uint8)
        valid[:n - d] = same
        valid = np.packbits(valid, bitorder="little").view(np.uint64)
        w, r = divmod(d, 64)
        far = np.zeros((BITS, words + pad + 1), np.uint64)
        far[:, :words - w] = planes[:, w:]
        moved = far[:, :-1] if r == 0 else (far[:, :-1] >> np.uint64(r)) | (far[:, 1:] << np.uint64(64 - r))
        moved[:, :words] ^= planes
        hits = _within(moved, valid, radius)
        if not hits.any():
            continue
        i = np.flatnonzero(np.unpackbits(hits.view(np.uint8), bitorder="little"))
        for a, b in zip(i[head[i] != head[i + d]], (i + d)[head[i] != head[i + d]]):
            x, y = sorted((int(head[a]), int(head[b])))
            if x != y:
                head[head == y] = x
    member = np.flatnonzero(head != np.arange(n))
    return member, head[member]


def links(distinct_fps: DataFrame, radius: int = 3) -> DataFrame:
    """Stars ``(a, b)`` of linked fingerprints from a table of distinct ones (column ``fp``)."""
    keyed = distinct_fps.select("fp", F.explode(F.array(*_block_keys(F.col("fp"), radius))).alias("key"))
    busy = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("key", "busy")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    met = keyed.join(busy, F.col("key") == F.col("busy")).withColumn("t", tiles).withColumn("own", own)
    others = F.filter(F.sequence(F.lit(0), F.col("t") - 1), lambda u: (u != F.col("own")) | (F.col("t") == 1))
    dealt = met.withColumn("other", F.explode(others)).select(
        "fp", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    packs = dealt.groupBy("key", "lo", "hi").agg(F.sort_array(F.collect_list("fp")).alias("fps")).select("fps")

    def run(batches):
        for b in batches:
            column = b.column(0)
            size = np.diff(column.offsets.to_numpy())
            fps = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            bucket = np.repeat(np.arange(len(size)), size)
            grade = np.repeat(np.frexp(size)[1], size)    # similar sizes together: few idle shifts
            a, c = [], []
            for g in np.unique(grade):
                rows = np.flatnonzero(grade == g)
                starts = np.flatnonzero(np.r_[True, bucket[rows][1:] != bucket[rows][:-1]])      # whole buckets at a time
                starts = starts[np.unique(starts // _PACKED, return_index=True)[1]]
                for part in np.split(rows, starts[1:]):
                    member, head = linked(fps[part], bucket[part], radius)
                    a.append(fps[part][member]), c.append(fps[part][head])
            done = [np.concatenate(v).view(np.int64) if v else np.zeros(0, np.int64) for v in (a, c)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in done], names=["a", "b"])

    return packs.mapInArrow(run, "a long, b long").distinct()


def _roots(fps: DataFrame, radius: int, low: Column) -> tuple[DataFrame, DataFrame]:
    """``(fp, low, root)`` per distinct fingerprint of a written table, and ``(root, low)`` per group of linked ones."""
    groups = materialise(fps.groupBy("fp").agg(F.min(low).alias("low")), "simhash-groups")
    roots = components(links(groups.select("fp"), radius))
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "simhash-roots")
    return rooted, rooted.groupBy("root").agg(F.min("low").alias("low"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Texts link when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id reachable over links, the row's own
    included.  Texts without words have fingerprint zero and link like any
    other; rows with a null id take part and get the component's smallest
    non-null id (null if it has none); an id that occurs twice is two rows.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    rooted, lowest = _roots(fps, radius, F.col("id"))
    lowest = lowest.select("root", F.col("low").alias("component_id"))
    classes = materialise(rooted.join(lowest, "root").select(F.col("fp").alias("cfp"), "component_id"), "simhash-classes")
    return fps.join(classes, fps["fp"] == classes["cfp"]).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of ``docs``, with all its columns, per group of linked texts.

    The smallest id stays (a null id only where no row of the group has one); of
    different texts with that id the one with the smallest digest, of rows that
    repeat both any one.  Groups, not ids, are counted: two texts without an id, or
    with the same one, both stay unless they are linked.
    """
    names = docs.columns
    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text_of(text_col)).cast("binary")))
    fps = materialise(fingerprints(docs, id_col, text_col, shingle, key), "simhash")
    low = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")
    heads = materialise(_roots(fps, radius, low)[1].select(F.col("low.mark").alias("__head")).distinct(), "simhash-heads")
    # repeated rows collapse before they are shuffled; the join then finds its key's partitioning in place
    once = docs.withColumn("__key", key).dropDuplicates(["__key"])
    return once.join(heads, F.col("__key") == F.col("__head"), "left_semi").select(*[F.col(f"`{c}`") for c in names])
