"""Mixture-controlled packing by deficit round-robin over source queues (operator 1).

Every window of ``window`` tokens takes from each source queue its target share.
What a share cannot take in whole tokens is a deficit carried to the next window.
Round-robin with carried deficits has a closed form: with cumulative shares
``C_s`` in queue order, after ``x`` tokens queue ``s`` has given
``floor(x C_s) - floor(x C_(s-1))``, within one token of its target.  So no task
has to walk the windows: a document's place in its queue fixes its windows and
offsets.  Places are prefix sums over (partition, queue) totals, which is how the
deficits cross partitions.

If explicit targets make queues run dry, a new phase begins: the shares of the
queues left are renormalised and the same form continues from there.

Sources holding at least ``1 / MAX_QUEUES`` of the rows or of the bytes are queues
of their own (at most ``2 * MAX_QUEUES`` by counting); the others share one queue,
the last.  Its order is an even spread: a source's tokens come in grains of ``GRAIN``,
grain ``g`` of ``size`` tokens at ``(g * GRAIN + phase * size) / total`` of the queue with
a phase hashed from the source.  So any stretch of the shared queue gives each of its
sources its share within one grain, however many there are.  Places of grains are
prefix sums over equal ranges of that quantile; no list of small sources is collected.
Token ids are written once to the scratch folder; the layout works on totals.
"""

from __future__ import annotations

import re
import zlib
from fractions import Fraction
from itertools import accumulate, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetflow.llm.common import materialise, text_of

WINDOW = 2048
END_ID = 1
MAX_QUEUES = 512
REST = "rest"
GRAIN = 128               # tokens of a small source in a row
_RANGE = 50_000           # grains sorted by one task
_CACHE = 400_000
_PLAIN = re.compile(r"[\x1c-\x1fɐ-\U0010ffff]|<\|")      # texts with these take the slow way
# and those with spaces beyond ASCII, or a letter whose lower case is two, are taken one by one
_ODD = r"[\x1c-\x1f\x{85}\x{a0}\x{130}\x{250}-\x{10ffff}]|<\|"
_SPACES = re.compile(r"[ \t\n\r]+")
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_CORE = r"^[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+$"
_MARKS = ".,!&%$*#|;:?"
_STEP = 50_000            # words of a text looked up together
_GROUP = 1 << 22          # bytes of texts split together


class WordIds(dict):
    """Ids (as bytes) of white-space separated words, by the tokenizer file's model; bounded.

    No token and no normalisation of the word-end BPE crosses white space, so a
    text's ids are its words' ids in order.  Words are kept without the marks behind
    them; those not known yet are learnt together: their letters in one call of the
    model, cut at the tokens that end a word.  ``self[word]`` expects lower case; ``exact`` takes a word as it stands.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers
        self.full = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.full.get_vocab_size() <= 1 << 16 else "<u4")
        # the same model for lower-case letters between spaces, a-z or any, where the file's other steps change nothing
        split = pre_tokenizers.WhitespaceSplit()
        self.ascii, self.letters = Tokenizer(self.full.model), Tokenizer(self.full.model)
        self.ascii.pre_tokenizer = split
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.full.get_vocab_size(), bool)
        self.ends[[k for token, k in self.full.get_vocab().items() if token.endswith(self.full.model.end_of_word_suffix or "\n")]] = True
        self.slow: dict[str, bytes] = {}

    def _pack(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def __missing__(self, word: str) -> bytes:
        return self.exact(word)

    def exact(self, word: str) -> bytes:
        if word not in self.slow:
            if len(self.slow) >= _CACHE:
                self.slow.clear()
            got = self._pack(self.full.encode(word, add_special_tokens=False).ids)
            if len(word) > 64:
                return got
            self.slow[word] = got
        return self.slow[word]

    def spelled(self, words: list[str], model) -> list[bytes]:
        """Ids of words of lower-case letters only."""
        ids = np.array(model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
        if len(cuts) != len(words):         # a model whose words do not end with such a token
            return [self.exact(w) for w in words]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def learn(self, words: list[str]) -> None:
        """Add the ids of new words without marks at their end; long ones are not kept."""
        plain = [w for w in words if w.isascii() and w.isalpha() and len(w) <= 64]
        wide = []
        for word in set(words).difference(plain) if len(plain) < len(words) else ():
            if len(word) > 64:
                continue
            if _LETTERS.fullmatch(word):
                wide.append(word)
            else:
                self[word] = self.exact(word)
        for some, model in ((plain, self.ascii), (wide, self.letters)):
            if some:
                self.update(zip(some, self.spelled(some, model)))

    def ids(self, words: pa.Array) -> pa.Array:
        """Ids of distinct lower-case words: marks after letters are taken off, as they are tokens of their own."""
        core = pc.utf8_rtrim(words, characters=_MARKS)
        core = pc.if_else(pc.match_substring_regex(core, _CORE), core, words)
        coded = core.dictionary_encode()
        cores = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.get, cores))
        new = [k for k, ids in enumerate(got) if ids is None]
        if new:
            if len(self) + len(new) > _CACHE:
                self.clear()
            self.learn([cores[k] for k in new])
            for k in new:
                got[k] = self[cores[k]]
        ids = pa.array(got, pa.large_binary()).take(coded.indices)
        marks = pc.not_equal(pc.binary_length(words), pc.binary_length(core))
        if pc.any(marks).as_py():
            full, bare = (x.filter(marks).to_numpy(zero_copy_only=False).tolist() for x in (words, core))
            tails = pa.array([self.exact(w[len(c):]) for w, c in zip(full, bare)], pa.large_binary())
            none = pa.scalar(b"", pa.large_binary())
            ids = pc.binary_join_element_wise(ids, pc.replace_with_mask(pa.repeat(none, len(words)), marks, tails), none)
        return ids

    def text(self, text: str) -> bytes:
        if _PLAIN.search(text):
            return b"".join([self.exact(w) for w in _SPACES.split(text) if w])
        words, got = text.lower().split(), []
        for at in range(0, len(words), _STEP):
            some = pa.array(words[at:at + _STEP], pa.large_string()).dictionary_encode()
            got += self.ids(some.dictionary).take(some.indices).to_pylist()
        return b"".join(got)

    def texts(self, texts: pa.Array) -> list[bytes]:
        """Ids of many texts: they are split, and their distinct words numbered, as Arrow arrays."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        odd = odd | (size > _GROUP)
        out: list[bytes] = [b""] * len(texts)
        for at in np.flatnonzero(odd).tolist():
            out[at] = self.text(texts[at].as_py())
        even = np.flatnonzero(~odd)
        for group in np.split(even, np.flatnonzero(np.diff(np.cumsum(size[even], dtype=np.int64) // _GROUP)) + 1):
            if len(group):
                self._group(texts.take(pa.array(group)), group.tolist(), out)
        return out

    def _group(self, texts: pa.Array, places: list[int], out: list[bytes]) -> None:
        split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        words = split.flatten().dictionary_encode()
        if not len(words):
            return
        ids = self.ids(words.dictionary).take(words.indices)
        _, ends, data = ids.buffers()
        cuts = np.frombuffer(ends, np.int64)[np.asarray(split.offsets)].tolist()
        raw = memoryview(data)
        for at, a, b in zip(places, cuts, cuts[1:]):
            out[at] = raw[a:b].tobytes()


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def tokenise(docs: DataFrame, queues: list[str], path: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(doc_id, queue, small, part, before, n, ids)``: ids packed little-endian, ``before`` = tokens of the source earlier in the partition.

    ``queue`` is null and ``small`` the source (``''`` if null) for sources without a queue of their own.
    """
    own = set(queues)

    def run(batches):
        words, part, used = word_ids(path), TaskContext.get().partitionId(), {}
        end = np.array([END_ID], words.dtype).tobytes()
        for b in batches:
            queue, small, before, n, ids = [], [], [], [], []
            for got, source in zip(words.texts(b.column(1)), b.column(2).to_pylist()):
                got += end
                q = (source, "") if source in own else (None, source or "")
                queue.append(q[0]), small.append(q[1]), before.append(used.get(q, 0)), ids.append(got), n.append(len(got) // words.dtype.itemsize)
                used[q] = before[-1] + n[-1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(queue, pa.string()), pa.array(small, pa.string()), pa.array([part] * len(n), pa.int32()),
                 pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "queue", "small", "part", "before", "n", "ids"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"), F.col(source_col).cast("string").alias("s"))
    return plain.mapInArrow(run, "doc_id long, queue string, small string, part int, before long, n long, ids binary")


def phases(totals: list[int], weights: list[Fraction]) -> list[tuple[int, list[int], list[int]]]:
    """Per phase: stream position where it starts, tokens each queue gave before it, tokens each gives in it."""
    done, at, out = [0] * len(totals), 0, []
    while any(d < t for d, t in zip(done, totals)):
        live = [s for s in range(len(totals)) if done[s] < totals[s]]
        share = {s: weights[s] for s in live}
        if not any(share.values()):
            share = {s: Fraction(totals[s] - done[s]) for s in live}       # targets spent: what is left, in proportion
        span = min(Fraction(totals[s] - done[s]) / share[s] for s in live if share[s])
        give = [0] * len(totals)
        for s in live:
            give[s] = min(totals[s] - done[s], round(span * share[s]))
        out.append((at, done, give))
        done = [d + g for d, g in zip(done, give)]
        at += sum(give)
    return out


class Layout:
    """Where each queue's tokens fall; exact integers, at most MAX_QUEUES + 1 queues."""

    def __init__(self, totals: list[int], weights: list[Fraction], window: int):
        self.window, self.steps = window, phases(totals, weights)
        self.upto = [[0, *accumulate(give)] for _, _, give in self.steps]

    def pieces(self, s: int, place: int, n: int):
        """(window, offset, length) of queue ``s``'s tokens ``place .. place + n``, in order."""
        end = place + n
        for (at, done, give), upto in zip(self.steps, self.upto):
            lo, hi = max(place, done[s]), min(end, done[s] + give[s])
            if lo >= hi:
                continue
            total, a, b = upto[-1], upto[s], upto[s + 1]

            def given(x: int) -> int:      # tokens of s among the phase's first x
                return x * b // total - x * a // total

            # the window in which token lo of this phase falls: given(x) tracks x * (b - a) / total within one
            x = max(0, (lo - done[s] - 1) * total // (b - a))
            k = (at + x) // self.window
            while lo < hi:
                left, right = max(k * self.window, at) - at, min((k + 1) * self.window - at, total)
                first, last = given(left), given(right)
                if done[s] + last > lo:
                    take = min(hi, done[s] + last) - lo
                    start = right * a // total - left * a // total      # tokens of queues before s in this window
                    yield k, (at + left) % self.window + start + (lo - done[s] - first), take
                    lo += take
                k += 1


def spread(sums: DataFrame, total: int) -> DataFrame:
    """``(gq, gs, g, at)``: where grain ``g`` of each source of ``(queue, small, n)`` begins in the shared queue of ``total`` tokens."""
    phase = F.pmod(F.xxhash64("queue", "small"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    size = F.least(F.lit(GRAIN), F.col("n") - F.col("g") * GRAIN)
    ranges = total // (GRAIN * _RANGE) + 1
    grains = (sums.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {GRAIN}"))))
              .select("queue", "small", "g", size.alias("size"), ((F.col("g") * GRAIN + phase * size) / F.col("n")).alias("key"))
              .withColumn("range", F.floor(F.col("key") * ranges)))
    grains = materialise(grains, "packing-grains")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    bases = (grains.groupBy("range").agg(F.sum("size").alias("n"))
             .select(F.col("range").alias("brange"), F.coalesce(F.sum("n").over(earlier.orderBy("range")), F.lit(0)).alias("base")))
    inside = F.coalesce(F.sum("size").over(earlier.partitionBy("range").orderBy("key", "queue", "small", "g")), F.lit(0))
    placed = grains.withColumn("inside", inside).join(bases, F.col("range") == F.col("brange"))
    return materialise(placed.select(F.col("queue").alias("gq"), F.col("small").alias("gs"), "g", (F.col("base") + F.col("inside")).alias("at")), "packing-spread")


def shared(placed: DataFrame, grains: DataFrame, wide: int) -> DataFrame:
    """Rows of the shared queue cut at the grains of their source, with their places in the shared queue."""
    end = F.col("place") + F.col("n")

    def piece(g):
        lo, hi = F.greatest(F.col("place"), g * GRAIN), F.least(end, (g + 1) * GRAIN)
        skip = lo - F.col("place")
        return F.struct(g.alias("g"), skip.alias("skip"), (lo - g * GRAIN).alias("into"), (hi - lo).alias("n"),
                        F.substring(F.col("ids"), (skip * wide + 1).cast("int"), ((hi - lo) * wide).cast("int")).alias("ids"))
    cut = placed.select("doc_id", "queue", "small", F.col("n").alias("whole"), F.explode_outer(F.transform(
        F.sequence(F.expr(f"place div {GRAIN}"), F.expr(f"(place + n - 1) div {GRAIN}")), piece)).alias("p"))
    cut = cut.select("doc_id", "queue", "small", "whole", F.col("p.g").alias("pg"), F.col("p.skip").alias("skip"), F.col("p.into").alias("into"),
                     F.col("p.n").alias("n"), F.col("p.ids").alias("ids"))
    met = cut.join(grains, F.col("queue").eqNullSafe(F.col("gq")) & (F.col("small") == F.col("gs")) & (F.col("pg") == F.col("g")))
    return met.select("doc_id", F.lit(None).cast("string").alias("queue"), (F.col("at") + F.col("into")).alias("place"), "n", "ids", "skip", "whole")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, targets: dict[str, float] | None = None,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source_queue`` (and ``ids`` on request).

    ``targets`` maps sources to relative weights; sources without one have weight
    0 and come last.  None: every window mirrors the corpus.  All sequences but
    the last are full, so nothing is padded but the last.  A null text is empty
    (one end token); a null source, like a small one, goes to the shared queue;
    repeated rows are packed each; an empty table gives no rows.  In the shared queue a
    null source is the source ``''``.
    """
    weigh = docs.groupBy(F.col(source_col).cast("string").alias("s")).agg(F.count("*").alias("rows"), F.sum(F.octet_length(text_of(text_col))).alias("bytes"))
    all_of = weigh.agg(F.sum("rows").alias("all_rows"), F.sum("bytes").alias("all_bytes"))
    large = weigh.crossJoin(F.broadcast(all_of)).filter(      # one row beside each source
        F.col("s").isNotNull() & ((F.col("rows") * MAX_QUEUES >= F.col("all_rows")) | (F.col("bytes") * MAX_QUEUES >= F.col("all_bytes"))))
    queues = sorted({r["s"] for r in large.select("s").collect()} | set(targets or {}))      # at most 2 * MAX_QUEUES + targets

    ids = materialise(tokenise(docs, queues, tokenizer, id_col, text_col, source_col), "packing-ids")
    parts = materialise(ids.groupBy("queue", "small", "part").agg(F.sum("n").alias("n")), "packing-parts")
    sums = {r["queue"]: r["n"] for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    total = sum(sums.values())
    # own queues below one token a window join the shared queue, so that shares stay monotone
    small = [] if targets else [q for q in queues if sums.get(q, 0) * window < total]
    order = [q for q in queues if q not in small]
    rest = sum(sums.get(q, 0) for q in [*small, None])
    totals = [*(sums.get(q, 0) for q in order), rest]
    weights = [Fraction(targets.get(q, 0)) for q in order] + [Fraction(0)] if targets else [Fraction(t) for t in totals]
    layout = Layout(totals, weights, window)
    at = {**{q: k for k, q in enumerate(order)}, None: len(order)}
    wide = word_ids(tokenizer).dtype.itemsize

    before = Window.partitionBy("queue", "small").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = materialise(parts.select(F.col("queue").alias("bq"), F.col("small").alias("bs"), F.col("part").alias("bp"),
                                    F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-base")
    placed = ids.join(base, F.col("queue").eqNullSafe(F.col("bq")) & (F.col("small") == F.col("bs")) & (F.col("part") == F.col("bp"))).select(
        "doc_id", "queue", "small", (F.col("base") + F.col("before")).alias("place"), "n", "ids")
    if rest:
        tail = F.col("queue").isNull() | F.col("queue").isin(small)
        grains = spread(parts.filter(tail).groupBy("queue", "small").agg(F.sum("n").alias("n")), rest)
        own = placed.filter(~tail).select("doc_id", "queue", "place", "n", "ids", F.lit(0).cast("long").alias("skip"), F.col("n").alias("whole"))
        placed = own.unionByName(shared(placed.filter(tail), grains, wide))
    else:
        placed = placed.select("doc_id", "queue", "place", "n", "ids", F.lit(0).cast("long").alias("skip"), F.col("n").alias("whole"))

    def cut(batches):
        kind = word_ids(tokenizer).dtype
        for b in batches:
            rows = []
            for doc, queue, place, n, raw, skip, whole in zip(*(b.column(k).to_pylist() for k in range(7))):
                got = np.frombuffer(raw, kind).astype("<u4").tobytes()
                start = 0
                for k, offset, take in layout.pieces(at[queue], place, n):
                    piece = got[4 * start:4 * (start + take)]
                    rows.append((doc, skip + start, take, zlib.crc32(piece), whole, k, offset, REST if queue is None else queue, piece if keep_ids else None))
                    start += take
                if len(rows) >= 50_000:
                    yield _batch(rows, keep_ids)
                    rows = []
            yield _batch(rows, keep_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source_queue string"
    return placed.mapInArrow(cut, schema + (", ids binary" if keep_ids else ""))


def _batch(rows: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source_queue", "ids"]
    columns = list(zip(*rows)) or [()] * len(names)
    kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]
    many = len(names) if keep_ids else len(names) - 1
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:many], kinds)], names=names[:many])
