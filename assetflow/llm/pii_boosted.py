"""Personal data by candidate gradient boosting (operator 4), DataFrame functions only.

Base patterns with validators (e-mail, IP, card with Luhn check, phone) always
count.  Beyond them, generators with high recall propose overlapping spans: any
``x@y`` token, addresses spelled out with *at* and *dot*, any run of digits with and
without separators, any four short digit groups, any international dialling form,
IPv6 forms, and any token of twelve or more letters and digits (keys, passwords).

Labels are weak and come from labellers that do not see the features: a candidate
is positive if it overlaps a validated span, if its digits pass the checksum once the
separators are gone, if words such as *password* or *phone* stand right before it, if it
begins like the keys of a well-known service, or ends in a common domain.  Boosted
trees learn from format (digits, groups, separators, letter case, neighbours) which
candidates are positive; thresholds calibrated on a held-out fold, one per generator,
select candidates to add, labelled or not.  So a format that is nearly always
positive is redacted also where no labeller spoke.  Every score level above a
threshold reaches the precision by itself, so easy hits of one level or generator
buy no room for misses of another.

Training data are counts per feature cell: the cells are a fixed product of small
ranges, so the table that the trees are fitted on is bounded whatever the corpus,
yet counts every candidate.  The fitted trees become one column expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetflow.functions.arrays import let
from assetflow.llm.common import materialise, text_of

KINDS = ("email", "ip", "card", "phone", "secret")      # base patterns find the first four
PRECISION = 0.95          # calibrated precision on the held-out fold that an added span must reach
ROUNDS, DEPTH, RATE, RIDGE = 30, 3, 0.3, 1.0
MIN_CELL = 20             # held-out candidates behind a calibrated threshold
CONTEXT = 24              # characters before a candidate that the labellers search for words
MIN_SECRET = 12           # characters of a key or password
# Weak labellers: words right before a candidate, by kind, and what it looks like itself.
SAID_BEFORE = {
    "email": r"(?i)\b(e-?mail|contact|write to|reach|address)\b",
    "ip": r"(?i)\b(ip|ipv6|host|server|address)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax)\b",
    "secret": r"(?i)(password|passwd|pwd|secret|token|api[_ -]?key|credentials?)[\"'\s:=]{1,6}$",
}
COMMON_DOMAIN = r"(?i)[.\s)\]](com|org|net|edu|gov|de|fr|es|uk|io)$"
KEY_BEGINS = r"^(AKIA|ASIA|ghp_|gho_|xox[abp]|sk_live_|AIza)"

# Fixed patterns.  The guards "\G or not preceded by the class" start a match only at the
# start of a run or where the last match ended, and possessive loops never give
# characters back: same matches, linear time on texts without white space.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "at": r"(?:\G|(?<![^\s@]))[^\s@]++@[^\s@]++",
    "digits": r"[+(]{0,2}+[0-9](?:[\x20().-]{0,3}+[0-9])++",
    "quad": r"(?:\G|(?<![0-9]))[0-9]{1,3}+(?:[.,:-][0-9]{1,3}+){3}",
    "run": r"[0-9]{7,}+",
    "call": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])",
    "spelled": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?: ?[(\[]at[)\]] ?| at )[A-Za-z0-9-]++"
                r"(?:(?: ?[(\[]dot[)\]] ?| dot )[A-Za-z0-9-]++)++"),
    "ipv6": r"(?:\G|(?<![0-9A-Za-z:]))(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])",
    "secret": r"(?:\G|(?<![A-Za-z0-9_]))(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{%d,}+" % MIN_SECRET,
}
# a text without this cannot match
NEEDS = {"email": "@", "at": "@", "phone": "+", "call": "+", "spelled": "dot", "ipv6": ":"}
# feature -> number of values: the cells
FEATURES = {"gen": 8, "n_digits": 9, "groups": 6, "seps": 16, "left": 4, "right": 4, "letters": 4}
_BLOCK = 256


def _prefix(a: Column, first: Column) -> Column:
    step = F.aggregate(a, F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out")),
                       lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))
    return step["out"]


def prefix_sums(a: Column) -> Column:
    """Sums before each element, in blocks, so that long arrays are not copied element by element."""
    many = F.ceil(F.size(a) / _BLOCK).cast("int")
    blocks = F.when(many == 0, F.array().cast("array<array<int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(many, F.lit(1)) - 1), lambda b: F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK))))
    return let(blocks, lambda bs: let(
        _prefix(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x)), F.lit(0)),
        lambda starts: F.flatten(F.zip_with(bs, starts, lambda b, s: _prefix(b, s)))))


def matches(text: Column, pattern: str, need: str | None = None) -> Column:
    """array<struct<start, end, m>> of the leftmost non-overlapping matches, in characters."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    spans = let(found, lambda m: F.when(F.size(m) == 0, F.array().cast("array<struct<start:int,end:int,m:string>>")).otherwise(
        let(gaps, lambda g: let(prefix_sums(F.transform(m, lambda x, i: F.length(x) + F.length(F.get(g, i)))), lambda before: F.transform(
            m, lambda x, i: F.struct((F.get(before, i) + F.length(F.get(g, i))).alias("start"),
                                     (F.get(before, i) + F.length(F.get(g, i)) + F.length(x)).alias("end"), x.alias("m")))))))
    return spans if need is None else F.when(F.contains(text, F.lit(need)), spans).otherwise(
        F.array().cast("array<struct<start:int,end:int,m:string>>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    return let(F.reverse(digits), lambda d: F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.length(d), F.lit(1)) - 1), F.lit(0), lambda s, i: s + let(
            F.substring(d, i + 1, 1).cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) < 4) & (q.cast("int") <= 255)))
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>>, by kind as listed and start; kinds as numbers."""
    return F.concat(*[F.transform(F.filter(matches(text, p, NEEDS.get(kind)), lambda s: _valid(kind, s["m"])),
                                  lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
                      for k, (kind, p) in enumerate(BASE.items())])


def _side(ch: Column) -> Column:
    return F.when(F.coalesce(ch, F.lit("")) == "", 0).when(ch.rlike(r"^\s$"), 1).when(ch.rlike(r"^[\p{L}\p{N}]$"), 2).otherwise(3)


def candidates(text: Column) -> Column:
    """array<struct<start, end, kind, features..., said>> of all generators; digit runs of one to six are left out.

    ``said``: a labeller calls it personal, whatever the base patterns say.
    """
    parts = []
    for g, (gen, pattern) in enumerate(GENERATORS.items()):
        def featured(s: Column) -> Column:
            m = s["m"]
            digits = F.length(_digits(m))
            groups = F.size(F.split(m, r"[^0-9]+"))
            kind = {"at": F.lit(0), "spelled": F.lit(0), "quad": F.lit(1), "ipv6": F.lit(1), "call": F.lit(3), "secret": F.lit(4)}.get(
                gen, F.when(digits.between(13, 19), 2).otherwise(3))
            before = F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
            count = F.length(m) if gen == "secret" else digits
            said = {"at": F.lit(False), "spelled": before.rlike(SAID_BEFORE["email"]) | m.rlike(COMMON_DOMAIN), "quad": F.lit(False),
                    "ipv6": before.rlike(SAID_BEFORE["ip"]), "secret": before.rlike(SAID_BEFORE["secret"]) | m.rlike(KEY_BEGINS)}.get(
                gen, F.when(digits.between(13, 19), luhn(_digits(m))).otherwise(digits.between(9, 15) & before.rlike(SAID_BEFORE["phone"])))
            seps = sum((F.contains(m, F.lit(c)).cast("int") * (1 << i) for i, c in enumerate((" ", ".", "-", "+"))), F.lit(0))
            return F.struct(
                s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), F.lit(g).alias("gen"),
                F.when(count < 7, 0).when(count < 9, 1).when(count < 10, 2).when(count < 12, 3).when(count < 13, 4)
                 .when(count < 16, 5).when(count < 17, 6).when(count < 20, 7).otherwise(8).alias("n_digits"),
                (F.lit(0) if gen == "secret" else F.least(groups, F.lit(5))).alias("groups"), seps.alias("seps"),
                _side(F.when(s["start"] == 0, "").otherwise(F.substring(text, s["start"], 1))).alias("left"),
                _side(F.substring(text, s["end"] + 1, 1)).alias("right"),
                (m.rlike("[a-z]").cast("int") + m.rlike("[A-Z]").cast("int") * 2).alias("letters"),
                F.coalesce(said, F.lit(False)).cast("int").alias("said"))
        found = matches(text, pattern, NEEDS.get(gen))
        if gen == "digits":
            found = F.filter(found, lambda s: F.length(_digits(s["m"])) >= 7)
        parts.append(F.transform(found, featured))
    return F.concat(*parts)


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, key, base, cands)``: one scan of the whole texts; ``key`` names equal (id, text) rows alike."""
    t = text_of(text_col)
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), t).cast("binary"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(key).alias("key"), t.alias("t")).select(
        "doc_id", "key", base_spans(F.col("t")).alias("base"), candidates(F.col("t")).alias("cands"))


def _spread(extracted: DataFrame) -> DataFrame:
    """One row per distinct key and candidate, with ``near`` (it overlaps a base span) and ``hit`` (that, or a labeller spoke)."""
    distinct = extracted.filter("size(cands) > 0").dropDuplicates(["key"])
    names = ["start", "end", "kind", *FEATURES, "said"]
    none = [F.lit(0).alias(c) for c in (*FEATURES, "said")]
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind"), *none, F.lit(1).alias("is_base")))
    cand = F.transform("cands", lambda c: F.struct(*[c[n].alias(n) for n in names], F.lit(0).alias("is_base")))
    rows = distinct.select("key", F.explode(F.concat(base, cand)).alias("s")).select("key", *[F.col(f"s.{n}").alias(n) for n in names], F.col("s.is_base").alias("is_base"))
    order = Window.partitionBy("key").orderBy("start", "is_base", "end")
    left = F.max(F.when(F.col("is_base") == 1, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(F.when(F.col("is_base") == 1, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    near = F.coalesce(left > F.col("start"), F.lit(False)) | F.coalesce(right < F.col("end"), F.lit(False))
    return rows.withColumn("near", near.cast("int")).withColumn("hit", F.greatest("near", "said")).filter("is_base = 0").drop("is_base", "said")


def _grow(rows: list, grad: list[float], hess: list[float], depth: int):
    """A regression tree over cells: ('leaf', value) or ('split', feature, value, tree if <= value, tree if >)."""
    g, h = sum(grad), sum(hess)
    best = None
    if depth:
        for f in range(len(FEATURES)):
            bins: dict[int, list[float]] = {}
            for r, gr, he in zip(rows, grad, hess):
                b = bins.setdefault(r[f], [0.0, 0.0])
                b[0] += gr
                b[1] += he
            gl = hl = 0.0
            for v in sorted(bins)[:-1]:
                gl, hl = gl + bins[v][0], hl + bins[v][1]
                gain = gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, v)
    if best is None or best[0] < 1e-6:
        return ("leaf", -RATE * g / (h + RIDGE))
    _, f, v = best
    side = [r[f] <= v for r in rows]
    pick = lambda want: [[x for x, s in zip(xs, side) if s == want] for xs in (rows, grad, hess)]      # noqa: E731
    return ("split", f, v, _grow(*pick(True), depth - 1), _grow(*pick(False), depth - 1))


def _value(tree, row) -> float:
    while tree[0] == "split":
        tree = tree[3] if row[tree[1]] <= tree[2] else tree[4]
    return tree[1]


def boost(cells: list[tuple]) -> tuple[float, list]:
    """Logistic boosting over ``(features..., hits, misses)`` cells; start and trees."""
    rows = [c[:-2] for c in cells]
    hits, misses = [float(c[-2]) for c in cells], [float(c[-1]) for c in cells]
    start = math.log((sum(hits) + 0.5) / (sum(misses) + 0.5))
    score, trees = [start] * len(rows), []
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad = [(h + m) * q - h for h, m, q in zip(hits, misses, p)]
        hess = [(h + m) * q * (1 - q) for h, m, q in zip(hits, misses, p)]
        tree = _grow(rows, grad, hess, DEPTH)
        trees.append(tree)
        score = [s + _value(tree, r) for s, r in zip(score, rows)]
    return start, trees


def _expression(tree) -> Column:
    if tree[0] == "leaf":
        return F.lit(tree[1])
    return F.when(F.col(list(FEATURES)[tree[1]]) <= tree[2], _expression(tree[3])).otherwise(_expression(tree[4]))


def threshold(scored: list[tuple[float, int, int]], precision: float = PRECISION) -> float:
    """Least score down to which each level of held-out candidates reaches ``precision`` by itself; infinite if none does.

    Levels of fewer than MIN_CELL candidates count with the next ones, up to that many.
    """
    levels: dict[float, list[int]] = {}
    for s, h, m in scored:
        level = levels.setdefault(round(s, 9), [0, 0])
        level[0] += h
        level[1] += h + m
    hits, total, best = 0, 0, math.inf
    for s in sorted(levels, reverse=True):
        hits, total = hits + levels[s][0], total + levels[s][1]
        if total >= MIN_CELL:
            if hits < precision * total:
                break
            hits, total, best = 0, 0, s
    return best


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> tuple[DataFrame, DataFrame]:
    """``(rows, added)``: the extracted rows, and per key the spans that the trees add.

    Null and empty texts have no spans; without any positive candidate, or below
    ``precision`` at a score level of a generator, nothing is added.  Added spans never overlap a base span, and
    overlapping added spans become their union, of its best-scored candidate's kind.
    """
    rows = materialise(extract(docs, id_col, text_col), "pii-rows")
    cand = materialise(_spread(rows), "pii-candidates")
    fold = F.pmod(F.xxhash64("key"), F.lit(5)) == 0
    cells = (cand.groupBy(*FEATURES).agg(      # at most the product of the feature sizes, 442,368 rows
        F.sum(F.when(~fold, F.col("hit")).otherwise(0)).alias("h"), F.sum(F.when(~fold, 1 - F.col("hit")).otherwise(0)).alias("m"),
        F.sum(F.when(fold, F.col("hit")).otherwise(0)).alias("th"), F.sum(F.when(fold, 1 - F.col("hit")).otherwise(0)).alias("tm"))
        .orderBy(*FEATURES).collect())
    start, trees = boost([(*r[:len(FEATURES)], r["h"], r["m"]) for r in cells if r["h"] + r["m"]])
    held: dict[int, list] = {}
    for r in cells:
        if r["th"] + r["tm"]:
            held.setdefault(r["gen"], []).append((start + sum(_value(t, r[:len(FEATURES)]) for t in trees), r["th"], r["tm"]))
    cut = F.lit(1e9)
    for gen, scored in held.items():
        least = threshold(scored, precision)
        if not math.isinf(least):
            cut = F.when(F.col("gen") == gen, least).otherwise(cut)
    score = F.lit(start)
    for t in trees:
        score = score + _expression(t)
    chosen = cand.filter("near = 0").withColumn("score", score).filter(F.col("score") >= cut - 1e-8)
    order = Window.partitionBy("key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = chosen.withColumn("new", F.when(F.coalesce(reach > F.col("start"), F.lit(False)), 0).otherwise(1)) \
        .withColumn("island", F.sum("new").over(order))
    union = island.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"),
                                                F.max_by("kind", F.struct("score", -F.col("start"))).alias("kind"))
    added = union.groupBy(F.col("key").alias("akey")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    return rows, added


def _said(a: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """Per row: ``doc_id``, base counts per kind, base and all spans as arrays, and their text form."""
    rows, added = spans(docs, id_col, text_col, precision)
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    met = rows.join(added, rows["key"] == added["akey"], "left").withColumn("added", F.coalesce("added", none))
    every = F.array_sort(F.concat("base", "added"))
    return met.select(
        "doc_id", "key", *[F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)],
        F.col("base"), every.alias("all"), F.size("added").cast("long").alias("n_added")) \
        .withColumn("base_text", _said(F.col("base"))).withColumn("spans", _said(F.col("all")))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; other columns and null texts stay as they are."""
    found = find(docs, id_col, text_col, precision).filter("size(all) > 0").dropDuplicates(["key"]).select(F.col("key").alias("__key"), F.col("all").alias("__all"))
    names = docs.columns
    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text_of(text_col)).cast("binary")))
    met = docs.withColumn("__own", key).join(found, F.col("__own") == F.col("__key"), "left")
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    t = F.col(f"`{text_col}`")

    def cut(all_spans: Column) -> Column:
        s = F.array_sort(F.transform(all_spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
        def build(a: Column) -> Column:
            # spans of different kinds may overlap: each piece of text starts after every earlier span's end
            ends = let(F.transform(a, lambda x: x["end"]), lambda e: running_max(e))
            return let(ends, lambda e: F.concat(
                F.array_join(F.transform(a, lambda x, i: let(F.when(i == 0, 0).otherwise(F.get(e, i - 1)), lambda p: F.concat(
                    F.when(x["start"] > p, F.substring(t, p + 1, x["start"] - p)).otherwise(""),
                    F.when((x["start"] >= p) | (x["end"] > p), F.get(label, x["kind"])).otherwise("")))), ""),
                F.substring(t, F.element_at(e, -1) + 1, F.length(t))))
        return let(s, build)
    return met.withColumn(text_col, F.when(F.col("__all").isNull(), t).otherwise(cut(F.col("__all")))).select(*[F.col(f"`{c}`") for c in names])


def running_max(e: Column) -> Column:
    """Largest element so far, in blocks like ``prefix_sums``."""
    def inner(a: Column, first: Column) -> Column:
        return F.aggregate(a, F.struct(first.alias("top"), F.array().cast("array<int>").alias("out")),
                           lambda s, x: F.struct(F.greatest(s["top"], x).alias("top"), F.concat(s["out"], F.array(F.greatest(s["top"], x))).alias("out")))["out"]
    many = F.greatest(F.ceil(F.size(e) / _BLOCK).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), many - 1), lambda b: F.slice(e, b * _BLOCK + 1, F.lit(_BLOCK)))
    return let(blocks, lambda bs: let(
        inner(F.transform(bs, lambda b: F.coalesce(F.array_max(b), F.lit(0))), F.lit(0)),
        lambda tops: F.flatten(F.transform(bs, lambda b, i: inner(b, F.when(i == 0, 0).otherwise(F.get(tops, i - 1)))))))
