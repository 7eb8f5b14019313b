"""URL filter: rules, then host word segmentation and naive Bayes (operator 7).

A rule ``host/path`` fits its host and all subdomains when the URL's path starts
with the rule's path; the longest rule wins.  For all other URLs the letter runs
of host and path are split into words by a unigram Viterbi search, and a
multinomial naive Bayes over the words of host and path decides.

Unigram counts come from the letter runs of all URLs and the words of all pages.
They are never collected or broadcast: the substrings of distinct letter runs are
joined with the counts, and each run is split from its own few hundred entries.
Words of any length are counted and found.

Naive Bayes learns in two rounds.  First, URLs whose segmented host holds a seed word
are the block class, all others the allow class.  Then every URL is labelled anew by
its other words, the seed words left out: one without a seed is block if they say so
(it shares words with blocked hosts), and one with a seed is allow if they speak for
allow by more than MARGIN (a common word of clean hosts beside a word that happens
to be a seed); words that say little leave the seed's label.  The second model,
fitted on these labels, scores all words of every URL.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.llm.common import materialise

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
SEEDS = ("adult", "ads", "bets", "casino", "gambling", "pills", "porn", "spam", "track", "viagra", "xxx")
MARGIN = 2.0        # log odds of the other words that overrule a seed word
SMOOTH = 10.0       # weight, in words, of the overall word shares in either class
SALT = 8            # a word found in most URLs is dealt to so many tasks
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls; of equal rules the first given."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def runs(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z]+"), F.lit(0))


def split_words(run: str, entries: dict[tuple[int, int], float], total: float) -> list[str]:
    """Most likely words of ``run``; ``entries``: (start, length) -> count.  Unknown words, of any length, cost a factor of ten a letter."""
    floor, letter = math.log(total + 1), math.log(10)
    known: dict[int, list[tuple[int, float]]] = {}
    for (start, length), n in entries.items():
        known.setdefault(start + length, []).append((start, math.log(n) - floor))
    best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
    new, since = -math.inf, 0                 # the best way to end with an unknown word, and where that begins
    for end in range(1, len(run) + 1):
        new -= letter
        if best[end - 1] - floor > new:
            new, since = best[end - 1] - floor, end - 1
        best[end], back[end] = new, since
        for start, p in known.get(end, ()):
            if (best[start] + p, -start) > (best[end], -back[end]):
                best[end], back[end] = best[start] + p, start
    out, end = [], len(run)
    while end:
        out.append(run[back[end]:end])
        end = back[end]
    return out[::-1]


def unigrams(urls: DataFrame, html: DataFrame | None) -> DataFrame:
    """``(word, n)``: letter runs of all distinct URLs, weighted by their pages, and words of all page texts."""
    words = urls.select(F.explode(F.concat(runs(F.col("host")), runs(F.col("path")))).alias("word"), "n")
    if html is not None:
        body = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), r"(?s)<[^>]*+>", " ")
        words = words.union(html.select(F.explode(runs(body)).alias("word"), F.lit(1).cast("long").alias("n")))
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def segment(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """``(piece, words)`` for a table of distinct letter runs, through a join with the unigram counts."""
    # words counted once and longer than all others are unknown words, so the substrings below are as long as words are
    size = counts.agg(F.sum("n").alias("n"), F.max(F.when(F.col("n") > 1, F.length("word"))).alias("longest")).first()
    total, longest = float(size["n"] or 0), size["longest"] or 1
    at = pieces.select("piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("at"))
    subs = at.select("piece", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("piece") - F.col("at") + 1))).alias("len"))
    subs = subs.withColumn("sub", F.substr(F.col("piece"), F.col("at"), F.col("len")))
    known = subs.join(counts, subs["sub"] == counts["word"], "left")
    packs = known.groupBy("piece").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("at", "len", "n"))).alias("entries"))

    def run(batches):
        for b in batches:
            out = [split_words(p, {(e["at"] - 1, e["len"]): e["n"] for e in es}, total)
                   for p, es in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["piece", "words"])

    return packs.mapInArrow(run, "piece string, words array<string>")


def _salted(left: DataFrame, right: DataFrame, on: str, by: list[str]) -> DataFrame:
    """Inner join on ``on`` with the left side's hot keys dealt over SALT copies of the right side."""
    dealt = left.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALT)).cast("int"))
    copies = right.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALT)])))
    return dealt.join(copies, [on, "salt"]).drop("salt")


def learn(bags: DataFrame) -> tuple[DataFrame, float]:
    """Log odds of block per word, and of the prior, from ``bags (host, path, n, words, block)``.

    Smoothed towards the words' overall shares: a rare word of the large class never speaks for the small one.
    """
    of = bags.select("n", "block", F.explode("words").alias("word"))
    seen = of.groupBy("word").agg(F.sum(F.col("n") * F.col("block")).alias("b"), F.sum(F.col("n") * (1 - F.col("block"))).alias("a"))
    seen = materialise(seen, "url-seen")
    size = seen.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    urls = bags.agg(F.coalesce(F.sum(F.col("n") * F.col("block")), F.lit(0)).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    prior = math.log((urls["b"] + 1e-9) / (urls["n"] - urls["b"] + 1e-9)) if urls["n"] else 0.0
    share = (F.col("a") + F.col("b")) / max(size["a"] + size["b"], 1) * SMOOTH
    odds = seen.select("word", (F.log((F.col("b") + share) / (size["b"] + SMOOTH)) - F.log((F.col("a") + share) / (size["a"] + SMOOTH))).alias("odds"))
    return materialise(odds, "url-odds"), prior


def score(bags: DataFrame, odds: DataFrame) -> DataFrame:
    """``(sh, sp, odds)``: the summed log odds of each URL's words, without the prior."""
    tokens = bags.select(F.col("host").alias("sh"), F.col("path").alias("sp"), F.explode("words").alias("word"))
    return _salted(tokens, odds, "word", ["sh", "sp"]).groupBy("sh", "sp").agg(F.sum("odds").alias("odds"))


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` per row.

    A null URL or one without ``://`` has an empty host and path, fits no rule and
    has no words: it is allowed with a null score, like any URL without letters.
    ``score`` is the second model's log odds of block; ties are allowed.  Without a seeded host, or
    with nothing else, naive Bayes has one class and allows, or blocks, everything.
    """
    host, path = host_path(F.col(url_col).cast("string"))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = materialise(own.groupBy("host", "path").agg(F.count("*").alias("n")), "url-distinct")
    html = None if html_col is None else pages.select(F.col(html_col).cast("string").alias("html"))
    counts = materialise(unigrams(urls, html), "url-unigrams")
    parts = urls.select("host", "path", "n", F.explode(F.concat(
        F.transform(runs(F.col("host")), lambda p: F.struct(p.alias("piece"), F.lit(1).alias("in_host"))),
        F.transform(runs(F.col("path")), lambda p: F.struct(p.alias("piece"), F.lit(0).alias("in_host"))))).alias("p"))
    parts = parts.select("host", "path", "n", "p.piece", "p.in_host")
    words = materialise(segment(parts.select("piece").distinct(), counts), "url-words")
    seed = F.array(*[F.lit(s) for s in seeds])
    bags = (_salted(parts, words, "piece", ["host", "path"]).groupBy("host", "path")
            .agg(F.first("n").alias("n"), F.flatten(F.collect_list("words")).alias("words"),
                 F.max(F.arrays_overlap("words", seed).cast("int") * F.col("in_host")).alias("seeded")))
    bags = materialise(bags, "url-bags")      # one URL's words: bounded by its length
    first, prior = learn(bags.withColumn("block", F.col("seeded")))
    rest = score(bags.withColumn("words", F.filter("words", lambda w: ~F.array_contains(seed, w))), first)
    by_rest = bags.join(rest, (F.col("host") == F.col("sh")) & (F.col("path") == F.col("sp")), "left")
    evidence = F.coalesce(F.col("odds"), F.lit(0.0))
    block = F.when(F.col("seeded") == 1, (evidence >= -MARGIN).cast("int")).otherwise((evidence + prior > 0).cast("int"))
    bags = materialise(by_rest.select("host", "path", "n", "words", block.alias("block")), "url-labelled")
    second, prior = learn(bags)
    scores = materialise(score(bags, second).select("sh", "sp", (F.col("odds") + prior).alias("score")), "url-scores")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    met = own.join(scores, (F.col("host") == F.col("sh")) & (F.col("path") == F.col("sp")), "left")
    by_score = F.when(F.coalesce(F.col("score"), F.lit(0.0)) > 0, "block").otherwise("allow")
    return met.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_score).alias("verdict"), "score")
