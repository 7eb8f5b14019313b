"""Approximate nearest neighbours: one HNSW graph per shard, shard results merged (operator 6).

Rows are dealt to shards of about ``SHARD_ROWS`` distinct vectors by hash.  Each
shard builds a hierarchical navigable small-world graph (Malkov & Yashunin 2018),
stored as flat neighbour arrays, one per layer.  Insertion and search run a beam
over many points at once: per step, all points of a batch expand their best
unexpanded nodes, so the work is matrix products instead of a loop per point.

Inner product is reduced to a metric: vectors get one more component that gives
all the same norm, queries get zero there.  Shards hold vectors of one band of norms
(a factor of BAND) and are scaled to norm one, queries too, so neither huge nor tiny
vectors cost precision or blur the differences of the others; scores are computed
in double precision from the vectors as given.

Equal vectors are one node with the smallest ids of its rows (as many as a result
can need), so a hot vector neither floods a graph nor hides the ties by id.
Queries travel in blocks to every shard; per (shard, block) one task searches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetflow.functions.arrays import let
from assetflow.llm.common import materialise

SHARD_ROWS = 8192
QUERY_BLOCK = 4096
LINKS = 16               # per node on upper layers; twice as many on the lowest
EF_BUILD, EF_SEARCH = 64, 128
BAND = 16                # largest quotient of norms in a shard
_BEAM = 4                # nodes a point expands per step
_BATCH = 256
_FEW = 512


class Graph:
    """Vectors (n, d) float32 of equal norm, and per layer a flat (n, links) neighbour array, -1 for none."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], entry: int):
        self.vectors, self.layers, self.entry = vectors, layers, entry

    def beam(self, layer: np.ndarray, queries: np.ndarray, entries: np.ndarray, ef: int):
        """(ids, similarities), best first, of each query's beam of width ``ef``; -1 pads."""
        many = len(queries)
        rows = np.arange(many)
        seen = np.zeros((many, len(self.vectors) + 1), bool)       # the last column takes the padding
        ids = np.full((many, ef), -1, np.int64)
        sim = np.full((many, ef), -np.inf, np.float32)
        open_ = np.zeros((many, ef), bool)
        width = min(entries.shape[1], ef)
        ids[:, :width] = entries[:, :width]
        sim[:, :width] = np.where(ids[:, :width] >= 0, np.einsum("qed,qd->qe", self.vectors[ids[:, :width]], queries), -np.inf)
        open_[:, :width] = ids[:, :width] >= 0
        seen[rows[:, None], ids[:, :width]] = True
        while open_.any():
            live = rows[open_.any(axis=1)]
            rank = np.where(open_[live], sim[live], -np.inf)
            step = min(_BEAM, ef)
            at = np.argpartition(-rank, step - 1, axis=1)[:, :step]
            took = np.take_along_axis(open_[live], at, axis=1)
            expand = np.where(took, np.take_along_axis(ids[live], at, axis=1), -1)
            open_[live[:, None], at] = False
            near = np.where(expand[:, :, None] >= 0, layer[expand], -1).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], near]] = -1
            seen[live[:, None], near] = True
            used = (near >= 0).any(axis=0)
            near = near[:, used]
            if not near.shape[1]:
                continue
            got = np.where(near >= 0, np.einsum("qnd,qd->qn", self.vectors[near], queries[live]), -np.inf).astype(np.float32)
            all_sim, all_ids = np.hstack([sim[live], got]), np.hstack([ids[live], near])
            all_open = np.hstack([open_[live], near >= 0])
            top = np.argpartition(-all_sim, ef - 1, axis=1)[:, :ef]
            sim[live], ids[live], open_[live] = (np.take_along_axis(x, top, axis=1) for x in (all_sim, all_ids, all_open))
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sim, order, axis=1)

    def descend(self, queries: np.ndarray, stop: int) -> np.ndarray:
        """Entry points on layer ``stop`` by greedy search from the top."""
        at = np.full((len(queries), 1), self.entry)
        for level in range(len(self.layers) - 1, stop, -1):
            at = self.beam(self.layers[level], queries, at, 1)[0]
        return at

    def search(self, queries: np.ndarray, k: int, ef: int = EF_SEARCH) -> np.ndarray:
        """(q, k) node numbers, -1 pads; queries have one zero component more than the given vectors."""
        parts = [self.beam(self.layers[0], q, self.descend(q, 0), max(ef, k))[0][:, :k]
                 for q in np.array_split(queries, -(-len(queries) // _BATCH))] if len(queries) else []
        return np.vstack(parts) if parts else np.zeros((0, k), np.int64)


def _choose(vectors: np.ndarray, points: np.ndarray, cand: np.ndarray, sim: np.ndarray, links: int) -> np.ndarray:
    """Neighbour selection: a candidate stays if it is nearer to the point than to any chosen one; the rest fills up."""
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sim, order, axis=1)
    v = vectors[cand]
    among = v @ v.transpose(0, 2, 1)
    good, chosen = cand >= 0, np.zeros(cand.shape, bool)
    closest = np.full(cand.shape, -np.inf, np.float32)
    for c in range(cand.shape[1]):
        take = good[:, c] & (closest[:, c] < sim[:, c]) & (chosen.sum(axis=1) < links)
        chosen[take, c] = True
        closest[take] = np.maximum(closest[take], among[take, c])
    rank = np.where(chosen, 0, np.where(good, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1])
    first = np.argsort(rank, axis=1)[:, :links]
    out = np.where(np.take_along_axis(good, first, axis=1), np.take_along_axis(cand, first, axis=1), -1)
    return np.pad(out, ((0, 0), (0, links - out.shape[1])), constant_values=-1)


def build(vectors: np.ndarray, ids: np.ndarray) -> Graph:
    """Insert all vectors in batches; levels and order are hashes of the ids, so a retry builds the same graph."""
    n = len(vectors)
    u = np.array([(xxhash.xxh64_intdigest(str(i), 3) + 0.5) / 2.0**64 for i in ids.tolist()])
    level = np.minimum((-np.log(u) / np.log(LINKS)).astype(int), 6)
    order = np.lexsort((u, -level))
    layers = [np.full((n, 2 * LINKS if lv == 0 else LINKS), -1, np.int64) for lv in range(level.max() + 1)]
    graph = Graph(vectors, layers, int(order[0]))
    done = 1
    while done < n:
        new = order[done:done + min(_BATCH, done)]
        old = order[:done]
        top = len(layers) - 1
        at = np.full((len(new), 1), graph.entry)
        for lv in range(top, -1, -1):
            layer = layers[lv]
            here = level[new] >= lv
            found, sim = graph.beam(layer, vectors[new], at, EF_BUILD if here.any() else 1)
            at = found[:, :1]
            if not here.any() or not (level[old] >= lv).any():
                continue
            pts = new[here]
            mutual = vectors[pts] @ vectors[pts].T
            np.fill_diagonal(mutual, -np.inf)
            some = min(len(pts), 16)
            close = np.argpartition(-mutual, some - 1, axis=1)[:, :some]
            near = np.where(np.isfinite(np.take_along_axis(mutual, close, axis=1)), pts[close], -1)
            cand = np.hstack([found[here], near])
            csim = np.hstack([sim[here], np.where(near >= 0, np.take_along_axis(mutual, close, axis=1), -np.inf)]).astype(np.float32)
            links = layer.shape[1]
            layer[pts] = _choose(vectors, pts, cand, csim, LINKS if lv else LINKS)[:, :links] if links == LINKS else np.pad(
                _choose(vectors, pts, cand, csim, LINKS), ((0, 0), (0, links - LINKS)), constant_values=-1)
            _link_back(vectors, layer, pts)
        done += len(new)
    return graph


def _link_back(vectors: np.ndarray, layer: np.ndarray, pts: np.ndarray) -> None:
    """Add each new point to its neighbours' lists; lists that overflow are chosen anew."""
    links = layer.shape[1]
    target = layer[pts].ravel()
    source = np.repeat(pts, links)
    target, source = target[target >= 0], source[target >= 0]
    order = np.lexsort((source, target))
    target, source = target[order], source[order]
    nodes, start, many = np.unique(target, return_index=True, return_counts=True)
    for a in range(0, len(nodes), _FEW):
        part, first, size = nodes[a:a + _FEW], start[a:a + _FEW], many[a:a + _FEW]
        wide = int(size.max())
        extra = np.full((len(part), wide), -1, np.int64)
        col = np.concatenate([np.arange(s) for s in size])
        extra[np.repeat(np.arange(len(part)), size), col] = source[first[0]:first[-1] + size[-1]]
        extra[(extra[:, :, None] == layer[part][:, None, :]).any(axis=2)] = -1
        cand = np.hstack([layer[part], extra])
        sim = np.where(cand >= 0, np.einsum("pcd,pd->pc", vectors[cand], vectors[part]), -np.inf).astype(np.float32)
        best = np.argsort(-sim, axis=1, kind="stable")[:, :2 * links]
        cand, sim = np.take_along_axis(cand, best, axis=1), np.take_along_axis(sim, best, axis=1)
        full = (cand >= 0).sum(axis=1) > links
        if (~full).any():
            layer[part[~full]] = cand[~full][:, :links]
        if full.any():
            layer[part[full]] = _choose(vectors, part[full], cand[full], sim[full], links)


def scaled(v: np.ndarray, by_row: bool = False) -> np.ndarray:
    """Rows divided by their largest norm, or each by its own; safe for any finite numbers."""
    v = v / np.abs(v).max(axis=1 if by_row else None, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True)).max(axis=1 if by_row else None, keepdims=True)


def _equal_norm(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    norm = (v * v).sum(axis=1)
    return np.hstack([v, np.sqrt(np.maximum(1 - norm, 0))[:, None]]).astype(np.float32)


def _band(v: Column) -> Column:
    """Logarithm of the norm to base BAND, rounded down; components are scaled first, as their squares may overflow."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return let(top, lambda t: F.floor((F.log2(t) + F.log2(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / t) * (x / t))) / 2) / math.log2(BAND)).cast("int"))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v, dim, band)`` of the vectors that take part: an id, no null, NaN or infinite component, not all zero."""
    v = F.col("v")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
            .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
            .withColumn("dim", F.size("v")).withColumn("band", _band(v)))


def index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """One row per (dim, band, shard): vectors, neighbour arrays and ids as flat binaries; and the number of shards per (dim, band)."""
    spark_window = Window.partitionBy("v").orderBy("id")
    kept = rows.withColumn("nth", F.row_number().over(spark_window)).filter(F.col("nth") <= k + 1)      # limited before the shuffle
    nodes = materialise(kept.groupBy("v", "dim", "band").agg(F.sort_array(F.collect_list("id")).alias("ids")), "hnsw-nodes")
    shards = materialise(nodes.groupBy("dim", "band").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "hnsw-shards")
    dealt = nodes.join(shards, ["dim", "band"]).withColumn("shard", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.col("shards")).cast("int"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda s: s.map(lambda x: x[0]))
        v = np.stack(pdf["v"].to_numpy())
        graph = build(_equal_norm(v), np.array([x[0] for x in pdf["ids"]]))
        return pd.DataFrame({
            "dim": [v.shape[1]], "band": [pdf["band"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "nodes": [len(v)], "entry": [graph.entry], "vectors": [v.tobytes()],
            "layers": [[x.astype(np.int32).tobytes() for x in graph.layers]],
            "ids": [np.concatenate(pdf["ids"].to_numpy()).astype(np.int64).tobytes()], "many": [pdf["ids"].map(len).to_numpy(np.int32).tobytes()]})

    schema = "dim int, band int, shard int, nodes int, entry int, vectors binary, layers array<binary>, ids binary, many binary"
    return materialise(dealt.drop("shards").groupBy("dim", "band", "shard").applyInPandas(make, schema), "hnsw-index"), shards


def load(row) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """Graph, vectors in double precision, ids and where each node's ids begin."""
    v = np.frombuffer(row["vectors"], np.float64).reshape(row["nodes"], row["dim"])
    layers = [np.frombuffer(x, np.int32).reshape(row["nodes"], -1).astype(np.int64) for x in row["layers"]]
    return Graph(_equal_norm(v), layers, row["entry"]), v, np.frombuffer(row["ids"], np.int64), np.r_[0, np.cumsum(np.frombuffer(row["many"], np.int32))]


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
               shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest inner products found for each row whose id is divisible by ``every``.

    A row is never its own neighbour; ties go to the smaller id.  Vectors that are
    null, zero or hold a null or non-finite component, and rows without an id, take
    no part; vectors of different lengths are never compared.  Rows that repeat an
    id and a vector are one row.  Fewer than k candidates: all of them.
    """
    rows = usable(vectors, id_col, vec_col).dropDuplicates(["id", "v"])
    table, shards = index(rows, k, shard_rows)
    asked = materialise(rows.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v", "dim"), "hnsw-queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    sent = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).join(shards, "dim") \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")      # a few bands per dim
    lent = table.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(shard):
            graph, exact, ids, first = load(shard.iloc[0])
            q = np.stack(queries["v"].to_numpy())
            found = graph.search(np.hstack([scaled(q, by_row=True), np.zeros((len(q), 1))]).astype(np.float32), k + 1, ef)
            for own, vec, near in zip(queries["query_id"], q, found):
                near = near[near >= 0]
                score = (exact[near] * vec).sum(axis=1)
                pairs = sorted((-s, i) for s, x in zip(score.tolist(), near) for i in ids[first[x]:first[x + 1]].tolist() if i != own)
                out += [(own, i, -s) for s, i in pairs[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["dim", "band", "shard", "block"]
    parts = sent.groupBy(*keys).cogroup(lent.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
