"""Nearest neighbours by inner product through robust-pruned directed graphs, one per shard.

Equal vectors are one node with their smallest ids (no more than could be answered). Nodes are dealt to shards by
length, a power of two to a band, and by a hash of the vector: within a shard lengths differ by a factor of two at
most, so no outlier blurs the others. Each shard gets one more component that turns largest inner product into
smallest distance, and builds its graph: every node searches greedily from the entry point, proposes what it met as neighbours, and keeps
those that no kept neighbour is closer to by the factor ALPHA (relaxed pruning leaves long, diverse edges); edges go
both ways, and nodes with too many are pruned again. A query walks every shard's graph with a beam; the best of all
shards, re-scored in double precision on the original vectors, are the answer.

Queries are the stated set; they are cut into blocks of QUERY_BLOCK, and each (shard, block) is one task's work: the
work is that of the queries times the shards, and a graph is sent to each block once.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; neither do
null ids; equal ids are separate candidates, but never answers to their own id; vectors of another length than a
query's are no candidates for it; with fewer candidates than asked for, all are given; an empty table gives an empty
result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.llm.common import materialise

TOP = 20
SHARD_ROWS = 8192
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 120
ALPHA = 1.2
QUERY_BLOCK = 16384
#: Neighbours looked at together in one step of the walk.
WIDE = 3


def beam_search(vecs: np.ndarray, norms: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the nodes of its final beam and their squared distances (less the query's own square), sorted."""
    b, n = len(queries), len(vecs)
    ids = np.full((b, beam), -1, dtype=np.int64)
    dist = np.full((b, beam), np.inf, dtype=np.float32)
    done = np.zeros((b, beam), dtype=bool)
    seen = np.zeros((b, n), dtype=bool)
    ids[:, 0], seen[:, entry] = entry, True
    dist[:, 0] = norms[entry] - 2 * queries @ vecs[entry]
    live = np.arange(b)
    while len(live):
        open_ = np.where(done[live], np.inf, dist[live])
        first = np.argsort(open_, axis=1)[:, :WIDE]
        value = np.take_along_axis(open_, first, axis=1)
        going = np.isfinite(value[:, 0])
        live, first, value = live[going], first[going], value[going]
        if not len(live):
            break
        nodes = np.where(np.isfinite(value), ids[live[:, None], first], -1)
        done[live[:, None], first] = True
        near = np.where(nodes[:, :, None] >= 0, edges[nodes], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        fresh = (near >= 0) & ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(fresh)
        node = near[row, col]
        seen[live[row], node] = True
        d = np.full(near.shape, np.inf, dtype=np.float32)
        d[row, col] = norms[node] - 2 * np.einsum("ij,ij->i", vecs[node], queries[live[row]])
        all_d = np.concatenate([dist[live], d], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), best, axis=1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(near.shape, dtype=bool)], axis=1), best, axis=1)
        dist[live] = np.take_along_axis(all_d, best, axis=1)
    order = np.argsort(dist, axis=1)
    ids, dist = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)
    return np.where(np.isfinite(dist), ids, -1), dist


def robust_prune(vecs: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node its kept neighbours among ``cand`` (-1: none), nearest first, -1 to fill."""
    cand = np.where(cand == nodes[:, None], -1, cand)
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    own = vecs[np.maximum(cand, 0)]
    d = ((own - vecs[nodes][:, None]) ** 2).sum(axis=2)
    d[cand < 0] = np.inf
    order = np.argsort(d, axis=1)
    cand, d = np.take_along_axis(cand, order, axis=1), np.take_along_axis(d, order, axis=1)
    own = np.take_along_axis(own, order[:, :, None], axis=1)
    sq = (own**2).sum(axis=2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * own @ own.transpose(0, 2, 1)
    open_, out = np.isfinite(d), np.full((len(nodes), degree), -1, dtype=np.int64)
    count, r = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes))
    for i in range(cand.shape[1]):
        take = open_[:, i] & (count < degree)
        out[r[take], count[take]] = cand[take, i]
        count[take] += 1
        open_[take] &= ~(alpha * alpha * between[take, i] <= d[take])
        open_[:, i] = False
    return out


def build_graph(vecs: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """(edges n x degree, entry) over float32 vectors."""
    n, rng = len(vecs), np.random.default_rng(seed)
    norms = (vecs**2).sum(axis=1)
    entry = int(np.argmin(((vecs - vecs.mean(axis=0)) ** 2).sum(axis=1)))
    degree = min(degree, max(1, n - 1))
    edges = np.full((n, degree), -1, dtype=np.int64)
    order = rng.permutation(n)
    order = np.r_[entry, order[order != entry]]
    at, step = 1, 1
    while at < n:
        batch = order[at : at + step]
        found, _ = beam_search(vecs, norms, edges, entry, vecs[batch], beam)
        edges[batch] = robust_prune(vecs, batch, found, degree, alpha)
        src, dst = np.repeat(batch, degree), edges[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        heads, first, counts = np.unique(dst, return_index=True, return_counts=True)
        most = int(counts.max()) if len(counts) else 0
        for lo in range(0, len(heads), 512):
            h, f, c = heads[lo : lo + 512], first[lo : lo + 512], counts[lo : lo + 512]
            col = np.arange(most)
            came = np.where(col < c[:, None], src[np.minimum(f[:, None] + col, len(src) - 1)], -1)
            had = edges[h]
            room = (had >= 0).sum(axis=1) + c <= degree
            both = np.concatenate([had, came], axis=1)
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
            edges[h[room]] = packed[room, :degree]
            if (~room).any():
                edges[h[~room]] = robust_prune(vecs, h[~room], packed[~room], degree, alpha)
        at += len(batch)
        step = min(256, max(1, at // 8))
    return edges, entry


def lifted(vecs: np.ndarray) -> np.ndarray:
    """With one more component, so that all have length one and nearest means largest inner product."""
    scaled = vecs / np.abs(vecs).max()
    sq = (scaled**2).sum(axis=1)
    return (np.c_[scaled, np.sqrt(np.maximum(sq.max() - sq, 0))] / np.sqrt(sq.max())).astype(np.float32)


def band(key: bytes) -> int:
    """The power of two of a vector's length."""
    v = np.frombuffer(key, dtype=np.float64)
    most = np.abs(v).max()
    return int(np.frexp(most)[1] + np.frexp(np.sqrt(((v / most) ** 2).sum()))[1])


def keyed_vectors(rows: DataFrame, id_col: str, vec_col: str, most: int | None = None) -> DataFrame:
    """(key, vec_id): valid vectors as bytes; of equal ones in a batch only the ``most`` smallest ids, if given."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = []
            for v in pdf["v"]:
                try:
                    x = np.array(v, dtype=np.float64) + 0.0
                    keys.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
                except (TypeError, ValueError):
                    keys.append(None)
            pdf = pd.DataFrame({"key": keys, "vec_id": pdf["vec_id"].to_numpy()}).dropna(subset=["key"])
            yield pdf if most is None else pdf.sort_values("vec_id").pipe(lambda x: x[x.groupby("key").cumcount() < most])

    return rows.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vec_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")).mapInPandas(partial, "key binary, vec_id long")


def distinct_vectors(rows: DataFrame, id_col: str, vec_col: str, most: int) -> DataFrame:
    """(key, band, vec_ids): each distinct valid vector with its smallest ids, ``most`` at most; no more can be answers."""

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "band": [band(k) for k in pdf["key"]], "vec_ids": pdf["vec_ids"]})

    found = keyed_vectors(rows, id_col, vec_col, most)
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("r") <= most)
    return ranked.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids")).mapInPandas(banded, "key binary, band int, vec_ids array<long>")


def search(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP, shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``top`` best other rows that the graphs find."""
    nodes = materialise(distinct_vectors(rows, id_col, vec_col, top + 1), "distinct-vectors")
    asked = materialise(keyed_vectors(queries, id_col, vec_col).select("key", F.col("vec_id").alias("query_id")), "queries")
    patterns = materialise(asked.select("key").distinct().withColumn("pattern", F.monotonically_increasing_id()), "distinct-queries")
    # One row per band and length of vectors (a few thousand at most, the exponents of doubles): how many shards it gets.
    bands = nodes.groupBy("band").agg(F.count(F.lit(1)).alias("n")).orderBy("band").collect()
    first, shards = [], 0
    for r in bands:
        first.append((r["band"], shards, n_own := -(-r["n"] // shard_rows)))
        shards += n_own
    of_band = rows.sparkSession.createDataFrame(first, "band int, first int, own int")
    n_blocks = max(1, -(-patterns.count() // QUERY_BLOCK))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values("key").reset_index(drop=True)
        for _, own in pdf.groupby(pdf["key"].str.len()):
            edges, entry = build_graph(lifted(np.frombuffer(b"".join(own["key"]), dtype=np.float64).reshape(len(own), -1)))
            out.append(pd.DataFrame({"shard": own["shard"].to_numpy(), "node": np.arange(len(own)), "entry": entry, "key": own["key"].to_numpy(), "vec_ids": own["vec_ids"].to_numpy(), "edges": [e.astype(np.int32) for e in edges]}))
        return pd.concat(out)

    shard = (F.col("first") + F.pmod(F.xxhash64("key"), F.col("own"))).cast("int").alias("shard")
    placed = nodes.join(F.broadcast(of_band), "band").select("key", "vec_ids", shard)
    graph = placed.repartition(max(1, shards), "shard").groupBy("shard").applyInPandas(build, "shard int, node int, entry int, key binary, vec_ids array<long>, edges array<int>")
    graph = materialise(graph, "graphs")

    def walk(pattern: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        sizes = pattern["key"].str.len()
        for width, own in shard.groupby(shard["key"].str.len()):
            keys, numbers = (pattern.loc[sizes == width, c].to_numpy() for c in ("key", "pattern"))
            if not len(keys):
                continue
            own = own.sort_values("node")
            exact = np.frombuffer(b"".join(own["key"]), dtype=np.float64).reshape(len(own), -1)
            vecs, edges = lifted(exact), np.stack(own["edges"].to_numpy()).astype(np.int64)
            level = np.zeros(len(own), dtype=np.float32)  # lengths are equal: they tell nothing apart
            asked = np.frombuffer(b"".join(keys), dtype=np.float64).reshape(len(keys), -1)
            ids = own["vec_ids"].to_numpy()
            for lo in range(0, len(keys), 256):
                q = asked[lo : lo + 256]
                unit = q / np.abs(q).max(axis=1, keepdims=True)
                found, _ = beam_search(vecs, level, edges, int(own["entry"].iloc[0]), np.c_[unit, np.zeros(len(q))].astype(np.float32), min(beam, len(own)))
                for i, nodes_found in enumerate(found):
                    good = nodes_found[nodes_found >= 0]
                    score = (exact[good] * q[i]).sum(axis=1)
                    good, score = good[o := np.argsort(-score, kind="stable")[: top + 1]], score[o]
                    out += [(numbers[lo + i], s, int(v)) for g, s in zip(good, score.tolist(), strict=True) for v in ids[g]]
        return pd.DataFrame(out, columns=["pattern", "score", "vec_id"])

    block = F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(n_blocks)).cast("int").alias("block")
    left = patterns.select("key", "pattern", block, F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1)))).alias("shard"))
    right = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(walk, "pattern long, score double, vec_id long")
    best = Window.partitionBy("pattern").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top + 1).drop("r")
    # One list per distinct query vector, then each query without itself.
    lists = found.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("worse"), "vec_id"))).alias("best"))
    lists = materialise(lists.join(patterns, "pattern").select("key", "best"), "answers")
    out = asked.join(lists, "key").select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, top).alias("best"))
    return out.select("query_id", F.posexplode("best").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.worse")).alias("score"))
