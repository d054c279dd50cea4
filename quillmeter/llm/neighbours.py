"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard, shard results merged.

Equal vectors are indexed once with their smallest ids (k + 1 of them suffice for any query's k, its own left out), and dealt to
shards by a hash of the vector, so a common vector is one node. A shard's graph is built in batches of inserts: each batch
searches the graph so far in lockstep, all queries a step at once in numpy, is compared with itself, and links to a
diverse choice of what it found; full lists are chosen anew. Levels are drawn from the vector's hash. To turn largest inner
product into smallest distance, vectors of a shard get one more component that makes all of them equally long. The graph is
stored as flat neighbour arrays, a row per node, in the shared folder. Blocks of queries then meet each shard, in tasks of bounded
size, and the best of all shards remain, scored in double precision on the original vectors.

Shards hold about ``shard_rows`` vectors at most, and there are ``shards`` at least. Memory of a task: one shard and a block of queries.

Edge cases: null and zero vectors and those with null or non-finite components take no part; doubles stay doubles, floats floats, and scores are in double precision; vectors of another length than
the first are an error; equal scores are ordered by id; fewer candidates than k give fewer rows; repeated rows of an id count
once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K, EVERY, SHARDS, SHARD_ROWS, QUERY_BLOCK, LINKS, EF_BUILD, EF_SEARCH, BATCH = 20, 20, 6, 10000, 16384, 16, 48, 96, 256
NODES = "shard int, node int, level int, vid long, vec {vec}, ids array<long>, near array<int>, upper array<int>"


class Graph:
    """vectors: (n, d) float32; near: (n, 2 * links) and by upper level (n, links), -1 where there is none."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: int):
        self.v, self.level, self.links = vectors, levels, links
        self.near = [np.full((len(vectors), 2 * links if k == 0 else links), -1, dtype=np.int32) for k in range(int(levels.max(initial=0)) + 1)]
        self.entry = -1

    def distances(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Between each query and its own nodes, as -2 * product (all nodes are equally long)."""
        return -np.einsum("qd,qkd->qk", q, self.v[nodes])

    def search(self, q: np.ndarray, entry: np.ndarray, ef: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in lockstep: nodes and distances, nearest first, -1 and inf where fewer are found."""
        n, table = len(q), self.near[level]
        beam = np.full((n, ef), -1, dtype=np.int64)
        dist = np.full((n, ef), np.inf, dtype=np.float32)
        done = np.ones((n, ef), dtype=bool)
        seen = np.zeros((n, len(self.v)), dtype=bool)
        rows = np.arange(n)
        width = min(ef, entry.shape[1])
        ok = entry[:, :width] >= 0
        beam[:, :width] = entry[:, :width]
        dist[:, :width] = np.where(ok, self.distances(q, np.maximum(entry[:, :width], 0)), np.inf)
        done[:, :width] = ~ok
        seen[np.repeat(rows, width)[ok.ravel()], entry[:, :width].ravel()[ok.ravel()]] = True
        active = rows
        while len(active):
            open_ = np.where(done[active], np.inf, dist[active])
            pick = open_.argmin(axis=1)
            going = np.isfinite(open_[np.arange(len(active)), pick])
            active, pick = active[going], pick[going]
            if not len(active):
                break
            done[active, pick] = True
            nodes = table[beam[active, pick]]
            fresh = nodes >= 0
            fresh &= ~seen[active[:, None], np.maximum(nodes, 0)]
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            seen[active[r], nodes[r, c]] = True
            d = np.full(nodes.shape, np.inf, dtype=np.float32)
            d[r, c] = -np.einsum("kd,kd->k", q[active[r]], self.v[nodes[r, c]])
            all_d = np.concatenate([dist[active], d], axis=1)
            best = np.argpartition(all_d, ef - 1, axis=1)[:, :ef] if all_d.shape[1] > ef else np.argsort(all_d, axis=1)
            dist[active] = np.take_along_axis(all_d, best, 1)
            beam[active] = np.take_along_axis(np.concatenate([beam[active], np.where(fresh, nodes, -1)], axis=1), best, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), best, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        dist, beam = np.take_along_axis(dist, order, 1), np.take_along_axis(beam, order, 1)
        return np.where(np.isfinite(dist), beam, -1), dist

    def chosen(self, d: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """Of each row's nodes, nearest first, those no nearer to one chosen before than to the row itself; then the nearest of the rest."""
        n, width = nodes.shape
        v = self.v[np.maximum(nodes, 0)]
        between = -np.einsum("nad,nbd->nab", v, v)
        take = np.zeros((n, width), dtype=bool)
        for k in range(width):
            covered = ((between[:, k, :] < d[:, k, None]) & take).any(axis=1)
            take[:, k] = (nodes[:, k] >= 0) & ~covered & (take.sum(axis=1) < most)
        rank = np.where(take, 0, np.where(nodes >= 0, 1, 2)) * width + np.arange(width)
        order = np.argsort(rank, axis=1)[:, :most]
        return np.take_along_axis(nodes, order, 1)

    def build(self, ef: int, batch: int) -> Graph:
        order = np.lexsort((np.arange(len(self.v)), -self.level))  # highest first, so that upper levels stand before the many
        at = 0
        while at < len(order):
            new = order[at : at + min(batch, max(1, at))]
            self._insert(new, ef)
            at += len(new)
        return self

    def _insert(self, new: np.ndarray, ef: int) -> None:
        if self.entry < 0:
            self.entry = int(new[0])
            return
        q = self.v[new]
        entry = np.full((len(new), 1), self.entry, dtype=np.int64)
        top = int(self.level[self.entry])
        for level in range(top, -1, -1):
            mine = self.level[new] >= level
            if not mine.any():
                entry = self.search(q, entry, 1, level)[0]
                continue
            found, dist = self.search(q, entry, ef, level)
            entry = found[:, :8]
            own = new[mine]
            inside = -(self.v[own] @ self.v[own].T)
            inside[np.arange(len(own)), np.arange(len(own))] = np.inf
            all_d = np.concatenate([dist[mine], inside], axis=1)
            nodes = np.concatenate([found[mine], np.broadcast_to(own, inside.shape)], axis=1)
            self._link(own, nodes, all_d, level, ef)

    def _link(self, own: np.ndarray, nodes: np.ndarray, d: np.ndarray, level: int, ef: int) -> None:
        table = self.near[level]
        order = np.argsort(d, axis=1, kind="stable")[:, :ef]
        d, nodes = np.take_along_axis(d, order, 1), np.take_along_axis(nodes, order, 1)
        nodes = np.where(np.isfinite(d), nodes, -1)
        picked = self.chosen(d, nodes, self.links)
        table[own, : picked.shape[1]] = picked
        # And back: each picked node gets its new neighbours, and chooses anew if they are too many.
        source, target = np.repeat(own, picked.shape[1]), picked.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        begin = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, dtype=np.int64)
        nth = np.arange(len(target)) - np.repeat(begin, np.diff(np.r_[begin, len(target)]))
        touched, most = target[begin], table.shape[1]
        wide = np.full((len(touched), most + (int(nth.max()) + 1 if len(nth) else 0)), -1, dtype=np.int64)
        wide[:, :most] = table[touched]
        wide[np.searchsorted(touched, target), most + nth] = source
        for part in range(0, len(touched), 512):
            rows = wide[part : part + 512]
            dist = np.where(rows >= 0, self.distances(self.v[touched[part : part + 512]], np.maximum(rows, 0)), np.inf)
            order = np.argsort(dist, axis=1, kind="stable")
            dist, rows = np.take_along_axis(dist, order, 1), np.take_along_axis(rows, order, 1)
            twice = np.zeros(rows.shape, dtype=bool)
            twice[:, 1:] = (rows[:, 1:] == rows[:, :-1]) & (rows[:, 1:] >= 0)
            rows = np.where(twice, -1, rows)
            full = (rows >= 0).sum(axis=1) > most
            front = np.take_along_axis(rows, np.argsort(rows < 0, axis=1, kind="stable"), 1)[:, :most]
            if full.any():
                cut = 3 * most
                front[full] = self.chosen(dist[full][:, :cut], rows[full][:, :cut], most)
            table[touched[part : part + 512]] = front

    def query(self, q: np.ndarray, ef: int) -> np.ndarray:
        entry = np.full((len(q), 1), self.entry, dtype=np.int64)
        for level in range(int(self.level[self.entry]), 0, -1):
            entry = self.search(q, entry, 4, level)[0]
        return self.search(q, entry, ef, 0)[0]


def levels_of(hashes: np.ndarray, links: int) -> np.ndarray:
    u = ((hashes.astype(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return np.floor(-np.log(u) / np.log(links)).astype(np.int32)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and len(values) % len(flat):
        raise ValueError("vectors of different lengths")
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def scaled(v: np.ndarray) -> np.ndarray:
    """v for the graph: single precision, and no component beyond 1, so that doubles of any size fit. Order by inner product stays."""
    most = np.abs(v).max(initial=0)
    return (v.astype(np.float64) / (most or 1)).astype(np.float32)


def build_shard(table: pa.Table, links: int, ef: int, batch: int) -> pa.Table:
    """table: shard, vid, vec, ids. The shard's graph as rows of NODES; upper holds the lists of levels 1 and up, one after the other."""
    table = table.take(pc.sort_indices(table, [("vid", "ascending")]))
    v = scaled(matrix(table["vec"]))
    norm = (v.astype(np.float64) ** 2).sum(axis=1)
    rest = np.sqrt(np.maximum(norm.max(initial=0) - norm, 0)).astype(np.float32)
    levels = np.minimum(levels_of(table["vid"].to_numpy(), links), 8)
    g = Graph(np.ascontiguousarray(np.concatenate([v, rest[:, None]], axis=1)), levels, links).build(ef, batch)
    upper = [np.concatenate([g.near[k][node] for k in range(1, level + 1)]) if level else np.zeros(0, dtype=np.int32) for node, level in enumerate(levels)]
    node = np.arange(len(v), dtype=np.int32)
    columns = [table["shard"], pa.array(node), pa.array(levels), table["vid"], table["vec"], table["ids"], pa.array(list(g.near[0]), pa.list_(pa.int32())), pa.array(upper, pa.list_(pa.int32()))]
    return pa.table(columns, names=["shard", "node", "level", "vid", "vec", "ids", "near", "upper"])


def load_shard(table: pa.Table, links: int) -> Graph:
    table = table.take(pc.sort_indices(table, [("node", "ascending")]))
    v, levels = scaled(matrix(table["vec"])), table["level"].to_numpy()
    g = Graph(np.ascontiguousarray(np.concatenate([v, np.zeros((len(v), 1), dtype=np.float32)], axis=1)), levels, links)
    g.near[0][:] = matrix(table["near"])
    upper = table["upper"].combine_chunks()
    flat, at = upper.flatten().to_numpy(zero_copy_only=False), upper.offsets.to_numpy() - upper.offsets[0].as_py()
    for node in np.flatnonzero(levels):
        for k in range(1, levels[node] + 1):
            g.near[k][node] = flat[at[node] + (k - 1) * links : at[node] + k * links]
    g.entry = int(np.lexsort((np.arange(len(v)), -levels))[0])
    return g


def search_shard(nodes: pa.Table, queries: pa.Table, k: int, links: int, ef: int) -> pa.Table:
    """The k best of a shard for each query: query_id, vec_id, score."""
    out = ([], [], [])
    if nodes.num_rows and queries.num_rows:
        nodes = nodes.take(pc.sort_indices(nodes, [("node", "ascending")]))
        g = load_shard(nodes, links)
        q, qid = matrix(queries["vec"]), queries["query_id"].to_numpy()
        v, ids = matrix(nodes["vec"]).astype(np.float64), nodes["ids"].combine_chunks()
        flat, at = ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        if q.shape[1] != v.shape[1]:
            raise ValueError("vectors of different lengths")
        step = max(1, min(1024, (64 << 20) // max(1, len(v))))
        for part in range(0, len(q), step):
            some = q[part : part + step].astype(np.float64)
            unit = some / np.abs(some).max(axis=1, keepdims=True)
            unit = np.concatenate([unit / np.sqrt((unit**2).sum(axis=1, keepdims=True)), np.zeros((len(some), 1))], axis=1).astype(np.float32)
            found = g.query(unit, max(ef, k + 1))
            for row, own in enumerate(found):
                own = own[own >= 0]
                score = (v[own] * some[row]).sum(axis=1)
                size = at[own + 1] - at[own]
                ids_ = np.concatenate([flat[at[x] : at[x + 1]] for x in own]) if len(own) else np.zeros(0, dtype=np.int64)
                score = np.repeat(score, size)
                score, ids_ = score[ids_ != qid[part + row]], ids_[ids_ != qid[part + row]]
                best = np.lexsort((ids_, -score))[:k]
                out[0].append(np.full(len(best), qid[part + row]))
                out[1].append(ids_[best])
                out[2].append(score[best])
    return pa.table([pa.array(np.concatenate(x) if x else [], kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), v.cast(exact(vectors, vec_col)).alias("vec"))


def exact(vectors: DataFrame, vec_col: str) -> str:
    """The type that holds the vectors as they are: of floats, or else of doubles."""
    own = vectors.schema[vec_col].dataType.simpleString()
    return own if own == "array<float>" else "array<double>"


def build_index(vectors: DataFrame, k: int = K, shards: int = SHARDS, shard_rows: int = SHARD_ROWS, links: int = LINKS, ef: int = EF_BUILD, batch: int = BATCH, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The graphs of all shards, stored: NODES. Serves searches of up to k neighbours."""
    good = usable(vectors, id_col, vec_col).distinct().withColumn("vid", F.xxhash64("vec"))
    few = good.withColumn("n", F.row_number().over(Window.partitionBy("vid", "vec").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    one = common.stored(few.groupBy("vid", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    count = max(shards, -(-one.count() // shard_rows))
    dealt = one.select(F.pmod(F.xxhash64("vid", F.lit(1)), F.lit(count)).cast("int").alias("shard"), "vid", "vec", "ids")
    return common.stored(dealt.groupBy("shard").applyInArrow(lambda t: build_shard(t, links, ef, batch), NODES.format(vec=exact(vectors, vec_col))), "graphs")


def search(index: DataFrame, queries: DataFrame, k: int = K, links: int = LINKS, ef: int = EF_SEARCH, query_block: int = QUERY_BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per query: query_id, rank, vec_id, score, of the k nearest found."""
    q = common.stored(usable(queries, id_col, vec_col).distinct().select(F.col("vec_id").alias("query_id"), "vec"), "queries")
    blocks = max(1, -(-q.count() // query_block))
    shards = index.select("shard").distinct()
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    # A query goes to each shard: the shards' numbers stand in an array, as many as there are shards.
    numbers = [r.shard for r in shards.collect()]
    asked = q.select("query_id", "vec", block.alias("block"), F.explode(F.array(*map(F.lit, numbers)) if numbers else F.array().cast("array<int>")).alias("shard"))
    served = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = served.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(lambda n, a: search_shard(n, a, k, links, ef), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", **how) -> DataFrame:
    """For the rows whose id is divisible by every, the k nearest of all other rows."""
    index = build_index(vectors, k, id_col=id_col, vec_col=vec_col, **how)
    return search(index, vectors.where(F.pmod(F.col(id_col), F.lit(every)) == 0), k, id_col=id_col, vec_col=vec_col)


def op9(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
