"""Exact top-k by inner product: ball-tree branch and bound in each shard.

Vectors are dealt to shards of bounded size; queries come in blocks of bounded size, so that a task
holds one shard and one block. A shard's vectors form a tree of balls: no vector v in a ball with
centre c and radius r has q.v above q.c + |q| r. Nodes are taken in order of that bound,
for all queries of the block to which they still matter; a node's bound below a query's current
k-th score drops the node for that query.

The k-th score is shared: each query first searches one shard, its home; what it finds there is its
starting bound in all others.

Nulls and odd cases: rows with a null identifier or vector, an empty one, or one with components that are null or not
finite take no part; only vectors of equal length are compared; rows with the query's identifier
aren't its candidates; a repeated row counts each time as candidate, and once as query; equal scores
go to the smaller identifier; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Vectors of a shard, queries of a block, and vectors of a leaf, about or at most.
SHARD, BLOCK, LEAF = 8192, 4096, 128


class BallTree:
    def __init__(self, vectors: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(vectors))
        self.vectors = vectors
        self.nodes: list[tuple[int, int, np.ndarray, float, int]] = []  # begin, end, centre, radius, first child or 0
        todo = [(0, len(vectors), -1)]
        while todo:
            begin, end, place = todo.pop()
            if place < 0:
                place = len(self.nodes)
                self.nodes.append(None)  # type: ignore[arg-type]
            own = vectors[self.order[begin:end]]
            centre = own.mean(0)
            far = ((own - centre) ** 2).sum(1)
            # A little more than computed, for rounding.
            radius = float(np.sqrt(far.max())) * (1 + 1e-9) + 1e-9
            child = 0
            if end - begin > leaf:
                pole = own[far.argmax()]
                other = own[((own - pole) ** 2).sum(1).argmax()]
                half = np.argsort(own @ (other - pole), kind="stable")
                self.order[begin:end] = self.order[begin:end][half]
                child = len(self.nodes)
                self.nodes += [None, None]  # type: ignore[list-item]
                middle = (begin + end) // 2
                todo += [(begin, middle, child), (middle, end, child + 1)]
            self.nodes[place] = (begin, end, centre, radius, child)
        self.vectors = vectors[self.order]


class _Best:
    """The k best (score, identifier) so far of each query."""

    def __init__(self, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.ident = np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        """Scores at or above the floor join; the queries they belong to are put in order again."""
        here = np.zeros(len(self.floor), bool)
        here[query] = True
        old = here[self.query]
        query, score, ident = (np.concatenate([a[old], b]) for a, b in ((self.query, query), (self.score, score), (self.ident, ident)))
        order = np.lexsort((ident, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        order, last, query = order[keep], place[keep] == self.k - 1, query[keep]
        self.query = np.concatenate([self.query[~old], query])
        self.score = np.concatenate([self.score[~old], score[order]])
        self.ident = np.concatenate([self.ident[~old], ident[order]])
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[order][last])


def search(tree: BallTree, idents: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> _Best:
    """The k best of the tree for each query, none of those below its floor needed."""
    idents = idents[tree.order]
    sizes = np.sqrt((queries**2).sum(1))
    best = _Best(k, floor)

    def bound(node: int, some: np.ndarray) -> np.ndarray:
        _, _, centre, radius, _ = tree.nodes[node]
        reach = queries[some] @ centre + sizes[some] * radius
        return reach + 1e-9 * (np.abs(reach) + sizes[some] * (np.sqrt((centre**2).sum()) + radius)) + 1e-6

    everyone = np.arange(len(queries))
    first = bound(0, everyone)
    heap = [(-float(first.max()), 0, everyone, first)]
    while heap:
        _, node, some, reach = heapq.heappop(heap)
        still = reach >= best.floor[some]
        some = some[still]
        if len(some) == 0:
            continue
        begin, end, _, _, child = tree.nodes[node]
        if child:
            for c in (child, child + 1):
                reach = bound(c, some)
                near = reach >= best.floor[some]
                if near.any():
                    heapq.heappush(heap, (-float(reach[near].max()), c, some[near], reach[near]))
            continue
        scores = queries[some] @ tree.vectors[begin:end].T  # whole numbers below 2^53: exact
        good = (scores >= best.floor[some][:, None]) & (idents[begin:end] != own[some][:, None])
        row, column = np.nonzero(good)
        if len(row):
            best.add(some[row], scores[row, column], idents[begin:end][column])
    return best


def quantised(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of each component; all vectors have one length."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(scale * flat).reshape(len(column), -1)


def _cell(k: int, scale: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ["query_id", "query_mark", "vec_id", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def cell(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], t) for t in kinds], names)
        if vectors.num_rows == 0 or queries.num_rows == 0:
            return empty
        v, q = quantised(vectors["vector"].combine_chunks(), scale), quantised(queries["vector"].combine_chunks(), scale)
        idents, own = vectors["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        floor = queries["floor"].cast(pa.float64()).fill_null(-np.inf).to_numpy().copy()
        if float(np.abs(v).max()) * float(np.abs(q).max()) * v.shape[1] < 2.0**53:
            best = search(BallTree(v), idents, q, own, floor, k)
            query, score, ident = best.query, best.score.astype(np.int64), best.ident
        else:
            query, score, ident = _plain(v, idents, q, own, k)
        return pa.table([pa.array(own[query]), queries["query_mark"].combine_chunks().take(pa.array(query)), pa.array(ident), pa.array(score, pa.int64())], names)

    return cell


def _plain(v: np.ndarray, idents: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """Huge components: whole numbers without limit, one query at a time; a score beyond a long is the nearest long."""
    big = [[int(x) for x in row] for row in v]
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for i, row in enumerate(q):
        whole = [int(x) for x in row]
        scores = ((-sum(a * b for a, b in zip(whole, other)), ident) for other, ident in zip(big, idents.tolist()) if ident != own[i])
        for score, ident in heapq.nsmallest(k, scores):
            out[0].append(i)
            out[1].append(max(-(1 << 63), min((1 << 63) - 1, -score)))
            out[2].append(ident)
    return out


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The k best of all rows for each row whose vec_id is divisible by `every`.

    vectors has vec_id and embedding. Returns query_id, rank (from 1), vec_id, score.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine).withColumn("size", F.size("vector"))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("query_mark", F.xxhash64("vector")).dropDuplicates(["vec_id", "query_mark"])
    asked = store(asked, "queries")
    n, m = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("long").alias("shard")
    at = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("long").alias("block")
    dealt = rows.select("size", home, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "vec_id", "vector")
    asked = asked.withColumns({"home": home, "block": at})
    cell = ["size", "shard", "block"]

    def run(queries: DataFrame) -> DataFrame:
        pairs = dealt.groupBy(*cell).cogroup(queries.select(*cell, "vec_id", "query_mark", "floor", "vector").groupBy(*cell))
        return pairs.applyInArrow(_cell(k, scale), "query_id long, query_mark long, vec_id long, score long")

    at_home = store(run(asked.select("*", F.col("home").alias("shard"), F.lit(None).cast("long").alias("floor"))), "home-shard")
    floors = at_home.groupBy("query_id", "query_mark").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floors = floors.select(F.col("query_id").alias("vec_id"), "query_mark", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    spread = asked.join(floors, ["vec_id", "query_mark"], "left").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = at_home.unionByName(run(spread.where("shard <> home")))
    place = F.row_number().over(Window.partitionBy("query_id", "query_mark").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
