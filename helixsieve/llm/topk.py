"""Exact top-k search by inner product: ball trees, branch and bound per shard.

Vectors are quantised to integers, ``floor(scale * x)``, and dealt into shards by hash of the row's own key. Each
shard's ball tree is built once and kept as one row: nodes split at the middle of their widest direction, and each, inner
or leaf, has centre and radius. A query starts at the root; of the nodes open to it, it takes the one of the largest
upper bound, ``q . centre + |q| * radius``, opens an inner node's children or scores a leaf's rows, and ends where that
bound falls below its k-th score so far. All queries of a batch step at once, those at one node together.

The k-th score is shared: shards are searched in rounds of 1, 1, 2, 4, ..., and each round begins with the k-th scores of
all before it. A round's tasks are shards times blocks of queries: a tree meets a stream of queries, so no task holds
more than one tree and a batch. Trees move once a block of ``block_rows`` queries, queries once a shard.

Vectors that are null, or hold a null or non-finite component, take no part. A shorter vector is padded with zeros. A
null vec_id is neither query nor candidate, for it has no place in an order. Repeated rows are candidates each; a
query's own vec_id is no candidate of its, in any of its rows; repeated query rows give one result, that of the smallest
vector. Ties go to the smaller vec_id. Scores are ranked as exact integers whatever their size, and returned as the
nearest 64-bit integer. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixsieve.llm.common import Scratch, with_uid

LEAF = 128
#: Below this bound float64 sums of integer products are exact.
EXACT = float(1 << 52)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Parts in which a query's results are cut to k before they meet.
PARTS = 64


class BallTree:
    """Nodes as slices of the reordered rows, in order of their making: start, end, left child (0: a leaf), centre, radius."""

    NAMES = ("ids", "x", "nodes", "centres", "radii")

    def __init__(self, **arrays: np.ndarray):
        for name in self.NAMES:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray) -> BallTree:
        """x is float64 of integers; children of a node are neighbours."""
        order, nodes, centres, radii = np.arange(len(x)), [[0, len(x), 0]], [], []
        at = 0
        while at < len(nodes):
            a, b, _ = nodes[at]
            own = x[order[a:b]]
            centre = own.mean(0)
            away = own - centre
            far = np.sqrt((away * away).sum(1))
            centres.append(centre)
            radii.append(float(far.max()))
            if b - a > LEAF and radii[-1] > 0:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(away @ away[far.argmax()], middle)]
                nodes[at][2] = len(nodes)
                nodes += [[a, a + middle, 0], [a + middle, b, 0]]
            at += 1
        return cls(ids=ids[order], x=x[order], nodes=np.array(nodes), centres=np.array(centres), radii=np.array(radii))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.NAMES})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> BallTree:
        with np.load(io.BytesIO(data), allow_pickle=False) as own:
            return cls(**{name: own[name] for name in cls.NAMES})

    def bounds(self, q: np.ndarray, norms: np.ndarray, node: int) -> np.ndarray:
        """Upper bounds of inner products with a node's rows; a little more, so that rounding hides no tie."""
        ball = q @ self.centres[node] + norms * self.radii[node]
        slack = (np.abs(q) @ np.abs(self.centres[node]) + norms * self.radii[node]) * 1e-9 + 1e-6
        return np.nan_to_num(ball + slack, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def _dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integers: exact in float64 where that holds the sums, and exact Python integers elsewhere."""
    out = q @ x.T
    large = np.outer(np.abs(q).sum(1), np.abs(x).max(1, initial=0)) >= EXACT
    if large.any():
        out = out.astype(object)
        for i, j in np.argwhere(large).tolist():
            out[i, j] = sum(int(a) * int(b) for a, b in zip(q[i].tolist(), x[j].tolist(), strict=True))
    return out


def _below(score: int) -> float:
    """A float no larger than the integer."""
    try:
        return float(np.nextafter(float(score), -np.inf))
    except OverflowError:
        return -np.inf if score < 0 else float(np.finfo(float).max)


def search(tree: BallTree, qids: np.ndarray, q: np.ndarray, k: int, floors: list[int | None]) -> list[list[tuple[int, int]]]:
    """For each query its k best (score, vec_id) of the tree among those that may reach its floor, best first."""
    best: list[list[tuple[int, int]]] = [[] for _ in qids]  # heaps of (score, -vec_id)
    floor = np.array([-np.inf if f is None else _below(f) for f in floors])
    norms, every = np.sqrt((q * q).sum(1)), np.arange(len(q))
    open_ = np.full((len(q), len(tree.nodes)), -np.inf)
    open_[:, 0] = tree.bounds(q, norms, 0)
    waits = np.zeros(open_.shape, bool)
    waits[:, 0] = True
    while True:
        top = np.where(waits, open_, -np.inf).argmax(1)
        alive = every[waits[every, top] & (open_[every, top] >= floor)]
        if not len(alive):
            return [[(s, -v) for s, v in sorted(h, reverse=True)] for h in best]
        alive = alive[np.argsort(top[alive], kind="stable")]
        for own in np.split(alive, np.flatnonzero(np.diff(top[alive])) + 1):
            node = int(top[own[0]])
            waits[own, node] = False
            a, b, child = tree.nodes[node].tolist()
            if child:
                for c in (child, child + 1):
                    open_[own, c] = np.minimum(open_[own, node], tree.bounds(q[own], norms[own], c))
                    waits[own, c] = True
                continue
            scores = _dot(q[own], tree.x[a:b])
            good = (scores >= floor[own][:, None]) & (tree.ids[None, a:b] != qids[own][:, None])
            for i in np.flatnonzero(good.any(1)).tolist():
                heap, cols = best[own[i]], np.flatnonzero(good[i])
                if len(cols) > k and scores.dtype != object:
                    cols = cols[np.lexsort((tree.ids[a + cols], -scores[i][cols]))][:k]
                for c in cols.tolist():
                    item = (int(scores[i][c]), -int(tree.ids[a + c]))
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
                if len(heap) == k:
                    floor[own[i]] = max(floor[own[i]], _below(heap[0][0]))


def usable(vec: Column) -> Column:
    """Whether a vector takes part."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _stack(rows: list, dim: int, scale: int) -> np.ndarray:
    """Quantised vectors as rows of doubles, zeros at the end of short ones."""
    out = np.zeros((len(rows), dim))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return np.floor(scale * out)


def _split(score: int) -> tuple[int, bytes]:
    """The nearest 64-bit integer, and of a score beyond them what it exceeds them by, as bytes in order."""
    if LEAST < score < MOST:
        return score, b""
    bits = 4096  # more than any sum of squares of doubles has
    return (MOST, (score - MOST).to_bytes(bits // 8)) if score > 0 else (LEAST, (score + (1 << bits)).to_bytes(bits // 8 + 1))


def _join(score: int, more: bytes | None) -> int:
    if not more:
        return score
    return MOST + int.from_bytes(more) if score > 0 else int.from_bytes(more) - (1 << 4096)


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 20, scale: int = 64, shard_rows: int = 4096, block_rows: int = 1 << 16, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id and score. Both frames have vec_id and embedding."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "topk")

    def own(df: DataFrame, *more: str) -> DataFrame:
        df = df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), *more)

    vectors = own(with_uid(vectors.select("vec_id", "embedding"), scratch=scratch), "uid")
    queries = scratch.save(own(queries).groupBy("vec_id").agg(F.min("x").alias("x")), "queries")
    n, dim = vectors.agg(F.count("*"), F.max(F.size("x"))).first()
    m, qdim = queries.agg(F.count("*"), F.max(F.size("x"))).first()
    shards, blocks, dim = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows)), max(dim or 0, qdim or 0, 1)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree.build(pdf["vec_id"].to_numpy(), _stack(pdf["x"].tolist(), dim, scale))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "tree": [tree.dump()]})

    dealt = vectors.select("vec_id", "x", F.pmod(F.xxhash64("uid.f", "uid.r"), F.lit(shards)).cast("int").alias("shard"))
    trees = scratch.save(dealt.groupBy("shard").applyInPandas(build, "shard int, tree binary"), "trees")
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    names = ["query_id", "vec_id", "score", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by shard and block, a tree before its queries."""
        tree = at = None
        for batch in batches:
            cells = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "block")), strict=True))
            blobs = batch.column("tree")
            begin = 0
            for i in range(1, len(cells) + 1):
                if i < len(cells) and not blobs[i].is_valid and cells[i] == cells[begin]:
                    continue
                rows, begin = batch.slice(begin, i - begin), i
                if rows.column("tree")[0].is_valid:
                    tree, at = BallTree.load(rows.column("tree")[0].as_py()), cells[i - 1]
                    rows = rows.slice(1)
                if not rows.num_rows or tree is None or at != cells[i - 1]:  # a shard without rows has no tree
                    continue
                floors = [None if s is None else _join(s, f) for s, f in zip(rows.column("floor").to_pylist(), rows.column("floor_more").to_pylist(), strict=True)]
                qids = rows.column("vec_id").to_numpy()
                got = search(tree, qids, _stack(rows.column("x").to_pylist(), dim, scale), k, floors)
                found = [(q, v, *_split(s)) for q, own in zip(qids.tolist(), got, strict=True) for s, v in own]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

    def cut(found: DataFrame, key: list[str]) -> DataFrame:
        """The k best of each key; ties to the smaller vec_id, whose bits, turned over, make the larger number."""
        one = F.struct("score", "more", F.bitwise_not("vec_id").alias("no"))
        top = F.slice(F.sort_array(F.collect_list(one), asc=False), 1, k)
        return found.groupBy(*key).agg(top.alias("top"))

    def rows_of(best: DataFrame) -> DataFrame:
        return best.select("query_id", F.explode("top").alias("t")).select("query_id", F.bitwise_not("t.no").alias("vec_id"), "t.score", "t.more")

    best, first, round_ = None, 0, 0
    while first < shards:
        last = min(shards, max(1, 2 * first))
        floors = None
        if best is not None:
            floors = best.where(F.size("top") >= k).select(F.col("query_id").alias("vec_id"), F.element_at("top", -1).alias("f"))
            floors = floors.select("vec_id", F.col("f.score").alias("floor"), F.col("f.more").alias("floor_more"))
        ask = asked.join(floors, "vec_id", "left") if floors is not None else asked.withColumns({"floor": F.lit(None).cast("long"), "floor_more": F.lit(None).cast("binary")})
        ask = ask.select(F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("shard"), "block", F.lit(None).cast("binary").alias("tree"), "vec_id", "x", "floor", "floor_more")
        own_trees = trees.where(F.col("shard").between(first, last - 1)).select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "tree")
        rows = own_trees.unionByName(ask, allowMissingColumns=True).withColumn("side", F.col("tree").isNull())
        rows = rows.repartition("shard", "block").sortWithinPartitions("shard", "block", "side")
        found = rows.mapInArrow(run, "query_id long, vec_id long, score long, more binary")
        if best is not None:
            found = found.unionByName(rows_of(best))
        # At most k rows a query and shard: the k best of their parts first, then of these.
        parts = rows_of(cut(found.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS))), ["query_id", "part"]))
        best = scratch.save(cut(parts, ["query_id"]), f"best{round_}")
        first, round_ = last, round_ + 1
    ranked = best.select("query_id", F.posexplode("top").alias("at", "t"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.bitwise_not("t.no").alias("vec_id"), "t.score")
