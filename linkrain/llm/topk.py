"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are dealt into shards by hash, queries into blocks; both are rows. Every block meets every shard
in a cell of its own, so that a task holds one of each. A shard has, for each dimension, its vectors sorted
by that component. For a query the lists are read in step from the end that the sign of the query's
component favours; new vectors are scored in full, and the threshold, the inner product of the query with
the values at the depth reached, bounds all vectors that no list has shown. The shard is left when the
threshold cannot beat the kth best so far. Steps double, so a list is read in few steps. Of a query's best of
all shards the first k are the result.

Sums are in float64 where no sum can reach 2**53, and else in integers of any size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
#: Candidates of a shard and queries of a block, at most about; less candidates while there are idle cores.
SHARD, BLOCK, _LEAST = 131_072, 20_000, 4096
_FIRST = 32
_LONG = (1 << 63) - 1


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, of equal ones those of the smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


class Shard:
    """Vectors in order of ids, and the order of each dimension's list."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by], np.ascontiguousarray(vectors[by])
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        #: vectors scored, and all
        self.scored = [0, 0]

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the best k without the query's own id."""
        n = len(self.ids)
        used = np.flatnonzero(query != 0)
        q = query[used]
        up = q > 0
        seen = np.zeros(n, bool)
        scores, rows = np.zeros(0, query.dtype), np.zeros(0, np.int64)
        depth, step, kth = 0, _FIRST, -math.inf
        while depth < n:
            end = min(n, depth + step)
            part = np.where(up[None, :], self.lists[n - end : n - depth, used][::-1], self.lists[depth:end, used]) if len(used) else np.arange(depth, end)[:, None]
            fresh = np.zeros(n, bool)
            fresh[part] = True
            new = np.flatnonzero(fresh & ~seen)
            seen |= fresh
            s = self.vectors[new] @ query
            ok = (s >= kth) & (self.ids[new] != own)
            scores, rows = np.concatenate([scores, s[ok]]), np.concatenate([rows, new[ok]])
            if len(scores) > k:
                top = best(scores, self.ids[rows], k)
                scores, rows = scores[top], rows[top]
            if len(scores) >= k:
                kth = max(kth, scores.min())
            # an equal score may have a smaller id
            if len(used) and self.vectors[part[-1], used] @ q < kth:
                break
            depth, step = end, step * 2
        self.scored = [self.scored[0] + int(seen.sum()), self.scored[1] + n]
        return scores, self.ids[rows]


def quantised(values: np.ndarray, scale: int, whole: bool) -> np.ndarray:
    """floor(scale * x) as float64, or as integers of any size if whole."""
    if not whole:
        return np.floor(scale * values)
    out = np.array([int(x) * scale if abs(x) >= 1 << 53 else math.floor(scale * x) for x in values.ravel().tolist()], object)
    return out.reshape(values.shape)


def top_k(vectors: DataFrame, query: str = "vec_id % 50 = 0", k: int = K, scale: int = 256, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every query, a row of vectors for which query holds.

    A component x counts as floor(scale * x). Queries and candidates meet by equal numbers of components only.

    Cases: rows that are null or hold null or non-finite components take no part; a query with fewer than k
    candidates has them all; equal scores go by the smaller id; a query's own id is no candidate; repeated ids
    are one query, by their first vector, and candidates each; scores are exact and ranked so, but one beyond
    64 bits is given as the last number of them; an empty table gives none; other columns are not read.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # rows equal in id and vector are candidates each, k of them at most have a place; the sum is partial before the shuffle
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    asked = vectors.where(fine).where(query).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    counts = vectors.where(fine).agg(F.count("*").alias("n"), F.coalesce(F.count_if(F.expr(query)), F.lit(0)).alias("q")).first()
    context = vectors.sparkSession.sparkContext
    shards = max(1, -(-counts["n"] // shard), min(2 * context.defaultParallelism, -(-counts["n"] // _LEAST)))
    blocks = max(1, -(-counts["q"] // block))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    size = F.size("v").alias("size")
    left = rows.select(size, F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), every(blocks, "block"), "vec_id", "v", "copies")
    right = asked.select(size, every(shards, "shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")

    def arrays(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        lists = cell.column("v").combine_chunks()
        return cell.column("vec_id").to_numpy(), lists.flatten().to_numpy().reshape(cell.num_rows, -1)

    def meet(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if candidates.num_rows and queries.num_rows:
            (ids, v), (own, q) = arrays(candidates), arrays(queries)
            copies = candidates.column("copies").to_numpy()
            ids, v = np.repeat(ids, copies), np.repeat(v, copies, axis=0)
            largest = (float(np.abs(v).max()) * scale + 1) * (float(np.abs(q).max()) * scale + 1) * v.shape[1] if v.size else 0.0
            whole = not largest < 1 << 53
            part = Shard(ids, quantised(v, scale, whole))
            for i, one in zip(own.tolist(), quantised(q, scale, whole)):
                scores, found = part.search(one, i, k)
                out[0].extend([i] * len(found))
                out[1].extend(found.tolist())
                out[2].extend(str(int(s)) for s in scores.tolist())
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["query_id", "vec_id", "exact"])

    key = ("size", "shard", "block")
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, exact string")
    # in order of numbers of any size: sign, number of digits, digits
    digits = F.regexp_replace("exact", "^-", "")
    up = ~F.startswith("exact", F.lit("-"))
    order = [F.desc(up), F.when(up, F.length(digits)).otherwise(-F.length(digits)).desc(), F.when(up, digits).desc_nulls_last(), F.when(~up, digits).asc_nulls_last(), "vec_id"]
    w = Window.partitionBy("query_id").orderBy(*order)
    score = F.coalesce(F.col("exact").try_cast("long"), F.when(up, _LONG).otherwise(-_LONG - 1)).alias("score")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)


def op4_topk(spark, sf_dir: str) -> DataFrame:
    from linkrain.llm.common import table

    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND c.vec_id != q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored) WHERE rank <= 5
"""
