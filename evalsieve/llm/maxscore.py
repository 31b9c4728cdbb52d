"""Exact top-k inner products by MaxScore (operator 5).

Components are quantised to floor(SCALE * x). Within a shard each dimension is a posting list whose impacts, seen from
the end that the query's sign makes the least, are never negative, so a dimension's greatest impact bounds what it
adds. Dimensions are split by these bounds: while the smallest ones together cannot lift a row over the k-th best
score they are non-essential. The essential lists are traversed; the other dimensions are probed, greatest bound
first, only for rows whose score so far plus all remaining bounds still competes. Shards' k best are merged.

Queries come in blocks of at most BLOCK_BYTES, which are broadcast; the candidates are never shuffled. Each task goes
through its candidates in shards and carries every query's k best on to the next shard, whose bounds they tighten; only
these are shuffled, to be merged.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of another length
than the query's are no candidates; a query's own row is none, another row of the same id is. Ties go to the smaller
vec_id. Queries without candidates have no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import written

SCALE, SHARD, STEP, BLOCK_BYTES = 256, 8192, 8, 32 << 20


def quantised(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))


def best_rows(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: greatest score first, then smallest id, then first row."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((rows[at], ids[at], -score[at]))[:k]]


class Shard:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, block: int = 2048):
        self.ids, self.rows, self.block = ids, rows, block
        self.lists = np.ascontiguousarray(vectors.T)
        self.low, self.high = self.lists.min(axis=1), self.lists.max(axis=1)

    def search(self, query: np.ndarray, own: int, k: int, best: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, rows, scores) of the k best rows other than own, among these and the ones in best."""
        ids, rows, scores = best or (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.lists.dtype))
        bound = np.abs(query) * (self.high - self.low)
        lowest = np.where(query >= 0, query * self.low, query * self.high)  # what a dimension adds at least
        floor = lowest.sum()
        order = np.argsort(-bound, kind="stable")
        rest = np.r_[bound[order][::-1].cumsum()[::-1], 0]  # all that the dimensions from here on can add
        for start in range(0, len(self.ids), self.block):
            at = np.arange(start, min(start + self.block, len(self.ids)))
            at = at[self.rows[at] != own]
            full = len(scores) == k
            # dimensions that can't lift a row to the k-th score together; equal scores count, as a smaller id wins
            essential = min(int(np.searchsorted(-rest, floor - scores[-1], "right")), len(order)) if full else len(order)
            dims = order[:essential]
            # exact sums of the essential dimensions; the others stand at their least until probed
            least = lowest[order[essential:]].sum()
            part = query[dims] @ self.lists[np.ix_(dims, at)] + least if essential else np.full(len(at), least, self.lists.dtype)
            done = essential
            while True:
                if full:
                    keep = part + rest[min(done, len(order))] >= scores[-1]
                    at, part = at[keep], part[keep]
                if done >= len(order) or not len(at):
                    break
                dims = order[done : done + STEP]
                part = part + query[dims] @ self.lists[np.ix_(dims, at)] - lowest[dims].sum()
                done += STEP
            if len(at):
                ids, rows, scores = np.concatenate((ids, self.ids[at])), np.concatenate((rows, self.rows[at])), np.concatenate((scores, part))
                first = best_rows(scores, ids, rows, k)
                ids, rows, scores = ids[first], rows[first], scores[first]
        return ids, rows, scores


def exact(vectors: np.ndarray, dims: int) -> np.ndarray:
    """Floats where all sums stay below 2**53 and are exact, else Python's integers."""
    most = int(np.abs(vectors).max(initial=0))
    return vectors.astype(float) if most * most * max(dims, 1) * 4 < 2**53 else vectors.astype(object)


def by_length(lists: pa.Array):
    """(length, places, matrix of int64) of the vectors of each length."""
    sizes = pc.list_value_length(lists).to_numpy()
    values, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield n, at, values[(ends[at] - n)[:, None] + np.arange(n)]


def search_task(shared, k: int, size: int):
    """(vec_id, row, v) -> (query_row, query_id, vec_id, score, row): each query's k best of this task's candidates."""

    def run(batches):
        query_row, query_id, some = shared.value  # of one block
        asked = {n: (at, vectors) for n, at, vectors in by_length(some)}
        best: list[tuple | None] = [None] * len(query_row)
        waiting: dict[int, list[tuple]] = {n: [] for n in asked}

        def search(n: int) -> None:
            ids, rows, vectors = map(np.concatenate, zip(*waiting[n]))
            waiting[n] = []
            both = exact(np.concatenate([vectors, asked[n][1]]), n)
            for start in range(0, len(ids), most := max(1, min(size, BLOCK_BYTES // (8 * n)))):
                part = slice(start, min(start + most, len(ids)))
                shard = Shard(both[part], ids[part], rows[part])
                for q, vector in zip(asked[n][0].tolist(), both[len(ids) :]):
                    old = best[q]
                    best[q] = shard.search(vector, query_row[q], k, old and (old[0], old[1], old[2].astype(both.dtype)))

        for b in batches:
            ids, rows = b.column("vec_id").to_numpy(), b.column("row").to_numpy()
            for n, at, vectors in by_length(b.column("v")):
                if n in asked:
                    waiting[n].append((ids[at], rows[at], vectors))
                    if sum(len(x) for x, _, _ in waiting[n]) >= size:
                        search(n)
        for n in [n for n, some in waiting.items() if some]:
            search(n)
        out = [(query_row[q], query_id[q], a, int(s), c) for q, found in enumerate(best) if found for a, c, s in zip(*found)]
        names = ["query_row", "query_id", "vec_id", "score", "row"]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * len(names))], names)

    return run


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows query_id, rank (from 1), vec_id, score: the k best candidates of each row of vectors with is_query."""
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), is_query.alias("ask"), F.col(vector_col).alias("v"))
    fine = x.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    fine = written(spark, fine.select("vec_id", F.coalesce("ask", F.lit(False)).alias("ask"), quantised(F.col("v")).alias("v"), F.monotonically_increasing_id().alias("row")), "vectors")
    asked, longest = fine.where("ask").agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, -(-asked * (longest or 0) * 8 // BLOCK_BYTES))
    found = []
    for block in range(blocks):
        own = F.pmod(F.xxhash64("row"), F.lit(blocks)) == block
        rows = fine.where("ask").where(own).select("row", "vec_id", "v").toArrow().combine_chunks()
        vectors = rows.column("v").combine_chunks() if len(rows) else pa.array([], pa.list_(pa.int64()))
        shared = spark.sparkContext.broadcast((rows.column("row").to_numpy(), rows.column("vec_id").to_numpy(), vectors))
        met = fine.select("vec_id", "row", "v").mapInArrow(search_task(shared, k, SHARD), "query_row long, query_id long, vec_id long, score long, row long")
        found.append(written(spark, met, "best"))
        shared.unpersist()
    met = reduce(lambda a, b: a.unionByName(b), found)
    nth = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return met.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
