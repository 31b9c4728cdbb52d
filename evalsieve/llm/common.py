"""What the operators of this subpackage share: the shared work folder, written tables, components."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import written

__all__ = ["written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lowers the session's bytes per Arrow batch to `most`, if they are more: texts are long, executors' memory is not."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > most:
        spark.conf.set(name, str(most))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def row_bound(df: DataFrame, most: int) -> bool:
    """True if df has at most that many rows: the check before any broadcast of data whose size isn't fixed."""
    return df.limit(most + 1).count() <= most


def with_ids(docs: DataFrame, ids: DataFrame, key: str, how: str, most: int = 500_000) -> DataFrame:
    """docs semi- or anti-joined (how) with a table of short keys: broadcast up to `most` of them, else a shuffle join."""
    return docs.join(F.broadcast(ids) if row_bound(ids, most) else ids, key, how)


#: up to so many edges (16 bytes each) one task finds the components
SMALL_GRAPH = 100_000


def joined_up(batches):
    """Edges (a, b), a > b -> (node, comp), by union-find."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (r := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(r, r)
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    yield pa.record_batch([pa.array(list(root), pa.int64()), pa.array([find(x) for x in list(root)], pa.int64())], ["node", "comp"])


def components(spark: SparkSession, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, comp), comp the smallest node.

    Alternating large-star and small-star steps, each a minimum per node joined back to the edges, so that a hub's
    edges are never gathered in one place; every round is written to the shared folder. Up to SMALL_GRAPH edges go to one
    task instead, which spares the rounds. Self-loops are allowed.
    """
    e = written(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    if row_bound(e, SMALL_GRAPH):
        return e.repartition(1).mapInArrow(joined_up, "node long, comp long")
    before = None
    while True:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        # written, so that the joins have two plain exchanges and a hub's rows can be split among tasks
        low = written(spark, both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), name)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # small star: each node's smaller neighbours and the node itself point at the smallest of them
        large = written(spark, large, name)
        least = written(spark, large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        e = written(spark, small, name)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp").union(e.select("b", "b").distinct().toDF("node", "comp"))


def kept(name: str | None = None, make=None):
    """One object for each worker process, made once and kept while tasks ask for it by its name; any other is dropped.

    Worker processes outlive tasks, stages and queries, so what an earlier operator remembered would take memory from the
    next one. It is kept in Arrow's namespace: this package is shipped by value, so its own lasts for one task only.
    """
    registry = vars(pa).setdefault("_evalsieve_kept", {})
    for other in [k for k in registry if k != name]:
        del registry[other]
        tidy()
    if name is not None and name not in registry:
        registry[name] = make()
    return registry.get(name)


def tidy() -> None:
    """Gives memory that Arrow's and C's allocators hold back to the system: worker processes outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def slices(batches, column: str = "text", most: int = 2_000_000):
    """Slices of Arrow batches with about `most` bytes in a column, so that few texts are Python objects at a time."""
    tidy()
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(start, end - start)
            start = end
        del batch
        tidy()


def row_key(id_col: str, text_col: str) -> Column:
    """Tells apart the rows of a table that differ in id or text: the id, then a hash of the text."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.xxhash64(text_or_empty(text_col)).cast("string"))


def keep_rows(docs: DataFrame, said: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that said (_evs_key, kept: a row for each row of docs) keeps, with docs' own columns.

    Rows of the same id and text can't be told apart; if some of them are kept and others not, one stays.
    """
    keys = said.groupBy("_evs_key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    lost, twins = keys.where("not kept").select("_evs_key"), keys.where("kept and n > 1").select("_evs_key")
    left = with_ids(docs.withColumn("_evs_key", row_key(id_col, text_col)), lost, "_evs_key", "left_anti")
    if not twins.isEmpty():
        left = with_ids(left, twins, "_evs_key", "left_anti").unionByName(with_ids(left, twins, "_evs_key", "left_semi").dropDuplicates(["_evs_key"]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
