"""Sharding by extendible hashing (operator 1).

A row's place is a string of hash bits: BITS bits of its key's MD5, then, for rows of one key alone, BITS bits of a
hash of the row itself. The directory starts as one bucket and splits a bucket on its next bit only while its rows
exceed the byte limit, so every shard is a bit prefix and fits.

The directory is a table, built on the executors. Bytes are counted per cell, a prefix of so many bits that CELLS cells
make up a shard's worth of bytes. Cells are gathered by ranges of 2**GROUP cells, and a task finds the shards of one
range from its cells; the driver sees the sums of the ranges alone (2**RANGES at most) and decides which buckets are
wider than a range. Cells that are too large themselves are counted again with STEP further bits, from their own rows,
until every bucket fits or holds a single row. Rows meet the directory by an equality join on their cell.

Defined results: null text has 0 bytes; null keys are one key. A row larger than the limit gets a shard of its own, as
deep as it takes to part it from the others; texts of any length are only measured. Equal rows are told apart by their
place in the input. An empty table has an empty directory. Columns besides key and text are not read by assign and
kept as they are by sharded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_bound, text_or_empty, written

LIMIT, BITS, CELLS, GROUP, RANGES, STEP = 1 << 20, 60, 16, 16, 20, 10
MAP = "c1 long, c2 long, depth long, shard_bytes long, fits boolean"


def hash_bits(column: Column) -> Column:
    """The first 60 bits of an MD5 as a long."""
    return F.conv(F.substring(F.md5(column), 1, BITS // 4), 16, 10).cast("long")


def cell(bits: int) -> list[Column]:
    """c1, c2: the first `bits` bits of h1 and h2 in their places, zeros after them."""
    first, second = min(bits, BITS), max(0, bits - BITS)
    cut = lambda h, n: F.shiftleft(F.shiftright(h, BITS - n), BITS - n) if n else F.lit(0).cast("long")
    return [cut("h1", first).alias("c1"), cut("h2", second).alias("c2")]


def below(c1: int, c2: int, start: int, end: int) -> int:
    """Bits start to end of a place."""
    whole = (c1 << BITS) | c2
    return (whole >> (2 * BITS - end)) & ((1 << (end - start)) - 1)


def split(sizes: np.ndarray, counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a bucket with bytes and rows per cell, a power of two of cells: each cell's leaf as depth and bytes, and
    whether the leaf fits. Leaves that don't fit are single cells."""
    full = int(len(sizes)).bit_length() - 1
    depth, total, fits = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
    open_ = np.zeros(1, np.int64)
    for d in range(full + 1):
        s = sizes.reshape(1 << d, -1).sum(axis=1)[open_]
        ok = (s <= limit) | (counts.reshape(1 << d, -1).sum(axis=1)[open_] <= 1)
        leaf = ok | (d == full)
        width = len(sizes) >> d
        at = (open_[leaf, None] * width + np.arange(width)).ravel()
        depth[at], total[at], fits[at] = d, np.repeat(s[leaf], width), np.repeat(ok[leaf], width)
        open_ = (2 * open_[~leaf, None] + np.arange(2)).ravel()
    return depth, total, fits


def leaves_of(start: int, end: int, limit: int):
    """The cells (r1, r2, c1, c2, bytes, n) of one bucket of `start` bits -> the leaf of each cell of `end` bits."""

    def run(task: pd.DataFrame) -> pd.DataFrame:
        at = np.array([below(a, b, start, end) for a, b in zip(task["c1"].tolist(), task["c2"].tolist())], np.int64)
        sizes, counts = np.zeros(1 << (end - start), np.int64), np.zeros(1 << (end - start), np.int64)
        sizes[at], counts[at] = task["bytes"], task["n"]
        depth, total, fits = split(sizes, counts, limit)
        return pd.DataFrame({"c1": task["c1"], "c2": task["c2"], "depth": start + depth[at], "shard_bytes": total[at], "fits": fits[at]})

    return run


def directory(spark: SparkSession, rows: DataFrame, limit: int = LIMIT, group: int = GROUP) -> list[tuple[int, DataFrame]]:
    """Maps from cells to leaves as (bits of the cells, table of MAP); rows whose leaf doesn't fit look in the next one."""
    sums = [F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")]
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits = min(BITS, (CELLS * total // limit).bit_length())
    ranges = min(RANGES, max(0, bits - group))
    counts = written(spark, rows.groupBy(*cell(bits)).agg(*sums), "cells")
    r1 = F.shiftright("c1", BITS - ranges)
    top = counts.groupBy(r1.alias("r")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).toArrow()
    sizes, number = np.zeros(1 << ranges, np.int64), np.zeros(1 << ranges, np.int64)
    at = top.column("r").to_numpy()
    sizes[at], number[at] = top.column("bytes").to_numpy(), top.column("n").to_numpy()
    depth, whole, fits = split(sizes, number, limit)
    wide = at[fits[at]]  # these ranges lie within one leaf; 2**RANGES rows at most
    wider = F.broadcast(spark.createDataFrame(pd.DataFrame({"r": wide, "depth": depth[wide], "shard_bytes": whole[wide]}).astype("int64"), "r long, depth long, shard_bytes long"))
    placed = counts.withColumn("r", r1)
    known = placed.join(wider, "r").select("c1", "c2", "depth", "shard_bytes", F.lit(True).alias("fits"))
    inner = placed.join(wider, "r", "left_anti").groupBy("r").applyInPandas(leaves_of(ranges, bits, limit), MAP)
    maps = [(bits, written(spark, known.unionByName(inner), "directory"))]
    while bits < 2 * BITS and not (large := maps[-1][1].where("not fits").select("c1", "c2")).isEmpty():
        end = min(bits + STEP, BITS if bits < BITS else 2 * BITS)
        c1, c2 = cell(bits)
        here = rows.select("h1", "h2", "bytes", c1, c2)
        here = here.join(F.broadcast(large) if row_bound(large, 500_000) else large, ["c1", "c2"], "left_semi").withColumnsRenamed({"c1": "r1", "c2": "r2"})
        deeper = here.groupBy("r1", "r2", *cell(end)).agg(*sums).groupBy("r1", "r2").applyInPandas(leaves_of(bits, end, limit), MAP)
        maps.append((end, written(spark, deeper, "directory")))
        bits = end
    return maps


def placed(rows: DataFrame, maps: list[tuple[int, DataFrame]]) -> DataFrame:
    """rows (h1, h2 and others) with their shard, its depth and bytes in place of h1 and h2."""
    others = [f"`{c}`" for c in rows.columns if c not in ("h1", "h2")]
    bits = F.concat(F.lpad(F.bin("h1"), BITS, "0"), F.lpad(F.bin("h2"), BITS, "0"))
    found, rest = [], rows
    for i, (n, leaves) in enumerate(maps):
        c1, c2 = cell(n)
        table = F.broadcast(leaves) if row_bound(leaves, 500_000) else leaves
        met = rest.withColumns({"c1": c1, "c2": c2}).join(table, ["c1", "c2"])
        last = i == len(maps) - 1
        found.append((met if last else met.where("fits")).select(*others, F.substring(bits, F.lit(1), F.col("depth").cast("int")).alias("shard"), "depth", "shard_bytes"))
        rest = met.where("not fits").drop("c1", "c2", "depth", "shard_bytes", "fits")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def with_bits(docs: DataFrame, key_col: str, text_col: str) -> list[Column]:
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    text = text_or_empty(text_col)
    row = F.concat_ws(":", F.monotonically_increasing_id().cast("string"), F.xxhash64(text).cast("string"))
    return [hash_bits(key).alias("h1"), hash_bits(row).alias("h2"), F.octet_length(text).cast("long").alias("bytes")]


def assign(spark: SparkSession, docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """One row per document: key, shard (its bits), depth, shard_bytes."""
    rows = written(spark, docs.select(F.col(key_col).alias("key"), *with_bits(docs, key_col, text_col)), "sizes")
    return placed(rows, directory(spark, rows, limit, group)).select("key", "shard", "depth", "shard_bytes")


def sharded(spark: SparkSession, docs: DataFrame, path: str, key_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """Writes docs under path as one Parquet folder per shard, named by its bits; returns what was written.

    The column _evs_shard is the shard's bits after a "b", so that readers of partitioned tables take it for a string.
    """
    rows = written(spark, docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *with_bits(docs, key_col, text_col)), "rows")
    out = placed(rows, directory(spark, rows.select("h1", "h2", "bytes"), limit, group)).select("row.*", F.concat(F.lit("b"), "shard").alias("_evs_shard"))
    out.repartition("_evs_shard").write.partitionBy("_evs_shard").parquet(path)
    return spark.read.parquet(path)
