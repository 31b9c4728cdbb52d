"""Exact deduplication with a heavy-hitter split (operator 8).

Each row's text, lower-cased A-Z, becomes a SHA-256 digest. Misra-Gries summaries of the partitions name the digests
that may hold more than 1/HEAVY of all rows; there are at most 4/3 * HEAVY of them whatever the input. Their exact
winners and sizes are counted with a map-side filter and broadcast, so rows of frequent texts never cross a shuffle;
all other digests use an ordinary aggregate and join.

Defined results: a null text counts as empty, and empty texts are equal to each other. A null doc_id loses to any
other and is kept only if its whole group has none. Of rows with the same text and the same doc_id one is kept. Other
columns are untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, keep_rows, kept, row_key, text_or_empty, written

HEAVY = 1024


def misra_gries(values, k: int, counts: dict | None = None) -> dict:
    """At most k counters over an iterable: any value with more than n / (k + 1) of n occurrences is among them.

    With the counters of what came before, it goes on from these.
    """
    counts = {} if counts is None else counts
    for v in values:
        if v in counts:
            counts[v] += 1
        elif len(counts) < k:
            counts[v] = 1
        else:
            counts = {x: c - 1 for x, c in counts.items() if c > 1}
    return counts


def summaries(k: int):
    def run(batches):
        kept()
        counts: dict = {}
        for b in batches:
            counts = misra_gries(b.column(0).to_pylist(), k, counts)
        yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "n"])

    return run


def heavy_digests(digests: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Every digest that holds more than 1/heavy of the rows, and some that hold more than 3/4 of that; bounded."""
    n = digests.count()
    sums = digests.select("digest").mapInArrow(summaries(4 * heavy), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= max(2, 0.75 * n / heavy)).select("digest")


def digest_table(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, rid, _evs_key, digest): rid tells apart rows that are otherwise the same."""
    return written(spark, docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), row_key(id_col, text_col).alias("_evs_key"), F.unhex(F.sha2(ascii_lower(text_or_empty(text_col)), 256)).alias("digest")), "digests")


def decisions(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (binary) and the row's key."""
    rows = digest_table(spark, docs, id_col, text_col)
    frequent = F.broadcast(written(spark, heavy_digests(rows, heavy), "heavy"))
    winner = (F.max(F.struct("doc_id", "rid")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    hot = rows.join(frequent, "digest", "left_semi").groupBy("digest").agg(*winner)
    hot = F.broadcast(written(spark, hot, "winners"))
    rest = rows.join(frequent, "digest", "left_anti")
    both = rows.join(hot, "digest").unionByName(rest.join(written(spark, rest.groupBy("digest").agg(*winner), "groups"), "digest"))
    return both.select("_evs_key", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "digest")


def keep_distinct(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """The rows of docs that stay, with docs' own columns."""
    said = decisions(spark, docs, id_col, text_col, heavy)
    return keep_rows(docs, written(spark, said.select("_evs_key", "kept"), "decisions"), id_col, text_col)
