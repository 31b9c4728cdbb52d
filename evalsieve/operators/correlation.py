"""Do benchmark scores still predict downstream scores? Correlations, trends and alerts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .ranges import placed

#: points whose inversions one task counts
BLOCK = 1 << 16

MIN_MODELS, MIN_PEARSON, MIN_TAU, FALLING, RISING = 3, 0.5, 0.6, -0.05, 0.02


def pearson(x: str, y: str) -> Column:
    """Null for constants and single rows, where the built-in one fails."""
    return F.covar_pop(x, y) / F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0))


def average_rank(column: str, keys: list[str]) -> Column:
    """Rank within keys; ties share the mean of their places."""
    by = Window.partitionBy(*keys)
    return F.rank().over(by.orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, column)) - 1) / 2


def with_ranks(scores: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return scores.withColumns({"rank_x": average_rank(x, keys), "rank_y": average_rank(y, keys)})


def inversions(rank: np.ndarray, weight: np.ndarray) -> float:
    """Sum of the products of weights over pairs whose first has the greater rank (ranks differ from each other).

    From the highest bit of the rank on: of two points that agree in all higher bits, a 1 before a 0 is an inversion.
    Exact as long as the sum stays below 2^53."""
    order = np.argsort(np.argsort(rank))
    total = 0.0
    for bit in reversed(range(int(len(order) - 1).bit_length())):
        high = order >> (bit + 1)
        one = (order >> bit & 1).astype(bool)
        sums = np.cumsum(np.where(one, weight, 0.0))
        begins = np.r_[True, high[1:] != high[:-1]]
        before = np.r_[0.0, sums[:-1]][begins][np.cumsum(begins) - 1]
        total += float(((sums - before) * np.where(one, 0.0, weight)).sum())
        again = np.argsort(order >> bit, kind="stable")
        order, weight = order[again], weight[again]
    return total


def discordant(points: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, d): weighted pairs of points (x, y, w) of a key that x and y order differently; points differ in x or y.

    A key of up to `block` points is one task's work. A larger one, of n points, is cut by x and by y into blocks of `block` or
    2 sqrt(n) places, whichever is more, so that fewer pairs of blocks meet than there are points. Pairs
    in one block by x are counted there, other pairs in one block by y there, and of all others only the blocks matter: they
    are points themselves, with the sum of their weights, and are counted the same way.
    """
    spark = points.sparkSession
    kinds = dict(points.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", d double"

    def told(group: pa.Table, d: float) -> pa.Table:
        return pa.table([*(group.column(k).slice(0, 1) for k in keys), pa.array([d])], [*keys, "d"])

    def whole(group: pa.Table) -> pa.Table:
        x, y, w = (group.column(c).to_numpy() for c in ("x", "y", "w"))
        by_x = np.lexsort((y, x))
        place = np.empty(len(x), np.int64)
        place[np.lexsort((np.arange(len(x)), y[by_x]))] = np.arange(len(x))
        return told(group, inversions(place, w[by_x].astype(float)))

    sizes = written(spark, points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")), "sizes")
    small = points.join(sizes.where(F.col("_size") <= block), keys, "left_semi")
    out = small.groupBy(*keys).applyInArrow(whole, schema)
    large = sizes.where(F.col("_size") > block).select(*keys, F.greatest(F.lit(block), 2 * F.ceil(F.sqrt("_size"))).cast("long").alias("_block"))
    if large.isEmpty():
        return out
    by_x = placed(points.join(large, keys), ["x", "y"], keys, "p")
    by_y = placed(by_x.select(*keys, "y", "p", "w", "_block"), ["y", "p"], keys, "r")
    both = written(spark, by_y.select(*keys, "p", "r", "w", F.floor(F.col("p") / F.col("_block")).alias("xs"), F.floor(F.col("r") / F.col("_block")).alias("ys")), "blocks")

    def within(group: pa.Table) -> pa.Table:
        p, r, w = (group.column(c).to_numpy() for c in ("p", "r", "w"))
        order = np.argsort(p)
        return told(group, inversions(r[order], w[order].astype(float)))

    def across(group: pa.Table) -> pa.Table:
        p, r, w, xs = (group.column(c).to_numpy() for c in ("p", "r", "w", "xs"))
        order = np.argsort(p)
        w = w[order].astype(float)
        return told(group, inversions(r[order], w) - inversions(np.lexsort((r[order], xs[order])).argsort(), w))

    cells = both.groupBy(*keys, "xs", "ys").agg(F.sum("w").alias("w")).select(*keys, F.col("xs").alias("x"), F.col("ys").alias("y"), "w")
    parts = [both.groupBy(*keys, "xs").applyInArrow(within, schema), both.groupBy(*keys, "ys").applyInArrow(across, schema), discordant(written(spark, cells, "cells"), keys, block)]
    return out.unionByName(parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*keys).agg(F.sum("d").alias("d")))


def kendall(scores: DataFrame, keys: list[str], x: str, y: str, block: int = BLOCK) -> DataFrame:
    """(keys, tau): tau-b of x and y within each key, null where either is constant. No pairs are formed: pairs in different
    order are inversions, tied ones follow from counts. Rows with a null (or a null key) take no part."""
    spark = scores.sparkSession
    named = scores.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(" and ".join(f"`{c}` is not null" for c in [*keys, "x", "y"]))
    points = written(spark, named.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("w")), "points")

    def tied(*by: str) -> DataFrame:
        n = F.col("n").cast("double")
        name = "_".join(("pairs", *by))
        return points.groupBy(*keys, *by).agg(F.sum("w").alias("n")).groupBy(*keys).agg(F.sum(n * (n - 1) / 2).alias(name))

    all_, in_x, in_y, in_both = (F.col(c) for c in ("pairs", "pairs_x", "pairs_y", "pairs_x_y"))
    told = tied().join(tied("x"), keys).join(tied("y"), keys).join(tied("x", "y"), keys).join(discordant(points, keys, block), keys)
    below = F.nullif(F.sqrt((all_ - in_x) * (all_ - in_y)), F.lit(0.0))
    return told.select(*keys, ((all_ - in_x - in_y + in_both - 2 * F.col("d")) / below).alias("tau"))


def records(scores: DataFrame, keys: list[str], x: str, y: str, least: int = MIN_MODELS) -> DataFrame:
    """(keys, n_models, pearson, spearman, tau) where at least `least` models have both scores."""
    both = scores.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    linear = with_ranks(both, keys, x, y).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_models"), pearson(x, y).alias("pearson"), pearson("rank_x", "rank_y").alias("spearman"))
    return linear.where(F.col("n_models") >= least).join(kendall(both, keys, x, y), keys, "left")


def trend(slope: Column) -> Column:
    return F.when(slope < FALLING, "DEGRADING").when(slope > RISING, "IMPROVING").otherwise("STABLE")


def alert_reason(pearson_r: Column, tau: Column, slope: Column) -> Column:
    """The first rule that holds, or null. A null figure raises no alert."""
    return F.when(pearson_r < MIN_PEARSON, F.format_string("pearson %.3f below %.2f", pearson_r, F.lit(MIN_PEARSON))).when(tau < MIN_TAU, F.format_string("kendall %.3f below %.2f", tau, F.lit(MIN_TAU))).when(slope < FALLING, F.format_string("slope %.4f below %.2f", slope, F.lit(FALLING)))


def reports(log: DataFrame, benchmark: str, time: str) -> DataFrame:
    """Per benchmark: the latest figures, slope of Pearson's r over the records in time order, trend, alert and reason."""
    nth = F.row_number().over(Window.partitionBy(benchmark).orderBy(time)) - 1
    placed = log.withColumn("nth", nth.cast("double"))
    slope = F.when(F.count(F.lit(1)) >= 3, F.coalesce(F.regr_slope("pearson", "nth"), F.lit(0.0))).otherwise(0.0)
    latest = F.max_by(F.struct("pearson", "spearman", "tau"), "nth")
    out = placed.groupBy(benchmark).agg(F.count(F.lit(1)).alias("n_records"), latest.alias("latest"), F.round(slope, 6).alias("slope"))
    out = out.select(benchmark, "n_records", "latest.*", "slope", trend(F.col("slope")).alias("trend"))
    reason = alert_reason(F.col("pearson"), F.col("tau"), F.col("slope"))
    return out.withColumn("reason", reason).withColumn("alert", F.col("reason").isNotNull())


def drops(log: DataFrame, benchmark: str, time: str, most: float = 0.1) -> DataFrame:
    """An extension: records whose r fell by more than `most` since the one before."""
    before = F.lag("pearson").over(Window.partitionBy(benchmark).orderBy(time))
    return log.withColumn("before", before).where(F.col("pearson") - F.col("before") < -most)
