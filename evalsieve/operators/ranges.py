"""Places, medians and draws over rows of any number: every step works on ranges, none sorts or holds all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.store import written


def placed(rows: DataFrame, by: list[str], within: list[str] | tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """rows with a long column `name`: 0, 1, ... in the order of the columns `by`, anew for each value of `within`.

    Rows are dealt out by ranges of (within, by), sorted there and numbered as they are written to the shared folder. The rows
    of one key stand together in each part, so a row's place is its number, less its key's first number in the part, plus
    the key's rows in the parts before: as many counts as there are keys and parts. Rows that are equal in `by` get places of
    their own.
    """
    keys = list(within)
    order = [F.col(c) for c in (*keys, *by)]
    numbered = written(rows.sparkSession, rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    numbered = numbered.withColumn("_part", F.shiftright("_at", 33))
    parts = numbered.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")
    parts = parts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_in"), (before - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_in")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return numbered.join(parts, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))


def median(rows: DataFrame, column: str, most: int = 10_000) -> float | None:
    """The exact median of a column's values, the mean of the middle two if their number is even; None if there are none.

    A hundred ranges are cut where a sketch puts the percentiles, their rows counted exactly, and the range with the middle
    cut again, until `most` rows or one value is left. A sketch that is off costs a round, never the result.
    """
    part = rows.select(F.col(column).cast("double").alias("x")).where("x is not null")
    n = part.count()
    if not n:
        return None
    low, high, before = (n - 1) // 2, n // 2, 0
    while n > most:
        cuts = sorted(set(part.agg(F.percentile_approx("x", [k / 100 for k in range(1, 100)], 1000)).first()[0]))
        place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("x")))
        counted = part.groupBy(place.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("first"), F.max("x").alias("last")).orderBy("k").collect()
        for r in counted:
            if low < before + r.n:
                break
            before += r.n
        if high >= before + r.n:  # the middle lies between two ranges
            return (r["last"] + next(o["first"] for o in counted if o.k > r.k)) / 2
        if r["first"] == r["last"]:
            return r["first"]
        part, n = part.where(F.col("x").between(r["first"], r["last"])), r.n
    values = sorted(r.x for r in part.collect())
    return (values[low - before] + values[high - before]) / 2


def number(*parts: Column | str) -> Column:
    """A whole number below 2^28 that depends on the parts alone: seven hex digits of an MD5, which any engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])), 1, 7), 16, 10).cast("long")


def shuffled_place(k: Column, n: Column, seed: Column, rounds: int = 4) -> Column:
    """Where a permutation of 0 .. n - 1, one for each seed, puts k: a Feistel network on pairs of digits, walked until it ends
    within n. Neither the permutation nor its other values are ever made.

    A digit has the least base whose square is n or more, so a walk takes four steps on average at most; 64 are followed, and
    what still isn't within n then (a chance below 10^-8 for n of 2 or more) stays where it was.
    """
    base = F.ceil(F.sqrt(n.cast("double"))).cast("long")

    def once(x: Column) -> Column:
        left, right = F.floor(x / base).cast("long"), x % base
        for r in range(rounds):
            left, right = right, (left + number(seed, str(r), right)) % base
        return left * base + right

    start = once(k)
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(steps < n, steps).otherwise(k)
