"""Item response theory over long tables (model, item, response)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.store import written
from . import ranges, stats

#: the box of estimates, Newton steps planned at a time, and their number at most
A_RANGE, B_RANGE, STEPS, MOST_STEPS = (0.01, 5.0), (-4.0, 4.0), 4, 52


def p_2pl(theta: Column, a: Column, b: Column) -> Column:
    return 1 / (1 + F.exp(-a * (theta - b)))


def p_3pl(theta: Column, a: Column, b: Column, c: Column) -> Column:
    return c + (1 - c) * p_2pl(theta, a, b)


def information_2pl(theta: Column, a: Column, b: Column) -> Column:
    p = p_2pl(theta, a, b)
    return a * a * p * (1 - p)


def information_3pl(theta: Column, a: Column, b: Column, c: Column) -> Column:
    """a^2 (q / p) p*^2, p* the 2PL part: (p - c) / (1 - c) already is p*, so nothing more is divided out."""
    p, star = p_3pl(theta, a, b, c), p_2pl(theta, a, b)
    return a * a * (1 - p) / p * star * star


def information_3pl_rescaled(theta: Column, a: Column, b: Column, c: Column) -> Column:
    """The variant that divides by (1 - c)^2 once more; kept for comparison with results made by it."""
    return information_3pl(theta, a, b, c) / ((1 - c) * (1 - c))


def standard_error(information: Column) -> Column:
    return 1 / F.sqrt(F.greatest(information, F.lit(1e-8)))


def grid(spark: SparkSession, low: float, high: float, points: int) -> DataFrame:
    """theta at equal steps, and its place."""
    step = (high - low) / (points - 1)
    return spark.range(points).select(F.col("id").alias("g"), (F.lit(low) + F.col("id") * F.lit(step)).alias("theta"))


def abilities(responses: DataFrame) -> DataFrame:
    """(model, theta): logit of the mean response, clipped to [.01, .99]."""
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.avg("response")))
    return responses.groupBy("model").agg(F.ln(p / (1 - p)).alias("theta"))


def filled(models: DataFrame, items: DataFrame, scores: DataFrame, missing: float = 0.5) -> DataFrame:
    """Every model with every item: the score, or `missing`. Its size is the answer's own."""
    return models.crossJoin(items).join(scores, ["model", "item"], "left").select("model", "item", F.coalesce("response", F.lit(missing)).alias("response"))


def newton(cells: DataFrame, state: DataFrame) -> DataFrame:
    """One step of u * theta + v towards the most likely logit: state (item, u, v, moved), all items at once, by sums."""
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("u") * F.col("theta") + F.col("v")))
    p = 1 / (1 + F.exp(-x))
    q, miss = F.col("n") * p * (1 - p), F.col("right") - F.col("n") * p
    t = F.col("theta")
    said = cells.join(state.select("item", "u", "v"), "item").select("item", "u", "v", q.alias("q"), (q * t).alias("qt"), (q * t * t).alias("qtt"), miss.alias("g"), (miss * t).alias("gt"))
    sums = said.groupBy("item").agg(F.first("u").alias("u"), F.first("v").alias("v"), (F.sum("qtt") + 1e-10).alias("aa"), F.sum("qt").alias("ab"), (F.sum("q") + 1e-10).alias("bb"), F.sum("gt").alias("ga"), F.sum("g").alias("gb"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    du, dv = (F.col("bb") * F.col("ga") - F.col("ab") * F.col("gb")) / det, (F.col("aa") * F.col("gb") - F.col("ab") * F.col("ga")) / det
    cut = lambda d: F.greatest(F.lit(-5.0), F.least(F.lit(5.0), d))
    return sums.select("item", (F.col("u") + cut(du)).alias("u"), (F.col("v") + cut(dv)).alias("v"), F.greatest(F.abs(du), F.abs(dv)).alias("moved"))


def logistic(cells: DataFrame, items: DataFrame) -> DataFrame:
    """(item, u, v): the most likely logit u * theta + v of each item. Items that no longer move leave the rounds."""
    spark = cells.sparkSession
    state, done = items.select("item", F.lit(1.0).alias("u"), F.lit(0.0).alias("v"), F.lit(1.0).alias("moved")), []
    for _ in range(0, MOST_STEPS, STEPS):
        for _ in range(STEPS):
            state = newton(cells, state)
        found = written(spark, state, "newton")
        done.append(found.where("moved < 1e-10"))
        state = found.where("not (moved < 1e-10)")
        if state.isEmpty():
            break
    return reduce(lambda a, b: a.unionByName(b), [*done, state]).select("item", "u", "v")


#: the faces of the box: which parameter is fixed, and where
FACES = [("a", A_RANGE[0]), ("a", A_RANGE[1]), ("b", B_RANGE[0]), ("b", B_RANGE[1])]
def face_point() -> tuple[Column, Column]:
    """(a, b) of the place x on a face."""
    return F.when(F.col("fixed") == "a", F.col("at")).otherwise(F.col("x")), F.when(F.col("fixed") == "a", F.col("x")).otherwise(F.col("at"))


def clipped(p: Column) -> Column:
    return F.least(F.lit(1 - 1e-8), F.greatest(F.lit(1e-8), p))


def face_step(cells: DataFrame, state: DataFrame) -> DataFrame:
    """One step along each face towards the top, between low and high: Newton's where it stays between, else half-way."""
    t = F.col("theta")
    p, slope = p_2pl(t, *face_point()), F.when(F.col("fixed") == "a", -F.col("at")).otherwise(t - F.col("at"))
    live = (p > 1e-8) & (p < 1 - 1e-8)  # beyond, the clipped likelihood is flat
    keys = ["item", "face", "fixed", "at", "low", "high", "x"]
    said = cells.join(state.select(*keys), "item").select(*keys, F.when(live, (F.col("right") - F.col("n") * p) * slope).otherwise(0.0).alias("g"), F.when(live, F.col("n") * p * (1 - p) * slope * slope).otherwise(0.0).alias("h"))
    sums = said.groupBy("item", "face").agg(*[F.first(c).alias(c) for c in keys[2:]], F.sum("g").alias("g"), F.sum("h").alias("h"))
    low, high = F.when(F.col("g") > 0, F.col("x")).otherwise(F.col("low")), F.when(F.col("g") > 0, F.col("high")).otherwise(F.col("x"))
    to = sums.select("item", "face", "fixed", "at", low.alias("low"), high.alias("high"), "x", (F.col("x") + F.try_divide("g", "h")).alias("to"))
    x = F.when((F.col("to") >= F.col("low")) & (F.col("to") <= F.col("high")), F.col("to")).otherwise((F.col("low") + F.col("high")) / 2)
    return to.select("item", "face", "fixed", "at", "low", "high", x.alias("x"), F.abs(x - F.col("x")).alias("moved"))


def on_faces(cells: DataFrame, items: DataFrame) -> DataFrame:
    """(item, a, b): the most likely point on the faces of the box, for items whose best point lies outside of it."""
    spark = cells.sparkSession
    spans = [B_RANGE if f == "a" else A_RANGE for f, _ in FACES]
    faces = F.explode(F.array(*[F.struct(F.lit(k).alias("face"), F.lit(f).alias("fixed"), F.lit(v).alias("at"), F.lit(lo).alias("from"), F.lit(hi).alias("to")) for k, ((f, v), (lo, hi)) in enumerate(zip(FACES, spans))])).alias("s")
    grid = items.select("item", faces).select("item", "s.*").select("*", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("k")).withColumn("x", F.col("from") + F.col("k") * (F.col("to") - F.col("from")) / 40)
    p = clipped(p_2pl(F.col("theta"), *face_point()))
    log = F.col("right") * F.ln(p) + (F.col("n") - F.col("right")) * F.ln(1 - p)
    told = cells.join(grid, "item").groupBy("item", "face", "fixed", "at", "from", "to", "k").agg(F.sum(log).alias("ll"))
    best = told.groupBy("item", "face", "fixed", "at", "from", "to").agg(F.max(F.struct("ll", (-F.col("k")).alias("m"))).alias("b"))
    step, k = (F.col("to") - F.col("from")) / 40, -F.col("b.m")
    at = lambda i: F.col("from") + F.greatest(F.lit(0), F.least(F.lit(40), i)) * step
    state = best.select("item", "face", "fixed", "at", at(k - 1).alias("low"), at(k + 1).alias("high"), at(k).alias("x"), F.lit(1.0).alias("moved"))
    for _ in range(0, MOST_STEPS, STEPS):
        for _ in range(STEPS):
            state = face_step(cells, state)
        state = written(spark, state, "faces")
        if state.where("moved > 1e-10").isEmpty():
            break
    a, b = face_point()
    tops = cells.join(state, "item").groupBy("item", "face").agg(F.first(a).alias("a"), F.first(b).alias("b"), F.sum(log).alias("ll"))
    return tops.groupBy("item").agg(F.max_by(F.struct("a", "b"), F.struct("ll", (-F.col("face")).alias("m"))).alias("s")).select("item", "s.*")


def fit(responses: DataFrame) -> DataFrame:
    """(item, a, b, fit_p_value, flags): 2PL per item for abilities fixed beforehand.

    The logit a * theta - a * b is linear in (a, -a * b) and its likelihood concave, so Newton steps find the maximum; if it
    lies outside the box, the maximum is on a face. Every step is a sum over (item, theta, answers, right answers), for all
    items together: no item's responses are ever in one place, and an item has as many such rows as there are different
    abilities. Items answered right by 99 % or more (wrong: 1 %) have no estimate and are CEILING (FLOOR).
    """
    spark = responses.sparkSession
    known = responses.join(abilities(responses), "model").select("item", "theta", F.col("response").cast("double").alias("response"))
    r, t, n = F.col("response"), F.col("theta"), F.col("n")
    cells = written(spark, known.groupBy("item", "theta").agg(F.count("response").cast("double").alias("n"), F.sum("response").alias("right"), F.sum(r * r).alias("squares")), "cells")
    mean = lambda x: F.sum(x) / F.sum("n")
    means = cells.groupBy("item").agg(F.sum("n").alias("n"), mean(F.col("right")).alias("mean"), mean(F.col("squares")).alias("rr"), mean(n * t).alias("t"), mean(n * t * t).alias("tt"), mean(F.col("right") * t).alias("rt"))
    spread = (F.col("rr") - F.col("mean") * F.col("mean")) * (F.col("tt") - F.col("t") * F.col("t"))
    rho = (F.col("rt") - F.col("mean") * F.col("t")) / F.nullif(F.sqrt(F.greatest(spread, F.lit(0.0))), F.lit(0.0))
    items = written(spark, means.select("item", "mean", "n", rho.alias("rho")), "items")
    extreme = (F.col("mean") >= 0.99) | (F.col("mean") <= 0.01)
    line = logistic(cells, items.where(~extreme).select("item"))
    b = -F.col("v") / F.nullif(F.col("u"), F.lit(0.0))
    inside = F.coalesce(F.col("u").between(*A_RANGE) & b.between(*B_RANGE), F.lit(False))
    line = written(spark, line.select("item", F.col("u").alias("a"), b.alias("b"), inside.alias("inside")), "line")
    found, outside = line.where("inside").select("item", "a", "b"), line.where("not inside").select("item")
    if not outside.isEmpty():
        found = found.unionByName(on_faces(cells, outside))
    p_value = F.pandas_udf(lambda rho, n: pd.Series([stats.correlation_p_value(r, int(k)) for r, k in zip(rho, n)]), "double")
    a = F.when(extreme, 0.0).otherwise(F.col("a"))
    b = F.when(F.col("mean") >= 0.99, B_RANGE[0]).when(F.col("mean") <= 0.01, B_RANGE[1]).otherwise(F.col("b"))
    out = items.join(found, "item", "left").select("item", a.alias("a"), b.alias("b"), p_value("rho", "n").alias("fit_p_value"))
    return out.withColumn("flags", flags(F.col("a"), F.col("b")))


def flags(a: Column, b: Column) -> Column:
    """LOW_DISCRIMINATION, FLOOR, CEILING, or OK; a = 0 marks an item that all got right or wrong."""
    found = F.array_compact(F.array(F.when((a < 0.3) & (a > 0), "LOW_DISCRIMINATION"), F.when(b > 3, "FLOOR"), F.when(b < -3, "CEILING")))
    return F.when(F.size(found) == 0, F.array(F.lit("OK"))).otherwise(found)


def item_information(parameters: DataFrame, thetas: DataFrame) -> DataFrame:
    """(item, g, theta, information) over a grid; the grid is a fixed few dozen rows and is broadcast."""
    return parameters.crossJoin(F.broadcast(thetas)).withColumn("information", information_2pl(F.col("theta"), F.col("a"), F.col("b")))


def peaks(informed: DataFrame) -> DataFrame:
    """(item, peak_theta): where an item tells most; of equals the lowest."""
    best = F.max_by("theta", F.struct(F.round("information", 12), -F.col("g")))
    return informed.groupBy("item").agg(F.round(best, 2).alias("peak_theta"))


def test_information(informed: DataFrame) -> DataFrame:
    return informed.groupBy("g", "theta").agg(F.sum("information").alias("information"))


def test_summary(total: DataFrame) -> DataFrame:
    """One row: peak_theta (lowest of equals), most information, grid points with more than a tenth of it."""
    most = total.agg(F.max(F.round("information", 9)).alias("most"))
    return total.crossJoin(F.broadcast(most)).agg(F.min(F.when(F.round("information", 9) == F.col("most"), F.col("theta"))).alias("peak_theta"), F.first("most").alias("most"), F.count_if(F.col("information") > 0.1 * F.col("most")).alias("coverage"))


def reliability(informed_abilities: DataFrame) -> DataFrame:
    """One row: median error of measurement, variance of theta, reliability; from (theta, information) per model.

    The median is found by ranges: errors are never gathered."""
    spark = informed_abilities.sparkSession
    known = written(spark, informed_abilities.select("theta", standard_error(F.col("information")).alias("sem")), "errors")
    out = known.agg(F.var_pop("theta").alias("variance")).select(F.lit(ranges.median(known, "sem")).cast("double").alias("sem"), "variance")
    return out.select("sem", "variance", F.when(F.col("variance") > 0, F.greatest(F.lit(0.0), 1 - F.col("sem") * F.col("sem") / F.col("variance"))).otherwise(0.0).alias("reliability"))


def to_replace(parameters: DataFrame, most: int = 20) -> DataFrame:
    """(item, rank): items with a flag other than OK; low discrimination first, then the order of items."""
    first = F.get("flags", F.lit(0))
    order = Window.orderBy(F.when(first == "LOW_DISCRIMINATION", 0).otherwise(1), "item")
    worst = parameters.where(first != "OK").orderBy(F.when(first == "LOW_DISCRIMINATION", 0).otherwise(1), "item").limit(most)
    return worst.select("item", F.row_number().over(order).alias("rank"))


def flag_counts(parameters: DataFrame) -> DataFrame:
    has = lambda f: F.count_if(F.array_contains("flags", f))
    return parameters.agg(F.count(F.lit(1)).alias("n_items"), has("LOW_DISCRIMINATION").alias("low_discrimination"), has("CEILING").alias("ceiling"), has("FLOOR").alias("floor"))


def likelihood(responses: DataFrame, parameters: DataFrame) -> DataFrame:
    """(item, log_likelihood) of responses with theta under given parameters."""
    p = clipped(p_2pl(F.col("theta"), F.col("a"), F.col("b")))
    r = F.col("response")
    return responses.join(parameters, "item").groupBy("item").agg(F.sum(r * F.ln(p) + (1 - r) * F.ln(1 - p)).alias("log_likelihood"))


def recovery(estimates: DataFrame, truth: DataFrame, true_col: str) -> DataFrame:
    """One row: the mean squared error of estimated difficulties against known ones, and the number of items."""
    both = estimates.join(truth, "item")
    return both.agg(F.round(F.avg(F.pow(F.col("b") - F.col(true_col), F.lit(2.0))), 4).alias("mse"), F.count(F.lit(1)).alias("n"))
