"""Roll-ups: the audit of a benchmark and the evaluation of the auditor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text
from . import irt


def verdict(contaminated: Column, flagged: Column) -> Column:
    return F.when((contaminated > 0.3) | (flagged > 0.5), "MAJOR_REVISION_REQUIRED").when((contaminated > 0.1) | (flagged > 0.2), "PARTIAL_REVISION_RECOMMENDED").otherwise("ACCEPTABLE_WITH_MONITORING")


FAVOURED = 1.5


def faults(items: DataFrame, id_col: str, *more: str) -> DataFrame:
    """(id, more columns, kinds): the kinds of planted faults that the rules find in items (question, choices, answer).

    Stock phrases tell n-gram overlap, template patterns a template, the rules on one item length bias and leaked
    answers; position bias is laid to items at a place that FAVOURED times as many answers have as chance gives.
    """
    from . import contamination, shortcuts

    places = items.groupBy("answer").agg(F.count(F.lit(1)).alias("_n"))
    whole = places.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_places"))
    favoured = places.crossJoin(F.broadcast(whole)).where(F.col("_n") * F.col("_places") >= FAVOURED * F.col("_all")).select("answer", F.lit(True).alias("_favoured"))
    rules = shortcuts.reports(items, id_col).select(id_col, F.col("shortcuts.pattern").alias("_found"))
    has = lambda k: F.array_contains("_found", k)
    signs = {"ngram_overlap": contamination.audit_flag(F.col("question")), "template_fill": contamination.template_score(F.col("question")) > 0, "answer_leak": has("lexical_overlap"), "length_bias": has("length_bias"), "position_bias": F.col("_favoured")}
    kinds = F.array_compact(F.array(*[F.when(sign, kind) for kind, sign in signs.items()]))
    return items.join(F.broadcast(favoured), "answer", "left").join(rules, id_col).select(id_col, *more, kinds.alias("kinds"))


def detection(mix: DataFrame, id_col: str) -> DataFrame:
    """One row: recall of planted faults and precision of the flags raised, for a labelled mix of items."""
    found = faults(mix, id_col, "planted_type", "is_contaminated")
    flagged = F.size("kinds") > 0
    recall = F.avg(F.when(F.col("is_contaminated"), F.array_contains("kinds", F.col("planted_type")).cast("double")))
    precision = F.count_if(flagged & F.col("is_contaminated")) / F.nullif(F.count_if(flagged), F.lit(0))
    return found.agg(F.round(F.coalesce(recall, F.lit(0.0)), 4).alias("recall"), F.round(F.coalesce(precision, F.lit(0.0)), 4).alias("precision"))


def audit(report: DataFrame, flags: DataFrame, fitted: DataFrame | None = None, reliability: DataFrame | None = None) -> DataFrame:
    """One row from shortcut reports, a table of contaminated item ids (one row each), and, if there are responses,
    fitted items (flags) and the test's reliability."""
    whole = report.agg(F.count(F.lit(1)).alias("n_items"), F.avg((F.size("shortcuts") > 0).cast("double")).alias("flagged"))
    bad = flags.agg(F.count(F.lit(1)).alias("n_contaminated"))
    share = F.col("n_contaminated") / F.greatest(F.lit(1), F.col("n_items"))
    out = whole.crossJoin(bad).select("n_items", "n_contaminated", F.round(share, 3).alias("contamination_score"), F.round("flagged", 3).alias("flagged_item_fraction"), verdict(share, F.col("flagged")).alias("recommendation"))
    if fitted is not None:
        out = out.crossJoin(irt.flag_counts(fitted).withColumnRenamed("n_items", "n_fitted"))
    if reliability is not None:
        out = out.crossJoin(reliability.select(F.round("reliability", 6).alias("reliability")))
    return out


def priority(weak: DataFrame, contaminated: DataFrame, item: str, weak_most: int = 10, other_most: int = 10, most: int = 20) -> DataFrame:
    """(item, place): weak items by rank, then contaminated ones by id, each once. Both inputs are cut to a few rows."""
    a = weak.orderBy("rank").limit(weak_most).select(F.col("item").cast("string").alias(item), F.col("rank").alias("o"))
    b = contaminated.orderBy(item).limit(other_most).select(F.col(item).cast("string").alias(item), (F.row_number().over(Window.orderBy(F.col(item))) + weak_most).alias("o"))
    first = a.unionByName(b).groupBy(item).agg(F.min("o").alias("o"))
    return first.select(item, F.row_number().over(Window.orderBy("o")).alias("place")).where(F.col("place") <= most)


def self_bleu(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bleu): mean share of an item's bigrams that another item has, over others with bigrams; 0 without bigrams.

    Pairs without a common bigram add nothing, so a bigram that k items share adds k - 1 for each of them and no pair
    is ever formed. The bigrams' counts are written, so that the join's tasks can be split where one bigram is very common.
    """
    from ..sources.store import written

    own = items.select(id_col, text.bigrams(F.col(text_col)).alias("b"))
    n = own.where(F.size("b") > 0).agg(F.count(F.lit(1)).alias("n"))
    spread = own.select(id_col, F.size("b").alias("k"), F.explode("b").alias("b"))
    shared = written(items.sparkSession, spread.groupBy("b").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0"), "bigrams")
    sums = spread.join(shared, "b").groupBy(id_col, "k").agg(F.sum("others").alias("s"))
    return own.select(id_col).join(sums, id_col, "left").crossJoin(F.broadcast(n)).select(id_col, F.coalesce(F.col("s") / F.nullif(F.col("k") * (F.col("n") - 1), F.lit(0)), F.lit(0.0)).alias("bleu"))


def quality_score(recall: Column, precision: Column, mse: Column, diversity: Column, accuracy: Column) -> Column:
    return F.round(0.3 * recall + 0.3 * precision + 0.1 * (1 - F.least(F.lit(1.0), mse)) + 0.15 * diversity + 0.15 * accuracy, 4)


def as_json(report: DataFrame) -> Column:
    return F.to_json(F.struct(*report.columns))


def as_text() -> Column:
    """The audit's row for people."""
    return F.format_string("%d items, %d contaminated (%.1f%%), %.1f%% with shortcuts: %s", "n_items", "n_contaminated", F.col("contamination_score") * 100, F.col("flagged_item_fraction") * 100, "recommendation")


def named(cases: DataFrame, truth: str, response: str) -> DataFrame:
    """(accuracy, n): a case is right if its response holds the true pattern's id, or what stands before its underscore. Without
    a response it is wrong."""
    right = F.contains(response, truth) | F.contains(F.col(response), F.substring_index(truth, "_", 1))
    return cases.agg(F.avg(F.coalesce(right, F.lit(False)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
