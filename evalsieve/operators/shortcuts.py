"""Shortcut rules over multiple-choice items.

An item has `question`, `choices` (array of texts) and `answer` (a letter). The rules are expressions on one row;
set-level figures are aggregates over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def answer_place(answer: Column) -> Column:
    """0 for A, 1 for B, ..."""
    return F.ascii(answer) - ord("A")


def correct_choice(choices: Column, answer: Column) -> Column:
    """Null if the letter stands for no choice."""
    return F.get(choices, answer_place(answer))


def distractors(choices: Column, answer: Column) -> Column:
    place = answer_place(answer)
    return F.filter(choices, lambda c, i: i != place)


def mean_words(texts: Column) -> Column:
    total = lambda n: F.aggregate(n, F.lit(0), lambda a, k: a + k)
    return text.bound(F.transform(texts, text.word_count), lambda n: F.when(F.size(n) > 0, total(n) / F.size(n)).otherwise(0.0))


def length_bias(choices: Column, answer: Column) -> Column:
    """Severity, null if the rule doesn't hold."""
    ratio = text.bound(mean_words(distractors(choices, answer)), lambda mean: F.when(mean > 0, text.word_count(correct_choice(choices, answer)) / mean))
    return text.bound(ratio, lambda r: F.when(r >= 2, F.round(F.least(F.lit(1.0), (r - 2) * 0.5 + 0.5), 2)))


def lexical_overlap(question: Column, choices: Column, answer: Column) -> Column:
    asked = text.content_words(question)

    def of(own: Column) -> Column:
        share = F.size(F.array_intersect(own, asked)) / F.nullif(F.size(own), F.lit(0))
        return F.when(F.size(own) >= 2, text.bound(share, lambda s: F.when(s >= 0.75, F.round(s, 2))))

    return text.bound(text.content_words(correct_choice(choices, answer)), of)


def negation_artifact(question: Column, choices: Column, answer: Column) -> Column:
    others = distractors(choices, answer)
    alike = text.bound(F.array_distinct(text.without_negation(correct_choice(choices, answer))), lambda own: F.exists(others, lambda d: text.jaccard(own, F.array_distinct(text.without_negation(d))) > 0.8))
    return F.when(text.has_negation(question), F.when(alike, 0.7))


def implausible_distractor(choices: Column, answer: Column) -> Column:
    return F.when(F.exists(distractors(choices, answer), lambda d: text.word_count(d) < 3), 0.5)


def asymmetry(choices: Column) -> Column:
    ends = lambda n: (F.size(n) >= 2) & (F.array_min(n) > 0) & (F.array_max(n) >= 5 * F.array_min(n))
    return text.bound(F.transform(choices, text.word_count), lambda n: F.when(ends(n), 0.4))


def quality(severities: Column) -> Column:
    """1 less 0.3 of each severity in turn, never under 0; a running sum of doubles, since 0.7 is a threshold."""
    return F.aggregate(severities, F.lit(1.0), lambda q, s: F.greatest(F.lit(0.0), q - s * F.lit(0.3)))


def recommendation(score: Column) -> Column:
    return F.when(score < 0.4, "REPLACE").when(score < 0.7, "REVISE").otherwise("KEEP")


def reports(items: DataFrame, id_col: str, *more: str) -> DataFrame:
    """(id, more columns, shortcuts array<struct<pattern,severity>>, score, recommendation); items without a valid answer have
    none."""
    q, c, a = F.col("question"), F.col("choices"), F.col("answer")
    valid = F.coalesce((F.size(c) > 0) & correct_choice(c, a).isNotNull(), F.lit(False))
    rules = {"length_bias": length_bias(c, a), "lexical_overlap": lexical_overlap(q, c, a), "negation_artifact": negation_artifact(q, c, a), "distractor_implausibility": implausible_distractor(c, a), "answer_choice_asymmetry": asymmetry(c)}
    told = lambda k, s: text.bound(s.cast("double"), lambda v: F.when(v.isNotNull(), F.struct(F.lit(k).alias("pattern"), v.alias("severity"))))
    found = F.array_compact(F.array(*[F.when(valid, told(k, s)) for k, s in rules.items()]))
    out = items.select(id_col, *more, found.alias("shortcuts"))
    return out.withColumn("score", quality(F.col("shortcuts.severity"))).withColumn("recommendation", recommendation(F.col("score")))


def set_analysis(report: DataFrame) -> DataFrame:
    """One row: n_items, flagged_fraction, replace_fraction."""
    return report.agg(F.count(F.lit(1)).alias("n_items"), F.avg((F.size("shortcuts") > 0).cast("double")).alias("flagged_fraction"), F.avg((F.col("recommendation") == "REPLACE").cast("double")).alias("replace_fraction"))


def pattern_fractions(report: DataFrame) -> DataFrame:
    """(pattern, n, fraction of all items)."""
    n = report.agg(F.count(F.lit(1)).alias("all"))
    return report.select(F.explode("shortcuts.pattern").alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n)).select("pattern", "n", (F.col("n") / F.col("all")).alias("fraction"))


def position_bias(items: DataFrame) -> DataFrame:
    """One row: n_items, distinct positions, most frequent position's count, bias from 0 to 1."""
    counts = items.groupBy("answer").agg(F.count(F.lit(1)).alias("n"))
    expected = F.sum("n") / F.count(F.lit(1))
    return counts.agg(F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("positions"), F.max("n").alias("most"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.max("n") / expected - 1) / 2)).alias("bias"))


def valid_items(items: DataFrame) -> DataFrame:
    """Items whose answer is among the choices and whose correct choice is at most 2.5 times the mean distractor."""
    c, a = F.col("choices"), F.col("answer")
    long = text.bound(mean_words(distractors(c, a)), lambda mean: (mean > 0) & (text.word_count(correct_choice(c, a)) / F.nullif(mean, F.lit(0.0)) > 2.5))
    return items.where(F.col("question").isNotNull() & correct_choice(c, a).isNotNull() & ~F.coalesce(long, F.lit(False)))
