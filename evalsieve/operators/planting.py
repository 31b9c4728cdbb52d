"""Planting known faults in items. What a random generator would choose is chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, values
from .shortcuts import answer_place, correct_choice, distractors


def draw(key: Column, seed: str, n: int) -> Column:
    """A number from 0 to n - 1 that depends on key and seed alone."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), key.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def ngram_overlap(key: Column, question: Column) -> Column:
    return F.concat(F.get(F.array(*map(F.lit, values.PLANT_PHRASES)), draw(key, "phrase", 3)), F.lit(" "), question)


def template_fill(question: Column) -> Column:
    return F.concat(F.lit("The answer to '"), F.substring(question, 1, 50), F.lit("...' is: ___"))


def answer_leak(question: Column, correct: Column) -> Column:
    return F.concat(question, F.lit(" (Note: "), F.array_join(F.slice(text.words(correct), 1, 3), " "), F.lit(" is relevant.)"))


def length_bias(choices: Column, answer: Column) -> Column:
    place = answer_place(answer)
    return F.transform(choices, lambda c, i: F.when(i == place, F.concat(c, F.lit(values.PLANT_SUFFIX))).otherwise(c))


def position_bias(choices: Column, answer: Column) -> Column:
    """The correct choice first, the others in their order."""
    return F.concat(F.array(correct_choice(choices, answer)), distractors(choices, answer))


def planted(items: DataFrame, id_col: str, kind: Column) -> DataFrame:
    """items with the fault that kind names (null: none), and planted_type and severity."""
    q, c, a = F.col("question"), F.col("choices"), F.col("answer")
    fits = F.coalesce((kind != "position_bias") | (F.size(c) == 4), F.lit(False)) & correct_choice(c, a).isNotNull()
    k = F.when(fits, kind)
    severity = F.lit(None).cast("double")
    for name, s in values.PLANT_SEVERITY.items():
        severity = F.when(F.col("planted_type") == name, s).otherwise(severity)
    t = F.col("planted_type")
    new_q = F.when(t == "ngram_overlap", ngram_overlap(F.col(id_col), q)).when(t == "template_fill", template_fill(q)).when(t == "answer_leak", answer_leak(q, correct_choice(c, a))).otherwise(q)
    new_c = F.when(t == "length_bias", length_bias(c, a)).when(t == "position_bias", position_bias(c, a)).otherwise(c)
    return items.withColumn("planted_type", k).withColumns({"question": new_q, "choices": new_c, "answer": F.when(t == "position_bias", F.lit("A")).otherwise(a), "severity": severity})


def labelled_mix(items: DataFrame, id_col: str, n: int, seed: str = "mix") -> DataFrame:
    """n items with a planted fault each, and half as many clean ones: the items' columns, planted_type, severity and
    is_contaminated. Ids become texts, "planted-" or "clean-" and the item's, so that an item may be in both."""
    from .dedup import sampled

    kind = F.get(F.array(*map(F.lit, values.PLANT_SEVERITY)), draw(F.col(id_col), "kind", len(values.PLANT_SEVERITY)))
    flawed = planted(sampled(items, id_col, n, seed), id_col, kind).where(F.col("planted_type").isNotNull())
    clean = sampled(items, id_col, n // 2, seed).withColumns({"planted_type": F.lit(None).cast("string"), "severity": F.lit(0.0)})
    named = lambda df, what: df.withColumns({"is_contaminated": F.lit(what == "planted"), id_col: F.concat(F.lit(what + "-"), F.col(id_col).cast("string"))})
    return named(flawed, "planted").unionByName(named(clean, "clean"))


def bundles(items: DataFrame, id_col: str, n: int, seed: str = "bundle", least: int = 5, most: int = 15, tenths: int = 3) -> DataFrame:
    """n bundles of `least` to `most` different items each (all, if there are fewer), in which `tenths` items in ten get a fault:
    (bundle, items, shortcuts_planted, n_shortcuts); items: slot, id, question, choices, answer, planted_type.

    A bundle's slots are the first places of a permutation of all items' ranks, a different one for each bundle, so they
    meet their items by an equi-join on ranks. Faults that don't fit an item leave it as it is and aren't in the ground truth.
    """
    from .dedup import ranked
    from .ranges import shuffled_place

    ranks = ranked(items, id_col, seed)
    known = ranks.agg(F.max("all").alias("all")).where("all is not null")  # one row
    each = items.sparkSession.range(n).select(F.col("id").alias("bundle")).crossJoin(F.broadcast(known))
    size = F.least(least + draw(F.col("bundle"), seed + "|size", most - least + 1), F.col("all")).cast("int")
    slots = each.select("bundle", "all", F.explode(F.sequence(F.lit(0), size - 1)).alias("slot"))
    place = shuffled_place(F.col("slot").cast("long"), F.col("all"), F.concat(F.lit(seed + "|"), F.col("bundle").cast("string")))
    key = F.concat_ws("|", F.col("bundle").cast("string"), F.col("slot").cast("string"))
    kind = F.when(draw(key, seed + "|plant", 10) < tenths, F.get(F.array(*map(F.lit, values.PLANT_SEVERITY)), draw(key, seed + "|kind", len(values.PLANT_SEVERITY))))
    chosen = slots.select("bundle", "slot", (place + 1).alias("nth"), kind.alias("_kind")).join(ranks.select(id_col, "nth"), "nth").join(items, id_col)
    flawed = planted(chosen, id_col, F.col("_kind"))
    told = flawed.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("slot", F.col(id_col).alias("id"), "question", "choices", "answer", "planted_type"))).alias("items"))
    truth = F.array_sort(F.array_distinct(F.array_compact(F.col("items.planted_type"))))
    return told.select("bundle", "items", truth.alias("shortcuts_planted"), F.size(truth).alias("n_shortcuts"))
