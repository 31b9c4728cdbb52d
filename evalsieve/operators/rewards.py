"""Rewards of answers that name planted shortcuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, values


def detected(response: Column) -> Column:
    """The patterns that an answer names under any of three schemas, the first there counting; null if it is no JSON."""
    inside = text.without_fence(response)
    parsed = F.when(F.try_parse_json(inside).isNotNull() & (inside != ""), inside)
    objects = lambda k: F.transform(F.from_json(F.get_json_object(parsed, f"$.{k}"), "array<struct<pattern:string>>"), lambda s: s["pattern"])
    plain = F.from_json(F.get_json_object(parsed, "$.shortcuts_detected"), "array<string>")
    return F.when(parsed.isNotNull(), F.array_distinct(F.coalesce(objects("shortcuts_found"), objects("shortcuts"), plain, F.array().cast("array<string>"))))


def shortcut_f1(planted: Column, found: Column) -> Column:
    """1 if nothing is planted; 0 if nothing is found; else F1 of the two sets."""
    p, f = F.array_distinct(planted), F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))
    both = F.size(F.array_intersect(p, f))
    return F.when(F.size(p) == 0, 1.0).when(F.size(f) == 0, 0.0).otherwise(2.0 * both / (F.size(p) + F.size(f)))


def total(f1: Column, form: Column) -> Column:
    w = values.REWARD_WEIGHTS
    return F.round(w["shortcut"] * f1 + w["format"] * form + w["correlation"] * (0.8 * f1), 4)


def guarded(rewards: DataFrame, group: str, reward: str) -> DataFrame:
    """A group whose rewards are all equal teaches nothing: each becomes -1."""
    w = Window.partitionBy(group)
    return rewards.withColumn(reward, F.when(F.min(reward).over(w) == F.max(reward).over(w), F.lit(-1.0)).otherwise(F.col(reward)))
