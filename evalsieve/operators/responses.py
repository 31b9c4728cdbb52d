"""Do models agree on answers that they can only know from training?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_MODELS, LEAST_SHARE = 2, 0.75


def votes(answers: DataFrame, question: str, model: str, answer: str) -> DataFrame:
    """(question, n_models, top_answer, consistency, is_contaminated, confidence); of equals the first model's answer."""
    counts = answers.where(F.col(answer).isNotNull()).groupBy(question, answer).agg(F.count(F.lit(1)).alias("k"), F.min(model).alias("first"))
    nth = F.row_number().over(Window.partitionBy(question).orderBy(F.desc("k"), "first"))
    best = counts.withColumn("n_models", F.sum("k").over(Window.partitionBy(question))).withColumn("nth", nth).where("nth = 1")
    share = F.col("k") / F.col("n_models")
    flag = (F.col("n_models") >= LEAST_MODELS) & (share >= LEAST_SHARE)
    return best.select(question, "n_models", F.col(answer).alias("top_answer"), share.alias("consistency"), flag.alias("is_contaminated"), F.when(flag, share).otherwise(0.0).alias("confidence"))


def summary(voted: DataFrame) -> DataFrame:
    return voted.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_contaminated").alias("contaminated"), F.avg(F.col("is_contaminated").cast("double")).alias("rate"), F.avg("consistency").alias("mean_consistency"))
