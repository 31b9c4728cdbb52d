"""Generating questions from templates until a target is met: attempts, checks and rounds."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.store import written
from . import external
from .dedup import drawn

#: attempts for each question wanted
TRIES = 5


def judged(said: DataFrame, known: DataFrame, accepted: DataFrame) -> DataFrame:
    """said (attempt, category, completion) with question, answer, note, fp and reason: unparsed, empty, unverified, contaminated,
    repeated or accepted. known (fp) is the catalog, accepted (fp) what earlier rounds took; of equals the first attempt wins."""
    parsed = said.withColumn("json", text.json_text(F.col("completion")))
    field = lambda name: F.trim(F.coalesce(F.get_json_object("json", f"$.{name}"), F.lit("")))
    parsed = parsed.select("attempt", "category", F.col("json").isNotNull().alias("parsed"), field("question").alias("question"), field("answer").alias("answer"), field("explanation").alias("explanation"))
    note = F.when(F.col("category") == "coding", external.code_note(F.col("answer"))).otherwise(external.math_note(F.col("answer"), F.col("explanation")))
    first = F.when(~F.col("parsed"), "unparsed").when((F.col("question") == "") | (F.col("answer") == ""), "empty").when(F.col("note").isin("syntax error", "answer too short for code"), "unverified")
    noted = parsed.withColumn("note", note).withColumn("fp", text.fingerprint(F.col("question"))).withColumn("reason", first)
    seen = known.select("fp", F.lit("contaminated").alias("seen")).unionByName(accepted.select("fp", F.lit("repeated").alias("seen"))).groupBy("fp").agg(F.min("seen").alias("seen"))
    met = noted.join(seen, "fp", "left").withColumn("reason", F.coalesce("reason", "seen"))
    met = written(said.sparkSession, met, "met")
    won = met.where("reason is null").groupBy("fp").agg(F.min("attempt").alias("attempt")).select("attempt", F.lit("accepted").alias("won"))
    return met.join(won, "attempt", "left").select("attempt", "question", "answer", "note", "fp", F.coalesce("reason", "won", F.lit("repeated")).alias("reason"))


def generate(templates: DataFrame, id_col: str, prompt: Column, category: Column, call: Callable[[list[str]], list[str]], target: int, catalog: DataFrame, seed: str = "generate", tries: int = TRIES) -> tuple[DataFrame, DataFrame]:
    """(questions, reasons): up to `target` questions by a callable over prompts, and how the attempts went, (reason, n).

    An attempt draws a template, with replacement, by its number alone, and asks with the number added to the prompt as a
    variant, so the outcome doesn't depend on how attempts fall into rounds. Rounds go on until the target is met or `tries`
    attempts for each question wanted are spent; a round is as large as the share accepted so far lets expect. Attempts
    after the one that meets the target don't count. Each round is written to the shared folder.
    """
    spark = templates.sparkSession
    known = templates.select(F.col(id_col).alias("_id"), prompt.alias("prompt"), category.alias("category"))
    rounds, have, done = [], 0, 0
    while have < target and done < tries * target:
        size = min(tries * target - done, math.ceil((target - have) * (done / have if have else 1.25) * 1.1) + 8)
        asked = drawn(templates.select(F.col(id_col).alias("_id")), "_id", size, seed, first=done).join(known, "_id").select(F.col("draw").alias("attempt"), F.concat("prompt", F.lit("\nVariant "), F.col("draw").cast("string")).alias("prompt"), "category")
        replies = external.completions(asked, "attempt", "prompt", call)
        accepted = [r.where("reason = 'accepted'").select("fp") for r in rounds]
        before = accepted[0] if accepted else catalog.select("fp").limit(0)
        for more in accepted[1:]:
            before = before.unionByName(more)
        found = written(spark, judged(replies.join(asked.select("attempt", "category"), "attempt"), catalog, before), "round")
        taken = found.where("reason = 'accepted'").select("attempt")
        n = taken.count()
        if not found.take(1):
            rounds.append(found)
            break
        if have + n >= target:
            last = taken.orderBy("attempt").limit(target - have).agg(F.max("attempt")).first()[0]
            found, n = found.where(F.col("attempt") <= last), target - have
        rounds.append(found)
        have, done = have + n, done + size
    if not rounds:
        rounds = [judged(known.limit(0).select(F.lit(0).cast("long").alias("attempt"), "category", F.col("prompt").alias("completion")), catalog, catalog.select("fp").limit(0))]
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    return every.where("reason = 'accepted'").select("attempt", "question", "answer", "note"), every.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
