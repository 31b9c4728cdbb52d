"""Where calls to models plug in, and checks of what they return. Nothing here reaches the network or runs foreign code."""

from __future__ import annotations

import ast
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def completions(rows: DataFrame, id_col: str, prompt_col: str, call: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """(id, completion) by a callable over batches of prompts; without one there are no rows. Null prompts are empty."""
    kind = dict(rows.dtypes)[id_col]
    told = rows.select(F.col(id_col), F.coalesce(prompt_col, F.lit("")).alias("prompt"))

    def run(batches):
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "completion": call(b["prompt"].tolist())})

    schema = f"{id_col} {kind}, completion string"
    return told.mapInPandas(run, schema) if call else told.limit(0).select(id_col, F.col("prompt").alias("completion"))


def syntax(code: pd.Series) -> pd.Series:
    def one(text: str) -> str:
        try:
            ast.parse(text)
        except (SyntaxError, ValueError):
            return "syntax error"
        return "syntax OK"

    return code.map(one)


def code_note(code: Column) -> Column:
    """Is an answer Python? It is parsed, never run."""
    check = F.pandas_udf(syntax, StringType())
    return F.when(F.length(F.trim(F.coalesce(code, F.lit("")))) < 10, "answer too short for code").otherwise(check(F.coalesce(code, F.lit(""))))


def math_note(answer: Column, explanation: Column) -> Column:
    """numeric if the answer is a number, explained if the explanation has it among its numbers, else manual."""
    clean = F.regexp_replace(F.trim(answer), ",", "")
    numbers = F.regexp_extract_all(explanation, F.lit("\\b\\d+(?:\\.\\d+)?\\b"), F.lit(0))
    return F.when(clean.try_cast("double").isNotNull(), "numeric").when(F.array_contains(numbers, clean), "explained").otherwise("manual")
