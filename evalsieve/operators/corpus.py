"""Papers, problem sets, chat texts and other corpus shaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, values


def difficulty(question: Column) -> Column:
    n = text.word_count(question)
    return F.when(n < 20, "easy").when(n < 60, "medium").otherwise("hard")


def contest_difficulty(name: Column) -> Column:
    has = lambda s: F.contains(name, F.lit(s))
    return F.when(has("AIME"), "hard").when(has("AMC 12"), "medium-hard").when(has("AMC 10"), "medium").otherwise("easy-medium")


def relevance(title: Column, abstract: Column, citations: Column, year: Column) -> Column:
    """0 to 1: terms, citations and year of a paper."""
    low = F.concat(F.lower(F.coalesce(title, F.lit(""))), F.lit(" "), F.lower(F.coalesce(abstract, F.lit(""))))
    c, y = F.coalesce(citations, F.lit(0)), F.coalesce(year, F.lit(0))
    score = text.phrase_hits(low, values.HIGH_VALUE_TERMS) * 0.15 + text.phrase_hits(low, values.MEDIUM_VALUE_TERMS) * 0.05
    score = score + F.when(c > 500, 0.3).when(c > 100, 0.2).when(c > 20, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(score + F.when(y >= 2022, 0.1).when(y >= 2020, 0.05).otherwise(0.0), 6))


def relevant(title: Column, abstract: Column) -> Column:
    return text.any_of(F.lower(F.concat_ws(" ", title, abstract)), values.RELEVANCE_TERMS)


def high_value(papers: DataFrame, score: str, order: str, least: float = 0.4, most: int = 2000) -> DataFrame:
    return papers.where(F.col(score) >= least).orderBy(F.desc(score), order).limit(most)


def unwrapped(content: Column) -> Column:
    """The value of {"value": x}, or the text itself."""
    return F.coalesce(F.get_json_object(F.when(F.try_parse_json(content).isNotNull(), content), "$.value"), content)


def substantial_reviews(reviews: Column, least: int = 100) -> Column:
    return F.filter(reviews, lambda r: F.length(r["text"]) > least)


def capped(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first rows of each source."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_nth") <= most).drop("_nth")


def batches(rows: DataFrame, by: str, order: str, size: int = 10, ranges: int = 1024) -> DataFrame:
    """Rows with the number of their batch of `size` within `by`, in the order of a number.

    Rows are numbered within ranges of the order, and the ranges' counts, of which there are as many at most for each
    value of `by`, are added up: a value that most rows have is numbered by many tasks.
    """
    ends = rows.agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    width = (F.col("_high") - F.col("_low") + 1) / F.lit(float(ranges))
    placed = rows.crossJoin(F.broadcast(ends)).withColumn("_part", F.coalesce(F.floor((F.col(order) - F.col("_low")) / width), F.lit(-1))).drop("_low", "_high")
    counts = placed.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), (F.sum("_n").over(Window.partitionBy(by).orderBy("_part")) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(by, "_part").orderBy(order)) - 1
    numbered = placed.withColumn("_nth", nth).join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return numbered.withColumn("batch", F.floor((F.col("_nth") + F.col("_before")) / size)).select(*rows.columns, "batch")


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def titles(column: Column) -> Column:
    """A title worth keeping."""
    return (column != "") & ~F.startswith(column, F.lit("Category:")) & ~F.startswith(column, F.lit("Template:"))


def problem_sections(page: Column) -> Column:
    """array<struct<number, text>> of the "== Problem N ==" sections of a wiki page."""
    mark = F.lit(values.PROBLEM_SECTION)
    numbers, bodies = F.regexp_extract_all(page, mark, F.lit(1)), F.regexp_extract_all(page, mark, F.lit(2))
    return F.transform(F.arrays_zip(numbers.alias("n"), bodies.alias("t")), lambda x: F.struct(x["n"].cast("int").alias("number"), text.without_markup(x["t"]).alias("text")))


def hash_record(line: Column) -> Column:
    """number and title of "12##Title##...", null if the number is none."""
    parts = F.split(line, "##")
    number = F.trim(F.get(parts, F.lit(0))).try_cast("int")
    return F.when((F.size(parts) >= 3) & number.isNotNull(), F.struct(number.alias("number"), F.trim(F.get(parts, F.lit(1))).alias("title")))


def paragraphs(html: Column) -> Column:
    """The texts of a page's paragraphs, without tags."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit("(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), text.without_markup), lambda p: p != "")


def container_texts(html: Column, name: str, tag: str = "div") -> Column:
    """The texts of a page's containers of a class, nested ones included, without tags; empty ones left out."""
    return F.filter(F.transform(text.element_texts(html, tag, name), text.without_markup), lambda p: p != "")


def chat(rows: DataFrame, by: str, order: str, role: str, content: str) -> DataFrame:
    """(by, n_turns, chat): the turns in order, with ChatML marks; one conversation at a time is gathered."""
    turns = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("r"), F.col(content).alias("c"))))
    said = F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["r"], F.lit("\n"), t["c"], F.lit("<|im_end|>")))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(said, "\n").alias("chat"))


def prompt(rows: DataFrame, by: str, order: str, role: str, content: str) -> DataFrame:
    """(by, prompt): the first system and the first user turn, "" where there is none."""
    first = lambda r: F.coalesce(F.min_by(content, F.when(F.col(role) == r, F.col(order))), F.lit(""))
    return rows.groupBy(by).agg(F.concat(F.lit("<|im_start|>system\n"), first("system"), F.lit("<|im_end|>\n<|im_start|>user\n"), first("user"), F.lit("<|im_end|>")).alias("prompt"))


def question_prompt(question: Column, choices: Column) -> Column:
    """The question, then its lettered choices."""
    lines = F.transform(choices, lambda c, i: F.concat(F.lit("  ("), F.char(i + 65), F.lit(") "), c))
    return F.concat(question, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nAnswer:"))
