"""JSON-lines and JSON sources and sinks. All scans are lazy and take a schema, so nothing is read twice to infer one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

CHAT = "id string, type string, conversations array<struct<from:string,value:string>>"
REWARD = "prompt string, ground_truth struct<shortcuts_planted:array<string>,type:string>"
PREFERENCE = "prompt string, chosen string, rejected string, preference_reason string"
CATALOG = "benchmark string, subset string, exact_fingerprint string, ngram_fingerprints array<string>, category string, question_preview string"


def lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every well-formed line of a file or folder; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fails, when read, on a malformed line."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def first_rows(spark: SparkSession, path: str, schema: str, most: int) -> DataFrame:
    return lenient(spark, path, schema).limit(most)


def objects(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """A row per file, each one JSON object."""
    return spark.read.schema(schema).option("multiLine", True).json(glob)


def with_file(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Lines of many files, with their file's name."""
    return spark.read.schema(schema).json(glob).withColumn("file", F.input_file_name())


def catalog_entries(items: DataFrame, benchmark: str, subset: Column, text_col: str, category: Column) -> DataFrame:
    """Catalog rows of items: fingerprint, n-gram fingerprints and a preview."""
    t = F.col(text_col)
    return items.select(F.lit(benchmark).alias("benchmark"), subset.alias("subset"), text.fingerprint(t).alias("exact_fingerprint"), text.catalog_grams(t).alias("ngram_fingerprints"), category.alias("category"), F.substring(t, 1, 120).alias("question_preview"))


def catalog_maps(catalog: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(fp, benchmark) and (gram, benchmark); of several benchmarks for one key the last in order."""
    exact = catalog.where(F.col("exact_fingerprint") != "").groupBy(F.col("exact_fingerprint").alias("fp")).agg(F.max_by("benchmark", order).alias("benchmark"))
    grams = catalog.select("benchmark", order, F.explode("ngram_fingerprints").alias("gram")).groupBy("gram").agg(F.max_by("benchmark", order).alias("benchmark"))
    return exact, grams


def ngram_lines(spark: SparkSession, path: str) -> DataFrame:
    """(gram, source) from JSON lines {gram, sources}, which any number of tasks read; empty if there is no such path."""
    try:
        return lenient(spark, path, "gram string, sources array<string>").select("gram", F.explode("sources").alias("source"))
    except AnalysisException:
        return spark.createDataFrame([], "gram string, source string")


def write_ngram_lines(grams: DataFrame, path: str) -> None:
    """(gram, source) rows as ngram_lines reads them."""
    grams.groupBy("gram").agg(F.sort_array(F.collect_set("source")).alias("sources")).write.mode("overwrite").json(path)


def chats(spark: SparkSession, path: str) -> DataFrame:
    return lenient(spark, path, CHAT).where(F.size("conversations") > 0)


def reward_examples(spark: SparkSession, path: str) -> DataFrame:
    return lenient(spark, path, REWARD).where(F.col("prompt").isNotNull() & F.col("ground_truth").isNotNull())


def preferences(spark: SparkSession, path: str) -> DataFrame:
    return lenient(spark, path, PREFERENCE).where(F.col("prompt").isNotNull() & F.col("chosen").isNotNull() & F.col("rejected").isNotNull())


def mapped(rows: DataFrame, fields: dict[str, Column], subset: Column, order: str, most: int | None = None) -> DataFrame:
    """A source's rows under common names, at most `most` of each subset."""
    from ..operators.corpus import capped

    out = rows.select(*[c.alias(k) for k, c in fields.items()], subset.alias("subset"), F.col(order).alias("_order"))
    return (capped(out, "subset", "_order", most) if most else out).drop("_order")


def write_lines(rows: DataFrame, path: str, subset: Column | None = None, subset_path: str | None = None) -> None:
    """JSON lines, and those of a subset to a second folder, taken from what was written: rows are computed once."""
    rows.write.mode("overwrite").json(path)
    if subset is not None and subset_path:
        rows.sparkSession.read.schema(rows.schema).json(path).where(subset).write.mode("overwrite").json(subset_path)


def write_splits(rows: DataFrame, path: str) -> None:
    """A folder of JSON lines for each value of `split`."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def statistics(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
