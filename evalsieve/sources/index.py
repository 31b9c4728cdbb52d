"""One large JSON object gram -> [sources] as rows, read in byte ranges by any number of tasks.

The object is split at its quotes, which a text scan does in ranges of the file. A quote is escaped if an odd number of
backslashes stands before it, which its own piece shows; whether a piece lies within a string follows from how many
real quotes come before, a sum over the ranges. What stands between strings must be one of a few short texts; these also
tell keys from sources.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .store import written

#: texts between strings, without blanks: what may follow a key, what may follow a source, and after which of them comes a key
AFTER_KEY, AFTER_SOURCE, BEFORE_KEY, LAST = (":[", ":[],", ":[]}"), (",", "],", "]}"), ("{", "],", ":[],"), ("]}", ":[]}")
#: strings whose last key is found together
CHUNK = 1 << 20


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(q, at, value): the pieces between quotes and how many real quotes come before each; at orders the pieces of a q."""
    raw = spark.read.option("lineSep", '"').text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    slashes = F.length(F.regexp_extract("value", "(\\\\*)$", 1))
    pieces = written(spark, raw.withColumn("real", (slashes % 2 == 0).cast("long")), "pieces")
    blocks = pieces.groupBy("block").agg(F.sum("real").alias("n"))
    before = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))  # a row for each range
    within = F.sum("real").over(Window.partitionBy("block").orderBy("at")) - F.col("real")
    return pieces.withColumn("within", within).join(before, "block").select((F.col("before") + F.col("within")).alias("q"), "block", "at", "value")


def one_of(column: Column, texts: tuple[str, ...]) -> Column:
    return column.isin(*texts)


def well_formed(between: DataFrame, last: int) -> bool:
    """Whether the texts between strings, (q, text), make up an object of lists of strings, and end with the last quote."""
    before = between.select((F.col("q") + 2).alias("q"), F.col("text").alias("before"))
    follows = F.when(one_of(F.col("before"), BEFORE_KEY), one_of(F.col("text"), AFTER_KEY)).otherwise(one_of(F.col("text"), AFTER_SOURCE))
    begins = F.when(F.lit(last == 0), F.col("text") == "{}").otherwise(F.col("text") == "{")
    ends = one_of(F.col("text"), LAST) == (F.col("q") == last)
    fine = F.when(F.col("q") == 0, begins).otherwise(follows & ends)
    n, good = between.join(before, "q", "left").agg(F.count(F.lit(1)), F.count_if(fine)).first()
    return n == good == last // 2 + 1


def ngram_index(spark: SparkSession, path: str) -> DataFrame:
    """(gram, source) from one JSON object gram -> [sources]; empty if there is no such file, or it holds anything but one
    object of lists of strings. Of equal grams the last one counts."""
    empty = spark.createDataFrame([], "gram string, source string")
    try:
        pieces = written(spark, numbered(spark, path), "numbered")
    except AnalysisException:
        return empty
    last = pieces.agg(F.max("q")).first()[0]
    if last is None or last % 2:
        return empty
    between = written(spark, pieces.where("q % 2 = 0").select("q", F.regexp_replace("value", "[ \t\r\n]", "").alias("text")), "between")
    if not well_formed(between, last):
        return empty
    inner = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "value"))), lambda x: x.value), '"')
    strings = pieces.where("q % 2 = 1").groupBy("q").agg(inner.alias("s")).select("q", F.get(F.from_json(F.concat(F.lit('["'), "s", F.lit('"]')), "array<string>"), F.lit(0)).alias("s"))
    kinds = between.select((F.col("q") + 1).alias("q"), one_of(F.col("text"), BEFORE_KEY).alias("key"))
    strings = written(spark, strings.join(kinds, "q").withColumn("chunk", F.floor(F.col("q") / CHUNK)), "strings")
    if not strings.where("s is null").isEmpty():  # a bad escape
        return empty
    # the last key before each source: within its chunk, else that of an earlier chunk
    own = F.max(F.when(F.col("key"), F.col("q")))
    chunks = strings.groupBy("chunk").agg(own.alias("own"))
    carried = chunks.select("chunk", F.max("own").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))  # a row for each chunk
    of = F.coalesce(own.over(Window.partitionBy("chunk").orderBy("q")), "carried")
    sources = strings.join(F.broadcast(carried), "chunk").withColumn("of", of).where("not key").select("of", F.col("s").alias("source"))
    grams = strings.where("key").groupBy(F.col("s").alias("gram")).agg(F.max("q").alias("of"))
    return grams.join(sources, "of").select("gram", "source")


def write_ngram_index(grams: DataFrame, path: str) -> None:
    """(gram, source) rows as one JSON object in one file, a line for each gram: one task writes it, as such a file needs."""
    lines = grams.groupBy("gram").agg(F.sort_array(F.collect_set("source")).alias("sources")).select(F.lit(0).alias("end"), F.concat(F.regexp_extract(F.to_json(F.array("gram")), "^.(.*).$", 1), F.lit(":"), F.to_json("sources")).alias("line"))
    end = grams.sparkSession.range(1).select(F.lit(1).alias("end"), F.lit("}").alias("line"))
    ordered = lines.unionByName(end).coalesce(1).sortWithinPartitions("end", "line").withColumn("at", F.monotonically_increasing_id())
    start = F.when(F.col("at") == 0, "{").when(F.col("end") == 0, ",").otherwise("")
    ordered.select(F.concat(start, "line").alias("value")).write.mode("overwrite").text(path)
