"""Structured Streaming over measurement files. They extend the batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import correlation
from ..sources import log

SCORES = "benchmark string, period int, model int, bench_score double, downstream_score double"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
RECORDS = "benchmark string, period int, n_models long, pearson double, spearman double, tau double"
#: what reports need of a benchmark's records: their number, sums over the ones with an r (places, their squares, r, products),
#: and the last one's time and figures
STATE = "benchmark string, n long, m long, i double, ii double, r double, ir double, last int, pearson double, spearman double, tau double"


def measurements(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCORES).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def summed(records: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """STATE of records; with states before, places go on from theirs and sums are added to theirs."""
    nth = (F.row_number().over(Window.partitionBy("benchmark").orderBy("period")) - 1).cast("double")
    placed = records.withColumn("nth", nth)
    if before is not None:
        placed = placed.join(before.select("benchmark", F.col("n").alias("n0")), "benchmark", "left").withColumn("nth", F.col("nth") + F.coalesce("n0", F.lit(0)))
    has = F.col("pearson").isNotNull()
    add = lambda x: F.coalesce(F.sum(F.when(has, x)), F.lit(0.0))
    at, r = F.col("nth"), F.col("pearson")
    figures = F.max_by(F.struct("period", "pearson", "spearman", "tau"), "nth")
    new = placed.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"), F.count_if(has).alias("m"), add(at).alias("i"), add(at * at).alias("ii"), add(r).alias("r"), add(at * r).alias("ir"), figures.alias("f"))
    new = new.select("benchmark", "n", "m", "i", "ii", "r", "ir", F.col("f.period").alias("last"), "f.pearson", "f.spearman", "f.tau")
    if before is None:
        return new
    sums = ["n", "m", "i", "ii", "r", "ir"]
    old = before.select("benchmark", *[F.col(c).alias(f"{c}0") for c in sums])
    return new.join(old, "benchmark", "left").select("benchmark", *[(F.col(c) + F.coalesce(f"{c}0", F.lit(0))).alias(c) for c in sums], "last", "pearson", "spearman", "tau")


def advanced(records: DataFrame, before: DataFrame, whole_log: DataFrame) -> DataFrame:
    """New STATE of the benchmarks in records: by adding to the state where all records are later than it, else from the
    benchmark's own part of the log, which must hold the records."""
    known = before.select("benchmark", F.col("last").alias("known"))
    late = records.join(known, "benchmark").where("period <= known").select("benchmark").distinct()
    in_order = summed(records.join(late, "benchmark", "left_anti"), before)
    return in_order.unionByName(summed(whole_log.join(late, "benchmark", "left_semi")))


def reports(state: DataFrame) -> DataFrame:
    """correlation.reports of the log that the state stands for, without reading it."""
    spread = F.col("m") * F.col("ii") - F.col("i") * F.col("i")
    slope = F.when((F.col("n") >= 3) & (spread > 0), (F.col("m") * F.col("ir") - F.col("i") * F.col("r")) / spread).otherwise(0.0)
    out = state.select("benchmark", F.col("n").alias("n_records"), "pearson", "spearman", "tau", F.round(slope, 6).alias("slope")).withColumn("trend", correlation.trend(F.col("slope")))
    reason = correlation.alert_reason(F.col("pearson"), F.col("tau"), F.col("slope"))
    return out.withColumn("reason", reason).withColumn("alert", F.col("reason").isNotNull())


def absorb(batch: DataFrame, name: str, log_path: str, state_path: str) -> None:
    """One batch of measurements: its records are committed to the log, then the states that they change. Both commits happen
    once, however often the batch is tried, and a try that was killed between them is finished by the next one."""
    spark = batch.sparkSession
    found = correlation.records(batch, ["benchmark", "period"], "bench_score", "downstream_score").select("benchmark", "period", "n_models", "pearson", "spearman", "tau")
    log.commit(found, log_path, name)
    before = log.latest(spark, state_path, STATE, ["benchmark"])
    log.commit(advanced(found, before, log.committed(spark, log_path, RECORDS)), state_path, name)


def track(stream: DataFrame, log_path: str, state_path: str, checkpoint: str):
    """Keeps the log of records and the state of every benchmark up to date; reports(current(...)) tells trends and alerts."""
    return stream.writeStream.foreachBatch(lambda batch, number: absorb(batch, str(number), log_path, state_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, state_path: str) -> DataFrame:
    return log.latest(spark, state_path, STATE, ["benchmark"])


def timed(stream: DataFrame, time: str) -> DataFrame:
    """With the time as an instant: watermarks take no timestamps without a zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def first_seen(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark; state is dropped as the watermark moves on."""
    return timed(stream, time).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def daily(stream: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events, users' range and mean value by day and type."""
    return timed(stream, time).withWatermark(time, late).groupBy(F.window(time, "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
