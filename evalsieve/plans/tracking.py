"""Plans that track benchmark scores against downstream scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlation as op
from ..operators import responses as vote
from ..functions import text
from .fixtures import MEASURE_SQL, VOTES_SQL, measurements, table, votes
from .registry import query

KEYS = ["benchmark", "period"]


def records(spark, sf_dir):
    found = op.records(measurements(spark, sf_dir), KEYS, "bench_score", "downstream_score")
    return found.select(*KEYS, "n_models", *[F.round(c, 6).alias(c) for c in ("pearson", "spearman", "tau")])


ROUNDED = "rec AS (SELECT benchmark, period, n_models, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(tau, 6) AS tau FROM records)"


@query(f"WITH {MEASURE_SQL} SELECT benchmark, period, n_models, round(pearson, 6) AS pearson FROM records")
def corr_pearson(spark, sf_dir):
    m = measurements(spark, sf_dir)
    return m.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_models"), F.round(op.pearson("bench_score", "downstream_score"), 6).alias("pearson")).where("n_models >= 3")


@query(f"WITH {MEASURE_SQL} SELECT benchmark, period, round(spearman, 6) AS spearman FROM records")
def corr_spearman(spark, sf_dir):
    return op.with_ranks(measurements(spark, sf_dir), KEYS, "bench_score", "downstream_score").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.round(op.pearson("rank_x", "rank_y"), 6).alias("spearman")).where("n >= 3").drop("n")


@query(f"WITH {MEASURE_SQL} SELECT benchmark, period, round(tau, 6) AS tau FROM taus")
def corr_kendall(spark, sf_dir):
    return op.kendall(measurements(spark, sf_dir), KEYS, "bench_score", "downstream_score").withColumn("tau", F.round("tau", 6))


@query(f"WITH {MEASURE_SQL} SELECT benchmark, period, model, rx AS rank_bench, ry AS rank_downstream FROM ranked")
def average_ranks(spark, sf_dir):
    r = op.with_ranks(measurements(spark, sf_dir), KEYS, "bench_score", "downstream_score")
    return r.select(*KEYS, "model", F.col("rank_x").cast("double").alias("rank_bench"), F.col("rank_y").cast("double").alias("rank_downstream"))


@query(f"WITH {MEASURE_SQL}, {ROUNDED} SELECT * FROM rec")
def corr_records(spark, sf_dir):
    return records(spark, sf_dir)


TREND = f"""{MEASURE_SQL}, {ROUNDED}, n AS (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY period) - 1 AS i FROM rec),
    s AS (SELECT benchmark, count(*) AS n_records, round(CASE WHEN count(*) >= 3 THEN coalesce(regr_slope(pearson, i), 0) ELSE 0 END, 6) AS slope,
        max_by(pearson, i) AS pearson, max_by(spearman, i) AS spearman, max_by(tau, i) AS tau FROM n GROUP BY benchmark),
    rep AS (SELECT *, CASE WHEN slope < -0.05e0 THEN 'DEGRADING' WHEN slope > 0.02e0 THEN 'IMPROVING' ELSE 'STABLE' END AS trend,
        CASE WHEN pearson < 0.5e0 THEN printf('pearson %.3f below %.2f', pearson, 0.5e0) WHEN tau < 0.6e0 THEN printf('kendall %.3f below %.2f', tau, 0.6e0) WHEN slope < -0.05e0 THEN printf('slope %.4f below %.2f', slope, -0.05e0) END AS reason FROM s)"""


@query(f"WITH {TREND} SELECT benchmark, n_records, slope, trend FROM rep")
def corr_trend(spark, sf_dir):
    return op.reports(records(spark, sf_dir), "benchmark", "period").select("benchmark", "n_records", "slope", "trend")


@query(f"WITH {TREND} SELECT benchmark, pearson, spearman, tau, slope, reason FROM rep WHERE reason IS NOT NULL")
def corr_alerts(spark, sf_dir):
    return op.reports(records(spark, sf_dir), "benchmark", "period").where("alert").select("benchmark", "pearson", "spearman", "tau", "slope", "reason")


@query(f"WITH {MEASURE_SQL}, {ROUNDED}, b AS (SELECT *, lag(pearson) OVER (PARTITION BY benchmark ORDER BY period) AS before FROM rec) SELECT benchmark, period, pearson, before FROM b WHERE pearson - before < -0.1e0")
def corr_drops(spark, sf_dir):
    return op.drops(records(spark, sf_dir), "benchmark", "period").select("benchmark", "period", "pearson", "before")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS model FROM orders), b AS (SELECT c_custkey AS model FROM customer WHERE c_acctbal > 0)
    SELECT count(*) AS n_common, min(model) AS first_model, max(model) AS last_model FROM (SELECT model FROM a INTERSECT SELECT model FROM b)""")
def common_models(spark, sf_dir):
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("model")), table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("model"))
    return a.intersect(b).agg(F.count(F.lit(1)).alias("n_common"), F.min("model").alias("first_model"), F.max("model").alias("last_model"))


VOTED = f"""{VOTES_SQL}, k AS (SELECT question, answer, count(*) AS k, min(model) AS f FROM votes GROUP BY ALL),
    r AS (SELECT *, sum(k) OVER (PARTITION BY question) AS n, row_number() OVER (PARTITION BY question ORDER BY k DESC, f) AS nth FROM k),
    voted AS (SELECT question, n::BIGINT AS n_models, answer AS top_answer, k / n::DOUBLE AS consistency, n >= 2 AND k / n::DOUBLE >= 0.75e0 AS is_contaminated FROM r WHERE nth = 1)"""


@query(f"WITH {VOTED} SELECT *, CASE WHEN is_contaminated THEN consistency ELSE 0e0 END AS confidence FROM voted")
def consistency_vote(spark, sf_dir):
    return vote.votes(votes(spark, sf_dir), "question", "model", "answer")


@query(f"WITH {VOTED} SELECT count(*) AS total, count(*) FILTER (is_contaminated) AS contaminated, avg(is_contaminated::INTEGER) AS rate, avg(consistency) AS mean_consistency FROM voted")
def probe_summary(spark, sf_dir):
    return vote.summary(consistency_vote(spark, sf_dir))


@query("""WITH a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '[.,;:!?]+$', '') AS t FROM conversations)
    SELECT conv_id, turn, trim(split_part(split_part(t, chr(10), 1), '.', 1)) AS answer FROM a""")
def normal_answers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normal_answer(F.col("text")).alias("answer"))
