"""Item, response and measurement tables derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text of documents of 70 words or more."""
    long = F.col("text").rlike("^[ \\n\\t]*+(?:[^ \\n\\t]++[ \\n\\t]++){69}+[^ \\n\\t]")
    return table(spark, sf_dir, "documents").where(long).select("doc_id", "text")


def mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, question, choices, answer from documents of 70 words or more."""
    return items_of(item_texts(spark, sf_dir))


def items_of(texts: DataFrame) -> DataFrame:
    """doc_id, question, choices, answer from item_texts or some of them.

    An item is made within a generator, so a text is split once: as columns of a projection, its words would be put in
    wherever a filter or rule names question or choices.
    """
    k = F.col("doc_id")
    first = F.split(F.ltrim(F.col("text"), F.lit(" \n\t")), "[ \\n\\t]+", 64)  # 63 words and the rest

    def item(w: Column) -> Column:
        choice = lambda start, m: F.array_join(F.slice(w, start, (F.lit(1) + (k * m + m) % 12).cast("int")), " ")
        both = F.struct(F.array_join(F.slice(w, 1, 12), " ").alias("q0"), F.array(choice(13, 5), choice(26, 7), choice(39, 11), choice(52, 13)).alias("c"))
        return text.bound(both, asked)

    def asked(x: Column) -> Column:
        q0, c = x["q0"], x["c"]
        right = F.get(c, (k % 4).cast("int"))
        negated, leaked = k % 7 == 0, k % 5 == 0
        choices = F.when(negated & (k % 4 != 1), F.array(F.get(c, F.lit(0)), F.concat(F.lit("never "), right), F.get(c, F.lit(2)), F.get(c, F.lit(3)))).otherwise(c)
        question = F.when(negated, F.concat(F.lit("not "), q0)).when(leaked, F.concat(q0, F.lit(" "), right)).otherwise(q0)
        return F.struct(question.alias("question"), choices.alias("choices"), F.char(65 + k % 4).alias("answer"))

    return texts.select("doc_id", F.inline(F.transform(F.array(first), item)))


MCQ_SQL = """
    mw AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n\\t]+'), lambda x: x <> '') AS w FROM documents),
    m0 AS (SELECT doc_id, array_to_string(w[1:12], ' ') AS q0,
        [array_to_string(w[13:12+1+(doc_id*5+5)%12], ' '), array_to_string(w[26:25+1+(doc_id*7+7)%12], ' '),
         array_to_string(w[39:38+1+(doc_id*11+11)%12], ' '), array_to_string(w[52:51+1+(doc_id*13+13)%12], ' ')] AS c,
        chr((65 + doc_id % 4)::INTEGER) AS answer FROM mw WHERE len(w) >= 70),
    mcq AS (SELECT doc_id,
        CASE WHEN doc_id % 7 = 0 THEN 'not ' || q0 WHEN doc_id % 5 = 0 THEN q0 || ' ' || c[doc_id % 4 + 1] ELSE q0 END AS question,
        CASE WHEN doc_id % 7 = 0 AND doc_id % 4 <> 1 THEN [c[1], 'never ' || c[doc_id % 4 + 1], c[3], c[4]] ELSE c END AS choices,
        answer FROM m0)"""


def hex32(key):
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, item, response (0 or 1), true ability and difficulty."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("model"), (-3.0 + 6.0 * ((F.col("s_suppkey") * 37) % 100) / 99.0).alias("th_true"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), (-2.0 + 4.0 * (F.col("item_id") % 20) / 19.0).alias("b_true"))
    u = hex32(F.concat_ws("|", F.col("model").cast("string"), F.col("item").cast("string")))
    p = 1 / (1 + F.exp(-(F.col("th_true") - F.col("b_true"))))
    return s.crossJoin(b).select("model", "item", F.when(u < p, 1.0).otherwise(0.0).alias("response"), "th_true", "b_true")


ABILITIES_SQL = "abilities AS (SELECT model, ln(p / (1 - p)) AS theta FROM (SELECT model, least(0.99e0, greatest(0.01e0, avg(response))) AS p FROM responses GROUP BY model))"
RESPONSES_SQL = """
    responses AS (SELECT s.model, b.item, th_true, b_true,
        CASE WHEN ('0x' || substr(md5(s.model || '|' || b.item), 1, 8))::UBIGINT::DOUBLE / 4294967296e0 < 1 / (1 + exp(-(th_true - b_true))) THEN 1e0 ELSE 0e0 END AS response
        FROM (SELECT s_suppkey AS model, -3e0 + 6e0 * ((s_suppkey * 37) % 100) / 99e0 AS th_true FROM supplier) s,
             (SELECT item_id AS item, -2e0 + 4e0 * (item_id % 20) / 19e0 AS b_true FROM benchmark) b),
    """ + ABILITIES_SQL


def flawed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response matrix with items that all models get right, that none does, and that ability hardly tells on."""
    r, k = responses(spark, sf_dir), F.col("item") % 10
    u = hex32(F.concat_ws("|", F.lit("flaw"), F.col("model").cast("string"), F.col("item").cast("string")))
    dull = F.when(u < 1 / (1 + F.exp(-0.25 * F.col("th_true"))), 1.0).otherwise(0.0)
    return r.withColumn("response", F.when(k == 0, 1.0).when(k == 1, 0.0).when(k == 2, dull).otherwise(F.col("response")))


FLAWED_SQL = RESPONSES_SQL.replace("responses AS (", "whole AS (", 1).replace(ABILITIES_SQL, f"""
    responses AS (SELECT * REPLACE (CASE item % 10 WHEN 0 THEN 1e0 WHEN 1 THEN 0e0
        WHEN 2 THEN CASE WHEN ('0x' || substr(md5('flaw|' || model || '|' || item), 1, 8))::UBIGINT::DOUBLE / 4294967296e0 < 1 / (1 + exp(-0.25e0 * th_true)) THEN 1e0 ELSE 0e0 END
        ELSE response END AS response) FROM whole),
    {ABILITIES_SQL}""")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark, period, model, bench_score, downstream_score."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return joined.groupBy(F.col("o_orderpriority").alias("benchmark"), F.year("o_orderdate").alias("period"), F.col("c_nationkey").alias("model")).agg(F.avg("o_totalprice").alias("bench_score"), F.avg("c_acctbal").alias("downstream_score"))


MEASURE_SQL = """
    measurements AS (SELECT o_orderpriority AS benchmark, year(o_orderdate)::INTEGER AS period, c_nationkey AS model, avg(o_totalprice) AS bench_score, avg(c_acctbal) AS downstream_score
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    ranked AS (SELECT *, rank() OVER (PARTITION BY benchmark, period ORDER BY bench_score) + (count(*) OVER (PARTITION BY benchmark, period, bench_score) - 1) / 2e0 AS rx,
        rank() OVER (PARTITION BY benchmark, period ORDER BY downstream_score) + (count(*) OVER (PARTITION BY benchmark, period, downstream_score) - 1) / 2e0 AS ry FROM measurements),
    pairs AS (SELECT a.benchmark, a.period, sign(a.bench_score - b.bench_score) AS sx, sign(a.downstream_score - b.downstream_score) AS sy
        FROM measurements a JOIN measurements b ON a.benchmark = b.benchmark AND a.period = b.period AND a.model < b.model),
    taus AS (SELECT benchmark, period, sum(sx * sy) / nullif(sqrt(sum(abs(sx)) * sum(abs(sy))::DOUBLE), 0) AS tau FROM pairs GROUP BY ALL),
    records AS (SELECT benchmark, period, count(*) AS n_models,
        covar_pop(bench_score, downstream_score) / nullif(sqrt(var_pop(bench_score) * var_pop(downstream_score)), 0) AS pearson,
        covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0) AS spearman, any_value(tau) AS tau
        FROM ranked LEFT JOIN taus USING (benchmark, period) GROUP BY benchmark, period HAVING count(*) >= 3)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question, model, answer: the mean value in steps of 20.

    Values are added as decimals of ten places, since a sum of doubles depends on their order and a mean on the edge of a step
    would fall on either side. Where a value is no such decimal (NaN, 1e20), the mean is that of the doubles.
    """
    exact, n = F.col("value").try_cast("decimal(28,10)"), F.count("value")
    said = F.col("user_id").alias("question"), F.col("event_type").alias("model")
    sums = table(spark, sf_dir, "events").groupBy(*said).agg(F.sum(exact).alias("s"), F.when(F.count(exact) == n, n * 20).cast("decimal(20,0)").alias("m"), F.floor(F.avg("value") / 20).alias("plain"))
    return sums.select("question", "model", F.coalesce(F.expr("(s - pmod(s, m)) div m"), "plain").cast("string").alias("answer"))


VOTES_SQL = "votes AS (SELECT user_id AS question, event_type AS model, floor(avg(value) / 20)::BIGINT::VARCHAR AS answer FROM events GROUP BY ALL)"
