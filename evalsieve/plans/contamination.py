"""Contamination plans: is benchmark text in the corpus?"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import contamination as op
from ..sources import jsonl
from .fixtures import table
from .registry import query

WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"
PLAIN = WORDS.format("regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')")
LOW = WORDS.format("lower({})")


def grams_sql(words: str, n: int) -> str:
    return f"CASE WHEN len({words}) >= {n} THEN list_transform(range(1, len({words}) - {n} + 2), lambda i: array_to_string({words}[i:i + {n} - 1], ' ')) ELSE [] END"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def hits_sql(column: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({column}), {quoted(p)})::INTEGER" for p in phrases) + ")"


def any_sql(low: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({low}, {quoted(p)})" for p in phrases) + ")"


CLEAN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
FINGERPRINT = f"sha256(lower({CLEAN}))"
GRAM8 = f"""
    bw AS (SELECT item_id, {PLAIN.format('text')} AS w FROM benchmark),
    bg AS (SELECT item_id, {grams_sql('w', 8)} AS g FROM bw),
    be AS (SELECT item_id, unnest(g) AS x FROM bg),
    dw AS (SELECT doc_id, {PLAIN.format('text')} AS w FROM documents),
    de AS (SELECT doc_id, unnest({grams_sql('w', 8)}) AS x FROM dw)"""
GRAM6 = f"""
    bw6 AS (SELECT item_id, {LOW.format('text')} AS w FROM benchmark),
    be6 AS (SELECT DISTINCT item_id, substr(md5(x), 1, 8) AS x FROM (SELECT item_id, unnest({grams_sql('w', 6)}) AS x FROM bw6)),
    dw6 AS (SELECT doc_id, {LOW.format('text')} AS w FROM documents),
    de6 AS (SELECT DISTINCT substr(md5(x), 1, 8) AS x FROM (SELECT unnest({grams_sql('w', 6)}) AS x FROM dw6)),
    s6 AS (SELECT item_id, count(*) AS n, count(*) FILTER (x IN (SELECT x FROM de6)) AS m FROM be6 GROUP BY 1)"""


@query(f"""
    WITH d AS (SELECT {FINGERPRINT.format('text')} AS fp, max(doc_id) AS source FROM documents GROUP BY 1)
    SELECT item_id, source IS NOT NULL AS matched, source FROM benchmark LEFT JOIN d ON fp = {FINGERPRINT.format('benchmark.text')}""")
def contam_exact(spark, sf_dir):
    return op.by_fingerprint(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text")


@query(f"""
    WITH {GRAM8}, h AS (SELECT item_id, count(*) AS hits FROM be WHERE x IN (SELECT x FROM de) GROUP BY 1)
    SELECT item_id, len(g)::BIGINT AS n_grams, coalesce(hits, 0) AS hits, round(CASE WHEN len(g) > 0 THEN coalesce(hits, 0) / len(g)::DOUBLE ELSE 0 END, 3) AS ratio,
        CASE WHEN len(g) > 0 THEN coalesce(hits, 0) / len(g)::DOUBLE ELSE 0 END >= 0.3e0 AS is_contaminated
    FROM bg LEFT JOIN h USING (item_id)""")
def contam_ngram8(spark, sf_dir):
    return op.gram_ratio(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "text")


@query(f"""
    WITH {GRAM6}
    SELECT item_id, coalesce(n, 0) AS n_grams, coalesce(m, 0) AS matches, coalesce(round(least(1e0, 3e0 * m / n), 3), 0e0) AS score FROM benchmark LEFT JOIN s6 USING (item_id)""")
def contam_ngram6_agent(spark, sf_dir):
    return op.index_score(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "text")


@query(f"""
    WITH i AS (SELECT DISTINCT item_id, x AS gram FROM (SELECT item_id, unnest({grams_sql('w', 6)}) AS x FROM (SELECT item_id, {LOW.format('text')} AS w FROM benchmark))),
    d AS (SELECT DISTINCT doc_id, x AS gram FROM (SELECT doc_id, unnest({grams_sql('w', 6)}) AS x FROM (SELECT doc_id, {LOW.format('text')} AS w FROM documents))),
    s AS (SELECT gram, list(doc_id ORDER BY doc_id)[1:3] AS sources FROM d WHERE gram IN (SELECT gram FROM i) GROUP BY gram),
    r AS (SELECT item_id, gram, sources, row_number() OVER (PARTITION BY item_id ORDER BY gram) AS nth FROM i JOIN s USING (gram))
    SELECT item_id, gram, array_to_string(sources, ',') AS sources FROM r WHERE nth <= 3""")
def contam_examples(spark, sf_dir):
    found = op.index_examples(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text")
    return found.withColumn("sources", F.array_join(F.transform("sources", lambda s: s.cast("string")), ","))


@query(f"""
    WITH {GRAM8} SELECT de.doc_id, be.item_id, count(*) AS hits FROM de JOIN (SELECT DISTINCT item_id, x FROM be) be USING (x) GROUP BY ALL""")
def doc_benchmark_overlap(spark, sf_dir):
    grams = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(text.gram_keys(F.col("text")))).alias("gram"))
    told = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.gram_keys(F.col("text"))).alias("gram"))
    return told.join(grams, "gram").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("hits"))


@query(f"""
    WITH {GRAM8}, c AS (SELECT x, max(src) AS source FROM (SELECT CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS src, x FROM be) GROUP BY x),
    h AS (SELECT doc_id, source, count(*) AS hits FROM de JOIN c USING (x) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, source) AS nth FROM h)
    SELECT doc_id, source, hits, round(hits / (len(w) - 7)::DOUBLE, 3) AS ratio, hits / (len(w) - 7)::DOUBLE >= 0.3e0 AS is_contaminated FROM r JOIN dw USING (doc_id) WHERE nth = 1""")
def contam_best_source(spark, sf_dir):
    catalog = table(spark, sf_dir, "benchmark").withColumn("source", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd"))
    return op.best_source(table(spark, sf_dir, "documents"), catalog, "doc_id", "text", "source", "text")


@query(f"""
    WITH {GRAM8}, src AS (SELECT *, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source FROM benchmark),
    cand AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, '  ' || lower(text) FROM benchmark WHERE item_id % 3 = 0),
    cw AS (SELECT doc_id, {PLAIN.format('text')} AS w FROM cand), ce AS (SELECT doc_id, unnest({grams_sql('w', 8)}) AS x FROM cw),
    ex AS (SELECT {FINGERPRINT.format('text')} AS fp, max(source) AS exact FROM src GROUP BY 1),
    t AS (SELECT doc_id, exact FROM cand LEFT JOIN ex ON fp = {FINGERPRINT.format('cand.text')}),
    c AS (SELECT x, max(source) AS source FROM be JOIN src USING (item_id) GROUP BY x),
    h AS (SELECT doc_id, source, count(*) AS hits FROM ce JOIN c USING (x) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, source) AS nth FROM h),
    z AS (SELECT doc_id, source AS fuzzy, round(hits / (len(w) - 7)::DOUBLE, 3) AS ratio FROM r JOIN cw USING (doc_id) WHERE nth = 1 AND hits / (len(w) - 7)::DOUBLE >= 0.3e0)
    SELECT doc_id, exact IS NOT NULL OR fuzzy IS NOT NULL AS is_contaminated, coalesce(exact, fuzzy) AS source, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN fuzzy IS NOT NULL THEN 'fuzzy' END AS match_type,
        CASE WHEN exact IS NOT NULL THEN 1e0 ELSE coalesce(ratio, 0e0) END AS confidence FROM t LEFT JOIN z USING (doc_id)""")
def catalog_check(spark, sf_dir):
    """Documents and a third of the items, in small letters, against the catalog: exact match, else n-grams, else none."""
    b = table(spark, sf_dir, "benchmark")
    catalog = b.withColumn("source", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd"))
    shouted = b.where("item_id % 3 = 0").select((-1 - F.col("item_id")).alias("doc_id"), F.concat(F.lit("  "), F.lower("text")).alias("text"))
    return op.catalog_check(table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(shouted), catalog, "doc_id", "text", "source", "text")


@query(f"""
    SELECT doc_id, CASE WHEN len({WORDS.format('text')}) < 6 THEN 0e0 ELSE least(1e0, {hits_sql('text', values.INDEX_FREE_PHRASES)} * 0.3e0) END AS score,
        {any_sql('lower(text)', values.AUDIT_PHRASES)} AND length(text) < 100 AS audit_flag FROM documents""")
def contam_heuristic(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", op.phrase_score(F.col("text")).alias("score"), op.audit_flag(F.col("text")).alias("audit_flag"))


@query("SELECT doc_id, least(1e0, (" + " + ".join(f"regexp_matches(lower(text), {quoted(p)})::INTEGER" for p in values.TEMPLATE_PATTERNS) + ") * 0.25e0) AS score FROM documents")
def contam_template(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", op.template_score(F.col("text")).alias("score"))


@query(f"""
    WITH {GRAM6}, mw AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark),
    mr AS (SELECT item_id, list_distinct(list_transform(w[greatest(3, len(w) // 3) + 1:], lambda x: lower(x))) AS expected FROM mw WHERE len(w) >= 5),
    mm AS (SELECT item_id, round(CASE WHEN len(expected) = 0 THEN 0 ELSE len(list_intersect(expected, list_distinct({LOW.format('text')}))) / len(expected)::DOUBLE END, 3) AS memory FROM mr JOIN documents ON doc_id = item_id),
    t AS (SELECT item_id, least(1e0, ({' + '.join(f"regexp_matches(lower(text), {quoted(p)})::INTEGER" for p in values.TEMPLATE_PATTERNS)}) * 0.25e0) AS template,
        coalesce(round(least(1e0, 3e0 * m / n), 3), 0e0) AS ngram, memory FROM benchmark LEFT JOIN s6 USING (item_id) LEFT JOIN mm USING (item_id)),
    c AS (SELECT *, (0.4e0 * ngram + 0.3e0 * template + CASE WHEN memory IS NULL THEN 0e0 ELSE 0.3e0 * memory END) / (0.4e0 + 0.3e0 + CASE WHEN memory IS NULL THEN 0e0 ELSE 0.3e0 END) AS whole FROM t)
    SELECT item_id, round(whole, 3) AS composite, whole > 0.5e0 AS is_contaminated, memory IS NOT NULL AS completed,
        concat_ws(',', CASE WHEN ngram > 0.5e0 THEN 'ngram' END, CASE WHEN template > 0.5e0 THEN 'template' END, CASE WHEN memory > 0.5e0 THEN 'memorization' END) AS methods,
        CASE WHEN (ngram > 0.5e0)::INTEGER + (template > 0.5e0)::INTEGER + coalesce((memory > 0.5e0)::INTEGER, 0) >= 2 THEN 'HIGH' WHEN greatest(ngram, template, coalesce(memory, 0e0)) > 0.7e0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM c""")
def contam_composite(spark, sf_dir):
    """All three methods; a document of the item's number stands for a model's completion of it."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    ngram = op.index_score(b, d, "item_id", "text", "text").select("item_id", F.col("score").alias("ngram"))
    prefix, rest = text.prefix_and_rest(F.col("text"))
    said = d.select(F.col("doc_id").alias("item_id"), F.col("text").alias("said"))
    memory = b.where(prefix.isNotNull()).select("item_id", rest.alias("rest")).join(said, "item_id").select("item_id", op.memorised(F.col("rest"), F.col("said")).alias("memory"))
    scored = b.select("item_id", op.template_score(F.col("text")).alias("template")).join(ngram, "item_id").join(memory, "item_id", "left")
    scores = {"ngram": F.col("ngram"), "template": F.col("template"), "memorization": F.col("memory")}
    whole = op.composite(scores)
    return scored.select("item_id", F.round(whole, 3).alias("composite"), (whole > 0.5).alias("is_contaminated"), F.col("memory").isNotNull().alias("completed"), F.array_join(op.methods_flagged(scores), ",").alias("methods"), op.confidence(scores).alias("confidence"))


@query(f"""
    WITH w AS (SELECT conv_id, turn, {WORDS.format('text')} AS w FROM conversations WHERE role = 'user'),
    p AS (SELECT conv_id, turn, array_to_string(w[:greatest(3, len(w) // 3)], ' ') AS prefix, w[greatest(3, len(w) // 3) + 1:] AS rest FROM w WHERE len(w) >= 5),
    a AS (SELECT conv_id, turn - 1 AS turn, list_distinct({LOW.format('text')}) AS said FROM conversations WHERE role = 'assistant'),
    e AS (SELECT conv_id, turn, prefix, list_distinct(list_transform(rest, lambda x: lower(x))) AS expected FROM p)
    SELECT conv_id, turn, prefix, round(CASE WHEN len(expected) = 0 THEN 0 ELSE len(list_intersect(expected, said)) / len(expected)::DOUBLE END, 3) AS overlap FROM e JOIN a USING (conv_id, turn)""")
def memorization_overlap(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    prefix, rest = text.prefix_and_rest(F.col("text"))
    asked = c.where("role = 'user'").select("conv_id", "turn", prefix.alias("prefix"), rest.alias("rest")).where("prefix is not null")
    said = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said"))
    return asked.join(said, ["conv_id", "turn"]).select("conv_id", "turn", "prefix", op.memorised(F.col("rest"), F.col("said")).alias("overlap"))


@query(f"""
    SELECT 'benchmark' AS benchmark, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS subset, {FINGERPRINT.format('text')} AS exact_fingerprint,
        md5(array_to_string(list_transform({grams_sql('w', 8)}, lambda x: md5(x)), ',')) AS grams_md5, 'text' AS category, substr(text, 1, 120) AS question_preview
    FROM (SELECT item_id, text, {PLAIN.format('text')} AS w FROM benchmark)""")
def catalog_build(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    entries = jsonl.catalog_entries(b, "benchmark", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd"), "text", F.lit("text"))
    return entries.withColumn("grams_md5", F.md5(F.array_join("ngram_fingerprints", ","))).drop("ngram_fingerprints")


@query(f"""
    WITH e AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS benchmark, {PLAIN.format('text')} AS w FROM benchmark),
    g AS (SELECT item_id, benchmark, md5(x) AS gram FROM (SELECT item_id, benchmark, unnest({grams_sql('w', 8)}) AS x FROM e))
    SELECT gram, max_by(benchmark, item_id) AS benchmark FROM g GROUP BY gram""")
def catalog_gram_map(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    source = F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd")
    catalog = b.select("item_id", source.alias("benchmark"), text.fingerprint(F.col("text")).alias("exact_fingerprint"), text.catalog_grams(F.col("text")).alias("ngram_fingerprints"))
    return jsonl.catalog_maps(catalog, "item_id")[1]
