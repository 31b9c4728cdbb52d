"""Plans over what grows or answers in pieces: committed logs, tracked states, one-object indexes, paged sources, generation."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text
from ..operators import generation
from ..sources import index, log
from ..sources.paged import paged
from ..sources.store import place
from ..streaming import health
from .contamination import FINGERPRINT, GRAM8
from .fixtures import MEASURE_SQL, measurements, table
from .registry import query
from .tracking import ROUNDED, TREND


@query(f"WITH {GRAM8} SELECT DISTINCT md5(x) AS gram, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source FROM be")
def ngram_index_object(spark, sf_dir):
    """The n-gram index as one JSON object in one file, read back in ranges."""
    b = table(spark, sf_dir, "benchmark")
    grams = b.select(F.explode(text.catalog_grams(F.col("text"))).alias("gram"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("source"))
    path = place(spark, "object")
    index.write_ngram_index(grams, path)
    return index.ngram_index(spark, path)


@query(f"WITH {MEASURE_SQL} SELECT benchmark, period, n_models, round(pearson, 6) AS pearson FROM records")
def correlation_log(spark, sf_dir):
    """Two batches committed to one log, one of them twice, and a third one whose writer died before its commit."""
    from ..operators import correlation

    r = correlation.records(measurements(spark, sf_dir), ["benchmark", "period"], "bench_score", "downstream_score").select("benchmark", "period", "n_models", F.round("pearson", 6).alias("pearson"))
    path = place(spark, "log")
    log.commit(r.where("period % 2 = 0"), path, "even")
    log.commit(r.where("period % 2 = 1"), path, "odd")
    log.commit(r.where("period % 2 = 0"), path, "even")
    r.write.parquet(f"{path}/data/dead")
    return log.committed(spark, path, "benchmark string, period int, n_models long, pearson double")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 0 WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS round FROM documents")
def crawl_resume(spark, sf_dir):
    """A crawl in three runs, each of which takes what no earlier one has committed; the second is tried twice."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id"), place(spark, "crawl")
    of = lambda rows, n: rows.select("doc_id", F.lit(n).alias("round"))
    log.commit(of(docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi"), 0), path, "first")
    for _ in range(2):
        log.commit(of(log.not_yet(docs, path, "doc_id").where("doc_id % 2 = 0"), 1), path, "second")
    log.commit(of(log.not_yet(docs, path, "doc_id"), 2), path, "third")
    return log.committed(spark, path, "doc_id long, round int")


WHOLE = TREND.replace(ROUNDED, "rec AS (SELECT benchmark, period, n_models, pearson, spearman, tau FROM records)")


@query(f"WITH {WHOLE} SELECT benchmark, n_records, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(tau, 6) AS tau, slope, trend, reason FROM rep")
def tracked_trends(spark, sf_dir):
    """Trends and alerts from states that batches keep up to date; every second batch comes late, the last one twice."""
    m, logs, states = measurements(spark, sf_dir), place(spark, "records"), place(spark, "states")
    for k in (1, 0, 2, 2):
        health.absorb(m.where(F.col("period") % 3 == k), f"batch {k}", logs, states)
    found = health.reports(health.current(spark, states))
    return found.select("benchmark", "n_records", *[F.round(c, 6).alias(c) for c in ("pearson", "spearman", "tau")], "slope", "trend", "reason")


@query("SELECT page_id, url, length(html) AS n_chars FROM pages")
def paged_source(spark, sf_dir):
    """Stored pages of eight queries, twenty rows each, read as a data source whose fetcher opens them one after another."""
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 8).alias("q"), F.floor(F.col("page_id") / 160).alias("n"), F.struct("page_id", "url", F.length("html").cast("long").alias("n_chars")).alias("row"))
    path = place(spark, "pages")
    rows.groupBy("q", "n").agg(F.to_json(F.sort_array(F.collect_list("row"))).alias("value")).write.partitionBy("q", "n").text(path)

    def fetch(q, token):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        folder = f"{root}/q={q}/n={token or 0}"
        files = [f.path for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".txt")]
        found = []
        for f in files:
            with system.open_input_stream(f) as stream:
                found += [(r["page_id"], r["url"], r["n_chars"]) for line in stream.read().decode().splitlines() for r in json.loads(line)]
        return found, (token or 0) + 1 if files else None

    name = "evalsieve_pages"
    spark.dataSource.register(paged(name, "page_id long, url string, n_chars long", fetch, [str(q) for q in range(8)]))
    return spark.read.format(name).load()


def stub(prompts):
    """In place of a model: every seventh variant is no JSON, every seventh has no question, the others ask one of two questions
    of their template."""
    said = []
    for p in prompts:
        start, _, variant = p.rpartition("\nVariant ")
        v = int(variant)
        said.append("no idea" if v % 7 == 0 else json.dumps({"question": " " if v % 7 == 1 else f"{start} {v % 2}", "answer": str(v)}))
    return said


#: attempts in order, with the first of each fingerprint that passes; ends in tried(i, q, reason) up to the target
GENERATED = f"""
    o AS (SELECT doc_id, text, row_number() OVER (ORDER BY md5('ask|' || doc_id), doc_id) AS nth FROM documents),
    z AS (SELECT count(*) AS n, count(*) // 4 AS target FROM documents),
    d AS (SELECT i, ('0x' || substr(md5('ask|draw|' || i), 1, 15))::BIGINT % n + 1 AS nth FROM (SELECT unnest(range(5 * target)) AS i, n FROM z)),
    a AS (SELECT i, CASE WHEN i % 7 > 1 THEN trim(substr(text, 1, 60) || ' ' || i % 2) END AS q FROM d JOIN o USING (nth)),
    k AS (SELECT {FINGERPRINT.format("substr(text, 1, 60) || ' 0'")} AS fp FROM documents WHERE doc_id % 10 = 0),
    f AS (SELECT i, q, CASE WHEN q IS NOT NULL THEN {FINGERPRINT.format("q")} END AS fp FROM a),
    r AS (SELECT i, q, CASE WHEN i % 7 = 0 THEN 'unparsed' WHEN i % 7 = 1 THEN 'empty' WHEN fp IN (SELECT fp FROM k) THEN 'contaminated' WHEN row_number() OVER (PARTITION BY fp ORDER BY i) = 1 THEN 'accepted' ELSE 'repeated' END AS reason FROM f),
    w AS (SELECT *, count(*) FILTER (reason = 'accepted') OVER (ORDER BY i) - (reason = 'accepted')::INTEGER AS had FROM r),
    tried AS (SELECT i, q, reason FROM w WHERE had < (SELECT target FROM z))"""


def generated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    catalog = docs.where("doc_id % 10 = 0").select(text.fingerprint(F.concat(F.substring("text", 1, 60), F.lit(" 0"))).alias("fp"))
    return generation.generate(docs, "doc_id", F.substring("text", 1, 60), F.lit("math"), stub, docs.count() // 4, catalog, "ask")


@query(f"WITH {GENERATED} SELECT i AS attempt, md5(q) AS question_md5, i::VARCHAR AS answer, 'numeric' AS note FROM tried WHERE reason = 'accepted'")
def generation_loop(spark, sf_dir):
    """Rounds of attempts until a quarter as many questions as there are documents stand."""
    return generated(spark, sf_dir)[0].select("attempt", F.md5("question").alias("question_md5"), "answer", "note")


@query(f"WITH {GENERATED} SELECT reason, count(*) AS n FROM tried GROUP BY reason")
def generation_reasons(spark, sf_dir):
    return generated(spark, sf_dir)[1]
