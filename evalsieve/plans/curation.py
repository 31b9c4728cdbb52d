"""Corpus curation plans: filters, fingerprints, deduplication, splits, papers, pages and chats."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text, values
from ..operators import corpus, dedup
from ..sources import jsonl
from .contamination import CLEAN, FINGERPRINT, GRAM8, WORDS, any_sql, hits_sql, quoted
from .fixtures import table
from .registry import query

COUNT = f"len({WORDS.format('text')})"
DIFFICULTY = f"CASE WHEN {COUNT} < 20 THEN 'easy' WHEN {COUNT} < 60 THEN 'medium' ELSE 'hard' END"


@query(f"SELECT doc_id, fp FROM (SELECT doc_id, {FINGERPRINT.format('text')} AS fp, row_number() OVER (PARTITION BY {FINGERPRINT.format('text')} ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_exact(spark, sf_dir):
    return dedup.first_by_fingerprint(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT {FINGERPRINT.format('text')} AS fp, min(doc_id) AS first_id, count(*) AS size FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    return dedup.duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


PERMUTED = "[" + ", ".join(f"{{'a': {a}::BIGINT, 'b': {b}::BIGINT}}" for a, b in map(dedup.permutation, range(128))) + "]"
MINHASH = f"""
    mt AS (SELECT doc_id AS id, list_transform(list_distinct({WORDS.format('text')}), lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) AS h FROM documents),
    ms AS (SELECT id, list_transform({PERMUTED}, lambda p: list_min(list_transform(h, lambda x: (x * p.a + p.b) % {dedup.PRIME}))) AS s FROM mt WHERE len(h) > 0),
    mk AS (SELECT id, list_transform(range(0, 128, 16), lambda i: md5(i || ':' || array_to_string(s[i + 1:i + 16], ':'))) AS ks FROM ms)"""


SETS = f"""
    t AS (SELECT doc_id AS id, list_sort(list_distinct({WORDS.format('text')})) AS w FROM documents),
    one AS (SELECT min(id) AS id, w FROM t WHERE len(w) > 0 GROUP BY w)"""


@query(f"""WITH {SETS} SELECT a, b, j AS jaccard FROM (
    SELECT x.id AS a, y.id AS b, len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))::DOUBLE AS j FROM one x JOIN one y ON x.id < y.id AND len(x.w) * 10 >= len(y.w) * 8 AND len(y.w) * 10 >= len(x.w) * 8) WHERE j >= 0.8e0""")
def jaccard_pairs(spark, sf_dir):
    """All pairs of different sets of words at 0.8 or more; the SQL compares all with all."""
    return dedup.similar_pairs(spark, table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {SETS} SELECT t.id, one.id AS set_id FROM t JOIN one USING (w)")
def word_sets(spark, sf_dir):
    """Which texts stand for which in jaccard_pairs."""
    return dedup.same_sets(spark, table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {MINHASH} SELECT key, count(*) AS n, min(id) AS first_id FROM (SELECT id, unnest(ks) AS key FROM mk) GROUP BY key HAVING count(*) > 1")
def minhash_bands(spark, sf_dir):
    """The buckets of 128 permutations in bands of 16 that several documents share."""
    keys = dedup.buckets(table(spark, sf_dir, "documents"), "doc_id", "text")
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def greedy_sql(members: str) -> str:
    """The greedy rule over members(doc_id, ks: keys as numbers): CTEs that end in kept(doc_id)."""
    return f"""
    o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM {members}),
    g AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS seen, NULL::BIGINT AS doc_id, false AS kept
        UNION ALL SELECT o.r, CASE WHEN list_has_any(seen, ks) THEN seen ELSE list_concat(seen, ks) END, o.doc_id, NOT list_has_any(seen, ks) FROM g JOIN o ON o.r = g.r + 1),
    kept AS (SELECT doc_id FROM g WHERE kept)"""


GREEDY = f"""RECURSIVE {MINHASH}, gm AS MATERIALIZED (SELECT doc_id, coalesce(list_transform(ks, lambda x: ('0x' || substr(x, 1, 15))::BIGINT), []::BIGINT[]) AS ks FROM documents LEFT JOIN mk ON id = doc_id), {greedy_sql('gm')}"""


def kept_of(spark, docs, id_col="doc_id"):
    return dedup.greedy_keep(spark, docs.select(id_col), dedup.buckets(docs, id_col, "text")).withColumnRenamed("id", id_col)


@query(f"WITH {GREEDY} SELECT doc_id FROM kept")
def greedy_dedup(spark, sf_dir):
    """Keep iff no earlier kept document shares a MinHash band, in the order of ids."""
    return kept_of(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


LINE_KEYS = "list_transform(list_filter(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x))), lambda x: length(x) >= 20), lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT)"


@query(f"WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, {LINE_KEYS} AS ks FROM documents), {greedy_sql('l')} SELECT doc_id FROM kept")
def greedy_lines(spark, sf_dir):
    """The greedy rule with lines as keys: keep iff no earlier kept document has one of the document's lines of 20 characters or
    more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x))), lambda x: F.length(x) >= 20).alias("k"))
    return dedup.greedy_keep(spark, docs.select("doc_id"), docs.select(F.col("doc_id").alias("id"), F.explode("k").alias("key"))).withColumnRenamed("id", "doc_id")


SPLIT = """o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents),
    s AS (SELECT doc_id, CASE WHEN r <= floor(n * 0.9e0) THEN 'train' WHEN r <= floor(n * 0.9e0) + floor(n * 0.05e0) THEN 'validation' ELSE 'test' END AS split FROM o)"""


@query(f"WITH {SPLIT} SELECT doc_id, split FROM s")
def split_exact(spark, sf_dir):
    return dedup.exact_split(table(spark, sf_dir, "documents"), "doc_id")


@query(f"WITH {SPLIT} SELECT split, count(*) AS n FROM s GROUP BY split")
def split_statistics(spark, sf_dir):
    return jsonl.statistics(split_exact(spark, sf_dir), "split")


@query(f"""WITH {GREEDY}, so AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM kept)
    SELECT split, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, CASE WHEN r <= floor(n * 0.9e0) THEN 'train' WHEN r <= floor(n * 0.9e0) + floor(n * 0.05e0) THEN 'validation' ELSE 'test' END AS split FROM so) GROUP BY split""")
def merge_dedup_split(spark, sf_dir):
    """The corpus build: merged, greedily deduplicated, split."""
    s = dedup.exact_split(greedy_dedup(spark, sf_dir), "doc_id")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT doc_id FROM documents ORDER BY md5('draw|' || doc_id), doc_id LIMIT 100")
def hash_sample(spark, sf_dir):
    return dedup.sampled(table(spark, sf_dir, "documents"), "doc_id", 100, "draw").select("doc_id")


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('pick|' || doc_id), doc_id) AS nth FROM documents),
    d AS (SELECT i AS draw, ('0x' || substr(md5('pick|draw|' || i), 1, 15))::BIGINT % (SELECT count(*) FROM documents) + 1 AS nth FROM (SELECT unnest(range((SELECT count(*) FROM documents))) AS i))
    SELECT draw, doc_id FROM d JOIN o USING (nth)""")
def drawn_with_replacement(spark, sf_dir):
    """As many draws as there are documents: about a third of these are never drawn, others several times."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return dedup.drawn(docs, "doc_id", docs.count(), "pick")


@query(f"SELECT {DIFFICULTY} AS difficulty, lang, coalesce(quality, -1) AS quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def difficulty_dist(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy(corpus.difficulty(F.col("text")).alias("difficulty"), "lang", F.coalesce("quality", F.lit(-1)).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def stream_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def paper(alias: str = "documents") -> str:
    return "(doc_id * 37) % 700 AS citations, 2016 + (doc_id % 10) AS year"


RELEVANCE = f"""least(1e0, round({hits_sql('t', values.HIGH_VALUE_TERMS)} * 0.15e0 + {hits_sql('t', values.MEDIUM_VALUE_TERMS)} * 0.05e0
    + CASE WHEN citations > 500 THEN 0.3e0 WHEN citations > 100 THEN 0.2e0 WHEN citations > 20 THEN 0.1e0 ELSE 0e0 END + CASE WHEN year >= 2022 THEN 0.1e0 WHEN year >= 2020 THEN 0.05e0 ELSE 0e0 END, 6))"""
TITLES = ["An evaluation of shortcut learning", "Benchmark contamination and data leakage", "Notes", "Robustness and generalization metric", "Saturation: a benchmark critique"]
TITLE_SQL = "[" + ", ".join(map(quoted, TITLES)) + "][(doc_id % 5 + 1)::INTEGER]"
PAPERS = f"papers AS (SELECT doc_id, title, text, citations, year, {RELEVANCE} AS score FROM (SELECT doc_id, title, text, title || ' ' || text AS t, citations, year FROM (SELECT doc_id, {TITLE_SQL} AS title, text, {paper()} FROM documents)))"


def papers(spark, sf_dir):
    title = F.get(F.array(*map(F.lit, TITLES)), (F.col("doc_id") % 5).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), "text", ((F.col("doc_id") * 37) % 700).alias("citations"), (2016 + F.col("doc_id") % 10).alias("year"))
    return d.withColumn("score", corpus.relevance(F.col("title"), F.col("text"), F.col("citations"), F.col("year")))


@query(f"WITH {PAPERS} SELECT doc_id, score FROM papers WHERE score >= 0.4e0 ORDER BY score DESC, doc_id LIMIT 2000")
def relevance_topk(spark, sf_dir):
    return corpus.high_value(papers(spark, sf_dir), "score", "doc_id").select("doc_id", "score")


@query(f"WITH {PAPERS} SELECT year, count(*) AS n, round(avg(score), 9) AS mean_score, count(*) FILTER (score >= 0.4e0) AS n_high FROM papers GROUP BY year")
def paper_mining(spark, sf_dir):
    return papers(spark, sf_dir).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("mean_score"), F.count_if(F.col("score") >= 0.4).alias("n_high"))


SENTENCES = "string_split(regexp_replace({}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def stems_sql(stems: list[str], most: int) -> str:
    return f"array_to_string(list_transform(list_filter({SENTENCES.format('t')}, lambda s: {any_sql('lower(s)', stems)}), lambda s: trim(s))[1:{most}], '|')"


@query(f"SELECT doc_id, {stems_sql(values.METHOD_STEMS, 5)} AS methods, {stems_sql(values.FAILURE_STEMS, 3)} AS failures FROM (SELECT doc_id, {TITLE_SQL} || '. ' || text AS t FROM documents)")
def sentence_extract(spark, sf_dir):
    title = F.get(F.array(*map(F.lit, TITLES)), (F.col("doc_id") % 5).cast("int"))
    t = F.concat(title, F.lit(". "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.sentences_with(t, values.METHOD_STEMS, 5), "|").alias("methods"), F.array_join(text.sentences_with(t, values.FAILURE_STEMS, 3), "|").alias("failures"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {TITLE_SQL} || ' ' || text AS t FROM documents) WHERE {any_sql('lower(t)', values.RELEVANCE_TERMS)}")
def relevance_filter(spark, sf_dir):
    return papers(spark, sf_dir).where(corpus.relevant(F.col("title"), F.col("text"))).select("doc_id")


@query(f"SELECT doc_id, CASE {' '.join(f'WHEN {any_sql(chr(116), w)} THEN {quoted(k)}' for k, w in values.MATH_SUBJECTS.items())} ELSE 'general' END AS subject FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def math_classify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.math_subject(F.col("text")).alias("subject"))


@query("""SELECT page_id, CASE WHEN contains(c, 'AIME') THEN 'hard' WHEN contains(c, 'AMC 12') THEN 'medium-hard' WHEN contains(c, 'AMC 10') THEN 'medium' ELSE 'easy-medium' END AS difficulty
    FROM (SELECT page_id, ['AIME I', 'AMC 12A', 'AMC 10B', 'AJHSME'][(page_id % 4 + 1)::INTEGER] AS c FROM pages)""")
def contest_difficulty(spark, sf_dir):
    names = F.get(F.array(*map(F.lit, ["AIME I", "AMC 12A", "AMC 10B", "AJHSME"])), (F.col("page_id") % 4).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", corpus.contest_difficulty(names).alias("difficulty"))


MARKUP = "regexp_replace(regexp_replace(regexp_replace({}, '\\[\\[.*?\\]\\]', '', 'g'), '\\{{\\{{.*?\\}}\\}}', '', 'g'), '<[^>]+>', '', 'g')"


@query(f"SELECT page_id, md5({CLEAN.format(MARKUP.format('html'))}) AS clean_md5, length({CLEAN.format(MARKUP.format('html'))}) AS n_chars FROM pages")
def html_clean(spark, sf_dir):
    clean = text.without_markup(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(clean).alias("clean_md5"), F.length(clean).cast("long").alias("n_chars"))


@query(f"""WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: {CLEAN.format(MARKUP.format('x'))}), lambda x: x <> '') AS p FROM pages)
    SELECT page_id, len(p)::BIGINT AS n_paragraphs, md5(array_to_string(p, chr(10))) AS text_md5 FROM p""")
def html_paragraphs(spark, sf_dir):
    p = corpus.paragraphs(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", p.alias("p")).select("page_id", F.size("p").cast("long").alias("n_paragraphs"), F.md5(F.array_join("p", "\n")).alias("text_md5"))


@query(f"""WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: {CLEAN.format(MARKUP.format('x'))}), lambda x: x <> '') AS p FROM pages)
    SELECT page_id, unnest(range(1, len(p) + 1))::INTEGER AS number, md5(unnest(p)) AS text_md5 FROM p""")
def problem_sections(spark, sf_dir):
    """Problem sections of a wiki page that is made of each page's paragraphs: a heading before each, a solution behind."""
    page = F.array_join(F.transform(corpus.paragraphs(F.col("html")), lambda p, i: F.concat(F.lit("== Problem "), (i + 1).cast("string"), F.lit(" ==\n"), p, F.lit("\n== Solution ==\nno\n"))), "")
    return table(spark, sf_dir, "pages").select("page_id", F.explode(corpus.problem_sections(page)).alias("x")).select("page_id", "x.number", F.md5("x.text").alias("text_md5"))


@query("SELECT page_id, page_id::INTEGER AS number, 'title ' || page_id AS title FROM pages WHERE page_id % 3 <> 0")
def hash_records(spark, sf_dir):
    line = F.when(F.col("page_id") % 3 == 0, F.lit("x##no number##y")).otherwise(F.concat(F.lit(" "), F.col("page_id").cast("string"), F.lit(" ##  title "), F.col("page_id").cast("string"), F.lit("##z")))
    return table(spark, sf_dir, "pages").select("page_id", corpus.hash_record(line).alias("r")).where("r is not null").select("page_id", "r.*")


@query("SELECT page_id, year FROM (SELECT page_id, coalesce(try_cast(regexp_extract(v, '/([0-9]{4})(?:/|$)', 1) AS INTEGER), 0) AS year FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'org/ACL/' || (2010 + page_id % 15) || '/Conference' WHEN 1 THEN 'x.cc' ELSE 'org/' || (2010 + page_id % 15) END AS v FROM pages)) WHERE year >= 2015")
def venue_year(spark, sf_dir):
    y = (2010 + F.col("page_id") % 15).cast("string")
    venue = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("org/ACL/"), y, F.lit("/Conference"))).when(F.col("page_id") % 3 == 1, F.lit("x.cc")).otherwise(F.concat(F.lit("org/"), y))
    return table(spark, sf_dir, "pages").select("page_id", text.year_of_venue(venue).alias("year")).where("year >= 2015")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN regexp_extract(props, '[0-9]+') ELSE event_type END AS value FROM events""")
def unwrapped_values(spark, sf_dir):
    content = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"value":'), F.get_json_object("props", "$.k"), F.lit("}"))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", corpus.unwrapped(content).alias("value"))


@query("""WITH r AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
    SELECT conv_id, len(list_filter(t, lambda x: length(x) > 100))::BIGINT AS n_reviews FROM r WHERE len(list_filter(t, lambda x: length(x) > 100)) > 0""")
def substantial_reviews(spark, sf_dir):
    r = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("r"))
    return r.select("conv_id", F.size(corpus.substantial_reviews(F.col("r"))).cast("long").alias("n_reviews")).where("n_reviews > 0")


@query("""SELECT conv_id, count(*) AS n_turns, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn) AS chat FROM conversations GROUP BY conv_id""")
def chat_format(spark, sf_dir):
    return corpus.chat(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("""SELECT conv_id, '<|im_start|>system' || chr(10) || coalesce(min_by(text, turn) FILTER (role = 'system'), '') || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || coalesce(min_by(text, turn) FILTER (role = 'user'), '') || '<|im_end|>' AS prompt FROM conversations GROUP BY conv_id""")
def chat_prompt(spark, sf_dir):
    return corpus.prompt(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS batch FROM documents")
def batch_of_10(spark, sf_dir):
    return corpus.batches(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5")
def source_caps(spark, sf_dir):
    return corpus.capped(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5)


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def first_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(50)


@query("""SELECT 'documents' AS source, doc_id AS id, lang, NULL AS url, length(text) AS n FROM documents UNION ALL SELECT 'pages', page_id, NULL, url, length(html) FROM pages UNION ALL SELECT 'benchmark', item_id, NULL, NULL, length(text) FROM benchmark""")
def union_sources(spark, sf_dir):
    of = lambda name, key, t, *more: table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.col(key).alias("id"), F.length(t).cast("long").alias("n"), *more)
    return corpus.union_by_name([of("documents", "doc_id", "text", "lang"), of("pages", "page_id", "html", "url"), of("benchmark", "item_id", "text")])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def seen_antijoin(spark, sf_dir):
    return dedup.unseen(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"SELECT item_id, {FINGERPRINT.format('text')} AS fp, substr(text, 1, 200) AS excerpt, {DIFFICULTY} AS difficulty FROM benchmark WHERE trim(text) <> '' AND length(text) >= 20")
def catalog_ingest(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").where((F.trim("text") != "") & (F.length("text") >= 20))
    return b.select("item_id", text.fingerprint(F.col("text")).alias("fp"), F.substring("text", 1, 200).alias("excerpt"), corpus.difficulty(F.col("text")).alias("difficulty"))


@query("SELECT subset, question, n_choices FROM (SELECT source AS subset, substr(text, 1, 80) AS question, 4 AS n_choices, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3")
def mapped_ingest(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return jsonl.mapped(d, {"question": F.substring("text", 1, 80), "n_choices": F.lit(4)}, F.col("source"), "doc_id", 3)


@query("SELECT page_id, t FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Category:x' WHEN 1 THEN 'Template:y' WHEN 2 THEN '' ELSE url END AS t FROM pages) WHERE t <> '' AND NOT starts_with(t, 'Category:') AND NOT starts_with(t, 'Template:')")
def wiki_titles(spark, sf_dir):
    m = F.col("page_id") % 4
    t = F.when(m == 0, "Category:x").when(m == 1, "Template:y").when(m == 2, "").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).where(corpus.titles(F.col("t")))


@query(f"""WITH g AS (SELECT min(doc_id) AS doc_id FROM documents WHERE trim(text) <> '' GROUP BY {FINGERPRINT.format('text')}), k AS (SELECT doc_id, text FROM documents JOIN g USING (doc_id)),
    b AS (SELECT {FINGERPRINT.format('text')} AS fp FROM benchmark)
    SELECT doc_id, CASE WHEN try_cast(regexp_extract(text, '[0-9]+') AS BIGINT) IS NOT NULL THEN 'numeric answer' ELSE 'manual' END AS note FROM k WHERE {FINGERPRINT.format('text')} NOT IN (SELECT fp FROM b) ORDER BY doc_id LIMIT 500""")
def generation_batch(spark, sf_dir):
    """Generated candidates: valid, verified as far as numbers go, not in the catalog, each once, up to a target."""
    d = table(spark, sf_dir, "documents").where(F.trim("text") != "")
    one = dedup.first_by_fingerprint(d, "doc_id", "text")
    known = table(spark, sf_dir, "benchmark").select(text.fingerprint(F.col("text")).alias("fp"))
    note = F.when(F.regexp_extract("text", "[0-9]+", 0).try_cast("long").isNotNull(), "numeric answer").otherwise("manual")
    return one.join(known, "fp", "left_anti").join(d.select("doc_id", note.alias("note")), "doc_id").orderBy("doc_id").limit(500).select("doc_id", "note")


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT event_type, count(*) AS n, count(*) FILTER (n = 1) AS first_seen, strftime(min(ts), '%Y-%m-%d') AS first_day FROM d GROUP BY event_type""")
def event_health(spark, sf_dir):
    """The batch form of the streaming extensions: first sight of each user, and days."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("nth", nth).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("nth") == 1).alias("first_seen"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"))


@query("SELECT window_day AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT strftime(ts, '%Y-%m-%d') AS window_day, event_type, value FROM events) GROUP BY ALL")
def daily_events(spark, sf_dir):
    """Tumbling days over events, as a stream over the same rows gives them."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "mean_value")


@query("SELECT conv_id, turn AS shortest_turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS n FROM conversations) WHERE n = 1")
def first_of_equals(spark, sf_dir):
    """The argmax of K4: best value, first place among equals."""
    w = Window.partitionBy("conv_id").orderBy(F.length("text"), "turn")
    return table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(w)).where("n = 1").select("conv_id", F.col("turn").alias("shortest_turn"))


# JSON files: each query writes a table to the shared folder and reads it back


def stored(spark, name: str, write) -> str:
    """The path under which write(path) has stored something."""
    from ..sources.store import place

    path = place(spark, name)
    write(path)
    return path


def json_lines(rows):
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


@query("SELECT doc_id, lang, md5(text) AS text_md5 FROM documents WHERE doc_id % 7 <> 3")
def jsonl_lenient(spark, sf_dir):
    """Blank and broken lines among the good ones are left out: every seventh line is cut short, blank ones follow."""
    d = table(spark, sf_dir, "documents")
    line = F.to_json(F.struct("doc_id", "lang", "text"))
    line = F.when(F.col("doc_id") % 7 == 3, F.substring(line, 1, 9)).otherwise(line)
    path = stored(spark, "lines", lambda p: d.select(F.concat(line, F.when(F.col("doc_id") % 5 == 0, "\n\n").otherwise("")).alias("value")).write.text(p))
    return jsonl.lenient(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("SELECT item_id, md5(text) AS text_md5 FROM benchmark")
def jsonl_strict(spark, sf_dir):
    path = stored(spark, "strict", lambda p: json_lines(table(spark, sf_dir, "benchmark")).write.text(p))
    return jsonl.strict(spark, path, "item_id long, text string").select("item_id", F.md5("text").alias("text_md5"))


@query("SELECT n_nationkey, n_name FROM nation")
def json_objects(spark, sf_dir):
    """A file for each object, which spans several lines."""
    rows = table(spark, sf_dir, "nation").repartition(25, "n_nationkey")
    pretty = rows.select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name"), {"pretty": "true"}).alias("value"))
    path = stored(spark, "objects", lambda p: pretty.write.partitionBy("n_nationkey").option("lineSep", "\n").text(p))
    return jsonl.objects(spark, f"{path}/*/*", "n_nationkey int, n_name string").select("n_nationkey", "n_name")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def jsonl_files(spark, sf_dir):
    """Lines of many folders, counted by the file's folder."""
    path = stored(spark, "files", lambda p: table(spark, sf_dir, "documents").select("doc_id", "lang").write.partitionBy("lang").json(p))
    return jsonl.with_file(spark, f"{path}/*/*.json", "doc_id long").groupBy(F.regexp_extract("file", "/lang=([^/]*)/", 1).alias("lang")).agg(F.count("doc_id").alias("n"))


@query(f"WITH {GRAM8} SELECT DISTINCT md5(x) AS gram, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source FROM be")
def ngram_index_lines(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    grams = b.select(F.explode(text.catalog_grams(F.col("text"))).alias("gram"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("source"))
    return jsonl.ngram_lines(spark, stored(spark, "index", lambda p: jsonl.write_ngram_lines(grams, p)))


@query("SELECT conv_id, count(*) AS n_turns FROM conversations WHERE conv_id % 4 <> 0 GROUP BY conv_id")
def chat_examples(spark, sf_dir):
    """Conversations as training lines; those without turns don't come back."""
    c = table(spark, sf_dir, "conversations")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    said = F.when(F.col("conv_id") % 4 == 0, F.array().cast("array<struct<from:string,value:string>>")).otherwise(F.transform("t", lambda x: F.struct(x.role.alias("from"), x.text.alias("value"))))
    lines = c.groupBy("conv_id").agg(turns.alias("t")).select(F.col("conv_id").cast("string").alias("id"), F.lit("chat").alias("type"), said.alias("conversations"))
    return jsonl.chats(spark, stored(spark, "chats", lambda p: json_lines(lines).write.text(p))).select(F.col("id").cast("long").alias("conv_id"), F.size("conversations").cast("long").alias("n_turns"))


@query("SELECT doc_id, md5(text) AS prompt_md5, quality FROM documents JOIN labels USING (doc_id) WHERE doc_id % 3 <> 0")
def reward_lines(spark, sf_dir):
    """Prompts with a ground truth; lines without one don't come back."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    truth = F.when(F.col("doc_id") % 3 != 0, F.struct(F.array(F.col("doc_id").cast("string")).alias("shortcuts_planted"), F.col("quality").cast("string").alias("type")))
    lines = d.select(F.col("text").alias("prompt"), truth.alias("ground_truth"))
    back = jsonl.reward_examples(spark, stored(spark, "rewards", lambda p: json_lines(lines).write.text(p)))
    return back.select(F.get("ground_truth.shortcuts_planted", F.lit(0)).cast("long").alias("doc_id"), F.md5("prompt").alias("prompt_md5"), F.col("ground_truth.type").cast("int").alias("quality"))


@query("SELECT conv_id, md5(string_agg(text, '|' ORDER BY turn)) AS pair_md5 FROM conversations WHERE turn < 3 GROUP BY conv_id HAVING count(*) = 3")
def preference_lines(spark, sf_dir):
    """First turns as prompt, chosen and rejected; lines that lack one don't come back."""
    c = table(spark, sf_dir, "conversations").where("turn < 3")
    at = lambda n: F.max(F.when(F.col("turn") == n, F.col("text")))
    lines = c.groupBy("conv_id").agg(at(0).alias("prompt"), at(1).alias("chosen"), at(2).alias("rejected"), F.max("conv_id").cast("string").alias("preference_reason")).drop("conv_id")
    back = jsonl.preferences(spark, stored(spark, "preferences", lambda p: json_lines(lines).write.text(p)))
    return back.select(F.col("preference_reason").cast("long").alias("conv_id"), F.md5(F.concat_ws("|", "prompt", "chosen", "rejected")).alias("pair_md5"))


@query("SELECT 'all' AS part, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents UNION ALL SELECT 'short', count(*), sum(doc_id)::BIGINT FROM documents WHERE n_chars < 1000")
def jsonl_subsets(spark, sf_dir):
    """A table as JSON lines, and a subset of it beside."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    path = stored(spark, "subsets", lambda p: jsonl.write_lines(d, f"{p}/all", F.col("n_chars") < 1000, f"{p}/short"))
    of = lambda part: jsonl.lenient(spark, f"{path}/{part}", "doc_id long").agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))
    return of("all").unionByName(of("short"))


@query(f"WITH {SPLIT} SELECT split, count(*) AS n, min(doc_id) AS first_id FROM s GROUP BY split")
def jsonl_splits(spark, sf_dir):
    """A folder of JSON lines for each split, read back."""
    path = stored(spark, "splits", lambda p: jsonl.write_splits(split_exact(spark, sf_dir), p))
    return spark.read.schema("doc_id long, split string").json(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query(f"""WITH x AS (SELECT page_id, {CLEAN.format(MARKUP.format('html'))} AS t FROM pages)
    SELECT page_id, 1 + (page_id % 2)::BIGINT AS n_containers, md5(CASE page_id % 2 WHEN 0 THEN trim('a b ' || t) ELSE trim('a b ' || t) || chr(10) || 'last' END) AS text_md5 FROM x""")
def html_containers(spark, sf_dir):
    """The text of named containers, with others nested inside: pages are put into one, after a decoy of another class."""
    body = text.without_markup(F.col("html"))
    page = F.concat(F.lit('<div class="other">no</div><div class="wide problem_content">a <div>b</div> '), body, F.lit(" </div><p>no</p>"), F.when(F.col("page_id") % 2 == 1, '<DIV id=1 class="problem_content">last').otherwise(""))
    found = corpus.container_texts(page, "problem_content")
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n_containers"), F.md5(F.array_join(found, "\n")).alias("text_md5"))
