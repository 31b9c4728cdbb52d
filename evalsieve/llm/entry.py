"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, exact_dedup, licenses, maxscore, media, minhash, packing, pieces, sharding, spelling, templates, toxicity, whitening


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(spark, table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(spark, table(spark, sf_dir, "documents")).drop("_evs_key")


def op4_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = toxicity.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return said.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("neighbours.doc_id").alias("neighbour_ids"))


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), with_ids=False)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = exact_dedup.decisions(spark, table(spark, sf_dir, "documents"))
    return said.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = templates.cleaned(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", F.col("_evs_lines").alias("n_lines"), F.col("_evs_dropped").alias("n_dropped"), F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("text_md5"))


def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(spark, table(spark, sf_dir, "documents"))


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spark, table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, table(spark, sf_dir, "embeddings"))


def op13_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = media.read(media.stored(table(spark, sf_dir, "documents")))
    size = F.concat_ws("x", "width", "height"), F.concat_ws("x", "thumbnail_width", "thumbnail_height")
    feature = F.concat_ws(" ", size[0], F.concat(F.lit("thumbnail="), size[1]), F.concat(F.lit("crc32="), F.lower(F.hex("thumbnail_crc32"))), F.concat(F.lit("average="), "average_hash"), F.concat(F.lit("difference="), "difference_hash"))
    return said.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def line_templates_sql(splits: int = 6) -> str:
    """The template tree, a group of common table expressions for each level: more levels than the given tables have."""
    of_size = "QUALIFY sum(docs) OVER (PARTITION BY node) >= 10 AND count(*) OVER (PARTITION BY node) > 1"
    levels = f"n0 AS (SELECT * FROM (SELECT list_prepend(n::VARCHAR, head) AS node, toks, docs FROM u) {of_size})"
    for r in range(splits + 1):
        levels += f""",
        p{r} AS (SELECT node, pos, tok, sum(docs) AS d FROM (SELECT node, docs, unnest(range(len(toks))) AS pos, unnest(toks) AS tok FROM n{r}) GROUP BY ALL),
        q{r} AS (SELECT node, pos, count(*) AS kinds, CASE WHEN max(d) * 2 > sum(d) THEN arg_max(tok, d) END AS tok FROM p{r} GROUP BY ALL),
        s{r} AS (SELECT node, list(tok ORDER BY pos) AS cons, (min(kinds * 1000000 + pos) FILTER (kinds > 1)) % 1000000 AS cut FROM q{r} GROUP BY node),
        j{r} AS MATERIALIZED (SELECT n{r}.*, cut, len(list_filter(range(1, len(toks) + 1), lambda i: toks[i] = cons[i])) >= 0.7e0 * len(toks) AS fits FROM n{r} JOIN s{r} USING (node)),
        n{r + 1} AS (
            SELECT node, toks, docs FROM (SELECT CASE WHEN bool_or(fits) OVER (PARTITION BY node) THEN list_append(node, 'rest') ELSE list_append(node, cut || ':' || toks[cut + 1]) END AS node, toks, docs, fits FROM j{r})
            WHERE NOT fits {of_size})"""
    return f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, row_number() OVER () AS r FROM documents),
        l AS (SELECT r, doc_id, unnest(range(len(ls))) AS no, unnest(ls) AS line FROM d),
        t AS (
            SELECT r, doc_id, no, line, list_transform(list_filter(regexp_split_to_array(line, '[ \t\f\r]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS toks FROM l),
        k AS MATERIALIZED (SELECT *, len(toks) AS n, toks[1:3] AS head FROM t),
        u AS MATERIALIZED (SELECT n, head, toks, count(DISTINCT coalesce(doc_id, -1)) AS docs, min(doc_id) AS first FROM k WHERE n > 0 GROUP BY ALL),
        {levels},
        fits AS ({" UNION ALL ".join(f"SELECT node, toks FROM j{r} WHERE fits" for r in range(splits + 1))}),
        wide AS (SELECT node FROM k JOIN fits USING (toks) GROUP BY node HAVING count(DISTINCT coalesce(doc_id, -1)) >= 10),
        frequent AS (SELECT toks FROM u WHERE docs >= 10 UNION SELECT toks FROM fits JOIN wide USING (node)),
        m AS (SELECT k.*, k.n > 0 AND (k.toks IN (SELECT toks FROM frequent) OR (k.n >= 25 AND u.docs > 1 AND k.doc_id IS DISTINCT FROM u.first)) AS gone FROM k LEFT JOIN u USING (toks))
        SELECT doc_id, n_lines, n_dropped, length(kept) AS n_chars_kept, md5(kept) AS text_md5 FROM (
            SELECT r, any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS kept
            FROM m GROUP BY r)"""


SQL = {
    "op1_sharding": """
        WITH x AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0) AS b FROM documents),
        d AS (SELECT unnest(range(0, 31))::INTEGER AS depth),
        s AS (SELECT depth, h >> (60 - depth) AS p, sum(b) AS bytes, count(*) AS n FROM x, d GROUP BY ALL),
        l AS (SELECT doc_id, h, min(s.depth) AS depth FROM x, s WHERE s.p = h >> (60 - s.depth) AND (s.bytes <= 1048576 OR s.n = 1) GROUP BY ALL)
        SELECT doc_id, CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(s.p), l.depth, '0') END AS shard, l.depth::BIGINT AS depth, s.bytes::BIGINT AS shard_bytes
        FROM l JOIN s ON s.depth = l.depth AND s.p = l.h >> (60 - l.depth)""",
    "op9_line_templates": line_templates_sql(),
    "op5_maxscore": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256.0e0 * x::DOUBLE)) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (
            SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
        SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM p
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op11_spelling_groups": """
        WITH RECURSIVE d AS (
            SELECT coalesce(doc_id::VARCHAR, 'null') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
        o AS MATERIALIZED (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k FROM d WHERE length(run) >= 7 GROUP BY ALL),
        t AS MATERIALIZED (
            SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i)) AS crc),
        b AS (SELECT id, w, k, flatten(list_transform(string_split(id || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS bs FROM o),
        h AS MATERIALIZED (SELECT w, k, xor(list_reduce(bs, lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM b, t),
        c AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h),
        v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM c WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
        i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
        m AS MATERIALIZED (SELECT word, n, i || ':' || substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS masked FROM i),
        s AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS shorter FROM i),
        u AS MATERIALIZED (SELECT s.word, s.n, v.word AS other, v.n AS other_n FROM s JOIN v ON v.word = s.shorter),
        p AS (
            SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM m a JOIN m b USING (masked) WHERE a.word <> b.word
            UNION ALL SELECT word, n, other, other_n FROM u UNION ALL SELECT other, other_n, word, n FROM u),
        q AS MATERIALIZED (
            SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) FILTER (other_n >= 10 * n) AS form, max(other_n) FILTER (other_n >= 10 * n) AS form_n
            FROM p GROUP BY word),
        r AS (SELECT word, form AS root FROM q WHERE form IS NOT NULL UNION ALL SELECT r.word, q.form FROM r JOIN q ON q.word = r.root WHERE q.form IS NOT NULL),
        e AS (SELECT r.word, r.root FROM r LEFT JOIN q ON q.word = r.root WHERE q.form IS NULL)
        SELECT v.word, form, coalesce(root, v.word) AS root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
        FROM v LEFT JOIN q ON q.word = v.word LEFT JOIN e ON e.word = v.word""",
    "op8_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
}


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict:
    return dict(SQL)
