"""Contamination of items by a catalog, an index or stock phrases.

Item tables are small next to corpora, but nothing here relies on it: hints are left to the optimiser, which
broadcasts the smaller side by its size and shuffles otherwise. Corpora are cut down by a semi-join on grams before
anything is made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, values


def searchable(question: Column, choices: Column) -> Column:
    """Question and choices in one text, without empty ones."""
    return F.concat_ws(" ", question, F.filter(choices, lambda c: c != ""))


def by_fingerprint(items: DataFrame, corpus: DataFrame, id_col: str, text_col: str, corpus_id: str, corpus_text: str) -> DataFrame:
    """(id, matched, source): items whose fingerprint the corpus has; source is the last such row."""
    own = items.select(id_col, text.fingerprint(F.col(text_col)).alias("fp"))
    told = corpus.select(F.col(corpus_id).alias("source"), text.fingerprint(F.col(corpus_text)).alias("fp"))
    # the corpus is reduced to the items' fingerprints before anything is aggregated
    known = told.join(own.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.max("source").alias("source"))
    return own.join(known, "fp", "left").select(id_col, F.col("source").isNotNull().alias("matched"), "source")


def gram_ratio(items: DataFrame, corpus: DataFrame, id_col: str, text_col: str, corpus_text: str, n: int = 8, threshold: float = 0.3) -> DataFrame:
    """(id, n_grams, hits, ratio, is_contaminated): share of an item's n-grams, repeats counted, that the corpus has."""
    own = items.select(id_col, text.gram_count(F.col(text_col), n).alias("n_grams"))
    spread = items.select(id_col, F.explode(text.gram_keys(F.col(text_col), n)).alias("gram"))
    told = corpus.select(F.explode(text.gram_keys(F.col(corpus_text), n)).alias("gram"))
    # the corpus is reduced to the items' grams before anything is made distinct
    known = told.join(spread.select("gram").distinct(), "gram", "left_semi").distinct()
    hits = spread.join(known, "gram", "left_semi").groupBy(id_col).agg(F.count(F.lit(1)).alias("hits"))
    total = F.col("n_grams")
    ratio = F.when(total > 0, F.coalesce("hits", F.lit(0)) / total).otherwise(0.0)
    return own.join(hits, id_col, "left").select(id_col, "n_grams", F.coalesce("hits", F.lit(0)).alias("hits"), F.round(ratio, 3).alias("ratio"), (ratio >= threshold).alias("is_contaminated"))


def best_source(candidates: DataFrame, catalog: DataFrame, id_col: str, text_col: str, source_col: str, catalog_text: str, n: int = 8, threshold: float = 0.3) -> DataFrame:
    """(id, source, hits, ratio, is_contaminated): the source with most hits; of equals the first by name."""
    own = candidates.select(id_col, text.gram_count(F.col(text_col), n).alias("_all"))
    grams = catalog.select(source_col, F.explode(text.gram_keys(F.col(catalog_text), n)).alias("gram")).groupBy("gram").agg(F.max(source_col).alias(source_col))
    hits = candidates.select(id_col, F.explode(text.gram_keys(F.col(text_col), n)).alias("gram")).join(grams, "gram").groupBy(id_col, source_col).agg(F.count(F.lit(1)).alias("hits"))
    # most hits, then the first name: of equals max_by keeps none in particular, so the order is part of the key
    best = hits.groupBy(id_col).agg(F.max("hits").alias("hits"), F.collect_list(F.struct((-F.col("hits")).alias("o"), F.col(source_col).alias("s"))).alias("x")).select(id_col, "hits", F.array_min("x").s.alias(source_col))
    ratio = F.col("hits") / F.col("_all")
    return own.join(best, id_col).select(id_col, source_col, "hits", F.round(ratio, 3).alias("ratio"), (ratio >= threshold).alias("is_contaminated"))


def catalog_check(candidates: DataFrame, catalog: DataFrame, id_col: str, text_col: str, source_col: str, catalog_text: str, n: int = 8, threshold: float = 0.3) -> DataFrame:
    """(id, is_contaminated, source, match_type, confidence), a row for every candidate.

    A candidate with the fingerprint of a catalog text is an exact match, of the last source by name that has it; of the
    others those are fuzzy matches whose share of n-grams in their best source reaches the threshold.
    """
    own = candidates.select(id_col, text_col, text.fingerprint(F.col(text_col)).alias("_fp"))
    told = catalog.groupBy(text.fingerprint(F.col(catalog_text)).alias("_fp")).agg(F.max(source_col).alias("_exact"))
    tried = own.join(told, "_fp", "left").drop("_fp")
    fuzzy = best_source(tried.where(F.col("_exact").isNull()), catalog, id_col, text_col, source_col, catalog_text, n, threshold).where("is_contaminated").select(id_col, F.col(source_col).alias("_fuzzy"), "ratio")
    kind = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_fuzzy").isNotNull(), "fuzzy")
    return tried.select(id_col, "_exact").join(fuzzy, id_col, "left").select(
        id_col, kind.isNotNull().alias("is_contaminated"), F.coalesce("_exact", "_fuzzy").alias(source_col), kind.alias("match_type"),
        F.when(kind == "exact", 1.0).when(kind == "fuzzy", F.col("ratio")).otherwise(0.0).alias("confidence"))


def index_score(items: DataFrame, corpus: DataFrame, id_col: str, text_col: str, corpus_text: str, n: int = 6) -> DataFrame:
    """(id, n_grams, matches, score): three times the share of distinct n-grams that the index has, 1 at most."""
    own = items.select(id_col, text.index_grams(F.col(text_col), n).alias("grams"))
    spread = own.select(id_col, F.explode("grams").alias("gram"))
    told = corpus.select(F.explode(text.index_grams(F.col(corpus_text), n)).alias("gram"))
    known = told.join(spread.select("gram").distinct(), "gram", "left_semi").distinct()
    hits = spread.join(known, "gram", "left_semi").groupBy(id_col).agg(F.count(F.lit(1)).alias("matches"))
    total, found = F.size("grams").cast("long"), F.coalesce("matches", F.lit(0))
    return own.join(hits, id_col, "left").select(id_col, total.alias("n_grams"), found.alias("matches"), F.round(F.when(total > 0, F.least(F.lit(1.0), 3.0 * found / total)).otherwise(0.0), 3).alias("score"))


def index_examples(items: DataFrame, corpus: DataFrame, id_col: str, text_col: str, corpus_id: str, corpus_text: str, n: int = 6, sources: int = 3, examples: int = 3) -> DataFrame:
    """(id, gram, sources): the first few matching n-grams of an item, each with its first few corpus rows."""
    spread = items.select(id_col, F.explode(F.array_distinct(text.grams(text.words(F.lower(F.col(text_col))), n))).alias("gram"))
    told = corpus.select(F.col(corpus_id).alias("source"), F.explode(F.array_distinct(text.grams(text.words(F.lower(F.col(corpus_text))), n))).alias("gram"))
    met = told.join(spread.select("gram").distinct(), "gram", "left_semi")
    nth = F.row_number().over(Window.partitionBy("gram").orderBy("source"))
    few = met.withColumn("nth", nth).where(F.col("nth") <= sources).groupBy("gram").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    order = F.row_number().over(Window.partitionBy(id_col).orderBy("gram"))
    return spread.join(few, "gram").withColumn("nth", order).where(F.col("nth") <= examples).select(id_col, "gram", "sources")


def phrase_score(column: Column) -> Column:
    """0.3 for each stock phrase, 1 at most; texts under six words score 0 whatever they hold."""
    return F.when(text.word_count(column) < 6, 0.0).otherwise(F.least(F.lit(1.0), text.phrase_hits(column, values.INDEX_FREE_PHRASES) * 0.3))


def template_score(column: Column) -> Column:
    return F.least(F.lit(1.0), text.pattern_hits(column, values.TEMPLATE_PATTERNS) * 0.25)


def audit_flag(question: Column) -> Column:
    """A short question with a stock phrase."""
    return text.any_of(F.lower(question), values.AUDIT_PHRASES) & (F.length(question) < 100)


def judged(items: DataFrame, judgments: DataFrame, id_col: str, response_col: str, heuristic: Column) -> DataFrame:
    """(id, contaminated, judged): a model's verdict where there is one, else the heuristic on the item's own columns.

    A verdict is JSON with `contaminated`, or prose that holds "true"; of several for one item a positive one counts.
    """
    said = F.col(response_col)
    parsed = F.try_parse_json(said)
    yes = F.when(parsed.isNotNull(), F.coalesce(F.try_variant_get(parsed, "$.contaminated", "boolean"), F.lit(False))).otherwise(F.contains(F.lower(said), F.lit("true")))
    told = judgments.where(said.isNotNull()).groupBy(id_col).agg(F.max(yes).alias("_said"))
    both = items.withColumn("_own", F.coalesce(heuristic, F.lit(False))).join(told, id_col, "left")
    return both.select(id_col, F.coalesce("_said", "_own").alias("contaminated"), F.col("_said").isNotNull().alias("judged"))


def composite(scores: dict[str, Column]) -> Column:
    """Weighted mean of the methods that are there (not null)."""
    weights = {k: F.when(s.isNotNull(), values.CONTAMINATION_WEIGHTS[k]).otherwise(0.0) for k, s in scores.items()}
    top = sum((weights[k] * F.coalesce(s, F.lit(0.0)) for k, s in scores.items()), F.lit(0.0))
    below = sum(weights.values(), F.lit(0.0))
    return F.when(below > 0, top / below).otherwise(0.0)


def methods_flagged(scores: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(s > 0.5, k) for k, s in scores.items()]))


def confidence(scores: dict[str, Column]) -> Column:
    """HIGH if two methods flag, MEDIUM if one is sure (over 0.7), else LOW."""
    flagged = F.size(methods_flagged(scores))
    return F.when(flagged >= 2, "HIGH").when(F.greatest(*[F.coalesce(s, F.lit(0.0)) for s in scores.values()], F.lit(0.0)) > 0.7, "MEDIUM").otherwise("LOW")


def memorised(expected: Column, completion: Column) -> Column:
    """Share of the expected words that a completion has."""
    return F.round(text.share_in(text.words(F.lower(expected)), text.words(F.lower(completion))), 3)
