"""Line deduplication by a fixed-depth template tree (operator 9), in DataFrame operations only.

A line's tokens (between blanks, tabs, form feeds and carriage returns) that hold a digit count as a field, <*>. Lines
with the same number of tokens and the same first DEPTH tokens share a leaf. Within a node a position is constant where
one token has more than half of the node's documents; a line that agrees with the constants in SIMILAR of its
positions or more belongs to the node's template, whose other positions are fields. The lines left over become nodes
themselves: together, if the node had a template, else parted by their tokens at the position of fewest different ones.
This goes on as long as there are nodes of MIN_DOCS documents or more with several kinds of lines, which have fewer lines at
each level; a line without a template by then is a template of its own. Templates that occur in MIN_DOCS documents or more are dropped from all texts; lines of LONG
tokens or more that recur in fewer documents stay in the one with the smallest id alone.

Nodes and templates are counted once per distinct line after partial aggregation, so a line that a third of all
documents share is one row when tokens are spread out. A node's constants are one array, which lines of any number meet.

Defined results: null text counts as empty; blank lines are never dropped; a null doc_id counts as one document, after
all others; equal rows get equal results; lines may be of any length. An empty table gives an empty result. Line feeds
part lines, and what stays is joined by line feeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_bound, row_key, text_or_empty, with_ids, written

DEPTH, SIMILAR, MIN_DOCS, LONG = 3, 0.7, 10, 25
GAP = "[ \\t\\f\\r]+"
FIELD = "<*>"


def once(value: Column, body) -> Column:
    """body(value), with value computed once as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def masked(line: Column) -> Column:
    """The line's tokens, <*> for those with a digit. Most lines have neither digits nor other gaps than blanks."""
    parts = F.when(line.rlike("[\\t\\f\\r]"), F.split(line, GAP)).otherwise(F.split(line, " "))
    tokens = F.filter(parts, lambda t: t != "")
    return F.when(line.rlike("[0-9]"), F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), FIELD).otherwise(t))).otherwise(tokens)


def lines_of(docs: DataFrame, id_col: str, text_col: str, tokens: bool) -> DataFrame:
    """(key, doc, no, leaf, line, n) of every line, and its tokens' hashes if asked for; a blank line has n = 0."""
    more = lambda t: [F.transform(t, lambda x: F.xxhash64(x)).alias("tokens")] if tokens else []
    about = lambda t: F.struct(F.xxhash64(F.size(t), F.slice(t, 1, DEPTH)).alias("leaf"), F.xxhash64(t).alias("line"), F.size(t).alias("n"), *more(t))
    all_lines = F.transform(F.split(text_or_empty(text_col), "\n"), lambda x: once(masked(x), about))
    return docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc"), F.posexplode(all_lines).alias("no", "x")).select("key", "doc", "no", "x.*")


def of_size(lines: DataFrame) -> DataFrame:
    """Nodes with several kinds of lines in MIN_DOCS documents or more: all others can't have fields and be frequent."""
    return lines.groupBy("node").agg(F.sum("docs").alias("all"), F.count(F.lit(1)).alias("kinds")).where((F.col("all") >= MIN_DOCS) & (F.col("kinds") > 1)).select("node")


def described(lines: DataFrame) -> DataFrame:
    """(node, constants: a token or null for each position, at: the position of fewest different tokens, from 1)."""
    spread = lines.select("node", "docs", F.posexplode("tokens").alias("at", "token"))
    tally = spread.groupBy("node", "at", "token").agg(F.sum("docs").alias("d"))
    place = tally.groupBy("node", "at").agg(F.count(F.lit(1)).alias("kinds"), F.sum("d").alias("all"), F.max(F.struct("d", "token")).alias("top"))
    constant = F.when(F.col("top.d") * 2 > F.col("all"), F.col("top.token"))
    fewest = F.min(F.when(F.col("kinds") > 1, F.struct("kinds", "at")))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("at", constant.alias("token")))), lambda x: x.token)
    return place.groupBy("node").agg(in_order.alias("constants"), (fewest.at + 1).alias("at"))


def template_lines(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(leaf, line, node): the lines of lines (leaf, line, tokens, docs, node) that belong to a node's template."""
    found = None
    while True:
        about = written(spark, described(lines), "nodes")
        agree = F.size(F.filter(F.zip_with("tokens", "constants", lambda t, c: t == c), lambda same: same))
        judged = with_size(lines, about, "node").withColumn("fits", agree >= SIMILAR * F.size("tokens")).drop("constants")
        judged = written(spark, judged, "judged")
        fits = judged.where("fits").select("leaf", "line", "node")
        found = fits if found is None else found.unionByName(fits)
        rest = with_size(judged.where("not fits"), fits.groupBy("node").agg(F.lit(True).alias("one")), "node", "left")
        deeper = F.when(F.col("one"), F.xxhash64("node")).otherwise(F.xxhash64("node", "at", F.element_at("tokens", F.col("at"))))
        rest = rest.select("leaf", "line", "tokens", "docs", deeper.alias("node"))
        lines = written(spark, with_ids(rest, of_size(rest), "node", "left_semi"), "rest")
        if lines.isEmpty():
            return found


def with_size(left: DataFrame, right: DataFrame, key: str, how: str = "inner", most: int = 20_000) -> DataFrame:
    """left joined with a table of one row per key: broadcast up to `most` rows, else by a shuffle."""
    return left.join(F.broadcast(right) if row_bound(right, most) else right, key, how)


def marked(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, keep: array<boolean>): which lines of the texts under this row key stay."""
    slim = written(spark, lines_of(docs, id_col, text_col, tokens=False), "lines")
    filled = slim.where("n > 0")
    per_line = filled.groupBy("leaf", "line", "doc").agg(F.first("n").alias("n")).groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs"), F.first("n").alias("n"), F.min("doc").alias("first"))
    per_line = written(spark, per_line.where((F.col("docs") > 1) | (F.col("n") > DEPTH)), "line_docs")  # others can't recur

    mixed = written(spark, of_size(per_line.select(F.col("leaf").alias("node"), "docs")), "leaves").withColumnRenamed("node", "leaf")
    tokens = with_ids(lines_of(docs, id_col, text_col, tokens=True).where("n > 0").select("leaf", "line", "tokens"), mixed, "leaf", "left_semi").groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"))
    kinds = written(spark, tokens.join(per_line.select("leaf", "line", "docs"), ["leaf", "line"]).withColumn("node", F.col("leaf")), "kinds")
    fits = written(spark, template_lines(spark, kinds), "fits")

    # documents of a node's template: each counted once, whichever of its lines match
    wide = filled.join(fits, ["leaf", "line"]).groupBy("node", "doc").agg(F.lit(1).alias("x")).groupBy("node").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= MIN_DOCS).select("node")
    frequent = with_ids(fits, written(spark, wide, "wide"), "node", "left_semi").select("leaf", "line", F.lit(True).alias("frequent"))
    seen = per_line.join(frequent, ["leaf", "line"], "left").withColumn("frequent", F.col("frequent").isNotNull() | (F.col("docs") >= MIN_DOCS))
    lost = written(spark, seen.where(F.col("frequent") | ((F.col("docs") > 1) & (F.col("n") >= LONG))).select("leaf", "line", "frequent", "first"), "lost")
    gone = F.col("frequent").isNotNull() & (F.col("frequent") | ~F.col("doc").eqNullSafe(F.col("first")))
    told = slim.join(lost, ["leaf", "line"], "left").select("key", "no", ((F.col("n") == 0) | ~gone).alias("keep"))
    flags = F.transform(F.sort_array(F.collect_set(F.struct("no", "keep"))), lambda x: x.keep)
    return told.groupBy("key").agg(flags.alias("keep"))


def cleaned(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col rid of recurring templates, and the counts _evs_lines and _evs_dropped."""
    keep = written(spark, marked(spark, docs, id_col, text_col), "keep").toDF("_evs_key", "_evs_keep")
    joined = docs.withColumn("_evs_key", row_key(id_col, text_col)).join(keep, "_evs_key")
    left = F.array_join(F.filter(F.split(text_or_empty(text_col), "\n"), lambda x, i: F.get("_evs_keep", i)), "\n")
    named = [left.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*named, F.size("_evs_keep").cast("long").alias("_evs_lines"), F.size(F.filter("_evs_keep", lambda k: ~k)).cast("long").alias("_evs_dropped"))
