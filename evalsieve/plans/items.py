"""Plans over multiple-choice items: shortcuts, planting, rewards, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import audit, dedup, planting, rewards, shortcuts, taxonomy
from ..sources.store import written
from . import psychometrics
from .contamination import LOW, PLAIN, WORDS, any_sql, quoted
from .fixtures import MCQ_SQL, item_texts, items_of, mcq, table
from .registry import query

STOP = "[" + ", ".join(map(quoted, values.STOP_WORDS)) + "]"
NEGATION = "[" + ", ".join(map(quoted, values.NEGATION_WORDS)) + "]"
COUNT = f"len({WORDS})"
CONTENT = f"list_distinct(list_filter({PLAIN}, lambda x: length(x) > 2 AND NOT list_contains({STOP}, x)))"
STRIPPED = f"list_distinct(list_filter({LOW}, lambda x: NOT list_contains({NEGATION}, x)))"


def rules_sql(source: str) -> str:
    """CTEs that end in rep(doc_id, answer, five severities)."""
    return f"""
    r0 AS (SELECT doc_id, question, choices, answer, choices[ascii(answer) - 64] AS correct,
        list_filter(choices, lambda c, i: i <> ascii(answer) - 64) AS others FROM {source}),
    r1 AS (SELECT *, {COUNT.format('correct')} AS nc, list_transform(others, lambda c: {COUNT.format('c')}) AS no, list_transform(choices, lambda c: {COUNT.format('c')}) AS na,
        {CONTENT.format('correct')} AS cc, {CONTENT.format('question')} AS cq, {STRIPPED.format('correct')} AS sc, list_transform(others, lambda c: {STRIPPED.format('c')}) AS so,
        list_has_any({LOW.format('question')}, {NEGATION}) AS neg FROM r0),
    r2 AS (SELECT *, list_sum(no) / len(no)::DOUBLE AS mean FROM r1),
    rep AS (SELECT doc_id, answer,
        CASE WHEN mean > 0 AND nc / mean >= 2 THEN round(least(1e0, (nc / mean - 2) * 0.5e0 + 0.5e0), 2) END AS s1,
        CASE WHEN len(cc) >= 2 AND len(list_intersect(cc, cq)) / len(cc)::DOUBLE >= 0.75e0 THEN round(len(list_intersect(cc, cq)) / len(cc)::DOUBLE, 2) END AS s2,
        CASE WHEN neg AND len(list_filter(so, lambda s: CASE WHEN len(sc) + len(s) = 0 THEN 1e0 ELSE len(list_intersect(sc, s)) / (len(sc) + len(s) - len(list_intersect(sc, s)))::DOUBLE END > 0.8e0)) > 0 THEN 0.7e0 END AS s3,
        CASE WHEN len(list_filter(no, lambda n: n < 3)) > 0 THEN 0.5e0 END AS s4,
        CASE WHEN list_min(na) > 0 AND list_max(na) >= 5 * list_min(na) THEN 0.4e0 END AS s5 FROM r2),
    q1 AS (SELECT *, greatest(0e0, 1e0 - coalesce(s1, 0) * 0.3e0) AS a1 FROM rep),
    q2 AS (SELECT *, greatest(0e0, a1 - coalesce(s2, 0) * 0.3e0) AS a2 FROM q1),
    q3 AS (SELECT *, greatest(0e0, a2 - coalesce(s3, 0) * 0.3e0) AS a3 FROM q2),
    q4 AS (SELECT *, greatest(0e0, a3 - coalesce(s4, 0) * 0.3e0) AS a4 FROM q3),
    q5 AS (SELECT *, greatest(0e0, a4 - coalesce(s5, 0) * 0.3e0) AS score,
        concat_ws(',', CASE WHEN s1 IS NOT NULL THEN 'length_bias' END, CASE WHEN s2 IS NOT NULL THEN 'lexical_overlap' END, CASE WHEN s3 IS NOT NULL THEN 'negation_artifact' END,
            CASE WHEN s4 IS NOT NULL THEN 'distractor_implausibility' END, CASE WHEN s5 IS NOT NULL THEN 'answer_choice_asymmetry' END) AS patterns FROM q4),
    reports AS (SELECT doc_id, answer, patterns, score, CASE WHEN score < 0.4e0 THEN 'REPLACE' WHEN score < 0.7e0 THEN 'REVISE' ELSE 'KEEP' END AS recommendation FROM q5)"""


RULES = f"WITH {MCQ_SQL}, {rules_sql('mcq')}"


def flat(report):
    return report.select("doc_id", F.array_join("shortcuts.pattern", ",").alias("patterns"), "score", "recommendation")


@query(f"{RULES} SELECT doc_id, patterns, score, recommendation FROM reports")
def shortcut_items(spark, sf_dir):
    return flat(shortcuts.reports(mcq(spark, sf_dir), "doc_id"))


@query(f"{RULES} SELECT doc_id, round(s1, 2) AS length_bias, round(s2, 2) AS lexical_overlap, s3 AS negation_artifact, s4 AS implausible, s5 AS asymmetry FROM rep")
def shortcut_severities(spark, sf_dir):
    q, c, a = F.col("question"), F.col("choices"), F.col("answer")
    return mcq(spark, sf_dir).select("doc_id", shortcuts.length_bias(c, a).alias("length_bias"), shortcuts.lexical_overlap(q, c, a).alias("lexical_overlap"), shortcuts.negation_artifact(q, c, a).alias("negation_artifact"), shortcuts.implausible_distractor(c, a).alias("implausible"), shortcuts.asymmetry(c).alias("asymmetry"))


@query(f"{RULES} SELECT count(*) AS n_items, avg((patterns <> '')::INTEGER) AS flagged_fraction, avg((recommendation = 'REPLACE')::INTEGER) AS replace_fraction FROM reports")
def shortcut_set(spark, sf_dir):
    return shortcuts.set_analysis(shortcuts.reports(mcq(spark, sf_dir), "doc_id"))


@query(f"""{RULES}, p AS (SELECT unnest(string_split(patterns, ',')) AS pattern FROM reports WHERE patterns <> '')
    SELECT pattern, count(*) AS n, count(*) / (SELECT count(*) FROM reports)::DOUBLE AS fraction FROM p GROUP BY pattern""")
def shortcut_patterns(spark, sf_dir):
    return shortcuts.pattern_fractions(shortcuts.reports(mcq(spark, sf_dir), "doc_id"))


@query(f"""WITH {MCQ_SQL}, c AS (SELECT answer, count(*) AS n FROM mcq GROUP BY answer)
    SELECT sum(n)::BIGINT AS n_items, count(*) AS positions, max(n) AS most, greatest(0e0, least(1e0, (max(n) / (sum(n) / count(*)::DOUBLE) - 1) / 2)) AS bias FROM c""")
def position_bias(spark, sf_dir):
    return shortcuts.position_bias(mcq(spark, sf_dir))


@query(f"""WITH {MCQ_SQL}, v AS (SELECT doc_id, {COUNT.format('choices[ascii(answer) - 64]')} AS nc, list_transform(list_filter(choices, lambda c, i: i <> ascii(answer) - 64), lambda c: {COUNT.format('c')}) AS no FROM mcq)
    SELECT doc_id FROM v WHERE NOT (list_sum(no) > 0 AND nc / (list_sum(no) / len(no)::DOUBLE) > 2.5e0)""")
def valid_items(spark, sf_dir):
    return shortcuts.valid_items(mcq(spark, sf_dir)).select("doc_id")


@query(f"WITH {MCQ_SQL} SELECT doc_id, array_to_string(list_filter({LOW.format('question')}, lambda x: NOT list_contains({NEGATION}, x)), ' ') AS stripped, list_has_any({LOW.format('question')}, {NEGATION}) AS negated FROM mcq")
def negation_filter(spark, sf_dir):
    return mcq(spark, sf_dir).select("doc_id", F.array_join(text.without_negation(F.col("question")), " ").alias("stripped"), text.has_negation(F.col("question")).alias("negated"))


@query(f"""WITH {MCQ_SQL}, c AS (SELECT doc_id, {CONTENT.format('question')} AS q, {CONTENT.format("array_to_string(choices, ' ')")} AS c FROM mcq)
    SELECT doc_id, len(q)::BIGINT AS n_question, len(c)::BIGINT AS n_choices, CASE WHEN len(q) + len(c) = 0 THEN 1e0 ELSE len(list_intersect(q, c)) / (len(q) + len(c) - len(list_intersect(q, c)))::DOUBLE END AS jaccard FROM c""")
def lexical_overlap(spark, sf_dir):
    q, c = text.content_words(F.col("question")), text.content_words(F.array_join("choices", " "))
    return mcq(spark, sf_dir).select("doc_id", F.size(q).cast("long").alias("n_question"), F.size(c).cast("long").alias("n_choices"), text.jaccard(q, c).alias("jaccard"))


KINDS = list(values.PLANT_SEVERITY)
DRAW = "(('0x' || substr(md5('{}|' || doc_id), 1, 8))::UBIGINT % {})::INTEGER"
KIND = f"[{', '.join(map(quoted, KINDS))}][{DRAW.format('kind', 5)} + 1]"
PHRASES = "[" + ", ".join(map(quoted, values.PLANT_PHRASES)) + "]"

def planted_sql(source: str, kind: str, name: str = "planted", more: str = "") -> str:
    """CTEs that end in `name`: the source's items with the fault that an expression names (null: none)."""
    return f"""
    {name}_k AS (SELECT *, {kind} AS planted_type, choices[ascii(answer) - 64] AS correct FROM {source}),
    {name} AS (SELECT doc_id, planted_type,{more}
        CASE planted_type WHEN 'ngram_overlap' THEN {PHRASES}[{DRAW.format('phrase', 3)} + 1] || ' ' || question
            WHEN 'template_fill' THEN 'The answer to ''' || substr(question, 1, 50) || '...'' is: ___'
            WHEN 'answer_leak' THEN question || ' (Note: ' || array_to_string(({WORDS.format('correct')})[1:3], ' ') || ' is relevant.)' ELSE question END AS question,
        CASE planted_type WHEN 'length_bias' THEN list_transform(choices, lambda c, i: CASE WHEN i = ascii(answer) - 64 THEN c || {quoted(values.PLANT_SUFFIX)} ELSE c END)
            WHEN 'position_bias' THEN list_concat([correct], list_filter(choices, lambda c, i: i <> ascii(answer) - 64)) ELSE choices END AS choices,
        CASE planted_type WHEN 'position_bias' THEN 'A' ELSE answer END AS answer FROM {name}_k)"""


PLANTED_SQL = planted_sql("mcq", KIND)


def planted(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, KINDS)), planting.draw(F.col("doc_id"), "kind", 5))
    return planting.planted(mcq(spark, sf_dir), "doc_id", kind)


@query(f"WITH {MCQ_SQL}, {PLANTED_SQL} SELECT doc_id, planted_type, question, array_to_string(choices, '|') AS choices, answer, CASE planted_type WHEN 'ngram_overlap' THEN 0.8e0 WHEN 'template_fill' THEN 0.7e0 WHEN 'answer_leak' THEN 0.9e0 WHEN 'length_bias' THEN 0.6e0 ELSE 0.5e0 END AS severity FROM planted")
def plant_items(spark, sf_dir):
    return planted(spark, sf_dir).withColumn("choices", F.array_join("choices", "|"))


TEMPLATED = "(" + " OR ".join(f"regexp_matches(lower(question), {quoted(p)})" for p in values.TEMPLATE_PATTERNS) + ")"
AUDIT_FLAGS = f"{any_sql('lower(question)', values.AUDIT_PHRASES)} AND length(question) < 100"


def faults_sql(source: str) -> str:
    """CTEs that end in faults(doc_id, kinds) of the items in source."""
    return f"""{rules_sql(source)},
    fav AS (SELECT answer FROM (SELECT answer, count(*) AS n, sum(count(*)) OVER () AS every, count(*) OVER () AS places FROM {source} GROUP BY answer) WHERE n * places >= 1.5e0 * every),
    faults AS (SELECT doc_id, list_filter([CASE WHEN {AUDIT_FLAGS} THEN 'ngram_overlap' END, CASE WHEN {TEMPLATED} THEN 'template_fill' END, CASE WHEN contains(patterns, 'lexical_overlap') THEN 'answer_leak' END,
        CASE WHEN contains(patterns, 'length_bias') THEN 'length_bias' END, CASE WHEN answer IN (SELECT answer FROM fav) THEN 'position_bias' END], lambda x: x IS NOT NULL) AS kinds
        FROM (SELECT doc_id, patterns FROM reports) JOIN (SELECT doc_id, question, answer FROM {source}) USING (doc_id))"""


@query(f"""WITH {MCQ_SQL}, {PLANTED_SQL}, {faults_sql('planted')}
    SELECT planted_type, count(*) AS n, avg(list_contains(kinds, planted_type)::INTEGER) AS recall FROM faults JOIN planted USING (doc_id) GROUP BY planted_type""")
def planted_recall(spark, sf_dir):
    found = audit.faults(planted(spark, sf_dir), "doc_id", "planted_type")
    return found.groupBy("planted_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.array_contains("kinds", F.col("planted_type")).cast("double")).alias("recall"))


HASHED = "('0x' || substr(md5({}), 1, 8))::UBIGINT"
#: one pass of the network over left * base + right, and the walk until it ends within n
FEISTEL = "list_reduce(range(4), lambda s, r: (s % base) * base + ((s // base) + ('0x' || substr(md5('bundle|' || bundle || '|' || r || '|' || (s % base)), 1, 7))::BIGINT) % base, {})"
WALK = f"list_reduce(range(64), lambda x, i: CASE WHEN x < n THEN x ELSE {FEISTEL.format('x')} END, {FEISTEL.format('slot')})"
SLOT_KIND = "CASE WHEN {} % 10 < 3 THEN {}[({} % 5)::INTEGER + 1] END".format(HASHED.format("'bundle|plant|' || key"), f"[{', '.join(map(quoted, KINDS))}]", HASHED.format("'bundle|kind|' || key"))
BUNDLE_SIZE = HASHED.format("'bundle|size|' || bundle")


@query(f"""WITH {MCQ_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY md5('bundle|' || doc_id), doc_id) - 1 AS place FROM mcq),
    e AS (SELECT n, ceil(sqrt(n))::BIGINT AS base, unnest(range(greatest(1, n // 10))) AS bundle FROM (SELECT count(*) AS n FROM mcq)),
    s AS (SELECT *, unnest(range(least(5 + {BUNDLE_SIZE} % 11, n)::BIGINT)) AS slot FROM e),
    c AS (SELECT bundle, slot, bundle || '|' || slot AS key, {WALK} AS place FROM s),
    i AS (SELECT bundle, slot, key, o.* FROM c JOIN o USING (place)), {planted_sql("i", SLOT_KIND, "p", " bundle, slot,")}
    SELECT bundle, count(*) AS n_items, count(planted_type) AS n_planted, coalesce(array_to_string(list_sort(list(DISTINCT planted_type) FILTER (planted_type IS NOT NULL)), ','), '') AS shortcuts_planted,
        count(DISTINCT planted_type) AS n_shortcuts, string_agg(doc_id::VARCHAR, ',' ORDER BY slot) AS ids,
        md5(string_agg(concat_ws('|', question, array_to_string(choices, '|'), answer, planted_type), chr(10) ORDER BY slot)) AS items_md5 FROM p GROUP BY bundle""")
def planted_bundles(spark, sf_dir):
    """A bundle for every ten items: which items it holds, what they became, and the ground truth."""
    items = mcq(spark, sf_dir)
    found = planting.bundles(items, "doc_id", max(1, items.count() // 10))
    lines = F.transform("items", lambda x: F.concat_ws("|", x.question, F.array_join(x.choices, "|"), x.answer, x.planted_type))
    ids = F.array_join(F.transform("items", lambda x: x.id.cast("string")), ",")
    n_planted = F.size(F.filter("items", lambda x: x.planted_type.isNotNull())).cast("long")
    return found.select("bundle", F.size("items").cast("long").alias("n_items"), n_planted.alias("n_planted"), F.array_join("shortcuts_planted", ",").alias("shortcuts_planted"), F.col("n_shortcuts").cast("long").alias("n_shortcuts"), ids.alias("ids"), F.md5(F.array_join(lines, "\n")).alias("items_md5"))


MIX_SQL = f"""{MCQ_SQL}, {PLANTED_SQL}, mo AS (SELECT doc_id, row_number() OVER (ORDER BY md5('mix|' || doc_id), doc_id) AS nth FROM mcq),
    mix AS (SELECT 'planted-' || doc_id AS doc_id, planted_type, question, choices, answer, true AS is_contaminated FROM planted JOIN mo USING (doc_id) WHERE nth <= 200
        UNION ALL SELECT 'clean-' || doc_id, NULL, question, choices, answer, false FROM mcq JOIN mo USING (doc_id) WHERE nth <= 100)"""


def mixed(spark, sf_dir):
    """The mix's 200 items are drawn as texts, in one pass over the documents, and only then made."""
    drawn = written(spark, dedup.sampled(item_texts(spark, sf_dir), "doc_id", 200, "mix"), "drawn")
    return planting.labelled_mix(items_of(drawn), "doc_id", 200, "mix")


@query(f"""WITH {MIX_SQL} SELECT doc_id, is_contaminated, planted_type, CASE planted_type WHEN 'ngram_overlap' THEN 0.8e0 WHEN 'template_fill' THEN 0.7e0 WHEN 'answer_leak' THEN 0.9e0 WHEN 'length_bias' THEN 0.6e0 WHEN 'position_bias' THEN 0.5e0 ELSE 0e0 END AS severity,
    question, array_to_string(choices, '|') AS choices, answer FROM mix""")
def labelled_mix(spark, sf_dir):
    return mixed(spark, sf_dir).select("doc_id", "is_contaminated", "planted_type", "severity", "question", F.array_join("choices", "|").alias("choices"), "answer")


DETECTION_SQL = f"""{MIX_SQL}, {faults_sql('mix')},
    detection AS (SELECT round(avg(list_contains(kinds, planted_type)::INTEGER) FILTER (is_contaminated), 4) AS recall,
        round(count(*) FILTER (is_contaminated AND len(kinds) > 0) / nullif(count(*) FILTER (len(kinds) > 0), 0)::DOUBLE, 4) AS precision FROM faults JOIN mix USING (doc_id))"""


@query(f"WITH {DETECTION_SQL} SELECT recall, precision FROM detection")
def fault_detection(spark, sf_dir):
    return audit.detection(mixed(spark, sf_dir), "doc_id")


def answers(spark, sf_dir):
    """A model's answer for each planted item, with the patterns that its rules find, in one of three schemas or none."""
    p = planted(spark, sf_dir)
    r = shortcuts.reports(p, "doc_id").join(p.select("doc_id", "planted_type"), "doc_id")
    names = F.array_join(F.transform("shortcuts.pattern", lambda x: F.concat(F.lit('{"pattern":"'), x, F.lit('"}'))), ",")
    plain = F.array_join(F.transform("shortcuts.pattern", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ",")
    k = F.col("doc_id") % 5
    said = F.when(k == 0, F.concat(F.lit('{"shortcuts_found":['), names, F.lit("]}"))).when(k == 1, F.concat(F.lit('```json\n{"shortcuts":['), names, F.lit("]}\n```"))).when(k == 2, F.concat(F.lit('{"shortcuts_detected":['), plain, F.lit("]}"))).when(k == 3, F.lit("I see {none}")).otherwise(F.lit("nothing"))
    truth = F.when(F.col("planted_type") == "answer_leak", F.array(F.lit("lexical_overlap"))).when(F.col("planted_type") == "length_bias", F.array(F.lit("length_bias"), F.lit("answer_choice_asymmetry"))).otherwise(F.array().cast("array<string>"))
    return r.select("doc_id", said.alias("response"), truth.alias("truth"))


ANSWER_SQL = f"""WITH {MCQ_SQL}, {PLANTED_SQL}, {rules_sql('planted')},
    a AS (SELECT doc_id, doc_id % 5 AS k, list_filter(string_split(patterns, ','), lambda x: x <> '') AS found,
        CASE planted_type WHEN 'answer_leak' THEN ['lexical_overlap'] WHEN 'length_bias' THEN ['length_bias', 'answer_choice_asymmetry'] ELSE [] END AS truth FROM reports JOIN planted USING (doc_id)),
    f AS (SELECT doc_id, k, CASE WHEN len(truth) = 0 THEN 1e0 WHEN k > 2 OR len(found) = 0 THEN 0e0 ELSE 2e0 * len(list_intersect(truth, found)) / (len(truth) + len(found)) END AS f1,
        CASE k WHEN 3 THEN 0.3e0 WHEN 4 THEN 0e0 ELSE 1e0 END AS form FROM a)"""


@query(f"{ANSWER_SQL} SELECT doc_id, f1, form, round(0.5e0 * f1 + 0.3e0 * form + 0.2e0 * (0.8e0 * f1), 4) AS total FROM f")
def reward_f1(spark, sf_dir):
    a = answers(spark, sf_dir)
    f1, form = rewards.shortcut_f1(F.col("truth"), rewards.detected(F.col("response"))), text.format_reward(F.col("response"))
    return a.select("doc_id", f1.alias("f1"), form.alias("form")).withColumn("total", rewards.total(F.col("f1"), F.col("form")))


@query(f"{ANSWER_SQL}, t AS (SELECT doc_id, doc_id // 4 AS grp, round(0.5e0 * f1 + 0.3e0 * form + 0.2e0 * (0.8e0 * f1), 4) AS total FROM f) SELECT doc_id, grp, CASE WHEN min(total) OVER (PARTITION BY grp) = max(total) OVER (PARTITION BY grp) THEN -1e0 ELSE total END AS total FROM t")
def group_reward_guard(spark, sf_dir):
    t = reward_f1(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 4).alias("grp"), "total")
    return rewards.guarded(t, "grp", "total")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 1e0 WHEN 2 THEN 0.3e0 ELSE 0e0 END AS reward,
    CASE WHEN event_id % 4 IN (0, 1, 2) THEN regexp_extract(props, '[0-9]+')::BIGINT END AS k FROM events""")
def format_reward(spark, sf_dir):
    """JSON, fenced JSON, JSON within prose, none; and the value that each still gives."""
    p, m = F.col("props"), F.col("event_id") % 4
    said = F.when(m == 0, p).when(m == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(m == 2, F.concat(F.lit("so: "), p, F.lit(" it is"))).otherwise(F.lit("none"))
    return table(spark, sf_dir, "events").select("event_id", text.format_reward(said).alias("reward"), F.get_json_object(text.json_text(said), "$.k").cast("long").alias("k"))


@query(f"""{RULES}, t AS (SELECT * FROM (VALUES {", ".join(f"({quoted(a)}, {quoted(b)})" for a, b, _ in values.PATTERNS)}) v(pattern_id, category)),
    p AS (SELECT pattern, count(*) AS n FROM (SELECT unnest(string_split(patterns, ',')) AS pattern FROM reports WHERE patterns <> '') GROUP BY pattern)
    SELECT category, count(*) AS n_patterns, min(pattern_id) AS first_id, count(n) AS n_found, coalesce(sum(n), 0)::BIGINT AS n_findings FROM t LEFT JOIN p ON substr(pattern_id, 5) = pattern GROUP BY category""")
def taxonomy_summary(spark, sf_dir):
    """Categories: how many patterns they have, how many of these the items show, and how often."""
    found = shortcuts.reports(mcq(spark, sf_dir), "doc_id").select(F.explode("shortcuts.pattern").alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    known = taxonomy.patterns(spark).withColumn("pattern", F.substring("pattern_id", 5, 100))
    return known.join(found, "pattern", "left").groupBy("category").agg(F.count(F.lit(1)).alias("n_patterns"), F.min("pattern_id").alias("first_id"), F.count("n").alias("n_found"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_findings"))


@query(f"""{RULES}, t AS (SELECT * FROM (VALUES {", ".join(f"({quoted(a)}, {quoted(b)})" for a, b, _ in values.PATTERNS)}) v(pattern_id, category)),
    p AS (SELECT unnest(string_split(patterns, ',')) AS pattern FROM reports WHERE patterns <> '')
    SELECT pattern_id, category, count(*) AS n FROM p JOIN t ON substr(pattern_id, 5) = pattern GROUP BY ALL""")
def pattern_lookup(spark, sf_dir):
    found = shortcuts.reports(mcq(spark, sf_dir), "doc_id").select(F.explode("shortcuts.pattern").alias("pattern"))
    known = taxonomy.patterns(spark).withColumn("pattern", F.substring("pattern_id", 5, 100))
    return found.join(known, "pattern").groupBy("pattern_id", "category").agg(F.count(F.lit(1)).alias("n"))


ACCURACY_SQL = """SELECT avg(coalesce(contains(said, truth) OR contains(said, split_part(truth, '_', 1)), false)::INTEGER) AS accuracy, count(*) AS n FROM (
    SELECT truth, string_agg(text, chr(10) ORDER BY turn) AS said FROM (SELECT conv_id, lower(regexp_extract(text, '[A-Za-zÀ-ÿ]+')) || '_' || role AS truth FROM conversations WHERE turn = 0) c
    LEFT JOIN (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant') a USING (conv_id) GROUP BY conv_id, truth)"""


@query(ACCURACY_SQL)
def pattern_accuracy(spark, sf_dir):
    """Whether replies name what they were asked: a conversation's pattern is the first word of its first turn, with the role
    behind it, and its response all that the assistant says."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("turn = 0").select("conv_id", F.concat(F.lower(F.regexp_extract("text", "[A-Za-zÀ-ÿ]+", 0)), F.lit("_"), "role").alias("truth"))
    replies = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), "\n").alias("said"))
    return audit.named(asked.join(replies, "conv_id", "left"), "truth", "said")


AUDIT_SQL = f"""{RULES}, bad AS (SELECT doc_id FROM mcq WHERE question IN (SELECT question FROM mcq GROUP BY question HAVING count(*) > 1) OR ({AUDIT_FLAGS})),
    s AS (SELECT (SELECT count(*) FROM reports) AS n_items, (SELECT count(*) FROM bad) AS n_contaminated, (SELECT avg((patterns <> '')::INTEGER) FROM reports) AS flagged),
    report AS (SELECT n_items, n_contaminated, round(n_contaminated / greatest(1, n_items)::DOUBLE, 3) AS contamination_score, round(flagged, 3) AS flagged_item_fraction,
        CASE WHEN n_contaminated / greatest(1, n_items)::DOUBLE > 0.3e0 OR flagged > 0.5e0 THEN 'MAJOR_REVISION_REQUIRED' WHEN n_contaminated / greatest(1, n_items)::DOUBLE > 0.1e0 OR flagged > 0.2e0 THEN 'PARTIAL_REVISION_RECOMMENDED' ELSE 'ACCEPTABLE_WITH_MONITORING' END AS recommendation FROM s)"""


def reported(spark, sf_dir):
    """(doc_id, question, shortcuts): all that an audit asks of the items, from one pass over the documents."""
    return written(spark, shortcuts.reports(mcq(spark, sf_dir), "doc_id", "question").select("doc_id", "question", "shortcuts"), "reported")


def contaminated(items):
    """Items whose question another one has too, or that an audit flags."""
    from ..operators.contamination import audit_flag

    twice = items.groupBy("question").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("question", F.lit(True).alias("twice"))
    return items.join(twice, "question", "left").where(F.col("twice").isNotNull() | audit_flag(F.col("question"))).select("doc_id")


@query(f"""{AUDIT_SQL}, {psychometrics.RELIABILITY_SQL}
    SELECT report.*, (SELECT count(*) FROM fit) AS n_fitted, (SELECT count(*) FROM fit WHERE contains(flags, 'LOW')) AS low_discrimination, (SELECT count(*) FROM fit WHERE contains(flags, 'CEILING')) AS ceiling, (SELECT count(*) FROM fit WHERE contains(flags, 'FLOOR')) AS floor,
        round(reliability, 6) AS reliability FROM report, reliable""")
def audit_report(spark, sf_dir):
    r = reported(spark, sf_dir)
    return audit.audit(r, contaminated(r), psychometrics.fitted(spark, sf_dir), psychometrics.reliable(spark, sf_dir))


@query(f"""WITH {MCQ_SQL} SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE {AUDIT_FLAGS} END AS contaminated, doc_id % 5 < 4 AS judged FROM mcq""")
def judged_contamination(spark, sf_dir):
    """Judgments as JSON and as prose, positive and negative, for four items in five; the heuristic for the others."""
    from ..operators import contamination

    m, k = mcq(spark, sf_dir), F.col("doc_id") % 5
    said = F.when(k == 0, '{"contaminated": true, "evidence": "x"}').when(k == 1, '{"contaminated": false, "evidence": "not true"}').when(k == 2, "I think it is True.").when(k == 3, "no")
    return contamination.judged(m, m.select("doc_id", said.alias("response")), "doc_id", "response", contamination.audit_flag(F.col("question")))


@query(f"SELECT doc_id, question || chr(10) || array_to_string(list_transform(choices, lambda c, i: '  (' || chr((64 + i)::INTEGER) || ') ' || c), chr(10)) || chr(10) || 'Answer:' AS prompt, question || ' ' || array_to_string(choices, ' ') AS searchable FROM (WITH {MCQ_SQL} SELECT * FROM mcq)")
def question_prompts(spark, sf_dir):
    from ..operators.contamination import searchable
    from ..operators.corpus import question_prompt

    return mcq(spark, sf_dir).select("doc_id", question_prompt(F.col("question"), F.col("choices")).alias("prompt"), searchable(F.col("question"), F.col("choices")).alias("searchable"))


@query(f"""WITH b AS (SELECT item_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END) AS b FROM (SELECT item_id, {LOW.format('text')} AS w FROM benchmark)),
    p AS (SELECT a.item_id, CASE WHEN len(a.b) = 0 THEN 0e0 ELSE len(list_intersect(a.b, o.b)) / len(a.b)::DOUBLE END AS s FROM b a JOIN b o ON a.item_id <> o.item_id WHERE len(o.b) > 0)
    SELECT item_id, round(avg(s), 9) AS bleu FROM p GROUP BY item_id""")
def self_bleu(spark, sf_dir):
    return audit.self_bleu(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("bleu", F.round("bleu", 9))


@query(f"""WITH {DETECTION_SQL}, {psychometrics.RECOVERY_SQL},
    bl AS (SELECT item_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END) AS b FROM (SELECT item_id, {LOW.format('text')} AS w FROM benchmark)),
    bp AS (SELECT x.item_id, CASE WHEN len(x.b) = 0 THEN 0e0 ELSE len(list_intersect(x.b, o.b)) / len(x.b)::DOUBLE END AS s FROM bl x JOIN bl o ON x.item_id <> o.item_id WHERE len(o.b) > 0),
    variety AS (SELECT round(1 - avg(s), 4) AS diversity FROM (SELECT item_id, avg(s) AS s FROM bp GROUP BY item_id)),
    acc AS ({ACCURACY_SQL})
    SELECT recall, precision, mse, diversity, round(accuracy, 4) AS accuracy,
        round(0.3e0 * recall + 0.3e0 * precision + 0.1e0 * (1 - least(1e0, mse)) + 0.15e0 * diversity + 0.15e0 * round(accuracy, 4), 4) AS quality FROM detection, mse, variety, acc""")
def forge_quality(spark, sf_dir):
    """Every part from its own operator: planted faults, fitted difficulties, self-BLEU, answers on patterns."""
    bleu = audit.self_bleu(table(spark, sf_dir, "benchmark"), "item_id", "text")
    parts = [
        audit.detection(mixed(spark, sf_dir), "doc_id"),
        psychometrics.b_recovery_mse(spark, sf_dir).select("mse"),
        bleu.agg(F.round(1 - F.avg("bleu"), 4).alias("diversity")),
        pattern_accuracy(spark, sf_dir).select(F.round("accuracy", 4).alias("accuracy")),
    ]
    whole = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    return whole.withColumn("quality", audit.quality_score(*map(F.col, whole.columns)))


@query(f"""WITH {MCQ_SQL} SELECT doc_id, CASE WHEN try_cast(replace(trim(choices[1]), ',', '') AS DOUBLE) IS NOT NULL THEN 'numeric' ELSE 'manual' END AS note,
    CASE WHEN length(trim(code)) < 10 THEN 'answer too short for code' WHEN doc_id % 3 = 0 THEN 'syntax OK' ELSE 'syntax error' END AS code_note
    FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'value = ' || doc_id WHEN 1 THEN 'def f(: ' || doc_id ELSE 'x' END AS code FROM mcq)""")
def answer_checks(spark, sf_dir):
    from ..operators import external

    k = F.col("doc_id") % 3
    code = F.when(k == 0, F.concat(F.lit("value = "), F.col("doc_id").cast("string"))).when(k == 1, F.concat(F.lit("def f(: "), F.col("doc_id").cast("string"))).otherwise(F.lit("x"))
    return mcq(spark, sf_dir).select("doc_id", external.math_note(F.get("choices", F.lit(0)), F.col("question")).alias("note"), external.code_note(code).alias("code_note"))


@query(f"""{AUDIT_SQL} SELECT '{{"n_items":' || n_items || ',"n_contaminated":' || n_contaminated || ',"contamination_score":' || contamination_score || ',"recommendation":"' || recommendation || '"}}' AS report FROM report""")
def audit_json(spark, sf_dir):
    seen = reported(spark, sf_dir)
    r = audit.audit(seen, contaminated(seen)).drop("flagged_item_fraction")
    return r.select(audit.as_json(r).alias("report"))
