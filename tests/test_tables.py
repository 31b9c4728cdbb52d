"""Operators over tables, sources, streams and the registered plans."""

import collections
import json
import os
import random

import duckdb
import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__
from evalsieve.functions import text
from evalsieve.operators import audit, contamination, dedup, external, irt, planting, taxonomy
from evalsieve.plans import registry
from evalsieve.sources import jsonl
from evalsieve.streaming import health

SF = "/root/testdata/sf0.001"


# sources


def test_lenient_and_strict_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n\n{bad\n{"a":2}\n')
    assert sorted(r.a for r in jsonl.lenient(spark, str(tmp_path), "a int").collect()) == [1, 2]
    assert jsonl.first_rows(spark, str(tmp_path), "a int", 1).count() == 1
    with pytest.raises((PySparkException, Py4JError)):
        jsonl.strict(spark, str(tmp_path), "a int").collect()


def test_objects_and_files(spark, tmp_path):
    for i in range(3):
        os.makedirs(tmp_path / f"d{i}")
        (tmp_path / f"d{i}" / "items.jsonl").write_text(json.dumps({"a": i}) + "\n")
        (tmp_path / f"o{i}.json").write_text(json.dumps({"a": i}, indent=1))
    assert {os.path.basename(os.path.dirname(r.file)) for r in jsonl.with_file(spark, f"{tmp_path}/*/items.jsonl", "a int").collect()} == {"d0", "d1", "d2"}
    assert sorted(r.a for r in jsonl.objects(spark, f"{tmp_path}/o*.json", "a int").collect()) == [0, 1, 2]


def test_sinks_and_splits(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("doc_id"), (F.col("id") > 15).alias("bad"))
    jsonl.write_lines(rows, f"{tmp_path}/all", F.col("bad"), f"{tmp_path}/bad")
    assert jsonl.lenient(spark, f"{tmp_path}/bad", "doc_id long").count() == 4
    split = dedup.exact_split(rows, "doc_id")
    jsonl.write_splits(split, f"{tmp_path}/splits")
    assert sorted(d for d in os.listdir(tmp_path / "splits") if d.startswith("split=")) == ["split=test", "split=train", "split=validation"]


def test_loaders_require_their_fields(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"prompt":"a","chosen":"b","rejected":"c"}\n{"prompt":"a","chosen":"b"}\n')
    assert jsonl.preferences(spark, str(tmp_path / "p.jsonl")).count() == 1
    (tmp_path / "c.jsonl").write_text('{"id":"1","conversations":[{"from":"human","value":"x"}]}\n{"id":"2","conversations":[]}\n')
    assert jsonl.chats(spark, str(tmp_path / "c.jsonl")).count() == 1
    (tmp_path / "r.jsonl").write_text('{"prompt":"a","ground_truth":{"shortcuts_planted":["x"],"type":"t"}}\n{"prompt":"a"}\n')
    assert jsonl.reward_examples(spark, str(tmp_path / "r.jsonl")).count() == 1


# deduplication and splits


@pytest.mark.parametrize("n, want", [(7, (6, 0, 1)), (100, (90, 5, 5)), (0, (0, 0, 0)), (1, (0, 0, 1))])
def test_split_sizes_are_exact(spark, n, want):
    got = collections.Counter(r.split for r in dedup.exact_split(spark.range(n), "id").collect())
    assert (got["train"], got["validation"], got["test"]) == want


@pytest.mark.parametrize("small", [0, 40, 100_000])
def test_greedy_keep_equals_a_loop(spark, small):
    r = random.Random(7)
    members = sorted({(i, r.randrange(40)) for i in range(120) for _ in range(r.randrange(3))})
    keys = collections.defaultdict(set)
    for i, k in members:
        keys[i].add(k)
    taken, want = set(), []
    for i in range(120):
        if not keys[i] & taken:
            want.append(i)
            taken |= keys[i]
    table = spark.createDataFrame(members, "id long, key long")
    got = dedup.greedy_keep(spark, spark.range(120), table, small)
    assert sorted(x.id for x in got.collect()) == want
    chain = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 11)], "id long, key long")  # A~B, B~C, A not C
    assert sorted(x.id for x in dedup.greedy_keep(spark, spark.range(1, 4), chain, small).collect()) == [1, 3]


def test_exact_dedup_is_idempotent(spark):
    rows = spark.createDataFrame([(3, "A  b"), (1, " a B "), (2, "c"), (4, None)], "id int, t string")
    once = dedup.first_by_fingerprint(rows, "id", "t")
    assert sorted(r.id for r in once.collect()) == [1, 2, 4]
    again = dedup.first_by_fingerprint(rows.join(once.select("id"), "id"), "id", "t")
    assert sorted(r.id for r in again.collect()) == [1, 2, 4]


# audits, plans


def test_self_bleu_equals_all_pairs(spark):
    texts = ["a b c", "a b d", "x", "", "b c a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    sets = [{tuple(w[i : i + 2]) for i in range(len(w) - 1)} for w in (t.split() for t in texts)]
    want = [0.0 if not s else sum(len(s & o) / len(s) for j, o in enumerate(sets) if j != i and o) / sum(1 for j, o in enumerate(sets) if j != i and o) for i, s in enumerate(sets)]
    got = {r.id: r.bleu for r in audit.self_bleu(rows, "id", "t").collect()}
    assert [got[i] for i in range(5)] == pytest.approx(want)


@pytest.mark.parametrize("share, flagged, want", [(0.31, 0, "MAJOR_REVISION_REQUIRED"), (0, 0.51, "MAJOR_REVISION_REQUIRED"), (0.11, 0, "PARTIAL_REVISION_RECOMMENDED"), (0, 0.21, "PARTIAL_REVISION_RECOMMENDED"), (0.1, 0.2, "ACCEPTABLE_WITH_MONITORING")])
def test_verdicts(spark, share, flagged, want):
    assert spark.range(1).select(audit.verdict(F.lit(share), F.lit(flagged)).alias("v")).first().v == want


def test_planting_is_repeatable_and_leaves_others_alone(spark):
    items = spark.createDataFrame([(i, f"question {i}", ["a", "b", "c", "d"], "C") for i in range(40)], "id int, question string, choices array<string>, answer string")
    kind = F.when(F.col("id") % 2 == 0, F.lit("position_bias"))
    a, b = (planting.planted(items, "id", kind).orderBy("id").collect() for _ in range(2))
    assert a == b
    assert all((r.choices, r.answer) == ((["c", "a", "b", "d"], "A") if r.id % 2 == 0 else (["a", "b", "c", "d"], "C")) for r in a)


def test_taxonomy_has_23_patterns_in_six_categories(spark):
    rows = taxonomy.patterns(spark).collect()
    assert len(rows) == 23 and len({r.category for r in rows}) == 6


def test_no_pairs_of_rows_are_formed(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    for df in (contamination.gram_ratio(items, docs, "item_id", "text", "text"), audit.self_bleu(items, "item_id", "text"), dedup.similar_sets(spark, docs, "doc_id", "text")[0]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
        joins = [x for x in plan.splitlines() if "BroadcastNestedLoopJoin" in x]
        assert len(joins) <= 1  # with a one-row total


def test_grids_and_peaks(spark):
    thetas = irt.grid(spark, -4.0, 4.0, 41)
    items = spark.createDataFrame([("x", 1.0, 0.0), ("y", 0.0, 1.0)], "item string, a double, b double")
    got = {r.item: r.peak_theta for r in irt.peaks(irt.item_information(items, thetas)).collect()}
    assert got == {"x": 0.0, "y": -4.0}  # of equals the lowest


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_plans_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    # ten models are too few for estimates within the box, which Newton steps alone find
    SF = "/root/testdata/sf0.01" if "seen AS MATERIALIZED" in registry.SQL[name] else "/root/testdata/sf0.001"
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda row: tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in row)
    assert sorted(map(repr, map(plain, got.select(*names).collect()))) == sorted(map(repr, map(plain, want.fetchall())))


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) == set(registry.SQL)


def test_external_calls_and_code_checks(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, p string")
    said = external.completions(rows, "id", "p", lambda prompts: [p.upper() for p in prompts]).collect()
    assert sorted((r.id, r.completion) for r in said) == [(1, "A"), (2, "")]
    assert external.completions(rows, "id", "p").count() == 0
    code = spark.createDataFrame([("x = 1\nprint(x)",), ("def f(:\n  pass",), ("short",), (None,)], "c string")
    assert [r.note for r in code.select(external.code_note(F.col("c")).alias("note")).collect()] == ["syntax OK", "syntax error", "answer too short for code", "answer too short for code"]
    notes = spark.createDataFrame([("1,000", "x"), ("pi", "it is pi or 3"), ("3", "so 3"), ("z", "none")], "a string, e string")
    assert [r.n for r in notes.select(external.math_note(F.col("a"), F.col("e")).alias("n")).collect()] == ["numeric", "manual", "numeric", "manual"]


def test_audit_report_as_json_and_text(spark):
    report = spark.createDataFrame([(10, 2, 0.2, 0.3, "PARTIAL_REVISION_RECOMMENDED")], "n_items long, n_contaminated long, contamination_score double, flagged_item_fraction double, recommendation string")
    row = report.select(audit.as_json(report).alias("j"), audit.as_text().alias("t")).first()
    assert json.loads(row.j)["n_items"] == 10 and "20.0%" in row.t and "PARTIAL" in row.t


def test_detection_moves_with_the_labels(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    some = lambda k: " ".join(r.sample(words, k))
    items = spark.createDataFrame([(i, some(8), [some(4) for _ in range(4)], "ABCD"[i % 4]) for i in range(80)], "doc_id long, question string, choices array<string>, answer string")
    mix = planting.labelled_mix(items, "doc_id", 40)
    rows = mix.collect()
    assert len(rows) == 60 and sum(x.is_contaminated for x in rows) == 40 and {x.planted_type for x in rows if not x.is_contaminated} == {None}
    whole = {x.doc_id: x for x in items.collect()}
    for x in rows:
        old = whole[int(x.doc_id.split("-")[1])]
        assert ((x.question, x.choices, x.answer) == (old.question, old.choices, old.answer)) == (not x.is_contaminated or x.planted_type == "position_bias" and old.answer == "A")
    found = {x.doc_id: x.kinds for x in audit.faults(mix, "doc_id").collect()}
    flagged = [x for x in rows if found[x.doc_id]]
    right = [x for x in rows if x.is_contaminated and x.planted_type in found[x.doc_id]]
    got = audit.detection(mix, "doc_id").first()
    assert got.recall == round(len(right) / 40, 4) > 0 and got.precision == round(sum(x.is_contaminated for x in flagged) / len(flagged), 4)
    flipped = audit.detection(mix.withColumn("is_contaminated", ~F.col("is_contaminated")), "doc_id").first()
    assert abs(flipped.precision - (1 - got.precision)) < 1e-3
    renamed = audit.detection(mix.withColumn("planted_type", F.when(F.col("is_contaminated"), "none")), "doc_id").first()
    assert renamed.recall == 0 and renamed.precision == got.precision
    none = audit.detection(mix.where("false"), "doc_id").first()
    assert (none.recall, none.precision) == (0, 0)


def test_recovery_and_audit_follow_their_inputs(spark):
    fitted = spark.createDataFrame([(1, 1.0, ["OK"]), (2, 4.0, ["FLOOR"]), (3, 0.0, ["LOW_DISCRIMINATION"])], "item long, b double, flags array<string>")
    truth = spark.createDataFrame([(1, 0.5), (2, 4.0), (3, 1.0)], "item long, t double")
    assert irt.recovery(fitted, truth, "t").first().mse == round((0.25 + 1) / 3, 4)
    assert irt.recovery(fitted, truth.withColumn("t", F.col("t") + 1), "t").first().mse == round((0.25 + 1 + 4) / 3, 4)
    report = spark.createDataFrame([(i, [("x", 0.5)] if i < 3 else []) for i in range(10)], "doc_id long, shortcuts array<struct<pattern:string,severity:double>>")
    bad = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id long")
    rel = spark.createDataFrame([(0.75,)], "reliability double")
    row = audit.audit(report, bad, fitted, rel).first()
    assert (row.n_contaminated, row.n_fitted, row.low_discrimination, row.ceiling, row.floor, row.reliability, row.recommendation) == (4, 3, 1, 0, 1, 0.75, "MAJOR_REVISION_REQUIRED")
    assert "n_fitted" not in audit.audit(report, bad).columns


def test_catalog_check_is_a_cascade(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    catalog = spark.createDataFrame([("a", long), ("b", long), ("c", "x " + long[4:])], "source string, q string")
    asked = spark.createDataFrame([(1, long.upper() + " "), (2, long + " and more words"), (3, "none of it"), (4, None), (5, "x " + long[4:])], "id long, t string")
    got = {r.id: (r.is_contaminated, r.source, r.match_type, r.confidence) for r in contamination.catalog_check(asked, catalog, "id", "t", "source", "q").collect()}
    assert got == {1: (True, "b", "exact", 1.0), 2: (True, "c", "fuzzy", 0.5), 3: (False, None, None, 0.0), 4: (False, None, None, 0.0), 5: (True, "c", "exact", 1.0)}


def test_judgments_come_before_the_heuristic(spark):
    items = spark.createDataFrame([(i, q) for i, q in enumerate(["according to x", "plain", "plain", "according to y", "plain", "plain"])], "id long, question string")
    said = spark.createDataFrame([(0, '{"contaminated": false}'), (1, '{"contaminated": true}'), (2, "it is TRUE"), (4, "[1]"), (5, "no"), (5, '{"contaminated": true}'), (3, None), (99, "true")], "id long, r string")
    got = {x.id: (x.contaminated, x.judged) for x in contamination.judged(items, said, "id", "r", contamination.audit_flag(F.col("question"))).collect()}
    assert got == {0: (False, True), 1: (True, True), 2: (True, True), 3: (True, False), 4: (False, True), 5: (True, True)}


def test_similar_sets_equal_all_pairs(spark):
    r = random.Random(9)
    base = [[f"t{r.randrange(80)}" for _ in range(r.randrange(1, 25))] for _ in range(40)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:-1] + [f"n{r.randrange(9)}"]) for b in base for _ in range(3)] + ["", None, " ".join(base[0] * 2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for common in (1 << 17, 5):
        pairs, members = dedup.similar_sets(spark, rows, "id", "t", 0.8, common)
        sets = {}
        for i, t in enumerate(texts):
            if (t or "").split():
                sets.setdefault(frozenset(t.split()), []).append(i)
        assert {(m.id, m.set_id) for m in members.collect()} == {(i, g[0]) for g in sets.values() for i in g}
        want = {(min(a[0], b[0]), max(a[0], b[0])) for x, a in sets.items() for y, b in sets.items() if a != b and len(x & y) / len(x | y) >= 0.8}
        assert {(p.a, p.b) for p in pairs.collect()} == want and len(want) > 20


def test_element_texts_follow_nesting(spark):
    html = "<div class='p x'>a<div class=\"p\">b</div>c</div><div class='px'>d</div><DIV\nCLASS = 'y p'>e<b>f</b></Div >g<div class='p'>h<div>i"
    row = spark.createDataFrame([(html,), (None,), ("no tags",)], "h string").select(text.element_texts(F.col("h"), "div", "p").alias("x")).collect()
    assert [r.x for r in row] == [["a<div class=\"p\">b</div>c", "e<b>f</b>", "h<div>i"], None, []]


def test_shared_folder_needs_a_setting_off_local_mode(spark):
    from evalsieve.sources import store

    class Session:
        class sparkContext:
            master, applicationId = "spark://host:7077", "x"

        class conf:
            get = staticmethod(lambda k, d: d)

    with pytest.raises(ValueError):
        store.shared_dir(Session)
    path = store.place(spark, "t")
    spark.range(3).write.parquet(path)
    store.delete(spark, path)
    with pytest.raises(PySparkException):
        spark.read.parquet(path)


# streams


def test_measurement_stream_equals_the_batch(spark, tmp_path):
    r = random.Random(1)
    rows = [("b", p, m, r.random(), r.random()) for p in range(4) for m in range(6)]
    for p in (0, 2, 1, 3):
        spark.createDataFrame([x for x in rows if x[1] == p], health.SCORES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = health.measurements(spark, f"{tmp_path}/in", per_trigger=1)
    health.track(stream, f"{tmp_path}/log", f"{tmp_path}/state", f"{tmp_path}/checkpoint").awaitTermination()
    from evalsieve.operators import correlation

    whole = correlation.records(spark.createDataFrame(rows, health.SCORES), ["benchmark", "period"], "bench_score", "downstream_score")
    want = correlation.reports(whole, "benchmark", "period").first()
    got = health.reports(health.current(spark, f"{tmp_path}/state")).first()
    assert got.n_records == 4 and got.slope == pytest.approx(want.slope) and got.trend == want.trend


def test_daily_and_first_seen_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for name, df in (("daily", health.daily(stream)), ("first", health.first_seen(stream, "user_id", "ts", "60 days"))):
        df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "daily" else "append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("daily").agg(F.sum("n")).first()[0] == events.count()
    assert spark.table("first").count() == events.select("user_id").distinct().count()


def test_text_helpers_are_total(spark):
    rows = spark.createDataFrame([(None,), ("",), (" \n",), ("x" * 100_000,)], "t string")
    assert rows.select(text.catalog_grams(F.col("t")), text.fingerprint(F.col("t")), text.normal_answer(F.col("t")), text.json_text(F.col("t")), text.prefix_and_rest(F.col("t"))[0]).count() == 4
