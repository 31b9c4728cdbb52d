"""What grows or answers in pieces: indexes, logs, states, paged sources and generation."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evalsieve.operators import correlation, generation
from evalsieve.sources import index, log
from evalsieve.sources.paged import paged, pages
from evalsieve.streaming import health


def pairs(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_index_in_ranges_equals_a_parser(spark, tmp_path, monkeypatch, small_splits):
    monkeypatch.setattr(index, "CHUNK", 16)
    r = random.Random(5)
    word = lambda: "".join(r.choice('ab"\\é{}[]:, \n /') for _ in range(r.randrange(7)))
    for k, options in enumerate([{}, {"indent": 1}, {"ensure_ascii": False}, {"separators": (",", ":")}]):
        made = {f"g{i}{word()}": [word() + str(r.randrange(4)) for _ in range(r.randrange(4))] for i in range(12)}
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(made, **options))
        assert pairs(index.ngram_index(spark, str(path))) == sorted((g, s) for g, ss in made.items() for s in ss)


@pytest.mark.parametrize("text", ["{not json", "", "{", "[]", '{"a": ["b"]', '{"a": "b"}', '{"a": 1}', '{"a": ["b", 2]}', '{"a": [["b"]]}', '{"a": ["b",]}', '{"a" ["b"]}', '{"a": ["b"]} x', '{"a": ["b"]}{"c": ["d"]}', '{"a": ["\\x"]}', '{"a": ["b"], }', '{"a": ["b"} ', '"a"', '{"a": ["b" "c"]}'])
def test_a_corrupt_index_is_empty(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    assert index.ngram_index(spark, str(tmp_path / "x.json")).count() == 0


def test_index_edge_objects(spark, tmp_path):
    for text, want in (("{}", []), (' { } ', []), ('{"a": []}', []), ('{"a": ["x"], "a": ["y"]}', [("a", "y")]), ('{"": ["", "\\""], "b": [], "c":["\\\\"]}', [("", ""), ("", '"'), ("c", "\\")])):
        (tmp_path / "x.json").write_text(text)
        assert pairs(index.ngram_index(spark, str(tmp_path / "x.json"))) == want
    assert index.ngram_index(spark, str(tmp_path / "none.json")).count() == 0
    grams = spark.createDataFrame([("g", "x"), ("g", "y"), ('q"\\', "z")], "gram string, source string")
    for rows in (grams, grams.limit(0)):
        index.write_ngram_index(rows, f"{tmp_path}/written")
        assert pairs(index.ngram_index(spark, f"{tmp_path}/written")) == pairs(rows)


# logs


def test_a_log_takes_a_batch_once(spark, tmp_path):
    path, rows = f"file://{tmp_path}/log", spark.createDataFrame([(i, f"v{i}") for i in range(6)], "k long, v string")
    assert log.committed(spark, path, "k long, v string").count() == 0
    assert log.commit(rows.where("k < 3"), path, "a") and log.commit(rows.where("k = 3"), path, "b")
    before = pairs(log.committed(spark, path, "k long, v string"))
    assert not log.commit(rows, path, "a") and pairs(log.committed(spark, path, "k long, v string")) == before
    rows.write.parquet(f"{path}/data/dead")  # a writer that died before its commit
    assert pairs(log.committed(spark, path, "k long, v string")) == before
    assert sorted(r.k for r in log.not_yet(rows, path, "k").collect()) == [4, 5]
    log.clean(spark, path)
    assert len(log.Files(spark, path).names("data")) == 2 and pairs(log.committed(spark, path, "k long, v string")) == before


def test_of_two_writers_each_gets_a_number(spark, tmp_path, monkeypatch):
    path, rows = f"file://{tmp_path}/log", spark.createDataFrame([(1,), (2,)], "k long")
    put, met = log.Files.put_new, []

    def late(self, name, text):  # another writer commits between our look and our commit
        if not met:
            met.append(name)
            assert log.commit(rows.where("k = 1"), path, "other")
        return put(self, name, text)

    monkeypatch.setattr(log.Files, "put_new", late)
    assert log.commit(rows.where("k = 2"), path, "mine")
    assert pairs(log.committed(spark, path, "k long")) == [(1,), (2,)] and [b["batch"] for b in log.manifest(log.Files(spark, path))[1]] == ["other", "mine"]


def test_latest_rows_and_compaction(spark, tmp_path):
    path, schema = f"file://{tmp_path}/log", "k long, v string"
    for name, rows in (("a", [(1, "old"), (2, "two")]), ("b", [(1, "new")]), ("c", [(3, "three")])):
        log.commit(spark.createDataFrame(rows, schema), path, name)
    want = [(1, "new"), (2, "two"), (3, "three")]
    assert pairs(log.latest(spark, path, schema, ["k"])) == want
    log.compact(spark, path, schema, ["k"])
    assert pairs(log.committed(spark, path, schema)) == want == pairs(log.latest(spark, path, schema, ["k"]))
    assert not log.commit(spark.createDataFrame([(9, "x")], schema), path, "b")
    log.clean(spark, path)
    assert pairs(log.committed(spark, path, schema)) == want


# states


def scores(spark):
    r = random.Random(1)
    rows = [(b, p, m, r.random(), r.random() if b != "flat" else 1.0) for b in ("one", "two", "flat", "short") for p in range(2 if b == "short" else 6) for m in range(5)]
    return spark.createDataFrame(rows, health.SCORES)


@pytest.mark.parametrize("order", [[[0, 1, 2, 3, 4, 5]], [[0, 1], [2, 3], [4, 5]], [[5], [0, 3], [1, 2, 4]], [[3, 4], [5], [0], [2], [1]]])
def test_states_equal_reports_after_any_split(spark, tmp_path, order):
    m, logs, states = scores(spark), f"file://{tmp_path}/log", f"file://{tmp_path}/states"
    for k, periods in enumerate(order):
        batch = m.where(F.col("period").isin(periods))
        health.absorb(batch, str(k), logs, states)
        if k == 1:
            health.absorb(batch, str(k), logs, states)  # tried again
    want = correlation.reports(correlation.records(m, ["benchmark", "period"], "bench_score", "downstream_score"), "benchmark", "period")
    got = health.reports(health.current(spark, states)).select(want.columns)
    for a, b in zip(sorted(want.collect(), key=lambda x: x.benchmark), sorted(got.collect(), key=lambda x: x.benchmark), strict=True):
        for c in want.columns:
            assert a[c] == b[c] or a[c] == pytest.approx(b[c], abs=1e-9), (a, b)


def test_a_batch_killed_between_its_commits_is_finished(spark, tmp_path, monkeypatch):
    m, logs, states = scores(spark), f"file://{tmp_path}/log", f"file://{tmp_path}/states"
    health.absorb(m.where("period < 3"), "0", logs, states)
    commit = log.commit

    def dies(rows, path, batch):
        if path == states:
            raise RuntimeError("killed")
        return commit(rows, path, batch)

    monkeypatch.setattr(log, "commit", dies)
    with pytest.raises(RuntimeError):
        health.absorb(m.where("period >= 3"), "1", logs, states)
    monkeypatch.setattr(log, "commit", commit)
    health.absorb(m.where("period >= 3"), "1", logs, states)
    assert {r.benchmark: r.n_records for r in health.reports(health.current(spark, states)).collect()} == {"one": 6, "two": 6, "flat": 6, "short": 2}


# paged sources


def test_pages_follow_tokens_and_fail_at_last():
    calls = []

    def fetch(query, token):
        calls.append(token)
        if len(calls) in (1, 3):
            raise OSError("busy")
        return [(query, token or 0, i) for i in range(3)], {None: 1, 1: 2}.get(token)

    assert list(pages(fetch, "q", 1, 0.0)) == [("q", t, i) for t in range(3) for i in range(3)] and calls == [None, None, 1, 1, 2]
    calls.clear()
    assert len(list(pages(fetch, "q", 1, 0.0, most=4))) == 4
    with pytest.raises(OSError):
        list(pages(lambda q, t: 1 / 0 if False else (_ for _ in ()).throw(OSError("down")), "q", 2, 0.0))


def test_paged_source_reads_every_query(spark):
    def fetch(query, token):
        at = token or 0
        return [(query, at * 10 + i) for i in range(10)], at + 1 if at < int(query) else None

    spark.dataSource.register(paged("counted", "q string, n long", fetch, ["0", "1", "4"]))
    rows = spark.read.format("counted").load()
    assert {r.q: r.n for r in rows.groupBy("q").agg(F.count("*").alias("n")).collect()} == {"0": 10, "1": 20, "4": 50}
    assert spark.read.format("counted").option("most", 12).load().count() == 10 + 12 + 12


# generation


def templates(spark, n=30):
    return spark.createDataFrame([(i, f"template {i}", "coding" if i % 5 == 0 else "math") for i in range(n)], "id long, t string, kind string")


def model(prompts):
    said = []
    for p in prompts:
        start, _, v = p.rpartition("\nVariant ")
        code = "x = 1  # fine code" if int(v) % 2 else "def f(:  not code"
        said.append("none" if int(v) % 6 == 0 else json.dumps({"question": f"{start} {int(v) % 4}", "answer": code, "explanation": ""}))
    return said


def test_generation_meets_its_target_and_repeats(spark):
    known = spark.createDataFrame([("template 3 1",), ("template 4 2",)], "t string").select(F.sha2("t", 256).alias("fp"))
    runs = []
    for _ in range(2):
        questions, reasons = generation.generate(templates(spark), "id", F.col("t"), F.col("kind"), model, 25, known, "g")
        runs.append((pairs(questions), pairs(reasons)))
    assert runs[0] == runs[1]
    rows, counts = runs[0][0], dict(runs[0][1])
    assert len(rows) == 25 == counts["accepted"] and len({q for _, q, *_ in rows}) == 25 and counts["unverified"] and counts["unparsed"]
    assert not {"template 3 1", "template 4 2"} & {q for _, q, *_ in rows}
    assert sum(counts.values()) == max(a for a, *_ in rows) + 1  # nothing after the attempt that met it
    assert all(note == "syntax OK" for _, q, _, note in rows if int(q.split()[1]) % 5 == 0)


def test_generation_gives_up_after_five_tries_each(spark):
    questions, reasons = generation.generate(templates(spark, 2), "id", F.col("t"), F.col("kind"), model, 20, templates(spark, 0).select(F.col("t").alias("fp")), "g")
    assert questions.count() <= 8 and sum(n for _, n in pairs(reasons)) == 100
    for empty in (templates(spark, 0),):
        questions, reasons = generation.generate(empty, "id", F.col("t"), F.col("kind"), model, 5, empty.select(F.col("t").alias("fp")), "g")
        assert questions.count() == 0 and reasons.count() == 0
    assert generation.generate(templates(spark), "id", F.col("t"), F.col("kind"), model, 0, empty.select(F.col("t").alias("fp")), "g")[0].count() == 0
