"""Steps that once did work over and over, or gathered what grows: each test fails on the form before."""

import pytest
from pyspark.sql import functions as F

from evalsieve.operators import shortcuts
from evalsieve.plans import fixtures


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("report", [shortcuts.valid_items, lambda m: shortcuts.reports(m, "doc_id"), lambda m: shortcuts.pattern_fractions(shortcuts.reports(m, "doc_id")).drop("fraction")])
def test_items_split_their_text_once_for_each_scan(spark, report):
    plan = optimized(report(fixtures.mcq(spark, "/root/testdata/sf0.001")))
    assert plan.count("split(ltrim(text") <= plan.count("Relation [")
    assert plan.count("split(text") == 0


def test_items_of_odd_white_space(spark, tmp_path):
    words = [f"w{i}" for i in range(70)]
    texts = [" ".join(words), "\n\t " + "\n".join(words) + " ", " ".join(words[:69]) + "  ", "\r".join(words), None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fixtures.mcq(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1]
    assert got[1].choices == [" ".join(words[s : s + 1 + (m + m) % 12]) for s, m in ((12, 5), (25, 7), (38, 11), (51, 13))]
    assert got[1].question == " ".join(words[:12]) and got[0].question == "not " + " ".join(words[:12])


def test_minhash_of_parts_equals_the_plain_one(spark, monkeypatch):
    """Python's own arithmetic, text by text; parts are made small, so that words, texts and vocabularies are cut."""
    import hashlib

    from evalsieve.operators import dedup

    monkeypatch.setattr(dedup, "WORDS", 3)
    texts = ["a b a", "\x0b é ü\tb\r\nc  ", " ".join(map(str, range(50))), "x"]

    def plain(i, t):
        words = [w for w in __import__("re").split("[ \t\n\x0b\f\r]+", t) if w]
        hs = [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in words]
        s = [min((h * a + b) % dedup.PRIME for h in hs) for a, b in map(dedup.permutation, range(128))]
        return [(i, hashlib.md5(":".join(map(str, [k, *s[k : k + 16]])).encode()).hexdigest()) for k in range(0, 128, 16)]

    rows = spark.createDataFrame([*enumerate(texts), (7, None), (8, " \n"), (9, "")], "i long, t string")
    got = dedup.buckets(rows, "i", "t")
    assert "array_min" not in optimized(got)  # a word was permuted anew for each text that has it
    assert sorted(map(tuple, got.collect())) == sorted(x for i, t in enumerate(texts) for x in plain(i, t))


def test_votes_on_the_edge_of_a_step_dont_depend_on_order(spark, tmp_path):
    on_edge = [8.36, 1.99, 36.69, 10.45, 42.46, 32.2, 7.85]  # 140 in all, 20 on average; less when doubles are added in this order
    rows = [(1, "a", v) for v in on_edge] + [(1, "b", -v) for v in on_edge] + [(2, "a", -0.01), (2, "b", None), (3, "a", 1e20), (3, "b", 39.99), (3, "c", 40.0)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.question, r.model): r.answer for r in fixtures.votes(spark, str(tmp_path)).collect()}
    assert got == {(1, "a"): "1", (1, "b"): "-1", (2, "a"): "-1", (2, "b"): None, (3, "a"): "5000000000000000000", (3, "b"): "1", (3, "c"): "2"}


def test_word_sets_makes_no_pairs(spark, monkeypatch):
    """It once made all the tables of the similarity join, and then told sets only."""
    from evalsieve.operators import dedup
    from evalsieve.plans import curation

    made, real = [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda spark, df, name: made.append((name, df.columns)) or real(spark, df, name))
    assert curation.word_sets(spark, "/root/testdata/sf0.001").count() > 0
    assert made == [("set_keys", ["id", "h", "k"])]


def near_copies(n):
    words = [f"w{i}" for i in range(300)]
    return [" ".join(words[: 290 + i % 10] + [f"n{i}"]) for i in range(n)]


def test_similar_pairs_fetch_no_words_for_each_pair(spark):
    """Pairs were joined with the words of both their sets, so a set was shuffled once for each pair that it was in."""
    from evalsieve.operators import dedup

    found = dedup.similar_pairs(spark, spark.createDataFrame(list(enumerate(near_copies(80))), "id long, t string"), "id", "t")
    assert found.count() == 80 * 79 // 2
    plan = optimized(found).splitlines()
    assert sum("Join" in x for x in plan) <= 1  # of tasks' sets with their words


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 3}, {"BLOCK_BYTES": 500}, {"TOGETHER": 2, "BITS": 64}, {"TEXT": 64, "BLOCK": 2}, {"LARGE": 3, "WIDE": 128}])
def test_similar_pairs_in_blocks_equal_all_pairs(spark, monkeypatch, limits):
    import itertools
    import random

    from evalsieve.operators import dedup

    for name, value in limits.items():
        monkeypatch.setattr(dedup, name, value)
    r = random.Random(4)
    base = [[f"t{r.randrange(60)}" for _ in range(r.randrange(1, 30))] for _ in range(25)]
    texts = near_copies(7) + [" ".join(b + [f"n{r.randrange(5)}"] * k) for b in base for k in range(2)] + ["", " ", None, "one", "One", "é one"]
    rows = spark.createDataFrame([(f"x{i:03}", t) for i, t in enumerate(texts)], "id string, t string")
    sets = {}
    for i, t in enumerate(texts):
        if (t or "").split():
            sets.setdefault(frozenset(t.split()), f"x{i:03}")
    want = {(*sorted((a, b)), len(x & y) / len(x | y)) for (x, a), (y, b) in itertools.combinations(sets.items(), 2) if len(x & y) / len(x | y) >= 0.8}
    for common in (1 << 17, 40):
        got = dedup.similar_pairs(spark, rows, "id", "t", 0.8, common).collect()
        assert len(got) == len(want) > 20 and {tuple(p) for p in got} == want


def documents_read(monkeypatch, df_of):
    """How often documents are scanned: by tables written on the way, and by what is left to run."""
    from evalsieve.plans import items

    scans, real = [], getattr(items, "written", None)
    of = lambda df: scans.extend(f for f in df.inputFiles() if "documents.parquet" in f)
    monkeypatch.setattr(items, "written", lambda spark, df, name: of(df) or real(spark, df, name), raising=False)
    df = df_of(items)
    return len(scans) + optimized(df).count("Filter (isnotnull(text") * (any("documents.parquet" in f for f in df.inputFiles()))


@pytest.mark.parametrize("query", ["audit_report", "audit_json"])
def test_audits_read_the_documents_once(spark, monkeypatch, query):
    assert documents_read(monkeypatch, lambda items: getattr(items, query)(spark, "/root/testdata/sf0.001")) == 1


@pytest.mark.parametrize("query", ["forge_quality", "fault_detection", "labelled_mix"])
def test_mixes_read_the_documents_once_and_make_200_items(spark, monkeypatch, query):
    assert documents_read(monkeypatch, lambda items: getattr(items, query)(spark, "/root/testdata/sf0.001")) == 1


def test_bands_are_never_broadcast(spark, monkeypatch):
    """Spark takes exploded bands for as small as the rows that hold them; they were broadcast and broke the driver's memory."""
    from evalsieve.llm import minhash

    plans, real = {}, minhash.written
    monkeypatch.setattr(minhash, "written", lambda spark, df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and real(spark, df, name))
    assert minhash.classes(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).count() == 200
    assert "SortMergeJoin" in plans["shared"] and "Broadcast" not in plans["shared"]


def test_pairs_get_their_bits_in_parts(spark, monkeypatch):
    """All pairs were joined with the bits of both their sets at once, whatever their number."""
    from evalsieve.operators import dedup

    made, real = [], dedup.written
    monkeypatch.setattr(dedup, "AT_ONCE", 1000)
    monkeypatch.setattr(dedup, "written", lambda spark, df, name: made.append(name) or real(spark, df, name))
    assert dedup.similar_pairs(spark, spark.createDataFrame(list(enumerate(near_copies(80))), "id long, t string"), "id", "t").count() == 80 * 79 // 2
    assert made.count("alike") == 8  # 3,160 pairs, twice
