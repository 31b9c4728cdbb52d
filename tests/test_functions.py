"""Column functions and rules on hand-made rows: every guard once."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalsieve.functions import text
from evalsieve.operators import contamination, corpus, correlation, dedup, irt, ranges, responses, rewards, shortcuts, stats


def value(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in given.items()])
    return row.select(column.alias("out")).first().out


T = F.col("t")


@pytest.mark.parametrize("n, want", [(7, 0), (8, 1), (9, 2)])
def test_catalog_grams_need_eight_words(spark, n, want):
    assert len(value(spark, text.catalog_grams(T), t=" ".join("abcdefghi"[:n]))) == want


def test_words_keep_letters_of_all_languages(spark):
    assert value(spark, text.plain_words(T), t="Über straße, été!") == ["über", "straße", "été"]
    assert value(spark, text.words(T), t="  a  b ") == ["a", "b"] and value(spark, text.words(T), t="") == []


@pytest.mark.parametrize("given, want", [(" Paris.\nyes", "paris"), ("42!!", "42"), ("", "")])
def test_normal_answer(spark, given, want):
    assert value(spark, text.normal_answer(T), t=given) == want


def test_heuristic_scores(spark):
    assert value(spark, contamination.template_score(T), t="Which of the following: what is the best of the capital of") == 0.75
    assert value(spark, contamination.template_score(T), t="nothing") == 0
    assert value(spark, contamination.phrase_score(T), t="in the context of it") == 0
    assert value(spark, contamination.phrase_score(T), t="now in the context of all it is") == pytest.approx(0.3)


def test_jaccard_of_empty_sets(spark):
    e = F.array().cast("array<string>")
    assert value(spark, text.jaccard(e, e), t="") == 1 and value(spark, text.jaccard(e, F.array(T)), t="a") == 0


def scores(n=None, t=None, m=None):
    return {k: F.lit(v).cast("double") for k, v in (("ngram", n), ("template", t), ("memorization", m))}


@pytest.mark.parametrize("given, want", [((0.6, 0.6), "HIGH"), ((0.75, 0.1), "MEDIUM"), ((0.6, 0.1), "LOW")])
def test_confidence_and_composite(spark, given, want):
    assert value(spark, contamination.confidence(scores(*given)), t="") == want
    assert value(spark, contamination.composite(scores(1.0, 0.5)), t="") == pytest.approx(0.55 / 0.7)
    assert value(spark, contamination.composite(scores()), t="") == 0


def items(spark, *rows):
    return spark.createDataFrame(rows, "id int, question string, choices array<string>, answer string")


def words(n, stem="w"):
    return " ".join(f"{stem}{i}" for i in range(n))


def found(spark, question, choices, answer="A"):
    r = shortcuts.reports(items(spark, (1, question, choices, answer)), "id").first()
    return {s.pattern: s.severity for s in r.shortcuts}, r.score, r.recommendation


def test_shortcut_rules(spark):
    three = [words(3, c) for c in "xyz"]
    assert found(spark, "q", [words(6), *three])[0] == {"length_bias": 0.5}
    assert found(spark, "q", [words(12), *three])[0]["length_bias"] == 1.0
    assert found(spark, "about green apples", ["green apples here now", *[words(4, c) for c in "xyz"]])[0] == {}
    assert found(spark, "about green apples", ["green apples are so", *[words(4, c) for c in "xyz"]])[0] == {"lexical_overlap": 1.0}
    assert found(spark, "apples", ["apples is to at", *[words(4, c) for c in "xyz"]])[0] == {}
    assert found(spark, "which is not so", ["it never was ever red", "it was ever red", words(4)])[0] == {"negation_artifact": 0.7}
    assert found(spark, "q", [words(4), words(2, "x"), words(4, "y")])[0] == {"distractor_implausibility": 0.5}
    assert found(spark, "q", [words(3), words(15, "x")])[0] == {"answer_choice_asymmetry": 0.4}
    for bad in ([], None):
        assert found(spark, "q", bad) == ({}, 1.0, "KEEP")
    assert found(spark, "q", ["a"], "D") == ({}, 1.0, "KEEP") and found(spark, "q", ["a b c"], None) == ({}, 1.0, "KEEP")


@pytest.mark.parametrize("given, score, want", [([1.0], 0.7, "KEEP"), ([1.0, 0.5], 0.55, "REVISE"), ([1.0, 1.0, 0.5], 0.25, "REPLACE"), ([1.0] * 5, 0.0, "REPLACE")])
def test_quality_is_folded_in_doubles(spark, given, score, want):
    got = value(spark, F.struct(shortcuts.quality(F.col("s")), shortcuts.recommendation(shortcuts.quality(F.col("s")))), s=given)
    assert got[0] == pytest.approx(score) and got[1] == want


def test_position_bias_and_validity(spark):
    rows = [(i, "q", ["a", "b", "c", "d"], a) for i, a in enumerate("AAAAAAABCD")]
    assert shortcuts.position_bias(items(spark, *rows)).first().bias == pytest.approx(0.9)
    valid = items(spark, (1, "q", [words(6), words(2, "x")], "A"), (2, "q", [words(5), words(2, "x")], "A"), (3, "q", ["a"], "B"))
    assert [r.id for r in shortcuts.valid_items(valid).collect()] == [2]


def test_item_curves(spark):
    one = lambda c: value(spark, c, t="")
    th, a, b = F.lit(0.5), F.lit(1.0), F.lit(0.5)
    assert one(irt.p_2pl(th, a, b)) == 0.5 and one(irt.p_3pl(th, a, b, F.lit(0.25))) == 0.625
    assert one(irt.information_2pl(th, a, b)) == 0.25 and one(irt.standard_error(F.lit(0.25))) == 2


def test_abilities_are_clipped_logits(spark):
    rows = spark.createDataFrame([("all", 1, 1.0), ("none", 1, 0.0), ("half", 1, 1.0), ("half", 2, 0.0)], "model string, item int, response double")
    got = {r.model: r.theta for r in irt.abilities(rows).collect()}
    assert got["all"] == pytest.approx(math.log(99)) and got["none"] == pytest.approx(-math.log(99)) and got["half"] == pytest.approx(0)


def log_likelihood(r: np.ndarray, theta: np.ndarray, a: float, b: float) -> float:
    p = np.clip(1 / (1 + np.exp(-a * (theta - b))), 1e-8, 1 - 1e-8)
    return float((r * np.log(p) + (1 - r) * np.log(1 - p)).sum())


def fit_2pl(r: np.ndarray, theta: np.ndarray, a_range=(0.01, 5.0), b_range=(-4.0, 4.0)) -> tuple[float, float]:
    """Most likely (a, b) in the box for fixed abilities.

    The logit a * theta - a * b is linear in (a, -a * b) and its likelihood concave, so Newton steps find the maximum;
    if it lies outside the box, the maximum is on a face, where one parameter is fixed and the other found by
    golden-section search.
    """
    x = np.stack([theta, np.ones_like(theta)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-10 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (r - p))
        w = w + np.clip(step, -5, 5)
        if abs(step).max() < 1e-10:
            break
    a = float(w[0])
    b = float(-w[1] / w[0]) if w[0] else math.inf
    if a_range[0] <= a <= a_range[1] and b_range[0] <= b <= b_range[1]:
        return a, b

    def best(f, low: float, high: float) -> float:
        ratio = (math.sqrt(5) - 1) / 2
        grid = np.linspace(low, high, 41)
        k = int(np.argmax([f(v) for v in grid]))
        low, high = grid[max(0, k - 1)], grid[min(40, k + 1)]
        while high - low > 1e-9:
            m, n = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, n) if f(m) >= f(n) else (m, high)
        return float((low + high) / 2)

    found = [(a0, best(lambda v: log_likelihood(r, theta, a0, v), *b_range)) for a0 in a_range]  # noqa: B023
    found += [(best(lambda v: log_likelihood(r, theta, v, b0), *a_range), b0) for b0 in b_range]  # noqa: B023
    return max(found, key=lambda ab: log_likelihood(r, theta, *ab))


def test_fit_recovers_parameters_and_flags_extremes(spark):
    rng = np.random.default_rng(0)
    theta = np.linspace(-2, 2, 400)
    for a, b in ((1.2, 0.5), (0.6, -1.0)):
        r = (rng.random(400) < 1 / (1 + np.exp(-a * (theta - b)))).astype(float)
        got = fit_2pl(r, theta)
        best = max(((x, y) for x in np.linspace(0.01, 5, 120) for y in np.linspace(-4, 4, 161)), key=lambda ab: log_likelihood(r, theta, *ab))
        assert log_likelihood(r, theta, *got) >= log_likelihood(r, theta, *best) - 1e-6
    assert fit_2pl((theta < 0).astype(float), theta)[0] == 0.01  # wrong way round: the face a = .01
    rows = [(f"m{m}", i, float(v)) for m in range(10) for i, v in (("easy", 1), ("hard", 0), ("mid", m > 4))]
    got = {r.item: r for r in irt.fit(spark.createDataFrame(rows, "model string, item string, response double")).collect()}
    assert (got["easy"].a, got["easy"].b, got["easy"].flags) == (0, -4, ["CEILING"]) and (got["hard"].b, got["hard"].flags) == (4, ["FLOOR"])


@pytest.mark.parametrize("r, n, want", [(0.5, 10, 0.14111328), (0.9, 5, 0.03738607), (0.0, 8, 1.0), (1.0, 8, 0.0)])
def test_correlation_p_value(r, n, want):
    assert stats.correlation_p_value(r, n) == pytest.approx(want, abs=1e-7)


def log(spark, *rows):
    return spark.createDataFrame([("b", i, r, 0.9, t) for i, (r, t) in enumerate(rows)], "benchmark string, period int, pearson double, spearman double, tau double")


@pytest.mark.parametrize("rows, trend, reason", [([(0.9, 0.9)] * 2, "STABLE", None), ([(0.9, 0.9), (0.8, 0.9), (0.7, 0.9)], "DEGRADING", "slope"), ([(0.4, 0.9)], "STABLE", "pearson"), ([(0.6, 0.5)], "STABLE", "kendall"), ([(None, 0.9)], "STABLE", None), ([(0.6, 0.9), (0.7, 0.9), (0.8, 0.9)], "IMPROVING", None)])
def test_trend_and_alerts(spark, rows, trend, reason):
    got = correlation.reports(log(spark, *rows), "benchmark", "period").first()
    assert got.trend == trend and (got.reason or "").split(" ")[0] == (reason or "") and got.alert == (reason is not None)


def test_correlations_of_few_or_constant_scores(spark):
    rows = [("two", 1, 1.0, 2.0), ("two", 2, 2.0, 1.0), *[("flat", m, 1.0, float(m)) for m in range(4)], *[("up", m, float(m), float(m * m)) for m in range(5)]]
    got = {r.k: r for r in correlation.records(spark.createDataFrame(rows, "k string, m int, x double, y double"), ["k"], "x", "y").collect()}
    assert set(got) == {"flat", "up"} and got["flat"].pearson is None and got["flat"].tau is None
    assert got["up"].spearman == pytest.approx(1) and got["up"].tau == pytest.approx(1)


@pytest.mark.parametrize("answers, want", [(["a", "a"], True), (["a"], False), (["a", "a", "a", "b"], True), (["a", "a", "b", "b"], False)])
def test_votes(spark, answers, want):
    rows = spark.createDataFrame([("q", f"m{i}", a) for i, a in enumerate(answers)], "q string, m string, a string")
    got = responses.votes(rows, "q", "m", "a").first()
    assert got.is_contaminated == want and got.top_answer == "a"


def test_json_and_rewards(spark):
    assert [value(spark, text.format_reward(T), t=t) for t in ('{"a":1}', "{bad}", "none", '```json\n{"a":1}\n```')] == [1.0, 0.3, 0.0, 1.0]
    assert [value(spark, text.json_text(T), t=t) for t in ('so {"a":1} it is', "garbage", '```\n{"a":1}\n```')] == ['{"a":1}', None, '{"a":1}']
    f1 = lambda p, f: value(spark, rewards.shortcut_f1(F.col("p"), F.col("f")), p=p, f=f)
    assert f1(["x", "y"], ["x"]) == pytest.approx(2 / 3) and f1(["x"], ["z"]) == 0
    group = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.1), (2, 0.2)], "g int, r double")
    assert sorted(r.r for r in rewards.guarded(group, "g", "r").collect()) == [-1, -1, 0.1, 0.2]
    many = '{"shortcuts_found":[{"pattern":"a"}],"shortcuts":[{"pattern":"b"}]}'
    assert value(spark, rewards.detected(T), t=many) == ["a"] and value(spark, rewards.detected(T), t="no") is None


def test_papers_and_pages(spark):
    assert value(spark, corpus.relevance(F.lit(None).cast("string"), F.lit("plain"), F.lit(501), F.lit(2022)), t="") == pytest.approx(0.4)
    assert [value(spark, text.year_of_venue(T), t=t) for t in ("org/ACL/2023/Conference", "X.cc", "a/2021")] == [2023, 0, 2021]
    assert value(spark, text.without_markup(T), t="a [[File:x]] <b>c</b> {{d}} e") == "a c e"
    assert [(s.number, s.text) for s in value(spark, corpus.problem_sections(T), t="== Problem 1 ==\none\n==problem 2==\ntwo\n== Solution ==\nno")] == [(1, "one"), (2, "two")]
    assert value(spark, text.math_subject(T), t="a random triangle") == "probability" and value(spark, text.math_subject(T), t="hm") == "general"


# items fitted by sums, order by ranges


def brute_tau(x, y):
    up = down = tied_x = tied_y = 0
    for (a, b), (c, d) in itertools.combinations(zip(x, y), 2):
        s = (a > c) - (a < c), (b > d) - (b < d)
        up, down = up + (s[0] * s[1] > 0), down + (s[0] * s[1] < 0)
        tied_x, tied_y = tied_x + (s[0] != 0), tied_y + (s[1] != 0)
    return (up - down) / math.sqrt(tied_x * tied_y) if tied_x * tied_y else None


@pytest.mark.parametrize("block", [1 << 16, 30, 5])
def test_kendall_equals_all_pairs(spark, block):
    r = random.Random(block)
    rows = [(k, "m", float(r.randrange(wide)), float(r.randrange(wide))) for k, n, wide in (("ties", 120, 6), ("few", 3, 9), ("many", 260, 10**6), ("equal", 40, 1), ("one", 1, 5)) for _ in range(n)]
    rows += [("const", "m", 1.0, float(i)) for i in range(9)] + [("ties", "m", None, 1.0), (None, "m", 1.0, 2.0), (None, "m", 2.0, 1.0)]
    scores = spark.createDataFrame(rows, "k string, w string, x double, y double")
    got = {t.k: t.tau for t in correlation.kendall(scores, ["k"], "x", "y", block).collect()}
    want = {k: brute_tau(*zip(*[(x, y) for a, _, x, y in rows if a == k and x is not None])) for k in ("ties", "few", "many", "equal", "one", "const")}
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or got[k] == pytest.approx(want[k], abs=1e-12)) for k in want)


def test_kendall_of_a_large_key_forms_no_pairs(spark):
    """10^5 models under one key: y is x but for a block that is turned round, which has known inversions."""
    n, turned = 100_000, 2_000
    x = F.col("id")
    scores = spark.range(n).select(F.lit("b").alias("k"), x.cast("double").alias("x"), F.when(x < turned, turned - 1 - x).otherwise(x).cast("double").alias("y"))
    tau = correlation.kendall(scores, ["k"], "x", "y", 20_000)
    assert tau.first().tau == pytest.approx(1 - 2 * turned * (turned - 1) / (n * (n - 1)), abs=1e-12)


def test_fit_by_sums_equals_item_by_item(spark):
    r = np.random.default_rng(3)
    theta = np.concatenate([np.linspace(-2.5, 2.5, 60), np.zeros(40)])
    kinds = {"good": (1.3, 0.4), "steep": (40.0, 0.1), "wrong": (-1.0, 0.0), "hard": (0.4, 9.0), "flat": (0.02, 60.0), "split": (1e9, 0.3)}
    rows = [(f"m{m}", i, float(r.random() < 1 / (1 + math.exp(min(700, max(-700, -a * (t - b))))))) for i, (a, b) in kinds.items() for m, t in enumerate(theta)]
    rows += [(f"m{m}", "half", 0.5) for m in range(100)] + [(f"m{m}", f"anchor{k}", float(t > -2 + k / 3)) for m, t in enumerate(theta) for k in range(12)]
    responses = spark.createDataFrame(rows, "model string, item string, response double")
    abilities = {a.model: a.theta for a in irt.abilities(responses).collect()}
    got = {x.item: x for x in irt.fit(responses).collect()}
    outside = 0
    for item in {i for _, i, _ in rows}:
        y, t = np.array([v for _, i, v in rows if i == item]), np.array([abilities[m] for m, i, _ in rows if i == item])
        if not 0.01 < y.mean() < 0.99:
            continue
        a, b = fit_2pl(y, t)
        outside += a in (0.01, 5.0) or b in (-4.0, 4.0)
        assert log_likelihood(y, t, got[item].a, got[item].b) == pytest.approx(log_likelihood(y, t, a, b), abs=1e-7), item
        assert (got[item].a, got[item].b) == pytest.approx((a, b), abs=1e-3), item
        if y.std():
            assert got[item].fit_p_value == pytest.approx(stats.correlation_p_value(float(np.corrcoef(t, y)[0, 1]), len(y)), abs=1e-9)
        else:
            assert got[item].fit_p_value is None
    assert outside >= 4


def test_fit_of_an_item_with_a_million_responses(spark):
    """Twenty anchors' values, 50,000 models each: forty abilities, so the fit has forty rows to go through."""
    n, k = 1_000_000, np.arange(1_000_000) % 20
    right = np.arange(n) // 20 < np.round(50_000 / (1 + np.exp(-(k - 9.5) / 4)))
    m = F.col("id")
    p = 1 / (1 + F.exp(-(m % 20 - 9.5) / 4))
    rows = spark.range(n).select(m.alias("model"), F.explode(F.create_map(F.lit("anchor"), (m % 20 + 0.5) / 20, F.lit("big"), (F.floor(m / 20) < F.round(p * 50_000)).cast("double"))).alias("item", "response"))
    mean = np.clip(((k + 0.5) / 20 + right) / 2, 0.01, 0.99)
    got = {x.item: x for x in irt.fit(rows).collect()}
    assert (got["big"].a, got["big"].b) == pytest.approx(fit_2pl(right.astype(float), np.log(mean / (1 - mean))), abs=1e-3)


def test_places_and_medians_by_ranges(spark):
    r = random.Random(8)
    rows = [(r.choice("abc") if i % 9 else None, r.randrange(40), i) for i in range(500)]
    got = ranges.placed(spark.createDataFrame(rows, "k string, x int, i int").repartition(7), ["x", "i"], ["k"]).collect()
    for key in ("a", "b", "c", None):
        assert [(g.x, g.i) for g in sorted((g for g in got if g.k == key), key=lambda g: g.place)] == sorted((x, i) for k, x, i in rows if k == key)
        assert sorted(g.place for g in got if g.k == key) == list(range(sum(k == key for k, _, _ in rows)))
    for values in ([], [3.0], [1.0, 2.0], [5.0] * 200, [float(i) for i in range(301)], [r.gauss(0, 1) ** 9 for _ in range(500)], [1.0] * 100 + [2.0] * 100, [None, 4.0, None]):
        known = [v for v in values if v is not None]
        for most in (10_000, 3):
            got = ranges.median(spark.createDataFrame([(v,) for v in values], "v double"), "v", most)
            assert got == (float(np.median(known)) if known else None)


def test_a_feistel_network_permutes(spark):
    for n in (1, 2, 3, 7, 50, 911):
        got = spark.range(n).select(*[ranges.shuffled_place(F.col("id"), F.lit(n).cast("long"), F.lit(s)).alias(s) for s in ("s", "t")]).collect()
        assert all(sorted(g[s] for g in got) == list(range(n)) for s in ("s", "t"))
        assert n < 50 or [g.s for g in got] != [g.t for g in got]


def items_of(spark, n):
    return spark.createDataFrame([(i, f"question {i}", [f"c{i} {k}" for k in range(4 if i % 5 else 3)], "ABC"[i % 3], "x") for i in range(n)], "id long, question string, choices array<string>, answer string, nth string")


@pytest.mark.parametrize("n", [0, 3, 60])
def test_bundles_draw_different_items_and_tell_what_was_planted(spark, n):
    from evalsieve.operators import planting

    items = items_of(spark, n).drop("nth")
    found = planting.bundles(items, "id", 40).collect()
    assert len(found) == (40 if n else 0)
    known = {r.id: r for r in items.collect()}
    for b in found:
        ids = [x.id for x in b["items"]]
        assert len(set(ids)) == len(ids) and (len(ids) == 3 if n == 3 else 5 <= len(ids) <= 15)
        changed = [x for x in b["items"] if (x.question, x.choices, x.answer) != tuple(known[x.id])[1:4]]
        assert {x.id for x in changed} <= {x.id for x in b["items"] if x.planted_type}
        assert b.shortcuts_planted == sorted({x.planted_type for x in b["items"] if x.planted_type}) and b.n_shortcuts == len(b.shortcuts_planted)
        assert not any(x.planted_type == "position_bias" and x.id % 5 == 0 for x in b["items"])
    share = np.mean([x.planted_type is not None for b in found for x in b["items"]]) if n else 0.3
    assert 0.15 < share < 0.45 and (n < 60 or len({tuple(x.id for x in b["items"]) for b in found}) == 40)


def test_draws_with_replacement_repeat(spark):
    rows = spark.createDataFrame([(i, "n") for i in range(50)], "i long, nth string")
    all_ = {d.draw: d.i for d in dedup.drawn(rows, "i", 300, "s").collect()}
    assert sorted(all_) == list(range(300)) and len(set(all_.values())) > 40
    assert {d.draw: d.i for d in dedup.drawn(rows, "i", 100, "s", first=150).collect()} == {k: all_[k] for k in range(150, 250)}
    assert dedup.drawn(rows.limit(0), "i", 5, "s").count() == 0
