"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import itertools
import math
import pickle
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalsieve.llm import common, ctw, exact_dedup, licenses, maxscore, minhash, packing, pieces, sharding, templates, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, key string, row long, word string"


def documents(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "d", "k", 1, "w") for i, t in zip(ids, texts)], DOCS)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join("w" + chr(97 + k // 26) + chr(97 + k % 26) for k in (r.randrange(vocabulary) for _ in range(n)))


ODD = [None, "", " \n\t ", "one", "One", "ONE", "long " * 30000, "straße ÉTÉ ﬁ İ Σας", "tab\tand\rcr\x0bvt", "null\x00byte"]


# exact dedup (8)


def test_exact_dedup_odd_rows_and_heavy_groups(spark):
    texts = ODD + ["Copy"] * 300 + ["copy"] * 50 + ["b", "B"]
    ids = [*range(len(texts))]
    ids[3] = None
    rows = exact_dedup.decisions(spark, documents(spark, texts, ids), heavy=4).collect()
    low = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    groups = collections.defaultdict(list)
    for i, t in zip(ids, texts):
        groups[hashlib.sha256(low(t).encode()).digest()].append(i)
    assert len(rows) == len(texts)
    for r in rows:
        g = groups[bytes(r.digest)]
        assert r.group_size == len(g)
        assert r.keep_id == max(x for x in g if x is not None)
        assert r.kept == (r.doc_id == r.keep_id)


def test_exact_dedup_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["x", "x", "X", "y", None, None], [7, 7, 3, None, None, None])
    kept = exact_dedup.keep_distinct(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == [("7", "x"), ("None", ""), ("None", "y")]
    assert exact_dedup.decisions(spark, docs.limit(0)).count() == 0


def test_misra_gries_finds_every_frequent_value():
    r = random.Random(1)
    values = [r.choice("abc") if r.random() < 0.5 else str(r.random()) for _ in range(5000)]
    counts = exact_dedup.misra_gries(values, 20)
    assert len(counts) <= 20 and {"a", "b", "c"} <= set(counts)


# near dedup (3)


def weighted_jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def bag(text):
    w = (text or "").lower().split()
    n = min(5, len(w))
    return collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else collections.Counter()


def near_classes(texts):
    bags, root = [bag(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if (not bags[i] and not bags[j]) or weighted_jaccard(bags[i], bags[j]) >= 0.8 - 1e-9:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def edited(text, seed, n):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("small", [0, 100_000])
def test_components_equal_union_find(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL_GRAPH", small)
    r = random.Random(8)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, i) for i in range(6000, 6050)] + [(7, 7), (9000, 9000)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "a long, b long")
    got = {x.node: x.comp for x in common.components(spark, table, "t").collect()}
    alone = {x for x in root if all(x not in e or e[0] == e[1] for e in edges)}
    assert got == {x: find(x) for x in root if x not in alone}
    assert common.components(spark, table.limit(0), "t").count() == 0


@pytest.mark.parametrize("small", [0, 100_000])
def test_near_dedup_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL_GRAPH", small)
    monkeypatch.setattr(minhash, "BLOCK", 16)  # many blocks within one group
    base = prose(1, 120)
    texts = [*ODD, base, base.upper(), *(edited(base, s, 1 + s % 4) for s in range(80)), *(prose(s, 60) for s in range(50, 80)), "a b c", "A b C", ("x y z " * 40).strip(), ("x y z " * 41).strip(), ("x y z " * 20).strip()]
    rows = minhash.classes(spark, documents(spark, texts)).collect()
    want = near_classes(texts)
    got = {r.doc_id: r.class_id for r in rows}
    assert [got[i] for i in range(len(texts))] == want
    sizes = collections.Counter(want)
    for r in rows:
        assert r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id)


@pytest.mark.parametrize("bytes_", [16 << 20, 2000])
def test_near_dedup_finds_all_pairs_of_a_table(spark, monkeypatch, bytes_):
    """Recall of links on the documents of sf0.001 and edited copies of them, against all pairs; and blocks by bytes."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", bytes_)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    texts = [r.text for r in docs][: 200 if bytes_ > 2000 else 60]
    texts += [edited(t, i, 1 + len(t.split()) * (i % 5) // 250) for i, t in enumerate(texts) if len(t.split()) > 30]
    got = {r.doc_id: r.class_id for r in minhash.classes(spark, documents(spark, texts)).collect()}
    want = near_classes(texts)
    joined = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if want[i] == want[j]]
    assert len(joined) > 20 and sum(got[i] == got[j] for i, j in joined) >= 0.99 * len(joined)
    assert all(want[i] == want[j] for i, j in itertools.combinations(range(len(texts)), 2) if got[i] == got[j])


def test_near_dedup_repeats_nulls_and_slices(spark, monkeypatch):
    monkeypatch.setattr(minhash, "UNITS", 0)  # signatures are made after every text
    docs = documents(spark, ["a b c d e f", "a b c d e f", "q", None, "a b c d e f"], [4, 4, None, None, 9])
    kept = minhash.keep_one(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == [("4", "a b c d e f"), ("None", ""), ("None", "q")]
    assert minhash.classes(spark, docs.limit(0)).count() == 0


def test_bagminhash_estimates_weighted_jaccard():
    r = np.random.default_rng(5)
    element = r.integers(1, 2**63, 300).astype(np.uint64)
    a, b = r.integers(1, 6, 300), r.integers(1, 6, 300)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    first = minhash.signatures([(element, a), (element, b)], m=4096)
    assert abs((first[0] == first[1]).mean() - want) < 0.03


# packing (7)


def test_packing_ids_pieces_and_places(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ODD + [prose(s, 20 + 17 * s) for s in range(60)] + ["J̌ don't stop. étude,x ЖУК. 東京!", "<|endoftext|>a <|startoftext|>", "same", "same"]
    rows = packing.pack(spark, documents(spark, texts), path, capacity=256).collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [(k, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())) for k, s in enumerate(range(0, len(ids), 256))]
    placed = collections.defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
    for some in placed.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in rows)
    assert len(placed) <= -(-total // 256) * 1.05 + 1
    packed = packing.pack(spark, documents(spark, texts), path, capacity=256, with_ids=True)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in packed.collect())
    whole = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    parts = collections.defaultdict(list)
    for r in packing.sequences(packed).collect():
        assert len(r.ids) <= 256 and len(r.offsets) == len(r.doc_ids)
        for i, a, b in zip(r.doc_ids, r.offsets, [*r.offsets[1:], len(r.ids)]):
            parts[i].append(r.ids[a:b])
    for i, ids in whole.items():
        assert sorted(parts[i]) == sorted(ids[s : s + 256] for s in range(0, len(ids), 256))
    assert packing.pack(spark, documents(spark, texts).limit(0), path).count() == 0


def planned(lengths):
    """How many sequences a plan takes, checked piece by piece."""
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    seen, room = collections.Counter(), collections.Counter()
    for length, first, count, sequence, each, _ in packing.plan(histogram):
        assert seen[length] == first and count % each == 0
        seen[length] += count
        for k in range(count // each):
            room[sequence + k] += each * length
    assert dict(seen) == histogram and max(room.values()) <= 2048
    return len(room), sum(n for n, _, _ in packing.best_fit([], histogram, 2048)), -(-int(lengths.sum()) // 2048)


@pytest.mark.parametrize("n", [1, 7, 400, 20000])
def test_packing_plan_is_exact_and_near_the_bound(n):
    lengths = np.clip(np.random.default_rng(n).lognormal(6.4, 1, n).astype(int), 1, 2048)
    got, alone, bound = planned(lengths)
    assert got <= bound * 1.01 + 1 and got <= alone


@pytest.mark.parametrize("low, high, better", [(683, 1365, 0), (500, 1100, 0.04), (1, 2048, 0), (300, 690, 0.03), (600, 1000, 0), (2000, 2048, 0), (100, 250, 0)])
def test_packing_plan_is_never_above_best_fit(low, high, better):
    lengths = np.random.default_rng(low).integers(low, high + 1, 20000)
    got, alone, bound = planned(lengths)
    assert bound <= got <= alone * (1 - better)


# top-k (5)


@pytest.mark.parametrize("shard, block", [(8192, 32 << 20), (7, 200)])
def test_maxscore_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "BLOCK_BYTES", block)
    r = random.Random(3)
    vectors = [[r.gauss(0, 0.3) for _ in range(12)] for _ in range(300)]
    vectors[10] = vectors[11] = vectors[12]
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(400, None, 1), (450, [None] * 12, 1), (500, [float("nan")] + [0.1] * 11, 1), (550, [float("inf")] * 12, 1), (600, [], 1), (650, [0.5] * 3, 1), (5, vectors[5], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row long")
    got = maxscore.top_k(spark, table, F.col("vec_id") % 50 == 0, 5).collect()
    kept = [(k, i, [math.floor(256 * float(np.float32(x))) for x in v]) for k, (i, v, _) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for k, i, q in kept:
        if i % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, c)), j) for m, j, c in kept if m != k and len(c) == len(q)))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted((g.query_id, g.rank, g.vec_id, g.score) for g in got) == sorted(want)
    assert maxscore.top_k(spark, table.limit(0), F.lit(True), 5).count() == 0


# line templates (9)


def test_templates_drop_recurring_lines_only(spark):
    texts = [f"own words of {prose(i, 9)}\nuser {i} logged in from port {i * 7}\n\nAll rights reserved." for i in range(30)]
    texts += [f"the build of {c} is ready to be used now" for c in ("alpha", "beta", "gamma") * 6]
    out = {r.doc_id: r for r in templates.cleaned(spark, documents(spark, texts + [None, "", "\n"])).collect()}
    for i in range(30):
        assert out[i].text == texts[i].split("\n")[0] + "\n"
        assert (out[i]["_evs_lines"], out[i]["_evs_dropped"]) == (4, 2)
    assert all(out[i].text == "" for i in range(30, 48))
    assert [out[i].text for i in (48, 49, 50)] == ["", "", "\n"]
    both = [f"the build of {w} is ready to be used now" for w in map(str.upper, "abcdefghijklmnopqrstuvwxyz")] + [f"the build of {w} has failed at the second step" for w in "abcdefghijklmnopqrst"]
    mixed = both + [f"the build of {prose(i, 7)}" for i in range(40)]  # two templates and prose share a leaf
    left = {r.doc_id: r.text for r in templates.cleaned(spark, documents(spark, mixed)).collect()}
    assert [left[i] for i in range(len(both))] == [""] * len(both) and [left[i] for i in range(len(both), len(mixed))] == mixed[len(both) :]
    even = documents(spark, both[:20] + both[26:46])
    assert {r.text for r in templates.cleaned(spark, even).collect()} == {""}
    few = documents(spark, ["same line here"] * 9)
    assert {r.text for r in templates.cleaned(spark, few).collect()} == {"same line here"}
    assert templates.cleaned(spark, few.limit(0)).count() == 0
    long = prose(1, 60)
    passages = documents(spark, [f"a\n{long}", f"{long}\nb", f"{long}\n{long}", f"c {long}", "x " * 50_000, "a", "a"], [4, 5, 3, 7, None, 8, 8])
    kept = {r.doc_id: r.text for r in templates.cleaned(spark, passages).collect()}
    assert kept == {4: "a", 5: "b", 3: f"{long}\n{long}", 7: f"c {long}", None: "x " * 50_000, 8: "a"}


@pytest.mark.parametrize("n", [30_000])
def test_near_dedup_of_many_repeated_rows_in_small_tasks(spark, monkeypatch, n):
    """Rows of one id and text, and near copies: no task gets more than a block and its hubs."""
    text = prose(1, 60)
    near = [" ".join([*text.split()[:-2], f"x{k}", f"y{k}"]) for k in range(40)]
    made = spark.range(n).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(near)], "doc_id long, text string"))
    largest, original = [], minhash.verified

    def counted(docs, tasks):
        wanted = docs.join(tasks, "_evs_key").groupBy("task").count().agg(F.max("count")).first()[0]
        largest.append(wanted or 0)
        return original(docs, tasks)

    monkeypatch.setattr(minhash, "verified", counted)
    sizes = minhash.classes(spark, made).groupBy("class_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()
    assert [(r.class_id, r.n, r.kept) for r in sizes] == [(5, n + 40, 1)]
    assert 0 < max(largest) <= minhash.BLOCK + minhash.HUBS


# toxicity (4)


def test_toxicity_learns_and_ignores_the_held_out_fold(spark):
    r = random.Random(2)
    texts, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        texts.append(prose(i, 40) + (f" {r.choice(['vile', 'rotten', 'foulish'])}{r.choice(['', 'ly', 'ness'])} " + prose(i + 9000, 5) if bad else ""))
        labels.append((i, 1, int(bad)))
    docs = documents(spark, texts + [None, ""])
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, 0, None), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(spark, docs, lab).collect()}
    assert len(got) == 902
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.5) == bool(labels[i][2]) for i in held) / len(held) > 0.97
    flipped = spark.createDataFrame([(i, q, 1 - t if i in set(held) else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in toxicity.score(spark, docs, flipped).collect()} == {i: r.score for i, r in got.items()}
    assert all(0 <= r.score <= 1 for r in got.values())
    left = toxicity.accepted(spark, docs, lab)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if r.score < 0.5}
    assert [r.score for r in toxicity.score(spark, docs.limit(3), lab.limit(0)).collect()] == [0.0] * 3


def test_toxicity_examples_are_bounded_and_no_neighbours_of_their_own(spark, monkeypatch):
    texts = [prose(i, 40) + (" vile" if i % 3 == 0 else "") for i in range(120)]
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    got = toxicity.score(spark, documents(spark, texts), lab).collect()
    assert all(r.neighbours and r.doc_id not in [x.doc_id for x in r.neighbours] for r in got)
    monkeypatch.setattr(toxicity, "TEXT_BYTES", 1500)
    few = {x.doc_id for r in toxicity.score(spark, documents(spark, texts), lab).collect() for x in r.neighbours}
    assert 4 < len(few) < 30 and {i % 3 == 0 for i in few} == {True, False}


def test_toxicity_sends_vectors_and_no_index(spark):
    texts = [prose(i, 40) + (" vile" if i % 3 == 0 else "") for i in range(400)]
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(spark, documents(spark, texts), lab)
    entries = len(toxicity.Vectors(*model["terms"]).of(pa.array([texts[i] for i in model["ids"]]))[1])
    assert len(pickle.dumps({k: x for k, x in model.items() if k != "terms"})) < 8 * entries + 24 * len(model["ids"]) + 2000


def test_toxicity_needs_no_number_of_examples(spark):
    def corpus(n, each):
        bad = [i for i in range(n) if i % 5 == 0]
        word = {i: "foulish" if j % each == 0 else "rotten" for j, i in enumerate(bad)}
        return [prose(i, 30) + (f" {word[i]} {prose(i + 9000, 5)} {word[i]}" if i in word else "") for i in range(n)], word

    for n, each in ((60, 60), (600, 12)):  # fewer than 60 examples; an insult in few of many toxic ones
        texts, word = corpus(n, each)
        fresh = [prose(5000 + i, 30) + f" {w} {prose(7000 + i, 5)} {w}" for i, w in enumerate(["rotten", *["foulish"] * (each < 60)] * 3)]
        lab = spark.createDataFrame([(i, 1, int(i in word)) for i in range(n)], "doc_id long, quality int, toxic int")
        got = {r.doc_id: r.score for r in toxicity.score(spark, documents(spark, texts + fresh + [prose(8000 + i, 30) for i in range(20)]), lab).collect()}
        assert all(got[i] >= 0.5 for i in range(n, n + len(fresh))), n
        assert sum(got[i] >= 0.5 for i in range(n + len(fresh), n + len(fresh) + 20)) <= 1


@pytest.mark.parametrize("slack", [0, 0.02, 0.5, 9])
def test_block_max_search_is_exact(slack, monkeypatch):
    monkeypatch.setattr(toxicity, "SLACK", slack)
    r = np.random.default_rng(4)
    dense = np.zeros((500, 80))
    for i in range(500):
        t = r.choice(80, r.integers(0, 12), replace=False)
        dense[i, t] = r.random(len(t)) * np.where(t < 5, 9, 1)
        dense[i] /= max(1e-9, np.sqrt((dense[i] ** 2).sum()))
    dense[40:60] = dense[:20]
    row, terms = np.nonzero(dense)
    start, weights = np.searchsorted(row, np.arange(501)), dense[row, terms]
    index = toxicity.BlockMaxIndex(start, terms, weights, 80, block=16)
    assert 0 < len(index.matrix) < 80 and len(index.rows)
    base, spread = index.frequent(start, terms, weights), np.zeros(80)
    for i in range(0, 500, 7):
        here = slice(start[i], start[i + 1])
        rows, scores = index.search(terms[here], weights[here], 9, base[i], spread)
        want = dense.astype(np.float32).astype(float) @ dense[i]
        order = np.lexsort((np.arange(500), -np.round(want, 9)))[:9]
        order = order[want[order] > 0]
        assert rows.tolist() == order.tolist() and np.allclose(scores, want[order]) and not spread.any()


@pytest.mark.parametrize("matrix", [128 << 20, 3000, 0])
def test_toxicity_equals_brute_force(spark, monkeypatch, matrix):
    """Also where few or no frequent terms have room in the matrix."""
    monkeypatch.setattr(toxicity, "MATRIX_BYTES", matrix)
    r = random.Random(6)
    texts, toxic = [], []
    for i in range(160):
        bad = i % 3 == 0
        texts.append(" ".join(r.choice(["alpha,", "beta", "Gamma.", "delta", "epsilon", "zetas", "vile" if bad else "kind", f"w{i % 40}"]) for _ in range(r.randrange(1, 30))))
        toxic.append(int(bad != (i % 17 == 0)))
    texts[50], texts[51], texts[52] = texts[3], texts[3].upper(), texts[4]  # copies, and one labelled otherwise
    asked = texts + [None, "", "unheard of", "vile " * 40_000, "vile kind", "vile kind"]
    ids = [*range(len(asked) - 1), None]
    got = toxicity.score(spark, documents(spark, asked, ids), spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")).collect()
    assert len(got) == len(asked)

    def terms(text):
        out = collections.Counter()
        for chunk in (text or "").lower().split():
            if word := chunk.strip(toxicity.EDGES):
                out[word] += 1
                if len(word) >= 5:
                    out[word[:5] + "*"] += 1
        return out

    train = [i for i in range(160) if zlib.crc32(str(i).encode()) % 5]
    first = {}
    for i in train:
        first.setdefault((texts[i].lower(), toxic[i]), i)
    examples = sorted(first.values())
    bags = {i: terms(texts[i]) for i in examples}
    n, n1 = len(examples), sum(toxic[i] for i in examples)
    weight = {}
    for t in set().union(*bags.values()):
        c = [sum(t in bags[i] for i in examples if toxic[i] == y) for y in (0, 1)]
        if sum(c) >= 2:
            phi = abs(c[1] * (n - n1 - c[0]) - c[0] * (n1 - c[1])) / math.sqrt(n1 * (n - n1) * sum(c) * max(n - sum(c), 0.5))
            weight[t] = (math.log((1 + n) / (1 + sum(c))) + 1) * phi

    def vector(bag):
        v = {t: (1 + math.log(k)) * weight[t] for t, k in bag.items() if weight.get(t)}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    known = {i: vector(bags[i]) for i in examples}
    rate = sum(toxic[i] for i in train) / len(train)
    per_class = [sum(toxic[i] == y for i in train) / (n1 if y else n - n1) for y in (0, 1)]
    for row in got:
        text = "vile kind" if row.doc_id is None else asked[row.doc_id]
        v = vector(terms(text))
        near = sorted(((sum(x * known[i].get(t, 0) for t, x in v.items()), i) for i in examples if i != row.doc_id), reverse=True)
        near = [x for x in near if x[0] > 1e-6]
        assert np.allclose([x.similarity for x in row.neighbours], [s for s, _ in near[: toxicity.K]], atol=1e-5)
        assert all(abs(x.similarity - sum(w * known[x.doc_id].get(t, 0) for t, w in v.items())) < 1e-5 and x.label == toxic[x.doc_id] for x in row.neighbours)
        vague = toxicity.VAGUE * sum(per_class) / 2
        votes = [x.similarity * per_class[x.label] for x in row.neighbours]
        want = (sum(w * x.label for w, x in zip(votes, row.neighbours)) + vague * rate) / (sum(votes) + vague) if votes else rate
        assert abs(row.score - min(1, want)) < 1e-5
    assert toxicity.score(spark, documents(spark, []), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


# sharding (1)


def brute_shards(rows, limit):
    """rows: (bits as a string, bytes)."""
    out = {}

    def go(prefix, some):
        if sum(b for _, b in some) <= limit or len(some) == 1:
            out.update({r[0]: (prefix, sum(b for _, b in some)) for r in some})
            return
        for bit in "01":
            if part := [r for r in some if r[0][len(prefix)] == bit]:
                go(prefix + bit, part)

    go("", rows)
    return out


def test_sharding_equals_recursive_splitting(spark):
    texts = ["x" * n for n in random.Random(1).choices([0, 10, 100, 900], k=400)]
    got = sharding.assign(spark, documents(spark, texts), limit=2000).collect()
    bits = {i: format(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "060b") for i in range(400)}
    want = brute_shards([(bits[i], len(t)) for i, t in enumerate(texts)], 2000)
    assert {r.key: (r.shard, r.shard_bytes) for r in got} == {i: want[bits[i]] for i in range(400)}


@pytest.mark.parametrize("group", [0, 2, 5, 16])
def test_sharding_ranges_of_the_directory_are_found_on_executors(spark, group):
    r = random.Random(3)
    texts = ["x" * n for n in r.choices([0, 10, 100, 900, 7000], k=300)]
    ids = [0] * 60 + [*range(1, 241)]  # a fifth of the rows has one key
    docs = documents(spark, texts, ids)
    got = sharding.assign(spark, docs, limit=3000, group=group).collect()
    load = collections.defaultdict(list)
    for row in got:
        load[row.shard].append(row)
        assert row.depth == len(row.shard)
    sizes = collections.Counter()
    assert sorted(r.key for r in got) == sorted(ids)
    for shard, rows in load.items():
        sizes[rows[0].shard_bytes] += 1
        assert rows[0].shard_bytes <= 3000 or len(rows) == 1
    assert sum(k * v for k, v in sizes.items()) == sum(map(len, texts))
    shards = sorted(load)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:]))
    bits = {i: format(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "060b") for i in range(1, 241)}
    want = brute_shards([(bits[i], len(t)) for i, t in zip(ids, texts) if i] + [(format(int(hashlib.md5(b"0").hexdigest()[:15], 16), "060b"), sum(len(t) for i, t in zip(ids, texts) if not i))] * 1, 3000)
    assert all((r.shard, r.shard_bytes) == want[bits[r.key]] for r in got if r.key)


def test_sharding_writes_shards(spark, tmp_path):
    texts = ["x" * n for n in random.Random(5).choices([0, 10, 100, 900], k=60)] + [None, "é" * 50]
    docs = documents(spark, texts)
    back = sharding.sharded(spark, docs, f"file://{tmp_path}/shards", limit=2000)
    assert sorted((r.doc_id, r.text, r.key) for r in back.collect()) == sorted(((i, t, "k") for i, t in enumerate(texts)), key=lambda x: (x[0],))
    load = {r["_evs_shard"]: r.b for r in back.groupBy("_evs_shard").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("b")).collect()}
    assert len(load) > 3 and max(load.values()) <= 2000


def test_sharding_one_key_and_a_giant_row(spark):
    texts = ["y" * 100] * 90 + ["z" * 5000, None, ""]
    docs = documents(spark, texts, [7] * 90 + [8, None, None])
    rows = sharding.assign(spark, docs, limit=1000).collect()
    load = collections.Counter()
    for r in rows:
        load[r.shard] += 1
        assert r.shard_bytes <= 1000 or (r.key == 8 and r.shard_bytes == 5000)
    assert sum(load.values()) == 93
    shards = sorted(load)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:]))
    assert sharding.assign(spark, docs.limit(0), limit=10).count() == 0


# licenses (2)


def test_license_scan_finds_real_wordings(spark):
    def wrapped(text, n=9):
        words = text.split()
        return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))

    texts = [("MIT", "SPDX-License-Identifier: MIT"), ("GPL-3.0", "# SPDX-License-Identifier: GPL-3.0-or-later"), ("Apache-2.0", "Licensed under the Apache License,\nVersion 2.0."), ("MPL-2.0", licenses.TEMPLATES["MPL-2.0"]), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.")]
    texts += [(k, f"own words here\n\n{wrapped(v[0])}\n\nmore own prose") for k, v in licenses.FORMS.items() if len(v) > 1]
    got = collections.defaultdict(list)
    for r in licenses.scan(documents(spark, [t for _, t in texts])).collect():
        got[r.doc_id].append(r.license)
    assert [got[i] for i in range(len(texts))] == [[k] for k, _ in texts]


def test_license_scan_finds_all_notices_of_a_block(spark):
    gpl = "This work is licensed under the GNU General Public License, version"
    texts = {
        f"{gpl} 2.\nLicensed under the Apache License, Version 2.0.\nAll rights reserved.": ["Apache-2.0", "GPL-2.0", "Proprietary"],
        f"{gpl} 3. Released under the MIT License.": ["GPL-3.0", "MIT"],
        "All rights reserved. Licensed under CC BY-NC 4.0. Released under the MIT License.": ["CC-BY-NC-4.0", "MIT", "Proprietary"],
        f"{gpl} 3.": ["GPL-3.0"],
    }
    found = collections.defaultdict(list)
    for r in licenses.scan(documents(spark, list(texts))).collect():
        found[r.doc_id].append(r.license)
    assert [sorted(found[i]) for i in range(len(texts))] == list(texts.values())


def test_license_scan_finds_wording_and_rejects_others(spark):
    clean = ["the driver took his license out", "All rights are reserved seats", "version 2.0 of the apache helicopter", None, ""]
    notices = {
        "MIT": "Some prose. Released under the MIT License.\nMore prose",
        "Apache-2.0": "Licensed under the Apache License, version 2.0. See below.",
        "GPL-3.0": "x\nThis work is licensed under the GNU General Public License, version 3.",
        "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
        "Proprietary": "All rights reserved.",
    }
    texts = clean + list(notices.values())
    rows = licenses.scan(documents(spark, texts)).collect()
    assert {r.doc_id: r.license for r in rows} == {5 + i: k for i, k in enumerate(notices)}
    for r in rows:
        assert texts[r.doc_id][r.start : r.start + r.length] == r.block and r.reduction > 0


SHORT_NOTICES = {
    "Licensed under the MIT License.": ["MIT"], "MIT License": ["MIT"], "Licensed under the GNU GPL v3.": ["GPL-3.0"], "This project is released under the Apache License 2.0.": ["Apache-2.0"], "License: BSD-3-Clause": ["BSD-3-Clause"],
    "Dual licensed under the MIT and GPL-2.0 licenses.": ["GPL-2.0", "MIT"], "SPDX-License-Identifier: (MIT OR Apache-2.0)": ["Apache-2.0", "MIT"], "// SPDX-License-Identifier: MIT AND (BSD-3-Clause OR GPL-2.0-only)": ["BSD-3-Clause", "GPL-2.0", "MIT"],
    "This work is licensed under a Creative Commons Attribution 3.0 International License.": ["CC-BY-3.0"], "This is free and unencumbered software released into the public domain.": ["Unlicense"], "Distributed under the Boost Software License, Version 1.0.": ["BSL-1.0"],
    "Released under the BSD 3-Clause License. Mit der Zeit": ["BSD-3-Clause"], "he drove mit einer license": [], "licensed to kill under the bridge": [], "version 3 of the general terms": [],
}


def test_license_scan_of_short_notices_and_expressions(spark):
    found = collections.defaultdict(list)
    for r in licenses.scan(documents(spark, list(SHORT_NOTICES))).collect():
        found[r.doc_id].append(r.license)
    assert {t: sorted(found[i]) for i, t in enumerate(SHORT_NOTICES)} == SHORT_NOTICES


def plain_scan(text, templates):
    """Cut, ranked and chosen again by plain means: templates in the order of their own reductions, longest common subsequences where they stand closest."""
    import zstandard

    def size(data, template=None):
        more = {} if template is None else {"dict_data": zstandard.ZstdCompressionDict(template.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)}
        return len(zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(19, write_content_size=0, write_checksum=0, write_dict_id=0), **more).compress(data.encode()))

    def common(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        i, j, places = len(a), len(b), []
        while i and j:
            if a[i - 1] == b[j - 1] and best[i][j] == best[i - 1][j - 1] + 1:
                i, j = i - 1, j - 1
                places.append((i, j))
            elif best[i - 1][j] >= best[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return places[::-1]

    said = {k: licenses.words_of(v) for k, v in templates.items()}
    words, out = licenses.words_of(text), []
    while words:
        whole = " ".join(words)
        order = sorted((size(whole, " ".join(t)) / size(whole), k) for k, t in said.items())
        for _, k in order:
            t = said[k]
            if len(t) <= 3:
                at = [i for i in range(len(words)) if words[i : i + len(t)] == t]
                places = [(i, at[0] + i) for i in range(len(t))] if at else []
            else:
                most = len(common(t, words))
                spans = ((at, n) for n in range(most, len(words) + 1) for at in range(len(words) - n + 1))
                at, n = next((at, n) for at, n in spans if len(common(t, words[at : at + n])) == most)  # where they stand closest
                places = [(i, at + j) for i, j in common(t, words[at : at + n])]
            kept = {i for i, _ in places}
            if k not in out and len(places) >= 0.85 * len(t) and all(i in kept for i, w in enumerate(t) if re.search(r"\d", w)):
                out.append(k)
                gone = {j for _, j in places}
                words = [w for j, w in enumerate(words) if j not in gone]
                break
        else:
            break
    return out


def test_license_choice_equals_a_plain_version():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    r = random.Random(8)
    notices = list(licenses.TEMPLATES.values())
    several = 0
    for _ in range(60):
        text = " ".join(x for n in r.sample(notices, r.randrange(1, 4)) for x in (prose(r.randrange(99), r.randrange(4)), n))
        got = [name for name, *_ in scanner.scan_all(text)]
        assert got == plain_scan(text, licenses.TEMPLATES), text
        several += len(got) > 1
    assert several > 20


def test_compression_chooses_the_license(monkeypatch):
    """Both BSD texts are confirmed by the longer one's wording; without their reductions the choice is another."""
    scanner = licenses.Scanner({"a short form": licenses.BSD, "the long form": licenses.BSD + licenses.NAMES})
    assert scanner.scan(licenses.BSD + licenses.NAMES)[0] == "the long form" and scanner.scan(licenses.BSD)[0] == "a short form"
    monkeypatch.setattr(licenses.Scanner, "ranking", lambda self, block: sorted((0.0, k) for k in self.words))
    scanner = licenses.Scanner({"a short form": licenses.BSD, "the long form": licenses.BSD + licenses.NAMES})
    assert scanner.scan(licenses.BSD + licenses.NAMES)[0] == "a short form"


def test_a_template_without_usual_words_is_found(spark):
    rows = licenses.scan(documents(spark, ["lorem\nfree for any use by gnomes and dwarves\nipsum", "free for all"]), templates={"Gnome": "Free for any use by gnomes and dwarves"}).collect()
    assert [(r.doc_id, r.license, r.block) for r in rows] == [(0, "Gnome", "free for any use by gnomes and dwarves")]


def test_a_long_block_with_cues_in_every_line_is_scanned(spark):
    lines = ["Released under the MIT License and some rights"] * 3000 + ["Licensed under CC BY 4.0."] * 3000
    rows = licenses.scan(documents(spark, ["\n".join(lines)])).collect()
    assert sorted(r.license for r in rows) == ["CC-BY-4.0", "MIT"]


# sentence pieces (6)


def test_sentencepiece_parity_and_round_trip(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["" if t is None else t for t in ODD] + ["  two  blanks ", " lead", "trail ", "a\n\nb c", "日本語 text 😀 ümlaut", prose(3, 300), "x" * 5000]
    encoded = pieces.encode(documents(spark, [*texts, None]), path)
    for r in encoded.collect():
        t = texts[r.doc_id] if r.doc_id < len(texts) else ""
        want = library.encode(t)
        assert list(r.ids) == want and r.n_ids == len(want) and r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert r.parity and r.round_trip == (library.decode(want) == t), repr(t)
    decoded = {r.doc_id: r.text for r in pieces.decode(encoded, path).collect()}
    assert all(decoded[i] == t for i, t in enumerate(texts) if library.decode(library.encode(t)) == t)


def test_unigram_models_are_rebuilt_with_their_scores():
    words = [("<unk>", 0.0, pieces.UNKNOWN), ("▁", -3.0, pieces.NORMAL), ("▁ab", -1.0, pieces.NORMAL), ("a", -4.0, pieces.NORMAL), ("b", -4.0, pieces.NORMAL), ("abab", -2.0, pieces.NORMAL)]
    model = {"pieces": words, "type": pieces.UNIGRAM, "charsmap": b"", "dummy_prefix": True, "trim": False, "escape": True}
    tokenizer = pieces.rebuild(model)
    assert tokenizer.encode(" ab", add_special_tokens=False).tokens == ["▁ab"]
    assert tokenizer.encode(" abab", add_special_tokens=False).tokens == ["▁", "abab"]


# context-tree weighting (10)


def slow_ctw(train, text, depth):
    """Code length of text under the tree that training built, node by node."""
    counts = collections.defaultdict(lambda: [0, 0])
    for data in train:
        padded = b" " * depth + data
        for i, byte in enumerate(data):
            for bit in range(8):
                prefix = (1 << bit) | (byte >> (8 - bit))
                for d in range(depth + 1):
                    counts[padded[i + depth - d : i + depth], prefix][byte >> (7 - bit) & 1] += 1
    children = collections.defaultdict(set)
    for context, prefix in counts:
        if context:
            children[context[1:], prefix].add((context, prefix))
    memo = {}

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(node):
        if node not in memo:
            own = log_kt(*counts[node])
            below = sum(weighted(c) for c in children[node]) if len(node[0]) < depth else None
            total = own if below is None else np.logaddexp(own, below) - math.log(2)
            memo[node] = total, 1.0 if below is None else math.exp(own - math.log(2) - total)
        return memo[node][0]

    score, padded = 0.0, b" " * depth + text
    for i, byte in enumerate(text):
        for bit in range(8):
            prefix, one = (1 << bit) | (byte >> (8 - bit)), byte >> (7 - bit) & 1
            p = met = None
            for d in range(depth, -1, -1):
                node = padded[i + depth - d : i + depth], prefix
                a = counts[node] if node in counts else [0, 0]
                own = (a[one] + 0.5) / (sum(a) + 1)
                if p is None:
                    p = own
                elif node in counts:
                    weighted(node)
                    w = memo[node][1]
                    p = w * own + (1 - w) * (p if met else own)
                else:
                    p = own
                met = sum(a) > 0
            score += math.log10(p)
    return score


@pytest.mark.parametrize("few", [2048, 3])
def test_context_tree_equals_the_slow_tree(spark, monkeypatch, few):
    monkeypatch.setattr(ctw, "FEW", few)  # with 3, some contexts of two bytes are split
    monkeypatch.setattr(ctw, "TOP_WORDS", 5)
    monkeypatch.setattr(ctw, "TOP_GRAMS", 20)
    texts = ["the cat sat on the mat", "The dog sat", "a cat and a dog", None, "", "the\tthe\x0bthe  mat", "Été été", "zzz unseen words", "the cat", "the cat"] + [prose(i, 12, 30) for i in range(8)]
    rows = {r.doc_id: r for r in ctw.score(spark, documents(spark, texts), depth=3).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), "\n"] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = collections.Counter(w for p, h in zip(parts, held) if not h for w in p)
    n, v = sum(c.values()), len(c)
    train = [ctw.stream((t or "").encode()) for t, h in zip(texts, held) if not h]
    for i, p in enumerate(parts):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(p), sum(c[w] > 0 for w in p), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in p))
        assert r.score == pytest.approx(slow_ctw(train, ctw.stream((texts[i] or "").encode()), 3))


def test_context_tree_probabilities_sum_to_one(spark):
    """Over all bytes after one context."""
    data = b"abracadabra abracadabra "
    code, n = ctw.tally(ctw.grams([data], 2)[0])
    every = np.union1d(code, (ord("a") << 16 | ord("b") << 8) + np.arange(256))
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, code)] = n
    import pickle
    import types

    import pyarrow as pa

    batch = pa.record_batch([pa.array(every), pa.array(counts), pa.array(np.zeros(len(every), bool))], ["gram", "n", "hot"])
    roots = pa.Table.from_batches(list(ctw.subtree_roots(2)([batch])))
    shared = types.SimpleNamespace(value=pickle.dumps(ctw.tops(roots)))
    scored = pa.Table.from_batches(list(ctw.gram_scores(shared, 2)([batch])))
    key, score = scored.column("gram").to_numpy(), scored.column("score").to_numpy()
    assert (10 ** score[key >> 8 == (ord("a") << 8 | ord("b"))]).sum() == pytest.approx(1)


def test_context_tree_edge_tables(spark):
    assert ctw.score(spark, documents(spark, ["a"]).limit(0)).count() == 0
    only_held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = ctw.score(spark, documents(spark, ["ab", None], only_held)).collect()
    for r, size in zip(sorted(rows, key=lambda r: r.doc_id), (4, 1)):
        assert r.base_score == 0 and r.score == pytest.approx(-8 * size * math.log10(2)) and r.train_tokens == 0


def test_sentencepiece_ids_are_those_of_the_rebuilt_tokenizer():
    codes = pieces.Coder(public_tokenizers.path("piece_bpe_32k.model"))

    class Other:
        def encode(self, texts, num_threads=1):
            return [[7] for _ in texts]

        def decode(self, ids):
            return ""

    codes.library = Other()
    want = np.array(codes.tokenizer.encode(" some words", add_special_tokens=False).ids, "<u4").tobytes()
    for found in (codes.encode(["some words"]), codes.encode_whole(["some words"])):
        assert found[0][0] == want and not found[0][1]


# edge cases of several operators


def test_every_license_template_has_a_cue_and_is_found_alone():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.FORMS)
    for name, words in [(k, v) for k, v in licenses.TEMPLATES.items()] + [(k, x) for k, v in licenses.FORMS.items() for x in v]:
        (span,) = scanner.blocks(words)
        assert scanner.scan(words[slice(*span)])[0] == name, words


def test_license_scan_of_whole_texts(spark, tmp_path):
    from pathlib import Path

    folder = "/usr/share/common-licenses"
    forms = licenses.whole_texts(folder)
    if not forms:
        pytest.skip("no license texts on this machine")
    names = sorted(forms)
    docs = documents(spark, [f"{prose(i, 50)}\n\n{forms[n][0]}" for i, n in enumerate(names)])
    got = collections.defaultdict(set)
    for r in licenses.scan(docs, forms=forms).collect():
        got[r.doc_id].add(r.license)
    assert all(n in got[i] for i, n in enumerate(names)), (names, dict(got))
    assert licenses.whole_texts(str(tmp_path)) == {} and Path(folder).exists()


def test_license_scan_edge_rows(spark):
    two = "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."
    texts = [None, "", "no notice", two, two, "w " * 60_000 + "\nAll rights reserved."]
    rows = licenses.scan(documents(spark, texts, [0, 1, 2, 3, 3, None])).collect()
    found = collections.Counter((r.doc_id, r.license) for r in rows)
    assert found == {(3, "Apache-2.0"): 2, (3, "MIT"): 2, (None, "Proprietary"): 1}
    assert licenses.scan(documents(spark, [])).count() == 0


def test_maxscore_clashing_columns_and_repeats(spark):
    rows = [(50, [0.5, 0.25], 7, 7, "x", True), (50, [0.5, 0.25], 7, 7, "x", True), (1, [0.5, 0.5], 7, 7, "x", False), (None, [1.0, 1.0], 7, 7, "x", True)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row long, score long, v string, ask boolean")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in maxscore.top_k(spark, table, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == [(50, 1, 1, 24576), (50, 1, 1, 24576), (50, 2, 50, 20480), (50, 2, 50, 20480)]


def test_sentencepiece_edge_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    long = "straße und so " * 40_000
    texts = [long, long, None, ""]
    coded = pieces.encode(documents(spark, texts, [1, 1, None, 2]), path)
    rows = coded.collect()
    assert len({r.ids_crc32 for r in rows if r.doc_id == 1}) == 1 and sorted(r.n_ids for r in rows)[:2] == [0, 0]
    assert all(r.parity and r.round_trip for r in rows)
    back = sorted((str(r.doc_id), r.text) for r in pieces.decode(coded, path).collect())
    assert back == sorted([("1", long), ("1", long), ("None", ""), ("2", "")])
    assert pieces.encode(documents(spark, []), path).count() == 0


def test_templates_are_found_seven_levels_below_a_leaf(spark, monkeypatch):
    """128 templates in one leaf, two lines each, told apart by seven positions: none has enough constants above the seventh level."""
    monkeypatch.setattr(templates, "MIN_DOCS", 2)
    letters = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    lines = [" ".join(["all", "start", "alike", *(f"{'ab'[k >> i & 1]}{'xyzuvwt'[i]}" for i in range(7)), *(f"w{letters(k)}q{'mn'[copy]}{'rst'[i]}" for i in range(3))]) for k in range(128) for copy in range(2)]
    left = templates.cleaned(spark, documents(spark, [*lines, "all start alike but this one is not like any of the others here"])).collect()
    assert [r.doc_id for r in left if r.text] == [256] and sum(r._evs_dropped for r in left) == 256


def test_templates_repeated_rows_null_ids_and_long_lines(spark):
    line = "x" * 300_000 + " " + "y " * 60
    texts = ["a line that recurs\nown " + str(i) for i in range(12)] + [line, line, None, None]
    ids = [*range(11), 10, None, None, None, None]
    rows = templates.cleaned(spark, documents(spark, texts, ids)).collect()
    assert len(rows) == 16 and all("recurs" not in (r.text or "") for r in rows)
    assert sum(r.text == line for r in rows) == 2  # null ids are one document, which keeps its long line
    assert templates.cleaned(spark, documents(spark, [])).count() == 0


def test_context_tree_long_and_repeated_texts(spark):
    long = prose(3, 60_000)
    rows = ctw.score(spark, documents(spark, [long, "one two", "one two", None], [4, 9, 9, None])).collect()
    assert len(rows) == 4
    same = [r for r in rows if r.doc_id == 9]
    assert same[0] == same[1]
    assert all(math.isfinite(r.score) and r.score < 0 and r.base_score < 0 for r in rows)
    assert next(r.n_tokens for r in rows if r.doc_id == 4) == 60_001
