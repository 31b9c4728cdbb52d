"""Operators 11 to 13 against brute force, and on nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest

from evalsieve.llm import media, spelling, whitening

DOCS = "doc_id long, text string, word string, n long, id long, kind string, v string, media string"


def documents(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "w", 1, 7, "k", "v", "m") for i, t in zip(ids, texts)], DOCS)


# spelling variants (11)


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, least=7, twice=2, every=31, ratio=10):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    n = {w: k for w, k in counts.items() if len(w) >= least and k >= twice}
    around = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(around[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(around[w]), n[form[w]] if form[w] else None) for w in n), key=str)


def found(spark, rows, **more):
    got = spelling.variants(spark, documents(spark, [t for _, t in rows], [i for i, _ in rows]), **more)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("letters", ["ab", "abcé"])
def test_variants_equal_brute_force(spark, letters):
    r = random.Random(len(letters))
    words = ["".join(r.choice(letters) for _ in range(r.choice([6, 7, 7, 8, 8, 9]))) for _ in range(120)]
    weights = [r.choice([1, 1, 2, 20, 20, 300]) for _ in words]
    rows = [(i, " ".join(r.choices(words, weights, k=60))) for i in range(120)] + [(None, " ".join(words[:20]) + " ABABABAB"), (5, words[0]), (5, words[0])]
    want = brute_variants(rows)
    assert found(spark, rows) == want
    assert any(w[1] for w in want)


def test_forms_are_followed_to_their_end(spark):
    chain = {"lmnopqrs": 5000, "lmnopqrt": 400, "lmnopqtt": 30, "lmnoptt": 2}
    rows = [(i, " ".join([w] * k)) for i, (w, k) in enumerate(chain.items(), 31)]
    want = brute_variants(rows)
    assert found(spark, rows) == want
    assert {w[0]: w[1:3] for w in want} == {"lmnopqrs": (None, "lmnopqrs"), "lmnopqrt": ("lmnopqrs",) * 2, "lmnopqtt": ("lmnopqrt", "lmnopqrs"), "lmnoptt": ("lmnopqtt", "lmnopqrs")}


def test_variants_ties_go_to_the_smallest_word(spark):
    """Equal frequencies in every kind of group: masked words, longer words, shorter ones, and between groups."""
    base = "mmmmmmmm"
    around = {base[:i] + c + base[i + 1 :] for i in range(8) for c in "azé"} | {base[:i] + c + base[i:] for i in range(9) for c in "azmé"} | {base[1:]}
    for seed in range(3):
        r = random.Random(seed)
        some = r.sample(sorted(around), 12)
        rows = [(i, " ".join([w] * 30)) for i, w in enumerate(some)] + [(1000, f"{base} {base}")]
        assert found(spark, rows) == brute_variants(rows)


def test_variants_odd_rows_and_long_words(spark):
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(3000))
    texts = [None, "", " \n ", "short words only", "x" * 7, long + " " + long, long[:1500] + "z" + long[1501:] + " " + long[:1500] + "z" + long[1501:], "Été" * 3 + " straße " * 40, "naïve×thing " * 3, "null\x00byteword nullbyteword nullbyteword"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "xxxxxxx"), (7, "straßen straßen")]
    assert found(spark, rows) == brute_variants(rows)
    assert spelling.variants(spark, documents(spark, [], [])).count() == 0
    assert spelling.variants(spark, documents(spark, [None, "tiny"])).count() == 0


def test_group_names_tell_groups_apart():
    words = ["abababab", "babababa", "aaaaaaaa", "abcdefgh"]
    points = np.array([[ord(c) for c in w] for w in words], np.uint64)
    for seed in spelling.SEEDS:
        own, cut, wild = spelling.group_names(points, seed)
        seven = spelling.group_names(points[:, :7], seed)[0]
        for k, w in enumerate(words):
            shorter = np.array([[ord(c) for c in w[:i] + w[i + 1 :]] for i in range(8)], np.uint64)
            assert (spelling.group_names(shorter, seed)[0] == cut[k]).all()
            assert cut[k, 7] == seven[k] and wild[k, 7] != seven[k]
        assert len(set(wild.ravel().tolist())) == wild.size


def test_normalised_words_of_documents(spark):
    docs = documents(spark, ["Elephant " * 40, "elephamt elephamt elephants"], [3, 4])
    forms = spark.createDataFrame([("elephamt", "elephant"), ("elephant", "elephant")], "word string, root string")
    assert [tuple(r) for r in spelling.normalised(spark, docs, forms).collect()] == [(4, "elephamt", "elephant", 2)]


# whitening (12)


def brute_whitening(vectors, most=32):
    """n, S, deviations, covariance of the whole numbers, and eigenvalues, by Python's integers and plain numpy."""
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors]
    n, total = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, total)) for row in x]
    y = np.array([[(n * a - s) / n for a, s in zip(row, total)] for row in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return n, deviation, y, values[::-1], vectors[:, ::-1].T


VECTORS = "vec_id long, embedding array<float>, label int, v string, component int, n long"


def test_whitening_equals_numpy(spark):
    r = np.random.default_rng(2)
    mix = r.normal(size=(40, 40))
    data = (r.normal(size=(700, 40)) @ mix * 3 + r.normal(size=40) * 50).astype(np.float32)
    rows = [(i, [float(c) for c in v], 1, "v", 2, 3) for i, v in enumerate(data)]
    odd = [(900, None, 1, "v", 2, 3), (901, [None] * 40, 1, "v", 2, 3), (902, [float("nan")] * 40, 1, "v", 2, 3), (903, [float("-inf")] + [0.0] * 39, 1, "v", 2, 3), (904, [], 1, "v", 2, 3), (905, [3e38] * 40, 1, "v", 2, 3)]
    got = whitening.whiten(spark, spark.createDataFrame(rows + odd, VECTORS).repartition(5)).toPandas()
    n, deviation, y, values, axes = brute_whitening(data)
    assert len(got) == 700 * 32 and (got.n == 700).all() and sorted(got.component.unique()) == list(range(1, 33))
    assert got.groupby("vec_id").deviation.nunique().max() == 1
    assert got[got.component == 1].set_index("vec_id").deviation.to_dict() == dict(enumerate(deviation))
    z = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = y @ axes[:32].T / np.sqrt(values[:32])
    for k in range(32):
        assert min(abs(z[:, k] - s * want[:, k]).max() for s in (1, -1)) < 1e-9
    assert np.allclose(got[got.vec_id == 0].sort_values("component").explained, values[:32] / values.sum(), rtol=1e-10)
    error = abs(z.T @ z / n - np.eye(32)).max()
    assert got.identity_error.nunique() == 1 and got.identity_error[0] <= 1e-9 and abs(got.identity_error[0] - error) < 1e-12


def test_whitening_edge_rows(spark):
    """Dependent and constant dimensions, several lengths, repeats, null ids, one row, none."""
    rows = [(i, [float(i), 2.0 * i, 5.0], 1, "v", 2, 3) for i in range(6)] + [(None, [9.0, 18.0, 5.0], 1, "v", 2, 3)] * 2 + [(50 + i, [float(i * i), 1.0], 1, "v", 2, 3) for i in range(4)] + [(99, [1.0], 1, "v", 2, 3)]
    got = whitening.whiten(spark, spark.createDataFrame(rows, VECTORS)).toPandas()
    three = got[got.n == 8]
    assert len(three) == 24 and three.vec_id.isna().sum() == 6
    live = three[three.component == 1]
    assert abs(live.whitened.mean()) < 1e-12 and abs((live.whitened**2).mean() - 1) < 1e-12
    assert three[three.component > 1].whitened.isna().all() and (abs(live.explained - 1) < 1e-12).all()
    two = got[got.n == 4]
    assert len(two) == 8 and abs((two[two.component == 1].whitened ** 2).mean() - 1) < 1e-12
    one = got[got.n == 1]
    assert len(one) == 1 and one.whitened.isna().all() and one.explained.isna().all() and one.deviation.iloc[0] == 0 and one.identity_error.iloc[0] == 0
    assert whitening.whiten(spark, spark.createDataFrame([], VECTORS)).count() == 0


def test_whitening_beyond_64_bits(spark):
    big = float(2.0**55)
    rows = [(i, [big * (i % 3), float(i)], 1, "v", 2, 3) for i in range(9)]
    got = whitening.whiten(spark, spark.createDataFrame(rows, VECTORS)).toPandas()
    n, deviation, *_ = brute_whitening([v for _, v, *_ in rows])
    assert max(deviation) >= 1 << 63
    said = got[got.component == 1].set_index("vec_id").deviation
    assert all((said[i] == d) if d < 1 << 63 else said.isna()[i] for i, d in enumerate(deviation))


# media (13)

ODD = [b"", b"a", b"x" * 63, b"y" * 64, b"z" * 65, b"\x00" * 300, bytes(range(256)) * 3, b"\x80" * 6400, (b"\x80" * 50 + b"A") * 40, b"\xff" * 5000, b"the quick brown fox " * 9000]


def test_pictures_hold_their_payload():
    payloads = [media.padded(t) for t in ODD]
    rows = media.looked_at(media.pictures(payloads, [len(t) for t in ODD]))
    for t, p, row in zip(ODD, payloads, rows):
        assert len(p) % 64 == 0 and p.startswith(t) and 0 < len(p) and len(p) - len(t) <= 64
        assert row.get("error") is None
        assert (row["n_bytes"], row["payload_bytes"]) == (len(t), len(p))
        assert row["payload_sha256"] == hashlib.sha256(p).hexdigest() and row["tail_crc32"] == zlib.crc32(p[-64:])
        blocks = row["thumbnail_width"] * row["thumbnail_height"]
        assert row["thumbnail"][: len(p) // 64] == p[::64] and set(row["thumbnail"][len(p) // 64 :]) <= {128} and blocks - len(p) // 64 < row["thumbnail_width"]
        assert (row["width"], row["height"]) == (8 * row["thumbnail_width"], 8 * row["thumbnail_height"])


def test_pictures_of_random_bytes_in_small_and_large_steps(monkeypatch):
    r = random.Random(4)
    payloads = [media.padded(bytes(r.choices([128, 127, 129, 0, 255, 97, 32], [r.random() ** 3 + 1e-6 for _ in range(7)], k=r.randrange(1, 9000)))) for _ in range(40)]
    large = media.pictures(payloads, [0] * 40)
    monkeypatch.setattr(media, "AT_ONCE", 3000)
    assert media.pictures(payloads, [0] * 40) == large
    assert [x["payload_sha256"] for x in media.looked_at(large)] == [hashlib.sha256(p).hexdigest() for p in payloads]


class Bits:
    """A plain writer of one bit after another, as a second opinion."""

    def __init__(self):
        self.bits = []

    def put(self, code, n):
        self.bits += [code >> (n - 1 - i) & 1 for i in range(n)]

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def plain_tables(n_long):
    """DC codes of four bits; AC codes of eight, `n_long` of the symbols with sixteen."""
    symbols = [0x00, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11)]
    return media.canonical({s: 4 for s in range(12)}), media.canonical({s: 16 if k >= len(symbols) - n_long else 8 for k, s in enumerate(symbols)})


def put_block(out, block, before, dc, ac):
    def number(v):
        size = abs(v).bit_length()
        return size, v if v >= 0 else v + (1 << size) - 1

    size, extra = number(block[0] - before)
    out.put(*dc[size])
    out.put(extra, size)
    run = 0
    for v in block[1:]:
        if not v:
            run += 1
            continue
        while run > 15:
            out.put(*ac[0xF0])
            run -= 16
        size, extra = number(v)
        out.put(*ac[run << 4 | size])
        out.put(extra, size)
        run = 0
    if run:
        out.put(*ac[0])
    return block[0]


def plain_jpeg(width, height, factors, interval, together, seed, n_long=60):
    """A baseline JPEG with random coefficients, written symbol by symbol, and its components' blocks as own rows and columns."""
    r = random.Random(seed)
    (dc_says, dc), (ac_says, ac) = plain_tables(n_long)
    most_h, most_v = max(h for h, _ in factors), max(v for _, v in factors)
    wide, high = -(-width // (8 * most_h)), -(-height // (8 * most_v))

    def block():
        return [r.randrange(-800, 800)] + [r.choice([0] * 30 + [1, -1, 5, -700, 999, -2]) for _ in range(63)]

    grids = [[[block() for _ in range(wide * h)] for _ in range(high * v)] for h, v in factors]
    own = [(-(-(-(-width * h // most_h)) // 8), -(-(-(-height * v // most_v)) // 8)) for h, v in factors]
    out = b"\xff\xd8" + media.segment(0xDB, b"\0" + bytes([3] + [1] * 63)) + media.segment(0xC0, struct.pack(">BHHB", 8, height, width, len(factors)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors)))
    out += media.segment(0xC4, b"\x00" + dc_says + b"\x10" + ac_says) + (media.segment(0xDD, struct.pack(">H", interval)) if interval else b"")
    for scan in [range(len(factors))] if together else [[i] for i in range(len(factors))]:
        if len(scan) == 1:
            mcus = [[(scan[0], y, x)] for y in range(own[scan[0]][1]) for x in range(own[scan[0]][0])]
        else:
            mcus = [[(i, y * factors[i][1] + b, x * factors[i][0] + a) for i in scan for b in range(factors[i][1]) for a in range(factors[i][0])] for y in range(high) for x in range(wide)]
        out += media.segment(0xDA, bytes([len(scan)]) + b"".join(bytes([i + 1, 0]) for i in scan) + b"\0\x3f\0")
        parts = []
        for start in range(0, len(mcus), interval or len(mcus)):
            bits, before = Bits(), collections.Counter()
            for i, y, x in itertools.chain.from_iterable(mcus[start : start + (interval or len(mcus))]):
                before[i] = put_block(bits, grids[i][y][x], before[i], dc, ac)
            parts.append(bits.bytes())
        out += b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(parts) else b"") for k, p in enumerate(parts))
    return out + b"\xff\xd9", grids, own


SHAPES = [(61, 45, [(2, 2), (1, 1), (1, 1)], 0, True), (61, 45, [(2, 1), (1, 1), (1, 1)], 3, True), (70, 20, [(1, 1), (1, 1), (1, 1)], 2, False), (8, 8, [(1, 1)], 0, True), (33, 70, [(2, 2)], 4, True), (64, 64, [(1, 1), (2, 2), (1, 2), (1, 1)], 5, True)]


def test_any_baseline_picture_is_decoded():
    made = [plain_jpeg(*shape, seed) for seed, shape in enumerate(SHAPES)]
    parsed = [media.parse(p) for p, _, _ in made]
    media.decode(parsed)
    for p, (_, grids, own), (width, height, factors, *_) in zip(parsed, made, SHAPES):
        assert p.error is None and (p.width, p.height) == (width, height)
        for c, grid, (w, h) in zip(p.components, grids, own):
            assert c.blocks[:h, :w].tolist() == [[b for b in row[:w]] for row in grid[:h]]
        small = media.thumbnail(p)
        want = [[min(255, max(0, (b[0] * 3 + 1024 + 4) >> 3)) for b in row[: own[0][0]]] for row in grids[0][: own[0][1]]]
        assert small.tolist() == want


def test_damaged_pictures_say_so():
    good = media.pictures([media.padded(b"hello world " * 200)], [2400])[0]
    truth = media.looked_at([good])[0]
    sof = good.index(b"\xff\xc0")
    bad = [None, b"", b"text", good[:40], good[: sof + 4], good[:-2], good[: len(good) // 2], good.replace(b"\xff\xc0", b"\xff\xc2"), good[: sof + 4] + b"\x0c" + good[sof + 5 :], good[:-80] + good[-2:], good.replace(b"\xff\xd0", b""), b"\xff\xd8\xff\xd9"]
    rows = media.looked_at([good, *bad, good])
    assert rows[0] == rows[-1] == truth
    assert all(r["error"] and "width" not in r for r in rows[1:-1])
    r = random.Random(6)
    for _ in range(150):  # damage anywhere changes no other picture and never crashes
        at = r.randrange(len(good))
        broken = good[:at] + bytes([r.randrange(256)]) + good[at + 1 :]
        assert media.looked_at([good, broken, good])[::2] == [truth, truth]


def test_hashes_are_close_for_close_pictures():
    ramp = np.add.outer(np.arange(40), np.arange(60)).astype(np.uint8)
    other = ramp.copy()
    other[3, 4] += 9
    far = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert all(far(a, b) <= 2 for a, b in zip(media.hashes(ramp), media.hashes(other)))
    assert all(far(a, b) >= 30 for a, b in zip(media.hashes(ramp), media.hashes(ramp[::-1, ::-1])))
    assert media.hashes(np.zeros((1, 1), np.uint8)) == ("0" * 16, "0" * 16)


def test_media_columns(spark):
    texts = [None, "", "one", "straße ÉTÉ", "long " * 40000, "one"]
    docs = documents(spark, texts, [0, 1, 2, 3, 4, None])
    rows = {r.doc_id: r for r in media.read(media.stored(docs)).collect()}
    assert len(rows) == 6
    for i, t in zip([0, 1, 2, 3, 4, None], texts):
        p = media.padded((t or "").encode())
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), None)
    same = lambda a, b: a.asDict() | {"doc_id": 0} == b.asDict() | {"doc_id": 0}
    assert same(rows[0], rows[1]) and same(rows[2], rows[None])
    assert media.read(media.stored(docs.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (2, bytearray(b"no"), "x")], "doc_id long, media binary, error string")
    assert {r.doc_id: (r.error, r.media_bytes) for r in media.read(odd).collect()} == {1: ("null", None), 2: ("no JPEG", 2)}
