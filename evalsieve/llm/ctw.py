"""Language-model scores by context-tree weighting (operator 10).

A text is its tokens: words between ASCII white space, A-Z lower-cased, then one end. As a stream of bytes a word is
its bytes and a blank, the end a line feed, and each byte is eight binary decisions, highest bit first. The context of
a decision is the byte's bits so far and up to DEPTH bytes of the stream before it (blanks before the start). Every
context of every depth holds a Krichevsky-Trofimov estimate of the training texts' bits; its weighted probability is
the mean of that estimate and of the product of its one byte longer contexts, as context-tree weighting has it. The
tree is frozen after training: a decision's probability mixes the estimates along its path by their weights; contexts
that training never met pass the estimate of the deepest one it met.

Partitions count their words and their byte grams (a context of DEPTH bytes and the byte after it), and the counts are
added up; the tree is computed from distinct grams, subtrees below two bytes of context apart. Contexts of two bytes with
more than one in SHARE of all grams (and more than FEW) are split once more, by their third byte, so no subtree is far
larger than the others; there are fewer than SHARE of them. What remains on the driver has at most 255 nodes for each of
these and 256 * 255 others, whatever the input. Looking words and grams up in texts goes in two steps at every size: the
TOP_WORDS and TOP_GRAMS most frequent ones are broadcast, and the others, of which none is frequent, are joined by an
ordinary shuffle.

Defined results: null text counts as empty and consists of the end alone; a null doc_id is a training row. Repeated
rows count and are scored each. Without training rows every decision has probability 1/2.
"""

from __future__ import annotations

import pickle
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, text_or_empty, written

DEPTH, TOP_WORDS, TOP_GRAMS = 5, 200_000, 1 << 20
SHARE, FEW = 4096, 2048
END, BLANK = b"\n", b" "
AT_ONCE = 300_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    """Words, then the end."""
    return [*text.lower().split(), END]


def count_words(batches):
    """(text, train) -> (word, n): a word's training count; held-out words come with 0."""
    counts, others = Counter(), set()

    def flush():
        words = [*counts, *(w for w in others if w not in counts)]
        n = np.zeros(len(words), np.int64)
        n[: len(counts)] = list(counts.values())
        for at in range(0, len(words), 50_000):
            yield pa.record_batch([pa.array(words[at : at + 50_000], pa.binary()), pa.array(n[at : at + 50_000])], ["word", "n"])
        counts.clear()
        others.clear()

    for b in slices(batches):
        for text, train in zip(b.column("text").to_pylist(), b.column("train").to_pylist()):
            (counts if train else others).update(tokens(text))
            if len(counts) + len(others) > AT_ONCE:
                yield from flush()
    yield from flush()


def stream(text: bytes) -> bytes:
    words = text.lower().split()
    return BLANK.join(words) + BLANK + END if words else END


def grams(streams: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(context << 8 | byte) of every byte of the streams, one after another, and how many each stream has."""
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    pad = BLANK * depth
    data = np.frombuffer(pad + pad.join(streams), np.uint8)
    code = np.zeros(len(data) - depth, np.int64)
    for i in range(depth + 1):
        code <<= 8
        code |= data[i : len(data) - depth + i]
    inside = np.ones(len(code), bool)  # windows that end in the padding between two streams are none
    gaps = np.cumsum(sizes + depth)[:-1] - depth
    inside[(gaps[:, None] + np.arange(depth)).ravel()] = False
    return code[inside], sizes


def tally(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = np.sort(code)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
    return code[first], np.diff(np.r_[first, len(code)])


def count_grams(depth: int):
    """(text, train) -> (gram, n): a gram's training count; held-out grams come with 0."""

    def run(batches):
        codes, counts, held = [], [], 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            code, back = np.unique(np.concatenate(codes), return_inverse=True)
            return code, np.bincount(back, np.concatenate(counts), len(code)).astype(np.int64)

        for b in slices(batches):
            texts, train = b.column("text").to_pylist(), b.column("train").to_pylist()
            for kind in (True, False):
                if streams := [stream(t) for t, k in zip(texts, train) if k is kind]:
                    code, n = tally(grams(streams, depth)[0])
                    codes.append(code)
                    counts.append(n if kind else np.zeros_like(n))
                    held += len(code)
            if held > 3_000_000:
                code, n = total()
                codes, counts, held = [code], [n], len(code)
                if held > 1_500_000:
                    yield pa.record_batch([pa.array(code), pa.array(n)], ["gram", "n"])
                    codes, counts, held = [], [], 0
        if codes:
            code, n = total()
            yield pa.record_batch([pa.array(code), pa.array(n)], ["gram", "n"])

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5, by Stirling's series eight steps up."""
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Level:
    """The nodes of one depth and one bit position: keys, counts, weighted probabilities, weights of their own estimates."""

    def __init__(self, key: np.ndarray, n: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.key, self.n, self.n1 = key, n, n1
        own = log_kt(n - n1, n1)
        self.weighted = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.weight = np.ones(len(key)) if below is None else np.exp(own - np.log(2) - self.weighted)


def levels(code: np.ndarray, n: np.ndarray, depth: int, low: int) -> dict[tuple[int, int], Level]:
    """All nodes from depth down to low, by (depth, bit): from sorted grams and their counts."""
    found: dict[tuple[int, int], Level] = {}
    for d in range(depth, low - 1, -1):
        if d < depth:
            code, back = np.unique(code & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
            n = np.bincount(back, n, len(code))
        for bit in range(8):
            prefix = code >> (8 - bit)
            first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
            key = prefix[first]
            all_n = np.add.reduceat(n, first).astype(float)
            ones = np.add.reduceat(n * (code >> (7 - bit) & 1), first).astype(float)
            below = None
            if d < depth:
                child = found[d + 1, bit]
                parent = np.searchsorted(key, child.key & ((1 << 8 * d + bit) - 1))
                below = np.bincount(parent, child.weighted, len(key))
            found[d, bit] = Level(key, all_n, ones, below)
    return found


def read_grams(batches) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(depth of the subtrees' roots, grams in order, counts) of a task's split contexts and of all others."""
    some = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "n", "hot")] for b in batches if b.num_rows]
    if not some:
        return []
    code, n, hot = (np.concatenate(x) for x in zip(*some))
    order = np.argsort(code)
    code, n, hot = code[order], n[order], hot[order]
    return [(low, code[at], n[at]) for low, at in ((2, ~hot), (3, hot)) if at.any()]


def subtree_roots(depth: int):
    """(gram, n, hot), whole subtrees together -> the nodes above them, with what they add: (level, key, bit, n, n1, below)."""

    def run(batches):
        for low, code, n in read_grams(batches):
            found = levels(code, n, depth, low)
            for bit in range(8):
                x = found[low, bit]
                key, back = np.unique(x.key & ((1 << 8 * (low - 1) + bit) - 1), return_inverse=True)
                sums = [np.bincount(back, v, len(key)) for v in (x.n, x.n1, x.weighted)]
                yield pa.record_batch([pa.array(np.full(len(key), low - 1)), pa.array(key), pa.array(np.full(len(key), bit)), *map(pa.array, sums)], ["level", "key", "bit", "n", "n1", "below"])

    return run


def tops(rows) -> dict[tuple[int, int], Level]:
    """The nodes of depths 1 and 0, and of depth 2 in split contexts, from an Arrow table of what lies below them."""
    found = {}
    level, key, bit, n, n1, below = (rows.column(c).to_numpy() for c in ("level", "key", "bit", "n", "n1", "below"))
    for b in range(8):

        def summed(keys, parts):
            k, back = np.unique(keys, return_inverse=True)
            return Level(k, *(np.bincount(back, v, len(k)) for v in parts))

        mine = np.flatnonzero((bit == b) & (level == 2))
        two = found[2, b] = summed(key[mine], (n[mine], n1[mine], below[mine]))
        mine = np.flatnonzero((bit == b) & (level == 1))
        up = two.key & ((1 << 8 + b) - 1)
        one = found[1, b] = summed(np.r_[key[mine], up], [np.r_[x[mine], y] for x, y in ((n, two.n), (n1, two.n1), (below, two.weighted))])
        found[0, b] = summed(one.key & ((1 << b) - 1), (one.n, one.n1, one.weighted))
    return found


def gram_scores(shared, depth: int):
    """(gram, n, hot), whole subtrees together -> (gram, n, score): log10 of the byte's probability in its context."""

    def run(batches):
        top = None
        for low, code, n in read_grams(batches):
            top = top or pickle.loads(shared.value)
            found = top | levels(code, n, depth, low)
            total = np.zeros(len(code))
            for bit in range(8):
                one = (code >> (7 - bit) & 1).astype(float)
                prefix, p, met = code >> (8 - bit), None, None
                for d in range(depth, -1, -1):
                    x = found[d, bit]
                    at = np.searchsorted(x.key, prefix & ((1 << 8 * d + bit) - 1))
                    seen, n1 = x.n[at], x.n1[at]
                    own = (np.where(one > 0, n1, seen - n1) + 0.5) / (seen + 1)
                    p = own if p is None else x.weight[at] * own + (1 - x.weight[at]) * np.where(met, p, own)
                    met = seen > 0
                total += np.log10(p)
            for at in range(0, len(code), 200_000):
                yield pa.record_batch([pa.array(x[at : at + 200_000]) for x in (code, n, total)], ["gram", "n", "score"])

    return run


class GramTable:
    """Values of a fixed set of grams, in open addressing with at least four slots for each gram."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys) - 1).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        slot = self.slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            got = self.keys[slot] == keys
            self.values[slot[got]] = values[got]
            keys, values, slot = keys[~got], values[~got], slot[~got] + 1 & self.last

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 for unknown grams) and which grams are known."""
        slot = self.slot(keys)
        met = self.keys[slot]
        known = met == keys
        value = np.where(known, self.values[slot], 0.0)
        open_ = np.flatnonzero(~known & (met >= 0))
        slot = slot[open_]
        while len(open_):
            slot = slot + 1 & self.last
            met = self.keys[slot]
            hit = met == keys[open_]
            known[open_[hit]] = True
            value[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (met >= 0)
            open_, slot = open_[go], slot[go]
        return value, known


def score_texts(shared, depth: int):
    """(doc_id, held_out, text) -> a row per text: its sums over frequent words and grams, its other words and grams."""

    def run(batches):
        words, known, base, keys, values = pickle.loads(shared.value)
        get = dict(zip(words.to_pylist(), range(len(words)))).get
        table = GramTable(keys, values)
        row = TaskContext.get().partitionId() << 33
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            columns: list[list] = [[], [], [], [], []]
            for text in texts:
                parts = tokens(text)
                at = np.fromiter(map(get, parts, repeat(-1)), np.int64, len(parts))
                found = at[at >= 0]
                for column, x in zip(columns, (row, len(parts), int(known[found].sum()), float(base[found].sum()), [parts[i] for i in np.flatnonzero(at < 0)])):
                    column.append(x)
                row += 1
            code, sizes = grams([stream(t) for t in texts], depth)
            value, hit = table.get(code)
            doc = np.repeat(np.arange(len(texts)), sizes)
            lost = np.bincount(doc[~hit], minlength=len(texts))
            score = np.add.reduceat(value, np.r_[0, sizes.cumsum()[:-1]])
            rare = pa.ListArray.from_arrays(pa.array(np.r_[0, lost.cumsum()], pa.int32()), pa.array(code[~hit]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()))
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), *(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(score), rare], ["doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "words", "score", "grams"])

    return run


def tree_scores(spark: SparkSession, texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, n, score) for every gram of texts (text binary, train boolean), learnt from those with train."""
    counted = texts.mapInArrow(count_grams(depth), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = written(spark, counted, "grams")
    total = counted.count()
    parts = max(spark.sparkContext.defaultParallelism, total // 1_000_000)
    two = F.shiftright("gram", 8).bitwiseAND(0xFFFF)
    limit = max(FEW, total // SHARE) if depth > 2 else total
    hot = written(spark, counted.groupBy(two.alias("two")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > limit).select("two", F.lit(True).alias("hot")), "hot_contexts")
    known = counted.withColumn("two", two).join(F.broadcast(hot), "two", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    together = known.repartition(parts, "two", F.when(F.col("hot"), F.shiftright("gram", 24).bitwiseAND(0xFF))).select("gram", "n", "hot")
    roots = together.mapInArrow(subtree_roots(depth), "level long, key long, bit long, n double, n1 double, below double").groupBy("level", "key", "bit").agg(*[F.sum(c).alias(c) for c in ("n", "n1", "below")])
    top = spark.sparkContext.broadcast(cloudpickle.dumps(tops(roots.toArrow())))
    return written(spark, together.mapInArrow(gram_scores(top, depth), "gram long, n long, score double"), "gram_scores")


def most_frequent(counted: DataFrame, most: int):
    """The rows of greatest n, `most` at most, as an Arrow table: those above a count that a histogram gives.

    The histogram has 64 steps for each doubling of n, so the driver sees a few thousand sums and no task sorts all rows.
    """
    step = F.coalesce(F.floor(F.log2("n") * 64), F.lit(-1)).cast("int")
    room, least = most, None
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r.step):
        room -= r.c
        if room < 0:
            break
        least = r.step
    return counted.where(step >= least if least is not None else F.lit(False)).toArrow()


def score(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), text_or_empty(text_col).cast("binary").alias("text"))
    learnt = texts.select("text", (~F.col("held_out")).alias("train"))
    words = written(spark, learnt.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n, v = total.n or 0, total.v or 0
    words = words.select("word", "n", (F.col("n") > 0).cast("long").alias("known"), F.log10((F.col("n") + 1) / F.lit(float(n + v + 1))).alias("base"))
    scored = tree_scores(spark, learnt, depth)

    often = most_frequent(words, TOP_WORDS)
    common = most_frequent(scored, TOP_GRAMS)
    shared = spark.sparkContext.broadcast(cloudpickle.dumps((often.column("word").combine_chunks(), *(often.column(c).to_numpy() for c in ("known", "base")), *(common.column(c).to_numpy() for c in ("gram", "score")))))
    half = texts.mapInArrow(score_texts(shared, depth), "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base_score double, words array<binary>, score double, grams array<long>")
    half = written(spark, half, "half")
    by_word = half.select("row", F.explode("words").alias("word")).join(words.drop("n"), "word").groupBy("row").agg(F.sum("known").alias("k"), F.sum("base").alias("b"))
    by_gram = half.select("row", F.explode("grams").alias("gram")).join(scored.select("gram", F.col("score").alias("s")), "gram").groupBy("row").agg(F.sum("s").alias("s"))
    whole = half.drop("words", "grams").join(by_word, "row", "left").join(by_gram, "row", "left")
    more = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
    return whole.select("doc_id", "held_out", "n_tokens", more("n_known", "k"), F.lit(n).cast("long").alias("train_tokens"), more("base_score", "b"), more("score", "s"))
