"""Spelling variants by pairless wildcard groups (operator 11).

Words are the maximal runs of letters with at least LEAST code points. Two words are near if they differ by exactly one
replaced, inserted or deleted code point. No pair of near words is ever formed:

* replacements: a word joins one group for each of its positions, named by the position and by what stands before and
  after it. A group keeps its size and its two most frequent words, which is all that a member needs: it has size - 1
  near words there, of which the best is the first word, or the second if it is the first one itself. Two words that differ
  in one position share exactly one group, so sizes add up without counting anyone twice;
* insertions and deletions: the different results of deleting one code point meet the vocabulary. A group is then a word
  and the longer words that shrink to it: it has all of them as near words, each of them has it.

A group has at most as many words as there are letters (times the positions of the longer word, for deletions), however
large the corpus, so no group is hot. Its name is a 128-bit hash: the sum of a hash of each (position, code point) left,
so that taking one out or moving the rest along is a subtraction, and a word's groups cost time in proportion to its
length. Two of 10^10 groups share a name by chance with a probability below 10^-18.

A word's form is the most frequent near word (of equals the smallest in code-point order) that occurs RATIO times as often
or more. Frequencies grow RATIO-fold with every step, so following forms to their end takes few doublings.

Defined results: null text has no words; a null id is written as "null"; equal rows count each. No words, no rows. Texts
may be of any length, and words as well (a task needs about 100 bytes for each code point of its longest word). Other
columns are not read.
"""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, small_batches, written

LEAST, TWICE, RATIO = 7, 2, 10
#: one occurrence in so many loses a code point, chosen by a hash of document and word
EVERY = 31
#: words counted in a task before they go on to the shuffle
FLUSH = 100_000
#: code points of words whose groups are named at a time
CELLS = 1 << 17

#: one for each half of a group's name
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
SELF, SHORTER, WILD = 0, 1, 2


def counting(least: int, every: int):
    """(doc_id, text) -> (word, n): partial counts of words."""
    runs = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % least)  # a run that is long enough matches as a whole

    def told(counts: collections.Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches):
        counts: collections.Counter = collections.Counter()
        for part in slices(batches):
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                if not text:
                    continue
                prefix = zlib.crc32(b"null:" if doc is None else b"%d:" % doc)
                # bytes.lower() knows A-Z only
                for word, n in collections.Counter(runs.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), prefix)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    counts[word] += n
            if len(counts) > FLUSH:
                yield told(counts)
                counts.clear()
        yield told(counts)

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, twice: int = TWICE, every: int = EVERY) -> DataFrame:
    """(word, n): words of at least `least` code points that occur `twice` or more."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(counting(least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def group_names(points: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One half of the names of m words of equal length (m, length): their own, by deleted and by masked position."""
    place = np.arange(points.shape[1], dtype=np.uint64) << np.uint64(32)
    here = mixed(points | place, seed)
    moved = mixed(points[:, 1:] | place[:-1], seed)  # each but the first, one place further to the left
    own = here.sum(axis=1, dtype=np.uint64)
    before = here.cumsum(axis=1, dtype=np.uint64) - here
    after = np.zeros_like(here)
    after[:, :-1] = moved[:, ::-1].cumsum(axis=1, dtype=np.uint64)[:, ::-1]
    # masked words are named apart: with its last position masked, a word would share the name of what stands before it
    return own, before + after, own[:, None] - here + mixed(np.array([1 << 63], np.uint64), seed)


def naming(least: int):
    """(id, word, n) -> (k1, k2, kind, n, place, id): every group that a word takes part in.

    place orders a group's members of equal frequency as their words: masked words by the code point under the mask. Of
    longer words that shrink to w, those whose extra code point is below the one that it stands before come first, the
    earlier it stands the further in front; of the others, the later the further in front.
    """

    def groups(ids: np.ndarray, words: pa.Array, n: np.ndarray, length: int):
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(-1, length)
        halves = [group_names(points, seed) for seed in SEEDS]
        # of equal neighbours the last one is deleted, so that results differ
        at, column = np.nonzero(np.hstack([points[:, 1:] != points[:, :-1], np.ones((len(points), 1), bool)]))
        if length <= least:  # nothing shorter is a word
            at, column = at[:0], column[:0]
        gone, following = points[at, column].astype(np.int64), points[at, np.minimum(column + 1, length - 1)].astype(np.int64)
        low = (gone < following) & (column < length - 1)
        cut_place = np.where(low, column << 21, (1 << 60) - (column << 21)) + gone
        every = np.arange(len(points))
        rows = np.concatenate([every, at, np.repeat(every, length)])
        keys = [np.concatenate([own, cut[at, column], wild.ravel()]).view(np.int64) for own, cut, wild in halves]
        kinds = np.repeat(np.array([SELF, SHORTER, WILD], np.int8), [len(every), len(at), points.size])
        place = np.concatenate([np.zeros(len(every), np.int64), cut_place, points.ravel().astype(np.int64)])
        return pa.record_batch([*map(pa.array, (*keys, kinds, n[rows], place, ids[rows]))], ["k1", "k2", "kind", "n", "place", "id"])

    def run(batches):
        for batch in batches:
            ids, words, n = batch.column("id").to_numpy(), batch.column("word"), batch.column("n").to_numpy()
            lengths = pc.utf8_length(words).to_numpy()
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                step = max(1, CELLS // length)
                for start in range(0, len(at), step):
                    some = at[start : start + step]
                    yield groups(ids[some], words.take(pa.array(some)), n[some], length)

    return run


def near(words: DataFrame, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """(id, near, best) of words (id, word, n): how many near words each word has in each of its groups, and which of these is
    the best, if it occurs `ratio` times as often as the word; groups without near words have no rows."""
    members = words.select("id", "word", "n").mapInArrow(naming(least), "k1 long, k2 long, kind byte, n long, place long, id long")
    whole = Window.partitionBy("k1", "k2").orderBy("kind", F.desc("n"), "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct("kind", "n", "id")
    grouped = members.select("kind", "n", "id", F.count(F.lit(1)).over(whole).alias("size"), F.first(me).over(whole).alias("first"), F.nth_value(me, 2).over(whole).alias("second")).where("size > 1")
    # a group of longer words whose shorter form is no word itself tells nothing
    told = grouped.where((F.col("kind") != SHORTER) | (F.col("first.kind") == SELF))
    best = F.when((F.col("first.id") == F.col("id")), F.col("second")).otherwise(F.col("first"))
    count = F.when(F.col("kind") == SHORTER, 1).otherwise(F.col("size") - 1)
    return told.select("id", count.cast("long").alias("near"), F.when(best["n"] >= ratio * F.col("n"), best["id"]).alias("best"))


def ends(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): where following forms ends. Each round doubles the steps followed."""
    links = written(spark, links.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = links.toDF("via", "end")
        nxt = links.join(further, F.col("root") == F.col("via"), "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved"))
        nxt = written(spark, nxt, "forms")
        if nxt.where("moved").isEmpty():
            return links
        links = nxt.select("word", "root")


def variants(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, twice: int = TWICE, every: int = EVERY, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    small_batches(spark)
    # numbered as they are written, so that groups need carry no words
    words = written(spark, vocabulary(docs, id_col, text_col, least, twice, every).withColumn("id", F.monotonically_increasing_id()), "words")
    groups = written(spark, near(words, least, ratio), "near")
    counts = groups.groupBy("id").agg(F.sum("near").alias("n_near"))
    better = groups.where("best is not null").select("id", "best").join(words.select(F.col("id").alias("best"), "word", "n"), "best")
    forms = better.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("m"), "word")).alias("f")).select("id", F.col("f.word").alias("form"), (-F.col("f.m")).alias("form_n"))
    formed = written(spark, words.join(counts, "id", "left").join(forms, "id", "left").select("word", "form", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"), "formed")
    return formed.join(ends(spark, formed.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def normalised(spark: SparkSession, docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word, root, n): the words of each document that have another root, for those who want to replace them."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.expr(f"regexp_extract_all(translate(`{text_col}`, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+', 0)")).alias("word"))
    counts = rows.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(found.where("word <> root").select("word", "root"), "word").select(F.col("doc_id").alias(id_col), "word", "root", "n")
