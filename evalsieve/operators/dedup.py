"""Deduplication and splits of items and corpora."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.store import written


def first_by_fingerprint(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): the row with the smallest id of each normalised fingerprint; partial aggregation, no window."""
    return rows.groupBy(text.fingerprint(F.col(text_col)).alias("fp")).agg(F.min(id_col).alias(id_col)).select(id_col, "fp")


def duplicate_groups(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fp, first id, size) of fingerprints that several rows share."""
    return rows.groupBy(text.fingerprint(F.col(text_col)).alias("fp")).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("size")).where("size > 1")


def split_order(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), key.cast("string")))


def ranked(rows: DataFrame, id_col: str, seed: str = "42") -> DataFrame:
    """(id, nth, all): each row's place, from 1, in the order of a hash of its id, and the number of rows.

    Ranks come from counts per range of the hash, so no task sorts all rows: rows are numbered within one of 65,536
    ranges and the ranges' totals, as many numbers, are added up.
    """
    h = rows.select(F.col(id_col).alias("id"), split_order(F.col(id_col), seed).alias("h")).withColumn("part", F.substring("h", 1, 4))
    sizes = h.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("part")
    before = sizes.select("part", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("h", "id")) + F.col("before")
    return h.join(F.broadcast(before), "part").select(F.col("id").alias(id_col), nth.alias("nth"), "all")


def exact_split(rows: DataFrame, id_col: str, seed: str = "42", train: float = 0.9, validation: float = 0.05) -> DataFrame:
    """(id, split) of exact sizes: int(train * n), int(validation * n), the rest test."""
    n_train, n_val = F.floor(F.col("all") * F.lit(train)), F.floor(F.col("all") * F.lit(validation))
    return ranked(rows, id_col, seed).select(id_col, F.when(F.col("nth") <= n_train, "train").when(F.col("nth") <= n_train + n_val, "validation").otherwise("test").alias("split"))


def sampled(rows: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """n rows in the order of a hash: a sample without replacement that anyone can repeat."""
    return rows.orderBy(split_order(F.col(id_col), seed), id_col).limit(n)


def drawn(rows: DataFrame, id_col: str, n: int, seed: str, first: int = 0) -> DataFrame:
    """(draw, id): n draws with replacement, numbered from `first`. Draw i takes the row whose rank is a hash of i, so draws
    don't depend on each other: more of them, or the same again, can be taken at any time. No rows, no draws."""
    ranks = ranked(rows, id_col, seed)
    draws = rows.sparkSession.range(first, first + n).select(F.col("id").alias("draw"), F.conv(F.substring(split_order(F.col("id"), seed + "|draw"), 1, 15), 16, 10).cast("long").alias("x"))
    known = ranks.agg(F.max("all").alias("all")).where("all is not null")  # one row
    return draws.crossJoin(F.broadcast(known)).select("draw", (F.col("x") % F.col("all") + 1).alias("nth")).join(ranks.select(id_col, "nth"), "nth").select("draw", id_col)


#: modulus of the permutations: a prime, so that products with 28-bit hashes stay within 64 bits
PRIME = 2147483647


def permutation(i: int) -> tuple[int, int]:
    """Factor and summand of the i-th permutation."""
    return 1 + (i * 1103515245 + 12345) % (PRIME - 1), (i * 69069 + 1) % PRIME


#: bytes of text, and words of a vocabulary, that a task of signatures has at a time
TEXT, WORDS = 4 << 20, 4096


def permuted(words: list[str], permutations: int) -> np.ndarray:
    """words x permutations: a * h + b of each word's hash h, seven hex digits of its MD5, which any SQL engine can repeat."""
    digests = b"".join([hashlib.md5(w.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[:4] for w in words])
    h = np.frombuffer(digests, ">u4").astype(np.uint64) >> np.uint64(4)
    a, b = np.array([permutation(i) for i in range(permutations)], np.uint64).T
    x = h[:, None] * a + b  # below 2^60: the modulus is 2^31 - 1, so both halves are added
    x = ((x & np.uint64(PRIME)) + (x >> np.uint64(31))).astype(np.uint32)
    return np.minimum(x, x - np.uint32(PRIME))


def minhash(lists: pa.ListArray, permutations: int = 128) -> np.ndarray:
    """texts x permutations: the smallest value of each text's words, of which every text has one or more.

    A word is hashed and permuted once for a batch; the permuted vocabulary is gone through in parts, so that memory
    depends neither on the vocabulary nor on a text's length.
    """
    flat = lists.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    pairs = np.unique(flat.indices.to_numpy().astype(np.int64) * len(lists) + text)  # each word of a text once, by words
    word, text = pairs // len(lists), pairs % len(lists)
    vocabulary = flat.dictionary.to_pylist()
    out = np.full((len(lists), permutations), PRIME, np.uint32)
    for low in range(0, len(vocabulary), WORDS):
        values = permuted(vocabulary[low : low + WORDS], permutations)
        w, t = (x[slice(*np.searchsorted(word, [low, low + WORDS]))] for x in (word, text))
        order = np.argsort(t, kind="stable")
        w, t = w[order] - low, t[order]
        for part in range(0, len(t), 8 * WORDS):
            own = t[part : part + 8 * WORDS]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            least = np.minimum.reduceat(values[w[part : part + 8 * WORDS]], starts, axis=0)
            out[own[starts]] = np.minimum(out[own[starts]], least)
    return out


def band_keys(signature: np.ndarray, rows: int) -> list[str]:
    """The keys of one text: the MD5 of each band's first place and values."""
    said = list(map(str, signature.tolist()))
    return [hashlib.md5(":".join([str(i), *said[i : i + rows]]).encode(), usedforsecurity=False).hexdigest() for i in range(0, len(said) - rows + 1, rows)]


def buckets(rows: DataFrame, id_col: str, text_col: str, permutations: int = 128, band_rows: int = 16) -> DataFrame:
    """(id, key): the MinHash bands of each text's white-space tokens."""

    def signed(batches):
        for batch in batches:
            ends, start = np.cumsum(pc.binary_length(batch.column("t")).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TEXT, "right")))
                part, start = batch.slice(start, end - start), end
                split = pc.split_pattern_regex(part.column("t"), "[ \t\n\x0b\x0c\r]+")  # Java's \s; the ends are trimmed
                keys = [band_keys(s, band_rows) for s in minhash(split, permutations)]
                per = permutations // band_rows
                yield pa.record_batch([part.column("id").take(pa.array(np.repeat(np.arange(len(keys)), per))), pa.array([k for ks in keys for k in ks], pa.string())], ["id", "key"])

    whole = rows.select(F.col(id_col).alias("id"), F.trim(F.col(text_col), F.lit(" \t\n\x0b\x0c\r")).alias("t")).where("t <> ''")
    return whole.mapInArrow(signed, f"id {dict(whole.dtypes)['id']}, key string")


def sets(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, h, k): each text's distinct words as sorted hashes, and two hashes of these; texts without words have no row."""
    hashes = F.array_sort(F.transform(F.array_distinct(text.words(F.col(text_col))), lambda w: F.xxhash64(w)))
    return rows.select(F.col(id_col).alias("id"), hashes.alias("t")).where(F.size("t") > 0).withColumns({"h": F.xxhash64("t"), "k": F.hash("t")})


def same_sets(spark: SparkSession, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, set_id): the smallest id of the texts with the same words. Two hashes of a set are all that is shuffled."""
    own = written(spark, sets(rows, id_col, text_col).select("id", "h", "k"), "set_keys")
    return own.join(own.groupBy("h", "k").agg(F.min("id").alias("set_id")), ["h", "k"]).select("id", "set_id")


#: of one comparison of sets: bytes and sets of a block, and pairs that small groups share a task up to
BLOCK_BYTES, BLOCK, TOGETHER = 8 << 20, 512, 200_000

#: parts of the hashes that tell sets apart before their words are fetched: sets of up to about BITS words each; WIDE for those
#: of more than LARGE words
BITS, WIDE, LARGE = 1024, 8192, 512


def coded(spark: SparkSession, own: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, h, k, c, u, bits, wide) of sets(): places of the words in ranks (w: most frequent first, of bounded size), the most
    frequent one's the largest, and the hashes of all others. Either is sorted; small numbers take a fraction of the hashes' room.
    bits: for each of BITS parts of the words' hashes whether an odd number of words is in it; two sets differ in as many words
    as bits at least. wide: the same in WIDE parts for sets of more than LARGE words, else empty."""

    def parity(w, row, n, parts):
        odd = np.bincount(row * parts + (w & (parts - 1)), minlength=n * parts).astype(np.uint8) & 1
        return np.packbits(odd).view(np.int64)

    known = ranks.toArrow().column("w").to_numpy()
    order = np.argsort(known)
    shared = spark.sparkContext.broadcast((known[order], (len(known) - 1 - order).astype(np.int32)))

    def code(batches):
        words, places = shared.value
        for batch in batches:
            ends, start = np.cumsum(pc.list_value_length(batch.column("t")).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TEXT // 8, "right")))
                part, start = batch.slice(start, end - start), end
                lists = part.column("t")
                w, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                at = np.minimum(np.searchsorted(words, w), max(len(words) - 1, 0))
                common = words[at] == w if len(words) else np.zeros(len(w), bool)
                c, u = places[at[common]], w[~common]  # u is sorted as it is
                offsets = [np.r_[0, np.cumsum(np.bincount(row[x], minlength=len(lists)))].astype(np.int32) for x in (common, ~common)]
                c = c[np.lexsort((c, row[common]))]
                large = np.bincount(row, minlength=len(lists)) > LARGE
                nth = np.cumsum(large) - 1
                bits, wide = parity(w, row, len(lists), BITS), parity(w[large[row]], nth[row[large[row]]], int(large.sum()), WIDE)
                offsets += [np.r_[0, np.cumsum(x)].astype(np.int32) for x in (np.full(len(lists), BITS // 64), large * (WIDE // 64))]
                arrays = [pa.ListArray.from_arrays(pa.array(o), pa.array(x)) for o, x in zip(offsets, (c, u, bits, wide))]
                yield pa.record_batch([*(part.column(x) for x in ("id", "h", "k")), *arrays], ["id", "h", "k", "c", "u", "bits", "wide"])

    return own.select("id", "h", "k", "t").mapInArrow(code, f"id {dict(own.dtypes)['id']}, h long, k int, c array<int>, u array<long>, bits array<long>, wide array<long>")


#: so many pairs are joined with their bits at a time
AT_ONCE = 16_000_000


def cleared(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """written(), whose shuffle files go at once: what follows reads the table, and pairs are many."""
    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(option, None)
    spark.conf.set(option, "true")
    try:
        return written(spark, df, name)
    finally:
        spark.conf.unset(option) if before is None else spark.conf.set(option, before)


def in_parts(spark: SparkSession, met: DataFrame, one: DataFrame, similarity: float, bits: str) -> DataFrame:
    """alike() of AT_ONCE pairs after another, each part's shuffle files gone before the next, so that pairs with their bits never are on disk together."""
    parts = 1 + met.count() // AT_ONCE
    part = F.pmod(F.xxhash64("a", "b"), F.lit(parts))
    done = [cleared(spark, alike(met.where(part == i) if parts > 1 else met, one, similarity, bits), "alike") for i in range(parts)]
    return reduce(DataFrame.unionByName, done)


def alike(met: DataFrame, one: DataFrame, similarity: float, bits: str) -> DataFrame:
    """The pairs (a, b) of met whose bits (a column of one; empty ones tell nothing) don't show that they differ in more words than `similarity` allows; none is lost."""
    sides = [one.select(F.col("set_id").alias(c), (F.size("c") + F.size("u")).alias(f"n{c}"), F.col(bits).alias(f"bits{c}")) for c in ("a", "b")]
    differ = F.aggregate(F.zip_with("bitsa", "bitsb", lambda x, y: F.coalesce(F.bit_count(x.bitwiseXOR(y)), F.lit(0))), F.lit(0), lambda n, x: n + x)
    return met.join(sides[0], "a").join(sides[1], "b").where(differ <= (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 1e-9).select("a", "b")


def overlaps(similarity: float):
    """(a, b, jaccard) of those pairs (a, b) of one task that reach `similarity`; held: (set_id, c, u), the sets that they name."""

    def compare(pairs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        sets_ = dict(zip(held["set_id"], zip(held["c"], held["u"])))
        found = np.empty(len(pairs))
        for i, (a, b) in enumerate(zip(pairs["a"], pairs["b"])):
            x, y = sets_[a], sets_[b]
            both = sum(len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y) if len(p) and len(q))
            found[i] = both / (sum(map(len, x)) + sum(map(len, y)) - both)
        return pd.DataFrame({"a": pairs["a"], "b": pairs["b"], "jaccard": found})[found >= similarity]

    return compare


def compared(spark: SparkSession, met: DataFrame, one: DataFrame, similarity: float) -> DataFrame:
    """(a, b, jaccard) of the pairs met (a < b) that reach `similarity`; one: (set_id, c, u).

    A pair is compared where the smallest set that its own smaller one met is, so that sets which all met each other are
    sent to one task, once each and not once for each pair. Groups of more than a block are compared block by block, and
    small ones share tasks, so that a task's memory depends on no group's size.
    """
    low = met.select(F.col("b").alias("set_id"), F.col("a").alias("m")).unionByName(met.select(F.col("a").alias("set_id"), F.col("a").alias("m"))).groupBy("set_id").agg(F.min("m").alias("lead"))
    led = cleared(spark, met.join(low.withColumnRenamed("set_id", "a"), "a").select("lead", "a", "b"), "led")
    sizes = one.select("set_id", (4 * F.size("c") + 8 * F.size("u")).cast("long").alias("bytes"))
    members = led.select("lead", F.explode(F.array("a", "b")).alias("set_id")).distinct().join(sizes, "set_id")
    groups = members.groupBy("lead").agg(F.sum("bytes").alias("bytes"), F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    groups = cleared(spark, groups, "groups")
    small = groups.where("blocks = 1").agg(F.sum("bytes")).first()[0] or 0
    bins = 1 + max(2 * small // BLOCK_BYTES, led.count() // TOGETHER)
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    task = F.when(F.col("blocks") > 1, F.concat_ws(":", F.col("lead").cast("string"), block("a"), block("b"))).otherwise(F.pmod(F.xxhash64("lead"), F.lit(bins)).cast("string"))
    pairs = cleared(spark, led.join(groups, "lead").select(task.alias("task"), "a", "b"), "pairs")
    wanted = pairs.select(F.col("task").alias("to"), F.explode(F.array("a", "b")).alias("set_id")).distinct()
    held = one.select("set_id", "c", "u").join(wanted, "set_id")
    kind = dict(met.dtypes)["a"]
    return pairs.groupBy("task").cogroup(held.groupBy("to")).applyInPandas(overlaps(similarity), f"a {kind}, b {kind}, jaccard double")


def similar_pairs(spark: SparkSession, rows: DataFrame, id_col: str, text_col: str, similarity: float = 0.8, common: int = 1 << 17) -> DataFrame:
    """Exact similarity join of texts as sets of words: (a, b, jaccard).

    Texts with the same words are one set, named by the smallest of their ids; same_sets tells each text's set.
    The result has every pair of sets, a < b, whose Jaccard similarity is `similarity` or more. Words are ordered from
    rare to frequent (`common` of the most frequent are ranked, the others come first in the order of their hashes), and
    two similar sets share a word among the first of either, as many as could be missing and one more.

    Sets meet as rows (word, set, size, place, the two words before it), which carry no other words, so what is shuffled grows
    with the number of words. Two sets that share one of the words before have met there, under conditions no stricter, and
    don't meet again: similar sets meet about once for each difference and not for each word. At the first word that two sets share, none before it is common, so they can have that word and as many more as
    follow it in the one with fewer left; pairs that need more are dropped there, then those whose bits differ too much. Only
    sets of the pairs left are fetched.
    A ranked word's number may be another word's hash: such sets meet in vain, and are told apart when they are compared.
    """
    words = rows.select(F.explode(F.transform(text.words(F.col(text_col)), lambda w: F.xxhash64(w))).alias("w"))
    ranks = written(spark, words.groupBy("w").agg(F.count(F.lit(1)).alias("f")).orderBy(F.desc("f"), "w").limit(common), "ranks").orderBy(F.desc("f"), "w")
    whole = coded(spark, sets(rows, id_col, text_col), ranks).groupBy("h", "k").agg(F.min("id").alias("set_id"), F.first(F.struct("c", "u", "bits", "wide")).alias("x"))
    one = cleared(spark, whole.select("set_id", "x.*"), "sets")

    n = F.size("u") + F.size("c")
    first = F.slice(F.concat("u", F.col("c").cast("array<bigint>")), F.lit(1), (n - F.ceil(n * similarity - 1e-9) + 1).cast("int"))
    exploded = one.select("set_id", n.alias("n"), first.alias("first")).select("set_id", "n", "first", F.posexplode("first").alias("at", "w"))
    last = [F.get("first", F.col("at") - i).alias(f"last{i}") for i in (1, 2)]
    placed = cleared(spark, exploded.select("set_id", "n", "at", "w", *last), "places")
    left, right = (placed.select("w", F.col("set_id").alias(s), *[F.col(c).alias(c + s) for c in ("n", "at", "last1", "last2")]) for s in ("a", "b"))
    sizes = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9
    most = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))  # places count from 0: this word and all after it
    enough = most >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-9
    again = reduce(Column.__or__, [F.coalesce(F.col(f"last{i}a") == F.col(f"last{j}b"), F.lit(False)) for i in (1, 2) for j in (1, 2)])
    met = cleared(spark, left.join(right, "w").where((F.col("a") < F.col("b")) & sizes & enough & ~again).select("a", "b").distinct(), "met")
    for bits in ("bits", "wide"):
        met = in_parts(spark, met, one, similarity, bits)
    return compared(spark, met, one, similarity)


def similar_sets(spark: SparkSession, rows: DataFrame, id_col: str, text_col: str, similarity: float = 0.8, common: int = 1 << 17) -> tuple[DataFrame, DataFrame]:
    """((a, b, jaccard), (id, set_id)): similar_pairs and same_sets."""
    return similar_pairs(spark, rows, id_col, text_col, similarity, common), same_sets(spark, rows, id_col, text_col)


#: up to so many memberships of undecided rows are decided in one task
SMALL = 100_000


def decided(batches):
    """(id, key, kept_first: the first kept id of the key so far) of undecided rows -> (id, kept), in the order of ids."""
    keys: dict = {}
    first: dict = {}
    for b in batches:
        for i, key, kept in zip(*(b.column(c).to_pylist() for c in ("id", "key", "kept_first"))):
            keys.setdefault(i, []).append(key)
            if kept is not None:
                first[key] = kept
    ids = sorted(keys)
    said = []
    for i in ids:
        said.append(not any(first.get(k, i) < i for k in keys[i]))
        if said[-1]:
            for k in keys[i]:
                first[k] = min(first.get(k, i), i)
    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(said, pa.bool_())], ["id", "kept"])


def greedy_keep(spark: SparkSession, ids: DataFrame, members: DataFrame, small: int = SMALL) -> DataFrame:
    """(id long): keep iff no earlier kept row shares a key, in the order of ids. members: (id, key).

    Rounds over keys, never over pairs: a row goes if a kept row comes before it in one of its keys, and is kept once
    it is the first undecided row of all its keys. As many rounds as the longest chain would take are cut short: what is still
    undecided goes to one task once it is no more than `small` memberships. Each round is written to the shared folder.
    """
    members = written(spark, members.select(F.col("id").cast("long").alias("id"), "key"), "greedy")
    several = members.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key")
    members = written(spark, members.join(several, "key", "left_semi").select("id", "key"), "greedy")  # keys of one row decide nothing
    rows = ids.select(F.col(ids.columns[0]).cast("long").alias("id"))
    state = written(spark, rows.join(members.select("id").distinct().withColumn("in", F.lit(True)), "id", "left").select("id", F.when(F.col("in").isNull(), True).alias("kept")), "greedy")
    while True:
        left = members.join(state.where("kept is null").select("id"), "id", "left_semi")
        n = left.limit(small + 1).count()
        if not n:
            return state.where("kept").select("id")
        now = members.join(state, "id")
        first = now.groupBy("key").agg(F.min(F.when(F.col("kept"), F.col("id"))).alias("kept_first"), F.min(F.when(F.col("kept").isNull(), F.col("id"))).alias("open_first"))
        if n <= small:
            said = left.join(first, "key").select("id", "key", "kept_first").repartition(1).mapInArrow(decided, "id long, kept boolean").select("id", F.col("kept").alias("verdict"))
        else:
            open_ = now.where("kept is null").join(first, "key")
            said = open_.groupBy("id").agg(F.max(F.coalesce(F.col("kept_first") < F.col("id"), F.lit(False))).alias("goes"), F.min(F.col("open_first") == F.col("id")).alias("first"))
            said = said.select("id", F.when(F.col("goes"), False).when(F.col("first"), True).alias("verdict"))
        state = written(spark, state.join(said, "id", "left").select("id", F.coalesce("kept", "verdict").alias("kept")), "greedy")


def unseen(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_anti")


