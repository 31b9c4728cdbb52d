"""Near-duplicate classes by BagMinHash (operator 3).

A text is a multiset of shingles: WORDS consecutive words of the lower-cased text, split at white space (all words, if
fewer). Each shingle's weight axis is discretised into the levels [0, 1), [1, 2), [2, 4), ...; every interval up to the
multiplicity has a Poisson process of points in time, each with a signature component and a place in the interval, so
two multisets share a component's first point with probability sum(min) / sum(max). Points are made in order of time only
while they can still come before a component's present first point, and those above the multiplicity don't count. The
hierarchy is that of the doubling intervals: they aren't halved further, since multiplicities are small integers and an
interval's points above the multiplicity are at most as many as the others. Texts that share ROWS
components in one of BANDS bands are candidates (a pair at similarity 0.8 is missed with probability 7e-5).

Texts with the same words are one node. A bucket is the set of nodes that share a band; equal buckets count once. Within
a bucket all pairs are compared exactly, shingle by shingle, in blocks of BLOCK nodes and about BLOCK_BYTES of text: first
each block on its own together with a few central texts of the bucket, then the texts outside the bucket's largest class
against every block. This is done for the buckets of the first FIRST bands, and then for those of all bands that still
hold nodes of several classes. Links are similarities of at least SIMILARITY; classes are their components. So a text is
sent to BANDS tasks at most, but for buckets of more than one block that fall into several classes, whose pairs have to
be compared. Blocks bound a task's memory, no pairs of a group become rows, and nothing is capped.

Defined results: null and white-space texts have no shingles and form one class. Texts may be of any length; one of more
than a block's bytes has a block of its own. The smallest doc_id of a class stays
(nulls last; of repeated rows, one). Other columns are untouched, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, keep_rows, kept, row_key, slices, small_batches, text_or_empty, tidy, with_ids, written

WORDS, SIMILARITY, BANDS, ROWS, FIRST, BLOCK, HUBS = 5, 0.8, 24, 5, 2, 192, 8
BLOCK_BYTES = 16 << 20
COMPONENTS = BANDS * ROWS
MEMO, UNITS = 200_000, 120_000


class WordHashes(dict):
    """Word -> 64-bit hash; forgets when it has grown to MEMO words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters its bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[str], hashes: WordHashes) -> np.ndarray:
    """Hashes of all shingles in order, repeats included."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return mix(out)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = COMPONENTS) -> np.ndarray:
    """First arrival times (texts x m) of (shingles, multiplicities); rows of empty bags stay infinite."""
    docs, seeds, lows, limits = [], [], [], []
    for d, (shingle, count) in enumerate(bags):
        low = 0
        while len(shingle):
            docs.append(np.full(len(shingle), d))
            seeds.append(mix(shingle + np.uint64(low * 0x9E3779B9 + 1)))
            lows.append(np.full(len(shingle), low))
            limits.append(count)
            low = max(1, 2 * low)
            more = count > low
            shingle, count = shingle[more], count[more]
    first = np.full((len(bags), m), np.inf)
    if not docs:
        return first
    doc, seed, low, limit = map(np.concatenate, (docs, seeds, lows, limits))
    length = np.maximum(low, 1).astype(float)
    pace, flat = 1 / (m * length), first.ravel()
    time, j = np.zeros(len(doc)), 0
    while len(doc):
        j += 1
        r = mix(seed + np.uint64(j * 0xD1342543DE82EF95 % 2**64))
        time = time - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) * pace
        s = mix(r ^ np.uint64(0xA0761D6478BD642F))
        component = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        level = low + ((s & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 * length).astype(np.int64)
        inside = level < limit
        np.minimum.at(flat, (doc * m + component)[inside], time[inside])
        alive = time < first.max(axis=1)[doc]
        doc, seed, low, limit, length, pace, time = (x[alive] for x in (doc, seed, low, limit, length, pace, time))
    return first


def band_keys(first: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each text and band; the band's number is part of it."""
    bits = np.ascontiguousarray(first).view(np.uint64).reshape(len(first), bands, first.shape[1] // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2])
    for i in range(bits.shape[2]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return key.view(np.int64)


def content(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def sign(batches):
    """(doc_id, rid, _evs_key, text) -> (doc_id, rid, _evs_key, ck, bytes, bands)."""
    kept()
    hashes = WordHashes()
    for b in slices(batches):
        cks, bags, keys, held = [], [], [], 0
        for text in b.column("text").to_pylist():
            words = text.lower().split()
            cks.append(content(words))
            bags.append(np.unique(shingles(words, hashes), return_counts=True))
            held += len(bags[-1][0])
            if held > UNITS:
                keys.append(band_keys(signatures(bags)))
                bags, held = [], 0
        keys.append(band_keys(signatures(bags)).reshape(-1, BANDS))
        flat = np.concatenate(keys).ravel()
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
        yield pa.record_batch([b.column("doc_id"), b.column("rid"), b.column("_evs_key"), pa.array(cks, pa.binary()), pc.binary_length(b.column("text")).cast(pa.int64()), bands], ["doc_id", "rid", "_evs_key", "ck", "bytes", "bands"])


def occurrences(shingle: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set: the n-th occurrence of a shingle is an element of its own."""
    s = np.sort(shingle)
    start = np.r_[True, s[1:] != s[:-1]] if len(s) else np.empty(0, bool)
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(start, at, 0))
    return np.where(nth == 0, s, mix(s + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))


def links(sets: list[np.ndarray], asks: np.ndarray, similarity: float = SIMILARITY, known: list | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j), i in asks, of similarity or more, without those that join what earlier ones, or known, had joined.

    known: each set's class so far.
    """
    sizes = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(sets)), sizes)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(term, kind="stable")
    postings = doc[order]
    start = np.r_[0, np.cumsum(np.bincount(term))]
    begins = np.r_[0, np.cumsum(sizes)]
    root = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]
    found = []
    for i in asks:
        if root[i] == root[0] and (root == root[0]).all():
            break
        both = np.zeros(len(sets), np.int64)
        for part in range(begins[i], begins[i + 1], 4096):
            t = term[part : min(part + 4096, begins[i + 1])]
            n = start[t + 1] - start[t]
            at = np.repeat(start[t] - np.r_[0, n.cumsum()[:-1]], n) + np.arange(n.sum())
            both += np.bincount(postings[at], minlength=len(sets))
        near = np.flatnonzero((both >= similarity * (sizes[i] + sizes - both) - 1e-9) & (root != root[i]))
        for j in near:
            if root[i] != root[j]:
                found.append((int(i), int(j)))
                a, b = sorted((root[i], root[j]))
                root[root == b] = a
    return found


def compare(task: pd.DataFrame) -> pd.DataFrame:
    """Links between the texts of one task; rows with ask are compared with all rows."""
    kept()
    tidy()
    hashes, sets, nodes, asks, known, seen = WordHashes(), [], [], [], [], set()
    for text, ck, node, ask, cls in zip(task["text"], task["ck"], task["node"], task["ask"], task["class"]):
        words = text.lower().split()
        if node in seen or content(words) != bytes(ck):
            continue
        seen.add(node)
        if ask:
            asks.append(len(nodes))
        nodes.append(node)
        known.append(cls)
        sets.append(occurrences(shingles(words, hashes)))
    found = links(sets, np.array(asks, np.int64), known=known) if asks and len(sets) > 1 else []
    return pd.DataFrame({"a": [nodes[i] for i, _ in found], "b": [nodes[j] for _, j in found]}, dtype="int64")


TASK = ("node", "_evs_key", "ck", "class")


def verified(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """The links found by tasks (task, ask and TASK's columns) between texts (_evs_key, text)."""
    wanted = with_ids(docs, tasks.select("_evs_key").distinct(), "_evs_key", "left_semi")
    return wanted.join(tasks, "_evs_key").drop("_evs_key").groupBy("task").applyInPandas(compare, "a long, b long")


def bucket_links(spark: SparkSession, docs: DataFrame, member: DataFrame) -> DataFrame:
    """All links that are missing within buckets: member (bucket, bytes, c: how central a node is, and TASK's columns)."""
    many_of = lambda: F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES))
    member = written(spark, member, "chosen")
    blocks = written(spark, member.groupBy("bucket").agg(many_of().alias("blocks")), "blocks")  # written, so that the join can split a bucket
    member = written(spark, member.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")), "member")
    name = lambda kind, *x: F.concat_ws(":", F.lit(kind), *x)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    many = member.where("blocks > 1")
    central = many.where(F.col("bytes") <= BLOCK_BYTES // (4 * HUBS)).groupBy("bucket", "blocks", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(HUBS))).agg(F.max(F.struct("c", *TASK)).alias("x"))
    hubs = central.select("bucket", "x.*", every("blocks").alias("block"))
    alone = member.select(name("b", "bucket", "block").alias("task"), *TASK, F.lit(True).alias("ask"))
    tasks = written(spark, alone.unionByName(hubs.select(name("b", "bucket", "block").alias("task"), *TASK, F.lit(True).alias("ask"))), "tasks")
    found = written(spark, verified(docs, tasks), "links")
    if many.isEmpty():
        return found

    # buckets of more than one block: whatever lies outside the largest class so far is compared with every block
    old = many.select("node", F.col("class").alias("b")).where("node <> b").distinct()
    now = components(spark, found.unionByName(old.select(F.col("node").alias("a"), "b")), "first").withColumnRenamed("comp", "now")
    placed = written(spark, many.join(now, "node", "left").withColumn("class", F.coalesce("now", "class")).drop("now"), "placed")
    sizes = placed.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("bucket").agg(F.max_by("class", F.struct("k", -F.col("class"))).alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    outside = placed.join(largest, "bucket").where("class <> main")
    parts = outside.groupBy("bucket").agg(many_of().alias("parts"))
    outside = written(spark, outside.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), "parts")), "outside")
    if outside.isEmpty():
        return found
    asks = outside.select("bucket", "part", *TASK, every("blocks").alias("block"), F.lit(True).alias("ask"))
    told = placed.join(parts, "bucket").select("bucket", every("parts").alias("part"), *TASK, "block", F.lit(False).alias("ask"))
    tasks = written(spark, asks.unionByName(told).select(name("x", "bucket", "part", "block").alias("task"), *TASK, "ask").groupBy("task", *TASK).agg(F.max("ask").alias("ask")), "tasks")
    return found.unionByName(written(spark, verified(docs, tasks), "links"))


def once_each(spark: SparkSession, texts: DataFrame, rows: DataFrame) -> DataFrame:
    """texts (_evs_key, text) with rows that are repeated there once, so that a task gets a text once however often it occurs."""
    twins = written(spark, rows.groupBy("_evs_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_evs_key"), "twins")
    if twins.isEmpty():
        return texts
    return with_ids(texts, twins, "_evs_key", "left_anti").unionByName(with_ids(texts, twins, "_evs_key", "left_semi").distinct())


def with_class(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """rows with their node's class: a node without links is one by itself."""
    return rows.join(joined, "node", "left").withColumn("class", F.coalesce("class", "node"))


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), class_size, kept, and the row's key."""
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc_id"), row_key(id_col, text_col).alias("_evs_key"), text_or_empty(text_col).alias("text"))
    signed = texts.withColumn("rid", F.monotonically_increasing_id()).select("doc_id", "rid", "_evs_key", "text").mapInArrow(sign, "doc_id long, rid long, _evs_key string, ck binary, bytes long, bands array<long>")
    rows = written(spark, signed, "signed")
    best = F.min(F.struct("doc_id", "rid", "_evs_key")).alias("best")
    whole = [best, F.count(F.lit(1)).alias("n"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands")]
    nodes = written(spark, rows.groupBy("ck").agg(*whole).select("ck", "best", F.col("best._evs_key").alias("_evs_key"), F.col("best.rid").alias("node"), "n", "bytes", "bands"), "nodes")

    bands = nodes.where(F.col("ck") != content([])).select("node", F.posexplode("bands").alias("band", "key"))
    met = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    # merged in any case: Spark takes the exploded bands for no larger than the rows they come from, and would broadcast them
    shared = written(spark, bands.hint("merge").join(met, "key"), "shared")
    plain = once_each(spark, texts.select("_evs_key", "text"), rows)
    joined, found = None, None
    for first in (True, False):
        now = shared.where(F.col("band") < FIRST) if first else shared
        now = (with_class(now, joined) if joined is not None else now.withColumn("class", F.col("node"))).drop("band")
        # buckets of the same nodes count once; those of one class are done
        same = [F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.min("node").alias("low")]
        buckets = now.groupBy("key").agg(*same, F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").groupBy("size", "sum", "low").agg(F.min("key").alias("key")).select("key")
        chosen = with_ids(now, written(spark, buckets, "buckets"), "key", "left_semi").withColumnRenamed("key", "bucket")
        central = shared.groupBy("node").agg(F.count(F.lit(1)).alias("c"))
        member = chosen.join(central, "node").join(nodes.select("node", "_evs_key", "ck", "bytes"), "node")
        more = bucket_links(spark, plain, member)
        found = more if found is None else found.unionByName(more)
        joined = written(spark, components(spark, found, "classes").withColumnRenamed("comp", "class"), "classes")

    named = with_class(nodes.drop("bands", "bytes"), joined)
    whole = named.groupBy("class").agg(F.min("best").alias("first"), F.sum("n").alias("class_size"))
    by_ck = written(spark, named.select("ck", "class").join(whole, "class").select("ck", "first", "class_size"), "by_ck")
    real = lambda c: F.nullif(F.col(c), F.lit(2**63 - 1))
    return rows.drop("bands", "bytes").join(by_ck, "ck").select("_evs_key", real("doc_id").alias("doc_id"), real("first.doc_id").alias("class_id"), "class_size", (F.col("rid") == F.col("first.rid")).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each class, with docs' own columns."""
    said = classes(spark, docs, id_col, text_col).select("_evs_key", "kept")
    return keep_rows(docs, written(spark, said, "decisions"), id_col, text_col)
