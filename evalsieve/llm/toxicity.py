"""Toxicity by nearest labelled examples (operator 4).

Labelled rows outside the held-out fold (crc32 of the doc_id as text, mod 5, is 0 there) supply at most EXAMPLES
examples of each class, and no more than TEXT_BYTES of text; these bounds are the only sampling, and documents are all scored
on their whole texts. Terms are
words and the beginnings of longer ones, BEGINNING letters; every term of two examples or more counts, at its TF-IDF in
the examples times the strength of its association with the label (the phi coefficient, which does not grow with their
number); the norm of a vector runs over these weights.

A document's K nearest examples by exact cosine, itself left out, come from a block-max inverted index: where a document is
an example, its own label has no say in its score. Frequent terms are rows of a
matrix of MATRIX_BYTES at most, the most frequent ones first, multiplied for many documents at a time; the others are postings. Of the other terms, those whose bounds are worth most for their
postings are essential and traversed; the others can add SLACK at most in all. Where a block's greatest sum so far and
the block's maxima of the other terms reach the K-th best sum, the examples that can still be among the K best are
opened: their whole vectors are multiplied with the document's. Votes are weighted by similarity and by how far each
class was thinned out; VAGUE votes at the labels' overall rate pull scores of documents with weak evidence towards that
rate.

The driver sees the examples' vectors, of bounded size, and sends them to the tasks; each worker process makes the index
and its matrix from them once.

Defined results: null text counts as empty; a text without any of the examples' terms, or only with terms of no
association at all, scores the overall rate (0 without labelled rows). Texts may be of any length. Labels other than 0
and 1 are ignored; a doc_id labelled both ways counts as toxic; a null doc_id is scored, not held out and no example.
Neighbours that tie are taken in order of the example's place. Repeated rows are each scored; an empty table gives an
empty result. Columns besides id and text are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import kept, slices, small_batches, text_or_empty, tidy, written

EXAMPLES, K, BLOCK, VAGUE = 4096, 9, 64, 0.5
DENSE, SLACK, TOGETHER = 16, 0.01, 128
BEGINNING, MIN_DF = 5, 2
TEXT_BYTES, MATRIX_BYTES = 64 << 20, 128 << 20
PORTION = 500_000
EDGES = ".,;:!?\"'()[]{}<>*#%&-_"


def held_out(doc_id: Column, mod: int = 5, rest: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def terms_of(chunk: str) -> list[str]:
    word = chunk.strip(EDGES)
    return [word, f"{word[:BEGINNING]}*"] if len(word) >= BEGINNING else [word] if word else []


class Vectors:
    """Texts' vectors, from the known words, the known beginnings and the weight of each, words first."""

    def __init__(self, words: pa.Array, beginnings: pa.Array, idf: np.ndarray):
        self.words, self.beginnings, self.idf = words, beginnings, idf

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each text and the end, term ids in order, unit-length weights)."""
        chunks = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        sizes = pc.list_value_length(chunks).to_numpy()
        coded = chunks.flatten().dictionary_encode()
        words = pc.utf8_trim(coded.dictionary, EDGES)
        ids = lambda known, keys: pc.fill_null(pc.index_in(keys, known), -1).to_numpy().astype(np.int64)
        beginning = ids(self.beginnings, pc.utf8_slice_codeunits(words, 0, BEGINNING))
        long = (beginning >= 0) & (pc.utf8_length(words).to_numpy() >= BEGINNING)
        pairs = np.stack((ids(self.words, words), np.where(long, beginning + len(self.words), -1)), axis=1)
        terms = pairs[coded.indices.to_numpy()]
        n = max(1, len(self.idf))
        keys, tf = np.unique((terms + (np.repeat(np.arange(len(texts)), sizes) * n)[:, None])[terms >= 0], return_counts=True)
        doc, terms = np.divmod(keys, n)
        w = (1 + np.log(tf)) * self.idf[terms] if len(keys) else np.empty(0)
        size = np.sqrt(np.bincount(doc, w * w, len(texts)))
        keep = w > 0
        doc, terms, w = doc[keep], terms[keep], w[keep]
        return np.searchsorted(doc, np.arange(len(texts) + 1)), terms, w / size[doc]


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The integers of all half-open ranges, one after another."""
    n = ends - starts
    return np.repeat(starts - np.concatenate(([0], n.cumsum()[:-1])), n) + np.arange(n.sum())


class BlockMaxIndex:
    """Postings of each term with their maxima by blocks of examples, frequent terms in a matrix, and whole vectors.

    Weights are 32-bit numbers; the products of opened examples are summed in 64 bits, always in the same order.
    """

    #: 32-bit sums of bounds and products are off by less than this
    MARGIN = 1e-4

    def __init__(self, start: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, block: int = BLOCK):
        n = len(start) - 1
        rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(start))
        terms, weights = terms.astype(np.int32, copy=False), weights.astype(np.float32, copy=False)
        self.row_start, self.row_terms, self.row_weights = start.astype(np.int64, copy=False), terms, weights
        number = np.bincount(terms, minlength=n_terms)
        often = np.argsort(-number, kind="stable")[: MATRIX_BYTES // (4 * max(n, 1))]
        often = np.sort(often[number[often] * DENSE > n])
        place = np.full(n_terms, -1, np.int32)
        place[often] = np.arange(len(often))
        matrix = np.zeros((len(often), n), np.float32)
        at = place[terms] >= 0
        matrix[place[terms[at]], rows[at]] = weights[at]
        order = np.lexsort((rows[~at], terms[~at]))
        terms, weights, rows = terms[~at][order], weights[~at][order], rows[~at][order]
        key = terms.astype(np.int64) * (n // block + 1) + rows // block
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        begins = lambda t: np.searchsorted(t, np.arange(n_terms + 1)).astype(np.int32)
        block_max = np.maximum.reduceat(weights, first) if len(key) else weights
        most = np.zeros(n_terms, np.float32)
        np.maximum.at(most, terms, weights)
        self.n, self.block, self.place, self.matrix = n, block, place, matrix
        self.rows, self.weights, self.start, self.most = rows.astype(np.min_scalar_type(n)), weights, begins(terms), most
        self.block_start, self.block_of, self.block_max = begins(terms[first]), (rows[first] // block).astype(np.min_scalar_type(n // block)), block_max

    def frequent(self, start: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the frequent terms add to the inner product of each query with each row."""
        wide = np.zeros((len(start) - 1, len(self.matrix)), np.float32)
        at = self.place[terms]
        wide[np.repeat(np.arange(len(start) - 1), np.diff(start))[at >= 0], at[at >= 0]] = weights[at >= 0]
        return wide @ self.matrix

    def products(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Inner products of rows, none of them without terms, with a query that is spread out over all terms."""
        start, end = self.row_start[rows], self.row_start[rows + 1]
        here = ranges(start, end)
        return np.add.reduceat(dense[self.row_terms[here]] * self.row_weights[here], np.cumsum(end - start) - (end - start)) if len(rows) else np.empty(0)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, base: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k rows of greatest positive inner product, best first, ties by row; and their products.

        base: what frequent() gives for this query; dense: zeros for every term, which are zeros again afterwards.
        """
        if not self.n:
            return np.empty(0, np.int64), np.empty(0)
        n_blocks = (self.n - 1) // self.block + 1
        number = self.start[terms + 1] - self.start[terms]
        rare = np.flatnonzero(number)
        bound = weights[rare] * self.most[terms[rare]]
        order = np.argsort(bound / number[rare])
        rest, essential = np.split(rare[order], [np.searchsorted(np.cumsum(bound[order]), SLACK)])
        total = np.zeros(n_blocks * self.block)
        total[: self.n] = base
        at = terms[essential]
        here = ranges(self.start[at], self.start[at + 1])
        total += np.bincount(self.rows[here], self.weights[here] * np.repeat(weights[essential], number[essential]), len(total))
        at = terms[rest]
        here = ranges(self.block_start[at], self.block_start[at + 1])
        more = np.bincount(self.block_of[here], self.block_max[here] * np.repeat(weights[rest], self.block_start[at + 1] - self.block_start[at]), n_blocks)
        by_block = total.reshape(n_blocks, self.block)
        most = by_block.max(1)
        # k rows at least reach `least`: those that lead as many blocks, or any k; others that stay below it are not among the k best
        sums = most if n_blocks >= k else total
        least = max(np.partition(sums, len(sums) - k)[-k] if len(sums) >= k else 0.0, 0.0) - self.MARGIN
        open_ = np.flatnonzero(most + more >= least)
        rows = (open_[:, None] * self.block + np.arange(self.block))[by_block[open_] + more[open_, None] >= least]
        rows = rows[rows < self.n]
        rows = rows[self.row_start[rows] < self.row_start[rows + 1]]
        dense[terms] = weights
        exact = self.products(rows, dense)
        dense[terms] = 0
        best = np.lexsort((rows, -np.round(exact, 9)))[:k]
        best = best[exact[best] > 0]
        return rows[best], exact[best]


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """What scoring needs: terms, their weights, the examples' vectors, labels, class weights and the overall rate; of bounded size."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    known = written(spark, known.join(docs.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id"), "labels")
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES) for y in (0, 1)]
    drawn = F.broadcast(written(spark, draw[0].union(draw[1]), "drawn"))
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text_or_empty(text_col)).cast("long").alias("size")).join(drawn, "doc_id").groupBy("doc_id", "y").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")) - F.col("size")  # EXAMPLES rows at most
    picked = F.broadcast(written(spark, sizes.withColumn("before", before).where(F.col("before") < TEXT_BYTES).select("doc_id", "y"), "picked"))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).join(picked, "doc_id")
    # of examples with the same words one is enough: copies would pass off their words as typical of a class
    same = F.xxhash64(F.lower("text"))
    texts = written(spark, texts.groupBy(same.alias("h"), "y").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("x")).select("x.*", "y"), "examples")

    def presence(batches):
        kept()
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                found = list({t for c in set(text.lower().split()) for t in terms_of(c)})
                yield pa.record_batch([pa.array(found, pa.string()), pa.array([y] * len(found), pa.int32())], ["term", "y"])

    n = {r.y: r.n for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    df = texts.select("text", "y").mapInArrow(presence, "term string, y int").groupBy("term").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    both = F.col("c0") + F.col("c1")
    total = float(n0 + n1)
    ahead = F.col("c1") * (n0 - F.col("c0")) - F.col("c0") * (n1 - F.col("c1"))
    phi = F.abs(ahead) / F.sqrt(1.0 * max(n0, 1) * max(n1, 1) * both * F.greatest(total - both, F.lit(0.5)))
    terms = df.where(both >= MIN_DF).select("term", both.alias("df"), phi.alias("phi")).toArrow()
    short = pc.ends_with(terms.column("term"), "*")
    terms = pa.concat_tables([terms.filter(pc.invert(short)), terms.filter(short)])
    words = terms.column("term").slice(0, len(terms) - pc.sum(short).as_py()).combine_chunks() if len(terms) else pa.array([], pa.string())
    beginnings = pc.utf8_slice_codeunits(terms.column("term").slice(len(words)).combine_chunks(), 0, -1) if len(terms) else words
    idf = (np.log((1 + total) / (1 + terms.column("df").to_numpy())) + 1) * terms.column("phi").to_numpy()
    learnt = spark.sparkContext.broadcast((words, beginnings, idf))

    def rows_of(batches):
        kept()
        vectors = Vectors(*learnt.value)
        for b in slices(batches, "text", PORTION):
            start, found, w = vectors.of(b.column("text"))
            lists = [pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(x, t)) for x, t in ((found, pa.int32()), (w, pa.float32()))]
            yield pa.record_batch([b.column("doc_id"), b.column("y"), *lists], ["doc_id", "y", "terms", "weights"])

    rows = texts.mapInArrow(rows_of, "doc_id long, y int, terms array<int>, weights array<float>").withColumn("h", F.xxhash64("doc_id")).toArrow().combine_chunks()
    learnt.destroy()
    rows = rows.sort_by([("h", "ascending"), ("doc_id", "ascending")])
    lists = [rows.column(c).combine_chunks() for c in ("terms", "weights")]
    start = np.r_[0, np.cumsum(pc.list_value_length(lists[0]).to_numpy())].astype(np.int64)
    y = rows.column("y").to_numpy().astype(np.int64)
    per_class = np.array([counts.get(0, 0) / max(n0, 1), counts.get(1, 0) / max(n1, 1)])
    return {"terms": (words, beginnings, idf), "vectors": (start, *(x.flatten().to_numpy() for x in lists)), "y": y, "ids": rows.column("doc_id").to_numpy().astype(np.int64), "weight": per_class, "rate": counts.get(1, 0) / max(1, sum(counts.values()))}


def trained(spark: SparkSession, *args) -> Broadcast:
    """train()'s model for the tasks; the driver's Python keeps none of it."""
    shared = spark.sparkContext.broadcast(train(spark, *args))
    tidy()
    return shared


class Scorer:
    """Scores texts by a model of train()."""

    def __init__(self, model: dict):
        self.model, self.vectors = model, Vectors(*model["terms"])
        self.index = BlockMaxIndex(*model["vectors"], len(model["terms"][-1]))
        self.dense = np.zeros(len(model["terms"][-1]))
        self.place = {i: k for k, i in enumerate(model["ids"].tolist())}

    def score_all(self, texts: pa.Array, own: list[int | None], k: int = K):
        """Of each text its score, neighbours' places and their similarities; own: the texts' ids, which are no neighbours."""
        own = np.array([-1 if i is None else self.place.get(i, -1) for i in own], np.int64)
        model, (start, terms, weights) = self.model, self.vectors.of(texts)
        vague = VAGUE * model["weight"].mean()
        for at in range(0, len(texts), TOGETHER):
            s = start[at : at + TOGETHER + 1]
            some = slice(s[0], s[-1])
            for me, first, last, base in zip(own[at:], s, s[1:], self.index.frequent(s - s[0], terms[some], weights[some])):
                rows, near = self.index.search(terms[first:last], weights[first:last], k + (me >= 0), base, self.dense) if first < last else (np.empty(0, np.int64), np.empty(0))
                rows, near = rows[rows != me][:k], near[rows != me][:k]
                y = model["y"][rows]
                votes = near * model["weight"][y]
                yield (float(min(1.0, (votes @ y + vague * model["rate"]) / (votes.sum() + vague))) if len(rows) else model["rate"]), rows, near


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, score, neighbours array<struct<doc_id, label, similarity>>."""
    small_batches(spark)
    shared, name = trained(spark, docs, labels, id_col, text_col, label_col), f"toxicity {uuid.uuid4().hex}"

    def run(batches):
        scorer = kept(name, lambda: Scorer(shared.value))
        model = scorer.model
        for b in slices(batches, "text", PORTION):
            found = list(scorer.score_all(b.column("text"), b.column("doc_id").to_pylist()))
            rows = np.concatenate([r for _, r, _ in found])
            parts = [pa.array(model["ids"][rows]), pa.array(model["y"][rows], pa.int32()), pa.array(np.concatenate([x for _, _, x in found]))]
            ends = np.cumsum([0, *(len(r) for _, r, _ in found)])
            near = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["doc_id", "label", "similarity"]))
            yield pa.record_batch([b.column("doc_id"), pa.array([s for s, _, _ in found], pa.float64()), near], ["doc_id", "score", "neighbours"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double, neighbours array<struct<doc_id:long,label:int,similarity:double>>")


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: float = 0.5) -> DataFrame:
    """The rows of docs with a score under `most`, with docs' own columns. Each row is judged by its own text."""
    small_batches(spark)
    shared, name = trained(spark, docs, labels, id_col, text_col, label_col), f"toxicity {uuid.uuid4().hex}"

    def run(batches):
        scorer = kept(name, lambda: Scorer(shared.value))
        for b in slices(batches, text_col, PORTION):
            texts = pc.fill_null(b.column(text_col).cast(pa.string()), "")
            yield b.filter(pa.array([s < most for s, _, _ in scorer.score_all(texts, b.column(id_col).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
