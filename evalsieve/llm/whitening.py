"""Whitening of embeddings by a two-pass covariance (operator 12).

Entries c become whole numbers x = floor(SCALE * c) + OFFSET. The first pass adds them up, exactly; the second adds up outer
products of what is left when the mean is taken off, a matrix product for each Arrow batch. Both give one partial sum for
each task, and treeAggregate merges these in steps on the executors. The driver gets one matrix of dimension squared,
LAPACK's symmetric solver gives eigenvalues and vectors, and the projection is broadcast. Rows are never shuffled.

Projected values are centred as they are made, since n * x - S adds up to zero exactly. A third pass adds up their outer
products, for the largest error against the identity.

Defined results: vectors that are null, empty or hold null or non-finite entries take no part, nor do those with an entry
beyond LARGEST, which is no whole number of 64 bits. Vectors of each length are a table of their own, with its own n, mean and
components. Components whose eigenvalue is below 1e-12 of the largest (constant or linearly dependent dimensions, or fewer
vectors than dimensions) have null in whitened and do not count in identity_error, which is 0 if none is left; explained is
null where all vectors are equal. deviation is null if it needs more than 64 bits. Rows with a null id stay, equal rows count
each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

SCALE, OFFSET = 64.0, 1_000_000
LARGEST = float(1 << 56)
MOST = 32
#: rows projected at a time
ROWS = 4096
#: an eigenvalue this much smaller than the largest is none
NOTHING = 1e-12


def usable(vector: Column) -> Column:
    """Neither null nor empty, and all entries finite and small enough for 64 bits."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) <= LARGEST))


def whole(batch: pa.RecordBatch, scale: float, offset: int):
    """(places, matrix of int64) of a batch's vectors, for each length."""
    lists = batch.column("v")
    sizes = pc.list_value_length(lists).to_numpy()
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    for length in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == length)
        c = values[(ends[at] - length)[:, None] + np.arange(length)].astype(np.float64)
        yield length, at, np.floor(scale * c).astype(np.int64) + offset


def fits(largest: int, times: int) -> bool:
    """Whether `times` numbers of that size add up within 63 bits."""
    return largest * times < 1 << 63


def exactly(x: np.ndarray, times: int) -> np.ndarray:
    """x, as Python's integers where sums of `times` entries wouldn't fit 64 bits."""
    return x if fits(int(np.abs(x).max(initial=0)), times) else x.astype(object)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, exactly."""
    largest = max(int(np.abs(x).max(initial=0)), max(map(abs, total)) // n + 1)
    kind = np.int64 if fits(largest, 2 * n) else object
    return x.astype(kind) * n - np.array(total, dtype=kind)


class Fit:
    """What one length's vectors have in common: n, sums, components (rows), eigenvalues, share explained."""

    def __init__(self, n: int, total: list[int], moment: np.ndarray, most: int):
        self.n, self.total = n, total
        values, vectors = np.linalg.eigh(moment / n)
        order = np.argsort(-values, kind="stable")[:most]
        self.values = values[order]
        trace = float(np.trace(moment / n))
        # of the two signs, the one that makes the entry of greatest size positive
        components = vectors[:, order].T
        self.components = components * np.sign(components[np.arange(len(order)), np.abs(components).argmax(axis=1)])[:, None]
        self.live = self.values > NOTHING * max(float(values.max()), 0.0)
        self.explained = self.values / trace if trace > 0 else None
        self.error = 0.0

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened values (rows, live components) of centred vectors."""
        return y @ (self.components[self.live] / np.sqrt(self.values[self.live])[:, None]).T


def merged(parts: DataFrame, add, tasks: int) -> dict:
    """Pickled {length: sums}, one for each task, merged pairwise on the executors and at last here."""

    def seq(a: dict, row) -> dict:
        for k, v in pickle.loads(bytes(row[0])).items():
            a[k] = add(a[k], v) if k in a else v
        return a

    def comb(a: dict, b: dict) -> dict:
        for k, v in b.items():
            a[k] = add(a[k], v) if k in a else v
        return a

    return parts.rdd.treeAggregate({}, seq, comb, depth=2 if tasks < 1000 else 3)


def each_task(rows: DataFrame, step):
    """One row (sums binary) for each task: {length: sums}, of the (length, sums) that step(batch) yields."""

    def run(batches):
        sums: dict = {}
        for batch in batches:
            for length, new in step(batch):
                sums[length] = tuple(a + b for a, b in zip(sums[length], new)) if length in sums else new
        yield pa.record_batch([pa.array([pickle.dumps(sums)], pa.binary())], ["sums"])

    return rows.mapInArrow(run, "sums binary")


def add(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def fit(spark: SparkSession, rows: DataFrame, scale: float = SCALE, offset: int = OFFSET, most: int = MOST) -> dict[int, Fit]:
    """The Fit of each length among rows (v: vectors that are usable)."""
    tasks = rows.rdd.getNumPartitions()

    def adding(batch):
        for length, at, x in whole(batch, scale, offset):
            yield length, (len(at), exactly(x, len(at)).sum(axis=0).astype(object))

    totals = {k: (n, [int(s) for s in total]) for k, (n, total) in merged(each_task(rows, adding), add, tasks).items()}
    shared = spark.sparkContext.broadcast(totals)

    def products(batch):
        for length, _, x in whole(batch, scale, offset):
            n, total = shared.value[length]
            y = centred(x, n, total).astype(np.float64) / n
            yield length, (y.T @ y,)

    moments = merged(each_task(rows, products), add, tasks)
    fits_ = {k: Fit(n, total, moments[k][0], most) for k, (n, total) in totals.items()}
    known = spark.sparkContext.broadcast(fits_)

    def squares(batch):
        for length, _, x in whole(batch, scale, offset):
            f = known.value[length]
            z = f.project(centred(x, f.n, f.total).astype(np.float64) / f.n)
            yield length, (z.T @ z,)

    for k, (square,) in merged(each_task(rows, squares), add, tasks).items():
        fits_[k].error = float(np.abs(square / fits_[k].n - np.eye(len(square))).max(initial=0.0))
    return fits_


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def projecting(known, scale: float, offset: int):
    """(vec_id, v) -> rows of SCHEMA."""

    def rows_of(ids: pa.Array, x: np.ndarray, f: Fit) -> pa.RecordBatch:
        y = centred(x, f.n, f.total)
        largest = int(np.abs(y).max(initial=0))
        squares = (y if fits(largest * largest, y.shape[1]) else y.astype(object)) ** 2
        deviation = [int(d) if d < 1 << 63 else None for d in squares.sum(axis=1).tolist()]
        z = np.full((len(x), len(f.values)), np.nan)
        z[:, f.live] = f.project(y.astype(np.float64) / f.n)
        count, k = len(x), len(f.values)
        again = pa.array(np.repeat(np.arange(count), k))
        explained = pa.array(np.tile(f.explained, count)) if f.explained is not None else pa.nulls(count * k, pa.float64())
        columns = [ids.take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, f.n, np.int64)), pa.array(deviation, pa.int64()).take(again)]
        return pa.record_batch([*columns, pa.array(z.ravel(), from_pandas=True), explained, pa.array(np.full(count * k, f.error))], [c.split()[0] for c in SCHEMA.split(", ")])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                for length, at, x in whole(part, scale, offset):
                    yield rows_of(part.column("vec_id").take(pa.array(at)), x, known.value[length])

    return run


def whiten(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, offset: int = OFFSET, most: int = MOST) -> DataFrame:
    """Rows of SCHEMA: each usable vector's whitened value on each of the `most` first components."""
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    fits_ = fit(spark, rows.select("v"), scale, offset, most)
    return rows.mapInArrow(projecting(spark.sparkContext.broadcast(fits_), scale, offset), SCHEMA)
