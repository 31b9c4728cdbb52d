"""Packing token sequences by linear grouping (operator 7).

Every text becomes token ids and a closing id; ids beyond one sequence are cut into pieces of the sequence's length.
How to pack depends on the piece lengths alone, so the driver sees a histogram of at most `capacity` rows and the plan
it makes has a bounded size too, whatever the number of documents:

1. lengths over capacity * share, for each share of LARGE, are sorted and cut into GROUPS groups of equal cardinality, each
   rounded up to its greatest length;
2. configurations (how many pieces of each group share a sequence) are optimised by column generation: a linear
   programme over configurations, new ones found by a knapsack over the dual prices; whole parts of the solution are
   taken;
3. actual lengths replace the rounded ones, but for each configuration's shortest, whose room best fit fills exactly;
4. the pieces left over and the small ones go, longest first, into the sequence with the least room that holds them;
5. of the shares' plans the one with the fewest sequences stays; the first that needs no more than the tokens do ends the
   search. Low shares leave configurations most to decide, which pays where several large pieces share a sequence; with 1/2,
   a configuration is one piece, and the plan is what best fit alone would make, so no plan is worse than that.

Pieces get consecutive ranks within their length, and the plan turns (length, rank) into sequence and offset. Ranks
are counted in salted parts, so a length that many documents share is no bottleneck.

Defined results: null text counts as empty and gives the closing id alone. Repeated rows are packed one by one; texts of
any length are encoded whole. An empty table gives an empty result. Columns besides id and text are not read. The
tokenizer's file has to be on every executor, under the path given.
"""

from __future__ import annotations

import array
import gc
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, slices, small_batches, text_or_empty, written

CAPACITY, LARGE, GROUPS, CLOSE = 2048, (1 / 8, 1 / 3, 1 / 2), 32, 0
MEMO, PORTION = 400_000, 2_000_000


class ChunkIds:
    """Token ids of texts cut at blanks and line feeds, as unsigned 32-bit numbers.

    Holds for tokenizers that lower-case, part letters from other characters and never join across white space; a
    text's ids are then those of its chunks, and letters before one of PUNCTUATION stand on their own. Others get
    whole texts. Chunks of LETTERS alone, lower-cased, pass normaliser and pattern unchanged, so they go to the same
    vocabulary and merges without these two, many chunks to a call.
    """

    PUNCTUATION = frozenset(".,;:!?")
    LETTERS = "\u0250"  # below it no letter is a combining mark or changes under NFC
    CALL = 512

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.load(open(path, encoding="utf-8"))
        kinds = [[x["type"] for x in (said[k] or {}).get(f"{k.replace('_', '')}s", [])] for k in ("normalizer", "pre_tokenizer")]
        self.by_chunk = kinds == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]
        if self.by_chunk:
            bytes_only = said["pre_tokenizer"]["pretokenizers"][1]
            self.letters = Tokenizer.from_str(json.dumps(said | {"normalizer": None, "pre_tokenizer": bytes_only, "added_tokens": []}))
            self.marks = {"": b""} | dict(zip(sorted(self.PUNCTUATION), self.whole(sorted(self.PUNCTUATION))))
        # the chunks remembered, and where each one's ids are in `flat`; the first ones met, which mostly are the frequent ones
        self.chunks, self.flat, self.start = pa.array([], pa.string()), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for at in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]

    def learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks that aren't remembered."""
        marks, letters = self.marks, self.LETTERS
        bodies = [c[:-1] if c and c[-1] in marks else c for c in chunks]
        lows = [x.lower() if x.isalpha() and (x.isascii() or (max(x) < letters and len(x.lower()) == len(x))) else "" for x in bodies]
        plain = [c for c, low in zip(chunks, lows) if not low and c]
        known = dict(zip(plain, self.whole(plain)), **{"": b""})
        words = list(dict.fromkeys(low for low in lows if low))
        for at in range(0, len(words), 8 * self.CALL):
            calls = [words[i : i + self.CALL] for i in range(at, min(at + 8 * self.CALL, len(words)), self.CALL)]
            for call, e in zip(calls, self.letters.encode_batch(calls, is_pretokenized=True, add_special_tokens=False)):
                buf = array.array("I", e.ids).tobytes()
                ends = (4 * np.searchsorted(np.array(e.word_ids), np.arange(1, len(call) + 1))).tolist()
                known.update(zip(call, map(buf.__getitem__, map(slice, [0, *ends], ends))))
        return [known[low] + marks[c[len(low) :]] if low else known[c] for c, low in zip(chunks, lows)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; where each text's ids end)."""
        if not self.by_chunk:
            found = self.whole(texts.to_pylist())
            return np.frombuffer(b"".join(found), np.uint32), np.cumsum([len(x) // 4 for x in found], dtype=np.int64)
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        place = pc.index_in(coded.dictionary, self.chunks)
        new = coded.dictionary.filter(pc.is_null(place))
        ids = self.learn(new.to_pylist())
        flat = np.concatenate((self.flat, np.frombuffer(b"".join(ids), np.uint32)))
        start = np.concatenate((self.start, self.start[-1] + np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)))
        at = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(self.chunks) + np.arange(len(new))
        each = at[coded.indices.to_numpy()]
        n = start[each + 1] - start[each]
        ends = np.cumsum(n)
        out = flat[np.repeat(start[each] - (ends - n), n) + np.arange(n.sum())]
        if room := min(len(new), MEMO - len(self.chunks)):
            self.chunks = pa.concat_arrays([self.chunks, new[:room]])
            self.start = start[: len(self.chunks) + 1]
            self.flat = flat[: self.start[-1]]
        last = np.cumsum(pc.list_value_length(parts).to_numpy())
        return out, np.concatenate(([0], ends))[last]


def cutter(path: str, capacity: int, close: int, with_ids: bool = False):
    closing = np.array([close], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = kept(f"chunk ids {path}", lambda: ChunkIds(path))
        row = TaskContext.get().partitionId() << 33
        gc.disable()  # millions of small objects, none of them in cycles
        for b in slices(batches, "text", PORTION):
            out: list[list] = [[] for _ in names]
            ids, ends = coder.encode(b.column("text"))
            for doc_id, first, last in zip(b.column("doc_id").to_pylist(), [0, *ends.tolist()], ends.tolist()):
                buf = ids[first:last].tobytes() + closing
                n = len(buf) // 4
                for piece, at in enumerate(range(0, n, capacity)):
                    part = buf[4 * at : 4 * (at + capacity)]
                    for column, x in zip(out, (doc_id, piece, at, len(part) // 4, zlib.crc32(part), row)):
                        column.append(x)
                    if with_ids:
                        out[-1].append(np.frombuffer(part, "<i4"))
                row += 1
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds)], names)
        gc.enable()

    return run


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of sizes within capacity: its price and the number of each size."""
    worth, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    low = int(sizes.min())
    for c in range(low, capacity + 1):
        fits = sizes <= c
        v = np.where(fits, prices + worth[np.maximum(c - sizes, 0)], 0)
        j = int(v.argmax())
        if v[j] > worth[c - 1] + 1e-12:
            worth[c], taken[c] = v[j], j
        else:
            worth[c] = worth[c - 1]
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c >= low:
        if taken[c] < 0:
            c -= 1
        else:
            counts[taken[c]] += 1
            c -= sizes[taken[c]]
    return float(worth[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each; the whole part of a solution within 0.02 % of the best."""
    g = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    use = demand / basis.diagonal()
    for _ in range(40 * g):
        prices = np.linalg.solve(basis.T, np.ones(g))
        value, counts = knapsack(sizes, prices, capacity)
        if value <= 1 + 1e-9 or use.sum() <= prices @ demand / value * 1.0002:
            break
        direction = np.linalg.solve(basis, counts.astype(float))
        ratio = np.where(direction > 1e-9, use / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        use = np.maximum(use - step * direction, 0)
        use[out] = step
        basis[:, out] = counts
    return [(basis[:, k].round().astype(np.int64), int(use[k] + 1e-6)) for k in range(g) if int(use[k] + 1e-6) > 0]


def best_fit(bins: list[tuple[int, int, list]], left: dict[int, int], capacity: int) -> list[tuple[int, int, list]]:
    """Puts left (length -> count), longest first, each piece where the least room is that holds it.

    bins: (how many sequences, room in each, what each holds as (length, count)).
    """
    import bisect

    rooms: dict[int, list] = {}
    order: list[int] = []

    def put(n: int, room: int, held: list) -> None:
        if n:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append((n, held))

    for b in bins:
        put(*b)
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                put(-(-count // (capacity // length)), capacity, [])
                continue
            room = order[at]
            n, held = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            each = min(room // length, count)
            whole = min(n, count // each)
            put(whole, room - each * length, [*held, (length, each)])
            put(n - whole, room, held)
            count -= whole * each
    return [(n, room, held) for room, some in rooms.items() for n, held in some]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: tuple[float, ...] = LARGE, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, number of ranks, first sequence, pieces of the length in each, their offset)."""
    least = -(-sum(k * n for k, n in histogram.items()) // capacity)
    best: tuple[int, list] | None = None
    for share in large:
        made = filled(histogram, capacity, share, groups)
        n = sum(n for n, _, _ in made)
        if best is None or n < best[0]:
            best = n, made
        if n == least:
            break
    done, rows, sequence = dict.fromkeys(histogram, 0), [], 0
    for n, _, held in best[1]:
        offset = 0
        for length, each in held:
            rows.append((length, done[length], n * each, sequence, each, offset))
            done[length] += n * each
            offset += each * length
        sequence += n
    return rows


def filled(histogram: dict[int, int], capacity: int, share: float, groups: int) -> list[tuple[int, int, list]]:
    """Sequences as (how many, room in each, what each holds as (length, count)), by configurations of lengths over
    capacity * share."""
    left = {k: v for k, v in histogram.items() if v}
    bins: list[tuple[int, int, list]] = []
    large = sorted((k for k in left if share * capacity < k < capacity), reverse=True)
    if large:
        total, stock, sizes, demand, seen = sum(left[k] for k in large), [], [], [], 0
        for length in large:  # a length stays whole, so groups are equal up to the last length's count
            if not stock or seen * groups >= len(stock) * total:
                stock.append([])
                sizes.append(length)
                demand.append(0)
            stock[-1].append([length, left[length]])
            demand[-1] += left[length]
            seen += left[length]
        for counts, n in configurations(np.array(sizes), np.array(demand, float), capacity):
            slots = [j for j, c in enumerate(counts) for _ in range(c)]
            slots = slots[:-1] or slots  # the shortest is chosen last, by the room that actual lengths leave
            while n and slots:
                slots = [j for j in slots if stock[j]]
                if not slots:
                    break
                need = {j: slots.count(j) for j in set(slots)}
                k = min([n, *(max(1, stock[j][0][1] // need[j]) for j in need)])
                held, room = [], capacity
                for j in need:
                    want = need[j]
                    if k > 1 or stock[j][0][1] >= want:
                        takes = [(stock[j][0], want)]
                    else:  # one sequence, whose pieces of this group differ in length
                        takes = []
                        for run in stock[j]:
                            take = min(run[1], want)
                            takes.append((run, take))
                            want -= take
                            if not want:
                                break
                    for run, take in takes:
                        run[1] -= take * k
                        left[run[0]] -= take * k
                        room -= run[0] * take
                        held.append((run[0], take))
                    stock[j] = [run for run in stock[j] if run[1]]
                bins.append((k, room, held))
                n -= k
    return best_fit(bins, {k: v for k, v in left.items() if v}, capacity)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, close: int = CLOSE, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (array<int>) if asked for."""
    small_batches(spark)
    more = ["ids"] * with_ids
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    pieces = written(spark, texts.mapInArrow(cutter(tokenizer, capacity, close, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, row long" + ", ids array<int>" * with_ids), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 6)
    salts = max(32, max(histogram.values(), default=0) // 100_000)

    from pyspark.sql import Window

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece"))).join(F.broadcast(before) if salts <= 64 else before, ["length", "salt"])

    wide = np.int64(1) << np.int64(44)  # ranks of one length stay below

    def place(batches):
        first = rows[:, 0] * wide + rows[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            r = rows[np.searchsorted(first, length * wide + rank, "right") - 1]
            at = rank - r[:, 1]
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(r[:, 3] + at // r[:, 4]), pa.array(r[:, 5] + at % r[:, 4] * length), *(b.column(c) for c in more)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *more])

    ready = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *more, (F.col("before") + F.col("nth") - 1).alias("rank"))
    return ready.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets): the packed sequences themselves, from pack(..., with_ids=True).

    A group is one sequence, of `capacity` ids at most.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    each = lambda c: F.transform("x", lambda p: p[c])
    return packed.groupBy("sequence_id").agg(parts.alias("x")).select("sequence_id", F.flatten(each("ids")).alias("ids"), each("doc_id").alias("doc_ids"), each("offset").alias("offsets"))
