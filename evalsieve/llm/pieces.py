"""SentencePiece encoding and decoding on the tokenizers library (operator 6).

The model file's protobuf is parsed here; its normaliser, metaspace marker, scores and byte fallback are rebuilt as a
tokenizers pipeline: a unigram model from the scores, or, where the file holds a BPE model, the merges that its scores
imply (such a file read as unigram would segment otherwise). Texts are cut before each run of blanks that follows
another character, where no piece can reach across; chunks are encoded in batches on THREADS threads, once for each
worker process while they are remembered, and each new chunk is held against the sentencepiece library: if the two
differ, the text is marked, and its ids are the rebuilt tokenizer's all the same. Decoding is checked chunk by chunk as well.

Defined results: null text counts as empty and has no ids. Texts whose marker characters are themselves in the text
don't decode to themselves and are marked so. Repeated rows are encoded each; texts of any length are encoded whole. An
empty table gives an empty result. Other columns are not read. The model's file has to be on every executor, under the
path given.
"""

from __future__ import annotations

import array
import os
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices, small_batches, text_or_empty

THREADS, MEMO = 2, 200_000
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes):
    """(number, value) of a protobuf message's fields."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(data, at)
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


def parse(data: bytes) -> dict:
    """pieces [(text, score, type)], model type, and the normaliser's settings."""
    import struct

    model = {"pieces": [], "type": UNIGRAM, "charsmap": b"", "dummy_prefix": True, "trim": True, "escape": True}
    for number, value in fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(fields(value))
            model["pieces"].append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            model["type"] = dict(fields(value)).get(3, UNIGRAM)
        elif number == 3:
            said = dict(fields(value))
            model |= {"charsmap": said.get(2, b""), "dummy_prefix": bool(said.get(3, 1)), "trim": bool(said.get(4, 1)), "escape": bool(said.get(5, 1))}
    return model


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs in the order in which a BPE model of these scores joins them."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    found = []
    for p, i in ids.items():
        for k in range(1, len(p)):
            a, b = p[:k], p[k:]
            if a in ids and b in ids:
                found.append((-pieces[i][1], i, ids[a], ids[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def rebuild(model: dict):
    """The tokenizers pipeline for a parsed model. It adds no prefix: texts come with the dummy blank."""
    from tokenizers import Tokenizer, decoders, models, normalizers

    unknown = next((p for p, _, kind in model["pieces"] if kind == UNKNOWN), None)
    fallback = any(kind == BYTE for _, _, kind in model["pieces"])
    if model["type"] == BPE:
        built = models.BPE({p: i for i, (p, _, _) in enumerate(model["pieces"])}, merges_of(model["pieces"]), unk_token=unknown, fuse_unk=True, byte_fallback=fallback)
    else:
        built = models.Unigram([(p, s) for p, s, _ in model["pieces"]], next((i for i, x in enumerate(model["pieces"]) if x[2] == UNKNOWN), None), fallback)
    tokenizer = Tokenizer(built)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["trim"]:
        steps.append(normalizers.Replace(__import__("tokenizers").Regex(" {2,}"), " "))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return tokenizer


class Coder:
    """ids of chunks, kept; parity and round trip of each."""

    CHUNK = re.compile(r" *[^ ]+| +")

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        self.model = parse(data)
        self.tokenizer = rebuild(self.model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        # cutting is sound if no piece goes on with a marker after another character
        self.by_chunk = not self.model["charsmap"] and not self.model["trim"] and self.model["dummy_prefix"] and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.model["pieces"] if kind in (NORMAL, USER))
        self.known: dict[str, tuple[bytes, bool, bool]] = {}

    def learn(self, new: list[str]) -> None:
        mine = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        # the library puts the dummy blank before a text itself; every chunk begins with that blank
        theirs = self.library.encode([c[1:] for c in new], num_threads=1)
        for i, c in enumerate(new):
            if c == " ":  # a text's last blank; alone, the library would take it for an empty text
                theirs[i] = self.library.encode("a ")[len(self.library.encode("a")) :]
        texts = self.tokenizer.decode_batch(mine, skip_special_tokens=False)
        for chunk, a, b, text in zip(new, mine, theirs, texts):
            self.known[chunk] = (array.array("I", a).tobytes(), a == b, text == chunk)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """(ids as little-endian unsigned 32-bit numbers, whether both libraries agree, whether decoding returns the text)."""
        if not self.by_chunk:
            return self.encode_whole(texts)
        parts = [self.CHUNK.findall(" " + t) if t else [] for t in texts]
        before = len(self.known)
        self.learn(list(set().union(*parts).difference(self.known)))
        out = []
        for p in parts:
            found = [self.known[c] for c in p]
            out.append((b"".join([x[0] for x in found]), all(x[1] for x in found), all(x[2] for x in found)))
        if len(self.known) > MEMO:
            from itertools import islice

            for c in list(islice(self.known, max(before, MEMO), None)):
                del self.known[c]
        return out

    def encode_whole(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        prepared = [(" " + t if self.model["dummy_prefix"] and t else t) for t in texts]
        if self.model["trim"]:
            prepared = [(" " if self.model["dummy_prefix"] and t.strip(" ") else "") + t.strip(" ") for t in texts]
        mine = [e.ids for e in self.tokenizer.encode_batch_fast(prepared, add_special_tokens=False)]
        theirs = self.library.encode(texts, num_threads=1)
        return [(array.array("I", a).tobytes(), a == b, self.library.decode(a) == t) for t, a, b in zip(texts, mine, theirs)]


def coder(path: str) -> Coder:
    return kept(f"coder {path}", lambda: Coder(path))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_ids, ids_crc32, parity, round_trip, and ids (array<int>) if asked for."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(THREADS)
        codes = coder(model)
        for b in slices(batches):
            found = codes.encode(b.column("text").to_pylist())
            columns = [b.column("doc_id"), pa.array([len(x[0]) // 4 for x in found], pa.int64()), pa.array([zlib.crc32(x[0]) for x in found], pa.int64()), pa.array([x[1] for x in found], pa.bool_()), pa.array([x[2] for x in found], pa.bool_())]
            names = ["doc_id", "n_ids", "ids_crc32", "parity", "round_trip"]
            if with_ids:
                columns.append(pa.array([array.array("I", x[0]).tolist() for x in found], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(columns, names)

    return texts.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, parity boolean, round_trip boolean" + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of an array of ids; null ids count as none."""

    def run(batches):
        codes = coder(model)
        for b in batches:
            texts = codes.tokenizer.decode_batch([x or [] for x in b.column("ids").to_pylist()], skip_special_tokens=False)
            yield pa.record_batch([b.column("doc_id"), pa.array([t[1:] if codes.model["dummy_prefix"] else t for t in texts], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
