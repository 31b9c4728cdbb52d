"""Media columns of baseline JPEGs (operator 13).

read() takes any baseline JPEG (8 bits, Huffman coded; one to four components, any sampling factors, interleaved or separate
scans, restart intervals): it parses the markers, decodes the scans and reconstructs, of the luminance, one pixel for each
block of 8 x 8 from the DC coefficient alone. Dimensions and hashes of this thumbnail are stored beside the picture.

Scans are decoded in numpy, not symbol by symbol in Python: every restart interval of every picture of a batch is a lane,
and each step takes one Huffman symbol of all lanes by one lookup of 16 bits. A scan without restart intervals is one lane.

stored() makes pictures that hold text without loss: 64 bytes are the 64 coefficients of a block, in zigzag order, less 128;
the first of them is the DC coefficient, so a thumbnail is every 64th byte. The quantiser is 8 for DC and 1 for AC, which
makes a pixel of the thumbnail the byte itself. A row of blocks is a restart interval. A comment holds the payload's lengths.

Defined results: null text is stored as empty; texts are of any length (up to 4 GB, the largest picture); equal texts give
equal pictures. In read(), null, truncated, damaged and other than baseline pictures have an error and no features; a row
whose picture wasn't made by stored() has features but no payload. Equal rows count each; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, text_or_empty

UNIT = 64
#: blocks in a row of a stored picture, unless it would be higher than a JPEG can be
WIDTH, HIGHEST = 16, 8191
#: bytes of pictures decoded, and of payload encoded, at a time
AT_ONCE = 1 << 20
#: different Huffman tables decoded at a time, 1 MB each
TABLES = 32

# Huffman codes of stored pictures. Text is mostly lower-case letters, whose coefficients have a size of five bits, then
# blanks (seven) and capitals (six); runs of zeros are rare.
DC_LENGTHS = {7: 2, 6: 2, 5: 2, 8: 3, 4: 4, 3: 5, 2: 6, 1: 7, 0: 8}
AC_LENGTHS = {5: 1, 7: 2, 4: 3, 6: 4, 3: 5, 8: 6, 0xF0: 8, 1: 8, 2: 9, 0x00: 9} | {run << 4 | size: 16 for run in range(1, 16) for size in range(1, 9)}

COMMENT = re.compile(rb"payload (\d+) text (\d+)")


def canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """(what a DHT segment says, symbol -> (code, length)): codes are counted up by length, then by place."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], list(lengths).index(s)))
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    codes, code, before = {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - before
        before = lengths[s]
        codes[s] = (code, before)
        code += 1
    return bytes(counts) + bytes(symbols), codes


DC_SAYS, DC_CODES = canonical(DC_LENGTHS)
AC_SAYS, AC_CODES = canonical(AC_LENGTHS)


def by_value(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(code with the extra bits behind it, bits) of the values -255 to 255, at value + 255."""
    code, bits = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for value in range(-255, 256):
        size = abs(value).bit_length()
        if size in codes and (value or codes is DC_CODES):
            prefix, n = codes[size]
            code[value + 255] = prefix << size | (value if value >= 0 else value + (1 << size) - 1)
            bits[value + 255] = n + size
    return code, bits


# writing


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(wide: int, high: int, payload: int, text: int) -> bytes:
    """Everything before the scan's data, for a picture of wide x high blocks."""
    return b"".join(
        [
            b"\xff\xd8",
            segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            segment(0xFE, b"payload %d text %d" % (payload, text)),
            segment(0xDB, b"\0" + bytes([8] + [1] * 63)),
            segment(0xC0, struct.pack(">BHHB3B", 8, 8 * high, 8 * wide, 1, 1, 0x11, 0)),
            segment(0xC4, b"\x00" + DC_SAYS + b"\x10" + AC_SAYS),
            segment(0xDD, struct.pack(">H", wide)),
            segment(0xDA, b"\1\1\0\0\x3f\0"),
        ]
    )


def tokens(blocks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, their bits, block of each) of coefficients (blocks, 64); first: blocks that begin a restart interval."""
    (dc_code, dc_bits), (ac_code, ac_bits) = by_value(DC_CODES), by_value(AC_CODES)
    told = blocks != 0
    told[:, 0] = True
    at = np.flatnonzero(told)
    k = at & 63
    value = blocks.ravel()[at] + np.int16(255)
    code, bits = ac_code.take(value), ac_bits.take(value)  # of values that no zeros precede
    head = np.flatnonzero(k == 0)
    dc = blocks[:, 0].astype(np.int64)
    difference = np.where(first, dc, dc - np.r_[0, dc[:-1]]) + 255
    code[head], bits[head] = dc_code[difference], dc_bits[difference]
    run = np.diff(at, prepend=-1) - 1  # a block's DC is always told, so runs stay within a block
    run[head] = 0
    for i in np.flatnonzero(run).tolist():
        v = int(value[i]) - 255
        size = abs(v).bit_length()
        (zrl, zrl_bits), (prefix, n) = AC_CODES[0xF0], AC_CODES[(int(run[i]) & 15) << 4 | size]
        whole = 0
        for _ in range(int(run[i]) >> 4):
            whole = whole << zrl_bits | zrl
        code[i] = (whole << n | prefix) << size | (v if v >= 0 else v + (1 << size) - 1)
        bits[i] = zrl_bits * (int(run[i]) >> 4) + n + size
    tail = np.r_[head[1:] - 1, len(at) - 1]
    tail = tail[k[tail] < 63]  # blocks that end in zeros
    eob, n = AC_CODES[0x00]
    code[tail] = code[tail] << np.uint64(n) | np.uint64(eob)
    bits[tail] += n
    return code, bits, head


def packed(code: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bytes of codes of 1 to 64 bits, one after another; together they fill the last byte."""
    while len(bits) > 1 and bits.max() <= 32:  # two are one
        if len(bits) & 1:
            code, bits = np.r_[code, np.uint64(0)], np.r_[bits, 0]
        code, bits = code[::2] << bits[1::2].astype(np.uint64) | code[1::2], bits[::2] + bits[1::2]
    start = np.cumsum(bits) - bits
    size = int(start[-1] + bits[-1]) >> 3
    words = np.zeros(size // 8 + 2, np.uint64)
    word, left = start >> 6, 64 - (start & 63) - bits
    high = np.where(left >= 0, code << np.maximum(left, 0).astype(np.uint64), code >> np.maximum(-left, 0).astype(np.uint64))
    firsts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[firsts]] = np.bitwise_or.reduceat(high, firsts)
    over = np.flatnonzero(left < 0)  # at most the last code of each word
    words[word[over] + 1] |= code[over] << (64 + left[over]).astype(np.uint64)
    return words.astype(">u8").view(np.uint8)[:size]


def scan_data(blocks: np.ndarray, rows: np.ndarray, ordinal: np.ndarray, last: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(entropy-coded bytes of restart intervals, where each ends): rows[i] blocks each, the ordinal-th of its picture."""
    begin = np.cumsum(rows) - rows
    first = np.zeros(len(blocks), bool)
    first[begin] = True
    code, bits, head = tokens(blocks, first)
    of_row = head[begin]  # each row's first code
    total = np.add.reduceat(bits, of_row)
    size = (total + 7) >> 3
    tail, fill = np.r_[of_row[1:] - 1, len(bits) - 1], size * 8 - total  # an interval is filled up with ones
    code[tail] = code[tail] << fill.astype(np.uint64) | ((1 << fill) - 1).astype(np.uint64)
    bits[tail] += fill
    data = packed(code, bits)
    full = data == 0xFF
    marks = np.where(last, 0, 2)
    end = np.cumsum(size)
    place = np.arange(len(data)) + np.cumsum(full) - full + np.repeat(np.cumsum(marks) - marks, size)
    out = np.zeros(len(data) + int(full.sum()) + int(marks.sum()), np.uint8)
    out[place] = data
    ends = place[end - 1] + 1 + full[end - 1]
    marked = ends[~last]
    out[marked], out[marked + 1] = 0xFF, 0xD0 + (ordinal[~last] & 7)
    return out.tobytes(), ends + marks


def pictures(payloads: list[bytes], texts: list[int]) -> list[bytes]:
    """A JPEG for each payload, a positive multiple of 64 bytes; texts: how many of them are text."""
    counts = [len(p) // UNIT for p in payloads]
    wides = [max(min(n, WIDTH), -(-n // HIGHEST)) for n in counts]
    highs = [-(-n // w) for n, w in zip(counts, wides)]
    out = [[header(w, h, len(p), n)] for w, h, p, n in zip(wides, highs, payloads, texts)]
    waiting: list[tuple[int, int, int]] = []  # (picture, row from, to)

    def flush() -> None:
        if not waiting:
            return
        parts, rows, ordinal, last, of = [], [], [], [], []
        for i, a, b in waiting:
            w = wides[i]
            some = np.frombuffer(payloads[i], np.uint8, count=min(len(payloads[i]), b * w * UNIT) - a * w * UNIT, offset=a * w * UNIT)
            parts.append(some)
            parts.append(np.full((b - a) * w * UNIT - len(some), 128, np.uint8))  # a last row is filled up with zero coefficients
            rows += [w] * (b - a)
            ordinal += range(a, b)
            last += [r == highs[i] - 1 for r in range(a, b)]
            of += [i] * (b - a)
        blocks = (np.concatenate(parts).astype(np.int16) - 128).reshape(-1, UNIT)
        data, ends = scan_data(blocks, np.array(rows), np.array(ordinal), np.array(last))
        at = 0
        for k, i in enumerate(of):
            if k + 1 == len(of) or of[k + 1] != i:
                out[i].append(data[at : ends[k]])
                at = int(ends[k])
        waiting.clear()

    held = 0
    for i, (w, h) in enumerate(zip(wides, highs)):
        step = max(1, AT_ONCE // (w * UNIT))
        for a in range(0, h, step):
            b = min(h, a + step)
            if held + (b - a) * w * UNIT > AT_ONCE:
                flush()
                held = 0
            waiting.append((i, a, b))
            held += (b - a) * w * UNIT
    flush()
    return [b"".join(parts) + b"\xff\xd9" for parts in out]


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT if text else UNIT)


# reading


class Damaged(ValueError):
    pass


@dataclass
class Component:
    id: int
    h: int
    v: int
    quantiser: int
    wide: int = 0  # in blocks, as scans of several components store them
    high: int = 0
    own_wide: int = 0  # as a scan of this component alone stores them
    own_high: int = 0
    blocks: np.ndarray | None = None


@dataclass
class Scan:
    parts: list[int]  # places of its components
    dc: list[bytes]
    ac: list[bytes]
    interval: int
    data: np.ndarray


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, list[int]] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comments: list[bytes] = field(default_factory=list)
    error: str | None = None


AFTER_SCAN = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")


def parse(data: bytes) -> Picture:
    """A picture's markers; raises Damaged if it isn't a whole baseline JPEG."""
    if data[:2] != b"\xff\xd8":
        raise Damaged("no JPEG")
    picture, at, interval, tables = Picture(), 2, 0, {}
    while True:
        if data[at : at + 1] != b"\xff":
            raise Damaged("truncated" if at >= len(data) else "no marker where one must be")
        while data[at : at + 1] == b"\xff":
            at += 1
        marker = data[at] if at < len(data) else None
        at += 1
        if marker is None:
            raise Damaged("truncated")
        if marker == 0xD9:
            break
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            continue
        if at + 2 > len(data):
            raise Damaged("truncated")
        (length,) = struct.unpack_from(">H", data, at)
        body = data[at + 2 : at + length]
        if length < 2 or len(body) != length - 2:
            raise Damaged("truncated")
        at += length
        try:
            if marker == 0xC0:
                bits, picture.height, picture.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8 or not 1 <= n <= 4 or picture.components or not picture.width or not picture.height:
                    raise Damaged("no baseline frame")
                picture.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if any(not 1 <= x <= 4 for c in picture.components for x in (c.h, c.v)):
                    raise Damaged("no baseline frame")
                sized(picture)
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise Damaged("not baseline")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    if len(body) < 17 + n or body[0] >> 4 > 1 or body[0] & 15 > 3:
                        raise Damaged("bad Huffman table")
                    tables[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xDB:
                while body:
                    wide = 1 + (body[0] >> 4)
                    picture.quantisers[body[0] & 15] = [int.from_bytes(body[1 + wide * k : 1 + wide * k + wide], "big") for k in range(64)]
                    if len(body) < 1 + 64 * wide:
                        raise Damaged("bad quantiser")
                    body = body[1 + 64 * wide :]
            elif marker == 0xDD:
                (interval,) = struct.unpack_from(">H", body)
            elif marker == 0xFE:
                picture.comments.append(body)
            elif marker == 0xDA:
                n = body[0]
                ids = [c.id for c in picture.components]
                parts = [ids.index(body[1 + 2 * i]) for i in range(n)]
                if body[1 + 2 * n : 4 + 2 * n] != b"\0\x3f\0":
                    raise Damaged("not baseline")
                end = AFTER_SCAN.search(data, at)
                if not end:
                    raise Damaged("truncated")
                picture.scans.append(Scan(parts, [tables[body[2 + 2 * i] >> 4] for i in range(n)], [tables[0x10 | body[2 + 2 * i] & 15] for i in range(n)], interval, np.frombuffer(data, np.uint8, end.start() - at, at)))
                at = end.start()
        except (IndexError, KeyError, ValueError, struct.error) as e:
            raise e if isinstance(e, Damaged) else Damaged("bad segment") from e
    if not picture.scans:
        raise Damaged("no scan")
    if {i for s in picture.scans for i in s.parts} != set(range(len(picture.components))):
        raise Damaged("a component without a scan")
    return picture


def sized(picture: Picture) -> None:
    most_h, most_v = max(c.h for c in picture.components), max(c.v for c in picture.components)
    wide, high = -(-picture.width // (8 * most_h)), -(-picture.height // (8 * most_v))
    for c in picture.components:
        c.wide, c.high = wide * c.h, high * c.v
        c.own_wide, c.own_high = -(-(-(-picture.width * c.h // most_h)) // 8), -(-(-(-picture.height * c.v // most_v)) // 8)


#: what a table's entries are made of: bits taken (LONG: more than 16 or none), zeros before, value
LONG, ALL = 31, 63


def lookup(says: bytes, ac: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits: value << 11 | zeros << 5 | bits of the symbol and extra bits that they begin with, ALL zeros for the end
    of a block; and length << 8 | symbol of its code, 0 for none, where it takes more bits than that."""
    table, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for length in range(1, 17):
        for symbol in says[at : at + says[length - 1]]:
            if code + 1 > 1 << length:
                raise Damaged("bad Huffman table")
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
            code += 1
        at += says[length - 1]
        code <<= 1
    length, symbol = table >> 8, table & 255
    size = symbol & 15 if ac else symbol
    none = (length == 0) | (size > 11) | (ac & (size == 0) & (symbol != 0) & (symbol != 0xF0))
    table[none] = 0
    bits = length + size
    extra = (np.arange(1 << 16) >> np.maximum(16 - bits, 0)) & ((1 << size) - 1)
    value = extra - np.where(extra < (1 << size) >> 1, (1 << size) - 1, 0)
    zeros = np.where(symbol == 0, ALL, symbol >> 4) if ac else 0
    return np.where(none | (bits > 16), LONG, value << 11 | zeros << 5 | bits), table


def intervals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a scan's bytes without stuffed zeros and restart markers, where its intervals begin)."""
    after = np.flatnonzero(data[:-1] == 0xFF)
    following = data[after + 1]
    marks = after[(following & 0xF8) == 0xD0]
    keep = np.ones(len(data), bool)
    keep[after[following == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    return data[keep], np.r_[0, np.cumsum(keep)[marks]] if len(marks) else np.zeros(1, np.int64)


def decode_lanes(stream: np.ndarray, tables: np.ndarray, codes: np.ndarray, begin: np.ndarray, stop: np.ndarray, units: np.ndarray, layout: np.ndarray, dc_of: np.ndarray, ac_of: np.ndarray, per_mcu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decodes all lanes (restart intervals) at a time, a symbol a step: (coefficients, which lanes are damaged).

    Lane i is bytes begin[i] to stop[i] of the stream and holds units[i] blocks. The tables of an MCU's blocks are
    dc_of[layout[i]] and ac_of[layout[i]]. DC coefficients are differences still.
    """
    out = np.zeros(int(units.sum()) * UNIT, np.int16)
    bad = np.zeros(len(begin), bool)
    wide = stream.astype(np.uint32)
    four = (wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]).astype(np.int64)
    eight = np.ndarray((len(stream) - 7,), ">u8", stream.data, strides=(1,))
    table, code = tables.reshape(-1), codes.reshape(-1)
    most = dc_of.shape[1]
    end = np.cumsum(units) * UNIT
    at = end - units * UNIT  # the coefficient that comes next
    lane, pos, start, limit = np.arange(len(begin)), begin * 8, at, stop * 8
    dc, ac = dc_of[layout, 0] << 16, ac_of[layout, 0] << 16
    while len(lane):
        if most > 1:
            slot = layout * most + ((at - start) >> 6) % per_mcu[layout]
            dc, ac = dc_of.take(slot) << 16, ac_of.take(slot) << 16
        which = np.where(at & 63 == 0, dc, ac)
        entry = table.take((four.take(pos >> 3, mode="clip") >> (16 - (pos & 7)) & 0xFFFF) + which)
        bits = entry & 31
        zeros, value = entry >> 5 & 63, entry >> 11
        ended = None
        if (bits == LONG).any():
            far = np.flatnonzero(bits == LONG)
            window = eight[np.minimum(pos[far] >> 3, len(eight) - 1)].astype(np.uint64) << (pos[far] & 7).astype(np.uint64)
            said = code.take((window >> np.uint64(48)).astype(np.int64) + which[far])
            length, symbol = said >> 8, said & 255
            is_dc = at[far] & 63 == 0
            size = np.where(is_dc, symbol, symbol & 15)
            extra = (window << length.astype(np.uint64) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
            value[far] = extra - np.where(extra < (1 << size) >> 1, (1 << size) - 1, 0)
            bits[far], zeros[far] = length + size, np.where(is_dc, 0, symbol >> 4)
            if (length == 0).any():
                bad[lane[far[length == 0]]] = True
                ended = at < 0
                ended[far[length == 0]] = True
        pos = pos + bits
        place, border = at + zeros, at | 63
        if (place > border).any():
            over = place > border
            bad[lane[over & (zeros != ALL)]] = True
            place = np.minimum(place, border)
        out[place] = value
        at = place + 1
        done = at >= end
        if ended is not None or done.any():
            bad[lane[done & (pos > limit)]] = True
            live = ~(done if ended is None else done | ended)
            lane, pos, start, limit, dc, ac, at, end, layout = (x[live] for x in (lane, pos, start, limit, dc, ac, at, end, layout))
    return out.reshape(-1, UNIT), bad


def decode(pictures_: list[Picture]) -> None:
    """Fills in the components' blocks (high, wide, 64), quantised and in zigzag order; damaged pictures get an error."""
    groups, group, known = [], [], set()
    for p in pictures_:
        own = {t for s in p.scans for t in (*s.dc, *s.ac)}
        if group and len(known | own) > TABLES:
            groups.append(group)
            group, known = [], set()
        group.append(p)
        known |= own
    for group in [*groups, group]:
        decode_group([p for p in group if not p.error])


def decode_group(group: list[Picture]) -> None:
    said: dict[tuple[bytes, bool], int] = {}
    layouts: dict[tuple, int] = {}
    streams, begin, stop, units, layout, owner = [], [], [], [], [], []
    at = blocks = 0
    jobs = []
    for p in group:
        for scan in p.scans:
            parts = [p.components[i] for i in scan.parts]
            alone = len(parts) == 1
            pattern = [i for i, c in enumerate(parts) for _ in range(1 if alone else c.h * c.v)]
            mcus = parts[0].own_wide * parts[0].own_high if alone else (parts[0].wide // parts[0].h) * (parts[0].high // parts[0].v)
            clean, starts = intervals(scan.data)
            interval = scan.interval or mcus
            needed = -(-mcus // interval)
            if len(starts) < needed or len(pattern) > 10:
                p.error = "restart markers are missing" if len(starts) < needed else "too many blocks in an MCU"
                break
            dc = tuple(said.setdefault((scan.dc[i], False), len(said)) for i in pattern)
            ac = tuple(said.setdefault((scan.ac[i], True), len(said)) for i in pattern)
            kind = layouts.setdefault((dc, ac), len(layouts))
            count = np.full(needed, interval)
            count[-1] = mcus - interval * (needed - 1)
            count = count * len(pattern)
            streams.append(clean)
            begin.append(at + starts[:needed])
            stop.append(at + np.r_[starts[1:], len(clean)][:needed])
            units.append(count)
            layout.append(np.full(needed, kind))
            owner.append(np.full(needed, len(jobs)))
            jobs.append((p, scan, pattern, interval, blocks, int(count.sum())))
            at += len(clean)
            blocks += int(count.sum())
    if not jobs:
        return
    try:
        tables, codes = map(np.stack, zip(*(lookup(*t) for t in said)))
    except Damaged as e:
        for p in group:  # one of them has it: each alone
            if len(group) == 1:
                p.error = p.error or str(e)
            else:
                decode_group([p])
        return
    most = max(len(dc) for dc, _ in layouts)
    shape = lambda i: np.array([(*k[i], *[0] * (most - len(k[i]))) for k in layouts])
    stream = np.concatenate([*streams, np.full(16, 0xFF, np.uint8)])
    lanes = [np.concatenate(x) for x in (begin, stop, units, layout)]
    out, bad = decode_lanes(stream, tables, codes, *lanes, shape(0), shape(1), np.array([len(dc) for dc, _ in layouts]))
    for job in np.unique(np.concatenate(owner)[bad]).tolist():
        jobs[job][0].error = "damaged scan"
    for p, scan, pattern, interval, first, count in jobs:
        if not p.error:
            blocks = out[first : first + count]
            summed(blocks, pattern, interval)
            placed(p, scan, pattern, blocks)


def summed(blocks: np.ndarray, pattern: list[int], interval: int) -> None:
    """Makes DC coefficients of a scan's differences: sums of each component, anew in each restart interval."""
    by_mcu = blocks[:, 0].reshape(-1, len(pattern))
    for i in set(pattern):
        columns = [k for k, x in enumerate(pattern) if x == i]
        own = by_mcu[:, columns].astype(np.int64)
        total = own.ravel().cumsum().reshape(own.shape)
        before = (total[:, 0] - own[:, 0])[::interval]
        by_mcu[:, columns] = total - np.repeat(before, interval)[: len(total), None]


def placed(p: Picture, scan: Scan, pattern: list[int], blocks: np.ndarray) -> None:
    """A scan's blocks, in the order of its MCUs, as rows and columns of their components."""
    if len(scan.parts) == 1:
        c = p.components[scan.parts[0]]
        c.blocks = blocks.reshape(c.own_high, c.own_wide, UNIT)
        return
    by_mcu = blocks.reshape(-1, len(pattern), UNIT)
    first = 0
    for i in scan.parts:
        c = p.components[i]
        own = by_mcu[:, first : first + c.h * c.v].reshape(c.high // c.v, c.wide // c.h, c.v, c.h, UNIT)
        c.blocks = own.transpose(0, 2, 1, 3, 4).reshape(c.high, c.wide, UNIT)
        first += c.h * c.v


def thumbnail(p: Picture) -> np.ndarray:
    """The luminance, a pixel for each of its blocks: the mean that the DC coefficient tells."""
    c = p.components[0]
    dc = c.blocks[: c.own_high, : c.own_wide, 0].astype(np.int32) * p.quantisers[c.quantiser][0]
    return np.clip((dc + 1024 + 4) >> 3, 0, 255).astype(np.uint8)


def shrunk(pixels: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Means of high x wide areas, each of a pixel or more."""
    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1), np.int64)
    total[1:, 1:] = pixels.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)

    def edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.arange(parts) * n // parts
        return low, np.maximum(low + 1, np.arange(1, parts + 1) * n // parts)

    (t, b), (left, r) = edges(pixels.shape[0], high), edges(pixels.shape[1], wide)
    rows = total[b] - total[t]
    return (rows[:, r] - rows[:, left]) / np.outer(b - t, r - left)


def bits_hex(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel()).tobytes().hex()


def hashes(pixels: np.ndarray) -> tuple[str, str]:
    """(average hash, difference hash), 64 bits each: areas above the mean; areas brighter than the one to their left."""
    small, rows = shrunk(pixels, 8, 8), shrunk(pixels, 8, 9)
    return bits_hex(small > small.mean()), bits_hex(rows[:, 1:] > rows[:, :-1])


# columns


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each text as a JPEG that holds its UTF-8 bytes, filled up with zeros to a positive multiple of 64."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))

    def run(batches):
        for part in slices(batches, most=AT_ONCE):
            found = part.column("text").to_pylist()
            yield pa.record_batch([part.column("doc_id"), pa.array(pictures([padded(t) for t in found], [len(t) for t in found]), pa.binary())], ["doc_id", "media"])

    return texts.mapInArrow(run, "doc_id long, media binary")


FEATURES = "doc_id long, error string, width int, height int, components int, thumbnail_width int, thumbnail_height int, thumbnail binary, thumbnail_crc32 long, average_hash string, difference_hash string, media_bytes long, media_sha256 string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long"


def features(data: bytes, p: Picture | None) -> dict:
    """The columns of FEATURES, but for the id."""
    row: dict = {} if data is None else {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
    if p is None or p.error:
        return row | {"error": p.error if p else "null"}
    small = thumbnail(p)
    row |= {"width": p.width, "height": p.height, "components": len(p.components), "thumbnail_width": small.shape[1], "thumbnail_height": small.shape[0], "thumbnail": small.tobytes(), "thumbnail_crc32": zlib.crc32(small)}
    row["average_hash"], row["difference_hash"] = hashes(small)
    said = next((m for m in map(COMMENT.fullmatch, p.comments) if m), None)
    if said and len(p.components) == 1:
        size, n = map(int, said.groups())
        payload = (p.components[0].blocks + 128).astype(np.uint8).reshape(-1)[:size]
        row |= {"n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:])}
    return row


def looked_at(media: list[bytes | None]) -> list[dict]:
    """The features of pictures, decoded together; one that can't be decoded has an error."""
    parsed: list[Picture | None] = []
    for m in media:
        try:
            parsed.append(None if m is None else parse(m))
        except Damaged as e:
            parsed.append(Picture(error=str(e)))
    decode([p for p in parsed if p and not p.error])
    for p in parsed:
        if p and not p.error and p.components[0].quantiser not in p.quantisers:
            p.error = "bad quantiser"
    return [features(m, p) for m, p in zip(media, parsed)]


def read(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Rows of FEATURES for a column of JPEGs."""
    small_batches(media.sparkSession)
    names = [c.split()[0] for c in FEATURES.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in FEATURES.split(", ")]

    def run(batches):
        for part in slices(batches, "media", AT_ONCE):
            rows = looked_at(part.column("media").to_pylist())
            columns = [part.column("doc_id"), *(pa.array([r.get(n) for r in rows], t) for n, t in zip(names[1:], types[1:]))]
            yield pa.record_batch(columns, names)

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, FEATURES)
