"""Progressive JPEG media columns.

Decoding accumulates all scans (spectral selection and successive approximation) into coefficient arrays, inverse-transforms them in
numpy, upsamples chroma and gives full-resolution RGB tensors. Restart intervals are independent, so those of all images with equal
tables decode side by side: each numpy step takes one symbol, or one coefficient, of every interval.

The encoder stores a payload losslessly: byte b is the quantised coefficient b - 128, 64 to a block in zigzag order, with all
quantisers 1; six blocks are a minimum unit of a 4:2:0 image (four luma blocks, two chroma blocks). A comment holds the payload's size.

Edge cases: a null text is an empty one, whose payload is 192 spaces; very long texts get wider images (65,500 pixels at most in either
direction, 16 GB of payload); equal texts give equal files; rows are never joined or dropped; an empty table gives no rows."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, read_table, slices

UNIT = 192
RESTART = 8
MOST_ROWS = 4093  # of minimum units, 16 pixels each
#: Text bytes worked on at once: tensors and lanes take some fifty times that.
WORK_BYTES = 2 << 20


def zigzag() -> np.ndarray:
    """Place in the 8 x 8 block of each coefficient in zigzag order."""
    order = sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))
    return np.array(order)


ZIGZAG = zigzag()


def basis() -> np.ndarray:
    """Inverse transform of zigzag coefficients to 64 pixels, times 2^13, as whole numbers: sums of them are exact in any order."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.round(np.kron(one, one)[ZIGZAG] * 8192)


BASIS = basis()


def code_lengths() -> tuple[dict[int, int], dict[int, int]]:
    """Code lengths of DC and AC symbols. Letters, spaces and line ends, as coefficients less their last bit, get the short codes."""
    ac = {0x04: 2, 0x03: 2, 0x06: 3, 0x02: 4, 0x05: 5, 0x07: 6, 0x01: 6, 0x00: 6}
    ac |= {s: 10 for s in [0xF0, *[r << 4 | s for r in range(16) for s in range(1, 8)]] if s not in ac}
    return dict.fromkeys(range(12), 4), ac


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """(codes per length 1 to 16, symbols in order, symbol -> (code, length))."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    return counts, symbols, assigned(counts, symbols)


def assigned(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    out, code, at = {}, 0, 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            out[symbols[at]] = (code, n)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16 bits, symbol << 8 | length of the code that they begin with."""
    out = np.zeros(1 << 16, np.int32)
    for s, (code, n) in assigned(counts, symbols).items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = s << 8 | n
    return out


DC_LENGTHS, AC_LENGTHS = code_lengths()
DC_TABLE, AC_TABLE = canonical(DC_LENGTHS), canonical(AC_LENGTHS)


def coder(table) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, (c, n) in table[2].items():
        code[s], size[s] = c, n
    return code, size


DC_CODE, DC_SIZE = coder(DC_TABLE)
AC_CODE, AC_SIZE = coder(AC_TABLE)
BIT_LENGTH = np.array([0, *[int(x).bit_length() for x in range(1, 4096)]])


# --- writing


def joined_bits(value: np.ndarray, size: np.ndarray, segment_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, byte ends of the segments): items of at most 32 bits one after the other, each segment filled up with ones.

    segment_ends: for each segment, the number of items up to its end."""
    so_far = np.concatenate([[0], np.cumsum(size)])
    bits = np.diff(so_far[segment_ends], prepend=0)
    fill = -bits % 8
    value = np.insert(value, segment_ends, (np.uint64(1) << fill.astype(np.uint64)) - np.uint64(1))
    size = np.insert(size, segment_ends, fill)
    end = np.cumsum(size)
    start = end - size
    total = int(end[-1]) if len(end) else 0
    word = start >> 6
    shift = 64 - (start & 63) - size
    main = np.where(shift >= 0, value << np.maximum(shift, 0).astype(np.uint64), value >> np.maximum(-shift, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros((total >> 6) + 2, np.uint64)
    out[word[first]] = np.bitwise_or.reduceat(main, first)
    over = np.flatnonzero(shift < 0)
    out[word[over] + 1] |= value[over] << (64 + shift[over]).astype(np.uint64)
    return out.astype(">u8").view(np.uint8)[: total >> 3], np.cumsum((bits + fill) >> 3)


def stuffed(data: np.ndarray, ends: np.ndarray, per_scan: np.ndarray) -> list[bytes]:
    """The scans' entropy-coded bytes: FF bytes followed by 00, restart markers between a scan's segments. per_scan: its segments."""
    full = data == 255
    shift = np.cumsum(full) - full
    segment = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    last = np.zeros(len(ends), bool)
    scan_end = np.cumsum(per_scan)
    last[scan_end - 1] = True
    marks_before = np.cumsum(~last) - ~last
    at = np.arange(len(data)) + shift + 2 * marks_before[segment]
    out = np.zeros(len(data) + int(full.sum()) + 2 * int((~last).sum()), np.uint8)
    out[at] = data
    grown = ends + np.concatenate([[0], np.cumsum(full)])[ends] + 2 * marks_before
    inner = np.flatnonzero(~last)
    number = inner - np.repeat(scan_end - per_scan, per_scan)[inner]
    out[grown[inner]] = 255
    out[grown[inner] + 1] = 0xD0 + number % 8
    raw, to = out.tobytes(), grown[scan_end - 1].tolist()
    return [raw[a:b] for a, b in zip([0, *to[:-1]], to, strict=True)]


def segments(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units per segment, segments per image) for so many units of each image."""
    per = -(-counts // RESTART)
    sizes = np.full(int(per.sum()), RESTART)
    sizes[np.cumsum(per) - 1] = counts - (per - 1) * RESTART
    return sizes, per


def dc_first(units: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """units[n, 6]: DC values less their last bit, four luma and two chroma blocks."""
    sizes, per = segments(counts)
    starts = np.cumsum(sizes) - sizes
    luma = units[:, :4].ravel()
    before = np.empty_like(luma)
    before[1:] = luma[:-1]
    before[4 * starts] = 0
    diff = np.empty_like(units)
    diff[:, :4] = (luma - before).reshape(-1, 4)
    for c in (4, 5):
        before = np.empty_like(units[:, c])
        before[1:] = units[:-1, c]
        before[starts] = 0
        diff[:, c] = units[:, c] - before
    d = diff.ravel().astype(np.int64)
    s = BIT_LENGTH[np.abs(d)]
    extra = np.where(d < 0, d + (1 << s) - 1, d).astype(np.uint64)
    return stuffed(*joined_bits(DC_CODE[s] << s.astype(np.uint64) | extra, DC_SIZE[s] + s, 6 * np.cumsum(sizes)), per)


def dc_second(units: np.ndarray, counts: np.ndarray) -> list[bytes]:
    sizes, per = segments(counts)
    value = (units.astype(np.int64) & 1) @ (1 << np.arange(5, -1, -1))
    return stuffed(*joined_bits(value.astype(np.uint64), np.full(len(value), 6), np.cumsum(sizes)), per)


def ac_first(band: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """band[blocks, coefficients] of one component, values less their last bit."""
    sizes, per = segments(counts)
    n, width = band.shape
    flat = band.ravel().astype(np.int64)
    at = np.flatnonzero(flat)
    block, place = at // width, at % width
    same = np.concatenate([[False], block[1:] == block[:-1]]) if len(at) else np.zeros(0, bool)
    run = place - np.where(same, np.concatenate([[0], place[:-1] + 1])[: len(at)], 0)
    v = flat[at]
    s = BIT_LENGTH[np.abs(v)]
    symbol = (run & 15) << 4 | s
    extra = np.where(v < 0, v + (1 << s) - 1, v).astype(np.uint64)
    value, size = AC_CODE[symbol] << s.astype(np.uint64) | extra, AC_SIZE[symbol] + s
    tail = np.full(n, -1)
    tail[block] = place  # the last write, that of the last coefficient, stays
    ended = np.flatnonzero(tail < width - 1)
    # runs of sixteen zeros come before their symbol, ends of blocks after their last one
    long = np.flatnonzero(run > 15)
    zrl = np.repeat(at[long], run[long] >> 4)
    key = np.concatenate([at * 2 + 1, zrl * 2, (ended + 1) * width * 2 - 1])
    value = np.concatenate([value, np.full(len(zrl), AC_CODE[0xF0]), np.full(len(ended), AC_CODE[0])])
    size = np.concatenate([size, np.full(len(zrl), AC_SIZE[0xF0]), np.full(len(ended), AC_SIZE[0])])
    if len(zrl) or len(ended):
        order = np.argsort(key, kind="stable")
        key, value, size = key[order], value[order], size[order]
    ends = np.searchsorted(key, np.cumsum(sizes) * width * 2)
    return stuffed(*joined_bits(value, size, ends), per)


def ac_second(band: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """band[blocks, 63]: whole values, of which all but the last bit are known."""
    sizes, per = segments(counts)
    n, width = band.shape
    size_of = np.abs(band.astype(np.int64))
    known, fresh = size_of > 1, size_of == 1
    plain = known.all(1)
    # blocks whose coefficients are all known: an end of block and one bit for each
    rows = np.flatnonzero(plain)
    bits = (size_of[rows] & 1).astype(np.uint64)
    words = [bits[:, a : a + 21] @ (np.uint64(1) << np.arange(20, -1, -1, dtype=np.uint64)) for a in (0, 21, 42)]
    value = np.stack([np.full(len(rows), AC_CODE[0]), *words], 1).ravel()
    size = np.tile(np.array([AC_SIZE[0], 21, 21, 21]), len(rows))
    owner = np.repeat(rows, 4)
    # the others: symbols, each followed by the bits of the known coefficients that it passes
    rest = np.flatnonzero(~plain)
    if len(rest):
        known, fresh, amount, v = known[rest], fresh[rest], size_of[rest], band[rest]
        zero = ~known & ~fresh
        k = np.cumsum(fresh, 1) - fresh  # fresh ones before
        zeros = np.cumsum(zero, 1) - zero
        at_fresh = np.where(fresh, zeros + 0, 0)
        base = np.maximum.accumulate(np.concatenate([np.zeros((len(rest), 1), np.int64), at_fresh[:, :-1]], 1), 1)
        since = zeros - base  # zeros since the last fresh one
        total = fresh.sum(1)
        in_tail = k == total[:, None]
        part = np.where(in_tail, 0, since >> 4)
        key = ((np.arange(len(rest))[:, None] * 64 + k) * 8 + part) * 128
        i, p = np.nonzero(known)
        items = [(key[i, p] + 1 + p, (amount[i, p] & 1).astype(np.uint64), np.ones(len(i), np.int64))]
        i, p = np.nonzero(fresh)
        symbol = (since[i, p] & 15) << 4 | 1
        items.append(((key[i, p]), AC_CODE[symbol] << np.uint64(1) | (v[i, p] > 0).astype(np.uint64), AC_SIZE[symbol] + 1))
        long = np.flatnonzero(since[i, p] > 15)
        for j in range(1, 4):
            some = long[(since[i, p] >> 4)[long] >= j]
            items.append((((i[some] * 64 + k[i, p][some]) * 8 + j - 1) * 128, np.full(len(some), AC_CODE[0xF0]), np.full(len(some), AC_SIZE[0xF0])))
        last = np.where(fresh.any(1), width - 1 - fresh[:, ::-1].argmax(1), -1)
        open_ = np.flatnonzero(last < width - 1)
        items.append(((open_ * 64 + total[open_]) * 8 * 128, np.full(len(open_), AC_CODE[0]), np.full(len(open_), AC_SIZE[0])))
        key, more, more_size = (np.concatenate(x) for x in zip(*items, strict=True))
        order = np.argsort(key, kind="stable")
        value, size = np.concatenate([value, more[order]]), np.concatenate([size, more_size[order]])
        owner = np.concatenate([owner, rest[key[order] // (64 * 8 * 128)]])
        order = np.argsort(owner, kind="stable")
        value, size, owner = value[order], size[order], owner[order]
    ends = np.searchsorted(owner, np.cumsum(sizes))
    return stuffed(*joined_bits(value, size, ends), per)


def marker(code: int, body: bytes) -> bytes:
    return bytes([255, code]) + (len(body) + 2).to_bytes(2, "big") + body


def scan_header(components: tuple[int, ...], first: int, last: int, high: int, low: int) -> bytes:
    return marker(0xDA, bytes([len(components), *[x for c in components for x in (c, 0)], first, last, high << 4 | low]))


def luma_order(wide: int, tall: int) -> np.ndarray:
    """For the luma blocks in raster order, their place in units: unit * 4 + block of the unit."""
    y, x = np.divmod(np.arange(4 * wide * tall), 2 * wide)
    return ((y // 2) * wide + x // 2) * 4 + (y % 2) * 2 + x % 2


def written(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload of a multiple of 192 bytes."""
    need = [-(-len(p) // (2 * UNIT)) for p in payloads]
    wide = [-(-n // MOST_ROWS) for n in need]
    tall = [-(-n // w) for n, w in zip(need, wide, strict=True)]
    counts = np.array([w * t for w, t in zip(wide, tall, strict=True)])
    blank = bytes([128])
    units = np.frombuffer(b"".join(p + blank * (384 * int(c) - len(p)) for p, c in zip(payloads, counts, strict=True)), np.uint8).astype(np.int16).reshape(-1, 6, 64) - 128
    luma = np.ascontiguousarray(units[:, :4]).reshape(-1, 64)
    if max(wide) > 1:
        starts = np.cumsum(counts) - counts
        luma = luma[np.concatenate([4 * a + luma_order(w, t) for a, w, t in zip(starts, wide, tall, strict=True)])]
    parts = (luma, units[:, 4], units[:, 5])
    per = (4 * counts, counts, counts)
    scans = [(scan_header((1, 2, 3), 0, 0, 0, 1), dc_first(units[:, :, 0] >> 1, counts))]
    for c, (x, n) in enumerate(zip(parts, per, strict=True), 1):
        half = np.sign(x) * (np.abs(x) >> 1)
        for a, b in ((1, 31), (32, 63)):
            scans.append((scan_header((c,), a, b, 0, 1), ac_first(half[:, a : b + 1], n)))
    scans.append((scan_header((1, 2, 3), 0, 0, 1, 0), dc_second(units[:, :, 0], counts)))
    for c, (x, n) in enumerate(zip(parts, per, strict=True), 1):
        scans.append((scan_header((c,), 1, 63, 1, 0), ac_second(x[:, 1:], n)))
    head = marker(0xDB, bytes([0]) + bytes([1]) * 64)
    tables = b"".join(marker(0xC4, bytes([kind]) + bytes(t[0]) + bytes(t[1])) for kind, t in ((0x00, DC_TABLE), (0x10, AC_TABLE))) + marker(0xDD, RESTART.to_bytes(2, "big"))
    out = []
    for i, p in enumerate(payloads):
        size = (tall[i] * 16).to_bytes(2, "big") + (wide[i] * 16).to_bytes(2, "big")
        frame = marker(0xC2, bytes([8]) + size + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        out.append(b"".join([b"\xff\xd8", marker(0xFE, b"payload %d" % len(p)), head, frame, tables, *[x for h, data in scans for x in (h, data[i])], b"\xff\xd9"]))
    return out


# --- reading


class Image:
    """What the markers of a file say: size, components, quantisers, comment, scans with their tables and entropy-coded bytes."""

    def __init__(self, raw: bytes):
        if raw[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        self.comment, self.quantisers, self.scans = b"", {}, []
        tables: dict[int, tuple] = {}
        at, restart = 2, 0
        while True:
            if raw[at] != 255:
                raise ValueError("marker expected")
            code = raw[at + 1]
            if code == 0xD9:
                break
            if code == 255:
                at += 1
                continue
            n = int.from_bytes(raw[at + 2 : at + 4], "big")
            body, at = raw[at + 4 : at + 2 + n], at + 2 + n
            if code == 0xFE:
                self.comment = body
            elif code == 0xDB:
                while body:
                    wide = body[0] >> 4
                    values = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8)
                    self.quantisers[body[0] & 15], body = values.astype(np.int64), body[1 + 64 * (1 + wide) :]
            elif code == 0xC2:
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a progressive JPEG")
            elif code == 0xC4:
                while body:
                    counts = list(body[1:17])
                    k = sum(counts)
                    tables[body[0]], body = (tuple(counts), tuple(body[17 : 17 + k])), body[17 + k :]
            elif code == 0xDD:
                restart = int.from_bytes(body, "big")
            elif code == 0xDA:
                chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
                first, last, approx = body[1 + 2 * body[0] :][:3]
                end = at
                while True:
                    end = raw.index(b"\xff", end)
                    if raw[end + 1] == 0 or 0xD0 <= raw[end + 1] <= 0xD7:
                        end += 2
                    else:
                        break
                used = tuple((c, tables.get(t >> 4) if first == 0 else tables.get(0x10 | t & 15)) for c, t in chosen)
                self.scans.append((used, first, last, approx >> 4, approx & 15, restart, (at, end)))
                at = end
        self.raw = raw
        self.most_h, self.most_v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        self.wide, self.tall = -(-self.width // (8 * self.most_h)), -(-self.height // (8 * self.most_v))
        #: images alike in this decode side by side
        self.kind = (tuple(self.components), tuple(s[:6] for s in self.scans))


def unstuffed(images: list[Image], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of scan k of all images without stuffing and markers, first byte of each segment, segments per image)."""
    parts = [np.frombuffer(i.raw, np.uint8, i.scans[k][6][1] - i.scans[k][6][0], i.scans[k][6][0]) for i in images]
    sizes = np.array([len(p) for p in parts])
    data = np.concatenate(parts)
    full = np.flatnonzero(data[:-1] == 255) if len(data) else np.zeros(0, np.int64)
    after = data[full + 1]
    # an FF that ends one image's part is never followed by its own 00 here: encoders stuff it
    mark = full[(after & 0xF8) == 0xD0]
    drop = np.zeros(len(data), bool)
    drop[full[after == 0] + 1] = True
    drop[mark] = drop[mark + 1] = True
    kept_before = np.concatenate([[0], np.cumsum(~drop)])
    image_start = np.cumsum(sizes) - sizes
    starts = np.sort(np.concatenate([image_start, mark + 2]))
    per = 1 + np.searchsorted(mark, image_start + sizes) - np.searchsorted(mark, image_start)
    return data[~drop], kept_before[starts], per


def windows(data: np.ndarray) -> np.ndarray:
    """For each byte, it and the next seven as a number; ones follow the end."""
    padded = np.concatenate([data, np.full(16, 255, np.uint8)])
    out = np.zeros(len(data) + 8, np.uint64)
    for i in range(8):
        out |= padded[i : i + len(out)].astype(np.uint64) << np.uint64(56 - 8 * i)
    return out


class Lanes:
    """Bit readers, one per segment."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.win = windows(data)
        self.pos = starts.astype(np.int64) * 8

    def now(self, n: int) -> np.ndarray:
        """The next bits of the first n lanes, 57 at least, leading."""
        p = self.pos[:n]
        return self.win[np.minimum(p >> 3, len(self.win) - 1)] << (p & 7).astype(np.uint64)

    def bit(self, n: int) -> np.ndarray:
        return (self.now(n) >> np.uint64(63)).astype(np.int64)


def received(w: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits after the first ``skip``."""
    return ((w << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)


def extended(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << n) >> 1, bits - (1 << n) + 1, bits)


def read_dc(lanes: Lanes, order: list[tuple[int, np.ndarray]], units: np.ndarray, places: list, coef: dict, tables: dict, high: int, low: int) -> None:
    """Lanes run over their units; order: the blocks of a unit as (component, its index there); places: block of (component, unit, index)."""
    lut = {c: lookup(list(t[0]), list(t[1])) for c, t in tables.items() if t} if not high else {}
    pred = {c: np.zeros(len(units), np.int64) for c, _ in order}
    for u in range(int(units.max(initial=0))):
        n = int(np.searchsorted(-units, -u, side="left"))  # lanes are in descending order of units
        for c, index in order:
            block = places[c](u, index, n)
            if high:
                coef[c][0, block] |= (lanes.bit(n) << low).astype(coef[c].dtype)
                lanes.pos[:n] += 1
                continue
            w = lanes.now(n)
            e = lut[c][(w >> np.uint64(48)).astype(np.int64)]
            size, skip = (e >> 8).astype(np.int64), (e & 255).astype(np.int64)
            pred[c][:n] += extended(received(w, skip, size), size)
            coef[c][0, block] = pred[c][:n] << low
            lanes.pos[:n] += skip + size


def read_ac_first(lanes: Lanes, units: np.ndarray, place, coef: np.ndarray, table, first: int, last: int, low: int) -> None:
    lut = lookup(list(table[0]), list(table[1]))
    eob = np.zeros(len(units), np.int64)
    flat, width = coef.reshape(-1), coef.shape[1]
    for u in range(int(units.max(initial=0))):
        n = int(np.searchsorted(-units, -u, side="left"))
        block = place(u, n)
        k = np.where(eob[:n] > 0, 64, first)
        eob[:n] -= eob[:n] > 0
        live = np.flatnonzero(k <= last)
        while len(live):
            every = len(live) == n
            p = lanes.pos[:n] if every else lanes.pos[live]
            w = lanes.win[np.minimum(p >> 3, len(lanes.win) - 1)] << (p & 7).astype(np.uint64)
            e = lut[(w >> np.uint64(48)).astype(np.int64)]
            skip = (e & 255).astype(np.int64)
            size = ((e >> 8) & 15).astype(np.int64)
            at = (k if every else k[live]) + (e >> 12)
            value = extended(received(w, skip, size), size) << low
            plain = size > 0
            if plain.all():
                flat[np.minimum(at, 63) * width + (block if every else block[live])] = value
                at += 1
            else:
                own = np.flatnonzero(plain)
                flat[np.minimum(at[own], 63) * width + (block if every else block[live])[own]] = value[own]
                run = (e >> 12).astype(np.int64)
                ends = ~plain & (run < 15)
                who = np.flatnonzero(ends)
                if len(who):
                    eob[who if every else live[who]] = (1 << run[who]) - 1 + received(w[who], skip[who], run[who])
                    size = np.where(ends, run, size)
                at = np.where(ends, 64, at + 1)
            if every:
                lanes.pos[:n] += skip + size
                k = at
            else:
                lanes.pos[live] += skip + size
                k[live] = at
            still = at <= last
            if not still.all():
                live = live[still]
    return


def read_ac_second(lanes: Lanes, units: np.ndarray, place, coef: np.ndarray, table, first: int, last: int, low: int) -> None:
    lut = lookup(list(table[0]), list(table[1]))
    eob = np.zeros(len(units), np.int64)
    one = 1 << low
    for u in range(int(units.max(initial=0))):
        n = int(np.searchsorted(-units, -u, side="left"))
        block = place(u, n)
        part = coef[first : last + 1, block].astype(np.int64)
        ended = eob[:n] > 0
        run, fresh = np.full(n, -1), np.zeros(n, np.int64)  # run -1: a symbol is due
        for row in part:
            due = np.flatnonzero((run < 0) & ~ended) if not ended.all() else ()
            if len(due):
                p = lanes.pos[due]
                w = lanes.win[np.minimum(p >> 3, len(lanes.win) - 1)] << (p & 7).astype(np.uint64)
                e = lut[(w >> np.uint64(48)).astype(np.int64)]
                skip, size, r = (e & 255).astype(np.int64), ((e >> 8) & 15).astype(np.int64), (e >> 12).astype(np.int64)
                ends = (size == 0) & (r < 15)
                extra = np.where(ends, r, size)
                bits = received(w, skip, extra)
                run[due] = np.where(ends, -1, r)
                fresh[due] = np.where(size > 0, np.where(bits > 0, one, -one), 0)
                eob[due[ends]] = (1 << r[ends]) + bits[ends]
                ended[due[ends]] = True
                lanes.pos[due] += skip + extra
            known = row != 0
            bit = lanes.bit(n) * known
            lanes.pos[:n] += known
            if ended.all():
                row += np.where(bit * ((np.abs(row) & one) == 0), np.where(row > 0, one, -one), 0)
                continue
            zero = ~known & ~ended
            here = zero & (run == 0)
            row += np.where(bit * ((np.abs(row) & one) == 0), np.where(row > 0, one, -one), 0)
            row[here] = fresh[here]
            run -= zero
        eob[:n] -= eob[:n] > 0
        coef[first : last + 1, block] = part


def coefficients(images: list[Image]) -> list[dict[int, np.ndarray]]:
    """For images of one kind: by component, arrays [64, blocks] with the blocks in raster order of whole units."""
    head = images[0]
    units = np.array([i.wide * i.tall for i in images])
    per_unit = {c: h * v for c, h, v, _ in head.components}
    starts = {c: np.cumsum(units * n) - units * n for c, n in per_unit.items()}
    coef = {c: np.zeros((64, int((units * n).sum())), np.int16) for c, n in per_unit.items()}
    wide = np.array([i.wide for i in images])
    shape = {c: (h, v) for c, h, v, _ in head.components}
    for k, (used, first, last, high, low, restart, _) in enumerate(head.scans):
        data, begin, per = unstuffed(images, k)
        image = np.repeat(np.arange(len(images)), per)
        number = np.arange(len(image)) - np.repeat(np.cumsum(per) - per, per)
        single = len(used) == 1
        c0 = used[0][0]
        h0, v0 = shape[c0]
        if single:  # blocks that cover the image, not whole units
            across = np.array([-(-(-(-i.width * h0 // i.most_h)) // 8) for i in images])
            down = np.array([-(-(-(-i.height * v0 // i.most_v)) // 8) for i in images])
            total = across * down
        else:
            across, total = wide, units
        step = restart or int(total.max(initial=1))
        length = np.minimum(total[image] - number * step, step)
        order = np.argsort(-length, kind="stable")
        image, number, length = image[order], number[order], length[order]
        lanes = Lanes(data, begin[order])
        origin = number * step

        def place(u: int, n: int, c=c0, h=h0, image=image, origin=origin, across=across) -> np.ndarray:
            y, x = np.divmod(origin[:n] + u, across[image[:n]])
            return starts[c][image[:n]] + y * wide[image[:n]] * h + x

        def unit_place(c: int, image=image, origin=origin):
            h, v = shape[c]

            def of(u: int, index: int, n: int) -> np.ndarray:
                y, x = np.divmod(origin[:n] + u, wide[image[:n]])
                return starts[c][image[:n]] + (y * v + index // h) * wide[image[:n]] * h + x * h + index % h

            return of

        if first == 0:
            if single:
                read_dc(lanes, [(c0, 0)], length, {c0: lambda u, index, n, place=place: place(u, n)}, coef, dict(used), high, low)
            else:
                blocks = [(c, i) for c, _ in used for i in range(per_unit[c])]
                read_dc(lanes, blocks, length, {c: unit_place(c) for c, _ in used}, coef, dict(used), high, low)
        elif high:
            read_ac_second(lanes, length, place, coef[c0], used[0][1], first, last, low)
        else:
            read_ac_first(lanes, length, place, coef[c0], used[0][1], first, last, low)
    return [{c: x[:, starts[c][i] : starts[c][i] + units[i] * per_unit[c]] for c, x in coef.items()} for i in range(len(images))]


def planes(coef: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """Pixels [blocks, 64] of coefficients [64, blocks], before clipping shifted to 0..255."""
    x = (coef.astype(np.float64) * quantiser[:, None]).T @ BASIS
    return np.clip((x.astype(np.int64) + 4096 >> 13) + 128, 0, 255)


def tensor(image: Image, coef: dict[int, np.ndarray]) -> np.ndarray:
    """Height x width x 3, 8-bit RGB; one component gives grey. Chroma is repeated up to full resolution."""
    full = []
    for c, h, v, q in image.components:
        p = planes(coef[c], image.quantisers[q]).reshape(image.tall * v, image.wide * h, 8, 8).transpose(0, 2, 1, 3).reshape(image.tall * v * 8, image.wide * h * 8)
        full.append(np.repeat(np.repeat(p, image.most_v // v, 0), image.most_h // h, 1)[: image.height, : image.width])
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    rgb = np.stack([y + (91881 * cr + 32768 >> 16), y - (22554 * cb + 46802 * cr + 32768 >> 16), y + (116130 * cb + 32768 >> 16)], 2)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def decoded(files: list[bytes]) -> list[tuple[Image, dict[int, np.ndarray]]]:
    images = [Image(f) for f in files]
    kinds: dict[tuple, list[int]] = {}
    for i, x in enumerate(images):
        kinds.setdefault(x.kind, []).append(i)
    out: list = [None] * len(files)
    for which in kinds.values():
        for i, c in zip(which, coefficients([images[i] for i in which]), strict=True):
            out[i] = (images[i], c)
    return out


def payload_of(image: Image, coef: dict[int, np.ndarray]) -> bytes:
    """The bytes that ``written`` has stored."""
    units = image.wide * image.tall
    luma = coef[1].T
    if image.wide > 1:
        back = np.empty(4 * units, np.int64)
        back[luma_order(image.wide, image.tall)] = np.arange(4 * units)
        luma = luma[back]
    blocks = np.concatenate([luma.reshape(units, 4, 64), coef[2].T[:, None], coef[3].T[:, None]], 1)
    return (blocks + 128).astype(np.uint8).tobytes()[: int(image.comment.split()[1])]


def features(rgb: np.ndarray) -> str:
    """Size, sums of the channels and how many pixels of each channel are in each quarter of the range."""
    flat = rgb.reshape(-1, 3)
    sums = flat.sum(0, dtype=np.int64)
    quarters = [np.bincount(flat[:, c] >> 6, minlength=4) for c in range(3)]
    return f"{rgb.shape[1]}x{rgb.shape[0]}:" + ",".join(map(str, sums)) + ":" + ",".join(str(x) for q in quarters for x in q)


def stored(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text, filled up with spaces to a multiple of 192 bytes, as a JPEG."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", WORK_BYTES):
                texts = encoded(part.column("text"))
                files = written([t + b" " * (max(1, -(-len(t) // UNIT)) * UNIT - len(t)) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "doc_id long, n_bytes long, media binary")


def tensors(media: DataFrame) -> DataFrame:
    """The media column of any table of JPEGs as tensors: all other columns, height, width, rgb."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != "media") + ", height int, width int, rgb binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", WORK_BYTES):
                rgb = [tensor(*x) for x in decoded(part.column("media").to_pylist())]
                others = [n for n in part.schema.names if n != "media"]
                columns = [*[part.column(n) for n in others], *[pa.array([x.shape[i] for x in rgb], pa.int32()) for i in (0, 1)], pa.array([x.tobytes() for x in rgb], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*others, "height", "width", "rgb"])

    return media.mapInArrow(read, schema)


def described(media: DataFrame) -> DataFrame:
    """Reads the stored files back: payload, features of the tensor, digests."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "n_bytes", WORK_BYTES):  # what is decoded, not what is stored
                rows = []
                files = part.column("media").to_pylist()
                for raw, (image, coef) in zip(files, decoded(files), strict=True):
                    payload = payload_of(image, coef)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), features(tensor(image, coef))))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(read, schema)


def op9_progressive_jpeg(spark, sf_dir: str) -> DataFrame:
    return described(stored(read_table(spark, sf_dir, "documents")))
