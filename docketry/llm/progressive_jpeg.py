"""Progressive JPEG for media columns: scans accumulate into coefficient arrays, then RGB tensors.

Restart intervals are independent, so the decoder takes those of all images of a batch, component by
component, as lanes of numpy arrays and reads one Huffman symbol of every lane at a time. Any spectral
selection, successive approximation, sampling and restart interval may occur. The encoder stores bytes
without loss as the quantised coefficients of 4:4:4 images with unit quantisation: 192 bytes a block row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docketry.llm.common import as_binary, blocks, fresh, numbered

#: Bytes of payload for each 8 x 8 block of the three components.
UNIT = 192
#: Scans of the encoder: components, spectral selection, successive approximation (high, low).
SCRIPT = (((0, 1, 2), 0, 0, 0, 1), *(((c,), 1, 5, 0, 1) for c in range(3)), *(((c,), 6, 63, 0, 0) for c in range(3)), ((0, 1, 2), 0, 0, 1, 0), *(((c,), 1, 5, 1, 0) for c in range(3)))
#: Payload bytes that a task turns into images at once.
BATCH_BYTES = 1 << 20

# place in the 8 x 8 block of each coefficient along the zigzag, by anti-diagonals
_ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))
#: 2**13 times the inverse DCT; with integers the sums are exact in float64 whatever their order.
_SCALE = 13
_wave = np.array([[(0.5 if u else 0.5 / np.sqrt(2)) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
_INVERSE = np.round(np.einsum("yv,xu->vuyx", _wave, _wave).reshape(64, 64)[_ZIGZAG] * (1 << _SCALE))


def _ac_table() -> tuple[list[int], list[int]]:
    """Counts by code length and symbols: 4 bits for sizes 1 to 8 without a run and the end of a block, else 9."""
    short = [0x00, *range(1, 9)]
    return [0, 0, 0, len(short), 0, 0, 0, 0, 152, 0, 0, 0, 0, 0, 0, 0], short + [0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11) if r << 4 | s not in short][:151]


_DC = ([0, 0, 0, 12] + [0] * 12, list(range(12)))
_AC = _ac_table()


def _codes(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) by symbol."""
    code, k = 0, 0
    value, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for bits, n in enumerate(counts, 1):
        for s in symbols[k : k + n]:
            value[s], length[s] = code, bits
            code += 1
        k, code = k + n, code << 1
    return value, length


_DC_CODE, _AC_CODE = _codes(*_DC), _codes(*_AC)
_SIZE = np.array([int(i).bit_length() for i in range(2048)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (np.where(v < 0, v - 1, v) & ((1 << size) - 1)).astype(np.uint64)


def _pack(lane: np.ndarray, value: np.ndarray, bits: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each lane, padded with ones to whole bytes; (bytes, first byte of each lane)."""
    total = np.bincount(lane, bits, lanes).astype(np.int64)
    size = (total + 7) >> 3
    first = np.concatenate([[0], np.cumsum(size)])
    before = np.cumsum(bits) - bits
    own = (np.cumsum(total) - total)[lane]
    at = 8 * first[:-1][lane] + before - own
    byte, within = at >> 3, at & 7
    window = value << (64 - within - bits).astype(np.uint64)
    out = np.zeros(first[-1] + 8)
    for j in range(8):
        more = slice(None) if j < 2 else np.flatnonzero(within + bits > 8 * j)
        if j >= 2 and not len(more):
            break
        part = (window[more] >> np.uint64(56 - 8 * j)) & np.uint64(255)
        out += np.bincount(byte[more] + j, part, len(out))
    out = out[: first[-1]].astype(np.uint8)
    pad = 8 * size - total
    out[first[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    return out, first


def _entropy(lane: np.ndarray, value: np.ndarray, bits: np.ndarray, lanes: int, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Stuffed bytes with restart markers between the lanes of an image; where each image's part starts.

    ``ends``: lanes up to the end of each image.
    """
    raw, first = _pack(lane, value, bits, lanes)
    full = np.concatenate([[0], np.cumsum(raw == 255)])
    index = np.arange(lanes)
    image = np.searchsorted(ends, index, "right")
    start = np.concatenate([[0], ends[:-1]])
    marked = np.ones(lanes, bool)
    marked[ends - 1] = False
    markers = np.concatenate([[0], np.cumsum(2 * marked)])
    size = np.diff(first)
    out = np.zeros(len(raw) + full[-1] + markers[-1], np.uint8)
    to = np.arange(len(raw)) + full[:-1] + np.repeat(markers[:-1], size)
    out[to] = raw
    after = first[1:] + full[first[1:]] + markers[:-1]
    out[after[marked]] = 0xFF
    out[after[marked] + 1] = 0xD0 + ((index - start[image]) % 8)[marked]
    places = first + full[first] + markers
    return out.tobytes(), np.concatenate([[0], places[ends]])


def _first_scan(v: np.ndarray, code: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Events (lane, value, bits) of a band of coefficients with one block a lane."""
    lanes, width = v.shape
    row, col = np.nonzero(v)
    value = v[row, col].astype(np.int64)
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] != row[:-1]
    before = np.where(fresh, -1, np.concatenate([[0], col[:-1]]))
    run = col - before - 1
    size = _SIZE[np.abs(value)]
    symbol = (run & 15) << 4 | size
    zeros, zero_bits = code[0][0xF0], int(code[1][0xF0])
    prefix = np.array([0, zeros, zeros << np.uint64(zero_bits) | zeros, (zeros << np.uint64(zero_bits) | zeros) << np.uint64(zero_bits) | zeros], np.uint64)[run >> 4]
    length = code[1][symbol]
    bits = length + size
    merged = (prefix << bits.astype(np.uint64)) | (code[0][symbol] << size.astype(np.uint64)) | _extra(value, size)
    bits = bits + zero_bits * (run >> 4)
    open_ = np.flatnonzero(v[:, -1] == 0)
    counts = np.bincount(row, minlength=lanes)
    total = counts.copy()
    total[open_] += 1
    start = np.cumsum(total) - total
    place = start[row] + np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
    out_value, out_bits = np.empty(total.sum(), np.uint64), np.empty(total.sum(), np.int64)
    out_value[place], out_bits[place] = merged, bits
    last = start[open_] + counts[open_]
    out_value[last], out_bits[last] = code[0][0], code[1][0]
    return np.repeat(np.arange(lanes), total), out_value, out_bits


def _refinement(v: np.ndarray, low: int, code: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One event a lane: the refinement of a band of at most five coefficients."""
    lanes = len(v)
    value, bits = np.zeros(lanes, np.uint64), np.zeros(lanes, np.int64)
    held, held_bits, run = np.zeros(lanes, np.uint64), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    one = np.uint64(1)

    def put(at, x, n):
        value[at] = value[at] << n.astype(np.uint64) | x
        bits[at] += n

    for k in range(v.shape[1]):
        size = np.abs(v[:, k]) >> low
        run += size == 0
        old = np.flatnonzero(size > 1)
        held[old] = held[old] << one | (size[old] & 1).astype(np.uint64)
        held_bits[old] += 1
        new = np.flatnonzero(size == 1)
        if len(new):
            symbol = run[new] << 4 | 1
            put(new, code[0][symbol] << one | (v[new, k] > 0).astype(np.uint64), code[1][symbol] + 1)
            put(new, held[new], held_bits[new])
            held[new], held_bits[new], run[new] = 0, 0, 0
    rest = np.flatnonzero((run > 0) | (held_bits > 0))
    put(rest, np.full(len(rest), code[0][0], np.uint64), np.full(len(rest), code[1][0]))
    put(rest, held[rest], held_bits[rest])
    return np.arange(lanes), value, bits


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload (a positive multiple of 192 bytes); its coefficients are the bytes less 128."""
    if not payloads:
        return []
    counts = [len(p) // UNIT for p in payloads]
    columns = [-(-n // 8191) for n in counts]
    rows = [-(-n // c) for n, c in zip(counts, columns)]
    padded = b"".join(p + b"\x80" * (UNIT * c * r - len(p)) for p, c, r in zip(payloads, columns, rows))
    coefficients = np.frombuffer(padded, np.uint8).reshape(-1, 3, 64).astype(np.int16) - 128
    ends = np.cumsum([c * r for c, r in zip(columns, rows)])
    lanes = len(coefficients)
    scans = []
    for components, first, last, high, low in SCRIPT:
        if first == 0:
            dc = coefficients[:, :, 0].astype(np.int64).ravel()
            lane = np.repeat(np.arange(lanes), 3)
            if high:
                events = lane, ((dc >> low) & 1).astype(np.uint64), np.ones(len(dc), np.int64)
            else:
                dc = dc >> low
                size = _SIZE[np.abs(dc)]
                events = lane, _DC_CODE[0][size] << size.astype(np.uint64) | _extra(dc, size), _DC_CODE[1][size] + size
        else:
            band = coefficients[:, components[0], first : last + 1].astype(np.int64)
            events = _refinement(band, low, _AC_CODE) if high else _first_scan(np.sign(band) * (np.abs(band) >> low), _AC_CODE)
        head = _segment(0xDA, bytes([len(components), *(b for c in components for b in (c + 1, 0)), first, last, high << 4 | low]))
        scans.append((head, *_entropy(*events, lanes, ends)))
    tables = _segment(0xDB, b"\x00" + b"\x01" * 64) + b"".join(_segment(0xC4, bytes([kind << 4, *counts_, *symbols])) for kind, (counts_, symbols) in enumerate((_DC, _AC))) + _segment(0xDD, b"\x00\x01")
    out = []
    for i, (c, r, p) in enumerate(zip(columns, rows, payloads)):
        frame = _segment(0xC2, b"\x08" + (8 * r).to_bytes(2, "big") + (8 * c).to_bytes(2, "big") + b"\x03" + b"".join(bytes([k, 0x11, 0]) for k in (1, 2, 3)))
        body = b"".join(head + data[places[i] : places[i + 1]] for head, data, places in scans)
        out.append(b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(p)) + tables + frame + body + b"\xff\xd9")
    return out


class _Image:
    """Frame of one image and where its components' blocks stand in the batch's coefficient array."""

    def __init__(self, height: int, width: int, components: list[tuple[int, int, int, int]]):
        self.height, self.width, self.components, self.comment = height, width, components, b""
        self.h, self.v = max(c[1] for c in components), max(c[2] for c in components)
        self.mcus_x, self.mcus_y = -(-width // (8 * self.h)), -(-height // (8 * self.v))
        self.bases: list[int] = []
        self.error = ""

    def blocks(self, k: int) -> int:
        return self.mcus_x * self.components[k][1] * self.mcus_y * self.components[k][2]

    def own(self, k: int) -> tuple[int, int]:
        """Blocks across and down that a scan of this component alone has."""
        _, h, v, _ = self.components[k]
        return -(-(-(-self.width * h // self.h)) // 8), -(-(-(-self.height * v // self.v)) // 8)


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """Symbol << 5 | length for every 16 bits; 0 where no code fits."""
    table, at, k = np.zeros(1 << 16, np.uint16), 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[k : k + n]:
            table[at : at + (1 << (16 - bits))] = s << 5 | bits
            at += 1 << (16 - bits)
        k += n
    return table


class _Bits:
    """Bit positions of lanes in one buffer."""

    def __init__(self, data: np.ndarray, position: np.ndarray):
        padded = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.uint64)
        n = len(data) + 1
        self.window = np.zeros(n, np.uint64)
        for j in range(8):
            self.window |= padded[j : j + n] << np.uint64(56 - 8 * j) if j + n <= len(padded) else np.uint64(0)
        self.at, self.limit = position, n - 1

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        """The next bits of the lanes, from the top of 64 bits on; at least 49 are right."""
        p = self.at[lanes]
        return self.window[np.minimum(p >> 3, self.limit)] << (p & 7).astype(np.uint64)


def _top(window: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n (0 to 16) bits of the windows."""
    return ((window >> np.uint64(32)) >> (32 - n).astype(np.uint64)).astype(np.int64)


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


class _Lanes:
    """The scans of one kind: of each its image, first and last byte, units of a restart interval and of all; tables; places."""

    def __init__(self):
        self.scans, self.tables, self.places = [], [], []


def decode_images(media: list[bytes]) -> tuple[list[_Image | None], np.ndarray]:
    """Frames (None where unreadable) and the batch's coefficients in zigzag order, a row for each block."""
    sizes = [len(m) for m in media]
    offsets = np.cumsum([0, *sizes])
    data = np.frombuffer(b"".join(media), np.uint8)
    marks = np.flatnonzero(data[:-1] == 255) if len(data) else np.zeros(0, np.int64)
    following = data[marks + 1] if len(marks) else np.zeros(0, np.uint8)
    restarts = marks[(following >= 0xD0) & (following <= 0xD7)]
    others = marks[(following != 0) & (following != 255) & ~((following >= 0xD0) & (following <= 0xD7))]
    stuffed = np.zeros(len(data) + 1, np.int64)
    stuffed[marks[following == 0] + 2] = 1  # counts for what comes after the zero
    shift = np.cumsum(stuffed)
    keep = np.ones(len(data), bool)
    keep[marks[following == 0] + 1] = False
    plain = data[keep]

    images: list[_Image | None] = []
    groups: dict[tuple, _Lanes] = {}
    tables: dict[bytes, int] = {}
    lookups: list[np.ndarray] = []
    total = 0
    for i, one in enumerate(media):
        try:
            image, scans = _parse(one, int(offsets[i]), others)
        except (ValueError, IndexError, KeyError) as problem:
            image = None
            images.append(None)
            del problem
            continue
        for k in range(len(image.components)):
            image.bases.append(total)
            total += image.blocks(k)
        for (ks, huffman, first, last, high, low, every), start, end in scans:
            sampling = tuple(image.components[k][1:3] for k in ks) if len(ks) > 1 else ((1, 1),)
            lanes = groups.setdefault((sampling, first, last, high, low), _Lanes())
            if len(ks) > 1:
                n = image.mcus_x * image.mcus_y
                places = [(image.bases[k], image.mcus_x * image.components[k][1], image.mcus_x) for k in ks]
            else:
                across, down = image.own(ks[0])
                n = across * down
                places = [(image.bases[ks[0]], image.mcus_x * image.components[ks[0]][1], across)]
            ids = []
            for table in huffman:
                if table is not None and table not in tables:
                    tables[table] = len(lookups)
                    lookups.append(_lookup(table[:16], table[16:]))
                ids.append(tables.get(table, 0))
            lanes.scans.append((i, start, end, every or n, n))
            lanes.tables.append(ids)
            lanes.places.append(places)
        images.append(image)

    coefficients = np.zeros((max(total, 1), 64), np.int16)
    bits = _Bits(plain, np.zeros(0, np.int64))
    for key in sorted(groups, key=lambda g: (g[3] > 0, -g[4])):  # first passes, then refinements from high to low
        sampling, first, last, high, low = key
        lanes = groups[key]
        image, start, end, every, units = np.array(lanes.scans, np.int64).T
        # a lane for each restart interval of a scan
        low_mark = np.searchsorted(restarts, start)
        m = np.minimum(np.searchsorted(restarts, end) - low_mark + 1, -(-units // every))
        j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        begin = np.repeat(start, m)
        later = np.flatnonzero(j)
        begin[later] = restarts[np.repeat(low_mark, m)[later] + j[later] - 1] + 2
        first_unit = j * np.repeat(every, m)
        count = np.minimum(np.repeat(every, m), np.repeat(units, m) - first_unit)
        bits.at = 8 * (begin - shift[begin])
        image_of = np.repeat(image, m)
        own_tables = np.repeat(np.array(lanes.tables, np.int64).T, m, axis=1)
        own_places = np.repeat(np.array(lanes.places, np.int64).transpose(2, 1, 0), m, axis=2)
        wrong = _scan(bits, coefficients, lookups, first_unit, count, own_tables, own_places, sampling, first, last, high, low)
        for i in np.unique(image_of[wrong]):
            if images[i] is not None:
                images[i].error = "entropy-coded data are damaged"
    return images, coefficients


def _parse(one: bytes, offset: int, others: np.ndarray) -> tuple[_Image, list]:
    """Frame and scans of an image; positions count in the batch."""
    if one[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, every, comment = 2, 0, b""
    quant: dict[int, bytes] = {}
    huffman: dict[tuple[int, int], bytes] = {}
    image, scans = None, []
    while True:
        if one[at] != 255:
            raise ValueError("marker expected")
        marker = one[at + 1]
        if marker == 0xD9:
            break
        size = one[at + 2] << 8 | one[at + 3]
        body = one[at + 4 : at + 2 + size]
        if marker == 0xC2:
            image = _Image(body[1] << 8 | body[2], body[3] << 8 | body[4], [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])])
            if not image.height or not image.width or len(image.components) not in (1, 3):
                raise ValueError("frame")
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not progressive")
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.int64)
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                huffman[body[k] >> 4, body[k] & 15] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif marker == 0xDD:
            every = body[0] << 8 | body[1]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            names = [c[0] for c in image.components]
            ks = [names.index(body[1 + 2 * j]) for j in range(body[0])]
            first, last, approx = body[-3:]
            used = [huffman[0 if first == 0 else 1, body[2 + 2 * j] >> 4 if first == 0 else body[2 + 2 * j] & 15] if not (first == 0 and approx >> 4) else None for j in range(body[0])]
            if last > 63 or first > last:
                raise ValueError("spectral selection")
            start = offset + at + 2 + size
            end = int(others[np.searchsorted(others, start)])
            scans.append(((ks, used, first, last, approx >> 4, approx & 15, every), start, end))
            at = end - offset
            continue
        at += 2 + size
    if image is None:
        raise ValueError("no frame")
    image.comment, image.quant = comment, quant
    return image, scans


def _scan(bits, coefficients, lookups, first_unit, count, tables, places, sampling, first, last, high, low):
    """Run one kind of scan over its lanes; returns the lanes that turned out damaged."""
    lanes = len(first_unit)
    every = np.arange(lanes)
    wrong = np.zeros(lanes, bool)
    alone = len(lookups) == 1 or len(np.unique(tables)) == 1
    one = lookups[int(tables.flat[0])] if lookups and tables.size else None

    def symbol(live, window, c=0):
        top = (window >> np.uint64(48)).astype(np.int64)
        if alone:
            found = one[top].astype(np.int64)
        else:
            found = np.empty(len(live), np.int64)
            for t in np.unique(tables[c]):
                own = tables[c][live] == t
                found[own] = lookups[t][top[own]]
        return found >> 5, found & 31

    last_dc = np.zeros((len(sampling), lanes), np.int64)
    eob = np.zeros(lanes, np.int64)
    for j in range(int(count.max(initial=0))):
        live = every if j == 0 and count.min() > 0 else np.flatnonzero(count > j)
        unit = first_unit[live] + j
        if first == 0:
            for c, (h, v) in enumerate(sampling):
                base, stride, across = places[:, c][:, live] if places.ndim == 3 else places[:, live]
                for y in range(v):
                    for x in range(h):
                        block = base + (unit // across * v + y) * stride + unit % across * h + x
                        window = bits.peek(live)
                        if high:
                            coefficients[block, 0] |= ((window >> np.uint64(63)).astype(np.int16) << low).astype(np.int16)
                            bits.at[live] += 1
                            continue
                        size, length = symbol(live, window, c)
                        wrong[live[(length == 0) | (size > 11)]] = True
                        size = np.minimum(size, 11)
                        last_dc[c, live] += _signed(_top(window << length.astype(np.uint64), size), size)
                        coefficients[block, 0] = (last_dc[c, live] << low).astype(np.int16)
                        bits.at[live] += length + size
            continue
        base, stride, across = places[:, 0][:, live]
        block = base + unit // across * stride + unit % across
        if high:
            _refine(bits, coefficients, symbol, live, block, eob, wrong, first, last, low)
            continue
        k = np.full(len(live), first)
        going = np.flatnonzero(eob[live] == 0)
        eob[live] = np.maximum(eob[live] - 1, 0)
        while len(going):
            who = live[going]
            window = bits.peek(who)
            found, length = symbol(who, window)
            run, size = found >> 4, found & 15
            value = _top(window << length.astype(np.uint64), size)
            end = (size == 0) & (run < 15)
            if end.any():
                extra = run[end]
                eob[who[end]] = (1 << extra) - 1 + _top(window[end] << length[end].astype(np.uint64), extra)
                length[end] += extra
            at = k[going] + run
            bad = (length == 0) | ((at > last) & ~end)
            put = (size > 0) & ~bad
            flat = block[going] * 64 + at
            if put.all():
                coefficients.reshape(-1)[flat] = _signed(value, size) << low
            else:
                coefficients.reshape(-1)[flat[put]] = _signed(value, size)[put] << low
            bits.at[who] += length + size
            k[going] = at + 1
            if bad.any():
                wrong[who[bad]] = True
            going = going[~end & ~bad & (at < last)]
    return wrong


def _refine(bits, coefficients, symbol, live, block, eob, wrong, first, last, low):
    """One block of each lane in a refining scan."""
    run, value = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    need = np.ones(len(live), bool)
    for k in range(first, last + 1):
        ask = np.flatnonzero(need & (eob[live] == 0))
        if len(ask):
            who = live[ask]
            window = bits.peek(who)
            found, length = symbol(who, window)
            r, size = found >> 4, found & 15
            wrong[who[(length == 0) | (size > 1)]] = True
            rest = window << length.astype(np.uint64)
            end = (size == 0) & (r < 15)
            extra = np.where(end, r, 0)
            eob[who[end]] = (1 << extra[end]) + _top(rest[end], extra[end])
            value[ask] = np.where(size > 0, np.where((rest >> np.uint64(63)) > 0, 1, -1) << low, 0)
            run[ask] = r
            need[ask] = False
            bits.at[who] += length + extra + (size > 0)
        now = coefficients[block, k].astype(np.int64)
        old = np.flatnonzero(now)
        if len(old):
            bit = (bits.peek(live[old]) >> np.uint64(63)).astype(np.int64)
            bits.at[live[old]] += 1
            was = now[old]
            coefficients[block[old], k] = was + np.where((bit > 0) & ((np.abs(was) >> low) & 1 == 0), np.sign(was) << low, 0)
        gap = np.flatnonzero((now == 0) & (eob[live] == 0))
        here = gap[run[gap] == 0]
        coefficients[block[here], k] = value[here]
        need[here] = True
        run[gap] -= 1
    eob[live] = np.maximum(eob[live] - 1, 0)


def rgb_tensors(images: list[_Image | None], coefficients: np.ndarray) -> list[np.ndarray | None]:
    """Height x width x 3 arrays of uint8: dequantised, inverse-transformed, chroma brought to full size."""
    out: list[np.ndarray | None] = [None] * len(images)
    alike: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        if image is not None and not image.error:
            alike.setdefault(tuple(image.quant[c[3]].tobytes() for c in image.components), []).append(i)
    for members in alike.values():
        for i in members:
            image = images[i]
            planes = []
            for k, (_, h, v, q) in enumerate(image.components):
                wide, n = image.mcus_x * h, image.blocks(k)
                own = coefficients[image.bases[k] : image.bases[k] + n] * image.quant[q][None, :].astype(np.float64)
                sample = np.floor((own @ _INVERSE + (1 << (_SCALE - 1))) / (1 << _SCALE)) + 128
                plane = np.clip(sample, 0, 255).astype(np.int32).reshape(n // wide, wide, 8, 8).transpose(0, 2, 1, 3).reshape(n // wide * 8, wide * 8)
                plane = np.repeat(np.repeat(plane, image.v // v, axis=0), image.h // h, axis=1) if (h, v) != (image.h, image.v) else plane
                planes.append(plane[: image.height, : image.width])
            if len(planes) == 1:
                out[i] = np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
                continue
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            # the colour matrix in 16-bit fixed point
            red = y + ((91881 * cr + 32768) >> 16)
            green = y - ((22554 * cb + 46802 * cr + 32768) >> 16)
            blue = y + ((116130 * cb + 32768) >> 16)
            out[i] = np.clip(np.stack([red, green, blue], axis=2), 0, 255).astype(np.uint8)
    return out


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, padded with blanks to a multiple of 192, as a JPEG.

    Null and empty texts are 192 blanks; repeated and null doc_ids keep a row each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, limit=BATCH_BYTES):
                at, raw = as_binary(part.column("text"))
                data = raw.tobytes()
                texts = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                media = encode_payloads([t.ljust(UNIT * max(1, -(-len(t) // UNIT))) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def decode_media(table: DataFrame, column: str = "media") -> DataFrame:
    """Adds width, height, rgb (binary, row by row), payload (where the image holds one) and error to a table with JPEG bytes.

    Null media give nulls; media that are not readable as progressive JPEG give nulls and an error. Where
    ``table`` has a column of one of these names it stays, and the new one's name ends in ``_``.
    """
    columns, names = table.columns, fresh(table, "width", "height", "rgb", "payload", "error")
    extra = [("width", "int", pa.int32()), ("height", "int", pa.int32()), ("rgb", "binary", pa.binary()), ("payload", "binary", pa.binary()), ("error", "string", pa.string())]

    def decoded(media: list[bytes | None]) -> list[list]:
        images, coefficients = decode_images([m or b"" for m in media])
        tensors = rgb_tensors(images, coefficients)
        rows = []
        for m, image, tensor in zip(media, images, tensors):
            if m is None or tensor is None:
                rows.append([None] * 4 + [None if m is None else "not a progressive JPEG" if image is None else image.error])
                continue
            payload = None
            if image.comment.startswith(b"payload ") and len(image.bases) == 3:
                n = image.blocks(0)
                own = coefficients[image.bases[0] : image.bases[0] + 3 * n].reshape(3, n, 64).transpose(1, 0, 2)
                payload = (own + 128).astype(np.uint8).tobytes()[: int(image.comment[8:])]
            rows.append([image.width, image.height, tensor.tobytes(), payload, None])
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, column, BATCH_BYTES):
                rows = decoded(part.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, e[2]) for c, e in zip(zip(*rows), extra))], [*columns, *names])

    return numbered(table, column).mapInArrow(run, T.StructType([*table.schema, *T.StructType.fromDDL(",".join(f"{n} {t}" for n, (_, t, _) in zip(names, extra)))]))


def digest(decoded: DataFrame) -> DataFrame:
    """Sizes and checksums of the stored form and of the payload read back (null where nothing could be read); feature: size, channel sums and checksum of the tensor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = []
                for media, payload, rgb, w, h in zip(*(part.column(c).to_pylist() for c in ("media", "payload", "rgb", "width", "height"))):
                    if payload is None or rgb is None:
                        rows.append((None, None, None, None if media is None else len(media), None if media is None else sha256(media).hexdigest(), None))
                        continue
                    sums = np.frombuffer(rgb, np.uint8).reshape(-1, 3).sum(0, dtype=np.int64)
                    rows.append((len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), sha256(media).hexdigest(), f"{w}x{h}:{sums[0]},{sums[1]},{sums[2]}:{zlib.crc32(rgb):08x}"))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names)

    chosen = decoded.select("doc_id", "n_bytes", "media", "payload", "rgb", "width", "height")
    return chosen.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
