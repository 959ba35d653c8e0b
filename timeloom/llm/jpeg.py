"""Progressive JPEG over arrays: many images at once, one lane for each restart interval.

The decoder reads Huffman-coded progressive files (SOF2) of 8 bits: scans of spectral selection and successive
approximation, interleaved DC scans included, are accumulated in one array of coefficients; images of one scan script are
decoded together, a step for each symbol of a lane. It then dequantises, inverts the transform in exact integer arithmetic,
repeats subsampled chroma and converts to RGB. The encoder writes 64 bytes of any payload as the coefficients of a block.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np


def _zigzag() -> np.ndarray:
    """Natural index of each coefficient in coding order: along the anti-diagonals, every other one upwards."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    return np.array([8 * r + c for r, c in sorted(cells, key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))])


ZIGZAG = _zigzag()
#: The transform's matrix times 2**13; products of it with coefficients stay exact in double precision.
SCALE = 13
_k, _x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
_BASIS = np.round(np.where(_k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * _x + 1) * _k * np.pi / 16) * (1 << SCALE))
_MARKER = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")
#: The encoder's scans: (first coefficient, last, previous bit, bit).
SCRIPT = ((0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (1, 63, 1, 0), (0, 0, 1, 0))


@dataclass
class Scan:
    components: tuple
    tables: tuple
    band: tuple
    interval: int
    data: bytes


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # id, horizontal and vertical sampling, quantisation table
    quant: dict = field(default_factory=dict)
    scans: list = field(default_factory=list)
    comment: bytes = b""

    def shape(self, c: int) -> tuple[int, int]:
        """Blocks in height and width of component c, as stored (whole units of all components)."""
        most_h, most_v = max(x[1] for x in self.components), max(x[2] for x in self.components)
        return -(-self.height // (8 * most_v)) * self.components[c][2], -(-self.width // (8 * most_h)) * self.components[c][1]

    def own_shape(self, c: int) -> tuple[int, int]:
        """Blocks that a scan of component c alone holds."""
        most_h, most_v = max(x[1] for x in self.components), max(x[2] for x in self.components)
        size = lambda n, a, b: -(-(-(-n * a // b)) // 8)
        return size(self.height, self.components[c][2], most_v), size(self.width, self.components[c][1], most_h)


def parse(data: bytes) -> Image:
    """The segments of one file; raises ValueError for files that are not progressive JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    image, tables, interval, at = Image(), {}, 0, 2
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        kind = data[at + 1] if data[at : at + 1] == b"\xff" and at + 1 < len(data) else 0
        if kind == 0xD9:
            return image
        if not kind:
            raise ValueError("a JPEG file is cut short")
        at += 2
        length = int.from_bytes(data[at : at + 2], "big")
        body, at = data[at + 2 : at + length], at + length
        if kind == 0xC2:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            if body[0] != 8:
                raise ValueError("only 8 bits a sample are read")
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only progressive Huffman-coded files are read")
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:n], body[n:]
        elif kind == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int64)
                body = body[1 + 64 * wide :]
        elif kind == 0xDD:
            interval = int.from_bytes(body, "big")
        elif kind == 0xFE:
            image.comment = body
        elif kind == 0xDA:
            ids = {x[0]: k for k, x in enumerate(image.components)}
            n, band = body[0], (body[-3], body[-2], body[-1] >> 4, body[-1] & 15)
            chosen = tuple(ids[body[1 + 2 * k]] for k in range(n))
            need = () if band[0] == 0 and band[2] else tuple(tables.get((body[2 + 2 * k] >> 4) if band[0] == 0 else 16 + (body[2 + 2 * k] & 15)) for k in range(n))
            end = _MARKER.search(data, at)
            if None in need or not end:
                raise ValueError("a scan has no table or no end")
            image.scans.append(Scan(chosen, need, band, interval, data[at : end.start()]))
            at = end.start()


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol of the code that any 16 bits begin with; length 0 where there is none."""
    lengths, symbols = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, k = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            at, span = code << (16 - n), 1 << (16 - n)
            lengths[at : at + span], symbols[at : at + span] = n, table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return lengths, symbols


class Bits:
    """The entropy-coded bytes of one scan of several images, without stuffing, and a position in bits for each lane."""

    def __init__(self, parts: Sequence[bytes]):
        data = np.frombuffer(b"\xff\xd0".join(parts) + b"\xff\xd0", np.uint8)
        ff = data[:-1] == 255
        restart = np.flatnonzero(ff & (data[1:] >= 0xD0) & (data[1:] <= 0xD7))
        keep = np.ones(len(data), bool)
        keep[restart] = keep[restart + 1] = False
        keep[1:] &= ~(ff & (data[1:] == 0))
        place = np.concatenate(([0], np.cumsum(keep)))
        plain = np.concatenate((data[keep], np.full(8, 255, np.uint8)))
        self.pos = 8 * place[np.concatenate(([0], restart[:-1] + 2))]
        self.end = 8 * place[restart]
        self.bits = np.unpackbits(plain)
        n, wide = len(plain) - 4, plain.astype(np.int64)
        self.word = (wide[:n] << 32) | (wide[1 : n + 1] << 24) | (wide[2 : n + 2] << 16) | (wide[3 : n + 3] << 8) | wide[4 : n + 4]

    def peek(self, pos: np.ndarray, n) -> np.ndarray:
        """The next n bits, up to 32, at each position; past the end there are ones."""
        at = np.minimum(pos >> 3, len(self.word) - 1)
        return (self.word[at] >> (40 - (pos & 7) - n)) & ((1 << n) - 1)

    def symbols(self, which, table) -> np.ndarray:
        lengths, symbols = table
        head = self.peek(self.pos[which], 16)
        n = lengths[head]
        if not n.all():
            raise ValueError("a code is in no table")
        self.pos[which] += n
        return symbols[head]

    def take(self, which, n: np.ndarray) -> np.ndarray:
        out = self.peek(self.pos[which], n)
        self.pos[which] += n
        return out


def _signed(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The value of n magnitude bits: a leading 0 marks a negative one."""
    return np.where((bits >> np.maximum(n - 1, 0)) & 1 == 0, bits - (np.int64(1) << n) + 1, bits)


def _dc(bits: Bits, coef: np.ndarray, which, block, last: np.ndarray, table, low: int) -> None:
    n = bits.symbols(which, table)
    last[which] += np.where(n > 0, _signed(bits.take(which, n), n), 0)
    coef[block, 0] = last[which] << low


def _ac_first(bits: Bits, coef: np.ndarray, which, block, rest: np.ndarray, table, first: int, end: int, low: int) -> None:
    free = rest[which] == 0
    rest[which[~free]] -= 1
    lane, at = which[free], block[free]
    k = np.full(len(lane), first)
    while len(lane):
        symbol = bits.symbols(lane, table)
        run, n = symbol >> 4, symbol & 15
        stop = (n == 0) & (run < 15)
        k = k + run + (n == 0)  # sixteen zeros, or the zeros before a value
        value = np.flatnonzero(n > 0)
        if len(value):
            v, where = lane[value], k[value]
            if where.max() > end:
                raise ValueError("a run leaves its band")
            coef[at[value], where] = _signed(bits.take(v, n[value]), n[value]) << low
            k[value] += 1
        if stop.any():
            s = lane[stop]
            rest[s] = (np.int64(1) << run[stop]) - 1 + bits.take(s, run[stop])
        go = ~stop & (k <= end)
        if not go.all():
            lane, at, k = lane[go], at[go], k[go]


def _correct(bits: Bits, coef: np.ndarray, lane, block, k, end: int, low: int) -> None:
    """Correction bits of all non-zero coefficients from k on, of each lane's block."""
    if not len(lane):
        return
    lowest = int(k.min())
    part = coef[block, lowest : end + 1]
    hit = (part != 0) & (np.arange(lowest, end + 1) >= k[:, None])
    order = np.cumsum(hit, 1)
    bit = bits.bits[np.minimum(bits.pos[lane][:, None] + order - 1, len(bits.bits) - 1)].astype(bool) & hit
    coef[block, lowest : end + 1] = np.where(bit & (np.abs(part) >> low & 1 == 0), part + np.sign(part) * (1 << low), part)
    bits.pos[lane] += order[:, -1]


def _ac_refine(bits: Bits, coef: np.ndarray, which, block, rest: np.ndarray, table, first: int, end: int, low: int) -> None:
    in_run = rest[which] > 0
    _correct(bits, coef, which[in_run], block[in_run], np.full(in_run.sum(), first), end, low)
    rest[which[in_run]] -= 1
    lane, at = which[~in_run], block[~in_run]
    k = np.full(len(lane), first)
    run, new, need = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64), np.ones(len(lane), bool)
    while len(lane):
        ask = np.flatnonzero(need)
        if len(ask):
            symbol = bits.symbols(lane[ask], table)
            r, n = symbol >> 4, symbol & 15
            fresh = ask[n > 0]
            new[ask] = 0
            new[fresh] = np.where(bits.take(lane[fresh], np.ones(len(fresh), np.int64)) == 1, 1, -1) << low if len(fresh) else 0
            run[ask], need[ask] = r, False
            stop = (n == 0) & (r < 15)
            if stop.any():
                s = ask[stop]
                rest[lane[s]] = (np.int64(1) << r[stop]) - 1 + bits.take(lane[s], r[stop])
                _correct(bits, coef, lane[s], at[s], k[s], end, low)
                go = np.ones(len(lane), bool)
                go[s] = False
                lane, at, k, run, new, need = (x[go] for x in (lane, at, k, run, new, need))
                if not len(lane):
                    return
        here = coef[at, k]
        full = here != 0
        f = np.flatnonzero(full)
        if len(f):
            one = bits.take(lane[f], np.ones(len(f), np.int64)) == 1
            coef[at[f], k[f]] = np.where(one & (np.abs(here[f]) >> low & 1 == 0), here[f] + np.sign(here[f]) * (1 << low), here[f])
        done = ~full & (run == 0)
        coef[at[done], k[done]] = new[done]
        need |= done
        run -= ~full & ~done
        k = k + 1
        go = k <= end
        if not go.all():
            lane, at, k, run, new, need = (x[go] for x in (lane, at, k, run, new, need))


def _units(image: Image, scan: Scan, base: list[int]) -> np.ndarray:
    """Blocks of a scan in coding order, a row for each unit."""
    if len(scan.components) == 1:
        c = scan.components[0]
        (rows, cols), (height, width) = image.own_shape(c), image.shape(c)
        if rows == height and cols == width:
            return np.arange(base[c], base[c] + rows * cols).reshape(-1, 1)
        return (base[c] + np.arange(rows)[:, None] * width + np.arange(cols)).reshape(-1, 1)
    columns = []
    for c in scan.components:
        (rows, width), (h, v) = image.shape(c), image.components[c][1:3]
        grid = base[c] + np.arange(rows)[:, None] * width + np.arange(width)
        columns.append(grid.reshape(rows // v, v, width // h, h).transpose(0, 2, 1, 3).reshape(-1, v * h))
    return np.concatenate(columns, 1)


def coefficients(images: Sequence[Image]) -> list[list[np.ndarray]]:
    """For each image and component the coefficients (blocks, 64) in coding order, all scans accumulated."""
    out: list = [None] * len(images)
    groups: dict = {}
    for k, image in enumerate(images):
        groups.setdefault((tuple(image.components), tuple((s.components, s.tables, s.band, s.interval) for s in image.scans)), []).append(k)
    for (components, _), members in groups.items():
        bases, total = [], 0
        for k in members:
            sizes = [int(np.prod(images[k].shape(c))) for c in range(len(components))]
            bases.append([total + sum(sizes[:c]) for c in range(len(sizes))])
            total += sum(sizes)
        coef, laid = np.zeros((total, 64), np.int64), {}
        for s, scan in enumerate(images[members[0]].scans):
            if scan.components not in laid:
                laid[scan.components] = [_units(images[k], scan, base) for k, base in zip(members, bases)]
            units = laid[scan.components]
            bits, step = Bits([images[k].scans[s].data for k in members]), [scan.interval or len(u) for u in units]
            lanes = [-(-len(u) // n) for u, n in zip(units, step)]
            if sum(lanes) != len(bits.pos):
                raise ValueError("a scan has too few or too many restart intervals")
            owner, offset = np.repeat(np.arange(len(members)), lanes), np.concatenate(([0], np.cumsum([len(u) for u in units])))
            index = np.arange(len(owner)) - np.repeat(np.cumsum([0, *lanes[:-1]]), lanes)
            begin = offset[owner] + index * np.array(step)[owner]
            stop = np.minimum(begin + np.array(step)[owner], offset[owner + 1])
            flat, tables = np.concatenate(units), [_lookup(t) for t in scan.tables]
            first, end, high, low = scan.band
            last, rest = [np.zeros(len(owner), np.int64) for _ in scan.components], np.zeros(len(owner), np.int64)
            of = [c for c, x in enumerate(scan.components) for _ in range(components[x][1] * components[x][2] if len(scan.components) > 1 else 1)]
            for unit in range(int((stop - begin).max(initial=0))):
                which = np.flatnonzero(begin + unit < stop)
                for column, c in enumerate(of):
                    block = flat[begin[which] + unit, column]
                    if first == 0 and high == 0:
                        _dc(bits, coef, which, block, last[c], tables[c], low)
                    elif first == 0:
                        coef[block, 0] |= bits.take(which, np.ones(len(which), np.int64)) << low
                    else:
                        (_ac_refine if high else _ac_first)(bits, coef, which, block, rest, tables[0], first, end, low)
            if (bits.pos > bits.end).any():
                raise ValueError("a restart interval is cut short")
        for k, base in zip(members, bases):
            out[k] = [coef[base[c] : base[c] + int(np.prod(images[k].shape(c)))] for c in range(len(components))]
    return out


def inverse(blocks: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Samples (blocks, 8, 8) of coefficients in coding order, 0 to 255; the same on any machine."""
    x = np.zeros(blocks.shape)
    x[:, ZIGZAG] = blocks * quant
    x = x.reshape(-1, 8)
    x = (x @ _BASIS).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8)  # integers below 2**53: exact
    x = (x @ _BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
    return np.clip(np.floor(x / (1 << 2 * SCALE) + 0.5) + 128, 0, 255).astype(np.uint8)


def pictures(images: Sequence[Image], coefs: Sequence[list[np.ndarray]]) -> list[np.ndarray]:
    """For each image (height, width, 3): all components at full resolution, chroma repeated, as RGB; grey is three equal planes."""
    tables = [image.quant[q] for image in images for _, _, _, q in image.components]
    blocks = [x for coef in coefs for x in coef]
    sizes = np.cumsum([len(x) for x in blocks]).tolist()
    if len({t.tobytes() for t in tables}) == 1:
        samples = inverse(np.concatenate(blocks), tables[0])
        samples = [samples[a:b] for a, b in zip([0, *sizes[:-1]], sizes)]
    else:
        samples = list(map(inverse, blocks, tables))
    return [rgb(image, [samples.pop(0) for _ in image.components]) for image in images]


def rgb(image: Image, samples: list[np.ndarray]) -> np.ndarray:
    most_h, most_v = max(x[1] for x in image.components), max(x[2] for x in image.components)
    planes = []
    for c, (_, h, v, _q) in enumerate(image.components):
        rows, cols = image.shape(c)
        planes.append(samples[c].reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8))
        planes[c] = planes[c] if (h, v) == (most_h, most_v) else np.repeat(np.repeat(planes[c], most_v // v, 0), most_h // h, 1)
    planes = [p[: image.height, : image.width] for p in planes]
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2)
    y, b, r = (planes[0].astype(np.int32) << 16) + (1 << 15), planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    out = np.empty((*y.shape, 3), np.uint8)
    # 1.402, 0.344136, 0.714136 and 1.772 times 2**16
    for k, plane in enumerate((y + 91881 * r, y - 22554 * b - 46802 * r, y + 116130 * b)):
        out[:, :, k] = np.clip(plane >> 16, 0, 255)
    return out


def _segment(kind: int, body: bytes) -> bytes:
    return bytes((0xFF, kind)) + (len(body) + 2).to_bytes(2, "big") + body


def _table(place: int, by_length: dict[int, list[int]]) -> bytes:
    return bytes((place, *(len(by_length.get(n, ())) for n in range(1, 17)), *(s for n in range(1, 17) for s in by_length.get(n, ()))))


#: Code 0 is a value of seven bits without zeros before it, code 10 the end of a block, 110 sixteen zeros.
_TABLES = _segment(0xC4, _table(0x00, {1: [7], 2: [0]}) + _table(0x10, {1: [0x07], 2: [0x00], 3: [0xF0]}))
_ENDS = np.unpackbits(np.array([[0b10000000]], np.uint8), 1)[:, :2]


def _entropy(rows: np.ndarray, index: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """For each image its rows of bytes, each a restart interval, with stuffing and restart markers between them.

    rows holds counts[i] rows of image i; index is a row's number in its image.
    """
    n, width = rows.shape
    full = np.empty((n, width + 2), np.uint8)
    full[:, :width], full[:, width], full[:, width + 1] = rows, 255, 0xD0 + index % 8
    stuffed = np.zeros((n, width + 2), bool)
    np.equal(rows, 255, out=stuffed[:, :width])
    extra = np.flatnonzero(stuffed)
    data = np.insert(full.reshape(-1), extra + 1, 0).tobytes() if len(extra) else full.tobytes()
    ends = np.cumsum(counts) * (width + 2)
    ends = (ends + np.searchsorted(extra, ends)).tolist()
    return [data[a : b - 2] for a, b in zip([0, *ends[:-1]], ends)]


_HEADS = {(c, s): _segment(0xDA, bytes((1, c + 1, 0x00, s[0], s[1], s[2] << 4 | s[3]))) for c in range(3) for s in SCRIPT}
_FRONT = _segment(0xDB, bytes((0, *[1] * 64)))
_BACK = _TABLES + _segment(0xDD, (1).to_bytes(2, "big"))


def encode(payloads: Sequence[bytes]) -> list[bytes]:
    """Progressive JPEG files whose coefficients hold the payloads, whose lengths are positive multiples of 64.

    64 bytes are a block. A byte b is a coefficient of eight magnitude bits, which are b itself; its first seven bits are in
    the first scan of its band and the last one in the refining scan. Blocks fill the luma plane, then the chroma planes,
    which have half its resolution; blocks behind the payload hold zero bytes, and a comment tells the number of blocks.
    """
    out, planes, counts = [], [[], [], []], []
    for payload in payloads:
        n = len(payload) // 64
        units = -(-n // 6)
        across = math.isqrt(units - 1) + 1
        units, down = across * -(-units // across), -(-units // across)
        data = payload + bytes(384 * units - len(payload))
        for plane, first, end in zip(planes, (0, 4, 5), (4, 5, 6)):
            plane.append(data[64 * first * units : 64 * end * units])
        counts.append(units)
        frame = bytes((8,)) + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + bytes((3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
        out.append([b"\xff\xd8", _segment(0xFE, str(n).encode()), _FRONT, _segment(0xC2, frame), _BACK])
    for c in range(3):
        rows_of = np.array(counts, np.int64) * (4 if c == 0 else 1)
        own = np.frombuffer(b"".join(planes[c]), np.uint8).reshape(-1, 64)
        index = np.arange(len(own)) - np.repeat(np.cumsum(rows_of) - rows_of, rows_of)
        # a magnitude's last bit: of a negative coefficient (first bit 0) it is inverted, but for DC, which is shifted
        last = (own & 1) ^ (own < 128)
        last[:, 0] = own[:, 0] & 1
        for scan in SCRIPT:
            first, end, high, low = scan
            if not high:
                rows = own[:, first : end + 1] >> 1
            else:
                head = _ENDS.shape[1] if first else 0
                bits = np.ones((len(own), -(-(head + end + 1 - first) // 8) * 8), np.uint8)
                if first:
                    bits[:, :head] = _ENDS
                bits[:, head : head + end + 1 - first] = last[:, first : end + 1]
                rows = np.packbits(bits, axis=1)
            for image, data in zip(out, _entropy(rows, index, rows_of)):
                image += (_HEADS[c, scan], data)
    return [b"".join([*x, b"\xff\xd9"]) for x in out]


def payload_of(image: Image, coef: list[np.ndarray]) -> bytes:
    """The payload that encode() put into the coefficients."""
    values = np.concatenate(coef)[: int(image.comment)]
    low = np.full(64, 255)
    low[0] = 254
    return np.where(values < 0, values + low, values).astype(np.uint8).tobytes()
