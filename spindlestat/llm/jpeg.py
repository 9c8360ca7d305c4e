"""Media columns: baseline JPEG in numpy.

The decoder parses the markers of grey or colour baseline files, decodes their Huffman-coded scans and gives the
quantised coefficients of each component, and from the DC coefficients alone a thumbnail of the luminance, a pixel for
each block. Scans are decoded in step: the restart intervals of all images of a batch that share a layout are lanes of
numpy arrays, and each step decodes one symbol of every lane through a table over the next 16 bits.

The encoder stores bytes losslessly as the format's unit, the 64 quantised coefficients of a block: byte 0 of a block is
its DC coefficient (byte - 128, quantiser 8, so that the thumbnail's pixel is that byte), the others are AC
coefficients that skip 0 (no runs). Every block is a restart interval. The number of bytes stands in a comment segment;
blocks that fill up the image's rectangle hold zeros.

A null payload counts as empty: one block of zeros. Equal payloads give equal files.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

#: Fixed by the format: Huffman code lengths and symbols are (number of codes of each length 1 to 16, symbols).
AC_SIZES = ([0, 3, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0], [5, 4, 7, 6, 3, 8, 2, 1])
DC_SIZES = ([0, 3, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0], [5, 4, 7, 6, 3, 8, 2, 1, 0])
DC_QUANT = 8
NOTE = b"payload="


class JpegError(ValueError):
    pass


def codes_of(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length): codes of one length count up, and double from each length to the next."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = code, length
            code += 1
        at += n
        code <<= 1
    return out


def _byte_codes(values: np.ndarray, table: tuple[list[int], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: the bits of its coefficient (size code, then magnitude), and how many they are (13 at most)."""
    codes = codes_of(*table)
    bits, lengths = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
    for b, v in enumerate(values.tolist()):
        size = abs(v).bit_length()
        code, n = codes[size]
        bits[b], lengths[b] = code << size | (v if v >= 0 else v + (1 << size) - 1), n + size
    return bits, lengths


_B = np.arange(256)
_AC = _byte_codes(np.where(_B > 128, _B - 128, _B - 129), AC_SIZES)
_DC = _byte_codes(_B - 128, DC_SIZES)


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % 64 or (0 if payload else 64))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = (
    _segment(0xDB, bytes([0, DC_QUANT, *[1] * 63])),
    _segment(0xC4, bytes([0x00, *DC_SIZES[0], *DC_SIZES[1]])) + _segment(0xC4, bytes([0x10, *AC_SIZES[0], *AC_SIZES[1]])) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload (whose length is a positive multiple of 64)."""
    n = np.array([len(p) // 64 for p in payloads], np.int64)
    if not len(n):
        return []
    if (n == 0).any() or any(len(p) % 64 for p in payloads):
        raise JpegError("a payload's length must be a positive multiple of 64")
    cols = np.ceil(np.sqrt(n)).astype(np.int64)
    rows = -(-n // cols)
    if cols.max() > 8191:
        raise JpegError("a payload is too large for one image")
    blocks = rows * cols
    p = np.frombuffer(b"".join(x + bytes(64 * int(e)) for x, e in zip(payloads, blocks - n, strict=True)), np.uint8).reshape(-1, 64)
    bits, lengths = _AC[0][p], _AC[1][p]
    bits[:, 0], lengths[:, 0] = _DC[0][p[:, 0]], _DC[1][p[:, 0]]
    for _ in range(2):  # neighbours join, up to 52 bits
        bits, lengths = bits[:, ::2] << lengths[:, 1::2] | bits[:, 1::2], lengths[:, ::2] + lengths[:, 1::2]
    ends = np.cumsum(lengths, axis=1, dtype=np.int64)
    total = ends[:, -1]
    size = (total + 7) // 8
    first = np.cumsum(size) - size
    raw = np.zeros(int(size.sum()) + 8, np.uint8)
    for k in range(bits.shape[1]):
        n_bits = lengths[:, k].astype(np.int64)
        offset = ends[:, k] - n_bits
        octets = (bits[:, k] << (64 - (offset & 7) - n_bits).astype(np.uint64)).astype(">u8").view(np.uint8).reshape(-1, 8)
        at = first + (offset >> 3)
        for j in range(8):
            raw[at + j] |= octets[:, j]
    last = first + size - 1
    raw[last] |= ((1 << (size * 8 - total)) - 1).astype(np.uint8)
    raw = raw[:-8]
    full = raw == 255
    block = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(raw)) + np.cumsum(full) - full + 2 * block
    out = np.zeros(len(raw) + int(full.sum()) + 2 * len(size), np.uint8)
    out[place] = raw
    mark = place[last] + 1 + full[last]
    image_first = np.cumsum(blocks) - blocks
    number = np.arange(len(size)) - np.repeat(image_first, blocks)
    out[mark], out[mark + 1] = 0xFF, 0xD0 + number % 8
    ending = image_first + blocks - 1
    out[mark[ending] + 1] = 0xD9
    stop = mark[ending] + 2
    start = np.concatenate([[0], stop[:-1]])
    scan = out.tobytes()
    files = []
    for x, c, r, a, z in zip(payloads, cols.tolist(), rows.tolist(), start.tolist(), stop.tolist(), strict=True):
        head = b"\xff\xd8" + _segment(0xFE, NOTE + str(len(x)).encode()) + _TABLES[0] + _segment(0xC0, struct.pack(">BHHBBBB", 8, r * 8, c * 8, 1, 1, 0x11, 0))
        files.append(head + _TABLES[1] + scan[a:z])
    return files


@dataclass(frozen=True)
class Layout:
    """What lanes that are decoded together share; parts: for each component its blocks down and across a unit, its DC and its AC table."""

    parts: tuple[tuple[int, int, tuple, tuple], ...]
    interval: int


@dataclass
class Image:
    width: int
    height: int
    layout: Layout
    quant: list[np.ndarray]
    scan: bytes
    units_across: int
    units_down: int
    payload: int | None
    coefficients: list[np.ndarray] | None = None  # for each component: rows, columns of blocks, 64 in zigzag order

    def thumbnail(self) -> np.ndarray:
        """The luminance from DC coefficients: a pixel for each block that the picture covers."""
        v, h = self.layout.parts[0][:2]
        top_v, top_h = max(p[0] for p in self.layout.parts), max(p[1] for p in self.layout.parts)
        down, across = -(-self.height * v // (8 * top_v)), -(-self.width * h // (8 * top_h))
        dc = self.coefficients[0][:down, :across, 0].astype(np.int64) * int(self.quant[0][0])
        return np.clip((dc + 4) // 8 + 128, 0, 255).astype(np.uint8)

    def payload_bytes(self) -> bytes:
        """What encode() stored."""
        c = self.coefficients[0].reshape(-1, 64)
        out = np.where(c > 0, c + 128, c + 129)
        out[:, 0] = c[:, 0] + 128
        flat = out.astype(np.uint8).tobytes()
        return flat[: self.payload] if self.payload is not None else flat


def parse(data: bytes) -> Image:
    """The frame of a baseline file, up to its (single) scan."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at, quant, tables, interval, frame, payload = 2, {}, {}, 0, None, None
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise JpegError(f"no marker at {at}")
        marker, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = tuple(body[1:17]), tuple(body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xFE and body.startswith(NOTE):
            payload = int(body[len(NOTE) :])
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise JpegError(f"{bits} bits a sample")
            frame = height, width, [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise JpegError(f"not baseline: marker {marker:02x}")
        elif marker == 0xDA:
            break
        elif marker == 0xD9:
            raise JpegError("no scan")
    if frame is None or not frame[0] or not frame[1]:
        raise JpegError("no frame")
    height, width, comps = frame
    chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    if set(chosen) != {c[0] for c in comps}:
        raise JpegError("components in several scans")
    parts = [[c[1] & 15, c[1] >> 4, tables[chosen[c[0]] >> 4], tables[0x10 | chosen[c[0]] & 15]] for c in comps]
    if len(parts) == 1:
        parts[0][:2] = 1, 1  # a scan of one component isn't interleaved
    v, h = max(p[0] for p in parts), max(p[1] for p in parts)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    return Image(width, height, Layout(tuple(tuple(p) for p in parts), interval or across * down), [quant[c[2]] for c in comps], data[at:], across, down, payload)


_LUTS: dict[tuple, np.ndarray] = {}


def _lut(table: tuple, dc: bool) -> np.ndarray:
    """For each 16 bits: bits used, run, value and what is special, packed: used | run << 8 | (value + 65536) << 16 | special << 40.

    special: 1 end of block; 2 the magnitude doesn't fit, `value` is its size; 3 no such code.
    """
    key = table, dc
    if key in _LUTS:
        return _LUTS[key]
    lut = np.full(1 << 16, 3 << 40 | 65536 << 16, np.int64)
    for symbol, (code, n) in codes_of(list(table[0]), list(table[1])).items():
        run, size = (0, symbol) if dc else (symbol >> 4, symbol & 15)
        rest = 16 - n
        window = np.arange(1 << rest)
        if size == 0:
            special = 0 if dc or run == 15 else 1
            entry = np.full(1 << rest, n | run << 8 | 65536 << 16 | special << 40, np.int64)
        elif size <= rest:
            m = window >> (rest - size)
            value = np.where(m >> (size - 1), m, m - (1 << size) + 1)
            entry = (n + size) | run << 8 | (value.astype(np.int64) + 65536) << 16
        else:
            entry = np.full(1 << rest, n | run << 8 | (size + 65536) << 16 | 2 << 40, np.int64)
        lut[code << rest : (code + 1) << rest] = entry
    if len(_LUTS) > 64:
        _LUTS.clear()
    _LUTS[key] = lut
    return lut


def decode(files: list[bytes]) -> list[Image]:
    """Images with their coefficients. A file that is damaged, or no baseline JPEG, raises JpegError."""
    try:
        images = [parse(f) for f in files]
        by: dict[Layout, list[Image]] = {}
        for im in images:
            by.setdefault(im.layout, []).append(im)
        for layout, group in by.items():
            _decode_group(layout, group)
    except (IndexError, KeyError, struct.error) as e:  # a scan, table or segment that ends too early
        raise JpegError(f"damaged file: {e!r}") from e
    return images


def _decode_group(layout: Layout, group: list[Image]) -> None:
    buf = np.frombuffer(b"".join(im.scan + b"\xff\xd9" for im in group), np.uint8)
    # cut at markers, of which one ends each image at the latest; drop the zeros after 255
    full = np.flatnonzero(buf[:-1] == 255)
    follows = buf[full + 1]
    keep = np.ones(len(buf), bool)
    keep[full[follows == 0] + 1] = False
    marks = full[follows != 0]
    keep[marks] = keep[marks + 1] = False
    before = np.cumsum(keep) - keep
    clean = np.concatenate([buf[keep], np.zeros(8, np.uint8)]).astype(np.int64)
    windows = clean[:-2] << 16 | clean[1:-1] << 8 | clean[2:]
    image_end = np.cumsum([len(im.scan) + 2 for im in group])
    image_start = image_end - [len(im.scan) + 2 for im in group]
    units = np.array([im.units_across * im.units_down for im in group])
    lanes = -(-units // layout.interval)
    of = np.repeat(np.arange(len(group)), lanes)
    number = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    ordinary = np.flatnonzero((buf[marks + 1] & 0xF8) == 0xD0)
    restarts = marks[ordinary]
    first_restart = np.searchsorted(restarts, image_start)
    if (np.searchsorted(restarts, image_end) - first_restart < lanes - 1).any():
        raise JpegError("restart markers are missing")
    begin = np.where(number == 0, image_start[of], 0)
    later = number > 0
    begin[later] = restarts[first_restart[of[later]] + number[later] - 1] + 2
    pos = before[begin] * 8
    todo = np.minimum(layout.interval, units[of] - number * layout.interval)
    unit_base = (np.cumsum(units) - units)[of] + number * layout.interval
    store = [np.zeros((int(units.sum()) * v * h, 64), np.int16) for v, h, *_ in layout.parts]
    pred = [np.zeros(len(of), np.int64) for _ in layout.parts]

    def symbol(lut: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = lut[(windows[pos >> 3] >> (8 - (pos & 7))) & 0xFFFF]
        special = e >> 40
        used, run, value = e & 255, (e >> 8) & 255, ((e >> 16) & 0xFFFFFF) - 65536
        if special.any():
            if (special == 3).any():
                raise JpegError("a code that the table lacks")
            for i in np.flatnonzero(special == 2):
                p, size = int(pos[i] + used[i]), int(value[i])
                m = int(windows[p >> 3] >> (24 - (p & 7) - size)) & ((1 << size) - 1)
                value[i], used[i] = m if m >> (size - 1) else m - (1 << size) + 1, used[i] + size
            run = np.where(special == 1, 64, run)
        return used, run, value

    for unit in range(int(todo.max(initial=0))):
        on = np.flatnonzero(todo > unit)
        for c, (v, h, dc_table, ac_table) in enumerate(layout.parts):
            dc_lut, ac_lut, flat = _lut(dc_table, True), _lut(ac_table, False), store[c].reshape(-1)
            for sub in range(v * h):
                base = ((unit_base[on] + unit) * (v * h) + sub) * 64
                p = pos[on]
                used, _, value = symbol(dc_lut, p)
                pred[c][on] += value
                flat[base] = pred[c][on]
                p += used
                alive, k = np.arange(len(on)), np.zeros(len(on), np.int64)
                q = p.copy()
                while len(alive):
                    used, run, value = symbol(ac_lut, q)
                    k += run + 1
                    q += used
                    inside = k < 64
                    if inside.all():
                        flat[base + k] = value
                    else:
                        flat[(base + k)[inside]] = value[inside]
                    done = k >= 63
                    if done.any():
                        p[alive[done]] = q[done]
                        more = ~done
                        alive, k, q, base = alive[more], k[more], q[more], base[more]
                pos[on] = p
    at = 0
    for im, n in zip(group, units.tolist(), strict=True):
        im.coefficients = []
        for (v, h, *_), s in zip(layout.parts, store, strict=True):
            x = s[at * v * h : (at + n) * v * h].reshape(im.units_down, im.units_across, v, h, 64)
            im.coefficients.append(x.transpose(0, 2, 1, 3, 4).reshape(im.units_down * v, im.units_across * h, 64))
        at += n


def thumbnail_hash(thumb: np.ndarray) -> str:
    """16 hex digits: of 8 x 8 samples of the thumbnail, whether each is above their mean."""
    h, w = thumb.shape
    small = thumb[(np.arange(8) * h) // 8][:, (np.arange(8) * w) // 8].astype(np.int64)
    return np.packbits(small * 64 > small.sum()).tobytes().hex()
