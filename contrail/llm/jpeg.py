"""Media columns: baseline JPEG read in numpy, with DC-only luminance thumbnails, dimensions and thumbnail hashes.

``decode`` parses the markers (SOI, APPn, COM, DQT, SOF0, DHT, DRI, SOS, RSTn, EOI), Huffman-decodes the scans and returns
the quantised coefficients of every component. All segments between restart markers are decoded in lockstep, one code of
every segment at each step, so files with restart markers (and many files at once) decode at numpy speed; files without
them decode by the same steps in a single lane. The thumbnail is one pixel for each 8 x 8 block of the first component:
its dequantised DC coefficient over 8, plus 128.

``store`` keeps any bytes losslessly in such a file. The format's unit is the quantised coefficient: 64 bytes become the
64 coefficients of one block of a grey image, byte b as b - 127 from 128 on and as b - 128 below (never 0, so there are no
runs), with all quantisers 1 and a restart marker after every block. The rectangle of blocks is filled up with blocks of
byte 0 and a COM segment holds the payload's length.

Defined cases: null and empty texts store 64 zero bytes; payloads are padded with zero bytes to a positive multiple of 64;
files that are not baseline JPEG raise ValueError from ``decode`` and give null features from ``features``; rows are
handled one by one, so repeated rows are alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import slices

_WORK = 4 << 20  # bytes of payload handled at once


def zigzag() -> np.ndarray:
    """Natural place of each coefficient in zigzag order."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


# ---------------------------------------------------------------- storing

#: Canonical Huffman codes of the store: four bits of length for each of the sizes 1 to 8 (run 0), five more at six bits.
_SIZES = list(range(1, 9))


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical codes (code, length) by symbol."""
    code, out, at = 0, {}, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - at
        out[symbol], at = (code, n), n
        code += 1
    return out


#: Code lengths by coefficient size: text is mostly sizes 4 to 7.
_LENGTHS = {5: 1, 7: 2, 4: 3, 6: 4, 3: 5, 8: 6, 2: 7, 1: 8}


def _value_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: Huffman code with amplitude bits, and their number."""
    codes = _codes(_LENGTHS)
    bits, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for b in range(256):
        v = b - 127 if b >= 128 else b - 128
        n = abs(v).bit_length()
        code, m = codes[n]
        bits[b] = (code << n) | (v if v > 0 else v + (1 << n) - 1)
        length[b] = m + n
    return bits, length


_BITS, _LENGTH = _value_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(blocks: int, n_payload: int) -> tuple[bytes, int]:
    """Everything before the scan's data, and the number of blocks of the rectangle."""
    w = max(1, int(np.ceil(np.sqrt(blocks))))
    h = -(-blocks // w)
    if w > 8191:
        raise ValueError("over 4 GB in one image")
    by_length = [[s for s, n in sorted(_LENGTHS.items()) if n == k] for k in range(1, 17)]
    table = bytes(map(len, by_length)) + bytes(s for row in by_length for s in row)
    out = b"\xff\xd8" + _segment(0xFE, b"bytes=%d" % n_payload) + _segment(0xDB, b"\0" + b"\1" * 64)
    out += _segment(0xC0, struct.pack(">BHHBBBB", 8, h * 8, w * 8, 1, 1, 0x11, 0)) + _segment(0xC4, b"\0" + table) + _segment(0xC4, b"\x10" + table)
    return out + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])), w * h


def padded(data: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def _scans(payload: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of blocks of 64 bytes (a restart marker before each block that is not ``first`` of its image),
    and the number of bytes of each block."""
    length = _LENGTH[payload].reshape(-1, 64)
    total = length.sum(axis=1)
    n_bytes = (total + 7) >> 3
    start = np.concatenate([[0], np.cumsum(n_bytes)[:-1]]) * 8
    at = (start[:, None] + np.cumsum(length, axis=1) - length).ravel()
    word, shift = at >> 5, 64 - length.ravel() - (at & 31)
    value = _BITS[payload] << shift.astype(np.uint64)
    n_words = int(n_bytes.sum() * 8 // 32 + 3)
    # bits of different codes never overlap, so sums are unions; they stay below 2^53
    sums = np.bincount(word, weights=(value >> np.uint64(32)).astype(float), minlength=n_words)
    sums[1:] += np.bincount(word, weights=(value & np.uint64(0xFFFFFFFF)).astype(float), minlength=n_words)[: n_words - 1]
    data = sums.astype(np.uint64).astype(">u4").view(np.uint8)[: int(n_bytes.sum())].copy()
    ends = np.cumsum(n_bytes) - 1
    data[ends] |= ((1 << (n_bytes * 8 - total)) - 1).astype(np.uint8)  # a block's last byte is filled up with ones
    stuffed = data == 0xFF
    marker = np.zeros(len(data), np.int64)
    marker[ends - n_bytes + 1] = 2 * ~first
    place = np.arange(len(data)) + np.concatenate([[0], np.cumsum(stuffed)[:-1]]) + np.cumsum(marker)
    out = np.zeros(len(data) + int(stuffed.sum()) + int(marker.sum()), np.uint8)
    out[place] = data
    return out, place[ends - n_bytes + 1] - 2 * ~first


def store(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload (whose length is a positive multiple of 64)."""
    heads = [_header(len(p) // 64, len(p)) for p in payloads]
    full = b"".join(p + b"\0" * (64 * n - len(p)) for p, (_, n) in zip(payloads, heads, strict=True))
    counts = np.array([n for _, n in heads])
    ends = np.cumsum(counts)
    index = np.arange(int(ends[-1])) - np.repeat(ends - counts, counts)  # of a block in its image
    data, at = _scans(np.frombuffer(full, np.uint8), index == 0)
    inner = at[index > 0]
    data[inner], data[inner + 1] = 0xFF, 0xD0 + (index[index > 0] - 1) % 8
    cuts = np.append(at[ends - counts], len(data))
    raw = data.tobytes()
    return [head + raw[cuts[i] : cuts[i + 1]] + b"\xff\xd9" for i, (head, _) in enumerate(heads)]


# ---------------------------------------------------------------- reading


@dataclass
class Component:
    """A component's sampling factors, tables and block grid (padded to whole MCUs)."""

    ident: int
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0
    wide: int = 0
    high: int = 0
    coefficients: np.ndarray | None = None


@dataclass
class Image:
    """A parsed file."""

    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits ahead: symbol * 32 + code length; 0 where no code fits."""
    table, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            table[code << (16 - n) : (code + 1) << (16 - n)] = symbols[k] * 32 + n
            code, k = code + 1, k + 1
        code <<= 1
    return table


@dataclass
class Scan:
    """A scan's components, tables and the span of its data in the file."""

    components: list[Component]
    tables: dict[tuple[int, int], np.ndarray]
    interval: int
    start: int
    stop: int


def parse(data: bytes) -> tuple[Image, list[Scan]]:
    """Markers of one file. Scans are located, not decoded."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI")
    image, scans, tables, interval, at = Image(), [], {}, 0, 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        n = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide, t = body[k] >> 4, body[k] & 15
                image.quants[t] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.int64)
                k += 129 if wide else 65
        elif marker == 0xC0:
            depth, image.height, image.width, c = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("not 8 bits")
            image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(c)]
            hmax, vmax = max(x.h for x in image.components), max(x.v for x in image.components)
            for x in image.components:
                x.wide, x.high = -(-image.width // (8 * hmax)) * x.h, -(-image.height // (8 * vmax)) * x.v
                x.coefficients = np.zeros((x.wide * x.high, 64), np.int16)
        elif marker in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                total = sum(body[k + 1 : k + 17])
                tables[body[k] >> 4, body[k] & 15] = _table(bytes(body[k + 1 : k + 17]), bytes(body[k + 17 : k + 17 + total]))
                k += 17 + total
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            own = []
            for i in range(body[0]):
                c = next(x for x in image.components if x.ident == body[1 + 2 * i])
                c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                own.append(c)
            stop = at
            while True:  # the scan ends at a marker that is neither a stuffed byte nor a restart
                stop = data.find(b"\xff", stop)
                if stop < 0 or stop + 1 >= len(data):
                    stop = len(data)
                    break
                if data[stop + 1] != 0 and not 0xD0 <= data[stop + 1] <= 0xD7:
                    break
                if data[stop + 1] == 0 or interval != 1 or len(image.components) != 1:
                    stop += 2
                else:  # many restarts: the end is the last marker of the file
                    stop = data.rfind(b"\xff\xd9")
                    break
            scans.append(Scan(own, dict(tables), interval, at, stop))
            at = stop
    return image, scans


_TABLES: dict[tuple[bytes, bytes], np.ndarray] = {}


def _table(counts: bytes, symbols: bytes) -> np.ndarray:
    """Lookup tables of the last few Huffman tables are kept: the files of a column mostly share them."""
    if (counts, symbols) not in _TABLES:
        if len(_TABLES) > 64:
            _TABLES.clear()
        _TABLES[counts, symbols] = _lookup(counts, symbols)
    return _TABLES[counts, symbols]


def _places(image: Image, scan: Scan) -> list[tuple[Component, np.ndarray]]:
    """For each block of an MCU, its component and the block's place in the grid for every MCU of the scan."""
    if len(scan.components) == 1:
        c = scan.components[0]
        hmax, vmax = max(x.h for x in image.components), max(x.v for x in image.components)
        wide, high = -(-(-(-image.width * c.h // hmax)) // 8), -(-(-(-image.height * c.v // vmax)) // 8)
        y, x = np.divmod(np.arange(wide * high), wide)
        return [(c, y * c.wide + x)]
    first = scan.components[0]
    per_row, rows = first.wide // first.h, first.high // first.v
    y, x = np.divmod(np.arange(per_row * rows), per_row)
    return [(c, (y * c.v + j) * c.wide + x * c.h + i) for c in scan.components for j in range(c.v) for i in range(c.h)]


def _entropy(data: bytes, scans: list[tuple[Image, Scan]]) -> None:
    """Decode scans of equal layout (same tables, same blocks in an MCU) together; ``Scan`` spans point into ``data``."""
    lanes = []  # (image number, first MCU, number of MCUs)
    raw = np.frombuffer(data + b"\xff" * 16, np.uint8)
    ff = np.flatnonzero(raw[:-17] == 0xFF)
    after = raw[ff + 1]
    keep = np.ones(len(raw), bool)
    keep[ff[after == 0] + 1] = False
    restarts = ff[(after >= 0xD0) & (after <= 0xD7)]
    where = np.cumsum(keep) - 1
    starts, plans = [], []
    for k, (image, scan) in enumerate(scans):
        places = _places(image, scan)
        plans.append(places)
        n_mcu = len(places[0][1])
        step = scan.interval or n_mcu
        own = restarts[np.searchsorted(restarts, scan.start) : np.searchsorted(restarts, scan.stop)]
        begins = np.concatenate([[scan.start], own + 2])[: -(-n_mcu // step)]
        starts.append(where[begins])
        first = np.arange(len(begins)) * step
        lanes.append(np.stack([np.full(len(begins), k), first, np.minimum(step, n_mcu - first)]))
    raw = raw[keep].astype(np.uint64)
    window = np.zeros(len(raw) - 8, np.uint64)
    for i in range(8):
        window = (window << np.uint64(8)) | raw[i : len(raw) - 8 + i]
    lane, at = np.concatenate(lanes, axis=1), np.concatenate(starts).astype(np.int64) * 8
    n_lanes = lane.shape[1]
    scan, layout = scans[0][1], plans[0]
    base, size = [], []  # all coefficients of all files in one array while decoding
    total = 0
    for image, _ in scans:
        for c in image.components:
            base.append(total)
            size.append(c.wide * c.high)
            total += size[-1]
    coef = np.zeros((total, 64), np.int16)
    column = [[next(i for i, y in enumerate(image.components) if y is c) for c, _ in places] for (image, _), places in zip(scans, plans, strict=True)][0]
    n_comp = len(scans[0][0].components)
    bases = np.array(base).reshape(len(scans), n_comp)
    offsets = np.concatenate([[0], np.cumsum([len(p[0][1]) for p in plans])])
    targets = [np.concatenate([p[j][1] for p in plans]) for j in range(len(layout))]
    pred = {id(c): np.zeros(n_lanes, np.int64) for c, _ in layout}
    most = int(lane[2].max(initial=0))
    limit = len(window) * 8 - 1
    zero, top = np.uint64(0), np.uint64(48)

    def step(table: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, its amplitude and the place after both."""
        pos = np.minimum(pos, limit)
        w = window[pos >> 3] << (pos & 7).astype(np.uint64)
        hit = table[(w >> top).astype(np.int64)]
        n = hit & 31
        if not n.all():
            raise ValueError("bad Huffman code")
        symbol = hit >> 5
        bits = symbol & 15
        w = w << n.astype(np.uint64)
        amp = np.where(bits > 0, w >> (64 - np.maximum(bits, 1)).astype(np.uint64), zero).astype(np.int64)
        amp = np.where(amp < (1 << np.maximum(bits, 1)) >> 1, amp - (1 << bits) + 1, amp)
        return symbol, amp, pos + n + bits

    for mcu in range(most):
        live = np.flatnonzero(lane[2] > mcu)
        for j, (c, _) in enumerate(layout):
            dc, ac = scan.tables[0, c.dc], scan.tables[1, c.ac]
            block = bases[lane[0, live], column[j]] + targets[j][offsets[lane[0, live]] + lane[1, live] + mcu]
            symbol, amp, pos = step(dc, at[live])
            pred[id(c)][live] += np.where(symbol > 0, amp, 0)
            coef[block, 0] = pred[id(c)][live]
            k, on, own = np.ones(len(live), np.int64), np.arange(len(live)), pos
            while len(on):
                symbol, amp, nxt = step(ac, own)
                run = symbol >> 4
                end = symbol == 0
                spot = np.where(end, 64, k + run)
                put = (symbol & 15) > 0
                if (put & (spot > 63)).any():
                    raise ValueError("too many coefficients")
                if put.all():
                    coef[block[on], spot] = amp
                else:
                    coef[block[on[put]], spot[put]] = amp[put]
                k = spot + 1
                more = k < 64
                if more.all():
                    own = nxt
                else:
                    pos[on[~more]] = nxt[~more]
                    on, k, own = on[more], k[more], nxt[more]
            at[live] = pos
    i = 0
    for image, _ in scans:
        for c in image.components:
            part = coef[base[i] : base[i] + size[i]]
            c.coefficients = part if len(scans) > 1 or not c.coefficients.any() else np.where(part != 0, part, c.coefficients)
            i += 1


def decode(files: list[bytes]) -> list[Image]:
    """Images with coefficients in zigzag order. Files with one scan of the same layout are decoded together."""
    out, groups = [], {}
    offset, parts = 0, []
    for data in files:
        image, scans = parse(data)
        out.append(image)
        parts.append(data)
        for s in scans:
            s.start, s.stop = s.start + offset, s.stop + offset
            key = (tuple((c.h, c.v, c.dc, c.ac) for c in s.components), len(image.components), tuple(sorted((k, id(t)) for k, t in s.tables.items())))
            groups.setdefault(key if len(scans) == 1 else (id(s),), []).append((image, s))
        offset += len(data)
    whole = b"".join(parts)
    for group in groups.values():
        _entropy(whole, group)
    return out


def thumbnail(image: Image) -> np.ndarray:
    """DC-only luminance, one pixel for each block, 0 to 255."""
    c = image.components[0]
    dc = c.coefficients[:, 0].astype(np.int64) * image.quants[c.quant][0]
    return np.clip(np.round(dc / 8 + 128), 0, 255).astype(np.uint8).reshape(c.high, c.wide)


def _shrunk(pixels: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Means over a grid of high x wide cells (pixels repeat where there are fewer)."""
    y, x = (np.arange(n + 1) * s / n for n, s in ((high, pixels.shape[0]), (wide, pixels.shape[1])))
    sums = np.pad(pixels.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    a, b = np.floor(y[:-1]).astype(int), np.maximum(np.ceil(y[1:]), np.floor(y[:-1]) + 1).astype(int)
    c, d = np.floor(x[:-1]).astype(int), np.maximum(np.ceil(x[1:]), np.floor(x[:-1]) + 1).astype(int)
    area = (b - a)[:, None] * (d - c)[None, :]
    return (sums[np.ix_(b, d)] - sums[np.ix_(a, d)] - sums[np.ix_(b, c)] + sums[np.ix_(a, c)]) / area


def thumbnail_hashes(pixels: np.ndarray) -> tuple[str, str]:
    """Average hash and difference hash, 16 hexadecimal digits each."""
    mean, step = _shrunk(pixels, 8, 8), _shrunk(pixels, 8, 9)
    bits = (mean > mean.mean()).ravel(), (step[:, 1:] > step[:, :-1]).ravel()
    return tuple(np.packbits(b).tobytes().hex() for b in bits)


def payload_of(image: Image) -> bytes:
    """The bytes that ``store`` has put in."""
    v = image.components[0].coefficients.astype(np.int16).ravel()
    n = int(image.comment.partition(b"bytes=")[2] or v.size)
    return np.where(v > 0, v + 127, v + 128).astype(np.uint8).tobytes()[:n]


def _works(sizes: list[int]) -> Iterator[slice]:
    """Consecutive rows of about ``_WORK`` bytes."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= _WORK:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def store_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, media``: every whole text in UTF-8, padded, stored as a JPEG file."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            raw = [(t or "").encode("utf-8") for t in b["t"]]
            for s in _works([len(x) for x in raw]):
                yield pd.DataFrame({id_col: b["k"].iloc[s], "n_bytes": [len(x) for x in raw[s]], "media": store([padded(x) for x in raw[s]])})

    return docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).mapInPandas(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", payload: bool = True) -> DataFrame:
    """``id_col, width, height, average_hash, difference_hash`` and digests of the file and, with ``payload``, of the bytes
    read back from it: ``media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32``. A file that can't be read
    has nulls."""
    kind = media.schema[id_col].dataType.simpleString()
    cols = "width int, height int, average_hash string, difference_hash string, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long"
    names = [c.split()[0] for c in cols.split(", ")]

    def row(data: bytes | None, image: Image | None) -> tuple:
        own = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
        if image is None or not image.components:
            return (None, None, None, None, *own, None, None, None)
        shape = (image.width, image.height, *thumbnail_hashes(thumbnail(image)))
        if not payload:
            return (*shape, *own, None, None, None)
        bytes_ = payload_of(image)
        return (*shape, *own, len(bytes_), hashlib.sha256(bytes_).hexdigest(), zlib.crc32(bytes_[-64:]))

    def images(files: list) -> list:
        try:
            return decode(files)
        except (ValueError, TypeError, KeyError, IndexError, StopIteration, struct.error):
            if len(files) == 1:
                return [None]
            return [x for f in files for x in images([f])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            files = list(b["m"])
            for s in _works([len(x) if x is not None else 0 for x in files]):
                rows = [row(d, i) for d, i in zip(files[s], images(files[s]), strict=True)]
                out = pd.DataFrame(rows, columns=names, dtype=object)
                out.insert(0, id_col, b["k"].iloc[s].to_numpy())
                yield out

    return media.select(F.col(id_col).alias("k"), F.col(media_col).alias("m")).mapInPandas(run, f"`{id_col}` {kind}, {cols}")
