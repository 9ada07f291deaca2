"""Baseline JPEG as a column format: a lossless payload writer, a decoder, and features from DC-only thumbnails.

Reading: markers are parsed (SOI, APPn, DQT, SOF0, DHT, SOS, DRI, RSTn, EOI), the scans are Huffman-decoded, and the DC
coefficients of the luminance component give a thumbnail of one pixel for each 8x8 block; AC coefficients are decoded to
keep the bit position and dropped. Restart intervals are independent of each other, so numpy decodes all intervals of all
images of a batch in step: one vector operation handles the next symbol of every interval. An image without restart markers
is one interval, decoded the same way.

Writing: a payload byte b is a block whose quantised DC coefficient is b - 128 under a quantiser of 8, so its 64 samples are
all b, and the DC-only thumbnail is the payload itself. Rows of `WIDTH` blocks (wider for payloads over 8,191 rows) are one
restart interval each, so that long payloads decode in parallel. A block costs its DC difference and one bit for "no AC".
A payload over `MOST_BYTES` is stored as several images, one after the other, and read back as one.

Features: dimensions, an average hash and a difference hash of the thumbnail reduced to 8x8 and 9x8 cells, and its mean; those
of several images are listed with a bar between.

Defined cases: null text is the empty text, stored as 64 zero bytes; empty texts, texts of any length, repeated rows and null
doc_ids are rows like any other; an empty table gives no rows; extra columns pass by unread. Progressive, arithmetic-coded
or truncated files raise ValueError in `decode`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import slices

WIDTH = 64
MOST_BLOCKS = 8191  # of a side: 65,528 samples
#: Payload bytes of one image: longer payloads are stored as several images, one after the other, so that memory for coding and
#: decoding is bounded whatever a text's length.
MOST_BYTES = 1 << 22

#: DC table of the writer: number of codes by length (1 to 16) and the categories 0 to 9 in order of code. Differences of
#: text bytes are mostly of 4 to 6 bits, so these come first.
DC_LENGTHS = (0, 1, 3, 3, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
DC_VALUES = (5, 4, 6, 3, 7, 2, 0, 1, 8, 9)
#: AC table of the writer: end of block in one bit.
AC_LENGTHS = (1,) + (0,) * 15
AC_VALUES = (0,)


def codes_of(lengths: tuple[int, ...], values: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, number of bits), canonical order."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out[values[at]] = (code, bits)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup_of(lengths: tuple[int, ...], values: tuple[int, ...]) -> np.ndarray:
    """For each 16-bit prefix: number of code bits << 8 | symbol; 0 where no code begins so."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, (code, bits) in codes_of(lengths, values).items():
        table[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | symbol
    return table


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def width_of(n: int) -> int:
    """Blocks of a row of an image of n bytes; `MOST_BYTES` take 1,024."""
    w = WIDTH
    while -(-n // w) > MOST_BLOCKS:
        w *= 2
    return w


def padded(raw: bytes) -> bytes:
    """`raw` with zero bytes up to a positive multiple of 64 (and of the width that its length asks for)."""
    size = max(64, -(-len(raw) // 64) * 64)
    return raw + bytes(size - len(raw))


_DC_CODE = np.zeros((10, 2), np.uint64)
for _symbol, _pair in codes_of(DC_LENGTHS, DC_VALUES).items():
    _DC_CODE[_symbol] = _pair
_CATEGORY = np.array([abs(d).bit_length() for d in range(-511, 512)], np.int64)


def _head(width: int, height: int) -> bytes:
    quant = bytes([0]) + bytes([8] + [1] * 63)
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    out = b"\xff\xd8" + _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00") + _segment(0xDB, quant) + _segment(0xC0, frame)
    out += _segment(0xC4, bytes([0x00, *DC_LENGTHS, *DC_VALUES])) + _segment(0xC4, bytes([0x10, *AC_LENGTHS, *AC_VALUES]))
    return out + _segment(0xDD, (width // 8).to_bytes(2, "big")) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file of each payload (length a positive multiple of 64). All payloads are coded by the same vector operations."""
    wide = [width_of(len(p)) for p in payloads]
    rows = [-(-len(p) // w) for p, w in zip(payloads, wide)]
    filled = b"".join(p if len(p) == w * r else p + bytes(w * r - len(p)) for p, w, r in zip(payloads, wide, rows))
    value = np.frombuffer(filled, np.uint8).astype(np.int64) - 128
    row_size = np.repeat(wide, rows)
    row_end = np.cumsum(row_size)
    row_start = row_end - row_size
    diff = np.diff(value, prepend=0)
    diff[row_start] = value[row_start]
    category = _CATEGORY[diff + 511]
    extra = np.where(diff < 0, diff + (1 << category) - 1, diff).astype(np.uint64)
    code, bits = _DC_CODE[category, 0], _DC_CODE[category, 1].astype(np.int64)
    word = (code << category.astype(np.uint64) | extra) << np.uint64(1)  # and the end of block, a zero bit
    bits = bits + category + 1
    # each row is padded with one bits to whole bytes
    row_bits = np.add.reduceat(bits, row_start)
    fill = -row_bits % 8
    row_bytes = (row_bits + fill) // 8
    first_byte = np.cumsum(row_bytes) - row_bytes
    ends = np.cumsum(bits)
    start = ends - bits
    start += np.repeat(first_byte * 8 - start[row_start], row_size)
    total = int(row_bytes.sum())
    # a block has at most 24 bits: it touches four bytes from its first one
    shifted = word << (np.uint64(32) - bits.astype(np.uint64) - (start & 7).astype(np.uint64))
    at = start >> 3
    out = np.zeros(total + 4, np.int64)
    for k in range(4):  # blocks share bytes but not bits, so sums are unions
        out += np.bincount(at + k, ((shifted >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64), total + 4).astype(np.int64)
    out = out[:total].astype(np.uint8)
    out[first_byte + row_bytes - 1] |= ((1 << fill) - 1).astype(np.uint8)
    # byte stuffing, and a restart marker after each row but an image's last
    data = out.tobytes()
    files, r = [], 0
    cuts = np.append(first_byte, total).tolist()
    for w, n in zip(wide, rows):
        parts = [_head(8 * w, 8 * n)]
        for k in range(n):
            parts.append(data[cuts[r + k] : cuts[r + k + 1]].replace(b"\xff", b"\xff\x00"))
            parts.append(b"\xff" + bytes([0xD0 + k % 8]) if k < n - 1 else b"\xff\xd9")
        r += n
        files.append(b"".join(parts))
    return files


def store(payloads: list[bytes], most: int = MOST_BYTES) -> list[bytes]:
    """The stored form of each payload: its image, or its images one after the other. `most`: a multiple of 64."""
    out: list[list[bytes]] = [[] for _ in payloads]
    held, size = [], 0  # (payload, piece) to code together

    def code() -> None:
        for (i, _), file in zip(held, encode_payloads([p for _, p in held])):
            out[i].append(file)

    for i, payload in enumerate(payloads):
        for at in range(0, len(payload), most):
            piece = payload[at : at + most]
            if held and size + len(piece) > most:
                code()
                held, size = [], 0
            held.append((i, piece))
            size += len(piece)
    if held:
        code()
    return [b"".join(x) for x in out]


def images_of(stored: bytes) -> list[bytes]:
    """The images of a stored form. In coded data a byte 255 is followed by 0 or a restart number, and no table of the writer
    holds one, so an end mark before a start mark is where two images meet."""
    parts = stored.split(b"\xff\xd9\xff\xd8")
    return [(b"\xff\xd8" if k else b"") + p + (b"\xff\xd9" if k < len(parts) - 1 else b"") for k, p in enumerate(parts)]


def retrieve(stored: list[bytes], sizes: list[int], most: int = MOST_BYTES) -> Iterator[tuple[bytes, list[tuple[int, int, np.ndarray]]]]:
    """(payload, its images as width, height and thumbnail) of each stored form, decoded some `most` bytes at a time."""
    files = [images_of(s) for s in stored]
    flat = [(i, f) for i, fs in enumerate(files) for f in fs]
    images: list[list] = [[] for _ in stored]
    at, done = 0, 0
    while at < len(flat):
        to, size = at + 1, len(flat[at][1])
        while to < len(flat) and size + len(flat[to][1]) <= most:
            size += len(flat[to][1])
            to += 1
        for (i, _), image in zip(flat[at:to], thumbnails([f for _, f in flat[at:to]])):
            images[i].append(image)
        at = to
        while done < len(stored) and len(images[done]) == len(files[done]):
            raw = b"".join(read_payload(t, most) for _, _, t in images[done])
            yield raw[: sizes[done]], images[done]
            images[done] = []
            done += 1


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quant: dict[int, int] = field(default_factory=dict)  # the DC step
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component index, DC table, AC table
    tables: dict[tuple[int, int], tuple[tuple[int, ...], tuple[int, ...]]] = field(default_factory=dict)
    restart: int = 0
    data: bytes = b""


def parse(file: bytes) -> Image:
    """Markers and tables of a baseline file with one scan of all components, or of luminance first."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    image, at = Image(), 2
    while True:
        if at + 4 > len(file) or file[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = file[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        size = int.from_bytes(file[at + 2 : at + 4], "big")
        body = file[at + 4 : at + 2 + size]
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, name = body[k] >> 4, body[k] & 15
                image.quant[name] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                k += 1 + 64 * (1 + wide)
        elif marker in (0xC0, 0xC1) and body[0] == 8:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline file")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                lengths = tuple(body[k + 1 : k + 17])
                n = sum(lengths)
                image.tables[body[k] >> 4, body[k] & 15] = lengths, tuple(body[k + 17 : k + 17 + n])
                k += 17 + n
        elif marker == 0xDD:
            image.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            ids = [c[0] for c in image.components]
            image.scan = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            image.data = file[at + 2 + size :]
            return image
        elif marker == 0xD9:
            raise ValueError("no scan")
        at += 2 + size


def _intervals(data: bytes) -> list[bytes]:
    """Entropy-coded intervals of a scan without stuffing, up to the marker that ends it."""
    raw = np.frombuffer(data, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    kind = raw[ff + 1]
    stop = ff[(kind != 0) & ((kind < 0xD0) | (kind > 0xD7)) & (kind != 0xFF)]
    if not len(stop):
        raise ValueError("the file is cut off")
    end = int(stop[0])
    marks = ff[(kind >= 0xD0) & (kind <= 0xD7) & (ff < end)].tolist()
    cuts = [-2, *marks, end]
    return [data[a + 2 : b].replace(b"\xff\x00", b"\xff") for a, b in zip(cuts, cuts[1:])]


def thumbnails(files: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, DC-only luminance thumbnail as uint8) of each file; files of one layout are decoded together."""
    images = [parse(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for i, m in enumerate(images):
        groups.setdefault((tuple(m.components), tuple(m.scan), tuple(sorted(m.tables.items())), m.restart, m.width if not m.restart else -(-m.width // 8)), []).append(i)
    out: list = [None] * len(files)
    for members in groups.values():
        for i, thumb in zip(members, _decode([images[i] for i in members])):
            out[i] = (images[i].width, images[i].height, thumb)
    return out


def _decode(images: list[Image]) -> list[np.ndarray]:
    first = images[0]
    h_max, v_max = max(c[1] for c in first.components), max(c[2] for c in first.components)
    alone = len(first.scan) == 1  # a scan of one component is not interleaved: a unit is one block
    wanted = first.scan.index(next(s for s in first.scan if s[0] == 0))
    parts, units, owner = [], [], []
    shapes = []
    for i, m in enumerate(images):
        _, h, v, _ = m.components[0]
        if alone:
            across, down = -(-(-(-m.width * h // h_max)) // 8), -(-(-(-m.height * v // v_max)) // 8)
        else:
            across, down = -(-m.width // (8 * h_max)), -(-m.height // (8 * v_max))
        own = _intervals(m.data)
        step = m.restart or across * down
        if len(own) != -(-across * down // step):
            raise ValueError("restart intervals don't fit the dimensions")
        parts += own
        units += [min(step, across * down - k * step) for k in range(len(own))]
        owner += [i] * len(own)
        shapes.append((across, down))
    size = np.array([len(p) for p in parts], np.int64)
    raw = np.frombuffer(b"".join(p + b"\xff\xff\xff\xff" for p in parts) + bytes(4), np.uint8).astype(np.uint32)
    # the 32 bits from each byte on: one gather then reads any 16 bits
    window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    begin = (np.cumsum(size + 4) - (size + 4)) * 8
    count = np.array(units)
    order = np.argsort(-count, kind="stable")
    pos, left = begin[order].copy(), count[order]
    limit = (begin + size * 8)[order]
    tables = {k: lookup_of(*t) for k, t in first.tables.items()}
    blocks = [(1, 1) if alone else first.components[c][1:3] for c, _, _ in first.scan]
    per_unit = blocks[wanted][0] * blocks[wanted][1]
    dc = np.zeros((len(parts), int(count.max()) * per_unit), np.int16)
    last = [np.zeros(len(parts), np.int64) for _ in first.scan]
    for u in range(int(count.max())):
        live = int(np.searchsorted(-left, -u, side="left"))  # intervals with more than u units
        p, kept = pos[:live], 0
        for s, (_, dc_table, ac_table) in enumerate(first.scan):
            for _ in range(blocks[s][0] * blocks[s][1]):
                p, symbol = _symbol_at(window, p, tables[0, dc_table])
                p, value = _receive(window, p, symbol)
                last[s][:live] += value
                if s == wanted:
                    dc[:live, u * per_unit + kept] = last[s][:live]
                    kept += 1
                p = _skip_ac(window, p, tables[1, ac_table])
        pos[:live] = p
    if (pos > limit).any():
        raise ValueError("the scan ends early")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    out, at = [], 0
    for m, (across, down) in zip(images, shapes):
        n = -(-across * down // (m.restart or across * down))
        rows = dc[back[at : at + n]]
        used = count[at : at + n]
        flat = np.concatenate([r[: k * per_unit] for r, k in zip(rows, used)]) if len(set(used.tolist())) > 1 else rows[:, : used[0] * per_unit].reshape(-1)
        at += n
        h, v = blocks[wanted]
        grid = flat.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        _, ch, cv, q = m.components[0]
        grid = grid[: -(-(-(-m.height * cv // v_max)) // 8), : -(-(-(-m.width * ch // h_max)) // 8)]
        out.append(np.clip(np.rint(grid.astype(np.float32) * m.quant[q] / 8) + 128, 0, 255).astype(np.uint8))
    return out


def _peek(window: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (window[np.minimum(p >> 3, len(window) - 1)] >> (16 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)


def _symbol_at(window: np.ndarray, p: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = table[_peek(window, p)]
    if not found.all():
        raise ValueError("a code is not in its table")
    return p + (found >> 8), found & 255


def _receive(window: np.ndarray, p: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value = (_peek(window, p) >> (16 - bits).astype(np.uint32)).astype(np.int64)
    return p + bits, np.where(value < (1 << bits) >> 1, value - (1 << bits) + 1, value)


def _skip_ac(window: np.ndarray, p: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The positions after the AC coefficients of one block."""
    if (table[::257] == 256).sum() == 128 and not table[1 << 15 :].any():  # only "end of block", in one bit
        if (_peek(window, p) >> 15).any():
            raise ValueError("a code is not in its table")
        return p + 1
    p = p.copy()
    k = np.ones(len(p), np.int64)
    open_ = np.arange(len(p))
    while len(open_):
        q, symbol = _symbol_at(window, p[open_], table)
        run, bits = symbol >> 4, symbol & 15
        p[open_] = q + bits
        k[open_] += np.where((bits == 0) & (run != 15), 64, run + 1)
        open_ = open_[k[open_] < 64]
    return p


def reduced(thumb: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means of `rows` x `columns` cells; cells of small thumbnails repeat pixels."""
    def edges(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        a = np.arange(k) * n // k
        return a, np.maximum(np.arange(1, k + 1) * n // k, a + 1)

    (r0, r1), (c0, c1) = edges(thumb.shape[0], rows), edges(thumb.shape[1], columns)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    total[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    area = total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]
    return area / ((r1 - r0)[:, None] * (c1 - c0)[None, :])


def hashes(thumb: np.ndarray) -> tuple[str, str]:
    """Average hash and difference hash, 64 bits each as hexadecimal digits."""
    small, wide = reduced(thumb, 8, 8), reduced(thumb, 8, 9)
    bits = lambda x: np.packbits(x.reshape(-1)).tobytes().hex()
    return bits(small > small.mean()), bits(wide[:, 1:] > wide[:, :-1])


def read_payload(thumb: np.ndarray, n: int) -> bytes:
    """The first n bytes that `encode_payloads` stored in a thumbnail's image."""
    return thumb.reshape(-1)[:n].tobytes()


def media(docs: DataFrame) -> DataFrame:
    """The stored form of every text: doc_id, n_bytes (without padding), payload_bytes, media (the JPEG file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=1 << 20):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            full = [padded(r) for r in raw]
            yield pa.record_batch([b.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([len(f) for f in full], pa.int64()), pa.array(store(full), pa.binary())], ["doc_id", "n_bytes", "payload_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, media binary")


def features(rows: DataFrame) -> DataFrame:
    """Dimensions, hashes and payload digests of every stored file, all from the file's own bytes."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media", 1 << 20):
            files = b.column("media").to_pylist()
            cols: list[list] = [[] for _ in range(7)]
            for f, (payload, images) in zip(files, retrieve(files, b.column("payload_bytes").to_pylist())):
                feature = "|".join("{0}x{1}:{3}:{4}:{2:.3f}".format(w, h, t.mean(), *hashes(t)) for w, h, t in images)
                for c, x in zip(cols, (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature, images[0][0], images[0][1])):
                    c.append(x)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), b.column("payload_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds))], schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", "))

    return rows.mapInArrow(run, schema)
