"""Media columns as baseline JPEG.

`jpeg_payload` stores bytes without loss in a one-component baseline JPEG: each block of 64 bytes becomes one block of
64 quantised coefficients (DC: byte - 128; AC: byte + 1, so none is zero), Huffman-coded, with a restart marker after
each block; a comment holds the unpadded length. `read_jpegs` parses markers and Huffman-decodes scans of baseline
JPEGs - any tables, restart intervals and sampling factors - in step over all restart segments of a batch, in numpy.
DC coefficients alone give luminance thumbnails of one pixel a block.

A null or empty payload is stored as one block of zeros; payloads are taken whole, a very long one in one task at some
thirty bytes a byte; equal payloads give equal media, so repeated rows repeated results; an empty table gives an empty
one; further columns of the input are not read, whatever their names. A media value that is null or no baseline JPEG gives
null features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import map_texts, table
from driftlake.llm.textbytes import utf8

BLOCK = 64
MEDIA_SLICE = 2 << 20
#: Code lengths for texts: letters are of AC size 7, spaces and digits of size 6, bytes from 127 of size 8.
_AC_LENGTHS = {0x07: 1, 0x06: 2, 0x08: 3, 0x01: 5, 0x05: 6, 0x00: 7, 0x04: 8, 0x03: 9, 0x02: 10, 0x09: 11}
_DC_LENGTHS = {5: 2, 6: 2, 7: 2, 4: 3, 8: 4, 3: 5, 2: 6, 1: 7, 0: 8}
_RESTARTS = np.arange(0xD0, 0xD8)


def canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The DHT body (16 counts, then symbols) and each symbol's (code, length)."""
    counts, codes, code, last = [0] * 16, {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        codes[symbol], last = (code, n), n
        code += 1
        counts[n - 1] += 1
    return bytes(counts) + bytes(s for s, _ in sorted(lengths.items(), key=lambda x: (x[1], x[0]))), codes


_DC_BODY, _DC_CODES = canonical(_DC_LENGTHS)
_AC_BODY, _AC_CODES = canonical(_AC_LENGTHS)


def _coded(values: np.ndarray, codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each value of a table: its Huffman code followed by its amplitude, and the bits of both."""
    bits, lengths = [], []
    for v in values.tolist():
        size = abs(v).bit_length()
        code, n = codes[size]
        bits.append(code << size | (v if v >= 0 else v + (1 << size) - 1))
        lengths.append(n + size)
    return np.array(bits, np.uint32), np.array(lengths, np.int64)


_DC_BITS, _DC_LEN = _coded(np.arange(256) - 128, _DC_CODES)
_AC_BITS, _AC_LEN = _coded(np.arange(256) + 1, _AC_CODES)


def _entropy(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all blocks (each its own restart segment, padded with ones and stuffed) and their ends."""
    n = len(blocks)
    bits, length = _AC_BITS[blocks], _AC_LEN[blocks]
    bits[:, 0], length[:, 0] = _DC_BITS[blocks[:, 0]], _DC_LEN[blocks[:, 0]]
    ends = np.cumsum(length, axis=1)
    size = (ends[:, -1] + 7) // 8
    first = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=first[1:])
    begin = first[:-1, None] * 8 + ends - length
    shift = (32 - length - (begin & 7)).astype(np.uint64)
    window = (bits.astype(np.uint64) << shift).ravel()
    at = (begin >> 3).ravel()
    out = np.zeros(first[-1] + 4, np.float64)
    for k in range(4):
        out += np.bincount(at + k, weights=((window >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64), minlength=len(out))
    out = out[: first[-1]].astype(np.uint8)
    pad = (-ends[:, -1]) % 8
    out[first[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    full = np.flatnonzero(out == 255)
    return np.insert(out, full + 1, 0), first[1:] + np.searchsorted(full, first[1:])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int, comment: bytes) -> bytes:
    return b"".join([
        b"\xff\xd8", _segment(0xFE, comment), _segment(0xDB, b"\x00" + bytes([8] + [1] * 63)),
        _segment(0xC0, struct.pack(">BHHB", 8, height * 8, width * 8, 1) + b"\x01\x11\x00"),
        _segment(0xC4, b"\x00" + _DC_BODY + b"\x10" + _AC_BODY), _segment(0xDD, b"\x00\x01"), _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


def jpegs_of(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A JPEG for each row's bytes, padded with zeros to a positive multiple of 64."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // BLOCK))
    begins = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(counts, out=begins[1:])
    padded = np.zeros(begins[-1] * BLOCK, np.uint8)
    padded[np.arange(len(data)) + np.repeat(begins[:-1] * BLOCK - offsets[:-1], sizes)] = data
    codes, ends = _entropy(padded.reshape(-1, BLOCK))
    filler_dc, filler_ac = _DC_CODES[0], _AC_CODES[0]
    bits = filler_dc[0] << filler_ac[1] | filler_ac[0]
    pad = -(filler_dc[1] + filler_ac[1]) % 8
    filler = ((bits << pad) | ((1 << pad) - 1)).to_bytes((filler_dc[1] + filler_ac[1] + pad) // 8, "big").replace(b"\xff", b"\xff\x00")
    # a restart marker after each block of a row; the last of each row is cut off again below
    local = np.arange(len(ends)) - np.repeat(begins[:-1], counts)
    marks = np.stack([np.full(len(ends), 0xFF), _RESTARTS[local % 8]], 1).astype(np.uint8).ravel()
    stream = np.insert(codes, np.repeat(ends, 2), marks)
    ends = ends + 2 * np.arange(1, len(ends) + 1)
    raw, out = stream.tobytes(), []
    for i, n in enumerate(counts.tolist()):
        width = max(1, int(np.ceil(np.sqrt(n))))
        height = -(-n // width)
        a, b = (int(ends[begins[i] - 1]) if begins[i] else 0), int(ends[begins[i + 1] - 1])
        extra = width * height - n
        tail = b"".join(bytes([0xFF, 0xD0 + (n - 1 + k) % 8]) + filler for k in range(extra))
        out.append(b"".join([_head(width, height, b"%d" % int(sizes[i])), raw[a : b - 2], tail, b"\xff\xd9"]))
    return out


@dataclass
class Jpeg:
    """What the markers of a baseline JPEG say, and where its restart segments lie."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    quant: dict[int, tuple[int, ...]] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    frame: tuple[tuple[int, int, int, int], ...] = ()
    scan: tuple[tuple[int, int, int], ...] = ()
    interval: int = 0
    segments: list[bytes] = field(default_factory=list)


def parse(media: bytes) -> Jpeg | None:
    """Markers of a baseline JPEG with one scan; None for anything else."""
    if media[:2] != b"\xff\xd8":
        return None
    out, at = Jpeg(), 2
    try:
        while True:
            while media[at] == 0xFF and media[at + 1] == 0xFF:
                at += 1
            if media[at] != 0xFF:
                return None
            marker = media[at + 1]
            if marker == 0xD9:
                return None
            n = struct.unpack_from(">H", media, at + 2)[0]
            body = media[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xFE:
                out.comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    size = 64 * (1 + wide)
                    out.quant[body[0] & 15] = struct.unpack(">64H" if wide else ">64B", body[1 : 1 + size])
                    body = body[1 + size :]
            elif marker == 0xC4:
                while body:
                    size = sum(body[1:17])
                    out.tables[body[0]] = body[1 : 17 + size]
                    body = body[17 + size :]
            elif marker in (0xC0, 0xC1):
                depth, out.height, out.width, parts = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    return None
                out.frame = tuple((body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(parts))
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                return None
            elif marker == 0xDD:
                out.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                out.scan = tuple((body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0]))
                break
    except (IndexError, struct.error):
        return None
    data = np.frombuffer(media, np.uint8)[at:]
    marks = np.flatnonzero((data[:-1] == 255) & (data[1:] != 0) & (data[1:] != 255))
    begin = 0
    for m in marks.tolist():
        out.segments.append(data[begin:m].tobytes())
        begin = m + 2
        if not 0xD0 <= data[m + 1] <= 0xD7:
            break
    else:
        out.segments.append(data[begin:].tobytes())
    return out if out.frame and out.scan and out.width and out.height else None


def _lookup(body: bytes) -> np.ndarray:
    """For each 16 bits: the symbol and length of the code that they begin with; length 0 for none."""
    table, code, at = np.zeros((1 << 16, 2), np.int16), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            lo = code << (16 - n)
            table[lo : lo + (1 << (16 - n))] = body[at], n
            code += 1
            at += 1
        code <<= 1
    return table


def _blocks_of_mcu(jpeg: Jpeg) -> list[tuple[int, int, int]]:
    """(component's place in the scan, DC table, AC table) of each block of an MCU."""
    by = {c[0]: c for c in jpeg.frame}
    if len(jpeg.scan) == 1:
        return [(0, jpeg.scan[0][1], jpeg.scan[0][2])]
    return [(k, dc, ac) for k, (c, dc, ac) in enumerate(jpeg.scan) for _ in range(by[c][1] * by[c][2])]


def _mcus(jpeg: Jpeg) -> tuple[int, int]:
    tall, wide = max(c[2] for c in jpeg.frame), max(c[1] for c in jpeg.frame)
    if len(jpeg.scan) == 1:
        c = next(c for c in jpeg.frame if c[0] == jpeg.scan[0][0])
        return -(-(-(-jpeg.width * c[1] // wide)) // 8), -(-(-(-jpeg.height * c[2] // tall)) // 8)
    return -(-jpeg.width // (8 * wide)), -(-jpeg.height // (8 * tall))


def scan_blocks(jpegs: list[Jpeg]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each image's decoded blocks, in scan order (n, 64 coefficients in zigzag order), and each block's place in its MCU.

    All restart segments of images with the same tables are decoded in step: one coefficient of each at a time."""
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i, j in enumerate(jpegs):
        groups[tuple(sorted(j.tables.items())), tuple(_blocks_of_mcu(j))].append(i)
    out: list = [None] * len(jpegs)
    for (tables, mcu), members in groups.items():
        lookups = {k: _lookup(body) for k, body in tables}
        segments, todo, base, total = [], [], [], 0
        for i in members:
            j = jpegs[i]
            wide, tall = _mcus(j)
            left, each, begin = wide * tall, j.interval or wide * tall, total
            for s in j.segments:
                if left <= 0:
                    break
                segments.append(s)
                base.append(total)
                todo.append(min(each, left) * len(mcu))
                total += todo[-1]
                left -= each
            out[i] = (begin, total)
        coefficients = _in_step(segments, np.array(todo, np.int64), np.array(base, np.int64), total, list(mcu), lookups)
        place = np.arange(total) % len(mcu)
        for i in members:
            a, b = out[i]
            out[i] = (coefficients[a:b], place[a:b])
    return out


def _in_step(segments: list[bytes], todo: np.ndarray, base: np.ndarray, total: int, mcu: list[tuple[int, int, int]], lookups: dict[int, np.ndarray]) -> np.ndarray:
    result = np.zeros((total, 64), np.int16)
    if not total:
        return result
    clean = [s.replace(b"\xff\x00", b"\xff") for s in segments]
    begins = np.zeros(len(clean) + 1, np.int64)
    np.cumsum([len(s) + 8 for s in clean], out=begins[1:])
    data = np.frombuffer(b"".join(s + b"\xff" * 8 for s in clean), np.uint8)
    # any 32 bits from a byte on, for reading at a bit position
    word = (data[:-4].astype(np.uint64) << 32) | (data[1:-3].astype(np.uint64) << 24) | (data[2:-2].astype(np.uint64) << 16) | (data[3:-1].astype(np.uint64) << 8) | data[4:]
    last = len(word) - 1
    lanes = np.arange(len(clean))
    bit = begins[:-1] * 8
    predict = np.zeros((len(clean), max(k for k, _, _ in mcu) + 1), np.int64)

    def peek(at: np.ndarray) -> np.ndarray:
        return (word[np.minimum(at >> 3, last)] >> (8 - (at & 7)).astype(np.uint64)).astype(np.int64) & 0xFFFFFFFF

    def value(bits: np.ndarray, used: np.ndarray, size: np.ndarray) -> np.ndarray:
        raw = (bits >> (32 - used - size)) & ((1 << size) - 1)
        return np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)

    for b in range(int(todo.max())):
        lanes = lanes[todo[lanes] > b]
        component, dc, ac = mcu[b % len(mcu)]
        row = base[lanes] + b
        bits = peek(bit[lanes])
        entry = lookups[dc][bits >> 16].astype(np.int64)
        size, used = entry[:, 0], entry[:, 1]
        predict[lanes, component] += value(bits, used, size)
        result[row, 0] = predict[lanes, component]
        at, k, live = bit[lanes] + used + size, np.ones(len(lanes), np.int64), np.arange(len(lanes))
        while len(live):
            bits = peek(at[live])
            entry = lookups[0x10 | ac][bits >> 16].astype(np.int64)
            run, size, used = entry[:, 0] >> 4, entry[:, 0] & 15, np.maximum(entry[:, 1], 1)
            at[live] += used + size
            to = k[live] + run
            good = (size > 0) & (to < 64)
            result[row[live[good]], to[good]] = value(bits[good], used[good], size[good])
            k[live] = np.where((size == 0) & (run < 15), 64, to + 1)
            live = live[k[live] < 64]
        bit[lanes] = at
    return result


def thumbnail(jpeg: Jpeg, blocks: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The luminance of each 8 by 8 block from its DC coefficient alone."""
    wide, tall = _mcus(jpeg)
    first = next(c for c in jpeg.frame if c[0] == jpeg.scan[0][0])
    h, v = (first[1], first[2]) if len(jpeg.scan) > 1 else (1, 1)
    dc = blocks[place < h * v, 0].astype(np.int64) * jpeg.quant[first[3]][0]
    out = np.zeros(wide * tall * h * v, np.int64)
    out[: len(dc)] = dc
    pixels = out.reshape(tall, wide, v, h).transpose(0, 2, 1, 3).reshape(tall * v, wide * h)
    return np.clip(np.round(pixels / 8) + 128, 0, 255).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: whether brightness falls from each cell of an 8 by 9 grid to the next one in its row."""
    tall, wide = pixels.shape
    grid = pixels[np.ix_(np.arange(8) * tall // 8, np.arange(9) * wide // 9)].astype(np.int16)
    return int.from_bytes(np.packbits(grid[:, :-1] > grid[:, 1:]).tobytes(), "big")


def payload_of(jpeg: Jpeg, blocks: np.ndarray) -> bytes:
    """The padded payload that `jpegs_of` stored."""
    n = max(1, -(-int(jpeg.comment) // BLOCK))
    own = blocks[:n].astype(np.int64) - 1
    own[:, 0] += 129
    return own.astype(np.uint8).tobytes()


def jpeg_payload(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each row's text, UTF-8, stored without loss as a baseline JPEG."""
    kind = dict(docs.dtypes)[id_col]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(jpegs_of(data, offsets), pa.binary())], ["id", "n_bytes", "media"])

    return map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, f"id {kind}, n_bytes long, media binary", limit=MEDIA_SLICE).withColumnRenamed("id", id_col)


def read_jpegs(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", payload: bool = False) -> DataFrame:
    """(id, width, height, thumbnail_hash, thumbnail[, payload_bytes, payload_sha256, tail_crc32]) of each row's JPEG.

    With payload, figures of the bytes that `jpeg_payload` stored come too."""
    kind = dict(media.dtypes)[id_col]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parsed = [parse(m) if m is not None else None for m in batch.column(1).to_pylist()]
        decoded = iter(scan_blocks([j for j in parsed if j]))
        rows = []
        for j in parsed:
            if j is None:
                rows.append((None,) * 7)
                continue
            blocks, place = next(decoded)
            pixels = thumbnail(j, blocks, place)
            row = (j.width, j.height, f"{difference_hash(pixels):016x}", pixels.tobytes())
            stored = payload_of(j, blocks) if payload else b""
            rows.append((*row, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-BLOCK:])))
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        names = ["width", "height", "thumbnail_hash", "thumbnail", "payload_bytes", "payload_sha256", "tail_crc32"]
        n = 7 if payload else 4
        return pa.RecordBatch.from_arrays([batch.column(0), *columns[:n]], ["id", *names[:n]])

    schema = f"id {kind}, width int, height int, thumbnail_hash string, thumbnail binary" + ", payload_bytes long, payload_sha256 string, tail_crc32 long" * payload
    return map_texts(media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")), work, schema, "media", MEDIA_SLICE).withColumnRenamed("id", id_col)


def media_figures(media: DataFrame) -> DataFrame:
    """Reads a media table of `jpeg_payload` back and puts its figures beside those of the stored form."""

    kind = dict(media.dtypes)["doc_id"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        media_list = batch.column(2).to_pylist()
        parsed = [parse(m) for m in media_list]
        rows = []
        for j, (blocks, place), m in zip(parsed, scan_blocks(parsed), media_list):
            stored = payload_of(j, blocks)
            feature = f"{j.width}x{j.height}:{difference_hash(thumbnail(j, blocks, place)):016x}"
            rows.append((len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), feature))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_texts(media.select("doc_id", "n_bytes", "media"), work, schema, "media", MEDIA_SLICE)


def op8_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_figures(jpeg_payload(table(spark, sf_dir, "documents")))
