"""Vectorised views of an Arrow text column: its UTF-8 bytes, its words and hashes of word sequences.

Everything here works on one slice of an Arrow batch inside a task; Spark deals the slices out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text that is looked at at a time, and that powers are kept for: some fifty bytes a byte of it, in each worker.
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Bytes of words `[^\x20\x09-\x0D]+`.
WORD_BYTES = ~byte_class(b" \t\n\x0b\x0c\r")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose text holds about `limit` bytes at most, one row at least."""
    texts = batch.column(column)
    if not len(texts):
        return
    ends = np.cumsum(_offsets(texts)[1:] - _offsets(texts)[:-1])
    at = 0
    while at < batch.num_rows:
        used = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, used + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def _offsets(texts: pa.Array) -> np.ndarray:
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if large else np.int32
    return np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * kind().itemsize).astype(np.int64)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each row's offsets in them; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = _offsets(texts)
    data = texts.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, members: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and for each row (and the end) the number of words before it."""
    inside = members[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[full] = False
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for up to n places. Those of a slice are kept; a longer text's are made
    anew, since workers live on."""
    kept = SLICE_BYTES + 4096
    made = _powers
    if n > kept or not made:
        made = {}
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, kept), base, np.uint64)
            steps[0] = 1
            made[name] = np.multiply.accumulate(steps, out=steps)
        if n <= kept:
            _powers.update(made)
    return made["up"], made["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span codes[start:end], from differences of one running sum."""
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.multiply(codes, up[: len(codes)], out=total[1:])
    np.cumsum(total, out=total)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, in ascending order of words that do not overlap; about a slice of the text at a time."""
    out = np.empty(len(starts), np.uint64)
    cuts = np.unique([*np.searchsorted(starts, np.arange(0, len(data), SLICE_BYTES)), len(starts)]).tolist()
    for a, b in zip(cuts, cuts[1:]):
        first, last = starts[a], ends[b - 1]
        out[a:b] = span_hashes(BYTE_CODES[data[first:last]], starts[a:b] - first, ends[a:b] - first)
    return out


#: Beyond so many bytes the running sums modulo 2**64 cannot tell some regular words apart.
LONG_WORD = 64


def sure_word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words that differ wherever words do but by chance: long words by a cryptographic hash."""
    out = word_hashes(data, starts, ends)
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` consecutive word hashes; windows may cross rows, which the caller masks."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return span_hashes(words, at, at + size)
