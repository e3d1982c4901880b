"""Byte-level BPE by a hierarchical-bitmap rank queue.

All pre-tokens of a block of text that are not yet known are laid out as one array of symbols with a linked list per
pre-token. Each merge rank has a bucket of list positions; a three-level bitmap over the ranks finds the first bucket
that is not empty; its positions are taken together, those whose pair has changed since are skipped as stale, and the
pairs that a merge makes go to the buckets of their own ranks. One pre-token of a million bytes costs no more than
many short ones; a text that is one pre-token takes some fifty bytes a byte in its task.

Null and empty texts have no ids; texts are read whole; repeated rows give repeated results; an empty table gives an
empty one; further columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import table

#: Pieces that can be encoded alone: no match of the pattern goes past a place where ASCII white space follows other text.
_PIECE = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: Characters that some engines take as white space beside the ASCII ones; a text with one of them is one piece.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
BLOCK_BYTES = 32 << 20
CACHE_PIECES = 200_000
LONG_PIECE = 48
_NONE = np.int64(1 << 40)


class RankBitmap:
    """Which ranks have entries: 64-way bitmaps on three levels, so that the first is found in three steps."""

    def __init__(self, size: int):
        self.levels = []
        while True:
            size = (size + 63) // 64
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, rank: int) -> None:
        for level in self.levels:
            level[rank >> 6] |= 1 << (rank & 63)
            rank >>= 6

    def pop_first(self) -> int:
        """Takes out the lowest rank; -1 if there is none."""
        if not self.levels[-1][0]:
            return -1
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = at * 64 + ((word & -word).bit_length() - 1)
        rank = at
        for level in self.levels:
            level[rank >> 6] &= ~(1 << (rank & 63))
            if level[rank >> 6]:
                break
            rank >>= 6
        return at


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.vocabulary = {i: b for b, i in ranks.items()}
        self.decimals = list(map(str, range(self.size)))
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    merged.append(rank)
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        #: Ranks whose merge can make a pair of a lower rank; their positions are taken one by one in each pre-token.
        lower = self.merged < np.maximum(self.keys // self.size, self.keys % self.size)
        both = np.concatenate([self.keys[lower] // self.size, self.keys[lower] % self.size])
        self.alone = set(both[np.concatenate([self.merged[lower]] * 2) < both].tolist()) - set(self.first.tolist())
        self.byte_pairs = self._ranks(np.repeat(self.first, 256), np.tile(self.first, 256)).reshape(256, 256)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairEncoder:
        fs, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
        with fs.open_input_stream(at) as f:
            lines = f.read().split(b"\n")
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens in a row, and where each one's ids start (and the end)."""
        data = np.frombuffer(b"".join(tokens), np.uint8)
        bounds = np.zeros(len(tokens) + 1, np.int64)
        np.cumsum([len(t) for t in tokens], out=bounds[1:])
        n = len(data)
        symbol = self.first[data]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[bounds[1:] - 1], before[bounds[:-1]] = -1, -1
        alive = np.ones(n, bool)
        pair = np.full(n, _NONE)
        if n > 1:
            pair[:-1] = self.byte_pairs[data[:-1], data[1:]]
            pair[bounds[1:] - 1] = _NONE
        owner = np.repeat(np.arange(len(tokens)), np.diff(bounds)) if self.alone else None
        queue, buckets = RankBitmap(self.size), {}

        def push(places: np.ndarray) -> None:
            rank = pair[places]
            order = np.argsort(rank, kind="stable")
            rank, places = rank[order], places[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for r, some in zip(rank[np.concatenate([[0], cut])].tolist() if len(rank) else (), np.split(places, cut)):
                if r not in buckets:
                    buckets[r] = [some]
                    queue.add(r)
                else:
                    buckets[r].append(some)

        push(np.flatnonzero(pair < _NONE))
        while (rank := queue.pop_first()) >= 0:
            held = buckets.pop(rank)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[pair[at] == rank]  # the others are stale
            if not len(at):
                continue
            if rank in self.alone:
                lead = np.ones(len(at), bool)
                lead[1:] = owner[at[1:]] != owner[at[:-1]]
                if not lead.all():
                    buckets[rank] = [at[~lead]]
                    queue.add(rank)
                at = at[lead]
            elif len(at) > 1:
                linked = after[at[:-1]] == at[1:]
                if linked.any():  # in a chain of overlapping pairs every other one merges, from the left
                    index = np.arange(len(at))
                    begin = np.ones(len(at), bool)
                    begin[1:] = ~linked
                    at = at[(index - np.maximum.accumulate(np.where(begin, index, 0))) % 2 == 0]
            right = after[at]
            symbol[at] = rank
            alive[right], pair[right] = False, _NONE
            follow = after[right]
            after[at] = follow
            has = follow >= 0
            before[follow[has]] = at[has]
            lead = before[at]  # only now: the one before may have merged as well
            pair[at] = _NONE
            new = at[has]
            pair[new] = self._ranks(symbol[new], symbol[follow[has]])
            old = lead[lead >= 0]
            pair[old] = self._ranks(symbol[old], symbol[after[old]])
            new = np.concatenate([new, old])
            new = new[pair[new] < _NONE]
            if len(new):
                push(np.unique(new))
        kept = np.flatnonzero(alive)
        return symbol[kept], np.searchsorted(kept, bounds)

    def pieces(self, text: str) -> list[str]:
        return [text] if _ODD_SPACE.search(text) and text else _PIECE.findall(text)

    def learn(self, wanted: list[str], cache: dict[str, str]) -> None:
        """Puts the ids of pieces, as decimals joined by spaces, into the cache."""
        split = [self.pattern.findall(p) for p in wanted]
        index = {t: i for i, t in enumerate(dict.fromkeys(t for s in split for t in s))}
        if not index:
            cache.update(dict.fromkeys(wanted, ""))
            return
        ids, bounds = self.merge([t.encode() for t in index])
        ids, bounds = list(map(self.decimals.__getitem__, ids.tolist())), bounds.tolist()
        texts = {t: " ".join(ids[a:b]) for t, a, b in zip(index, bounds, bounds[1:])}
        for piece, tokens in zip(wanted, split):
            cache[piece] = texts[tokens[0]] if len(tokens) == 1 else " ".join([texts[t] for t in tokens])

    def encode_all(self, texts: list[str], cache: dict[str, str]) -> list[str]:
        """Each text's ids as decimals joined by one space."""
        split = [self.pieces(t) for t in texts]
        if len(cache) > CACHE_PIECES:
            cache.clear()
        new = {p for s in split for p in s}
        new.difference_update(cache)
        if new:
            self.learn(sorted(new), cache)
        out = [" ".join(map(cache.__getitem__, s)) for s in split]
        for p in new:
            if len(p) > LONG_PIECE:
                del cache[p]
        return out

    def decoder(self) -> dict[str, bytes]:
        return {str(i): b for i, b in self.vocabulary.items()}


def bpe_ids(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, ids array<int>) for every row; with digests, (id, n_tokens, ids_sha256, decoded_sha256) of the ids and of
    the bytes that they decode to. ranks_path is a file of `base64 rank` lines that the executors can read."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cache = BytePairEncoder.from_file(ranks_path, pattern), {}
        vocabulary = encoder.decoder() if digests else {}

        def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoded = encoder.encode_all([t or "" for b in held for t in b.column(1).to_pylist()], cache)
            at = 0
            for b in held:
                own = encoded[at : at + b.num_rows]
                at += b.num_rows
                if digests:
                    ids = [x.split(" ") if x else [] for x in own]
                    yield pa.RecordBatch.from_arrays([
                        b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in own], pa.string()),
                        pa.array([hashlib.sha256(b"".join(map(vocabulary.__getitem__, x))).hexdigest() for x in ids], pa.string()),
                    ], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.fromstring(x, np.int32, sep=" ") if x else [] for x in own], pa.list_(pa.int32()))], ["id", "ids"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= BLOCK_BYTES:
                yield from block(held)
                held, size = [], 0
        if held:
            yield from block(held)

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else f"id {kind}, ids array<int>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def bpe_bytes(ids: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary): what each row's ids decode to; null ids give null."""
    kind = dict(ids.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = BytePairEncoder.from_file(ranks_path, pattern).vocabulary
        for b in batches:
            rows = [None if x is None else b"".join(map(vocabulary.__getitem__, x)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["id", "bytes"])

    return ids.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_ids(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, digests=True)
