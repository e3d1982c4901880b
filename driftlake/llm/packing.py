"""Best-fit packing of documents into token sequences by linear grouping.

Texts become token ids and an end id; a document longer than a sequence is cut, its first piece being the shorter one.
What is to be packed is then described by how many pieces there are of each length - as many numbers as a sequence has
tokens, whatever the corpus. On these:

1. large lengths (but for pieces that fill a sequence), in descending order, form groups of equal cardinality, each rounded up to its largest;
2. the few rounded sizes are packed by configurations, found by column generation on the linear programme;
3. the actual pieces are put into the places of their groups, which leaves what rounding had added free again;
4. pieces left over and the small ones go, in descending order, where they fit best.

The plan tells for each length which ranks go to which sequences; the pieces, ranked within their lengths on the
executors, look their places up in it.

A null text is an empty one and is packed as the end id alone; a text is encoded whole, in its task; repeated rows are
packed once each; an empty table gives an empty one; further columns of the input are not read. Pricing a configuration
that improves the linear programme ends when there is none or after ROUNDS; the basic solution then is feasible in any
case, and the pieces that it leaves are packed by best fit.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlake.llm.common import table, written

CAPACITY = 1024
END_ID = 2
GROUPS = 64
ROUNDS = 1500
LARGE_PART = 8  # lengths above a LARGE_PART-th of a sequence are large
#: Pieces of one length that are ranked together, about.
RANKED_TOGETHER = 1 << 16

def byte_level_bytes() -> dict[str, int]:
    """Byte-level tokenizers write each byte as a character: printable ones as themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}


def tokenizer_of(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file, whose ids are its merge ranks, and its added tokens.

    The same ids as the tokenizers library gives, in a quarter of its time; a test compares the two."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    with fs.open_input_stream(at) as f:
        described = json.loads(f.read())
    byte, added = byte_level_bytes(), described.get("added_tokens", ())
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take neighbouring characters are not supported")
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def token_pieces(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the pieces of every row's token ids, the end id included.

    The literals of the file's added tokens become their ids, as the library does by default; without added_tokens they are
    text like any other."""
    kind = dict(docs.dtypes)[id_col]
    end = end_id.to_bytes(4, "little")
    allowed = "all" if added_tokens else set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        for batch in batches:
            tokenizer = tokenizer or tokenizer_of(tokenizer_path, pattern)
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = (tokenizer.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype("<u4").tobytes() if text else b"") + end
                n = len(ids) // 4
                at, k, size = 0, 0, n % capacity or capacity
                while at < n:
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, k, size = at + size, k + 1, capacity
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


def grouped(counts: dict[int, int], groups: int) -> list[tuple[int, dict[int, int]]]:
    """Linear grouping: (rounded size, {length: pieces}) of groups of equal cardinality, largest first."""
    total = sum(counts.values())
    each = max(1, -(-total // groups))
    out: list[tuple[int, dict[int, int]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, {}))
                room = each
            n = min(left, room)
            out[-1][1][length] = out[-1][1].get(length, 0) + n
            left -= n
            room -= n
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = ROUNDS) -> list[tuple[float, list[int]]]:
    """(times, count of each size): a basic solution of the cutting-stock programme by column generation."""
    m = len(sizes)
    size, need = np.array(sizes), np.array(demand, float)
    columns = np.diag(capacity // size).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    amount = inverse @ need
    for _ in range(rounds):
        price = inverse.sum(0)
        # the most valuable content of a sequence at these prices (unbounded knapsack over all capacities)
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        ascending = np.argsort(size, kind="stable")
        own, worth = size[ascending], price[ascending]
        for c in range(1, capacity + 1):
            fit = int(np.searchsorted(own, c, "right"))
            if fit:
                value = best[c - own[:fit]] + worth[:fit]
                k = int(value.argmax())
                if value[k] > best[c - 1] + 1e-12:
                    best[c], choice[c] = value[k], k
                    continue
            best[c], choice[c] = best[c - 1], -1
        if best[capacity] <= 1 + 1e-7:
            break
        entering, c = np.zeros(m), capacity
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                entering[ascending[choice[c]]] += 1
                c -= own[choice[c]]
        step = inverse @ entering
        ratio = np.where(step > 1e-9, amount / np.maximum(step, 1e-9), np.inf)
        leaving = int(ratio.argmin())
        if not np.isfinite(ratio[leaving]):
            break
        amount = np.maximum(amount - ratio[leaving] * step, 0)
        amount[leaving] = ratio[leaving]
        pivot = inverse[leaving] / step[leaving]
        inverse -= np.outer(step, pivot)
        inverse[leaving] = pivot
        columns[:, leaving] = entering
    return [(float(a), columns[:, k].astype(int).tolist()) for k, a in enumerate(amount) if a > 1e-9]


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, tuple[int, ...]]]:
    """(sequences, lengths in each): where all pieces go, given the number of pieces of each length.

    The number of entries depends on the capacity and the groups, not on the number of pieces."""
    left = {k: n for k, n in counts.items() if n}
    runs: dict[tuple[int, ...], int] = defaultdict(int)
    if left.get(capacity):
        runs[(capacity,)] = left.pop(capacity)
    large = {k: n for k, n in left.items() if k > capacity // LARGE_PART}
    if large:
        spans: dict[int, tuple[int, int]] = {}  # rounded size -> shortest and longest actual length of its groups
        demand: dict[int, int] = defaultdict(int)
        for rounded, own in grouped(large, groups):
            spans[rounded] = min(*own, spans.get(rounded, (rounded,))[0], rounded), rounded
            demand[rounded] += sum(own.values())
        sizes = list(demand)
        there = sorted(left)
        for times, content in sorted(configurations(sizes, list(demand.values()), capacity), key=lambda x: [-k for k in x[1]]):
            places = [sizes[g] for g, n in enumerate(content) for _ in range(n)]
            todo = int(times + 1e-7)
            while todo > 0 and (lengths := _substituted(places, spans, left, there, capacity)):
                used = {k: lengths.count(k) for k in lengths}
                n = min([todo, *(left[k] // u for k, u in used.items())])
                runs[lengths] += n
                todo -= n
                for k, u in used.items():
                    left[k] -= n * u
                    if not left[k]:
                        there.pop(bisect_left(there, k))
    # best fit, in descending order, of all that is left
    open_runs: dict[int, list[tuple[int, ...]]] = defaultdict(list)
    free: list[int] = []
    for lengths in runs:
        room = capacity - sum(lengths)
        if room and not open_runs[room]:
            insort(free, room)
        if room:
            open_runs[room].append(lengths)
    for length in sorted((k for k, n in left.items() if n > 0), reverse=True):
        todo = left[length]
        while todo:
            at = bisect_left(free, length)
            if at == len(free):
                per = capacity // length
                n, rest = divmod(todo, per)
                moved = []
                for lengths, times in (((length,) * per, n), ((length,) * rest, 1 if rest else 0)):
                    if times:
                        runs[lengths] += times
                        moved.append(lengths)
                todo = 0
            else:
                room = free[at]
                lengths = open_runs[room][-1]
                per = min(room // length, -(-todo // runs[lengths]))
                n = min(runs[lengths], todo // per)
                runs[lengths] -= n
                if not runs[lengths]:
                    del runs[lengths]
                    open_runs[room].pop()
                    if not open_runs[room]:
                        free.pop(at)
                moved = [lengths + (length,) * per]
                runs[moved[0]] += n
                todo -= n * per
            for lengths in moved:
                room = capacity - sum(lengths)
                if room and lengths not in open_runs[room]:
                    if not open_runs[room]:
                        insort(free, room)
                    open_runs[room].append(lengths)
    return [(n, lengths) for lengths, n in runs.items() if n]


def _substituted(places: list[int], spans: dict[int, tuple[int, int]], left: dict[int, int], there: list[int], capacity: int) -> tuple[int, ...]:
    """Actual lengths for a configuration: its places, but for the smallest, take pieces of their groups; what is left
    of the sequence takes the pieces that fit best. Empty if a group has no piece left."""
    used: dict[int, int] = defaultdict(int)
    room = capacity

    def largest(most: int) -> int:
        at = bisect_right(there, most) - 1
        while at >= 0 and left[there[at]] <= used[there[at]]:
            at -= 1
        return there[at] if at >= 0 else 0

    for size in places[: max(1, len(places) - 1)]:
        k = largest(spans[size][1])
        if k < spans[size][0] or k > room:
            return ()
        used[k] += 1
        room -= k
    while room and (k := largest(room)):
        used[k] += 1
        room -= k
    return tuple(sorted((k for k, n in used.items() for _ in range(n)), reverse=True))


def placed(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, id_col: str = "doc_id") -> DataFrame:
    """pieces with sequence_id and offset. pieces: what `token_pieces` gives, written once, since it is read twice."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    rows, sequence, taken = [], 0, defaultdict(int)
    for n, lengths in packing_plan(counts, capacity, groups):
        offset = 0
        for k in lengths:
            rows.append((k, taken[k], taken[k] + n, sequence - taken[k], offset))
            taken[k] += n
            offset += k
        sequence += n
    plan = spark.createDataFrame(rows, "plan_length long, first long, past long, shift long, offset long")
    # ranks within a length: within a bucket of it, after what the buckets before it hold; their number grows with the pieces
    buckets = max(16, -(-max(counts.values(), default=0) // RANKED_TOGETHER))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece", "start", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    # the plan's size depends on the capacity and the groups alone
    found = ranked.join(F.broadcast(plan), (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    return found.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every row's pieces and their places in sequences."""
    return placed(written(token_pieces(docs, tokenizer_path, pattern, capacity, end_id, id_col, text_col, added_tokens), "pieces"), capacity, id_col=id_col)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN, added_tokens=True)
