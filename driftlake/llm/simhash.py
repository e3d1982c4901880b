"""SimHash near-duplicates by pigeonring filtering.

Each text's fingerprint takes the majority of each bit over the XXH64 hashes of its word shingles, repeats included.
Fingerprints within the budget of differing bits are linked; documents of linked fingerprints form a group.

The bits lie on a ring of segments, one more than the budget. If two fingerprints are within the budget then, from some
segment on, every chain of l consecutive segments differs in no more than l times the budget's share of a segment. So
the first segment of the chain is equal and is a bucket's key; as the corpus grows the key is extended by what the next
segments' budgets leave equal (of a segment with one difference at most one half is). In a bucket, pairs must pass the
chain's budgets one after the other before the full Hamming check. Buckets beyond a size are split into blocks whose
pairs are dealt out, so nothing is dropped.

Equal fingerprints are one node, so a group of copies costs what one document costs. Of the pairs that meet in a bucket no
more than an edge for each fingerprint leaves it: to the least one that it is linked to there, directly or not.

Null texts and texts without words have fingerprint zero, linked like any other; fewer words than a shingle are one
shingle; texts are read whole; repeated rows are separate members; a row without id joins and bridges its group like any
other but never names it (a group of such rows only has no name); an empty table gives an empty one; further columns of
the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import map_texts, table, written
from driftlake.llm.textbytes import WORD_BYTES, utf8, word_spans

BITS = 64
SHINGLE = 4
SEED = 42
#: Links that one task takes when components are made: of small sets of links no shuffle is needed.
LINKS_PER_TASK = 100_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: For each byte value, its bits from the lowest.
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each row of a block of UTF-8 texts; zero for a row without words."""
    data = _LOWER[data]
    starts, ends, counts = word_spans(data, offsets, WORD_BYTES)
    # words with one space after each
    sizes = ends - starts
    begin = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes + 1, out=begin[1:])
    joined = np.full(begin[-1], 32, np.uint8)
    joined[np.arange(begin[-1] - len(starts)) + np.repeat(np.arange(len(starts)), sizes)] = data[WORD_BYTES[data]]
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    out = np.zeros(len(offsets) - 1, np.uint64)
    column = 256 * np.arange(8)
    for i, (a, b) in enumerate(zip(counts.tolist(), counts[1:].tolist())):
        if a == b:
            continue
        n = max(1, b - a - shingle + 1)
        first = begin[a : a + n].tolist()
        last = (begin[a + min(shingle, b - a) : a + min(shingle, b - a) + n] - 1).tolist()
        hashes = np.array([digest(raw[s:e], seed) for s, e in zip(first, last)], np.uint64)
        times = np.bincount((hashes.view(np.uint8).reshape(n, 8) + column).ravel(), minlength=2048).reshape(8, 256)
        majority = (times @ _BYTE_BITS * 2 > n).ravel()
        out[i] = np.packbits(majority, bitorder="little").view(np.uint64)[0]
    return out


def segments(budget: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment of the ring."""
    m = budget + 1
    cuts = [bits * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def chains(budget: int, depth: int) -> list[tuple[int, int]]:
    """(first segment, bits that are equal) of every bucket key: the chain's first segment and, for each further one up
    to the depth, a part that the chain's budget leaves equal."""
    ring = segments(budget)
    m, keys = len(ring), [(i, ((1 << n) - 1) << a) for i, (a, n) in enumerate(ring)]
    for step in range(1, depth):
        parts = (step + 1) * budget // m + 1  # one more than the differences that the chain so far may have
        longer = []
        for i, mask in keys:
            a, n = ring[(i + step) % m]
            cuts = [a + n * k // parts for k in range(parts + 1)]
            longer += [(i, mask | ((1 << (y - x)) - 1) << x) for x, y in zip(cuts, cuts[1:])]
        keys = longer
    return keys


def depth_for(n: int, budget: int, members: int = 256) -> int:
    """How far keys must reach so that a bucket of n evenly spread fingerprints holds `members` at most."""
    for depth in range(1, budget + 1):
        if n >> min(mask.bit_count() for _, mask in chains(budget, depth)) <= members:
            return depth
    return budget


def chain_masks(budget: int) -> list[list[tuple[int, int]]]:
    """For each first segment: (bits of the chain, its budget) for chains of 2 segments up to the whole ring."""
    ring = segments(budget)
    m = len(ring)
    bits = [((1 << n) - 1) << a for a, n in ring]
    return [[(sum(bits[(i + k) % m] for k in range(l)), l * budget // m) for l in range(2, m + 1)] for i in range(m)]


def viable_pairs(key: np.ndarray, first: np.ndarray, block: np.ndarray, prints: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs among rows sorted by key; first: the key's chain start. Rows of equal key meet, unless
    the key's rows were dealt out in blocks: then only those of different blocks, or of the pair's single block."""
    masks = [[(np.uint64(mask), most) for mask, most in own] for own in chain_masks(budget)]
    left, right = [], []
    at, step = np.arange(len(key) - 1), 1
    while True:
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        here = at[(block[at] < 0) | (block[at] != block[at + step])]
        differ = prints[here] ^ prints[here + step]
        for i, own in enumerate(masks):
            mine = first[here] == i
            if not mine.any():
                continue
            places, x = here[mine], differ[mine]
            for mask, most in own:
                ok = np.bitwise_count(x & mask) <= most
                places, x = places[ok], x[ok]
            left.append(places)
            right.append(places + step)
        step += 1
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs as edges: each of their nodes but the least with the least node that it reaches by the pairs."""
    nodes, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, least = which[: len(a)], which[len(a) :], np.arange(len(nodes))
    while True:
        before = least.copy()
        np.minimum.at(least, left, before[right])
        np.minimum.at(least, right, before[left])
        least = least[least]
        if (least == before).all():
            break
    inner = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[least[inner]], nodes[inner]


def linked(nodes: DataFrame, budget: int, members: int = 4096) -> DataFrame:
    """(a, b), a < b: edges that join the fingerprints (print long, all different) of each group, and no others."""
    n = nodes.count()
    keys = chains(budget, depth_for(n, budget))
    masks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("first"), F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long").alias("mask")) for k, (i, mask) in enumerate(keys)])
    rows = nodes.select("print", F.explode(masks).alias("x")).select("print", F.col("x.first").alias("first"), F.xxhash64("x.k", F.col("print").bitwiseAND(F.col("x.mask"))).alias("key"))
    # buckets that are too large for one task are dealt out as pairs of blocks
    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > members).select("key", F.ceil(F.col("n") / members).cast("long").alias("blocks"))
    split = rows.join(large, "key", "left")
    block = F.pmod(F.xxhash64("print", F.lit(7)), F.col("blocks"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    split = split.withColumn("block", F.coalesce(block, F.lit(-1).cast("long"))).withColumn("other", other)
    split = split.select(
        "print", "first", F.when(F.col("block") == F.col("other"), -1).otherwise(F.col("block")).cast("long").alias("block"),
        F.when(F.col("other") < 0, F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).alias("key"),
    )

    def run(batches):
        held = None
        for batch in batches:
            table_ = pa.Table.from_batches([batch])
            held = table_ if held is None else pa.concat_tables([held, table_])
            key = held.column("key").to_numpy()
            cut = int(np.flatnonzero(key != key[-1])[-1] + 1) if (key != key[-1]).any() else 0
            if cut:
                yield from pairs(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from pairs(held)

    def pairs(rows_: pa.Table):
        key, first, block_, prints = (rows_.column(c).to_numpy() for c in ("key", "first", "block", "print"))
        a, b = viable_pairs(key, first, block_, prints.view(np.uint64), budget)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(prints[a], prints[b])], ["a", "b"])

    met = split.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    return met.distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component): the smallest node that each node of links (a, b) reaches; alternating stars (large, small).

    Links that fit one task are brought together there, in one job. Otherwise each round's links are written to the shared
    folder; nothing but their number and a checksum goes to the driver."""

    def checksum(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), name)
    state = checksum(now)
    if state[0] <= LINKS_PER_TASK:

        def together(batches):
            a, b = [], []
            for batch in batches:
                a.append(batch.column(0).to_numpy())
                b.append(batch.column(1).to_numpy())
            if a:
                least, node = stars(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], ["node", "component"])

        return now.coalesce(1).mapInArrow(together, "node long, component long")
    while state[0]:
        now = now.coalesce(-(-state[0] // LINKS_PER_TASK))
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(-(-state[0] // LINKS_PER_TASK))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = written(small.where(F.col("a") != F.col("b")).distinct(), name)
        before, state = state, checksum(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4, shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id) for every row: 16 hexadecimal digits, and the smallest id of the row's group."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(*utf8(batch.column(1)), shingle).view(np.int64))], ["id", "print"])

    prints = written(map_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), work, "id long, print long"), "prints")
    nodes = written(prints.groupBy("print").agg(F.min("id").alias("rep")), "nodes")
    found = components(linked(nodes, budget))
    grouped = nodes.join(found, F.col("print") == F.col("node"), "left").withColumn("component", F.coalesce("component", "print"))
    names = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = grouped.select("print", "component").join(names, "component").select("print", "component_id")
    return prints.join(named, "print").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
